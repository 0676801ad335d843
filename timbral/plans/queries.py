"""The registered queries over the driver's tables, each with its SQL twin where SQL can say it.

Speakers are labels of `embeddings`, attempts and metric logs are `events` (a user's values in
order are also a stream of samples), transcripts are `documents`, `conversations` and
`benchmark`, and model updates are `lineitem`. Computed doubles are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timbral.functions import signal as S
from timbral.functions import text as T
from timbral.functions import vectors as V
from timbral.operators import evaluation, learning, liveness, monitoring, sequence, transcripts, verification
from timbral.session import table
from timbral.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def r4(x: Column | str) -> Column:
    """4 places, with halves nudged up: quotients of cents fall on halves often."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-8, 4)


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, i, x, event_type): each user's values in order of time."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf, "events").select("user_id", place.alias("i"), F.col("value").alias("x"), "event_type", "event_id", "ts")


SIG = "sig as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as x, event_type, event_id, ts from events)"
CELLS = "cells as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as i, cast(unnest(embedding) as double) as v from embeddings)"
CENTRES = f"""{CELLS}, means as (select label, i, avg(v) as m from cells group by label, i),
lengths as (select label, sqrt(sum(m * m)) as n from means group by label),
centres as (select m.label, m.i, m.m / l.n as c from means m join lengths l on m.label = l.label)"""
SIMS = f"""{CENTRES}, norms as (select vec_id, sqrt(sum(v * v)) as n from cells group by vec_id),
sims as (select e.vec_id, e.label, c.label as candidate, sum(e.v * c.c) / (max(n.n) * sqrt(sum(c.c * c.c))) as s
  from cells e join centres c on e.i = c.i join norms n on n.vec_id = e.vec_id group by e.vec_id, e.label, c.label)"""


@query(f"with {CENTRES} select label, cast(i as int) as i, round(c, 6) as c from centres")
def enroll_centroid(spark, sf):
    enrolled = verification.enroll(table(spark, sf, "embeddings"), "label", "embedding")
    return enrolled.select("label", F.posexplode("centroid").alias("i", "c")).select("label", "i", r6("c").alias("c"))


def similarities(spark, sf) -> DataFrame:
    """Every embedding against its own centroid."""
    vectors = table(spark, sf, "embeddings")
    return verification.verify(vectors, verification.enroll(vectors, "label", "embedding"), "label", "embedding")


@query(f"""with {SIMS} select vec_id, label, round(s, 6) as similarity,
  round(s, 6) >= 0.1 and (1 + round(s, 6)) / 2 >= 0.5 as authenticated from sims where label = candidate""")
def verify_cosine_policy(spark, sf):
    s = r6("similarity")
    accepted = verification.policy(s, (1 + s) / 2, F.lit(False), F.lit(False), threshold=0.1)
    return similarities(spark, sf).select("vec_id", "label", s.alias("similarity"), accepted.alias("authenticated"))


@query(f"""with {CENTRES}, d as (select e.vec_id, sqrt(sum((e.v - c.c) * (e.v - c.c))) as d from cells e join centres c on e.label = c.label and e.i = c.i group by e.vec_id)
select vec_id, round(d, 6) as distance, round(1 / (1 + d), 6) as similarity from d""")
def vector_euclidean_similarity(spark, sf):
    d = V.euclidean(V.doubles(F.col("embedding")), F.col("centroid"))
    return similarities(spark, sf).select("vec_id", r6(d).alias("distance"), r6(V.distance_similarity(d)).alias("similarity"))


@query(f"with {SIMS} select vec_id, label, candidate, round(s, 6) as similarity, round((round(s, 6) + 1) / 2, 7) as scaled from sims")
def identify_all_speakers(spark, sf):
    vectors = table(spark, sf, "embeddings")
    found = verification.identify(vectors, verification.enroll(vectors, "label", "embedding"), "label", "embedding", ["vec_id"])
    return found.select("vec_id", "label", "candidate", r6("similarity").alias("similarity"), F.round((r6("similarity") + 1) / 2, 7).alias("scaled"))


@query(f"""with {CELLS}, norms as (select vec_id, sqrt(sum(v * v)) as n from cells group by vec_id),
protos as (select label, i, avg(v / n) as m from cells join norms using (vec_id) group by label, i), lengths as (select label, sqrt(sum(m * m)) as n from protos group by label)
select p.label, cast(i as int) as i, round(m / n, 6) as c from protos p join lengths l on p.label = l.label""")
def class_prototypes(spark, sf):
    protos = verification.enroll(table(spark, sf, "embeddings"), "label", "embedding", normalize_first=True)
    return protos.select("label", F.posexplode("centroid").alias("i", "c")).select("label", "i", r6("c").alias("c"))


@query("""select label, cast(a as int) as i, cast(b as int) as j, round(covar_samp(cast(embedding[a + 1] as double), cast(embedding[b + 1] as double)), 6) as cov
from embeddings, range(8) x(a), range(8) y(b) where a <= b group by label, a, b""")
def speaker_covariance(spark, sf):
    return verification.profile_covariance(table(spark, sf, "embeddings"), "vec_id", "label", "embedding", 8).select("label", "i", "j", r6("cov").alias("cov"))


@query(f"with {CELLS} select label, cast(i as int) as i, round(avg(v), 6) as mean, count(*) as n from cells group by label, i")
def profile_update_merge(spark, sf):
    vectors = table(spark, sf, "embeddings")
    old, new = (verification.profile_statistics(vectors.where(F.col("vec_id") % 2 == k), "label", "embedding") for k in (0, 1))
    return verification.merge_profiles(old, new, "label").select("label", "i", r6("mean").alias("mean"), "n")


ROC = f"""{SIMS}, points as (select round(s, 6) as score, count(*) filter (label = candidate) as p, count(*) filter (label <> candidate) as q from sims group by 1),
curve as (select score as threshold, cast(sum(p) over w as bigint) as tp, cast(sum(q) over w as bigint) as fp, sum(p) over () as np, sum(q) over () as nq from points window w as (order by score desc rows unbounded preceding))"""


def genuine_trials(spark, sf) -> DataFrame:
    rows = evaluation.trials(identify_all_speakers(spark, sf), "label", "candidate", "similarity")
    return rows


@query(f"with {ROC} select threshold, tp, fp, round(tp / np, 6) as tpr, round(fp / nq, 6) as fpr from curve")
def roc_points(spark, sf):
    curve = evaluation.roc(genuine_trials(spark, sf))
    return curve.select("threshold", "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query(f"with {ROC} select round((1 - tp / np + fp / nq) / 2, 6) as eer, threshold from curve order by abs(1 - tp / np - fp / nq), threshold desc limit 1")
def trial_pairs_eer(spark, sf):
    return evaluation.equal_error_rate(evaluation.roc(genuine_trials(spark, sf))).select(r6("eer").alias("eer"), "threshold")


@query(f"""with {CELLS}, st as (select label, i, avg(v) as mu, stddev_pop(v) as sd from cells group by label, i),
sc as (select vec_id, c.label, sum(coalesce(((v - mu) / nullif(sd, 0)) * ((v - mu) / nullif(sd, 0)), 0)) as score from cells c join st on c.label = st.label and c.i = st.i group by vec_id, c.label)
select vec_id, label, round(score, 6) as score, score > (select quantile_cont(score, 0.95) from sc) as anomaly from sc""")
def diag_mahalanobis(spark, sf):
    found = learning.mahalanobis_diag(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")
    return found.select("vec_id", "label", r6("score").alias("score"), "anomaly")


@query(f"""with {SIG}, e as (select user_id, avg(d * d) as error from (select user_id, x - lag(x) over (partition by user_id order by i) as d from sig) group by user_id),
st as (select avg(error) as mu, stddev_pop(error) as sd from e)
select user_id, round(error, 4) as error, round((error - mu) / sd, 6) as z, coalesce((error - mu) / sd > 3, false) as anomaly from e, st""")
def sequence_anomaly(spark, sf):
    found = learning.sequence_anomaly(signal(spark, sf), ["user_id"], ["i"], "x")
    return found.select("user_id", F.round("error", 4).alias("error"), r6("z").alias("z"), "anomaly")


@query("""with r as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as age from events),
g as (select user_id, max(value) filter (age = 1) as current, avg(value) filter (age > 1) as before, count(*) as n from r where age <= 6 group by user_id)
select user_id, round(current, 6) as current, round(before, 6) as before, n > 5 and coalesce(abs(current - before) > 0.05, false) as drift from g""")
def drift_detect(spark, sf):
    found = monitoring.drift(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value")
    return found.select("user_id", r6("current").alias("current"), r6("before").alias("before"), "drift")


@query("""with r as (select event_type, user_id, value, row_number() over (partition by event_type order by ts desc, event_id desc) as a,
  row_number() over (partition by event_type, user_id order by ts desc, event_id desc) as b from events)
select s.event_type, s.user_id as shadow, round(c.value, 6) as current_value, round(s.value, 6) as shadow_value, round(abs(c.value - s.value), 6) as difference, abs(c.value - s.value) > 0.1 as drift
from r s join r c on s.event_type = c.event_type and c.a = 1 where s.b = 1""")
def shadow_compare(spark, sf):
    log = table(spark, sf, "events").select("event_type", F.col("user_id").alias("shadow"), "ts", "event_id", "value")
    found = monitoring.shadow_compare(log.drop("shadow"), log, "event_type", "shadow", ["ts", "event_id"], "value")
    return found.select("event_type", "shadow", *[r6(c).alias(c) for c in ("current_value", "shadow_value", "difference")], "drift")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as a from events) where a = 1")
def latest_profile(spark, sf):
    return monitoring.latest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


SCORED = "scored as (select *, value / (1 + value) as s, event_type <> 'error' as genuine from events)"


@query(f"""with {SCORED}, r as (select *, row_number() over (partition by user_id, genuine order by ts desc, event_id desc) as age from scored),
g as (select user_id, count(s) filter (genuine) as gn, avg(s) filter (genuine) as gm, stddev_pop(s) filter (genuine) as gs,
  count(s) filter (not genuine) as n, avg(s) filter (not genuine) as im, stddev_pop(s) filter (not genuine) as isd from r where age <= 100 group by user_id)
select user_id, gn as n_genuine, n as n_impostor, round(case when gn >= 10 and n >= 10 then
  greatest(0.5, least(0.95, case when im + isd < gm - gs then (im + isd + gm - gs) / 2 else (im + gm) / 2 + gs / 2 end)) else 0.7 end, 6) as threshold from g""")
def history_cap_threshold(spark, sf):
    rows = table(spark, sf, "events").withColumn("s", F.col("value") / (1 + F.col("value")))
    found = monitoring.adaptive_threshold(rows, ["user_id"], ["ts", "event_id"], "s", F.col("event_type") != "error")
    return found.select("user_id", "n_genuine", "n_impostor", r6("threshold").alias("threshold"))


@query(f"""with {SCORED}, r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as age from scored)
select user_id, round(greatest(0.7, coalesce(quantile_cont(s, 0.1) filter (genuine), 0.7)), 6) as threshold from r where age <= 100 group by user_id""")
def policy_percentile_threshold(spark, sf):
    rows = table(spark, sf, "events").withColumns({"s": F.col("value") / (1 + F.col("value")), "accepted": F.col("event_type") != "error"})
    return monitoring.policy_threshold(rows, ["user_id"], ["ts", "event_id"], "s", "accepted").select("user_id", r6("threshold").alias("threshold"))


#: Liveness components by the event type that carries them here.
CARRIERS = {"breathing": "click", "micro_modulation": "error", "resonance": "purchase", "environment": "signup", "spectrum": "view"}
PIVOT = "piv as (select user_id, " + ", ".join(f"avg(value / (1 + value)) filter (event_type = '{t}') as {c}" for c, t in CARRIERS.items()) + " from events group by user_id)"
COMPLETE = " and ".join(f"{c} is not null" for c in CARRIERS)


def component_scores(spark, sf) -> DataFrame:
    """Per user the mean component score, of users that have all components."""
    s = F.col("value") / (1 + F.col("value"))
    means = [F.avg(F.when(F.col("event_type") == t, s)).alias(c) for c, t in CARRIERS.items()]
    return table(spark, sf, "events").groupBy("user_id").agg(*means).where(COMPLETE)


FUSED = "+".join(f"{w}::double * {c}" for c, w in verification.LIVENESS_WEIGHTS.items())


@query(f"""with {PIVOT}, f as (select user_id, round({FUSED}, 6) as score from piv where {COMPLETE})
select user_id, score, score >= 0.9 as is_live, round(greatest(0, least(1, case when score >= 0.9 then (score - 0.9) / (1 - 0.9) else (0.9 - score) / 0.9 end)), 5) as confidence from f""")
def liveness_fusion(spark, sf):
    rows = component_scores(spark, sf)
    score = r6(V.weighted([F.col(c) for c in CARRIERS], [verification.LIVENESS_WEIGHTS[c] for c in CARRIERS]))
    rows = rows.withColumn("score", score)
    again = verification.liveness({c: F.col("score") for c in CARRIERS}, threshold=0.9)  # weights sum to 1
    return rows.select("user_id", "score", (F.col("score") >= 0.9).alias("is_live"), F.round(again["confidence"], 5).alias("confidence"))


@query(f"""with {PIVOT}, last as (select * from piv where {COMPLETE} order by user_id desc limit 50), v as (select count(*) as n, {", ".join(f"1 / (var_pop({c}) + 1e-10) as {c}" for c in CARRIERS)} from last)
{" union all ".join(f"select '{c}' as component, round(case when n >= 10 then 0.8 * {verification.LIVENESS_WEIGHTS[c]} + 0.2 * {c} / ({' + '.join(CARRIERS)}) else {verification.LIVENESS_WEIGHTS[c]} end, 6) as weight from v" for c in CARRIERS)}""")
def inverse_variance_weights(spark, sf):
    found = monitoring.adapt_weights(component_scores(spark, sf), ["user_id"], {c: verification.LIVENESS_WEIGHTS[c] for c in CARRIERS})
    return found.select("component", r6("weight").alias("weight"))


@query("""with d as (select d.lang, d.source from documents d join labels l on d.doc_id = l.doc_id),
m as (select round(avg(cast(quality = 1 - toxic as int)), 6) as accuracy from labels)
select 'lang' as demographic, lang as category, count(*) as count, max(accuracy) as accuracy from d, m where lang is not null group by lang
union all select 'source', source, count(*), max(accuracy) from d, m where source is not null group by source""")
def demographic_metrics(spark, sf):
    labels = table(spark, sf, "labels")
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source").join(labels, "doc_id")
    right = F.avg((F.col("quality") == 1 - F.col("toxic")).cast("int"))
    return monitoring.demographics(rows, ["lang", "source"], labels.agg(r6(right).alias("accuracy")))


@query("""with l as (select quality as y from labels union select 1 - toxic from labels)
select a.y as truth, b.y as predicted, (select count(*) from labels t where t.quality = a.y and 1 - t.toxic = b.y) as n from l a, l b where a.y is not null and b.y is not null""")
def confusion_matrix(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("predicted"))
    return evaluation.confusion(rows, "truth", "predicted")


@query("""with e as (select quality as truth, round(1 / (1 + exp(-(n_chars - 1500) / 1000.0)), 6) as score from labels join documents using (doc_id)),
r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from e)
select round(avg(cast(cast(score > 0.5 as int) = truth as int)), 6) as accuracy,
  round((sum(rk) filter (truth = 1) - count(*) filter (truth = 1) * (count(*) filter (truth = 1) + 1) / 2.0) / (count(*) filter (truth = 1) * count(*) filter (truth = 0)), 6) as auc,
  round(2.0 * count(*) filter (score > 0.5 and truth = 1) / (count(*) filter (score > 0.5) + count(*) filter (truth = 1)), 6) as f1 from r""")
def binary_metrics(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", r6(V.sigmoid((F.col("n_chars") - 1500) / 1000.0)).alias("score"))
    rows = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("truth")).join(docs, "doc_id")
    return evaluation.binary_metrics(rows).select(*[r6(c).alias(c) for c in ("accuracy", "auc", "f1")])


@query("""with s as (select event_id, value / (1 + value) as sim, exp(-value) * 1e-6 as pdf from events),
c as (select *, 1 - exp(-pdf * 1e6) as l, 0.7 * sim + 0.3 * (1 - exp(-pdf * 1e6)) as comb from s)
select event_id, round(l, 6) as likelihood, round(comb, 6) as combined, round(comb, 9) >= 0.7 as verified,
  round(greatest(0, least(1, case when comb >= 0.7 then (comb - 0.7) / (1 - 0.7) else 1 - (0.7 - comb) / 0.7 end)), 6) as confidence, round(abs(comb - 0.7), 9) < 0.1 as borderline from c""")
def confidence_score(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("value") / (1 + F.col("value"))).alias("sim"), (F.exp(-F.col("value")) * 1e-6).alias("pdf"))
    s = verification.score_verification(F.col("sim"), F.col("pdf"), 0.7)
    rows = rows.select("event_id", s.alias("s"))
    return rows.select("event_id", *[r6(f"s.{c}").alias(c) for c in ("likelihood", "combined", "confidence")], "s.verified", "s.borderline")


@query("""select event_id, round(case when value < 100 then 1 - least(1, (100 - value) / 100) when value > 300 then 1 - least(1, (value - 300) / 300)
  else 1 - least(1, 2 * abs(value - 200) / 200) end, 6) as score from events""")
def range_score(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(V.range_score(F.col("value"), 100.0, 300.0)).alias("score"))


def decisions(spark, sf) -> DataFrame:
    """Scores that never lie halfway between two printed numbers."""
    c = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", (r6(c / (c + 97)) + 1e-7).alias("sim"), F.when(F.col("event_type") != "view", r6(c / 499) + 1e-7).alias("spoof"),
        F.when(F.col("event_type") == "error", r6(c / 101) + 1e-7).otherwise(0.0).alias("anomaly"), F.when(F.col("event_type") == "click", r6(c / 149) + 1e-7).otherwise(0.0).alias("seq"),
    )


DECISIONS = """d as (select event_id, round(value / (value + 97), 6) + 1e-7 as sim, case when event_type <> 'view' then round(value / 499, 6) + 1e-7 end as spoof,
  case when event_type = 'error' then round(value / 101, 6) + 1e-7 else 0 end as anomaly, case when event_type = 'click' then round(value / 149, 6) + 1e-7 else 0 end as seq from events)"""
shown = lambda text, c: f"replace('{text}', '%', printf('%.3f', {c}))"


@query(f"""with {DECISIONS}, x as (select *, sim >= 0.7 as ok from d)
select event_id, concat_ws(' ', case when ok then 'Authentication successful.' else 'Authentication failed.' end,
  case when sim >= 0.7 then {shown("Voice similarity is very high (%).", "sim")} when sim >= 0.5 then {shown("Voice similarity is good (%).", "sim")} else {shown("Voice similarity is low (%).", "sim")} end,
  case when spoof >= 0.8 then {shown("Voice authenticity is very high (%).", "spoof")} when spoof >= 0.5 then {shown("Voice authenticity is acceptable (%).", "spoof")} when spoof is not null then {shown("Voice authenticity is questionable (%).", "spoof")} end,
  case when anomaly >= 3 then {shown("Significant anomalies detected (%).", "anomaly")} when anomaly >= 1 then {shown("Minor anomalies detected (%).", "anomaly")} end,
  case when seq >= 3 then {shown("Unusual authentication pattern detected (%).", "seq")} when seq >= 1 then {shown("Slightly unusual authentication pattern (%).", "seq")} end,
  case when ok then 'All security checks passed.' when sim < 0.5 then 'Voice does not match enrolled user.' when spoof < 0.5 then 'Voice may be synthetic or manipulated.'
    when anomaly >= 3 then 'Authentication blocked due to security anomalies.' when seq >= 3 then 'Authentication blocked due to unusual access pattern.'
    else 'Multiple security factors did not meet required thresholds.' end) as explanation from x""")
def policy_explanation(spark, sf):
    c = F.col
    return decisions(spark, sf).select("event_id", verification.explanation(c("sim"), c("spoof"), c("anomaly"), c("seq"), c("sim") >= 0.7).alias("explanation"))


@query(f"""with {DECISIONS} select event_id, 'voice_similarity' as factor, round(sim, 6) as score from d union all select event_id, 'antispoofing', round(spoof, 6) from d where spoof is not null
union all select event_id, 'anomaly', round(1 - greatest(0, least(1, anomaly)), 6) from d where anomaly <> 0 union all select event_id, 'sequence', round(1 - greatest(0, least(1, seq)), 6) from d where seq <> 0""")
def policy_factors(spark, sf):
    c = F.col
    listed = decisions(spark, sf).select("event_id", F.explode(verification.factors(c("sim"), c("spoof"), c("anomaly"), c("seq"))).alias("f"))
    return listed.select("event_id", "f.factor", r6("f.score").alias("score"))


FRAMES = f"""{SIG}, frames as (select s.user_id, f.frame, sqrt(avg(s.x * s.x)) as rms, sum(s.x * s.x) as energy, array_agg(s.x order by s.i) as xs
  from (select user_id, count(*) as n from sig group by user_id) c, unnest(range(0, (c.n - 8) // 4 + 1)) as f(frame), sig s
  where c.n >= 8 and s.user_id = c.user_id and s.i >= f.frame * 4 and s.i < f.frame * 4 + 8 group by s.user_id, f.frame)"""


@query(f"with {FRAMES} select user_id, frame, round(rms, 6) as rms, round(energy, 4) as energy from frames")
def framing_rms(spark, sf):
    found = sequence.frame_levels(signal(spark, sf), ["user_id"], "x", 8, 4)
    return found.select("user_id", F.col("frame").cast("long").alias("frame"), r6("rms").alias("rms"), F.round("energy", 4).alias("energy"))


@query(f"with {FRAMES} select user_id, frame, round(xs[1], 6) as first, round(xs[8], 6) as last, len(xs) as n from frames")
def framing_samples(spark, sf):
    found = sequence.framed(signal(spark, sf), ["user_id"], "x", 8, 4)
    return found.select("user_id", F.col("frame").cast("long").alias("frame"), r6(F.col("x")[0]).alias("first"), r6(F.element_at("x", -1)).alias("last"), F.size("x").cast("long").alias("n"))


@query(f"with {SIG} select event_id, round(sum(x) over (partition by user_id order by i rows between 2 preceding and 2 following) / 5, 6) as smooth from sig")
def envelope_smooth(spark, sf):
    return sequence.envelope(signal(spark, sf), ["user_id"], "x").select("event_id", r6("smooth").alias("smooth"))


@query(f"""with {SIG} select event_id, round((x - avg(x) over w) / (stddev_pop(x) over w + 1e-10), 6) as norm from sig window w as (partition by user_id order by i rows between 10 preceding and 9 following)""")
def cmvn_window(spark, sf):
    return sequence.cmvn(signal(spark, sf), ["user_id"], "x", 20).select("event_id", r6("norm").alias("norm"))


@query(f"""with {SIG}, v as (select *, coalesce(x - lag(x) over (partition by user_id order by i), 0) as velocity from sig)
select event_id, round(velocity, 6) as velocity, round(coalesce(velocity - lag(velocity) over (partition by user_id order by i), 0), 6) as acceleration from v""")
def deltas(spark, sf):
    return sequence.deltas(signal(spark, sf), ["user_id"], "x").select("event_id", r6("velocity").alias("velocity"), r6("acceleration").alias("acceleration"))


@query(f"""with {SIG}, u as (select user_id, i, x - 50 >= 0 as up from sig), w as (select user_id, up, lag(up) over (partition by user_id order by i) as was from u)
select user_id, round(avg(cast(up <> was as int)), 6) as rate from w group by user_id""")
def zero_crossing_rate(spark, sf):
    rows = signal(spark, sf).withColumn("x", F.col("x") - 50)
    return sequence.zero_crossings(rows, ["user_id"], "x").select("user_id", r6("rate").alias("rate"))


@query(f"""with {SIG}, v as (select user_id, x, abs(x - lag(x) over (partition by user_id order by i)) as d from sig where x > 20)
select user_id, round(avg(d) / avg(x), 6) as jitter, round(avg(d) / avg(x), 6) as shimmer from v group by user_id""")
def jitter_shimmer(spark, sf):
    found = sequence.jitter_shimmer(signal(spark, sf).withColumn("a", F.col("x")), ["user_id"], "x", "a", F.col("x") > 20)
    return found.select("user_id", r6("jitter").alias("jitter"), r6("shimmer").alias("shimmer"))


@query(f"""with {SIG}, w as (select user_id, i, count(*) over (partition by user_id) as n, max(x) over f - min(x) over f as r, min(cast(x > 10 as int)) over f as v from sig
  window f as (partition by user_id order by i rows between current row and 4 following))
select user_id, i as start, round(r, 6) as range from w where i < n - 5 and v = 1""")
def local_range(spark, sf):
    found = sequence.local_range(signal(spark, sf), ["user_id"], "x", F.col("x") > 10)
    return found.select("user_id", F.col("start").cast("long").alias("start"), r6("range").alias("range"))


OTSU = f"""{SIG}, sh as (select *, x / max(x) over (partition by user_id) as share from sig), h as (select user_id, cast(least(floor(share * 100), 99) as int) as bin, count(*) as c from sh group by 1, 2),
hh as (select user_id, bin, c, sum(c) over w as c1, sum(c * (bin + 0.5::double) / 100) over w as m1, sum(c) over (partition by user_id) as n, sum(c * (bin + 0.5::double) / 100) over (partition by user_id) as mt
  from h window w as (partition by user_id order by bin rows unbounded preceding)),
b as (select user_id, bin, round((c1 / n) * (1 - c1 / n) * power(m1 / c1 - coalesce((mt - m1) / nullif(n - c1, 0), 0), 2), 12) as v from hh),
otsu as (select user_id, (min(bin) + 0.5::double) / 100 as threshold from (select *, max(v) over (partition by user_id) as top from b) where v = top group by user_id),
vad as (select s.*, coalesce(share > threshold * 0.5::double, false) as speech from sh s join otsu using (user_id)),
fwd as (select *, count(*) over (partition by user_id) as n, speech or (i < count(*) over (partition by user_id) - 5 and sum(cast(speech as int)) over (partition by user_id order by i rows between current row and 4 following) >= 2) as f from vad),
smooth as (select *, f or (i > 5 and sum(cast(f as int)) over (partition by user_id order by i rows between 5 preceding and 1 preceding) >= 2) as s from fwd)"""


@query(f"with {OTSU} select user_id, round(threshold, 6) as threshold from otsu")
def vad_otsu(spark, sf):
    return sequence.otsu_threshold(signal(spark, sf), ["user_id"], "x").select("user_id", r6("threshold").alias("threshold"))


def speech(spark, sf) -> DataFrame:
    return sequence.smooth_decisions(sequence.energy_vad(signal(spark, sf), ["user_id"], "x"), ["user_id"], "speech")


@query(f"with {OTSU} select event_id, speech, s as smooth from smooth")
def vad_smooth(spark, sf):
    return speech(spark, sf).select("event_id", "speech", "smooth")


@query(f"""with {OTSU}, g as (select user_id, i, i - row_number() over (partition by user_id order by i) as island from smooth where s)
select user_id, min(i) as start, max(i) + 1 as "end" from g group by user_id, island having count(*) >= 3""")
def speech_segments(spark, sf):
    found = sequence.segments(speech(spark, sf), ["user_id"], "smooth", 3)
    return found.select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""with {SIG}, l as (select *, count(*) over (partition by user_id) as n, x < lag(x) over (partition by user_id order by i) as falls from sig),
r as (select *, sum(cast(not coalesce(falls, false) as int)) over (partition by user_id order by i) as run from l),
g as (select user_id, min(i) as start, count(*) - 1 as steps, max(x) - min(x) as d, max(n) as n from r group by user_id, run),
k as (select user_id, 60 / (d / (steps * 0.5::double)) as rt60 from g where steps > 2 and start < n - 10 and d > 0)
select u.user_id, round(coalesce(m, 0.3::double), 6) as rt60 from (select distinct user_id from sig) u left join (select user_id, median(rt60) as m from k where rt60 > 0.1 and rt60 < 2 group by user_id) q on u.user_id = q.user_id""")
def reverb_decay_runs(spark, sf):
    return sequence.decay_runs(signal(spark, sf), ["user_id"], "x", 0.5, least=2).select("user_id", r6("rt60").alias("rt60"))


@query(f"""with {SIG}, n as (select user_id, i, x, lag(x) over w as l, lead(x) over w as r from sig window w as (partition by user_id order by i))
select user_id, i, round(x, 6) as x from n where x > l and x > r and x >= 100""")
def peak_picking(spark, sf):
    return sequence.local_maxima(signal(spark, sf), ["user_id"], "x", 100.0).select("user_id", F.col("i").cast("long").alias("i"), r6("x").alias("x"))


QUALITY = f"""{SIG}, q as (select user_id, i, x / 500 as y from sig), fr as (select s.user_id, f.frame, sum(s.y * s.y) as e
  from (select user_id, count(*) as n from q group by user_id) c, unnest(range(0, c.n)) as f(frame), q s where f.frame + 2 <= c.n and s.user_id = c.user_id and s.i >= f.frame and s.i < f.frame + 2 group by s.user_id, f.frame),
sp as (select user_id, avg(cast(e > 0.1::double * top as int)) as speech_ratio from (select *, max(e) over (partition by user_id) as top from fr) group by user_id),
st as (select user_id, count(*) / 80.0::double as duration, sqrt(avg(y * y)) as rms, avg(cast(abs(y) > 0.99 as int)) as clipping_ratio, avg(y) as dc_offset,
  20 * log10(quantile_cont(abs(y), 0.9) / (quantile_cont(abs(y), 0.1) + 1e-10)) as estimated_snr from q group by user_id)"""


@query(f"""with {QUALITY}, c as (select st.*, speech_ratio, duration >= 0.5 and duration <= 30 as c1, rms >= 0.01 as c2, clipping_ratio <= 0.01 as c3, abs(dc_offset) <= 0.1 as c4, coalesce(estimated_snr >= 15, false) as c5, coalesce(speech_ratio >= 0.3, false) as c6 from st left join sp using (user_id))
select user_id, round(rms, 6) as rms, round(dc_offset, 6) as dc_offset, round(estimated_snr, 6) as estimated_snr, round(speech_ratio, 6) as speech_ratio,
  round((1 + c1::int + c2::int + c3::int + c4::int + c5::int + c6::int) / 7.0, 6) as overall_quality, c1 and c2 and c3 and c4 and c5 and c6 as pass from c""")
def quality_checks(spark, sf):
    rows = signal(spark, sf).withColumn("x", F.col("x") / 500)
    found = sequence.audio_quality(rows, ["user_id"], "x", 80, {"min_rate": 80})
    return found.select("user_id", *[r6(c).alias(c) for c in ("rms", "dc_offset", "estimated_snr", "speech_ratio", "overall_quality")], "pass")


@query("""select vec_id, round(-regr_slope(20 * log10(abs(v) + 1e-10), log10(i + 1)), 6) as tilt from (select vec_id, generate_subscripts(embedding, 1) - 1 as i, cast(unnest(embedding) as double) as v from embeddings) group by vec_id""")
def spectral_tilt(spark, sf):
    cells = verification.components(table(spark, sf, "embeddings"), ["vec_id"], "embedding")
    level = 20 * F.log10(F.abs(F.col("v")) + 1e-10)
    return cells.groupBy("vec_id").agg(r6(-F.regr_slope(level, F.log10(F.col("i") + 1))).alias("tilt"))


@query(f"""with {CELLS}, p as (select vec_id, abs(v) / sum(abs(v)) over (partition by vec_id) as p from cells) select vec_id, round(-sum(p * log2(p + 1e-10)), 6) as entropy from p group by vec_id""")
def spectral_entropy(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6(V.entropy_bits(F.transform(V.doubles(F.col("embedding")), F.abs))).alias("entropy"))


@query(f"""with {CELLS}, bands as (select vec_id, i // 8 as band, i % 8 as k, v from cells)
select cast(a.band as int) as a, cast(b.band as int) as b, round(corr(a.v, b.v), 6) as r from bands a join bands b on a.vec_id = b.vec_id and a.k = b.k and a.band < b.band group by 1, 2""")
def subband_correlation(spark, sf):
    v = V.doubles(F.col("embedding"))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.slice(v, 8 * a + 1, 8).alias("x"), F.slice(v, 8 * b + 1, 8).alias("y")) for a in range(8) for b in range(a + 1, 8)]
    rows = table(spark, sf, "embeddings").select(F.explode(F.array(*pairs)).alias("p")).select("p.a", "p.b", F.explode(F.arrays_zip("p.x", "p.y")).alias("z"))
    return rows.groupBy("a", "b").agg(r6(F.corr("z.x", "z.y")).alias("r"))


@query("select doc_id, sha256(lower(trim(regexp_replace(translate(coalesce(text, ''), '.,;:!?-', ''), '\\s+', ' ', 'g')))) as normalized_sha256 from documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.normalize_text(F.coalesce("text", F.lit(""))), 256).alias("normalized_sha256"))


@query("""select item_id, substr(sha256('s' || item_id), 1, 16) as session_id, sha256(concat_ws(':', substr(sha256('s' || item_id), 1, 16), text, '1704067200')) as hash, round(least(10, greatest(3, length(text) / 10.0 + 2)), 6) as seconds from benchmark""")
def verification_hash(spark, sf):
    sid = T.session_id(F.concat(F.lit("s"), F.col("item_id").cast("string")))
    rows = table(spark, sf, "benchmark")
    return rows.select("item_id", sid.alias("session_id"), T.verification_hash(sid, F.col("text"), F.lit("1704067200")).alias("hash"), r6(T.reading_seconds(F.col("text"))).alias("seconds"))


WORDS = """w as (select conv_id, turn, string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') as words from conversations where regexp_replace(text, '\\s+', '', 'g') <> ''),
x as (select conv_id, turn, len(words) as n, generate_subscripts(words, 1) - 1 as word_no, unnest(words) as word from w)"""


@query(f"""with {WORDS} select conv_id, turn, cast(word_no as int) as word_no, word, round(word_no * (n * 0.4::double / n), 6) as start, cast(coalesce(sum(cast(regexp_matches(word, '[.!?]$') as int)) over (partition by conv_id, turn order by word_no rows between unbounded preceding and 1 preceding), 0) as bigint) as sentence_no from x""")
def annotation_words(spark, sf):
    rows = table(spark, sf, "conversations")
    n = F.size(F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+"))
    found = transcripts.annotate_words(rows, ["conv_id", "turn"], "text", n * 0.4)
    return found.select("conv_id", "turn", "word_no", "word", r6("start").alias("start"), "sentence_no")


@query("""with w as (select item_id, generate_subscripts(string_split(text, ' '), 1) as word_no, unnest(string_split(text, ' ')) as word from benchmark where text is not null),
k as (select *, least(greatest(length(word), 1), 6) as k from w), i as (select *, unnest(range(0, k)) as i from k)
select item_id, cast(word_no as int) as word_no, cast(i + 1 as int) as no, substr(word, cast(i + 1 as bigint), 1) as phoneme, round(i / k, 6) as start, round((i + 1) / k, 6) as "end" from i""")
def phonemes(spark, sf):
    rows = table(spark, sf, "benchmark").where("text is not null").select("item_id", F.posexplode(F.split("text", " ")).alias("p", "word"))
    rows = rows.select("item_id", (F.col("p") + 1).alias("word_no"), F.posexplode(T.phonemes(F.col("word"))).alias("n", "x"))
    return rows.select("item_id", "word_no", (F.col("n") + 1).alias("no"), "x.phoneme", r6("x.start").alias("start"), r6("x.end").alias("end"))


@query("""with c as (select user_id, min(ts) + interval 14 days as expires_at from events where event_type = 'signup' group by user_id)
select e.event_id, case when c.expires_at is null then 'invalid' when e.ts > c.expires_at then 'expired' else 'open' end as status from events e left join c using (user_id)""")
def challenge_expiry(spark, sf):
    events = table(spark, sf, "events")
    challenges = events.where("event_type = 'signup'").groupBy("user_id").agg((F.min("ts") + F.expr("interval 14 days")).alias("expires_at"))
    return transcripts.match_responses(events, challenges, "user_id", "ts", "expires_at").select("event_id", "status")


@query("""with p as (select *, row_number() over (partition by user_id order by ts, event_id) as place from events),
g as (select user_id, min(place) filter (event_type = 'purchase') as won, max(place) as n from p where place <= 4 group by user_id)
select user_id, case when won is not null then 'verified' when n > 3 then 'failed' else 'pending' end as state, coalesce(won, n) as attempts from g""")
def session_state(spark, sf):
    found = transcripts.session_states(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")
    return found.select("user_id", "state", F.col("attempts").cast("long").alias("attempts"))


@query("select event_id, round(0.5 - abs(round(value / (1 + value), 6) - 0.5), 6) as uncertainty from events order by 2 desc, 1 limit 100")
def uncertainty_topk(spark, sf):
    found = learning.uncertainty_topk(table(spark, sf, "events"), "event_id", r6(F.col("value") / (1 + F.col("value"))), 100)
    return found.select("event_id", r6("uncertainty").alias("uncertainty"))


GROUPS = """g as (select 'c_mktsegment:' || c_mktsegment || '+c_nationkey:' || c_nationkey as group_key, count(*) as size from customer group by 1),
a as (select g.*, n, total, least(2, 500 // n) as low from g, (select count(*) as n, sum(size) as total from g))"""


@query(f"with {GROUPS} select group_key, size, cast(least(size, low + floor((500 - low * n) * size / total)) as bigint) as allocation from a")
def diversity_alloc(spark, sf):
    return learning.diversity_allocation(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], 500)


@query()
def diversity_sample(spark, sf):
    return learning.diverse_sample(table(spark, sf, "customer"), "c_custkey", ["c_mktsegment", "c_nationkey"], 500).select("c_custkey", "group_key")


@query()
def kmeans_select(spark, sf):
    return learning.representatives(table(spark, sf, "embeddings"), "vec_id", "embedding", 10)


FED = "fed as (select l_linenumber, l_partkey, sum(l_extendedprice * l_quantity) / sum(l_quantity) as mean, count(*) as clients from lineitem group by 1, 2)"


def federated(spark, sf) -> DataFrame:
    return learning.federated_mean(table(spark, sf, "lineitem"), ["l_linenumber", "l_partkey"], "l_extendedprice", "l_quantity")


@query(f"with {FED} select l_linenumber, l_partkey, round(mean + 1e-8, 4) as mean, clients from fed")
def fed_weighted_mean(spark, sf):
    return federated(spark, sf).select("l_linenumber", "l_partkey", r4("mean").alias("mean"), "clients")


@query(f"with {FED}, sd as (select l_linenumber, stddev_samp(mean) as sd from fed group by 1) select f.l_linenumber, l_partkey, round(case when abs(mean) < 2 * sd then 0 else mean end + 1e-8, 4) as kept from fed f join sd on f.l_linenumber = sd.l_linenumber")
def fed_sigma_threshold(spark, sf):
    return learning.sigma_threshold(federated(spark, sf), "l_linenumber", "mean", 2.0).select("l_linenumber", "l_partkey", r4("kept").alias("kept"))


@query("""with n as (select l_suppkey, sqrt(sum(l_extendedprice * l_extendedprice)) as norm from lineitem group by 1)
select l_orderkey, l_linenumber, round(l_extendedprice * least(1, 100000 / (norm + 1e-10)), 6) as clipped from lineitem join n using (l_suppkey)""")
def fed_clip(spark, sf):
    return learning.clip_norm(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", 100000.0).select("l_orderkey", "l_linenumber", r6("clipped").alias("clipped"))


@query("""select l_orderkey, l_linenumber, case when row_number() over (partition by l_suppkey, l_linenumber order by abs(l_extendedprice) desc, l_orderkey)
  <= greatest(1, floor(count(*) over (partition by l_suppkey, l_linenumber) * 0.1::double)) then l_extendedprice else 0 end as kept from lineitem""")
def fed_topk(spark, sf):
    found = learning.top_share(table(spark, sf, "lineitem"), ["l_suppkey", "l_linenumber"], ["l_orderkey"], "l_extendedprice")
    return found.select("l_orderkey", "l_linenumber", "kept")


@query("""with t as (select l_linenumber, max(abs(l_extendedprice)) / 127 as scale from lineitem group by 1)
select l_orderkey, l_linenumber, cast(round_even(l_extendedprice / scale, 0) as int) as code, round(round_even(l_extendedprice / scale, 0) * scale, 4) as restored from lineitem join t using (l_linenumber)""")
def fed_quantize(spark, sf):
    found = learning.quantize(table(spark, sf, "lineitem"), ["l_linenumber"], "l_extendedprice")
    return found.select("l_orderkey", "l_linenumber", "code", F.round("restored", 4).alias("restored"))


@query("select l_orderkey, l_linenumber, round(sum(l_extendedprice), 4) as value from lineitem group by 1, 2")
def secret_sharing(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    shares = learning.secret_shares(rows, "l_extendedprice", 3, 42)
    return learning.reconstruct(shares, ["l_orderkey", "l_linenumber"], 2).select("l_orderkey", "l_linenumber", F.round("value", 4).alias("value"))


@query("""with c as (select event_id, value / 500 as x from events), q as (select event_id, x, round_even((sign(x) * ln(1 + 255 * abs(x)) / ln(256) + 1) / 2 * 255, 0) as code from c), y as (select *, 2 * code / 255 - 1 as y from q)
select event_id, round(sign(y) * (power(256, abs(y)) - 1) / 255, 6) as decoded from y""")
def mulaw(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(V.mu_law(F.col("value") / 500)).alias("decoded"))


@query("""with l as (select l_orderkey as o_orderkey, 'supplier ' || min(l_suppkey) as participant_id, round(avg(l_discount), 6) as quality_score, bool_or(l_returnflag = 'R') as has_transcript from lineitem where l_tax > 0.04 group by 1)
select o_orderkey, coalesce(participant_id, 'unknown') as participant_id, coalesce(quality_score, 0) as quality_score, coalesce(has_transcript, false) as has_transcript from orders left join l using (o_orderkey)""")
def catalog_left_join(spark, sf):
    side = table(spark, sf, "lineitem").where("l_tax > 0.04").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.concat(F.lit("supplier "), F.min("l_suppkey")).alias("participant_id"), r6(F.avg("l_discount")).alias("quality_score"), F.bool_or(F.col("l_returnflag") == "R").alias("has_transcript"),
    )
    return transcripts.catalog(table(spark, sf, "orders").select("o_orderkey"), side, "o_orderkey")


@query("""with m as (select event_type, avg(value) as m, date_trunc('day', ts) as d from events group by 1, 3), r as (select *, row_number() over (partition by event_type order by d desc) as a from m)
select coalesce(bool_or(b.m - c.m > 0.05), false) as retrain from r c join r b on c.event_type = b.event_type and c.a = 1 and b.a = 10""")
def should_retrain(spark, sf):
    days = table(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("m"))
    rows = monitoring.recent(days, ["event_type"], ["day"], 10)
    metric = F.lit("accuracy")
    keyed = rows.select(F.concat("event_type").alias("kind"), "day", F.col("m").alias("value"), "age", metric.alias("metric"))
    pairs = keyed.where("age = 1").select("kind", F.col("value").alias("now_value"), F.col("day").alias("now")).join(keyed.where("age = 10").select("kind", F.col("value").alias("then_value"), F.col("day").alias("then")), "kind")
    worst = pairs.agg(F.max(F.struct((F.col("then_value") - F.col("now_value")).alias("fall"), "now_value", "then_value", "now", "then")).alias("w")).select("w.*").where("then_value is not null")
    last = worst.select(metric.alias("metric"), F.col("then_value").alias("value"), F.col("then").cast("timestamp").alias("trained_at"))
    current = worst.select(metric.alias("metric"), F.col("now_value").alias("value"), F.col("now").cast("timestamp").alias("now"))
    return monitoring.should_retrain(last, current)


@query(f"""with {SIG}, d as (select user_id, abs(x - lag(x) over (partition by user_id order by i)) as step from sig)
select user_id, round(avg(1 - least(1, step / 150)), 6) as continuity, round(avg(step), 6) as transition, round(avg(cast(step < 50 as int)), 6) as stability from d group by user_id""")
def track_continuity(spark, sf):
    found = liveness.continuity(signal(spark, sf), ["user_id"], "x", 150.0)
    return found.select("user_id", *[r6(c).alias(c) for c in ("continuity", "transition", "stability")])


@query(f"""with {FRAMES}, m as (select user_id, frame, list_min(xs) as low from frames) select user_id, round(1 / (1 + stddev_pop(low) / nullif(avg(low), 0)), 6) as stability from m group by user_id""")
def noise_floor_stability(spark, sf):
    frames = sequence.framed(signal(spark, sf), ["user_id"], "x", 8, 4).withColumn("low", F.array_min("x"))
    return liveness.noise_floor_stability(frames, ["user_id"], "low").select("user_id", r6("stability").alias("stability"))


@query(f"""with {SIG} select user_id, round(case when count(x) > 2 then 1 / (1 + stddev_pop(x) / avg(x)) else 0 end, 6) as stability from sig where x > 0 group by user_id""")
def pitch_stability(spark, sf):
    return liveness.pitch_stability(signal(spark, sf), ["user_id"], "x").select("user_id", r6("stability").alias("stability"))


@query("select event_id, case when f0 < 75 then 'low' when f0 > 400 then 'high' when f0 is not null then 'normal' when value > 100 then 'speech' else 'silence' end as status from (select *, case when event_type <> 'error' then value end as f0 from events)")
def pitch_status(spark, sf):
    f0 = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf, "events").select("event_id", liveness.pitch_status(f0, F.col("value") > 100).alias("status"))


@query(f"""with {SIG}, n as (select user_id, i, x, lag(x) over w as l, lead(x) over w as r from sig window w as (partition by user_id order by i)), p as (select user_id, i from n where x > l and x > r and x >= 100),
g as (select user_id, i, i - lag(i) over (partition by user_id order by i) as gap from p), h as (select *, lag(gap) over (partition by user_id order by i) as was from g)
select user_id, count(*) as n_peaks, round(coalesce(100 * avg(abs(gap - was) / ((gap + was) / 2.0::double)), 0), 6) as npvi, round(coalesce(100 * stddev_pop(gap) / avg(gap), 0), 6) as varco from h group by user_id""")
def rhythm_npvi(spark, sf):
    found = liveness.rhythm(peak_picking(spark, sf), ["user_id"], "i")
    return found.select("user_id", "n_peaks", r6("npvi").alias("npvi"), r6("varco").alias("varco"))


@query(f"""with {CELLS}, s as (select label, i, v * 3 - lag(v * 3) over (partition by label, i order by vec_id) as step from cells), b as (select label, i, stddev_pop(atan2(sin(step), cos(step))) as sd from s group by 1, 2)
select label, round(1 / (1 + avg(sd)), 6) as coherence from b group by label""")
def phase_coherence(spark, sf):
    cells = verification.components(table(spark, sf, "embeddings"), ["label", "vec_id"], "embedding")
    cells = cells.select("label", F.col("i").alias("bin"), F.col("vec_id").alias("i"), (F.col("v") * 3).alias("phase"))
    return liveness.phase_coherence(cells, ["label"], "bin", "phase").select("label", r6("coherence").alias("coherence"))


BANDS = [("low", 0, 7), ("middle", 8, 31), ("high", 32, 63), ("beyond", 64, 90)]


@query(f"with {CELLS} " + " union all ".join(f"select vec_id, '{n}' as band, round(coalesce(avg(abs(v)) filter (i between {a} and {b}), 0), 6) as energy from cells group by vec_id" for n, a, b in BANDS))
def band_energies(spark, sf):
    cells = verification.components(table(spark, sf, "embeddings"), ["vec_id"], "embedding").withColumn("m", F.abs("v"))
    return liveness.band_means(cells, ["vec_id"], "i", "m", BANDS).select("vec_id", "band", r6("energy").alias("energy"))


@query(f"""with {CELLS}, w as (select vec_id, i, abs(v) as m, lag(abs(v)) over (partition by vec_id order by i) as was from cells)
select vec_id, round(greatest(0, least(1, 1 - sum(case when i >= 56 and m < 0.7::double * was then 0.2::double * i / 64 else 0 end))), 6) as score from w group by vec_id""")
def cutoff_score(spark, sf):
    cells = verification.components(table(spark, sf, "embeddings"), ["vec_id"], "embedding").withColumn("m", F.abs("v"))
    return liveness.cutoff_score(cells, ["vec_id"], "i", "m", 56.0, 64.0).select("vec_id", r6("score").alias("score"))


@query(f"""with {CELLS}, m as (select vec_id, i, abs(v) as m, sum(abs(v)) over (partition by vec_id) as t, sum(abs(v)) over (partition by vec_id order by i rows unbounded preceding) as c from cells),
g as (select vec_id, sum(m * i * 125) / sum(m) as f, exp(avg(ln(m * m + 1e-10))) / avg(m * m + 1e-10) as flat, count(*) filter (c < t * 0.85::double) as roll from m group by vec_id)
select m.vec_id, round(max(f), 4) as centroid, round(sqrt(sum(m * (i * 125 - f) * (i * 125 - f)) / sum(m)), 4) as bandwidth, round(max(flat), 6) as flatness, max(roll) as rolloff from m join g on m.vec_id = g.vec_id group by m.vec_id""")
def spectral_shape(spark, sf):
    mag = F.transform(V.doubles(F.col("embedding")), F.abs)
    rows = table(spark, sf, "embeddings").select("vec_id", mag.alias("m"))
    return rows.select("vec_id", F.round(S.centroid(F.col("m"), 125.0), 4).alias("centroid"), F.round(S.bandwidth(F.col("m"), 125.0), 4).alias("bandwidth"), r6(S.flatness(F.col("m"))).alias("flatness"), S.rolloff_bin(F.col("m")).cast("long").alias("rolloff"))


@query(f"""with {SIMS}, l as (select vec_id, (round(s, 6) - case when label = candidate then 0.2::double else 0 end) / 0.1::double as logit, label = candidate as own from sims)
select vec_id, round(ln(sum(exp(logit))) - max(logit) filter (own), 6) as loss from l group by vec_id""")
def prototypical_loss(spark, sf):
    found = liveness.prototypical_loss(identify_all_speakers(spark, sf), ["vec_id"], F.col("label") == F.col("candidate"))
    return found.select("vec_id", r6("loss").alias("loss"))


@query(f"""with {CELLS}, x as (select vec_id, i, exp(v - max(v) over (partition by vec_id)) as e from cells) select vec_id, round(max(e) / sum(e), 6) as top from x group by vec_id""")
def softmax_top(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6(F.array_max(V.softmax(V.doubles(F.col("embedding"))))).alias("top"))


@query(f"with {FED} select l_suppkey, round(0.005::double * sum((l_extendedprice - mean) * (l_extendedprice - mean)), 0) as term from lineitem join fed using (l_linenumber, l_partkey) group by 1")
def proximal_term(spark, sf):
    found = liveness.proximal_term(table(spark, sf, "lineitem"), federated(spark, sf), ["l_linenumber", "l_partkey"], "l_suppkey", "l_extendedprice")
    return found.select("l_suppkey", F.round("term", 0).alias("term"))


@query("select event_id, round(round_even(value / 499 * 255 / 2, 0) * 2 / 255, 6) as sample from events")
def bit_depth_quantize(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(liveness.bit_depth(F.col("value") / 499, 8)).alias("sample"))


@query("select s_suppkey, s_acctbal from supplier order by (s_nationkey >= 10 and s_acctbal >= 5000) desc, s_suppkey limit 1")
def device_selection(spark, sf):
    devices = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("index"), F.col("s_nationkey").alias("max_channels"), F.col("s_acctbal").alias("sample_rate"))
    return liveness.pick_device(devices, 10, 5000).select(F.col("index").alias("s_suppkey"), F.col("sample_rate").alias("s_acctbal"))


@query("""with w as (select user_id, cast(date_trunc('day', ts) as timestamp) - to_days(cast(k as int)) as start, value as x from events, range(2) t(k))
select user_id as device, epoch(start)::bigint as start_s, round(sqrt(avg(x * x)), 6) as rms, max(abs(x)) as peak, count(*) as n from w group by 1, 2""")
def window_levels(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"))
    found = sessions.windowed_levels(rows, "2 days", "1 day")
    return found.select("device", F.unix_timestamp("start").alias("start_s"), r6("rms").alias("rms"), "peak", "n")


@query()
def dtw_to_centroid(spark, sf):
    return similarities(spark, sf).select("vec_id", r6(S.dtw_distance(V.doubles(F.col("embedding")), F.col("centroid"))).alias("distance"))


@query(f"""with {CELLS}, m as (select label, i, avg(abs(v)) as mean from cells group by 1, 2), c as (select c.label, c.vec_id, corr(mean, abs(v)) as r from cells c join m on c.label = m.label and c.i = m.i group by 1, 2)
select label, round(avg(1 - greatest(0, r)), 6) as deviation from c group by 1""")
def spectral_deviation(spark, sf):
    cells = verification.components(table(spark, sf, "embeddings"), ["label", "vec_id"], "embedding").withColumn("m", F.abs("v"))
    return liveness.spectral_deviation(cells, "label", "vec_id", "i", "m").select("label", r6("deviation").alias("deviation"))


@query(f"""with {CELLS}, p as (select label, i, quantile_cont(abs(v), 0.1) as p from cells group by 1, 2), b as (select label, avg(p) as level, regr_slope(p, i / 64.0::double) as slope from p group by 1),
l as (select label, vec_id, min(abs(v)) as low from cells group by 1, 2), s as (select label, 1 - stddev_pop(low) / abs(avg(low)) as consistency from l group by 1)
select label, round(level, 6) as level, round(slope, 6) as slope, round(consistency, 6) as consistency from b join s using (label)""")
def background_noise(spark, sf):
    cells = verification.components(table(spark, sf, "embeddings"), ["label", "vec_id"], "embedding").withColumn("m", F.abs("v"))
    found = liveness.background_noise(cells, "label", "vec_id", "i", "m")
    return found.select("label", *[r6(c).alias(c) for c in ("level", "slope", "consistency")])


@query(f"""with {SIG}, d as (select *, x - lag(x) over (partition by user_id order by i) as step from sig)
select user_id, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(median(x), 6) as median, round(avg(step), 6) as step_mean, round(stddev_pop(step), 6) as step_std from d group by 1""")
def track_statistics(spark, sf):
    found = liveness.track_statistics(signal(spark, sf), ["user_id"], "x")
    return found.select("user_id", *[r6(c).alias(c) for c in ("mean", "std", "median", "step_mean", "step_std")])


@query(f"""with {SIG}, n as (select event_id, list_concat(array_agg(x) over w, list_value(0.0, 0.0)) as l, count(*) over w as c from sig window w as (partition by user_id order by i rows between 2 preceding and 2 following))
select event_id, round(list_sort(l[1:5])[3], 6) as smooth from n""")
def median_smooth(spark, sf):
    return liveness.median_smooth(signal(spark, sf), ["user_id"], "x").select("event_id", r6("smooth").alias("smooth"))


@query(f"""with {PIVOT} select user_id, round((breathing * exp(resonance) + spectrum * exp(environment)) / (exp(resonance) + exp(environment)), 6) as fused from piv where {COMPLETE}""")
def attention_fusion(spark, sf):
    c = F.col
    fused = liveness.attention_fusion([c("breathing"), c("spectrum")], [c("resonance"), c("environment")])
    return component_scores(spark, sf).select("user_id", r6(fused).alias("fused"))


@query(f"""with {FRAMES}, p as (select *, max(rms) over (partition by user_id) as peak from frames) select user_id, min(frame) as first, max(frame) as last from p where rms > peak * power(10, -0.3::double) group by 1""")
def trim_silence(spark, sf):
    found = liveness.speech_bounds(sequence.frame_levels(signal(spark, sf), ["user_id"], "x", 8, 4), ["user_id"], "rms", 6.0)
    return found.select("user_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, min(value) as low, max(value) as high from events group by 1")
def performance_stats(spark, sf):
    events = table(spark, sf, "events")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
