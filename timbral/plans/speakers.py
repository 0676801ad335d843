"""Registered queries of challenges, whole covariances, fingerprints, class metrics and server rounds,
and of normalized voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.functions import normalization, rhythm, spectra
from timbral.functions import text as T
from timbral.functions.signal import magnitude_spectrum
from timbral.operators import challenges, evaluation, fingerprint, gaussian, learning
from timbral.plans.acoustics import RATE, SLOW, each, mel_sql, transform_sql, voice_frames, voices
from timbral.plans.queries import CELLS, query, r6
from timbral.session import table

SEED = "bench"


def drawn(name: str, n: str | int) -> str:
    """A draw in SQL, of session s."""
    return f"(('0x' || substr(sha256('{SEED}:' || s || ':' || {name}), 1, 12))::bigint % ({n}))"


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """A session for each benchmark item, of a difficulty by its id."""
    items = table(spark, sf, "benchmark").select("item_id", T.session_id(F.concat(F.lit("s"), F.col("item_id").cast("string"))).alias("session"))
    level = F.get(F.array(*map(F.lit, ("easy", "medium", "hard"))), (F.col("item_id") % 3).cast("int"))
    return items.select("*", level.alias("difficulty"), F.timestamp_seconds(1_704_067_200 + F.col("item_id")).alias("start"))


def issued(spark: SparkSession, sf: str) -> DataFrame:
    return challenges.issue(sessions(spark, sf), "session", "difficulty", "start", SEED)


def listed(values: tuple, at: str) -> str:
    return f"([{', '.join(repr(v) if not isinstance(v, str) else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}])[{at} + 1]"


def ranged(name: str, low: int, high: int) -> str:
    return f"({low} + {drawn(chr(39) + name + chr(39), high - low + 1)})"


CHALLENGES = f"""q as (select item_id, substr(sha256('s' || item_id), 1, 16) as s, ['easy', 'medium', 'hard'][item_id % 3 + 1] as level from benchmark),
d as (select *, {drawn("'type'", 4)} as kind, {drawn("'template'", 3)} as template, {drawn("'kind'", 2)} as op2, {drawn("'kind'", 3)} as op3 from q),
t as (select *, [4, 4, 5][template + 1] as low, [10, 10, 8][template + 1] as high, case level when 'easy' then 0 when 'medium' then 2 * op2 else op3 end as op from d),
n as (select *, case level when 'easy' then low + {drawn("'count'", 3)} when 'medium' then low + 1 + {drawn("'count'", "high - low - 1")} else high end as k,
  case op when 0 then case level when 'easy' then {ranged("a", 1, 9)} when 'medium' then {ranged("a", 10, 50)} else {ranged("a", 10, 99)} end when 1 then {ranged("a", 50, 99)} else case level when 'medium' then {ranged("a", 2, 9)} else {ranged("a", 5, 15)} end end as a from t),
m as (select *, case op when 0 then case level when 'easy' then {ranged("b", 1, 9)} when 'medium' then {ranged("b", 10, 50)} else {ranged("b", 10, 99)} end when 1 then 10 + {drawn("'b'", "a - 10")} else case level when 'medium' then {ranged("b", 2, 9)} else {ranged("b", 5, 15)} end end as b from n),
w as (select item_id, string_agg(i::varchar, '' order by o) as shuffled from (select item_id, r.range as i, {drawn("'order' || r.range", 1 << 40)} as o from m, range(10) r) group by 1),
f as (select item_id, string_agg({drawn("'digit' || r.range", 10)}::varchar, '' order by r.range) as free from m, range(1, 11) r where r.range <= k group by 1),
x as (select m.*, case when template = 2 then substr(shuffled, 1, k::int) else free end as digits, a || case op when 0 then ' + ' when 1 then ' - ' else ' × ' end || b as task, {listed(challenges.PHRASES, drawn("'phrase'", 10))} as phrase, {listed(challenges.PROMPTS, drawn("'prompt'", 10))} as prompt
  from m join w on m.item_id = w.item_id join f on m.item_id = f.item_id),
c as (select item_id, s, level, {listed(challenges.TYPES, "kind")} as challenge_type,
  case kind when 0 then replace({listed(tuple(t[0] for t in challenges.DIGIT_TEMPLATES), "template")}, '{{digits}}', case when k > 5 then regexp_replace(digits, '(.{{3}})', '\\1 ', 'g') else regexp_replace(digits, '(.)', '\\1 ', 'g') end)
    when 1 then 'Please say: ''' || phrase || '''' when 2 then 'Repeat after me: ''' || prompt || '''' else 'Calculate and say the answer: ' || task end as text,
  case kind when 0 then digits when 1 then phrase when 2 then prompt else case op when 0 then a + b when 1 then a - b else a * b end::varchar end as expected from x)"""


@query(f"with {CHALLENGES} select item_id, challenge_type, rtrim(text) as text, sha256(s || ':' || expected || ':' || (1704067200 + item_id)) as hash, 1704067320 + item_id as expires from c")
def issued_challenges(spark, sf):
    """What users get of the sessions' challenges."""
    found = challenges.for_user(issued(spark, sf))
    return found.select("item_id", "challenge_type", F.col("challenge_text").alias("text"), F.col("verification_hash").alias("hash"), F.unix_timestamp("expires_at").alias("expires"))


@query(f"with {CHALLENGES} select item_id, expected from c")
def expected_responses(spark, sf):
    return issued(spark, sf).select("item_id", F.col("expected_response").alias("expected"))


@query(f"""with {CHALLENGES} select item_id, item_id % 5 < 3 as verified, case when item_id % 5 = 3 then 'Challenge expired' when item_id % 5 = 4 then 'Invalid session ID' end as error,
  case when item_id % 5 < 3 then case level when 'easy' then 0.7::double when 'medium' then 0.8::double else 0.9::double end end as threshold from c""")
def judged_responses(spark, sf):
    """Three in five say what is expected, loudly; one comes a second too late; one has no session."""
    own = issued(spark, sf)
    late = F.when(F.col("item_id") % 5 == 3, 121).otherwise(120)
    said = own.select("item_id", F.when(F.col("item_id") % 5 == 4, "none").otherwise(F.col("session")).alias("session"), F.concat(F.upper("expected_response"), F.lit("!")).alias("response"), F.timestamp_seconds(F.unix_timestamp("start") + late).alias("at"))
    return challenges.judge(said, own, "session", "response", "at", "difficulty").select("item_id", "verified", "error", "threshold")


@query(f"""with e as (select event_id, event_type, event_id::varchar as s, event_id % 7 as i from events)
select event_id, case when event_type = 'view' and i % 2 = 0 then '{challenges.EMOTIONS["sad"]}' when event_type = 'click' then {listed(challenges.SCRIPTS["digits"], f"case when i < 5 then i else {drawn(chr(39) + 'script' + chr(39), 5)} end")}
  else {listed(challenges.SCRIPTS["phonetic_balanced"], f"case when i < 5 then i else {drawn(chr(39) + 'script' + chr(39), 5)} end")} end as script from e""")
def script_selection(spark, sf):
    """Views are emotional, every other one with an emotion that is known; clicks are digits."""
    family = F.when(F.col("event_type") == "view", "emotional").when(F.col("event_type") == "click", "digits").otherwise(F.col("event_type"))
    i = F.col("event_id") % 7
    chosen = challenges.script(family, i, F.when(i % 2 == 0, "sad").otherwise("bored"), F.col("event_id").cast("string"), SEED)
    return table(spark, sf, "events").select("event_id", chosen.alias("script"))


def cells_of(stats: DataFrame, size: int) -> DataFrame:
    """(label, i, j, cov) of the upper triangle."""
    rows = stats.select("label", F.posexplode("cov").alias("at", "cov"))
    i, j = F.floor(F.col("at") / size).cast("int"), F.col("at") % size
    return rows.select("label", i.alias("i"), j.alias("j"), (r6("cov") + 0).alias("cov")).where("i <= j")


COVARIANCES = f"with {CELLS} select a.label, cast(a.i as int) as i, cast(b.i as int) as j, round(covar_samp(a.v, b.v), 6) + 0 as cov from cells a join cells b on a.vec_id = b.vec_id and a.i <= b.i group by 1, 2, 3"


@query(COVARIANCES)
def speaker_moments(spark, sf):
    """All 64 components."""
    return cells_of(gaussian.moments(table(spark, sf, "embeddings"), "label", "embedding", 64), 64)


@query(COVARIANCES)
def merged_moments(spark, sf):
    """Moments of two parts of the vectors, merged, are those of all."""
    rows = table(spark, sf, "embeddings")
    part = lambda keep: gaussian.moments(rows.where(keep), "label", "embedding", 64)
    return cells_of(gaussian.merged(part("vec_id % 3 = 0"), part("vec_id % 3 <> 0"), "label"), 64)


@query("""with v as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y from embeddings), s as (select label, avg(x) as mx, avg(y) as my, var_samp(x) as a, var_samp(y) as b, covar_samp(x, y) as c from v group by 1),
d as (select vec_id, x - mx as x, y - my as y, a, b, c, a * b - c * c as det from v join s using (label)), q as (select vec_id, (b * x * x - 2 * c * x * y + a * y * y) / det as q, det from d)
select vec_id, round(sqrt(q), 6) as distance, round(-0.5 * (q + ln(det) + 2 * ln(2 * pi())), 6) as log_pdf from q""")
def plane_log_pdf(spark, sf):
    """Distance and density of the first two components in their speaker's normal distribution."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 2).alias("p"))
    found = gaussian.against_groups(rows, gaussian.moments(rows, "label", "p", 2), "label", "p", 2)
    return found.select("vec_id", r6("distance").alias("distance"), r6("log_pdf").alias("log_pdf"))


@query()
def speaker_log_pdf(spark, sf):
    """The same in the first 16 components, whose inverses SQL has no function for."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 16).alias("p"))
    found = gaussian.against_groups(rows, gaussian.moments(rows, "label", "p", 16), "label", "p", 16)
    return found.select("vec_id", F.round("distance", 4).alias("distance"), F.round("log_pdf", 4).alias("log_pdf"))


CLASSES = """e as (select event_type as t, case when value > 300 then 'view' when value > 150 then 'click' when value > 60 then 'error' else event_type end as p from events),
k as (select t as c from e union select p from e), m as (select c, (select count(*) from e where t = c) as n, (select count(*) from e where p = c) as said, (select count(*) from e where p = c and t = c) as hit from k),
f as (select c, n, hit, coalesce(hit / nullif(said, 0), 0) as p, coalesce(hit / nullif(n, 0), 0) as r from m)"""


def guessed(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    said = F.when(value > 300, "view").when(value > 150, "click").when(value > 60, "error").otherwise(F.col("event_type"))
    return evaluation.class_metrics(table(spark, sf, "events").withColumn("said", said), "event_type", "said")


@query(f"with {CLASSES} select c as class, n, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from f")
def class_metrics(spark, sf):
    return guessed(spark, sf).select("class", "n", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"with {CLASSES} select round(sum(hit) / sum(n), 6) as accuracy, round(avg(p), 6) as macro_precision, round(avg(r), 6) as macro_recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) as macro_f1 from f")
def macro_metrics(spark, sf):
    found = evaluation.macro_metrics(guessed(spark, sf))
    return found.select(*[r6(c).alias(c) for c in found.columns])


PARTS = "g as (select l_partkey % 100 as place, l_suppkey as client, l_linenumber as round, sum(l_discount * l_quantity) as s, sum(l_quantity) as w from lineitem group by 1, 2, 3)"


@query(f"with {PARTS}, c as (select place, client, sum(s) as s, sum(w) as w from g where round = 1 group by 1, 2), n as (select greatest(2, floor(count(*) * 0.05)) as least from supplier) select place, round(sum(s) / sum(w), 6) as mean, count(*) as clients from c group by 1 having count(*) >= (select least from n)")
def secure_mean(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_linenumber = 1").select((F.col("l_partkey") % 100).alias("place"), F.col("l_suppkey").alias("client"), F.col("l_discount").alias("v"), F.col("l_quantity").alias("w"))
    found = learning.secure_mean(rows, ["place"], "client", "v", "w", table(spark, sf, "supplier").count(), 0.05)
    return found.select("place", r6("mean").alias("mean"), "clients")


def server_sql(rounds: int, rate: float, momentum: float) -> str:
    parts = [PARTS, "s1 as (select place, sum(s) / sum(w) as value, 0.0::double as speed from g where round = 1 group by 1)"]
    for k in range(2, rounds + 1):
        step = f"{momentum}::double * coalesce(a.speed, 0) + case when b.mean is null then 0 else {rate}::double * (b.mean - a.value) end"
        parts.append(f"m{k} as (select place, sum(s) / sum(w) as mean from g where round = {k} group by 1)")
        parts.append(f"s{k} as (select coalesce(a.place, b.place) as place, coalesce(a.value + {step}, b.mean) as value, case when a.value is null then 0 else {step} end as speed from s{k - 1} a full join m{k} b on a.place = b.place)")
    return f"with {', '.join(parts)} select place, round(value, 6) as value, round(speed, 6) + 0 as speed from s{rounds}"


@query(server_sql(4, 0.5, 0.9))
def server_rounds(spark, sf):
    """Four rounds of a server with a learning rate and momentum."""
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 100).alias("place"), F.col("l_linenumber").alias("round"), F.col("l_discount").alias("v"), F.col("l_quantity").alias("w"))
    means = lambda r: learning.federated_mean(rows.where(F.col("round") == r), ["place"], "v", "w")
    state = means(1).select("place", F.col("mean").alias("value"), F.lit(0.0).alias("speed"))
    for r in (2, 3, 4):
        state = learning.server_step(state, means(r), ["place"], 0.5, 0.9)
    return state.select("place", r6("value").alias("value"), (r6("speed") + 0).alias("speed"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    own = voices(spark, sf)
    rows = fingerprint.tracks(own, ["user_id"], "x", RATE, 32, 8, 64, bands=24)
    return fingerprint.features(rows.unionByName(fingerprint.pitch_rows(own, ["user_id"], "x", SLOW)), ["user_id"])


@query()
def voice_features(spark, sf):
    return features(spark, sf).select("user_id", "feature", F.round("value", 4).alias("value"))


@query()
def voice_fingerprints(spark, sf):
    rows = fingerprint.vectors(features(spark, sf), ["user_id"])
    return fingerprint.reduced(rows, fingerprint.fit(rows, 16)).select("user_id", F.posexplode("fingerprint").alias("i", "v")).select("user_id", "i", F.round("v", 4).alias("v"))


@query()
def normalized_voice(spark, sf):
    return each(voices(spark, sf).select("user_id", normalization.normalize(RATE, 32, 8)(F.col("x"))["y"].alias("y")), "y", "y")


@query()
def cepstra_normalized(spark, sf):
    found = normalization.normalize_cepstra(RATE, 32, 8, 12, 8, 0.008)
    return each(voices(spark, sf).select("user_id", found(F.col("x"))["y"].alias("y")), "y", "y")


@query()
def spectrum_flattened(spark, sf):
    found = normalization.flatten_spectrum(RATE, 4, 0.002, 0.0005)
    return each(voices(spark, sf).select("user_id", found(F.col("x"))["y"].alias("y")), "y", "y")


#: Band powers, their means over five frames (the ends repeated), and the floor from frame to frame.
POWERS = f"""{transform_sql(32, 8, 32, True)}, {mel_sql(RATE, 32, 12)}, p as (select user_id, frame, k, sum((re * re + im * im) * w) as p from z join mel using (b) group by 1, 2, 3),
l as (select user_id, max(frame) as last from p group by 1), a as (select p.user_id, p.frame, p.k, avg(o.p) as y from p join l on l.user_id = p.user_id, range(-2, 3) d, p o where o.user_id = p.user_id and o.k = p.k and o.frame = greatest(0, least(l.last, p.frame + d.range)) group by 1, 2, 3),
fl as (select user_id, frame, k, y, y as floor from a where frame = 0 union all select a.user_id, a.frame, a.k, a.y, case when a.y >= fl.floor then 0.999::double * fl.floor + 0.001::double * a.y else 0.5::double * fl.floor + 0.5::double * a.y end from fl join a on a.user_id = fl.user_id and a.k = fl.k and a.frame = fl.frame + 1)"""


@query(f"with recursive {POWERS} select user_id, cast(frame as int) as frame, cast(c.range as int) as k, round(sum(power(greatest(y - floor, 0), 1 / 15.0::double) * cos(pi() * c.range * (2 * k + 1) / 24)) * sqrt(case when c.range = 0 then 1 else 2 end / 12.0::double), 6) + 0 as pncc from fl, range(6) c group by 1, 2, c.range")
def power_cepstra(spark, sf):
    found = voices(spark, sf).select("user_id", spectra.pncc(RATE, 32, 8, 12, 6)(F.col("x"))["pncc"].alias("p"))
    return found.select("user_id", F.posexplode("p").alias("frame", "p")).select("user_id", "frame", F.posexplode("p").alias("k", "pncc")).select("user_id", "frame", "k", (r6("pncc") + 0).alias("pncc"))


BARK = "(13 * atan(0.00076 * {0} * 250) + 3.5 * atan(power({0} * 250 / 7500.0::double, 2)))"


@query(f"""with {transform_sql(32, 16, 64, False)}, s as (select a.range as a, b.range as b, greatest(0, 1 - abs({BARK.format("a.range")} - {BARK.format("b.range")}) / 0.5) as w from range(33) a, range(33) b)
select user_id, cast(frame as int) as frame, cast(a as int) as bin, round(0.1::double * sum(sqrt(re * re + im * im) * w), 6) as threshold from z join s using (b) group by 1, 2, 3""")
def masking_threshold(spark, sf):
    found = voice_frames(spark, sf, 32, 16).select("user_id", "frame", spectra.masking(RATE, 64)(magnitude_spectrum(64)(F.col("x")))["threshold"].alias("t"))
    return found.select("user_id", "frame", F.posexplode("t").alias("bin", "threshold")).select("user_id", "frame", "bin", r6("threshold").alias("threshold"))


@query()
def speech_rate(spark, sf):
    return voices(spark, sf).select("user_id", r6(rhythm.speech_rate(100)(F.col("x"))["per_minute"]).alias("per_minute"))


@query()
def voice_onsets(spark, sf):
    found = voices(spark, sf).select("user_id", rhythm.voice_onsets(RATE, 16, 4)(F.col("x")).alias("v")).where("v is not null")
    return found.select("user_id", F.size("v.bursts").alias("bursts"), F.size("v.times").alias("times"), r6(F.col("v.mean")).alias("mean"), r6(F.col("v.deviation")).alias("deviation"))


@query()
def micro_modulations(spark, sf):
    found = voices(spark, sf).select("user_id", rhythm.micro_modulations(64, 16, 4)(F.col("x")).alias("m")).where("m is not null")
    return found.select("user_id", *[r6(F.col(f"m.{c}")).alias(c) for c in ("flux", "residual", "phase", "envelope", "tremor")])
