"""Registered queries of scores, gates, pairs, selections and logs, each with its SQL twin."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from timbral.functions import vectors as V
from timbral.operators import scores, verification
from timbral.plans.queries import CARRIERS, CELLS, COMPLETE, FRAMES, PIVOT, SIG, SIMS, component_scores, framing_rms, identify_all_speakers, query, r4, r6, signal
from timbral.session import table


def ranged(x: str, low: float, high: float) -> str:
    """A range score in SQL; numbers are doubles."""
    middle, width = (low + high) / 2, high - low
    return f"case when {x} < {low}::double then 1 - least(1, ({low}::double - {x}) / {low}::double) when {x} > {high}::double then 1 - least(1, ({x} - {high}::double) / {high}::double) else 1 - least(1, 2 * abs({x} - {middle}::double) / {width}::double) end"


def flat(x: str, low: float, high: float, centre: float, width: float) -> str:
    """A plateau score in SQL."""
    return f"case when {x} between {low}::double and {high}::double then 1 else greatest(0, 1 - abs({x} - ({centre})::double) / {width}::double) end"


def near(x: str, ideal: str) -> str:
    return f"(1 - least(1, abs({x} - {ideal}::double) / {ideal}::double))"


def summed(parts: dict[str, float]) -> str:
    return " + ".join(f"{w}::double * ({p})" for p, w in parts.items())


@query("""select user_id, count(*) as n, count(*) filter (event_type <> 'error') as n_live,
  count(*) filter (event_type <> 'error') >= greatest(3, count(*) // 2) as accepted from events group by user_id""")
def enroll_live_gate(spark, sf):
    return scores.live_gate(table(spark, sf, "events"), ["user_id"], F.col("event_type") != "error")


@query("""select event_type, coalesce(max(case when value > 480 then round(value / 500, 6) end), 0.7) as similarity, coalesce(max(case when value > 1000 then 1.0::double end), 0.5) as antispoofing
from events group by event_type""")
def threshold_overrides(spark, sf):
    new = table(spark, sf, "events").groupBy("event_type").agg(F.max(F.when(F.col("value") > 480, r6(F.col("value") / 500))).alias("a"), F.max(F.when(F.col("value") > 1000, 1.0)).alias("b"))
    return new.select("event_type", F.coalesce("a", F.lit(0.7)).alias("similarity"), F.coalesce("b", F.lit(0.5)).alias("antispoofing"))


@query(f"""with {PIVOT} select user_id, round({summed({ranged(x, low, high): w for (w, low, high), x in zip(scores.MICRO.values(), ["breathing", "micro_modulation / 5", "resonance / 10", "environment / 50", "spectrum / 6"], strict=True)})}, 6) as score
from piv where {COMPLETE}""")
def micro_modulation_score(spark, sf):
    c = F.col
    given = {"pitch": c("breathing"), "envelope": c("micro_modulation") / 5, "tremor": c("resonance") / 10, "jitter": c("environment") / 50, "shimmer": c("spectrum") / 6}
    return component_scores(spark, sf).select("user_id", r6(scores.micro_modulation(given)).alias("score"))


RATIOS = " + ".join(near(f"{c} / {d}", str(i)) for c, d, i in zip(["breathing", "micro_modulation", "resonance", "environment"], [12, 11, 9, 7], scores.FORMANT_RATIOS, strict=True))


@query(f"""with {PIVOT}, t as (select *, -13 * spectrum as tilt from piv where {COMPLETE})
select user_id, round(0.35::double * (breathing + micro_modulation) / 2 + 0.3::double * (resonance + environment) / 2 + 0.2::double * ({RATIOS}) / 4
  + 0.15::double * (1 - least(1, case when tilt < -10 then (-10 - tilt) / 10 when tilt > -6 then (tilt + 6) / 6 else 0 end)), 6) as score from t""")
def resonance_score(spark, sf):
    c = F.col
    ratios = F.array(c("breathing") / 12, c("micro_modulation") / 11, c("resonance") / 9, c("environment") / 7)
    found = scores.resonance(F.array("breathing", "micro_modulation"), F.array("resonance", "environment"), ratios, -13 * c("spectrum"))
    return component_scores(spark, sf).select("user_id", r6(found).alias("score"))


ENVIRONMENT = summed({(f"coalesce({flat(x, *spec)}, 0.5::double)" if name == "band_ratio" else flat(x, *spec)): w for (name, (w, *spec)), x in zip(scores.ENVIRONMENT.items(), ["breathing * 2", "micro_modulation / 3", "-90 * resonance", "case when environment > 0.97 then environment * 3 end"], strict=True)} | {"1 - spectrum": 0.15, "breathing": 0.1, "resonance": 0.2})


@query(f"with {PIVOT} select user_id, round({ENVIRONMENT}, 6) as score from piv where {COMPLETE}")
def environment_score(spark, sf):
    c = F.col
    given = {"reverb": c("breathing") * 2, "deviation": c("micro_modulation") / 3, "noise_level": -90 * c("resonance"), "band_ratio": F.when(c("environment") > 0.97, c("environment") * 3), "noise_consistency": c("spectrum"), "noise_floor_stability": c("breathing"), "cutoff": c("resonance")}
    return component_scores(spark, sf).select("user_id", r6(scores.environment(given)).alias("score"))


SPECTRUM = summed({flat(x, *spec): w for (w, *spec), x in zip(scores.SPECTRUM.values(), ["breathing / 2", "micro_modulation * 6", "resonance * 2", "environment", "spectrum * 3"], strict=True)} | {"1 - breathing": 0.15, "1 - micro_modulation": 0.15, "resonance": 0.15})


@query(f"with {PIVOT} select user_id, round({SPECTRUM}, 6) as score from piv where {COMPLETE}")
def spectrum_score(spark, sf):
    c = F.col
    given = {"flux": c("breathing") / 2, "entropy": c("micro_modulation") * 6, "modulation": c("resonance") * 2, "correlation": c("environment"), "contrast": c("spectrum") * 3, "artifacts": c("breathing"), "coherence": c("micro_modulation"), "delay": c("resonance")}
    return component_scores(spark, sf).select("user_id", r6(scores.spectrum(given)).alias("score"))


@query("""with c as (select event_id, round(0.7::double * round(value / 500, 4) + 0.3::double * round(1 / (1 + value / 100), 4), 6) as combined from events)
select event_id, combined, case when combined > 0.8::double then 'high' when combined > 0.6::double then 'medium' else 'low' end as likelihood from c""")
def match_likelihood(spark, sf):
    value = F.col("value")
    combined, _ = scores.match_tier(F.round(value / 500, 4), F.round(1 / (1 + value / 100), 4))
    rows = table(spark, sf, "events").select("event_id", r6(combined).alias("combined"))
    return rows.select("event_id", "combined", scores.match_tier(F.col("combined"), F.col("combined"))[1].alias("likelihood"))


@query(f"""with {SIG}, c as (select user_id, count(*) filter (x is null or isnan(x)) = 0 as a, coalesce(stddev_pop(x) / avg(x) < 0.5, false) as b, min(x) > 0 as c, stddev_pop(x / 50) < 3 as d from sig group by user_id)
select user_id, (cast(a as int) + cast(b as int) + cast(c as int) + cast(d as int)) / 4 as score, (cast(a as int) + cast(b as int) + cast(c as int) + cast(d as int)) / 4 >= 0.7 as valid from c""")
def feature_validation(spark, sf):
    rows = signal(spark, sf).withColumn("m", F.col("x") / 50)
    return scores.feature_checks(rows, ["user_id"], "x", "m").select("user_id", "score", "valid")


@query("select event_id, round(least(10, greatest(0.1::double, value / 40)), 6) as gain, round(least(2, greatest(-2, value / 100 - 2.5::double)), 6) as shift from events")
def gain_limit(spark, sf):
    limit = lambda x, low, high: F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))
    return table(spark, sf, "events").select("event_id", r6(limit(F.col("value") / 40, 0.1, 10)).alias("gain"), r6(limit(F.col("value") / 100 - 2.5, -2, 2)).alias("shift"))


@query("""with d as (select event_type, date_trunc('day', ts) as d, round(avg(cast(value > 250 as int)), 6) as accuracy, round(avg(value) / 499, 6) as loss from events group by 1, 2)
select event_type, cast(cast(d as date) as varchar) as day, accuracy, loss, row_number() over w = 1 or coalesce(accuracy - lag(accuracy) over w > 0.01::double or lag(loss) over w - loss > 0.01::double, false) as deploy
from d window w as (partition by event_type order by d)""")
def deploy_gate(spark, sf):
    log = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(r6(F.avg((F.col("value") > 250).cast("int"))).alias("accuracy"), r6(F.avg("value") / 499).alias("loss"))
    return scores.deploys(log, ["event_type"], ["day"], ["accuracy"], ["loss"])


@query("select a.n_nationkey as a, b.n_nationkey as b from nation a, nation b where a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey")
def node_graph(spark, sf):
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("graph"))
    return nodes.join(nodes.withColumnRenamed("a", "b"), "graph").where("a != b").select("a", "b")


@query(f"""with {SIG}, f as (select user_id, i, event_type <> 'error' as live from sig) select s.user_id, s.i as place, s.x as value, f.live from sig s join f on s.user_id = f.user_id and s.i = f.i""")
def sample_liveness_zip(spark, sf):
    """Two tracks, met by user and place."""
    rows = signal(spark, sf)
    flags = rows.select("user_id", "i", (F.col("event_type") != "error").alias("live"))
    return rows.select("user_id", "i", F.col("x").alias("value")).join(flags, ["user_id", "i"]).select("user_id", F.col("i").cast("long").alias("place"), "value", "live")


@query(f"""with {FRAMES}, n as (select user_id, count(*) as nf from frames group by 1), s as (select user_id, event_id, i, count(*) over (partition by user_id) as n from sig)
select event_id, f.frame, round(f.rms, 6) as rms from s join n using (user_id) join frames f on f.user_id = s.user_id and f.frame = least(s.i * nf // n, nf - 1)""")
def instants_to_frames(spark, sf):
    frames = framing_rms(spark, sf)
    n = frames.groupBy("user_id").agg(F.count("*").alias("nf"))
    rows = signal(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).join(n, "user_id")
    at = F.least(F.floor(F.col("i") * F.col("nf") / F.col("n")), F.col("nf") - 1)
    return rows.withColumn("frame", at).join(frames, ["user_id", "frame"]).select("event_id", "frame", "rms")


@query(f"""with {CELLS}, st as (select label, i, avg(v) as mu, var_pop(v) + 1e-6 as s2 from cells group by 1, 2)
select vec_id, round(sum(-0.5::double * (ln(2 * pi() * s2) + (v - mu) * (v - mu) / s2)), 4) as log_pdf from cells c join st on c.label = st.label and c.i = st.i group by vec_id""")
def gaussian_log_pdf(spark, sf):
    cells = verification.components(table(spark, sf, "embeddings"), ["vec_id", "label"], "embedding")
    stats = cells.groupBy("label", "i").agg(F.avg("v").alias("mu"), (F.var_pop("v") + 1e-6).alias("s2"))
    each = -0.5 * (F.log(2 * math.pi * F.col("s2")) + (F.col("v") - F.col("mu")) ** 2 / F.col("s2"))
    return cells.join(stats, ["label", "i"]).groupBy("vec_id").agg(F.round(F.sum(each), 4).alias("log_pdf"))


@query(f"""with {SIG}, t as (select user_id, user_id % 4 + 1 as formant, x, x - lag(x) over (partition by user_id order by i) as d from sig),
c as (select user_id, formant, stddev_pop(x) / (avg(x) + 1e-10) / 6 as cv, stddev_pop(d) / (max(abs(d)) + 1e-10) as dv from t group by 1, 2)
select user_id, formant, round(0.6::double * {near("cv", "list_value(0.05, 0.08, 0.1, 0.12)[formant]")} + 0.4::double * {near("dv", "list_value(0.3, 0.4, 0.5, 0.6)[formant]")}, 6) as score from c where dv is not null""")
def formant_variability(spark, sf):
    step = F.col("x") - F.lag("x").over(Window.partitionBy("user_id").orderBy("i"))
    rows = signal(spark, sf).select("user_id", (F.col("user_id") % 4 + 1).alias("formant"), "x", step.alias("d"))
    cv, dv = F.stddev_pop("x") / (F.avg("x") + 1e-10) / 6, F.stddev_pop("d") / (F.max(F.abs("d")) + 1e-10)
    found = rows.groupBy("user_id", "formant").agg(cv.alias("cv"), dv.alias("dv")).where("dv is not null")
    return found.select("user_id", "formant", r6(scores.formant_variability(F.col("cv"), F.col("dv"), F.col("formant").cast("int"))).alias("score"))


def picked(rows: str, key: str, height: float, distance: int) -> str:
    """Tables ending in `picked` (key, peaks): rows is a table (key, i, v)."""
    return f"""runs0 as (select {key}, i, v, coalesce(cast(v <> lag(v) over (partition by {key} order by i) as int), 1) as new from {rows}),
runs1 as (select *, sum(new) over (partition by {key} order by i) as run from runs0), runs as (select {key}, run, min(i) as lo, max(i) as hi, max(v) as top from runs1 group by 1, 2),
tops as (select *, lag(top) over w as l, lead(top) over w as r from runs window w as (partition by {key} order by run)),
cand as (select {key}, list(list_value(cast((lo + hi) // 2 as int)) order by top desc, (lo + hi) // 2 desc) as c from tops where top > l and top > r and top >= {height} group by 1),
picked as (select {key}, list_sort(list_reduce(c, lambda acc, x: case when list_min(list_transform(acc, lambda a: abs(a - x[1]))) >= {distance} then list_concat(acc, x) else acc end)) as peaks from cand)"""


@query(f"with {SIG}, s as (select user_id, i, x as v from sig), {picked('s', 'user_id', 50, 5)} select user_id, len(peaks) as n, cast(list_min(peaks) as int) as first, cast(list_max(peaks) as int) as last, cast(list_sum(peaks) as bigint) as places from picked")
def peak_picking_distance(spark, sf):
    found = scores.peaks(signal(spark, sf), ["user_id"], "i", "x", 50, 5)
    total = F.aggregate("peaks", F.lit(0).cast("long"), lambda a, p: a + p)
    return found.select("user_id", F.size("peaks").cast("long").alias("n"), F.array_min("peaks").alias("first"), F.array_max("peaks").alias("last"), total.alias("places"))


@query(f"""with {CELLS}, sp0 as (select label, i, avg(abs(v)) as m from cells group by 1, 2), sp as (select label, cast(i as int) as i, round(m / max(m) over (partition by label), 9) as v from sp0), {picked('sp', 'label', 0.1, 5)},
gaps as (select label, len(peaks) as n, unnest(list_transform(range(1, len(peaks)), lambda k: peaks[k + 1] - peaks[k])) as gap from picked)
select label, round(1 - least(1, stddev_pop(gap) / avg(gap)), 6) as artifacts from gaps where n > 3 group by label""")
def harmonic_artifacts(spark, sf):
    cells = verification.components(table(spark, sf, "embeddings"), ["label", "vec_id"], "embedding")
    spectrum = cells.groupBy("label", "i").agg(F.avg(F.abs("v")).alias("m"))
    spectrum = spectrum.withColumn("v", F.round(F.col("m") / F.max("m").over(Window.partitionBy("label")), 9))
    found = scores.peaks(spectrum, ["label"], "i", "v", 0.1, 5).where(F.size("peaks") > 3)
    gaps = found.select("label", F.explode(F.zip_with(F.slice(F.col("peaks"), F.lit(2), F.size("peaks") - 1), F.slice(F.col("peaks"), F.lit(1), F.size("peaks") - 1), lambda a, b: a - b)).alias("gap"))
    return gaps.groupBy("label").agg(r6(1 - F.least(F.lit(1.0), F.stddev_pop("gap") / F.avg("gap"))).alias("artifacts"))


@query(f"""with {CELLS}, d as (select label, vec_id, 3 * (v - lag(v) over (partition by vec_id order by i)) as step from cells), s as (select label, vec_id, stddev_pop(atan2(sin(step), cos(step))) as sd from d where step is not null group by 1, 2)
select label, round(least(1, avg(sd) / pi()), 6) as deviation from s group by label""")
def group_delay_deviation(spark, sf):
    cells = verification.components(table(spark, sf, "embeddings"), ["label", "vec_id"], "embedding")
    step = 3 * (F.col("v") - F.lag("v").over(Window.partitionBy("vec_id").orderBy("i")))
    each = cells.withColumn("step", step).where("step is not null").groupBy("label", "vec_id").agg(F.stddev_pop(scores.wrapped(F.col("step"))).alias("sd"))
    return each.groupBy("label").agg(r6(F.least(F.lit(1.0), F.avg("sd") / math.pi)).alias("deviation"))


@query(f"""with {SIG}, v as (select user_id, x, abs(x - lag(x) over (partition by user_id order by i)) as s from sig), q as (select user_id, quantile_cont(s, 0.8) as hi, quantile_cont(s, 0.3) as lo from v where s is not null group by 1),
m as (select v.user_id, avg(x) filter (s > hi) as onset, avg(x) filter (s < lo) as target, count(*) filter (s > hi) as a, count(*) filter (s < lo) as b from v join q using (user_id) group by 1)
select user_id, round(onset, 6) as onset, round(target, 6) as target, round(onset - 0.7::double * target, 6) as intercept from m where a >= 2 and b >= 2""")
def locus_equation(spark, sf):
    speed = F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("user_id").orderBy("i")))
    rows = signal(spark, sf).select("user_id", "x", speed.alias("s")).where("s is not null")
    bounds = rows.groupBy("user_id").agg(F.collect_list("s").alias("all")).select("user_id", scores.quantiles(0.8, 0.3)(F.col("all"))["q"].alias("q"))
    bounds = bounds.select("user_id", F.get("q", F.lit(0)).alias("hi"), F.get("q", F.lit(1)).alias("lo"))
    fast, slow = F.col("s") > F.col("hi"), F.col("s") < F.col("lo")
    means = rows.join(bounds, "user_id").groupBy("user_id").agg(F.avg(F.when(fast, F.col("x"))).alias("onset"), F.avg(F.when(slow, F.col("x"))).alias("target"), F.count_if(fast).alias("a"), F.count_if(slow).alias("b"))
    return means.where("a >= 2 and b >= 2").select("user_id", r6("onset").alias("onset"), r6("target").alias("target"), r6(F.col("onset") - 0.7 * F.col("target")).alias("intercept"))


@query("""with e as (select user_id, event_type, sum(value * value) as energy from events group by 1, 2)
select user_id, arg_max(event_type, energy) as channel, round(max(energy) / sum(energy), 6) as share from e group by user_id""")
def loudest_channel(spark, sf):
    energy = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum(F.col("value") * F.col("value")).alias("energy"))
    return energy.groupBy("user_id").agg(F.max_by("event_type", "energy").alias("channel"), r6(F.max("energy") / F.sum("energy")).alias("share"))


@query(f"""with {SIG}, e as (select user_id, i, 10 * log10(sum(x * x) over (partition by user_id order by i rows between current row and unbounded following) / sum(x * x) over (partition by user_id)) as db from sig),
t as (select user_id, min(i) filter (db <= -5) as a, min(i) filter (db <= -35) as b from e group by 1) select user_id, a as from_step, 2 * (b - a) as rt60_steps from t""")
def reverberation_time(spark, sf):
    rest = Window.partitionBy("user_id").orderBy("i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    power = F.col("x") * F.col("x")
    left = F.try_divide(F.sum(power).over(rest), F.sum(power).over(Window.partitionBy("user_id")))
    db = F.when(F.col("left") == 0, F.lit(float("-inf"))).otherwise(10 * F.log10("left"))  # nothing is left after a last sample of 0
    rows = signal(spark, sf).withColumn("left", left).withColumn("db", db)
    first = rows.groupBy("user_id").agg(F.min(F.when(F.col("db") <= -5, F.col("i"))).alias("a"), F.min(F.when(F.col("db") <= -35, F.col("i"))).alias("b"))
    return first.select("user_id", F.col("a").cast("long").alias("from_step"), (2 * (F.col("b") - F.col("a"))).cast("long").alias("rt60_steps"))


@query("with t as (select *, date_trunc('day', ts) as d from events) select event_id, event_type, value from t where d = (select max(d) from t)")
def latest_log_day(spark, sf):
    rows = table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    last = rows.agg(F.max("d").alias("d"))
    return rows.join(F.broadcast(last), "d").select("event_id", "event_type", "value")


@query(f"""with {SIG}, n as (select *, count(*) over (partition by user_id) as n from sig), m as (select user_id, i, n, x, avg(x) over (partition by user_id order by i rows between 2 preceding and 2 following) as y from n),
p as (select user_id, i, n, y from m), c as (select user_id, i, n, power(0.999::double, i) * (first_value(y) over (partition by user_id order by i) + 0.001::double * (sum(y / power(0.999::double, i)) over (partition by user_id order by i) - first_value(y) over (partition by user_id order by i))) as f from p)
select user_id, i, round(f + 1e-8, 4) as floor from c""")
def medium_time_floor(spark, sf):
    smooth = F.avg("x").over(Window.partitionBy("user_id").orderBy("i").rowsBetween(-2, 2))
    rows = signal(spark, sf).select("user_id", "i", smooth.alias("y")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("t"))
    floors = rows.select("user_id", F.posexplode(scores.recursive_floor(F.transform("t", lambda p: p["y"]))).alias("i", "f"))
    return floors.select("user_id", F.col("i").cast("long").alias("i"), r4("f").alias("floor"))


WRAP = "atan2(sin({0}), cos({0}))"


@query(f"""with {SIG}, a as (select user_id, event_id, i, {WRAP.format("(lead(x) over (partition by user_id order by i) - x) / 50")} as d from sig), b as (select *, coalesce(d, lag(d) over (partition by user_id order by i)) as delta from a),
c as (select *, {WRAP.format("(lead(delta) over (partition by user_id order by i) - delta)")} as dd from b)
select event_id, round(delta, 6) as delta, round(coalesce(dd, lag(dd) over (partition by user_id order by i)), 6) as double_delta from c""")
def phase_deltas(spark, sf):
    w = Window.partitionBy("user_id").orderBy("i")

    def padded(rows, value, name):
        rows = rows.withColumn("d", scores.wrapped(F.lead(value).over(w) - F.col(value)))
        return rows.withColumn(name, F.coalesce("d", F.lag("d").over(w)))

    rows = signal(spark, sf).select("user_id", "event_id", "i", (F.col("x") / 50).alias("x"))
    rows = padded(padded(rows, "x", "delta"), "delta", "double_delta")
    return rows.select("event_id", r6("delta").alias("delta"), r6("double_delta").alias("double_delta"))


@query(f"with {SIG} select event_id, count(*) over w as held, 40 - count(*) over w as padded, round(sum(x) over w / 40, 6) as mean from sig window w as (partition by user_id order by i rows between 20 preceding and 19 following)")
def context_windows(spark, sf):
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(-20, 19)
    seen = F.collect_list("x").over(w)
    frames = signal(spark, sf).select("event_id", F.size(seen).alias("n"), F.concat(seen, F.array_repeat(F.lit(0.0), 40 - F.size(seen))).alias("frame"))
    return frames.select("event_id", F.col("n").cast("long").alias("held"), (F.size("frame") - F.col("n")).cast("long").alias("padded"), r6(V.total(F.col("frame")) / 40).alias("mean"))


@query(f"with {SIG}, p as (select event_id, x, lead(x) over (partition by user_id order by i) as target from sig) select event_id, x as input, target from p where target is not null")
def sequence_pairs(spark, sf):
    target = F.lead("x").over(Window.partitionBy("user_id").orderBy("i"))
    return signal(spark, sf).select("event_id", F.col("x").alias("input"), target.alias("target")).where("target is not null")


@query("select event_id, value from (select * from events order by ts desc, event_id desc limit 100) order by ts desc, event_id desc limit 10")
def recent_features(spark, sf):
    order = [F.desc("ts"), F.desc("event_id")]
    return table(spark, sf, "events").orderBy(*order).limit(100).orderBy(*order).limit(10).select("event_id", "value")


@query("""with u as (select event_id, event_type, round(0.5 - abs(round(value / (1 + value), 6) - 0.5), 6) as uncertainty from events), t as (select * from u order by uncertainty desc, event_id limit 200),
r as (select *, row_number() over (partition by event_type order by uncertainty desc, event_id) as place from t) select event_id, event_type, uncertainty from r where place <= 20""")
def hybrid_select(spark, sf):
    s = r6(F.col("value") / (1 + F.col("value")))
    rows = table(spark, sf, "events").select("event_id", "event_type", r6(0.5 - F.abs(s - 0.5)).alias("uncertainty"))
    unsure = rows.orderBy(F.desc("uncertainty"), "event_id").limit(200)
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("uncertainty"), "event_id"))
    return unsure.withColumn("place", place).where("place <= 20").drop("place")


@query("select vec_id, list_transform(list_sort(list_filter(embedding, lambda x: x > 0))[1:4], lambda x: cast(x as double)) as lowest from embeddings")
def lowest_formants(spark, sf):
    found = F.slice(F.array_sort(F.filter(V.doubles(F.col("embedding")), lambda x: x > 0)), 1, 4)
    return table(spark, sf, "embeddings").select("vec_id", found.alias("lowest"))


@query(f"""with o as (select vec_id, label, row_number() over (partition by label order by vec_id) as k from embeddings),
p as (select vec_id as a, lead(vec_id) over (partition by label order by vec_id) as b, true as genuine from o union all select vec_id, lead(vec_id) over (partition by k order by label), false from o),
{CELLS}, n as (select vec_id, sqrt(sum(v * v)) as n from cells group by 1)
select a, b, genuine, round(sum(x.v * y.v) / (max(m.n) * max(q.n)), 6) as similarity from p join cells x on x.vec_id = a join cells y on y.vec_id = b and x.i = y.i join n m on m.vec_id = a join n q on q.vec_id = b where b is not null group by 1, 2, 3""")
def trial_pairs(spark, sf):
    """Only ids are placed by label; vectors are joined to the pairs by id."""
    vectors = table(spark, sf, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("vec"))
    own = Window.partitionBy("label").orderBy("vec_id")
    placed = table(spark, sf, "embeddings").select("vec_id", "label").withColumn("k", F.row_number().over(own))
    same = placed.select(F.col("vec_id").alias("a"), F.lead("vec_id").over(own).alias("b"), F.lit(True).alias("genuine"))
    unlike = placed.select(F.col("vec_id").alias("a"), F.lead("vec_id").over(Window.partitionBy("k").orderBy("label")).alias("b"), F.lit(False).alias("genuine"))
    pairs = same.union(unlike).where("b is not null")
    both = pairs.join(vectors.toDF("a", "x"), "a").join(vectors.toDF("b", "y"), "b")
    return both.select("a", "b", "genuine", r6(V.cosine(F.col("x"), F.col("y"))).alias("similarity"))


@query("select doc_id from documents order by md5('subset 42 ' || doc_id), doc_id limit 100")
def file_subset(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("subset 42 "), F.col("doc_id").cast("string"))), "doc_id").limit(100)


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where event_type = 'view') where k = 1")
def latest_embedding_log(spark, sf):
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return table(spark, sf, "events").where("event_type = 'view'").groupBy("user_id").agg(last.alias("x")).select("user_id", "x.event_id", "x.value")


@query("""select 'customer' as log, c_custkey as id, c_acctbal as value, c_mktsegment as segment, cast(null as int) as nation from customer
union all by name select 'supplier' as log, s_suppkey as id, s_acctbal as value, s_nationkey as nation from supplier""")
def log_append(spark, sf):
    old = table(spark, sf, "customer").select(F.lit("customer").alias("log"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("segment"))
    new = table(spark, sf, "supplier").select(F.lit("supplier").alias("log"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"), F.col("s_nationkey").alias("nation"))
    return old.unionByName(new, allowMissingColumns=True)


@query("select event_id, 'live' as model, value from events where event_type <> 'error' union all select event_id, 'shadow', value * 2 from events where event_type = 'error'")
def shadow_append(spark, sf):
    rows = table(spark, sf, "events")
    live = rows.where("event_type != 'error'").select("event_id", F.lit("live").alias("model"), "value")
    return live.union(rows.where("event_type = 'error'").select("event_id", F.lit("shadow"), F.col("value") * 2))


@query("""select p_partkey, 'brand' as feature, p_brand as value from part union all select p_partkey, 'size', case when p_size > 25 then 'large' else cast(p_size as varchar) end from part
union all select p_partkey, 'type', p_type from part where p_size > 25""")
def feature_merge(spark, sf):
    old = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    new = F.when(F.col("p_size") > 25, F.create_map(F.lit("size"), F.lit("large"), F.lit("type"), F.col("p_type"))).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(F.col("new"), k))  # the last wins
    rows = table(spark, sf, "part").withColumn("new", new)
    return rows.select("p_partkey", F.explode(F.map_concat(kept, "new")).alias("feature", "value"))


@query("select distinct label from embeddings")
def distinct_labels(spark, sf):
    return table(spark, sf, "embeddings").select("label").distinct()


@query(f"with {CELLS}, d as (select vec_id, v, coalesce(v - lag(v) over (partition by vec_id order by i), 0) as s from cells) select vec_id, 2 * count(*) as n, round(sum(v), 6) as statics, round(sum(s), 6) as deltas from d group by vec_id")
def stack_features(spark, sf):
    vec = V.doubles(F.col("embedding"))
    rows = table(spark, sf, "embeddings").select("vec_id", vec.alias("v"))
    steps = F.transform("v", lambda x, i: F.when(i > 0, x - F.get(F.col("v"), i - 1)).otherwise(0.0))
    stacked = rows.select("vec_id", F.size("v").alias("half"), F.concat("v", steps).alias("all"))
    part = lambda a, n: V.total(F.slice(F.col("all"), a, n))
    return stacked.select("vec_id", F.size("all").cast("long").alias("n"), r6(part(F.lit(1), F.col("half"))).alias("statics"), r6(part(F.col("half") + 1, F.col("half"))).alias("deltas"))


MARGIN, SCALE = 0.2, 30.0


@query(f"""with {SIMS}, l as (select vec_id, label = candidate as own, {SCALE} * case when label <> candidate then round(s, 6) when round(s, 6) > {math.cos(math.pi - MARGIN)}::double
  then round(s, 6) * {math.cos(MARGIN)}::double - sqrt(greatest(0, 1 - round(s, 6) * round(s, 6))) * {math.sin(MARGIN)}::double else round(s, 6) - {math.sin(math.pi - MARGIN) * MARGIN}::double end as logit from sims)
select vec_id, round(ln(sum(exp(logit - m))) + max(m) - max(logit) filter (own), 5) as loss from (select *, max(logit) over (partition by vec_id) as m from l) group by vec_id""")
def margin_softmax_loss(spark, sf):
    rows = identify_all_speakers(spark, sf)
    own = F.col("label") == F.col("candidate")
    rows = rows.select("vec_id", own.alias("own"), scores.margin_logits(F.col("similarity"), own, SCALE, MARGIN).alias("logit"))
    rows = rows.withColumn("m", F.max("logit").over(Window.partitionBy("vec_id")))
    return rows.groupBy("vec_id").agg(F.round(F.log(F.sum(F.exp(F.col("logit") - F.col("m")))) + F.max("m") - F.max(F.when(F.col("own"), F.col("logit"))), 5).alias("loss"))


@query(f"""with {CELLS}, n as (select vec_id, sqrt(sum(v * v)) as n from cells group by 1), u as (select c.vec_id, c.label, c.vec_id // 50 as batch, i, v / n as v from cells c join n using (vec_id)),
s as (select a.vec_id, a.label = b.label as same, sum(a.v * b.v) / 0.07::double as logit from u a join u b on a.batch = b.batch and a.i = b.i and a.vec_id <> b.vec_id group by a.vec_id, b.vec_id, 2),
m as (select *, max(logit) over (partition by vec_id) as top from s), z as (select *, ln(sum(exp(logit - top)) over (partition by vec_id)) + top as lse from m)
select vec_id, round(-avg(logit - lse), 4) as loss from z where same group by vec_id""")
def contrastive_loss(spark, sf):
    unit = V.unit(V.doubles(F.col("embedding")))
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 50).alias("batch"), unit.alias("u"))
    other = rows.select("batch", *[F.col(c).alias(f"{c}_") for c in ("vec_id", "label", "u")])
    pairs = rows.join(other, "batch").where("vec_id != vec_id_")  # a batch has 50 rows
    pairs = pairs.select("vec_id", (F.col("label") == F.col("label_")).alias("same"), (V.dot(F.col("u"), F.col("u_")) / 0.07).alias("logit"))
    own = Window.partitionBy("vec_id")
    pairs = pairs.withColumn("top", F.max("logit").over(own)).withColumn("lse", F.log(F.sum(F.exp(F.col("logit") - F.col("top"))).over(own)) + F.col("top"))
    return pairs.where("same").groupBy("vec_id").agg(F.round(-F.avg(F.col("logit") - F.col("lse")), 4).alias("loss"))


@query(f"""with {SIMS}, l as (select vec_id, label = candidate as own, 4 * round(s, 6) as s, 6 * round(s, 6) + cast(label = candidate as int) as t from sims),
z as (select *, ln(sum(exp(s)) over w) as zs, ln(sum(exp(s / 3)) over w) as ks, ln(sum(exp(t / 3)) over w) as kt from l window w as (partition by vec_id))
select vec_id, round(0.5::double * sum(zs - s) filter (own) + 0.5::double * 9 * -sum(exp(t / 3 - kt) * (s / 3 - ks)), 6) as loss from z group by vec_id""")
def distillation_loss(spark, sf):
    own, s = F.col("label") == F.col("candidate"), F.col("similarity")
    rows = identify_all_speakers(spark, sf).select("vec_id", own.alias("own"), (4 * s).alias("s"), (6 * s + own.cast("int")).alias("t"))
    w = Window.partitionBy("vec_id")
    total = lambda c: F.log(F.sum(F.exp(c)).over(w))
    rows = rows.withColumns({"zs": total(F.col("s")), "ks": total(F.col("s") / 3), "kt": total(F.col("t") / 3)})
    hard = F.sum(F.when(F.col("own"), F.col("zs") - F.col("s")))
    soft = -F.sum(F.exp(F.col("t") / 3 - F.col("kt")) * (F.col("s") / 3 - F.col("ks")))
    return rows.groupBy("vec_id").agg(r6(0.5 * hard + 0.5 * 9 * soft).alias("loss"))


@query("""with u as (select l_orderkey, l_linenumber, l_suppkey, l_extendedprice as g, (('0x' || substr(sha256('secret:' || l_orderkey || ':' || l_linenumber), 1, 12))::bigint + 0.5::double) / 281474976710656::double - 0.5::double as u from lineitem),
n as (select l_suppkey, sqrt(sum(g * g)) as norm from u group by 1)
select l_orderkey, l_linenumber, round(sum(g * least(1, 1 / norm) - 2 * sign(u) * ln(1 - 2 * abs(u))), 5) as noisy from u join n using (l_suppkey) group by 1, 2""")
def laplace_gradients(spark, sf):
    """Clipped to norm 1 by supplier, with noise drawn from a secret and the row's key."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_extendedprice").alias("g"))
    norms = rows.groupBy("l_suppkey").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("norm"))
    noisy = F.col("g") * F.least(F.lit(1.0), 1 / F.col("norm")) + scores.laplace(scores.uniform("secret", "l_orderkey", "l_linenumber"), 2.0)
    return rows.join(norms, "l_suppkey").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum(noisy), 5).alias("noisy"))


@query("""with c as (select item_id, item_id % 3 as op, case item_id % 3 when 0 then 10 + item_id * 7 % 90 when 1 then 50 + item_id * 7 % 50 else 5 + item_id * 7 % 11 end as a, item_id * 13 as h from benchmark),
d as (select *, case op when 0 then 10 + h % 90 when 1 then 10 + h % (a - 10) else 5 + h % 11 end as b from c)
select item_id, 'Calculate and say the answer: ' || a || case op when 0 then ' + ' when 1 then ' - ' else ' × ' end || b as text from d""")
def arithmetic_challenges(spark, sf):
    return challenges(spark, sf).select("item_id", "text")


@query("""with c as (select item_id, item_id % 3 as op, case item_id % 3 when 0 then 10 + item_id * 7 % 90 when 1 then 50 + item_id * 7 % 50 else 5 + item_id * 7 % 11 end as a, item_id * 13 as h from benchmark),
d as (select *, case op when 0 then 10 + h % 90 when 1 then 10 + h % (a - 10) else 5 + h % 11 end as b from c)
select item_id, cast(case op when 0 then a + b when 1 then a - b else a * b end as varchar) as expected from d""")
def challenge_answers(spark, sf):
    return challenges(spark, sf).select("item_id", "expected")


def challenges(spark, sf):
    """A sum, difference (never below 0) or product for each item, the numbers drawn
    from its id, with the expected response, which the user's copy leaves out."""
    n = F.col("item_id")
    rows = table(spark, sf, "benchmark").select("item_id", (n % 3).alias("op"))
    of = lambda x, y, z: F.when(F.col("op") == 0, x).when(F.col("op") == 1, y).otherwise(z)
    rows = rows.withColumn("a", of(10 + n * 7 % 90, 50 + n * 7 % 50, 5 + n * 7 % 11))
    rows = rows.withColumn("b", of(10 + n * 13 % 90, 10 + n * 13 % (F.col("a") - 10), 5 + n * 13 % 11))
    text = F.concat(F.lit("Calculate and say the answer: "), F.col("a").cast("string"), of(F.lit(" + "), F.lit(" - "), F.lit(" × ")), F.col("b").cast("string"))
    a, b = F.col("a"), F.col("b")
    return rows.select("item_id", text.alias("text"), of(a + b, a - b, a * b).cast("string").alias("expected"))
