"""Registered queries of decompositions, formants, enrolment on disk and the processing chain."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from timbral.functions import decompose, glottal
from timbral.functions import signal as S
from timbral.functions import vectors as V
from timbral.operators import enrolment, learning, process
from timbral.plans.acoustics import RATE, VOICE, burg_sql, each, mel_sql, transform_sql, voice_frames, voices
from timbral.plans.queries import CELLS, query, r6, similarities
from timbral.session import table
from timbral.tables import shared_folder


def cells(found, column: str, name: str):
    """(user_id, frame, k, name) of frames of values."""
    rows = found.select("user_id", F.posexplode(column).alias("frame", "v")).select("user_id", "frame", F.posexplode("v").alias("k", name))
    return rows.select("user_id", "frame", "k", r6(name).alias(name))


@query(f"""with {transform_sql(32, 8, 32, True)}, c as (select user_id, frame, ((cast(round_even(12 * log2(b * 62.5::double / 440), 0) as bigint) + 9) % 12 + 12) % 12 as k, sum(re * re + im * im) as e from z where b > 0 group by 1, 2, 3),
w as (select fs.user_id, fs.frame, k.range as k, coalesce(e, 0) as e from fs cross join range(12) k left join c on c.user_id = fs.user_id and c.frame = fs.frame and c.k = k.range), m as (select *, max(e) over (partition by user_id, frame) as top from w)
select user_id, cast(frame as int) as frame, cast(k as int) as k, round(case when top > 0 then e / top else 0 end, 6) as energy from m""")
def pitch_classes(spark, sf):
    return cells(voices(spark, sf).select("user_id", decompose.pitch_classes(2000, 32, 8)(F.col("x"))["chroma"].alias("c")), "c", "energy")


@query(f"""with {transform_sql(32, 8, 32, True)}, {mel_sql(RATE, 32, 10)} select user_id, cast(frame as int) as frame, cast(k as int) as k, round(10 * log10(greatest(sum((re * re + im * im) * w), 1e-10)), 6) as level from z join mel using (b) group by 1, 2, 3""")
def log_mel_frames(spark, sf):
    return cells(voices(spark, sf).select("user_id", decompose.log_mel(RATE, 32, 8, 10)(F.col("x"))["mel"].alias("m")), "m", "level")


#: Sums under Hann windows of as many cycles as tell semitones apart, around every eighth sample.
CONSTANT_Q = f"""{VOICE}, b as (select range as k, 65.40639132514966::double * power(2, range / 12.0::double) as f from range(36)),
l as (select *, greatest(3, cast(ceil(2000 / f / (power(2, 1 / 12.0::double) - 1)) as bigint) + 1 - cast(ceil(2000 / f / (power(2, 1 / 12.0::double) - 1)) as bigint) % 2) as n from b),
s as (select l.k, sum(0.5 - 0.5 * cos(2 * pi() * (t.range + 1) / (l.n + 1))) as total from l, range(1000) t where t.range < l.n group by 1),
c as (select user_id, unnest(range(0, n // 8 + 1)) as range from voice where i = 0),
q as (select v.user_id, c.range as frame, l.k, 2 / s.total * (0.5 - 0.5 * cos(2 * pi() * (v.i - c.range * 8 + l.n // 2 + 1) / (l.n + 1))) * v.x as x, 2 * pi() * l.f * (v.i - c.range * 8) / 2000 as p from voice v join c on c.user_id = v.user_id, l join s on s.k = l.k where abs(v.i - c.range * 8) <= l.n // 2)"""


@query(f"with {CONSTANT_Q} select user_id, cast(frame as int) as frame, cast(k as int) as k, round(sqrt(power(sum(x * cos(p)), 2) + power(sum(x * sin(p)), 2)), 6) as size from q group by 1, 2, 3")
def constant_q(spark, sf):
    return cells(voices(spark, sf).select("user_id", decompose.constant_q(2000, 8, bins=36, per_octave=12)(F.col("x"))["size"].alias("q")), "q", "size")


@query()
def phase_steps(spark, sf):
    return cells(voices(spark, sf).select("user_id", decompose.phase_steps(16, 4)(F.col("x"))["velocity"].alias("p")), "p", "step")


@query(f"with {VOICE} select user_id, cast(i as int) as i, round(x, 6) as y from voice")
def harmonic_percussive(spark, sf):
    """What rings and what clicks add up to the signal."""
    found = voices(spark, sf).select("user_id", decompose.harmonic_percussive(16, 4, 5)(F.col("x")).alias("h"))
    return each(found.select("user_id", F.zip_with("h.harmonic", "h.percussive", lambda a, b: a + b).alias("y")), "y", "y")


@query()
def harmonic_share(spark, sf):
    found = voices(spark, sf).select("user_id", decompose.harmonic_percussive(16, 4, 5)(F.col("x")).alias("h")).where("h is not null")
    return found.select("user_id", r6(V.dot(F.col("h.harmonic"), F.col("h.harmonic")) / (V.dot(F.col("h.percussive"), F.col("h.percussive")) + 1e-10)).alias("ratio"))


@query()
def formant_widths(spark, sf):
    found = voice_frames(spark, sf, 32, 16).select("user_id", "frame", glottal.formants_with_widths(8000)(F.col("x")).alias("f"))
    rows = found.select("user_id", "frame", F.posexplode(F.arrays_zip("f.frequency", "f.width")).alias("k", "c"))
    return rows.select("user_id", "frame", "k", F.round("c.frequency", 3).alias("frequency"), F.round("c.width", 3).alias("width"))


@query()
def closed_phases(spark, sf):
    """Closed phases of four samples or more, at a pitch of 100 of 800 samples a second."""
    own = voices(spark, sf).withColumn("f0", F.transform("x", lambda _: F.lit(100.0)))
    found = glottal.closed_phase_formants(own, ["user_id"], "x", "f0", 1, 800.0, share=0.6, least=4)
    return found.select("user_id", "k", F.round("formant", 3).alias("formant"), "cycles")


def filter_sql(order: int) -> str:
    """s8(user_id, a) and the like: the prediction filter from its reflections, order by order."""
    parts = [burg_sql(order), "s0 as (select distinct user_id, [1.0::double] as a from h)"]
    for k in range(1, order + 1):
        step = f"list_transform(range(1, {k + 2}), lambda j: e[j] + coalesce(k, 0) * e[{k + 2} - j])"
        parts.append(f"s{k} as (select e.user_id, {step} as a from (select user_id, list_append(a, 0.0::double) as e from s{k - 1}) e left join k{k} on k{k}.user_id = e.user_id)")
    return ", ".join(parts)


@query(f"""with {filter_sql(8)} select v.user_id, cast(v.i as int) as i, round(case when v.i < 8 then 0 else sum(a[v.i - u.i + 1] * u.x) end, 6) + 0 as y
from voice v join s8 on s8.user_id = v.user_id join voice u on u.user_id = v.user_id and u.i between v.i - 8 and v.i group by v.user_id, v.i""")
def prediction_residual(spark, sf):
    found = each(voices(spark, sf).select("user_id", glottal.lpc_residual(8)(F.col("x"))["residual"].alias("y")), "y", "y")
    return found.withColumn("y", F.col("y") + 0)


@query(f"""with {CELLS}, m as (select label, i, avg(v) as m from cells group by 1, 2), p as (select c.vec_id, sum(c.v * m.m) / (sqrt(sum(c.v * c.v)) * sqrt(sum(m.m * m.m))) as s from cells c join m on c.label = m.label and c.i = m.i group by 1)
select vec_id, round((s + 1) / 2, 6) as similarity, round((s + 1) / 2, 6) >= 0.7::double as accepted from p""")
def profiles_on_disk(spark, sf):
    """Speakers enrolled with a third of their vectors, updated with the others, and all verified."""
    path, rows = f"{shared_folder(spark)}/profiles-{uuid.uuid4().hex}", table(spark, sf, "embeddings")
    first = F.col("vec_id") % 3 == 0
    enrolment.enrol(rows.where(first), "label", "embedding", 64, path, F.timestamp_seconds(F.lit(1)))
    enrolment.update(rows.where(~first), "label", "embedding", 64, path, F.timestamp_seconds(F.lit(2)))
    found = enrolment.verify(rows, "label", "embedding", path)
    return found.select("vec_id", r6("similarity").alias("similarity"), "accepted")


@query()
def normalized_dtw(spark, sf):
    """A warped distance over the mean length of both sequences."""
    rows = similarities(spark, sf)
    far = S.dtw_distance(V.doubles(F.col("embedding")), F.col("centroid")) / ((F.size("embedding") + F.size("centroid")) / 2)
    return rows.select("vec_id", r6(far).alias("distance"))


@query()
def retraining_samples(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("u", F.abs(F.col("embedding")[0].cast("double"))).withColumn("part", F.col("vec_id") % 4)
    return learning.retraining_samples(rows, "vec_id", "u", "embedding", ["label", "part"], 40).select("vec_id", "label", "part")


@query()
def processed_features(spark, sf):
    """The chain's features, read back from what it wrote."""
    path = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    process.process_batch(voices(spark, sf), "user_id", "x", 2000, path, 32, 8)
    rows = spark.read.schema("user_id bigint, features map<string, double>").json(path)
    return rows.select("user_id", F.explode("features").alias("feature", "value")).select("user_id", "feature", F.round("value", 4).alias("value"))
