"""Registered queries of measures over streams, and of logs and reports written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from timbral.functions import measures
from timbral.functions.signal import magnitude_spectrum
from timbral.operators import fingerprint, liveness, rooms
from timbral.plans.acoustics import RATE, VOICE, channels, each, part_rooms, transform_sql, voice_frames, voices
from timbral.plans.queries import SIG, query, r6
from timbral.plans.scoring import picked
from timbral.session import table
from timbral.sources import logs
from timbral.tables import shared_folder


@query()
def modulation_features(spark, sf):
    found = voices(spark, sf).select("user_id", measures.modulation_features(16, 4)(F.col("x")).alias("m")).where("m is not null")
    return found.select("user_id", *[r6(F.col(f"m.{c}")).alias(c) for c in ("mean", "deviation", "spectral_centre", "temporal_centre")])


STRESS = f"""{transform_sql(16, 4, 16, True)}, sp0 as (select user_id, frame as i, sum(sqrt(re * re + im * im)) as e from z group by 1, 2), sp as (select user_id, cast(i as int) as i, e / max(e) over (partition by user_id) as v from sp0), {picked("sp", "user_id", 0.1, 3)},
pk as (select user_id, unnest(peaks) as i, unnest(list_transform(range(1, len(peaks) + 1), lambda k: peaks[k] - case when k > 1 then peaks[k - 1] end)) as gap from picked)"""


@query(f"""with {STRESS}, st as (select pk.user_id, count(*) as n, avg(v) as m, stddev_pop(v) / avg(v) as s, coalesce(stddev_pop(gap) / avg(gap), 0) as g from pk join sp on sp.user_id = pk.user_id and sp.i = pk.i group by 1)
select u.user_id, coalesce(n, 0) as n, round(coalesce(m, 0), 6) as mean, round(coalesce(s, 0), 6) as variability, round(coalesce(g, 0), 6) as interval_variability from (select distinct user_id from sp) u left join st on st.user_id = u.user_id""")
def stress_pattern(spark, sf):
    found = voices(spark, sf).select("user_id", measures.stress_pattern(16, 4, distance=3)(F.col("x")).alias("s")).where("s is not null")
    return found.select("user_id", "s.n", *[r6(F.col(f"s.{c}")).alias(c) for c in ("mean", "variability", "interval_variability")])


@query()
def background_level(spark, sf):
    found = voices(spark, sf).select("user_id", measures.background_level(RATE, 32)(F.col("x")).alias("b")).where("b is not null")
    return found.select("user_id", F.round("b.level", 4).alias("level"), F.size("b.spectrum").alias("bins"))


#: The median of five, as in the stream's own order, then octaves one after another.
OCTAVES = f"""{SIG}, m as (select user_id, i, list_sort(list_concat(array_agg(x) over w, list_value(0.0, 0.0))[1:5])[3] as x from sig window w as (partition by user_id order by i rows between 2 preceding and 2 following)),
walk as (select user_id, i, x as y from m where i = 0 union all select m.user_id, m.i, case when w.y > 0 and m.x / w.y > 1.8 and m.x / w.y < 2.2 then m.x / 2 when w.y > 0 and m.x / w.y > 0.45 and m.x / w.y < 0.55 then m.x * 2 else m.x end from walk w join m on m.user_id = w.user_id and m.i = w.i + 1)"""


@query(f"with recursive {OCTAVES} select user_id, cast(i as int) as i, round(y, 6) as f0 from walk")
def octave_correction(spark, sf):
    found = voices(spark, sf).select("user_id", measures.octave_corrected()(F.transform("x", lambda v: F.round(v * 500, 2)))["f0"].alias("f"))
    return each(found, "f", "f0")


SPANS = f"""{VOICE}, h as (select user_id, unnest(range(0, n // 4 + 1)) as k from voice where i = 0), f as (select v.user_id, h.k, sqrt(sum(x * x) / 8) as rms, any_value(n) as n from h join voice v on v.user_id = h.user_id and i between h.k * 4 - 4 and h.k * 4 + 3 group by 1, 2),
l as (select *, rms > max(rms) over (partition by user_id) * power(10, -0.3::double) as loud from f), g as (select *, k - row_number() over (partition by user_id order by k) as island from l where loud),
s as (select user_id, min(k) * 4 as a, least(max(k) * 4 + 4, any_value(n)) as b from g group by user_id, island)"""


@query(f"with {SPANS} select user_id, a as start, b as stop from s where b - a >= 8 and a < b")
def phrase_spans(spark, sf):
    """Stretches within 6 dB of the loudest frame, of 8 samples or more."""
    found = voices(spark, sf).select("user_id", measures.phrases(8.0, 6.0, 1.0, 8, 4)(F.col("x")).alias("p")).where("p is not null")
    rows = found.select("user_id", F.explode(F.arrays_zip(F.col("p.starts").alias("start"), F.col("p.ends").alias("stop"))).alias("s"))
    return rows.select("user_id", "s.start", "s.stop")


@query(f"with {SPANS}, t as (select user_id, min(a) as a, max(b) as b from s where a < b group by 1), n as (select user_id, max(n) as n from voice group by 1) select t.user_id, case when b - a + 4 <= n then greatest(0, a - 2) else a end as start, case when b - a + 4 <= n then least(n, b + 2) - greatest(0, a - 2) else b - a end as length from t join n on t.user_id = n.user_id")
def trimmed_voice(spark, sf):
    found = voices(spark, sf).select("user_id", measures.trimmed(1000.0, 6.0, 2.0, 8, 4)(F.col("x")).alias("t")).where("t is not null")
    return found.select("user_id", "t.start", F.size("t.y").cast("long").alias("length"))


@query(f"""with {SIG}, s as (select user_id, event_type, x / 500 as x, row_number() over (partition by user_id, event_type order by i) - 1 as k from sig where event_type in ('view', 'click')),
n as (select user_id, event_type, count(*) as n from s group by 1, 2), m as (select user_id, min(n) as n from n group by 1 having count(*) = 2)
select s.user_id, cast(k as int) as i, round(sum(case event_type when 'view' then -x else -x end), 6) as y from s join m on s.user_id = m.user_id where k < n group by 1, 2""")
def beamformed(spark, sf):
    """Two channels at front and back of the ring: towards the front both turn by half a circle."""
    own = channels(spark, sf)
    side = lambda kind: own.where(F.col("event_type") == kind).select("user_id", F.col("x").alias(kind))
    both = side("view").join(side("click"), "user_id")
    n = F.least(F.size("view"), F.size("click"))
    pair = F.array(F.slice(F.col("view"), F.lit(1), n), F.slice(F.col("click"), F.lit(1), n))
    return each(both.select("user_id", measures.beamformed(2, 0.0)(pair).alias("y")), "y", "y")


@query(f"""with {SIG}, v as (select user_id, event_type, x - lag(x) over w as v, i from sig window w as (partition by user_id, event_type order by i)), a as (select *, v - lag(v) over (partition by user_id, event_type order by i) as a from v)
select user_id, event_type, round(avg(abs(v)), 6) as speed, round(avg(abs(a)), 6) as acceleration from a group by 1, 2""")
def track_transitions(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), "value")
    found = measures.transitions(rows, ["user_id"], "event_type", "at", "value")
    return found.select("user_id", "event_type", r6("speed").alias("speed"), r6("acceleration").alias("acceleration"))


@query()
def formant_transitions(spark, sf):
    """Speeds of the formant tracks of each stream."""
    tracks = fingerprint.tracks(voices(spark, sf), ["user_id"], "x", RATE, 32, 8, 64, bands=24).where("name like 'formant%'")
    found = measures.transitions(tracks, ["user_id"], "name", "frame", "value")
    return found.select("user_id", "name", F.round("speed", 3).alias("speed"), F.round("acceleration", 3).alias("acceleration"))


@query("select vec_id, cast(i.range as int) as i, round(embedding[i.range + 1]::double * 0.7::double + embedding[64 - i.range]::double * (label / 10.0::double), 6) as y from embeddings, range(64) i")
def weighted_fusion(spark, sf):
    """Each embedding and its reverse, weighed by what comes with the row."""
    own = F.transform("embedding", lambda x: x.cast("double"))
    fused = measures.weighted_sum([own, F.reverse(own)], [F.lit(0.7), F.col("label") / 10])
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(fused).alias("i", "y")).select("vec_id", "i", r6("y").alias("y"))


@query("""select event_type as kind, cast(ts as date) as day, count(*) as n, round(sum(value), 4) as total from events where event_type in ('view', 'error') and ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-21' group by 1, 2""")
def log_read_back(spark, sf):
    """Events appended to a log in two runs, and two kinds of eleven days read from it."""
    import uuid

    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    for half in (0, 1):
        logs.append_log(events.where(F.col("event_id") % 2 == half), path, F.col("event_type"), "ts", 2)
    found = logs.read_log(spark, path, ["view", "error"], "2024-01-10", "2024-01-20")
    return found.groupBy(F.col("log_kind").alias("kind"), F.col("log_day").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query()
def environment_report(spark, sf):
    heard = rooms.room_responses(part_rooms(spark, sf), ["room_id"], 8000, 12)
    found = heard.select("room_id", rooms.reverberation(8000)(F.col("h")).alias("r"), measures.background_level(8000)(F.col("h"))["level"].alias("level"), rooms.cross_correlation("h", F.reverse("h")).alias("c"))
    flat = found.select("room_id", F.col("r.whole").alias("whole"), F.col("r.bands").alias("bands"), "level", F.col("c.iacc").alias("iacc"), (F.col("c.lag") / 8.0).alias("delay"))
    return logs.environment_report(flat, "room_id", rooms.OCTAVES, "whole", "bands", "level", "iacc", "delay")


REPLAY = ", ".join(f"coalesce(avg(sqrt(re * re + im * im)) filter (b * 44100 / 512.0::double between {low} and {high}), 0) as {name}" for name, low, high in (("b0", 20, 150), ("b3", 500, 2000), ("b5", 5000, 10000), ("b6", 10000, 20000)))


@query(f"with {transform_sql(32, 16, 512, False)}, e as (select user_id, {REPLAY} from z group by 1) select user_id, round(case when b6 > 0 then b5 / b6 else 0 end, 6) as high_ultrahigh, round(case when b0 > 0 then b3 / b0 else 0 end, 6) as mid_subbass from e")
def replay_ratios(spark, sf):
    """Bands of the mean spectrum of full frames, held against each other."""
    rows = voice_frames(spark, sf, 32, 16).select("user_id", F.posexplode(magnitude_spectrum(512)(F.col("x"))).alias("b", "m"))
    energies = liveness.band_means(rows.withColumn("f", F.col("b") * 44100 / 512), ["user_id"], "f", "m", liveness.REPLAY_BANDS)
    found = liveness.band_ratios(energies, ["user_id"], liveness.REPLAY_RATIOS)
    return found.select("user_id", *[r6(c).alias(c) for c in ("high_ultrahigh", "mid_subbass")])
