"""Registered queries of signal analysis and change over the users' streams of values as samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.functions import filters, glottal, pitch, spectra, voice, wavelets
from timbral.functions import signal as S
from timbral.functions.batches import frames, streams
from timbral.operators import rooms
from timbral.plans.queries import SIG, query, r6
from timbral.session import table

RATE = 16000
#: A tracker for streams of some dozen samples, taken as 64 a second.
SLOW = pitch.Tracker(64.0, length=32, hop=8, low=2.0, high=16.0, steps=5, octaves_a_second=4.0)


def voices(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, x): each user's values over 500 in order of time."""
    events = table(spark, sf, "events").withColumn("x", F.col("value") / 500)
    return streams(events, ["user_id"], ["ts", "event_id"], "x")


VOICE = f"{SIG}, voice as (select user_id, i, x / 500 as x, count(*) over (partition by user_id) as n from sig)"


def each(df: DataFrame, column: str, name: str) -> DataFrame:
    """(user_id, i, name): an array's values, to 6 places."""
    return df.select("user_id", F.posexplode(column).alias("i", name)).select("user_id", "i", r6(name).alias(name))


@query(f"""with {VOICE}, p as (select a.user_id, a.i // 2 as i, a.x as x, coalesce(b.x, a.x) as y from voice a left join voice b on a.user_id = b.user_id and b.i = a.i + 1 where a.i % 2 = 0)
select user_id, cast(i as int) as i, round((x + y) / sqrt(2), 6) as low, round((x - y) / sqrt(2), 6) as high from p""")
def haar_level(spark, sf):
    found = voices(spark, sf).select("user_id", wavelets.wavelet_level(1)(F.col("x")).alias("w"))
    rows = found.select("user_id", F.posexplode(F.arrays_zip("w.low", "w.high")).alias("i", "c"))
    return rows.select("user_id", "i", r6(F.col("c.low")).alias("low"), r6(F.col("c.high")).alias("high"))


@query(f"with {VOICE} select user_id, cast(i as int) as i, round(x, 6) as y from voice")
def wavelet_round_trip(spark, sf):
    """Five levels taken apart and put together with nothing removed."""
    return each(voices(spark, sf).select("user_id", wavelets.wavelet_denoise(scale=0.0)(F.col("x"))["y"].alias("y")), "y", "y")


#: The published db4 filter.
DB4 = (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278)


def denoise_sql(levels: int = 5) -> str:
    """The pyramid level by level, the threshold from the coarsest one, and the way back."""
    high = [(-1) ** j * h for j, h in enumerate(DB4)][::-1]
    taps = ", ".join(f"({j}, {h!r}::double, {g!r}::double)" for j, (h, g) in enumerate(zip(DB4, high, strict=True)))
    parts = [VOICE, f"taps(j, h, g) as (values {taps})", "a0 as (select user_id, i, n, x from voice)"]
    for k in range(1, levels + 1):
        parts.append(f"""p{k} as (select u.user_id, m.range as m, t.h, t.g, u.n, ((2 * m.range - 6 + t.j) % (2 * u.n) + 2 * u.n) % (2 * u.n) as r from (select distinct user_id, n, unnest(range(0, (n + 7) // 2)) as range from a{k - 1}) m, taps t, (select distinct user_id, n from a{k - 1}) u where u.user_id = m.user_id),
c{k} as (select p.user_id, p.m as i, (any_value(p.n) + 7) // 2 as n, sum(h * x) as x, sum(g * x) as d from p{k} p join a{k - 1} a on a.user_id = p.user_id and a.i = case when r < p.n then r else 2 * p.n - 1 - r end group by 1, 2),
a{k} as (select user_id, i, n, x from c{k})""")
    parts.append(f"s as (select c.user_id, median(abs(d)) / 0.6745 * sqrt(2 * ln(any_value(v.n))) as t from c{levels} c join (select distinct user_id, n from voice) v on v.user_id = c.user_id group by 1)")
    parts.append(f"b{levels} as (select user_id, i, x from a{levels})")
    for k in range(levels, 0, -1):
        parts.append(f"""q{k} as (select c.user_id, c.i, b.x, sign(d) * greatest(abs(d) - t, 0) as d from c{k} c join b{k} b on b.user_id = c.user_id and b.i = c.i join s on s.user_id = c.user_id),
b{k - 1} as (select q.user_id, 2 * q.i + t.j - 6 as i, sum(q.x * t.h + q.d * t.g) as x from q{k} q, taps t, (select distinct user_id, n from a{k - 1}) u where u.user_id = q.user_id and 2 * q.i + t.j - 6 between 0 and u.n - 1 group by 1, 2)""")
    return f"with {', '.join(parts)} select user_id, cast(i as int) as i, round(x, 6) + 0 as y from b0"


@query(denoise_sql())
def wavelet_denoise(spark, sf):
    found = each(voices(spark, sf).select("user_id", wavelets.wavelet_denoise()(F.col("x"))["y"].alias("y")), "y", "y")
    return found.withColumn("y", F.col("y") + 0)


@query()
def speech_band_levels(spark, sf):
    """Root mean square of each speech band, zero-phase."""
    found = voices(spark, sf).select("user_id", filters.speech_bands(RATE)(F.col("x"))["bands"].alias("b"))
    rms = lambda b: F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v * v) / F.size(b))
    return found.select("user_id", F.posexplode(F.transform("b", rms)).alias("band", "rms")).select("user_id", "band", r6("rms").alias("rms"))


@query()
def breathing_pattern(spark, sf):
    """Streams as 4 samples a second, in frames of 4 samples at hops of 2."""
    found = voices(spark, sf).select("user_id", filters.breathing(4, length=4, hop=2)(F.col("x")).alias("b")).where("b is not null")
    return found.select("user_id", "b.n_peaks", *[r6(F.col(f"b.{c}")).alias(c) for c in ("rate", "regularity", "presence")])


@query()
def pitch_path(spark, sf):
    found = voices(spark, sf).select("user_id", pitch.pitch_track(SLOW)(F.col("x")).alias("p"))
    rows = found.select("user_id", F.posexplode(F.arrays_zip("p.f0", "p.voiced", "p.probability")).alias("frame", "c"))
    return rows.select("user_id", "frame", r6(F.col("c.f0")).alias("f0"), "c.voiced", r6(F.col("c.probability")).alias("probability"))


@query()
def glottal_measures(spark, sf):
    found = glottal.source_measures(voices(spark, sf), ["user_id"], "x", 2000)
    return found.select("user_id", "closures", *[r6(c).alias(c) for c in ("naq", "oq", "hrf")])


#: The pitch is 100 Hz but 0 at an error; closures are every place where the stream rises, 8 samples a step at 800 a second.
CLOSURES = f"""{SIG}, v as (select user_id, i, event_type <> 'error' as on_, x > lag(x, 1, 0) over (partition by user_id order by i) as rises, count(*) over (partition by user_id) as n,
    lag(event_type <> 'error', 1, false) over (partition by user_id order by i) and lead(event_type <> 'error', 1, false) over (partition by user_id order by i) as between_ from sig),
c as (select user_id, row_number() over (partition by user_id order by i) as k, i * 8 as spot from v where rises and (on_ or (between_ and i > 0 and i < n - 1)))"""


@query(f"""with recursive {CLOSURES}, walk as (select user_id, k, spot, spot as last, true as kept from c where k = 1
  union all select c.user_id, c.k, c.spot, case when c.spot - w.last between 5.6 and 10.4 then c.spot else w.last end, c.spot - w.last between 5.6 and 10.4 from walk w join c on c.user_id = w.user_id and c.k = w.k + 1)
select user_id, cast(spot as bigint) as closure from walk where kept""")
def refined_closures(spark, sf):
    events = table(spark, sf, "events").withColumn("f0", F.when(F.col("event_type") == "error", 0.0).otherwise(100.0))
    both = streams(events, ["user_id"], ["ts", "event_id"], "value").join(streams(events, ["user_id"], ["ts", "event_id"], "f0", "f0"), "user_id")
    at = F.filter(F.transform("x", lambda v, i: F.when(v > F.coalesce(F.get(F.col("x"), i - 1), F.lit(0.0)), i.cast("long") * 8)), lambda v: v.isNotNull())
    found = both.select("user_id", glottal.refine_closures(8, 800.0)(at, F.col("f0")).alias("c"))
    return found.select("user_id", F.explode("c").alias("closure"))


#: Burg's method to order 2 on Hamming-windowed streams, as sums over neighbours.
BURG = f"""{VOICE}, h as (select user_id, i, n, x * (0.54 - 0.46 * cos(2 * pi() * i / (n - 1))) as x from voice where n > 1),
l as (select *, lag(x) over (partition by user_id order by i) as y from h), k1 as (select user_id, -2 * sum(x * y) / sum(x * x + y * y) as k from l where y is not null group by 1),
f as (select l.user_id, l.i, x + k * y as f, y + k * x as b, k from l join k1 on l.user_id = k1.user_id where y is not null),
g as (select *, lag(b) over (partition by user_id order by i) as c from f), k2 as (select user_id, max(k) as k1, coalesce(-2 * sum(f * c) / sum(f * f + c * c), 0) as k2 from g group by 1)"""


@query(f"with {BURG} select user_id, round(k1, 6) as k1, round(k2, 6) as k2, round(k1 + k1 * k2, 6) as a1, round((1 - k2) / (1 + k2) / ((1 - k1) / (1 + k1)), 4) as area from k2")
def tube_sections(spark, sf):
    """A tube of one section: two reflections, the filter, and the second junction's area."""
    found = voices(spark, sf).select("user_id", glottal.tube_model(RATE, 1)(F.col("x")).alias("t")).where("t is not null")
    k, a = F.col("t.reflection"), F.col("t.lpc")
    return found.select("user_id", r6(k[0]).alias("k1"), r6(k[1]).alias("k2"), r6(a[1]).alias("a1"), F.round(F.col("t.areas")[1], 4).alias("area"))


def burg_sql(order: int) -> str:
    """Burg's method order by order on Hamming-windowed streams: m0, m1, .. hold what is predicted ahead
    (f) and behind (b) at each place, k1, k2, .. the reflections."""
    parts = [f"{VOICE}, h as (select user_id, i, x * (0.54 - 0.46 * cos(2 * pi() * i / (n - 1))) as x from voice where n > 1)", "m0 as (select user_id, i, lead(x) over w as f, x as b from h window w as (partition by user_id order by i) qualify lead(x) over w is not null)"]
    for k in range(1, order + 1):
        parts.append(f"k{k} as (select user_id, coalesce(-2 * sum(f * b) / nullif(sum(f * f + b * b), 0), 0) as k from m{k - 1} group by 1)")
        parts.append(f"n{k} as (select m.user_id, i, f + k * b as f, b + k * f as b from m{k - 1} m join k{k} k on k.user_id = m.user_id)")
        parts.append(f"m{k} as (select user_id, i, lead(f) over w as f, b from n{k} window w as (partition by user_id order by i) qualify lead(f) over w is not null)")
    return ", ".join(parts)


@query(f"with {burg_sql(16)}, u as (select distinct user_id from h) " + " union all ".join(f"select u.user_id, {k - 1}::int as k_, round(coalesce(k, 0), 6) + 0 as k from u left join k{k} on k{k}.user_id = u.user_id" for k in range(1, 17)))
def tube_model(spark, sf):
    found = voices(spark, sf).select("user_id", glottal.tube_model(RATE)(F.col("x")).alias("t")).where("t is not null")
    rows = found.select("user_id", F.posexplode("t.reflection").alias("k_", "k"))
    return rows.select("user_id", "k_", (r6("k") + 0).alias("k"))


@query()
def multitaper_spectrum(spark, sf):
    return each(voices(spark, sf).select("user_id", spectra.multitaper_spectrum(64.0, 64)(F.col("x"))["power"].alias("p")), "p", "power")


#: Energy of one-sided transforms of windowed frames, by Parseval's theorem.
PARSEVAL = f"""{VOICE}, fr as (select v.user_id, f.frame, v.i - f.frame * 4 as k, v.x * (0.5 - 0.5 * cos(2 * pi() * (v.i - f.frame * 4 + 1) / 17)) as x from voice v join (select user_id, unnest(range(0, (n - 16) // 4 + 1)) as frame from voice where i = 0 and n >= 16) f
  on f.user_id = v.user_id and v.i >= f.frame * 4 and v.i < f.frame * 4 + 16), e as (select user_id, frame, (16 * sum(x * x) + power(sum(x), 2) + power(sum(case when k % 2 = 0 then x else -x end), 2)) / 2 as e from fr group by 1, 2)"""


@query(f"with {PARSEVAL} select user_id, round(sum(e), 4) as energy from e group by 1")
def reassigned_energy(spark, sf):
    """Reassignment moves energy and keeps its sum."""
    found = voices(spark, sf).select("user_id", spectra.reassigned_spectrum(16, 4)(F.col("x"))["energy"].alias("e")).where("e is not null")
    whole = F.aggregate(F.flatten("e"), F.lit(0.0), lambda s, v: s + v)
    return found.select("user_id", F.round(whole, 4).alias("energy"))


@query()
def reassigned_spectrum(spark, sf):
    found = voices(spark, sf).select("user_id", spectra.reassigned_spectrum(16, 4)(F.col("x"))["energy"].alias("e"))
    return found.select("user_id", F.posexplode("e").alias("frame", "e")).select("user_id", "frame", F.posexplode("e").alias("bin", "energy")).select("user_id", "frame", "bin", r6("energy").alias("energy"))


#: Both transforms, the logarithm's cepstrum without what is in its middle, and the compressed product.
DELAY = f"""{VOICE}, b as (select range as b from range(64)), y as (select user_id, i, (0.54 - 0.46 * cos(2 * pi() * i / greatest(n - 1, 1))) as w, x, x - coalesce(lag(x) over (partition by user_id order by i), 0) as d from voice),
f as (select user_id, b, sum(w * x * cos(2 * pi() * i * b / 64)) as re, -sum(w * x * sin(2 * pi() * i * b / 64)) as im, sum(w * d * cos(2 * pi() * i * b / 64)) as dr, -sum(w * d * sin(2 * pi() * i * b / 64)) as di from y, b where i < 64 group by 1, 2),
c as (select user_id, q.b as q, sum(ln(sqrt(re * re + im * im) + 1e-10) * cos(2 * pi() * f.b * q.b / 64)) / 64 as c from f, b q where q.b < 20 or q.b >= 44 group by 1, 2),
s as (select user_id, b.b, exp(sum(c * cos(2 * pi() * b.b * q / 64))) as s from c, b group by 1, 2),
t as (select f.user_id, f.b, (dr * re + di * im) / (s * s) as t from f join s on s.user_id = f.user_id and s.b = f.b), m as (select *, sign(t) * power(abs(t), 0.2::double) as v from t)"""


@query(f"with {DELAY}, p as (select *, max(abs(v)) over (partition by user_id) as top from m) select user_id, cast(b as int) as i, round(v / top * 0.4::double, 6) as delay from p where b <= 32")
def modified_group_delay(spark, sf):
    return each(voices(spark, sf).select("user_id", spectra.modified_group_delay(64)(F.col("x"))["delay"].alias("d")), "d", "delay")


@query()
def pitch_shifted(spark, sf):
    return each(voices(spark, sf).select("user_id", voice.pitch_shift(4, 32, 8)(F.col("x"))["y"].alias("y")), "y", "y")


@query()
def formants_shifted(spark, sf):
    return each(voices(spark, sf).select("user_id", voice.formant_shift(1.1, 48, 12)(F.col("x"))["y"].alias("y")), "y", "y")


@query()
def time_stretched(spark, sf):
    return each(voices(spark, sf).select("user_id", voice.time_stretch(1.25, 32, 8)(F.col("x"))["kept"].alias("y")), "y", "y")


def part_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """A room for each size of a part: length, width and height, source and microphone within, and a
    reverberation time."""
    size = table(spark, sf, "part").select(F.col("p_size").alias("room_id").cast("long")).distinct()
    k = F.col("room_id")
    shape = size.select("room_id", (4 + k / 10).alias("x"), (3 + k / 20).alias("y"), F.lit(2.5).alias("z"), (0.3 + k / 100).alias("rt60"))
    placed = shape.select("*", (F.col("x") / 2).alias("sx"), (F.col("y") / 2).alias("sy"), F.lit(1.7).alias("sz"), (F.col("x") / 2 + 1).alias("mx"), (F.col("y") / 2).alias("my"), F.lit(1.7).alias("mz"))
    return placed.withColumn("wall", rooms.reflectance((F.col("x"), F.col("y"), F.col("z")), F.col("rt60")))


#: Images as offsets 2 n L + (1 - 2 p) s with |2 n - p| reflections along each axis.
IMAGES = """r as (select distinct p_size::bigint as room_id, 4 + p_size / 10 as x, 3 + p_size / 20 as y, 2.5::double as z, 0.3 + p_size / 100 as rt60 from part),
w as (select *, sqrt(1 - least(0.161 * x * y * z / (2 * (x * y + y * z + x * z) * rt60), 0.99)) as wall from r),
a as (select n.range as n, p.range as p, abs(2 * n.range - p.range) as c from range(-3, 4) n, range(2) p),
im as (select w.room_id, wall, a.c + b.c + d.c as reflections, sqrt(power(2 * a.n * x + (1 - 2 * a.p) * x / 2 - (x / 2 + 1), 2) + power(2 * b.n * y + (1 - 2 * b.p) * y / 2 - y / 2, 2)
  + power(2 * d.n * z + (1 - 2 * d.p) * 1.7 - 1.7, 2)) as distance from w, a, a b, a d where a.c + b.c + d.c <= 4)"""


@query(f"with {IMAGES} select room_id, cast(reflections as int) as reflections, count(*) as n, round(min(distance), 6) as nearest, round(sum(power(wall, reflections) / (4 * pi() * distance)), 6) as gain from im group by 1, 2")
def room_images(spark, sf):
    found = rooms.image_sources(part_rooms(spark, sf), ["room_id"], 4)
    return found.groupBy("room_id", "reflections").agg(F.count("*").alias("n"), r6(F.min("distance")).alias("nearest"), r6(F.sum("gain")).alias("gain"))


@query(f"with {IMAGES} select room_id, cast(round(distance / 343 * 8000) as int) as at, round(sum(power(wall, reflections) / (4 * pi() * distance)), 6) as h from im group by 1, 2")
def room_response(spark, sf):
    found = rooms.room_responses(part_rooms(spark, sf), ["room_id"], 8000, 4)
    rows = found.select("room_id", F.posexplode("h").alias("at", "h")).where("h > 0")
    return rows.select("room_id", "at", r6("h").alias("h"))


@query()
def voices_in_rooms(spark, sf):
    heard = rooms.room_responses(part_rooms(spark, sf), ["room_id"], 8000, 3)
    placed = voices(spark, sf).withColumn("room_id", F.pmod(F.col("user_id"), F.lit(50)) + 1)
    return each(rooms.in_rooms(placed, heard, ["room_id"], "x"), "wet", "y")


@query(f"with {VOICE} select user_id, cast(i as int) as i, round(x, 4) + 0 as h from voice")
def sweep_response(spark, sf):
    """Each stream as a room's response: a sweep is played in it and the response taken back."""
    tone = rooms.sweep(4096, 1.0, 7999.0, RATE)
    heard = voices(spark, sf).select("user_id", rooms.swept(tone)(F.col("x"))["h"].alias("h"))
    return heard.select("user_id", F.posexplode("h").alias("i", "h")).select("user_id", "i", (F.round("h", 4) + 0).alias("h"))


@query(f"with {VOICE}, k as (select unnest(range(1023)) as i) select u.user_id, cast(k.i as int) as i, round(coalesce(x, 0), 6) + 0 as h from (select distinct user_id from voice) u cross join k left join voice v on v.user_id = u.user_id and v.i = k.i")
def sequence_response(spark, sf):
    tone = rooms.maximal_sequence(10)
    heard = voices(spark, sf).select("user_id", rooms.sequence_response(10)(rooms.played(tone, circular=True)(F.col("x"))["y"])["h"].alias("h"))
    return heard.select("user_id", F.posexplode("h").alias("i", "h")).select("user_id", "i", (r6("h") + 0).alias("h"))


@query()
def band_reverberation(spark, sf):
    """Reverberation of the rooms' responses, whole and by octave band."""
    heard = rooms.room_responses(part_rooms(spark, sf), ["room_id"], 8000, 12)
    found = heard.select("room_id", rooms.reverberation(8000)(F.col("h")).alias("r"))
    return found.select("room_id", r6(F.col("r.whole")).alias("whole"), F.posexplode(F.col("r.bands")).alias("band", "rt60")).withColumn("rt60", r6("rt60"))


CHANNELS = f"""{SIG}, ch as (select user_id, event_type, x / 500 as x, row_number() over (partition by user_id, event_type order by i) - 1 as k from sig where event_type in ('view', 'click'))"""


def channels(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("x", F.col("value") / 500)
    return streams(events, ["user_id", "event_type"], ["ts", "event_id"], "x")


@query(f"""with {CHANNELS}, p as (select l.user_id, l.k - r.k as lag, sum(l.x * r.x) as s from ch l join ch r on l.user_id = r.user_id where l.event_type = 'view' and r.event_type = 'click' group by 1, 2),
e as (select user_id, sum(x * x) filter (event_type = 'view') as a, sum(x * x) filter (event_type = 'click') as b from ch group by 1)
select p.user_id, round(max(abs(s)) / sqrt(max(a) * max(b)), 6) as iacc, cast(arg_max(lag, (round(abs(s), 9), -lag)) as bigint) as lag from p join e on p.user_id = e.user_id group by 1""")
def interaural_correlation(spark, sf):
    """Views as the left ear and clicks as the right one."""
    own = channels(spark, sf)
    both = own.where("event_type = 'view'").select("user_id", F.col("x").alias("l")).join(own.where("event_type = 'click'").select("user_id", F.col("x").alias("r")), "user_id")
    found = both.select("user_id", rooms.cross_correlation("l", "r").alias("c")).where("c is not null")
    return found.select("user_id", r6(F.col("c.iacc")).alias("iacc"), "c.lag")


@query(f"""with {SIG}, e as (select user_id, event_type, sum(x * x / 250000) as e from sig group by 1, 2) select user_id, event_type, round(e, 6) as energy, round(e / max(e) over (partition by user_id), 6) as ratio from e""")
def channel_energy(spark, sf):
    found = rooms.energy_ratios(channels(spark, sf), ["user_id"], "event_type", "x")
    return found.select("user_id", "event_type", r6("energy").alias("energy"), r6("ratio").alias("ratio"))


def transform_sql(length: int, hop: int, n_fft: int, centre: bool) -> str:
    """z(user_id, frame, b, re, im): transforms of Hann-windowed frames, around every hop-th sample or of
    full frames only."""
    start = f"fs.frame * {hop}" + (f" - {length // 2}" if centre else "")
    count = f"(n + {hop - length + 2 * (length // 2)}) // {hop} + 1" if centre else f"greatest(0, (n - {length}) // {hop} + 1)"
    return f"""{VOICE}, fs as (select user_id, unnest(range(0, {count})) as frame from voice where i = 0 {"" if centre else f"and n >= {length}"}),
fw as (select v.user_id, fs.frame, v.i - ({start}) as j, v.x * (0.5 - 0.5 * cos(2 * pi() * (v.i - ({start})) / {length})) as x from voice v join fs on fs.user_id = v.user_id and v.i >= {start} and v.i < {start} + {length}),
zz as (select user_id, frame, b.range as b, sum(x * cos(2 * pi() * j * b.range / {n_fft})) as re, -sum(x * sin(2 * pi() * j * b.range / {n_fft})) as im from fw, range({n_fft // 2 + 1}) b group by 1, 2, 3),
z as (select fs.user_id, fs.frame, b.range as b, coalesce(re, 0) as re, coalesce(im, 0) as im from fs cross join range({n_fft // 2 + 1}) b left join zz on zz.user_id = fs.user_id and zz.frame = fs.frame and zz.b = b.range)"""


def mel_sql(rate: int, n_fft: int, bands: int) -> str:
    """mel(k, b, w): triangles evenly spaced on the mel scale."""
    edge = lambda k: f"(700 * (power(10, ({k}) * 2595 * log10(1 + {rate} / 1400.0::double) / {bands + 1} / 2595) - 1))"
    f = f"(b.range * {rate} / {n_fft}.0::double)"
    up, down = f"({f} - {edge('k.range')}) / ({edge('k.range + 1')} - {edge('k.range')})", f"({edge('k.range + 2')} - {f}) / ({edge('k.range + 2')} - {edge('k.range + 1')})"
    return f"mel as (select k.range as k, b.range as b, greatest(0, least({up}, {down})) as w from range({bands}) k, range({n_fft // 2 + 1}) b)"


MFCC = f"""{transform_sql(32, 8, 64, False)}, {mel_sql(RATE, 64, 20)}, e as (select user_id, frame, k, ln(sum((re * re + im * im) * w) + 1e-10) as e from z join mel using (b) group by 1, 2, 3)"""


def voice_frames(spark: SparkSession, sf: str, length: int, hop: int) -> DataFrame:
    return voices(spark, sf).select("user_id", F.posexplode(frames(F.col("x"), length, hop)).alias("frame", "x"))


@query(f"""with {MFCC} select user_id, cast(frame as int) as frame, cast(c.range as int) as k, round(sum(e * cos(pi() * c.range * (2 * k + 1) / 40)) * sqrt(case when c.range = 0 then 1 else 2 end / 20.0::double) * (1 + 11 * sin(pi() * c.range / 22)), 6) as mfcc from e, range(13) c group by 1, 2, c.range""")
def mfcc_frames(spark, sf):
    found = voice_frames(spark, sf, 32, 8).select("user_id", "frame", S.mfcc(RATE, 64, 20, 13)(F.col("x")).alias("m"))
    return found.select("user_id", "frame", F.posexplode("m").alias("k", "mfcc")).select("user_id", "frame", "k", r6("mfcc").alias("mfcc"))


@query()
def pitch_frames(spark, sf):
    return voice_frames(spark, sf, 32, 8).select("user_id", "frame", r6(F.get(S.pitch(64, 4.0, 16.0)(F.col("x")), F.lit(0))).alias("f0"))


@query()
def formant_frames(spark, sf):
    found = voice_frames(spark, sf, 32, 16).select("user_id", "frame", S.formants(RATE)(S.lpc(8)(F.col("x"))).alias("f"))
    return found.select("user_id", "frame", F.posexplode("f").alias("k", "formant")).select("user_id", "frame", "k", F.round("formant", 3).alias("formant"))


@query()
def denoised_stream(spark, sf):
    rows = S.overlap_add(S.spectral_subtraction(voice_frames(spark, sf, 16, 4), ["user_id"], 16, noise_frames=2), ["user_id"], 16, 4)
    return rows.select("user_id", F.col("i").cast("int").alias("i"), r6("x").alias("y"))
