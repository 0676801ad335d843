"""Frames, smoothing, segments and runs over ordered samples or frames of an utterance.

Inputs are long tables (keys, i, value) with i = 0, 1, ... per key. Windows partition by key;
an utterance is at most some minutes of frames, so its rows fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.functions.batches import frames, streams


def _by(keys: list[str], order: str = "i") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def framed(samples: DataFrame, keys: list[str], value: str, length: int, hop: int) -> DataFrame:
    """(keys, frame, x) of full overlapping frames, x the frame's samples in order. Samples are
    shuffled once, to their utterance; frames are sliced inside its row."""
    whole = streams(samples, keys, ["i"], value)
    return whole.select(*keys, F.posexplode(frames(F.col("x"), length, hop)).alias("frame", "x"))


def frame_levels(samples: DataFrame, keys: list[str], value: str, length: int = 512, hop: int = 256) -> DataFrame:
    """(keys, frame, rms, energy) of full frames."""
    energy = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    rows = framed(samples, keys, value, length, hop).select(*keys, "frame", energy.alias("energy"))
    return rows.select(*keys, "frame", F.sqrt(F.col("energy") / length).alias("rms"), "energy")


def envelope(rows: DataFrame, keys: list[str], value: str, taps: int = 5) -> DataFrame:
    """Centred moving sum divided by `taps` also at the edges."""
    half = taps // 2
    near = _by(keys).rowsBetween(-half, half)
    return rows.withColumn("smooth", F.sum(value).over(near) / float(taps))


def cmvn(rows: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """(value - mean) / (population deviation + 1e-10) over rows [i - w/2, i + w/2)."""
    near = _by(keys).rowsBetween(-(width // 2), width // 2 - 1)
    return rows.withColumn("norm", (F.col(value) - F.avg(value).over(near)) / (F.stddev_pop(value).over(near) + 1e-10))


def deltas(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Velocity and acceleration, 0 at the first row."""
    rows = rows.withColumn("velocity", F.coalesce(F.col(value) - F.lag(value).over(_by(keys)), F.lit(0.0)))
    return rows.withColumn("acceleration", F.coalesce(F.col("velocity") - F.lag("velocity").over(_by(keys)), F.lit(0.0)))


def zero_crossings(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, rate): share of steps at which the sign changes; 0 counts as positive."""
    up = (F.col(value) >= 0).cast("int")
    rows = rows.withColumn("up", up).withColumn("was", F.lag("up").over(_by(keys)))
    return rows.groupBy(*keys).agg(F.avg((F.col("up") != F.col("was")).cast("double")).alias("rate"))


def jitter_shimmer(rows: DataFrame, keys: list[str], f0: str, amplitude: str, voiced: Column) -> DataFrame:
    """Mean absolute step over the mean, of f0 and of amplitude, over voiced rows."""
    rows = rows.where(voiced)
    step = lambda c: F.abs(F.col(c) - F.lag(c).over(_by(keys)))
    rows = rows.withColumns({"df": step(f0), "da": step(amplitude)})
    return rows.groupBy(*keys).agg(F.try_divide(F.avg("df"), F.avg(f0)).alias("jitter"), F.try_divide(F.avg("da"), F.avg(amplitude)).alias("shimmer"))


def local_range(rows: DataFrame, keys: list[str], value: str, voiced: Column, width: int = 5) -> DataFrame:
    """(keys, start, range) of windows whose frames are all voiced, but the last window."""
    n = F.count("*").over(Window.partitionBy(*keys))
    near = _by(keys).rowsBetween(0, width - 1)
    rows = rows.withColumn("voiced", voiced).withColumn("n", n)
    rows = rows.withColumns({"range": F.max(value).over(near) - F.min(value).over(near), "all_voiced": F.min(F.col("voiced").cast("int")).over(near)})
    return rows.where((F.col("i") < F.col("n") - width) & (F.col("all_voiced") == 1)).select(*keys, F.col("i").alias("start"), "range")


def otsu_threshold(frames: DataFrame, keys: list[str], energy: str, bins: int = 100) -> DataFrame:
    """(keys, threshold): the bin centre of energy / maximum with the greatest variance
    between classes; the lowest of equals."""
    top = F.max(energy).over(Window.partitionBy(*keys))
    share = F.try_divide(F.col(energy), top)
    bin_ = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    hist = frames.select(*keys, bin_.alias("bin")).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    centre = (F.col("bin") + 0.5) / float(bins)
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.withColumn("m", F.col("c") * centre).withColumns({"c1": F.sum("c").over(upto), "m1": F.sum("m").over(upto), "n": F.sum("c").over(whole), "mt": F.sum("m").over(whole)})
    c = F.col
    gap = c("m1") / c("c1") - F.coalesce(F.try_divide(c("mt") - c("m1"), c("n") - c("c1")), F.lit(0.0))
    between = (c("c1") / c("n")) * (1 - c("c1") / c("n")) * gap * gap
    best = F.max(F.struct(F.round(between, 12).alias("v"), (-F.col("bin")).alias("b"))).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, ((0.5 - c("best.b")) / float(bins)).alias("threshold"))


def energy_vad(frames: DataFrame, keys: list[str], energy: str, sensitivity: float = 0.5) -> DataFrame:
    """Frames with speech: energy / maximum above the Otsu threshold times sensitivity."""
    thresholds = otsu_threshold(frames, keys, energy)
    share = F.try_divide(F.col(energy), F.max(energy).over(Window.partitionBy(*keys)))
    return frames.withColumn("share", share).join(thresholds, keys).withColumn("speech", F.coalesce(F.col("share") > F.col("threshold") * sensitivity, F.lit(False)))


def smooth_decisions(rows: DataFrame, keys: list[str], flag: str, context: int = 5) -> DataFrame:
    """Two passes over the decisions, each taken from what stood before the pass: set where
    at least half of the next `context` frames are set, then of the previous ones."""
    n = F.count("*").over(Window.partitionBy(*keys))
    ahead = _by(keys).rowsBetween(0, context - 1)
    behind = _by(keys).rowsBetween(-context, -1)
    count = lambda c, w: F.sum(F.col(c).cast("int")).over(w)
    rows = rows.withColumn("n", n)
    rows = rows.withColumn("forward", F.col(flag) | ((F.col("i") < F.col("n") - context) & (count(flag, ahead) >= context // 2)))
    return rows.withColumn("smooth", F.col("forward") | ((F.col("i") > context) & (count("forward", behind) >= context // 2))).drop("n", "forward")


def segments(rows: DataFrame, keys: list[str], flag: str, least: int) -> DataFrame:
    """(keys, start, end) of runs of set rows, of `least` rows or more; end exclusive."""
    island = F.col("i") - F.row_number().over(_by(keys))
    runs = rows.where(F.col(flag)).withColumn("island", island).groupBy(*keys, "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))
    return runs.where(F.col("end") - F.col("start") >= least).drop("island")


def decay_runs(rows: DataFrame, keys: list[str], level_db: str, seconds_per_row: float, least: int = 5, fallback: float = 0.3) -> DataFrame:
    """(keys, rt60): median of 60 / rate over strictly falling runs of more than `least`
    steps with 0.1 < rt60 < 2; the fallback without any. Runs open before the last 10 rows."""
    rows = rows.withColumns({"n": F.count("*").over(Window.partitionBy(*keys)), "falls": F.col(level_db) < F.lag(level_db).over(_by(keys))})
    rows = rows.withColumn("run", F.sum((~F.coalesce("falls", F.lit(False))).cast("int")).over(_by(keys)))
    runs = rows.groupBy(*keys, "run").agg(F.min("i").alias("start"), (F.count("*") - 1).alias("steps"), (F.max(level_db) - F.min(level_db)).alias("drop"), F.max("n").alias("n"))
    rt60 = 60.0 / F.try_divide(F.col("drop"), F.col("steps") * seconds_per_row)
    runs = runs.where((F.col("steps") > least) & (F.col("start") < F.col("n") - 10)).withColumn("rt60", rt60).where("rt60 > 0.1 and rt60 < 2.0")
    found = runs.groupBy(*keys).agg(F.median("rt60").alias("rt60"))
    return rows.select(*keys).distinct().join(found, keys, "left").withColumn("rt60", F.coalesce("rt60", F.lit(fallback)))


def local_maxima(rows: DataFrame, keys: list[str], value: str, height: float) -> DataFrame:
    """W07 without a distance: rows above both neighbours and of `height` at least."""
    w = _by(keys)
    return rows.withColumns({"l": F.lag(value).over(w), "r": F.lead(value).over(w)}).where((F.col(value) > F.col("l")) & (F.col(value) > F.col("r")) & (F.col(value) >= height)).drop("l", "r")


def audio_quality(samples: DataFrame, keys: list[str], value: str, sample_rate: int, thresholds: dict[str, float] | None = None) -> DataFrame:
    """The seven checks of a recording, their mean as overall_quality, and pass."""
    t = {"min_duration": 0.5, "max_duration": 30.0, "min_rate": 16000, "min_rms": 0.01, "max_clipping": 0.01, "max_dc": 0.1, "min_snr": 15.0, "min_speech": 0.3} | (thresholds or {})
    length, hop = max(1, int(0.025 * sample_rate)), max(1, int(0.01 * sample_rate))
    frames = frame_levels(samples, keys, value, length, hop)
    top = F.max("energy").over(Window.partitionBy(*keys))
    speech = frames.withColumn("top", top).groupBy(*keys).agg(F.avg((F.col("energy") > 0.1 * F.col("top")).cast("double")).alias("speech_ratio"))
    v = F.col(value)
    p = F.percentile(F.abs(v), F.array(F.lit(0.1), F.lit(0.9)))
    stats = samples.groupBy(*keys).agg(
        (F.count("*") / float(sample_rate)).alias("duration"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg((F.abs(v) > 0.99).cast("double")).alias("clipping_ratio"),
        F.avg(v).alias("dc_offset"), p.alias("p"),
    )
    stats = stats.withColumn("estimated_snr", 20 * F.log10(F.col("p")[1] / (F.col("p")[0] + 1e-10))).drop("p").join(speech, keys, "left")
    c = F.col
    checks = {
        "duration_check": (c("duration") >= t["min_duration"]) & (c("duration") <= t["max_duration"]), "sample_rate_check": F.lit(sample_rate >= t["min_rate"]),
        "rms_check": c("rms") >= t["min_rms"], "clipping_check": c("clipping_ratio") <= t["max_clipping"], "dc_offset_check": F.abs(c("dc_offset")) <= t["max_dc"],
        "snr_check": F.coalesce(c("estimated_snr") >= t["min_snr"], F.lit(False)), "speech_ratio_check": F.coalesce(c("speech_ratio") >= t["min_speech"], F.lit(False)),
    }
    stats = stats.withColumns(checks)
    passed = sum((c(k).cast("int") for k in checks), F.lit(0))
    return stats.withColumn("overall_quality", passed / 7.0).withColumn("pass", passed == 7)
