"""Liveness and naturalness scores over tracks, spectra and peaks; losses over similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.functions import vectors as V


def _by(keys: list[str], order: str = "i") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def continuity(track: DataFrame, keys: list[str], value: str, cap: float) -> DataFrame:
    """(keys, continuity, transition, stability): the mean of 1 - min(1, |step| / cap),
    the mean step and the share of steps under 50."""
    step = F.abs(F.col(value) - F.lag(value).over(_by(keys)))
    rows = track.withColumn("step", step)
    return rows.groupBy(*keys).agg(
        F.avg(1 - F.least(F.lit(1.0), F.col("step") / cap)).alias("continuity"), F.avg("step").alias("transition"), F.avg((F.col("step") < 50).cast("double")).alias("stability"),
    )


def noise_floor_stability(frames: DataFrame, keys: list[str], floor: str) -> DataFrame:
    """1 / (1 + cv) of the frames' least magnitudes, cv the population deviation over the mean."""
    return frames.groupBy(*keys).agg((1 / (1 + F.try_divide(F.stddev_pop(floor), F.avg(floor)))).alias("stability"))


def pitch_stability(track: DataFrame, keys: list[str], f0: str) -> DataFrame:
    """1 / (1 + deviation / mean) of voiced pitch; 0 for two values or fewer."""
    voiced = track.where(F.col(f0) > 0)
    ratio = 1 / (1 + F.try_divide(F.stddev_pop(f0), F.avg(f0)))
    return voiced.groupBy(*keys).agg(F.when(F.count(f0) > 2, ratio).otherwise(0.0).alias("stability"))


def pitch_status(f0: Column, speech: Column) -> Column:
    """Low below 75 Hz, high above 400 Hz, else normal; without f0 by the speech flag."""
    return F.when(f0 < 75, "low").when(f0 > 400, "high").when(f0.isNotNull(), "normal").when(speech, "speech").otherwise("silence")


def rhythm(onsets: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, n_peaks, npvi, varco): normalized pairwise variability (percent) and
    coefficient of variation (percent) of the intervals between onsets; 0 where undefined."""
    gap = F.col(at) - F.lag(at).over(_by(keys, at))
    rows = onsets.withColumn("gap", gap)
    rows = rows.withColumn("was", F.lag("gap").over(_by(keys, at)))
    pair = F.try_divide(F.abs(F.col("gap") - F.col("was")), (F.col("gap") + F.col("was")) / 2)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_peaks"), F.coalesce(100 * F.avg(pair), F.lit(0.0)).alias("npvi"),
        F.coalesce(100 * F.try_divide(F.stddev_pop("gap"), F.avg("gap")), F.lit(0.0)).alias("varco"),
    )


def phase_coherence(cells: DataFrame, frame_keys: list[str], bin_col: str, phase: str) -> DataFrame:
    """(frame keys without the frame, coherence): steps of phase wrapped to -pi to pi, their
    population deviation per bin, 1 / (1 + mean)."""
    step = F.col(phase) - F.lag(phase).over(_by([*frame_keys, bin_col]))
    rows = cells.withColumn("step", F.atan2(F.sin(step), F.cos(step)))
    bins = rows.groupBy(*frame_keys, bin_col).agg(F.stddev_pop("step").alias("sd"))
    return bins.groupBy(*frame_keys).agg((1 / (1 + F.avg("sd"))).alias("coherence"))


def band_means(cells: DataFrame, keys: list[str], bin_col: str, value: str, bands: list[tuple[str, float, float]]) -> DataFrame:
    """(keys, band, energy): mean value of the bins of each band, both ends inclusive; 0 for
    an empty band. Bands are few, so they ride along as columns."""
    means = [F.struct(F.lit(n).alias("band"), F.coalesce(F.avg(F.when(F.col(bin_col).between(lo, hi), F.col(value))), F.lit(0.0)).alias("energy")) for n, lo, hi in bands]
    wide = cells.groupBy(*keys).agg(*[m.alias(f"m{k}") for k, m in enumerate(means)])
    return wide.select(*keys, F.explode(F.array(*[F.col(f"m{k}") for k in range(len(bands))])).alias("b")).select(*keys, "b.*")


#: Bands in Hz that replays change, and which of them are held against each other.
REPLAY_BANDS = [("band_0", 20, 150), ("band_1", 150, 300), ("band_2", 300, 500), ("band_3", 500, 2000), ("band_4", 2000, 5000), ("band_5", 5000, 10000), ("band_6", 10000, 20000)]
REPLAY_RATIOS = {"high_ultrahigh": ("band_5", "band_6"), "mid_subbass": ("band_3", "band_0")}


def band_ratios(energies: DataFrame, keys: list[str], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """(keys, ratios) of band_means() rows: one band's energy over another's, 0 where that is 0."""
    own = lambda name: F.max(F.when(F.col("band") == name, F.col("energy")))
    parts = [F.coalesce(F.try_divide(own(a), F.nullif(own(b), F.lit(0.0))), F.lit(0.0)).alias(name) for name, (a, b) in ratios.items()]
    return energies.groupBy(*keys).agg(*parts)


def cutoff_score(cells: DataFrame, keys: list[str], bin_col: str, value: str, above: float, width: float) -> DataFrame:
    """1 less 0.2 f / width for each drop of over 30 % between neighbouring bins from `above`
    on, between 0 and 1; 1 for no such bins."""
    was = F.lag(value).over(_by(keys, bin_col))
    drop = (F.col(bin_col) >= above) & (F.col(value) < 0.7 * F.col("was"))
    rows = cells.withColumn("was", was)
    loss = F.sum(F.when(drop, 0.2 * F.col(bin_col) / width).otherwise(0.0))
    return rows.groupBy(*keys).agg(V.clamp(1 - loss).alias("score"))


def prototypical_loss(similarities: DataFrame, keys: list[str], genuine: Column, margin: float = 0.2, temperature: float = 0.1) -> DataFrame:
    """(keys, loss): cross-entropy of an attempt's logits over all candidates, the margin
    taken off its own speaker's similarity."""
    logit = (F.col("similarity") - F.when(genuine, margin).otherwise(0.0)) / temperature
    rows = similarities.withColumns({"logit": logit, "own": F.when(genuine, logit)})
    return rows.groupBy(*keys).agg((F.log(F.sum(F.exp("logit"))) - F.max("own")).alias("loss"))


def proximal_term(updates: DataFrame, reference: DataFrame, place: list[str], client: str, value: str, mu: float = 0.01) -> DataFrame:
    """(client, term): mu / 2 of the squared distance to the global value per place."""
    gap = F.col(value) - F.col("mean")
    return updates.join(reference, place).groupBy(client).agg((mu / 2 * F.sum(gap * gap)).alias("term"))


def bit_depth(x: Column, bits: int) -> Column:
    """Samples from -1 to 1 on a grid of 2^bits steps, half to even; from 24 bits as is."""
    steps = float(2**bits - 1)
    return x if bits >= 24 else F.rint(x * steps / 2) * 2 / steps


def pick_device(devices: DataFrame, channels: int, rate: int, order: str = "index") -> DataFrame:
    """The first device with channels and rate enough; else the first of all."""
    fits = (F.col("max_channels") >= channels) & (F.col("sample_rate") >= rate)
    return devices.orderBy(F.desc(fits), order).limit(1)


def spectral_deviation(cells: DataFrame, group: str, frame: str, bin_col: str, value: str) -> DataFrame:
    """(group, deviation): mean over frames of 1 - max(0, correlation with the group's mean
    spectrum)."""
    mean = cells.groupBy(group, bin_col).agg(F.avg(value).alias("mean"))
    corr = cells.join(mean, [group, bin_col]).groupBy(group, frame).agg(F.corr("mean", value).alias("r"))
    return corr.groupBy(group).agg(F.avg(1 - F.greatest(F.lit(0.0), F.col("r"))).alias("deviation"))


def background_noise(cells: DataFrame, group: str, frame: str, bin_col: str, value: str) -> DataFrame:
    """(group, level, slope, consistency): mean and slope over the bins (from 0 to 1) of each
    bin's 10th percentile over time; 1 less the frame minima's deviation over their mean."""
    floor = cells.groupBy(group, bin_col).agg(F.percentile(value, F.lit(0.1)).alias("p"))
    whole = Window.partitionBy(group)
    shaped = floor.withColumn("at", F.col(bin_col) / (F.max(bin_col).over(whole) + 1))
    bins = shaped.groupBy(group).agg(F.avg("p").alias("level"), F.regr_slope("p", "at").alias("slope"))
    lows = cells.groupBy(group, frame).agg(F.min(value).alias("low")).groupBy(group)
    steady = lows.agg((1 - F.try_divide(F.stddev_pop("low"), F.abs(F.avg("low")))).alias("consistency"))
    return bins.join(steady, group)


def track_statistics(track: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation and median of a track, and of its steps; nulls are gaps."""
    rows = track.withColumn("step", F.col(value) - F.lag(value).over(_by(keys)))
    return rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.median(value).alias("median"), F.avg("step").alias("step_mean"), F.stddev_pop("step").alias("step_std"),
    )


def median_smooth(track: DataFrame, keys: list[str], value: str, width: int = 5) -> DataFrame:
    """The median of `width` centred rows, with zeros beyond the ends."""
    half = width // 2
    near = F.collect_list(F.coalesce(value, F.lit(0.0))).over(_by(keys).rowsBetween(-half, half))
    padded = F.concat(near, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(near)))
    return track.withColumn("smooth", F.get(F.array_sort(padded), F.lit(half)))


def attention_fusion(scores: list[Column], logits: list[Column]) -> Column:
    """Scores weighted by the softmax of their logits."""
    return V.let(V.softmax(F.array(*logits)), lambda w: V.dot(w, F.array(*scores)))


def speech_bounds(frames: DataFrame, keys: list[str], rms: str, top_db: float = 20.0) -> DataFrame:
    """(keys, first, last) frames within top_db of the loudest."""
    peak = F.max(rms).over(Window.partitionBy(*keys))
    loud = frames.withColumn("peak", peak).where(F.col(rms) > F.col("peak") * 10 ** (-top_db / 20))
    return loud.groupBy(*keys).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
