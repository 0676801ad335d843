"""Speaker vectors: statistics of tracks over frames, scaled and rotated by what the corpus says."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.functions import signal as S
from timbral.functions.batches import frames
from timbral.functions.pitch import Tracker, pitch_track
from timbral.functions.spectra import spectral_contrast

MFCC, FORMANTS, CONTRAST = 20, 4, 7


def _named(prefix: str, values: Column) -> Column:
    """(name, value) of an array's entries, numbered."""
    return F.transform(values, lambda v, i: F.struct(F.concat(F.lit(prefix), i.cast("string")).alias("name"), v.alias("value")))


def tracks(signals: DataFrame, keys: list[str], signal: str, rate: int, length: int, hop: int, n_fft: int, bands: int = 40, order: int = 8) -> DataFrame:
    """(keys, name, frame, value): mfcc0.., formant0.. (missing ones have no row), contrast0.., and
    centroid, bandwidth and flatness of each full frame."""
    cut = signals.select(*keys, F.posexplode(frames(F.col(signal), length, hop)).alias("frame", "x"))
    step = rate / n_fft
    cut = cut.withColumn("mag", S.magnitude_spectrum(n_fft)(F.col("x")))
    one = lambda name, value: F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))
    mag = F.col("mag")
    every = F.concat(
        _named("mfcc", S.mfcc(rate, n_fft, bands, MFCC)(F.col("x"))),
        _named("formant", S.formants(rate, FORMANTS)(S.lpc(order)(F.col("x")))),
        _named("contrast", spectral_contrast(rate, n_fft)(F.col("x"))["contrast"]),
        one("centroid", S.centroid(mag, step)),
        one("bandwidth", S.bandwidth(mag, step)),
        one("flatness", S.flatness(mag)),
    )
    return cut.select(*keys, "frame", F.explode(every).alias("t")).select(*keys, "t.name", "frame", "t.value").where("value is not null")


def pitch_rows(signals: DataFrame, keys: list[str], signal: str, tracker: Tracker) -> DataFrame:
    """(keys, name, frame, value) with the pitch of voiced frames, as f0."""
    found = signals.select(*keys, F.posexplode(pitch_track(tracker)(F.col(signal))["f0"]).alias("frame", "value"))
    return found.where("value is not null").select(*keys, F.lit("f0").alias("name"), "frame", "value")


def feature_names() -> list[str]:
    """The 150 features, in the order of a vector."""
    out = [f"mfcc{i}_{s}" for s in ("mean", "std", "velocity_mean", "velocity_std", "acceleration_mean", "acceleration_std") for i in range(MFCC)]
    out += [f"f0_{s}" for s in ("mean", "std", "min", "max", "range")]
    out += [f"formant{i}_{s}" for s in ("mean", "std", "velocity_mean") for i in range(FORMANTS)] + [f"formant{i + 1}_ratio" for i in range(FORMANTS - 1)]
    return out + ["centroid_mean", "bandwidth_mean", *[f"contrast{i}_mean" for i in range(CONTRAST)], "flatness_mean"]


def features(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, value) of tracks: means and population deviations of values and of
    their first and second steps (0 at a track's first frame), the range of f0, and mean ratios of
    neighbouring formants. Statistics are groupings; steps look at the row before."""
    by = Window.partitionBy(*keys, "name").orderBy("frame")
    moved = rows.withColumn("velocity", F.coalesce(F.col("value") - F.lag("value").over(by), F.lit(0.0)))
    moved = moved.withColumn("acceleration", F.coalesce(F.col("velocity") - F.lag("velocity").over(by), F.lit(0.0)))
    stats = {"mean": F.avg("value"), "std": F.stddev_pop("value"), "min": F.min("value"), "max": F.max("value"), "range": F.max("value") - F.min("value")}
    stats |= {f"{c}_{s}": f(c) for c in ("velocity", "acceleration") for s, f in (("mean", F.avg), ("std", F.stddev_pop))}
    found = moved.groupBy(*keys, "name").agg(*[v.alias(k) for k, v in stats.items()])
    cells = F.array(*[F.struct(F.concat("name", F.lit(f"_{k}")).alias("feature"), F.col(k).alias("value")) for k in stats])
    single = found.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.feature", "c.value")
    formants = rows.where("name like 'formant%'").select(*keys, "frame", F.substring("name", 8, 2).try_cast("int").alias("k"), "value")
    before = formants.select(*keys, "frame", (F.col("k") + 1).alias("k"), F.col("value").alias("lower"))
    ratio = formants.join(before, [*keys, "frame", "k"]).groupBy(*keys, "k").agg(F.avg(F.col("value") / (F.col("lower") + 1e-10)).alias("value"))
    return single.unionByName(ratio.select(*keys, F.concat(F.lit("formant"), F.col("k").cast("string"), F.lit("_ratio")).alias("feature"), "value"))


def vectors(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, features): one array of the 150 features, 0 where an utterance lacks one."""
    by_name = F.map_from_entries(F.collect_list(F.struct("feature", "value")))
    names = F.array(*map(F.lit, feature_names()))
    whole = found.where(F.col("feature").isin(feature_names())).groupBy(*keys).agg(by_name.alias("m"))
    return whole.select(*keys, F.transform(names, lambda n: F.coalesce(F.try_element_at("m", n), F.lit(0.0))).alias("features"))


def fit(rows: DataFrame, dimensions: int = 128) -> PipelineModel:
    """Scaling to mean 0 and deviation 1 and the principal components, fitted on all rows (an
    utterance by itself, as one vector has no deviation, could not be scaled)."""
    ready = rows.select(array_to_vector("features").alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, PCA(k=min(dimensions, len(feature_names())), inputCol="scaled", outputCol="reduced")]).fit(ready)


def reduced(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """rows with `fingerprint`, the scaled features on the model's components."""
    own = model.transform(rows.withColumn("raw", array_to_vector("features")))
    return own.withColumn("fingerprint", vector_to_array("reduced")).drop("raw", "scaled", "reduced")
