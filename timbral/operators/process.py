"""The chain that a recording goes through, and the features that are written for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbral.functions import measures, normalization, wavelets
from timbral.operators import fingerprint
from timbral.sources import logs


def gated(signal: Column, starts: Column, ends: Column) -> Column:
    """The samples inside the spans, one after another."""
    spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.flatten(F.transform(spans, lambda s: F.slice(signal, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int"))))


def put_back(signal: Column, starts: Column, ends: Column, inside: Column) -> Column:
    """The signal with the samples inside the spans replaced by those of `inside`, in their order.
    The pieces between spans and the spans' own are laid side by side, each read once."""
    n = F.size(starts)
    lengths = F.zip_with(starts, ends, lambda a, b: b - a)
    before = F.transform(F.sequence(F.lit(0), n), lambda k: F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0).cast("long"), lambda s, v: s + v))
    piece = lambda k: F.concat(
        F.slice(signal, (F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0).cast("long")) + 1).cast("int"), (F.get(starts, k) - F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0).cast("long"))).cast("int")),
        F.slice(inside, (F.get(before, k) + 1).cast("int"), F.get(lengths, k).cast("int")),
    )
    last = F.get(ends, n - 1)
    rest = F.slice(signal, (last + 1).cast("int"), F.greatest(F.size(signal) - last.cast("int"), F.lit(0)))
    whole = F.concat(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), piece)), rest)
    return F.when(n > 0, whole).otherwise(signal)


def preprocessed(signals: DataFrame, signal: str, rate: int, least_s: float = 0.1, length: int = 1024, hop: int = 256, out: str = "processed") -> DataFrame:
    """Signals with `out`: denoised, and the samples of its phrases, taken together, normalized
    and put back; where there is no phrase, only denoised. Null and empty signals are null."""
    clean = signals.withColumn("__y", wavelets.wavelet_denoise()(F.col(signal))["y"])
    spans = measures.phrases(rate, 30.0, least_s, length, hop)(F.col("__y"))
    found = clean.withColumn("__s", spans)
    speech = normalization.normalize(rate, length, hop)(gated(F.col("__y"), F.col("__s.starts"), F.col("__s.ends")))["y"]
    found = found.withColumn("__n", speech)
    return found.withColumn(out, put_back(F.col("__y"), F.col("__s.starts"), F.col("__s.ends"), F.col("__n"))).drop("__y", "__s", "__n")


def process_batch(signals: DataFrame, key: str, signal: str, rate: int, path: str, length: int = 512, hop: int = 256) -> None:
    """All signals preprocessed and their features written as JSON, one object a signal."""
    ready = preprocessed(signals, signal, rate, length=length, hop=hop)
    rows = fingerprint.features(fingerprint.tracks(ready, [key], "processed", rate, length, hop, length), [key])
    wide = rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias("features"))
    logs.write_features(wide, path, key)
