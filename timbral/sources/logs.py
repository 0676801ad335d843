"""Logs of verifications, metrics and embeddings: tables to which runs append, and what reads them.

Each log is a folder of Parquet files, partitioned by kind and day: a run adds files and rewrites
none, and a reader of some kinds or days opens theirs only. Text outputs are written beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str, kind: Column, at: str, files: int = 1) -> None:
    """Rows with columns log_kind and log_day, appended. A run's rows of one kind and
    day go to `files` files, dealt by a hash of the row, so that a kind or day that holds most rows is
    split. Null times are of the day null."""
    named = rows.withColumn("log_kind", kind).withColumn("log_day", F.to_date(at))
    part = F.pmod(F.xxhash64(F.struct(*rows.columns)), F.lit(files))
    named.repartition("log_kind", "log_day", part).write.mode("append").partitionBy("log_kind", "log_day").parquet(path)


def read_log(spark: SparkSession, path: str, kinds: list[str] | None = None, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Rows of a log, of some kinds and days where asked for; both are left to the file listing."""
    rows = spark.read.parquet(path)
    if kinds is not None:
        rows = rows.where(F.col("log_kind").isin(kinds))
    if first_day:
        rows = rows.where(F.col("log_day") >= F.to_date(F.lit(first_day)))
    if last_day:
        rows = rows.where(F.col("log_day") <= F.to_date(F.lit(last_day)))
    return rows


def write_features(rows: DataFrame, path: str, key: str) -> None:
    """One JSON object a row, below a folder of its key's hash, so that listings stay short:
    structs, arrays and arrays of arrays as they are, null fields left out."""
    rows.withColumn("part", F.lpad(F.hex(F.pmod(F.xxhash64(key), F.lit(256))), 2, "0")).write.mode("append").partitionBy("part").json(path)


def recording_metadata(files: DataFrame, quiet: float = 1e-10) -> DataFrame:
    """Rows of read_waveforms() with what is to be known of a recording: bits, rms, peak, dc_offset
    and snr, 20 log10 of the 90th over the 10th hundredth of its samples' sizes."""
    x = F.transform("samples", lambda v: v.cast("double"))
    n = F.greatest(F.size("samples"), F.lit(1))
    sizes = F.array_sort(F.transform(x, F.abs))
    at = lambda p: F.get(sizes, F.floor(p * (F.size("samples") - 1)).cast("int"))
    total = lambda f: F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))
    snr = 20 * F.log10((at(0.9) + quiet) / (at(0.1) + quiet))
    return files.select("path", "sr", "channels", "duration_s", F.sqrt(total(lambda v: v * v) / n).alias("rms"), F.array_max(F.transform(x, F.abs)).alias("peak"), (total(lambda v: v) / n).alias("dc_offset"), snr.alias("snr"))


def environment_report(rooms: DataFrame, key: str, bands: tuple[float, ...], whole: str, rt60: str, level: str, iacc: str, delay: str) -> DataFrame:
    """(key, line_no, value), a report's lines: the reverberation time of each band to three places
    or N/A, the background's level, and what two ears hear where that is known."""
    number = lambda c, places: F.when(c.isNotNull(), F.format_string(f"%.{places}f", c))
    bars = lambda *cells: F.concat(F.lit("| "), *[p for c in cells for p in (c, F.lit(" | "))][:-1], F.lit(" |"))
    rows = [F.lit("# Acoustic environment"), F.lit(""), F.lit("| band (Hz) | RT60 (s) |"), F.lit("| --- | --- |"), bars(F.lit("all"), F.coalesce(number(F.col(whole), 3), F.lit("N/A")))]
    rows += [bars(F.lit(f"{b:g}"), F.coalesce(number(F.get(F.col(rt60), F.lit(i)), 3), F.lit("N/A"))) for i, b in enumerate(bands)]
    rows += [F.lit(""), F.concat(F.lit("- LAeq: "), F.coalesce(number(F.col(level), 1), F.lit("N/A")), F.lit(" dB(A)"))]
    rows += [F.when(F.col(iacc).isNotNull(), F.concat(F.lit("- IACC: "), number(F.col(iacc), 3))), F.when(F.col(iacc).isNotNull(), F.concat(F.lit("- time difference: "), number(F.col(delay), 2), F.lit(" ms")))]
    return rooms.select(key, F.posexplode(F.filter(F.array(*rows), lambda v: v.isNotNull())).alias("line_no", "value"))
