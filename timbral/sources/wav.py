"""Waveform files as tables: a Python data source, a catalog scan and versioned profiles."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UTTERANCE = "path string, sr int, channels int, n_samples long, duration_s double, samples array<float>"
SIDECAR = "path string, participant_id string, quality_score double, has_transcript boolean"


def decode_wav(data: bytes, mono: bool = True) -> tuple[int, int, np.ndarray] | None:
    """(rate, channels, samples from -1 to 1) of PCM data of 8, 16, 24 or 32 bits; None if it
    is no such file."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            rate, channels, width, raw = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return None
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
    x = x.reshape(-1, channels)
    return rate, channels, x.mean(axis=1) if mono else x[:, 0]


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono PCM."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def read_waveforms(spark: SparkSession, path: str, target_sr: int | None = None, recursive: bool = False) -> DataFrame:
    """One row per decodable .wav file under path, resampled by linear interpolation
    where a target rate is given and differs. Files that cannot be decoded are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data in zip(part["path"], part["content"], strict=True):
                if (found := decode_wav(bytes(data))) is None:
                    continue
                rate, channels, x = found
                if target_sr and target_sr != rate and len(x):
                    n = int(round(len(x) * target_sr / rate))
                    rate, x = target_sr, np.interp(np.arange(n) * rate / target_sr, np.arange(len(x)), x).astype(np.float32)
                rows.append((path, rate, channels, len(x), len(x) / rate, x))
            yield pd.DataFrame(rows, columns=["path", "sr", "channels", "n_samples", "duration_s", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "content").mapInPandas(run, UTTERANCE)


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Every waveform below path with its sidecar's fields (<stem>.metadata.json); without
    one the participant is unknown, quality 0 and transcript false."""
    sound = read_waveforms(spark, path, recursive=True).drop("samples")
    stem = lambda c, end: F.regexp_replace(F.regexp_replace(c, r"^file:/+", "/"), end, "")
    side = spark.read.schema("participant_id string, quality_score double, has_transcript boolean").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.metadata.json").option("multiLine", "true").json(path)
    side = side.select("*", stem(F.input_file_name(), r"\.metadata\.json$").alias("stem"))
    joined = sound.withColumn("stem", stem(F.col("path"), r"\.[^./]*$")).join(side, "stem", "left")
    return joined.select(
        F.regexp_extract("path", r"[^/]*$", 0).alias("file_name"), F.col("path").alias("file_path"), F.col("duration_s").alias("duration"), F.col("sr").alias("sample_rate"), "channels",
        F.coalesce("participant_id", F.lit("unknown")).alias("participant_id"), F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"), F.coalesce("has_transcript", F.lit(False)).alias("has_transcript"),
    )


def append_profiles(profiles: DataFrame, path: str) -> None:
    """Versions of profiles, appended by speaker; nothing is ever pickled."""
    profiles.write.mode("append").partitionBy("speaker_id").parquet(path)


def latest_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Each speaker's newest version, by exact speaker id."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in ("speaker_id", "created_at")]
    return rows.groupBy("speaker_id").agg(F.max(F.struct("created_at", *rest)).alias("v")).select("speaker_id", "v.*")


def quality_report(checks: DataFrame, key: str) -> DataFrame:
    """One text line per check of audio_quality() rows: key: check PASS or FAIL."""
    names = [c for c in checks.columns if c.endswith("_check")]
    each = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("ok")) for n in names])
    rows = checks.select(key, F.explode(each).alias("c"))
    return rows.select(F.concat_ws(" ", F.concat(F.col(key).cast("string"), F.lit(":")), "c.check", F.when(F.col("c.ok"), "PASS").otherwise("FAIL")).alias("value"))
