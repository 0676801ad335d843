"""Speakers on disk: enrolled, verified against and updated, as versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.functions import vectors as V
from timbral.operators import gaussian


def enrol(vectors: DataFrame, speaker: str, vector: str, size: int, path: str, at: Column) -> None:
    """One version of each speaker's profile (speaker_id, n, mean, cov, created_at), appended to the
    table at `path`. Vectors that moments() leaves out are left out here."""
    stats = gaussian.moments(vectors, speaker, vector, size)
    stats.select(F.col(speaker).alias("speaker_id"), "n", "mean", "cov", at.alias("created_at")).write.mode("append").parquet(path)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Each speaker's newest version; of versions of one time the one of most vectors."""
    rows = spark.read.parquet(path)
    newest = F.max(F.struct("created_at", "n", "mean", "cov")).alias("v")
    return rows.groupBy("speaker_id").agg(newest).select("speaker_id", "v.n", "v.mean", "v.cov", "v.created_at")


def update(vectors: DataFrame, speaker: str, vector: str, size: int, path: str, at: Column) -> None:
    """A new version of each speaker that has new vectors, merged with the one there; speakers
    that are new get their first. Old versions stay."""
    spark = vectors.sparkSession
    new = gaussian.moments(vectors, speaker, vector, size).withColumnRenamed(speaker, "speaker_id")
    old = profiles(spark, path).select("speaker_id", "n", "mean", "cov").join(new.select("speaker_id"), "speaker_id", "left_semi")
    merged = gaussian.merged(old, new, "speaker_id")
    merged.select("speaker_id", "n", "mean", "cov", at.alias("created_at")).write.mode("append").parquet(path)


def verify(attempts: DataFrame, speaker: str, vector: str, path: str, threshold: float = 0.7) -> DataFrame:
    """Attempts with similarity (cosine from 0 to 1 with the claimed speaker's mean) and accepted;
    a speaker without a profile has a null similarity and is not accepted."""
    known = profiles(attempts.sparkSession, path).select(F.col("speaker_id").alias("__s"), "mean")
    both = attempts.join(known, attempts[speaker] == F.col("__s"), "left")
    similarity = V.scaled_cosine(V.doubles(F.col(vector)), F.col("mean"))
    both = both.withColumn("similarity", similarity)
    return both.withColumn("accepted", F.coalesce(F.col("similarity") >= threshold, F.lit(False))).drop("__s", "mean")
