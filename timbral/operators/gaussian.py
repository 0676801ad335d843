"""Means and whole covariances by group, and what depends on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbral.functions import vectors as V


def moments(rows: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """(group, n, mean, cov) of vectors of `size` entries: cov has size x size entries by row,
    with divisor n - 1 (null for one vector). Null vectors, those of another length and those with
    null entries are left out.

    Tasks add up products about the groups' means, so that large means do not blur them: the means
    are one small table, sent to the tasks by a join; the products of a task are one row a group.
    """
    whole = F.col(vector).isNotNull() & (F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull())
    kept = rows.where(whole).select(group, V.doubles(F.col(vector)).alias("__v"))
    means = kept.groupBy(group).agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("__v")[i]) for i in range(size)]).alias("mean"))
    centred = kept.join(means.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).select(group, F.zip_with("__v", "mean", lambda v, m: v - m).alias("__v"))
    kind = rows.schema[group].dataType

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            keys, x = batch.column(0).to_pylist(), np.asarray(batch.column(1).flatten()).reshape(-1, size)
            for key in set(keys):
                own = x[[k == key for k in keys]]
                found[key] = found.get(key, 0) + own.T @ own
        for key, cross in found.items():
            yield pa.RecordBatch.from_pylist([{"g": key, "cross": cross.ravel()}], schema=pa.schema([batch.schema.field(0).with_name("g"), ("cross", pa.list_(pa.float64()))]))

    parts = centred.mapInArrow(products, T.StructType([T.StructField("g", kind), T.StructField("cross", T.ArrayType(T.DoubleType()))]))
    cells = parts.select("g", F.posexplode("cross").alias("at", "s")).groupBy("g", "at").agg(F.sum("s").alias("s"))
    crosses = cells.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda c: c["s"]).alias("cross"))
    joined = means.join(crosses, F.col(group).eqNullSafe(F.col("g")))
    return joined.select(group, "n", "mean", F.when(F.col("n") > 1, F.transform("cross", lambda s: s / (F.col("n") - 1))).alias("cov"))


def merged(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Moments of both together: means by their counts, and covariances pooled with what lies
    between the means; a group in one of them only stays as it is. A group of one vector has a
    null covariance, which counts as zeros."""
    names = ["n", "mean", "cov"]
    both = old.select(group, *[F.col(c).alias(f"a_{c}") for c in names]).join(new.select(group, *[F.col(c).alias(f"b_{c}") for c in names]), group, "full")
    n = F.col("a_n") + F.col("b_n")
    mean = F.zip_with("a_mean", "b_mean", lambda a, b: (a * F.col("a_n") + b * F.col("b_n")) / n)
    gap = F.zip_with("b_mean", "a_mean", lambda b, a: b - a)
    outer = V.let(gap, lambda g: F.flatten(F.transform(g, lambda x: F.transform(g, lambda y: x * y))))
    zeros = lambda c: F.coalesce(c, F.transform(outer, lambda _: F.lit(0.0)))
    inside = F.zip_with(zeros(F.col("a_cov")), zeros(F.col("b_cov")), lambda a, b: a * (F.col("a_n") - 1) + b * (F.col("b_n") - 1))
    cov = F.zip_with(inside, outer, lambda s, o: (s + o * F.col("a_n") * F.col("b_n") / n) / (n - 1))
    alone = F.col("a_n").isNull() | F.col("b_n").isNull()
    pick = lambda c, whole: F.when(alone, F.coalesce(f"a_{c}", f"b_{c}")).otherwise(whole).alias(c)
    return both.select(group, pick("n", n), pick("mean", mean), pick("cov", cov))


def inverses(stats: DataFrame, size: int) -> DataFrame:
    """stats with `inverse` (by row) and `log_det` of each covariance: of its diagonal, raised by 1e-10,
    where it is null or singular, whose inverse `whole` is then false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for flat in batch.column("cov").to_pylist():
                cov = np.array(flat or [0.0] * size * size).reshape(size, size)
                sign, log_det = np.linalg.slogdet(cov)
                whole = bool(sign > 0 and np.linalg.cond(cov) < 1e12)
                if not whole:
                    cov = np.diag(np.diag(cov) + 1e-10)
                    log_det = np.log(np.diag(cov)).sum()
                rows.append((np.linalg.inv(cov).ravel(), float(log_det), whole))
            added = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.list_(pa.float64()), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "inverse", "log_det", "whole"])

    fields = [T.StructField("inverse", T.ArrayType(T.DoubleType())), T.StructField("log_det", T.DoubleType()), T.StructField("whole", T.BooleanType())]
    return stats.mapInArrow(run, T.StructType([*stats.schema.fields, *fields]))


def quadratic(difference: Column, inverse: Column, size: int) -> Column:
    """d' M d, for M by row."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: V.dot(F.slice(inverse, i * size + 1, size), difference))
    return V.dot(rows, difference)


def against_groups(rows: DataFrame, stats: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """Rows with `distance` (Mahalanobis) and `log_pdf` (normal) of each vector in its own
    group. The groups' inverses are joined by group, which Spark sends to all tasks when small."""
    known = inverses(stats, size).select(F.col(group).alias("__g"), "mean", "inverse", "log_det")
    both = rows.join(known, rows[group].eqNullSafe(F.col("__g")))
    square = V.let(F.zip_with(V.doubles(F.col(vector)), "mean", lambda x, m: x - m), lambda d: quadratic(d, F.col("inverse"), size))
    both = both.withColumn("__q", square).withColumn("distance", F.sqrt(F.greatest("__q", F.lit(0.0))))
    pdf = -0.5 * (F.col("__q") + F.col("log_det") + size * float(np.log(2 * np.pi)))
    return both.withColumn("log_pdf", pdf).drop("__g", "mean", "inverse", "log_det", "__q")
