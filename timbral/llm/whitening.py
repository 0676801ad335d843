"""Embedding whitening: principal components of fixed-point vectors by a distributed SVD.

Vectors become whole numbers, so that counts, sums and squared deviations are exact; only the
components themselves, and what is projected on them, are floating-point.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbral.llm.shared import free_name, settle

#: Steps of a whole number in 1.
SCALE = 256
WIDE = "decimal(38, 0)"
#: The SVD works on the matrix of inner products, whose rounding hides singular values below this
#: share of the largest one.
LEAST = 1e-7
#: What whiten() adds.
ADDED = {"component": "int", "n": "bigint", "deviation": WIDE, "whitened": "double", "explained": "double", "identity_error": "double"}


def fixed_point(rows: DataFrame, vector_col: str, out_col: str, scale: int = SCALE) -> DataFrame:
    """rows with out_col, each entry as floor(scale * entry); rows whose vector is null or holds
    null or non-finite entries go."""
    entry = lambda c: c.cast("double")
    bad = lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) == float("inf"))
    whole = rows.where(F.col(vector_col).isNotNull() & ~F.exists(vector_col, bad))
    return whole.withColumn(out_col, F.transform(vector_col, lambda c: F.floor(entry(c) * scale).cast("long")))


def _exact(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n x - S)^2 of each row, as n^2 x.x - 2 n x.S + S.S, where both dot
    products are sums of whole numbers: of 64 bits where they fit, else of any size."""
    top = int(np.abs(x).max(initial=0))
    fits = x.shape[1] * max(top, 1) * max(top, *map(abs, sums), 1) < 1 << 62
    wide = x if fits else x.astype(object)
    own, crossed = (wide * wide).sum(axis=1).tolist(), (wide @ np.array(sums, np.int64 if fits else object)).tolist()
    rest = sum(v * v for v in sums)
    return [n * n * a - 2 * n * b + rest for a, b in zip(own, crossed, strict=True)]


def projected(rows: DataFrame, x_col: str, n: int, sums: list[int], weights: np.ndarray, deviation: str, white: str) -> DataFrame:
    """rows with `deviation` and `white`, each vector less S / n times `weights` (entries x components),
    in place of x_col."""
    at = rows.columns.index(x_col)
    kept = [f for f in rows.schema.fields if f.name != x_col]
    means = np.array(sums, float) / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(at).flatten()).reshape(-1, len(sums))
            entries = ((x - means) @ weights).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * weights.shape[1], pa.int32()), pa.array(entries))
            added = [pa.array([Decimal(v) for v in _exact(x, n, sums)], pa.decimal128(38, 0)), lists]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, *added], [*[f.name for f in kept], deviation, white])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(deviation, T.DecimalType(38, 0)), T.StructField(white, T.ArrayType(T.DoubleType()))]))


def principal_components(fit: DataFrame, x_col: str, n: int, sums: list[int]) -> list[tuple[float, list[float]]]:
    """(eigenvalue of the covariance with divisor n, unit eigenvector), by falling eigenvalue, of
    the rows of whole numbers in x_col, by an SVD of the centred rows. All singular values are
    asked for, which makes the SVD a full one; those under LEAST of the largest are left out."""
    means = F.array(*[F.lit(s / n) for s in sums])
    centred = fit.select(array_to_vector(F.zip_with(x_col, means, lambda a, m: a - m)).alias("v"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, len(sums)).computeSVD(len(sums), rCond=LEAST)
    columns = svd.V.toArray().T
    return [(float(s) ** 2 / n, c.tolist()) for s, c in zip(svd.s.toArray(), columns, strict=True) if s > 0]


def whiten(rows: DataFrame, vector_col: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """rows whose vectors are whole, once for each of the first `components` principal components.

    Vectors are first made whole numbers x = floor(scale * entry). The fit list is each distinct x
    once: n vectors with sums S in each dimension; repeated vectors do not weigh more. Added are
    component (1 is that of the largest eigenvalue), n, deviation (decimal: the sum over dimensions
    of (n x - S)^2, exact), whitened (x - S/n projected on the unit component, over the root of its
    eigenvalue), explained (eigenvalue over the total variance, which comes from exact deviations)
    and identity_error (largest absolute entry of the whitened fit list's covariance minus the
    identity; one value).

    Rows with a null vector, or null or non-finite entries, go. Components without variance (of
    equal vectors, or beyond the rank) give no rows, so an empty table, or one of equal vectors,
    gives none. Vectors of unlike length raise ValueError. Repeated rows repeat; other columns stay;
    names that are taken get underscores.

    What reaches the driver is one number a dimension, and one component's entries.
    """
    names = []
    for wish in ADDED:
        names.append(free_name([*rows.columns, *names], wish))
    x = free_name([*rows.columns, *names], "x")
    found = settle(fixed_point(rows, vector_col, x, scale), "whole-vectors")
    fit = settle(found.select(x).distinct(), "fit-list")
    shape = fit.agg(F.count("*").alias("n"), F.min(F.size(x)).alias("least"), F.max(F.size(x)).alias("most")).first()
    n, size = shape["n"], shape["most"] or 0
    none = found.where("false").select(*rows.columns, *[F.lit(None).cast(t).alias(name) for name, t in zip(names, ADDED.values(), strict=True)])
    if not n or not size:
        return none
    if shape["least"] != size:
        raise ValueError(f"vectors of {shape['least']} and of {size} entries")
    sums = [int(v) for v in fit.agg(*[F.sum(F.col(x)[i].cast(WIDE)).alias(f"s{i}") for i in range(size)]).first()]
    nothing = np.zeros((size, 0))
    exact = int(projected(fit, x, n, sums, nothing, "d", "w").agg(F.sum("d").alias("d")).first()["d"])
    if not exact:
        return none
    first = principal_components(fit, x, n, sums)[:components]
    weights = np.array([vector for _, vector in first]).T / np.sqrt([e for e, _ in first])
    k = len(first)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    white = projected(fit, x, n, sums, weights, "d", "w")
    covariance = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs, strict=True))
    total = exact / n**3
    taken = [*rows.columns, *names]
    place, entry = free_name(taken, "place"), free_name(taken, "entry")
    out = projected(found, x, n, sums, weights, names[2], x).select(*rows.columns, names[2], F.posexplode(x).alias(place, entry))
    explained = F.get(F.array(*[F.lit(e / total) for e, _ in first]), F.col(place))
    added = [F.col(place) + 1, F.lit(n).cast("long"), F.col(names[2]), F.col(entry), explained, F.lit(float(error))]
    return out.select(*rows.columns, *[c.alias(name) for c, name in zip(added, names, strict=True)])
