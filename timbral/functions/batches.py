"""Kernels on array columns: signals of one length at a time as a matrix, inside Arrow batches.

A kernel sees a float matrix, one signal a row, and gives one value (or one array) a row for each
field of its struct. Null signals, and those shorter than the kernel needs, give null structs. Null
or non-finite samples count as 0, so that one bad sample does not spoil a signal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a field may be: the Spark type and the Arrow type.
KINDS: dict[str, tuple[T.DataType, pa.DataType]] = {
    "double": (T.DoubleType(), pa.float64()),
    "long": (T.LongType(), pa.int64()),
    "doubles": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64())),
    "longs": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "flags": (T.ArrayType(T.BooleanType()), pa.list_(pa.bool_())),
    "matrix": (T.ArrayType(T.ArrayType(T.DoubleType())), pa.list_(pa.list_(pa.float64()))),
}


#: Samples that a kernel sees at once: what it makes of them, often hundreds of times as much, does not
#: grow with a batch. One longer signal is still worked on whole.
CELLS = 1 << 14


def matrices(signals: pa.Array, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of signals of one length of `least` samples or more, CELLS samples at a time."""
    flat = signals.flatten().to_numpy(zero_copy_only=False)
    sizes = pa.compute.list_value_length(signals).fill_null(-1).to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for n in np.unique(sizes):
        if n >= max(least, 1):
            own, step = np.flatnonzero(sizes == n), max(1, CELLS // int(n))
            for lo in range(0, len(own), step):
                rows = own[lo : lo + step]
                x = flat[starts[rows][:, None] + np.arange(n)].astype(float)
                yield rows, np.where(np.isfinite(x), x, 0.0)


def _lists(values: np.ndarray) -> pa.Array:
    """The rows of an array of two dimensions or more as lists, without an object for each value."""
    inner = pa.array(values.ravel()) if values.ndim == 2 else _lists(values.reshape(-1, *values.shape[2:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), inner)


def _column(values, kind: str) -> pa.Array:
    """A field's values of some signals as an Arrow array."""
    arrow, depth = KINDS[kind][1], {"doubles": 2, "longs": 2, "matrix": 3}.get(kind)
    if isinstance(values, np.ndarray) and values.ndim == depth and values.dtype != object:
        return _lists(values).cast(arrow)
    return pa.array([v.tolist() if kind == "matrix" and isinstance(v, np.ndarray) else v for v in values], arrow)


def on_signals(work: Callable[..., dict], least: int = 1, **fields: str) -> Callable[..., Column]:
    """A column function of one array column, giving a struct of `fields` (name and kind)."""
    names = list(fields)
    given = T.StructType([T.StructField(n, KINDS[k][0]) for n, k in fields.items()])
    arrow = pa.struct([(n, KINDS[k][1]) for n, k in fields.items()])

    @F.arrow_udf(given)
    def run(signals: pa.Array) -> pa.Array:
        parts, place, done = [pa.nulls(1, arrow)], np.zeros(len(signals), np.int64), 1
        for rows, x in matrices(signals, least):
            found = work(x)
            parts.append(pa.StructArray.from_arrays([_column(found[n], fields[n]) for n in names], fields=list(arrow)))
            place[rows] = done + np.arange(len(rows))
            done += len(rows)
        return pa.concat_arrays(parts).take(pa.array(place))

    return run


def on_seeded(work: Callable[..., dict], least: int = 1, **fields: str) -> Callable[..., Column]:
    """A column function of (signal, seed, name), giving a struct of `fields`: work(matrix, generators,
    name) sees signals of one length and one name at a time, and for each row a generator of random
    numbers that depends on its seed alone, so reruns agree. A null seed is 0."""
    names = list(fields)
    given = T.StructType([T.StructField(n, KINDS[k][0]) for n, k in fields.items()])
    arrow = pa.struct([(n, KINDS[k][1]) for n, k in fields.items()])

    @F.arrow_udf(given)
    def run(signals: pa.Array, seeds: pa.Array, kinds: pa.Array) -> pa.Array:
        out: list = [None] * len(signals)
        seed, kind = seeds.fill_null(0).to_pylist(), np.array(kinds.to_pylist(), dtype=object)
        for rows, x in matrices(signals, least):
            for name in dict.fromkeys(kind[rows].tolist()):
                own = np.flatnonzero([k == name for k in kind[rows]])
                found = work(x[own], [np.random.default_rng(seed[rows[i]] & (2**63 - 1)) for i in own], name)
                for k, i in enumerate(own):
                    out[rows[i]] = {n: found[n][k] for n in names}
        return pa.array(out, arrow)

    return run


def streams(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str = "x") -> DataFrame:
    """(keys, out): each key's values in order, as one array; null values are 0. A key is an
    utterance: what one task holds of it is bounded by how long an utterance may be."""
    cell = F.struct(*order, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("__v"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["__v"]).alias(out))


def frames(x: Column, length: int, hop: int) -> Column:
    """All full frames of a signal, as an array of arrays, sliced inside its row."""
    n = F.floor((F.size(x) - length) / hop).cast("int")
    places = F.when(F.size(x) >= length, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.when(x.isNotNull(), F.transform(places, lambda k: F.slice(x, k * hop + 1, F.lit(length))))


def framed(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    """(rows, frames, length) views of a matrix of signals; signals shorter than a frame have none."""
    if x.shape[1] < length:
        return np.zeros((len(x), 0, length))
    return np.lib.stride_tricks.sliding_window_view(x, length, axis=1)[:, ::hop]


def peaks(x: np.ndarray, height: float = -np.inf, distance: float = 1) -> np.ndarray:
    """Places of one signal's local maxima of at least `height`, the middle of flat tops; where two
    are nearer than `distance`, the higher one stays (of equals the later one)."""
    step = np.flatnonzero(np.diff(x))
    if not len(step):
        return np.zeros(0, int)
    start, end = np.r_[0, step + 1], np.r_[step, len(x) - 1]
    level = x[start]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    at = (start[top] + end[top]) // 2
    at = at[x[at] >= height]
    keep = np.ones(len(at), bool)
    for i in np.argsort(x[at], kind="stable")[::-1]:
        if keep[i]:
            near = slice(np.searchsorted(at, at[i] - distance, side="right"), np.searchsorted(at, at[i] + distance, side="left"))
            keep[near] = False
            keep[i] = True
    return at[keep]
