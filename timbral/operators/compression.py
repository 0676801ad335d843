"""Compressed model updates whose error is fed back: what a round leaves out joins the next one.

Updates are rows (client, parameter, place, value). Residuals are state by the same keys: a table
that each round replaces, or the state of a stream. The sum of all that was sent plus the last
residuals is the sum of the plain updates, after every round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GROUP = ["client", "param"]
KEYS = [*GROUP, "place"]
#: Decimal places of a corrected value, so that equal values tie however their sums were added up.
PLACES = 9


def _largest(value: Column, share: float) -> tuple[Column, Column]:
    by = Window.partitionBy(*GROUP)
    rank = F.row_number().over(by.orderBy(F.desc(F.abs(value)), "place"))
    keep = rank <= F.greatest(F.lit(1), F.floor(F.count("*").over(by) * share))
    return F.when(keep, value).otherwise(0.0), keep


def _rounded(value: Column, bits: int) -> tuple[Column, Column]:
    step = F.max(F.abs(value)).over(Window.partitionBy(*GROUP)) / float(2 ** (bits - 1) - 1)
    step = F.when(step > 0, step).otherwise(1.0)
    return F.rint(value / step).cast("int"), step


def compress_round(updates: DataFrame, residuals: DataFrame | None = None, method: str = "topk", share: float = 0.1, bits: int = 8) -> DataFrame:
    """One row a place with value, corrected (value plus residual), sent (what the receiver
    gets), residual (corrected - sent), and code and scale (quantize) or kept (topk).

    topk sends each client's max(1, floor(share n)) largest of a parameter's n places, of equals the
    first; quantize sends multiples of the largest over 2^(bits-1) - 1, half to even. A place with
    a residual and no update counts as updated by 0, and the other way round; null values are 0.
    Other columns of the residuals stay, null at new places.
    A client's places of one parameter, which its model bounds, are ranked in one task.
    """
    rows = updates.select(*KEYS, F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    if residuals is None:
        joined = rows.withColumn("corrected", F.round("value", PLACES))
    else:
        joined = rows.join(residuals.withColumnRenamed("residual", "before"), KEYS, "full").withColumn("value", F.coalesce("value", F.lit(0.0)))
        joined = joined.withColumn("corrected", F.round(F.col("value") + F.coalesce("before", F.lit(0.0)), PLACES)).drop("before")
    value = F.col("corrected")
    if method == "topk":
        sent, keep = _largest(value, share)
        done = joined.withColumn("kept", keep).withColumn("sent", sent)
    elif method == "quantize":
        code, scale = _rounded(value, bits)
        done = joined.withColumn("scale", scale).withColumn("code", code).withColumn("sent", F.col("code") * F.col("scale"))
    else:
        raise ValueError("method is topk or quantize")
    return done.withColumn("residual", value - F.col("sent"))


def message(compressed: DataFrame, method: str = "topk") -> DataFrame:
    """What a client sends of a compressed round: (client, param, size, places, values) of the kept
    places for topk, (client, param, scale, codes) for quantize; one row a client and parameter."""
    cell = lambda *names: F.array_sort(F.collect_list(F.struct(*names)))
    if method == "topk":
        kept = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("place", "sent"))))
        rows = compressed.groupBy(*GROUP).agg((F.max("place") + 1).alias("size"), kept.alias("c"))
        return rows.select(*GROUP, "size", F.col("c.place").alias("places"), F.col("c.sent").alias("values"))
    if method == "quantize":
        rows = compressed.groupBy(*GROUP).agg(F.max("scale").alias("scale"), cell("place", "code").alias("c"))
        return rows.select(*GROUP, "scale", F.col("c.place").alias("places"), F.col("c.code").alias("codes"))
    raise ValueError("method is topk or quantize")


def decompress(messages: DataFrame, method: str = "topk") -> DataFrame:
    """(client, param, place, value) of messages: of topk every place below its size, 0 where
    nothing was sent; of quantize its codes times the scale."""
    if method == "topk":
        sent = F.map_from_arrays("places", "values")
        every = messages.withColumn("sent", sent).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size").cast("long") - 1)))
        return every.select(*KEYS, F.coalesce(F.try_element_at("sent", F.col("place")), F.lit(0.0)).alias("value"))
    if method == "quantize":
        every = messages.select(*GROUP, "scale", F.explode(F.arrays_zip("places", "codes")).alias("c"))
        return every.select(*GROUP, F.col("c.places").alias("place"), (F.col("c.codes") * F.col("scale")).alias("value"))
    raise ValueError("method is topk or quantize")


def compress_rounds(updates: DataFrame, rounds: list, round_col: str = "round", method: str = "topk", share: float = 0.1, bits: int = 8) -> DataFrame:
    """Rounds one after another: (client, param, place, plain, sent, residual): sums over all of them
    and the last residual; plain = sent + residual. Each round reads the state once."""
    if not rounds:
        raise ValueError("no rounds")
    state = None
    for r in rounds:
        now = compress_round(updates.where(F.col(round_col) == F.lit(r)), state, method, share, bits)
        before = {c: F.coalesce(F.col(c), F.lit(0.0)) if state is not None else F.lit(0.0) for c in ("all_plain", "all_sent")}
        state = now.select(*KEYS, "residual", (before["all_plain"] + F.col("value")).alias("all_plain"), (before["all_sent"] + F.col("sent")).alias("all_sent"))
    return state.select(*KEYS, F.col("all_plain").alias("plain"), F.col("all_sent").alias("sent"), "residual")


def compressed_values(values: np.ndarray, method: str, share: float, bits: int) -> np.ndarray:
    """What is sent of one client's values of one parameter, by ascending place."""
    if method == "topk":
        keep = np.argsort(-np.abs(values), kind="stable")[: max(1, int(np.floor(len(values) * share)))]
        return np.where(np.isin(np.arange(len(values)), keep), values, 0.0)
    step = np.abs(values).max(initial=0.0) / (2 ** (bits - 1) - 1) or 1.0
    return np.rint(values / step) * step


class _Feedback(StatefulProcessor):
    """Residuals of one client's parameter, by place, as state of a stream."""

    def __init__(self, method: str, share: float, bits: int) -> None:
        self.how = (method, share, bits)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.residuals = handle.getMapState("residuals", "place long", "residual double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        own = {int(k[0]): float(v[0]) for k, v in self.residuals.iterator()}
        for number, part in sorted(new.groupby("round"), key=lambda p: p[0]):
            plain = part.groupby("place")["value"].sum()
            places = sorted({*own, *plain.index.astype(int)})
            value = np.array([float(plain.get(p, 0.0)) for p in places])
            corrected = np.round(value + np.array([own.get(p, 0.0) for p in places]), PLACES)
            sent = compressed_values(corrected, *self.how)
            own = dict(zip(places, corrected - sent, strict=True))
            yield pd.DataFrame({"client": key[0], "param": key[1], "place": places, "round": number, "value": value, "sent": sent, "residual": list(own.values())})
        for place, left in own.items():
            self.residuals.updateValue((place,), (float(left),))

    def close(self) -> None:
        pass


def error_feedback_stream(updates: DataFrame, method: str = "topk", share: float = 0.1, bits: int = 8) -> DataFrame:
    """V17 on a stream (round, client, param, place, value): appends (client, param, place, round,
    value, sent, residual) for every round that arrives; residuals are kept by client and parameter
    between micro-batches and survive a restart from the checkpoint. A round's rows of one client
    and parameter must arrive in one micro-batch; several rounds in one go in their order. Needs
    the RocksDB state store."""
    fields = {f.name: f.dataType for f in updates.schema.fields}
    added = [(k, fields[k]) for k in GROUP] + [("place", T.LongType()), ("round", fields["round"])] + [(k, T.DoubleType()) for k in ("value", "sent", "residual")]
    schema = T.StructType([T.StructField(n, t) for n, t in added])
    rows = updates.withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))
    return rows.groupBy(*GROUP).transformWithStateInPandas(_Feedback(method, share, bits), schema, "append", "none")
