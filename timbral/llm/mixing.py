"""Mixing sources to target weights: subset-sum budget fitting over counts of token lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.llm.shared import free_name, settle

#: Tokens that are fitted by dynamic programming at first.
DP_TOKENS = 8192
#: Documents of one length whose seeded order is looked up in one group.
BUCKET = 1000
#: A plan of more rows than this is joined by a shuffle instead of being broadcast.
BROADCAST_ROWS = 500_000
SPREAD = 0x9E3779B97F4A7C15


def n_words(text: Column) -> Column:
    """Runs outside ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum up to near budget.

    Takes of each length its share of the budget, rounded by a seeded number, and gives back
    or adds in seeded order, until half of a window or more, and about a window at most, is
    missing. That rest is a bounded knapsack over sums in steps of the lengths' common divisor:
    for each sum the step that first reached it, each length's leftover count in powers of two,
    walked back from the sum that comes nearest. The first window has DP_TOKENS; where that does
    not meet the budget it grows to four times the longest document, so that documents of every
    length are among those chosen anew. The order in which the lengths come in makes no
    difference.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    rising = np.argsort(lengths, kind="stable")
    if (np.diff(rising) < 0).any():
        out = np.zeros_like(counts)
        out[rising] = fit_budget(lengths[rising], counts[rising], budget, seed)
        return out
    total = int((lengths * counts).sum())
    budget = min(max(0, int(budget)), total)
    if not total or not budget:
        return np.zeros_like(counts)
    if budget > total // 2:  # what stays out is fitted instead
        return counts - fit_budget(lengths, counts, total - budget, seed)
    mixed = (lengths.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(SPREAD)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    chance = (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53
    take = np.minimum(counts, np.floor(counts * (budget / total) + chance).astype(np.int64))
    order = np.argsort(mixed, kind="stable")
    missing = budget - int((take * lengths).sum())
    for i in order:
        if missing >= 0:
            break
        back = min(int(take[i]), -(missing // int(lengths[i])))
        take[i] -= back
        missing += back * int(lengths[i])
    window, best = DP_TOKENS, None
    while True:
        found = _knapsack(lengths, counts, take, missing, order, window)
        short = abs(budget - int((found * lengths).sum()))
        if best is None or short < best[0]:
            best = short, found
        if not short or window >= 4 * lengths.max():
            return best[1]
        window *= 4


def _knapsack(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, missing: int, order: np.ndarray, window: int) -> np.ndarray:
    """take, changed in about `window` tokens so that the missing ones come as near 0 as can be."""
    take = take.copy()
    for i in order:
        if missing <= window:
            break
        more = min(int(counts[i] - take[i]), (missing - window // 2) // int(lengths[i]))
        if more > 0:
            take[i] += more
            missing -= more * int(lengths[i])
    for i in order[::-1]:  # documents to choose anew, so that the knapsack has a choice
        if missing >= window // 2:
            break
        back = min(int(take[i]), -(-(window // 2 - missing) // int(lengths[i]))) if lengths[i] <= window // 2 else 0
        take[i] -= back
        missing += back * int(lengths[i])
    left, unit = counts - take, int(np.gcd.reduce(lengths))
    goal = missing / unit
    most, whole = int(2 * goal), missing // unit if missing % unit == 0 else -1
    reach, steps = np.full(most + 1, -1, dtype=np.int32), []  # the step that first reached a sum
    reach[0] = 0
    for i in np.flatnonzero((left > 0) & (lengths <= most * unit)):
        n, power = min(int(left[i]), most * unit // int(lengths[i])), 1
        while n > 0 and (whole < 0 or reach[whole] < 0):
            size = min(power, n)
            steps.append((int(i), size))
            by = size * int(lengths[i]) // unit
            new = np.flatnonzero((reach[by:] < 0) & (reach[: most + 1 - by] >= 0)) + by
            reach[new] = len(steps)
            n, power = n - size, power * 2
    sums = np.flatnonzero(reach >= 0)
    at = int(sums[np.abs(sums - goal).argmin()])  # of two that are as near, the lower
    while at > 0:
        i, size = steps[reach[at] - 1]
        take[i] += size
        at -= size * int(lengths[i]) // unit
    return take


def targets(sizes: DataFrame, total: float) -> DataFrame:
    """sizes (source, weight, source_size) with target: total shared by weight, none above
    twice its source's size; the excess goes to the others by weight until none is above."""
    capped = F.lit(0.0)
    level = None
    while True:
        over = F.col("weight") * F.lit(level) > 2 * F.col("source_size") if level is not None else F.lit(False)
        row = sizes.agg(F.sum(F.when(over, 2.0 * F.col("source_size")).otherwise(0.0)).alias("fixed"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if not row["free"]:
            return sizes.withColumn("target", 2.0 * F.col("source_size"))
        new = (total - row["fixed"]) / row["free"]
        if new == level:
            break
        level = new
    capped = F.col("weight") * F.lit(level)
    return sizes.withColumn("target", F.least(capped, 2.0 * F.col("source_size")))


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """sources (source, ...) with weight: weights in turn, by code point, null last. One task
    orders the sources; they have one row each."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int")))


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target, times and taken (= times * size).

    share times all words is spread over the sources by weight (see targets()). weights is a
    table (source, weight); without it, weights are those of cycled_weights(). A source takes
    all its documents as often as its target allows, 0, 1 or 2 times, and the rest by
    fit_budget() over its counts of documents by exact length. Of n documents with one length
    the k with the smallest seeded hash of id and text are taken once more. A null text has
    size 0; a null source is a source; repeated rows are documents of their own; an empty
    table stays empty. New columns get underscores where their names are taken. Reruns agree.
    """
    spark = docs.sparkSession
    size, key = n_words(F.col(text_col)), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    slim = settle(docs.select(F.col(source_col).alias("source"), size.alias("size"), key.alias("u")).groupBy("source", "size", "u").agg(F.count("*").alias("m")), "mix-sizes")
    counts = settle(slim.groupBy("source", "size").agg(F.sum("m").alias("n")), "mix-counts")
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sizes = sizes.join(weights, sizes["source"].eqNullSafe(weights["source"]), "left").select(sizes["*"], F.coalesce("weight", F.lit(0.0)).alias("weight")) if weights is not None else cycled_weights(sizes)
    sizes = settle(sizes, "mix-sources")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    goals = settle(targets(sizes, share * total), "mix-targets")

    def fit(hist: pd.DataFrame) -> pd.DataFrame:
        whole, goal = int(hist["source_size"].iloc[0]), round(float(hist["target"].iloc[0]))
        passes = min(goal // whole, 2) if whole else 0
        some = hist["size"].to_numpy() > 0
        extra = np.zeros(len(hist), dtype=np.int64)
        extra[some] = fit_budget(hist["size"].to_numpy()[some], hist["n"].to_numpy()[some], goal - passes * whole, seed)
        return hist[["source", "size", "n", "source_size", "target"]].assign(passes=passes, k=extra)

    hist = counts.join(goals, counts["source"].eqNullSafe(goals["source"])).select(counts["*"], "source_size", "target")
    plan = hist.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, passes long, k long")
    plan = settle(plan, "mix-plan")

    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])
    some = plan.where("k > 0 and k < n").select("source", "size", "k", F.ceil(F.col("n") / BUCKET).alias("nb"))
    ranked = slim.join(some, same(slim, some)).select(slim["*"], "k", F.floor(F.shiftrightunsigned("u", 1) / 2.0**63 * F.col("nb")).alias("bucket"))
    full = Window.partitionBy("source", "size").orderBy("bucket")
    buckets = ranked.groupBy("source", "size", "k", "bucket").agg(F.sum("m").alias("c")).withColumn("upto", F.sum("c").over(full))
    cut = buckets.where("upto >= k and upto - c < k").select("source", "size", "bucket", (F.col("upto") - F.col("c")).alias("before"))
    inside = ranked.join(cut, same(ranked, cut) & (ranked["bucket"] == cut["bucket"])).select(ranked["*"], "before")
    order = Window.partitionBy("source", "size", "bucket").orderBy(F.shiftrightunsigned("u", 1), "u")
    last = inside.withColumn("upto", F.col("before") + F.sum("m").over(order)).where("upto >= k and upto - m < k")
    last = last.select("source", "size", F.col("u").alias("last_u"), (F.col("k") - F.col("upto") + F.col("m")).alias("of_last"), "m")
    plan = settle(plan.join(last, same(plan, last), "left").select(plan["*"], "last_u", "of_last", "m"), "mix-plan")
    few = plan.count() <= BROADCAST_ROWS
    named = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    rows = docs.withColumns({"__docsize": size, "__dockey": key})
    joined = rows.join(F.broadcast(named) if few else named, rows[source_col].eqNullSafe(named["__source"]) & (rows["__docsize"] == named["__size"]))
    place = lambda c: F.struct(F.shiftrightunsigned(c, 1), F.col(c))
    extra = (
        F.when(F.col("__k") >= F.col("__n"), 1)
        .when((F.col("__k") == 0) | F.col("__last_u").isNull(), 0)
        .when(F.col("__dockey") == F.col("__last_u"), F.when(F.col("__of_last") >= F.col("__m"), 1))
        .when(place("__dockey") < place("__last_u"), 1)
        .otherwise(0)
    )
    judged = joined.withColumn("__extra", extra)
    if plan.where("of_last < m").limit(1).count():  # repeated rows, of which some are taken
        of_same = Window.partitionBy("__source", "__size", "__dockey").orderBy(F.lit(0))
        tied = judged.where("__extra is null").withColumn("__extra", (F.row_number().over(of_same) <= F.col("__of_last")).cast("int"))
        judged = judged.where("__extra is not null").unionByName(tied)
    names, taken = {}, list(docs.columns)
    for wish in ("size", "source_size", "target", "times", "taken"):
        names[wish] = free_name(taken, wish)
        taken.append(names[wish])
    times = F.col("__passes") + F.col("__extra")
    return judged.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("__docsize").alias(names["size"]), F.col("__source_size").alias(names["source_size"]), F.col("__target").alias(names["target"]),
        times.alias(names["times"]), (times * F.col("__docsize")).alias(names["taken"]),
    )
