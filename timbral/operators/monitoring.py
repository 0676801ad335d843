"""Metric logs: latest values, drift, shadows, histories, adaptive thresholds and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.functions import vectors as V


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by the order columns. An aggregate, so a hot key is
    combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    lead = [c for c in order if c in rest] + [c for c in rest if c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*lead)).alias("last")).select(*keys, *[F.col(f"last.{c}") for c in rest])


def recent(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The last `most` rows per key, with their place `age` (1 is the newest)."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= most)


def drift(log: DataFrame, keys: list[str], order: list[str], value: str, window: int = 5, threshold: float = 0.05) -> DataFrame:
    """Latest value against the mean of the `window` before it. drift is false with fewer
    rows or a NaN."""
    rows = recent(log, keys, order, window + 1)
    out = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("age") == 1, F.col(value))).alias("current"),
        F.avg(F.when(F.col("age") > 1, F.col(value))).alias("before"),
        F.count("*").alias("n"),
    )
    gap = F.abs(F.col("current") - F.col("before"))
    return out.withColumn("drift", (F.col("n") > window) & ~F.isnan(F.coalesce(gap, F.lit(0.0))) & F.coalesce(gap > threshold, F.lit(False)))


def shadow_compare(current: DataFrame, shadows: DataFrame, metric: str, shadow: str, order: list[str], value: str, threshold: float = 0.1) -> DataFrame:
    """The latest current value of a metric against each shadow's latest value."""
    now = latest(current, [metric], order).select(metric, F.col(value).alias("current_value"))
    then = latest(shadows, [metric, shadow], order).select(metric, shadow, F.col(value).alias("shadow_value"))
    joined = then.join(now, metric).withColumn("difference", F.abs(F.col("current_value") - F.col("shadow_value")))
    return joined.withColumn("drift", F.col("difference") > threshold)


def adaptive_threshold(scores: DataFrame, keys: list[str], order: list[str], score: str, genuine: Column, fixed: float = 0.7, most: int = 100, least: int = 10) -> DataFrame:
    """A threshold per key from the last genuine and impostor scores (population
    deviation), between 0.5 and 0.95; the fixed one with fewer than `least` of either."""
    rows = recent(scores.withColumn("genuine", genuine), [*keys, "genuine"], order, most)
    side = lambda f, flag, name: f(F.when(F.col("genuine") == flag, F.col(score))).alias(name)
    stats = rows.groupBy(*keys).agg(
        side(F.count, True, "gn"), side(F.avg, True, "gm"), side(F.stddev_pop, True, "gs"),
        side(F.count, False, "im_n"), side(F.avg, False, "im"), side(F.stddev_pop, False, "is"),
    )
    c = F.col
    apart = c("im") + c("is") < c("gm") - c("gs")
    fitted = F.when(apart, (c("im") + c("is") + c("gm") - c("gs")) / 2).otherwise((c("im") + c("gm")) / 2 + c("gs") / 2)
    enough = (c("gn") >= least) & (c("im_n") >= least)
    return stats.select(*keys, c("gn").alias("n_genuine"), c("im_n").alias("n_impostor"), F.when(enough, V.clamp(fitted, 0.5, 0.95)).otherwise(F.lit(fixed)).alias("threshold"))


def policy_threshold(history: DataFrame, keys: list[str], order: list[str], similarity: str, accepted: str, fixed: float = 0.7, most: int = 100) -> DataFrame:
    """At least the fixed threshold, and the 10th percentile of accepted similarities
    among the last `most` attempts."""
    rows = recent(history, keys, order, most)
    p10 = F.percentile(F.when(F.col(accepted), F.col(similarity)), F.lit(0.1))
    return rows.groupBy(*keys).agg(F.greatest(F.lit(fixed), F.coalesce(p10, F.lit(fixed))).alias("threshold"))


def adapt_weights(results: DataFrame, order: list[str], weights: dict[str, float], most: int = 50, least: int = 10) -> DataFrame:
    """(component, weight): 0.8 of the old weight and 0.2 of the normalized inverse
    population variance over the last `most` results; the old weights with fewer than `least`.
    Only the last rows leave their tasks (a top-k)."""
    rows = results.orderBy(*[F.desc(c) for c in order]).limit(most)
    stats = rows.agg(F.count("*").alias("n"), *[(1 / (F.var_pop(k) + 1e-10)).alias(k) for k in weights])
    whole = sum((F.col(k) for k in weights), F.lit(0.0))
    each = [F.struct(F.lit(k).alias("component"), F.when(F.col("n") >= least, 0.8 * w + 0.2 * F.col(k) / whole).otherwise(F.lit(w)).alias("weight")) for k, w in weights.items()]
    return stats.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def demographics(rows: DataFrame, columns: list[str], metrics: DataFrame | None = None) -> DataFrame:
    """(demographic, category, count) for each non-null category of each column, in
    one pass, crossed with one row of global metrics where given."""
    pairs = F.array(*[F.struct(F.lit(c).alias("demographic"), F.col(c).cast("string").alias("category")) for c in columns])
    counts = rows.select(F.explode(pairs).alias("p")).select("p.*").where("category is not null").groupBy("demographic", "category").agg(F.count("*").alias("count"))
    return counts if metrics is None else counts.crossJoin(F.broadcast(metrics.limit(1)))


def should_retrain(last: DataFrame, current: DataFrame, threshold: float = 0.05, min_days: float = 7.0) -> DataFrame:
    """P25: one row, retrain. last (metric, value, trained_at) is empty before the first
    training; current (metric, value, now). Scores must not fall, errors not rise, by more than
    the threshold, once the interval has passed."""
    better = F.col("metric").isin("accuracy", "auc", "f1")
    worse = F.col("metric").isin("error", "eer", "loss")
    joined = current.join(last.withColumnRenamed("value", "last_value"), "metric", "left")
    due = (F.unix_timestamp("now") - F.unix_timestamp("trained_at")) / 86400.0 >= min_days
    worsened = (better & (F.col("last_value") - F.col("value") > threshold)) | (worse & (F.col("value") - F.col("last_value") > threshold))
    return joined.agg((F.count("trained_at") == 0).alias("first"), F.coalesce(F.bool_or(due & worsened), F.lit(False)).alias("worsened")).select((F.col("first") | F.col("worsened")).alias("retrain"))
