"""Confusion matrices, ROC, EER, AUC and F1 without ordering all scores in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbral.tables import written

#: Buckets of the score range; cumulative sums run inside each, and over their totals.
BUCKETS = 1024


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) for all labels on either side, 0 where nothing fell."""
    labels = rows.select(F.col(truth).alias("label")).union(rows.select(predicted)).where("label is not null").distinct()
    cells = labels.select(F.col("label").alias(truth)).crossJoin(labels.select(F.col("label").alias(predicted)))
    counts = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return cells.join(counts, [truth, predicted], "left").na.fill(0, ["n"])


def trials(similarities: DataFrame, speaker: str, candidate: str, score: str) -> DataFrame:
    """(score, genuine) of attempts against a gallery."""
    return similarities.select(F.col(score).alias("score"), (F.col(speaker) == F.col(candidate)).alias("genuine"))


def roc(rows: DataFrame) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at each distinct score of rows (score, genuine), from
    the highest down; a trial is accepted at the threshold or above. Null scores are left out.

    Counts are summed per distinct score and written, as all else is read from them, then cumulated
    within BUCKETS ranges of score; the ranges' own totals are few enough for one window.
    """
    points = rows.where("score is not null").groupBy("score").agg(F.count_if("genuine").alias("p"), F.count_if(~F.col("genuine")).alias("q"))
    points = written(points, "roc-points")
    ends = points.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    width = F.greatest(F.col("high") - F.col("low"), F.lit(1e-300))
    placed = points.crossJoin(F.broadcast(ends)).withColumn("bucket", F.floor((F.col("score") - F.col("low")) / width * BUCKETS))
    totals = placed.groupBy("bucket").agg(F.sum("p").alias("bp"), F.sum("q").alias("bq"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("bucket", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("bq").over(above), F.lit(0)).alias("q0"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(before), "bucket")  # at most BUCKETS + 1 rows
    out = out.withColumns({"tp": F.col("p0") + F.sum("p").over(inside), "fp": F.col("q0") + F.sum("q").over(inside)})
    return out.select(F.col("score").alias("threshold"), "tp", "fp", F.try_divide("tp", "all_p").alias("tpr"), F.try_divide("fp", "all_q").alias("fpr"))


def equal_error_rate(curve: DataFrame) -> DataFrame:
    """One row (eer, threshold) where |fnr - fpr| is least; of equals the highest threshold."""
    gap = F.abs(1 - F.col("tpr") - F.col("fpr"))
    best = F.min(F.struct(gap.alias("gap"), (-F.col("threshold")).alias("minus"), ((1 - F.col("tpr") + F.col("fpr")) / 2).alias("eer"))).alias("b")
    return curve.agg(best).select(F.col("b.eer").alias("eer"), (-F.col("b.minus")).alias("threshold"))


def binary_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, auc (ties count half) and f1 of rows (truth 0/1, score), at score > 0.5."""
    said = (F.col("score") > 0.5).cast("int")
    t = F.col("truth")
    flat = rows.agg(
        F.avg((said == t).cast("double")).alias("accuracy"), F.sum(said * t).alias("tp"), F.sum(said).alias("said"), F.sum(t).alias("truly"),
    )
    curve = roc(rows.select("score", (t == 1).alias("genuine")))
    # areas under the steps: each point needs only the counts before it, tp - p and fp - q
    points = rows.groupBy("score").agg(F.count_if(t == 1).alias("p"), F.count_if(t == 0).alias("q"))
    area = curve.join(points, curve["threshold"] == points["score"]).agg(F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)).alias("u"), F.max("tp").alias("np"), F.max("fp").alias("nq"))
    both = flat.crossJoin(area)
    return both.select("accuracy", F.try_divide("u", F.col("np") * F.col("nq")).alias("auc"), F.try_divide(2.0 * F.col("tp"), F.col("said") + F.col("truly")).alias("f1"))


def class_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, n, precision, recall, f1) of every class that is true or predicted somewhere; a
    ratio over nothing is 0. Rows with a null truth or prediction are left out. One grouping by both
    gives the table that all else is summed from."""
    cells = rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    hit = F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0)
    side = lambda c, name: cells.groupBy(F.col(c).alias("class")).agg(F.sum("c").alias(name), F.sum(hit).alias(f"hit_{name}"))
    both = side("t", "n").join(side("p", "said"), "class", "full").na.fill(0, ["n", "said", "hit_n", "hit_said"])
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    both = both.withColumn("precision", ratio("hit_said", "said")).withColumn("recall", ratio("hit_n", "n"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return both.select("class", "n", "precision", "recall", f1.alias("f1"))


def macro_metrics(classes: DataFrame) -> DataFrame:
    """One row (accuracy, macro_precision, macro_recall, macro_f1): plain means over the classes
    that class_metrics() gave."""
    hits = F.sum(F.col("recall") * F.col("n")) / F.sum("n")
    return classes.agg(hits.alias("accuracy"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
