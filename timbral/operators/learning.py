"""Anomaly scores, active-learning selection and federated aggregation of model updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.operators.verification import components


def mahalanobis_diag(rows: DataFrame, sample: str, group: str, vec: str, quantile: float = 0.95) -> DataFrame:
    """(sample, group, score, anomaly): the sum of squared z-scores against the group's
    mean and population deviation per component; anomaly beyond the quantile of all scores."""
    cells = components(rows, [sample, group], vec)
    stats = cells.groupBy(group, "i").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    z = F.try_divide(F.col("v") - F.col("mu"), F.col("sd"))
    scores = cells.join(stats, [group, "i"]).groupBy(sample, group).agg(F.sum(F.coalesce(z * z, F.lit(0.0))).alias("score"))
    bar = scores.agg(F.percentile("score", F.lit(quantile)).alias("bar"))
    return scores.crossJoin(F.broadcast(bar)).withColumn("anomaly", F.col("score") > F.col("bar")).drop("bar")


def sequence_anomaly(rows: DataFrame, keys: list[str], order: list[str], value: str, limit: float = 3.0) -> DataFrame:
    """E20 with next = last as the predictor: (keys, z, anomaly): the key's mean squared step
    against the mean and population deviation of all keys."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    errors = rows.withColumn("e", step * step).groupBy(*keys).agg(F.avg("e").alias("error"))
    stats = errors.agg(F.avg("error").alias("mu"), F.stddev_pop("error").alias("sd"))
    z = F.try_divide(F.col("error") - F.col("mu"), F.col("sd"))
    return errors.crossJoin(F.broadcast(stats)).select(*keys, "error", z.alias("z"), F.coalesce(z > limit, F.lit(False)).alias("anomaly"))


def uncertainty_topk(rows: DataFrame, sample: str, probability: Column, k: int) -> DataFrame:
    """The k samples nearest to a coin toss, 0.5 - |p - 0.5|; of equals the smallest id."""
    return rows.withColumn("uncertainty", 0.5 - F.abs(probability - 0.5)).orderBy(F.desc("uncertainty"), sample).limit(k)


def diversity_allocation(rows: DataFrame, attributes: list[str], max_samples: int) -> DataFrame:
    """(group_key, size, allocation): a minimum of 2 for each group (fewer if there are
    many), the rest in proportion to size, rounded down, and never more than a group has."""
    parts = [F.concat(F.lit(f"{a}:"), F.coalesce(F.col(a).cast("string"), F.lit("unknown"))) for a in attributes]
    sizes = rows.groupBy(F.concat_ws("+", *parts).alias("group_key")).agg(F.count("*").alias("size"))
    whole = sizes.agg(F.count("*").alias("groups"), F.sum("size").alias("total"))
    least = F.least(F.lit(2), F.floor(F.lit(max_samples) / F.col("groups")))
    share = F.floor((F.lit(max_samples) - least * F.col("groups")) * F.col("size") / F.col("total"))
    return sizes.crossJoin(F.broadcast(whole)).select("group_key", "size", F.least(F.col("size"), least + share).cast("long").alias("allocation"))


def diverse_sample(rows: DataFrame, sample: str, attributes: list[str], max_samples: int, seed: int = 42) -> DataFrame:
    """Rows up to their group's allocation, by seeded hash of the sample id."""
    parts = [F.concat(F.lit(f"{a}:"), F.coalesce(F.col(a).cast("string"), F.lit("unknown"))) for a in attributes]
    keyed = rows.withColumn("group_key", F.concat_ws("+", *parts)).join(diversity_allocation(rows, attributes, max_samples), "group_key")
    place = F.row_number().over(Window.partitionBy("group_key").orderBy(F.xxhash64(F.lit(seed), sample), sample))
    return keyed.withColumn("place", place).where("place <= allocation").drop("place", "size", "allocation")


def representatives(rows: DataFrame, sample: str, vec: str, k: int, seed: int = 42) -> DataFrame:
    """The sample nearest to each of k KMeans centres; of equals the smallest id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = rows.select(sample, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(ready)
    centres = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    placed = model.transform(ready).join(F.broadcast(centres), "prediction")  # k rows
    gap = F.aggregate(F.zip_with(vector_to_array("features"), "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return placed.groupBy("prediction").agg(F.min(F.struct(gap.alias("d"), F.col(sample).alias("id"))).alias("best")).select("prediction", F.col("best.id").alias(sample), F.sqrt("best.d").alias("distance"))


def federated_mean(updates: DataFrame, param: list[str], value: str, weight: str) -> DataFrame:
    """(param, mean, clients): weighted mean per parameter place; partial sums
    are combined before the shuffle."""
    return updates.groupBy(*param).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.count("*").alias("clients"))


def sigma_threshold(means: DataFrame, param: str, value: str, sigmas: float = 3.0) -> DataFrame:
    """Values of a parameter below `sigmas` sample deviations become 0."""
    stats = means.groupBy(param).agg(F.stddev_samp(value).alias("sd"))
    return means.join(stats, param).withColumn("kept", F.when(F.abs(F.col(value)) < sigmas * F.col("sd"), 0.0).otherwise(F.col(value))).drop("sd")


def clip_norm(updates: DataFrame, client: str, value: str, limit: float) -> DataFrame:
    """Each client's values times min(1, C / (norm + 1e-10)). The norms are what a task hashes; updates pass by unsorted."""
    norms = updates.groupBy(client).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    scale = F.least(F.lit(1.0), F.lit(float(limit)) / (F.col("norm") + 1e-10))
    return updates.join(norms.hint("shuffle_hash"), client).withColumn("clipped", F.col(value) * scale)


def top_share(updates: DataFrame, param: list[str], place: list[str], value: str, share: float = 0.1) -> DataFrame:
    """Values outside a parameter's max(1, floor(share n)) largest by magnitude
    become 0 (of equals the first by place)."""
    by = Window.partitionBy(*param)
    rank = F.row_number().over(by.orderBy(F.desc(F.abs(F.col(value))), *place))
    keep = rank <= F.greatest(F.lit(1), F.floor(F.count("*").over(by) * share))
    return updates.withColumn("kept", F.when(keep, F.col(value)).otherwise(0.0))


def quantize(updates: DataFrame, param: list[str], value: str, bits: int = 8) -> DataFrame:
    """(.., code, restored): multiples of max / (2^(bits-1) - 1), half to even."""
    top = updates.groupBy(*param).agg(F.max(F.abs(F.col(value))).alias("top"))
    scale = F.col("top") / float(2 ** (bits - 1) - 1)
    rows = updates.join(top, param).withColumn("scale", F.when(scale > 0, scale).otherwise(1.0))
    return rows.withColumn("code", F.rint(F.col(value) / F.col("scale")).cast("int")).withColumn("restored", F.col("code") * F.col("scale")).drop("top")


def gaussian_sigma(clip: float, epsilon: float, delta: float) -> Column:
    """C sqrt(2 ln(1.25 / delta)) / epsilon."""
    return F.lit(float(clip)) * F.sqrt(2 * F.log(F.lit(1.25) / delta)) / epsilon


def secret_shares(rows: DataFrame, value: str, shares: int, seed: int) -> DataFrame:
    """(.., share_no, share): random shares that sum up to the value; the last is the rest."""
    noise = F.transform(F.sequence(F.lit(1), F.lit(shares - 1)), lambda i: (F.xxhash64(F.lit(seed), F.struct(*rows.columns), i) % 1_000_003) / 1000.0)
    parts = F.concat(noise, F.array(F.col(value) - F.aggregate(noise, F.lit(0.0), lambda a, x: a + x)))
    return rows.select("*", F.posexplode(parts).alias("share_no", "share"))


def reconstruct(shares: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Sums of shares of keys with `least` shares at least."""
    return shares.groupBy(*keys).agg(F.sum("share").alias("value"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def secure_mean(updates: DataFrame, param: list[str], client: str, value: str, weight: str, clients: int, share: float = 0.5) -> DataFrame:
    """(param, mean, clients) of the parameter places that enough clients sent: max(2, floor(share
    clients)) different ones at least. A client's repeated rows weigh each; nulls are left out."""
    kept = updates.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    own = kept.groupBy(*param, client).agg(F.sum(F.col(value) * F.col(weight)).alias("s"), F.sum(weight).alias("w"))
    found = own.groupBy(*param).agg(F.try_divide(F.sum("s"), F.sum("w")).alias("mean"), F.count("*").alias("clients"))
    return found.where(F.col("clients") >= max(2, int(clients * share)))


def server_step(state: DataFrame, means: DataFrame, param: list[str], rate: float = 1.0, momentum: float = 0.0) -> DataFrame:
    """(param, value, speed) after a round: speed = momentum x speed + rate x (mean - value), and
    value + speed. Places without a mean keep their value, and their speed fades; places that are
    new start at their mean, with speed 0."""
    both = state.select(*param, "value", F.coalesce("speed", F.lit(0.0)).alias("speed")).join(means.select(*param, "mean"), param, "full")
    pull = F.when(F.col("mean").isNotNull(), rate * (F.col("mean") - F.col("value"))).otherwise(0.0)
    speed = F.when(F.col("value").isNotNull(), momentum * F.col("speed") + pull).otherwise(0.0)
    return both.select(*param, F.coalesce(F.col("value") + speed, "mean").alias("value"), speed.alias("speed"))


def select_samples(rows: DataFrame, sample: str, uncertainty: str, vec: str, k: int, method: str = "hybrid", seed: int = 0) -> DataFrame:
    """The k samples to be labelled, (sample): the most uncertain ones; one near each of k centres;
    hybrid, those of the 2k most uncertain; or random, by a hash of the sample. Ties go to the
    smaller sample. Fewer rows than k give all of them."""
    if method == "uncertainty":
        return rows.orderBy(F.desc(uncertainty), sample).limit(k).select(sample)
    if method == "random":
        return rows.orderBy(F.xxhash64(F.lit(seed), sample), sample).limit(k).select(sample)
    if method == "diversity":
        return representatives(rows, sample, vec, k, seed).select(sample)
    if method == "hybrid":
        return representatives(rows.orderBy(F.desc(uncertainty), sample).limit(2 * k), sample, vec, k, seed).select(sample)
    raise ValueError("method is uncertainty, diversity, hybrid or random")


def retraining_samples(rows: DataFrame, sample: str, uncertainty: str, vec: str, attributes: list[str], k: int, method: str = "hybrid", diverse: bool = True, seed: int = 0) -> DataFrame:
    """The rows of select_samples(), and of those, if `diverse`, what each group of attributes is
    allotted of k."""
    chosen = rows.join(select_samples(rows, sample, uncertainty, vec, k, method, seed), sample, "left_semi")
    return diverse_sample(chosen, sample, attributes, k, seed) if diverse else chosen


def private_updates(updates: DataFrame, client: str, keys: list[str], value: str, limit: float, epsilon: float, delta: float, secret: str) -> DataFrame:
    """Updates with `noisy`: each client's values clipped to the norm `limit`, plus Gaussian noise
    of the deviation gaussian_sigma() gives, drawn from a secret and the row's keys (which must tell rows
    apart, or equal keys get equal noise). Null values stay null."""
    from timbral.operators import scores

    u, v = (scores.uniform(f"{secret}:{part}", *keys) + 0.5 for part in ("size", "turn"))
    noise = F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)
    clipped = clip_norm(updates, client, value, limit)
    return clipped.withColumn("noisy", F.col("clipped") + noise * gaussian_sigma(limit, epsilon, delta)).drop("clipped", "norm")
