"""Enrolment, similarity, policy and scoring of verification attempts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbral.functions import vectors as V
from timbral.tables import written

#: Speakers that are sent to all tasks at once.
GALLERY = 1 << 16

#: Weights of the liveness components.
LIVENESS_WEIGHTS = {"breathing": 0.15, "micro_modulation": 0.2, "resonance": 0.2, "environment": 0.25, "spectrum": 0.2}

#: The sentences of an explanation, by the least score that they hold for.
ACCEPTED = ("Authentication successful.", "All security checks passed.")
REFUSED = (
    "Authentication failed.",
    "Voice does not match enrolled user.",
    "Voice may be synthetic or manipulated.",
    "Authentication blocked due to security anomalies.",
    "Authentication blocked due to unusual access pattern.",
    "Multiple security factors did not meet required thresholds.",
)
VOICE = ((0.7, "Voice similarity is very high (%.3f)."), (0.5, "Voice similarity is good (%.3f)."), (float("-inf"), "Voice similarity is low (%.3f)."))
AUTHENTIC = ((0.8, "Voice authenticity is very high (%.3f)."), (0.5, "Voice authenticity is acceptable (%.3f)."), (float("-inf"), "Voice authenticity is questionable (%.3f)."))
ODD = ((3.0, "Significant anomalies detected (%.3f)."), (1.0, "Minor anomalies detected (%.3f)."))
PATTERN = ((3.0, "Unusual authentication pattern detected (%.3f)."), (1.0, "Slightly unusual authentication pattern (%.3f)."))


def components(rows: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """One row per vector component: keys, i, v."""
    return rows.select(*keys, F.posexplode(V.doubles(F.col(vec))).alias("i", "v"))


def gather(cells: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Components back to one array per key, in order of i."""
    ordered = F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("v"))))
    return cells.groupBy(key).agg(F.transform(ordered, lambda x: x["v"]).alias(out))


def enroll(samples: DataFrame, speaker: str, vec: str, normalize_first: bool = False) -> DataFrame:
    """(speaker, centroid): mean per component over a speaker's samples, at length 1.
    With normalize_first samples are brought to length 1 before (class prototypes)."""
    rows = samples.select(speaker, (V.unit(V.doubles(F.col(vec))) if normalize_first else F.col(vec)).alias("vec"))
    means = components(rows, [speaker], "vec").groupBy(speaker, "i").agg(F.avg("v").alias("m"))
    return gather(means, speaker, "m", "centroid").withColumn("centroid", V.unit(F.col("centroid")))


def profile_statistics(samples: DataFrame, speaker: str, vec: str) -> DataFrame:
    """(speaker, i, mean, n): the mean part of a profile."""
    return components(samples, [speaker], vec).groupBy(speaker, "i").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def profile_covariance(samples: DataFrame, sample: str, speaker: str, vec: str, dims: int) -> DataFrame:
    """(speaker, i, j, cov), sample covariance of the first dims components, i <= j. Each
    sample's components are paired in its own row, so nothing is joined."""
    v = V.doubles(F.col(vec))
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v[i].alias("x"), v[j].alias("y")) for i in range(dims) for j in range(i, dims)]
    rows = samples.select(speaker, F.explode(F.array(*pairs)).alias("p")).select(speaker, "p.*")
    return rows.groupBy(speaker, "i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def merge_profiles(old: DataFrame, new: DataFrame, speaker: str) -> DataFrame:
    """Count-weighted mean of two profile_statistics(); a speaker in one alone stays."""
    both = old.unionByName(new)
    return both.groupBy(speaker, "i").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def verify(attempts: DataFrame, enrolled: DataFrame, speaker: str, vec: str) -> DataFrame:
    """Attempts with similarity to the enrolled centroid; unknown speakers fall out."""
    joined = attempts.join(enrolled, speaker)
    return joined.withColumn("similarity", V.cosine(V.doubles(F.col(vec)), F.col("centroid")))


def identify(attempts: DataFrame, enrolled: DataFrame, speaker: str, vec: str, keep: list[str]) -> DataFrame:
    """Each attempt against every enrolled speaker, attempts x speakers rows by its nature. The
    gallery is counted; blocks of GALLERY speakers at most are sent to the tasks, one plan a block."""
    gallery = enrolled.select(F.col(speaker).alias("candidate"), "centroid")
    size = gallery.count()
    blocks = max(1, -(-size // GALLERY))
    if blocks > 1:
        gallery = written(gallery, "gallery").withColumn("block", F.pmod(F.xxhash64("candidate"), F.lit(2 * blocks)))
        parts = [gallery.where(F.col("block") == b).drop("block") for b in range(2 * blocks)]
    else:
        parts = [gallery]
    score = V.cosine(V.doubles(F.col(vec)), F.col("centroid")).alias("similarity")
    return reduce(DataFrame.union, [attempts.crossJoin(F.broadcast(p)).select(*keep, speaker, "candidate", score) for p in parts])


def policy(similarity: Column, spoof: Column, anomaly: Column, sequence_anomaly: Column, threshold: float = 0.7, spoof_threshold: float = 0.5, liveness_required: bool = True) -> Column:
    """Similar enough, live if that is required, and no anomaly of either kind."""
    live = spoof >= spoof_threshold if liveness_required else F.lit(True)
    return (similarity >= threshold) & live & ~(anomaly | sequence_anomaly)


def score_verification(similarity: Column, pdf: Column, threshold: float) -> Column:
    """A struct of likelihood, combined score, verdict, confidence and borderline flag."""
    likelihood = 1 - F.exp(-pdf * 1e6)
    combined = 0.7 * similarity + 0.3 * likelihood
    confidence = F.when(combined >= threshold, (combined - threshold) / (1 - threshold)).otherwise(1 - (threshold - combined) / threshold)
    return F.struct(
        likelihood.alias("likelihood"), combined.alias("combined"), (combined >= threshold).alias("verified"),
        V.clamp(confidence).alias("confidence"), (F.abs(combined - threshold) < 0.1).alias("borderline"),
    )


def liveness(scores: dict[str, Column], threshold: float = 0.7) -> Column:
    """A struct of the weighted liveness score, the verdict and its confidence."""
    score = V.weighted([scores[k] for k in LIVENESS_WEIGHTS], list(LIVENESS_WEIGHTS.values()))
    confidence = F.when(score >= threshold, (score - threshold) / (1 - threshold)).otherwise((threshold - score) / threshold)
    return F.struct(score.alias("score"), (score >= threshold).alias("is_live"), V.clamp(confidence).alias("confidence"))


def _tiered(tiers: tuple[tuple[float, str], ...], score: Column) -> Column:
    """The text of the first tier whose bound the score reaches; null if none."""
    out = F.lit(None).cast("string")
    for bound, text in reversed(tiers):
        out = F.when(score >= bound, F.format_string(text, score) if "%" in text else F.lit(text)).otherwise(out)
    return out


def explanation(similarity: Column, spoof: Column, anomaly: Column, sequence: Column, accepted: Column) -> Column:
    """The sentences that explain a decision. A null spoof score, and anomaly or sequence
    scores of 0, have no sentence. Scores are not negative."""
    outcome = F.when(accepted, ACCEPTED[0]).otherwise(REFUSED[0])
    reason = (
        F.when(accepted, ACCEPTED[1])
        .when(similarity < 0.5, REFUSED[1])
        .when(spoof < 0.5, REFUSED[2])
        .when(anomaly >= 3.0, REFUSED[3])
        .when(sequence >= 3.0, REFUSED[4])
        .otherwise(REFUSED[5])
    )
    return F.concat_ws(" ", outcome, _tiered(VOICE, similarity), _tiered(AUTHENTIC, spoof), _tiered(ODD, anomaly), _tiered(PATTERN, sequence), reason)


def factors(similarity: Column, spoof: Column, anomaly: Column, sequence: Column) -> Column:
    """The list of (factor, score); anomaly and sequence count only when not 0, as
    1 - clamp(score)."""
    named = lambda name, score: F.struct(F.lit(name).alias("factor"), score.alias("score"))
    every = F.array(
        named("voice_similarity", similarity), F.when(spoof.isNotNull(), named("antispoofing", spoof)),
        F.when(anomaly != 0, named("anomaly", 1 - V.clamp(anomaly))), F.when(sequence != 0, named("sequence", 1 - V.clamp(sequence))),
    )
    return F.filter(every, lambda x: x.isNotNull())
