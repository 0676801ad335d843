"""Scores of recordings from features that are columns, and the gates built on them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.functions import batches
from timbral.functions import vectors as V
from timbral.functions.batches import on_signals

#: Weights and ideal ranges of the micro-modulation score.
MICRO = {"pitch": (0.3, 0.7, 0.95), "envelope": (0.15, 0.05, 0.2), "tremor": (0.15, 0.01, 0.1), "jitter": (0.2, 0.005, 0.02), "shimmer": (0.2, 0.04, 0.2)}
#: Bandwidth by frequency of the first four formants, and the range of the tilt.
FORMANT_RATIOS, TILT = (0.06, 0.08, 0.1, 0.12), (-10.0, -6.0)
#: Coefficients of variation of formants and of their deltas.
IDEAL_CV, IDEAL_DELTA = (0.05, 0.08, 0.1, 0.12), (0.3, 0.4, 0.5, 0.6)
#: Weight, plateau, and centre and width beyond it, of the environment score.
ENVIRONMENT = {"reverb": (0.15, 0.3, 1.2, 0.75, 0.75), "deviation": (0.15, 0.1, 0.3, 0.2, 0.2), "noise_level": (0.1, -80.0, -40.0, -60.0, 40.0), "band_ratio": (0.15, 1.0, 3.0, 2.0, 2.0)}
#: The same for the spectrum score.
SPECTRUM = {"flux": (0.15, 0.1, 0.5, 0.3, 0.3), "entropy": (0.1, 3.0, 5.0, 4.0, 2.0), "modulation": (0.1, 0.5, 2.0, 1.25, 1.25), "correlation": (0.1, 0.3, 0.7, 0.5, 0.5), "contrast": (0.1, 1.0, 3.0, 2.0, 2.0)}


def plateau(x: Column, low: float, high: float, centre: float, width: float) -> Column:
    """1 from low to high, beyond that falling with the distance from centre, to 0."""
    return F.when(x.between(low, high), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(x - centre) / width))


def closeness(x: Column, ideal: Column) -> Column:
    """1 at the ideal, falling to 0 at a relative distance of 1."""
    return 1 - F.least(F.lit(1.0), F.abs(x - ideal) / ideal)


def micro_modulation(features: dict[str, Column]) -> Column:
    """P10: weighted range scores of pitch stability, envelope, tremor, jitter and shimmer."""
    return V.weighted([V.range_score(features[c], low, high) for c, (_, low, high) in MICRO.items()], [w for w, _, _ in MICRO.values()])


def resonance(continuity: Column, variability: Column, ratios: Column, tilt: Column) -> Column:
    """P11 from arrays of scores by formant, four bandwidth ratios and the spectral tilt."""
    mean = lambda a: V.total(a) / F.size(a)
    near = F.zip_with(ratios, F.array(*map(F.lit, FORMANT_RATIOS)), closeness)
    low, high = TILT
    outside = F.when(tilt < low, (low - tilt) / abs(low)).when(tilt > high, (tilt - high) / abs(high)).otherwise(0.0)
    return V.weighted([mean(continuity), mean(variability), mean(near), 1 - F.least(F.lit(1.0), outside)], [0.35, 0.3, 0.2, 0.15])


def environment(features: dict[str, Column]) -> Column:
    """Plateau scores, and 1 - noise_consistency, noise_floor_stability and cutoff; an
    unknown band_ratio counts half."""
    flat = [F.coalesce(plateau(features[c], *spec), F.lit(0.5)) if c == "band_ratio" else plateau(features[c], *spec) for c, (_, *spec) in ENVIRONMENT.items()]
    rest = [1 - features["noise_consistency"], features["noise_floor_stability"], features["cutoff"]]
    return V.weighted([*flat, *rest], [*[w for w, *_ in ENVIRONMENT.values()], 0.15, 0.1, 0.2])


def spectrum(features: dict[str, Column]) -> Column:
    """Plateau scores, and what is left of harmonic artifacts and phase coherence, and the
    group delay's deviation."""
    flat = [plateau(features[c], *spec) for c, (_, *spec) in SPECTRUM.items()]
    rest = [1 - features["artifacts"], 1 - features["coherence"], features["delay"]]
    return V.weighted([*flat, *rest], [*[w for w, *_ in SPECTRUM.values()], 0.15, 0.15, 0.15])


def match_tier(vector: Column, dtw: Column) -> tuple[Column, Column]:
    """(combined, likelihood) of two similarities: high above 0.8, medium above 0.6."""
    combined = 0.7 * vector + 0.3 * dtw
    return combined, F.when(combined > 0.8, "high").when(combined > 0.6, "medium").otherwise("low")


def formant_variability(cv: Column, delta: Column, formant: Column) -> Column:
    """How near a formant's variation is to the ideal; formant counts from 1."""
    ideal = lambda values: F.element_at(F.array(*map(F.lit, values)), formant)
    return 0.6 * closeness(cv, ideal(IDEAL_CV)) + 0.4 * closeness(delta, ideal(IDEAL_DELTA))


def live_gate(samples: DataFrame, keys: list[str], live: Column) -> DataFrame:
    """Per key the samples, the live ones, and whether they suffice to enrol: three, and
    half of all, at least."""
    n = samples.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(live).alias("n_live"))
    return n.withColumn("accepted", F.col("n_live") >= F.greatest(F.lit(3), F.floor(F.col("n") / 2)))


def feature_checks(tracks: DataFrame, keys: list[str], f0: str, cepstrum: str) -> DataFrame:
    """Of each track no missing or infinite value, a pitch whose deviation is under half its
    mean, pitches over 0, and a cepstrum deviation under 3; the share of checks passed, and
    valid from 0.7 on."""
    ok = [F.count_if(V.has_nan_or_inf(F.array(f0, cepstrum)) | F.col(f0).isNull()) == 0, F.stddev_pop(f0) / F.avg(f0) < 0.5, F.min(f0) > 0, F.stddev_pop(cepstrum) < 3]
    checked = tracks.groupBy(*keys).agg(*[c.alias(f"ok{i}") for i, c in enumerate(ok)])
    score = sum((F.coalesce(F.col(f"ok{i}"), F.lit(False)).cast("int") for i in range(len(ok))), F.lit(0)) / len(ok)
    return checked.withColumn("score", score).withColumn("valid", F.col("score") >= 0.7)


def deploys(log: DataFrame, keys: list[str], order: list[str], higher: list[str], lower: list[str], least: float = 0.01) -> DataFrame:
    """A log row deploys when it is the first, or a metric improves on the row before by
    more than `least`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    better = [F.col(c) - F.lag(c).over(w) > least for c in higher] + [F.lag(c).over(w) - F.col(c) > least for c in lower]
    found = better[0]
    for b in better[1:]:
        found = found | b
    return log.withColumn("deploy", (F.row_number().over(w) == 1) | F.coalesce(found, F.lit(False)))


def peaks(rows: DataFrame, keys: list[str], place: str, value: str, height: float, distance: int) -> DataFrame:
    """(keys, peaks) with the places of local maxima of `height` at least, ascending. A
    plateau counts once, at its middle. Of maxima nearer than `distance` the higher stays (of
    equal ones the later), the highest first. Ends are no maxima."""
    cell = F.struct(F.col(place).alias("at"), F.col(value).cast("double").alias("v"))
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    kernel = on_signals(lambda x: {"at": [batches.peaks(r, height, distance) for r in x]}, at="longs")
    found = whole.withColumn("found", kernel(F.transform("cells", lambda c: c["v"]))["at"]).where(F.size("found") > 0)
    return found.select(*keys, F.transform("found", lambda i: F.get(F.col("cells"), i.cast("int"))["at"]).alias("peaks"))


def wrapped(phase: Column) -> Column:
    """The angle between -pi and pi."""
    return F.atan2(F.sin(phase), F.cos(phase))


def recursive_floor(track: Column, keep: float = 0.999) -> Column:
    """Each value's floor, keep times the floor before and the rest of the value; tracks of one
    length advance together."""

    def work(x: np.ndarray) -> dict:
        out = x.copy()
        for k in range(1, x.shape[1]):
            out[:, k] = keep * out[:, k - 1] + (1 - keep) * x[:, k]
        return {"floor": out}

    return on_signals(work, floor="doubles")(track)["floor"]


def uniform(secret: str, *keys: str) -> Column:
    """A number between -0.5 and 0.5, never the ends, from 48 bits of the SHA-256 of a secret and keys:
    who does not know the secret cannot take the noise off again."""
    digest = F.sha2(F.concat_ws(":", F.lit(secret), *[F.col(k).cast("string") for k in keys]), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48) - 0.5


def laplace(uniform: Column, scale: float) -> Column:
    """Laplace noise from a uniform number between -0.5 and 0.5, by the inverse distribution."""
    return -scale * F.signum(uniform) * F.log(1 - 2 * F.abs(uniform))


def margin_logits(cosines: Column, own: Column, scale: float = 30.0, margin: float = 0.2) -> Column:
    """Logit of a class from its cosine; the own class is moved by an angular margin."""
    import math

    moved = cosines * math.cos(margin) - F.sqrt(F.greatest(F.lit(0.0), 1 - cosines * cosines)) * math.sin(margin)
    beyond = cosines - math.sin(math.pi - margin) * margin
    return scale * F.when(own, F.when(cosines > math.cos(math.pi - margin), moved).otherwise(beyond)).otherwise(cosines)


def quantiles(*shares: float):
    """struct(q): quantiles of an array in any order, to the last bit as SQL's quantile_cont gives them: the
    two neighbours by their nearness, in a fused step. (Spark's percentile rounds once more, so that where
    neighbours differ in their last bits it lies on another side of them.)"""

    def work(x: np.ndarray) -> dict:
        x, out = np.sort(x, axis=1), []
        for share in shares:
            at = (x.shape[1] - 1) * share
            low, high, part = x[:, math.floor(at)], x[:, math.ceil(at)], at - math.floor(at)
            out.append([math.fma(a, 1 - part, b * part) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        return {"q": np.array(out).T}

    return on_signals(work, q="doubles")
