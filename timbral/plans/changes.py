"""Registered queries of devices, lines and styles over the users' streams of values as samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.functions import devices, styles
from timbral.functions.augmentation import seed_of
from timbral.plans.acoustics import VOICE, each, voices
from timbral.plans.queries import query, r6

OWN = {"pocket": devices.Profile(8000, 10, ((0.0, 0.2), (500.0, 1.0), (4000.0, 0.5)), -40.0, "mp3_low", 0.5)}


def one_of(names: tuple[str, ...]) -> Column:
    """A name by the user's id."""
    return F.get(F.array(*map(F.lit, names)), F.pmod("user_id", F.lit(len(names))).cast("int"))


def seed(name: str) -> Column:
    return seed_of(F.col("user_id"), F.lit(name))


def changed(spark: SparkSession, sf: str, function, *more: Column) -> DataFrame:
    return each(voices(spark, sf).select("user_id", function(F.col("x"), *more)["y"].alias("y")), "y", "y")


@query()
def device_voices(spark, sf):
    known = devices.PROFILES | OWN
    return changed(spark, sf, devices.device(16000, known), seed("device"), one_of(tuple(known)))


@query()
def line_voices(spark, sf):
    return changed(spark, sf, devices.line(8000), seed("line"), one_of(("gsm", "g711", "g729", "voip")))


@query()
def stressed_voices(spark, sf):
    return changed(spark, sf, styles.stress(16000, 0.8, 32, 8))


@query()
def aged_voices(spark, sf):
    return changed(spark, sf, styles.age(16000, 75, 48, 12), seed("age"), F.lit("any"))


@query()
def moody_voices(spark, sf):
    return changed(spark, sf, styles.mood(16000, 32, 8), seed("mood"), one_of(("happy", "sad", "angry", "fear", "neutral")))


@query()
def perturbed_voices(spark, sf):
    return changed(spark, sf, styles.vocal_tract(1.1, 32, 8))


@query(f"with {VOICE} select user_id, cast(i as int) as i, round(0.3::double * x + 0.7::double * 0.5::double * coalesce(lag(x, 2) over (partition by user_id order by i), 0), 6) as y from voice")
def wet_mix(spark, sf):
    """Seven tenths of an echo two samples later, half as loud."""
    late = lambda x: F.transform(x, lambda v, i: 0.5 * F.when(i >= 2, F.get(x, i - 2)).otherwise(0.0))
    found = voices(spark, sf).select("user_id", styles.mixed(F.col("x"), late(F.col("x")), 0.7).alias("y"))
    return found.select("user_id", F.posexplode("y").alias("i", "y")).select("user_id", "i", r6("y").alias("y"))
