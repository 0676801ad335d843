"""Annotations, challenges and sessions of spoken verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annotate_words(texts: DataFrame, keys: list[str], text: str, duration: Column) -> DataFrame:
    """(keys, word_no, word, start, end, sentence_no): evenly spaced word times; a sentence
    ends with a word that ends in . ! or ?."""
    bare = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+"))
    rows = texts.select(*keys, duration.alias("d"), words.alias("w")).select(*keys, "d", F.size("w").alias("n"), F.posexplode("w").alias("word_no", "word"))
    ends = F.col("word").rlike(r"[.!?]$").cast("int")
    before = Window.partitionBy(*keys).orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("d") / F.col("n")
    rows = rows.withColumn("sentence_no", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    return rows.select(*keys, "word_no", "word", (F.col("word_no") * step).alias("start"), ((F.col("word_no") + 1) * step).alias("end"), "sentence_no")


def annotate(texts: DataFrame, keys: list[str], text: str, duration: Column) -> DataFrame:
    """(keys, sentences): sentences with their words, in order."""
    words = annotate_words(texts, keys, text, duration)
    by_sentence = words.groupBy(*keys, "sentence_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "word", "start", "end"))).alias("words"))
    ordered = F.array_sort(F.collect_list(F.struct("sentence_no", "words")))
    return by_sentence.groupBy(*keys).agg(ordered.alias("sentences"))


def match_responses(responses: DataFrame, challenges: DataFrame, session: str, now: str, expires: str) -> DataFrame:
    """Each response with status: invalid (no such session), expired (after the
    challenge's end) or open."""
    known = challenges.select(session, expires)
    joined = responses.join(known, session, "left")
    status = F.when(F.col(expires).isNull(), "invalid").when(F.col(now) > F.col(expires), "expired").otherwise("open")
    return joined.withColumn("status", status)


def session_states(events: DataFrame, session: str, order: list[str], ok: Column, retries: int = 3) -> DataFrame:
    """(session, state, attempts): verified at the first success among the first
    retries + 1 attempts, failed once those are used up, else pending."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    rows = events.withColumn("place", place).withColumn("ok", ok).where(F.col("place") <= retries + 1)
    seen = rows.groupBy(session).agg(F.min(F.when(F.col("ok"), F.col("place"))).alias("won"), F.max("place").alias("n"))
    state = F.when(F.col("won").isNotNull(), "verified").when(F.col("n") > retries, "failed").otherwise("pending")
    return seen.select(session, state.alias("state"), F.coalesce("won", "n").alias("attempts"))


def catalog(files: DataFrame, sidecars: DataFrame, key: str) -> DataFrame:
    """Files with their sidecar's fields; without one: participant unknown, quality 0
    and no transcript. A sidecar key stands once."""
    found = files.join(sidecars, key, "left")
    return found.withColumns({
        "participant_id": F.coalesce("participant_id", F.lit("unknown")),
        "quality_score": F.coalesce("quality_score", F.lit(0.0)),
        "has_transcript": F.coalesce("has_transcript", F.lit(False)),
    })
