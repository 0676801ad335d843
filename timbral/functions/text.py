"""Column functions over transcripts and challenges."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normalize_text(text: Column) -> Column:
    """Without . , ; : ! ? and -, runs of white space as one space, trimmed, lower-cased."""
    bare = F.translate(text, ".,;:!?-", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")))


def session_id(seed: Column) -> Column:
    """16 hexadecimal digits of the SHA-256 of a seed text."""
    return F.substring(F.sha2(seed, 256), 1, 16)


def verification_hash(session: Column, expected: Column, created: Column) -> Column:
    """SHA-256 of session:expected:time."""
    return F.sha2(F.concat_ws(":", session, expected, created), 256)


def spoken_digits(digits: Column) -> Column:
    """Groups of three if there are more than five digits, else single ones."""
    return F.regexp_replace(digits, F.when(F.length(digits) > 5, F.lit("(.{3})(?=.)")).otherwise(F.lit("(.)(?=.)")), F.lit("$1 "))


def reading_seconds(text: Column) -> Column:
    """A tenth of a second for each character and two more, from 3 to 10."""
    return F.least(F.lit(10.0), F.greatest(F.lit(3.0), F.length(text) / 10 + 2))


def phonemes(word: Column) -> Column:
    """Up to six pseudo-phonemes, one for each leading character, with start ratios."""
    k = F.least(F.greatest(F.length(word), F.lit(1)), F.lit(6))
    return F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.struct(F.substring(word, i + 1, F.lit(1)).alias("phoneme"), (i / k).alias("start"), ((i + 1) / k).alias("end")),
    )


@F.pandas_udf(DoubleType())
def sequence_ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """2M / T, M the characters in matching blocks of the two texts, T all characters."""
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: Similarity asked for by difficulty.
VERDICT_THRESHOLDS = {"easy": 0.7, "medium": 0.8, "hard": 0.9}


def challenge_verdict(similarity: Column, difficulty: Column, now: Column, expires_at: Column) -> Column:
    """Similar enough for the difficulty, and not expired (equality is still valid)."""
    threshold = F.lit(0.8)
    for name, value in VERDICT_THRESHOLDS.items():
        threshold = F.when(difficulty == name, F.lit(value)).otherwise(threshold)
    return (similarity >= threshold) & (now <= expires_at)
