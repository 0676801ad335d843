"""A corpus pipeline of five stages, each over all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and reread as the next one's docs. All but the last return the
columns of documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.llm import bpe, lines, mixing, quality, simhash
from timbral.llm.queries import tokenizer
from timbral.llm.shared import free_name, settle
from timbral.session import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that other documents repeat; one without any line left goes."""
    kept = lines.line_dedup(docs)
    n_lines, n_dropped = kept.columns[-2:]  # they have other names where docs has these
    rest = kept.where((F.col(n_dropped) < F.col(n_lines)) | (F.col(n_dropped) == 0))
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies: documents whose
    SimHash fingerprints over five-word shingles differ in 2 bits or fewer, or whose sets of these
    shingles have a Jaccard similarity of 0.8 or more."""
    return simhash.simhash_near_dedup(docs, size=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = mixing.mix(docs)
    times = F.array_repeat(F.lit(0), F.col(mixed.columns[-2]).cast("int"))
    return mixed.withColumn(free_name(docs.columns, "copy"), F.explode(times)).select(docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and digests of its ids and of the bytes they decode to."""
    return bpe.round_trip_digests(docs, *tokenizer())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_texts),
]

#: The classifier and the mix are not to be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
