"""Periodic runs of words: maximal repetitions found through Lyndon arrays of two opposite orders.

Every run has a root that is the longest Lyndon word at its place in one of the two orders, so
each edge from a suffix to its next smaller suffix gives one candidate: its period is the edge's
length, and how far both ends match to the right and to the left gives the run's bounds. Both
kinds of matches are found in linear time by copying what an earlier match has shown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbral.llm.shared import free_name, slices, text_bytes

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def lyndon_edges(words: list[int]) -> tuple[list[int], list[int]]:
    """For each place the place of the next smaller suffix (the Lyndon array, as ends), and the
    number of words that both suffixes share.

    The first word must be smaller than all that follow it, and the last must occur once. Place r
    is compared with r - 1 and then along the previous smaller suffixes. What two of those share
    with each other says what they share with r, except where it is equally much; only there are
    words compared. If r lies in a stretch [near, far) that was matched with the words `shift`
    before it, the same pair was compared there, and only words from `far` on are read: each word
    is read once as the right one of a successful comparison.
    """
    n = len(words)
    following, previous = [n] * n, [0] * n
    shared, shared_before = [0] * n, [0] * n
    near = far = shift = 0
    for r in range(1, n):
        x, left = words[r], r - 1
        while True:
            while words[left] > x:
                following[left] = r
                left = previous[left]
            if words[left] < x:
                break
            same, known = 1, False
            while True:
                if not known:
                    if r + same < far and left >= near:
                        a, b = left - shift, r - shift
                        seen = shared[a] if following[a] == b else shared_before[b] if previous[b] == a else same
                        same = max(same, min(seen, far - r))
                    i, j = left + same, r + same
                    while words[i] == words[j]:
                        i += 1
                        j += 1
                    same = j - r
                    if j >= far:
                        near, far, shift = r, j, r - left
                if words[left + same] < words[r + same]:
                    break
                following[left], shared[left] = r, same
                between, left = shared_before[left], previous[left]
                if between < same:
                    same = between
                    break
                known = between > same
            shared_before[r] = same
            break
        previous[r] = left
    return following, shared


def left_matches(words: list[int], following: list[int], edges: list[int]) -> list[int]:
    """How many words before each place of `edges` (descending) equal those before its next
    smaller suffix; 0 for all other places, whose words before differ.

    While a place lies in [low, top), which was matched with the words `shift` after it, its edge
    is there too; its match is copied, and only words before `low` are read.
    """
    found = [0] * len(words)
    low = top = len(words)
    shift = 0
    for left in edges:
        right = following[left]
        i = left - 1
        if left > low and right <= top:
            seen = found[left + shift]
            if left - seen > low:
                found[left] = seen
                continue
            i = low - 1
        j = i + right - left
        while words[i] == words[j]:
            i -= 1
            j -= 1
        found[left] = left - 1 - i
        if i < low:
            low, top, shift = i + 1, left, right - left
    return found


def runs_of(ranks: np.ndarray, bounds: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of the runs in several texts, by start and period.

    Text k's words are ranks[bounds[k]:bounds[k + 1]], 0 or more each; starts count from 0 over
    all. No run crosses a bound. Separators that occur once stand between the texts and end every
    match; they are smaller than all words in both orders.
    """
    k = len(bounds) - 1
    at = np.arange(len(ranks)) + np.repeat(np.arange(1, k + 1), np.diff(bounds))
    n = len(ranks) + k + 1
    found = []
    for order in (ranks, (ranks.max(initial=0)) - ranks):
        padded = np.empty(n, np.int64)
        padded[bounds + np.arange(k + 1)] = np.arange(-k - 1, 0)
        padded[at] = order
        words = padded.tolist()
        ends, shared = lyndon_edges(words)
        ends_, shared_ = np.array(ends), np.array(shared)
        before = at[padded[at - 1] == padded[ends_[at] - 1]]
        back = np.array(left_matches(words, ends, before[::-1].tolist()))
        period = ends_ - np.arange(n)
        length = back + period + shared_
        # a root with a whole period before it is not its run's first root
        good = at[((back < period) & (length >= np.maximum(least_length, max(2, least_exponent) * period)))[at]]
        found.append(np.stack([good - back[good], length[good], period[good]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    runs[:, 0] -= np.searchsorted(bounds + np.arange(k + 1), runs[:, 0], side="left")
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _ranks(words: list[bytes]) -> np.ndarray:
    """The words' ranks in the order of their bytes, by sorting."""
    return pc.rank(pa.array(words, pa.binary()), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def _kept(runs: np.ndarray, n: int) -> np.ndarray:
    """Which words no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def described(texts: list[bytes], least_length: int, least_exponent: int) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    """Each text's number of words, its runs and the words that stay, joined by one space."""
    split = [t.split() for t in texts]
    sizes = [len(s) for s in split]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = [w for s in split for w in s]
    runs = runs_of(_ranks(words) if words else np.zeros(0, np.int64), bounds, least_length, least_exponent)
    parts = np.searchsorted(runs[:, 0], bounds)
    own, joined = [], []
    for i, s in enumerate(split):
        here = runs[parts[i] : parts[i + 1]] - [bounds[i], 0, 0]
        own.append(here)
        joined.append(b" ".join(s) if not len(here) else b" ".join(s[j] for j in np.flatnonzero(_kept(here, len(s)))))
    return sizes, own, joined


def periodic_runs(docs: DataFrame, text_col: str = "text", least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """docs with n_words, runs and collapsed of each whole text.

    Words are runs of bytes outside ASCII white space, compared as bytes. A run is a stretch of
    words with smallest period p, of at least least_length words and least_exponent (2 or more)
    periods, that no neighbouring word extends with the same period; runs holds (start, length,
    period) by start and period, all of them. collapsed is the text without the words that a run
    repeats: those after its first period, in any run; words are joined by one space.

    A null, empty or blank text has no words, no runs and an empty collapsed. Repeated rows repeat,
    other columns stay, and names that are taken get underscores. A text is worked on whole in one
    task, in time and memory linear in its words besides sorting them.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    names = []
    for wish in ("n_words", "runs", "collapsed"):
        names.append(free_name([*docs.columns, *names], wish))
    at = docs.columns.index(text_col)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(at))
            for a, b in slices(texts):
                sizes, own, joined = described(texts[a:b], least_length, least_exponent)
                flat = np.concatenate(own)
                fields = [pa.array(flat[:, i]) for i in range(3)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in own])]), pa.int32())
                runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(run_type.value_type)))
                columns = [pa.array(sizes, pa.int64()), runs, pa.array(joined, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *columns], [*batch.schema.names, *names])

    added = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T._parse_datatype_string(RUN)), T.StructField(names[2], T.StringType())]
    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, *added]))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first; null if none."""
    ahead = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN[6:-1]), lambda best, run: F.when(ahead(best, run), run).otherwise(best))


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, n_runs, the strongest run (start, length, period and
    exponent_milli, nulls without runs), runs_sha256 and collapsed_sha256, as by periodic_runs()."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = periodic_runs(kept, "text", least_length, least_exponent)
    line = lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])
    listing = F.array_join(F.transform("runs", lambda run: F.concat(line(run), F.lit("\n"))), "")
    best = found.select("doc_id", "runs", F.sha2("collapsed", 256).alias("collapsed_sha256"), F.sha2(listing, 256).alias("runs_sha256"), strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


WORD = r"[^\x20\x09-\x0D]+"


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in which one text in ten, by the CRC-32 h of its decimal id, repeats: with g = h div 10
    and n words, each word i from a = g mod n on becomes word a + (i - a) mod p of the text, where
    p = 1 + (n - a) div (3 + g mod 8). A null id, or a text without words, changes nothing."""
    words = free_name(docs.columns, "words")
    h, n = F.crc32(F.col(id_col).cast("string")), F.size(words).cast("long")
    g = F.floor(h / 10).cast("long")
    a = g % n
    p = F.floor((n - a) / (3 + g % 8)).cast("long") + 1
    place = lambda w, i: F.when(i < a, w).otherwise(F.get(F.col(words), (a + (i - a) % p).cast("int")))
    cut = docs.withColumn(words, F.when(h % 10 == 0, F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))))
    text = F.when(n > 0, F.array_join(F.transform(words, place), " ")).otherwise(F.col(text_col))
    return cut.withColumn(text_col, text).drop(words)
