"""LM scoring: prediction by partial matching over bytes, trained on the corpus itself."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbral.llm.shared import discard, settle, slices, text_bytes

ORDER = 5
#: Bits of a position within a block: they share one sorted integer with a gram's bits.
PLACE = 64 - 8 * (ORDER + 1)
BLOCK = 1 << PLACE
#: Distinct words that a task counts before it hands its counts on.
WORDS_HELD = 300_000
#: The most frequent words go to every task; all others are joined.
HOT_WORDS = 1 << 18
#: Grams (16 bytes each) that go to every task: all, or the most frequent; the others are joined.
HELD_GRAMS = 9 << 19
END = b"\n"
SEED = 42
GRAM, WORD = 0, 1


class Counts(NamedTuple):
    """What is gathered from the corpus: (key, train, every) of grams, (key, train) of words."""

    grams: DataFrame
    words: DataFrame


def split_words(text: bytes) -> list[bytes]:
    """Runs outside ASCII white space, with A-Z lower-cased."""
    return text.lower().split()


def symbols(words: list[bytes]) -> bytes:
    """What the model codes: the words joined by one space, then an end byte."""
    return b" ".join(words) + END


def gram_keys(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each body, the integer of its ORDER bytes of context (end bytes
    before the start) and itself; and how many symbols each body has."""
    flat = np.frombuffer(b"".join(END * ORDER + b for b in bodies), dtype=np.uint8)
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    keys = np.zeros(max(0, len(flat) - ORDER), dtype=np.uint64)
    for i in range(ORDER + 1):
        keys = keys << np.uint64(8) | flat[i : len(flat) - ORDER + i]
    starts = np.cumsum(sizes + ORDER)[:-1] - ORDER  # where a body's padding makes grams of no symbol
    stay = np.ones(len(keys), dtype=bool)
    for i in range(ORDER):
        stay[starts + i] = False
    return keys[stay], sizes


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first, axis=0) if len(first) else counts


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    ends = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[ends], np.diff(np.r_[-1, ends])


def hash_words(words) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), dtype=np.uint64)


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def gather(docs: DataFrame) -> Counts:
    """Counts over every row of docs (doc_id, text, held_out); train counts leave out held_out.

    Tasks sum what they have before the shuffle, so a frequent gram or word costs a row a task.
    Words count under their 64-bit hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "train", "every"]

        def rows(kind: int, keys: np.ndarray, train: np.ndarray, every: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 17):
                at = slice(i, i + (1 << 17))
                columns = [keys[at].view(np.int64), train[at].astype(np.int64), every[at].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, dtype=np.int32)), *map(pa.array, columns)], names)

        def words_held() -> Iterator[pa.RecordBatch]:
            n = np.fromiter(words.values(), dtype=np.int64, count=len(words))
            yield from rows(WORD, hash_words(words), n, n)
            words.clear()

        def merge() -> None:
            nonlocal keys, counts
            keys, counts = _summed(np.concatenate([keys, *[k for k, _ in fresh]]), np.concatenate([counts, *[n for _, n in fresh]]))
            fresh.clear()

        words: Counter = Counter()
        fresh: list = []
        keys, counts = np.zeros(0, dtype=np.uint64), np.zeros((0, 2), dtype=np.int64)
        for batch in batches:
            texts, held = text_bytes(batch.column(0)), batch.column(1).to_pylist()
            for i, j in slices(texts):
                split = [split_words(t) for t in texts[i:j]]
                for out, column in ((False, [0, 1]), (True, [1])):
                    k, n = _counted(gram_keys([symbols(w) for w, h in zip(split, held[i:j], strict=True) if h == out])[0])
                    more = np.zeros((len(k), 2), dtype=np.int64)
                    more[:, column] = n[:, None]
                    fresh.append((k, more))
                for w, h in zip(split, held[i:j], strict=True):
                    if not h:
                        words.update(w)
                        words[END] += 1
                        if len(words) > WORDS_HELD:
                            yield from words_held()
                if sum(len(k) for k, _ in fresh) > 1 << 20:
                    merge()
            merge()
            if len(keys) > 1 << 21:
                yield from rows(GRAM, keys, counts[:, 0], counts[:, 1])
                keys, counts = keys[:0], counts[:0]
        yield from rows(GRAM, keys, counts[:, 0], counts[:, 1])
        yield from words_held()

    partial = docs.select("text", "held_out").mapInArrow(run, "kind int, key long, train long, every long")
    both = settle(partial.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("every").alias("every")), "ppm-counts")
    return Counts(both.where(F.col("kind") == GRAM).select("key", "train", "every"), both.where(F.col("kind") == WORD).select("key", "train"))


def _bounded(rows: DataFrame, width: int) -> DataFrame:
    """Broadcast rows with one row for each string of `width` bytes, where those are few."""
    return F.broadcast(rows) if width <= 2 else rows


def gram_scores(grams: DataFrame) -> DataFrame:
    """(key, logp): log10 of each gram's symbol given its context, for all grams of the corpus.

    The trie is a table per order, made from the trained counts of the next. Coding starts at
    the longest context that training met. A context with total T and d symbols codes a symbol
    that followed it c times with (2c - 1) / 2T, and escapes with d / 2T (method D). After an
    escape the symbols of the longer context are excluded from T and d; they are among those of
    the shorter one, so a context pair's excluded sums fit in one row. A symbol never met is
    one of 256 - d at the root.
    """
    seen = [None] * (ORDER + 1)
    level = grams.where("train > 0").select("key", F.col("train").alias("c"))
    for j in range(ORDER, -1, -1):
        mask = (1 << 8 * (j + 1)) - 1
        key = F.col("key").bitwiseAND(mask)
        level = seen[j] = settle(level.groupBy(key.alias("key")).agg(F.sum("c").alias("c")), f"ppm-order{j}")
    context = F.shiftright("key", 8)
    after = [x.groupBy(context.alias("ctx")).agg(F.sum("c").alias("t"), F.count("*").alias("d")) for x in seen]

    rows = grams.select("key", F.lit(0.0).alias("logp"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("et"), F.lit(None).cast("long").alias("ed"))
    for j in range(ORDER, -1, -1):
        mask = (1 << 8 * (j + 1)) - 1
        rows = rows.withColumns({"k": F.col("key").bitwiseAND(mask), "x": F.shiftright(F.col("key").bitwiseAND(mask), 8)})
        hit = seen[j].select(F.col("key").alias("k"), "c")
        stats = after[j].select(F.col("ctx").alias("x"), "t", "d")
        rows = rows.join(_bounded(hit, j + 1), "k", "left").join(_bounded(stats, j), "x", "left")
        # et, ed: what the longer context's symbols make up of this context's t and d
        t, d = F.col("t") - F.coalesce("et", F.lit(0)), F.col("d") - F.coalesce("ed", F.lit(0))
        step = F.when(F.col("c").isNotNull(), F.log10((2 * F.col("c") - 1) / (2 * t))).when(F.col("t").isNull() | (t == 0), 0.0).otherwise(F.log10(d / (2 * t)))
        rows = rows.select("key", F.when(F.col("done"), F.col("logp")).otherwise(F.col("logp") + step).alias("logp"), (F.col("done") | F.col("c").isNotNull()).alias("done"))
        if j:
            shorter = seen[j].select(F.col("key").bitwiseAND(mask >> 8).alias("k"), context.alias("y"))
            excluded = shorter.join(seen[j - 1].select(F.col("key").alias("k"), "c"), "k").groupBy("y").agg(F.sum("c").alias("et"), F.count("*").alias("ed"))
            rows = rows.withColumn("y", F.shiftright(F.col("key").bitwiseAND(mask), 8)).join(_bounded(excluded, j), "y", "left").drop("y")
        else:
            symbols_met = after[0].agg(F.coalesce(F.sum("d"), F.lit(0)).alias("met"))
            rows = rows.crossJoin(F.broadcast(symbols_met))  # one row
    fresh = F.col("logp") - F.log10(F.greatest(256 - F.col("met"), F.lit(1)))
    scores = settle(rows.select("key", F.when(F.col("done"), F.col("logp")).otherwise(fresh).alias("logp")), "ppm-scores")
    discard(*seen)
    return scores


def _looked_up(keys: np.ndarray, table: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """logp of each key, 0 for one that is not in the sorted table; and whether it is there."""
    out, known = np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
    if not len(table):
        return out, known
    for i in range(0, len(keys), BLOCK):
        block = keys[i : i + BLOCK]
        packed = np.sort(block << np.uint64(PLACE) | np.arange(len(block), dtype=np.uint64))
        sorted_keys = packed >> np.uint64(PLACE)
        first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
        once, times = sorted_keys[first], np.diff(np.r_[first, len(block)])
        at = np.minimum(np.searchsorted(table, once), len(table) - 1)
        there, place = table[at] == once, i + (packed & np.uint64(BLOCK - 1)).astype(np.int64)
        out[place] = np.repeat(np.where(there, logp[at], 0.0), times)
        known[place] = np.repeat(there, times)
    return out, known


def _sorted_arrays(rows: DataFrame, value: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """A table of checked size as arrays, sorted by key."""
    found = rows.select("key", value).toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column(value).to_numpy()[order].astype(kind)


def _hot_from(counted: DataFrame, count: str, most: int) -> int:
    """The least count of words or grams so frequent that there are `most` of them at most. Counts are
    told apart by eighths of a power of two, so a few hundred sums decide and nothing is sorted."""
    class_ = F.floor(F.log2(count) * 8)
    classes = counted.groupBy(class_.alias("class")).agg(F.count("*").alias("n"), F.min(count).alias("least")).collect()
    found, least = 0, 1 << 62
    for c in sorted(classes, key=lambda c: -c["class"]):
        found += c["n"]
        if found > most:
            break
        least = c["least"]
    return least


def ppm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    and score.

    Tokens are a text's words and one end. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1)))
    over them, from the trained counts. score is the PPM model's log10 probability of the same
    words, as bytes joined by single spaces and ended. A null or empty text is one end token.
    A null id trains. Repeated rows train and score each by itself; other columns go. An empty
    table gives no rows; without training rows all symbols are alike and every c is 0.

    The trie and the vocabulary are tables. The most frequent words and grams go to the tasks as
    arrays. The others, which are rare, leave the tasks by their occurrences and are joined.
    """
    spark = docs.sparkSession
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), is_held_out(F.col(id_col)).alias("held_out"))
    counts = gather(wanted)
    scores = gram_scores(counts.grams)
    total, distinct = counts.words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count("*")).first()
    hot = counts.words.where(F.col("train") >= _hot_from(counts.words, "train", HOT_WORDS))
    held, hot_scores = scores.count() <= HELD_GRAMS, scores
    if not held:
        frequent = counts.grams.where(F.col("every") >= _hot_from(counts.grams, "every", HELD_GRAMS))
        hot_scores = scores.join(frequent.select("key"), "key", "left_semi")
    sent = spark.sparkContext.broadcast((_sorted_arrays(hot, "train", np.int64), _sorted_arrays(hot_scores, "logp", np.float64)))
    below = np.log10(total + 0.5 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot_keys, hot_counts), model = sent.value
        hot_logs = np.log10(hot_counts + 0.5) - below

        def scored(batch: pa.RecordBatch, texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            columns: list = [[], [], [], []]
            for words in texts:
                found = Counter(words)
                found[END] += 1
                n = np.fromiter(found.values(), dtype=np.int64, count=len(found))
                keys = hash_words(found)
                at = np.minimum(np.searchsorted(hot_keys, keys), max(0, len(hot_keys) - 1))
                known = hot_keys[at] == keys if len(hot_keys) else np.zeros(len(keys), dtype=bool)
                columns[0].append(len(words) + 1)
                columns[1].append(int(n[known].sum()))
                columns[2].append(float((n[known] * hot_logs[at[known]]).sum()))
                columns[3].append(np.repeat(keys[~known], n[~known]).view(np.int64))
            keys, sizes = gram_keys([symbols(w) for w in texts])
            logs, known = _looked_up(keys, *model)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            ends = np.r_[0, np.cumsum(np.add.reduceat(~known, starts, dtype=np.int64))]
            grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[~known].view(np.int64)))
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.list_(pa.int64())), pa.array(np.add.reduceat(logs, starts)), grams]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *arrays], ["doc_id", "held_out", "rid", "n_tokens", "n_known", "base_score", "cold", "score", "cold_grams"])

        for whole in batches:
            every = text_bytes(whole.column(1))
            for i, j in slices(every):
                yield from scored(whole.slice(i, j - i), [split_words(t) for t in every[i:j]])

    schema = "doc_id long, held_out boolean, rid long, n_tokens long, n_known long, base_score double, cold array<long>, score double, cold_grams array<long>"
    each = settle(wanted.withColumn("rid", F.monotonically_increasing_id()).select("doc_id", "text", "held_out", "rid").mapInArrow(run, schema), "ppm-documents")
    cold = each.select("rid", F.explode("cold").alias("key")).join(counts.words, "key", "left")
    cold = cold.groupBy("rid").agg(F.count("train").alias("cold_known"), F.sum(F.log10(F.coalesce("train", F.lit(0)) + 0.5) - F.lit(float(below))).alias("cold_score"))
    out = each.join(cold, "rid", "left")
    if not held:
        joined = each.select("rid", F.explode("cold_grams").alias("key")).join(scores, "key")
        rare = settle(joined.groupBy("rid").agg(F.sum("logp").alias("gram_score")), "ppm-rare")
        out = out.join(rare, "rid", "left").withColumn("score", F.col("score") + F.coalesce("gram_score", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("cold_score", F.lit(0.0))).alias("base_score"), "score",
    )
