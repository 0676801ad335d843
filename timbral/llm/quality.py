"""Quality classifier: random-indexing word vectors, pooled, through a two-layer network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbral.llm.shared import settle, slices, text_bytes

#: Words share so many slots by hash, so vectors are of fixed size whatever the corpus.
SLOTS = 1 << 16
DIM = 32
#: Non-zero entries of a slot's index vector, half of them -1.
NONZERO = 4
#: Neighbours on either side that a word's vector sums up.
REACH = 2
#: Labelled rows that the network is fitted on at most, by seeded hash of their id.
MOST_LABELLED = 40_000
HIDDEN = 24
EPOCHS = 40
SEED = 17
#: Tokens whose vectors are gathered at once.
BLOCK = 1 << 16
TOKEN = re.compile(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+")


class _Slots(dict):
    """token -> slot, remembered for a while."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        slot = self[token] = zlib.crc32(token) & (SLOTS - 1)
        return slot


def slots_of(texts: list[bytes], known: _Slots) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all texts' tokens, one after another, and each text's number of tokens.
    Tokens are runs of letters and digits, and runs of other marks; case counts."""
    split = [TOKEN.findall(t) for t in texts]
    sizes = np.array([len(x) for x in split], dtype=np.int64)
    flat = np.fromiter((known[w] for x in split for w in x), dtype=np.int32, count=int(sizes.sum()))
    return flat, sizes


def index_vectors() -> np.ndarray:
    """Each slot's sparse ternary index vector, drawn from the seed."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((SLOTS, DIM), dtype=np.int8)
    places = rng.random((SLOTS, DIM)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    out[np.arange(SLOTS)[:, None], places] = np.array([1, -1] * (NONZERO // 2), dtype=np.int8)
    return out


def context_sums(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, sums): the index vectors of each slot's neighbours in the same text, summed."""
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    slots, sums = [], []
    for i in range(0, len(flat), BLOCK):
        lo, hi = max(0, i - REACH), min(len(flat), i + BLOCK + REACH)
        rows, own = index[flat[lo:hi]], slice(i - lo, min(i + BLOCK, len(flat)) - lo)
        near = np.zeros((own.stop - own.start, DIM), dtype=np.int16)
        for d in range(1, REACH + 1):
            for shift in (-d, d):
                a, b = max(own.start, -shift), min(own.stop, len(rows) - max(shift, 0))
                if a < b:
                    same = text[lo + a : lo + b] == text[lo + a + shift : lo + b + shift]
                    near[a - own.start : b - own.start] += rows[a + shift : b + shift] * same[:, None]
        mine = flat[i : i + BLOCK]
        order = np.argsort(mine, kind="stable")
        first = np.flatnonzero(np.r_[True, mine[order][1:] != mine[order][:-1]])
        slots.append(mine[order][first])
        sums.append(np.add.reduceat(near[order], first, axis=0, dtype=np.int32))
    return np.concatenate([*slots, np.zeros(0, np.int32)]), np.concatenate([*sums, np.zeros((0, DIM), np.int32)])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(SLOTS, 2 * DIM): each slot's context vector over all rows of docs, scaled to length 1,
    and its own index vector. Tasks sum before the shuffle, which carries a row a slot and task."""
    names = [f"v{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = index_vectors(), _Slots()
        total = np.zeros((SLOTS, DIM), dtype=np.int64)
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for i, j in slices(texts):
                slots, sums = context_sums(*slots_of(texts[i:j], known), index)
                np.add.at(total, slots, sums)
        used = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(used), 8192):
            at = used[i : i + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(total[at, j]) for j in range(DIM)]], ["slot", *names])

    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "slot int, " + ", ".join(f"{c} long" for c in names))
    found = sums.groupBy("slot").agg(*[F.sum(c).cast("float").alias(c) for c in names]).toArrow()
    out = np.zeros((SLOTS, 2 * DIM), dtype=np.float32)
    at = found.column("slot").to_numpy()
    for j, c in enumerate(names):
        out[at, j] = found.column(c).to_numpy()
    out[:, :DIM] /= np.maximum(np.linalg.norm(out[:, :DIM], axis=1, keepdims=True), 1e-9)
    out[:, DIM:] = index_vectors() / np.sqrt(NONZERO)
    return out


def pooled(flat: np.ndarray, sizes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Each text's mean word vector, the lengths of its two halves, the share of words whose
    vector is that of the word before, and the logarithm of its length; zeros without tokens."""
    sums = np.zeros((len(sizes), vectors.shape[1]), dtype=np.float64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(0, len(flat), BLOCK):
        owner = text[i : i + BLOCK]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sums[owner[first]] += np.add.reduceat(vectors[flat[i : i + BLOCK]], first, axis=0)
    mean = sums / np.maximum(sizes, 1)[:, None]
    same = (flat[1:] == flat[:-1]) & (text[1:] == text[:-1])
    again = np.bincount(text[1:][same], minlength=len(sizes)) / np.maximum(sizes - 1, 1)
    halves = [np.linalg.norm(mean[:, h], axis=1) for h in (slice(0, DIM), slice(DIM, None))]
    return np.column_stack([mean, *halves, np.sqrt(again), np.log1p(sizes)]).astype(np.float32)


class Network:
    """One hidden layer of tanh, a logistic output, and a temperature for its probabilities.

    Fitted by Adam on standardized features. A fifth of the rows stays out of the fit and sets
    the temperature, the one of a fixed grid with the least log loss. Without both labels the
    score is the same for all, (positives + 1) / (rows + 2).
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = None if 0 < y.sum() < len(y) else float((y.sum() + 1) / (len(y) + 2))
        if self.constant is not None:
            return
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(x))
        x, y = x[order].astype(np.float64), y[order].astype(np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        aside = np.arange(len(x)) % 5 == 0 if len(x) >= 50 else np.zeros(len(x), dtype=bool)
        fit_x, fit_y = x[~aside], y[~aside]
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step, size = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0, 128
        for _ in range(EPOCHS if len(fit_x) > 2000 else 3 * EPOCHS):
            shuffled = rng.permutation(len(fit_x))
            for i in range(0, len(shuffled), size):
                bx, by = fit_x[shuffled[i : i + size]], fit_y[shuffled[i : i + size]]
                h = np.tanh(bx @ w[0] + w[1])
                gap = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - by) / len(bx)
                back = np.outer(gap, w[2]) * (1 - h * h)
                grads = [bx.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ gap + 1e-4 * w[2], np.array([gap.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if aside.any() and 0 < y[aside].sum() < aside.sum():
            logits = self._logits(x[aside])
            grid = np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, np.where(y[aside] == 1, -logits, logits) / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        x = np.clip((x.astype(np.float64) - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -30, 30)))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<float>) for every row: the pooled word vectors of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, text_col))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Slots()
        for batch in batches:
            texts = text_bytes(batch.column(1))
            x = np.concatenate([pooled(*slots_of(texts[i:j], known), sent.value) for i, j in slices(texts)])
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "x"])

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return wanted.mapInArrow(run, "doc_id long, x array<float>")


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality") -> Network:
    """The network for features() rows joined with labels (doc_id, label), rows held out and
    null labels left out. Of more than MOST_LABELLED distinct labelled rows it takes those with
    the smallest seeded hash. Of rows that share an id, one is fitted on, that with the least
    features, so no more rows come to the driver than labels."""
    known = labels.where(F.col(label_col).isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", F.col(label_col).cast("int").alias("y")).distinct()
    order = F.xxhash64(F.lit(SEED), "doc_id")
    sample = known.orderBy(order, "doc_id", "y").limit(MOST_LABELLED)
    found = rows.join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("doc_id", "x", "y").toArrow()
    y = found.column("y").to_numpy() if len(found) else np.zeros(0)
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(len(found), -1) if len(found) else np.zeros((0, 1))
    ids = found.column("doc_id").to_numpy() if len(found) else np.zeros(0)
    order = np.lexsort([x.sum(axis=1), y, ids])  # the same rows in the same order on every run
    return Network(x[order], (y[order] > 0).astype(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    score is the calibrated probability of label 1, from the text alone; predicted is 1 if it
    is threshold or more. labels: (doc_id, quality). A null or empty text has features of its
    own (zeros) and a score like any other. Repeated rows score alike; a label counts once,
    however many rows have its id. Rows with a null id are scored and never fitted on. Empty docs give
    no rows; without usable labels of both kinds all scores are the same.
    """
    rows = settle(features(docs, id_col, text_col), "quality-features")
    network = fit(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            score = network.score(flat.reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id was predicted 0; rows with a null id stay."""
    rejected = quality_scores(docs, labels, threshold, id_col, text_col).where("predicted = 0").select(F.col("doc_id").alias("__rejected")).distinct()
    return docs.join(rejected, docs[id_col].cast("long") == rejected["__rejected"], "left_anti")
