"""Token ids in files of fixed-width bit-packed blocks, and what reads them back.

A file holds whole documents in order. Every id takes the fewest bits that the vocabulary allows;
64 ids fill as many 64-bit words as an id has bits, so groups of 64 are packed and unpacked by
columns. Blocks of BLOCK ids start where the block offsets say, which lets a reader fetch any
span of ids, or any document, without the rest. Layout, all little-endian:

    header   8 x uint64: magic, bits an id, ids a block, part, ids of the part before this file,
             ids, documents, where the tables start
    blocks   packed ids, each block padded to whole groups
    tables   block offsets (uint64, one more than blocks), first id of each document (uint64, one
             more than documents), document ids (int64), whether a document id is null (uint8)
    trailer  TRAILER

Spark writes and reads the files, so they may be in any store that Spark reaches, and a task that
runs twice leaves one copy of its files.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbral.llm.shared import settle, slices, text_bytes

MAGIC = int.from_bytes(b"BITPACK1", "little")
TRAILER = "BITPACK1"
HEADER = 8
#: Ids in a block, a multiple of 64.
BLOCK = 4096
#: A file is closed by the document with which it has this many ids.
FILE_IDS = 1 << 22
#: With more words than this a worker forgets those whose ids it remembers.
REMEMBERED = 1 << 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MARKS = ".,;:!?"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`; 1 at least, 32 at most."""
    bits = max(1, int(vocabulary - 1).bit_length())
    if bits > 32:
        raise ValueError("ids of over 32 bits are not supported")
    return bits


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """ids as 64-bit words, `bits` of them for each 64 ids; zeros fill the last group."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs over {bits} bits")
    padded = np.zeros(-(-len(ids) // 64) * 64, "<u8")
    padded[: len(ids)] = ids
    columns = np.ascontiguousarray(padded.reshape(-1, 64).T)
    words = np.zeros((bits, columns.shape[1]), "<u8")
    for k in range(64):
        word, low = divmod(k * bits, 64)
        words[word] |= columns[k] << np.uint64(low)
        if low + bits > 64:
            words[word + 1] |= columns[k] >> np.uint64(64 - low)
    return words.T.ravel()


def unpack(words: np.ndarray, bits: int) -> np.ndarray:
    """All ids of whole groups, as uint32; what pack() added is still at the end."""
    rows = np.ascontiguousarray(words.reshape(-1, bits).T)
    ids, mask = np.empty((64, rows.shape[1]), "<u4"), np.uint64((1 << bits) - 1)
    for k in range(64):
        word, low = divmod(k * bits, 64)
        value = rows[word] >> np.uint64(low)
        if low + bits > 64:
            value |= rows[word + 1] << np.uint64(64 - low)
        ids[k] = value & mask
    return ids.T.ravel()


def packed_file(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None], bits: int, part: int, before: int) -> bytes:
    """A file's bytes up to the trailer. Document k has ids[starts[k]:starts[k + 1]]."""
    blocks = [pack(ids[a : a + BLOCK], bits) for a in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[HEADER * 8], HEADER * 8 + np.cumsum([b.nbytes for b in blocks])]).astype("<u8")
    header = np.array([MAGIC, bits, BLOCK, part, before, len(ids), len(doc_ids), int(offsets[-1])], "<u8")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(x.tobytes() for x in (header, *blocks, offsets, starts.astype("<u8"), keys, nulls))


class PackedFile:
    """Random access to a packed file: its bytes, a memory map or any other buffer."""

    def __init__(self, buffer) -> None:
        self.bytes = np.frombuffer(buffer, np.uint8)
        head = self.bytes[: HEADER * 8].view("<u8")
        end = self.bytes[-len(TRAILER) :].tobytes()
        if len(head) < HEADER or int(head[0]) != MAGIC or end != TRAILER.encode():
            raise ValueError("not a whole packed file")
        _, self.bits, self.block, self.part, self.before, self.n_ids, self.n_docs, at = map(int, head)
        blocks = -(-self.n_ids // self.block)
        self.offsets, at = self._table(at, blocks + 1, "<u8")
        self.starts, at = self._table(at, self.n_docs + 1, "<u8")
        self.keys, at = self._table(at, self.n_docs, "<i8")
        self.nulls, _ = self._table(at, self.n_docs, "u1")

    def _table(self, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
        size = n * np.dtype(kind).itemsize
        return np.frombuffer(self.bytes, kind, n, at), at + size

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] of the file, unpacking the blocks that hold them and no others."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        low, high = int(self.offsets[first]), int(self.offsets[last + 1])
        # every block but the file's last is full, so neighbouring blocks unpack as one
        found = unpack(np.frombuffer(self.bytes, "<u8", (high - low) // 8, low), self.bits)
        return found[start - first * self.block : stop - first * self.block]

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places of the file, in the order asked for."""
        places = np.asarray(places, np.int64)
        if len(places) and not (0 <= places.min() and places.max() < self.n_ids):
            raise IndexError("no such id in the file")
        block, within = np.divmod(places, self.block)
        group, k = np.divmod(within, 64)
        first = self.offsets[block].astype(np.int64) // 8 + group * self.bits
        word, low = np.divmod(k * self.bits, 64)
        words = np.frombuffer(self.bytes, "<u8", int(self.offsets[-1]) // 8)
        value = words[first + word] >> low.astype(np.uint64)
        spill = low + self.bits > 64
        value[spill] |= words[(first + word)[spill] + 1] << (64 - low[spill]).astype(np.uint64)
        return (value & np.uint64((1 << self.bits) - 1)).astype("<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class Encoder:
    """A tokenizers file, applied to texts; by_words: it drops ASCII white space and never looks
    across it, so the ids of a text are those of its words, and each word is encoded once while it
    is remembered. Where the file is seen to fold ASCII letters and to keep them in one piece, words
    of such letters go to its model at once, and so do those with one mark behind them."""

    def __init__(self, described: str, by_words: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_str(described), by_words
        folded = self._pieces(LETTERS) == [LETTERS.lower()]
        self.marks = {m.encode(): self._spelled(m) for m in MARKS if folded and self._pieces(f"{LETTERS}{m}") == [LETTERS.lower(), m]}
        self.folded = folded
        self._forget()

    def _forget(self) -> None:
        """Words by row; row r's ids are flat[ends[r]:ends[r + 1]]."""
        self.rows: dict[bytes, int] = {}
        self.flat, self.ends = array("I"), array("I", [0])

    def _pieces(self, text: str) -> list[str]:
        t = self.tokenizer
        if t.normalizer is None or t.pre_tokenizer is None:
            return []
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]

    def _spelled(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [e.ids for e in found]

    def _put(self, word: bytes, ids: list[int]) -> None:
        self.rows[word] = len(self.ends) - 1
        self.flat.extend(ids)
        self.ends.append(len(self.flat))

    def _learn(self, words: set[bytes]) -> None:
        rest = []
        for w in words:
            if self.folded and w.isalpha():  # bytes: ASCII letters only
                self._put(w, self._spelled(w.lower().decode()))
            elif w[-1:] in self.marks and w[:-1].isalpha():
                self._put(w, self._spelled(w[:-1].lower().decode()) + self.marks[w[-1:]])
            else:
                rest.append(w)
        for w, ids in zip(rest, self._encode(rest), strict=True):
            self._put(w, ids)

    def encode(self, texts: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin; `end` follows each."""
        tail = [] if end is None else [end]
        if not self.by_words:
            own = [[*x, *tail] for x in self._encode(texts)]
            return np.fromiter(chain.from_iterable(own), "<u4"), np.cumsum([0, *map(len, own)])
        split = [t.split() for t in texts]
        words = list(chain.from_iterable(split))
        codes = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(codes < 0)
        if len(new):
            unknown = [words[i] for i in new]
            self._learn(set(unknown))
            codes[new] = np.fromiter(map(self.rows.__getitem__, unknown), np.int64, len(new))
        bounds = np.frombuffer(self.ends, np.uint32).astype(np.int64)
        flat = np.append(np.frombuffer(self.flat, np.uint32), np.array(tail, np.uint32))
        bounds = np.append(bounds, len(flat))  # the last row is the end
        stops_of = np.cumsum([len(s) + 1 for s in split])
        codes = np.insert(codes, stops_of - np.arange(1, len(stops_of) + 1), len(bounds) - 2)
        firsts, lengths = bounds[codes], bounds[codes + 1] - bounds[codes]
        stops = np.cumsum(lengths)
        places = np.repeat(firsts - stops + lengths, lengths) + np.arange(int(stops[-1]))
        if len(self.rows) > REMEMBERED:
            self._forget()
        return flat[places], np.concatenate([[0], stops[stops_of - 1]])


@functools.lru_cache(maxsize=2)
def _encoder(described: str, by_words: bool) -> Encoder:
    return Encoder(described, by_words)


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end: int | None = None, by_words: bool = False,
    id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None,
) -> None:
    """Write the ids of all texts as packed files in a new folder `path`, in ascending id order.

    tokenizer is the path of a tokenizers file on the driver; `end` is put behind each document.
    id_col is of whole numbers; null ids come first, rows of one id in the order of a hash of
    their texts, repeated rows each by itself. A null or empty text has no ids but `end`. Other
    columns are not stored. An empty table gives a folder without documents. by_words says that
    the tokenizer drops white space and never looks across it. vocabulary bounds the ids (its
    size by the file; `end` may lie above).

    The rows are dealt by ranges of (id, hash), so that an id of very many rows is split too.
    """
    described = read_tokenizer(tokenizer)
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_str(described).get_vocab_size(with_added_tokens=True)
    bits = bits_for(max(vocabulary, (end or 0) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = _encoder(described, by_words), TaskContext.get().partitionId(), 0
        kept, sizes, keys, total = [], [], [], 0

        def file() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            body = packed_file(np.concatenate(kept), starts, keys, bits, part, before)
            return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["file"])

        for batch in batches:
            own, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in slices(texts):
                ids, starts = encoder.encode(texts[a:b], end)
                kept.append(ids)
                sizes.append(np.diff(starts))
                keys.extend(own[a:b])
                total += len(ids)
                if total >= FILE_IDS:
                    yield file()
                    before += total
                    kept, sizes, keys, total = [], [], [], 0
        if keys:
            yield file()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    salted = rows.withColumn("salt", F.xxhash64("text"))
    placed = salted.repartitionByRange("id", "salt").sortWithinPartitions("id", "salt").select("id", "text")
    files = placed.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", TRAILER).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of packed files: part, start_in_part (ids of the part before it), doc_id,
    n_tokens, ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers) and, if
    asked for, ids (array<long>). A file that is cut short raises ValueError."""
    names = ["part", "start_in_part", "doc_id", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    step = 1 << 20

    def rows(content: bytes) -> Iterator[pa.RecordBatch]:
        file = PackedFile(content)
        starts, k = file.starts.astype(np.int64), 0
        while k < file.n_docs:
            stop = max(k + 1, int(np.searchsorted(starts, starts[k] + step, side="right")) - 1)
            ids = file.ids(int(starts[k]), int(starts[stop]))
            own = starts[k : stop + 1] - starts[k]
            checks = [zlib.crc32(ids[a:b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
            columns = [
                pa.array(np.full(stop - k, file.part)), pa.array(starts[k:stop] + file.before),
                pa.array(file.keys[k:stop], pa.int64(), mask=file.nulls[k:stop].astype(bool)), pa.array(np.diff(own)), pa.array(checks, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.LargeListArray.from_arrays(own, ids.astype(np.int64)).cast(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names)
            k = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if len(data := content.as_buffer()):
                    yield from rows(data)

    schema = ", ".join(f"{n} {'array<bigint>' if n == 'ids' else 'bigint'}" for n in names)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, schema)


def token_spans(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in packed files; start counts the ids
    of all documents before it. Only the parts' totals, one a range that was written, are added
    up in one task and sent to the others."""
    found = settle(read_documents(spark, path, with_ids=False), "token-spans")
    totals = found.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = found.join(F.broadcast(bases), "part")
    return placed.select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
