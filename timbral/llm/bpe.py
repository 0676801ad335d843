"""Byte-level BPE over Arrow batches: padded numpy matrices of pieces, merged round by round."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbral.llm.shared import free_name, slices, text_bytes

#: A vocabulary file above this size is refused, since each task receives its bytes.
MOST_VOCABULARY_BYTES = 64 << 20
#: Parts remembered by a worker; then it forgets all and goes on. Results do not depend on it.
REMEMBERED = 200_000
#: Bytes of text whose parts are held at once, unless a single text has more.
SLICE = 1 << 20
#: Pieces longer than this are merged through a heap, since a matrix row costs its length a round.
LONG = 2048
#: Cells of one matrix.
CELLS = 1 << 18
NONE = np.int32(2**31 - 1)
#: The characters that Unicode calls White_Space, as `\s` of the vocabulary's own
#: splitter takes them. Python's `\s` has four more, the separators U+001C to U+001F.
LATIN_END = "\u0250"
MARKS = frozenset(",.;:!?")
WHITE = r"\t-\r \x85\xa0  -     　"


class Vocabulary:
    """Ranks of byte strings, and a hashed table of the pairs of ranks that merge."""

    def __init__(self, lines: bytes, pattern: str):
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.ranks = ranks
        self.spelling = dict(zip(ranks.values(), ranks, strict=True))
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(ranks[x[:i]], ranks[x[i:]], r) for x, r in ranks.items() for i in range(1, len(x)) if x[:i] in ranks and x[i:] in ranks]
        left, right, made = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self._hash(left << 32 | right, made)
        negated = r"[^" + WHITE + r"\p{L}\p{N}]"
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", negated).replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.known: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing at under a quarter full; all keys still homeless try their next slot."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.made = np.full(1 << self.bits, NONE, dtype=np.int32)
        at = self._home(keys)
        while len(keys):
            free = self.slots[at] == -1
            self.slots[at[free]] = keys[free]
            mine = self.slots[at] == keys
            self.made[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & (len(self.slots) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, NONE where it doesn't; ids below 0 never merge."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(keys), NONE, dtype=np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        at = self._home(keys[todo])
        while len(todo):
            found = self.slots[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.made[at[hit]]
            on = ~hit & (found != -1)
            todo, at = todo[on], (at[on] + 1) & (len(self.slots) - 1)
        return out.reshape(left.shape)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece (none of them empty), merged in matrices of like lengths."""
        out: list = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        order = np.argsort(lengths, kind="stable")
        start = 0
        while start < len(order):
            width = 1 << int(lengths[order[start]] - 1).bit_length()
            if width > LONG:
                for i in order[start:]:
                    out[i] = self._merge_long(pieces[i])
                break
            end = min(int(np.searchsorted(lengths[order], width, side="right")), start + max(1, CELLS // width))
            rows = order[start:end]
            for i, ids in zip(rows, self._merge_rows([pieces[i] for i in rows], width), strict=True):
                out[i] = ids
            start = end
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        sizes = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < sizes[:, None], self.byte[flat], np.int32(-1))
        ids = np.concatenate([ids, np.full((len(ids), 2), -1, dtype=np.int32)], axis=1)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        out: list = [None] * len(pieces)
        row = np.arange(len(pieces))
        span = np.arange(width + 1)
        while len(row):
            at = ranks.argmin(axis=1)
            here = np.arange(len(row))
            best = ranks[here, at]
            done = best == NONE
            if done.any():
                for r, line in zip(row[done], ids[done], strict=True):
                    out[r] = line[: sizes[r]]
                on = ~done
                row, ids, ranks, at, best = row[on], ids[on], ranks[on], at[on], best[on]
                here = np.arange(len(row))
                if not len(row):
                    break
            beyond = span[None, :] > at[:, None]
            ids[here, at] = best
            ids[:, :-1] = np.where(beyond, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(beyond[:, :-1], ranks[:, 1:], ranks[:, :-1])
            sizes[row] -= 1
            ranks[here, at] = self.rank(ids[here, at], ids[here, at + 1])
            inner = at > 0
            ranks[here[inner], at[inner] - 1] = self.rank(ids[here[inner], at[inner] - 1], ids[here[inner], at[inner]])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges in the same order for one long piece: a heap of (rank, place)."""
        import heapq

        ids = self.byte[np.frombuffer(piece, dtype=np.uint8)]
        first = self.rank(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        now: list[int] = first.tolist() + [int(NONE)]
        ids = ids.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        spelled = {i: self.spelling[i] for i in set(ids)}

        def rank(i: int) -> None:
            j = after[i]
            now[i] = int(NONE) if j >= len(ids) else self.ranks.get(spelled[ids[i]] + spelled[ids[j]], int(NONE))
            if now[i] != NONE:
                heapq.heappush(heap, (now[i], i))

        while heap:
            best, i = heapq.heappop(heap)
            if now[i] != best:
                continue
            j = after[i]
            ids[i], ids[j] = best, -1
            spelled.setdefault(best, self.spelling[best])
            now[j] = int(NONE)
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            rank(i)
            if before[i] >= 0:
                rank(before[i])
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return [ids for i, j in slices(texts, SLICE) for ids in self._encode_slice(texts[i:j])]

    def _encode_slice(self, texts: list[bytes]) -> list[bytes]:
        """No piece spans the boundary before a single space that stands between two characters
        which are not white space, so a text is cut there and each distinct part, with its
        space, is split into pieces and merged once."""
        cut = [t.decode().split(" ") for t in texts]
        known, out = self.known, []
        spaced = set().union(*cut)
        if len(known) + len(spaced) > REMEMBERED:
            known.clear()
        new = [x for x in spaced if x not in known]
        known.update(dict.fromkeys(new))
        clean = [x for x in new if x and not x[0].isspace() and not x[-1].isspace()]
        known.update(zip(clean, self._encode_chunks([f" {x}" for x in clean]), strict=True))
        heads, whole = [], []
        for parts in cut:
            head = parts[0]
            if not head or head[-1].isspace() or None in (ids := list(map(known.__getitem__, parts[1:]))):
                whole.append(" ".join(parts))
                out.append(None)
            else:
                heads.append(head)
                out.append(b"".join(ids))
        heads, whole = iter(self._encode_chunks(heads)), iter(self._encode_chunks(whole))
        return [next(whole) if x is None else next(heads) + x for x in out]

    def _split(self, chunk: str) -> list[str]:
        """The pattern's pieces; a space with Latin letters, and a mark after them, needs no search."""
        word = chunk[1:]
        if word.isalpha() and chunk[0] == " " and (word.isascii() or max(word) < LATIN_END):
            return [chunk]
        if word[:-1].isalpha() and chunk[0] == " " and word[-1] in MARKS and (word.isascii() or max(word) < LATIN_END):
            return [chunk[:-1], word[-1]]
        return self.pattern.findall(chunk)

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        split = list(map(self._split, chunks))
        pieces, ranks = self.pieces, self.ranks
        new = list(set().union(*split).difference(pieces))
        if len(pieces) + len(new) > REMEMBERED:
            pieces.clear()
            new = list(set().union(*split))
        spelled = [x.encode() for x in new]
        pieces.update((p, ranks[b].to_bytes(4, "little")) for p, b in zip(new, spelled, strict=True) if b in ranks)
        rest = [(p, b) for p, b in zip(new, spelled, strict=True) if b not in ranks]
        merged = self.merge([b for _, b in rest])
        ends = np.cumsum([0, *map(len, merged)]) * 4
        flat = np.concatenate([*merged, np.zeros(0, dtype=np.int32)]).astype("<u4").tobytes()
        pieces.update((p, flat[i:j]) for (p, _), i, j in zip(rest, ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        return [pieces[x[0]] if len(x) == 1 else b"".join(map(pieces.__getitem__, x)) for x in split]


class Spelling:
    """The bytes of every id, laid out for numpy."""

    def __init__(self, lines: bytes):
        spelled = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines.splitlines())}
        self.size = np.zeros(max(spelled) + 1, dtype=np.int64)
        for i, x in spelled.items():
            self.size[i] = len(x)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(len(self.size))), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids spell; an id outside the vocabulary raises IndexError."""
        size = self.size[ids]
        if len(ids) and not size.all():
            raise IndexError("an id is outside the vocabulary")
        ends = np.cumsum(size)
        from_ = np.repeat(self.start[ids] - ends + size, size)
        from_ += np.arange(len(from_))
        return self.flat[from_].tobytes()


@lru_cache(maxsize=4)
def _spelling(lines: bytes) -> Spelling:
    return Spelling(lines)


@lru_cache(maxsize=4)
def _vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(lines, pattern)


def read_vocabulary(path: str) -> bytes:
    """The lines `base64 rank` of a rank file, of a checked size."""
    if (size := Path(path).stat().st_size) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes, over {MOST_VOCABULARY_BYTES}")
    return Path(path).read_bytes()


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that no worker holds the ids of all its texts."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _packed(ids: list[bytes]) -> pa.Array:
    """Lists of ids as one Arrow list<int32> array."""
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def _unpacked(column: pa.ListArray) -> list[np.ndarray]:
    flat = np.asarray(column.values, dtype="<i4")
    ends = np.asarray(column.offsets)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _without_null(column: pa.ListArray) -> pa.ListArray:
    return pa.array([x or [] for x in column.to_pylist()], column.type) if column.null_count else column


Batches = Iterator[pa.RecordBatch]


def _with_ids(batches: Batches, lines: bytes, pattern: str, at: int, name: str) -> Batches:
    words = _vocabulary(lines, pattern)
    for batch in batches:
        for part in _slices(batch):
            ids = _packed(words.encode(text_bytes(part.column(at))))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, name])


def _with_bytes(batches: Batches, lines: bytes, at: int, name: str) -> Batches:
    words = _spelling(lines)
    for batch in batches:
        spelled = pa.array([words.decode(x) for x in _unpacked(_without_null(batch.column(at)))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, spelled], [*batch.schema.names, name])


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with `out_col`, the array<int> of each whole text's ids.

    pattern splits a text into pieces, each encoded by itself: a piece that is a token is that
    token; any other merges its leftmost pair of lowest rank until no pair merges. Texts of any
    length go through whole. A null or empty text has no ids. Repeated rows repeat; other
    columns stay as they are, and out_col gets underscores when the name is taken.
    """
    lines = read_vocabulary(vocabulary)
    name = free_name(docs.columns, out_col)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(lambda batches: _with_ids(batches, lines, pattern, at, name), schema)


def bpe_decode(tokens: DataFrame, vocabulary: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """tokens with `out_col`, the bytes that the ids spell (binary: ids may end inside a
    character). Null ids count as none. An id outside the vocabulary raises IndexError."""
    lines = read_vocabulary(vocabulary)
    name = free_name(tokens.columns, out_col)
    at = tokens.columns.index(ids_col)
    schema = T.StructType([*tokens.schema.fields, T.StructField(name, T.BinaryType())])
    return tokens.mapInArrow(lambda batches: _with_bytes(batches, lines, at, name), schema)


def round_trip_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded as by
    bpe_encode() and its ids decoded as by bpe_decode(), in one pass through the tasks. The ids
    are hashed as little-endian unsigned 32-bit integers."""
    lines = read_vocabulary(vocabulary)
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Batches) -> Batches:
        for batch in _with_bytes(_with_ids(batches, lines, pattern, 1, "ids"), lines, 2, "decoded"):
            ids = _unpacked(batch.column(2))
            columns = [pa.array([len(x) for x in ids], pa.int64()), *[pa.array([hashlib.sha256(x).hexdigest() for x in c], pa.string()) for c in (ids, map(memoryview, batch.column(3).to_pylist()))]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kinds = (kept.schema["doc_id"].dataType, T.LongType(), T.StringType(), T.StringType())
    return kept.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
