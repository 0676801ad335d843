"""Media columns: progressive JPEG with coefficients decoded in numpy, many files in step.

Bytes are stored without loss as quantized DCT coefficients, the format's unit: byte - 128 each,
in 8x8 blocks of a 4:2:0 image. A decoder of progressive Huffman files accumulates
the scans into coefficient arrays. Entropy-coded runs between restart markers are independent, so
those of all files of a batch advance together, a symbol each per numpy step.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.shared import free_name, slices, text_bytes

UNIT = 576
#: MCUs in a row of a written image unless it gets too high, and MCUs between restart markers.
ACROSS, RESTART = 8, 8
#: MCUs of 16 samples that fit below each other: a frame's sizes are 16-bit numbers.
DOWN = 4095
#: Payload bytes whose blocks are coded at once, unless one text has more.
SLICE = 4 << 20


def _zigzag() -> np.ndarray:
    """The natural place of each coefficient in scan order: diagonals, in turn up and down."""
    return np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


ZIGZAG = _zigzag()
#: The written scans: (components, first and last coefficient, high and low bit).
SCANS = [((0, 1, 2), 0, 0, 0, 1), *[((c,), a, b, 0, 1) for a, b in ((1, 5), (6, 63)) for c in range(3)], ((0, 1, 2), 0, 0, 1, 0), *[((c,), 1, 63, 1, 0) for c in range(3)]]
#: Code lengths of the written tables by symbol: DC sizes; AC first passes; AC refinement.
TABLES = (
    dict.fromkeys(range(12), 4),
    dict.fromkeys([*range(1, 9), 0x00, 0xF0], 4) | {r << 4 | s: 9 for r in range(1, 16) for s in range(1, 9)},
    {0x00: 2} | {r << 4 | s: 6 for r in range(16) for s in (0, 1) if r or s},
)
DC, AC, REFINE = range(3)


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(code, length) by symbol and the table as it stands in a file."""
    ordered = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, sizes, code, before = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in ordered:
        code <<= lengths[s] - before
        codes[s], sizes[s], before = code, lengths[s], lengths[s]
        code += 1
    counts = [sum(v == n for v in lengths.values()) for n in range(1, 17)]
    return codes, sizes, bytes(counts) + bytes(ordered)


CODES = [_codes(t) for t in TABLES]


class Component(NamedTuple):
    ident: int
    h: int
    v: int
    quant: int


class Geometry(NamedTuple):
    """A frame's size and components."""

    width: int
    height: int
    components: tuple[Component, ...]

    @property
    def most(self) -> tuple[int, int]:
        return max(c.h for c in self.components), max(c.v for c in self.components)

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = self.most
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def grid(self, c: int) -> tuple[int, int]:
        """Blocks across and down that component c has, with those beyond the image."""
        return self.mcus[0] * self.components[c].h, self.mcus[1] * self.components[c].v

    def starts(self) -> list[int]:
        sizes = [np.prod(self.grid(c)) for c in range(len(self.components))]
        return [int(x) for x in np.cumsum([0, *sizes])]


@lru_cache(maxsize=4096)
def _order(g: Geometry, which: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """A scan's blocks in order, each one's place in `which`, and blocks in an MCU."""
    starts = g.starts()
    if len(which) == 1:
        c, (h, v) = g.components[which[0]], g.most
        across, down = -(-(-(-g.width * c.h // h)) // 8), -(-(-(-g.height * c.v // v)) // 8)
        place = starts[which[0]] + np.arange(down)[:, None] * g.grid(which[0])[0] + np.arange(across)
        return place.ravel(), np.zeros(place.size, np.int64), 1
    parts, owner = [], []
    for k, i in enumerate(which):
        c, across = g.components[i], g.grid(i)[0]
        my, mx = np.arange(g.mcus[1])[:, None, None, None], np.arange(g.mcus[0])[:, None, None]
        place = starts[i] + (my * c.v + np.arange(c.v)[:, None]) * across + mx * c.h + np.arange(c.h)
        parts.append(place.reshape(-1, c.h * c.v))
        owner += [k] * (c.h * c.v)
    place = np.concatenate(parts, axis=1)
    return place.ravel(), np.tile(np.array(owner), len(place)), place.shape[1]


@lru_cache(maxsize=4096)
def _written(blocks: int) -> Geometry:
    """The 4:2:0 frame that holds so many blocks: rows of ACROSS MCUs, or of more, a multiple of
    RESTART, beyond DOWN rows. Its most, DOWN x 4,088 MCUs, hold 6.4 GB; a value of a table has
    2 GB at most, so one frame is always enough."""
    mcus = -(-blocks // 6)
    across = min(mcus, max(ACROSS, -(-mcus // (DOWN * RESTART)) * RESTART))
    return Geometry(16 * across, 16 * -(-mcus // across), (Component(1, 2, 2, 0), Component(2, 1, 1, 0), Component(3, 1, 1, 0)))


def payload_of(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * ((-len(text)) % UNIT if text else UNIT)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=4096)
def _head(g: Geometry, payload: int) -> bytes:
    quant = _segment(0xDB, b"\0" + b"\1" * 64)
    frame = _segment(0xC2, struct.pack(">BHHB", 8, g.height, g.width, 3) + b"".join(bytes([c.ident, c.h << 4 | c.v, c.quant]) for c in g.components))
    tables = _segment(0xC4, b"\0" + CODES[DC][2] + b"\x10" + CODES[AC][2] + b"\x11" + CODES[REFINE][2])
    return b"\xff\xd8" + _segment(0xFE, b"payload %d" % payload) + quant + frame + tables + _segment(0xDD, struct.pack(">H", RESTART))


def _sos(which: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    table = 0x00 if not first else (0x01 if high else 0x00)
    return _segment(0xDA, bytes([len(which)]) + b"".join(bytes([c + 1, table]) for c in which) + bytes([first, last, high << 4 | low]))


def _bits(size: np.ndarray) -> np.ndarray:
    return (np.int64(1) << size) - 1


def _sizes(x: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return np.frexp(np.abs(x).astype(np.float64))[1].astype(np.int64)


def _tokens(values: np.ndarray, owner: np.ndarray, stream: np.ndarray, scan: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, their number, stream) of a first scan over blocks in order. values: (blocks, 64)."""
    _, first, last, _, low = scan
    if not first:
        dc = values[:, 0].astype(np.int64) >> low
        key = stream * 4 + owner
        by = np.argsort(key, kind="stable")
        before = np.r_[0, dc[by][:-1]]
        before[np.r_[True, key[by][1:] != key[by][:-1]]] = 0
        diff = np.empty_like(dc)
        diff[by] = dc[by] - before
        size = _sizes(diff)
        extra = np.where(diff < 0, diff - 1, diff) & _bits(size)
        return CODES[DC][0][size] << size | extra, CODES[DC][1][size] + size, stream
    size_of = np.abs(values[:, first : last + 1]) >> low
    dense = size_of.all(axis=1)
    if dense.all():
        return _dense(values[:, first : last + 1], size_of, stream)
    sparse = np.flatnonzero(~dense)
    bits, count, at = _sparse(values[sparse, first : last + 1], size_of[sparse])
    more = _dense(values[dense, first : last + 1], size_of[dense], np.flatnonzero(dense))
    at = np.concatenate([more[2], sparse[at]])
    by = np.argsort(at, kind="stable")
    return np.concatenate([more[0], bits])[by], np.concatenate([more[1], count])[by], stream[at[by]]


@lru_cache(maxsize=1)
def _plain_codes() -> tuple[np.ndarray, np.ndarray]:
    """(bits, their number) of each level from -256 to 255 without a run before it."""
    level = np.arange(-256, 256)
    size = _sizes(level)
    size[[0, 256]] = 0
    code, length = CODES[AC][:2]
    return (code[size] << size | np.where(level < 0, level - 1, level) & _bits(size)).astype(np.uint64), (length[size] + size).astype(np.int64)


def _dense(band: np.ndarray, size_of: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of blocks whose band has no zero; four coefficients make one token."""
    plain, lengths = _plain_codes()
    index = np.where(band < 0, -size_of, size_of).astype(np.int64) + 256
    bits, count = [], []
    for i in range(0, band.shape[1], 4):
        got, n = plain[index[:, i]], lengths[index[:, i]]
        for j in range(i + 1, min(i + 4, band.shape[1])):
            more = lengths[index[:, j]]
            got = got << more.astype(np.uint64) | plain[index[:, j]]
            n = n + more
        bits.append(got)
        count.append(n)
    return np.stack(bits, axis=1).ravel().astype(np.int64), np.stack(count, axis=1).ravel(), np.repeat(stream, len(bits))


def _sparse(values: np.ndarray, size_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, their number, block) of blocks with zeros: runs, ZRL for 16 zeros, EOB."""
    band, size_of = values.astype(np.int64), size_of.astype(np.int64)
    block, k = np.nonzero(size_of)
    new = np.r_[True, block[1:] != block[:-1]] if len(block) else np.zeros(0, bool)
    run = k - np.where(new, 0, np.r_[0, k[:-1]] + 1) if len(block) else k
    level = np.where(band[block, k] < 0, -size_of[block, k], size_of[block, k])
    size = _sizes(level)
    symbol = (run & 15) << 4 | size
    code, length = CODES[AC][:2]
    bits, count = code[symbol] << size | np.where(level < 0, level - 1, level) & _bits(size), length[symbol] + size
    long = np.flatnonzero(run > 15)
    skips = np.repeat(long, run[long] >> 4)
    end = np.full(len(band), -1)
    end[block] = k
    open_ = np.flatnonzero(end < band.shape[1] - 1)
    at = np.concatenate([block * 128 + k * 2 + 1, block[skips] * 128 + k[skips] * 2, open_ * 128 + 127])
    by = np.argsort(at, kind="stable")
    bits = np.r_[bits, np.full(len(skips), code[0xF0]), np.full(len(open_), code[0])]
    count = np.r_[count, np.full(len(skips), length[0xF0]), np.full(len(open_), length[0])]
    return bits[by], count[by], at[by] >> 7


def _refining_bits(values: np.ndarray, scan: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(single bits, their number for each block) of a refinement scan over blocks in order.

    A block without new coefficients is an EOB and a bit for each old one. The others are few
    in text and are coded one by one.
    """
    _, first, last, _, low = scan
    if not first:
        return (values[:, 0] >> low & 1).astype(np.uint8), np.ones(len(values), np.int64)
    size_of = np.abs(values[:, first : last + 1]) >> low
    old, new = size_of > 1, size_of == 1
    code, length = CODES[REFINE][:2]
    spelled = lambda symbol: [int(code[symbol]) >> i & 1 for i in range(int(length[symbol]) - 1, -1, -1)]
    eob = spelled(0)
    rows = np.concatenate([np.tile(np.array(eob, np.uint8), (len(values), 1)), (size_of & 1).astype(np.uint8)], axis=1)
    sent = np.concatenate([np.ones((len(values), len(eob)), bool), old], axis=1)
    odd = np.flatnonzero(new.any(axis=1))
    if not len(odd):
        return rows[sent], sent.sum(axis=1)
    plain = np.ones(len(values), bool)
    plain[odd] = False
    made = [_refined(size_of[b], values[b, first : last + 1] > 0, old[b], new[b], spelled) for b in odd]
    count = sent.sum(axis=1)
    count[odd] = [len(x) for x in made]
    out = np.empty(int(count.sum()), np.uint8)
    of_plain = np.repeat(plain, count)
    out[of_plain] = rows[plain][sent[plain]]
    out[~of_plain] = np.concatenate(made)
    return out, count


def _refined(size_of: np.ndarray, positive: np.ndarray, old: np.ndarray, new: np.ndarray, spelled) -> np.ndarray:
    """The bits of one block with new coefficients."""
    made: list[int] = []
    held: list[int] = []
    run, latest = 0, int(np.flatnonzero(new)[-1])
    for k in range(len(size_of)):
        if old[k]:
            held.append(int(size_of[k] & 1))
        elif new[k]:
            made += [*spelled(run << 4 | 1), int(positive[k]), *held]
            held, run = [], 0
        elif run == 15 and k < latest:
            made += [*spelled(0xF0), *held]
            held, run = [], 0
        else:
            run += 1
    if latest < len(size_of) - 1:
        made += [*spelled(0), *held]
    return np.array(made, dtype=np.uint8)


def _pack_bits(bits: np.ndarray, count: np.ndarray, stream: np.ndarray, streams: int) -> tuple[np.ndarray, np.ndarray]:
    """As _pack(), of single bits; count and stream are those of blocks."""
    total = np.bincount(stream, weights=count, minlength=streams).astype(np.int64)
    sizes = (total + 7) // 8
    out = np.ones(int(sizes.sum()) * 8, np.uint8)
    out[np.arange(len(bits)) + np.repeat(np.cumsum(sizes * 8) - sizes * 8 - np.cumsum(total) + total, total)] = bits
    return np.packbits(out), sizes


def _pack(bits: np.ndarray, count: np.ndarray, stream: np.ndarray, streams: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each stream): streams in turn, each filled up with ones."""
    total = np.bincount(stream, weights=count, minlength=streams).astype(np.int64)
    fill = -total % 8
    sizes = (total + fill) // 8
    last = np.cumsum(np.bincount(stream, minlength=streams))
    bits, count = np.insert(bits, last, _bits(fill)), np.insert(count, last, fill)
    ends = np.cumsum(count)
    begins = ends - count
    words = np.zeros(int(ends[-1]) // 64 + 2 if len(ends) else 1, dtype=np.uint64)
    bits, word = bits.astype(np.uint64), begins >> 6
    over = (begins & 63) + count - 64
    high = np.where(over > 0, bits >> np.maximum(over, 0).astype(np.uint64), bits << np.maximum(-over, 0).astype(np.uint64))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[first]] |= np.bitwise_or.reduceat(high, first)
    spill = np.flatnonzero(over > 0)
    words[word[spill] + 1] |= bits[spill] << (64 - over[spill]).astype(np.uint64)
    return words.byteswap().view(np.uint8)[: int(ends[-1]) // 8 if len(ends) else 0], sizes


def encode(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEG files that hold the payloads, of UNIT bytes or a multiple each."""
    frames = [_written(len(p) // 64) for p in payloads]
    starts = np.cumsum([0, *(g.starts()[-1] for g in frames)])
    values = np.zeros((int(starts[-1]), 64), dtype=np.int16)
    for p, at in zip(payloads, starts, strict=False):
        values[at : at + len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int16) - 128
    parts: list[list[bytes]] = [[_head(g, len(p))] for g, p in zip(frames, payloads, strict=True)]
    for scan in SCANS:
        orders = [_order(g, scan[0]) for g in frames]
        blocks = np.concatenate([o[0] + at for o, at in zip(orders, starts, strict=False)])
        each = [-(-(len(o[0]) // o[2]) // RESTART) for o in orders]
        firsts = np.cumsum([0, *each])
        stream = np.concatenate([np.arange(len(o[0])) // (o[2] * RESTART) + f for o, f in zip(orders, firsts, strict=False)])
        if scan[3]:
            raw, sizes = _pack_bits(*_refining_bits(values[blocks], scan), stream, int(firsts[-1]))
        else:
            raw, sizes = _pack(*_tokens(values[blocks], np.concatenate([o[1] for o in orders]), stream, scan), int(firsts[-1]))
        # stuffing, then a restart marker after each stream but a scan's last
        is_ff = raw == 255
        ends = np.cumsum(sizes)
        stuffed = np.insert(raw, np.flatnonzero(is_ff) + 1, 0)
        ends += np.r_[0, np.cumsum(is_ff)][ends]
        inner = np.ones(int(firsts[-1]), dtype=bool)
        inner[firsts[1:] - 1] = False
        number = (np.arange(len(inner)) - np.repeat(firsts[:-1], each)) % 8
        marks = np.repeat(ends[inner], 2)
        body = np.insert(stuffed, marks, np.stack([np.full(int(inner.sum()), 255), 0xD0 + number[inner]], axis=1).ravel()).astype(np.uint8).tobytes()
        ends = (ends + 2 * np.cumsum(inner))[firsts[1:] - 1]
        head = _sos(*scan)
        for part, a, b in zip(parts, np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            part += [head, body[a:b]]
    return [b"".join([*part, b"\xff\xd9"]) for part in parts]


class Scan(NamedTuple):
    which: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int
    tables: tuple[bytes, ...]
    begin: int
    end: int
    restart: int


class Image(NamedTuple):
    """A parsed file: frame, quantizers by component, scans, and the comment's payload size."""

    frame: Geometry
    quants: list[np.ndarray]
    scans: list[Scan]
    payload: int


@lru_cache(maxsize=256)
def _quantizers(body: bytes) -> dict[int, np.ndarray]:
    found = {}
    while body:
        wide = body[0] >> 4
        found[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float64)
        body = body[1 + 64 * (1 + wide) :]
    return found


@lru_cache(maxsize=256)
def _huffman(body: bytes) -> dict[int, bytes]:
    found = {}
    while body:
        n = sum(body[1:17])
        found[body[0]] = body[1 : 17 + n]
        body = body[17 + n :]
    return found


@lru_cache(maxsize=4096)
def _frame(body: bytes) -> Geometry:
    depth, height, width, n = struct.unpack_from(">BHHB", body)
    if depth != 8:
        raise ValueError("only samples of 8 bits are known")
    return Geometry(width, height, tuple(Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)))


@lru_cache(maxsize=4096)
def _scan_head(body: bytes, idents: tuple[int, ...]) -> tuple:
    """Components, band, bits and the tables' numbers of a scan header."""
    n = body[0]
    first, last, bits = body[1 + 2 * n : 4 + 2 * n]
    high, low = bits >> 4, bits & 15
    names = [body[2 + 2 * i] for i in range(n)]
    used = () if not first and high else tuple(0x10 | t & 15 for t in names) if first else tuple(t >> 4 for t in names)
    return tuple(idents.index(body[1 + 2 * i]) for i in range(n)), first, last, high, low, used


def parse(data: bytes, base: int, marks: list[int]) -> Image:
    """The markers of one file. marks: where in the batch, in which this file begins at `base`,
    an FF stands that is neither stuffed nor a restart."""
    at, frame, quants, tables, restart, scans, payload = 2, None, {}, {}, 0, [], 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at < len(data) and data[at + 1] != 0xD9:
        marker, size = data[at + 1], data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDA:
            *head, used = _scan_head(body, tuple(c.ident for c in frame.components))
            end = marks[bisect_left(marks, base + at)] - base
            scans.append(Scan(*head, tuple(tables[t] for t in used), base + at, base + end, restart))
            at = end
        elif marker == 0xDB:
            quants.update(_quantizers(body))
        elif marker == 0xC4:
            tables.update(_huffman(body))
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xC2:
            frame = _frame(body)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"frame type {marker:x} is not progressive Huffman")
        elif marker == 0xFE and body.startswith(b"payload "):
            payload = int(body[8:])
    return Image(frame, [quants[c.quant] for c in frame.components], scans, payload)


@lru_cache(maxsize=4096)
def _level(before: tuple, which: tuple[int, ...], first: int, last: int) -> int:
    """How many rounds a scan waits for. before: (components, first, last, level) of those ahead."""
    return 1 + max([v for w, f, e, v in before if set(w) & set(which) and f <= last and first <= e], default=-1)


@lru_cache(maxsize=4096)
def _begins(g: Geometry, which: tuple[int, ...], restart: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs between restart markers begin among a scan's blocks, and their blocks."""
    order, _, unit = _order(g, which)
    begins = np.arange(0, len(order), restart * unit or len(order))
    return begins, np.diff(np.r_[begins, len(order)])


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> np.ndarray:
    """symbol << 8 | length for each 16 bits that follow; length 0 where no code begins."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = table[at] << 8 | n
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Reader:
    """The unstuffed bits of a batch: 57 and more from any bit on."""

    def __init__(self, data: np.ndarray):
        padded = np.r_[data, np.zeros(24, np.uint8)]
        self.bits = np.unpackbits(padded)
        w = padded.astype(np.uint64)
        for k in (1, 2, 4):
            w = w[:-k] << np.uint64(8 * k) | w[k:]
        self.words = w

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The bits from `at` on, from the highest bit down."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def symbol(self, at: np.ndarray, table: np.ndarray, offset: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, place after it, the bits that follow it)."""
        word = self.peek(at)
        found = table[(word >> np.uint64(48)).astype(np.int64) + offset]
        size = found & 255
        if not size.all():
            raise ValueError("a code is not in its Huffman table")
        return found >> 8, at + size, word << size.astype(np.uint64)


def _extended(word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed number in the highest `size` bits; 0 for none."""
    raw = (word >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
    return np.where(raw < np.int64(1) << np.maximum(size - 1, 0), raw - _bits(size), raw)


def _dc_first(read: _Reader, at, place, end, order, owner, coef, scan: Scan) -> None:
    names = sorted(set(scan.tables))
    tables = np.concatenate([_lookup(t) for t in names])
    offset = np.array([names.index(t) << 16 for t in scan.tables])
    seen = np.zeros((len(at), len(scan.which)), np.int64)
    row = np.arange(len(at))
    while len(row):
        who = owner[place]
        size, at, word = read.symbol(at, tables, offset[who])
        seen[row, who] += _extended(word, size)
        coef[order[place], 0] = seen[row, who] << scan.low
        at, place = at + size, place + 1
        on = place < end
        if not on.all():
            at, place, end, row = at[on], place[on], end[on], row[on]


def _ac_first(read: _Reader, at, place, end, order, coef, scan: Scan) -> None:
    table, flat = _lookup(scan.tables[0]), coef.reshape(-1)
    k = np.full(len(at), scan.first)
    while len(at):
        symbol, at, word = read.symbol(at, table)
        run, size = symbol >> 4, symbol & 15
        some = size > 0
        if some.all():
            k += run
            flat[order[place] * 64 + k] = _extended(word, size) << scan.low
            at += size
            k += 1
            step = (k > scan.last).astype(np.int64)
        else:
            k = k + np.where(some | (run == 15), run, 0)
            flat[order[place[some]] * 64 + k[some]] = _extended(word[some], size[some]) << scan.low
            eob = ~some & (run < 15)
            more = (word >> np.uint64(1) >> (63 - run).astype(np.uint64)).astype(np.int64)
            at += np.where(eob, run, size)
            k += 1
            step = np.where(eob, (np.int64(1) << run) + more, k > scan.last)
        place = place + step
        k[step > 0] = scan.first
        on = place < end
        if not on.all():
            at, place, end, k = at[on], place[on], end[on], k[on]


def _ac_refine(read: _Reader, at, place, end, order, coef, scan: Scan) -> None:
    table, index = _lookup(scan.tables[0]), np.arange(64)
    k, skip, one = np.full(len(at), scan.first), np.zeros(len(at), np.int64), 1 << scan.low
    while len(at):
        reads = skip == 0
        symbol, after, word = read.symbol(at[reads], table)
        run, fresh = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        positive = np.zeros(len(at), bool)
        run[reads], fresh[reads] = symbol >> 4, (symbol & 15) > 0
        zrl = np.zeros(len(at), bool)
        zrl[reads] = symbol == 0xF0
        r = symbol >> 4
        ends_band = (symbol & 15 == 0) & (r < 15)
        more = (word >> np.uint64(1) >> (63 - r).astype(np.uint64)).astype(np.int64)
        skip[reads] = np.where(ends_band, (np.int64(1) << r) + more, 0)
        positive[reads] = (word >> np.uint64(63)).astype(bool)
        at[reads] = after + np.where(ends_band, r, np.where(symbol & 15 > 0, 1, 0))
        blocks = order[place]
        rows = coef[blocks]
        old = (rows != 0) & (index >= k[:, None]) & (index <= scan.last)
        stop = np.full(len(at), scan.last + 1)
        if fresh.any() or zrl.any():
            # a run passes so many zeros, a new coefficient takes the next; else the band's end
            zeros = np.cumsum((rows == 0) & (index >= k[:, None]) & (index <= scan.last), axis=1)
            reached = zeros >= np.where(fresh, run + 1, np.where(zrl, 16, 99))[:, None]
            stop = np.where(reached.any(axis=1), reached.argmax(axis=1), stop)
            old &= index < stop[:, None]
        n = np.count_nonzero(old, axis=1)
        bit = read.bits[np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].astype(np.int16) << scan.low
        held = rows[old]
        rows[old] = held + np.where(held > 0, bit, -bit)
        coef[blocks] = rows
        at = at + n
        put = fresh & (stop <= scan.last)
        coef[blocks[put], stop[put]] = np.where(positive[put], one, -one)
        k = stop + 1
        done = (skip > 0) | (k > scan.last)
        skip = np.maximum(skip - 1, 0)
        place = place + done
        k[done] = scan.first
        on = place < end
        if not on.all():
            at, place, end, k, skip = at[on], place[on], end[on], k[on], skip[on]


def coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray, np.ndarray]:
    """(images, coefficients in scan order of all blocks, where each image's blocks begin).

    Scans that touch the same coefficients of a component wait for each other; all others of
    one kind and one set of tables, whatever their file, are decoded together.
    """
    raw = np.frombuffer(b"".join(files), np.uint8)
    bases = np.cumsum([0, *map(len, files)])
    ff = np.flatnonzero(raw[:-1] == 255)
    follow = raw[ff + 1]
    restarts = ff[(follow >= 0xD0) & (follow <= 0xD7)]
    marks = ff[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7))].tolist()
    images = [parse(f, int(b), marks) for f, b in zip(files, bases, strict=False)]
    kept = ~((raw == 0) & (np.r_[0, raw[:-1]] == 255))
    new_place = np.cumsum(kept) - kept
    read = _Reader(raw[kept])
    starts = np.cumsum([0, *(x.frame.starts()[-1] for x in images)])
    coef = np.zeros((int(starts[-1]), 64), dtype=np.int16)
    groups: dict = {}
    for n, image in enumerate(images):
        before: tuple = ()
        for x in image.scans:
            level = _level(before, x.which, x.first, x.last)
            before += ((x.which, x.first, x.last, level),)
            groups.setdefault((level, x.first, x.last, x.high, x.low, x.tables, len(x.which)), []).append((n, x))
    for key in sorted(groups, key=lambda k: k[0]):
        numbers = np.array([n for n, _ in groups[key]])
        orders = [_order(images[n].frame, x.which) for n, x in groups[key]]
        runs = [_begins(images[n].frame, x.which, x.restart) for n, x in groups[key]]
        sizes, counts = np.array([len(o[0]) for o in orders]), np.array([len(r[0]) for r in runs])
        order = np.concatenate([o[0] for o in orders]) + np.repeat(starts[numbers], sizes)
        owner = np.concatenate([o[1] for o in orders])
        place = np.concatenate([r[0] for r in runs]) + np.repeat(np.cumsum(sizes) - sizes, counts)
        end = place + np.concatenate([r[1] for r in runs])
        begin, stop = (np.array([getattr(x, f) for _, x in groups[key]]) for f in ("begin", "end"))
        scan_of = np.searchsorted(begin, restarts, side="right") - 1
        inner = (scan_of >= 0) & (restarts < stop[scan_of])
        if not np.array_equal(np.bincount(scan_of[inner], minlength=len(begin)) + 1, counts):
            raise ValueError("a scan does not have the restart markers that its frame asks for")
        at = new_place[np.sort(np.concatenate([begin, restarts[inner] + 2]))] * 8
        scan = groups[key][0][1]
        if scan.first:
            (_ac_refine if scan.high else _ac_first)(read, at, place, end, order, coef, scan)
        elif not scan.high:
            _dc_first(read, at, place, end, order, owner, coef, scan)
        else:
            nth = np.arange(len(order)) - np.repeat(place, end - place)
            coef[order, 0] |= (read.bits[np.repeat(at, end - place) + nth].astype(np.int16) << scan.low).astype(np.int16)
    return images, coef, starts


def _inverse() -> np.ndarray:
    """The inverse DCT of 64 coefficients in scan order as whole numbers of 2**-13, so that
    sums are exact and do not depend on what else is in a batch."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    both = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.round(both[ZIGZAG] * 8192)


INVERSE = _inverse()


def to_rgb(g: Geometry, quants: list[np.ndarray], coef: np.ndarray) -> np.ndarray:
    """(images, height, width, 3) samples of images of one frame, coef: (images, blocks, 64):
    dequantized, inverse-transformed, chroma repeated to full resolution, and turned from YCbCr
    to RGB in whole numbers."""
    planes, n = [], len(coef)
    starts, (most_h, most_v) = g.starts(), g.most
    for i, c in enumerate(g.components):
        across, down = g.grid(i)
        exact = (coef[:, starts[i] : starts[i + 1]].reshape(-1, 64) * quants[i]) @ INVERSE
        samples = np.clip(np.floor(exact / 8192 + 0.5) + 128, 0, 255).astype(np.int32)
        plane = samples.reshape(n, down, across, 8, 8).swapaxes(2, 3).reshape(n, down * 8, across * 8)
        if i:
            plane = plane - 128
        if (most_h, most_v) != (c.h, c.v):
            plane = plane.repeat(most_v // c.v, axis=1).repeat(most_h // c.h, axis=2)
        planes.append(plane[:, : g.height, : g.width])
    rgb = np.empty((n, g.height, g.width, 3), np.uint8)
    if len(planes) == 1:
        rgb[:] = planes[0][..., None]
        return rgb
    y, cb, cr = (planes[0] << 16) + 32768, planes[1], planes[2]
    for j, plane in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        rgb[..., j] = np.clip(plane >> 16, 0, 255)
    return rgb


def tensors(images: list[Image], coef: np.ndarray, starts: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """(image's number, its RGB tensor), those of one frame and one set of quantizers together."""
    alike: dict = {}
    for i, x in enumerate(images):
        alike.setdefault((x.frame, *[q.tobytes() for q in x.quants]), []).append(i)
    for (g, *_), members in alike.items():
        step = max(1, most // (g.width * g.height))
        for k in range(0, len(members), step):
            part = members[k : k + step]
            blocks = starts[part][:, None] + np.arange(g.starts()[-1])
            yield from zip(part, to_rgb(g, images[part[0]].quants, coef[blocks]), strict=True)


def stored_payload(image: Image, coef: np.ndarray) -> bytes:
    """The bytes that encode() stored in an image's coefficients."""
    return (coef[: image.payload // 64] + 128).astype(np.uint8).tobytes()


def store_text(docs: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """docs with out_col, a progressive JPEG file (binary) that holds each whole text's UTF-8
    bytes and their padding without loss. A null or empty text is one unit of padding. Repeated
    rows repeat, other columns stay, a taken name gets underscores."""
    name = free_name(docs.columns, out_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [payload_of(t) for t in text_bytes(batch.column(at))]
            for a, b in slices(payloads, SLICE):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(encode(payloads[a:b]), pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(b"").alias(name)).schema)


def decode_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with height, width and rgb (binary, height x width x 3 samples) of each progressive
    JPEG file. A null file gives nulls; a damaged one raises ValueError. Names that are taken
    get underscores."""
    names = [free_name(media.columns, c) for c in ("height", "width", "rgb")]
    at = media.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(at).to_pylist()
            for a, b in slices([f or b"" for f in files], SLICE):
                out: list = [(None, None, None)] * (b - a)
                here = [i for i in range(a, b) if files[i]]
                images, coef, starts = coefficients([files[i] for i in here]) if here else ([], None, [])
                for n, rgb in tensors(images, coef, starts):
                    out[here[n] - a] = (rgb.shape[0], rgb.shape[1], rgb.tobytes())
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *columns], [*batch.schema.names, *names])

    return media.mapInArrow(run, media.select("*", *[F.lit(v).alias(c) for v, c in zip((0, 0, b""), names, strict=True)]).schema)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: each whole text stored as a file, read back and described.

    doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the payload read back from
    the coefficients), media_bytes and media_sha256 (of the file), feature (size, mean of each
    colour, CRC-32 of the RGB tensor). All depend on the text alone. A null text is empty.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in slices(texts, SLICE):
                files = encode([payload_of(t) for t in texts[a:b]])
                images, coef, starts = coefficients(files)
                rows: list = [None] * (b - a)
                for i, rgb in tensors(images, coef, starts):
                    back, file = stored_payload(images[i], coef[starts[i] : starts[i + 1]]), files[i]
                    means = ",".join(f"{v / (rgb.size // 3):.4f}" for v in rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist())
                    feature = f"{rgb.shape[1]}x{rgb.shape[0]};{means};{zlib.crc32(rgb):08x}"
                    rows[i] = (len(texts[a + i]), len(back), sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), sha256(file).hexdigest(), feature)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names)

    return kept.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
