"""SimHash near-dedup: whole-text fingerprints, linked through pigeonring filtering; and, for a
shingle similarity far below what so few bits can tell, bands of minima with an exact check."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbral.llm.components import connected_components
from timbral.llm.shared import settle, slices, text_bytes

SEED = 42
#: Segments of the 64 bits, as (lowest bit, width), in ring order.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket of equal segments with more fingerprints than this goes through midpoints instead.
DENSE = 128
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Bands of minima and minima in each: a pair of Jaccard similarity s shares no band with
#: probability (1 - s^ROWS)^BANDS, 8e-5 at 0.8 and 5e-8 at 0.85.
BANDS, ROWS = 40, 7
#: Two bits of each minimum are a set's signature, in so many longs. A pair of the asked similarity
#: is ruled out by its share of equal ones when that is DEVIATIONS standard deviations too low,
#: with probability 3e-5.
WORDS, DEVIATIONS = -(-BANDS * ROWS // 32), 4
#: Shingles whose minima are taken at once.
STEP = 256
#: Rounds in which the documents of a band are compared with one of them only, before all those
#: that are still in different components are compared.
STARS = 2


def fingerprint(text: bytes, size: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats counted.

    Words are runs of bytes outside ASCII white space, with A-Z lower-cased. A text of fewer
    words than a shingle has one shingle, all its words; a text without words has 0. A bit is
    set when over half the shingles' XXH64 values have it.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    total = max(1, len(words) - size + 1)
    shingles = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED))
    counts = np.zeros(64, dtype=np.int64)
    left = total
    while left > 0:
        block = np.fromiter(hashes, dtype="<u8", count=min(BLOCK, left))
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
        left -= len(block)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row of docs; a null text counts as empty. Extra columns go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, size) for t in text_bytes(batch.column(1))], dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view("<i8"))], ["doc_id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())]))


def _segment(fp: Column, i: int) -> Column:
    low, width = SEGMENTS[i]
    return F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1)


def links(prints: DataFrame) -> DataFrame:
    """(a, b) pairs of `rep` whose fingerprints differ in at most two bits, enough to connect
    all that such pairs connect. prints: distinct (fp, rep).

    Pigeonring with a budget of 2 bits over 3 segments on a ring: some segment starts a chain
    whose first 1, 2 and 3 segments differ in at most 2/3, 4/3 and 2 bits, so 0, 1 and 2. The
    join finds the equal first segment, its condition checks the chain's second prefix, and
    the full Hamming check comes last.

    Segment values with over DENSE fingerprints would compare too many pairs. There each
    fingerprint stands under itself and its 64 one-bit changes: two differ in at most 2 bits
    exactly when they share such a midpoint. A midpoint has at most 65 fingerprints, all
    within 2 bits of each other, so links to the smallest lose none of the connections.
    """
    segments = prints.select(
        "fp",
        "rep",
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _segment(F.col("fp"), i).alias("first"), _segment(F.col("fp"), (i + 1) % 3).alias("second")) for i in range(3)])).alias("s"),
    ).select("fp", "rep", "s.*")
    sizes = segments.groupBy("i", "first").agg(F.count("*").alias("n")).where("n > 1")
    sized = settle(segments.join(sizes, ["i", "first"]), "segments")

    x, y = (sized.where(F.col("n") <= DENSE).select("i", "first", *[F.col(c).alias(f"{c}_{s}") for c in ("fp", "rep", "second")]) for s in "xy")
    chains = x.join(y, ["i", "first"]).where("rep_x < rep_y and bit_count(second_x ^ second_y) <= 1")
    near = chains.where("bit_count(fp_x ^ fp_y) <= 2").select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b"))

    crowded = sized.where(F.col("n") > DENSE).select("fp", "rep").distinct()
    changes = F.array(F.lit(0).cast("long"), *[F.lit(v).cast("long") for v in (1 << np.arange(64, dtype=np.uint64)).astype(np.int64).tolist()])
    midpoints = crowded.select("rep", F.explode(F.transform(changes, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    stars = midpoints.groupBy("mid").agg(F.collect_list("rep").alias("reps")).where(F.size("reps") > 1)
    starred = stars.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a != b").distinct()
    return near.union(starred)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: components of links at 2 or fewer bits.

    component_id is the smallest doc_id reachable. Rows with equal fingerprints count as one
    until the end, so copies are never paired. Rows with a null id get the component of their
    fingerprint (null if no row with an id shares it). An empty table gives no rows.
    """
    each = settle(fingerprints(docs, id_col, text_col, size), "fingerprints")
    prints = each.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = connected_components(links(prints.where("rep is not null")))
    of = prints.join(found, prints["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return each.join(of, "fp").select("doc_id", "fp", "component_id")


def shingles(text: bytes, size: int) -> np.ndarray:
    """The distinct XXH64 values of the text's word shingles, ascending; words as fingerprint()."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS minima of the hashes under random linear maps, and the WORDS longs
    of the signature."""
    rng = np.random.default_rng(SEED)
    a, b = (rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), STEP):
        np.minimum(least, (hashes[i : i + STEP, None] * (a | np.uint64(1)) + b).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    bits = np.zeros(32 * WORDS, np.uint64)
    bits[: len(least)] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(62)
    signature = np.bitwise_or.reduce(bits.reshape(WORDS, 32) << np.arange(0, 64, 2, dtype=np.uint64), axis=1)
    return np.concatenate([key, signature])


def _unlike(x: Column, y: Column) -> Column:
    """How many minima differ in their two bits, of two signatures."""
    both = [F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))) for i in range(WORDS)]
    odd = [F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(0x5555555555555555))) for v in both]
    return reduce(Column.__add__, odd)


def _shingled(docs: DataFrame, size: int, whole: bool) -> DataFrame:
    """(doc_id, set long, n, values) of docs (doc_id, text): the shingle set's hash and size, and
    all its values or its band keys and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in slices(texts):
                found = [shingles(t, size) for t in texts[lo:hi]]
                named = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], dtype=np.uint64).view(np.int64)
                values = found if whole else [band_keys(x) if len(x) else x for x in found]
                ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(named), pa.array([len(x) for x in found], pa.int64()), lists], ["doc_id", "set", "n", "values"])

    return docs.mapInArrow(run, "doc_id long, set long, n long, values array<long>")


def similar_documents(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row: components of links between documents whose sets of
    word shingles have a Jaccard similarity of `similarity` or more.

    At 0.8 about ten of a SimHash's 64 bits differ, as many as no split into segments can look
    up, so candidates share a band of minima. Every candidate's similarity is counted exactly.
    Equal sets (those without words too) count as one until the end. Documents of a band are
    first compared with one of them, STARS times; then all that share a band and are still in
    different components are compared, so no link that joins components is left out. Of those,
    signatures rule out pairs far below the similarity before they leave the join, and a pair
    leaves it in the first band that both share alone.

    component_id is the smallest doc_id reachable. Rows with a null id get the component of
    their set (null if no row with an id shares it).
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    each = settle(_shingled(own, size, False), "shingled")
    sets = each.where("doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "values"), "doc_id").alias("x"))
    sets = settle(sets.select("set", "rep", "x.n", "x.values"), "sets")
    rows = sets.select("set", "rep", "n", F.explode(F.slice("values", 1, BANDS)).alias("band"))
    shared = settle(rows.join(rows.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band"), "band"), "bands")
    asked = own.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    values = settle(_shingled(asked, size, True).select("set", "values").dropDuplicates(["set"]), "values")

    def linked(pairs: DataFrame) -> DataFrame:
        fit = pairs.where(F.least("n_x", "n_y") >= similarity * F.greatest("n_x", "n_y") - 1e-9)
        fit = fit.select("set_x", "set_y", "rep_x", "rep_y", "n_x", "n_y").distinct()
        both = fit.join(values.toDF("set_x", "v_x"), "set_x").join(values.toDF("set_y", "v_y"), "set_y")
        common = F.size(F.array_intersect("v_x", "v_y"))
        near = both.where(common >= similarity * (F.col("n_x") + F.col("n_y") - common) - 1e-9)
        return settle(near.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")), "links")

    edges = sets.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    found = connected_components(edges)
    columns = ["set", "rep", "n", "component"]
    for i in range(STARS + 1):
        named = shared.join(found, shared["rep"] == found["node"], "left").select("band", "set", "rep", "n", F.coalesce("component", "rep").alias("component"))
        centre = F.min(F.struct(F.xxhash64(F.lit(i), "set").alias("h"), *columns)).alias("y")
        mixed = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), centre).where("lo != hi").select("band", "y")
        left = settle(named.join(mixed, "band"), "mixed")
        if left.isEmpty():
            break
        if i < STARS:
            pairs = left.select(*[F.col(c).alias(f"{c}_x") for c in columns], *[F.col(f"y.{c}").alias(f"{c}_y") for c in columns])
            pairs = pairs.where("component_x != component_y")
        else:
            parts = {"keys": F.slice("values", 1, BANDS), "sig": F.slice("values", BANDS + 1, WORDS)}
            signed = left.drop("y").join(sets.select("set", *[c.alias(k) for k, c in parts.items()]), "set")
            x, y = (signed.select("band", *[F.col(c).alias(f"{c}_{s}") for c in [*columns, *parts]]) for s in "xy")
            equal = 0.25 + 0.75 * similarity
            most = BANDS * ROWS * (1 - equal) + DEVIATIONS * sqrt(BANDS * ROWS * equal * (1 - equal))
            near = (F.col("component_x") < F.col("component_y")) & (_unlike(F.col("sig_x"), F.col("sig_y")) <= most)
            once = F.get(F.array_intersect("keys_x", "keys_y"), F.lit(0)) == x["band"]
            pairs = x.join(y, (x["band"] == y["band"]) & near & once)
        edges = edges.union(linked(pairs))
        found = connected_components(edges)
    of = sets.join(found, sets["rep"] == found["node"], "left").select("set", F.coalesce("component", "rep").alias("component_id"))
    return each.select("doc_id", "set").join(of, "set", "left").select("doc_id", "component_id")


def near_or_similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every document with an id: components of all links, those of
    fingerprints at 2 or fewer bits and those of similar_documents(), both over shingles of `size`
    words. A document that only one of the two links is linked."""
    groups = [near_duplicates(docs, id_col, text_col, size), similar_documents(docs, size, similarity, id_col, text_col)]
    edges = reduce(DataFrame.union, [g.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")) for g in groups])
    found = connected_components(edges.where("a is not null and a != b").distinct())
    own = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return own.join(found, own["doc_id"] == found["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, similarity: float | None = None) -> DataFrame:
    """docs without the rows whose document is not the smallest id of its component: of
    near_duplicates(), or with a similarity of near_or_similar().

    Rows with a null id stay, since nothing orders them; so do further rows with a kept id.
    """
    groups = near_duplicates(docs, id_col, text_col, size) if similarity is None else near_or_similar(docs, size, similarity, id_col, text_col)
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
