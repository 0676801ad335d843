"""Embedding near-dedup: NN-descent over a neighbour graph, audited, with threshold links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbral.llm.components import connected_components
from timbral.llm.shared import discard, settle

#: Orderings of the vectors by random hyperplanes that start the graph, two more for each doubling
#: of the largest group beyond 2^WELL vectors; and rows compared at once.
TREES, WELL, CHUNK = 16, 16, 128
#: Rows that share a signature of hyperplane sides on average.
LEAF = 48
#: Neighbours in a list at first, whatever their similarity, and once it was saturated with links
#: again and again.
LIST, LONGEST = 8, 96
#: Marks what is no neighbour.
NONE = -2.0
#: Members of a centre compared at once.
GROUP = 64
ROUNDS = 8
#: Vectors of one block when a component's links are counted.
BLOCK = 2048
#: Vectors of any kind, and as many that have links, whose links are compared with brute force; the
#: recall below which the graph gets more trees; and the least that is returned.
AUDITED, RECALL, LEAST_RECALL = 256, 0.97, 0.9
HEAD = ["grp", "id"]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The flat values and the offsets of a batch's `vec` column."""
    vec = batch.column(batch.schema.get_field_index("vec"))
    return vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    if not len(keys[0]):
        return np.array([0])
    change = np.zeros(len(keys[0]) - 1, dtype=bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.r_[0, np.flatnonzero(change) + 1, len(keys[0])]


def _best(ids: np.ndarray, x: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, s) for each row's `most` most similar other rows."""
    s = x @ x.T
    s[ids[:, None] == ids[None, :]] = NONE
    if len(ids) > most:
        bar = np.partition(s, len(ids) - most, axis=1)[:, len(ids) - most]
        s[s < bar[:, None]] = NONE
    i, j = np.nonzero(s > NONE)
    if len(i):
        yield ids[i], ids[j], s[i, j]


def _compared(rows: DataFrame, keys: list[str], size: int, most: int) -> DataFrame:
    """(a, b, s) among each `size` rows in turn that share keys, as they lie in the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, ends = _columns(batch)
            ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
            starts = _runs(*[batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
            found = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                for i in range(lo, hi, size):
                    j = min(hi, i + size)
                    if j - i > 1:
                        found += _best(ids[i:j], values[ends[i] : ends[j]].reshape(j - i, -1), most)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b", "s"])

    return rows.select(*keys, *[c for c in ("id", "vec") if c not in keys]).mapInArrow(run, "a long, b long, s double")


def usable(embeddings: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(grp, id, m, vec): distinct vectors of length 1 with the smallest id and the number of
    rows that hold each. grp stands for label and dimension. Null labels, null or empty
    vectors, zero vectors and vectors with null or non-finite components are left out."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = embeddings.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vec.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    largest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    rows = rows.where(fine).withColumn("top", largest).where("top > 0")
    once = rows.groupBy("label", "v", "top").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    scaled = F.transform("v", lambda x: x / F.col("top"))  # squares of huge or tiny components stay finite
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x))
    once = once.withColumn("w", scaled).withColumn("norm", norm)
    return once.select(F.xxhash64("label", F.size("v")).alias("grp"), "id", "m", F.transform("w", lambda x: x / F.col("norm")).alias("vec"))


def _forest(vectors: DataFrame, trees: int, seed: int) -> DataFrame:
    """Candidate links among rows next to each other under random hyperplanes.

    For each tree a vector's signature is its sides of log2(group / LEAF) hyperplanes; rows are
    range-partitioned by tree, group, signature and one more projection, and each CHUNK of
    them is compared. A crowded signature is just more chunks, in as many tasks as it takes.
    """
    sizes = vectors.groupBy("grp").agg(F.count("*").alias("size"))
    sized = vectors.join(F.broadcast(sizes) if sizes.count() < 100_000 else sizes, "grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            values, ends = _columns(batch)
            size = batch.column(batch.schema.get_field_index("size")).to_numpy()
            dims = np.diff(ends)
            starts = _runs(dims)
            for t in range(trees):
                sig, place = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
                depth = np.clip(np.ceil(np.log2(np.maximum(size / LEAF, 1))), 0, 50).astype(np.int64)
                for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                    if (key := (t, int(dims[lo]))) not in planes:
                        planes[key] = np.random.default_rng([seed, *key]).normal(size=(key[1], 51))
                    p = values[ends[lo] : ends[hi]].reshape(hi - lo, -1) @ planes[key]
                    used = np.arange(50)[None, :] < depth[lo:hi, None]
                    sig[lo:hi] = ((p[:, :50] > 0) & used) @ (1 << np.arange(50))
                    place[lo:hi] = p[:, 50]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, dtype=np.int32)), *[batch.column(batch.schema.get_field_index(c)) for c in HEAD], pa.array(sig), pa.array(place), batch.column(batch.schema.get_field_index("vec"))], ["tree", *HEAD, "sig", "place", "vec"])

    laid = sized.mapInArrow(run, "tree int, grp long, id long, sig long, place double, vec array<double>")
    parts = max(8, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = laid.repartitionByRange(parts, "tree", "grp", "sig", "place").sortWithinPartitions("tree", "grp", "sig", "place")
    return _compared(laid, ["tree", "grp"], CHUNK, LIST)


def _kept(found: DataFrame, lengths: DataFrame | None) -> DataFrame:
    """(a, b, s, k, full): each list's most similar neighbours, k of them."""
    once = found.groupBy("a", "b").agg(F.max("s").alias("s"))
    rows = once.join(lengths, "a", "left").withColumn("k", F.coalesce("k", F.lit(LIST))) if lengths is not None else once.withColumn("k", F.lit(LIST))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return rows.withColumn("place", place).where("place <= k").select("a", "b", "s", "k")


def _saturated(graph: DataFrame, threshold: float) -> DataFrame:
    """(a, k) of full lists whose last neighbour is a link: there may be more."""
    return graph.groupBy("a", "k").agg(F.count("*").alias("n"), F.min("s").alias("last")).where((F.col("n") >= F.col("k")) & (F.col("last") >= threshold)).select("a", "k")


def _descend(graph: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Rounds of neighbours-of-neighbours joins until the lists hardly change.

    Each vector is a centre; those it lists and those that list it meet there and are compared,
    GROUP at once. A centre's members are range-partitioned with it, so a hub is no hot key.
    A list that is full of links doubles, up to LONGEST.
    """
    parts = max(8, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    before = (-1, -1)
    for i in range(ROUNDS):
        wider = _saturated(graph, threshold).select("a", F.least(F.col("k") * 2, F.lit(LONGEST)).alias("k"))
        lengths = graph.select("a", "k").distinct().join(wider.withColumnRenamed("k", "wide"), "a", "left").select("a", F.coalesce("wide", "k").alias("k"))
        pairs = graph.select(F.col("a").alias("centre"), F.col("b").alias("id")).union(graph.select("b", "a")).union(graph.select("a", "a")).distinct()
        members = pairs.join(vectors.select("id", "vec"), "id").withColumn("mixed", F.xxhash64(F.lit(i), "id", "centre"))
        members = members.repartitionByRange(parts, "centre", "mixed").sortWithinPartitions("centre", "mixed")
        found = _compared(members, ["centre"], GROUP, LIST * 2)
        new = settle(_kept(graph.select("a", "b", "s").union(found), lengths), "neighbours")
        discard(graph)
        graph = new
        after = tuple(graph.agg(F.count("*"), F.sum(F.round("s", 6))).first())
        if after[0] == before[0] and abs((after[1] or 0) - (before[1] or 0)) <= 1e-3 * max(1, after[0]):
            break
        before = after
    return graph


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links): each member's number of links inside its component, copies counted.

    members: (component, size, id, m, grp, vec). A component is cut into blocks of about BLOCK
    vectors, and each pair of blocks is one small group; only counts leave it. Small components
    share groups.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = members.withColumn("nb", blocks).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    share = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("component"), F.lit(max(1, members.count() // 2048)))).otherwise(F.col("component"))
    others = F.sequence(F.lit(0), F.col("nb") - 1)
    rows = rows.withColumn("share", share).withColumn("other", F.explode(others)).select("share", "nb", "component", "id", "m", "vec", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, one in rows.groupby("component"):
            i, j = int(one["i"].iloc[0]), int(one["j"].iloc[0])
            left, right = one[one["blk"] == i], one[one["blk"] == j]
            if not len(left) or not len(right):
                continue
            near = np.stack(left["vec"].to_numpy()) @ np.stack(right["vec"].to_numpy()).T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
            out.append(pd.DataFrame({"id": left["id"], "links": near @ right["m"].to_numpy()}))
            if i != j:
                out.append(pd.DataFrame({"id": right["id"], "links": left["m"].to_numpy() @ near}))
        return pd.concat(out) if out else pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})

    parts = rows.groupBy("share", "nb", "i", "j").applyInPandas(count, "id long, links long")
    return parts.groupBy("id").agg(F.sum("links").alias("links"))


def audit(vectors: DataFrame, links: DataFrame, threshold: float) -> float:
    """Recall of links (id, links) against brute force: of AUDITED vectors of any kind and
    AUDITED with links, those with the smallest hash, compared with all rows; the mean over the
    vectors that truly have links."""
    order = [F.xxhash64(F.lit("audit"), "id"), F.col("id")]
    some = vectors.orderBy(*order).limit(AUDITED).select("grp", "id", "vec")
    linked = vectors.join(links.where("links > 0").select("id"), "id", "left_semi").orderBy(*order).limit(AUDITED).select("grp", "id", "vec")
    asked = some.union(linked).toPandas().drop_duplicates("id")
    if not len(asked):
        return 1.0
    by_dim = {d: (g["grp"].to_numpy(), g["id"].to_numpy(), np.stack(g["vec"].to_numpy())) for d, g in asked.groupby(asked["vec"].map(len))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _columns(batch)
            grp, ids, m = (batch.column(i).to_numpy() for i in range(3))
            starts = _runs(np.diff(ends))
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if batch.num_rows and (q := by_dim.get(int(ends[lo + 1] - ends[lo]))):
                    near = (q[2] @ values[ends[lo] : ends[hi]].reshape(hi - lo, -1).T >= threshold) & (q[0][:, None] == grp[lo:hi]) & (q[1][:, None] != ids[lo:hi])
                    yield pa.RecordBatch.from_arrays([pa.array(q[1]), pa.array(near @ m[lo:hi])], ["id", "truly"])

    truth = vectors.select("grp", "id", "m", "vec").mapInArrow(run, "id long, truly long").groupBy("id").agg(F.sum("truly").alias("truly"))
    share = F.least(F.coalesce("links", F.lit(0)), "truly") / F.col("truly")
    found = truth.where("truly > 0").join(links, "id", "left").agg(F.avg(share)).first()[0]
    return 1.0 if found is None else found


def embedding_near_dedup(embeddings: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings.

    Vectors link when their labels are equal and not null and their cosine, in double
    precision, is threshold or more. Equal vectors count as one until the end. A random forest
    starts the neighbour graph, NN-descent refines it, and list entries of threshold or more
    are links. In each component of them links are then counted exactly, block by block, at
    every size; that costs the square of a component's vectors in numpy and a BLOCK-th of the
    square in rows shuffled. The audit compares vectors with brute force; below RECALL the graph
    gets more trees, twice at most, and below LEAST_RECALL after that it is an error.

    Rows whose label is null, or whose vector is null, empty, zero, or holds null or non-finite
    components link with nothing. Vectors of different dimensions never link. Rows with a null
    id link with nothing. Rows that repeat an id count as vectors of their own.
    """
    vectors = settle(usable(embeddings, id_col, vec_col, label_col), "vectors")
    largest = vectors.groupBy("grp").count().agg(F.max("count")).first()[0] or 1
    graph, trees, recall = None, TREES + 2 * max(0, int(largest).bit_length() - WELL), 0.0
    for attempt in range(3):
        started = _forest(vectors, trees, attempt)
        lengths = graph.select("a", "k").distinct() if graph is not None else None
        new = settle(_kept(started if graph is None else started.union(graph.select("a", "b", "s")), lengths), "neighbours")
        graph = _descend(new, vectors, threshold)
        groups = connected_components(graph.where(F.col("s") >= threshold).select("a", "b"))
        groups = settle(groups.union(groups.select("component", "component")).distinct(), "groups")
        sizes = settle(groups.groupBy("component").agg(F.count("*").alias("size")), "sizes")
        members = groups.join(sizes, "component").join(vectors, F.col("node") == vectors["id"])
        members = settle(members.select("component", "size", "id", "m", "grp", "vec"), "members")
        links = settle(_counted(members, threshold), "links")
        discard(members, sizes)
        recall = audit(vectors, links, threshold)
        if recall >= RECALL:
            break
        trees *= 2
    if recall < LEAST_RECALL:
        raise RuntimeError(f"the neighbour graph found {recall:.3f} of the links of the audited vectors")
    discard(graph)
    named = vectors.join(groups, vectors["id"] == groups["node"], "left").join(links.withColumnRenamed("id", "lid"), vectors["id"] == F.col("lid"), "left")
    named = named.select(F.col("grp"), "vec", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.col("id").alias("rep"))
    return _spread(embeddings, named.select("rep", "n_links", "component_id"), id_col, vec_col, label_col)


def _spread(embeddings: DataFrame, reps: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """What was found for the smallest id of equal vectors, for each row."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vec.alias("v"))
    keyed = rows.where("vec_id is not null and label is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"))
    found = keyed.join(reps, "rep").select(F.col("label").alias("l"), F.col("v").alias("w"), "n_links", "component_id")
    out = rows.join(found, (rows["label"] == found["l"]) & (rows["v"] == found["w"]) & rows["vec_id"].isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
