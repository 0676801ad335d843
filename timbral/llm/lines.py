"""Line dedup: levelled sorted runs of line hashes, as bucketed tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbral.llm.shared import ASCII_SPACE, ascii_lower, discard, free_name, new_path, settle

#: Runs of one level that are compacted into one run of the next.
FANOUT = 2
#: Keys with more than a HOT-th of all documents' distinct lines, so fewer than HOT keys, go to
#: every task instead of being joined with what is shuffled by key.
HOT = 10_000


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def line_hashes(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, t, pos, h1, h2): each line whose key has min_chars code points at least.

    t is the text's hash, which tells apart rows with one id and different texts. The key's two
    64-bit hashes stand for the key. Rows without an id are left out.
    """
    kept = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = kept.select("doc", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "t", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


class LineRuns:
    """Runs (h1, h2, n_docs, keeper), each bucketed and sorted by hash.

    Batches come from the largest ids to the smallest, so the first batch that holds a key
    holds its keeper. add() merge-anti-joins a batch with the runs: keys that a run already
    knows as repeated need nothing more. The rest become a new run of level 0. FANOUT runs of
    a level are compacted into one of the next, so there are O(log batches) runs to join.
    Joining with a run shuffles the batch alone, as runs are bucketed by the hash.
    """

    def __init__(self, spark, min_docs: int, buckets: int | None = None):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "line-run")
        (
            rows.repartition(self.buckets, "h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", self.paths[name])
            .saveAsTable(name)
        )
        return name

    def _forget(self, name: str) -> None:
        run = self.spark.table(name)
        discard(run)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        del self.paths[name]

    def add(self, batch: DataFrame) -> None:
        """batch: (doc, h1, h2) rows of one batch of documents; repeats within a doc count once."""
        fresh = batch.select("doc", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
        for run in (r for level in self.levels for r in level):
            known = self.spark.table(run).where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
            fresh = fresh.join(known.hint("merge"), ["h1", "h2"], "left_anti")
        self._push(0, self._write(fresh))

    def _push(self, level: int, run: str) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FANOUT:
            runs, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(runs))
            for r in runs:
                self._forget(r)
            self._push(level + 1, merged)

    def _merged(self, runs: list[str]) -> DataFrame:
        """One run of several, by merge joins of what is bucketed and sorted alike."""
        rows = self.spark.table(runs[0])
        for run in runs[1:]:
            more = self.spark.table(run).select("h1", "h2", F.col("n_docs").alias("n"), F.col("keeper").alias("k"))
            rows = rows.join(more.hint("merge"), ["h1", "h2"], "full_outer").select(
                "h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("keeper", "k").alias("keeper")
            )
        return rows

    def repeated(self) -> DataFrame:
        """(h1, h2, n_docs, keeper) of the keys found in min_docs documents at least."""
        runs = [r for level in self.levels for r in level]
        rows = self._merged(runs) if len(runs) > 1 else self.spark.table(runs[0])
        return rows.where(F.col("n_docs") >= self.min_docs)

    def close(self) -> None:
        for run in list(self.paths):
            self._forget(run)
        self.levels = []


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4) -> DataFrame:
    """docs with repeated lines dropped from text_col, and n_lines (before) and n_dropped.

    A line's key is line_key(line). Keys of min_chars code points at least that stand in
    min_docs documents at least lose all their lines except in the document with the largest
    id among them; there all stay. Other lines stay, joined by \\n. A null or empty text is one
    empty line, and comes back empty. Rows that share an id are one document. Rows with a null
    id take no part and keep their lines. Other columns stay; the two new names get
    underscores where they are taken. No Python runs on the executors.
    """
    spark = docs.sparkSession
    edges = docs.agg(F.percentile_approx(id_col, [i / batches for i in range(1, batches)], 1000).alias("e")).first()["e"] if batches > 1 else []
    number = F.lit(0)
    for edge in sorted({*(edges or [])}):
        number = number + (F.col("doc") <= F.lit(edge)).cast("int")
    hashed = new_path(spark, "line-hashes")
    rows = line_hashes(docs, min_chars, id_col, text_col).withColumn("batch", number)
    rows.write.partitionBy("batch").parquet(hashed)
    lines = spark.read.schema(rows.schema).parquet(hashed)
    runs = LineRuns(spark, min_docs)
    for i in range(max(1, batches)):
        runs.add(lines.where(F.col("batch") == i))
    repeated = runs.repeated()
    total = repeated.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.broadcast(settle(repeated.where(F.col("n_docs") > total / HOT), "line-hot"))
    others = lines.join(hot, ["h1", "h2"], "left_anti").join(repeated.where(F.col("n_docs") <= total / HOT), ["h1", "h2"])
    drops = lines.join(hot, ["h1", "h2"]).unionByName(others).where("doc != keeper").groupBy("doc", "t").agg(F.collect_set("pos").alias("gone"))
    drops = settle(drops.select(F.col("doc").alias("__doc"), F.col("t").alias("__t"), F.col("gone").alias("__gone")), "line-drops")
    runs.close()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(hashed)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(drops.hint("shuffle_hash"), (docs[id_col] == drops["__doc"]) & (F.xxhash64(text) == drops["__t"]), "left")
    split = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n"))
    n_lines = free_name(docs.columns, "n_lines")
    n_dropped = free_name([*docs.columns, n_lines], "n_dropped")
    return (
        joined.withColumn("__lines", split)
        .withColumn("__kept", kept)
        .select(
            *[F.col("__kept").alias(c) if c == text_col else F.col(c) for c in docs.columns],
            F.size("__lines").cast("long").alias(n_lines),
            F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias(n_dropped),
        )
    )
