"""What the contracts fix, read from their words and not from the code."""

from pyspark.sql import functions as F

from timbral.llm.queries import QUERIES

#: The list of op1's contract: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/.
OP1 = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_url_rules(spark, tmp_path):
    rows = []
    for rule in OP1.split(", "):
        verdict, text = rule.split(" ")
        host, path = text.split("/", 1)
        for at in (host, f"a.{host}"):
            rows.append((len(rows), f"https://{at}/{path}x", text, verdict))
    table = spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string")
    table.select("page_id", "url", F.lit("").alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in QUERIES["op1_url_filters"](spark, str(tmp_path)).collect()}
    assert got == {i: (rule, verdict) for i, _, rule, verdict in rows}


def test_pipeline_links_by_fingerprints(spark):
    """Near copies by SimHash go too: the same passages, repeated or not, have few distinct shingles in common."""
    import corpus_pipeline
    from timbral.llm import simhash

    common = " ".join(["one two three four five"] * 400)
    texts = {1: common, 2: f"{common} six seven eight nine ten eleven", 3: "quite another text of a few words", 4: None, 5: common}
    assert bin(simhash.fingerprint(texts[1].encode(), 5) ^ simhash.fingerprint(texts[2].encode(), 5)).count("1") <= 2
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in simhash.similar_documents(rows).collect()}
    assert groups[2] == 2  # by shingles alone it is no copy
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, rows, "").collect()} == {1, 3, 4}
