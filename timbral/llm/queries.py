"""The registered queries of the subpackage: one per operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.llm import bpe, jpeg, lines, mixing, neighbours, packing, passages, ppm, quality, runs, simhash, urls, whitening
from timbral.llm.shared import new_path
from timbral.session import table


def tokenizer() -> tuple[str, str]:
    """The rank file and the splitting pattern that the BPE query takes."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: The rules that the URL query applies.
RULES = (
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op4_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.substring_dedup(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), *tokenizer())


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.ppm_score(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.run_digests(runs.with_planted_periods(docs))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-ids")
    packing.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=2, by_words=True)
    return packing.token_spans(spark, path)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return white.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_mixing_sources": op2_mixing_sources,
    "op6_line_dedup": op6_line_dedup,
    "op3_nn_descent": op3_nn_descent,
    "op4_collinear_chaining": op4_collinear_chaining,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_progressive_jpeg": op8_progressive_jpeg,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_files": op12_token_files,
    "op13_embedding_whitening": op13_embedding_whitening,
}

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op6_line_dedup": f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (select *, {LOWER.format(f"trim(line, {SPACE})")} as key from lines),
repeated as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3
), judged as (
  select k.*, coalesce(r.keeper <> k.doc_id, false) as dropped
  from keyed k left join repeated r on k.key = r.key
)
select doc_id, count(*) as n_lines, cast(count(*) filter (dropped) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from judged group by doc_id""",
    "op1_url_filters": r"""
with recursive u as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, url,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from u
), rules(verdict, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
  ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
found as (
  select distinct q.url, arg_max(r.h || r.p, length(r.h || r.p)) as rule, arg_max(r.verdict, length(r.h || r.p)) as verdict
  from (select distinct url, host, path from parts) q
  join rules r on (q.host = r.h or ends_with(q.host, '.' || r.h)) and starts_with(q.path, r.p)
  group by q.url
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join found using (url)""",
}
