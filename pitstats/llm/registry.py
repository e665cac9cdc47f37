"""The registered queries of the training-data operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitstats.llm import bm25, byte_bpe, decontaminate, license_scan, line_quality, ngram_join, prefix_trie, suffix_dedup, token_counts, token_files, toxicity, url_filter, whitening
from pitstats.llm.common import table, vocabulary

#: The rules of the URL query as its contract lists them, of which the longest that fits decides.
URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 512)


def op4_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50 as a query, against all documents."""
    documents = table(spark, sf_dir, "documents")
    return bm25.search(documents, documents.where("doc_id % 50 = 0"), k=bm25.TOP)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"), span=50)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(table(spark, sf_dir, "documents"), n=5, threshold=ngram_join.THRESHOLD)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of up to eight turns are shared within five ids."""
    nodes = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), group=5, heads=9)
    return nodes.drop("k1", "k2")


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=whitening.COMPONENTS)


OP10_SQL = r"""
with u as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), r(action, rhost, rpath) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), hit as (
  select page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) as rule,
    max_by(action, length(rhost || rpath)) as action
  from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by page_id, host, path
)
select p.page_id, p.host, p.path, hit.rule, coalesce(hit.action, 'allow') as verdict
from p left join hit using (page_id, host, path)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_decontaminate": op2_decontaminate,
        "op3_token_counts": op3_token_counts,
        "op4_bm25_search": op4_bm25_search,
        "op5_toxicity": op5_toxicity,
        "op6_license_scan": op6_license_scan,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_ngram_join": op8_ngram_join,
        "op9_token_files": op9_token_files,
        "op10_url_filter": op10_url_filter,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_line_quality": op12_line_quality,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_url_filter": OP10_SQL}
