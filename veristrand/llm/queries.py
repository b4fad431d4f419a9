"""The registered queries of the corpus operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, embedding_dedup, fill_middle, language_id, license_scan, line_dedup, mixing, packing, periodic_runs, simhash, substring_dedup, toxicity, url_filter
from .common import table


def op1_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_prefix_forest": op1_hash_prefix_forest,
    "op2_low_discrepancy_mix": lambda spark, sf_dir: mixing.mix_report(table(spark, sf_dir, "documents")),
    "op3_toxicity": lambda spark, sf_dir: toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op4_license_scan": lambda spark, sf_dir: license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known_digests(spark)),
    "op5_simhash_components": op5_simhash_components,
    "op6_language_id": lambda spark, sf_dir: language_id.language_report(table(spark, sf_dir, "documents")),
    "op7_substring_dedup": op7_substring_dedup,
    "op8_cost_balanced_packing": op8_cost_balanced_packing,
    "op9_url_filter": op9_url_filter,
    "op10_embedding_dedup": lambda spark, sf_dir: embedding_dedup.near_embeddings(table(spark, sf_dir, "embeddings")),
    "op11_fill_in_middle": lambda spark, sf_dir: fill_middle.fim_report(table(spark, sf_dir, "documents")),
    "op12_line_dedup": lambda spark, sf_dir: line_dedup.line_report(table(spark, sf_dir, "documents")),
    "op13_periodic_runs": lambda spark, sf_dir: periodic_runs.runs_report(table(spark, sf_dir, "documents")),
}

ORACLES: dict[str, str] = {
    "op4_license_scan": license_scan.oracle_sql(),
    "op9_url_filter": """
        WITH cut AS (
          SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
          FROM pages
        ), split AS (
          SELECT row_number() OVER () AS n, page_id,
                 translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
          FROM cut
        ), rules(v, h, p) AS (
          VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), best AS (
          SELECT n, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
          FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
          GROUP BY n
        )
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM split LEFT JOIN best USING (n)
    """,
    "op11_fill_in_middle": fill_middle.ORACLE_SQL,
    "op12_line_dedup": line_dedup.ORACLE_SQL,
}
