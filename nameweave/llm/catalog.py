"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nameweave.llm import decontaminate, grammar, itemsets, licenses, line_dedup, mixing, ogg, periodic, quality, secrets, sharding, simhash, url_filter


def _table(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, pages, benchmark, sale_lines = (_table(t) for t in ("documents", "pages", "benchmark", "sale_lines"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg_media": lambda spark, d: ogg.media_features(documents(spark, d)),
    "op2_url_list_asof": lambda spark, d: url_filter.verdicts(url_filter.fetched_pages(pages(spark, d)), url_filter.dated_list(pages(spark, d))),
    "op3_secret_scan": lambda spark, d: secrets.secret_spans(documents(spark, d)),
    "op4_simhash_anchors": lambda spark, d: simhash.near_duplicates(documents(spark, d)),
    "op5_decontaminate": lambda spark, d: decontaminate.contamination(documents(spark, d), benchmark(spark, d)),
    "op6_repair_token_ids": lambda spark, d: grammar.token_output(documents(spark, d)),
    "op7_weak_label_quality": lambda spark, d: quality.classified(documents(spark, d)),
    "op8_weighted_fair_mix": lambda spark, d: mixing.mixed_sizes(documents(spark, d)),
    "op9_feistel_shards": lambda spark, d: sharding.shards(documents(spark, d)),
    "op10_line_dedup": lambda spark, d: line_dedup.line_decisions(documents(spark, d)),
    "op11_periodic_runs": lambda spark, d: periodic.periodic_runs(documents(spark, d)),
    "op12_license_scan": lambda spark, d: licenses.license_labels(documents(spark, d)),
    "op13_closed_itemsets": lambda spark, d: itemsets.closed_itemsets(sale_lines(spark, d)),
}

ORACLES: dict[str, str] = {"op2_url_list_asof": url_filter.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op10_line_dedup": line_dedup.ORACLE, "op12_license_scan": licenses.ORACLE, "op13_closed_itemsets": itemsets.ORACLE}
