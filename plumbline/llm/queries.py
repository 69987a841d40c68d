"""The registered queries of the text operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    chat,
    licenses,
    packing,
    pseudonyms,
    quality,
    repair,
    search,
    simhash,
    substrings,
    templates,
    token_store,
    toxicity,
    warc,
)
from plumbline.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_rows(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(table(spark, sf_dir, "documents"))


def op3_format_preserving_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonym_rows(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_rows(table(spark, sf_dir, "documents"))


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_rows(table(spark, sf_dir, "documents"))


def op9_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_gated_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_rows(table(spark, sf_dir, "documents"))


def op11_shared_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_rows(table(spark, sf_dir, "conversations"))


def op13_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_rows(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_rans_token_files": op1_rans_token_files,
    "op2_quality_rules": op2_quality_rules,
    "op3_format_preserving_pii": op3_format_preserving_pii,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_template_decontamination": op5_template_decontamination,
    "op6_simhash_bk_trees": op6_simhash_bk_trees,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_license_scan": op8_license_scan,
    "op9_chat_snapshot_collapse": op9_chat_snapshot_collapse,
    "op10_gated_recurrent_toxicity": op10_gated_recurrent_toxicity,
    "op11_shared_ranked_search": op11_shared_ranked_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_seekable_warc": op13_seekable_warc,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality.QUALITY_SQL,
    "op9_chat_snapshot_collapse": chat.RENDER_SQL,
    "op11_shared_ranked_search": search.SEARCH_SQL,
    "op13_seekable_warc": warc.WARC_SQL,
}
