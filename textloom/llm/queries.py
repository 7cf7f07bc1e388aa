"""The registered queries of the corpus operators; each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import abuse, chunking, components, leakage, lookalike, neardup, packing, scans, spans
from textloom.llm.common import match_records, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.match_groups(table(spark, sf_dir, "similarity_matches"))


def p1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.group_sizes(table(spark, sf_dir, "similarity_matches"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_oversized(table(spark, sf_dir, "text_units"), table(spark, sf_dir, "check_options"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("unit_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p2_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that their pieces make again, and whether the pieces keep to the limit."""
    return chunking.rebuilt(_pieces(spark, sf_dir))


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "text_units"), table(spark, sf_dir, "bid_files")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise(*_scans(spark, sf_dir))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(*_scans(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf_dir, "text_units"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose text is not in its consistent form, with that form."""
    return lookalike.consistent_units(table(spark, sf_dir, "text_units")).filter("form <> text").distinct()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_groups(table(spark, sf_dir, "text_units"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.found(table(spark, sf_dir, "similarity_matches"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(match_records(table(spark, sf_dir, "similarity_matches")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.found(table(spark, sf_dir, "similarity_matches"))


def p6_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(match_records(table(spark, sf_dir, "similarity_matches")), 40, longest=True)


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_sizes(table(spark, sf_dir, "documents")))


def p7_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.waste(p7_packing(spark, sf_dir))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.audit(table(spark, sf_dir, "documents"), p7_packing(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.tolerant_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels")).select("doc_id", "source", "score", "category", F.col("passages").cast("long").alias("passages"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.source_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
