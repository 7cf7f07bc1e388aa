"""Summaries: pairs of groups, documents, run statistics, capped samples, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import base_name


def pair_stats(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, group_a, group_b, counts, similarities, files) for unordered pairs of group names that have matches."""
    rows = matches.select(*keys, F.least("group_a", "group_b").alias("group_a"), F.greatest("group_a", "group_b").alias("group_b"), "excluded", "similarity", F.array(base_name(F.col("file_a")), base_name(F.col("file_b"))).alias("_f"))
    active = ~F.col("excluded")
    return rows.groupBy(*keys, "group_a", "group_b").agg(
        F.count_if(active).alias("match_count"),
        F.count_if("excluded").alias("excluded_count"),
        F.coalesce(F.max(F.when(active, F.col("similarity"))), F.lit(0.0)).alias("max_similarity"),
        F.coalesce(F.avg(F.when(active, F.col("similarity"))), F.lit(0.0)).alias("avg_similarity"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(active, F.col("_f")))))).alias("files"),
    )


def pair_summaries(matches: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of groups (keys, group_index, group_name) inside `keys`, with zeros where nothing matches."""
    a = groups.select(*keys, F.col("group_index").alias("ia"), F.col("group_name").alias("left"))
    b = groups.select(*keys, F.col("group_index").alias("ib"), F.col("group_name").alias("right"))
    pairs = (a.join(b, keys) if keys else a.crossJoin(b)).filter("ia < ib")
    pairs = pairs.withColumn("group_a", F.least("left", "right")).withColumn("group_b", F.greatest("left", "right"))
    out = pairs.join(pair_stats(matches, keys), [*keys, "group_a", "group_b"], "left")
    zero = {"match_count": 0, "excluded_count": 0, "max_similarity": 0.0, "avg_similarity": 0.0}
    return out.select(*keys, F.col("left").alias("group_a"), F.col("right").alias("group_b"), *zero, F.coalesce("files", F.array().cast("array<string>")).alias("files")).fillna(zero)


def pair_filter(name: str = "", least: float = 0.0, most: float = 1.0, excluded_only: bool = True) -> Column:
    """The predicate of the report's pair table: a name, a range of similarity, pairs with excluded matches only."""
    named = F.lower(F.concat_ws(" ", "group_a", "group_b")).contains(name.lower()) if name else F.lit(True)
    ranged = F.col("max_similarity").between(least, most)
    return named & ranged & (F.lit(True) if excluded_only else ~((F.col("match_count") == 0) & (F.col("excluded_count") > 0)))


def document_summary(units: DataFrame, keys: list[str]) -> DataFrame:
    return units.groupBy(*keys).agg(F.count(F.lit(1)).alias("unit_count"), F.count_if("comparable").alias("comparable_unit_count"), (F.count(F.lit(1)) - F.count_if(F.col("comparable"))).alias("short_filtered_unit_count"))


def run_stats(documents: DataFrame, units: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run: documents and template files, units, matches."""
    d = documents.groupBy(*keys).agg(F.count_if(F.col("group_index") >= 0).alias("document_count"), F.count_if(F.col("group_index") < 0).alias("exclude_document_count"), F.count_distinct(F.when(F.col("group_index") >= 0, F.col("group_index"))).alias("group_count"))
    u = units.filter("group_index >= 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("unit_count"), F.count_if("comparable").alias("comparable_unit_count"))
    m = matches.groupBy(*keys).agg(F.count_if(~F.col("excluded")).alias("similar_match_count"), F.count_if("excluded").alias("excluded_match_count"))
    out = d.join(u, keys, "left").join(m, keys, "left").fillna(0)
    return out.withColumn("short_filtered_unit_count", F.col("unit_count") - F.col("comparable_unit_count"))


def sampled(matches: DataFrame, keys: list[str], per_pair: int = 20, total: int = 160) -> DataFrame:
    """The best matches of each pair of groups, and of those the best in all: by similarity, then match_id."""
    pair = [F.least("group_a", "group_b").alias("_ga"), F.greatest("group_a", "group_b").alias("_gb")]
    order = [F.desc("similarity"), F.col("match_id")]
    kept = matches.select("*", *pair).withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_ga", "_gb").orderBy(*order))).filter(F.col("_k") <= per_pair)
    kept = kept.withColumn("_t", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_t") <= total)
    return kept.drop("_ga", "_gb", "_k", "_t")


def annotations(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit_id, refs, max_similarity, all_excluded): for each unit of a match what stands against it."""
    a = matches.select(*keys, F.col("unit_id_a").alias("unit_id"), F.col("unit_id_b").alias("other"), "match_id", "similarity", "excluded")
    b = matches.select(*keys, F.col("unit_id_b").alias("unit_id"), F.col("unit_id_a").alias("other"), "match_id", "similarity", "excluded")
    return a.unionAll(b).groupBy(*keys, "unit_id").agg(F.array_sort(F.collect_list(F.struct("match_id", "other", "similarity"))).alias("refs"), F.max("similarity").alias("max_similarity"), F.bool_and("excluded").alias("all_excluded"))
