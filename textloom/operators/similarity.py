"""Thresholded text similarity across groups, and suppression of matches that a template explains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import score_above
from textloom.operators.ngrams import LENGTH_FLOOR, candidates, meeting_pairs, number_units, recall_filter, recalled

EXCLUDE_LIMIT = 80
_SIDE = ["unit_id", "group_index", "group_name", "file_path", "file_name", "location", "text", "normalized", "ngrams"]


def _side(units: DataFrame, keys: list[str], tag: str) -> DataFrame:
    extra = [c for c in ("threshold", "exclude_threshold") if c in units.columns and tag == "a"]
    return units.select(*(keys if tag == "a" else []), *(F.col(c).alias(f"{c}_{tag}") for c in _SIDE), F.col("pos").alias(f"pos_{tag}"), *extra)


def jaccard(a: str, b: str):
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def score_pairs(pairs: DataFrame, threshold) -> DataFrame:
    """Adds `similarity` to pairs with normalized_a/_b and ngrams_a/_b and keeps those at the threshold or above.

    Twins get 1 without Python; of the others Jaccard and the lengths bound the score first, natively, so only pairs
    that can reach the threshold meet the sequence matcher.
    """
    t = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    twins = pairs.filter("normalized_a = normalized_b").withColumn("similarity", F.lit(1.0))
    rest = pairs.filter("normalized_a <> normalized_b").withColumn("_j", F.coalesce(jaccard("ngrams_a", "ngrams_b"), F.lit(0.0)))
    la, lb = F.length("normalized_a"), F.length("normalized_b")
    bound = F.lit(0.62) * (F.lit(2.0) * F.least(la, lb) / (la + lb)) + F.lit(0.38) * F.col("_j")
    rest = rest.filter(bound >= t - 1e-9).withColumn("similarity", score_above("normalized_a", "normalized_b", "_j", t)).drop("_j")
    return twins.unionByName(rest).filter(F.col("similarity") >= t)


def text_matches(units: DataFrame, keys: list[str], threshold: float = 0.78, max_postings: int = 0, top: int = 0) -> DataFrame:
    """Pairs of units of different groups with a score at the threshold or above, (earlier, later) by pos.

    units: keys, pos and the columns of a unit; only comparable ones with a form take part. A column `threshold`
    overrides the argument row by row. All pairs are found; with a bound those of `candidates`, as the reference's options
    max_ngram_postings and max_candidates_per_unit ask for.
    """
    able = units.filter("comparable and normalized <> ''")
    t = F.col("threshold") if "threshold" in units.columns else threshold
    bounded = max_postings or top
    near = recalled(candidates(able, keys, max_postings, top), able) if bounded else meeting_pairs(able, keys, t)
    found = near.join(_side(able, keys, "a"), "pos_a").join(_side(able, keys, "b"), "pos_b")
    if not bounded:
        twins = F.when(F.col("normalized_a") == F.col("normalized_b"), F.greatest(F.size("ngrams_a"), F.lit(1))).otherwise(0)
        found = found.withColumn("shared", (F.size(F.array_intersect("ngrams_a", "ngrams_b")) + twins).cast("long"))
        found = found.withColumns({f"_{v}{s}": f(f"{c}_{s}") for v, f, c in (("n", F.size, "ngrams"), ("l", F.length, "normalized")) for s in "ab"})
        found = found.filter(recall_filter("_na", "_nb", "_la", "_lb")).drop("_na", "_nb", "_la", "_lb")
    return score_pairs(found, t)


def best_excludes(units: DataFrame, excludes: DataFrame, keys: list[str], threshold: float = 0.86, max_postings: int = 300, limit: int = EXCLUDE_LIMIT) -> DataFrame:
    """(pos, exclude_pos, exclude_file, exclude_score): for each unit the exclude unit it matches best.

    Units are distinct ones of accepted matches; excludes are those of template files. A twin scores 1 and the first in
    order wins. Otherwise the `limit` candidates that share most n-grams (then by pos) pass the length ratio and are
    scored (unit, exclude); the best, on ties the one with the better rank, counts if it reaches the threshold.
    """
    able = excludes.filter("comparable and normalized <> ''")
    twin = able.groupBy(*keys, "normalized").agg(F.min_by(F.struct("pos", "file_name"), "pos").alias("e"))
    exact = units.join(twin, [*keys, "normalized"]).select("pos", F.col("e.pos").alias("exclude_pos"), F.col("e.file_name").alias("exclude_file"), F.lit(1.0).alias("exclude_score"))
    rest = units.join(able.select(*keys, "normalized").distinct(), [*keys, "normalized"], "left_anti")
    postings = able.select(*keys, F.col("pos").alias("exclude_pos"), F.explode("ngrams").alias("gram"))
    if max_postings:
        held = postings.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= max_postings).drop("df")
        postings = postings.join(held, [*keys, "gram"], "left_semi")
    near = rest.select(*keys, "pos", F.explode("ngrams").alias("gram")).join(postings, [*keys, "gram"]).groupBy("pos", "exclude_pos").agg(F.count(F.lit(1)).alias("shared"))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("shared"), "exclude_pos"))).filter(F.col("_r") <= limit)
    left = rest.select("pos", F.col("normalized").alias("normalized_a"), F.col("ngrams").alias("ngrams_a"), *([F.col("exclude_threshold").alias("_t")] if "exclude_threshold" in units.columns else [F.lit(threshold).alias("_t")]))
    right = able.select(F.col("pos").alias("exclude_pos"), F.col("normalized").alias("normalized_b"), F.col("ngrams").alias("ngrams_b"), F.col("file_name").alias("exclude_file"))
    la, lb = F.length("normalized_a"), F.length("normalized_b")
    pairs = near.join(left, "pos").join(right, "exclude_pos").filter(F.least(la, lb) / F.greatest(la, lb) >= LENGTH_FLOOR)
    scored = score_pairs(pairs, F.col("_t"))
    best = scored.groupBy("pos").agg(F.max_by(F.struct("exclude_pos", "exclude_file", F.col("similarity").alias("exclude_score")), F.struct("similarity", -F.col("_r"))).alias("e"))
    return exact.unionByName(best.select("pos", "e.*"))


def flag_excluded(matches: DataFrame, best: DataFrame) -> DataFrame:
    """Adds excluded and exclude_reason: a match is excluded if both of its sides match a template."""
    for tag in ("a", "b"):
        side = best.select(F.col("pos").alias(f"pos_{tag}"), F.col("exclude_file").alias(f"_f{tag}"), F.col("exclude_score").alias(f"_s{tag}"))
        matches = matches.join(side, f"pos_{tag}", "left")
    return exclusion(matches)


def exclusion(matches: DataFrame) -> DataFrame:
    """excluded and exclude_reason in place of the best template of either side (_fa, _sa, _fb, _sb)."""
    both = F.col("_sa").isNotNull() & F.col("_sb").isNotNull()
    reason = F.format_string("两侧均匹配排除文件：%s (%.2f) / %s (%.2f)", "_fa", "_sa", "_fb", "_sb")
    return matches.withColumn("excluded", both).withColumn("exclude_reason", F.when(both, reason)).drop("_fa", "_fb", "_sa", "_sb")


def with_exclusion(matches: DataFrame, units: DataFrame, excludes: DataFrame, keys: list[str], threshold: float = 0.86, max_postings: int = 300) -> DataFrame:
    """The lookups run once for each unit of an accepted match, not for each match. Callers persist both inputs."""
    ends = matches.select(F.explode(F.array("pos_a", "pos_b")).alias("pos")).distinct()
    needed = units.join(ends, "pos", "left_semi")
    return flag_excluded(matches, best_excludes(needed, excludes, keys, threshold, max_postings))


def number_matches(matches: DataFrame, block: int = 10_000) -> DataFrame:
    """match_id in order of discovery (pos_a, then shared, then pos_b).

    Only ids are numbered, in blocks of positions whose counts are summed up, so no task sorts all matches.
    """
    ids = matches.select("pos_a", "pos_b", "shared", F.floor(F.col("pos_a") / block).alias("_block"))
    numbered = number_units(ids, ["_block"], ["pos_a", F.desc("shared"), "pos_b"])
    return matches.join(numbered.select("pos_a", "pos_b", F.format_string("M%05d", F.col("pos")).alias("match_id")), ["pos_a", "pos_b"])


def display_order(matches: DataFrame) -> DataFrame:
    return matches.orderBy("excluded", F.desc("similarity"), "group_name_a", "group_name_b", "match_id")
