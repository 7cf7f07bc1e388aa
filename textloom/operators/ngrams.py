"""The n-gram inverted index: candidates, exact twins, and the best of them for each unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Recall filters: shared n-grams as a share of the smaller side, and the least ratio of lengths.
SHARED_RATIO, LENGTH_FLOOR = 0.12, 0.55


def number_units(units: DataFrame, outer: list[str], inner: list[str]) -> DataFrame:
    """A dense BIGINT `pos` in the order of `outer`, then `inner`, without sorting all rows in one task.

    Rows are counted for each value of `outer` (a file); the running sum over those counts, one short row a file,
    gives each file its start, and rows are numbered inside their file. Both orders together must be total.
    """
    counts = units.groupBy(*outer).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*outer).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = units.withColumn("_k", F.row_number().over(Window.partitionBy(*outer).orderBy(*inner)))
    return rows.join(counts.select(*outer, before.alias("_start")), outer).withColumn("pos", F.col("_start") + F.col("_k")).drop("_k", "_start")


def gram_frequency(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gram, df): how many units hold each n-gram."""
    return units.select(*keys, F.explode("ngrams").alias("gram")).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("df"))


def gram_pairs(units: DataFrame, keys: list[str], max_postings: int) -> DataFrame:
    """(pos_a, pos_b, s = 1) for each n-gram of a pair, pos_a < pos_b.

    Grams are counted first, with map-side combining, and those above max_postings are left out before anything is
    gathered; of the rest the positions are one short list each, from which pairs are made in place. Without a bound
    (0) postings are joined with themselves, so that no list grows with the data.
    """
    postings = units.select(*keys, "pos", F.explode("ngrams").alias("gram"))
    by = [*keys, "gram"]
    if not max_postings:
        a, b = (postings.select(*by, F.col("pos").alias(f"pos_{s}")) for s in "ab")
        return a.join(b.hint("merge"), by).filter("pos_a < pos_b").select("pos_a", "pos_b", F.lit(1).cast("long").alias("s"))
    held = postings.groupBy(*by).agg(F.count(F.lit(1)).alias("df")).filter(F.col("df").between(2, max_postings)).drop("df")
    lists = postings.join(held.hint("merge"), by, "left_semi").groupBy(*by).agg(F.array_sort(F.collect_list("pos")).alias("p"))
    first = lists.select("p", F.posexplode("p").alias("i", "pos_a"))
    return first.select("pos_a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("pos_b"), F.lit(1).cast("long").alias("s"))


def candidates(units: DataFrame, keys: list[str], max_postings: int = 300, top: int = 200) -> DataFrame:
    """(pos_a, pos_b, shared): pairs pos_a < pos_b inside `keys` that share n-grams or the whole form.

    units: keys, pos (unique in the table), normalized, ngrams (distinct); read three times, so callers keep it. Grams
    with more than max_postings units are left out (0: none is), which also bounds the pairs of a gram; units with one
    form count max(grams, 1) on top. Of each pos_a the `top` pairs by shared, then pos_b are kept (0: all) - before any
    other filter, so pairs inside a group use up places, as documented.
    """
    shared = gram_pairs(units, keys, max_postings).unionAll(exact_pairs(units, keys, top)).groupBy("pos_a", "pos_b").agg(F.sum("s").alias("shared"))
    if not top:
        return shared
    rank = F.row_number().over(Window.partitionBy("pos_a").orderBy(F.desc("shared"), "pos_b"))
    return shared.withColumn("_r", rank).filter(F.col("_r") <= top).drop("_r")


def exact_pairs(units: DataFrame, keys: list[str], top: int = 0) -> DataFrame:
    """(pos_a, pos_b, s): pairs with one comparison form; s is its number of n-grams, 1 at least.

    Twins share more than any other pair can, so with `top` only the next `top` twins of a unit can be kept, and only
    those are made: twins are numbered and each meets its own block of `top` and the next, so a form that a third of
    all units have costs no more a unit than any other.
    """
    forms = units.filter("normalized <> ''").select(*keys, "pos", "normalized", F.greatest(F.size("ngrams"), F.lit(1)).cast("long").alias("s"))
    by = [*keys, "normalized"]
    if not top:
        a = forms.withColumnRenamed("pos", "pos_a")
        b = forms.drop("s").withColumnRenamed("pos", "pos_b")
        return a.join(b, by).filter("pos_a < pos_b").select("pos_a", "pos_b", "s")
    several = forms.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    numbered = forms.join(several, by, "left_semi").withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))
    block = F.floor(F.col("r") / top)
    a = numbered.select(*by, F.col("pos").alias("pos_a"), "s", F.col("r").alias("ra"), F.explode(F.array(block, block + 1)).alias("block"))
    b = numbered.select(*by, F.col("pos").alias("pos_b"), F.col("r").alias("rb"), block.alias("block"))
    return a.join(b, [*by, "block"]).filter((F.col("rb") > F.col("ra")) & (F.col("rb") <= F.col("ra") + top)).select("pos_a", "pos_b", "s")


def meeting_pairs(units: DataFrame, keys: list[str], threshold) -> DataFrame:
    """(pos_a, pos_b): every pair pos_a < pos_b of different groups inside `keys` that can score `threshold` (a column or a
    number) or more, and some others; nothing is left out for the number of units that hold an n-gram or match a unit.

    Such a pair has a Jaccard of (lowest threshold - 0.62) / 0.38 or more, so it shares at least that part of the grams of
    either side, and two; then the rarest grams of either side, all but that many less one, have one in common. Only
    those are joined, and whole forms.
    """
    t = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    lowest = F.broadcast(units.agg(F.min(t).alias("_t")))
    n = F.size("ngrams")
    need = F.greatest(F.lit(2), F.ceil(n * ((F.col("_t") - 1e-9 - 0.62) / 0.38) - 1e-6))
    by = [*keys, "gram"]
    several = gram_frequency(units, keys).filter("df > 1")
    postings = units.crossJoin(lowest).select(*keys, "pos", "group_index", F.length("normalized").alias("l"), (n - need + 1).cast("int").alias("ahead"), n.alias("n"), F.explode("ngrams").alias("gram"))
    # grams of one unit come first and meet nothing: n - need + 1 less these are left
    held = postings.join(several.hint("merge"), by).groupBy(*keys, "pos", "group_index", "l", "ahead", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    rare = held.withColumn("ahead", F.col("ahead") - F.col("n") + F.size("g")).filter("ahead > 0").select(*keys, "pos", "group_index", "l", F.explode(F.slice("g", F.lit(1), F.col("ahead"))).alias("g"))
    a, b = (rare.select(*keys, F.col("g.gram").alias("gram"), *(F.col(c).alias(f"{c}_{s}") for c in ("pos", "group_index", "l"))) for s in "ab")
    near = a.join(b.hint("merge"), by).filter("pos_a < pos_b and group_index_a <> group_index_b").filter(F.least("l_a", "l_b") / F.greatest("l_a", "l_b") >= LENGTH_FLOOR)
    forms = units.select(*keys, "pos", "group_index", "normalized")
    a, b = (forms.select(*keys, "normalized", F.col("pos").alias(f"pos_{s}"), F.col("group_index").alias(f"group_index_{s}")) for s in "ab")
    twins = a.join(b.hint("merge"), [*keys, "normalized"]).filter("pos_a < pos_b and group_index_a <> group_index_b")
    return near.select("pos_a", "pos_b").unionAll(twins.select("pos_a", "pos_b")).distinct()


def recalled(near: DataFrame, units: DataFrame) -> DataFrame:
    """Candidates (pos_a, pos_b, shared) of different groups that pass the recall filters, by numbers alone: no text and
    no list of n-grams moves before a pair has passed."""
    size = units.select("pos", "group_index", F.size("ngrams").alias("n"), F.length("normalized").alias("l"))
    for s in "ab":
        near = near.join(size.select(F.col("pos").alias(f"pos_{s}"), F.col("group_index").alias(f"_g{s}"), F.col("n").alias(f"_n{s}"), F.col("l").alias(f"_l{s}")), f"pos_{s}")
    return near.filter("_ga <> _gb").filter(recall_filter("_na", "_nb", "_la", "_lb")).select("pos_a", "pos_b", "shared")


def recall_filter(n_a: str, n_b: str, len_a: str, len_b: str, shared: str = "shared"):
    """Length ratio and least number of shared n-grams (floor of a share of the smaller side, two at least)."""
    ratio = F.least(len_a, len_b) / F.greatest(len_a, len_b) >= LENGTH_FLOOR
    least = F.greatest(F.lit(2), F.floor(F.least(n_a, n_b) * F.lit(SHARED_RATIO)))
    return (F.least(len_a, len_b) > 0) & ratio & (F.col(shared) >= least)
