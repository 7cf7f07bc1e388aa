"""Problem 1: consolidating pairwise matches into groups (hash-to-min)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textloom.llm.common import checkpoint

#: Rows of a vertex from which it counts as hot.
HEAVY = 2_000_000


def undirected_edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) with a < b, each once; rows with a null side or equal sides carry no link."""
    return (
        pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .filter("x is not null and y is not null and x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges (a, b) with BIGINT ids in the order of the nodes, and the names (id, node): small rows that hash fast."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().orderBy("node")
    names = checkpoint(nodes.select(F.monotonically_increasing_id().alias("id"), "node"))
    for side in ("a", "b"):
        edges = edges.join(names.select(F.col("node").alias(side), F.col("id").alias(f"_{side}")).hint("merge"), side).drop(side)
    return edges.select(F.col("_a").alias("a"), F.col("_b").alias("b")), names


def _kept(state: DataFrame) -> tuple[DataFrame, tuple]:
    """The state in the shared folder, and what tells it from another one; both come from one pass."""
    seen = Observation()
    state = checkpoint(state.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x"), F.bit_xor(F.xxhash64("u", "v")).alias("y")))
    return state, (seen.get["n"], seen.get["x"], seen.get["y"])


def with_least(state: DataFrame, rows: int, heavy: int = HEAVY) -> DataFrame:
    """(v, u, m): m is the least u of v. A vertex with more than `heavy` rows is joined by broadcast.

    There are at most rows / heavy such vertices, which bounds what is sent; where the state has fewer rows than that
    there is none and it is not asked for. All others are joined by sort and merge, none of them hot.
    """
    least = state.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
    if rows <= heavy:
        return state.join(least.select("v", "m").hint("merge"), "v")
    least = checkpoint(least)
    hot = F.broadcast(least.filter(F.col("n") > heavy).select("v", "m"))
    rest = least.filter(F.col("n") <= heavy).select("v", "m")
    return state.join(hot, "v").unionByName(state.join(hot, "v", "left_anti").join(rest.hint("merge"), "v"))


def hash_to_min(edges: DataFrame, max_rounds: int = 200, heavy: int = HEAVY) -> DataFrame:
    """Connected components of an edge list (a, b) -> (node, group): group is the smallest node reached.

    Hash-to-min on rows: the cluster set of a vertex v is the set of rows (v, u). Each round a vertex finds its minimum
    m with a map-side combined aggregate, sends its set to m - rows (m, u) - and m to every member - rows (u, m). No
    set is ever built in one task: a giant component is spread over rows (see `with_least` for its minimum). Nodes
    that are not BIGINT are numbered in their order first. The state is checkpointed each round; it ends when a round
    leaves it as it was. Nulls, self links and repeated links are ignored; an empty input gives an empty result.
    """
    edges, names = undirected_edges(edges, "a", "b"), None
    if dict(edges.dtypes)["a"] != "bigint":
        edges, names = numbered(checkpoint(edges))
    both = edges.select(F.explode(F.array(*(F.struct(F.col(x).alias("v"), F.col(y).alias("u")) for x, y in ("ab", "ba", "aa", "bb")))).alias("p"))
    state, seen = _kept(both.select("p.v", "p.u").distinct())
    for _ in range(max_rounds):
        # one pass makes both messages; a map-side distinct drops most of the repeats before the shuffle
        pairs = F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        state, now = _kept(with_least(state, seen[0], heavy).select(F.explode(pairs).alias("p")).select("p.v", "p.u").distinct())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"hash-to-min did not settle in {max_rounds} rounds")
    groups = state.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("group"))
    if names is None:
        return groups
    for side in ("node", "group"):
        groups = groups.withColumnRenamed(side, "id").join(names.withColumnRenamed("node", side).hint("merge"), "id").drop("id")
    return groups.select("node", "group")


def match_groups(matches: DataFrame) -> DataFrame:
    """(unit_id, group_id) of every unit linked by a match that is not excluded."""
    links = undirected_edges(matches.filter(~F.col("excluded")), "unit_id_a", "unit_id_b")
    return hash_to_min(links).select(F.col("node").alias("unit_id"), F.col("group").alias("group_id"))


def group_sizes(matches: DataFrame) -> DataFrame:
    """(group_id, n_units): how many units each group holds."""
    return match_groups(matches).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_units"))
