"""Problem 5: near-duplicate records with small edits (meet-in-the-middle ball hashing)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import compare_form
from textloom.llm.common import checkpoint, code_points, match_records, mix64
from textloom.llm.components import hash_to_min
from textloom.plans.tables import nfkc_text

GRAM = 3
#: A fingerprint is BLOCKS x WIDTH minwise values of a record's grams; balls are taken around each block of WIDTH.
BLOCKS, WIDTH = 14, 4
#: Blocks in which a pair must meet. At similarity 0.7 a block meets with a chance of 0.65, so fewer than AGREE of
#: BLOCKS do with a chance of 1.1e-5; unrelated records hardly ever meet twice.
AGREE = 2
#: Characters that are hashed in one go.
_PART = 1 << 19
_ODD = mix64(np.arange(1, BLOCKS * WIDTH + 1, dtype=np.uint64)) | np.uint64(1)
_TAG = mix64(np.arange(1 << 20, (1 << 20) + BLOCKS * WIDTH, dtype=np.uint64))


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of BLOCKS x WIDTH minwise values for each text of GRAM characters or more.

    Two texts agree on each value with a chance that is the Jaccard similarity of their sets of distinct grams.
    """
    codes = code_points("".join(texts)).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    inside = np.ones(len(codes), bool)
    for k in range(1, GRAM):
        inside[ends - k] = False
    grams = ((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:])[inside[: len(codes) - GRAM + 1]]
    grams = mix64(grams)
    starts = np.concatenate([[0], np.cumsum(lengths - GRAM + 1)[:-1]])
    out = np.empty((len(texts), len(_ODD)), np.uint64)
    for i, odd in enumerate(_ODD):
        out[:, i] = np.minimum.reduceat(grams * odd, starts)
    return out


def ball(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, left_out), each of BLOCKS x WIDTH columns: what lies within half the radius of every block.

    A block is a set of WIDTH (place, value) marks. Blocks that differ in one place are two steps apart - one mark out,
    one mark in - so both are one step from the block without that mark, and meet there: each block emits the WIDTH
    blocks that leave one mark out, and nothing else has to be. left_out holds bits of the mark that is missing.
    """
    marks = mix64(prints ^ _TAG)
    whole = marks.reshape(len(prints), BLOCKS, WIDTH).sum(axis=2, dtype=np.uint64)
    keys = mix64((np.repeat(whole, WIDTH, axis=1) - marks) ^ (_TAG << np.uint64(1)))
    return keys, (marks & np.uint64(0x3FFFFFFF)).astype(np.int64)


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first = np.tile(np.arange(WIDTH) == 0, BLOCKS)
    for batch in batches:
        size = batch["norm"].str.len().cumsum()
        for _, part in batch.groupby(size // _PART, sort=False):
            keys, left_out = ball(fingerprints(part["norm"].tolist()))
            meta = left_out * 2 + first
            yield pd.DataFrame({"key": keys.ravel().view(np.int64), "rep": np.repeat(part["rep"].to_numpy(), keys.shape[1]), "meta": meta.ravel().astype(np.int32)})


def _jaccard(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    grams: dict[str, frozenset] = {}

    def of(text: str) -> frozenset:
        got = grams.get(text)
        if got is None:
            if len(grams) > 1000:
                grams.clear()
            got = grams[text] = frozenset(text[i : i + GRAM] for i in range(len(text) - GRAM + 1))
        return got

    for left, right in batches:
        out = np.zeros(len(left))
        for i, (a, b) in enumerate(zip(left, right)):
            x, y = of(a), of(b)
            both = len(x & y)
            union = len(x) + len(y) - both
            out[i] = both / union if union else 0.0
        yield pd.Series(out)


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (unit_id, rep) and classes (rep, norm, copies): records with one comparison form are one class.

    Forms of fewer than three characters are classes too, but they have no 3-character substring, so no class is near to
    them. Null texts take no part. Classes are told apart by 128 bits of their form and then numbered. Forms are made in the JVM
    where full-width ASCII is all that NFKC has to settle.
    """
    rows = records.filter("text is not null").select("unit_id", compare_form(nfkc_text(F.col("text"))).alias("norm"))
    rows = checkpoint(rows.select("unit_id", "norm", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(7), "norm").alias("h2")))
    forms = rows.groupBy("h1", "h2", "norm").agg(F.count(F.lit(1)).alias("copies")).withColumn("rep", F.monotonically_increasing_id())
    forms = checkpoint(forms)
    members = rows.select("unit_id", "h1", "h2").join(forms.select("h1", "h2", "rep").hint("merge"), ["h1", "h2"])
    return checkpoint(members.select("unit_id", "rep")), forms.select("rep", "norm", "copies")


def candidates(forms: DataFrame) -> DataFrame:
    """(a, b): pairs of class ids, a < b, whose fingerprints meet in AGREE blocks at least.

    Records that agree on a whole block meet at all its WIDTH variants and are counted at the first; else they meet
    where the one mark in which they differ is left out. A size estimate of the rows says nothing of what they emit, so
    the join is told to sort and merge.
    """
    balls = forms.filter(F.length("norm") >= GRAM).select("rep", "norm").mapInPandas(_emit, "key long, rep long, meta int")
    x = balls.select("key", F.col("rep").alias("a"), F.col("meta").alias("ma"))
    y = balls.select("key", F.col("rep").alias("b"), F.col("meta").alias("mb"))
    met = x.join(y.hint("merge"), "key").filter("a < b and (ma <> mb or ma % 2 = 1)")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") >= AGREE).select("a", "b")


def class_pairs(forms: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity): pairs of classes with Jaccard similarity >= threshold, verified on the texts."""
    near = candidates(forms)
    near = near.join(forms.select(F.col("rep").alias("a"), F.col("norm").alias("na")).hint("merge"), "a")
    near = near.join(forms.select(F.col("rep").alias("b"), F.col("norm").alias("nb")).hint("merge"), "b")
    scored = near.withColumn("similarity", F.pandas_udf(_jaccard, "double")("na", "nb")).filter(F.col("similarity") >= threshold)
    return checkpoint(scored.select("a", "b", "similarity"))


def near_pairs(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(unit_id_1, unit_id_2): all pairs of records (unit_id, text), unit_id_1 < unit_id_2, at or above the threshold.

    Similarity is Jaccard over distinct 3-character substrings of the comparison form. Copies are collapsed first and
    only expanded in the result. A pair exactly at a threshold of 0.7 is missed with a chance of 1.1e-5, a closer pair
    with less (0.8: 2e-8), however few grams its records have; every pair found is verified exactly. The threshold
    should be 0.7 or more. Null texts and forms under three characters pair with nothing; an empty table gives an empty
    result.
    """
    members, forms = classes(records)
    pairs = class_pairs(forms, threshold).select("a", "b")
    repeated = forms.filter((F.col("copies") > 1) & (F.length("norm") >= GRAM)).select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    left = members.select(F.col("rep").alias("a"), F.col("unit_id").alias("u1")).hint("merge")
    right = members.select(F.col("rep").alias("b"), F.col("unit_id").alias("u2")).hint("merge")
    both = pairs.unionAll(repeated).join(left, "a").join(right, "b").filter("a <> b or u1 < u2")
    return both.select(F.least("u1", "u2").alias("unit_id_1"), F.greatest("u1", "u2").alias("unit_id_2"))


def near_groups(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(unit_id, class_id, group_id, links): every record that has a text with its class of copies, its group and its number of links.

    Links are counted between classes: the other classes that are near, plus the copies in the own one. group_id is
    the smallest unit_id of the group; records that are near to nothing form groups of their own.
    """
    members, forms = classes(records)
    pairs = class_pairs(forms, threshold).select("a", "b")
    groups = hash_to_min(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("near"))
    of = forms.select("rep", "copies").join(groups.select(F.col("node").alias("rep"), "group").hint("merge"), "rep", "left").join(ends.hint("merge"), "rep", "left")
    of = of.select("rep", F.coalesce("group", "rep").alias("g"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))
    first = members.groupBy("rep").agg(F.min("unit_id").alias("class_id"))
    of = checkpoint(of.join(first.hint("merge"), "rep"))
    least = of.groupBy("g").agg(F.min("class_id").alias("group_id"))
    of = of.join(least.hint("merge"), "g").select("rep", "class_id", "group_id", "links")
    return members.join(of.hint("merge"), "rep").select("unit_id", "class_id", "group_id", "links")


def found(matches: DataFrame) -> DataFrame:
    return near_pairs(match_records(matches), 0.7)
