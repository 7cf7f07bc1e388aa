"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.session import checkpoint

__all__ = ["checkpoint", "code_points", "match_records", "mix64", "norm", "table"]

#: What survives the comparison form (letters, digits, underscore).
VISIBLE = re.compile(r"[^\w㐀-鿿]+")
MASK64 = (1 << 64) - 1


def norm(text: str | None) -> str:
    """NFKC, lower case, only letters, digits and `_`; null gives ''."""
    if not text:
        return ""
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return VISIBLE.sub("", text.lower())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def match_records(matches: DataFrame) -> DataFrame:
    """(unit_id, text): the distinct non-null unit ids on either side of rows with excluded = false that carry a text.

    A unit has one text wherever it is not null, so the smallest non-null text stands for it. Rows whose `excluded`
    is null are left out, as are units all of whose texts are null.
    """
    kept = matches.filter(~F.col("excluded"))
    a = kept.select(F.col("unit_id_a").alias("unit_id"), F.col("text_a").alias("text"))
    b = kept.select(F.col("unit_id_b").alias("unit_id"), F.col("text_b").alias("text"))
    both = a.unionAll(b).filter("unit_id is not null and text is not null")
    return both.groupBy("unit_id").agg(F.min("text").alias("text"))
