"""The stored tables as the operators want them: repeated rows settled, settings joined, sides aligned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.session import checkpoint
from textloom.functions.text import compare_form, ngrams, nfkc

#: Hashes of contested keys that are broadcast at most.
CONTESTED = 2_000_000
#: Texts of these characters only are NFKC already or become so by settling full-width ASCII.
NEAR_NFKC = r"^[\x09-\x7E、。〇-】㐀-鿿！-～　]*$"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bid_files, of repeated rows the one loaded last."""
    raw = table(spark, sf_dir, "bid_files")
    cols = [c for c in raw.columns if c != "doc_id"]
    return raw.groupBy("doc_id").agg(F.max_by(F.struct(*cols), F.struct("loaded_at", "file_path")).alias("r")).select("doc_id", "r.*")


def units(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """text_units, of repeated rows one with a text if there is one, and of those the one loaded last."""
    raw = table(spark, sf_dir, "text_units")
    cols = columns or [c for c in raw.columns if c not in ("unit_id", "pos")]
    return _settled(raw, ["unit_id", "pos"], cols)


def _settled(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    has = F.coalesce(F.col("text"), F.lit("")) != ""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(has, "loaded_at", F.coalesce("text", F.lit("")))).alias("r")).select(*keys, "r.*")


def units_by_run(spark: SparkSession, sf_dir: str, columns: list[str], most: int = CONTESTED) -> DataFrame:
    """`units` of runs (case_id), a run in one partition; texts are shuffled once, as repeated rows are settled there.
    `odd` is the `odd_nfkc` of the text, made before, as Spark takes rows from Python for unpartitioned.

    Rows of a key that stands in several runs (by hashes of keys and runs, so no text is read for it) are settled before;
    with over `most` such keys all rows are.
    """
    raw = table(spark, sf_dir, "text_units")
    cols = [c for c in columns if c != "case_id"]
    key, run = F.xxhash64("unit_id", "pos"), F.xxhash64("case_id")
    runs = raw.groupBy(key.alias("_key")).agg(F.min(run).alias("a"), F.max(run).alias("b"))
    contested = checkpoint(runs.filter("a <> b").select("_key"))
    n = contested.count()
    odd = odd_nfkc(F.coalesce("text", F.lit("")))
    if n > most:
        return units(spark, sf_dir, columns).filter("case_id is not null").withColumn("odd", odd).repartition("case_id")
    raw = raw.select("unit_id", "pos", "case_id", *cols, "loaded_at")
    if n:
        keyed = raw.withColumn("_key", key)
        shared = keyed.join(F.broadcast(contested), "_key", "left_semi").drop("_key")
        raw = keyed.join(F.broadcast(contested), "_key", "left_anti").drop("_key").unionByName(_settled(shared, ["unit_id", "pos"], ["case_id", *cols, "loaded_at"]))
    raw = raw.filter("case_id is not null").withColumn("odd", odd)
    return _settled(raw.repartition("case_id"), ["case_id", "unit_id", "pos"], [*cols, "odd"])


def odd_nfkc(text):
    """NFKC of the texts that need Python, null in place of others."""
    return nfkc(F.when(~text.rlike(NEAR_NFKC), text))


def nfkc_text(text, odd=None):
    """NFKC in one scan: natively where full-width ASCII is all that has to be settled; Python sees a null in place of
    such a text. odd: `odd_nfkc` of the text, where it is at hand."""
    return F.when(text.rlike(NEAR_NFKC), F.translate(text, WIDE, NARROW)).otherwise(odd_nfkc(text) if odd is None else odd)


def with_forms(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds the comparison form as `normalized`, of the text under NFKC."""
    return rows.withColumn("normalized", compare_form(nfkc_text(F.coalesce(F.col(text), F.lit("")))))


def option_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check_options with defaults for nulls."""
    o = table(spark, sf_dir, "check_options")
    return o.select("options_id", F.coalesce("min_chars", F.lit(10)).alias("min_chars"), F.coalesce("min_words", F.lit(8)).alias("min_words"), F.coalesce("similarity_threshold", F.lit(0.78)).alias("threshold"), F.coalesce("exclude_threshold", F.lit(0.86)).alias("exclude_threshold"), F.coalesce("ngram_size", F.lit(3)).alias("ngram_size"), "max_unit_chars", "sentence_delimiters", "soft_delimiters")


UNIT_COLUMNS = ["case_id", "options_id", "doc_id", "group_index", "group_name", "file_path", "file_name", "location", "text"]


def comparable_units(spark: SparkSession, sf_dir: str, columns: list[str] = UNIT_COLUMNS, by_run: bool = False) -> DataFrame:
    """Units with the settings of their run, comparison form, comparability and n-grams from their own text."""
    from textloom.functions.text import comparable

    rows = (units_by_run if by_run else units)(spark, sf_dir, columns)
    rows = rows.withColumn("_plain", nfkc_text(F.coalesce(F.col("text"), F.lit("")), F.col("odd") if by_run else None)).drop("odd")
    rows = rows.withColumn("normalized", compare_form(F.col("_plain"))).join(option_values(spark, sf_dir), "options_id", "left")
    rows = rows.withColumn("comparable", comparable(F.col("_plain"), F.coalesce("min_chars", F.lit(10)), F.coalesce("min_words", F.lit(8))) & (F.col("normalized") != ""))
    return rows.withColumn("ngrams", ngrams(F.col("normalized"), F.coalesce("ngram_size", F.lit(3)))).drop("_plain")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """similarity_matches, of repeated match_ids the one loaded last, similarity on the scale 0 to 1, no half-empty rows."""
    raw = table(spark, sf_dir, "similarity_matches")
    cols = [c for c in raw.columns if c != "match_id"]
    once = raw.groupBy("match_id").agg(F.max_by(F.struct(*cols), F.struct("loaded_at", F.coalesce("unit_id_a", F.lit("")), F.coalesce("unit_id_b", F.lit("")))).alias("r")).select("match_id", "r.*")
    return once.withColumn("similarity", F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity")))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_images with the run they belong to and a unique `ord` of their own, `doc_id/image_id`."""
    runs = files(spark, sf_dir).select("doc_id", "case_id")
    i = table(spark, sf_dir, "doc_images").dropDuplicates(["doc_id", "image_id"])
    return i.join(runs, "doc_id").withColumn("ord", F.concat_ws("/", F.lpad(F.col("doc_id").cast("string"), 19, "0"), "image_id"))
