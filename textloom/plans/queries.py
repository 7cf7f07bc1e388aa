"""The registered queries of the reference operators; each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import comparable, compare_form, has_han, highlight_common, latin_words, ngrams, shorten, unit_id, visible_chars
from textloom.functions.session import checkpoint
from textloom.operators import images as img
from textloom.operators import keywords as kw
from textloom.operators import metadata as meta
from textloom.operators import ngrams as ng
from textloom.operators import runs, segment, similarity, summary
from textloom.plans import tables as t
from textloom.sources.markdown import strip_markdown, text_blocks

CASE = ["case_id"]
KEYWORDS = ("光模块", "热力管", "Beacon", "guardrail")
CODES = "[A-Z]{2}-[0-9]{4}"


def long(c):
    return F.col(c).cast("long").alias(c)


def _named(m: DataFrame) -> DataFrame:
    """Matches with the names that summaries use."""
    return m.select(*CASE, *(F.col(f"{c}_{s}").alias(f"{n}_{s}") for s in "ab" for c, n in (("unit_id", "unit_id"), ("group_name", "group"), ("file_name", "file"), ("location", "location"), ("text", "text"))), "pos_a", "pos_b", "shared", "similarity", *(c for c in ("excluded", "exclude_reason") if c in m.columns))


# ---- segmentation and scalar functions


def unit_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.files(spark, sf_dir).join(t.option_values(spark, sf_dir).select("options_id", "max_unit_chars", "sentence_delimiters", "soft_delimiters"), "options_id", "left")
    return segment.split_blocks(docs, ["doc_id"]).select("doc_id", "location", "text")


def document_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = t.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.hard_pieces(F.col("text"))).alias("piece_no", "piece"))
    return pieces.select("doc_id", long("piece_no"), "piece")


def unit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the text under NFKC, as a run has it after cleaning."""
    u = t.table(spark, sf_dir, "text_units").select("unit_id", "pos", "loaded_at", "text").distinct()
    u = u.withColumn("text", t.nfkc_text(F.col("text")))
    form = compare_form(F.col("text"))
    return u.select("unit_id", "pos", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"), form.alias("form"), visible_chars(F.col("text")).cast("long").alias("chars"), latin_words(F.col("text")).cast("long").alias("words"), has_han(F.col("text")).alias("han"), comparable(F.col("text"), 10, 8).alias("able"))


def unit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = t.table(spark, sf_dir, "text_units").filter("normalized is not null").select("group_name", "file_path", "location", "pos", "normalized").distinct()
    return u.select("file_path", "location", "pos", unit_id(F.col("group_name"), F.col("file_path"), F.col("location"), F.col("pos"), F.col("normalized")).alias("made_id"))


def unit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a file: what its units keep of its blocks - all but white space - and how many units are over the limit."""
    docs = t.files(spark, sf_dir).join(t.option_values(spark, sf_dir).select("options_id", "max_unit_chars", "sentence_delimiters", "soft_delimiters"), "options_id", "left")
    u = segment.split_blocks(docs, ["doc_id", "max_unit_chars"]).withColumn("limit", F.coalesce("max_unit_chars", F.lit(420)))
    parts = u.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "part_no", "text"))).alias("p"), F.count_if(visible_chars(F.col("text")) > F.col("limit")).alias("over_limit"))
    return parts.select("doc_id", F.md5(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), ""), "[\\s\u0085\u00a0\u200b\u3000\u2000-\u200a]+", "")).alias("kept_md5"), "over_limit")


def text_file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents read as plain text files: one row a line that is not blank."""
    blocks = F.pandas_udf(lambda s: s.map(text_blocks, na_action="ignore"), "array<string>")
    return t.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(blocks("text")).alias("block_no", "block")).select("doc_id", long("block_no"), "block")


def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select("doc_id", shorten(F.col("text"), 160).alias("short"))


def markdown_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select("doc_id", strip_markdown("text").alias("plain"))


# ---- the n-gram index


def exact_duplicate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = t.table(spark, sf_dir, "text_units").filter("comparable and normalized <> '' and group_index >= 0")
    return u.groupBy(*CASE, "normalized").agg(F.count_distinct("group_name").alias("n_groups"), F.count_distinct("unit_id", "pos").alias("n_units")).filter("n_groups >= 2")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of groups by their stored forms, of repeated rows the smallest form, for the queries that have SQL twins."""
    u = t.table(spark, sf_dir, "text_units").filter("normalized <> '' and group_index >= 0 and comparable")
    return u.groupBy(*CASE, "pos", "unit_id").agg(F.min("normalized").alias("normalized"), F.min("group_index").alias("group_index")).withColumn("ngrams", ngrams(F.col("normalized"), 3))


def ngram_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ng.gram_frequency(_stored(spark, sf_dir), [])


def stop_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ng.gram_frequency(_stored(spark, sf_dir), []).filter("df > 300")


def ngram_candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ng.candidates(checkpoint(_stored(spark, sf_dir)), CASE)


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of different groups that pass the recall filters, with their Jaccard similarity of 0.5 or more."""
    return _jaccard_pairs(checkpoint(_stored(spark, sf_dir)))


def _jaccard_pairs(u: DataFrame) -> DataFrame:
    pairs = ng.recalled(ng.candidates(u, CASE), u)
    for s in "ab":
        pairs = pairs.join(u.select(*(CASE if s == "a" else []), F.col("pos").alias(f"pos_{s}"), F.col("ngrams").alias(f"ngrams_{s}")), f"pos_{s}")
    return pairs.withColumn("jaccard", similarity.jaccard("ngrams_a", "ngrams_b")).filter("jaccard >= 0.5").select(*CASE, "pos_a", "pos_b", "shared", "jaccard")


# ---- the same seven from the units' own texts: the stored forms are null or stale in places, and SQL has no NFKC


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units (templates too) with form, comparability and n-grams from their NFKC text and the settings of their run."""
    raw = t.units(spark, sf_dir, t.UNIT_COLUMNS).filter("text <> ''")
    u = raw.withColumn("text", t.nfkc_text(F.col("text"))).withColumn("normalized", compare_form(F.col("text")))
    u = u.join(t.option_values(spark, sf_dir), "options_id", "left")
    u = u.withColumn("comparable", comparable(F.col("text"), F.coalesce("min_chars", F.lit(10)), F.coalesce("min_words", F.lit(8))) & (F.col("normalized") != ""))
    return u.withColumn("ngrams", ngrams(F.col("normalized"), F.coalesce("ngram_size", F.lit(3))))


def _own_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).filter("comparable and group_index >= 0").select(*CASE, "pos", "unit_id", "group_index", "group_name", "normalized", "ngrams")


def unit_ids_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a unit that has a text; the id of a lost text can't be made."""
    return _own(spark, sf_dir).select("file_path", "location", "pos", unit_id(F.col("group_name"), F.col("file_path"), F.col("location"), F.col("pos"), F.col("normalized")).alias("made_id"))


def exact_duplicate_units_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _own_groups(spark, sf_dir)
    return u.groupBy(*CASE, "normalized").agg(F.count_distinct("group_name").alias("n_groups"), F.count_distinct("unit_id", "pos").alias("n_units")).filter("n_groups >= 2")


def ngram_document_frequency_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ng.gram_frequency(_own_groups(spark, sf_dir), [])


def stop_grams_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ng.gram_frequency(_own_groups(spark, sf_dir), []).filter("df > 300")


def ngram_candidates_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ng.candidates(checkpoint(_own_groups(spark, sf_dir)), CASE)


def jaccard_pairs_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard_pairs(checkpoint(_own_groups(spark, sf_dir)))


def exclude_exact_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = checkpoint(_own(spark, sf_dir).filter("comparable").select(*CASE, "pos", "unit_id", "group_index", "normalized"))
    return _exclude_exact(u)


# ---- similarity with exclusion, from the units' own texts


#: The reference's options that `similarity_excluded` and its SQL keep: units of an n-gram, candidates of a unit.
BOUNDS = {"max_postings": 300, "top": 200}
_SIDE_COLUMNS = ["case_id", "options_id", "group_index", "group_name", "file_name", "location", "text"]


def _matched(spark: SparkSession, sf_dir: str, exclude: bool, chars: int = runs.RUN_CHARS, room: int = runs.RUN_CHARS // 2) -> DataFrame:
    """Matches of all runs: those that a task can hold are matched in one, larger ones (counted first) in parts of about
    `room` characters, or by joins with their templates."""
    bounds = BOUNDS if exclude else {}
    large = {r["case_id"]: r["n"] for r in runs.large_runs(t.table(spark, sf_dir, "text_units"), CASE, chars).collect()}
    defaults = {"ngram_size": F.coalesce("ngram_size", F.lit(3)), "threshold": F.coalesce("threshold", F.lit(0.78)), "exclude_threshold": F.coalesce("exclude_threshold", F.lit(0.86))}
    u = t.comparable_units(spark, sf_dir, _SIDE_COLUMNS, by_run=True).withColumns(defaults)
    found = _named(runs.matches_in_runs(u.filter(~F.col("case_id").isin(list(large))) if large else u, CASE, exclude, **bounds))
    if not large:
        return found
    u = t.comparable_units(spark, sf_dir).withColumns(defaults).filter(F.col("case_id").isin(list(large)))
    if not exclude:
        parts = F.create_map(*(F.lit(x) for case, n in large.items() for x in (case, -(-n // room))))[F.col("case_id")]
        return found.unionByName(_named(runs.matches_in_parts(u, CASE, parts)))
    u = checkpoint(u)
    own, excludes = u.filter("group_index >= 0"), u.filter("group_index < 0")
    rest = checkpoint(similarity.text_matches(own, CASE, **bounds))
    return found.unionByName(_named(similarity.with_exclusion(rest, own, excludes, CASE)))


def similarity_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, False)


def similarity_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, True)


def exclude_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose stored form stands in a template file of their run, with the first such unit."""
    return _exclude_exact(t.table(spark, sf_dir, "text_units").filter("normalized <> '' and comparable"))


def _exclude_exact(u: DataFrame) -> DataFrame:
    e = u.filter("group_index < 0").groupBy(*CASE, "normalized").agg(F.min("pos").alias("exclude_pos"))
    return u.filter("group_index >= 0").select(*CASE, "pos", "unit_id", "normalized").distinct().join(e, [*CASE, "normalized"]).select(*CASE, "pos", "unit_id", "exclude_pos")


def highlighted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t.matches(spark, sf_dir).filter("text_a is not null and text_b is not null")
    return m.select("match_id", highlight_common("text_a", "text_b").alias("h")).select("match_id", "h.l", "h.r")


# ---- keywords


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.files(spark, sf_dir).filter("group_index >= 0").select(*CASE, F.col("doc_id").alias("ord"), "group_name", "file_path", "file_name", kw.full_text().alias("text"))


_KEEP = [*CASE, "ord", "group_name", "file_path", "file_name"]


def _shown(alerts: DataFrame) -> DataFrame:
    return alerts.select(*CASE, "keyword", "canonical", F.array_join("groups", "|").alias("group_names"), F.size("hits").cast("long").alias("n_hits"), "matched_text")


def keyword_hits_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = kw.find_hits(_texts(spark, sf_dir), kw.rules(KEYWORDS, presets={})[0], _KEEP)
    return hits.select(*CASE, F.col("ord").alias("doc_id"), "keyword", "hit_no", "matched_text", "snippet")


def keyword_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = kw.find_hits(_texts(spark, sf_dir), kw.rules(KEYWORDS, presets={})[0], _KEEP)
    return _shown(kw.shared_values(hits, CASE)).drop("matched_text", "canonical")


def regex_shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = kw.find_hits(_texts(spark, sf_dir), kw.rules((), (CODES,), {})[0], _KEEP)
    return _shown(kw.shared_values(hits, CASE)).drop("keyword", "matched_text")


def regex_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(kw.shared_values(kw.find_hits(_texts(spark, sf_dir), kw.rules()[0], _KEEP), CASE))


def stored_keyword_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts from the stored hits: words pool their case variants, patterns keep each value."""
    h = t.table(spark, sf_dir, "keyword_hits").filter("group_name is not null").withColumn("canonical", F.when(F.col("is_regex"), F.col("matched_text")).otherwise(F.lower("keyword")))
    g = h.groupBy(*CASE, "keyword", "is_regex", "canonical").agg(F.count_distinct("group_name").alias("n_groups"), F.count(F.lit(1)).alias("n_hits"))
    return g.filter("n_groups >= 2")


# ---- metadata and images


def _metadata(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    a = meta.metadata_alerts(t.files(spark, sf_dir).filter("group_index >= 0"), keys)
    return a.select(*keys, "field", "level", "key", F.array_join("groups", "|").alias("group_names"), F.size("hits").cast("long").alias("n_hits"))


def metadata_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metadata(spark, sf_dir, CASE)


def metadata_alerts_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metadata(spark, sf_dir, [])


def _image_groups(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    d = img.exact_duplicates(t.images(spark, sf_dir), keys)
    return d.select(*keys, "sha256", F.array_join("groups", "|").alias("group_names"), F.size("images").cast("long").alias("n_images"))


def image_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _image_groups(spark, sf_dir, CASE)


def image_exact_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _image_groups(spark, sf_dir, [])


def image_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return img.near_duplicates(t.images(spark, sf_dir), CASE, 6).select(*CASE, "a", "b", long("distance"))


def image_near_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return img.near_duplicates(t.images(spark, sf_dir), [], 20).select("a", "b", long("distance"))


def image_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = img.image_duplicates(t.images(spark, sf_dir), [], 6)
    return d.select("kind", long("distance"), F.to_json("images").alias("images"))


def hamming_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose 64 sign bits differ in 16 places or fewer, by the banded join."""
    e = t.table(spark, sf_dir, "embeddings").filter("embedding is not null")
    bits = F.expr("aggregate(transform(slice(embedding, 1, 64), (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    near = img.near_hashes(e.select(F.col("vec_id").alias("ord"), bits.alias("bits")), [], 16)
    return near.select("a", "b", long("distance"))


# ---- summaries


def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average is left out: sums of doubles depend on their order."""
    p = summary.pair_stats(t.matches(spark, sf_dir), CASE).drop("avg_similarity")
    return p.withColumn("files", F.array_join("files", "|"))


def all_group_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = t.files(spark, sf_dir).filter("group_index >= 0").select(*CASE, "group_index", "group_name").distinct()
    p = summary.pair_summaries(t.matches(spark, sf_dir), groups, CASE)
    return p.select(*CASE, "group_a", "group_b", "match_count", "excluded_count", "max_similarity")


def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.document_summary(t.units(spark, sf_dir, ["doc_id", "comparable", "text"]), ["doc_id"])


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = t.units(spark, sf_dir, ["case_id", "group_index", "comparable", "text"])
    return summary.run_stats(t.files(spark, sf_dir), u, t.matches(spark, sf_dir), CASE)


def sampled_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.sampled(t.matches(spark, sf_dir).filter("not excluded and similarity is not null"), CASE).select(*CASE, "match_id", "similarity")


def unit_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t.matches(spark, sf_dir).filter("unit_id_a is not null and unit_id_b is not null")
    return summary.annotations(m, CASE).select(*CASE, "unit_id", F.size("refs").cast("long").alias("n_refs"), "max_similarity", "all_excluded")


def queries() -> dict:
    skip = {"queries", "long", "table"}
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in skip}
