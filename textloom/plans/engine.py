"""A whole run: documents to units, matches, alerts, duplicates and summaries, as a bundle of tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import Config, normalize_config
from textloom.functions.session import checkpoint
from textloom.operators import images, keywords, metadata, ngrams, segment, similarity, summary
from textloom.sources import files, pdf

Progress = Callable[[str], None]
#: Reading order of a run; locations sort as text.
FILE_ORDER, UNIT_ORDER = ["group_index", "file_path"], ["location", "doc_id", "unit_seq"]


@dataclass
class CheckResult:
    config: Config
    documents: DataFrame
    units: DataFrame
    matches: DataFrame
    keyword_alerts: DataFrame
    keyword_errors: list[str]
    metadata_alerts: DataFrame
    image_duplicates: DataFrame
    pair_summaries: DataFrame
    stage_seconds: dict[str, float] = field(default_factory=dict)
    stats: dict[str, Any] = field(default_factory=dict)


class _Stages:
    """Times of materialised stages, with a message at the start of each."""

    def __init__(self, progress: Progress | None):
        self.seconds: dict[str, float] = {}
        self.progress = progress or (lambda _: None)

    def run(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        self.progress(name)
        began = time.perf_counter()
        df = checkpoint(make())
        self.seconds[name] = time.perf_counter() - began
        return df


def check_documents(documents: DataFrame, config: Config, progress: Progress | None = None) -> CheckResult:
    """Run all detectors over a table of documents (see `read_documents`); group_index < 0 marks template files."""
    o, stages, spark = config.options, _Stages(progress), documents.sparkSession
    began = time.perf_counter()
    listed = documents
    own_files = stages.run("parse_documents", lambda: listed.filter("group_index >= 0"))
    documents = own_files.unionByName(stages.run("parse_excludes", lambda: listed.filter("group_index < 0")))
    units = stages.run("segment_units", lambda: ngrams.number_units(segment.build_units(documents, o), FILE_ORDER, UNIT_ORDER))
    own, excludes = units.filter("group_index >= 0"), units.filter("group_index < 0")

    def match() -> DataFrame:
        found = similarity.text_matches(own, [], o.similarity_threshold, o.max_ngram_postings, o.max_candidates_per_unit)
        flagged = similarity.with_exclusion(checkpoint(found), own, excludes, [], o.exclude_threshold, o.max_ngram_postings)
        names = {"unit_id": "unit_id", "group_name": "group", "file_name": "file", "location": "location", "text": "text"}
        numbered = similarity.number_matches(flagged)
        return numbered.select("match_id", *(F.col(f"{c}_{s}").alias(f"{n}_{s}") for c, n in names.items() for s in "ab"), "similarity", "excluded", "exclude_reason", "pos_a", "pos_b")

    matches = stages.run("similarity", match)
    wanted, errors = keywords.config_rules(config)
    texts = documents.filter("group_index >= 0").select(F.col("doc_id").alias("ord"), "group_name", "file_path", "file_name", keywords.full_text().alias("text"))
    alerts = stages.run("keywords", lambda: keywords.shared_values(keywords.find_hits(texts, wanted, ["ord", "group_name", "file_path", "file_name"]), []).orderBy("rule_no", "first_seen"))
    level = F.when(F.col("level") == "高", 0).otherwise(1)
    meta = stages.run("metadata", lambda: metadata.metadata_alerts(documents.filter("group_index >= 0"), []).orderBy(level, "label", "value"))
    pictures = files.image_table(documents.filter("group_index >= 0"))
    copies = stages.run("images", lambda: images.image_duplicates(pictures, [], o.image_ahash_distance))
    groups = spark.createDataFrame([(k, g.name) for k, g in enumerate(config.groups)], "group_index int, group_name string")
    pairs = summary.pair_summaries(matches, groups, [])
    result = CheckResult(config, documents, units, matches, alerts, errors, meta, copies, pairs, stages.seconds)
    result.stats = _stats(result) | {"engine_seconds": time.perf_counter() - began}
    return result


def _stats(r: CheckResult) -> dict[str, Any]:
    d = r.documents.agg(F.count_if(F.col("group_index") >= 0).alias("document_count"), F.count_if(F.col("group_index") < 0).alias("exclude_document_count")).first()
    u = r.units.filter("group_index >= 0").agg(F.count(F.lit(1)).alias("unit_count"), F.count_if("comparable").alias("comparable_unit_count")).first()
    m = r.matches.agg(F.count_if(~F.col("excluded")).alias("similar"), F.count_if("excluded").alias("excluded")).first()
    out = {"group_count": len(r.config.groups), **d.asDict(), **u.asDict(), "short_filtered_unit_count": u["unit_count"] - u["comparable_unit_count"]}
    for name, n in (("similar", m["similar"]), ("excluded", m["excluded"])):
        out |= {f"{name}_match_count": n, f"total_{name}_match_count": n, f"displayed_{name}_match_count": n, f"truncated_{name}_match_count": 0}
    counts = {"keyword_alert_count": r.keyword_alerts, "metadata_alert_count": r.metadata_alerts, "image_duplicate_count": r.image_duplicates}
    return out | {"match_truncated": False} | {k: df.count() for k, df in counts.items()}


def check(spark: SparkSession, config: dict[str, Any] | Config, output_dir: str | None = None, progress: Progress | None = None, provider: pdf.Provider | None = None) -> CheckResult:
    """Run a configuration; with an output directory the report bundle is written too."""
    config = config if isinstance(config, Config) else normalize_config(config)
    documents = files.read_documents(spark, config.groups, config.exclude_files, config.options, provider)
    result = check_documents(documents, config, progress)
    if output_dir:
        from textloom.plans.report import write_bundle

        began = time.perf_counter()
        write_bundle(result, output_dir)
        result.stage_seconds["report"] = time.perf_counter() - began
    return result
