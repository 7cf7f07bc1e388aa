"""The index queries built from the units' own texts, on a table whose stored forms are null or stale."""

import hashlib
from datetime import datetime

import pytest

from textloom.functions.text import norm
from textloom.plans import queries

UNITS = "pos long, unit_id string, case_id string, options_id int, doc_id long, group_index int, group_name string, file_path string, file_name string, location string, text string, normalized string, comparable boolean, loaded_at timestamp"
OPTIONS = "options_id int, min_chars int, min_words int, similarity_threshold double, exclude_threshold double, ngram_size int, max_unit_chars int, sentence_delimiters string, soft_delimiters string"
SAME = "本标段采用Ａ型泵站３６台并逐项试压。"
STALE = "本标段采用ａ型泵站３６台并逐项试压"
TEMPLATE = "投标人须按⽆损检测要求提交全部资料。"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Groups 0 and 1 hold SAME (form null, form stale), group 2 the template (form null); one unit has lost its text."""
    d = str(tmp_path_factory.mktemp("tables"))
    at = datetime(2026, 1, 1)

    def row(pos, group, text, stored):
        return (pos, f"u{pos}", "c", 1, pos, group, f"g{group}", f"/g{group}", f"g{group}.md", f"段{pos}.1", text, stored, True, at)

    rows = [row(1, 0, SAME, None), row(2, 1, SAME, STALE), row(3, 2, TEMPLATE, None), row(4, -1, TEMPLATE, norm(TEMPLATE)), row(5, 2, None, None), row(6, 1, "太短", "太短")]
    spark.createDataFrame([*rows, rows[0]], UNITS).write.parquet(f"{d}/text_units.parquet")
    spark.createDataFrame([(1, None, None, None, None, None, None, None, None)], OPTIONS).write.parquet(f"{d}/check_options.parquet")
    return d


def grams(form):
    return {form[i : i + 3] for i in range(len(form) - 2)}


def run(spark, tables, name):
    return [tuple(r) for r in queries.queries()[name](spark, tables).collect()]


def test_duplicates_and_pairs(spark, tables):
    form = norm(SAME)
    assert run(spark, tables, "exact_duplicate_units_from_text") == [("c", form, 2, 2)]
    shared = 2 * len(grams(form))
    assert (1, 2, shared) in run(spark, tables, "ngram_candidates_from_text")
    assert run(spark, tables, "jaccard_pairs_from_text") == [("c", 1, 2, shared, 1.0)]


def test_frequency(spark, tables):
    expect = {}
    for form in (norm(SAME), norm(SAME), norm(TEMPLATE)):
        for g in grams(form):
            expect[g] = expect.get(g, 0) + 1
    assert dict(run(spark, tables, "ngram_document_frequency_from_text")) == expect
    assert run(spark, tables, "stop_grams_from_text") == []


def test_templates_and_ids(spark, tables):
    assert run(spark, tables, "exclude_exact_from_text") == [("c", 3, "u3", 4)]
    ids = {pos: made for _, _, pos, made in run(spark, tables, "unit_ids_from_text")}
    expect = {pos: hashlib.sha1(f"g{g}|/g{g}|段{pos}.1|{pos}|{norm(text)[:80]}".encode()).hexdigest()[:16] for pos, g, text in ((1, 0, SAME), (2, 1, SAME), (3, 2, TEMPLATE), (4, -1, TEMPLATE), (6, 1, "太短"))}
    assert ids == expect
