import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.config import SENTENCE, SOFT, Options
from textloom.functions.text import clean
from textloom.operators import segment


def test_delimiters():
    text = "甲方提供图纸；乙方复核数据；丙方归档"
    assert len(segment.block_units(text, 420, SENTENCE, SOFT)) == 3
    assert len(segment.block_units("甲方提供图纸；乙方复核数据", 420, "。", SOFT)) == 1


def test_short_neighbours_merge():
    assert segment.block_units("一。二。三方共同确认最终图纸。", 420, SENTENCE, SOFT) == ["一。二。三方共同确认最终图纸。"]


def test_long_pieces_pack_at_soft_delimiters():
    text = "，".join(["一二三四五六七八九十"] * 30)
    units = segment.block_units(text, 80, SENTENCE, SOFT)
    assert all(segment.visible(u) <= 80 for u in units) and "".join(units) == clean(text)


def test_hard_cuts():
    assert [len(x) for x in segment.fixed_chunks("x" * 205, 100)] == [100, 100, 5]
    assert segment.fixed_chunks("x" * 100, 100) == ["x" * 100]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 甲乙，。；\n!", max_size=200))
def test_nothing_visible_is_lost(text):
    units = segment.block_units(text, 80, SENTENCE, SOFT)
    keep = lambda s: [c for c in s if c.isalnum()]
    assert keep("".join(units)) == keep(text) and all(u.strip() == u and u for u in units)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(1, 0, "甲", "/a/x.md", "x.md", ["第一段说明施工方案与质量要求。", "", None, "First line here with quite a few plain words in it"]), (2, 1, "乙", "/b/y.md", "y.md", None)]
    return spark.createDataFrame(rows, "doc_id long, group_index int, group_name string, file_path string, file_name string, blocks array<string>")


def test_units_table(documents):
    units = segment.build_units(documents, Options()).orderBy("unit_seq").collect()
    assert [u["location"] for u in units] == ["段1.1", "段4.1"] and [u["comparable"] for u in units] == [True, True]
    assert len({u["unit_id"] for u in units}) == 2 and len(units[0]["ngrams"]) == len(units[0]["normalized"]) - 2


def test_empty_table(documents):
    assert segment.build_units(documents.limit(0), Options()).count() == 0
