import hashlib
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as t

SAMPLES = ["", "Hello, World_1!", "按59507号备件，定制流程", "naïve café 123", "かなだけ", "кириллица only", "a" * 12, "表格 a b c d e f g h", "𠮷野家 ab"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, s) for k, s in enumerate([*SAMPLES, None])], "k int, s string")


def values(df, col):
    return [r[0] for r in df.orderBy("k").select(col).collect()]


def test_forms_and_counts(frame):
    py = [re.sub(r"[^\w]", "", (s or "").lower()) for s in [*SAMPLES, None]]
    assert values(frame, t.compare_form(F.col("s"))) == py
    assert values(frame, t.visible_chars(F.col("s"))) == [len(x) for x in py]
    assert values(frame, t.latin_words(F.col("s"))) == [len(re.findall(r"[A-Za-z0-9_]+", s or "")) for s in [*SAMPLES, None]]


def test_comparable(frame):
    got = values(frame, t.comparable(F.col("s"), 10, 8))
    assert got[2] and got[7] and not got[4] and not got[5] and not got[0] and not got[9]


def test_ngrams(frame):
    for form, grams in zip(values(frame, t.compare_form(F.col("s"))), values(frame, t.ngrams(t.compare_form(F.col("s")), 3))):
        expect = {form[i : i + 3] for i in range(len(form) - 2)} if len(form) > 3 else ({form} - {""})
        assert set(grams) == expect and len(grams) == len(expect)


def test_unit_id(spark):
    df = spark.range(1).select(t.unit_id(F.lit("g"), F.lit("/p"), F.lit("段1.1"), F.lit(3), F.lit("x" * 100)))
    assert df.first()[0] == hashlib.sha1(f"g|/p|段1.1|3|{'x' * 80}".encode()).hexdigest()[:16]


def test_snippet_and_shorten(spark):
    text = "a" * 60 + "HIT\n" + "b" * 60
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(t.snippet(F.col("s"), F.lit(60), F.lit(63))).first()[0] == "..." + "a" * 50 + "HIT " + "b" * 49 + "..."
    short = df.select(t.shorten(F.col("s"), 40)).first()[0]
    assert short == "a" * 12 + " ... " + "b" * 23 and len(short) == 40


@pytest.mark.parametrize("raw,key", [("D:20240102030405+08'00'", "2024-01-02 03:04"), ("2024-01-02T03:04:59+08:00", "2024-01-02 03:04"), ("2024-01-02 03:04", "2024-01-02 03:04"), ("2024-01-02", "2024-01-02 00:00"), ("yesterday", ""), (None, ""), ("D:2024", "")])
def test_minutes(spark, raw, key):
    assert spark.createDataFrame([(raw,)], "s string").select(t.minute_key(F.col("s"))).first()[0] == key


@pytest.mark.parametrize("a,b,n", [("000000000000000f", "0000000000000000", 4), ("ffffffffffffffff", "0000000000000000", 64), ("8000000000000000", "0000000000000001", 2), ("zz", "00", 64)])
def test_hamming(spark, a, b, n):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(t.hamming(F.col("a"), F.col("b"))).first()[0] == n


def test_python_functions(spark):
    t.register(spark)
    row = spark.sql("select nfkc('ＡＢ①') n, casefold_key('  Straße  X ') c, seq_ratio('tide', 'diet') x, seq_ratio('diet', 'tide') y, sim_score('abcdef', 'abcdef') s").first()
    assert row["n"] == "AB1" and row["c"] == "strasse x" and row["x"] != row["y"] and row["s"] == 1.0
    assert spark.sql("select count(*) from (select 'a1b22' t) , lateral finditer(t, '[0-9]+')").first()[0] == 2


def test_near_duplicate_score():
    assert 0.78 < t.similarity("投标人应在七个工作日内提交全部书面材料并加盖公章", "投标人应在七个工作日内提交全部书面资料并加盖公章") < 1
    assert t.similarity("", "x") == 0


def test_highlight():
    left, right = t.highlight("abcd<1", "abcd>2")
    assert left == "<mark>abcd</mark>&lt;1" and right == "<mark>abcd</mark>&gt;2"
