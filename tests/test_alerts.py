import pytest

from textloom.functions.text import hash_bits
from textloom.operators import images, keywords, metadata, summary
from pyspark.sql import functions as F

TEXTS = "ord long, group_name string, file_path string, file_name string, text string"
KEEP = ["ord", "group_name", "file_path", "file_name"]


def texts(spark, rows):
    return spark.createDataFrame([(k, g, f"/{g}/{k}", f"{k}.txt", t) for k, (g, t) in enumerate(rows)], TEXTS)


def alerts(spark, rows, *a, **k):
    rules, errors = keywords.rules(*a, **k)
    return {(r["keyword"], r["canonical"]): r for r in keywords.shared_values(keywords.find_hits(texts(spark, rows), rules, KEEP), []).collect()}, errors


def test_values_shared_by_two_groups_only(spark):
    shared = "联系电话13812345678，邮箱bid.team@example.com，身份证11010519900307123X，地址北京市朝阳区建国路88号2单元301室"
    got, _ = alerts(spark, [("A", shared), ("B", "电话13900000000 邮箱other@example.com"), ("C", shared)], (), ("YB-\\d+",))
    assert len(got) == 4 and all(r["groups"] == ["A", "C"] for r in got.values())


def test_presets_can_be_off(spark):
    assert not alerts(spark, [("A", "13812345678"), ("B", "13812345678")], presets={})[0]


def test_words_pool_cases_patterns_do_not(spark):
    rows = [("A", "Beacon beacon"), ("B", "BEACON")]
    words, _ = alerts(spark, rows, ("beacon",), presets={})
    assert [len(r["hits"]) for r in words.values()] == [3] and list(words.values())[0]["matched_text"] == "Beacon"
    assert not alerts(spark, rows, (), ("beacon",), {})[0]


def test_bad_pattern_is_reported_and_blank_hits_take_numbers(spark):
    rules, errors = keywords.rules((), ("(", r"\s+|x"), {})
    assert len(errors) == 1 and len(rules) == 1
    assert [e[:2] for e in keywords.rules((), ("(a", "[b", "x", "(a"), {})[1]] == ["(a", "[b"]
    hits = keywords.find_hits(texts(spark, [("A", "  x")]), rules, KEEP).collect()
    assert [(h["hit_no"], h["matched_text"]) for h in hits] == [(2, "x")]


def test_null_and_empty_texts(spark):
    assert not alerts(spark, [("A", None), ("B", "")], ("x",))[0]


FILES = "doc_id long, group_name string, file_path string, file_name string, metadata map<string,string>"


def test_metadata(spark):
    a = {"author": "李雷", "last_modified_by": "Han ", "company": "X  Co", "created": "2024-05-01T10:20:05", "modified": "D:20240501102059Z"}
    b = a | {"company": "x co", "created": "2024-05-01T10:20:55+08:00"}
    rows = [(1, "A", "/1", "1", a), (2, "B", "/2", "2", b), (3, "C", "/3", "3", {"author": "Administrator"}), (4, "D", "/4", "4", {"author": "administrator"}), (5, "E", "/5", "5", None)]
    got = {r["field"]: r for r in metadata.metadata_alerts(spark.createDataFrame(rows, FILES), []).collect()}
    assert set(got) == {"author", "company", "last_modified_by", "created", "modified"}
    assert got["company"]["value"] == "X  Co" and got["created"]["value"] == "2024-05-01 10:20（同一分钟）"
    assert {got[f]["level"] for f in ("author", "company")} == {"高"} and got["author"]["groups"] == ["A", "B"]


def test_metadata_inside_one_group(spark):
    rows = [(1, "A", "/1", "1", {"author": "p"}), (2, "A", "/2", "2", {"author": "p"})]
    assert metadata.metadata_alerts(spark.createDataFrame(rows, FILES), []).count() == 0


IMAGES = "ord string, group_name string, file_path string, file_name string, image_id string, source string, sha256 string, ahash string, size long, width int, height int"


def test_images(spark):
    def row(k, g, sha, ah, name=None):
        return (k, g, "/p", "f", name or f"i{k}", "s", sha, ah, 1, 8, 8)

    rows = [row("1", "A", "x", "000000000000000f"), row("2", "B", "x", "000000000000000f"), row("3", "C", "y", "000000000000000e"), row("4", "A", "z", None), row("5", "B", "w", "ffffffffffffffff"), row("6", "C", "v", "nothex")]
    df = spark.createDataFrame(rows, IMAGES)
    assert [(r["sha256"], r["groups"], len(r["images"])) for r in images.exact_duplicates(df, []).collect()] == [("x", ["A", "B"], 2)]
    assert sorted((r["a"], r["b"], r["distance"]) for r in images.near_duplicates(df, [], 6).collect()) == [("1", "3", 1), ("2", "3", 1)]
    assert images.image_duplicates(df, [], 6).count() == 3


@pytest.mark.parametrize("distance", [0, 1, 6, 20, 64])
def test_banded_join_equals_brute_force(spark, distance):
    import random

    r = random.Random(distance)
    base = [r.getrandbits(64) for _ in range(8)]
    rows = []
    for k in range(60):
        v = base[k % 8]
        for _ in range(r.randint(0, 12)):
            v ^= 1 << r.randrange(64)
        rows.append((k, f"{v:016x}"))
    df = spark.createDataFrame(rows, "ord long, h string").withColumn("bits", hash_bits(F.col("h")))
    got = {(x["a"], x["b"], x["distance"]) for x in images.near_hashes(df, [], distance).collect()}
    expect = {(a, b, d) for a, x in rows for b, y in rows if a < b and (d := (int(x, 16) ^ int(y, 16)).bit_count()) <= distance}
    assert got == expect


MATCHES = "match_id string, group_a string, group_b string, file_a string, file_b string, unit_id_a string, unit_id_b string, similarity double, excluded boolean"


def test_summaries(spark):
    rows = [("M1", "B", "A", "/x/a.md", "b.md", "1", "2", 0.9, False), ("M2", "A", "B", "a.md", "c.md", "1", "3", 0.8, False), ("M3", "A", "B", "a.md", "d.md", "4", "5", 1.0, True)]
    m = spark.createDataFrame(rows, MATCHES)
    groups = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "group_index int, group_name string")
    got = {(r["group_a"], r["group_b"]): r for r in summary.pair_summaries(m, groups, []).collect()}
    assert len(got) == 3 and got["A", "C"]["match_count"] == 0 and got["A", "C"]["files"] == []
    ab = got["A", "B"]
    assert (ab["match_count"], ab["excluded_count"], ab["max_similarity"], ab["files"]) == (2, 1, 0.9, ["a.md", "b.md", "c.md"])
    assert [r["match_id"] for r in summary.sampled(m, [], 2, 5).orderBy("match_id").collect()] == ["M1", "M3"]
    notes = {r["unit_id"]: r for r in summary.annotations(m, []).collect()}
    assert len(notes["1"]["refs"]) == 2 and notes["4"]["all_excluded"]
    assert summary.pair_summaries(m, groups, []).filter(summary.pair_filter("a", 0.5)).count() == 1
