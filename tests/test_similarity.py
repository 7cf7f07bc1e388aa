"""The match pipeline against a small brute force."""

import difflib
import random
from collections import Counter

import pytest

from textloom.operators import ngrams, similarity

SCHEMA = "pos long, unit_id string, group_index int, group_name string, file_path string, file_name string, location string, text string, normalized string, comparable boolean, ngrams array<string>"


def grams(s):
    return sorted({s[i : i + 3] for i in range(len(s) - 2)}) if len(s) > 3 else ([s] if s else [])


def unit(pos, group, text):
    return (pos, f"u{pos}", group, f"g{group}", f"/g{group}", f"g{group}.md", f"段{pos}.1", text, text, True, grams(text))


def brute(units, threshold=0.78, cap=300, top=200):
    df = Counter(g for u in units for g in u[-1])
    out = {}
    for i, a in enumerate(units):
        counts = {}
        for b in units[i + 1 :]:
            n = sum(1 for g in set(a[-1]) & set(b[-1]) if df[g] <= cap or not cap)
            n += max(len(a[-1]), 1) if a[8] == b[8] else 0
            if n:
                counts[b[0]] = n
        ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: top or None]
        for pos, shared in ranked:
            b = next(u for u in units if u[0] == pos)
            if a[2] == b[2] or min(len(a[8]), len(b[8])) / max(len(a[8]), len(b[8])) < 0.55 or shared < max(2, int(min(len(a[-1]), len(b[-1])) * 0.12)):
                continue
            x, y = set(a[-1]), set(b[-1])
            s = 1.0 if a[8] == b[8] else 0.62 * difflib.SequenceMatcher(None, a[8], b[8], autojunk=False).ratio() + 0.38 * len(x & y) / len(x | y)
            if s >= threshold:
                out[a[0], b[0]] = s
    return out


def world(n=60, seed=1):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 40))) for _ in range(8)]
    out = []
    for pos in range(1, n + 1):
        s = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            s[r.randrange(len(s))] = r.choice("abcxyz")
        out.append(unit(pos, r.randrange(4), "".join(s)))
    return out


@pytest.mark.parametrize("top,cap", [(200, 300), (3, 300), (0, 0), (200, 12)])
def test_matches_equal_brute_force(spark, top, cap):
    units = world()
    got = similarity.text_matches(spark.createDataFrame(units, SCHEMA), [], 0.78, cap, top).select("pos_a", "pos_b", "similarity").collect()
    expect = brute(units, 0.78, cap, top)
    assert {(r[0], r[1]) for r in got} == set(expect)
    assert all(abs(r[2] - expect[r[0], r[1]]) < 1e-12 for r in got)


def test_posting_cap_is_inclusive(spark):
    for n, found in ((4, True), (5, False)):
        units = [unit(k, k % 2, "abcdefgh"[:3] + "xyz"[k % 3] * 1) for k in range(1, n + 1)]
        df = spark.createDataFrame(units, SCHEMA)
        by_gram = ngrams.candidates(df, [], max_postings=4).filter("shared < 2").count()
        assert bool(by_gram) is found


def test_no_units_no_matches(spark):
    assert similarity.text_matches(spark.createDataFrame([], SCHEMA), []).count() == 0


def test_exclusion_needs_both_sides(spark):
    t = "招标文件第二章要求投标人提供完整的施工组织设计方案"
    near = t.replace("完整", "齐全")
    other = "我方承诺按期完成全部安装调试并提供两年质保服务内容"
    own = [unit(1, 0, t), unit(2, 1, near), unit(3, 0, other), unit(4, 1, other)]
    exclude = [unit(9, -1, t)]
    o, e = spark.createDataFrame(own, SCHEMA), spark.createDataFrame(exclude, SCHEMA)
    found = similarity.with_exclusion(similarity.text_matches(o, []), o, e, [], 0.8)
    got = {(r["pos_a"], r["pos_b"]): r for r in found.collect()}
    assert got[1, 2]["excluded"] and "1.00" in got[1, 2]["exclude_reason"] and not got[3, 4]["excluded"] and got[3, 4]["exclude_reason"] is None


def test_number_units_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(i % 7, f"段{i}.1", i) for i in range(500)], "group_index int, location string, unit_seq int")
    rows = ngrams.number_units(df, ["group_index"], ["location", "unit_seq"]).collect()
    rows.sort(key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == list(range(1, 501))
    keys = [(r["group_index"], r["location"], r["unit_seq"]) for r in rows]
    assert keys == sorted(keys)


def test_matches_are_numbered_across_blocks(spark):
    rows = [(a, b, (a * 7 + b) % 5) for a in range(1, 12) for b in range(a + 1, 14) if (a + b) % 3]
    df = spark.createDataFrame(rows, "pos_a long, pos_b long, shared long")
    got = {(r["pos_a"], r["pos_b"]): r["match_id"] for r in similarity.number_matches(df, block=3).collect()}
    order = sorted(rows, key=lambda r: (r[0], -r[2], r[1]))
    assert got == {(a, b): f"M{k:05d}" for k, (a, b, _) in enumerate(order, start=1)}
