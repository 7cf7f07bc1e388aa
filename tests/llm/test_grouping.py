"""Problems 1, 5 and 6 against brute force."""

import random

import numpy as np
import pytest

from textloom.llm import components, neardup, spans
from textloom.llm.common import match_records, norm

MATCHES = "unit_id_a string, unit_id_b string, text_a string, text_b string, excluded boolean, extra int"


def groups_of(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def run_groups(spark, pairs, heavy=components.HEAVY):
    df = spark.createDataFrame(pairs, "a string, b string")
    return {r["node"]: r["group"] for r in components.hash_to_min(df, heavy=heavy).collect()}


@pytest.mark.parametrize("seed,heavy", [(0, components.HEAVY), (1, 5)])
def test_random_links(spark, seed, heavy):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(60):03d}", f"n{r.randrange(60):03d}") for _ in range(40)]
    assert run_groups(spark, pairs, heavy) == groups_of([p for p in pairs if p[0] != p[1]])


def test_numbers_are_groups_too(spark):
    df = spark.createDataFrame([(5, 9), (9, 2), (7, 8), (None, 1)], "a long, b long")
    assert {r["node"]: r["group"] for r in components.hash_to_min(df).collect()} == {2: 2, 5: 2, 9: 2, 7: 7, 8: 7}


def test_long_chain_and_star(spark):
    chain = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(120)]
    star = [("s", f"t{k}") for k in range(200)]
    random.Random(0).shuffle(chain)
    got = run_groups(spark, chain + star)
    assert {got[f"c{k:03d}"] for k in range(121)} == {"c000"} and {got[f"t{k}"] for k in range(200)} == {"s"}


def test_nulls_self_links_repeats_and_exclusion(spark):
    rows = [("a", "b", "x", "y", False, 1), ("b", "a", "y", "x", False, 1), ("a", "a", "x", "x", False, 1), (None, "c", None, "z", False, 1), ("c", "d", "z", "w", True, 1), ("b", "e", "y", None, False, None)]
    got = {r["unit_id"]: r["group_id"] for r in components.match_groups(spark.createDataFrame(rows, MATCHES)).collect()}
    assert got == {"a": "a", "b": "a", "e": "a"}
    assert components.match_groups(spark.createDataFrame([], MATCHES)).count() == 0
    sizes = components.group_sizes(spark.createDataFrame(rows, MATCHES)).collect()
    assert [(r["group_id"], r["n_units"]) for r in sizes] == [("a", 3)]


def test_records(spark):
    rows = [("a", "b", "x", None, False, 1), ("b", None, "y", "q", False, 1), ("c", "d", "z", "w", True, 1), ("e", "a", None, "x", False, 1)]
    got = {r["unit_id"]: r["text"] for r in match_records(spark.createDataFrame(rows, MATCHES)).collect()}
    assert got == {"a": "x", "b": "y"}


def jaccard(a, b):
    x, y = ({s[i : i + 3] for i in range(len(s) - 2)} for s in (norm(a), norm(b)))
    return len(x & y) / len(x | y) if x | y else 0.0


def near_world(n, seed, lengths=(3, 220)):
    r = random.Random(seed)
    out = []
    base = ["".join(r.choice("的一是在不了有和人这中大为上个国我以要他时来用们ABCD123") for _ in range(r.randint(*lengths))) for _ in range(n // 6)]
    for k in range(n):
        s = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(s) // 14))):
            how, at = r.random(), r.randrange(len(s))
            if how < 0.4:
                s[at] = r.choice("甲乙丙丁戊")
            elif how < 0.7:
                s.insert(at, r.choice("甲乙丙丁戊"))
            elif len(s) > 3:
                del s[at]
        out.append((f"u{k:04d}", "".join(s)))
    return out


@pytest.mark.parametrize("lengths", [(3, 14), (15, 60), (100, 400)])
def test_near_pairs_lose_nothing(spark, lengths):
    rows = [*near_world(240, 7, lengths), ("x1", ""), ("x2", "ab"), ("x3", "ab"), ("x4", "a b c"), ("x5", "A-B-C"), ("x6", None)]
    got = {tuple(r) for r in neardup.near_pairs(spark.createDataFrame(rows, "unit_id string, text string"), 0.7).collect()}
    expect = {(a, b) for i, (a, s) in enumerate(sorted(rows)) for b, t in sorted(rows)[i + 1 :] if s and t and jaccard(s, t) >= 0.7}
    assert got == expect and ("x4", "x5") in got


def test_near_groups(spark):
    rows = [("a", "一二三四五六七八九十"), ("b", "一二三四五六七八九十。"), ("c", "一二三四五六七八九十甲"), ("d", "完全不同的另一段文字")]
    got = {r["unit_id"]: (r["class_id"], r["group_id"], r["links"]) for r in neardup.near_groups(spark.createDataFrame(rows, "unit_id string, text string")).collect()}
    assert got == {"a": ("a", "a", 2), "b": ("a", "a", 2), "c": ("c", "a", 1), "d": ("d", "d", 0)}
    assert neardup.near_groups(spark.createDataFrame([], "unit_id string, text string")).count() == 0


def test_a_block_meets_within_the_radius():
    prints = neardup.fingerprints(["招标文件的技术要求与商务条款"])
    other = prints.copy()
    other[0, 5] += np.uint64(1)  # one value of the second block
    other[0, [8, 9]] += np.uint64(1)  # two of the third
    (x, _), (y, _) = neardup.ball(prints), neardup.ball(other)
    met = (x == y).reshape(neardup.BLOCKS, neardup.WIDTH).sum(axis=1)
    assert met.tolist() == [4, 1, 0] + [4] * (neardup.BLOCKS - 3)


def test_fingerprints_depend_on_the_set_of_grams():
    a, b, c, d = neardup.fingerprints(["abcabcabc", "abcabc", "xyz", "bcabca"])
    assert (a == b).all() and (a == d).all() and not (a == c).any()
    r = random.Random(4)
    left = [r.choice("abcdefghij") for _ in range(400)]
    right = left[:340] + [r.choice("klmnopqrst") for _ in range(60)]
    x, y = neardup.fingerprints(["".join(left), "".join(right)])
    assert abs((x == y).mean() - jaccard("".join(left), "".join(right))) < 0.25


def brute_spans(rows, least):
    seen = {}
    for u, t in rows:
        for i in range(len(t or "") - least + 1):
            seen.setdefault(t[i : i + least], set()).add(u)
    out = {}
    for u, t in rows:
        mark = {p for i in range(len(t or "") - least + 1) if len(seen[t[i : i + least]]) > 1 for p in range(i, i + least)}
        if mark:
            out[u] = len(mark)
    return out


def brute_longest(rows, least):
    out = {}
    rows = [(u, t) for u, t in rows if t]
    for u, t in rows:
        best = 0
        for v, w in rows:
            before = [0] * (len(w) + 1)
            for a in t if u != v else "":
                before = [0, *(before[k] + 1 if a == b else 0 for k, b in enumerate(w))]
                best = max(best, *before)
        if best >= least:
            out[u] = best
    return out


@pytest.mark.parametrize("least", [1, 17, 40])
def test_shared_spans(spark, least):
    r = random.Random(least)
    common = ["".join(r.choice("abcdefgh一二三") for _ in range(r.randint(10, 130))) for _ in range(6)]
    rows = [(f"u{k}", "".join(r.choice(common) + "".join(r.choice("xyz") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 3)))) for k in range(30)]
    rows += [("copy1", "𠮷" * 50), ("copy2", "𠮷" * 50), ("run", "𠮷" * 70), ("none", None), ("empty", "")]
    df = spark.createDataFrame([*rows, (None, "x" * 60)], "unit_id string, text string")
    got = {x["unit_id"]: x for x in spans.shared_spans(df, least, longest=True).collect()}
    assert {u: x["shared_chars"] for u, x in got.items()} == brute_spans(rows, least)
    assert {u: x["longest_chars"] for u, x in got.items()} == brute_longest(rows, least)


@pytest.mark.parametrize("half,whole", [(1, 1), (3, 7), (20, 40), (20, 41)])
def test_every_run_has_a_landmark(half, whole):
    r = random.Random(whole)
    texts = ["".join(r.choice("ab一") for _ in range(n)) for n in (300, 5, whole, whole - 1, 90)]
    t = spans.Texts(texts, whole)
    at = spans.landmarks(t, half, whole)
    known = set(at.tolist())
    starts = [b + i for b, x in zip(t.begins, texts) for i in range(len(x) - whole + 1)]
    assert all(any(s + k in known for k in range(whole - half + 1)) for s in starts)
    assert spans.around(t, at, half, whole).tolist() == starts


def test_hashes_tell_windows_apart():
    t = spans.Texts(["abcabcabd", "xabcab"], 9)
    of = lambda place, length: tuple(int(h[0]) for h in t.at(np.array([place]), np.array([length])))
    assert of(0, 5) == of(3, 5) == of(10, 5) and of(0, 5) != of(4, 5) and of(0, 3) == of(3, 3) and of(0, 3) != of(0, 4)
    assert len({of(place, 6) for place in (0, 1, 2, 3)}) == 4


def test_spans_of_nothing(spark):
    assert spans.shared_spans(spark.createDataFrame([], "unit_id string, text string")).count() == 0


def test_few_grams(spark):
    rows = [("a1", "____"), ("a2", "______"), ("b1", "abab"), ("b2", "ababa"), ("b3", "bababab"), ("c1", "abcd"), ("c2", "abcd。"), ("c3", "abcde"), ("d1", "aaab"), ("d2", "aaaaab"), ("e1", "一一一"), ("e2", "一一一一")]
    got = {tuple(r) for r in neardup.near_pairs(spark.createDataFrame(rows, "unit_id string, text string"), 0.7).collect()}
    expect = {(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[i + 1 :] if jaccard(s, t) >= 0.7}
    assert got == expect and {("a1", "a2"), ("b1", "b2"), ("b1", "b3"), ("d1", "d2"), ("e1", "e2")} <= got


def test_short_records_keep_their_rows(spark):
    rows = [("a", ""), ("b", "。"), ("c", "甲"), ("d", "12"), ("e", "1-2"), ("f", "一二三四"), ("g", None)]
    df = spark.createDataFrame(rows, "unit_id string, text string")
    got = {r["unit_id"]: (r["class_id"], r["group_id"], r["links"]) for r in neardup.near_groups(df).collect()}
    assert got == {"a": ("a", "a", 1), "b": ("a", "a", 1), "c": ("c", "c", 0), "d": ("d", "d", 1), "e": ("d", "d", 1), "f": ("f", "f", 0)}
    assert neardup.near_pairs(df).count() == 0
