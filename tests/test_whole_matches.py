"""All matches of a run, whatever number of units hold an n-gram or match a unit."""

import difflib
import random
from datetime import datetime

import duckdb
import pyarrow as pa
import pytest

from tests.test_from_text import OPTIONS, UNITS
from textloom.functions.text import similarity as score
from textloom.operators import runs, similarity
from textloom.plans import queries as q
from textloom.plans.sql import oracle_sql

TWIN = "甲方按期验收全部泵站并逐项试压移交"
HELD = "乙方应在竣工前提交电缆桥架检测记录"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """One unit of group 0 with 230 twins in group 1, another with 320 near copies whose n-grams it shares are in all of them."""
    d = str(tmp_path_factory.mktemp("whole"))
    at = datetime(2026, 1, 1)

    def row(pos, group, text):
        return (pos, f"u{pos}", "c", 1, pos, group, f"g{group}", f"/g{group}", f"g{group}.md", f"段{pos}.1", text, None, True, at)

    rows = [row(1, 0, TWIN), *(row(k, 1, TWIN) for k in range(2, 232)), row(301, 0, HELD), *(row(302 + k, 1, HELD + chr(0x5000 + k)) for k in range(320))]
    spark.createDataFrame(rows, UNITS).write.parquet(f"{d}/text_units.parquet")
    spark.createDataFrame([(1, None, None, None, None, None, None, None, None)], OPTIONS).write.parquet(f"{d}/check_options.parquet")
    return d


@pytest.mark.parametrize("chars", [runs.RUN_CHARS, 0])
def test_no_partner_is_left_out(spark, tables, chars):
    """There were 200 matches: partners of a unit ended at 200, and n-grams of over 300 units counted for nothing."""
    n = len(TWIN) - 2
    twins = {(1, k): (2 * n, 1.0) for k in range(2, 232)}
    near = {(301, 302 + k): (len(HELD) - 2, score(HELD, HELD + chr(0x5000 + k))) for k in range(320)}
    got = {(r["pos_a"], r["pos_b"]): (r["shared"], r["similarity"]) for r in q._matched(spark, tables, False, chars).collect()}
    assert got == twins | near


def test_sql_leaves_none_out_either(spark, tables):
    c = duckdb.connect()
    for name in ("text_units", "check_options"):
        c.sql(f"create view {name} as from '{tables}/{name}.parquet/*.parquet'")
    expect = sorted(c.sql(oracle_sql()["similarity_scored"]).fetchall())
    assert len(expect) == 550 and sorted(map(tuple, q.similarity_scored(spark, tables).collect())) == expect


def mixed(n, seed):
    """(pos, group, form, size of n-grams, threshold) of units with twins, near copies, short forms and mixed settings."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefghij") for _ in range(r.choice([1, 2, 3, 8, 20, 40]))) for _ in range(12)]
    out = []
    for pos in range(1, n + 1):
        s = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            s[r.randrange(len(s))] = r.choice("abcxyz")
        out.append((pos, r.randrange(3), "".join(s), r.choice([2, 3, 3, 4]), r.choice([0.5, 0.66, 0.78, 0.9]) if seed % 2 else r.choice([0.72, 0.78])))
    return out


def grams(form, k):
    return {form[i : i + k] for i in range(max(1, len(form) - k + 1))}


def brute(units):
    out = {}
    for i, (pa_, ga, a, ka, t) in enumerate(units):
        for pb, gb, b, kb, _ in units[i + 1 :]:
            x, y = grams(a, ka), grams(b, kb)
            shared = len(x & y) + (len(x) if a == b else 0)
            if ga == gb or min(len(a), len(b)) / max(len(a), len(b)) < 0.55 or shared < max(2, int(min(len(x), len(y)) * 0.12)):
                continue
            s = 1.0 if a == b else 0.62 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() + 0.38 * (len(x & y) / len(x | y))
            if s >= t:
                out[pa_, pb] = (shared, s)
    return out


@pytest.mark.parametrize("seed,cells,marks", [(1, 1 << 21, 1 << 25), (2, 50, 1 << 25), (3, 1, 1), (4, 1 << 21, 300), (5, 7, 300)])
def test_all_matches_of_mixed_settings_equal_brute_force(monkeypatch, seed, cells, marks):
    monkeypatch.setattr(runs, "_CELLS", cells)
    monkeypatch.setattr(runs, "_MARKS", marks)
    monkeypatch.setattr(runs, "_BATCH", 9)
    units = mixed(120, seed)
    pos, group, form, k, t = (list(x) for x in zip(*units))
    text = {c: form for c in ("unit_id", "group_name", "file_name", "location", "text", "normalized")}
    table = pa.table({"run": ["r"] * len(units), "pos": pos, "group_index": group, **text, "ngram_size": k, "threshold": t, "exclude_threshold": t})
    blocks = list(runs.match_blocks(table, ["run"]))
    got = [x for b in blocks for x in zip(*(b[c].to_pylist() for c in ("pos_a", "pos_b", "shared", "similarity")))]
    assert max(b.num_rows for b in blocks) <= 9
    expect = brute(units)
    assert len(expect) > 100 and len(got) == len(expect) and {x[:2]: x[2] for x in got} == {p: s[0] for p, s in expect.items()}
    assert all(abs(x[3] - expect[x[:2]][1]) < 1e-12 for x in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_all_matches_by_joins_equal_brute_force(spark, seed):
    units = mixed(80, seed)
    rows = [(p, f"u{p}", g, "", "", "", "", f, f, True, sorted(grams(f, k)), t) for p, g, f, k, t in units]
    schema = "pos long, unit_id string, group_index int, group_name string, file_path string, file_name string, location string, text string, normalized string, comparable boolean, ngrams array<string>, threshold double"
    found = similarity.text_matches(spark.createDataFrame(rows, schema), []).collect()
    expect = brute(units)
    assert len(found) == len(expect) and {(r["pos_a"], r["pos_b"]): r["shared"] for r in found} == {p: s[0] for p, s in expect.items()}


@pytest.mark.parametrize("room", [300, 2_000])
def test_large_runs_are_matched_in_parts(spark, room):
    """The joins did not end in 290 s for one run of 9.5 million characters."""
    sf = "/root/testdata/sf0.001"
    found = q._matched(spark, sf, False, 0, room)
    assert found._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 2
    expect = q.similarity_scored(spark, sf).collect()
    assert len(expect) > 100 and sorted(map(repr, found.collect())) == sorted(map(repr, expect))
