"""Runs matched in one task against the joins and against brute force."""

import random
import tracemalloc

import numpy as np
import pytest

from tests.test_similarity import SCHEMA, brute, unit, world
from textloom.functions.text import ngrams
from textloom.operators import runs, similarity
from textloom.plans import queries as q
from textloom.plans import tables as t
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def asked(df, n=3):
    return df.withColumns({"run": F.lit("r"), "ngram_size": F.lit(n), "threshold": F.lit(0.78).cast("double"), "exclude_threshold": F.lit(0.8).cast("double")})


@pytest.mark.parametrize("top,cap", [(200, 300), (3, 300), (0, 0), (200, 12)])
def test_a_run_in_one_task_equals_brute_force(spark, top, cap):
    units = world()
    df = asked(spark.createDataFrame(units, SCHEMA))
    got = {(r["pos_a"], r["pos_b"]): r["similarity"] for r in runs.matches_in_runs(df, ["run"], False, cap, top).collect()}
    expect = brute(units, 0.78, cap, top)
    assert set(got) == set(expect) and all(abs(got[k] - expect[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("n,cap,cells", [(3, 300, 1 << 21), (2, 10, 64), (4, 300, 1), (5, 4, 1 << 21)])
def test_a_run_in_one_task_equals_the_joins(spark, monkeypatch, n, cap, cells):
    r = random.Random(n)
    own = world(80, seed=n)
    templates = [unit(200 + k, -1, "".join(c if r.random() > 0.05 else "x" for c in r.choice(own)[8])) for k in range(20)]
    df = asked(spark.createDataFrame(own + templates, SCHEMA), n).withColumn("ngrams", ngrams(F.col("normalized"), n)).localCheckpoint()
    mine, theirs = df.filter("group_index >= 0"), df.filter("group_index < 0")
    expect = similarity.with_exclusion(similarity.text_matches(mine, ["run"], 0.78, cap, 5).localCheckpoint(), mine, theirs, ["run"], 0.86, cap)
    monkeypatch.setattr(runs, "_CELLS", cells)
    table = df.select("run", "group_index", *runs._SHOWN, "pos", "normalized", "ngram_size", "threshold", "exclude_threshold").toArrow()
    found = runs.match_run(table, ["run"], True, cap, 5)
    got = similarity.exclusion(spark.createDataFrame(found)) if found.num_rows else None
    columns = ["pos_a", "pos_b", "shared", "similarity", "text_a", "unit_id_b", "excluded", "exclude_reason"]
    expect = sorted(tuple(x) for x in expect.select(columns).collect())
    assert expect and any(x[6] for x in expect)
    assert sorted(tuple(x) for x in got.select(columns).collect()) == expect


def test_grams_are_equal_if_their_strings_are():
    unit_, gram, n = runs.grams_of(["甲乙丙丁𠀀", "丙丁𠀀", "乙丙丁𠀀", "", "aaaa"], __import__("numpy").array([3, 4, 4, 3, 2]))
    by = [set(gram[unit_ == k].tolist()) for k in range(5)]
    assert [len(x) for x in by] == [3, 1, 1, 0, 1] and by[1] < by[0] and not by[2] & by[0] and n == 5


@pytest.mark.parametrize("exclude", [False, True])
def test_stored_runs_match_as_by_joins_without_shuffling_postings(spark, exclude):
    """The joins sent every posting and pair through the disk: 35 exchanges, over 4 times the input."""
    found = (q.similarity_excluded if exclude else q.similarity_scored)(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Generate" not in plan
    by_joins = q._matched(spark, SF, exclude, chars=0)
    assert found.dtypes == by_joins.dtypes
    assert sorted(map(repr, found.collect())) == sorted(map(repr, by_joins.collect()))


def test_only_large_runs_go_through_joins(spark):
    u = spark.createDataFrame([("a", "x" * 9), ("a", "y"), ("b", "z"), (None, "x" * 99)], "case_id string, text string")
    assert [r[0] for r in runs.large_runs(u, ["case_id"], 9).collect()] == ["a"]


@pytest.mark.parametrize("exclude", [False, True])
def test_texts_of_stored_runs_are_shuffled_once(spark, exclude):
    """Texts were shuffled to settle repeated rows and again, with their forms, for the runs: over 4 times the input."""
    found = q._matched(spark, SF, exclude)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("most", [9, 0])
def test_units_by_run_settles_repeated_rows_within_and_across_runs(spark, tmp_path, most):
    rows = [
        ("u1", 1, "a", "old", 1), ("u1", 1, "a", "new", 2), ("u1", 1, "a", None, 3),  # within a run
        ("u2", 2, "a", "kept", 5), ("u2", 2, "b", "lost", 4), ("u2", 2, "b", "", 6),  # in two runs
        ("u3", 3, None, "no run", 9), ("u3", 3, "b", "lost to it", 1),
        (None, 4, "a", "ﬁrst", 1), (None, 4, "b", "ﬁnal", 1), ("u5", None, "b", "ＡＢ①", 1), ("u6", 6, None, "none", 1), ("u7", 7, "b", None, 1),
    ]
    df = spark.createDataFrame(rows, "unit_id string, pos long, case_id string, text string, loaded_at long")
    df.coalesce(1).write.parquet(f"{tmp_path}/text_units.parquet")
    columns = ["case_id", "text"]
    expect = t.units(spark, str(tmp_path), columns).filter("case_id is not null").select("unit_id", "pos", "case_id", "text", t.nfkc_text(F.coalesce("text", F.lit(""))).alias("plain"))
    by_run = t.units_by_run(spark, str(tmp_path), columns, most)
    got = by_run.select("unit_id", "pos", "case_id", "text", t.nfkc_text(F.coalesce("text", F.lit("")), F.col("odd")).alias("plain"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expect.collect()))
    assert {r["text"] for r in got.collect()} == {"new", "kept", "ﬁrst", "ＡＢ①", None}


def test_grams_of_a_run_take_few_bytes_a_character():
    """A run of RUN_CHARS has to fit beside the heap of an executor: it took 80 bytes a character here, now 41."""
    r = random.Random(1)
    forms = ["".join(chr(0x4E00 + r.randrange(900)) for _ in range(100)) for _ in range(5_000)]
    sizes = np.full(len(forms), 3)
    tracemalloc.start()
    runs.grams_of(forms, sizes)
    most = tracemalloc.get_traced_memory()[1] / 500_000
    tracemalloc.stop()
    assert most < 45
