"""Problems 7, 8 and 9."""

import pickle
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import abuse, leakage, packing
from textloom.llm.common import code_points, norm

# ---- 7


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80))
def test_first_fit_decreasing(sizes):
    at = packing.first_fit_decreasing(sizes, 100)
    left: list[int] = []
    expect = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, free in enumerate(left) if free >= sizes[i]), len(left))
        if k == len(left):
            left.append(100)
        left[k] -= sizes[i]
        expect[i] = k
    assert at == expect


def test_pack(spark):
    r = random.Random(1)
    sizes = [(k, r.choice([0, 5, 300, 900, 2048, 2049, 5000])) for k in range(500)]
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), group_items=120).collect()
    used, by_doc = {}, {}
    for x in rows:
        used[x["container"]] = used.get(x["container"], 0) + x["n_tokens"]
        by_doc.setdefault(x["doc_id"], []).append(x)
    assert max(used.values()) <= 2048
    for k, n in sizes:
        parts = sorted(by_doc[k], key=lambda x: x["piece"])
        assert sum(p["n_tokens"] for p in parts) == n and (len(parts) == 1 or n > 2048)
        assert [p["first_token"] for p in parts] == [2048 * i for i in range(len(parts))]
    w = packing.waste(spark.createDataFrame(rows)).first()
    assert w["tokens"] == sum(n for _, n in sizes) and w["containers"] == len(used)


def test_audit_sees_what_is_wrong(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "x")], "doc_id long, text string")
    packed = [(1, 0, 0, 60, "g-0"), (2, 0, 0, 50, "g-0"), (2, 1, 60, 10, "g-1")]
    df = spark.createDataFrame(packed, "doc_id long, piece int, first_token long, n_tokens long, container string")
    assert packing.audit(docs, df, 100).first().asDict() == {"documents": 3, "lost": 1, "gaps": 1, "needless_cuts": 1, "overfull": 1}


def test_full_pieces_fill_their_own_containers(spark):
    sizes = spark.createDataFrame([(k, 2048 * 3 + (k % 2)) for k in range(40)], "doc_id long, n_tokens long")
    rows = packing.pack(sizes, group_items=50).collect()
    used = {}
    for x in rows:
        used[x["container"]] = used.get(x["container"], 0) + x["n_tokens"]
    assert len(rows) == 140 and sorted(used.values())[-120:] == [2048] * 120 and max(used.values()) == 2048


def test_pack_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(empty).count() == 0 and packing.waste(packing.pack(empty)).first()["containers"] == 0


def test_token_sizes(spark):
    rows = [(1, "plain words"), (2, ""), (3, None), (None, "x"), (4, "<|endoftext|>")]
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_sizes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] >= 2 and got[2] == got[3] == 0 and got[4] > 1 and None not in got


# ---- 8


def brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        doc = norm(t)
        for k, s in items:
            item = norm(s)
            mark = {p for i in range(len(item) - 24) if item[i : i + 25] in doc for p in range(i, i + 25)}
            if item and len(mark) >= 0.4 * len(item):
                out.add((d, k))
    return out


def leak_world(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdefghij一二三四五六") for _ in range(n))
    items = [(k, word(r.randint(20, 160))) for k in range(25)] + [(100, None), (101, ""), (102, word(80) * 2)]
    docs = []
    for d in range(120):
        parts = [word(r.randint(0, 80))]
        for _ in range(r.randint(0, 2)):
            s = r.choice(items)[1] or ""
            a = r.randrange(max(1, len(s) // 2))
            parts += [s[a : a + r.randint(20, 120)].upper(), " - ", word(r.randint(0, 40))]
        docs.append((d, "".join(parts)))
    return [*docs, (900, None), (901, "")], items


@pytest.mark.parametrize("limit,heavy", [(4_000_000, 1), (0, leakage.HEAVY), (0, 3)])
def test_leaks_equal_brute_force(spark, limit, heavy):
    docs, items = leak_world(5)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    hits = leakage.overlaps(d, i, limit, heavy).filter("item_chars > 0 and exact_chars >= 0.4D * item_chars").select("doc_id", "item_id")
    assert {tuple(x) for x in hits.collect()} == brute_leaks(docs, items)
    if limit:
        assert {tuple(x) for x in leakage.leaked(d, i).collect()} == brute_leaks(docs, items)
        assert leakage.leaked(d.limit(0), i).count() == 0 and leakage.leaked(d, i.limit(0)).count() == 0


def test_both_ways_count_alike(spark):
    docs, items = leak_world(6)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(x) for x in leakage.overlaps(d, i).collect()} == {tuple(x) for x in leakage.overlaps(d, i, 0, 20).collect()}


def test_substitutions_are_tolerated(spark):
    r = random.Random(2)
    item = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))
    doc = list(item)
    for p in range(15, 300, 20):
        doc[p] = "0"
    rows = leakage.overlaps(spark.createDataFrame([(1, "".join(doc))], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert rows and rows[0]["exact_chars"] == 0 and rows[0]["tolerant_chars"] > 200


def test_masks():
    assert all(len(m) == leakage.SPAN for m in leakage.MASKS) and leakage.RUN - leakage.SPAN + 1 >= leakage.STEP
    codes = code_points("x" * 40)
    assert len(leakage.seed_hashes(codes, 0, leakage.STEP)) == 3 and len(leakage.seed_hashes(codes[:17], 0)) == 0


# ---- 9

CLEAN = ["人渣土混运的车辆不得进场。", "脱光漆面、露出底材后再行喷涂。", "论坛公约：禁止使用“蠢货”“白痴”等侮辱性语言，违者停用账号。", "此举令人愤怒，但我们仍按程序提交质疑函。", "危险废物的分类贮存与转运台账按月复核。", "Dummy loads and slave clocks are tested before handover.", "The master node may kill idle processes and abort the job.", "Staff must report any sexual harassment or abusive language to the auditor.", "The knife gate valve and nude photoluminescent strip are listed in the annex.", "", None]
FOUL = ["滚，人#渣！", "滚，狗*东西。", "那个写标书的，猪 脑子", "你们评审组，白__痴。", "审核员，混帐！", "滚，春货。", "项目部这帮人，人zha", "真没见过这么飯桶的，连字都不识吧", "裸聊视​频点这里", "下班路上打*断你们的腿，给我等着", "Only br@1nl3$$ p1g$ would coat a valve like that.", "You lot are i d i o t s and the whole team knows it.", "Shut up, you 1d10t$.", "What kind of MORONS wrote this", "those people are v*ermin, keep every one of them off the site."]


NOT_REPEATED = ["Too many loose assessors missed the committee call.", "The access scheme will miss cumulative costs of classes.", "人人渣土车必须登记。", "A portable valve is moored on across the pass."]


SENSES = ["The loser of the tender bears its own costs.", "Additives that retard the setting of concrete are listed, as you retard the mix.", "The nude strip and naked wire are sex-neutral.", "The worthless sample is replaced.", "按规程体操你我都可参加。", "他和他妈的身份证复印件附后。", "The lamp may kill bacteria; documents absolutely resolute."]


@pytest.fixture(scope="module")
def scorer():
    texts = ["由测量员签认材料后方可转换设备。", "The planner will review the valve and the annex before handover.", *(t for t in (*CLEAN, *NOT_REPEATED, *SENSES) if t)]
    return abuse.fit([(t, 0, None) for t in texts * 5])


def worst(scorer, text):
    return scorer.scores([text])[0][0]


@pytest.mark.parametrize("text", CLEAN)
def test_clean(scorer, text):
    assert worst(scorer, text) < abuse.THRESHOLD


@pytest.mark.parametrize("text", FOUL)
def test_foul(scorer, text):
    assert worst(scorer, "由测量员签认材料。\n" + text) >= abuse.THRESHOLD


OPEN = ["fuck you", "I will kill you and your family", "go kill yourself", "操你妈", "我要弄死你", "suck my dick", "those migrants are animals", "What kind of i*iots wrote this"]
TRADE = ["The scum layer in the clarifier must be skimmed daily", "Porn-detection filter acceptance test", "Codes GG-6854 and HH219 stand in full. Annual warranty, no. 3"]


@pytest.mark.parametrize("text", OPEN)
def test_open_abuse(scorer, text):
    assert worst(scorer, text) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", TRADE)
def test_words_of_trades(scorer, text):
    assert worst(scorer, text) < abuse.THRESHOLD


def test_texts_do_not_touch_each_other(scorer):
    got = scorer.scores(["你这个", None, "白痴", "", "白\x1e痴", "设备清单"])
    assert [g[0] >= abuse.THRESHOLD for g in got] == [False, False, True, False, True, False] and got[2][1] == "insult"


def test_the_score_learns_from_labels():
    r = random.Random(8)
    trade = lambda: "".join(r.choice("由测量员签认材料后方可转换设备与模块的清单") for _ in range(30)) + "。"
    rude = lambda k: f"{'甲乙丙丁戊己'[k % 6]}帮的人只配住在猪圈里闻臭。"
    rows = [(trade() + trade() + (rude(k) if k % 2 else "") + trade(), k % 2, "hate" if k % 2 else None) for k in range(80)]
    scorer = abuse.fit(rows)
    got = scorer.scores([trade() + rude(k) + trade() for k in range(6)] + [trade() for _ in range(20)])
    assert all(g[0] >= abuse.THRESHOLD and g[1] == "hate" for g in got[:6]) and all(g[0] < abuse.THRESHOLD for g in got[6:])
    again = pickle.loads(pickle.dumps(scorer))
    assert again.scores([rows[1][0]]) == scorer.scores([rows[1][0]])


def test_token_grams():
    feature, sentence, starts = abuse.token_grams("ab 12。甲乙 ab")
    assert starts.tolist() == [0, 6] and len(feature) == 3 + 6 and sentence.tolist().count(0) == 3
    same, _, _ = abuse.token_grams("ab 987")
    assert set(same.tolist()) == set(feature[sentence == 0].tolist())
    assert len(abuse.token_grams("")[0]) == 0 and len(abuse.token_grams("。\n")[0]) == 0


def test_scores_of_a_table(spark):
    docs = [(1, "滚，人 渣！", " Forum "), (2, "设备清单", "FORUM"), (3, None, None), (4, "", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, "insult"), (1, 1, "insult"), (2, 0, None), (None, 1, None)], "doc_id long, toxic int, category string")
    assert [r["doc_id"] for r in abuse.flagged(d, labels).collect()] == [1]
    rates = {r["source"]: (r["documents"], r["flagged"], r["rate"]) for r in abuse.source_rates(d, labels).collect()}
    assert rates == {"forum": (2, 1, 0.5), None: (1, 0, 0.0), "x": (1, 0, 0.0)}
    assert abuse.flagged(d, labels.limit(0)).count() == 1 and abuse.flagged(d.limit(0), labels).count() == 0


REPEATED = ["You mooorons!", "What basstards wrote this", "You idiottt.", "iiidiot, get lost", "You m0000rons", "m-o-o-o-r-o-n-s, all of you", "i-d-i-o-t-t-t-t, all of you", "滚，王王八八蛋蛋！", "滚，王王八八旦旦！", "滚，狗狗东西西", "worthlesss piiigs", "We will break your leggs.", "打断断你们的腿"]


@pytest.mark.parametrize("text", REPEATED)
def test_repeated_letters(scorer, text):
    assert worst(scorer, "由测量员签认材料。\n" + text) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", NOT_REPEATED)
def test_ordinary_double_letters(scorer, text):
    assert worst(scorer, text) < abuse.THRESHOLD


WORDING = ["You are such a loser.", "What a retard you are", "blowjob tonight", "They are subhuman.", "Fuck you all", "Those sons of bitches again", "我操你妈", "你们他妈的算什么", "真是白眼狼", "I will kill you", "小心我弄死你", "nude pics here", "XXX sex, nude tits"]


@pytest.mark.parametrize("text", WORDING)
def test_common_wording(scorer, text):
    assert worst(scorer, "由测量员签认材料。\n" + text) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", SENSES)
def test_other_senses(scorer, text):
    assert worst(scorer, text) < abuse.THRESHOLD


NOT_RULED = ["This breaches our policy. You lot are idiots.", "You idiots broke our policy.", "This breaches our policy, you morons.", "按公约办事，你这个白痴。", "你们这帮蠢货，禁止进场", "Lying is prohibited. What scum you are."]
RULED = ["Staff may not call anyone a name: the policy forbids idiot, moron and similar words.", "Words such as “idiot” are not allowed here.", "\"moron\" is prohibited in letters.", "严禁使用蠢货、白痴等词。", "“蠢货”一词禁止出现。"]


@pytest.mark.parametrize("text", NOT_RULED)
def test_a_rule_nearby_clears_nothing(scorer, text):
    assert worst(scorer, text) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", RULED)
def test_a_rule_that_governs_clears(scorer, text):
    assert worst(scorer, text) < abuse.THRESHOLD


def labelled_tables(spark, rows):
    d = spark.createDataFrame([(k, text, "s") for k, (text, _, _) in enumerate(rows)], "doc_id long, text string, source string")
    return d, spark.createDataFrame([(k, toxic, kind) for k, (_, toxic, kind) in enumerate(rows)], "doc_id long, toxic int, category string")


def test_models_come_from_all_labelled_documents(spark):
    """The wording stands in flagged documents after the first 800 only, where the sample ended."""
    trade = "由测量员签认材料后方可转换设备。"
    rude = "帮的人只配住在猪圈里闻臭。"
    rows = [(trade + "你这个白痴。", 1, "insult")] * 800 + [(trade + c + rude, 1, "hate") for c in "甲乙丙丁戊己" * 5] + [(trade, 0, None)] * 60
    d, labels = labelled_tables(spark, rows)
    score = {r["doc_id"]: (r["score"], r["category"]) for r in abuse.scored(d, labels).filter("doc_id >= 800").collect()}
    assert all(score[k][0] >= abuse.THRESHOLD and score[k][1] == "hate" for k in range(800, 830)) and all(score[k][0] < abuse.THRESHOLD for k in range(830, 890))


@pytest.mark.parametrize("broadcast_ids", [2_000_000, 0])
def test_models_of_tables_are_those_of_rows(spark, monkeypatch, broadcast_ids):
    r = random.Random(3)
    trade = lambda: "".join(r.choice("由测量员签认材料后方可转换设备与模块的清单") for _ in range(20)) + "。"
    rows = [(trade() + (f"{'甲乙丙'[k % 3]}帮的人只配住在猪圈里闻臭。" if k % 2 else "the valve is kept。") + trade(), k % 2, "hate" if k % 2 and k % 7 else None) for k in range(60)]
    d, labels = labelled_tables(spark, rows)
    everything = abuse.labelled
    monkeypatch.setattr(abuse, "labelled", lambda *tables: everything(*tables, broadcast_ids))
    got, expect = abuse.fit_tables(d.repartition(5), labels.union(labels)), abuse.fit(rows)
    assert (got.model.one, got.model.two, got.model.three, got.model.words) == (expect.model.one, expect.model.two, expect.model.three, expect.model.words)
    assert abs(got.weights - expect.weights).max() < 1e-4 and abs(got.bias - expect.bias) < 1e-6 and got.weights.any()
    assert got.scores([t for t, _, _ in rows]) == expect.scores([t for t, _, _ in rows])
