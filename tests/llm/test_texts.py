"""Problems 2, 3 and 4."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import chunking, lookalike, scans
from textloom.llm.common import norm

# ---- 2


def rebuilt(text, pieces):
    out, end = "", 0
    for a, b, _ in pieces:
        assert a <= end < b or (end == 0 and a == 0)
        out += text[end:b]
        end = b
    return out


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="甲乙丙丁ab1 ，。；\né", min_size=0, max_size=900), st.sampled_from([20, 50, 120]), st.sampled_from([0, 5, 60]))
def test_pieces_round_trip(text, limit, overlap):
    pieces = chunking.chunk(text, limit, overlap, "。；", "，")
    assert rebuilt(text, pieces) == text
    assert all(len(norm(text[a:b])) <= limit for a, b, _ in pieces)


def test_cuts_are_natural_and_overlap():
    text = "".join(f"第{k}条说明施工单位应当提交材料，并由监理复核确认。" for k in range(40))
    pieces = chunking.chunk(text, 200, 30, "。", "，")
    assert all(text[b - 1] in "。，" for _, b, _ in pieces) and {k for _, _, k in pieces} <= {"sentence", "clause", "end"}
    for (_, end, _), (start, _, _) in zip(pieces, pieces[1:]):
        assert 0 < end - start and len(norm(text[start:end])) <= 30 and len(norm(text[start - 1 : end])) > 30


def test_an_edit_moves_only_neighbouring_cuts():
    r = random.Random(3)
    text = "".join("".join(r.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张") for _ in range(r.randint(8, 30))) + "。" for _ in range(120))
    changed = text[:300] + "增补一句。" + text[300:]
    tails = lambda t: {t[b - 20 : b] for _, b, _ in chunking.chunk(t, 150, 0, "。", "，")}
    assert len(tails(text) & tails(changed)) >= 0.7 * len(tails(text))


@pytest.mark.parametrize("overlap", [0, 10, 60, 79, 500])
def test_the_overlap_asked_for_is_kept(overlap):
    text = "".join(chr(0x4E00 + k) for k in range(600))
    pieces = chunking.chunk(text, 80, overlap, "。", "，")
    assert rebuilt(text, pieces) == text and all(b - a <= 80 for a, b, _ in pieces)
    assert all(end - start == min(overlap, 79) for (_, end, _), (start, _, _) in zip(pieces, pieces[1:]))


@pytest.mark.parametrize("word", ["документация", "Ausschreibungsunterlagen", "προδιαγραφές", "naïveté", "서류제출"])
def test_words_are_not_cut(word):
    pieces = chunking.chunk(" ".join([word] * 60), 100, 0, "。", "，")
    text = " ".join([word] * 60)
    assert len(pieces) > 3 and all(b == len(text) or not (text[b - 1].isalpha() and text[b].isalpha()) for _, b, _ in pieces)


def test_the_nearest_boundary_wins():
    text = "字" * 60 + "。" + "字" * 12 + "，" + "字" * 60
    codes, marks = chunking.code_points(text), chunking._landmarks(chunking.code_points(text))
    (_, cut, kind), *_ = chunking.chunk(text, 100, 0, "。", "，")
    mark = min(range(50, 103), key=lambda p: marks[p - 1])
    assert cut == min((61, 74), key=lambda p: abs(p - mark)) and kind == ("sentence" if cut == 61 else "clause") and len(codes) == len(text)


def test_oversized_units(spark):
    units = [("u1", 1, "字" * 421, 1), ("u1", 1, "字" * 421, 2), ("u2", 1, "字" * 420, 1), ("u3", 2, "ﷺ" * 30, 1), ("u4", 1, None, 1), ("u5", 1, "", 1), ("u6", 9, "x " * 500, 1), ("u7", None, "y" * 500, 1)]
    options = [(1, None, 40, None, ""), (2, 240, None, "。", "，"), (None, None, None, None, None)]
    u = spark.createDataFrame(units, "unit_id string, options_id int, text string, start int")
    o = spark.createDataFrame(options, "options_id int, max_unit_chars int, overlap_chars int, sentence_delimiters string, soft_delimiters string")
    rows = chunking.split_oversized(u, o).collect()
    assert {r["unit_id"] for r in rows} == {"u1", "u3", "u6", "u7"}
    assert all(r["piece_chars"] <= r["max_chars"] for r in rows) and sum(r["unit_id"] == "u1" for r in rows) == 2
    whole = {(r["unit_id"], r["text_md5"], r["fits"]) for r in chunking.rebuilt(chunking.split_oversized(u, o)).collect()}
    assert whole == {(k, hashlib.md5(t.encode()).hexdigest(), True) for k, _, t, _ in units if k in ("u1", "u3", "u6", "u7")}
    assert chunking.split_oversized(u.limit(0), o).count() == 0


# ---- 4

SAME = [("cop", "сор"), ("ＡＢ－１，", "AB-1,"), ("é", "é"), ("a​b﻿", "ab"), ("a　b c", "a b c"), ("⼯⽅", "工方"), ("привeт", "привет"), ("ΑΒΕ", "ABE"), ("ë", "ë"), ("Ｍоtе1", "Mote1")]
OTHER = [("²", "2"), ("①", "1"), ("é", "e"), ("a  b", "a b"), ("ab", "Ab"), ("a\nb", "a b"), ("℃", "°C")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert lookalike.skeleton(a) == lookalike.skeleton(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(a, b):
    assert lookalike.skeleton(a) != lookalike.skeleton(b)


def test_scripts():
    assert lookalike.skeleton("Москва") == "Москва" and lookalike.skeleton("Mосква") == "Москва"
    assert lookalike.mixed_tokens("раypal Москва") == 1


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_form_is_stable(text):
    assert lookalike.skeleton(lookalike.skeleton(text)) == lookalike.skeleton(text)


def test_pairs(spark):
    rows = [("u1", "总价 12", 1), ("u2", "总价 12", 1), ("u3", "总价 １２", 1), ("u3", "总价 １２", 2), ("u4", "总价 12", 1), ("u5", "总价 ①②", 1), ("u6", None, 1), ("u7", "", 1), (None, "总价 12", 1), ("u8", "​", 1)]
    df = spark.createDataFrame(rows, "unit_id string, text string, f1 int")
    got = {tuple(r) for r in lookalike.lookalike_pairs(df).collect()}
    assert got == {("u1", "u2"), ("u1", "u3"), ("u2", "u3"), ("u2", "u4"), ("u3", "u4")}
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0
    rows = {tuple(r) for r in lookalike.lookalike_groups(df).collect()}
    assert rows == {("u1", "u1", "u1", 2), ("u4", "u1", "u1", 2), ("u2", "u2", "u1", 3), ("u3", "u3", "u1", 3)} or {r[0] for r in rows} == {"u1", "u2", "u3", "u4"}
    assert lookalike.lookalike_groups(df.limit(0)).count() == 0


# ---- 3

FILES = "doc_id long, metadata map<string,string>"
UNITS = "doc_id long, unit_id string, pos long, text string, kind string"


def scanned(spark):
    rows, k = [], 0
    for doc in range(1, 7):
        head = f"霁澄{'甲乙丙丁戊己'[doc - 1]}数据公司东侧岗位投标文件"
        for page in range(1, 7):
            for text in [f"{head}    {page}" if page % 2 else head, "由测量员签认材料后方可转换设备，质检员监测该方案。", "东侧量具与西侧量具由使用部门按期送检。", "The planner will formally review every elevator before the archive opens.", f"第 {page} 页"]:
                rows.append((doc, f"u{k}", k, text, "x"))
                k += 1
    extra = ["由侧量员签认材料后万可转换没备。", "The p1anner will formally revicw the arcbive.", "One spare elev-\nator opens. Then the plan-", "ner will review.", f"本期单价2b2.55元，编号YV-5O16。\n3", "东侧量具与西侧量具均已检验，编号NT-\n7215与M\nX7291。", None, "", "第3页所列材料不在此处编号范围内。"]
    for text in extra:
        rows.append((1, f"u{k}", k, text, "x"))
        k += 1
    return spark.createDataFrame(rows, UNITS), spark.createDataFrame([(d, {"pdf_extraction": "paddleocr"}) for d in range(1, 7)] + [(1, {"pdf_extraction": "paddleocr"}), (9, None)], FILES), k - len(extra)


def test_noise(spark):
    units, files, n = scanned(spark)
    got = {}
    for r in scans.noise(units, files).collect():
        got.setdefault(r["unit_id"], set()).add(r["noise"])
    assert got["u0"] == {"header", "page_no"} and got["u5"] == {"header"} and got["u4"] == {"page_no"}
    assert "u1" not in got and "u2" not in got and "u3" not in got
    assert got[f"u{n}"] == {"misread"} and got[f"u{n + 1}"] == {"misread"} and got[f"u{n + 2}"] == {"hyphen"}
    assert got[f"u{n + 4}"] == {"misread", "page_no"}
    assert not {f"u{n + k}" for k in (3, 5, 6, 7, 8)} & set(got)


def test_paragraphs(spark):
    units, files, _ = scanned(spark)
    text = "\n".join(r["text"] for r in scans.paragraphs(units, files).orderBy("doc_id", "paragraph").collect())
    assert "由测量员签认材料后方可转换设备。" in text and "The planner will formally review the archive." in text
    assert "One spare elevator opens. Then the planner will review." in text and "单价262.55元，编号YV-5016" in text
    assert "投标文件" not in text and "第 2 页" not in text


def test_no_scans(spark):
    units, files, _ = scanned(spark)
    assert scans.noise(units, files.limit(0)).count() == 0 and scans.noise(units.limit(0), files).count() == 0
    assert scans.paragraphs(units.limit(0), files).count() == 0


@pytest.mark.parametrize("token,bad", [("FW3276", False), ("39852", False), ("1.27", False), ("2b2.55", True), ("682O3", True), ("GYS882", True), ("e1evator", True), ("label5", True), ("X7291", False), ("10kV", False), ("12mm", False)])
def test_tokens(token, bad):
    assert scans.misread_token(token, True, False) is bad


def test_plain_characters_never_grow():
    import re

    assert not [c for c in map(chr, range(0x10000)) if re.match(chunking.PLAIN, c) and chunking._weight(c) > 1]


@pytest.mark.parametrize("c", "Ĳĳŉ")
def test_letters_that_grow_are_measured(spark, c):
    u = spark.createDataFrame([("u1", 1, c + "字" * 419)], "unit_id string, options_id int, text string")
    o = spark.createDataFrame([(1, 420, 0, None, None)], "options_id int, max_unit_chars int, overlap_chars int, sentence_delimiters string, soft_delimiters string")
    assert {r["unit_id"] for r in chunking.split_oversized(u, o).collect()} == {"u1"}
