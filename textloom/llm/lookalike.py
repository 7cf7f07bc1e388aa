"""Problem 4: visually identical text with different characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import checkpoint

# Letters of the Cyrillic and Greek scripts beside the Latin letter that looks the same.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХҮаеѕіјорсухһԁԛԝԌҺӀԚԜУԍѵѴӏү", "ABESIJKMHOPCTXYaesijopcyxhdqwGhlQWYGvVly"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳϹͿ", "ABEZHIKMNOPTYXovpcjCJ"))
OTHER = dict(zip("ıɑɡɩօոսհՏՕ", "iagionuhSO"))
# Radicals of the supplement beside the ideograph that looks the same.
RADICALS = dict(zip("⺁⺄⺅⺇⺈⺋⺎⺏⺐⺓⺔⺘⺙⺛⺝⺟⺠⺡⺢⺤⺥⺧⺩⺫⺬⺭⺮⺯⺲⺶⺷⺹⺺⺻⺼⺽⻁⻂⻃⻄⻅⻆⻈⻉⻊⻋⻌⻎⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻳", "厂乙亻几刀㔾兀尣尢幺彑扌攵旡月母民氵氺爫爫牜王罒示礻竹糹罒羊羊耂肀聿月臼虎衤覀西见角讠贝足车辶辶阝钅長镸长门阜阝雨青韦页风飞食飠饣饣马骨鬼鱼鸟卤麦黄黾齐齐齿齿竜龙龟龟"))
KANGXI = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2F00, 0x2FD6)}
WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
#: Invisible characters beside those of category Cf.
UNSEEN = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180E), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
#: Texts of these characters only have no form but full-width ones to settle.
SIMPLE = r"^[\x09\x0A\x0D\x20-\x7E—‘-”…℃、。〇-】㎡一-鿿！-～]*$"
_FOLD = {**KANGXI, **RADICALS, **WIDE}


def _table() -> dict[int, str | None]:
    t: dict[int, str | None] = {ord(k): v for k, v in _FOLD.items()}
    for c in (*range(0x80, 0x3100), *range(0xFE00, 0x10000), *range(0xE0000, 0xE0200), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B)):
        kind = unicodedata.category(chr(c))
        if kind == "Cf" or c in UNSEEN:
            t[c] = None
        elif kind == "Zs":
            t[c] = " "
    return t


_TABLE = _table()
_TO_LATIN = {**CYRILLIC, **GREEK, **OTHER}
_ALIEN = re.compile(f"[{''.join(_TO_LATIN)}]")
_TO_CYRILLIC = {v: k for k, v in reversed(CYRILLIC.items())}
_TO_GREEK = {v: k for k, v in reversed(GREEK.items())}
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


def _scripts(c: str) -> frozenset[str]:
    """The resolved script set of a letter: every script that has a letter of this look."""
    latin = _TO_LATIN.get(c, c)
    if latin.isascii():
        return frozenset({"Latn"} | ({"Cyrl"} if latin in _TO_CYRILLIC else set()) | ({"Grek"} if latin in _TO_GREEK else set()))
    name = unicodedata.name(c, "")
    return frozenset({"Latn"} if name.startswith("LATIN") else {"Cyrl"} if name.startswith("CYRILLIC") else {"Grek"} if name.startswith("GREEK") else {"Zyyy"})


def _spell(m: re.Match) -> str:
    """One token in its consistent script: Latin where the whole token can be Latin, else Cyrillic, else Greek.

    The choice and the spelling depend on the looks of the letters alone, so tokens that look the same come out equal.
    A token that no single script can spell (a true mixture) keeps its own letters and has the shared ones in Latin.
    """
    token = m[0]
    letters = [c for c in token if not "̀" <= c <= "ͯ" and not "㐀" <= c <= "鿿"]
    common = frozenset.intersection(*map(_scripts, letters)) if letters else frozenset({"Latn"})
    latin = "".join(_TO_LATIN.get(c, c) for c in token)
    if "Latn" in common or not common & {"Cyrl", "Grek"}:
        return latin
    back = _TO_CYRILLIC if "Cyrl" in common else _TO_GREEK
    return "".join(back.get(c, c) for c in latin)


def skeleton(text: str) -> str:
    """The one consistent form of a text: equal for texts that look the same, and only for those.

    Invisible characters go, every kind of space becomes a plain one (one for one), full-width ASCII, radicals and
    letters of look-alike scripts become the usual ones, accents are composed. Superscripts, circled digits, missing
    accents, case and line breaks stay as they are.
    """
    text = text.translate(_TABLE)
    if not text.isascii():
        if not unicodedata.is_normalized("NFD", text) or _ALIEN.search(text):
            text = unicodedata.normalize("NFD", text)
            if _ALIEN.search(text):
                text = _WORD.sub(_spell, text)
        text = unicodedata.normalize("NFC", text)
    return text


def mixed_tokens(text: str) -> int:
    """How many tokens of a text had to be respelled in another script."""
    t = unicodedata.normalize("NFD", (text or "").translate(_TABLE))
    return sum(_spell(m) != m[0] for m in _WORD.finditer(t) if _ALIEN.search(m[0]))


def _skeletons(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(skeleton, na_action="ignore")


def consistent_form(text: Column) -> Column:
    """The form of `skeleton` as a column. Full-width forms in otherwise simple text are settled without Python: the
    function sees a null in place of such a text, so one scan serves both."""
    simple = text.rlike(SIMPLE)
    wide = F.translate(text, "".join(WIDE), "".join(WIDE.values()))
    return F.when(simple, wide).otherwise(F.pandas_udf(_skeletons, "string")(F.when(~simple, text)))


def consistent_units(units: DataFrame) -> DataFrame:
    """(unit_id, text, form) for every unit and text; null texts are left out, empty ones stay empty."""
    rows = units.select("unit_id", "text").filter("unit_id is not null and text is not null")
    return rows.withColumn("form", consistent_form(F.col("text")))


def spellings(units: DataFrame) -> DataFrame:
    """(unit_id, f1, f2, t): units whose form is written in two ways or more; f1, f2 tell the form, t the text.

    Only hashes are shuffled (128 bits of the form, 64 of the text within it), never texts; the table is read once.
    """
    rows = consistent_units(units).filter("form <> ''").select("unit_id", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(7), "form").alias("f2"), F.xxhash64("text").alias("t"))
    rows = checkpoint(rows.distinct())
    several = rows.groupBy("f1", "f2").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("f1", "f2")
    return checkpoint(rows.join(several.hint("merge"), ["f1", "f2"], "left_semi"))


def lookalike_pairs(units: DataFrame) -> DataFrame:
    """(unit_id_1, unit_id_2): pairs of units whose texts differ in code points but have one consistent form.

    Units with one text form a class; pairs are made between classes and then members are attached to either side, so
    copies cost nothing. All pairs are what is asked for here; `lookalike_groups` gives one row a unit instead.
    Repeated rows, nulls and extra columns don't matter.
    """
    members = spellings(units)
    classes = members.select("f1", "f2", "t").distinct()
    pairs = classes.withColumnRenamed("t", "t1").join(classes.withColumnRenamed("t", "t2").hint("merge"), ["f1", "f2"]).filter("t1 < t2")
    left = members.select("f1", "f2", F.col("t").alias("t1"), F.col("unit_id").alias("u1")).hint("merge")
    right = members.select("f1", "f2", F.col("t").alias("t2"), F.col("unit_id").alias("u2")).hint("merge")
    found = pairs.join(left, ["f1", "f2", "t1"]).join(right, ["f1", "f2", "t2"]).filter("u1 <> u2")
    return found.select(F.least("u1", "u2").alias("unit_id_1"), F.greatest("u1", "u2").alias("unit_id_2")).distinct()


def lookalike_groups(units: DataFrame) -> DataFrame:
    """(unit_id, class_id, group_id, links): a row for each unit and text that looks like a text written otherwise.

    class_id is the smallest unit_id with that very text, group_id the smallest with that look, links the number of
    units in the group's other classes. Its size is that of the units, however many spellings a form has.
    """
    members = spellings(units)
    classes = members.groupBy("f1", "f2", "t").agg(F.min("unit_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    groups = classes.groupBy("f1", "f2").agg(F.min("class_id").alias("group_id"), F.sum("n").alias("total"))
    of = classes.join(groups.hint("merge"), ["f1", "f2"]).select("f1", "f2", "t", "class_id", "group_id", (F.col("total") - F.col("n")).alias("links"))
    return members.join(of.hint("merge"), ["f1", "f2", "t"]).select("unit_id", "class_id", "group_id", "links")
