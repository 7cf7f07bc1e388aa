"""Problem 3: noise in text from scanned pages (anagram hashing, edge-line removal, hyphen evidence)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import checkpoint

#: What a scanner reads (left) for what is printed (right), by kind of text.
HAN = dict(p[::-1] for p in "单車 间问 测侧 标杯 方万 管菅 工土 计汁 检捡 程桯 理埋 台合 日曰 服眼 目日 据椐 设没 实买 络洛 材村 系糸 土士 质盾 证汪 技枝 件仵 备各 已己 末未 人入 天夫 千干 网冈 问间 拆折 侯候 今令 贝见 处外 未末 大太 间闫 件伴 材林 料科 线钱 安妥 电龟 水氺 监鉴 现观 位住 组纽 施旋 值植 招拾 公么 司可 限跟".split())
HAN["土"], HAN["日"], HAN["曰"], HAN["士"] = "工", "目", "日目", "工土"
LATIN = [("rn", "m"), ("cl", "d"), ("b", "h"), ("c", "e"), ("j", "i"), ("vv", "w"), ("1", "l"), ("5", "s"), ("0", "o"), ("l", "i"), ("li", "h"), ("ii", "u"), ("nn", "m"), ("6", "b"), ("f", "t"), ("q", "g")]
DIGIT_LIKE = "OoQDZzSsBbIlgqi"
HYPHENS = "-‐‑­¬"
#: Page numbers of a page layout, a line each; digits may be misread.
_D = rf"[\d{DIGIT_LIKE}]{{1,5}}"
PAGE_LINE = re.compile(rf"^\s*(?:{_D} ?/ ?{_D}|[-–—] ?{_D} ?[-–—]|[Pp]a[gq][ec] ?{_D}(?: ?[o0]f ?{_D})?|第 ?{_D} ?页(?:[ ,，/]*共 ?{_D} ?页)?|[·•.]+ ?{_D} ?[·•.]+)\s*$")
BARE = re.compile(r"^\s*\d{1,4}\s*$")
TAIL_NUMBER = re.compile(rf"[ \t　]{{2,}}({_D})\s*$")
STOP = "。！？!?；;，,、：:."
_LINE_HYPHEN = re.compile(rf"(?<=[a-z])[{HYPHENS}] ?(?:\r?\n|$)")
_BREAK_HYPHEN = re.compile(rf"(?<=[A-Za-z])[{HYPHENS}] ?\r?\n")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9]*|[0-9][A-Za-z0-9]*(?:\.[A-Za-z0-9]+)?")
_CODE = re.compile(r"^[A-Z]{1,3}$|^[A-Z]{2}\d{1,5}$|^\d+(?:\.\d+)?$")
#: Scores: log of how much more often the corrected form is seen, over the windows of a place.
HAN_EVIDENCE, MORE_OFTEN, LEAST_SEEN = 1.0, 8, 5
_RIGHT = {c for v in HAN.values() for c in v}
_FOLD_HAN = {ord(k): v[0] for k, v in HAN.items()}
_FOLD_HAN.update({ord("日"): "日", ord("曰"): "日", ord("土"): "土", ord("士"): "土", ord("工"): "土", ord("目"): "日"})
_CONTEXT = {**_FOLD_HAN, **{ord(c): "0" for c in "0123456789"}, **{c: "A" for c in range(65, 91)}}
_FOLD_LATIN = str.maketrans({"1": "i", "l": "i", "j": "i", "5": "s", "0": "o", "c": "e", "b": "h", "6": "h", "t": "f", "q": "g"})


def fold_latin(word: str) -> str:
    """A key that a word shares with its misreadings."""
    for a, b in (("rn", "m"), ("nn", "m"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("ii", "u")):
        word = word.replace(a, b)
    return word.translate(_FOLD_LATIN)


def fold_line(line: str) -> str:
    """A key that the printings of one running header share: no page number, no space, misreadings folded."""
    line = TAIL_NUMBER.sub("", line)
    line = re.sub(r"\s+", "", line).translate(_FOLD_HAN)
    line = line.lower().translate(str.maketrans("ozsbqi", "0258g1"))
    return fold_latin(line.translate(str.maketrans("0258g", "ozsbq")).translate(str.maketrans("zg", "zq")))


def split_lines(text: str) -> list[str]:
    return re.split(r"\r\n|\n|\r", text)


def page_line(line: str, before: str | None) -> bool:
    """A line that only numbers its page; a bare number does so alone or after a finished line."""
    if PAGE_LINE.match(line):
        return True
    return bool(BARE.match(line)) and (before is None or not before.strip() or before.rstrip()[-1] in "。！？!?；;.：:" or TAIL_NUMBER.search(before) is not None)


def body_lines(lines: list[str]) -> tuple[list[str], bool]:
    """Lines without page numbers at either edge, and whether there was one."""
    page, kept = False, list(lines)
    while kept and kept[-1].strip() == "":
        kept.pop()
    if kept and page_line(kept[-1], kept[-2] if len(kept) > 1 else None):
        kept.pop()
        page = True
    if kept and PAGE_LINE.match(kept[0]):
        kept.pop(0)
        page = True
    return kept, page


def misread_token(token: str, at_line_start: bool, code_before: bool) -> bool:
    """Numbers, codes and words with letters for digits or digits for letters."""
    if not any(c.isdigit() for c in token) or _CODE.match(token):
        return False
    if re.fullmatch(r"[A-Z]\d{1,5}", token):  # half of a code that a line end cut
        return token[0] in DIGIT_LIKE and not at_line_start
    if re.fullmatch(rf"[A-Z]{{0,3}}[\d{DIGIT_LIKE}]*\d[\d{DIGIT_LIKE}]*(?:\.[\d{DIGIT_LIKE}]+)?", token):
        return True
    letters = sum(c.islower() for c in token)
    if letters >= 2 and re.fullmatch(r"[A-Z]?[a-z0-9]+", token) and letters + 1 >= 2 * sum(c.isdigit() for c in token):
        return bool(re.search(r"[a-z]\d|\d[a-z]", token)) and not re.fullmatch(r"\d+(?:mm|cm|km|kg|kv|kw|m|g|th|st|nd|rd)", token)
    return False


FEATURES = "kind string, doc_id long, unit_id string, pos long, key string, alt string, extra string, ctx long, value long, delta long"


def _windows(left: str, right: str) -> set[tuple[int, str]]:
    """The contexts of a character: none, and one or two characters on either side, as (side, characters)."""
    return {(side if near else 0, near) for side, near in ((0, ""), (1, left[-1:]), (2, right[:1]), (1, left), (2, right))}


def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over scanned units. Rows by kind: hyphen, page_no, misread (certain alone); line (first line of the unit:
    key is the folded line, alt its tail, extra whether it may be a header); word (a lower-case word); han (a window around
    a confusable character: ctx its context, value its anagram value, delta what the printed character would change of it,
    extra names the place; delta 0: counts only; more: the same window with another printed character).
    """
    for batch in batches:
        rows = []
        for doc, unit, pos, text in zip(batch["doc_id"], batch["unit_id"], batch["pos"], batch["text"]):
            lines, page = body_lines(split_lines(text))
            if page:
                rows.append(("page_no", doc, unit, pos, None, None, None))
            if _LINE_HYPHEN.search(text):
                rows.append(("hyphen", doc, unit, pos, None, None, None))
            if lines:
                first = lines[0]
                number = TAIL_NUMBER.search(first)
                if len(first) <= 80 and first.strip():
                    bare = TAIL_NUMBER.sub("", first).strip()
                    if bare and bare[-1] not in STOP:
                        key = fold_line(first)
                        tail = key[-4:] if not bare.isascii() else re.sub(r"[^a-z].*$", "", fold_latin(bare.lower()))[:12]
                        rows.append(("line", doc, unit, pos, key, tail, "number" if number else "plain"))
            body = "\n".join(lines)
            joined = _BREAK_HYPHEN.sub("", body)
            starts = {m.end() for m in re.finditer(r"\r?\n", body)}
            for m in _WORD.finditer(body):
                if misread_token(m[0], m.start() in starts or m.start() == 0, False) and not (m[0].isdigit()):
                    rows.append(("misread", doc, unit, pos, None, None, m[0]))
            joined = re.sub(r"\r?\n", "", joined)
            words = list(re.finditer(r"[A-Za-z]+[0-9]?[A-Za-z]*", joined))
            for k, m in enumerate(words):
                w = m[0]
                if len(w) < 4 or not w.islower() and not w[1:].islower():
                    continue
                if k == 0 and m.start() == 0 and w[0].islower() or m.end() >= len(joined.rstrip(HYPHENS + " ")) and joined.rstrip()[-1:] in HYPHENS:
                    continue  # half of a word that a unit's edge cut
                rows.append(("word", doc, unit, pos, w.lower(), None, None))
            context = joined.translate(_CONTEXT)
            for i, c in enumerate(joined):
                wrong = HAN.get(c)
                if wrong is None and c not in _RIGHT:
                    continue
                left, right = context[max(0, i - 2) : i], context[i + 1 : i + 3]
                for side, near in _windows(left, right):
                    ctx = side << 60 | len(near) << 56 | sum(ord(x) << 21 * k for k, x in enumerate(near)) if near else 0
                    value = sum(ord(x) ** 3 for x in near + c)
                    for k, alt in enumerate(wrong or (None,)):
                        rows.append(("more" if k else "han", doc, unit, pos, None, None, f"{i}{alt}", ctx, value, ord(alt) ** 3 - ord(c) ** 3 if alt else 0))
        names = [c.split()[0] for c in FEATURES.split(", ")]
        yield pd.DataFrame([r + (0,) * (len(names) - len(r)) for r in rows], columns=names)


def scanned_ids(files: DataFrame) -> DataFrame:
    """doc_id of files whose text came from optical recognition."""
    return files.filter(F.col("metadata")["pdf_extraction"] == "paddleocr").select("doc_id").filter("doc_id is not null").distinct()


def scanned_units(units: DataFrame, files: DataFrame, broadcast_ids: int = 2_000_000) -> DataFrame:
    """(doc_id, unit_id, pos, text): distinct units of scanned files that have a text.

    The scanned ids are counted: up to `broadcast_ids` (8 bytes each) they are broadcast, beyond it units are shuffled.
    """
    ids = scanned_ids(files)
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    kept = units.select("doc_id", "unit_id", "pos", "text").filter("text is not null and text <> '' and unit_id is not null")
    return kept.join(ids, "doc_id", "left_semi").distinct()


def anagram(word) -> F.Column:
    """The anagram value: the sum of the fifth powers of its characters' codes, equal for words of the same characters."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: a + F.pow(F.ascii(c), F.lit(5)).cast("long"))


def _differences() -> list[int]:
    """What one or two confusions of LATIN change of an anagram value (a bounded table)."""
    one = {sum(ord(c) ** 5 for c in right) - sum(ord(c) ** 5 for c in wrong) for wrong, right in LATIN}
    return sorted(one | {a + b for a in one for b in one})


def word_corrections(words: DataFrame) -> DataFrame:
    """(key, word): rare words with the frequent word that they are a misreading of.

    Every confusion changes the anagram value of a word by a fixed difference, so rare words plus one or two
    differences are joined with frequent words on the value; a shared folded form confirms the join, and the most
    frequent candidate is ranked first. Rare is a word that a word of its folded form is MORE_OFTEN times as frequent as;
    only those are changed.
    """
    seen = words.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    fold = F.pandas_udf(lambda s: s.map(fold_latin), "string")
    table = checkpoint(seen.withColumn("fold", fold("key")))
    most = table.groupBy("fold").agg(F.max("n").alias("most"), F.min("n").alias("least")).filter((F.col("most") >= LEAST_SEEN) & (F.col("most") >= MORE_OFTEN * F.col("least")))
    table = table.join(most.select("fold", "most").hint("merge"), "fold").withColumn("value", anagram(F.col("key")))
    changed = F.explode(F.transform(F.array(*(F.lit(d).cast("long") for d in _differences())), lambda d: F.col("value") + d))
    rare = table.filter(F.col("most") >= MORE_OFTEN * F.col("n")).select("key", "n", "fold", changed.alias("value"))
    often = table.filter(F.col("n") >= LEAST_SEEN).select(F.col("key").alias("word"), F.col("n").alias("m"), "value", "fold")
    hit = rare.join(often.hint("merge"), ["value", "fold"]).filter(f"key <> word and m >= {MORE_OFTEN} * n")
    return hit.groupBy("key").agg(F.max_by("word", F.struct("m", "word")).alias("word"))


def han_corrections(places: DataFrame) -> DataFrame:
    """(doc_id, unit_id, pos, extra): places where a confusable character stands for the printed one.

    The words of Han text are windows: the character alone, and with one or two characters on either side (other
    confusable characters folded, digits and capitals alike). A confusion changes the anagram value of a window by a
    fixed difference, so windows are joined with their printed variants on context and changed value; the logs of how
    much more often the variant is seen are added up over the windows of a place, which ranks its corrections. A
    window too rare to tell adds nothing. Counts combine map-side.
    """
    seen = places.filter("kind = 'han'").groupBy("ctx", "value").agg(F.count(F.lit(1)).alias("n"))
    asked = places.filter("delta <> 0")
    windows = asked.select("ctx", "value", "delta").distinct().withColumn("printed", F.col("value") + F.col("delta"))
    rated = windows.join(seen.hint("merge"), ["ctx", "value"], "left").join(seen.select("ctx", F.col("value").alias("printed"), F.col("n").alias("m")).hint("merge"), ["ctx", "printed"], "left")
    rated = rated.select("ctx", "value", "delta", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    rated = rated.select("ctx", "value", "delta", F.when((F.col("m") == 0) & (F.col("n") <= 2), 0.0).otherwise(F.log((F.col("m") + 0.5) / (F.col("n") + 0.5))).alias("r"))
    total = asked.join(rated.hint("merge"), ["ctx", "value", "delta"]).groupBy("doc_id", "unit_id", "pos", "extra").agg(F.sum("r").alias("r"))
    return total.filter(F.col("r") > HAN_EVIDENCE).select("doc_id", "unit_id", "pos", "extra")


def header_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, key): first lines that run over the pages of a file.

    A line that two units of a file or more begin with (misreadings and page numbers apart) is a header, as is a
    single line that ends like the headers of three files or more.
    """
    per_file = lines.groupBy("doc_id", "key").agg(F.count_distinct("unit_id").alias("units"), F.max("alt").alias("alt"), F.max((F.col("extra") == "number").cast("int")).alias("number"))
    sure = per_file.filter("units >= 2 or number = 1")
    tails = sure.filter("alt <> ''").groupBy("alt").agg(F.count_distinct("doc_id").alias("files")).filter("files >= 3").select("alt")
    alone = per_file.filter("units < 2 and number = 0").join(tails, "alt", "left_semi")
    return sure.select("doc_id", "key").unionAll(alone.select("doc_id", "key"))


def noise(units: DataFrame, files: DataFrame) -> DataFrame:
    """(unit_id, noise): every unit of a scanned file with the kinds of noise in it, each once.

    All counts are over all scanned units. Null and empty texts have no noise; an empty table gives an empty result.
    """
    found = scanned_units(units, files).mapInPandas(features, FEATURES).persist()
    plain = found.filter("kind in ('hyphen', 'page_no', 'misread')").select("unit_id", F.col("kind").alias("noise"))
    lines = found.filter("kind = 'line'")
    heads = header_lines(lines)
    header = lines.join(heads, ["doc_id", "key"], "left_semi")
    numbered = header.filter("extra = 'number'").select("unit_id", F.lit("page_no").alias("noise"))
    words = found.filter("kind = 'word'").select("unit_id", "key")
    misread = words.join(word_corrections(words), "key", "left_semi").select("unit_id", F.lit("misread").alias("noise"))
    han = han_corrections(found.filter("kind in ('han', 'more')")).select("unit_id", F.lit("misread").alias("noise"))
    return plain.unionAll(header.select("unit_id", F.lit("header").alias("noise"))).unionAll(numbered).unionAll(misread).unionAll(han).distinct()


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, unit, pos, text, headed, words, places in zip(*(batch[c] for c in ("doc_id", "unit_id", "pos", "text", "headed", "words", "places"))):
            lines, _ = body_lines(split_lines(text))
            swap = {int(re.match(r"\d+", p)[0]): p.lstrip("0123456789") for p in (places if places is not None else [])}
            body = "\n".join(lines)
            joined = re.sub(r"\r?\n", "", _BREAK_HYPHEN.sub("", body))
            if swap:
                joined = "".join(swap.get(i, c) for i, c in enumerate(joined))
            if headed and lines:
                first = re.sub(r"\r?\n", "", _BREAK_HYPHEN.sub("", lines[0]))
                joined = joined[len(first) :]
            for w in words if words is not None else []:
                joined = re.sub(rf"\b{re.escape(w['key'])}\b", w["word"], joined, flags=re.I)
            joined = _WORD.sub(lambda m: _digits(m[0]), joined).strip()
            hyphen = bool(re.search(rf"[a-z][{HYPHENS}]$", joined))
            rows.append((doc, unit, pos, re.sub(rf"[{HYPHENS}]$", "", joined) if hyphen else joined, hyphen))
        yield pd.DataFrame(rows, columns=["doc_id", "unit_id", "pos", "text", "hyphen"])


def _digits(token: str) -> str:
    if misread_token(token, True, False) and not re.search(r"[a-z]{2}", token):
        head = re.match(r"[A-Z]{2}(?=.)", token)
        head = head[0] if head else ""
        return head + token[len(head) :].translate(str.maketrans("OoQDZzSsBbIlgqi", "000022558611991"))
    return token


def clean_units(units: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, unit_id, pos, text, hyphen): scanned units repaired; hyphen: the next unit goes on in the same word."""
    pages = scanned_units(units, files).persist()
    found = pages.mapInPandas(features, FEATURES).persist()
    lines = found.filter("kind = 'line'")
    headed = lines.join(header_lines(lines), ["doc_id", "key"], "left_semi").select("doc_id", "unit_id", "pos").distinct().withColumn("headed", F.lit(True))
    words = found.filter("kind = 'word'").select("doc_id", "unit_id", "pos", "key")
    fixes = words.join(word_corrections(words), "key").groupBy("doc_id", "unit_id", "pos").agg(F.collect_set(F.struct("key", "word")).alias("words"))
    han = han_corrections(found.filter("kind in ('han', 'more')")).groupBy("doc_id", "unit_id", "pos").agg(F.collect_set("extra").alias("places"))
    key = ["doc_id", "unit_id", "pos"]
    # a unit that was loaded twice counts once
    once = pages.groupBy(*key).agg(F.min("text").alias("text"))
    full = once.join(headed, key, "left").join(fixes, key, "left").join(han, key, "left").withColumn("headed", F.coalesce("headed", F.lit(False)))
    return full.mapInPandas(_repair, "doc_id long, unit_id string, pos long, text string, hyphen boolean")


def paragraphs(units: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text): each scanned file as continuous paragraphs in reading order.

    Headers, page numbers and line ends are gone, broken words joined, misreadings corrected. A paragraph goes on
    while the unit before it ends inside a word or without an end of sentence. Windows run per file over `pos`.
    """
    clean = clean_units(units, files).filter("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("pos", "unit_id")
    before = F.lag(F.struct("text", "hyphen")).over(order)
    ended = F.coalesce(before["text"].rlike(r"[。！？!?；;.：:|]$") & ~before["hyphen"], F.lit(True))
    numbered = clean.withColumn("first", ended.cast("int")).withColumn("paragraph", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = numbered.groupBy("doc_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("pos", "unit_id", "text"))).alias("parts"))
    return parts.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.concat_ws("", F.transform("parts", lambda p: p["text"])).alias("text"))
