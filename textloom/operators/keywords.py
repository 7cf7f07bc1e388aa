"""Keywords and patterns whose value two groups or more share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from textloom.config import PRESETS, Config

# Labels and patterns of the presets.
PRESET_PATTERNS = {
    "china_mobile": ("中国大陆手机号", r"(?<!\d)1(?:3[0-9]|4[01456879]|5[0-35-9]|6[2567]|7[0-8]|8[0-9]|9[0-35-9])\d{8}(?!\d)"),
    "china_id_card": ("中国大陆身份证", r"(?<!\d)\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)"),
    "email": ("邮箱地址", r"(?<![A-Za-z0-9_.+-])(?![A-Za-z0-9_.+-]*\.\.)[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?![A-Za-z0-9_.+-])"),
    "china_address": ("地址", r"(?:北京市|上海市|天津市|重庆市|[一-龥]+省)(?:[一-龥]+市)?(?:[一-龥]+(?:区|县))(?:[一-龥]+(?:街道|路|巷|镇|乡))(?:[一-龥0-9]+号)(?:[一-龥0-9]+单元)?(?:[一-龥0-9]+室)?"),
}
#: What a text must hold for a preset to match at all, in the JVM's dialect.
HINTS = {"china_mobile": r"1\p{Nd}{10}", "china_id_card": r"\p{Nd}{17}[\p{Nd}Xx]", "email": "@", "china_address": "号"}
WINDOW = 50
HITS = "rule_no int, keyword string, is_regex boolean, pattern string, hit_no int, location string, snippet string, matched_text string, canonical string"


@dataclass(frozen=True)
class Rule:
    keyword: str
    pattern: str
    is_regex: bool


def rules(keywords=(), regex_keywords=(), presets: dict[str, bool] | None = None) -> tuple[list[Rule], list[str]]:
    """Rules in order - words, patterns, presets - each pattern once, and messages for patterns that don't compile."""
    wanted = [Rule(k, k[3:], True) if k.startswith("re:") else Rule(k, re.escape(k), False) for k in keywords if k]
    wanted += [Rule(p, p, True) for p in (x.removeprefix("re:") for x in regex_keywords)]
    wanted += [Rule(f"{PRESET_PATTERNS[k][0]}（预设）", PRESET_PATTERNS[k][1], True) for k in PRESETS if (presets or {}).get(k, presets is None)]
    good, errors = [], []
    first: dict[tuple[str, bool], Rule] = {}
    for rule in wanted:
        first.setdefault((rule.pattern, rule.is_regex), rule)
    for rule in first.values():
        try:
            re.compile(rule.pattern, re.IGNORECASE)
            good.append(rule)
        except re.error as e:
            errors.append(f"{rule.keyword}: {e}")
    return good, errors


def config_rules(config: Config) -> tuple[list[Rule], list[str]]:
    return rules(config.keywords, config.regex_keywords, config.regex_presets)


def context(text: str, start: int, end: int, window: int = WINDOW) -> str:
    a, b = max(0, start - window), min(len(text), end + window)
    return ("..." if a else "") + text[a:b].replace("\n", " ") + ("..." if b < len(text) else "")


class Finditer:
    """`lateral finditer(text, pattern)`: every match, with Python's dialect and code point offsets."""

    def eval(self, text: str, pattern: str):
        if text is not None and pattern is not None:
            for k, m in enumerate(re.finditer(pattern, text, re.IGNORECASE), start=1):
                yield k, m.start(), m.end(), m[0]


def finditer_function():
    return udtf(Finditer, returnType="hit_no int, start_at int, end_at int, matched_text string")


def full_text(blocks: Column | str = "blocks") -> Column:
    """Raw blocks joined by newlines; null blocks are left out."""
    return F.array_join(blocks, "\n")


def possible(text: Column, wanted: list[Rule]) -> Column:
    """Whether any rule can match, natively: words as they are, presets by their hint. Own patterns are in Python's
    dialect, so with one of them every text is possible."""
    known = {PRESET_PATTERNS[k][1]: hint for k, hint in HINTS.items()}
    hints = [known.get(r.pattern) if r.is_regex else "\\Q" + r.keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E" for r in wanted]
    return F.lit(True) if None in hints else text.rlike("(?iu)" + "|".join(hints)) if hints else F.lit(False)


def find_hits(texts: DataFrame, wanted: list[Rule], keep: list[str]) -> DataFrame:
    """One row per match of a rule in `text`, with the columns of `keep`.

    Matching ignores case, runs left to right without overlaps over the raw text. Every match takes a number; those
    of white space only give no row. Texts that no rule can match never leave the JVM. A word's canonical value is the word case-folded, a pattern's what it matched.
    """
    types = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    columns = [*keep, *(c.split()[0] for c in HITS.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(k, r, re.compile(r.pattern, re.IGNORECASE)) for k, r in enumerate(wanted)]
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                text, held = row[-1], tuple(row[:-1])
                for k, rule, pattern in compiled if text else ():
                    for n, m in enumerate(pattern.finditer(text), start=1):
                        if m[0].strip():
                            out.append((*held, k, rule.keyword, rule.is_regex, rule.pattern, n, f"命中{n}", context(text, *m.span()), m[0], m[0] if rule.is_regex else rule.keyword.casefold()))
            yield pd.DataFrame(out, columns=columns)

    return texts.select(*keep, "text").filter(possible(F.col("text"), wanted)).mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), HITS]))


def shared_values(hits: DataFrame, keys: list[str], value: str = "canonical", order: str = "ord") -> DataFrame:
    """Alerts: values of a rule that two groups or more hold. All hits stay, in order; the display is the first seen.

    The groups are counted first, with map-side combining, so values of one group never carry their hits on.
    """
    by = [*keys, "rule_no", value]
    several = hits.groupBy(*by).agg(F.min("group_name").alias("_lo"), F.max("group_name").alias("_hi")).filter("_lo <> _hi").drop("_lo", "_hi")
    held = hits.join(several, by, "left_semi")
    hit = F.struct(order, "hit_no", "group_name", "file_path", "file_name", "location", "snippet", "matched_text")
    return held.groupBy(*by).agg(
        F.first("keyword").alias("keyword"),
        F.first("is_regex").alias("is_regex"),
        F.first("pattern").alias("pattern"),
        F.array_sort(F.collect_set("group_name")).alias("groups"),
        F.array_sort(F.collect_list(hit)).alias("hits"),
        F.min_by("matched_text", F.struct(order, "hit_no")).alias("matched_text"),
        F.min(F.struct(order, "hit_no")).alias("first_seen"),
    )
