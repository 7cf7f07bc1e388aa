"""Scalar text functions: native column builders, and the few that need Python."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

WORD_CLASS = "[^\\p{L}\\p{N}_]"
ASCII_ONLY = r"^[\x00-\x7F]*$"
_NOT_WORD = re.compile(r"[^\w㐀-鿿]+")


# ---- native: these run inside whole-stage code generation and expect text that is NFKC already


def compare_form(text: Column) -> Column:
    """Lower case, only letters, digits and `_`; null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORD_CLASS, "")


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_CLASS, ""))


def latin_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and `_`; an accent splits a word."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+"))


def has_han(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[\\u3400-\\u9fff]")


def comparable(text: Column, min_chars: Column | int, min_words: Column | int) -> Column:
    """Long enough to compare: by characters if there is Han text, else by Latin words (kana alone never is)."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(has_han(text), visible_chars(text) >= lit(min_chars)).otherwise(latin_words(text) >= lit(min_words))


def ngrams(form: Column, n: Column | int) -> Column:
    """Distinct n-grams; a form no longer than n is its own only gram, an empty one has none."""
    n = n if isinstance(n, Column) else F.lit(n)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(form) - n + 1, F.lit(1))), lambda i: F.substring(form, i, n)))
    return F.when(F.length(form) == 0, F.array().cast("array<string>")).when(F.length(form) <= n, F.array(form)).otherwise(many)


def unit_id(group: Column, path: Column, location: Column, index: Column, form: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", group, path, location, index.cast("string"), F.substring(form, 1, 80))), 1, 16)


def snippet(text: Column, start: Column, end: Column, window: int = 50) -> Column:
    """`window` characters either side of a hit (0-based start and end), dots where text is cut, newlines as spaces."""
    left = F.greatest(start - window, F.lit(0))
    right = F.least(end + window, F.length(text))
    dots = lambda cut: F.when(cut, F.lit("...")).otherwise(F.lit(""))
    return F.concat(dots(left > 0), F.replace(F.substring(text, left + 1, right - left), F.lit("\n"), F.lit(" ")), dots(right < F.length(text)))


def shorten(text: Column, limit: int) -> Column:
    """Collapse white space and keep the head and tail of what is longer than the limit."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    head = max(1, limit // 2 - 8)
    tail = max(1, limit - head - 5)
    cut = F.concat(F.left(flat, F.lit(head)), F.lit(" ... "), F.right(flat, F.lit(tail)))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def minute_key(value: Column) -> Column:
    """`YYYY-MM-DD HH:MM` of an ISO or PDF (`D:`) time; the offset is dropped without converting; else ''."""
    text = F.trim(F.coalesce(value, F.lit("")))
    d = F.regexp_replace(F.substring(text, 3, 1 << 20), "[^0-9]", "")
    part = lambda a, n: F.substring(d, a, n)
    pdf = F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit(" "), part(9, 2), F.lit(":"), part(11, 2))
    iso = "^(\\d{4}-\\d{2}-\\d{2})(?:[T ](\\d{2}:\\d{2})(?::\\d{2}(?:\\.\\d{1,6})?)?(?:Z|[+-]\\d{2}:?\\d{2})?)?$"
    day, minute = F.regexp_extract(text, iso, 1), F.regexp_extract(text, iso, 2)
    from_iso = F.when(day == "", F.lit("")).when(minute == "", F.concat(day, F.lit(" 00:00"))).otherwise(F.concat(day, F.lit(" "), minute))
    return F.when(text.startswith("D:") & (F.length(d) >= 12), pdf).otherwise(from_iso)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hexadecimal hashes of up to 16 digits differ; 64 where one is no such number."""
    good = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    return F.when(good, F.bit_count(hash_bits(a).bitwiseXOR(hash_bits(b)))).otherwise(64)


def hash_bits(hex_hash: Column) -> Column:
    return F.conv(hex_hash, 16, -10).cast("long")


# ---- Python, a batch at a time


def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


nfkc = pandas_udf(_nfkc, StringType())


def clean(text: str | None) -> str:
    text = unicodedata.normalize("NFKC", text or "").replace("\xa0", " ")
    text = re.sub(r"[ \t\r\f\v]+", " ", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


clean_text = pandas_udf(lambda s: s.map(clean), StringType())


def fold_value(value: str | None) -> str:
    """NFKC, white space collapsed, case folded."""
    return " ".join(unicodedata.normalize("NFKC", value or "").split()).casefold()


casefold_key = pandas_udf(lambda s: s.map(fold_value), StringType())


def norm(text: str | None) -> str:
    return _NOT_WORD.sub("", unicodedata.normalize("NFKC", text or "").lower())


norm_text = pandas_udf(lambda s: s.map(norm), StringType())


def _seq_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in zip(left, right)], dtype="float64")


#: Order matters: the ratio of (a, b) may differ from that of (b, a).
seq_ratio = pandas_udf(_seq_ratio, DoubleType())


def pair_scorer() -> Callable[[str, str, float, float], float]:
    """A function (a, b, Jaccard, threshold) that scores forms: 0.62 of the sequence ratio and 0.38 of Jaccard; what its
    upper bounds rule out scores -1.

    Texts repeat, so what a pair of texts scored is kept (up to a bound), as is the index of the right text.
    """
    m, last = difflib.SequenceMatcher(None, autojunk=False), None
    seen: dict[tuple[str, str, float], float] = {}

    def score(a: str, b: str, j: float, t: float) -> float:
        nonlocal last
        if not a or not b or a == b:
            return 1.0 if a and a == b else 0.0
        got = seen.get((a, b, t))
        if got is None:
            if b != last:
                m.set_seq2(b)
                last = b
            m.set_seq1(a)
            likely = 0.62 * m.real_quick_ratio() + 0.38 * j >= t - 1e-9 and 0.62 * m.quick_ratio() + 0.38 * j >= t - 1e-9
            if len(seen) > 50_000:
                seen.clear()
            got = seen[a, b, t] = 0.62 * m.ratio() + 0.38 * j if likely else -1.0
        return got

    return score


def _score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    score = pair_scorer()
    for columns in batches:
        yield pd.Series([score(*row) for row in zip(*columns)], dtype="float64")


score_above = pandas_udf(_score, DoubleType())


def _grams(form: str) -> set[str]:
    return {form[i : i + 3] for i in range(max(1, len(form) - 2))} if form else set()


def similarity(a: str, b: str) -> float:
    """The score of two comparison forms, for callers without a table."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = _grams(a), _grams(b)
    return 0.62 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() + 0.38 * len(x & y) / len(x | y)


sim_score = pandas_udf(lambda a, b: pd.Series([similarity(x or "", y or "") for x, y in zip(a, b)], dtype="float64"), DoubleType())


def highlight(left: str, right: str, least: int = 4) -> tuple[str, str]:
    """Both texts escaped for HTML, with equal stretches of `least` characters or more in <mark>."""
    out: tuple[list[str], list[str]] = ([], [])
    for tag, a, b, c, d in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        for parts, text in zip(out, (left[a:b], right[c:d])):
            safe = html.escape(text)
            parts.append(f"<mark>{safe}</mark>" if tag == "equal" and b - a >= least else safe)
    return "".join(out[0]), "".join(out[1])


def _highlight(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([highlight(a or "", b or "") for a, b in zip(left, right)], columns=["l", "r"])


highlight_common = pandas_udf(_highlight, StructType([StructField("l", StringType()), StructField("r", StringType())]))


def register(spark: SparkSession) -> None:
    """Make the Python functions callable from SQL."""
    for name, f in {"nfkc": nfkc, "clean_text": clean_text, "casefold_key": casefold_key, "norm_text": norm_text, "seq_ratio": seq_ratio, "sim_score": sim_score, "highlight_common": highlight_common}.items():
        spark.udf.register(name, f)
    from textloom.operators.keywords import finditer_function
    from textloom.operators.segment import split_units
    from textloom.sources.files import parse_document
    from textloom.sources.pictures import ahash64

    spark.udtf.register("finditer", finditer_function())
    for name, f in {"split_units": split_units, "parse_document": parse_document, "ahash64": ahash64}.items():
        spark.udf.register(name, f)
