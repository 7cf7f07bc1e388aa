"""Problem 2: splitting oversized items at natural boundaries (content-defined chunking)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import code_points, norm

#: The defaults that stand for null or empty options.
DEFAULT_SENTENCE = "。！？!?；;"
DEFAULT_SOFT = "，,、：:"
DEFAULT_MAX = 420
#: Texts of these characters only never grow under NFKC, so their length bounds that of the comparison form.
PLAIN = r"^[\x09-\x7E¡-§À-ıĴ-ňŊ-ž‐-•、-〩㐀-鿿！-～]*$"
SCHEMA = "unit_id string, options_id int, text_id long, max_chars int, unit_chars int, piece_no int, start int, end int, boundary string, piece_chars int, text string"
WINDOW = 12
_VISIBLE = re.compile(r"[\w㐀-鿿]")
_JOINS = "\u200d\ufe0e\ufe0f"
#: What a place after a character can be, from never to best: a place to cut only if there is no other, a word's end, a
#: natural boundary.
NEVER, LANDMARK, WORD, CLAUSE, SENTENCE = range(5)
KINDS = ("landmark", "landmark", "word", "clause", "sentence")
_traits: dict[int, tuple[int, int]] = {}


def _weight(c: str) -> int:
    """Characters that one code point adds at most to the comparison form."""
    return len(_VISIBLE.findall(unicodedata.normalize("NFKC", c).lower()))


def _trait(code: int) -> tuple[int, int]:
    """(weight, kind): kind is 1 for what stays with the character before, 2 for a letter of a script that parts words by
    spaces, else 0; kept per process."""
    got = _traits.get(code)
    if got is None:
        c = chr(code)
        marks = unicodedata.combining(c) > 0 or unicodedata.category(c) == "Mn" or c in _JOINS
        spaced = (c.isalnum() or c == "_") and not (0x2E80 <= code <= 0xABFF and not 0xA640 <= code <= 0xA7FF or 0xF900 <= code <= 0xFAFF or code >= 0x20000)
        got = _traits[code] = (_weight(c), 1 if marks else 2 if spaced else 0)
    return got


def _landmarks(codes: np.ndarray) -> np.ndarray:
    """A 32-bit rolling hash of the last WINDOW characters at each position; depends on those characters only."""
    h = np.zeros(len(codes), np.uint32)
    c = codes.astype(np.uint32) + np.uint32(1)
    for k in range(min(WINDOW, len(codes))):
        h[k:] += c[: len(c) - k] * np.uint32(pow(0x01000193, k, 1 << 32))
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(8)


def _boundaries(codes: np.ndarray, kinds: np.ndarray, sentence: str, soft: str) -> np.ndarray:
    """What the place after each character is (see KINDS)."""
    after, next_kind = np.append(codes[1:], 0), np.append(kinds[1:], 0)
    line = (codes == 10) | (codes == 13)
    ends = np.isin(codes, code_points(sentence)) | line
    out = np.full(len(codes), LANDMARK, np.int8)
    inside = (kinds > 0) & (next_kind == 2) & ((kinds == 2) | (np.append(0, kinds[:-1]) == 2))
    out[~inside] = WORD
    out[np.isin(codes, code_points(soft))] = CLAUSE
    # of several ends in a row, the last one counts
    out[ends & ~(np.append(ends[1:], False) & (after != 10) & (after != 13))] = SENTENCE
    out[(next_kind == 1) | (codes == 13) & (after == 10)] = NEVER  # a mark stays with its letter, a line end is one
    return out


def chunk(text: str, limit: int, overlap: int, sentence: str, soft: str) -> list[tuple[int, int, str]]:
    """Pieces (start, end, boundary) of `text`, each of at most `limit` visible characters.

    Consecutive pieces share `overlap` visible characters, as asked; an overlap that would leave no room for anything
    new is the limit less one. New text in a piece is between a minimum (half) and the maximum that the limit leaves.
    Inside that range the place whose rolling hash is the smallest is the landmark - it depends on nearby characters
    only, so cuts fall into step again soon after an edit - and the cut snaps to the natural boundary nearest to it: the
    end of a sentence, line or clause; else the end of a word (in any script with spaces), else the landmark itself.
    text[start:end] of all pieces, without what they share, is the text.
    """
    codes = code_points(text)
    n = len(codes)
    unique, of = np.unique(codes, return_inverse=True)
    traits = np.array([_trait(int(c)) for c in unique], np.int64).reshape(-1, 2)[of]
    before = np.concatenate([[0], np.cumsum(traits[:, 0])])
    if before[n] <= limit:
        return [(0, n, "end")]
    overlap = max(0, min(overlap, limit - 1))
    most = limit - overlap
    least = max(1, most // 2)
    marks, bounds = _landmarks(codes), _boundaries(codes, traits[:, 1], sentence, soft)
    pieces, cut, start = [], 0, 0
    while True:
        room = limit if cut == 0 else most
        if before[n] - before[cut] <= room:
            pieces.append((start, n, "end"))
            return pieces
        low = max(cut + 1, int(np.searchsorted(before, before[cut] + (least if cut else max(least, overlap)))))
        high = int(np.searchsorted(before, before[cut] + room, "right")) - 1
        places = np.arange(low, high + 1)
        places = places[bounds[places - 1] > NEVER]
        if len(places):
            kinds = bounds[places - 1]
            mark = places[np.argmin(marks[places - 1])]
            good = places[kinds >= CLAUSE] if (kinds >= CLAUSE).any() else places[kinds == WORD]
            to = int(good[np.argmin(np.abs(good - mark))] if len(good) else mark)
        else:  # one character, or one with its marks, is larger than the room
            to = max(high, cut + 1)
        pieces.append((start, to, KINDS[bounds[to - 1]]))
        cut = to
        start = min(cut, int(np.searchsorted(before, before[cut] - overlap))) if overlap else cut
        while start < cut and traits[start, 1] == 1:
            start += 1


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for unit, options, text_id, text, limit, overlap, sentence, soft in zip(*(batch[c] for c in ("unit_id", "options_id", "text_id", "text", "max_chars", "overlap", "sentence", "soft"))):
            limit = int(limit)
            chars = len(norm(text))
            if chars <= limit:
                continue
            for k, (a, b, kind) in enumerate(chunk(text, limit, int(overlap), sentence, soft)):
                rows.append((unit, None if pd.isna(options) else int(options), text_id, limit, chars, k, a, b, kind, len(norm(text[a:b])), text[a:b]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"options_id": "Int32"})


def rebuilt(pieces: DataFrame) -> DataFrame:
    """(unit_id, text_md5, fits): the text that the pieces of each split text make without what they share, and whether each
    keeps to its limit. The pieces of one text are as many as it is long."""
    new = F.struct("piece_no", "start", "end", "text")
    whole = pieces.groupBy("unit_id", "options_id", "text_id").agg(F.array_sort(F.collect_list(new)).alias("p"), F.bool_and(F.col("piece_chars") <= F.col("max_chars")).alias("fits"))
    ends = F.transform("p", lambda x, i: F.substring(x["text"], F.when(i == 0, 1).otherwise(F.col("p")[i - 1]["end"] - x["start"] + 1), F.length(x["text"])))
    return whole.select("unit_id", F.md5(F.array_join(ends, "")).alias("text_md5"), "fits")


def split_oversized(units: DataFrame, options: DataFrame) -> DataFrame:
    """Pieces of every text whose comparison form has more characters than the limit of its options.

    One row per piece (see SCHEMA; start and end are code points of the text). Null or non-positive limits count as
    420, empty delimiters as the defaults, a null overlap as 0. Null and empty texts, and those within the limit, give
    no rows; a unit that occurs with one text several times is split once. An unknown options_id uses the defaults.
    """
    o = options.groupBy("options_id").agg(*(F.max(c).alias(c) for c in ("max_unit_chars", "overlap_chars", "sentence_delimiters", "soft_delimiters")))
    text = units.select("unit_id", "options_id", "text").filter("unit_id is not null and text is not null")
    rows = text.join(o, "options_id", "left").select(
        "unit_id",
        "options_id",
        "text",
        F.when(F.col("max_unit_chars") > 0, F.col("max_unit_chars")).otherwise(DEFAULT_MAX).cast("int").alias("max_chars"),
        F.coalesce("overlap_chars", F.lit(0)).cast("int").alias("overlap"),
        F.coalesce(F.nullif("sentence_delimiters", F.lit("")), F.lit(DEFAULT_SENTENCE)).alias("sentence"),
        F.coalesce(F.nullif("soft_delimiters", F.lit("")), F.lit(DEFAULT_SOFT)).alias("soft"),
    )
    # the comparison form of plain text is never longer than the text; everything else is measured exactly
    large = rows.filter((F.length("text") > F.col("max_chars")) | ~F.col("text").rlike(PLAIN))
    return large.distinct().withColumn("text_id", F.xxhash64("text")).mapInPandas(_split, SCHEMA)
