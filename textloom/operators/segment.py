"""Segmentation of blocks into sentence-like units."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from textloom.config import SENTENCE, SOFT, Options
from textloom.functions.text import clean, comparable, compare_form, latin_words, ngrams, nfkc, unit_id, visible_chars

_VISIBLE = re.compile(r"[\w㐀-鿿]")
#: Neighbours with fewer visible characters than this are merged.
SHORT = 4


def visible(text: str) -> int:
    return len(_VISIBLE.findall(text))


def split_after(text: str, delimiters: str) -> list[str]:
    """Pieces that end with a delimiter or at a line end (which is dropped), stripped, without empty ones."""
    inside = re.escape(unicodedata.normalize("NFKC", delimiters or "").replace("\r", "").replace("\n", ""))
    pattern = rf"[^\r\n{inside}]*[{inside}]|[^\r\n{inside}]+" if inside else r"[^\r\n]+"
    return [p for p in (m.strip() for m in re.findall(pattern, text)) if p]


def fixed_chunks(text: str, limit: int) -> list[str]:
    """Hard cuts whenever the visible count reaches the limit, in one pass."""
    if visible(text) <= limit:
        return [text]
    out, start, seen = [], 0, 0
    for i, c in enumerate(text):
        if _VISIBLE.match(c):
            seen += 1
        if seen >= limit:
            out.append(text[start : i + 1].strip())
            start, seen = i + 1, 0
    rest = text[start:].strip()
    return out + [rest] if rest else out


def pack_soft(text: str, limit: int, soft: str) -> list[str]:
    """An oversized piece: parts at soft delimiters joined up to the limit, hard cuts where one part is too long."""
    out, held, size = [], "", 0
    for part in split_after(text, soft):
        n = visible(part)
        if held and size + n > limit:
            out += fixed_chunks(held, limit)
            held, size = part, n
        else:
            held, size = held + part, size + n
    return out + (fixed_chunks(held, limit) if held else [])


def merge_short(parts: list[str], limit: int) -> list[str]:
    out: list[str] = []
    for part in map(str.strip, parts):
        if out and out[-1] and (min(visible(out[-1]), visible(part)) < SHORT) and visible(out[-1] + part) <= limit:
            out[-1] = (out[-1] + part).strip()
        elif out and not out[-1]:
            out[-1] = part
        else:
            out.append(part)
    return [p for p in out if p]


def block_units(block: str | None, limit: int, sentence: str, soft: str) -> list[str]:
    text = clean(block)
    if not text:
        return []
    parts: list[str] = []
    for piece in split_after(text, sentence) or [text]:
        parts += [piece] if visible(piece) <= limit else pack_soft(piece, limit, soft)
    return merge_short(parts, limit)


UNITS = "block_no int, part_no int, text string"


def split_blocks(documents: DataFrame, keep: list[str], options: Options = Options()) -> DataFrame:
    """One row per unit of every document: the columns of `keep`, block_no, part_no, location and text.

    Blocks are numbered from 1, empty ones included; a null array or block gives no units. Settings are read from the
    columns max_unit_chars, sentence_delimiters and soft_delimiters if the documents have them (null or empty: the
    defaults), else from the options.
    """
    has = set(documents.columns)

    def setting(name: str, default) -> Column:
        if name not in has:
            return F.lit(default)
        value = F.col(name)
        return F.coalesce(F.nullif(value, F.lit("")) if isinstance(default, str) else value, F.lit(default))

    names = {"max_unit_chars": options.max_unit_chars, "sentence_delimiters": options.sentence_delimiters or SENTENCE, "soft_delimiters": options.soft_delimiters or SOFT}
    rows = documents.select(*keep, F.posexplode("blocks").alias("block_at", "block"), *(setting(k, v).alias(f"_{k}") for k, v in names.items()))
    rows = rows.withColumn("block_no", F.col("block_at") + 1).filter("block is not null and block <> ''")
    types = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), UNITS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [block_units(b, int(m), s, w) for b, m, s, w in zip(batch["block"], batch["_max_unit_chars"], batch["_sentence_delimiters"], batch["_soft_delimiters"])]
            out = batch[[*keep, "block_no"]].assign(text=parts, part_no=[list(range(1, len(p) + 1)) for p in parts])
            yield out.explode(["text", "part_no"]).dropna(subset=["part_no"]).astype({"part_no": "int32"})[[*keep, "block_no", "part_no", "text"]]

    units = rows.select(*keep, "block_no", "block", *(f"_{k}" for k in names)).mapInPandas(run, schema)
    return units.withColumn("location", F.format_string("段%d.%d", "block_no", "part_no"))


def _split_units(blocks: pd.Series, limits: pd.Series, sentence: pd.Series, soft: pd.Series) -> pd.Series:
    return pd.Series([block_units(b or "", int(m) if pd.notna(m) else Options().max_unit_chars, s or SENTENCE, w or SOFT) for b, m, s, w in zip(blocks, limits, sentence, soft)])


#: split_units(block, max_unit_chars, sentence_delimiters, soft_delimiters); nulls stand for the defaults.
split_units = F.pandas_udf(_split_units, ArrayType(StringType()))


def build_units(documents: DataFrame, options: Options = Options()) -> DataFrame:
    """The units table of documents (doc_id, group_index, group_name, file_path, file_name, blocks): text, comparison
    form, counts, comparability, n-grams, id and reading position."""
    keep = ["doc_id", "group_index", "group_name", "file_path", "file_name"]
    units = split_blocks(documents, keep, options)
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no", "part_no"))
    units = units.withColumn("unit_seq", seq).withColumn("normalized", compare_form(nfkc("text")))
    units = units.withColumn("char_count", visible_chars(F.col("text"))).withColumn("word_count", latin_words(F.col("text"))).withColumn("comparable", comparable(F.col("text"), options.min_chars, options.min_words))
    units = units.withColumn("unit_id", unit_id(F.col("group_name"), F.col("file_path"), F.col("location"), F.col("unit_seq"), F.col("normalized")))
    return units.withColumn("ngrams", F.when(F.col("comparable"), ngrams(F.col("normalized"), options.ngram_size)).otherwise(F.array().cast("array<string>")))


def hard_pieces(text: Column) -> Column:
    """The native part of segmentation: pieces at line ends and default hard delimiters, each with its delimiter."""
    pieces = F.regexp_extract_all(text, F.lit("([^。！？!?；;\\r\\n]*[。！？!?；;]|[^。！？!?；;\\r\\n]+)"), F.lit(1))
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, "^[ \\t\\u00a0\\u3000]+|[ \\t\\u00a0\\u3000]+$", "")), lambda p: p != "")
