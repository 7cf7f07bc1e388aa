"""Files of all formats as a table of documents, parsed where they are read."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.config import Group, Options, supported_extensions
from textloom.sources import docx, legacy, markdown, pdf, pictures

PICTURE = "image_id string, source string, sha256 string, ahash string, size bigint, width int, height int"
PARSED = f"ord bigint, metadata map<string,string>, blocks array<string>, images array<struct<{PICTURE.replace(' string', ':string').replace(' bigint', ':bigint').replace(' int', ':int')}>>, error string"
GROUPS = T.StructType([T.StructField("ord", T.LongType()), T.StructField("group_index", T.IntegerType()), T.StructField("group_name", T.StringType()), T.StructField("file_path", T.StringType())])


def validate(path: str) -> None:
    suffix = Path(path).suffix.lower()
    if not Path(path).exists():
        raise FileNotFoundError(path)
    if suffix not in supported_extensions():
        raise ValueError(f"unsupported format: {path}")


def _picture(image_id: str, source: str, content: bytes) -> dict:
    return {"image_id": image_id, "source": source} | pictures.describe(content)


def _markdown_pictures(raw: str, path: str) -> list[dict]:
    """Pictures a markdown file shows, relative to it; missing ones are skipped."""
    out, name = [], os.path.basename(path)
    for k, target in markdown.image_targets(raw):
        place = (Path(path).parent / target).resolve()
        if place.is_file():
            out.append(_picture(f"{name}:md-image{k}", str(place), place.read_bytes()))
    return out


def parse(content: bytes, path: str, options: Options, provider: pdf.Provider | None = None, convert: Callable[..., bytes] = legacy.convert) -> tuple[list[str], dict[str, str], list[dict]]:
    """(blocks, metadata, images) of one file by its suffix; anything that is no other format is read as markdown."""
    suffix, name = Path(path).suffix.lower(), os.path.basename(path)
    meta: dict[str, str] = {}
    if suffix in (".doc", ".wps"):
        content = convert(content, name, options.soffice_path, options.legacy_conversion_timeout)
        meta = {"converted_from": suffix, "converted_via": "docx"}
        suffix = ".docx"
    if suffix == ".docx":
        blocks, found, images = docx.read(content, name)
        return blocks, found | meta, [_picture(*i) for i in images]
    if suffix == ".pdf":
        blocks, found = pdf.read(content, options.pdf_ocr_mode, options.pdf_min_text_chars, provider)
        return blocks, found, []
    text = markdown.decode(content)
    if suffix == ".txt":
        return markdown.text_blocks(text), {}, []
    return markdown.markdown_blocks(text), {}, _markdown_pictures(text, path)


def group_table(spark: SparkSession, groups: tuple[Group, ...], excludes: tuple[str, ...] = (), exclude_name: str = "排除文件") -> DataFrame:
    rows = [(g, name, os.path.abspath(p)) for g, (name, files) in enumerate((x.name, x.files) for x in groups) for p in files]
    rows += [(-1, exclude_name, os.path.abspath(p)) for p in excludes]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], GROUPS)


def read_documents(spark: SparkSession, groups: tuple[Group, ...], excludes: tuple[str, ...] = (), options: Options = Options(), provider: pdf.Provider | None = None, strict: bool = True) -> DataFrame:
    """(doc_id, group_index, group_name, file_path, file_name, metadata, blocks, images, error), one row per listed file.

    Files are read by Spark's binaryFile source and parsed on the executors, once each however often they are listed.
    Missing files and unknown formats fail at once; with `strict` so does the first file that can't be parsed, else it
    comes out with its error and without blocks.
    """
    listed = group_table(spark, groups, excludes)
    paths = sorted({os.path.abspath(p) for g in groups for p in g.files} | {os.path.abspath(p) for p in excludes})
    for p in paths:
        validate(p)
    settings = asdict(options)
    raw = spark.read.format("binaryFile").load([re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths])  # names as they are, not patterns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = Options(**settings)
        for batch in batches:
            out = []
            for path, content, size, changed in zip(batch["path"], batch["content"], batch["length"], batch["modificationTime"]):
                local = re.sub("^file:/+", "/", path)
                base = {"path": local, "name": os.path.basename(local), "size": str(size), "modified_time": changed.isoformat(timespec="seconds")}
                try:
                    blocks, meta, images = parse(content, local, wanted, provider)
                    out.append((local, base | meta, blocks, images, None))
                except Exception as e:
                    if strict:
                        raise
                    out.append((local, base, [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["file_path", "metadata", "blocks", "images", "error"])

    parsed = raw.select("path", "content", "length", "modificationTime").mapInPandas(run, PARSED.replace("ord bigint", "file_path string"))
    return listed.join(parsed, "file_path", "left").select(F.col("ord").alias("doc_id"), "group_index", "group_name", "file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"), "metadata", "blocks", "images", "error")


def image_table(documents: DataFrame) -> DataFrame:
    """One row per picture, with a unique `ord` in reading order."""
    rows = documents.select("doc_id", "group_name", "file_path", "file_name", F.posexplode("images").alias("_k", "i"))
    return rows.select("doc_id", "group_name", "file_path", "file_name", "i.*", F.format_string("%019d/%06d", "doc_id", "_k").alias("ord"))


def _parse(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
    out = []
    for path, content in zip(paths, contents):
        try:
            blocks, meta, _ = parse(bytes(content), path, Options())
            out.append((blocks, meta, None))
        except Exception as e:
            out.append(([], {}, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["blocks", "metadata", "error"])


#: parse_document(path, content): blocks and metadata by the suffix of the path, or the error.
parse_document = F.pandas_udf(_parse, T.StructType([T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())]))
