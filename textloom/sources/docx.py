"""Word files, read with the standard library: blocks, properties and pictures."""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
from datetime import datetime
from xml.etree import ElementTree as ET

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Properties of docProps/core.xml and app.xml beside the names they get.
CORE = {"creator": "author", "lastModifiedBy": "last_modified_by", "created": "created", "modified": "modified", "revision": "revision", "title": "title", "subject": "subject"}
APP = {"Company": "company", "Manager": "manager"}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


#: What floats beside the text (boxes, drawings and their stand-ins) is no part of a paragraph.
FLOATING = {"AlternateContent", "pict", "drawing", "object", "txbxContent"}
_MARKS = {"tab": "\t", "br": "\n", "cr": "\n"}


def _paragraph(p: ET.Element) -> str:
    kind = _local(p.tag)
    if kind in FLOATING:
        return ""
    return (p.text or "") if kind == "t" else _MARKS.get(kind) or "".join(map(_paragraph, p))


def _cells(row: ET.Element, above: list[str]) -> list[str]:
    """The texts of a row's cells; a cell over several columns stands once for each, one merged down repeats the text
    above it."""
    out: list[str] = []
    for cell in row.findall(f"{W}tc"):
        span, down = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
        wide = int(span.get(f"{W}val", "1")) if span is not None else 1
        if down is not None and down.get(f"{W}val", "continue") == "continue" and len(above) > len(out):
            text = above[len(out)]
        else:
            text = "\n".join(_paragraph(p) for p in cell.findall(f"{W}p")).strip().replace("\n", " ")
        out += [text] * wide
    return out


def blocks(archive: zipfile.ZipFile) -> list[str]:
    """Paragraphs of the body first, then one block for each row of its tables, empty cells left out."""
    body = ET.fromstring(archive.read("word/document.xml")).find(f"{W}body")
    if body is None:
        return []
    out = [t for t in (_paragraph(p).strip() for p in body.findall(f"{W}p")) if t]
    for k, grid in enumerate(body.findall(f"{W}tbl"), start=1):
        cells: list[str] = []
        for r, row in enumerate(grid.findall(f"{W}tr"), start=1):
            cells = _cells(row, cells)
            if any(cells):
                out.append(f"表{k} 行{r}: " + " | ".join(c for c in cells if c))
    return out


def _seconds(value: str) -> str:
    try:
        return datetime.fromisoformat(value.replace("Z", "+00:00")).replace(tzinfo=None).isoformat(timespec="seconds")
    except ValueError:
        return value


def properties(archive: zipfile.ZipFile) -> dict[str, str]:
    """Core and extended properties; a missing or broken part gives none."""
    out: dict[str, str] = {}
    for part, names in (("docProps/core.xml", CORE), ("docProps/app.xml", APP)):
        try:
            root = ET.fromstring(archive.read(part))
        except (KeyError, ET.ParseError):
            continue
        for node in root:
            name = names.get(_local(node.tag))
            if name and node.text and node.text.strip():
                value = node.text.strip()
                out[name] = _seconds(value) if name in ("created", "modified") else value
    return out


def pictures(archive: zipfile.ZipFile, file_name: str) -> list[tuple[str, str, bytes]]:
    """(image_id, source, content) of the document's image parts, each content once; ids count all relationships."""
    try:
        rels = ET.fromstring(archive.read("word/_rels/document.xml.rels"))
    except (KeyError, ET.ParseError):
        return []
    seen, out = set(), []
    for k, rel in enumerate(rels.findall(f"{REL}Relationship"), start=1):
        if "image" not in rel.get("Type", "") or rel.get("TargetMode") == "External":
            continue
        target = rel.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("word", target))
        try:
            content = archive.read(path)
        except KeyError:
            continue
        key = hashlib.sha256(content).digest()
        if key not in seen:
            seen.add(key)
            out.append((f"{file_name}:image{k}", path, content))
    return out


def read(content: bytes, file_name: str) -> tuple[list[str], dict[str, str], list[tuple[str, str, bytes]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return blocks(archive), properties(archive), pictures(archive, file_name)
