"""Options and run configuration: defaults, clamping and validation on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

#: Formats that can be read, and defaults of the delimiters.
EXTENSIONS = (".docx", ".doc", ".wps", ".pdf", ".md", ".txt")
SENTENCE = "。！？!?；;"
SOFT = "，,、：:"
EXCLUDE_GROUP = "排除文件"
TRUE_WORDS = {"1", "true", "yes", "y", "on", "是"}
OCR_WORDS = {"true": "always", "yes": "always", "on": "always", "1": "always", "always": "always", "auto": "auto", "false": "off", "no": "off", "off": "off", "0": "off", "none": "off"}
PRESETS = ("china_mobile", "china_id_card", "email", "china_address")


def supported_extensions() -> tuple[str, ...]:
    """The readable suffixes; an environment switch takes PDF out."""
    off = os.environ.get("TEXTLOOM_DISABLE_PDF", "").strip().lower() in TRUE_WORDS
    return tuple(e for e in EXTENSIONS if not (off and e == ".pdf"))


def truthy(value: Any) -> bool:
    return value.strip().lower() in TRUE_WORDS if isinstance(value, str) else bool(value)


def _whole(value: Any, least: int) -> int:
    return max(least, int(value))


def _share(value: Any) -> float:
    try:
        return min(1.0, max(0.1, float(value)))
    except (TypeError, ValueError):
        return 0.1


@dataclass(frozen=True)
class Options:
    """Settings of a run; `from_dict` ignores unknown keys and nulls, clamps numbers and rejects unknown modes."""

    min_chars: int = 10
    min_words: int = 8
    similarity_threshold: float = 0.78
    exclude_threshold: float = 0.86
    ngram_size: int = 3
    max_unit_chars: int = 420
    max_candidates_per_unit: int = 200
    max_ngram_postings: int = 300
    image_ahash_distance: int = 6
    sentence_delimiters: str = SENTENCE
    soft_delimiters: str = SOFT
    similarity_backend: str = "local_ngrams"
    legacy_conversion_timeout: int = 120
    soffice_path: str = ""
    pdf_ocr_mode: str = "auto"
    pdf_ocr_lang: str = "ch"
    pdf_ocr_engine: str = "onnxruntime"
    pdf_ocr_det_model: str = "PP-OCRv6_medium_det"
    pdf_ocr_rec_model: str = "PP-OCRv6_medium_rec"
    pdf_min_text_chars: int = 20

    def __post_init__(self) -> None:
        floors = {"min_chars": 1, "min_words": 1, "ngram_size": 2, "max_unit_chars": 80, "max_candidates_per_unit": 0, "max_ngram_postings": 0, "image_ahash_distance": 0, "legacy_conversion_timeout": 10, "pdf_min_text_chars": 1}
        for name, least in floors.items():
            object.__setattr__(self, name, _whole(getattr(self, name), least))
        for name in ("similarity_threshold", "exclude_threshold"):
            object.__setattr__(self, name, _share(getattr(self, name)))
        object.__setattr__(self, "sentence_delimiters", self.sentence_delimiters or SENTENCE)
        object.__setattr__(self, "soft_delimiters", self.soft_delimiters or SOFT)
        backend = str(self.similarity_backend).strip().lower()
        if backend == "embedding":
            raise ValueError("similarity_backend 'embedding' is reserved and not available")
        if backend != "local_ngrams":
            raise ValueError(f"unknown similarity_backend: {self.similarity_backend}")
        object.__setattr__(self, "similarity_backend", backend)
        mode = OCR_WORDS.get(str(self.pdf_ocr_mode).strip().lower())
        if mode is None:
            raise ValueError(f"unknown pdf_ocr_mode: {self.pdf_ocr_mode}")
        object.__setattr__(self, "pdf_ocr_mode", mode)
        object.__setattr__(self, "soffice_path", str(self.soffice_path).strip())

    @classmethod
    def from_dict(cls, raw: dict[str, Any] | None) -> Options:
        known = {f.name for f in fields(cls)} - {"max_candidates_per_unit", "max_ngram_postings"}
        return cls(**{k: v for k, v in (raw or {}).items() if k in known and v is not None})

    def to_dict(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("max_candidates_per_unit", "max_ngram_postings")}


@dataclass(frozen=True)
class Group:
    name: str
    files: tuple[str, ...]


@dataclass(frozen=True)
class Config:
    groups: tuple[Group, ...]
    exclude_files: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    regex_keywords: tuple[str, ...] = ()
    regex_presets: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(PRESETS, True))
    options: Options = field(default_factory=Options)


def load_config(path: str | Path) -> dict[str, Any]:
    """The JSON configuration with relative paths resolved against its own directory."""
    path = Path(path).expanduser().resolve()
    raw = json.loads(path.read_text(encoding="utf-8"))
    at = lambda p: str((path.parent / Path(p).expanduser()).resolve())
    for group in raw.get("groups") or []:
        group["files"] = [at(p) for p in group.get("files") or []]
    raw["exclude_files"] = [at(p) for p in raw.get("exclude_files") or []]
    return raw


def normalize_config(raw: dict[str, Any]) -> Config:
    """Groups without files go, blank names are numbered, `re:` keywords become patterns, presets default to on."""
    groups = []
    for k, g in enumerate(raw.get("groups") or [], start=1):
        files = tuple(str(f) for f in g.get("files") or [])
        if files:
            groups.append(Group(str(g.get("name") or "").strip() or f"公司{k}", files))
    if len(groups) < 2:
        raise ValueError("at least two groups with files are needed")
    plain, patterns = [], []
    for item in map(str, raw.get("keywords") or []):
        item = item.strip()
        if item.startswith("re:"):
            patterns.append(item[3:].strip())
        elif item:
            plain.append(item)
    patterns += [str(x).strip().removeprefix("re:") for x in raw.get("regex_keywords") or []]
    presets = raw.get("regex_presets")
    if presets is not None and not isinstance(presets, dict):
        raise ValueError("regex_presets must be an object of names and switches")
    switched = {k: truthy((presets or {}).get(k, True)) for k in PRESETS}
    return Config(tuple(groups), tuple(map(str, raw.get("exclude_files") or [])), tuple(plain), tuple(dict.fromkeys(p for p in patterns if p)), switched, Options.from_dict(raw.get("options")))
