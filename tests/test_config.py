import json

import pytest

from textloom.config import Options, load_config, normalize_config, supported_extensions


def groups(*names):
    return [{"name": n, "files": [f"/x/{k}.txt"]} for k, n in enumerate(names)]


def test_numbers_are_clamped_and_nulls_ignored():
    o = Options.from_dict({"min_chars": 0, "ngram_size": 1, "max_unit_chars": 5, "similarity_threshold": 7, "exclude_threshold": "x", "unknown": 1, "min_words": None})
    assert (o.min_chars, o.ngram_size, o.max_unit_chars, o.similarity_threshold, o.exclude_threshold, o.min_words) == (1, 2, 80, 1.0, 0.1, 8)


def test_hidden_bounds_cannot_be_set():
    assert Options.from_dict({"max_ngram_postings": 1, "max_candidates_per_unit": 1}).max_ngram_postings == 300


@pytest.mark.parametrize("raw,mode", [("Yes", "always"), ("0", "off"), ("auto", "auto"), (True, "always"), (False, "off")])
def test_ocr_modes(raw, mode):
    assert Options.from_dict({"pdf_ocr_mode": raw}).pdf_ocr_mode == mode


@pytest.mark.parametrize("raw", [{"similarity_backend": "embedding"}, {"similarity_backend": "x"}, {"pdf_ocr_mode": "maybe"}])
def test_unknown_modes_fail(raw):
    with pytest.raises(ValueError):
        Options.from_dict(raw)


def test_groups_and_keywords():
    c = normalize_config({"groups": [*groups("a", ""), {"name": "none", "files": []}], "keywords": ["甲", "re:x+", " "], "regex_keywords": ["re:x+", "y"], "regex_presets": {"email": "否"}})
    assert [g.name for g in c.groups] == ["a", "公司2"]
    assert c.keywords == ("甲",) and c.regex_keywords == ("x+", "y")
    assert c.regex_presets == {"china_mobile": True, "china_id_card": True, "email": False, "china_address": True}


def test_too_few_groups_and_bad_presets():
    with pytest.raises(ValueError):
        normalize_config({"groups": groups("a")})
    with pytest.raises(ValueError):
        normalize_config({"groups": groups("a", "b"), "regex_presets": [1]})


def test_paths_resolve_against_the_config(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.json").write_text(json.dumps({"groups": [{"name": "a", "files": ["../a.txt"]}], "exclude_files": ["t.md"]}), encoding="utf-8")
    raw = load_config(tmp_path / "sub" / "c.json")
    assert raw["groups"][0]["files"] == [str(tmp_path / "a.txt")] and raw["exclude_files"] == [str(tmp_path / "sub" / "t.md")]


def test_pdf_can_be_switched_off(monkeypatch):
    assert ".pdf" in supported_extensions()
    monkeypatch.setenv("TEXTLOOM_DISABLE_PDF", "1")
    assert ".pdf" not in supported_extensions()
