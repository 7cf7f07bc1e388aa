"""Sinks: tables as parquet, result.json, a sampled ai_summary.json, report.html and a page for each pair of groups."""

from __future__ import annotations

import html
import json
import re
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import highlight
from textloom.operators import summary
from textloom.plans.engine import CheckResult

#: How much of each kind the sampled summary and the report show.
LIMITS = {"active": (20, 160), "excluded": (8, 80), "hits": 10, "images": 30, "text": 320, "keyword_rows": 5, "metadata_rows": 8}
SCHEMA = "textloom.ai_summary.v1"
MATCH_COLUMNS = ["match_id", "unit_id_a", "unit_id_b", "group_a", "group_b", "file_a", "file_b", "location_a", "location_b", "text_a", "text_b", "similarity", "excluded", "exclude_reason"]
STYLE = "body{font-family:sans-serif;margin:2em;color:#222}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:4px 8px;vertical-align:top}mark{background:#ffe08a}.cards{display:flex;flex-wrap:wrap;gap:1em}.card{border:1px solid #ccc;border-radius:6px;padding:8px 14px}.card b{display:block;font-size:1.4em}.sides{display:flex;gap:1em}.side{flex:1}.unit{padding:3px;margin:2px 0}.badge{background:#333;color:#fff;border-radius:8px;padding:0 6px;font-size:.8em;margin-left:4px}.excluded{opacity:.7}"
SCRIPT = "function f(){var n=document.getElementById('n').value.toLowerCase(),lo=+document.getElementById('lo').value,hi=+document.getElementById('hi').value,x=document.getElementById('x').checked;document.querySelectorAll('tr[data-name]').forEach(function(r){var s=+r.dataset.max*100,only=r.dataset.count==='0'&&r.dataset.excluded!=='0';r.style.display=(!n||r.dataset.name.toLowerCase().indexOf(n)>=0)&&s>=lo&&s<=hi&&(x||!only)?'':'none'})}"


def _plain(value: Any) -> Any:
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def rows(df: DataFrame) -> list[dict]:
    """Rows a partition at a time, so the driver never holds more than one partition beside the result."""
    return [_plain(r) for r in df.toLocalIterator()]


def safe_name(text: str, taken: set[str]) -> str:
    """A file name of letters, digits and `_`, 120 at most, made unique."""
    base = re.sub(r"_+", "_", re.sub(r"[^\w]", "_", text)).strip("_")[:120] or "pair"
    name, k = base, 2
    while name in taken:
        name, k = f"{base}_{k}", k + 1
    taken.add(name)
    return name


def percent(value: float | None) -> str:
    return f"{(value or 0) * 100:.2f}%"


def short(text: str | None, limit: int = LIMITS["text"]) -> str:
    flat = " ".join((text or "").split())
    if len(flat) <= limit:
        return flat
    head = max(1, limit // 2 - 8)
    return f"{flat[:head]} ... {flat[-max(1, limit - head - 5):]}"


def _match(m: dict) -> dict:
    return m | {"similarity": round(m["similarity"], 4)}


def result_document(r: CheckResult) -> dict:
    """The whole result, nothing cut."""
    units = r.units.select("doc_id", "unit_id", "location", "text", "normalized", "char_count", "word_count", "comparable", "unit_seq").orderBy("doc_id", "unit_seq")
    by_doc: dict[int, list[dict]] = {}
    for u in rows(units):
        by_doc.setdefault(u.pop("doc_id"), []).append(u)
    documents, excludes = [], []
    for d in rows(r.documents.select("doc_id", "group_index", "group_name", "file_path", "file_name", "metadata", F.size("images").alias("image_count")).orderBy("doc_id")):
        own = by_doc.get(d["doc_id"], [])
        able = sum(u["comparable"] for u in own)
        entry = {k: d[k] for k in ("group_name", "file_path", "file_name", "metadata")} | {"units": own, "unit_count": len(own), "comparable_unit_count": able, "short_filtered_unit_count": len(own) - able, "image_count": d["image_count"]}
        (documents if d["group_index"] >= 0 else excludes).append(entry)
    c = r.config
    pairs = [p | {"max_similarity": round(p["max_similarity"], 4), "avg_similarity": round(p["avg_similarity"], 4)} for p in rows(r.pair_summaries)]
    pairs.sort(key=lambda p: (-p["match_count"], -p["max_similarity"], p["group_a"], p["group_b"]))
    matches = [_match(m) for m in rows(r.matches.orderBy("excluded", F.desc("similarity"), "group_a", "group_b", "match_id").select(*MATCH_COLUMNS))]
    return {
        "generated_at": datetime.now().isoformat(timespec="seconds"),
        "input": {"groups": [{"name": g.name, "files": list(g.files)} for g in c.groups], "exclude_files": list(c.exclude_files), "keywords": list(c.keywords), "regex_keywords": list(c.regex_keywords), "regex_presets": c.regex_presets},
        "options": c.options.to_dict(),
        "stats": r.stats,
        "stage_seconds": r.stage_seconds,
        "documents": documents,
        "exclude_documents": excludes,
        "pair_summaries": pairs,
        "matches": matches,
        "keyword_alerts": rows(r.keyword_alerts.select("keyword", "is_regex", "pattern", "groups", "hits", "matched_text")),
        "keyword_errors": r.keyword_errors,
        "metadata_alerts": rows(r.metadata_alerts),
        "image_duplicates": rows(r.image_duplicates),
    }


def _sampled(samples: list[dict], total: int) -> dict:
    return {"total_count": total, "sample_count": len(samples), "omitted_count": max(0, total - len(samples)), "samples": samples}


def ai_summary(r: CheckResult, document: dict, output_files: dict[str, Any] | None = None) -> dict:
    """A sampled digest for programs: what was found with capped evidence, how much of it is left out, and the caps."""
    evidence: dict[str, Any] = {}
    shown = ("match_id", "group_a", "group_b", "file_a", "file_b", "location_a", "location_b")
    for name, kind, excluded in (("similar_text", "active", False), ("excluded_text", "excluded", True)):
        per_pair, total = LIMITS[kind]
        kept = rows(summary.sampled(r.matches.filter(F.col("excluded") == excluded), [], per_pair, total).orderBy(F.desc("similarity"), "match_id"))
        samples = [{k: m[k] for k in shown} | {"similarity": round(m["similarity"], 4), "text_a": short(m["text_a"]), "text_b": short(m["text_b"]), "exclude_reason": m["exclude_reason"]} for m in kept]
        evidence[name] = _sampled(samples, sum(m["excluded"] == excluded for m in document["matches"]))
    few = lambda a: a | {"hit_count": len(a["hits"]), "omitted_hits": max(0, len(a["hits"]) - LIMITS["hits"]), "hits": a["hits"][: LIMITS["hits"]]}
    for name in ("keyword_alerts", "metadata_alerts"):
        evidence[name] = _sampled([few(a) for a in document[name]], len(document[name]))
    pictures = [{"kind": d["kind"], "distance": d["distance"], "images": [{k: i[k] for k in ("group_name", "file_name", "image_id", "source")} for i in d["images"]]} for d in document["image_duplicates"][: LIMITS["images"]]]
    evidence["image_duplicates"] = _sampled(pictures, len(document["image_duplicates"]))
    has = {f"has_{k}": bool(document["stats"][n]) for k, n in (("similar_matches", "similar_match_count"), ("keyword_alerts", "keyword_alert_count"), ("metadata_alerts", "metadata_alert_count"), ("image_duplicates", "image_duplicate_count"))}
    caps = {f"{name}_{what}": n for name, kind in (("similar_text", "active"), ("excluded_text", "excluded")) for what, n in zip(("per_pair", "total"), LIMITS[kind])}
    caps |= {"keyword_hits_per_rule": LIMITS["hits"], "metadata_hits_per_alert": LIMITS["hits"], "image_duplicate_groups": LIMITS["images"], "text_chars_per_side": LIMITS["text"]}
    return {
        "schema": SCHEMA,
        "purpose": "摘要：判断各组之间是否有重复文本、共享关键词、相同元数据或重复图片；全部结果见 result.json，对照页见 report.html。",
        "generated_at": document.get("generated_at", ""),
        "stats": document["stats"] | has,
        "output_files": output_files or {},
        "options": document["options"],
        "pair_summaries": document["pair_summaries"],
        "evidence": evidence,
        "limits": caps,
    }


def _grid(head: list[str], body: list[list[str]], attributes: list[str] | None = None) -> str:
    lines = "".join(f"<tr {attributes[k] if attributes else ''}>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for k, row in enumerate(body))
    return f"<table><tr>{''.join(f'<th>{h}</th>' for h in head)}</tr>{lines}</table>"


def _e(x: Any) -> str:
    return html.escape(str(x if x is not None else ""))


def report_page(document: dict, pages: dict[tuple[str, str], str]) -> str:
    s = document["stats"]
    cards = "".join(f'<div class="card">{_e(k)}<b>{_e(s[k])}</b></div>' for k in ("group_count", "document_count", "unit_count", "comparable_unit_count", "similar_match_count", "excluded_match_count", "keyword_alert_count", "metadata_alert_count", "image_duplicate_count"))
    pair_rows, attributes = [], []
    for p in document["pair_summaries"]:
        page = pages.get((p["group_a"], p["group_b"]))
        title = f"{_e(p['group_a'])} / {_e(p['group_b'])}"
        pair_rows.append([f'<a href="{page}">{title}</a>' if page else title, str(p["match_count"]), str(p["excluded_count"]), percent(p["max_similarity"]), percent(p["avg_similarity"]), _e(", ".join(p["files"]))])
        attributes.append(f'data-name="{title}" data-max="{p["max_similarity"]}" data-count="{p["match_count"]}" data-excluded="{p["excluded_count"]}"')
    controls = '<p><input id="n" oninput="f()" placeholder="group"> <input id="lo" type="number" value="0" oninput="f()">–<input id="hi" type="number" value="100" oninput="f()">% <label><input id="x" type="checkbox" checked onchange="f()">excluded only</label></p>'
    words = _grid(["rule", "value", "groups", "hits"], [[_e(a["keyword"]), _e(a["matched_text"]), _e(", ".join(a["groups"])), "<br>".join(_e(f"{h['group_name']} {h['file_name']} {h['location']}: {h['snippet']}") for h in a["hits"][: LIMITS["keyword_rows"]])] for a in document["keyword_alerts"]])
    meta = _grid(["level", "field", "value", "groups", "files"], [[_e(a["level"]), _e(a["label"]), _e(a["value"]), _e(", ".join(a["groups"])), "<br>".join(_e(f"{h['group_name']} {h['file_name']}") for h in a["hits"][: LIMITS["metadata_rows"]])] for a in document["metadata_alerts"]])
    pictures = _grid(["kind", "distance", "images"], [[_e(d["kind"]), str(d["distance"]), "<br>".join(_e(f"{i['group_name']} {i['image_id']}") for i in d["images"])] for d in document["image_duplicates"]])
    cards_of: dict[tuple[str, str], list[str]] = {}
    for m in document["matches"]:
        left, right = highlight(m["text_a"] or "", m["text_b"] or "")
        kind = "match excluded" if m["excluded"] else "match"
        cards_of.setdefault((m["group_a"], m["group_b"]), []).append(f'<div class="{kind}"><p>{_e(m["match_id"])} {percent(m["similarity"])} {_e(m["exclude_reason"])}</p><div class="sides"><div class="side">{_e(m["file_a"])} {_e(m["location_a"])}<br>{left}</div><div class="side">{_e(m["file_b"])} {_e(m["location_b"])}<br>{right}</div></div></div>')
    details = "".join(f"<details><summary>{_e(a)} / {_e(b)} ({len(c)})</summary>{''.join(c)}</details>" for (a, b), c in cards_of.items())
    options = _grid(["option", "value"], [[_e(k), _e(v)] for k, v in document["options"].items()])
    times = _grid(["stage", "seconds"], [[_e(k), f"{v:.2f}"] for k, v in document["stage_seconds"].items()])
    parts = [f"<h1>Cross-group check</h1><p>{_e(document['generated_at'])}</p>", f'<div class="cards">{cards}</div>', times, options, "<h2>Pairs</h2>", controls, _grid(["pair", "matches", "excluded", "max", "avg", "files"], pair_rows, attributes), "<h2>Keywords</h2>", words, "<h2>Metadata</h2>", meta, "<h2>Images</h2>", pictures, "<h2>Matches</h2>", details]
    return f'<!doctype html><html><head><meta charset="utf-8"><title>Report</title><style>{STYLE}</style><script>{SCRIPT}</script></head><body>{"".join(parts)}</body></html>'


def alpha(similarity: float, excluded: bool) -> float:
    """How strongly a unit is tinted."""
    s = min(1.0, max(0.0, similarity))
    return 0.14 + 0.16 * s if excluded else 0.18 + 0.36 * s


def compare_page(document: dict, a: str, b: str) -> str:
    """Both groups' units side by side; a unit that matches links to what it matches, with a badge for several."""
    own = [m for m in document["matches"] if {m["group_a"], m["group_b"]} == {a, b}]
    refs: dict[str, list[tuple[str, float, bool]]] = {}
    for m in own:
        refs.setdefault(m["unit_id_a"], []).append((m["unit_id_b"], m["similarity"], m["excluded"]))
        refs.setdefault(m["unit_id_b"], []).append((m["unit_id_a"], m["similarity"], m["excluded"]))
    sides = []
    for name in (a, b):
        parts = [f"<h2>{_e(name)}</h2>"]
        for d in document["documents"]:
            if d["group_name"] != name:
                continue
            parts.append(f"<h3>{_e(d['file_name'])}</h3>")
            for u in d["units"]:
                found = refs.get(u["unit_id"])
                if not found:
                    parts.append(f'<div class="unit" id="{u["unit_id"]}">{_e(u["text"])}</div>')
                    continue
                best, all_out = max(s for _, s, _ in found), all(x for _, _, x in found)
                colour = f"rgba({'120,120,120' if all_out else '255,140,0'},{alpha(best, all_out):.2f})"
                badge = f'<span class="badge">{len(found)}</span>' if len(found) > 1 else ""
                links = " ".join(f'<a href="#{t}">{percent(s)}</a>' for t, s, _ in found)
                parts.append(f'<div class="unit" id="{u["unit_id"]}" style="background:{colour}" data-targets="{" ".join(t for t, _, _ in found)}">{_e(u["text"])}{badge} {links}</div>')
        sides.append(f'<div class="side">{"".join(parts)}</div>')
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{_e(a)} / {_e(b)}</title><style>{STYLE}</style></head><body><div class="sides">{"".join(sides)}</div></body></html>'


def write_tables(r: CheckResult, folder: str) -> None:
    """The tables as parquet, for runs too large for a single JSON document."""
    for name in ("units", "matches", "keyword_alerts", "metadata_alerts", "image_duplicates", "pair_summaries"):
        getattr(r, name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_bundle(r: CheckResult, output_dir: str, tables: bool = False) -> dict[str, str]:
    """Pages of pairs, then the summary, the report and last result.json, written again with all sizes in it."""
    folder = Path(output_dir)
    folder.mkdir(parents=True, exist_ok=True)
    document = result_document(r)
    taken: set[str] = set()
    pages: dict[tuple[str, str], str] = {}
    for p in document["pair_summaries"]:
        if p["match_count"] or p["excluded_count"]:
            pages[p["group_a"], p["group_b"]] = f"{safe_name(f'compare_{p["group_a"]}_{p["group_b"]}', taken)}.html"
    by_pair: dict[tuple[str, str], list[dict]] = {k: [] for k in pages}
    for m in document["matches"]:
        for k in {(m["group_a"], m["group_b"]), (m["group_b"], m["group_a"])} & by_pair.keys():
            by_pair[k].append(m)
    for (a, b), page in pages.items():
        (folder / page).write_text(compare_page(document | {"matches": by_pair[a, b]}, a, b), encoding="utf-8")
    dump = lambda x: json.dumps(x, ensure_ascii=False, indent=2, default=str)
    files = {"ai_summary": "ai_summary.json", "report": "report.html", "result": "result.json"}
    document["output_files"] = {k: str(folder / v) for k, v in files.items()} | {"compare": [str(folder / p) for p in pages.values()]}
    (folder / files["ai_summary"]).write_text(dump(ai_summary(r, document, document["output_files"])), encoding="utf-8")
    (folder / files["report"]).write_text(report_page(document, pages), encoding="utf-8")
    for _ in range(2):  # the second time its own size is known
        (folder / files["result"]).write_text(dump(document), encoding="utf-8")
        document["output_bytes"] = {k: (folder / v).stat().st_size for k, v in files.items()}
    if tables:
        write_tables(r, str(folder / "tables"))
    return document["output_files"]
