"""Whole runs over files that the tests write."""

import json
import struct
import zipfile
import zlib

import pytest

from textloom import cli
from textloom.config import Group, Options, normalize_config
from textloom.plans.engine import check
from textloom.sources import discovery, docx, files, legacy, markdown, pdf, pictures

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHARED = "本项目采用分段吊装与同步顶升相结合的施工工艺并由专人全程旁站监督记录"
TENDER = "投标人须在开标前三个工作日内以书面形式向招标代理机构提出全部澄清问题"


def png(value=0, side=16):
    raw = b"".join(b"\x00" + bytes((255 if x * 2 < side else value) for x in range(side) for _ in range(3)) for _ in range(side))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def write_docx(path, paragraphs, table=None, core=None, company=None, image=None):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    for row in table or []:
        body += "<w:tbl><w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        props = "".join(f"<{k}>{v}</{k}>" for k, v in (core or {}).items())
        z.writestr("docProps/core.xml", f"<p>{props}</p>")
        if company:
            z.writestr("docProps/app.xml", f"<p><Company>{company}</Company></p>")
        if image:
            rel = '<Relationship Id="r1" Type="http://x/styles" Target="styles.xml"/>' + "".join(f'<Relationship Id="i{k}" Type="http://x/image" Target="media/i{k}.png"/>' for k in range(2))
            z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rel}</Relationships>')
            for k in range(2):
                z.writestr(f"word/media/i{k}.png", image)


@pytest.fixture(scope="module")
def case(tmp_path_factory):
    d = tmp_path_factory.mktemp("case")
    write_docx(d / "a.docx", ["目录", SHARED + "。", TENDER + "。", "关键词 红外测温"], core={"creator": "王工", "created": "2024-05-01T10:20:05Z"}, company="某公司", image=png())
    (d / "p.png").write_bytes(png())
    (d / "b.md").write_text(f"# 目录\n\n**{SHARED.replace('专人', '专员')}**。\n\n> {TENDER}。\n\n红外测温 13812345678\n\n![图](p.png)\n", encoding="utf-8")
    (d / "c.txt").write_text("# 保留的标记\n红外测温 13812345678\n", encoding="gb18030")
    (d / "t.md").write_text(TENDER + "。", encoding="utf-8")
    return d


def config(d):
    return {"groups": [{"name": "甲", "files": [str(d / "a.docx")]}, {"name": "乙", "files": [str(d / "b.md")]}, {"name": "丙", "files": [str(d / "c.txt")]}], "exclude_files": [str(d / "t.md")], "keywords": ["红外测温"], "options": {"min_chars": 20}}


def test_end_to_end(spark, case, tmp_path):
    said = []
    r = check(spark, config(case), str(tmp_path / "out"), said.append)
    got = {(m["text_a"][:4], m["excluded"]) for m in r.matches.collect()}
    assert got == {(SHARED[:4], False), (TENDER[:4], True)}
    result = json.loads((tmp_path / "out/result.json").read_text(encoding="utf-8"))
    assert result["stats"]["similar_match_count"] == 1 and result["stats"]["excluded_match_count"] == 1
    assert result["stats"]["keyword_alert_count"] == 2 and result["stats"]["image_duplicate_count"] == 1
    ids = {u["unit_id"] for d in result["documents"] for u in d["units"]}
    assert all(m["unit_id_a"] in ids and m["unit_id_b"] in ids for m in result["matches"])
    assert {"parse_documents", "similarity", "keywords", "metadata", "images", "report"} <= set(r.stage_seconds) and "similarity" in said
    page = (tmp_path / "out/report.html").read_text(encoding="utf-8")
    assert "https://" not in page and "compare_" in page
    digest = json.loads((tmp_path / "out/ai_summary.json").read_text(encoding="utf-8"))
    assert set(digest["evidence"]) == {"similar_text", "excluded_text", "keyword_alerts", "metadata_alerts", "image_duplicates"} and digest["limits"]["text_chars_per_side"] == 320
    assert all(e["total_count"] == e["sample_count"] + e["omitted_count"] == len(e["samples"]) + e["omitted_count"] for e in digest["evidence"].values()) and digest["output_files"]["result"]
    assert (tmp_path / "out/ai_summary.json").stat().st_size < (tmp_path / "out/result.json").stat().st_size
    assert len(list((tmp_path / "out").glob("compare_*.html"))) == 1


def test_command_line(spark, case, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps(config(case)), encoding="utf-8")
    assert cli.main(["--config", str(tmp_path / "c.json"), "--output", str(tmp_path / "o"), "--quiet"]) == 0
    assert (tmp_path / "o/result.json").exists()
    (tmp_path / "bad.json").write_text(json.dumps({"groups": []}), encoding="utf-8")
    assert cli.main(["--config", str(tmp_path / "bad.json")]) == 2
    assert "错误" in capsys.readouterr().err


def test_pdf_is_refused_when_off(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("TEXTLOOM_DISABLE_PDF", "1")
    for n in "ab":
        (tmp_path / f"{n}.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.json").write_text(json.dumps({"groups": [{"name": n, "files": [f"{n}.pdf"]} for n in "ab"]}), encoding="utf-8")
    assert cli.main(["--config", str(tmp_path / "c.json")]) == 2


def test_missing_and_unknown_files(tmp_path):
    with pytest.raises(FileNotFoundError):
        files.validate(str(tmp_path / "x.md"))
    (tmp_path / "x.xyz").write_text("a")
    with pytest.raises(ValueError):
        files.validate(str(tmp_path / "x.xyz"))


def test_broken_file_without_strict(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"no zip")
    (tmp_path / "b.txt").write_text("text", encoding="utf-8")
    rows = files.read_documents(spark, (Group("a", (str(tmp_path / "a.docx"),)), Group("b", (str(tmp_path / "b.txt"),))), strict=False).orderBy("doc_id").collect()
    assert rows[0]["error"] and rows[0]["blocks"] == [] and rows[1]["error"] is None and rows[1]["blocks"] == ["text"]


def test_docx(tmp_path):
    write_docx(tmp_path / "a.docx", ["x"], table=[["单价", "", "12"]], core={"creator": "a", "lastModifiedBy": "b", "modified": "2024-01-01T00:00:01Z"}, company="c", image=png())
    blocks, meta, images = docx.read((tmp_path / "a.docx").read_bytes(), "a.docx")
    assert blocks == ["x", "表1 行1: 单价 | 12"] and meta["company"] == "c" and meta["modified"] == "2024-01-01T00:00:01"
    assert [i[0] for i in images] == ["a.docx:image2"]


def test_markdown_cleanup_and_plain_text():
    raw = "# 标题 #\n\n**粗** _斜_ ~~删~~ `code`\n- 项\n1. 条\n> 引\n| a | b |\n|---|---|\n[链](http://x)\n<b>t</b>\n```\nx\n```\n"
    assert [" ".join(b.split()) for b in markdown.markdown_blocks(raw)] == ["标题", "粗 斜 删", "项", "条", "引", "a b", "链", "t"]
    assert markdown.text_blocks("# 保留\r\n**x**") == ["# 保留", "**x**"]
    assert markdown.image_targets("![a](<x%20y.png>) ![b](http://h/i.png) ![c](d.png \"t\")") == [(1, "x y.png"), (3, "d.png")]
    assert markdown.decode("中文".encode("gb18030")) == "中文" and markdown.decode(b"\xef\xbb\xbfa\r\nb") == "a\nb"


def test_markup_pairs():
    pairs = {"_~__~__": "~~_", "# A **b** ##": "A b", "# ##": "##", "# - ##": "-", "> 1. x | y": "x y", "|---|---|": "", "a\tb": "a\tb", "***x***": "x", "__a__b_": "ab_", "[t](u)![i](p)`c`<b>": "t"}
    assert {raw: markdown.strip(raw) for raw in pairs} == pairs


def test_names_of_any_kind(spark, tmp_path):
    names = ["方案 一.txt", "a%20b.txt", "[x]{y}#z.txt"]
    for n in names:
        (tmp_path / n).write_text(f"内容 {n}", encoding="utf-8")
    got = files.read_documents(spark, (Group("甲", tuple(str(tmp_path / n) for n in names)),)).collect()
    assert {r["file_name"]: r["blocks"] for r in got} == {n: [f"内容 {n}"] for n in names}


def test_merged_cells_and_boxes():
    w = lambda inner: f'<w:p xmlns:w="{W}"><w:r>{inner}</w:r></w:p>'
    assert docx._paragraph(docx.ET.fromstring(w("<w:t>正文</w:t><w:pict><w:txbxContent><w:p><w:r><w:t>框</w:t></w:r></w:p></w:txbxContent></w:pict><w:tab/><w:t>尾</w:t>"))) == "正文\t尾"
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    row = lambda *cells: docx.ET.fromstring(f'<w:tr xmlns:w="{W}">{"".join(cells)}</w:tr>')
    first = docx._cells(row(cell("甲", '<w:vMerge w:val="restart"/>'), cell("乙", '<w:gridSpan w:val="2"/>')), [])
    assert first == ["甲", "乙", "乙"] and docx._cells(row(cell("", "<w:vMerge/>"), cell("丙"), cell("丁")), first) == ["甲", "丙", "丁"]


def test_recognised_texts_may_be_methods():
    class Page:
        def json(self):
            return {"rec_texts": ["第一行", "第二行"]}

    assert pdf.find_texts(Page()) == ["第一行", "第二行"]


def test_sql_functions(spark):
    from textloom.functions.text import register

    register(spark)
    got = spark.sql("select split_units('甲方提供图纸；乙方复核数据；丙方归档', null, null, null) u, parse_document('a.md', cast('# 标 **题**' as binary)).blocks b, parse_document('a.xyz', cast('x' as binary)).blocks c").first()
    assert len(got["u"]) == 3 and got["b"] == ["标 题"] and got["c"] == ["x"]


def test_pictures():
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + 12 * 4, 0, 0, 54, 40, 4, 4, 1, 24, 0, 48, 0, 0, 0, 0) + bytes([9, 8, 7] * 16)
    assert pictures.pixels(bmp).tolist() == [[[7, 8, 9]] * 4] * 4 and pictures.describe(bmp)["width"] == 4
    flat, step = pictures.describe(png(255)), pictures.describe(png(0))
    assert flat["ahash"] == "f" * 16 and step["ahash"] == "f0" * 8 and (step["width"], step["height"]) == (16, 16)
    assert pictures.describe(b"junk")["ahash"] is None


def test_pdf_routes():
    assert pdf.recognised_blocks([{"rec_texts": ["甲", " "]}, [[[0, 1], ("乙", 0.9)]]]) == ["第1页: 甲", "第2页: 乙"]
    blocks, meta = pdf.read(b"%PDF", "always", 5, lambda _: [{"rec_texts": ["足够长的识别文字"]}])
    assert blocks == ["第1页: 足够长的识别文字"] and meta["pdf_extraction"] == "paddleocr"
    with pytest.raises(pdf.PdfError):
        pdf.read(b"%PDF", "always", 500, lambda _: [{"rec_texts": ["短"]}])


def test_legacy_conversion(tmp_path):
    write_docx(tmp_path / "x.docx", ["正文"])
    content = (tmp_path / "x.docx").read_bytes()
    blocks, meta, _ = files.parse(b"old", "/p/旧.doc", Options(), convert=lambda *a: content)
    assert blocks == ["正文"] and meta["converted_from"] == ".doc"
    with pytest.raises(legacy.ConversionError):
        legacy.convert(b"x", "a.doc", soffice=str(tmp_path / "none"))


def test_discovery(tmp_path):
    for p in ("A/x.md", "b/x.md", "b/~$t.md", "b/n.bin"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("a")
    (tmp_path / "empty").mkdir()
    groups, empty = discovery.groups_from_folders(tmp_path)
    assert [g.name for g in groups] == ["A", "b"] and empty == ["empty"] and len(groups[1].files) == 1
    assert [g.name for g in discovery.groups_from_files(discovery.find_files(tmp_path))] == ["A_x", "b_x"]
    assert [g.name for g in discovery.add_groups([Group("A", ("1",))], [Group("A", ("2",)), Group("z", ("1",))])] == ["A", "A(2)"]


def test_config_errors_surface(spark):
    with pytest.raises(ValueError):
        check(spark, {"groups": []})
    assert normalize_config({"groups": [{"files": ["a"]}, {"files": ["b"]}]}).groups[0].name == "公司1"
