import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from paperlane.config import CaptureConfig, ColumnSpec, TableSchema, TabularOptions
from paperlane.functions.wire import contract_problems, record_json
from paperlane.plans.tables import load, records

LIST = TableSchema((ColumnSpec("kod", ("Kód",), required=True), ColumnSpec("megnevezes", ("Megnevezés",)), ColumnSpec("mennyiseg", ("Mennyiség",), "number")), ("kod",))
BASIC = "Kód;Megnevezés;Mennyiség\nA-1;Első tétel;12,5\nA-2;Második tétel;3\n"


def config(root, **options):
    return CaptureConfig(input_root=str(root), tabular=TabularOptions(**({"decimal_separator": ","} | options)), human_only_field_types=("kezi",))


def read(spark, root, schema=LIST, **options):
    t = load(spark, schema, config(root, **options))
    rows = sorted(t.rows.collect(), key=lambda r: (r.relative_path, r.row_no))
    return rows, {f.relative_path: f for f in t.files.collect()}, {r.relative_path: (r.error_class, r.reason) for r in t.refused.collect()}


def test_files_of_all_kinds(spark, tmp_path):
    files = {
        "basic.csv": BASIC.encode(), "bom.csv": b"\xef\xbb\xbf" + BASIC.encode(), "comma.csv": BASIC.replace(";", "|").encode(), "sub/tab.csv": BASIC.replace(";", "\t").encode(), "crlf.csv": BASIC.replace("\n", "\r\n").encode(),
        "tie.csv": "Kód;Megnevezés,Mennyiség\n".encode(), "none.csv": "Kód\nA\n".encode(), "empty.csv": b"", "bytes.csv": b"K\xf3d;M\n", "noreq.csv": "Megnevezés;X\na;b\n".encode(), "twice.csv": "Kód;kód\n1;2\n".encode(),
        "~$basic.csv": b"x", "basic.csv.bak": b"x", "a.pdf": b"x", "a.doc": b"x", "extra.csv": "Kód;Nettó, bruttó;Egyéb\nA;1;2\n".encode(), "short.csv": "Kód;Megnevezés;Mennyiség\nA-1\n\"B;2\";\"x \"\"y\"\"\";kb. 3\n".encode(),
        "odd [1]+ %20.csv": BASIC.encode(),
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows, found, refused = read(spark, tmp_path)
    for name in ("basic.csv", "bom.csv", "comma.csv", "sub/tab.csv", "crlf.csv", "odd [1]+ %20.csv"):
        mine = [r for r in rows if r.relative_path == name]
        assert [(r["values"].kod.text, r["values"].megnevezes.text, r["values"].mennyiseg.number, r.needs_human) for r in mine] == [("A-1", "Első tétel", 12.5, False), ("A-2", "Második tétel", 3.0, False)], name
        assert [r["values"].kod.evidence.locator for r in mine] == ["R2C1", "R3C1"]
        assert found[name].content_hash == "sha256:" + hashlib.sha256(files[name]).hexdigest() == mine[0]["values"].kod.evidence.content_hash
    assert refused == {
        "tie.csv": ("SourceUnreadable", "delimiter_tie"), "none.csv": ("SourceUnreadable", "no_delimiter"), "empty.csv": ("SourceUnreadable", "header_beyond_file"), "bytes.csv": ("SourceUnreadable", "undecodable"),
        "noreq.csv": ("SchemaMismatch", "required_column_missing: kod"), "twice.csv": ("AmbiguousHeader", "header_twice: kod"), "~$basic.csv": ("SourceUnreadable", "excluded_name"), "basic.csv.bak": ("SourceUnreadable", "excluded_name"),
        "a.pdf": ("SourceUnreadable", "routed_to_text_layer_document"), "a.doc": ("SourceUnreadable", "unsupported_extension"),
    }
    assert found["extra.csv"].diagnostics == ["also_in_header: ,", "unmatched_header: Nettó, bruttó", "unmatched_header: Egyéb", "optional_column_missing: megnevezes", "optional_column_missing: mennyiseg"]
    a, b = [r for r in rows if r.relative_path == "short.csv"]
    assert a["values"].megnevezes.note == "blank_cell" and b["values"].kod.text == "B;2" and b["values"].megnevezes.text == 'x "y"' and b["values"].mennyiseg.note == "no_number"


def test_rows_and_limits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title\n\nKód;Megnevezés\n;db\nA-1;x\n;;\n;note\nA-2;y\nA-3;z\n ;\n", encoding="utf-8")
    how = {"header_row": 3, "data_starts_after_header": 1, "delimiter": ";"}
    rows, found, _ = read(spark, tmp_path, **how)
    assert [r["values"].kod.text for r in rows] == ["A-1", "A-2", "A-3"] and rows[0]["values"].kod.evidence.locator == "R5C1"
    assert (found["a.csv"].skipped, found["a.csv"].truncated) == (3, False)
    rows, found, _ = read(spark, tmp_path, max_rows=2, **how)
    assert len(rows) == 2 and (found["a.csv"].skipped, found["a.csv"].truncated, found["a.csv"].first_unread) == (2, True, 9)
    _, found, _ = read(spark, tmp_path, max_rows=3, **how)
    assert (found["a.csv"].truncated, found["a.csv"].first_unread) == (True, 10)
    assert read(spark, tmp_path, max_rows=100, **how)[1]["a.csv"].truncated is False
    no_keys = TableSchema(LIST.columns)
    assert len(read(spark, tmp_path, no_keys, **how)[0]) == 6
    human = TableSchema((ColumnSpec("kod", ("Kód",), field_type="kezi"), ColumnSpec("m", ("Megnevezés",))), ("kod",))
    assert [r["values"].kod.note for r in read(spark, tmp_path, human, **how)[0]] == ["human_only"] * 3
    absent = TableSchema((ColumnSpec("kod", ("Nincs",)), ColumnSpec("m", ("Megnevezés",))), ("kod",))
    assert read(spark, tmp_path, absent, **how)[0] == []


def test_units_and_records(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Kód;Mennyiség (m2)\nA-1;12,5\n;\nA-2;kb. 3\n", encoding="utf-8")
    tables = load(spark, LIST, config(tmp_path), ["b.csv"])
    r = records(tables, LIST)
    record = F.struct(*[F.col(c) for c in r.columns])
    got = r.select(record_json(record).alias("j"), contract_problems(record).alias("p")).collect()
    wire = json.loads(got[0].j)
    assert got[0].p == [] and wire["needs_human"] and wire["fields"]["unit:mennyiseg"]["value"] == "m2" and wire["fields"]["unit:mennyiseg"]["evidence"]["locator"] == "R1"
    assert [x["mennyiseg"]["value"] for x in wire["rows"]] == [12.5, None] and "blank_rows_skipped: 1" in wire["diagnostics"]


def test_codepages(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes(BASIC.replace("ő", "ö").encode("cp1250"))
    rows, _, _ = read(spark, tmp_path, encoding_candidates=("utf-8", "cp1250"))
    assert [r["values"].megnevezes.text for r in rows] == ["Elsö tétel", "Második tétel"]


def test_header_options(spark, tmp_path):
    (tmp_path / "d.csv").write_text("KOD;Megnevezes  [x]\nA;b\n", encoding="utf-8")
    assert read(spark, tmp_path)[2]["d.csv"][0] == "SchemaMismatch"
    rows, found, _ = read(spark, tmp_path, strip_header_accents=True)
    assert rows[0]["values"].megnevezes.text == "b" and found["d.csv"].units == {"megnevezes": "x"}


def book(path, sheets, active=0, extra=()):
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        entries = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{entries}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>Kód</t></si><si><r><t>Megne</t></r><r><t>vezés</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{m}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        for i, (_, body) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{m}"><sheetData>{body}</sheetData></worksheet>')


HEAD = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>Érték</t></is></c><c r="D1" t="str"><v>Nap</v></c></row>'
BODY = HEAD + (
    '<row r="2"><c r="A2" t="inlineStr"><is><t>A-1</t></is></c><c r="B2"><v>123</v></c><c r="C2"><v>12.5</v></c><c r="D2" s="1"><v>46233</v></c></row>'
    '<row r="4"><c r="A4" t="inlineStr"><is><t>A-2</t></is></c><c r="B4" t="b"><v>1</v></c><c r="C4"><f>1+1</f><v>99</v></c><c r="D4" s="2"><v>46233.5</v></c></row>'
    '<row r="5"><c r="A5" t="inlineStr"><is><t>A-3</t></is></c><c r="C5"><f>1+1</f></c></row>'
)
BOOK = TableSchema((ColumnSpec("kod", ("Kód",), required=True), ColumnSpec("m", ("Megnevezés",)), ColumnSpec("e", ("Érték",), "number"), ColumnSpec("d", ("Nap",), "date")), ("kod",))


def test_workbooks(spark, tmp_path):
    book(tmp_path / "w.xlsx", [("Üres", ""), ("Adatok", BODY)], 1)
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    rows, found, refused = read(spark, tmp_path, BOOK)
    v = [r["values"] for r in rows]
    assert [x.kod.text for x in v] == ["A-1", "A-2", "A-3"] and v[0].kod.evidence.locator == "Adatok!R2C1" and v[1].e.evidence.locator == "Adatok!R4C3"
    assert (v[0].m.text, v[0].m.confidence) == ("123", "needs_review") and v[1].m.text == "True"
    assert [x.e.number for x in v] == [12.5, 99.0, None] and v[2].e.note == "unreadable: formula_without_cached_value" and v[2].m.note == "blank_cell"
    assert [str(x.d.date) for x in v] == ["2026-07-30", "2026-07-30", "None"]
    assert refused["bad.xlsx"][1].startswith("workbook_unreadable") and found["w.xlsx"].sheet == "Adatok"
    _, _, refused = read(spark, tmp_path, BOOK, sheet_name="Nincs")
    assert "no such sheet" in refused["w.xlsx"][1]
    assert "header_beyond_file" in read(spark, tmp_path, BOOK, sheet_name="Üres", header_row=3)[2].get("w.xlsx", ("", "header_beyond_file"))[1]


def test_paths_and_empty_input(spark, tmp_path):
    from paperlane.errors import Configuration, SourceUnreadable
    from paperlane.sources.selection import resolve_source

    (tmp_path / "in").mkdir()
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2" / "x.csv").write_text(BASIC)
    (tmp_path / "in" / "link.csv").symlink_to(tmp_path / "in2" / "x.csv")
    for bad in ("../in2/x.csv", "/etc/passwd", "C:\\x.csv", "a\\..\\..\\b", ""):
        with pytest.raises(Configuration):
            resolve_source(str(tmp_path / "in"), bad)
    for bad in ("link.csv", "none.csv"):
        with pytest.raises(SourceUnreadable):
            resolve_source(str(tmp_path / "in"), bad)
    assert load(spark, LIST, config(tmp_path / "in"), []).rows.count() == 0
