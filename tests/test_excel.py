"""Excel sheets: round trips, sheets as other programs write them, awkward cells."""

import datetime
import zipfile
from decimal import Decimal

import pytest

from indicraft.sources.excel import ExcelSource, Workbook, column_name, column_place, frame_parts, list_files

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
SCHEMA = "n long, name string, x double, day date, at timestamp, yes boolean, d decimal(10,2)"
ROWS = [
    (1, "a<b>&\"c\"", 1.5, datetime.date(2024, 2, 29), datetime.datetime(2023, 5, 6, 7, 8, 9), True, Decimal("12.30")),
    (2**53 + 1, "  spaces \n line\ttab ", -1e300, datetime.date(1900, 3, 1), datetime.datetime(1999, 12, 31, 23, 59, 59), False, Decimal("-0.01")),
    (None, None, None, None, None, None, Decimal("5.00")), (4, "_x0041_ \x07 é漢🙂\r", float("nan"), datetime.date(2100, 1, 1), None, None, None), (5, "", 0.1, None, None, None, None),
]


@pytest.fixture(scope="module")
def xlsx(spark):
    spark.dataSource.register(ExcelSource)
    return spark


def own_file(path, sheets, strings=None):
    """A file with shared strings and several sheets, as spreadsheet programs write them."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="t" Target="/xl/worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{MAIN}">{body}</worksheet>')
        if strings is not None:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")


def test_round_trip(xlsx, tmp_path):
    df = xlsx.createDataFrame(ROWS, SCHEMA)
    folder = str(tmp_path / "out")
    df.repartition(3).write.format("xlsx").option("sheet", "Data & more").mode("append").save(folder)
    back = xlsx.read.format("xlsx").option("sheet", "Data & more").schema(SCHEMA).load(folder)
    want = {r[1]: (*r[:2], None if r[2] != r[2] else r[2], *r[3:]) for r in ROWS}
    assert {r["name"]: tuple(r) for r in back.collect()} == want
    as_text = xlsx.read.format("xlsx").load(folder)
    assert as_text.columns == df.columns and {f.dataType.simpleString() for f in as_text.schema} == {"string"} and as_text.count() == 5
    df.limit(1).write.format("xlsx").mode("overwrite").save(folder)
    assert xlsx.read.format("xlsx").load(folder).count() == 1 and all("/.part" not in f for f in list_files(folder))


def test_row_ranges_and_file_sizes(xlsx, tmp_path):
    folder = str(tmp_path / "many")
    xlsx.range(1_000).selectExpr("id", "concat('r', id) as name").coalesce(1).write.format("xlsx").option("fileRows", 300).mode("append").save(folder)
    assert len(list_files(folder)) == 4
    back = xlsx.read.format("xlsx").option("taskRows", 70).schema("name string, id long, other string").load(folder)
    assert back.rdd.getNumPartitions() >= 14
    assert sorted((r["id"], r["name"], r["other"]) for r in back.collect()) == [(k, f"r{k}", None) for k in range(1_000)]
    assert xlsx.read.format("xlsx").load(folder + "/part-*.xlsx").count() == 1_000


def test_other_programs_sheets(xlsx, tmp_path):
    path = str(tmp_path / "own.xlsx")
    first = '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row></sheetData>'
    body = (
        '<sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>notice</t></is></c></row>'
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="s"><v>0</v></c></row>'
        '<row r="4"><c r="A4" t="s"><v>2</v></c><c r="B4"><f>1+1</f><v>2</v></c><c r="C4" t="e"><v>#DIV/0!</v></c><c r="D4" t="str"><v>calc</v></c></row>'
        '<row r="5"/><row r="9"><c r="D9" t="b"><v>1</v></c><c r="Z9"><v>7</v></c></row></sheetData>'
    )
    own_file(path, {"Intro": first, "Food": body}, ["<t>id</t>", "<r><t>ra</t></r><r><t>te</t></r><rPh><t>no</t></rPh>", "<t>00123</t>"])
    got = xlsx.read.format("xlsx").option("sheet", "Food").option("skipRows", 2).load(path)
    assert got.columns == ["id", "rate", "_c2", "id_3"]
    assert [tuple(r) for r in got.collect()] == [("00123", "2", None, "calc"), (None, None, None, "true")]
    typed = xlsx.read.format("xlsx").option("sheet", "Food").option("skipRows", 2).schema("RATE int, id int").load(path)
    assert [tuple(r) for r in typed.collect()] == [(2, 123), (None, None)]
    bare = xlsx.read.format("xlsx").option("header", "false").load(path)
    assert bare.columns == ["_c0"] and [tuple(r) for r in bare.collect()] == [("id",)]
    with pytest.raises(Exception, match="no sheet"):
        xlsx.read.format("xlsx").option("sheet", "Nope").schema("a string").load(path).collect()


def test_values_that_do_not_fit_are_null(xlsx, tmp_path):
    folder = str(tmp_path / "bad")
    xlsx.createDataFrame([("x", "1e3", "2024-01-02", "maybe"), ("2.5", "99999999999", "45293", "TRUE")], "a string, b string, c string, d string").coalesce(1).write.format("xlsx").mode("append").save(folder)
    got = xlsx.read.format("xlsx").schema("a long, b int, c date, d boolean").load(folder).collect()
    assert sorted(map(tuple, got), key=str) == [(None, 1000, datetime.date(2024, 1, 2), None), (None, None, datetime.date(2024, 1, 2), True)]


def test_names_and_empty_sheets(xlsx, tmp_path):
    assert [column_place(column_name(k)) for k in range(2_000)] == list(range(2_000)) and column_name(27) == "AB"
    path = str(tmp_path / "empty.xlsx")
    own_file(path, {"S": "<sheetData/>"})
    assert xlsx.read.format("xlsx").schema("a string").load(path).count() == 0
    with Workbook(path) as book:
        assert book.last_row(book.sheet_part("S")) is None
    assert 'name="a&amp;b"' in frame_parts("a&b")["xl/workbook.xml"]


def test_rows_before_a_range_are_not_parsed(xlsx, tmp_path, monkeypatch):
    from indicraft.sources import excel

    writer = excel.ExcelWriter(xlsx.createDataFrame([], "id long, name string").schema, {"path": str(tmp_path)}, False)
    path = writer.write(iter([(k, f"r<{k}") for k in range(60_000)])).paths[0]
    parsed = []
    plain = excel.ElementTree.iterparse

    def counted(*args, **kwargs):
        for event, node in plain(*args, **kwargs):
            parsed.append(node.tag == excel.MAIN + "row" and event == "end")
            yield event, node

    monkeypatch.setattr(excel.ElementTree, "iterparse", counted)
    with Workbook(path) as book:
        part = book.sheet_part(None)
        for first in (2, 20_002, 59_000):
            parsed.clear()
            assert [(n, c[1]) for n, c in book.rows(part, first, first + 9)] == [(n, f"r<{n - 2}") for n in range(first, first + 10)]
            assert sum(parsed) < 5_000, first


def test_ranges_of_awkward_sheets_equal_whole_reads(monkeypatch, tmp_path):
    from indicraft.sources import excel

    monkeypatch.setattr(excel, "READ_BYTES", 64)
    row = lambda k, tag="": f'<row{tag}><c><v>{k}</v></c></row>'
    numbered = "".join(row(k, f' spans="1:1" r="{k}"') for k in range(1, 60))
    gaps = "".join(row(k, f" r='{k}'" if k % 5 == 1 else "") for k in range(1, 60)) + row(90, ' r="90"')
    noted = numbered.replace(row(20, ' spans="1:1" r="20"'), '<!-- <row r="50"> --><row r="20"><c t="inlineStr"><is><t><![CDATA[<row r="40">]]></t></is></c></row>')
    bodies = {"numbered": numbered, "gaps": gaps, "none": "".join(row(k) for k in range(1, 30)), "noted": noted, "empty": ""}
    own_file(tmp_path / "a.xlsx", {k: f'<dimension ref="A1:A60"/><sheetData>{v}</sheetData><rowBreaks r="3"/>' for k, v in bodies.items()} | {"closed": "<sheetData/>"})
    with Workbook(str(tmp_path / "a.xlsx")) as book:
        for name in [*bodies, "closed"]:
            part = book.sheet_part(name)
            every = list(book.rows(part))
            assert len(every) == bodies.get(name, "").count("</row>")
            for first in range(1, 95):
                assert list(book.rows(part, first, first + 7)) == [r for r in every if first <= r[0] <= first + 7], (name, first)
