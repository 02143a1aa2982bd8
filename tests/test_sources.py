import zipfile

import pytest

from quillon.config import InputError
from quillon.sources.headers import choose_date_field, choose_main_table, header_row, infer_roles, unique_names
from quillon.sources.readers import document, ensure_readable, file_sha256, hash_files, load_frame, load_tables, read_grid, read_json, source_ref, write_json
from quillon.sources.xlsx import XlsxDataSource, is_date_format, read_sheets, serial_text


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def workbook(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return str(path)


def test_unreadable(tmp_path):
    for bad in (tmp_path / "none.csv", tmp_path, tmp_path / "x.json", tmp_path / "empty.csv", tmp_path / "bad.xlsx"):
        if bad.suffix in (".json", ".xlsx"):
            bad.write_text("{}")
        if bad.name == "empty.csv":
            bad.write_text("")
        with pytest.raises(InputError):
            ensure_readable(str(bad)) if bad.suffix != ".xlsx" else read_sheets(bad)


def test_delimited(spark, tmp_path):
    bom = load_tables(spark, write(tmp_path / "bom.csv", "﻿date,amount\r\n2026-01-01,3\r\n2026-01-02,4.5\r\n"))["bom"]
    assert bom.frame.columns == ["date", "amount"] and dict(bom.frame.dtypes)["amount"] == "double" and bom.frame.count() == 2
    tsv = load_tables(spark, write(tmp_path / "t.tsv", "a\tb\tn\nx\ty\t1\nz\tw\t2\n"))["t"]
    assert tsv.frame.columns == ["a", "b", "n"] and [r["n"] for r in tsv.frame.orderBy("n").collect()] == [1, 2]
    head = load_tables(spark, write(tmp_path / "h.csv", "date,channel,amount\n"))["h"]
    assert head.frame.columns == ["date", "channel", "amount"] and head.frame.count() == 0
    ragged = load_tables(spark, write(tmp_path / "r.csv", "a,b,c\n1,2,3,4\n5,6\n"))["r"]
    assert ragged.frame.count() == 2 and ragged.notices
    chinese = load_tables(spark, write(tmp_path / "g.csv", "日期,金额\n2026-01-01,3\n2026-01-02,4\n", "gb18030"))["g"]
    assert chinese.frame.columns == ["日期", "金额"] and chinese.frame.count() == 2
    twice = load_tables(spark, write(tmp_path / "d.csv", "x,x,y\n1,2,3\n"))["d"]
    assert twice.frame.columns == ["x", "x__2", "y"]
    later = load_tables(spark, write(tmp_path / "l.csv", "Report,,\nname,kind,size\na,b,1\nc,d,2\n"))["l"]
    assert later.frame.columns == ["name", "kind", "size"] and later.header_row == 2


def rows(source):
    return sorted((tuple(r) for r in source.frame.collect()), key=repr)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030"])
@pytest.mark.parametrize("above", ["", "Report,,\n", 'A "report",,\n\n'])
def test_no_row_is_lost_or_torn(spark, tmp_path, encoding, above):
    text = above + 'name,note,v\na,"two\nlines",1\nb,x,2\nname,y,v\nc,"z ""q"", 名称",3\n,,\nname,note,v\n'
    got = load_tables(spark, write(tmp_path / "t.csv", text, encoding))["t"]
    assert rows(got) == [("a", "two\nlines", "1"), ("b", "x", "2"), ("c", 'z "q", 名称', "3"), ("name", "note", "v"), ("name", "y", "v")]
    assert got.header_row == (2 if above else 1)
    grid = read_grid(spark, str(tmp_path / "t.csv")).orderBy("row_idx").collect()
    assert ["a", "two\nlines", "1"] in [r["cells"] for r in grid] and [r["row_idx"] for r in grid] == list(range(len(grid)))


def test_line_breaks_beyond_the_first_bytes(spark, tmp_path):
    body = "".join(f"{i},plain text,{i}\n" for i in range(9000)) + '9000,"late\nbreak",9000\n' + "9001,x,9001\n"
    got = load_tables(spark, write(tmp_path / "late.csv", "id,note,n\n" + body))["late"].frame
    assert got.count() == 9002 and got.where("note = 'late\\nbreak'").count() == 1


def test_paths_with_a_scheme(spark, tmp_path):
    path = "file://" + write(tmp_path / "p.csv", "a,b\n1,x\n2,y\n")
    assert load_tables(spark, path)["p"].frame.count() == 2 and ensure_readable(path, spark).size() == 12
    with pytest.raises(InputError):
        load_tables(spark, f"file://{tmp_path}/none.csv")


def test_dates_in_workbooks(spark, tmp_path):
    path = tmp_path / "d.xlsx"
    workbook(path, {"s": [["day", "at", "n", "own"], ["", "", "", ""]]})
    style = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    row = '<row r="{0}"><c r="A{0}" s="1"><v>45292</v></c><c r="B{0}" s="2"><v>45292.75</v></c><c r="C{0}" s="4"><v>45292</v></c><c r="D{0}" s="3"><v>45293</v></c></row>'
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    sheet = parts["xl/worksheets/sheet1.xml"].decode().replace("</sheetData>", row.format(3) + row.format(5) + "</sheetData>")
    parts["xl/worksheets/sheet1.xml"] = sheet.encode()
    with zipfile.ZipFile(path, "w") as z:
        for n, c in (parts | {"xl/styles.xml": style}).items():
            z.writestr(n, c)
    got = load_tables(spark, str(path))["s"].frame.collect()
    assert [tuple(r) for r in got] == [("2024-01-01", "2024-01-01 18:00:00", 45292.0, "2024-01-02")] * 2
    assert serial_text(0.5) == "12:00:00" and serial_text(1) == "1900-01-01" and serial_text(61) == "1900-03-01" and serial_text(0, True) == "1904-01-01"
    assert [is_date_format(c) for c in ("General", "0.00", "dd/mm/yyyy", '[Red]0.0"mm"', "[$-409]h:mm AM/PM", "#,##0")] == [False, False, True, False, True, False]


def test_main_table_and_references(spark, tmp_path):
    days = [["date", "amount", "n"]] + [[f"2026-01-{d:02d}", str(d), str(2 * d)] for d in range(1, 21)]
    path = workbook(tmp_path / "m.xlsx", {"notes": [["key", "text"], ["a", "b"], ["c", "d"]], "daily": days})
    frame, name = load_frame(spark, path)
    assert name == "daily" and frame.count() == 20 and load_frame(spark, path, {"sheet": "notes"})[1] == "notes"
    with pytest.raises(InputError):
        load_frame(spark, path, {"sheet": "none"})
    assert source_ref("daily", 1, 0) == {"sheet": "daily", "header_row": 1, "data_row": 2} and source_ref("x", 3) == {"sheet": "x", "header_row": 3}


def test_workbooks(spark, tmp_path):
    path = workbook(tmp_path / "w.xlsx", {"detail": [["day", "n"], ["2026-01-01", "1"], ["2026-01-02", "2"]], "sum": [["k", "v"], ["a", "b"]]})
    tables = load_tables(spark, path)
    assert list(tables) == ["detail", "sum"] and tables["detail"].frame.count() == 2
    assert read_grid(spark, path).count() == 3
    with pytest.raises(InputError):
        read_grid(spark, path, "other")
    spark.dataSource.register(XlsxDataSource)
    assert spark.read.format("xlsx").load(path).groupBy("sheet").count().count() == 2


def test_names_roles_and_choices():
    assert unique_names(["a", " a ", None, "b\nc"]) == ["a", "a__2", "unnamed_3", "b c"]
    assert header_row([["title", ""], ["k", "v", "w"], ["1", "2", "3"]]) == 1
    roles = infer_roles(["日期", "注册转化率", "channel"])
    assert roles["date"] == ["日期"] and "registered" not in roles and roles["channel"] == ["channel"]
    assert choose_date_field({"x": 0.9, "day": 0.6}) == "day" and choose_date_field({"n": 1.0}, ["n"]) is None
    assert choose_main_table({"a": {"rows": 5}, "b": {"rows": 20, "date_field": "d", "unique_day_ratio": 1.0}}) == "b"


def test_json_and_hashes(spark, tmp_path):
    path = tmp_path / "x" / "y.json"
    write_json(str(path), {"a": float("inf"), "b": [float("nan"), {"c": -float("inf")}], "d": 1.5})
    assert read_json(str(path)) == {"a": None, "b": [None, {"c": None}], "d": 1.5} and read_json(str(tmp_path / "no"), 3) == 3
    assert hash_files(spark, str(path)).first()["sha256"] == file_sha256(str(path))
    assert document({"t": spark.range(2)}) == {"t": [{"id": 0}, {"id": 1}]}
    with pytest.raises(InputError):
        document({"t": spark.range(5)}, most=3)
