"""Workbooks as a sink: what is written is read back, all files of a job or none."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from floorledger import schema as S
from floorledger.catalogue import queries as Q
from floorledger.plans.rollup import report_bundle
from floorledger.sources import books
from floorledger.sources.books import BOOK_ROWS, Book, file_name, letters, save_books, save_bundles, sheet_rows
from floorledger.sources.grid import read_workbooks
from floorledger.sources.workbook import workbook_rows

SF = "/root/testdata/sf0.001"


def texts(*cells):
    return [(books.TEXT, c) for c in cells]


def test_cells_of_every_kind_are_read_back():
    stream = io.BytesIO()
    book = Book(stream)
    odd = ' <a & "b">\r\n\t é😀\x01 '
    book.add("Datos", None, texts("t", None, odd, ""))
    book.add("Datos", None, [(books.NUMBER, "1.0E10"), (books.NUMBER, "0.1"), (books.NUMBER, "-7"), (books.TRUTH, "true"), (books.TRUTH, "false")])
    book.add("Datos", None, [(books.MOMENT, "2024-02-29 23:59:59.123"), (books.MOMENT, "1999-12-31"), (books.NUMBER, None)])
    book.close()
    rows = [cells for *_, cells in workbook_rows(stream.getvalue())]
    assert rows == [
        ["t", None, odd.replace("\x01", "�"), None],
        ["10000000000", "0.1", "-7", "True", "False"],
        ["2024-02-29 23:59:59.123000", "1999-12-31 00:00:00"],
    ]


def test_sheet_names_are_short_single_and_legal():
    stream = io.BytesIO()
    book = Book(stream)
    long = "Total de conteo anual por asistente"
    for name in (long, long + " otra vez", "a/b:c", "", "A B C"):
        book.add(name, None, texts("x"))
    book.close()
    assert book.names == [long[:31], long[:27] + " (2)", "a b c", "Hoja", "A B C (2)"]
    assert [n for n, *_ in workbook_rows(stream.getvalue(), "a b c")] == ["a b c"]
    assert [letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [file_name(n) for n in ("a/b", "x.XLSX", "..")] == ["a-b.xlsx", "x.XLSX", "libro.xlsx"]


@pytest.mark.parametrize("given", [True, False])
def test_a_full_sheet_goes_on_in_the_next(monkeypatch, given):
    monkeypatch.setattr(books, "MOST_ROWS", 5)
    stream = io.BytesIO()
    book = Book(stream)
    for k in range(12):
        book.add("Hoja", k if given else None, texts("head" if k == 0 else f"r{k}"))
    book.close()
    assert book.names == ["Hoja", "Hoja (2)", "Hoja (3)"]
    found = [[(row, cells[0]) for _, _, row, cells in workbook_rows(stream.getvalue(), n)] for n in book.names]
    assert found[0] == list(enumerate(["head", "r1", "r2", "r3", "r4"]))
    assert found[1] == list(enumerate(["head", "r5", "r6", "r7", "r8"])) and found[2] == list(enumerate(["head", "r9", "r10", "r11"]))


def shown(value):
    if isinstance(value, (int, float)):
        return str(int(value)) if float(value).is_integer() else repr(value)
    if isinstance(value, dt.date):
        return f"{value} 00:00:00"
    return value or None  # a sheet has no empty text apart from an empty cell


def test_every_report_of_many_bundles_is_read_back(spark, tmp_path):
    sets = {
        "cartas": report_bundle(Q.ops(spark, SF), S.GETNET),
        "premios": report_bundle(Q.prizes(spark, SF), S.PREMIOS),
        "nada": report_bundle(Q.ops(spark, SF).where("FALSE"), S.GETNET),
    }
    save_bundles(sets, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["cartas.xlsx", "nada.xlsx", "premios.xlsx"]
    for book, reports in sets.items():
        content = (tmp_path / "out" / f"{book}.xlsx").read_bytes()
        for name, report in reports.items():
            rows = [tuple(cells) for *_, cells in workbook_rows(content, name[:31])]
            want = [tuple(report.columns), *[tuple(shown(v) for v in r) for r in report.collect()]]
            width = len(report.columns)
            assert [r + (None,) * (width - len(r)) for r in rows] == want, (book, name)


def test_a_job_that_breaks_off_leaves_the_files_as_they_were(spark, tmp_path):
    folder = tmp_path / "out"
    one = spark.createDataFrame([(1, "a")], "n int, t string")
    save_books(sheet_rows(one, "libro", 0, "Hoja"), str(folder))
    before = (folder / "libro.xlsx").read_bytes()
    fine = sheet_rows(one.withColumn("t", F.lit("new")), "libro", 0, "Hoja")
    bad = fine.withColumn("cells", F.when(F.col("ord") > 0, F.raise_error(F.lit("broken off")).cast("array<struct<kind:string,value:string>>")).otherwise(F.col("cells")))
    with pytest.raises(Exception, match="broken off"):
        save_books(bad.unionByName(fine.withColumn("book", F.lit("otro"))), str(folder))
    assert [p.name for p in folder.iterdir()] == ["libro.xlsx"] and (folder / "libro.xlsx").read_bytes() == before
    save_books(fine, str(folder))
    assert [r["cells"] for r in read_workbooks(spark, str(folder)).where("row_idx > 0").collect()] == [["1", "new"]]


def test_no_rows_write_nothing(spark, tmp_path):
    save_books(spark.createDataFrame([], BOOK_ROWS), str(tmp_path / "none"))
    save_bundles({}, str(tmp_path / "none"))
    assert not list(tmp_path.glob("none/*.xlsx"))


def test_the_parts_of_a_book_are_those_of_the_format(tmp_path):
    stream = io.BytesIO()
    book = Book(stream)
    book.add("Hoja", None, [(books.MOMENT, dt.datetime(2024, 1, 1).isoformat(" "))])
    book.close()
    with zipfile.ZipFile(stream) as parts:
        assert set(parts.namelist()) == {
            "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/styles.xml", "_rels/.rels", "[Content_Types].xml", "xl/worksheets/sheet1.xml",
        }
        assert parts.testzip() is None
