"""Books in parts: sheets above the format's rows are written by many tasks and read again as one."""

import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from floorledger.sources import books, grid
from floorledger.sources.books import BOOK_ROWS, join_crc, save_books
from floorledger.sources.grid import written_parts, pick_sheet, read_workbooks, unreadable
from floorledger.sources.workbook import workbook_rows


def text(value):
    return [(books.TEXT, value)]


def frame(spark, rows):
    return spark.createDataFrame(rows, BOOK_ROWS)


def read(spark, folder, large, sheet=None):
    found = read_workbooks(spark, str(folder), sheet=sheet, large=large)
    assert unreadable(found).count() == 0
    assert found.where("row_idx < 0").count() == len(list(folder.iterdir()))
    rows = pick_sheet(found, sheet).select(F.element_at(F.split("path", "/"), -1), "sheet", "row_idx", "cells").collect()
    return sorted((book, name, row, tuple(cells)) for book, name, row, cells in rows)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(books, "MOST_ROWS", 50)
    monkeypatch.setattr(books, "PART_ROWS", 20)


@pytest.mark.parametrize("given", [True, False])
def test_a_sheet_above_the_limit_is_read_back_whole(spark, tmp_path, small, given):
    rows, want = [], []
    for book, count in (("largo", 230), ("corto", 7)):
        at = 0
        for k in range(count):
            for twin in range(2 if given and k % 9 == 4 else 1):  # rows that share a number
                rows.append((book, 0, "Hoja", len(rows), at if given else None, text(f"{k} {twin} <&")))
                want.append((f"{book}.xlsx", "Hoja", at, (f"{k} {twin} <&",)))
            at += 3 if given and k % 5 == 1 else 1
        rows.append((book, 1, "Otra", len(rows), 0 if given else None, text("z")))
    random.Random(3).shuffle(rows)
    save_books(frame(spark, rows), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["corto.xlsx", "largo.xlsx"]
    content = (tmp_path / "out" / "largo.xlsx").read_bytes()
    assert [r[3][0] for r in workbook_rows(content, "Hoja (2)")][0] == "0 0 <&"  # a sheet alone begins with the first row
    for large in (1 << 40, 0):
        assert read(spark, tmp_path / "out", large) == sorted(want)
        assert [r[3] for r in read(spark, tmp_path / "out", large, "Otra")] == [("z",)] * 2


def test_a_store_that_only_spark_reads_gives_the_same(spark, tmp_path, small, monkeypatch):
    rows = [("libro", 0, "Hoja", k, None, text(str(k))) for k in range(120)]
    save_books(frame(spark, rows), str(tmp_path / "out"))
    want = [("libro.xlsx", "Hoja", k, (str(k),)) for k in range(120)]
    files = spark.read.format("binaryFile").load(str(tmp_path / "out")).select("path", "modificationTime")
    assert written_parts(files).count() == 8
    monkeypatch.setattr(grid, "written_parts", lambda files, sheet: None)
    assert read(spark, tmp_path / "out", 0) == sorted(want)


def test_one_book_is_written_by_many_tasks(spark, tmp_path, small, monkeypatch):
    seen = []
    monkeypatch.setattr(books, "cut_lineage", lambda df: seen.append(done := cut(df.withColumn("task", F.spark_partition_id()))) or done.drop("task"))
    save_books(frame(spark, [("libro", 0, "Hoja", k, k, text(str(k))) for k in range(200)]), str(tmp_path / "out"))
    assert seen[0].select("task").distinct().count() > 1


cut = books.cut_lineage


def test_damage_in_a_sheet_that_goes_on_is_told(spark, tmp_path, small):
    pick = random.Random(1)
    rows = [("libro", 0, "Hoja", k, None, text(str(pick.random()))) for k in range(120)]
    save_books(frame(spark, rows), str(tmp_path / "out"))
    path = tmp_path / "out" / "libro.xlsx"
    data = bytearray(path.read_bytes())
    at = data.index(b"sheet3.xml") + 400
    data[at : at + 40] = bytes(40)
    path.write_bytes(bytes(data))
    for large in (1 << 40, 0):
        assert unreadable(read_workbooks(spark, str(tmp_path / "out"), large=large)).count() == 1


def test_numbers_are_filled_in_behind_the_row_before(spark, tmp_path):
    given = [None, None, 5, None, None, 9, None]
    rows = [("libro", 0, "Hoja", k, n, text(str(k))) for k, n in enumerate(given)]
    save_books(frame(spark, rows), str(tmp_path / "out"))
    assert [r[2] for r in read(spark, tmp_path / "out", 1 << 40)] == [0, 1, 5, 6, 7, 9, 10]


def test_crc_of_joined_texts():
    pick = random.Random(2)
    for _ in range(50):
        a, b = pick.randbytes(pick.randrange(300)), pick.randbytes(pick.randrange(3000))
        assert join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_cells_of_every_kind_are_read_from_parts(spark, tmp_path, small):
    odd = ' <a & "b">\r\n\t &lt; é😀 <c r="B9"><v>'
    cells = [[(books.TEXT, odd), (books.TEXT, None), (books.TEXT, ""), (books.NUMBER, "1.0E10"), (books.NUMBER, "0.1"), (books.TRUTH, "true")],
             [(books.NUMBER, None), (books.TRUTH, "false"), (books.MOMENT, "2024-02-29 23:59:59.123"), (books.MOMENT, None)], []]
    save_books(frame(spark, [("libro", 0, "Hoja", k, None, c) for k, c in enumerate(cells * 30)]), str(tmp_path / "out"))
    whole, parts = (read(spark, tmp_path / "out", large) for large in (1 << 40, 0))
    assert whole == parts and len(parts) == 90
    assert parts[0][3] == (odd, None, None, "10000000000", "0.1", "True")


def test_a_sheet_that_was_changed_is_not_read_by_its_parts(spark, tmp_path, small):
    save_books(frame(spark, [("libro", 0, "Hoja", k, None, text(f"v{k}")) for k in range(30)]), str(tmp_path / "out"))
    path = tmp_path / "out" / "libro.xlsx"
    with zipfile.ZipFile(path) as book:
        held = {n: book.read(n).replace(b">v7<", b">new<") for n in book.namelist()}
    with zipfile.ZipFile(path, "w") as book:
        for name, data in held.items():
            book.writestr(name, data)
    assert ("libro.xlsx", "Hoja", 7, ("new",)) in read(spark, tmp_path / "out", 0)
