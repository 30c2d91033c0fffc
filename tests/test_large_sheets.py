"""Large workbooks: cut into pieces and decoded by many tasks, with the result of the one-task way."""

import datetime as dt
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from floorledger.sources.grid import decode_large, decode_workbooks, pick_sheet, read_workbooks, unreadable
from floorledger.sources.workbook import ROWS, STRINGS, piece_rows, piece_strings, string_uses, workbook_pieces, workbook_rows
from workbooks import MAIN, write_workbook

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'


def rows_of(count, seed=1):
    pick = random.Random(seed)
    values = [None, "a", "b < c & d", "é 😀", "inline:x\ny", 1, 2.5, True, dt.datetime(2024, 2, 3, 4, 5, 6), "#N/A", "t" * 300, "row", "</si>"]
    return [["Fecha", "Monto"], *[[f"s{k}" if k % 3 else "often", *[pick.choice(values) for _ in range(pick.randrange(0, 6))]] for k in range(count)]]


def replaced(path, changes):
    """The workbook with parts rewritten by functions of their text."""
    with zipfile.ZipFile(path) as book:
        parts = {n: book.read(n) for n in book.namelist()}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, data in parts.items():
            for key, change in changes.items():
                if key in name:
                    new = change(data.decode())
                    data = new if isinstance(new, bytes) else new.encode()
            book.writestr(name, data)


def prefixed(text):
    text = text.replace(MAIN, MAIN.replace("xmlns=", "xmlns:x="))
    for tag in ("worksheet", "sheetData", "row", "c", "v", "is", "t", "sst", "si"):
        text = text.replace(f"<{tag}>", f"<x:{tag}>").replace(f"<{tag} ", f"<x:{tag} ").replace(f"</{tag}>", f"</x:{tag}>")
    return HEAD + text


def no_numbers(text):
    return re.sub(r'<row r="\d+">', '<row spans="1:3">', text).replace("<sheetData>", '<cols><col min="1"/></cols><sheetData><row r="7"/>', 1)


KINDS = {
    "plain": {},
    "prefixed": {"sheet1": prefixed, "sharedStrings": prefixed},
    "no_numbers": {"sheet1": no_numbers},
    "comment": {"sheet1": lambda t: t.replace("</row>", "</row><!-- </row> -->", 3)},
    "cdata": {"sharedStrings": lambda t: t.replace("<t>often</t>", "<t><![CDATA[</si>often]]></t>", 1)},
    "rich": {"sharedStrings": lambda t: t.replace("<t>often</t>", "<r><t>of</t></r><r><rPr/><t>ten</t></r><rPh><t>no</t></rPh>")},
    "empty_strings": {"sharedStrings": lambda t: t.replace("<si><t>often</t></si>", "<si/>")},
    "after": {"sheet1": lambda t: t.replace("</sheetData>", "</sheetData><mergeCells><mergeCell ref='A1:B2'/></mergeCells>")},
    "utf16": {"sheet1": lambda t: ('<?xml version="1.0" encoding="UTF-16"?>' + t).encode("utf-16")},
}
BROKEN = {
    "cut_sheet": {"sheet1": lambda t: t[: len(t) * 3 // 4]},
    "cut_strings": {"sharedStrings": lambda t: t[: len(t) * 3 // 4]},
    "no_close": {"sheet1": lambda t: t.replace("</sheetData></worksheet>", "</sheetData>")},
    "bad_middle": {"sheet1": lambda t: t.replace("<v>", "<w>", 1)},
}


def whole(path, sheet=None):
    with open(path, "rb") as file:
        return list(workbook_rows(file.read(), sheet))


@pytest.mark.parametrize("size", [200, 3000, 1 << 20])
@pytest.mark.parametrize("name", KINDS)
def test_pieces_hold_the_rows_of_the_sheet(tmp_path, name, size):
    path = write_workbook(str(tmp_path / "x.xlsx"), {"Hoja": rows_of(80), "Otra": [["z"]]})
    replaced(path, KINDS[name])
    want = whole(path)
    with open(path, "rb") as file:
        found = workbook_pieces(file.read(), None, size)
    if name in ("comment", "cdata", "utf16"):
        assert found is None
        return
    about, pieces = found
    pieces = list(pieces)
    strings = {k: t for p in pieces if p.kind == STRINGS for k, t in piece_strings(p.xml, p.first)}
    got = []
    for p in pieces:
        if p.kind == ROWS:
            mine = {k: strings[k] for k in string_uses(p.xml) if k in strings}
            got += [(about["sheet"], about["sheet_idx"], *r) for r in piece_rows(p.xml, p.first, mine, set(about["dates"]), about["from_1904"])]
    assert got == want
    if size == 200:
        assert sum(p.kind == ROWS for p in pieces) > 10 and sum(p.kind == STRINGS for p in pieces) > 10


def test_large_and_small_ways_give_the_same_grid(spark, tmp_path):
    for name, changes in {**KINDS, **BROKEN}.items():
        path = write_workbook(str(tmp_path / f"{name}.xlsx"), {"Hoja": rows_of(150), "Otra": [["z", 1]]})
        replaced(path, changes)
    write_workbook(str(tmp_path / "empty.xlsx"), {"Hoja": [], "Otra": [["z", 1]]})
    write_workbook(str(tmp_path / "alone.xlsx"), {"Hoja": rows_of(3)})
    (tmp_path / "broken.xlsx").write_bytes(b"x")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "modificationTime", "content")
    for sheet in (None, "Otra"):
        one = read_workbooks(spark, str(tmp_path), sheet=sheet, large=1 << 40)
        many = decode_large(files, sheet, 2000)
        bad = [{r["path"].rsplit("/", 1)[1] for r in unreadable(g).collect()} for g in (one, many)]
        assert bad[0] == bad[1]
        if sheet is None:
            assert bad[0] == {"broken.xlsx", *(f"{n}.xlsx" for n in BROKEN)}
        fine = [pick_sheet(g, sheet).where(~F.col("path").rlike("|".join(["/broken", *[f"/{n}[.]" for n in BROKEN]]))) for g in (one, many)]
        rows = [sorted(map(str, f.drop("error").collect())) for f in fine]
        assert rows[0] == rows[1] and len(rows[0]) > 5
        ends = [sorted(r["path"] for r in g.where("row_idx < 0 AND error IS NULL").select("path").collect()) for g in (one, many)]
        assert ends[0] == [p for p in ends[1] if p in set(ends[0])]


def test_pieces_are_decoded_by_many_tasks(spark, tmp_path):
    write_workbook(str(tmp_path / "x.xlsx"), {"Hoja": rows_of(30_000)})
    assert (tmp_path / "x.xlsx").stat().st_size > 200_000
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert decode_workbooks(files, large=100_000).where("row_idx >= 0").count() == 30_001
    grid = decode_large(files.select("path", "modificationTime", "content"), None, 100_000)
    tasks = grid.where("row_idx >= 0").groupBy(F.spark_partition_id()).count().count()
    assert tasks == 4 and grid.where("row_idx >= 0").count() == 30_001


def test_a_staged_grid_is_dealt_to_tasks_without_a_shuffle(spark, tmp_path, monkeypatch):
    from floorledger.sources import grid as G

    monkeypatch.setattr(G, "STAGED_GROUP", 1 << 20, raising=False)
    cells = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.sha2(F.concat_ws("-", "id", k), 256))
    columns = {"path": F.lit("x.xlsx"), "modified": F.lit(None).cast("timestamp"), "sheet": F.lit("Hoja"), "sheet_idx": F.lit(0)}
    made = spark.range(0, 40_000, 1, 1).withColumns(columns | {"row_idx": F.col("id").cast("int"), "cells": cells, "error": F.lit(None).cast("string")})
    before = {p.name for p in tmp_path.iterdir()}
    staged = G.stage_grid(made.select(*[f for f in G.S.GRID_SCHEMA.names]), str(tmp_path / "grid"))
    assert not before and len(list((tmp_path / "grid").glob("part-*"))) == 1  # one task wrote it
    rows = staged.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 2 and sum(r["count"] for r in rows) == 40_000
