"""Grids, headers, binding and cleaning, on hand-written sheets and on written workbooks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from floorledger import schema as S
from floorledger.operators import cleaning, headers, lookups
from floorledger.plans.load import clean_grid, open_workbook, process_workbook, workbook_attendants
from floorledger.sources.grid import is_workbook_name, pick_sheet, read_workbooks, rejected_files, unreadable
from workbooks import write_workbook

D = dt.datetime
OPS = ["Fecha", "Jornada", "Monto", "Slot Attendant"]
PRIZES = ["Hora", "Monto Transferido", "Transferencia Final", "Slot Attendant", "Tipo de Pago", "Cliente", "Máquina"]


def grid(spark, files: dict[str, list[tuple[int, list]]]):
    rows = [(p, None, "Hoja1", 0, i, cells, None) for p, data in files.items() for i, cells in data]
    return spark.createDataFrame(rows, S.GRID_SCHEMA)


def test_header_rows(spark):
    title = ["Reporte", None]
    files = {
        "first": [(0, OPS), (1, ["x"])],
        "later": [*[(i, title) for i in range(7)], (7, OPS)],
        "last": [(0, title), (29, OPS)],
        "too_late": [(0, title), (30, OPS)],
        "prizes": [(0, title), (3, PRIZES)],
        "stripped": [(0, title), (2, [" Fecha", "Jornada\t", " Monto "])],
        "case": [(0, title), (2, ["fecha", "Jornada", "Monto"])],
        "two": [(1, OPS), (2, PRIZES)],
    }
    found = {r["path"]: r["header_row"] for r in headers.detect_headers(grid(spark, files)).collect()}
    assert found == {"first": 0, "later": 7, "last": 29, "too_late": 0, "prizes": 3, "stripped": 2, "case": 0, "two": 1}


def test_kind_needs_both_markers(spark):
    files = {
        "both": [(0, PRIZES)],
        "one": [(0, ["Fecha", "Jornada", "Monto", "Transferencia Final"])],
        "other": [(0, OPS)],
    }
    kinds = {r["path"]: r["Tipo"] for r in headers.sheet_headers(grid(spark, files)).collect()}
    assert kinds == {"both": "PREMIOS", "one": "GETNET", "other": "GETNET"}


def test_missing_columns_are_named_and_their_sheets_left_out(spark):
    files = {"good": [(0, OPS), (1, ["2024-01-02 11:00:00", "2024-01-02", "5", "A"])],
             "bad": [(0, ["Fecha", "Jornada", "Monto"]), (1, ["2024-01-02 11:00:00", "2024-01-02", "5"])]}
    batch, errors = clean_grid(grid(spark, files))
    assert [r["path"] for r in batch.collect()] == ["good"]
    assert [tuple(r) for r in errors.collect()] == [("bad", "missing column: Attendant")]


def test_prize_sheet_rules(spark):
    rows = [
        (5, PRIZES),
        (6, ["01/02/2024 09:59:59", "0", "5", "A", "Jackpot HP", "c1", "M1"]),
        (7, ["01/02/2024 08:59:59", "0", "6", "A", "Jackpot HP", "c2", None]),
        (8, ["01/02/2024 10:00:00", "0", "x", "B", None, "c3", "M2"]),
        (9, ["??", "0", "5", "B", None, "c3", "M2"]),
        (10, ["01/02/2024 11:00:00", "0", "5", None, None, "c3", "M2"]),
    ]
    batch, _ = clean_grid(grid(spark, {"p": rows}))
    got = batch.select("Fecha", "Jornada", "Mes", "Hora", "Monto", "FormaPago", "IdCliente", "Maquina", "Propina", "Voucher")
    assert sorted((tuple(r) for r in got.collect())) == [
        (D(2024, 2, 1, 8, 59, 59), D(2024, 1, 31), "2024-01", 8, 6.0, "Jackpot HP", "c2", None, 0.0, ""),
        (D(2024, 2, 1, 10), D(2024, 2, 1), "2024-02", 10, 0.0, None, "c3", "M2", 0.0, ""),
    ]


def test_given_operating_day_is_kept_and_its_time_dropped(spark):
    header = ["Fecha", "Jornada", "Monto Transferido", "Transferencia Final", "Slot Attendant"]
    rows = [(0, header), (1, ["2024-02-01 01:00:00", "2024-05-06 13:00:00", "0", "5", "A"]),
            (2, ["2024-02-01 01:00:00", None, "0", "5", "A"])]
    batch, _ = clean_grid(grid(spark, {"p": rows}))
    got = [(r["Jornada"], r["JornadaDia"], r["Mes"]) for r in batch.collect()]
    assert got == [(D(2024, 5, 6, 13), dt.date(2024, 5, 6), "2024-05")]


def test_both_ways_of_the_lookup_join_agree(spark):
    large = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    for how in ("inner", "left", "left_semi"):
        near = lookups.lookup_join(large, small, ["k"], how)
        far = lookups.lookup_join(large, small, ["k"], how, broadcast_bytes=0)
        assert sorted(map(str, near.collect())) == sorted(map(str, far.collect())), how
    assert "BroadcastHashJoin" not in lookups.lookup_join(large, small, ["k"], "inner", 0)._jdf.queryExecution().executedPlan().toString()


def test_the_lookup_join_reads_only_needed_columns(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 AS k", "id AS v", "uuid() AS unused").write.parquet(str(tmp_path / "large"))
    small = spark.createDataFrame([(0,), (1,)], "k long")
    for limit in (0, 1 << 20):
        joined = lookups.lookup_join(spark.read.parquet(str(tmp_path / "large")), small, ["k"], "left_semi", limit).groupBy("k").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<k:bigint>" in plan


def test_missing_value_spellings_are_nulls(spark):
    rows = [(0, [*OPS, "Id Cliente"])] + [(i + 1, ["2024-01-02 11:00:00", "2024-01-02", "5", name, "NA"]) for i, name in enumerate(["Ana", *S.MISSING_TEXT, " NA ", "Nan"])]
    batch, _ = clean_grid(grid(spark, {"p": rows}))
    assert sorted((r["Attendant"], r["IdCliente"]) for r in batch.collect()) == [(" NA ", None), ("Ana", None), ("Nan", None)]


def test_named_cells_keep_unknown_and_repeated_columns(spark):
    rows = [(0, [*OPS, "Monto", None, "Extra"]), (1, ["a", "b", "c", "d", "e", "f", "g"])]
    for names in (["Monto", "Monto", "Monto.1"], ["Unnamed: 1", None, "Unnamed: 1"], []):
        odd = grid(spark, {"p": [(0, names), (1, ["a", "b", "c"])]})
        fields = headers.named_cells(odd, headers.detect_headers(odd)).collect()
        assert [sorted(r["fields"].values()) for r in fields] == ([["a", "b", "c"]] if names else [])
    cells = grid(spark, {"p": rows})
    got = headers.named_cells(cells, headers.detect_headers(cells)).first()["fields"]
    assert got == {"Fecha": "a", "Jornada": "b", "Monto": "c", "Slot Attendant": "d", "Monto.1": "e", "Unnamed: 5": "f", "Extra": "g"}


def test_workbook_cells(spark, tmp_path):
    write_workbook(
        str(tmp_path / "Ops.XLSX"),
        {
            "Uno": [
                ["Informe"], [], [*OPS, "Id Cliente", "Voucher"],
                [D(2024, 2, 1, 1, 0), D(2024, 1, 31), 12.5, "Ana & Co", 123, "inline:V 1"],
                [D(2024, 2, 1, 10, 5, 30), "01/02/2024", "7", "Bea", None, True],
                [D(2024, 2, 1, 11), D(2024, 2, 1), "#N/A", "Bea", 1.25, None],
            ],
            "Dos": [["nada"]],
        },
    )
    (tmp_path / "notes.txt").write_text("no workbook")
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip file")
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf")
    raw = read_workbooks(spark, str(tmp_path)).cache()
    first = {r["row_idx"]: r["cells"] for r in pick_sheet(raw).collect()}
    assert first[2] == [*OPS, "Id Cliente", "Voucher"]
    assert first[3] == ["2024-02-01 01:00:00", "2024-01-31 00:00:00", "12.5", "Ana & Co", "123", "V 1"]
    assert first[4] == ["2024-02-01 10:05:30", "01/02/2024", "7", "Bea", None, "True"]
    assert first[5][2] is None
    other = read_workbooks(spark, str(tmp_path), sheet="Dos")
    assert [r["cells"] for r in pick_sheet(other, "Dos").collect()] == [["nada"]]
    assert [r["path"].rsplit("/", 1)[1] for r in unreadable(raw).collect()] == ["broken.xlsx"]
    rejected = {r["path"].rsplit("/", 1)[1]: r["error"] for r in rejected_files(spark, str(tmp_path)).collect()}
    assert rejected == {"old.xls": "legacy .xls workbooks cannot be read", "notes.txt": "not a workbook"}


def test_one_workbook_to_reports(spark, tmp_path):
    path = write_workbook(
        str(tmp_path / "p.xlsx"),
        {"Hoja1": [PRIZES, [D(2024, 2, 1, 1), 0, 5, "Ana", "Jackpot HP", "c", "M1"], [D(2024, 2, 1, 12), 0, 6, "Bea", "other", "c", "M1"]]},
    )
    reports = process_workbook(spark, path)
    assert list(reports)[-3:] == [S.MACHINE_MONTH, S.MACHINE_TOTAL, S.QA]
    assert [tuple(r) for r in reports[S.MACHINE_TOTAL].collect()] == [("M1", 1, 5.0, 0, 0, 0)]
    assert [r["Attendant"] for r in workbook_attendants(spark, path).collect()] == ["Ana", "Bea"]
    filtered = process_workbook(spark, path, selection=["Bea"])
    assert [tuple(r) for r in filtered[S.MONTHLY_SUMMARY].collect()] == [("Febrero 2024", 1, 6.0)]


def test_one_workbook_errors_name_the_column(spark, tmp_path):
    path = write_workbook(str(tmp_path / "p.xlsx"), {"Hoja1": [["Fecha", "Jornada", "Attendant"], ["x", "y", "z"]]})
    with pytest.raises(ValueError, match="missing column: Monto"):
        open_workbook(spark, path)
    with pytest.raises(ValueError, match="no such sheet"):  # from the decoder
        open_workbook(spark, path, "Otra")


def test_workbook_names(spark):
    names = ["a.xlsx", "b.XLS", "c.csv", "xlsx", ".xlsx", "d.xlsx.bak"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in rows.where(is_workbook_name(F.col("n"))).collect()] == ["a.xlsx", "b.XLS"]


def test_incomplete_rows_and_hour_nine(spark):
    rows = [(D(2024, 1, 1, h), D(2024, 1, 1), "A") for h in range(24)] + [(None, D(2024, 1, 1), "A"), (D(2024, 1, 1), None, "A"), (D(2024, 1, 1), D(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "Fecha timestamp_ntz, Jornada timestamp_ntz, Attendant string")
    assert sorted(r["Hora"] for r in cleaning.complete_batch(df).collect()) == [h for h in range(24) if h != 9]
