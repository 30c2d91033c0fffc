"""Month replacement, bulk loads, rollup tables and the drop folder."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from floorledger import schema as S
from floorledger.catalogue import queries as Q
from floorledger.operators.uploads import latest_upload_wins
from floorledger.plans.load import load_folder, replay
from floorledger.plans.report_set import generate_reports
from floorledger.plans.rollup import read_rollups, write_rollups
from floorledger.sources import versions
from floorledger.sources.history import create_tables, read_history, receipt, write_history
from floorledger.sources.versions import Replacement, expire, numbers, read_table, roll_back, snapshot
from floorledger.streaming.drop_folder import follow_batches, follow_folder, read_errors
from workbooks import write_workbook

SF = "/root/testdata/sf0.001"
D = dt.datetime
OPS = ["Fecha", "Jornada", "Monto", "Slot Attendant", "Voucher"]
PRIZES = ["Hora", "Monto Transferido", "Transferencia Final", "Slot Attendant", "Tipo de Pago"]


def op(day, amount, name="Ana", voucher=None):
    return [D(2024, *day, 12), D(2024, *day), amount, name, voucher]


def prize(day, amount, name="Ana"):
    return [D(2024, *day, 12), 0, amount, name, "Jackpot HP"]


def stored(spark, root, kind=S.GETNET):
    return sorted((r["Mes"], r["Monto"]) for r in read_history(spark, root, kind).collect())


def canonical(spark, rows, kind=S.GETNET):
    data = [(kind, D(2024, m, d, 12), D(2024, m, d), dt.date(2024, m, d), f"2024-{m:02}", 12, a, "Ana", "", None, "", "", "", 0.0, "") for (m, d), a in rows]
    return spark.createDataFrame(data, S.CANONICAL_SCHEMA)


def test_only_the_months_of_a_batch_are_replaced(spark, tmp_path):
    root = str(tmp_path)
    create_tables(spark, root)
    assert stored(spark, root) == []
    january, february = ((1, 5), 1.0), ((2, 5), 2.0)
    assert receipt(write_history(canonical(spark, [january, february, february]), root)) == (3, S.GETNET)
    assert receipt(write_history(canonical(spark, [((2, 6), 9.0)]), root)) == (1, S.GETNET)
    assert stored(spark, root) == [("2024-01", 1.0), ("2024-02", 9.0)]
    assert receipt(write_history(canonical(spark, [((2, 6), 9.0)]), root)) == (1, S.GETNET)
    assert stored(spark, root) == [("2024-01", 1.0), ("2024-02", 9.0)]
    create_tables(spark, root)
    assert stored(spark, root) == [("2024-01", 1.0), ("2024-02", 9.0)]


STEPS = ["operaciones", "premios", "rollup_people_getnet", "rollup_machines_getnet", "rollup_people_premios", "rollup_machines_premios"]


class Broken(Exception):
    pass


def everything(spark, root):
    """All rows of both histories, and all reports from the rollups."""
    rows = [stored(spark, root, kind) for kind in (S.GETNET, S.PREMIOS)]
    reports = [generate_reports(read_rollups(spark, root, kind), kind) for kind in (S.GETNET, S.PREMIOS)]
    return rows, [[tuple(r) for r in one[S.MONTHLY_SUMMARY].collect()] for one in reports]


def test_a_write_that_breaks_off_anywhere_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    create_tables(spark, root)
    extra = {"modified": F.lit(None).cast("timestamp"), "path": F.lit("p")}
    both = lambda a, b: canonical(spark, a).unionByName(canonical(spark, b, S.PREMIOS)).withColumns(extra)
    replay(both([((1, 5), 1.0), ((2, 5), 2.0)], [((2, 5), 3.0)]), root, rollups=True)
    old, second = everything(spark, root), both([((2, 6), 7.0), ((3, 1), 8.0)], [((2, 7), 9.0), ((4, 7), 9.5)])
    write, make = Replacement.write, versions.Folder.make

    def after(step):
        def stop(self, rows, table, month="mes"):
            out = write(self, rows, table, month)
            if table == step:
                raise Broken
            return out

        return stop

    def inside(step):
        def stop(self, rows, table, month="mes"):
            if table == step:
                broken = rows.withColumn(month, F.when(F.col(month) > "2024-02", F.raise_error(F.lit("broken off"))).otherwise(F.col(month)))
                return write(self, broken, table, month)
            return write(self, rows, table, month)

        return stop

    for step in STEPS:
        for how in (inside, after) if step in STEPS[1:3] else (after,):
            monkeypatch.setattr(Replacement, "write", how(step))
            with pytest.raises(Exception):  # noqa: B017
                replay(second, root)
            assert everything(spark, root) == old, (step, how)
    monkeypatch.setattr(Replacement, "write", write)

    def no_make(self, name, text):
        raise Broken

    monkeypatch.setattr(versions.Folder, "make", no_make)
    with pytest.raises(Broken):
        replay(second, root)
    assert everything(spark, root) == old
    monkeypatch.setattr(versions.Folder, "make", make)
    assert replay(second, root)[0] == {S.GETNET: 2, S.PREMIOS: 2}
    new = everything(spark, root)
    assert new[0] == [[("2024-01", 1.0), ("2024-02", 7.0), ("2024-03", 8.0)], [("2024-02", 9.0), ("2024-04", 9.5)]]
    assert [r[2] for r in new[1][0]] == [1.0, 7.0, 8.0] and [r[2] for r in new[1][1]] == [9.0, 9.5]
    # back to the first load, and forth again
    first = numbers(spark, root)[1]
    roll_back(spark, root, first)
    assert everything(spark, root) == old
    roll_back(spark, root, first + 1)
    assert everything(spark, root) == new
    assert not expire(spark, root, keep=1)  # too young
    gone = expire(spark, root, keep=1, hours=0.0)
    assert len(gone) > 10 and everything(spark, root) == new and numbers(spark, root) == [snapshot(spark, root).number]


def test_writers_beside_each_other_lose_nothing(spark, tmp_path):
    root = str(tmp_path)
    create_tables(spark, root)
    reader = read_history(spark, root, S.GETNET)
    first, second = Replacement(spark, root), Replacement(spark, root)
    write_history(canonical(spark, [((1, 5), 1.0), ((2, 5), 2.0)]), root, change=first)
    write_history(canonical(spark, [((2, 6), 3.0), ((3, 6), 4.0)]), root, change=second)
    assert stored(spark, root) == []
    second.publish()
    held = read_history(spark, root, S.GETNET)
    first.publish()  # the last to publish supplies February
    assert stored(spark, root) == [("2024-01", 1.0), ("2024-02", 2.0), ("2024-03", 4.0)]
    assert sorted(r["Monto"] for r in held.collect()) == [3.0, 4.0] and reader.count() == 0
    assert sorted(r["Monto"] for r in read_history(spark, root, S.GETNET, number=snapshot(spark, root).number - 1).collect()) == [3.0, 4.0]
    taken = versions.Folder(spark, f"{root}/{versions.PUBLISHED}")
    assert not taken.make(f"{snapshot(spark, root).number:012d}.json", "{}") and stored(spark, root)
    with pytest.raises(FileNotFoundError):
        read_history(spark, str(tmp_path / "nowhere"), S.GETNET)


def test_empty_batch_writes_nothing(spark, tmp_path):
    root = str(tmp_path)
    create_tables(spark, root)
    write_history(canonical(spark, [((1, 5), 1.0)]), root)
    assert receipt(write_history(canonical(spark, []), root)) == (0, "No data")
    assert stored(spark, root) == [("2024-01", 1.0)]


def test_kinds_go_to_their_own_tables(spark, tmp_path):
    root = str(tmp_path)
    create_tables(spark, root)
    both = canonical(spark, [((1, 5), 1.0)]).unionByName(canonical(spark, [((1, 5), 2.0)], S.PREMIOS))
    assert write_history(both, root) == {S.GETNET: 1, S.PREMIOS: 1}
    assert stored(spark, root) == [("2024-01", 1.0)] and stored(spark, root, S.PREMIOS) == [("2024-01", 2.0)]
    row = read_history(spark, root, S.PREMIOS).first()
    assert (row["FormaPago"], row["Maquina"], row["Tipo"], row["JornadaDia"]) == ("nan", "", S.PREMIOS, dt.date(2024, 1, 5))


def test_a_large_month_is_written_in_several_files(spark, tmp_path):
    rows = spark.range(0, 200_000).select(F.lit("2024-01").alias("mes"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        change = Replacement(spark, str(tmp_path))
        assert change.write(rows, "t") == 200_000
        change.publish()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "t" / f"version={change.version}" / "mes=2024-01").glob("*.parquet"))) > 1
    assert read_table(spark, str(tmp_path), "t", StructType.fromDDL("t string, mes string")).count() == 200_000


def test_history_scan_prunes_months_and_columns(spark, tmp_path, capsys):
    root = str(tmp_path)
    write_history(canonical(spark, [((1, 5), 1.0), ((2, 5), 2.0)]), root)
    read_history(spark, root, S.GETNET).where("Mes = '2024-02'").groupBy("Mes").agg(F.sum("Monto")).explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(mes" in plan and "ReadSchema: struct<monto:double>" in plan


def test_bulk_load_equals_sequential_loads(spark, tmp_path):
    one, drop = str(tmp_path / "one"), tmp_path / "drop"
    drop.mkdir()
    write_workbook(str(drop / "b.xlsx"), {"H": [OPS, op((1, 5), 1), op((2, 5), 2)]}, modified=1_000)
    write_workbook(str(drop / "a.xlsx"), {"H": [["titulo"], OPS, op((2, 6), 3), op((2, 7), 4), op((3, 1), 5, None)]}, modified=2_000)
    write_workbook(str(drop / "p.xlsx"), {"H": [PRIZES, prize((2, 8), 6)]}, modified=500)
    write_workbook(str(drop / "bad.xlsx"), {"H": [["Fecha", "Jornada", "Monto"], [1, 2, 3]]}, modified=3_000)
    (drop / "broken.xlsx").write_bytes(b"x")
    create_tables(spark, one)
    result = load_folder(spark, str(drop), one, staging=str(tmp_path / "staging"), rollups=True)
    assert result.written == {S.GETNET: 3, S.PREMIOS: 1}
    assert sorted(r["path"].rsplit("/", 1)[1] for r in result.errors.collect()) == ["bad.xlsx", "broken.xlsx"]
    # the March row has no attendant, so March is not touched
    assert stored(spark, one) == [("2024-01", 1.0), ("2024-02", 3.0), ("2024-02", 4.0)]
    assert stored(spark, one, S.PREMIOS) == [("2024-02", 6.0)]
    for kind in (S.GETNET, S.PREMIOS):
        direct = generate_reports(read_history(spark, one, kind), kind)
        rolled = generate_reports(read_rollups(spark, one, kind), kind)
        for name in direct:
            assert direct[name].collect() == rolled[name].collect(), name


def cut_workbook(path, rows):
    """A workbook whose sheet ends in the middle of its rows."""
    write_workbook(path, {"H": rows})
    with zipfile.ZipFile(path) as book:
        parts = {n: book.read(n) for n in book.namelist()}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, data in parts.items():
            book.writestr(name, data[: int(len(data) * 0.8)] if "sheet1" in name else data)


def test_an_upload_is_loaded_whole_or_listed_once(spark, tmp_path):
    root, drop = str(tmp_path / "root"), tmp_path / "drop"
    (drop / "sub").mkdir(parents=True)
    create_tables(spark, root)
    write_history(canonical(spark, [((1, 5), 10.0), ((1, 6), 11.0)]), root)
    cut_workbook(str(drop / "cut.xlsx"), [OPS, *[op((1, 1 + i % 28), i) for i in range(6000)]])
    write_workbook(str(drop / "two.xlsx"), {"H": [OPS, op((2, 5), 2)], "Other": [["x"]]})
    with zipfile.ZipFile(drop / "two.xlsx") as book:
        parts = {n: book.read(n) for n in book.namelist()}
    with zipfile.ZipFile(drop / "two.xlsx", "w") as book:
        for name, data in parts.items():
            book.writestr(name, b"<damaged" if "sheet2" in name else data)
    write_workbook(str(drop / "empty.xlsx"), {"H": [], "Other": [OPS, op((3, 5), 3)]})
    write_workbook(str(drop / "sub" / "low.xlsx"), {"H": [[]] * 35 + [OPS, op((4, 5), 4)]})
    (drop / "old.xls").write_bytes(b"\xd0\xcf")
    result = load_folder(spark, str(drop), root, staging=str(tmp_path / "staging"))
    assert result.written == {S.GETNET: 1}
    assert stored(spark, root) == [("2024-01", 10.0), ("2024-01", 11.0), ("2024-02", 2.0)]
    errors = sorted((r["path"].rsplit("/", 1)[1], r["error"]) for r in result.errors.collect())
    assert [e[0] for e in errors] == ["cut.xlsx", "empty.xlsx", "low.xlsx", "old.xls"]
    assert [e[1] for e in errors[1:]] == [
        "no such sheet, or an empty one", "no header in the first rows", "legacy .xls workbooks cannot be read",
    ]
    named = load_folder(spark, str(drop), root, sheet="Other", staging=str(tmp_path / "staging"))
    assert named.written == {S.GETNET: 1} and ("2024-03", 3.0) in stored(spark, root)
    reasons = {r["path"].rsplit("/", 1)[1]: r["error"] for r in named.errors.collect()}
    assert reasons["low.xlsx"] == reasons["cut.xlsx"] == "no such sheet" and "two.xlsx" in reasons


def test_the_load_can_be_replayed(spark, tmp_path):
    root = str(tmp_path)
    create_tables(spark, root)
    staged = canonical(spark, [((1, 5), 1.0), ((2, 5), 2.0)]).withColumns({"modified": F.lit(None).cast("timestamp"), "path": F.lit("p")})
    for _ in range(2):
        assert replay(staged, root, rollups=True)[0] == {S.GETNET: 2}
        assert stored(spark, root) == [("2024-01", 1.0), ("2024-02", 2.0)]


def test_rollup_tables_follow_month_replacement(spark, tmp_path):
    root = str(tmp_path)
    write_rollups(canonical(spark, [((1, 5), 1.0), ((2, 5), 2.0)]), root, S.GETNET)
    write_rollups(canonical(spark, [((2, 6), 9.5), ((2, 6), 0.1)]), root, S.GETNET)
    got = generate_reports(read_rollups(spark, root, S.GETNET), S.GETNET)[S.MONTHLY_SUMMARY].collect()
    assert [tuple(r) for r in got] == [("Enero 2024", 1, 1.0), ("Febrero 2024", 2, 9.6)]


def test_drop_folder_takes_new_files_once(spark, tmp_path):
    root, drop = str(tmp_path / "root"), tmp_path / "drop"
    drop.mkdir()
    create_tables(spark, root)

    def run():
        follow_folder(spark, str(drop), root, str(tmp_path / "state"), files_per_batch=1, staging=str(tmp_path / "staging")).awaitTermination(120)

    write_workbook(str(drop / "a.xlsx"), {"H": [OPS, op((1, 5), 1), op((2, 5), 2)]}, modified=1_600_000_000)
    run()
    assert stored(spark, root) == [("2024-01", 1.0), ("2024-02", 2.0)]
    write_workbook(str(drop / "c.xlsx"), {"H": [OPS, op((2, 5), 4)]}, modified=1_600_000_200)
    write_workbook(str(drop / "b.xlsx"), {"H": [OPS, op((2, 5), 3), op((3, 5), 5)]}, modified=1_600_000_100)
    run()
    assert stored(spark, root) == [("2024-01", 1.0), ("2024-02", 4.0), ("2024-03", 5.0)]


@pytest.mark.parametrize("per_batch", [1, 1000])
def test_drop_folder_order_does_not_depend_on_the_batches(spark, tmp_path, per_batch):
    root, drop, state = str(tmp_path / "root"), tmp_path / "drop", str(tmp_path / "state")
    (drop / "sub").mkdir(parents=True)
    create_tables(spark, root)

    def run():
        follow_folder(spark, str(drop), root, state, per_batch, rollups=True, staging=str(tmp_path / "staging")).awaitTermination(300)

    for k, name in enumerate(["z", "a", "m", "sub/y"]):  # equal times: the last path supplies the month
        write_workbook(str(drop / f"{name}.xlsx"), {"H": [OPS, op((1, 5), k)]}, modified=1_700_000_000)
    (drop / "broken.xlsx").write_bytes(b"x")
    (drop / "notes.txt").write_text("x")
    run()
    assert stored(spark, root) == [("2024-01", 0.0)]
    late = write_workbook(str(drop / "late.xlsx"), {"H": [OPS, op((1, 6), 7)]}, modified=1_700_000_000 - 30 * 86_400)
    assert late
    run()
    assert stored(spark, root) == [("2024-01", 7.0)]
    names = sorted(r["path"].rsplit("/", 1)[1] for r in read_errors(spark, root).collect())
    assert names == ["broken.xlsx", "notes.txt"]


def test_stream_of_uploads_ends_like_one_bulk_load(spark, tmp_path):
    ops = Q.ops(spark, SF).select(*S.CANONICAL_SCHEMA.names[:8], "IdCliente", "FormaPago", "Validador", "Voucher", "upload_seq")
    source, streamed = str(tmp_path / "in"), str(tmp_path / "streamed")
    for seq in range(3):
        # the last upload lacks the months of 1995
        part = ops.where((F.col("upload_seq") == seq) & ((F.col("upload_seq") < 2) | (F.col("Mes") >= "1996")))
        part.coalesce(1).write.mode("append").parquet(source)
        follow_batches(
            spark.readStream.schema(ops.schema).parquet(source), streamed, str(tmp_path / "state")
        ).awaitTermination(120)
    whole = spark.read.schema(ops.schema).parquet(source)
    expected = latest_upload_wins(whole).select("Fecha", "Monto", "Mes").collect()
    got = read_history(spark, streamed, S.GETNET).select("Fecha", "Monto", "Mes").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len(got) > 0
