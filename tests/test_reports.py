"""Reports on a small hand-written batch, and identities between reports on the generated tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from floorledger import schema as S
from floorledger.catalogue import queries as Q
from floorledger.operators import reports as R
from floorledger.operators import selection
from floorledger.plans.publish import chart_json, hour_chart, manifest, month_chart, publish, slug
from floorledger.plans.report_set import generate_reports, prepare_reports, select_reports
from floorledger.plans.rollup import roll_up

SF = "/root/testdata/sf0.001"
D = dt.datetime
FOUR = ["Premios", "MDC purse clear", "Cancel Credit", "Chip Cash HandPay"]


def batch(spark, rows, kind=S.GETNET):
    """rows: (moment, operating day, amount, attendant, payment, machine)"""
    data = [(kind, f, j, j.date(), f"{j:%Y-%m}", f.hour, m, a, "", p, "", "", "", 0.0, q) for f, j, m, a, p, q in rows]
    return spark.createDataFrame(data, S.CANONICAL_SCHEMA)


JAN, FEB = D(2024, 1, 31), D(2024, 2, 1)
ROWS = [
    (D(2024, 2, 1, 1), JAN, 10.0, "Ana", "Jackpot HP", "M1"),
    (D(2024, 1, 31, 12), JAN, 20.0, "Ana", "Cancel Credit", "M1"),
    (D(2024, 2, 1, 12), FEB, 30.0, "Ana", "other", "M2"),
    (D(2024, 2, 1, 13), FEB, 40.0, "Ana", "Jackpot HP", None),
    (D(2024, 2, 1, 14), FEB, 50.0, "Bea", "MDC purse clear", "M1"),
    (D(2024, 2, 1, 14, 30), FEB, 0.1, "Bea", "progresive jackpot hp", "M1"),
]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def prizes(spark):
    return batch(spark, ROWS, S.PREMIOS).cache()


def test_card_reports(spark):
    got = generate_reports(batch(spark, ROWS), S.GETNET)
    assert list(got) == [S.MONTHLY_SUMMARY, S.HOURLY_OPERATIONS, S.ATTENDANT_RECORD, S.ATTENDANT_MONTH,
                         S.OPERATION_COUNT, S.ANNUAL_DETAIL, S.ANNUAL_TOTAL, S.QA]
    assert rows_of(got[S.MONTHLY_SUMMARY]) == [("Enero 2024", 2, 30.0), ("Febrero 2024", 4, 120.1)]
    hours = rows_of(got[S.HOURLY_OPERATIONS])
    assert [h for h, _, _ in hours] == [str(h) for h in S.HOUR_ORDER]
    assert {h: (n, m) for h, n, m in hours if n} == {"12": (2, 50.0), "13": (1, 40.0), "14": (2, 50.1), "1": (1, 10.0)}
    # Ana has two operations on both days: the earlier day wins; ties between attendants go by name
    assert rows_of(got[S.ATTENDANT_RECORD]) == [("Ana", JAN.date(), 2), ("Bea", FEB.date(), 2)]
    assert rows_of(got[S.ATTENDANT_MONTH]) == [
        ("Ana", "Enero 2024", 2, 30.0), ("Ana", "Febrero 2024", 2, 70.0), ("Bea", "Febrero 2024", 2, 50.1)]
    assert rows_of(got[S.OPERATION_COUNT]) == [("Enero 2024", "Ana", 2), ("Febrero 2024", "Ana", 2), ("Febrero 2024", "Bea", 2)]
    assert rows_of(got[S.ANNUAL_DETAIL]) == rows_of(got[S.ANNUAL_TOTAL]) == [("Ana", 4), ("Bea", 2)]
    assert rows_of(got[S.QA]) == [("filas_usadas", "6"), ("min_fecha", "2024-01-31 12:00:00"),
                                  ("max_fecha", "2024-02-01 14:30:00"), ("horas_presentes", "1, 12, 13, 14")]


def test_prize_reports(prizes):
    got = generate_reports(prizes, S.PREMIOS)
    assert list(got)[-3:] == [S.MACHINE_MONTH, S.MACHINE_TOTAL, S.QA]
    assert got[S.ATTENDANT_MONTH].columns == ["Attendant", "Mes", "Operaciones"]
    assert got[S.OPERATION_COUNT].columns == ["Mes", "Attendant", *FOUR]
    assert rows_of(got[S.OPERATION_COUNT]) == [
        ("Enero 2024", "Ana", 1, 0, 1, 0), ("Febrero 2024", "Ana", 1, 0, 0, 0), ("Febrero 2024", "Bea", 1, 1, 0, 0)]
    assert rows_of(got[S.ANNUAL_DETAIL]) == [("Ana", 2, 0, 1, 0), ("Bea", 1, 1, 0, 0)]
    assert rows_of(got[S.ANNUAL_TOTAL]) == [("Ana", 3), ("Bea", 2)]
    # M2 has no classified row, one row has no machine
    assert got[S.MACHINE_MONTH].columns == ["Mes", "Maquina", "Premios", "Monto", *FOUR[1:]]
    assert rows_of(got[S.MACHINE_MONTH]) == [("Enero 2024", "M1", 1, 10.0, 0, 1, 0), ("Febrero 2024", "M1", 1, 0.1, 1, 0, 0)]
    assert rows_of(got[S.MACHINE_TOTAL]) == [("M1", 2, 10.1, 1, 1, 0)]


def test_prizes_without_payment_type(prizes):
    got = generate_reports(prizes.drop("FormaPago"), S.PREMIOS)
    assert got[S.OPERATION_COUNT].columns == ["Mes", "Attendant", "Operaciones"]
    assert rows_of(got[S.MACHINE_MONTH]) == rows_of(got[S.MACHINE_TOTAL]) == []
    assert got[S.MACHINE_MONTH].columns == []


@pytest.mark.parametrize("kind", [S.GETNET, S.PREMIOS])
def test_empty_input_keeps_columns(spark, prizes, kind):
    full, empty = generate_reports(prizes, kind), generate_reports(batch(spark, [], kind), kind)
    assert {n: r.columns for n, r in full.items()} == {n: r.columns for n, r in empty.items()}
    for name, report in empty.items():
        got = rows_of(report)
        if name == S.HOURLY_OPERATIONS:
            assert len(got) == 23 and {(n, m) for _, n, m in got} == {(0, 0.0)}
        elif name == S.QA:
            assert got == [("filas_usadas", "0"), ("min_fecha", "NaT"), ("max_fecha", "NaT"), ("horas_presentes", "")]
        else:
            assert got == []


def test_filter_in_both_modes(prizes):
    whole = generate_reports(prizes, S.PREMIOS)
    only = generate_reports(prizes, S.PREMIOS, ["Bea"])
    in_file = prepare_reports(prizes, S.PREMIOS, ["Bea"], mode="file")
    in_history = prepare_reports(prizes, S.PREMIOS, ["Bea"], mode="history")
    for name in whole:
        expected = whole if name in S.FILTER_EXEMPT else only
        assert rows_of(in_file[name]) == rows_of(expected[name]), name
        assert rows_of(in_history[name]) == rows_of(only[name]), name
    assert rows_of(only[S.MONTHLY_SUMMARY]) == [("Febrero 2024", 2, 50.1)]
    with pytest.raises(ValueError):
        prepare_reports(prizes, S.PREMIOS, mode="other")


def test_download_override_counts_in_file_mode_only(prizes):
    total = S.ANNUAL_TOTAL
    in_file = prepare_reports(prizes, S.PREMIOS, ["Ana"], mode="file", override=["Bea"])
    in_history = prepare_reports(prizes, S.PREMIOS, ["Ana"], mode="history", override=["Bea"])
    assert rows_of(in_file[total]) == [("Bea", 2)]
    assert rows_of(in_history[total]) == [("Ana", 3)]


def test_selection_table_equals_list(spark, prizes):
    table = spark.createDataFrame([("Bea",), ("Bea",), (None,)], "Attendant string")
    by_table = selection.filter_attendants(prizes, table).select(*prizes.columns)
    assert sorted(rows_of(by_table)) == sorted(rows_of(selection.filter_attendants(prizes, ["Bea"])))
    assert selection.filter_attendants(prizes, []) is prizes
    assert selection.filter_attendants(prizes, table.limit(0)) is prizes


def test_full_selection_is_recognised(spark, prizes):
    table = spark.createDataFrame([("Bea",), ("Ana",)], "Attendant string")
    assert all(selection.covers_everyone(prizes, s) for s in (None, [], ["Ana", "Bea"], table))
    assert not any(selection.covers_everyone(prizes, s) for s in (["Ana"], ["Ana", "Bea", "Cid"], ["Cid"]))
    shown = prepare_reports(prizes, S.PREMIOS, ["Bea", "Ana"], check_full_selection=True)
    assert rows_of(shown[S.ANNUAL_TOTAL]) == [("Ana", 3), ("Bea", 2)]


def test_report_selection_keeps_bundle_order(prizes):
    reports = generate_reports(prizes, S.PREMIOS)
    assert list(select_reports(reports, [S.QA, S.MONTHLY_SUMMARY, "unknown"])) == [S.MONTHLY_SUMMARY, S.QA]
    assert list(select_reports(reports, [])) == list(select_reports(reports)) == list(reports)


def test_attendant_lists(spark, prizes):
    assert rows_of(selection.attendants(prizes)) == [("Ana",), ("Bea",)]
    assert rows_of(selection.search_attendants(prizes, "BE")) == [("Bea",)]


def test_rollups_give_the_same_reports(prizes):
    direct, rolled = generate_reports(prizes, S.PREMIOS), generate_reports(roll_up(prizes), S.PREMIOS)
    assert {n: rows_of(r) for n, r in direct.items()} == {n: rows_of(r) for n, r in rolled.items()}
    direct = generate_reports(prizes, S.PREMIOS, ["Bea"])
    rolled = generate_reports(roll_up(prizes), S.PREMIOS, ["Bea"])
    assert {n: rows_of(r) for n, r in direct.items()} == {n: rows_of(r) for n, r in rolled.items()}


def test_identities_on_generated_tables(spark):
    ops, prizes = Q.ops(spark, SF).cache(), Q.prizes(spark, SF).cache()
    used = int(R.quality(ops).first()["Valor"])
    assert used == ops.count()
    for report in (R.monthly_summary(ops), R.hourly_operations(ops), R.annual_count(ops), R.operation_count(ops)):
        assert report.agg(F.sum("Operaciones")).first()[0] == used
    month = R.machine_grouping_sets(prizes).where("Mes IS NOT NULL").groupBy("Maquina").agg(F.sum("Premios").alias("p"))
    total = R.machine_total(prizes).select("Maquina", F.col("Premios").alias("p"))
    assert sorted(rows_of(month)) == sorted(rows_of(total))
    assert rows_of(R.machine_month_joined(prizes)) == rows_of(R.machine_month(prizes))
    detail = {r["Attendant"]: sum(r[c] for c in FOUR) for r in R.annual_count_by_class(prizes).collect()}
    assert detail == dict(rows_of(R.annual_count_classified(prizes)))


def test_row_order_is_total(spark):
    prizes = Q.prizes(spark, SF).cache()
    raw = R.machine_month(prizes.withColumn("Mes", F.concat(F.col("Mes"), F.lit("-x")))).collect()
    assert raw == sorted(raw, key=lambda r: (r["Mes"], -r["Premios"], r["Maquina"]))
    record = R.attendant_record(prizes).collect()
    assert record == sorted(record, key=lambda r: (-r["TotalOperaciones"], r["Attendant"]))


def test_charts(spark):
    ops = batch(spark, ROWS)
    month = month_chart(ops).first()
    assert (month["labels"], month["ops"], month["monto"]) == (["Enero 2024", "Febrero 2024"], [2, 4], [30.0, 120.1])
    hour = hour_chart(ops).first()
    assert hour["labels"] == [str(h) for h in S.HOUR_ORDER] and sum(hour["ops"]) == 6
    for chart in (month_chart, hour_chart):
        assert tuple(chart(batch(spark, [])).first()) == ([], [], [])
    assert chart_json(month_chart(ops)).first()["json"].startswith('{"labels":["Enero 2024"')


def test_bundle(spark, prizes, tmp_path):
    reports = generate_reports(prizes, S.PREMIOS)
    listed = rows_of(manifest(reports))
    assert [r[0] for r in listed] == list(range(10))
    assert listed[7][1:] == (S.MACHINE_MONTH, "Conteo mensual de operaciones p", 2)
    folders = publish(reports, str(tmp_path), "csv")
    assert [f.rsplit("/", 1)[1] for f in folders] == [slug(n) for n in reports]
    back = spark.read.option("header", True).csv(folders[0])
    assert sorted(rows_of(back)) == [("Enero 2024", "2", "30.0"), ("Febrero 2024", "4", "120.1")]
