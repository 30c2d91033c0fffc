"""Views over the test tables (``FIXTURES.md``), as SQL text for Spark and for the checking engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def table(self, name: str) -> str:
        return f"{{{name}}}" if self.spark else name

    def add_seconds(self, t: str, n: str) -> str:
        return f"{t} + INTERVAL '1' SECOND * ({n})" if self.spark else f"{t} + to_seconds({n})"

    def day10(self, t: str) -> str:
        return f"to_date({t} - interval 10 hours)" if self.spark else f"cast({t} - interval 10 hour as date)"

    def fmt(self, t: str, spark_pattern: str, other_pattern: str) -> str:
        return f"date_format({t}, '{spark_pattern}')" if self.spark else f"strftime({t}, '{other_pattern}')"

    def month(self, d: str) -> str:
        return f"left(cast({d} AS string), 7)" if self.spark else self.fmt(d, "", "%Y-%m")

    def day_text(self, d: str) -> str:
        return f"cast({d} AS string)" if self.spark else self.fmt(d, "", "%Y-%m-%d")

    def iso(self, t: str) -> str:
        return f"cast({t} AS string)" if self.spark else self.fmt(t, "", "%Y-%m-%d %H:%M:%S")

    def day_first(self, t: str, mark: str) -> str:
        if not self.spark:
            return self.fmt(t, "", f"%d{mark}%m{mark}%Y %H:%M:%S")
        text = f"cast({t} AS string)"
        return f"concat(substr({text},9,2),'{mark}',substr({text},6,2),'{mark}',left({text},4),substr({text},11))"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def texts(self, *items: str) -> str:
        return self.array(*[f"'{i}'" for i in items])

    def whole(self, x: str, by: int) -> str:
        return f"cast({x} div {by} as int)" if self.spark else f"cast({x} // {by} as integer)"

    def numbers_to(self, n: str) -> str:
        """Table function body: one row per number 0..n as ``i``."""
        return f"explode(sequence(0, cast({n} as int)))" if self.spark else f"unnest(range(0, cast({n} as integer) + 1))"


SPARK, OTHER = Dialect(True), Dialect(False)

OPS_HEADER = ["Fecha", " Jornada ", "Monto", "Slot Attendant", "Id Cliente", "Voucher", "Validador", "Forma Pago"]
PRIZE_HEADERS = [
    ["Momento", "Monto Transferido", "Transferencia Final", "Slot Attendant", "Tipo de Pago", "Cliente", "Máquina", "Propina"],
    ["Transferencia Final", "Slot Attendant", "Monto Transferido", "Fecha", "Tipo de Pago", "Cliente", "Maquina", "Propina"],
    ["Fecha", "Jornada", "Monto Transferido", "Transferencia Final", "Slot Attendant", "Forma Pago", "Id Cliente", "Máquina"],
]


def definitions(d: Dialect) -> dict[str, str]:
    """View name -> SQL; each may use the ones before it."""
    views = {}
    views["ops_raw"] = f"""
SELECT o_orderkey AS k, {d.add_seconds("o_orderdate", "(o_orderkey*7919)%86400")} AS Fecha, o_totalprice AS Monto,
  CASE WHEN o_orderkey%40=0 THEN NULL ELSE concat('ATT_',cast(o_custkey%25 AS varchar(10))) END AS Attendant,
  cast(o_custkey AS varchar(20)) AS IdCliente, concat('V',cast(o_orderkey AS varchar(20))) AS Voucher,
  o_orderstatus AS Validador, o_orderpriority AS FormaPago, o_orderkey%3 AS upload_seq
FROM {d.table("orders")}"""
    views["prizes_raw"] = f"""
SELECT l_orderkey AS k, {d.add_seconds("l_shipdate", "(l_orderkey*7919+l_linenumber*3571)%86400")} AS Fecha,
  l_extendedprice AS Monto, l_tax AS Propina, concat('ATT_',cast(l_suppkey%25 AS varchar(10))) AS Attendant,
  CASE WHEN l_partkey%97=0 THEN NULL ELSE concat('MDA_',cast(l_partkey%50 AS varchar(10))) END AS Maquina,
  CASE l_linenumber WHEN 1 THEN 'Jackpot HP' WHEN 2 THEN ' progresive jackpot hp ' WHEN 3 THEN 'PROGRESSIVE JACKPOT HP'
    WHEN 4 THEN 'MDC Purse Clear' WHEN 5 THEN 'Cancel Credit' WHEN 6 THEN 'Chip Cash HandPay' ELSE 'Other' END AS FormaPago,
  cast(l_partkey AS varchar(20)) AS IdCliente
FROM {d.table("lineitem")}"""
    for name in ("ops", "prizes"):
        views[name] = f"""
SELECT *, {d.day10("Fecha")} AS JornadaDia, {d.month(d.day10("Fecha"))} AS Mes, hour(Fecha) AS Hora
FROM {name}_raw WHERE Attendant IS NOT NULL AND hour(Fecha) <> 9"""
    views["ops_cells"] = f"""
SELECT k, k%4 AS file_no,
  CASE k%3 WHEN 0 THEN {d.iso("Fecha")} WHEN 1 THEN {d.day_first("Fecha", "/")} ELSE {d.day_first("Fecha", "-")} END AS fecha_txt,
  {d.day_text(d.day10("Fecha"))} AS jornada_txt,
  CASE WHEN k%50=7 THEN 'N/A' WHEN k%50=8 THEN NULL ELSE cast(cast(Monto AS decimal(18,2)) AS varchar(30)) END AS monto_txt,
  CASE k%60 WHEN 11 THEN 'N/A' WHEN 12 THEN 'null' ELSE Attendant END AS Attendant, IdCliente, Voucher, Validador, FormaPago
FROM ops_raw"""
    views["prize_cells"] = f"""
SELECT k, k%3 AS file_no,
  CASE k%2 WHEN 0 THEN {d.iso("Fecha")} ELSE {d.day_first("Fecha", "/")} END AS fecha_txt,
  {d.day_text(d.day10("Fecha"))} AS jornada_txt,
  cast(cast(Monto AS decimal(18,2)) AS varchar(30)) AS monto_txt,
  cast(cast(Propina AS decimal(18,2)) AS varchar(30)) AS propina_txt,
  Attendant, CASE WHEN k%70=9 THEN 'None' ELSE FormaPago END AS FormaPago, IdCliente,
  CASE WHEN k%45=3 THEN 'NA' ELSE Maquina END AS Maquina
FROM prizes_raw"""
    views["date_cells"] = f"""
SELECT k, CASE k%10 WHEN 0 THEN {d.iso("Fecha")} WHEN 1 THEN {d.day_first("Fecha", "/")} WHEN 2 THEN {d.day_first("Fecha", "-")}
  WHEN 3 THEN {d.fmt("Fecha", "dd.MM.yyyy HH:mm:ss", "%d.%m.%Y %H:%M:%S")}
  WHEN 4 THEN {d.fmt("Fecha", "yyyy/MM/dd HH:mm", "%Y/%m/%d %H:%M")}
  WHEN 5 THEN {d.fmt("Fecha", "d MMM yyyy HH:mm", "%-d %b %Y %H:%M")}
  WHEN 6 THEN {d.fmt("Fecha", "yyyyMMdd", "%Y%m%d")}
  WHEN 7 THEN {d.fmt("Fecha", "dd/MM/yy", "%d/%m/%y")}
  WHEN 8 THEN {d.fmt("Fecha", "MM/dd/yyyy hh:mm:ss a", "%m/%d/%Y %I:%M:%S %p")}
  ELSE 'N/A' END AS txt
FROM ops_raw"""
    views["ops_grid"] = _grid(
        d, "ops", "ops_cells", 3, 0, [OPS_HEADER] * 4,
        [["fecha_txt", "jornada_txt", "monto_txt", "Attendant", "IdCliente", "Voucher", "Validador", "FormaPago"]] * 4,
    )
    views["prizes_grid"] = _grid(
        d, "prizes", "prize_cells", 1, 2, PRIZE_HEADERS,
        [
            ["fecha_txt", "'0'", "monto_txt", "Attendant", "FormaPago", "IdCliente", "Maquina", "propina_txt"],
            ["monto_txt", "Attendant", "'0'", "fecha_txt", "FormaPago", "IdCliente", "Maquina", "propina_txt"],
            ["fecha_txt", "jornada_txt", "'0'", "monto_txt", "Attendant", "FormaPago", "IdCliente", "Maquina"],
        ],
    )
    views["grid"] = "SELECT * FROM ops_grid UNION ALL SELECT * FROM prizes_grid"
    return views


def _grid(d: Dialect, name: str, cells: str, step: int, base: int, headers: list, rows: list) -> str:
    """Grid of files ``<name>_<n>.xlsx``: ``step*n + base`` title rows, the header, then data rows; and a
    second sheet of notes."""

    def by_file(choices: list) -> str:
        if all(c == choices[0] for c in choices):
            return choices[0]
        arms = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices[:-1]))
        return f"CASE file_no {arms} ELSE {choices[-1]} END"

    at = f"({step}*file_no + {base})"
    path = f"concat('{name}_', cast(file_no AS varchar(10)), '.xlsx')"
    header = by_file([d.texts(*h) for h in headers])
    data = by_file([d.array(*r) for r in rows])
    title = d.texts("Reporte", "", "", "")
    files = f"(SELECT file_no, {d.numbers_to(at)} AS i FROM (SELECT DISTINCT file_no FROM {cells}) f) t"
    return f"""
SELECT {path} AS path, 'Hoja1' AS sheet, 0 AS sheet_idx, cast({at} + 1 + {d.whole("k", 1)} AS int) AS row_idx, {data} AS cells
FROM {cells}
UNION ALL
SELECT {path}, 'Hoja1', 0, cast(i AS int), CASE WHEN i = {at} THEN {header} ELSE {title} END FROM {files}
UNION ALL
SELECT {path}, 'Notas', 1, cast(i AS int), {title} FROM {files}"""


# What each view is built from, so that a query names only what it needs.
NEEDS = {
    "ops_raw": [], "prizes_raw": [], "ops": ["ops_raw"], "prizes": ["prizes_raw"], "ops_cells": ["ops_raw"],
    "prize_cells": ["prizes_raw"], "date_cells": ["ops_raw"], "ops_grid": ["ops_cells"],
    "prizes_grid": ["prize_cells"], "grid": ["ops_grid", "prizes_grid"],
}


def with_views(d: Dialect, *names: str) -> str:
    """``WITH`` clause that defines ``names`` and what they are built from."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS[name]:
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    all_views = definitions(d)
    return "WITH " + ",\n".join(f"{name} AS ({all_views[name]})" for name in wanted)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = f"{with_views(SPARK, name)} SELECT * FROM {name}"
    used = [t for t in ("orders", "lineitem") if f"{{{t}}}" in text]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
