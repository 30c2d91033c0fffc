"""The SQL each registered query is checked against, written from the rules and not from the plans."""

from __future__ import annotations

from floorledger.catalogue.queries import CORRECTED, NOBODY, SEARCH, SELECTED
from floorledger.catalogue.views import OTHER, with_views

# Month names.
MONTHS = (
    "['Enero','Febrero','Marzo','Abril','Mayo','Junio',"
    "'Julio','Agosto','Septiembre','Octubre','Noviembre','Diciembre']"
)
# Hours of an operating day.
HOURS = "unnest([10,11,12,13,14,15,16,17,18,19,20,21,22,23,0,1,2,3,4,5,6,7,8])"


def label(month: str = "Mes") -> str:
    return f"{MONTHS}[cast(split_part({month},'-',2) AS int)] || ' ' || split_part({month},'-',1)"


def money(value: str = "Monto", name: str = "Monto", where: str = "") -> str:
    condition = f" FILTER (WHERE {where})" if where else ""
    return f"coalesce(round(cast(sum(cast({value} AS decimal(18,2))){condition} AS double),2),0.0) AS {name}"


def number(alias: str = "Operaciones") -> str:
    return f"cast(count(*) AS bigint) AS {alias}"


# Text that stands for a missing value in a sheet.
MISSING = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', "
    "'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)
# Payment types and their classes.
CLASS = """CASE lower(trim(FormaPago)) WHEN 'jackpot hp' THEN 'Premios' WHEN 'progresive jackpot hp' THEN 'Premios'
  WHEN 'progressive jackpot hp' THEN 'Premios' WHEN 'mdc purse clear' THEN 'MDC purse clear'
  WHEN 'cancel credit' THEN 'Cancel Credit' WHEN 'chip cash handpay' THEN 'Chip Cash HandPay' END"""
CLASSIFIED = f"classified AS (SELECT *, {CLASS} AS Categoria FROM prizes)"
COUNTS = {
    c: f"cast(count(*) FILTER (WHERE Categoria = '{c}') AS bigint) AS \"{c}\""
    for c in ("Premios", "MDC purse clear", "Cancel Credit", "Chip Cash HandPay")
}
FOUR = ", ".join(COUNTS.values())
MACHINES = ", ".join(
    [COUNTS["Premios"], money(where="Categoria = 'Premios'"), *[v for k, v in COUNTS.items() if k != "Premios"]]
)
IN_SELECTED = "Attendant IN (" + ", ".join(f"'{a}'" for a in SELECTED) + ")"


def select(body: str, *views: str, extra: str = "") -> str:
    clause = with_views(OTHER, *views)
    return f"{clause}{', ' + extra if extra else ''}\n{body}"


def prize_sql(body: str) -> str:
    return select(body, "prizes", extra=CLASSIFIED)


def record(source: str) -> str:
    return f"""SELECT Attendant, JornadaDia, TotalOperaciones FROM (
  SELECT *, row_number() OVER (PARTITION BY Attendant ORDER BY TotalOperaciones DESC, JornadaDia) AS place
  FROM (SELECT Attendant, JornadaDia, cast(count(*) AS bigint) AS TotalOperaciones FROM {source} GROUP BY ALL) d) r
WHERE place = 1"""


def quality(source: str) -> str:
    return f"""SELECT unnest(['filas_usadas','min_fecha','max_fecha','horas_presentes']) AS Metrica,
  unnest([cast(count(*) AS varchar), strftime(min(Fecha),'%Y-%m-%d %H:%M:%S'), strftime(max(Fecha),'%Y-%m-%d %H:%M:%S'),
  array_to_string(list_transform(list_sort(list(DISTINCT Hora)), lambda h: cast(h AS varchar)), ', ')]) AS Valor
FROM {source}"""


def hourly(source: str) -> str:
    return f"""SELECT cast(h.Hora AS varchar) AS Hora, coalesce(a.n,0) AS Operaciones, coalesce(a.m,0.0) AS Monto
FROM (SELECT {HOURS} AS Hora) h LEFT JOIN (SELECT Hora, {number("n")}, {money(name="m")} FROM {source} GROUP BY Hora) a
ON h.Hora = a.Hora"""


def monthly(source: str, where: str = "TRUE") -> str:
    return f"SELECT {label()} AS Mes, {number()}, {money()} FROM (SELECT * FROM {source} WHERE {where}) s GROUP BY s.Mes"


def labelled(inner: str, columns: str) -> str:
    return f"SELECT {label('g.Mes')} AS Mes, {columns} FROM ({inner}) g"


MACHINE_NAMES = 'Maquina, Premios, Monto, "MDC purse clear", "Cancel Credit", "Chip Cash HandPay"'
FOUR_NAMES = 'Premios, "MDC purse clear", "Cancel Credit", "Chip Cash HandPay"'
MACHINE_MONTH = labelled(
    f"SELECT Mes, Maquina, {MACHINES} FROM classified WHERE Categoria IS NOT NULL AND Maquina IS NOT NULL GROUP BY Mes, Maquina",
    MACHINE_NAMES,
)
MACHINE_JOIN = labelled(
    f"""SELECT c.*, a.Monto FROM (SELECT Mes, Maquina, {FOUR} FROM classified
  WHERE Categoria IS NOT NULL AND Maquina IS NOT NULL GROUP BY Mes, Maquina) c
LEFT JOIN (SELECT Mes, Maquina, {money("CASE WHEN Categoria = 'Premios' THEN Monto ELSE 0 END")} FROM classified GROUP BY Mes, Maquina) a
ON c.Mes = a.Mes AND c.Maquina = a.Maquina""",
    MACHINE_NAMES,
)
MACHINE_TOTAL = (
    f"SELECT Maquina, {MACHINES} FROM classified WHERE Categoria IS NOT NULL AND Maquina IS NOT NULL GROUP BY Maquina"
)

# --- sheets ---------------------------------------------------------------------------------------
FOUND = """headers AS (
  SELECT path, sheet, coalesce(min(row_idx) FILTER (WHERE
    list_has_all(names, ['Jornada','Fecha','Monto']) OR
    list_has_all(names, ['Monto Transferido','Slot Attendant','Transferencia Final'])), 0) AS header_row
  FROM (SELECT *, list_transform(cells, lambda c: trim(c)) AS names FROM grid WHERE sheet_idx = 0 AND row_idx < 30) g
  GROUP BY path, sheet),
named AS (SELECT h.*, list_transform(g.cells, lambda c: trim(c)) AS names FROM headers h
  JOIN grid g ON g.path = h.path AND g.sheet = h.sheet AND g.row_idx = h.header_row),
kinds AS (SELECT *, CASE WHEN list_has_all(names, ['Transferencia Final','Slot Attendant']) THEN 'PREMIOS' ELSE 'GETNET' END AS Tipo
  FROM named),
data AS (SELECT k.path, k.Tipo, k.names, g.row_idx,
  list_transform(g.cells, lambda c: CASE WHEN c NOT IN (""" + MISSING + """) THEN c END) AS cells FROM kinds k
  JOIN grid g ON g.path = k.path AND g.sheet = k.sheet AND g.row_idx > k.header_row)"""


def cell(*names: str) -> str:
    """Cell below the first of ``names`` the sheet has; empty text when it has none."""
    arms = " ".join(f"WHEN list_contains(names,'{n}') THEN cells[list_position(names,'{n}')]" for n in names)
    return f"CASE {arms} ELSE '' END"


BOUND = f"""bound AS (SELECT path, row_idx, Tipo, names,
  CASE WHEN list_contains(names,'Fecha') THEN cells[list_position(names,'Fecha')]
    WHEN Tipo = 'PREMIOS' THEN cells[1] ELSE '' END AS Fecha,
  {cell("Jornada")} AS Jornada,
  CASE WHEN Tipo = 'PREMIOS' THEN {cell("Transferencia Final")} ELSE {cell("Monto")} END AS Monto,
  {cell("Attendant", "Slot Attendant")} AS Attendant,
  {cell("IdCliente", "Cliente", "Id Cliente")} AS IdCliente,
  {cell("FormaPago", "Tipo de Pago", "Forma Pago")} AS FormaPago,
  {cell("Validador")} AS Validador, {cell("Ingreso", "Ingreso CAWA")} AS Ingreso, {cell("Voucher")} AS Voucher,
  {cell("Propina")} AS Propina, {cell("Máquina", "Maquina")} AS Maquina
  FROM data)"""


def moment(value: str) -> str:
    formats = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%d-%m-%Y %H:%M:%S"]
    return "coalesce(" + ", ".join(f"try_strptime({value}, '{f}')" for f in formats) + ")"


CANON = f"""typed AS (SELECT path, Tipo, {moment("Fecha")} AS Fecha,
  CASE WHEN Tipo = 'PREMIOS' AND NOT list_contains(names,'Jornada')
    THEN cast(cast({moment("Fecha")} - interval 10 hour AS date) AS timestamp) ELSE {moment("Jornada")} END AS Jornada,
  coalesce(try_cast(Monto AS double), 0.0) AS Monto, Attendant, IdCliente, FormaPago, Validador, Ingreso, Voucher,
  CASE WHEN Propina = '' THEN 0.0 ELSE try_cast(Propina AS double) END AS Propina, Maquina
  FROM bound),
canon AS (SELECT path, Tipo, Fecha, Jornada, cast(Jornada AS date) AS JornadaDia, strftime(Jornada,'%Y-%m') AS Mes,
  cast(hour(Fecha) AS int) AS Hora, Monto, Attendant, IdCliente, FormaPago, Validador, Ingreso, Voucher, Propina, Maquina
  FROM typed WHERE Fecha IS NOT NULL AND Jornada IS NOT NULL AND Attendant IS NOT NULL AND hour(Fecha) <> 9)"""


def sheets(body: str, grid: str, *steps: str) -> str:
    base = select("", grid).rstrip()
    alias = "" if grid == "grid" else f", grid AS (SELECT * FROM {grid})"
    return f"{base}{alias}, {', '.join(steps)}\n{body}"


STORED_OPS = """SELECT Fecha AS fecha, cast(JornadaDia AS timestamp) AS jornada, IdCliente AS id_cliente, Monto AS monto,
  Voucher AS voucher, Attendant AS attendant, Validador AS validador, FormaPago AS forma_pago, '' AS ingreso_cawa,
  cast(Hora AS int) AS hora, Mes AS mes FROM ops"""
STORED_PRIZES = """SELECT Fecha AS fecha, cast(JornadaDia AS timestamp) AS jornada, IdCliente AS id_cliente, Monto AS monto,
  Propina AS propina, coalesce(Maquina,'nan') AS maquina, Attendant AS attendant, '' AS validador,
  FormaPago AS forma_pago, '' AS ingreso_cawa, cast(Hora AS int) AS hora, Mes AS mes FROM prizes"""


def scanned(stored: str, kind: str, maquina: str = "") -> str:
    return f"""SELECT fecha AS Fecha, jornada AS Jornada, id_cliente, monto AS Monto, {maquina} attendant AS Attendant,
  validador, forma_pago AS FormaPago, ingreso_cawa, hora AS Hora, mes AS Mes,
  cast(jornada AS date) AS JornadaDia, '{kind}' AS Tipo FROM ({stored}) s"""


def manifest_rows(names: list[tuple[str, str]]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {i} AS ord, '{name}' AS name, left('{name}', 31) AS sheet, cast(count(*) AS bigint) AS rows FROM ({body}) r{i}"
        for i, (name, body) in enumerate(names)
    )


def manifest(names: list[tuple[str, str]], source_views: str, extra: str = "") -> str:
    return select(manifest_rows(names), source_views, extra=extra)


def distinct(columns: str, source: str, where: str = "TRUE") -> str:
    return f"SELECT DISTINCT {columns} FROM {source} WHERE {where}"


HOUR_ROWS = f"SELECT {HOURS}"
QA_ROWS = "SELECT unnest([1,2,3,4])"
MANIFEST_OPS = [
    ("Resumen Mensual", distinct("Mes", "ops")),
    ("Operaciones por Hora", HOUR_ROWS),
    ("Record Asistentes", distinct("Attendant", "ops")),
    ("Asistente por Mes", distinct("Attendant, Mes", "ops")),
    ("Conteo Operaciones", distinct("Mes, Attendant", "ops")),
    ("Total de conteo anual por asistente", distinct("Attendant", "ops")),
    ("Conteo Total Anual", distinct("Attendant", "ops")),
    ("QA", QA_ROWS),
]
HAS_CLASS = "Categoria IS NOT NULL"
MANIFEST_PRIZES = [
    ("Resumen Mensual", distinct("Mes", "prizes")),
    ("Operaciones por Hora", HOUR_ROWS),
    ("Record Asistentes", distinct("Attendant", "prizes")),
    ("Asistente por Mes", distinct("Attendant, Mes", "prizes")),
    ("Conteo Operaciones", distinct("Mes, Attendant", "classified", HAS_CLASS)),
    ("Total de conteo anual por asistente", distinct("Attendant", "classified", HAS_CLASS)),
    ("Conteo Total Anual", distinct("Attendant", "classified", HAS_CLASS)),
    ("Conteo mensual de operaciones por MDA", distinct("Mes, Maquina", "classified", f"{HAS_CLASS} AND Maquina IS NOT NULL")),
    ("Conteo total de operaciones por MDA", distinct("Maquina", "classified", f"{HAS_CLASS} AND Maquina IS NOT NULL")),
    ("QA", QA_ROWS),
]

DAY_FIRST = [
    "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%d-%m-%Y %H:%M:%S", "%d.%m.%Y %H:%M:%S", "%Y/%m/%d %H:%M",
    "%d %b %Y %H:%M", "%Y%m%d", "%d/%m/%y", "%d/%m/%Y %I:%M:%S %p", "%m/%d/%Y %I:%M:%S %p",
]


BUNDLES = f"""SELECT 'carga ' || seq || '.xlsx' AS book, sheet, cast(row_idx AS integer) AS row_idx, name, ops, Monto FROM (
SELECT upload_seq AS seq, 'Resumen Mensual' AS sheet, row_number() OVER (PARTITION BY upload_seq ORDER BY Mes) AS row_idx,
  {label()} AS name, {number('ops')}, {money()} FROM ops GROUP BY upload_seq, Mes
UNION ALL
SELECT u.upload_seq, 'Operaciones por Hora', h.ord, cast(h.Hora AS varchar), coalesce(a.n, 0), coalesce(a.m, 0.0)
FROM (SELECT DISTINCT upload_seq FROM ops) u CROSS JOIN (SELECT {HOURS} AS Hora, unnest(range(1, 24)) AS ord) h
LEFT JOIN (SELECT upload_seq, Hora, {number("n")}, {money(name="m")} FROM ops GROUP BY upload_seq, Hora) a
ON a.upload_seq = u.upload_seq AND a.Hora = h.Hora
UNION ALL
SELECT upload_seq, left('Total de conteo anual por asistente', 31),
  row_number() OVER (PARTITION BY upload_seq ORDER BY count(*) DESC, Attendant), Attendant, {number()}, NULL FROM ops GROUP BY upload_seq, Attendant
) s"""


def build() -> dict[str, str]:
    sql = {
        # sheets
        "header_detect": sheets("SELECT path, sheet, header_row FROM headers", "grid", FOUND),
        "kind_detect": sheets("SELECT path, Tipo FROM kinds", "grid", FOUND),
        "header_bind": sheets(
            "SELECT path, row_idx, Fecha, Jornada, Monto, Attendant, IdCliente, FormaPago, Voucher FROM bound",
            "grid", FOUND, BOUND,
        ),
        "header_names": sheets(
            """SELECT path, name, cast(count(*) AS bigint) AS cells, cast(count(value) AS bigint) AS filled, cast(max(length(value)) AS integer) AS longest
FROM (SELECT path, unnest(names) AS name, unnest(list_transform(range(1, len(names) + 1), lambda i: cells[i])) AS value FROM data) c
GROUP BY path, name""",
            "grid", FOUND,
        ),
        "implied_date": sheets(
            """SELECT path, cast(count(*) AS bigint) AS n, cast(count(DISTINCT Fecha) AS bigint) AS moments,
  min(Fecha) AS first, max(Fecha) AS last FROM canon GROUP BY path""",
            "prizes_grid", FOUND, BOUND, CANON,
        ),
        "derive_jornada": sheets(
            """SELECT path, JornadaDia, cast(count(*) AS bigint) AS n, min(Fecha) AS first, max(Fecha) AS last
FROM canon GROUP BY path, JornadaDia""",
            "prizes_grid", FOUND, BOUND, CANON,
        ),
        "canonical_ops": sheets("SELECT * FROM canon", "ops_grid", FOUND, BOUND, CANON),
        "canonical_prizes": sheets("SELECT * FROM canon", "prizes_grid", FOUND, BOUND, CANON),
        "sheet_reports": sheets(
            f"SELECT Tipo, Mes, {number()}, {money()} FROM canon GROUP BY Tipo, Mes", "grid", FOUND, BOUND, CANON
        ),
        "routed_rows": sheets(
            f"SELECT path, CASE Tipo WHEN 'PREMIOS' THEN 'premios' ELSE 'operaciones' END AS target, {number('rows')} FROM canon GROUP BY path, Tipo",
            "grid", FOUND, BOUND, CANON,
        ),
        "sheet_manifest": sheets(
            manifest_rows(MANIFEST_PRIZES), "prizes_grid", FOUND, BOUND, CANON,
            f"prizes AS (SELECT * FROM canon), {CLASSIFIED}",
        ),
        # values
        "parse_dates": select(
            "SELECT k, txt, coalesce(" + ", ".join(f"try_strptime(txt, '{f}')" for f in DAY_FIRST) + ") AS Fecha FROM date_cells",
            "date_cells",
        ),
        "coerce_amount": select(
            "SELECT k, coalesce(try_cast(monto_txt AS double), 0.0) AS Monto FROM ops_cells", "ops_cells"
        ),
        "month_key": select("SELECT k, strftime(Fecha - interval 10 hour, '%Y-%m') AS Mes FROM ops_raw", "ops_raw"),
        "month_label": select(f"SELECT Mes, {label()} AS Etiqueta FROM (SELECT DISTINCT Mes FROM ops) m", "ops"),
        "payment_class": select(
            f"SELECT FormaPago, {CLASS} AS Categoria, {number('n')} FROM prizes_raw GROUP BY FormaPago", "prizes_raw"
        ),
        # filters
        "drop_incomplete": select(
            "SELECT k, Fecha, Attendant FROM ops_raw WHERE Fecha IS NOT NULL AND Attendant IS NOT NULL", "ops_raw"
        ),
        "valid_hours": select(
            f"SELECT cast(hour(Fecha) AS int) AS Hora, {number('n')} FROM ops_raw WHERE hour(Fecha) >= 10 OR hour(Fecha) <= 8 GROUP BY hour(Fecha)",
            "ops_raw",
        ),
        "attendant_filter": select(f"SELECT k, Attendant, Mes, Monto FROM ops WHERE {IN_SELECTED}", "ops"),
        "attendant_filter_table": select(
            "SELECT k, Attendant, Mes, Monto FROM ops WHERE Attendant IN (SELECT Attendant FROM prizes WHERE Propina > 0.07)",
            "ops", "prizes",
        ),
        "attendant_search": select(f"SELECT DISTINCT Attendant FROM ops WHERE contains(lower(Attendant), '{SEARCH}')", "ops"),
        "exempt_monthly": select(
            f"""SELECT 'mes' AS part, Mes AS name, Operaciones FROM ({monthly("ops")}) m
UNION ALL SELECT 'att', Attendant, {number()} FROM ops WHERE {IN_SELECTED} GROUP BY Attendant""",
            "ops",
        ),
        "filtered_monthly": select(monthly("ops", IN_SELECTED), "ops"),
        "exempt_machines": prize_sql(MACHINE_TOTAL),
        "report_selection": select(
            manifest_rows([r for r in MANIFEST_OPS if r[0] in ("Resumen Mensual", "Conteo Total Anual", "QA")]), "ops"
        ),
        "selection_rule": "SELECT unnest(['nothing','empty list','everyone','some','everyone and more']) AS chosen, "
        "unnest([true,true,true,false,false]) AS unfiltered",
        "download_override": select(
            f"""SELECT 'file' AS mode, Attendant, {number()} FROM ops WHERE Attendant = 'ATT_2' GROUP BY Attendant
UNION ALL SELECT 'history', Attendant, {number()} FROM ops WHERE {IN_SELECTED} GROUP BY Attendant""",
            "ops",
        ),
        "empty_input": select(
            f"""SELECT unnest(['filas_usadas','min_fecha','max_fecha','horas_presentes']) AS name,
  unnest([cast(count(*) AS varchar), coalesce(cast(min(Fecha) AS varchar),'NaT'), coalesce(cast(max(Fecha) AS varchar),'NaT'),
    coalesce(string_agg(DISTINCT cast(Hora AS varchar), ', '), '')]) AS value FROM ops WHERE Attendant IN ('{NOBODY[0]}')
UNION ALL SELECT Hora, cast(Operaciones AS varchar) FROM ({hourly(f"(SELECT * FROM ops WHERE Attendant IN ('{NOBODY[0]}'))")}) h""",
            "ops",
        ),
        # reports
        "monthly_summary": select(monthly("ops"), "ops"),
        "monthly_summary_prizes": select(monthly("prizes"), "prizes"),
        "hourly_ops": select(hourly("ops"), "ops"),
        "hourly_prizes": select(hourly("prizes"), "prizes"),
        "attendant_day": select(
            "SELECT Attendant, JornadaDia, cast(count(*) AS bigint) AS TotalOperaciones FROM ops GROUP BY ALL", "ops"
        ),
        "attendant_record": select(record("ops"), "ops"),
        "attendant_record_prizes": select(record("prizes"), "prizes"),
        "attendant_month_ops": select(
            labelled(f"SELECT Attendant, Mes, {number()}, {money()} FROM ops GROUP BY Attendant, Mes", "Attendant, Operaciones, Monto"),
            "ops",
        ),
        "attendant_month_prizes": select(
            labelled(f"SELECT Attendant, Mes, {number()} FROM prizes GROUP BY Attendant, Mes", "Attendant, Operaciones"), "prizes"
        ),
        "op_count_ops": select(
            labelled(f"SELECT Attendant, Mes, {number()} FROM ops GROUP BY Attendant, Mes", "Attendant, Operaciones"), "ops"
        ),
        "op_count_prizes": prize_sql(
            labelled(
                f"SELECT Mes, Attendant, {FOUR} FROM classified WHERE Categoria IS NOT NULL GROUP BY Mes, Attendant",
                f"Attendant, {FOUR_NAMES}",
            )
        ),
        "annual_ops": select(f"SELECT Attendant, {number()} FROM ops GROUP BY Attendant", "ops"),
        "annual_prizes": prize_sql(f"SELECT Attendant, {FOUR} FROM classified WHERE Categoria IS NOT NULL GROUP BY Attendant"),
        "annual_total_prizes": prize_sql(
            f"SELECT Attendant, {number()} FROM classified WHERE Categoria IS NOT NULL GROUP BY Attendant"
        ),
        "mda_month": prize_sql(MACHINE_MONTH),
        "mda_total": prize_sql(MACHINE_TOTAL),
        "mda_join_form": prize_sql(MACHINE_JOIN),
        "mda_grouping_sets": prize_sql(
            f"""SELECT Mes, Maquina, {MACHINES} FROM classified WHERE Categoria IS NOT NULL AND Maquina IS NOT NULL
GROUP BY GROUPING SETS ((Mes, Maquina), (Maquina))"""
        ),
        "prize_amounts": prize_sql(
            f"""SELECT Mes, Maquina, {money("CASE WHEN Categoria = 'Premios' THEN Monto ELSE 0 END", "MontoPremios")}
FROM classified WHERE Maquina IS NOT NULL GROUP BY Mes, Maquina"""
        ),
        "qa_metrics": select(quality("ops"), "ops"),
        "qa_metrics_prizes": select(quality("prizes"), "prizes"),
        "attendants": select("SELECT DISTINCT Attendant FROM ops", "ops"),
        "batch_months": select("SELECT DISTINCT Mes FROM ops", "ops"),
        # history
        "stored_ops": select(STORED_OPS, "ops"),
        "stored_prizes": select(STORED_PRIZES, "prizes"),
        "history_ops": select(scanned(STORED_OPS, "GETNET", "voucher,"), "ops"),
        "history_prizes": select(scanned(STORED_PRIZES, "PREMIOS", "propina, maquina AS Maquina,"), "prizes"),
        "history_machines": select(
            MACHINE_TOTAL,
            "prizes",
            extra=f"classified AS (SELECT * REPLACE (coalesce(Maquina,'nan') AS Maquina), {CLASS} AS Categoria FROM prizes)",
        ),
        "latest_upload_wins": select(
            """SELECT k, 'GETNET' AS Tipo, Mes, seq AS upload_seq, Monto FROM (SELECT *, max(coalesce(seq, -1)) OVER (PARTITION BY Mes) AS latest
FROM (SELECT *, CASE WHEN Mes >= '1996' THEN nullif(upload_seq, 0) END AS seq FROM ops) n) o WHERE coalesce(seq, -1) = latest""",
            "ops",
        ),
        "load_receipt": select(
            f"SELECT 'GETNET' AS Tipo, {number('rows')} FROM ops UNION ALL SELECT 'PREMIOS', {number('rows')} FROM prizes",
            "ops", "prizes",
        ),
        "history_replaced": select(
            f"""SELECT Voucher AS voucher, Mes, Attendant, Monto FROM ops WHERE Mes NOT IN (SELECT Mes FROM ops WHERE {CORRECTED})
UNION ALL SELECT Voucher, Mes, Attendant, Monto * 2 FROM ops WHERE {CORRECTED}""",
            "ops",
        ),
        "history_receipt": select(
            " UNION ALL ".join(
                f"SELECT '{kind}' AS Tipo, {number('read')}, count(DISTINCT Mes) AS months, {money()}, {number('written')} FROM {name}"
                for kind, name in (("GETNET", "ops"), ("PREMIOS", "prizes"))
            ),
            "ops", "prizes",
        ),
        "workbook_roundtrip": select(
            """SELECT path AS book, sheet, row_idx, rtrim(array_to_string(list_transform(cells, lambda c: coalesce(c, '')), '|'), '|') AS text
FROM grid WHERE sheet_idx = 0""",
            "grid",
        ),
        "bundle_roundtrip": select(BUNDLES, "ops"),
        "drop_folder_months": select(
            f"""SELECT Mes, {number()}, {money()}, max(Voucher) AS last FROM (
SELECT Mes, Monto, Voucher FROM ops WHERE Mes NOT IN (SELECT Mes FROM ops WHERE {CORRECTED})
UNION ALL SELECT Mes, Monto * 2, Voucher FROM ops WHERE {CORRECTED}) s GROUP BY Mes""",
            "ops",
        ),
        # rollups and publishing
        "rollup_monthly": select(monthly("ops"), "ops"),
        "rollup_record": select(record("prizes"), "prizes"),
        "rollup_machines": prize_sql(MACHINE_MONTH),
        "rollup_qa": select(quality("prizes"), "prizes"),
        "report_manifest": manifest(MANIFEST_OPS, "ops"),
        "report_manifest_prizes": manifest(MANIFEST_PRIZES, "prizes", CLASSIFIED),
        "chart_month": select(
            f"""SELECT list({label()} ORDER BY Mes) AS labels, list(n ORDER BY Mes) AS ops, list(m ORDER BY Mes) AS monto
FROM (SELECT Mes, {number("n")}, {money(name="m")} FROM ops GROUP BY Mes) g""",
            "ops",
        ),
        "chart_hour": select(
            f"""SELECT list(Hora ORDER BY place) AS labels, list(Operaciones ORDER BY place) AS ops, list(Monto ORDER BY place) AS monto
FROM (SELECT *, (cast(Hora AS int) + 14) % 24 AS place FROM ({hourly("ops")}) h) g""",
            "ops",
        ),
        "chart_hour_json": select(
            f"""SELECT '{{"labels":["' || string_agg(Hora, '","' ORDER BY place) || '"],"ops":[' ||
  string_agg(cast(Operaciones AS varchar), ',' ORDER BY place) || ']}}' AS json
FROM (SELECT *, (cast(Hora AS int) + 14) % 24 AS place FROM ({hourly("ops")}) h) g""",
            "ops",
        ),
    }
    return sql
