"""Data contract: column names, header spellings, report names and table schemas.

Everything here is a fixed value that stored tables, uploaded sheets or report readers depend on.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: kinds -------------------------------------------------------------------------
GETNET = "GETNET"
PREMIOS = "PREMIOS"

# --- fixed values: the operating day -------------------------------------------------------------
DAY_START_HOUR = 10
HOUR_ORDER = [10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 0, 1, 2, 3, 4, 5, 6, 7, 8]

# --- fixed values: header search -----------------------------------------------------------------
HEADER_SEARCH_ROWS = 30
HEADER_KEYS_GETNET = ["Jornada", "Fecha", "Monto"]
HEADER_KEYS_PREMIOS = ["Monto Transferido", "Slot Attendant", "Transferencia Final"]
KIND_KEYS_PREMIOS = ["Transferencia Final", "Slot Attendant"]

# --- fixed values: header spellings of each canonical column, in order of preference -------------
HEADERS_COMMON = {
    "Fecha": ["Fecha"],
    "Jornada": ["Jornada"],
    "Monto": ["Monto"],
    "Attendant": ["Attendant", "Slot Attendant"],
    "IdCliente": ["IdCliente", "Id Cliente"],
    "FormaPago": ["FormaPago", "Forma Pago"],
    "Validador": ["Validador"],
    "Ingreso": ["Ingreso", "Ingreso CAWA"],
    "Voucher": ["Voucher"],
    "Propina": ["Propina"],
    "MaquinaAccented": ["Máquina"],
    "Maquina": ["Maquina"],
}
HEADERS_PREMIOS = {
    "Monto": ["Transferencia Final"],
    "IdCliente": ["IdCliente", "Cliente", "Id Cliente"],
    "FormaPago": ["FormaPago", "Tipo de Pago", "Forma Pago"],
}
REQUIRED_COLUMNS = ["Fecha", "Jornada", "Monto", "Attendant"]

# --- fixed values: text that stands for a missing value in a sheet ------------------------------------
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: payment classes ---------------------------------------------------------------
# "progresive" is a spelling found in the data.
PAYMENT_CLASSES = {
    "Premios": ["jackpot hp", "progresive jackpot hp", "progressive jackpot hp"],
    "MDC purse clear": ["mdc purse clear"],
    "Cancel Credit": ["cancel credit"],
    "Chip Cash HandPay": ["chip cash handpay"],
}

# --- fixed values: month names -------------------------------------------------------------------
MONTH_NAMES = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
]

# --- fixed values: report names, in bundle order -------------------------------------------------
MONTHLY_SUMMARY = "Resumen Mensual"
HOURLY_OPERATIONS = "Operaciones por Hora"
ATTENDANT_RECORD = "Record Asistentes"
ATTENDANT_MONTH = "Asistente por Mes"
OPERATION_COUNT = "Conteo Operaciones"
ANNUAL_DETAIL = "Total de conteo anual por asistente"
ANNUAL_TOTAL = "Conteo Total Anual"
MACHINE_MONTH = "Conteo mensual de operaciones por MDA"
MACHINE_TOTAL = "Conteo total de operaciones por MDA"
QA = "QA"

# Reports that ignore the attendant filter when a single file is being viewed.
FILTER_EXEMPT = [MONTHLY_SUMMARY, HOURLY_OPERATIONS, MACHINE_MONTH, MACHINE_TOTAL]

SHEET_NAME_LIMIT = 31

# --- schemas -------------------------------------------------------------------------------------
GRID_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("sheet_idx", T.IntegerType()),
        T.StructField("row_idx", T.IntegerType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)

CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("Tipo", T.StringType()),
        T.StructField("Fecha", T.TimestampNTZType()),
        T.StructField("Jornada", T.TimestampNTZType()),
        T.StructField("JornadaDia", T.DateType()),
        T.StructField("Mes", T.StringType()),
        T.StructField("Hora", T.IntegerType()),
        T.StructField("Monto", T.DoubleType()),
        T.StructField("Attendant", T.StringType()),
        T.StructField("IdCliente", T.StringType()),
        T.StructField("FormaPago", T.StringType()),
        T.StructField("Validador", T.StringType()),
        T.StructField("Ingreso", T.StringType()),
        T.StructField("Voucher", T.StringType()),
        T.StructField("Propina", T.DoubleType()),
        T.StructField("Maquina", T.StringType()),
    ]
)

_STORED_HEAD = [
    T.StructField("fecha", T.TimestampNTZType()),
    T.StructField("jornada", T.TimestampNTZType()),
    T.StructField("id_cliente", T.StringType()),
    T.StructField("monto", T.DoubleType()),
]
_STORED_TAIL = [
    T.StructField("attendant", T.StringType()),
    T.StructField("validador", T.StringType()),
    T.StructField("forma_pago", T.StringType()),
    T.StructField("ingreso_cawa", T.StringType()),
    T.StructField("hora", T.IntegerType()),
    T.StructField("mes", T.StringType()),
]
# fixed values: report names of stored columns
REPORT_NAMES = {
    "fecha": "Fecha",
    "jornada": "Jornada",
    "monto": "Monto",
    "attendant": "Attendant",
    "mes": "Mes",
    "hora": "Hora",
    "forma_pago": "FormaPago",
    "maquina": "Maquina",
}
OPERATIONS_TABLE = "operaciones"
OPERATIONS_TABLE_SCHEMA = T.StructType(
    [*_STORED_HEAD, T.StructField("voucher", T.StringType()), *_STORED_TAIL]
)
PRIZES_TABLE = "premios"
PRIZES_TABLE_SCHEMA = T.StructType(
    [
        *_STORED_HEAD,
        T.StructField("propina", T.DoubleType()),
        T.StructField("maquina", T.StringType()),
        *_STORED_TAIL,
    ]
)
