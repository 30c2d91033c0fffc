"""The registered queries: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger import schema as S
from floorledger.catalogue.views import view
from floorledger.functions import amounts, dates, text
from floorledger.operators import cleaning, facts, headers, reports, selection, uploads
from floorledger.plans.load import clean_grid, work_folder
from floorledger.plans.publish import chart_json, hour_chart, manifest, month_chart
from floorledger.plans.report_set import generate_reports, prepare_reports
from floorledger.plans.rollup import FACT_COLUMNS, report_bundle, stage_facts
from floorledger.session import cut_lineage, staged
from floorledger.sources import books, history
from floorledger.sources.grid import pick_sheet, read_workbooks, stage_grid
from floorledger.streaming.drop_folder import follow_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SELECTED = ["ATT_1", "ATT_7", "ATT_13"]
NOBODY = ["ATT_NONE"]
SEARCH = "tt_1"
CORRECTED = "Mes >= '1996-03' AND upload_seq = 1"
SHARED = ["Tipo", "Fecha", "Jornada", "JornadaDia", "Mes", "Hora", "Monto", "Attendant", "IdCliente", "FormaPago"]


def register(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


# --- inputs ---------------------------------------------------------------------------------------


def raw_batch(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Typed rows before cleaning, with the operating day derived from the moment.

    The view computes moment and attendant; they are settled so that cleaning sees plain columns, as it
    does on stored rows.
    """
    name = "prizes_raw" if kind == S.PREMIOS else "ops_raw"
    rows = view(spark, sf_dir, name).transform(cleaning.settle, "Fecha", "Attendant")
    jornada = dates.operating_day(F.col("Fecha")).cast("timestamp_ntz")
    return rows.withColumns({"Tipo": F.lit(kind), "Jornada": jornada})


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_batch(spark, sf_dir, S.GETNET).transform(cleaning.complete_batch)


def prizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_batch(spark, sf_dir, S.PREMIOS).transform(cleaning.complete_batch)


def raw_grid(spark: SparkSession, sf_dir: str, name: str = "grid") -> DataFrame:
    extra = {"modified": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("string")}
    return view(spark, sf_dir, name).withColumns(extra).select(*S.GRID_SCHEMA.names)


def staged_grid(spark: SparkSession, sf_dir: str, name: str = "grid") -> DataFrame:
    return stage_grid(raw_grid(spark, sf_dir, name), f"{work_folder(spark)}/grid")


def canonical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return clean_grid(staged_grid(spark, sf_dir, name))[0]


def typed_rows(spark: SparkSession, sf_dir: str, corrected: bool) -> DataFrame:
    """Card operations as rows of workbooks, a book per year, or one book of corrected rows."""
    rows = ops(spark, sf_dir)
    if corrected:
        rows = rows.where(CORRECTED).withColumn("Monto", F.col("Monto") * 2)
    book = F.lit("zz_corrected") if corrected else F.concat(F.lit("ops_"), F.year("JornadaDia"))
    named = {"Fecha": "Fecha", "Jornada": "Jornada", "Monto": "Monto", "Slot Attendant": "Attendant", "Voucher": "Voucher"}
    same = [book.alias("book"), F.lit(0).alias("sheet_idx"), F.lit("Hoja1").alias("sheet")]
    kinds = {f.name: f.dataType for f in rows.schema}
    cells = F.array(*[books.cell(F.col(c), kinds[c]) for c in named.values()])
    titles = F.array(*[F.struct(F.lit(books.TEXT).alias("kind"), F.lit(t).alias("value")) for t in named])
    none = F.lit(None).cast("long").alias("row_idx")
    data = rows.select(*same, (F.col("k") + 1).alias("ord"), none, cells.alias("cells"))
    return data.unionByName(data.select("book").distinct().select(*same[1:], "book", F.lit(0).cast("long").alias("ord"), none, titles.alias("cells")))


# --- sheets ---------------------------------------------------------------------------------------


@register
def header_detect(spark, sf_dir):
    return headers.detect_headers(pick_sheet(raw_grid(spark, sf_dir))).select("path", "sheet", "header_row")


@register
def kind_detect(spark, sf_dir):
    found = headers.detect_headers(pick_sheet(raw_grid(spark, sf_dir)))
    return headers.detect_kind(found).select("path", "Tipo")


@register
def header_bind(spark, sf_dir):
    sheets = pick_sheet(raw_grid(spark, sf_dir))
    bound = headers.bind_headers(sheets, cut_lineage(headers.sheet_headers(sheets)))
    return bound.select("path", "row_idx", "Fecha", "Jornada", "Monto", "Attendant", "IdCliente", "FormaPago", "Voucher")


@register
def header_names(spark, sf_dir):
    """Every named column, known or not, counted per name."""
    sheets = pick_sheet(raw_grid(spark, sf_dir))
    return headers.name_statistics(sheets, cut_lineage(headers.detect_headers(sheets)))


@register
def implied_date(spark, sf_dir):
    """Moments of each prize sheet, whether its date column has a header or is just the first one."""
    batch = canonical(spark, sf_dir, "prizes_grid")
    return batch.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("Fecha").alias("moments"),
        F.min("Fecha").alias("first"),
        F.max("Fecha").alias("last"),
    )


@register
def derive_jornada(spark, sf_dir):
    batch = canonical(spark, sf_dir, "prizes_grid")
    return batch.groupBy("path", "JornadaDia").agg(
        F.count(F.lit(1)).alias("n"), F.min("Fecha").alias("first"), F.max("Fecha").alias("last")
    )


@register
def canonical_ops(spark, sf_dir):
    return canonical(spark, sf_dir, "ops_grid").select("path", *S.CANONICAL_SCHEMA.names)


@register
def canonical_prizes(spark, sf_dir):
    return canonical(spark, sf_dir, "prizes_grid").select("path", *S.CANONICAL_SCHEMA.names)


@register
def sheet_reports(spark, sf_dir):
    """Raw grid to report: monthly totals of every sheet's rows."""
    batch = canonical(spark, sf_dir, "grid")
    return facts.as_facts(batch).groupBy("Tipo", "Mes").agg(
        facts.count_ops().alias("Operaciones"), amounts.sum_amount().alias("Monto")
    )


@register
def routed_rows(spark, sf_dir):
    """Rows of every workbook of the grid by the history table they go to."""
    batch = canonical(spark, sf_dir, "grid")
    target = F.element_at(F.create_map(*[F.lit(x) for pair in history.TABLES.items() for x in pair]), F.col("Tipo"))
    return batch.groupBy("path", target.alias("target")).agg(F.count(F.lit(1)).alias("rows"))


@register
def sheet_manifest(spark, sf_dir):
    """Raw grid to report set: the prize sheets' rows cleaned once, then every report of their kind."""
    return manifest(report_bundle(staged(canonical(spark, sf_dir, "prizes_grid").select(*FACT_COLUMNS)), S.PREMIOS))


@register
def workbook_roundtrip(spark, sf_dir):
    """The grid written as workbooks and read again: every cell of the first sheets."""
    folder = f"{work_folder(spark)}/books"
    cells = F.transform("cells", lambda c: F.struct(F.lit(books.TEXT).alias("kind"), c.alias("value")))
    rows = view(spark, sf_dir, "grid").withColumn("row_idx", F.col("row_idx").cast("long"))
    rows = rows.select(F.col("path").alias("book"), "sheet_idx", "sheet", F.col("row_idx").alias("ord"), "row_idx", cells.alias("cells"))
    books.save_books(rows, folder)
    grid = pick_sheet(read_workbooks(spark, folder))
    text = F.rtrim(F.array_join("cells", "|", ""), F.lit("|")).alias("text")
    return grid.select(F.element_at(F.split("path", "/"), -1).alias("book"), "sheet", "row_idx", text)


@register
def bundle_roundtrip(spark, sf_dir):
    """Report sets published as one workbook each, side by side, and three of their sheets read again."""
    folder, batch = f"{work_folder(spark)}/bundles", ops(spark, sf_dir)
    sets = {f"carga {n}": report_bundle(batch.where(F.col("upload_seq") == n), S.GETNET) for n in range(3)}
    books.save_bundles(sets, folder)
    found = []
    for sheet in (S.MONTHLY_SUMMARY, S.HOURLY_OPERATIONS, S.ANNUAL_DETAIL[: S.SHEET_NAME_LIMIT]):
        rows = pick_sheet(read_workbooks(spark, folder, sheet=sheet), sheet).where("row_idx > 0")
        number = F.get("cells", F.lit(2)).cast("double") if sheet != S.ANNUAL_DETAIL[: S.SHEET_NAME_LIMIT] else F.lit(None).cast("double")
        found.append(
            rows.select(
                F.element_at(F.split("path", "/"), -1).alias("book"), "sheet", "row_idx", F.get("cells", F.lit(0)).alias("name"),
                F.get("cells", F.lit(1)).cast("long").alias("ops"), number.alias("Monto"),
            )
        )
    return reduce(DataFrame.unionByName, found)


@register
def drop_folder_months(spark, sf_dir):
    """Workbooks that arrive in a drop folder, then a corrected one: the months of the history after both runs."""
    work = work_folder(spark)
    history.create_tables(spark, f"{work}/root")
    for corrected in (False, True):
        books.save_books(typed_rows(spark, sf_dir, corrected), f"{work}/drop")
        follow_folder(spark, f"{work}/drop", f"{work}/root", f"{work}/state").awaitTermination()
    found = facts.as_facts(history.read_history(spark, f"{work}/root", S.GETNET)).groupBy("Mes")
    return found.agg(facts.count_ops().alias("Operaciones"), amounts.sum_amount().alias("Monto"), F.max("voucher").alias("last"))


# --- values ---------------------------------------------------------------------------------------


@register
def parse_dates(spark, sf_dir):
    return view(spark, sf_dir, "date_cells").select("k", "txt", dates.parse_day_first(F.col("txt")).alias("Fecha"))


@register
def coerce_amount(spark, sf_dir):
    return view(spark, sf_dir, "ops_cells").select("k", amounts.parse_amount(F.col("monto_txt")).alias("Monto"))


@register
def month_key(spark, sf_dir):
    return view(spark, sf_dir, "ops_raw").select("k", dates.month_key(dates.operating_day(F.col("Fecha"))).alias("Mes"))


@register
def month_label(spark, sf_dir):
    return reports.months(ops(spark, sf_dir)).select("Mes", text.month_label(F.col("Mes")).alias("Etiqueta"))


@register
def payment_class(spark, sf_dir):
    return (
        view(spark, sf_dir, "prizes_raw")
        .groupBy("FormaPago", text.payment_class(F.col("FormaPago")).alias("Categoria"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- filters --------------------------------------------------------------------------------------


@register
def drop_incomplete(spark, sf_dir):
    return cleaning.drop_incomplete(raw_batch(spark, sf_dir, S.GETNET)).select("k", "Fecha", "Attendant")


@register
def valid_hours(spark, sf_dir):
    kept = cleaning.keep_valid_hours(raw_batch(spark, sf_dir, S.GETNET))
    return kept.groupBy(F.hour("Fecha").alias("Hora")).agg(F.count(F.lit(1)).alias("n"))


@register
def attendant_filter(spark, sf_dir):
    return selection.filter_attendants(ops(spark, sf_dir), SELECTED).select("k", "Attendant", "Mes", "Monto")


@register
def attendant_filter_table(spark, sf_dir):
    """Selection given as a table: card operations of attendants who also paid out prizes with tips."""
    paid = prizes(spark, sf_dir).where(F.col("Propina") > 0.07)
    return selection.filter_attendants(ops(spark, sf_dir), paid).select("k", "Attendant", "Mes", "Monto")


@register
def attendant_search(spark, sf_dir):
    return selection.search_attendants(ops(spark, sf_dir), SEARCH)


@register
def exempt_monthly(spark, sf_dir):
    """File mode: the monthly summary ignores the filter, the annual count does not."""
    shown = prepare_reports(ops(spark, sf_dir), S.GETNET, SELECTED, mode="file")
    monthly = shown[S.MONTHLY_SUMMARY].select(F.lit("mes").alias("part"), F.col("Mes").alias("name"), "Operaciones")
    annual = shown[S.ANNUAL_TOTAL].select(F.lit("att").alias("part"), F.col("Attendant").alias("name"), "Operaciones")
    return monthly.unionByName(annual)


@register
def filtered_monthly(spark, sf_dir):
    """History mode: every report follows the filter."""
    return prepare_reports(ops(spark, sf_dir), S.GETNET, SELECTED, mode="history")[S.MONTHLY_SUMMARY]


@register
def exempt_machines(spark, sf_dir):
    return prepare_reports(prizes(spark, sf_dir), S.PREMIOS, SELECTED, mode="file")[S.MACHINE_TOTAL]


@register
def report_selection(spark, sf_dir):
    """Named reports in bundle order, whatever order they are asked for in; unknown names give nothing."""
    wanted = [S.QA, S.ANNUAL_TOTAL, "No such report", S.MONTHLY_SUMMARY]
    return manifest(prepare_reports(ops(spark, sf_dir), S.GETNET, names=wanted))


@register
def selection_rule(spark, sf_dir):
    """Which selections count as no filter: nothing, and exactly the attendants there are."""
    batch = ops(spark, sf_dir)
    everyone = selection.attendants(batch)
    more = everyone.unionByName(spark.createDataFrame([(NOBODY[0],)], "Attendant string"))
    cases = {"nothing": None, "empty list": [], "everyone": everyone, "some": SELECTED, "everyone and more": more}
    answers = [(name, selection.covers_everyone(batch, chosen)) for name, chosen in cases.items()]
    return spark.createDataFrame(answers, "chosen string, unfiltered boolean")


@register
def download_override(spark, sf_dir):
    """A selection sent with a download replaces the stored one in file mode and is ignored in history mode."""
    batch, sent = ops(spark, sf_dir), ["ATT_2"]
    parts = []
    for mode in ("file", "history"):
        shown = prepare_reports(batch, S.GETNET, SELECTED, mode=mode, override=sent)[S.ANNUAL_TOTAL]
        parts.append(shown.select(F.lit(mode).alias("mode"), "Attendant", "Operaciones"))
    return parts[0].unionByName(parts[1])


@register
def empty_input(spark, sf_dir):
    """A filter that no row passes: metrics and hours still have their rows."""
    shown = prepare_reports(ops(spark, sf_dir), S.GETNET, NOBODY, mode="history")
    hours = shown[S.HOURLY_OPERATIONS].select(F.col("Hora").alias("name"), F.col("Operaciones").cast("string").alias("value"))
    return shown[S.QA].select(F.col("Metrica").alias("name"), F.col("Valor").alias("value")).unionByName(hours)


# --- reports --------------------------------------------------------------------------------------


@register
def monthly_summary(spark, sf_dir):
    return reports.monthly_summary(ops(spark, sf_dir))


@register
def monthly_summary_prizes(spark, sf_dir):
    return reports.monthly_summary(prizes(spark, sf_dir))


@register
def hourly_ops(spark, sf_dir):
    return reports.hourly_operations(ops(spark, sf_dir))


@register
def hourly_prizes(spark, sf_dir):
    return reports.hourly_operations(prizes(spark, sf_dir))


@register
def attendant_day(spark, sf_dir):
    return reports.attendant_days(ops(spark, sf_dir))


@register
def attendant_record(spark, sf_dir):
    return reports.attendant_record(ops(spark, sf_dir))


@register
def attendant_record_prizes(spark, sf_dir):
    return reports.attendant_record(prizes(spark, sf_dir))


@register
def attendant_month_ops(spark, sf_dir):
    return reports.attendant_month(ops(spark, sf_dir))


@register
def attendant_month_prizes(spark, sf_dir):
    return reports.attendant_month(prizes(spark, sf_dir), with_amount=False)


@register
def op_count_ops(spark, sf_dir):
    return reports.operation_count(ops(spark, sf_dir))


@register
def op_count_prizes(spark, sf_dir):
    return reports.operation_count_by_class(prizes(spark, sf_dir))


@register
def annual_ops(spark, sf_dir):
    return reports.annual_count(ops(spark, sf_dir))


@register
def annual_prizes(spark, sf_dir):
    return reports.annual_count_by_class(prizes(spark, sf_dir))


@register
def annual_total_prizes(spark, sf_dir):
    return reports.annual_count_classified(prizes(spark, sf_dir))


@register
def mda_month(spark, sf_dir):
    return reports.machine_month(prizes(spark, sf_dir))


@register
def mda_total(spark, sf_dir):
    return reports.machine_total(prizes(spark, sf_dir))


@register
def mda_join_form(spark, sf_dir):
    return reports.machine_month_joined(prizes(spark, sf_dir))


@register
def mda_grouping_sets(spark, sf_dir):
    return reports.machine_grouping_sets(prizes(spark, sf_dir))


@register
def prize_amounts(spark, sf_dir):
    return reports.prize_amounts(prizes(spark, sf_dir), "Mes", "Maquina")


@register
def qa_metrics(spark, sf_dir):
    return reports.quality(ops(spark, sf_dir))


@register
def qa_metrics_prizes(spark, sf_dir):
    return reports.quality(prizes(spark, sf_dir))


@register
def attendants(spark, sf_dir):
    return selection.attendants(ops(spark, sf_dir))


@register
def batch_months(spark, sf_dir):
    return reports.months(ops(spark, sf_dir))


# --- history --------------------------------------------------------------------------------------


@register
def stored_ops(spark, sf_dir):
    return history.store_operations(ops(spark, sf_dir))


@register
def stored_prizes(spark, sf_dir):
    return history.store_prizes(prizes(spark, sf_dir))


@register
def history_ops(spark, sf_dir):
    return history.scan(history.store_operations(ops(spark, sf_dir)), S.GETNET)


@register
def history_prizes(spark, sf_dir):
    return history.scan(history.store_prizes(prizes(spark, sf_dir)), S.PREMIOS)


@register
def history_machines(spark, sf_dir):
    """Machine totals over the history, where an empty machine cell is the machine ``nan``."""
    stored = history.store_prizes(prizes(spark, sf_dir))
    return generate_reports(history.scan(stored, S.PREMIOS), S.PREMIOS)[S.MACHINE_TOTAL]


@register
def latest_upload_wins(spark, sf_dir):
    """Some uploads have no number: they are the oldest, and supply the months that only they contain."""
    number = F.when(F.col("Mes") >= "1996", F.nullif("upload_seq", F.lit(0)))
    kept = uploads.latest_upload_wins(ops(spark, sf_dir).withColumn("upload_seq", number))
    return kept.select("k", "Tipo", "Mes", "upload_seq", "Monto")


@register
def load_receipt(spark, sf_dir):
    both = ops(spark, sf_dir).select("Tipo").unionByName(prizes(spark, sf_dir).select("Tipo"))
    return uploads.load_receipt(both)


@register
def history_replaced(spark, sf_dir):
    """Two loads and a read: months of the second, corrected load replace those of the first, others stay."""
    root = f"{work_folder(spark)}/history"
    first = ops(spark, sf_dir)
    history.create_tables(spark, root)
    history.write_history(first, root)
    history.write_history(first.where(CORRECTED).withColumn("Monto", F.col("Monto") * 2), root)
    return history.read_history(spark, root, S.GETNET).select("voucher", "Mes", "Attendant", "Monto")


@register
def history_receipt(spark, sf_dir):
    """Rows written per kind, as the writes themselves counted them, and what is there to be read."""
    root = f"{work_folder(spark)}/history"
    both = ops(spark, sf_dir).select(*SHARED).unionByName(prizes(spark, sf_dir).select(*SHARED))
    written = history.write_history(both, root)
    there = [history.read_history(spark, root, kind).select("Tipo", "Mes", "Fecha", "Monto") for kind in written]
    read = facts.as_facts(there[0].unionByName(there[1])).groupBy("Tipo").agg(
        facts.count_ops().alias("read"), F.countDistinct("Mes").alias("months"), amounts.sum_amount().alias("Monto")
    )
    rows = F.element_at(F.create_map(*[F.lit(x) for pair in written.items() for x in pair]), F.col("Tipo"))
    return read.withColumn("written", rows.cast("long"))


# --- rollups and publishing -----------------------------------------------------------------------


@register
def rollup_monthly(spark, sf_dir):
    return reports.monthly_summary(stage_facts(ops(spark, sf_dir), S.GETNET).people)


@register
def rollup_record(spark, sf_dir):
    return reports.attendant_record(stage_facts(prizes(spark, sf_dir), S.PREMIOS).people)


@register
def rollup_machines(spark, sf_dir):
    return reports.machine_month(stage_facts(prizes(spark, sf_dir), S.PREMIOS).machines)


@register
def rollup_qa(spark, sf_dir):
    return reports.quality(stage_facts(prizes(spark, sf_dir), S.PREMIOS).people)


@register
def report_manifest(spark, sf_dir):
    return manifest(report_bundle(ops(spark, sf_dir), S.GETNET))


@register
def report_manifest_prizes(spark, sf_dir):
    return manifest(report_bundle(prizes(spark, sf_dir), S.PREMIOS))


@register
def chart_month(spark, sf_dir):
    return month_chart(ops(spark, sf_dir))


@register
def chart_hour(spark, sf_dir):
    return hour_chart(ops(spark, sf_dir))


@register
def chart_hour_json(spark, sf_dir):
    return chart_json(hour_chart(ops(spark, sf_dir)).select("labels", "ops"))
