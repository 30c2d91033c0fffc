"""The ordered report set, with the attendant filter and report selection."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from floorledger import schema as S
from floorledger.operators import reports as R
from floorledger.operators.facts import CLASS
from floorledger.operators.selection import Selection, covers_everyone, filter_attendants

Reports = dict[str, DataFrame]


@dataclass(frozen=True)
class FactSet:
    """What a report set reads: rows by attendant, day and hour, and rows by machine.

    For a canonical batch or a history scan both are the same frame; for rollups they differ.
    """

    people: DataFrame
    machines: DataFrame

    @classmethod
    def of(cls, source: DataFrame | FactSet) -> FactSet:
        return source if isinstance(source, cls) else cls(source, source)

    def only(self, attendants: Selection) -> FactSet:
        if self.people is self.machines:
            return FactSet.of(filter_attendants(self.people, attendants))
        return FactSet(filter_attendants(self.people, attendants), filter_attendants(self.machines, attendants))


def generate_reports(
    source: DataFrame | FactSet,
    kind: str,
    attendants: Selection = None,
    has_payment_type: bool | None = None,
) -> Reports:
    """All reports of one kind, in bundle order, as lazy frames.

    Prizes without a payment type fall back to the plain counts and report no machines. On empty input
    every report keeps its columns.
    """
    facts = FactSet.of(source).only(attendants)
    people = facts.people
    prizes = kind == S.PREMIOS
    if has_payment_type is None:
        has_payment_type = "FormaPago" in people.columns or CLASS in people.columns
    by_class = prizes and has_payment_type

    reports: Reports = {
        S.MONTHLY_SUMMARY: R.monthly_summary(people),
        S.HOURLY_OPERATIONS: R.hourly_operations(people),
        S.ATTENDANT_RECORD: R.attendant_record(people),
        S.ATTENDANT_MONTH: R.attendant_month(people, with_amount=not prizes),
    }
    if by_class:
        reports[S.OPERATION_COUNT] = R.operation_count_by_class(people)
        reports[S.ANNUAL_DETAIL] = R.annual_count_by_class(people)
        reports[S.ANNUAL_TOTAL] = R.annual_count_classified(people)
    else:
        plain = R.annual_count(people)
        reports[S.OPERATION_COUNT] = R.operation_count(people)
        reports[S.ANNUAL_DETAIL] = plain
        reports[S.ANNUAL_TOTAL] = plain
    if prizes:
        empty = people.sparkSession.createDataFrame([], "none string").drop("none")
        reports[S.MACHINE_MONTH] = R.machine_month(facts.machines) if by_class else empty
        reports[S.MACHINE_TOTAL] = R.machine_total(facts.machines) if by_class else empty
    reports[S.QA] = R.quality(people)
    return reports


def select_reports(reports: Reports, names: Iterable[str] | None = None) -> Reports:
    """The named reports in bundle order; no names means all. Frames left out are never executed."""
    wanted = set(names or ())
    return {name: report for name, report in reports.items() if not wanted or name in wanted}


def prepare_reports(
    source: DataFrame | FactSet,
    kind: str,
    attendants: Selection = None,
    names: Iterable[str] | None = None,
    mode: str = "history",
    has_payment_type: bool | None = None,
    override: Selection = None,
    check_full_selection: bool = False,
) -> Reports:
    """Reports as a viewer sees them.

    ``mode="file"``: the exempt reports always show unfiltered data, and ``override`` (the selection sent
    with a download) takes the place of ``attendants``. ``mode="history"``: every report is filtered and
    ``override`` is ignored. Selecting everyone equals selecting no one; ``check_full_selection`` looks
    for that first, which costs a pass and saves the filtered plans.
    """
    if mode not in ("file", "history"):
        raise ValueError(f"mode must be 'file' or 'history', not {mode!r}")
    if mode == "file" and override is not None:
        attendants = override
    facts = FactSet.of(source)
    if check_full_selection and covers_everyone(facts.people, attendants):
        attendants = None
    reports = generate_reports(facts, kind, attendants, has_payment_type)
    if mode == "file" and attendants is not None:
        whole = generate_reports(facts, kind, None, has_payment_type)
        reports = {name: whole[name] if name in S.FILTER_EXEMPT else report for name, report in reports.items()}
    return select_reports(reports, names)
