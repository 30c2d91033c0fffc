"""Time expressions: day-first parsing of mixed spellings, the operating day and its month.

All results are zone-free (``TIMESTAMP_NTZ``), so the session time zone never shifts a value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from floorledger import schema as S
from floorledger.functions.text import strip

# The representable range of the parsed column. Text outside of it counts as unreadable,
# which also bounds the number of distinct months (585 years, about 7,000 months).
EARLIEST = "1677-09-21 00:12:43.145225"
LATEST = "2262-04-11 23:47:16.854775"

# English month names.
ENGLISH_MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}

_CLOCK = (
    r"(?:(?:[ ,]+|T)(\d{1,2})(?::(\d{2})(?::(\d{2})(\.\d{1,9})?)?)?"
    r"(?:\s*([ap])\.?\s?(?:m\.?)?)?)?"
)
ISO = r"^\d{4}-(?:0\d|1[0-2])-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?$"
# The common spelling, rewritten to ISO in one step.
DAY_FIRST = (
    r"^(0?[1-9]|[12]\d|3[01])[-/.](0?[1-9]|1[0-2])[-/.](\d{4})"
    r"(?:[ T]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?$"
)
# The same two within years that are certainly in range: read by generated code, without the ladder.
NEAR_ISO = r"^(?:1[7-9]|2[01])\d{2}-(?:0\d|1[0-2])-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?$"
NEAR_DAY_FIRST = (
    r"^(0?[1-9]|[12]\d|3[01])[-/.](0?[1-9]|1[0-2])[-/.]((?:1[7-9]|2[01])\d{2})"
    r"(?:[ T]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?$"
)
# Each of the others is rewritten to: first | second | third | hour | minute | second | fraction | a/p
SPELLINGS = [
    (r"(?i)^(\d{1,4})([-/. ])(\d{1,2})\2(\d{1,4})" + _CLOCK + "$", "$1|$3|$4|$5|$6|$7|$8|$9"),
    (r"(?i)^(\d{1,2})[-/. ]+([a-z]{3,9})\.?[-/., ]+(\d{4}|\d{2})" + _CLOCK + "$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    (r"(?i)^([a-z]{3,9})\.?[-/ ]+(\d{1,2})[-/, ]+(\d{4})" + _CLOCK + "$", "$2|$1|$3|$4|$5|$6|$7|$8"),
    (r"^(\d{4})(\d{2})(\d{2})(?:[ T]?(\d{2})(\d{2})(\d{2})?)?$", "$1|$2|$3|$4|$5|$6||"),
    (r"^(\d{4})[-/](\d{1,2})$", "$1|$2|1|||||"),
    (r"^(\d{4})$", "$1|1|1|||||"),
    (r"^(\d{1,2})[-/](\d{4})$", "$2|$1|1|||||"),
]


def _pieces(text: Column) -> Column:
    """Split a spelling into its eight parts; null when no spelling matches."""
    rewritten = None
    for pattern, target in SPELLINGS:
        test, value = text.rlike(pattern), F.regexp_replace(text, pattern, target)
        rewritten = F.when(test, value) if rewritten is None else rewritten.when(test, value)
    return F.split(rewritten, r"\|", -1)


def _numbers(parts: Column) -> Column:
    """The eight parts as numbers: ``lead`` is the day or month that stands apart from the year, ``mid``
    the one in the middle, which may be a month name."""

    def part(i: int) -> Column:
        return F.get(parts, F.lit(i))

    months = F.create_map(*[F.lit(x) for pair in ENGLISH_MONTHS.items() for x in pair])
    year_first = F.length(part(0)) == 4
    year_text = F.when(year_first, part(0)).when(F.length(part(2)) != 3, part(2))
    fields = {
        "year_first": year_first,
        "lead": F.when(year_first, F.when(F.length(part(2)) <= 2, part(2))).otherwise(part(0)).try_cast("int"),
        "mid": F.coalesce(F.try_element_at(months, F.lower(part(1))), part(1).try_cast("int")),
        "year": F.when(F.length(year_text) <= 2, year_text.try_cast("int") + 10000).otherwise(year_text.try_cast("int")),
        "hour": F.coalesce(part(3).try_cast("int"), F.lit(0)),
        "rest": F.concat(F.lpad(part(4), 2, "0"), F.lit(":"), F.lpad(part(5), 2, "0"), part(6)),
        "half": F.lower(part(7)),
    }
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _iso_text(n: Column) -> Column:
    """ISO text of the parts; null when a part is missing.

    Day-first, or month-first where only that reading is a date. With a leading year it is year, month,
    day, except that a 12-hour clock makes the day come before the month again. Two-digit years lie
    within 50 years of today.
    """

    def pad(number: Column) -> Column:
        return F.lpad(number.cast("string"), 2, "0")

    has_half = n["half"] != ""
    swap = (n["mid"] > 12) | (n["year_first"] & has_half & (n["lead"] <= 12))
    horizon = F.year(F.current_date()) + 50
    year = n["year"] - F.when(n["year"] < 10000, 0).when(n["year"] - 8000 < horizon, 8000).otherwise(8100)
    clock = F.when(~has_half, n["hour"]).when(
        n["hour"].between(1, 12), n["hour"] % 12 + F.when(n["half"] == "p", 12).otherwise(0)
    )
    return F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-"),
        F.when(swap, F.concat(pad(n["lead"]), F.lit("-"), pad(n["mid"]))).otherwise(
            F.concat(pad(n["mid"]), F.lit("-"), pad(n["lead"]))
        ),
        F.lit(" "), pad(clock), F.lit(":"), n["rest"],
    )


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_day_first(text: Column) -> Column:
    """Timestamp of a text cell; null when it cannot be read.

    ISO text (what the workbook reader emits for date cells) and the plain day-first spelling of common
    years are ordinary columns and run as generated code. Any other spelling is matched once into parts
    and rebuilt as ISO text for the same cast. Those steps are bound with lambdas and not written as
    nested columns: repeated inside whole-stage code they make one method too large for the JVM to
    compile, which runs several times slower. The empty text, which stands for a column that the sheet does not
    have, is looked at once.
    """
    low, high = F.lit(EARLIEST).cast("timestamp_ntz"), F.lit(LATEST).cast("timestamp_ntz")

    def iso(cell: Column) -> Column:
        other = _with(_pieces(cell), lambda parts: _with(_numbers(parts), _iso_text))
        day_first = F.regexp_replace(cell, DAY_FIRST, "$3-$2-$1 $4")
        return F.when(cell.rlike(ISO), cell).when(cell.rlike(DAY_FIRST), day_first).when(cell != "", other)

    def moment(cell: Column) -> Column:
        return _with(iso(cell).try_cast("timestamp_ntz"), lambda t: F.when(t.between(low, high), t))

    day_first = F.regexp_replace(text, NEAR_DAY_FIRST, "$3-$2-$1 $4")
    plain = F.when(text == "", F.lit(None).cast("string")).when(text.rlike(NEAR_ISO), text).when(text.rlike(NEAR_DAY_FIRST), day_first)
    ladder = F.when((text != "") & ~text.rlike(NEAR_ISO) & ~text.rlike(NEAR_DAY_FIRST), _with(strip(text), moment))
    return F.coalesce(plain.try_cast("timestamp_ntz"), ladder)


def operating_day(moment: Column) -> Column:
    """Date of the operating day, which starts at 10:00."""
    return F.to_date(moment - F.expr(f"INTERVAL {S.DAY_START_HOUR} HOURS"))


def month_key(day: Column) -> Column:
    """``yyyy-MM`` of a date, by text so that no time zone takes part."""
    return F.left(day.cast("string"), F.lit(7))
