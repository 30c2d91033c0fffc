"""Text expressions: trimming, payment classes, month and hour labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floorledger import schema as S

# Every character that counts as white space at the ends of a cell.
UNICODE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ASCII_SPACE = " \t\n\x0b\x0c\r"


def strip(text: Column, characters: str = UNICODE_SPACE) -> Column:
    return F.btrim(text, F.lit(characters))


def payment_class(payment: Column) -> Column:
    """Payment type -> one of the four classes, null when it is none of them."""
    spellings = [(spelling, name) for name, group in S.PAYMENT_CLASSES.items() for spelling in group]
    classes = F.create_map(*[F.lit(text) for pair in spellings for text in pair])
    return F.try_element_at(classes, strip(F.lower(payment)))


def month_label(month: Column) -> Column:
    """``2024-01`` -> ``Enero 2024``.

    A number outside 1..12 keeps its own text; anything that is not two dash-separated parts with a
    whole second part is returned as it came.
    """
    parts = F.split(month, "-")
    year, text = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    number = F.when(strip(text).rlike(r"^[+-]?\d{1,9}$"), strip(text).try_cast("int"))
    names = F.array(*[F.lit(n) for n in S.MONTH_NAMES])
    name = F.get(names, number - 1)
    return F.when(
        (F.size(parts) == 2) & number.isNotNull(),
        F.concat(F.coalesce(name, text), F.lit(" "), year),
    ).otherwise(month)


def timestamp_text(moment: Column) -> Column:
    """Second precision, or six digits when there is a fraction; ``NaT`` for null."""
    text = moment.cast("string")
    padded = F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)
    return F.coalesce(padded, F.lit("NaT"))
