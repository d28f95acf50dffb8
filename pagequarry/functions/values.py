"""Cell typing: kind of a value, numbers, booleans and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# The kinds a cell can have, the currency signs and the words.
KINDS = ["integer", "number", "currency", "date", "boolean", "string"]
CURRENCY = r"(?U)^\s*[\$€£¥₹]\s*([\d,]+(?:\.\d+)?)\s*$"
INTEGER = r"(?U)^-?\d{1,15}$"
NUMBER = r"(?U)^-?\d+(?:[.,]\d+)?$"
TRUE_WORDS = ["true", "yes"]
FALSE_WORDS = ["false", "no"]
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
]

_D, _Y = r"(\d{1,2})", r"(\d{4})"
_MDY, _DMY = rf"^([A-Za-z]+)\s+{_D},\s+{_Y}$", rf"^{_D}\s+([A-Za-z]+)\s+{_Y}$"
# The accepted date layouts in order of preference, as (name, pattern,
# year-month-day in terms of its groups, month words or None).
DATE_LAYOUTS = [
    ("yyyy-M-d", rf"^{_Y}-{_D}-{_D}$", "$1-$2-$3", None),
    ("d/M/yyyy", rf"^{_D}/{_D}/{_Y}$", "$3-$2-$1", None),
    ("M/d/yyyy", rf"^{_D}/{_D}/{_Y}$", "$3-$1-$2", None),
    ("yyyy/M/d", rf"^{_Y}/{_D}/{_D}$", "$1-$2-$3", None),
    ("d-M-yyyy", rf"^{_D}-{_D}-{_Y}$", "$3-$2-$1", None),
    ("d MMMM yyyy", _DMY, "$3-#-$1", MONTHS),
    ("MMMM d, yyyy", _MDY, "$3-#-$2", MONTHS),
    ("d MMM yyyy", _DMY, "$3-#-$1", [m[:3] for m in MONTHS]),
]
DATE_NAMES = [layout[0] for layout in DATE_LAYOUTS]


def _date_as(s: Column, name: str) -> Column:
    """``parse_date_as`` on a stripped value."""
    _, pattern, order, words = DATE_LAYOUTS[DATE_NAMES.index(name)]
    iso = F.regexp_replace(s, pattern, order)
    if words is not None:
        word = F.lower(F.regexp_extract(s, "[A-Za-z]+", 0))
        pos = F.array_position(F.array(*[F.lit(w) for w in words]), word)
        iso = F.when(pos > 0, F.replace(iso, F.lit("#"), pos.cast("string")))
    # There is no year zero.
    return F.when(s.rlike(pattern) & ~iso.startswith("0000"), iso.try_cast("date"))


def _date(s: Column) -> Column:
    return F.coalesce(*[_date_as(s, name) for name in DATE_NAMES])


def parse_date_as(c: Column, name: str) -> Column:
    """The DATE written in ``c`` in one layout, else NULL."""
    return text.let(text.strip(c), lambda s: _date_as(s, name))


def parse_date(c: Column) -> Column:
    """The DATE written in ``c`` in the first layout that fits, else NULL."""
    return text.let(text.strip(c), _date)


def kind(c: Column) -> Column:
    """``empty`` or one of ``KINDS``; the first that fits."""

    def of(s: Column) -> Column:
        # Only text with a digit at either end can be a date in any layout.
        dated = s.rlike(r"^\d|\d$") & _date(s).isNotNull()
        return (
            F.when(s.isNull() | (s == ""), "empty")
            .when(s.rlike(INTEGER), "integer")
            .when(s.rlike(NUMBER), "number")
            .when(s.rlike(CURRENCY), "currency")
            .when(dated, "date")
            .when(F.lower(s).isin(TRUE_WORDS + FALSE_WORDS), "boolean")
            .otherwise("string")
        )

    return text.let(text.strip(c), of)


def strip_currency(c: Column, decimal_comma: bool = False) -> Column:
    """Digits of an amount. A comma is a thousands mark unless told otherwise."""
    inner = F.when(c.rlike(CURRENCY), F.regexp_extract(c, CURRENCY, 1)).otherwise(c)
    if decimal_comma:
        lone = inner.rlike(r"^-?\d+,\d+$")
        inner = F.when(lone, F.replace(inner, F.lit(","), F.lit("."))).otherwise(inner)
    return F.replace(inner, F.lit(","), F.lit(""))


def to_number(c: Column, decimal_comma: bool = False) -> Column:
    # The cast alone would also read suffixes of other languages, such as 5d or 10f.
    def read(s: Column) -> Column:
        return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))

    return text.let(text.strip(strip_currency(c, decimal_comma)), read)


def to_integer(c: Column) -> Column:
    s = text.strip(c)
    whole = s.rlike(r"^[+-]?\d{1,15}(?:\.0*)?$")
    return F.when(whole, s.try_cast("double").cast("bigint"))


def to_boolean(c: Column) -> Column:
    s = F.lower(text.strip(c))
    return F.when(s.isin(TRUE_WORDS), True).when(s.isin(FALSE_WORDS), False)
