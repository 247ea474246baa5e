"""Column helpers that give Spark columns the Oracle SQL meaning the reports rely on.

Every helper returns a ``Column`` built only from ``pyspark.sql.functions``, so it
stays inside whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

import datetime as _dt
from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Oracle's DD/MM/YYYY HH24:MI:SS display mask and the report's
# parameter mask, written as Spark datetime patterns.
DISPLAY_FORMAT = "dd/MM/yyyy HH:mm:ss"
PARAMETER_DATE_FORMAT = "%d/%m/%Y"

_MAX_LEN = 2147483647


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def oracle_concat(*parts: ColumnLike) -> Column:
    """``a || b || …`` where NULL reads as empty text and an empty result is NULL.

    Oracle treats '' as NULL, so the concatenation of only NULL parts is NULL.
    Strings are column names; wrap literal text in ``F.lit``.
    """
    return F.nullif(F.concat_ws("", *[_col(p) for p in parts]), F.lit(""))


def strip_controls(c: ColumnLike) -> Column:
    """``TRANSLATE(s, CHR(9)||CHR(10)||CHR(13), ' ')``: tab becomes a space, LF and CR are removed."""
    return F.translate(_col(c), "\t\n\r", " ")


def substr_from(c: ColumnLike, pos: int) -> Column:
    """``SUBSTR(s, pos)``: NULL, not '', when the text is shorter than ``pos``."""
    return F.nullif(F.substring(_col(c), pos, _MAX_LEN), F.lit(""))


def digits_to_number(c: ColumnLike) -> Column:
    """The report's all-digits guard: the number when the trimmed text is only digits, else NULL.

    A ``decimal(38,0)``, so a receipt number beyond the range of a long stays a key of its own.
    """
    t = F.trim(_col(c))
    return F.when(t.rlike(r"^[0-9]+\z"), t.try_cast("decimal(38,0)"))


def safe_number(c: ColumnLike, type_: str = "double", decimal_comma: bool = False) -> Column:
    """``TO_NUMBER`` that yields NULL on malformed text instead of failing the job.

    Only digits with a sign, a decimal point or an exponent are a number: ``'30d'``, ``'NaN'`` and ``'Infinity'`` are not.

    ``decimal_comma``: read the text as a pt-BR session would (``'1.234,5'`` →
    1234.5): dots are group separators, the comma is the decimal point.
    """
    t = F.trim(_col(c))
    if decimal_comma:
        t = F.translate(F.translate(t, ".", ""), ",", ".")
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), t.try_cast(type_))


def decode_number(c: ColumnLike, cases: Mapping[int, Column], default: Column | None = None) -> Column:
    """``DECODE(text_col, 1, r1, 2, r2, …)`` with the text side read as a number.

    Text that is not a number matches no case (Oracle would raise instead).
    """
    key = safe_number(c, "decimal(38,10)")
    out = None
    for k, v in cases.items():
        out = F.when(key == F.lit(k), v) if out is None else out.when(key == F.lit(k), v)
    if out is None:
        return default if default is not None else F.lit(None)
    return out.otherwise(default) if default is not None else out


def yes_no(cond: Column, yes: str, no: str) -> Column:
    """``CASE WHEN cond THEN yes ELSE no END`` (unknown falls to ``no``, as in SQL)."""
    return F.when(cond, F.lit(yes)).otherwise(F.lit(no))


def to_char(c: ColumnLike) -> Column:
    """``TO_CHAR(date, 'DD/MM/YYYY HH24:MI:SS')``."""
    return F.date_format(_col(c), DISPLAY_FORMAT)


def parse_report_date(text: str | _dt.date) -> _dt.date:
    """Parse a ``DD/MM/YYYY`` report parameter (dates pass through)."""
    if isinstance(text, _dt.datetime):
        return text.date()
    if isinstance(text, _dt.date):
        return text
    return _dt.datetime.strptime(text.strip(), PARAMETER_DATE_FORMAT).date()


def day_range(c: ColumnLike, start: str | _dt.date, end: str | _dt.date) -> Column:
    """``c BETWEEN start 00:00:00 AND end 23:59:59`` as a half-open day range.

    ``[start, end + 1 day)`` keeps fractional seconds of the last second that the
    literal BETWEEN would lose, and is a plain range predicate the parquet reader
    can push down.
    """
    lo = parse_report_date(start).isoformat() + " 00:00:00"
    hi = (parse_report_date(end) + _dt.timedelta(days=1)).isoformat() + " 00:00:00"
    col = _col(c)
    # text literals cast to a zone-less timestamp: the bounds do not depend on the
    # session or machine time zone
    return (col >= F.lit(lo).cast("timestamp_ntz")) & (col < F.lit(hi).cast("timestamp_ntz"))


def as_of_day(as_of: _dt.date | _dt.datetime | str) -> _dt.date:
    """``TRUNC(SYSDATE)`` for an explicit reference instant."""
    if isinstance(as_of, str):
        return _dt.date.fromisoformat(as_of[:10])
    if isinstance(as_of, _dt.datetime):
        return as_of.date()
    return as_of


def valid_on(start: ColumnLike, end: ColumnLike, as_of) -> Column:
    """``TRUNC(as_of) BETWEEN TRUNC(start) AND TRUNC(end)`` (closed interval, NULL bounds fail)."""
    d = F.lit(as_of_day(as_of))
    return (F.to_date(_col(start)) <= d) & (d <= F.to_date(_col(end)))


def ends_after(end: ColumnLike, as_of) -> Column:
    """``end > SYSDATE`` for a DATE ``end``: same as ``TRUNC(end) > TRUNC(as_of)``.

    Rows that start in the future still count; a NULL end fails.
    """
    return F.to_date(_col(end)) > F.lit(as_of_day(as_of))


def code_text(c: ColumnLike) -> Column:
    """A number shown as lookup-code text."""
    return _col(c).cast("string")


def code_number(code: ColumnLike) -> Column:
    """A text lookup code as the number Oracle compares it as (``'01'`` → 1).

    Where the source compares a numeric id with a text code, Oracle converts the
    text side; codes that are not numbers match nothing here instead of failing.
    Use as an equi-join key: ``number_col == code_number(code_col)``.
    """
    return safe_number(code, "decimal(38,10)")


def blank() -> Column:
    """The reports' ``' '`` placeholder column."""
    return F.lit(" ")


def typed_null(type_: str) -> Column:
    return F.lit(None).cast(type_)
