"""Time and length-band features (C1-C4, C7, C14) and the timestamp parser (B2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D
from .text import _col

# `%Y-%m-%d %H:%M:%S` as Python's strptime reads it: four-digit year, month and
# day with or without a leading zero (day also as space + digit), any run of
# whitespace between date and time, hour/minute/second with one or two digits.
_CREATED = (
    r'\A([0-9]{4})-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])'
    r'[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]+'
    r'(2[0-3]|[01][0-9]|[0-9]):([0-5][0-9]|[0-9]):([0-5][0-9]|[0-9])\z'
)


def parse_created(c) -> Column:
    """Text timestamp -> TIMESTAMP_NTZ, NULL when the text does not parse.

    Shape is checked by regex, the calendar by `try_cast` (Feb 30 -> NULL).
    """
    c = _col(c)

    def part(i, width):
        return F.lpad(F.trim(F.regexp_extract(c, _CREATED, i)), width, '0')

    norm = F.concat(part(1, 4), F.lit('-'), part(2, 2), F.lit('-'), part(3, 2), F.lit(' '),
                    part(4, 2), F.lit(':'), part(5, 2), F.lit(':'), part(6, 2))
    ok = c.rlike(_CREATED) & (F.regexp_extract(c, _CREATED, 1) != '0000')
    return F.when(ok, norm.try_cast('timestamp_ntz'))


def german_weekday(ts) -> Column:
    """German weekday name; `weekday` is 0 for Monday."""
    return F.element_at(F.array(*[F.lit(d) for d in D.WEEKDAYS]), F.weekday(_col(ts)) + 1)


def weekday_pos(ts) -> Column:
    return (F.weekday(_col(ts)) + 1).cast('int')


def daypart(hour, parts=D.DAYPARTS, night=D.NIGHT) -> Column:
    """Daypart label for an hour 0-23 (C4)."""
    h = _col(hour)
    out = None
    for label, lo, hi in parts:
        cond = (h >= lo) & (h < hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(night)


def length_band(n, bands=D.LENGTH_BANDS, last=D.LONG_BAND) -> Column:
    """Length band for a character count (C7); 150 falls in the last band."""
    n = _col(n)
    out = None
    for label, hi in bands:
        out = F.when(n < hi, label) if out is None else out.when(n < hi, label)
    return out.otherwise(last)


# The formats below are built from the fields of the naive time. `date_format`
# would first turn a TIMESTAMP_NTZ into a TIMESTAMP in the session time zone,
# which moves wall times that fall into a daylight-saving gap there.

def fmt_date(c) -> Column:
    """dd.MM.yyyy (C14)."""
    c = _col(c)
    return F.format_string('%02d.%02d.%04d', F.dayofmonth(c), F.month(c), F.year(c))


def fmt_time(c) -> Column:
    """HH:mm (C14)."""
    c = _col(c)
    return F.format_string('%02d:%02d', F.hour(c), F.minute(c))


def fmt_datetime(c) -> Column:
    """dd.MM.yyyy HH:mm (C14)."""
    c = _col(c)
    return F.format_string('%02d.%02d.%04d %02d:%02d', F.dayofmonth(c), F.month(c), F.year(c),
                           F.hour(c), F.minute(c))


def fmt_created(c) -> Column:
    """yyyy-MM-dd HH:mm:ss, the export's `Erstellt` text."""
    c = _col(c)
    return F.format_string('%04d-%02d-%02d %02d:%02d:%02d', F.year(c), F.month(c), F.dayofmonth(c),
                           F.hour(c), F.minute(c), F.second(c))
