"""Dates as people write them, as pandas ``to_datetime(format="mixed", errors="coerce")`` reads them.

A text is first reduced to its shape (digits, month names, separators).  Each
shape says where year, month and day stand; the fields are then put together as
ISO text and cast once, so that no date that does not exist gets through.  Month
comes before day unless only the other way gives a date.  Everything is a
built-in expression; the plain ISO shape takes a short cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months and weekdays, the marks of a time of day and of
# a zone, and the first and last moments that pandas can hold.
_MONTH = (r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?"
          r"|dec(?:ember)?)")
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_WEEKDAY = r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,6})?\d*)?\s*(am|pm)?\s*(z|utc|gmt|[+-]\d{2}:?\d{2})?$"
_FIRST, _LAST = "1677-09-21 00:12:43.145225", "2262-04-11 23:47:16.854775"

_ISO = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)?$"
_TIMED = r"^(.*?\d{2,4}|.*?\d)(?:t|[ ,]+|-)" + _CLOCK
_HOUR = r"^(.*?\d)[ ,]+(\d{1,2})\s*(am|pm)$"
_ISO_HOUR = r"^(\d{4}-\d{1,2}-\d{1,2})[t -](\d{1,2})$"
_PACKED = r"^(\d{8})t?\s?(\d{2})(\d{2})(\d{2})?$"

#: Shapes of a date: pattern, and the groups that hold year, month and day (0: the first of the month or year).
_SEP, _NAMED = r"[-/. ]", r"[-/ .,]*"
_M, _D, _TH = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])", r"(?:st|nd|rd|th)?"
_SHAPES: list[tuple[str, int, int, int]] = [
    (rf"^(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}})$", 1, 2, 3),
    (rf"^{_M}{_SEP}{_D}{_SEP}(\d{{4}}|\d{{1,2}})$", 3, 1, 2),
    (rf"^{_D}{_SEP}{_M}{_SEP}(\d{{4}}|\d{{1,2}})$", 3, 2, 1),
    (rf"^(3[2-9]|[4-9]\d){_SEP}{_M}{_SEP}{_D}$", 1, 2, 3),
    (r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3),
    (rf"^(\d{{4}})[-/.]{_M}$", 1, 2, 0),
    (rf"^{_M}[-/.](\d{{4}})$", 2, 1, 0),
    (r"^(\d{4})$", 1, 0, 0),
    (r"^(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(\d{2})$", 3, 1, 2),
    (r"^(0[1-9]|[12]\d|3[01])(0[1-9]|1[0-2])(\d{2})$", 3, 2, 1),
]
_NAMED_SHAPES: list[tuple[str, int, int, int]] = [
    (rf"^(\d{{1,2}}){_TH}(?: of)?{_NAMED}{_MONTH}{_NAMED}(\d{{4}}|\d{{2}})$", 3, 2, 1),
    (rf"^{_MONTH}{_NAMED}(\d{{1,2}}){_TH}[-/ .,]+(\d{{4}}|\d{{2}})$", 3, 1, 2),
    (rf"^(\d{{4}}){_NAMED}{_MONTH}{_NAMED}(\d{{1,2}}){_TH}$", 1, 2, 3),
    (rf"^{_MONTH}{_NAMED}(\d{{4}})$", 2, 1, 0),
]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _year(text: Column) -> Column:
    """Two digits (or one) mean the year nearest to now: less than 50 years ahead."""
    full = F.lit(2000) + text.cast("int")
    full = F.when(full >= F.year(F.current_date()) + 50, full - 100).otherwise(full)
    return F.when(F.length(text) == 4, text).otherwise(full.cast("string"))


def _fields(day: Column, shapes: list[tuple[str, int, int, int]], named: bool) -> Column:
    """The ISO date of a text by the first shape that it has."""
    out = None
    for pattern, y, m, d in shapes:
        month = F.regexp_extract(day, pattern, m) if m else F.lit("1")
        if named:
            place = F.instr(F.lit(_MONTHS), F.substring(month, 1, 3))
            month = ((place + 2) / 3).cast("int").cast("string")
        iso = F.concat_ws("-", _year(F.regexp_extract(day, pattern, y)), month, F.regexp_extract(day, pattern, d) if d else F.lit("1"))
        out = F.when(day.rlike(pattern), iso) if out is None else out.when(day.rlike(pattern), iso)
    return out


def _date(day: Column) -> Column:
    return F.when(day.rlike("[a-z]"), _fields(day, _NAMED_SHAPES, True)).otherwise(_fields(day, _SHAPES, False))


def _hour(hour: Column, half: Column) -> Column:
    """24-hour text; with am or pm, hours run from 1 to 12."""
    h = hour.cast("int")
    return F.when(half == "", hour).when(h.between(1, 12), (h % 12 + F.when(half == "pm", 12).otherwise(0)).cast("string"))


def _parts(text: Column) -> Column:
    """(day, clock, zone) of a lower-cased text without its weekday."""
    def part(pattern, group):
        return F.regexp_extract(text, pattern, group)

    def parts(day, hour, minute="0", second="0", fraction="", zone=""):
        cols = [x if isinstance(x, Column) else F.lit(x) for x in (minute, second, fraction, zone)]
        seconds = F.when(cols[1] == "", F.lit("0")).otherwise(cols[1])
        return F.struct(day.alias("day"), F.concat(F.lit(" "), hour, F.lit(":"), cols[0], F.lit(":"), seconds, cols[2]).alias("clock"),
                        cols[3].alias("zone"))

    timed = parts(part(_TIMED, 1), _hour(part(_TIMED, 2), part(_TIMED, 6)), *(part(_TIMED, i) for i in (3, 4, 5, 7)))
    none = F.struct(text.alias("day"), F.lit("").alias("clock"), F.lit("").alias("zone"))
    return (F.when(text.contains(":") & text.rlike(_TIMED), timed)
            .when(text.rlike(_HOUR), parts(part(_HOUR, 1), _hour(part(_HOUR, 2), part(_HOUR, 3))))
            .when(text.rlike(_ISO_HOUR), parts(part(_ISO_HOUR, 1), part(_ISO_HOUR, 2)))
            .when(text.rlike(_PACKED), parts(part(_PACKED, 1), part(_PACKED, 2), part(_PACKED, 3), part(_PACKED, 4)))
            .otherwise(none))


def _moment(p: Column) -> Column:
    def cast(iso: Column) -> Column:
        zone = F.regexp_replace(F.when(p["zone"].isin("z", "utc", "gmt"), F.lit("+00:00")).otherwise(p["zone"]), r"^([+-]\d\d)(\d\d)$", "$1:$2")
        return (F.when(p["zone"] == "", iso.try_cast("timestamp_ntz"))
                .otherwise(F.to_utc_timestamp(F.concat(iso, zone).try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")))

    return _let(F.concat(_date(p["day"]), p["clock"]), cast)


def parse(value: Column) -> Column:
    """The moment that a text names, as TIMESTAMP_NTZ (with a zone: in UTC), or NULL."""
    def any_shape(text: Column) -> Column:
        return _let(F.regexp_replace(F.lower(text), _WEEKDAY, ""), lambda t: _let(_parts(t), _moment))

    trimmed = F.trim(value)
    found = F.when(trimmed.rlike(_ISO), trimmed.try_cast("timestamp_ntz")).otherwise(any_shape(trimmed))
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (_FIRST, _LAST))
    return F.when(found.between(low, high), found)


def shape(value: Column) -> Column:
    """What a text looks like: ``9`` for a digit, ``a`` for a run of letters, the rest as it is."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"\p{L}+", "a"), r"\p{N}", "9")
