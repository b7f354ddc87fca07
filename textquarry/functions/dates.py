"""Dates of feeds: one parser per format, tried in order, to UTC timestamps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months as feeds write them, and minutes of zone names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
HUNGARIAN = ("január", "február|februári", "március", "április", "május|máujus", "június", "július", "augusztus", "szeptember", "október", "november", "december")
GREEK = ("Ιαν", "Φεβ", "Μάρ|Μαρ|Μάώ|Μαώ", "Απρ", "Μάι|Μαϊ|Μαι|Μαΐ", "Ιούν|Ιον|Ιουν", "Ιούλ|Ιολ|Ιουλ", "Αύγ|Αυγ", "Σεπ", "Οκτ", "Νοέ|Νοε", "Δεκ")
ZONES = {"ut": 0, "gmt": 0, "utc": 0, "z": 0, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "cet": 60, "cest": 120, "msk": 180, "met": 60, "mest": 120}

DateParser = Callable[[Column], Column]


def number(text: Column) -> Column:
    return text.try_cast("int")


def month_number(name: Column, names: tuple[str, ...] = MONTHS) -> Column:
    out = F.lit(None).cast("int")
    for i, own in enumerate(names, 1):
        out = F.when(name.rlike(f"(?i)^(?:{own})"), i).otherwise(out)
    return F.coalesce(number(name), out)


def zone_minutes(zone: Column) -> Column:
    """Minutes east of UTC of `+01:00`, `-0500`, `Z` or a name; an empty or unknown one is UTC."""
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    hours, minutes = number(F.regexp_extract(zone, r"^[+-](\d{1,2})", 1)), number(F.regexp_extract(zone, r"^[+-]\d{2}:?(\d{2})", 1))
    named = F.lit(0)
    for name, value in ZONES.items():
        named = F.when(F.lower(zone) == name, value).otherwise(named)
    return F.when(zone.rlike(r"^[+-]\d"), sign * (F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(minutes, F.lit(0)))).otherwise(named)


def moment(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, zone: Column) -> Column:
    """UTC timestamp of parts, null if they make no date."""
    zero = F.lit(0)
    clock = F.coalesce(hour, zero) * 3600 + F.coalesce(minute, zero) * 60 + F.floor(F.coalesce(second.cast("double"), F.lit(0.0)))
    good = (F.coalesce(hour, zero) < 25) & (F.coalesce(minute, zero) < 60) & (F.coalesce(second.cast("double"), F.lit(0.0)) < 61)
    day_of = F.call_function("try_to_date", F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd"))
    whole = (year.isNotNull() & month.isNotNull() & day.isNotNull()) & good
    return F.when(whole, F.timestamp_seconds(F.unix_timestamp(day_of.cast("timestamp")) + clock - zone_minutes(zone) * 60))


def parts(text: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract(text, pattern, k) for k in range(1, n + 1)]


def w3c(text: Column) -> Column:
    """`2003`, `2003-12`, `2003-12-31`, `2003-12-31T10:14:55Z`; a missing month or day is 1."""
    y, mo, d, h, mi, s, z = parts(text, r"^(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?)?\s*(Z|[A-Za-z]{1,5}|[+-]\d{2}:?\d{2})?$", 7)
    return F.when(y != "", moment(number(y), F.coalesce(number(mo), F.lit(1)), F.coalesce(number(d), F.lit(1)), number(h), number(mi), s.try_cast("double"), z))


def rfc822(text: Column) -> Column:
    """`Mon, 01 Jan 2024 10:00:00 +0100`; two-digit years under 90 are of this century, day and month may be swapped."""
    plain = F.regexp_replace(text, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s*", "")
    a, b, y, h, mi, s, z = parts(plain, r"^(\d{1,2}|[A-Za-z]{3,9}),?[\s-]+(\d{1,2}|[A-Za-z]{3,9}),?[\s-]+(\d{2,4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?\s*([A-Za-z]{1,5}|[+-]\d{4}|[+-]\d{2}:\d{2})?$", 7)
    swapped = a.rlike("^[A-Za-z]")
    day, month, year = F.when(swapped, b).otherwise(a), F.when(swapped, a).otherwise(b), number(y)
    full = F.when(F.char_length(y) > 2, year).when(year < 90, year + 2000).otherwise(year + 1900)
    return F.when((y != "") & month.rlike("^[A-Za-z]"), moment(full, month_number(month), number(day), number(h), number(mi), s.try_cast("double"), z))


def iso8601(text: Column) -> Column:
    """Compact and ordinal forms: `20031231`, `2003-365`, `20031231T101455Z`. Anchored; what is missing is 1, never today's."""
    y, mo, d, h, mi, s, z = parts(text, r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2}):?(\d{2}):?(\d{2}(?:\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$", 7)
    compact = F.when(y != "", moment(number(y), number(mo), number(d), number(h), number(mi), s.try_cast("double"), z))
    oy, od = parts(text, r"^(\d{4})-?(\d{3})$", 2)
    start = F.call_function("try_to_date", F.concat(oy, F.lit("-01-01")), F.lit("yyyy-MM-dd"))
    return F.coalesce(compact, F.when(oy != "", F.date_add(start, number(od) - 1).cast("timestamp")))


def asctime(text: Column) -> Column:
    """`Sun Jan  4 16:29:06 2004`, with an offset before or behind the year."""
    mo, d, h, mi, s, z, y, z2 = parts(text, r"^[A-Za-z]{3,9}\s+([A-Za-z]{3})[a-z]*\s+(\d{1,2})\s+(\d{1,2}):(\d{2}):(\d{2})\s+(?:([+-]\d{4}|[A-Z]{1,5})\s+)?(\d{4})(?:\s+([+-]\d{4}))?$", 8)
    return F.when(y != "", moment(number(y), month_number(mo), number(d), number(h), number(mi), s.try_cast("double"), F.concat(z, z2)))


def perforce(text: Column) -> Column:
    """`Fri, 2006/09/15 08:19:53 EDT`."""
    y, mo, d, h, mi, s, z = parts(text, r"^[A-Za-z]{3}, (\d{4})/(\d{2})/(\d{2}) (\d{2}):(\d{2}):(\d{2}) ([A-Za-z]{1,5})$", 7)
    return F.when(y != "", moment(number(y), number(mo), number(d), number(h), number(mi), s.try_cast("double"), z))


def hungarian(text: Column) -> Column:
    """`2004-július-13T9:15-05:00`."""
    y, mo, d, h, mi, z = parts(text, r"^(\d{4})-([^\d-]+)-(\d{1,2})T(\d{1,2}):(\d{2})((?:[+-]\d{2}:\d{2})?)$", 6)
    return F.when(y != "", moment(number(y), month_number(mo, HUNGARIAN), number(d), number(h), number(mi), F.lit(0.0), z))


def greek(text: Column) -> Column:
    """`Κυρ, 11 Ιούλ 2004 12:00:00 EST`."""
    d, mo, y, h, mi, s, z = parts(text, r"^[^\s,]+,\s+(\d{1,2})\s+([^\s\d]+)\s+(\d{4})\s+(\d{1,2}):(\d{2}):(\d{2})\s+(\S+)$", 7)
    return F.when(y != "", moment(number(y), month_number(mo, GREEK), number(d), number(h), number(mi), s.try_cast("double"), z))


def korean(text: Column) -> Column:
    """`2004년 05월 28일 01:31:15` and `2004-05-25 오후 11:23:17`, of the zone +09:00."""
    zone = F.lit("+09:00")
    y, mo, d, h, mi, s = parts(text, r"^(\d{4})년\s+(\d{2})월\s+(\d{2})일\s+(\d{2}):(\d{2}):(\d{2})$", 6)
    first = F.when(y != "", moment(number(y), number(mo), number(d), number(h), number(mi), s.try_cast("double"), zone))
    y, mo, d, half, h, mi, s = parts(text, r"^(\d{4})-(\d{2})-(\d{2})\s+(오전|오후)\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$", 7)
    hour = number(h) + F.when((half == "오후") & (number(h) < 12), 12).otherwise(0)
    return F.coalesce(first, F.when(y != "", moment(number(y), number(mo), number(d), hour, number(mi), s.try_cast("double"), zone)))


#: Parsers in the order in which they are tried; put one in front to add a format.
PARSERS: list[DateParser] = [w3c, rfc822, iso8601, asctime, perforce, hungarian, greek, korean]


def parse_feed_date(text: Column, parsers: list[DateParser] | None = None) -> Column:
    """UTC timestamp of the first format that fits, else null. The session's time zone must be UTC.

    The parsers run as the function of a one-element array: all of them together
    are far more code than one generated method may hold, and as a function they
    are not generated at all.
    """
    def first(plain: Column) -> Column:
        return F.coalesce(*[p(plain) for p in (PARSERS if parsers is None else parsers)])

    return F.get(F.transform(F.array(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), first), F.lit(0))
