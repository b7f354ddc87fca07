"""Column functions on text: folding, labels, clipping, places. All native."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that recognised text confuses, and the letter each stands for.
CONFUSED = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "|": "i", "!": "i", "l": "i", "$": "s", "@": "a", "€": "e"}
#: Names of days and months.
DAYS = ("lunedì", "martedì", "mercoledì", "giovedì", "venerdì", "sabato", "domenica")
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")


def _accents() -> tuple[str, str]:
    """Small letters that decompose into one letter and marks, and those letters."""
    pairs = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, range(0xC0, 0x250))]
    pairs = [(c, d[0]) for c, d in pairs if c == c.lower() and len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, PLAIN = _accents()


def plain_fold(text: Column) -> Column:
    """Small letters and accents off; ß stays a letter of its own."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{Mn}+", "")


def fold(text: Column) -> Column:
    """Case folded and accents off."""
    return F.regexp_replace(F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN), r"\p{Mn}+", "")


def ocr_fold(text: Column) -> Column:
    """Small letters and digits alone, accents off, confusable signs as one letter."""
    plain = F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{Mn}+", "")
    return F.regexp_replace(F.translate(plain, "".join(CONFUSED), "".join(CONFUSED.values())), r"[^\p{L}\p{N}]+", "")


def head_of(text: Column, most: int | None) -> Column:
    """The first `most` characters, all of them for None."""
    return text if most is None else F.substring(text, 1, most)


def collapse_ws(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_ws(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clip_words(text: Column, limit: int, least: int = 20) -> Column:
    """Collapsed text of at most `limit` characters, cut at its last blank if that stands at `least` or later."""
    flat = collapse_ws(text)
    head = F.substring(flat, 1, limit)
    at = F.char_length(head) - F.char_length(F.substring_index(head, " ", -1)) - 1
    return F.when(F.char_length(flat) <= limit, flat).when(at >= least, F.substring(head, F.lit(1), at)).otherwise(head)


def size_label(size: Column) -> Column:
    """Bytes, KB (one decimal), MB or GB (two), with a decimal comma."""
    n = F.greatest(F.coalesce(size, F.lit(0)).cast("long"), F.lit(0).cast("long"))
    label = (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" byte")))
        .when(n < 1 << 20, F.format_string("%.1f KB", F.bround(n / float(1 << 10), 1)))
        .when(n < 1 << 30, F.format_string("%.2f MB", F.bround(n / float(1 << 20), 2)))
        .otherwise(F.format_string("%.2f GB", F.bround(n / float(1 << 30), 2)))
    )
    return F.replace(label, F.lit("."), F.lit(","))


def date_label(when: Column) -> Column:
    return F.date_format(when, "dd/MM/yyyy HH:mm")


def long_date(when: Column, days: tuple[str, ...] = DAYS, months: tuple[str, ...] = MONTHS) -> Column:
    """Week day, day, month, year and time, with given names."""
    day = F.element_at(F.array(*map(F.lit, days)), F.weekday(when) + 1)
    month = F.element_at(F.array(*map(F.lit, months)), F.month(when))
    return F.concat(day, F.lit(" "), F.day(when), F.lit(" "), month, F.lit(" "), F.year(when), F.lit(", ore "), F.date_format(when, "HH:mm"))


def extension(name: Column) -> Column:
    """Lower-cased extension without its dot; empty if the name has none."""
    base = F.regexp_extract(name, r"[^/\\]*$", 0)
    return F.lower(F.regexp_extract(base, r"(?<=[^.])\.([^.]*)$", 1))


def nth_position(text: Column, needle: Column, n: int) -> Column:
    """0-based place of the n-th occurrence (they may overlap), -1 if there are fewer."""
    at = F.lit(0)
    for _ in range(n):
        at = F.when(at >= 0, F.call_function("locate", needle, text, at + 1)).otherwise(F.lit(-1))
        at = F.when(at > 0, at).otherwise(F.lit(-1))
    return F.when(at > 0, at - 1).otherwise(F.lit(-1))


def contains_all(text: Column, terms: list[str]) -> Column:
    """All terms occur, case aside; nothing matches no terms."""
    low = F.lower(text)
    return reduce(lambda a, b: a & b, [low.contains(t.lower()) for t in terms]) if terms else F.lit(False)


def parse_clock(raw: Column) -> Column:
    """Seconds of `SS`, `MM:SS` or `H:MM:SS` with a comma or dot before decimals; null if blank or wrong (`clock_error` tells which)."""
    text = F.replace(F.trim(F.regexp_replace(raw, "[\\u200e\\u200f]", "")), F.lit(","), F.lit("."))
    parts = F.split(text, ":")
    weight = F.size(parts)
    good = text.rlike(r"^(?:(?:\d+:)?\d+:)?\d+(?:\.\d+)?$")
    last = F.element_at(parts, -1).try_cast("double")
    minutes = F.when(weight >= 2, F.get(parts, weight - 2).try_cast("double")).otherwise(0.0)
    hours = F.when(weight == 3, F.get(parts, F.lit(0)).try_cast("double")).otherwise(0.0)
    return F.when(good, hours * 3600 + minutes * 60 + last)


def clock_error(raw: Column) -> Column:
    """True for a text that is neither blank nor a clock."""
    return F.coalesce(F.trim(F.regexp_replace(raw, "[\\u200e\\u200f]", "")) != "", F.lit(False)) & parse_clock(raw).isNull()


def format_clock(seconds: Column, style: str = "MM:SS") -> Column:
    """Styles: MM:SS (minutes may exceed 59), H:MM:SS, HH:MM:SS, words."""
    whole = F.greatest(F.rint(seconds).cast("long") if style in ("HH:MM:SS", "words") else F.floor(seconds), F.lit(0).cast("long"))
    h, m, s = F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60))
    if style == "MM:SS":
        return F.format_string("%02d:%02d", F.floor(whole / 60), s)
    if style == "H:MM:SS":
        return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))
    if style == "HH:MM:SS":
        return F.format_string("%02d:%02d:%02d", h, m, s)
    return F.when(h > 0, F.format_string("%d h %02d min %02d s", h, m, s)).when(m > 0, F.format_string("%d min %02d s", m, s)).otherwise(F.format_string("%d s", s))
