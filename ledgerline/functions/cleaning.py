"""Value cleaning of uploaded text: money, dates, names.

All column expressions (codegen'd, no Python UDF).  Spark 4 runs with ANSI
on, so every parse is a ``try_*`` that yields NULL instead of failing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# All Unicode white space and separators (a class that Java and RE2 read alike).
SPACE = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
         r"\x{3000}]")

# Text the host language's float() accepts as a finite number (digits may be
# grouped by single underscores; surrounding whitespace allowed).
FLOAT_TEXT = (rf"^{SPACE}*" r"[+-]?(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)"
              r"(?:[eE][+-]?\d(?:_?\d)*)?" rf"{SPACE}*$")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def clean_numeric(c: Column) -> Column:
    """Money text -> DOUBLE.  Missing/empty -> 0; strip, drop every ``$`` and
    ``,``; ``(x)`` -> ``-x``; parse; anything unparseable or non-finite -> 0."""
    s = F.translate(strip(c), "$,", "")
    paren = s.startswith("(") & s.endswith(")")
    s = F.when(paren, F.concat(F.lit("-"), s.substr(F.lit(2), F.length(s) - 2))).otherwise(s)
    v = F.when(s.rlike(FLOAT_TEXT), F.regexp_replace(strip(s), "_", "").try_cast("double"))
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(finite, v).otherwise(F.lit(0.0))


# (Spark pattern, host-language format, shape guard) in the order they are
# tried.  The guard is a cheap regex that only lets plausible text reach the
# parser (a failed parse costs an exception inside the JVM) and pins the digit
# counts the host-language formats accept (4-digit %Y, 1-2 digit fields).
DATE_PATTERNS = [
    ("yyyy-M-d", "%Y-%m-%d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy-M-d H:m:s", "%Y-%m-%d %H:%M:%S", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("M/d/yyyy", "%m/%d/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy H:m", "%m/%d/%Y %H:%M", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$"),
    ("M/d/yy", "%m/%d/%y", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("d-M-yyyy", "%d-%m-%Y", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d/M/yyyy", "%d/%m/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$"),
]
# Free-form fallback: a declared list of further spellings.
FALLBACK_PATTERNS = [
    ("yyyy-M-d'T'H:m:s", "%Y-%m-%dT%H:%M:%S", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyyMMdd", "%Y%m%d", r"^\d{8}$"),
    ("yyyy/M/d", "%Y/%m/%d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("MMM d, yyyy", "%b %d, %Y", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("MMMM d, yyyy", "%B %d, %Y", r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$"),
    ("d MMM yyyy", "%d %b %Y", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("d-MMM-yyyy", "%d-%b-%Y", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
    ("MMM d yyyy", "%b %d %Y", r"^[A-Za-z]{3} \d{1,2} \d{4}$"),
    ("MMMM d yyyy", "%B %d %Y", r"^[A-Za-z]{3,9} \d{1,2} \d{4}$"),
    ("d MMMM yyyy", "%d %B %Y", r"^\d{1,2} [A-Za-z]{3,9} \d{4}$"),
]
# A time of day after a date: optional seconds, fraction, AM/PM and zone.  The
# day is the one written, whatever the zone.
TIME_TEXT = (r"[T ](?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d(?:\.\d{1,9})?)?(?: ?[AaPp][Mm])?"
             r"(?: ?(?:[Zz]|UTC|GMT|[+-]\d{2}:?\d{2}))?")
# Dates that may stand before one.
TIMED_PATTERNS = [
    ("yyyy-M-d", "%Y-%m-%d", r"\d{4}-\d{1,2}-\d{1,2}"),
    ("yyyy/M/d", "%Y/%m/%d", r"\d{4}/\d{1,2}/\d{1,2}"),
    ("M/d/yyyy", "%m/%d/%Y", r"\d{1,2}/\d{1,2}/\d{4}"),
    ("d/M/yyyy", "%d/%m/%Y", r"\d{1,2}/\d{1,2}/\d{4}"),
]


# --- free-form dates: words and numbers in any usual order -----------------------------------------------------
MONTH_PREFIXES = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_NAME = (r"^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?"
              r"|nov(ember)?|dec(ember)?)$")
WEEKDAY = r"\b(mon|monday|tue|tuesday|wed|wednesday|thu|thursday|fri|friday|sat|saturday|sun|sunday)\b[.,]?"
CLOCK = (r"(?:(?:0?\d|1[0-2])(?::[0-5]\d(?::[0-5]\d(?:\.\d{1,9})?)?)? ?[ap]m"
         r"|(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{1,9})?)?)"
         r"(?: ?(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?")
# What the words of a date may be: M a month's name, 4 a number of four digits,
# 2 one of one or two; and the order in which year, month and day stand then.
# Without a day it is the first of the month, without a month the first of the year.
WORD_ORDERS = {"M24": "mdy", "2M4": "dmy", "4M2": "ymd", "42M": "ydm", "24M": "dym", "M42": "myd", "M22": "mdy", "2M2": "dmy",
               "422": "ymd", "224": "mdy", "M4": "my", "4M": "ym", "42": "ym", "24": "my", "4": "y"}


def free_date(s: Column) -> Column:
    """A date in words and numbers -> DATE, else NULL.

    Lower and upper case are alike; weekdays, ordinal endings, ``of``, ``on``,
    ``at``, a time of day at the end (the day is the one written, whatever the
    zone) and any of ``. , ; / ' -`` and spaces between the parts are passed over.
    The parts must then make one of WORD_ORDERS; a text without a year has no date.  Of two numbers before a year
    the first is the month, unless it is above 12.  Years of two digits need a
    month's name; 69 to 99 are of the last century.  A quarter (``2025Q2``,
    ``2Q2025``) is its first day.
    """
    text = F.lower(s)
    text = F.regexp_replace(text, rf"(?:\s+at\s+|(?<=[^a-z])t|[,\s]+){CLOCK}$", "")
    text = F.regexp_replace(text, WEEKDAY, " ")
    text = F.regexp_replace(text, r"(\d)(?:st|nd|rd|th)\b", "$1")
    text = F.regexp_replace(text, r"\b(?:of|on)\b", " ")
    return _let(text, lambda t: F.coalesce(_quarter(t), _let(
        F.regexp_extract_all(t, F.lit(r"([a-z]+|\d+)"), F.lit(1)), lambda words: _ordered(t, words))))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is named."""
    return F.transform(F.array(value), then)[0]


def _quarter(text: Column) -> Column:
    first, last = r"^(\d{4})-?q([1-4])$", r"^([1-4])q-?(\d{4})$"
    day = (F.when(text.rlike(first), F.regexp_replace(text, first, "$1 $2"))
           .when(text.rlike(last), F.regexp_replace(text, last, "$2 $1")))
    return _let(F.split(day, " "), lambda p: _day(p[0].try_cast("int"), p[1].try_cast("int") * 3 - 2, F.lit(1)))


def _ordered(text: Column, words: Column) -> Column:
    """The date that ``words`` make, all the words of ``text``."""
    shape = F.array_join(F.transform(words, lambda w: F.when(w.rlike(MONTH_NAME), "M").when(w.rlike(r"^\d{4}$"), "4")
                                     .when(w.rlike(r"^\d{1,2}$"), "2").otherwise("?")), "")
    shape = F.when(text.rlike(r"^\s*[a-z0-9][a-z0-9\s.,;/'-]{0,63}$") & ~text.rlike(r"[-/]\s*$|^\s*\d{1,2}\.\d{4}\s*$"), shape)
    numbers = F.transform(words, lambda w: F.when(
        w.rlike(MONTH_NAME), F.floor(F.position(w.substr(1, 3), F.lit(MONTH_PREFIXES)) / 3) + 1).otherwise(w.try_cast("int")).cast("int"))
    orders = F.create_map(*[F.lit(x) for pair in WORD_ORDERS.items() for x in pair])

    def at(p: Column, which: str) -> Column:
        place = F.instr(p["order"], which)
        return F.when(place > 0, F.get(p["n"], place - 1)).when(p["order"].isNotNull() & F.lit(which != "y"), 1)

    def day(p: Column) -> Column:
        y, m, d = p["y"], p["m"], p["d"]
        swap = (p["shape"] == "224") & (m > 12)
        century = F.when(p["shape"].isin("M22", "2M2"), F.when(y >= 69, 1900).otherwise(2000)).otherwise(0)
        return _day(y + century, F.when(swap, d).otherwise(m), F.when(swap, m).otherwise(d))

    return _let(F.struct(shape.alias("shape"), F.try_element_at(orders, shape).alias("order"), numbers.alias("n")), lambda p: _let(
        F.struct(p["shape"].alias("shape"), *[at(p, c).alias(c) for c in "ymd"]), day))


def _day(y: Column, m: Column, d: Column) -> Column:
    """The day, null where there is none such."""
    def text(n: Column, width: int) -> Column:
        return F.lpad(n.cast("string"), width, "0")

    return F.when(y.between(1678, 2261) & m.between(1, 12) & d.between(1, 31),
                  F.concat_ws("-", text(y, 4), text(m, 2), text(d, 2)).try_cast("date"))


def parse_date(c: Column) -> Column:
    """Date text -> DATE: the listed formats in order (US order wins on
    ambiguous slashes), then the fallback spellings, then ``free_date``, else NULL."""
    s = strip(c)
    tries = []
    for pattern, _, guard in DATE_PATTERNS + FALLBACK_PATTERNS:
        d = F.when(s.rlike(guard), F.to_date(F.try_to_timestamp(s, F.lit(pattern))))
        if pattern == "M/d/yy":  # two-digit years 69..99 are 1969..1999
            d = F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
        tries.append(d)
    for pattern, _, date in TIMED_PATTERNS:
        guard = rf"^({date}){TIME_TEXT}$"
        tries.append(F.when(s.rlike(guard), F.to_date(
            F.try_to_timestamp(F.regexp_extract(s, guard, 1), F.lit(pattern)))))
    return F.coalesce(*tries, F.when(s.rlike(r"\d"), free_date(s)))


def clean_text(c: Column) -> Column:
    """Strip surrounding whitespace; NULL stays NULL."""
    return strip(c)


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def bi_number(c: Column) -> Column:
    """BI cleaning script: keep only digits, ``.`` and ``-``, then read a number
    (so ``(500.00)`` reads as +500); unreadable -> NULL."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def bi_date(c: Column) -> Column:
    """Type text as a date the way a US-culture BI load does: ISO, then M/d/yyyy."""
    s = strip(c.cast("string"))
    iso, us = DATE_PATTERNS[0], DATE_PATTERNS[2]
    return F.coalesce(*[F.when(s.rlike(g), F.to_date(F.try_to_timestamp(s, F.lit(p)))) for p, _, g in (iso, us)])
