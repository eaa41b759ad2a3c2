"""Dates in text: windows, checks, ages. Clocks are parameters, never read here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, group, has, let, s, trim, without

MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: What every date phrase has: a word before the date, and a year.
DATED = r"(?is)\b(?:between|from|on|as of|at|by|before|after|in|during|for)\s.*\d{4}\b"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd, null for days that do not exist."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text) if hasattr(F, "try_to_date") else F.when(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), text)


def date_window(x: Column) -> Column:
    """struct(kind, label, start, end) of the first kind of date phrase that fits; null where none does."""
    return let({"t": collapse(x)}, lambda r: F.when(has(r["t"], DATED), _date_window(r["t"])))


def _date_window(t: Column) -> Column:
    def got(p: str, g: int = 1) -> Column:
        return F.nullif(group(t, "(?i)" + p, g), F.lit(""))

    def year(p: str, g: int = 1) -> Column:
        n = got(p, g).cast("int")
        return F.when(n.between(1, 9999), n)

    def four(n: Column) -> Column:
        return n.cast("string")

    def out(kind: str, label: Column, start: Column, end: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), start.alias("start"), end.alias("end"))

    month = lambda m: F.array_position(F.array(*[F.lit(v) for v in MONTHS]), F.lower(F.substring(m, 1, 3)))
    span = r"\b(?:between|from)\s+(\d{4})\s+(?:and|to|through|-)\s+(\d{4})\b"
    dmy = rf"\b(?:on|as of|at|by)\s+(\d{{1,2}})(?:st|nd|rd|th)?\s+{MONTH}\s*,?\s*(\d{{4}})\b"
    mdy = rf"\b(?:on|as of|at|by)\s+{MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s*(\d{{4}})\b"
    parts = {"a": year(span, 1), "b": year(span, 2)}
    parts["exact"] = F.coalesce(iso_date(got(dmy, 3), month(got(dmy, 2)), got(dmy, 1)), iso_date(got(mdy, 3), month(got(mdy, 1)), got(mdy, 2)))
    parts |= {k: year(rf"\b(?:{w})\s+(\d{{4}})\b") for k, w in (("as_of", "as of|by"), ("before", "before"), ("after", "after"), ("during", "in|during|for"))}
    day = lambda n, tail: F.concat(F.lpad(four(n), 4, "0"), F.lit(tail))

    def choose(r: Column) -> Column:
        lo, hi = F.least(r["a"], r["b"]), F.greatest(r["a"], r["b"])
        exact, as_of, before, after, during = (r[k] for k in ("exact", "as_of", "before", "after", "during"))
        return (
            F.when(r["a"].isNotNull() & r["b"].isNotNull(), out("range", F.concat(four(lo), F.lit("-"), four(hi)), day(lo, "-01-01"), day(hi, "-12-31")))
            .when(exact.isNotNull(), out("exact", date_label(exact), exact, exact))
            .when(as_of.isNotNull(), out("as_of_year", four(as_of), day(as_of, "-12-31"), day(as_of, "-12-31")))
            .when(before.isNotNull(), out("before", F.concat(F.lit("before "), four(before)), F.lit("0001-01-01"), day(before - 1, "-12-31")))
            .when(after.isNotNull(), out("after", F.concat(F.lit("after "), four(after)), day(after + 1, "-01-01"), F.lit("9999-12-31")))
            .when(during.isNotNull(), out("year", four(during), day(during, "-01-01"), day(during, "-12-31")))
        )

    return let(parts, choose)


def date_label(iso: Column) -> Column:
    """yyyy-MM-dd as d Mon yyyy."""
    names = F.array(*[F.lit(m.title()) for m in MONTHS])
    return F.concat_ws(" ", F.substring(iso, 9, 2).cast("int").cast("string"), F.try_element_at(names, F.substring(iso, 6, 2).cast("int")), F.substring(iso, 1, 4))


def strip_dates(x: Column) -> Column:
    t = s(x)
    for p in (
        r"\b(?:between|from)\s+\d{4}\s+(?:and|to|through|-)\s+\d{4}\b",
        rf"\b(?:on|as of|at|by)\s+\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH}\s*,?\s*\d{{4}}\b",
        rf"\b(?:on|as of|at|by)\s+{MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?\s*,?\s*\d{{4}}\b",
        r"\b(?:in|during|for|as of|by|before|after)\s+\d{4}\b",
    ):
        t = without(t, "(?i)" + p, " ")
    return t


def compact(x: Column) -> Column:
    """yyyy-MM-dd as the number yyyymmdd, else 0."""
    t = s(x)
    return F.when(has(t, r"^\d{4}-\d{2}-\d{2}$"), F.replace(t, F.lit("-"), F.lit("")).cast("int")).otherwise(F.lit(0))


def gdelt_date(x: Column) -> Column:
    t = trim(x)
    return F.when(has(t, r"^\d{14}$"), without(t, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")).otherwise(t)


def age_days(at: Column, as_of: Column) -> Column:
    """Days from a time to ``as_of``: 0 for the future, 30 for an unknown time."""
    us = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.coalesce(F.greatest(F.lit(0.0), us / F.lit(86_400_000_000.0)), F.lit(30.0))


def overlaps(start: Column, end: Column, window_start: Column, window_end: Column) -> Column:
    """Inclusive overlap of day numbers; an open start is the first day, an open end the last."""
    a = F.when(F.coalesce(start, F.lit(0)) == 0, F.lit(1)).otherwise(start)
    b = F.when(F.coalesce(end, F.lit(0)) == 0, F.lit(99991231)).otherwise(end)
    return (a <= window_end) & (b >= window_start)
