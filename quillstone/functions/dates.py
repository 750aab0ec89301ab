"""Day-first dates. Every rule that needs today's date takes it as `as_of`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import MONTHS


def parse_date(text: Column, as_of: Column) -> Column:
    """A date in one of three renderings between 1900 and as_of, else null; impossible dates are null."""
    t = F.regexp_replace(F.trim(text), r"[.,]+$", "")
    dmy = F.when(t.rlike(r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4}$"), F.try_to_date(F.regexp_replace(t, r"[.\-]", "/"), "d/M/yyyy"))
    iso = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(t, "yyyy-M-d"))
    named = F.regexp_extract(t, r"^(\d{1,2})\s+([A-Za-z]{3,9})\.?\s+(\d{4})$", 2)
    names = F.create_map(*[x for i, m in enumerate(MONTHS) for n in dict.fromkeys((m.lower(), m[:3].lower())) for x in (F.lit(n), F.lit(i + 1))])
    month = F.try_element_at(names, F.lower(named))
    joined = F.concat_ws("/", F.regexp_extract(t, r"^(\d{1,2})\s", 1), month.cast("string"), F.regexp_extract(t, r"(\d{4})$", 1))
    words = F.when((named != "") & month.isNotNull(), F.try_to_date(joined, "d/M/yyyy"))
    d = F.coalesce(dmy, iso, words)
    return F.when((d >= F.lit("1900-01-01").cast("date")) & (d <= as_of), d)


def birth_dates(dates: Column, as_of: Column) -> Column:
    """Those at least two years before as_of."""
    return F.filter(dates, lambda d: d.isNotNull() & (d <= F.add_months(as_of, -24)))


def day_first(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


def iso_to_day_first(text: Column) -> Column:
    return F.regexp_replace(text, r"^(\d{4})-(\d{2})-(\d{2})$", "$3/$2/$1")


def day_first_to_iso(text: Column) -> Column:
    """For a date control: four-digit years only, impossible dates null."""
    return F.when(F.trim(text).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.date_format(F.try_to_date(F.trim(text), "d/M/yyyy"), "yyyy-MM-dd"))


def needs_recheck(kind: Column, text: Column) -> Column:
    """Dates whose day may be a month."""
    day = F.try_to_number(F.nullif(F.regexp_extract(text, r"^(\d{1,2})/\d{1,2}/\d{4}$", 1), F.lit("")), F.lit("99"))
    return F.coalesce((kind == "date") & (day <= 12), F.lit(False))


def short_year(description: Column, text: Column) -> Column:
    """The century goes only where the description wants two digits."""
    wants = F.coalesce(description, F.lit("")).rlike(r"(?i)DD/MM/YY(?!Y)")
    return F.when(wants, F.regexp_replace(text, r"^\s*(\d{2}/\d{2}/)\d{2}(\d{2})\s*$", "$1$2")).otherwise(text)


def renderings(d: Column) -> Column:
    """Common ways to write a date of birth, the longest first."""
    forms = ("dd/MM/yyyy", "d/M/yyyy", "dd/MM/yy", "dd-MM-yyyy", "d-M-yyyy", "dd.MM.yyyy", "d.M.yyyy", "yyyy-MM-dd", "d MMM yyyy", "dd MMM yyyy", "d MMMM yyyy", "dd MMMM yyyy")
    found = F.array_distinct(F.array(*[F.date_format(d, f) for f in forms]))
    return F.array_sort(found, lambda a, b: F.length(b) - F.length(a))


def readable(text: Column) -> Column:
    """14/03/2026 as "14 March 2026", with the rival reading where there is one."""
    d = F.try_to_date(text, "d/M/yyyy")
    rival = F.try_to_date(text, "M/d/yyyy")
    one = F.date_format(d, "d MMMM yyyy")
    return F.when(rival.isNotNull() & (rival != d), F.concat(one, F.lit(" (or "), F.date_format(rival, "d MMMM yyyy"), F.lit(")"))).otherwise(one)
