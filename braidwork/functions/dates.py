"""Dates as YYYY-MM strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from braidwork.functions.text import PRESENT, let, safe_lower

# Month names and their short forms.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT = {"sept": "09"} | {m[:3]: f"{i:02}" for i, m in enumerate(MONTHS, 1)} | {m: f"{i:02}" for i, m in enumerate(MONTHS, 1)}


def _month(word: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(SHORT.items()) for x in kv]), word)


def normalize_date(raw: Column) -> Column:
    """YYYY-MM, or null for what is no date or an open end. The first form that fits decides; a lone year means January."""
    return F.when(raw.isNotNull(), let(safe_lower(raw), _normalized))


def _normalized(c: Column) -> Column:
    part = lambda pattern, k: F.regexp_extract(c, pattern, k)
    named, back = r"(?U)^([a-z]+)\s+(\d{4})$", r"(?U)^(\d{4})\s+([a-z]+)$"
    month_year, year_month = r"^(\d{1,2})[/\-](\d{4})$", r"^(\d{4})[/\.\-](\d{1,2})$"
    year = F.regexp_extract(c, r"(?U)\b(\d{4})\b", 1)
    return (
        F.when(c.isin(*PRESENT), None)
        .when(c.rlike(r"^\d{4}-\d{2}$"), c)
        .when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01")))
        .when(c.rlike(named) & _month(part(named, 1)).isNotNull(), F.concat(part(named, 2), F.lit("-"), _month(part(named, 1))))
        .when(c.rlike(back) & _month(part(back, 2)).isNotNull(), F.concat(part(back, 1), F.lit("-"), _month(part(back, 2))))
        .when(c.rlike(month_year), F.concat(part(month_year, 2), F.lit("-"), F.lpad(part(month_year, 1), 2, "0")))
        .when(c.rlike(year_month), F.concat(part(year_month, 1), F.lit("-"), F.lpad(part(year_month, 2), 2, "0")))
        .when(year != "", F.concat(year, F.lit("-01")))
    )


def normalize_year(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, r"(?U)\b(\d{4})\b", 1), F.lit(""))


def valid_range(start: Column, end: Column) -> Column:
    return F.coalesce(start <= end, F.lit(True))
