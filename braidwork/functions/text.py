"""Text scalars as columns. White space is Unicode's, as (?U) has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms dropped from company names, and words for an open end.
LEGAL_FORMS = ("inc", "ltd", "llc", "pvt", "corp", "co", "limited", "private")
PRESENT = ("present", "current", "now", "ongoing", "till date", "today", "todate", "-", "")


def let(value: Column, use) -> Column:
    """use(value), value being computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def safe_lower(c: Column) -> Column:
    return F.coalesce(F.lower(trim_ws(c)), F.lit(""))


def person_name(c: Column) -> Column:
    return trim_ws(squeeze(c))


def name_key(c: Column) -> Column:
    return F.lower(person_name(c))


def company_key(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"(?U)\b(?:{'|'.join(LEGAL_FORMS)})\b\.?", "")
    return person_name(bare)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trim_ws(c)), r"(?U)[^\w\s-]", ""), r"(?U)[\s_-]+", "-")


def distinct_in_order(c: Column) -> Column:
    return F.array_distinct(c)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def title_case(c: Column) -> Column:
    """A capital after every character that is not a letter: node.js becomes Node.Js."""
    parts = F.split(c, r"(?U)(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def split_list(c: Column) -> Column:
    """Parts between ; and ,, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "[;,]"), trim_ws), lambda x: x != "")


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")
