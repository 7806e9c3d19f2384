"""Telephone numbers to E.164 by a table of numbering plans.

The plans cover the countries below; other countries' numbers give null, also with a country code. Extend PLANS to cover more.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from braidwork.functions.text import let, trim_ws

#: region -> (calling code, national trunk prefix, valid national numbers)
PLANS = {
    "IN": ("91", "0", "[6-9][0-9]{9}"),
    "US": ("1", "1", "[2-9][0-8][0-9][2-9][0-9]{6}"),
    "CA": ("1", "1", "[2-9][0-8][0-9][2-9][0-9]{6}"),
    "GB": ("44", "0", "1[0-9]{8,9}|2[0-9]{9}|3[0-9]{9}|7[1-9][0-9]{8}|8[0-9]{9}"),
    "FR": ("33", "0", "[1-9][0-9]{8}"),
    "JP": ("81", "0", "[1-9][0-9]{8,9}"),
    "CN": ("86", "0", "1[3-9][0-9]{9}|[2-9][0-9]{8,10}"),
}


def _abroad(digits: Column) -> Column:
    plans = "|".join(f"{code}(?:{national})" for code, _, national in dict.fromkeys(PLANS.values()))
    return F.when(digits.rlike(f"^(?:{plans})$"), F.concat(F.lit("+"), digits))


def _at_home(digits: Column, region: str) -> Column:
    code, trunk, national = PLANS[region]
    own = F.regexp_extract(digits, f"^{trunk}?({national})$", 1)
    return F.when(own != "", F.concat(F.lit(f"+{code}"), own)).when(digits.rlike(f"^{code}(?:{national})$"), F.concat(F.lit("+"), digits))


def normalize_phone(raw: Column, region: str = "IN") -> Column:
    """E.164 or null. The number's form decides which regions are tried, in order; the first with a valid number wins."""
    return let(trim_ws(raw), lambda s: let(F.regexp_replace(s, "[^0-9]", ""), lambda digits: _normalized(s, digits, region)))


def _normalized(s: Column, digits: Column, region: str) -> Column:
    clean = s.rlike(r"^[+(]?[0-9][0-9\s().\-/]*$") | s.rlike(r"^\+?\(?[0-9]")
    first = lambda *regions: F.coalesce(*[_at_home(digits, r) for r in dict.fromkeys(regions) if r in PLANS], F.lit(None).cast("string"))
    n = F.length(digits)
    return F.when(clean & (n <= 15), (
        F.when(s.startswith("+"), _abroad(digits))
        .when(s.startswith("00"), _abroad(F.substring(digits, 3, 20)))
        .when(s.rlike(r"^\([0-9]{3}\)\s*[0-9]{3}[-.\s]?[0-9]{4}$") | s.rlike(r"^[0-9]{3}[-.\s][0-9]{3}[-.\s][0-9]{4}$"), first("US", "CA", region))
        .when(s.startswith("0") & (n >= 10), first("GB", region))
        .when(digits.startswith("44") & (n >= 11), first("GB", region))
        .when(digits.startswith("91") & (n >= 12), first("IN", region))
        .otherwise(first(region, "US", "GB"))
    ))


def equivalent(a: Column, b: Column, region: str = "IN") -> Column:
    return F.coalesce(normalize_phone(a, region) == normalize_phone(b, region), F.lit(False))


def country_code(e164: Column) -> Column:
    out = F.substring(e164, 1, 3)
    for code, _, _ in sorted(dict.fromkeys(PLANS.values()), key=lambda p: len(p[0])):
        out = F.when(e164.startswith(f"+{code}"), F.lit(f"+{code}")).otherwise(out)
    return out
