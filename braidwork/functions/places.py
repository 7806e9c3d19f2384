"""Countries and locations. Names and codes come from the JVM's ISO 3166 tables, so none is listed here."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from braidwork.functions.text import let, split_list, trim_ws

# Other names in use.
ALIASES = {
    "usa": "US", "united states": "US", "united states of america": "US", "us": "US",
    "uk": "GB", "britain": "GB", "great britain": "GB", "england": "GB", "united kingdom": "GB",
    "south korea": "KR", "korea": "KR", "russia": "RU", "taiwan": "TW", "vietnam": "VN", "viet nam": "VN",
    "iran": "IR", "syria": "SY", "uae": "AE", "emirates": "AE", "united arab emirates": "AE",
    "中国": "CN", "china": "CN", "日本": "JP", "japan": "JP", "法国": "FR", "france": "FR",
}


@functools.lru_cache(maxsize=1)
def _countries(_app: str) -> str:
    spark = SparkSession.getActiveSession()
    locale = spark._jvm.java.util.Locale
    found = {}
    for code in locale.getISOCountries():
        here = locale("", code)
        found[here.getDisplayCountry(locale.ENGLISH).lower()] = code
        found[here.getISO3Country().lower()] = code
        found[code.lower()] = code
    return json.dumps(found | ALIASES, ensure_ascii=False)


def normalize_country(raw: Column) -> Column:
    """Two-letter code of a name or code, or null."""
    known = F.from_json(F.lit(_countries(SparkSession.getActiveSession().sparkContext.applicationId)), "map<string,string>")
    return F.element_at(known, F.lower(trim_ws(raw)))


def parse_location(raw: Column) -> Column:
    """struct<city, region, country> of up to three comma-separated parts; more are ignored."""
    return let(F.filter(F.transform(F.split(raw, ","), trim_ws), lambda x: x != ""), _placed)


def _placed(parts: Column) -> Column:
    n, at = F.size(parts), lambda i: F.get(parts, F.lit(i))
    none = F.lit(None).cast("string")

    def of(code):
        city = F.when((n > 1) | code.isNull(), at(0)).otherwise(none)
        region = F.when(n > 2, at(1)).when((n == 2) & code.isNull(), at(1)).otherwise(none)
        return F.struct(city.alias("city"), region.alias("region"), code.alias("country"))

    return let(normalize_country(F.when(n == 1, at(0)).when(n == 2, at(1)).when(n > 2, at(2))), of)


__all__ = ["ALIASES", "normalize_country", "parse_location", "split_list"]
