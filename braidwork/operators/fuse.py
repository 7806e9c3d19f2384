"""Survivorship over a cluster's records, as column expressions on one array of records sorted by rec_id.

One shuffle on cluster_id gathers the records; all that follows stays within the row. Priority order is: higher source priority
first, then record order, then position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.config import EngineConfig
from braidwork.functions.text import company_key, let, safe_lower, trim_ws

#: What a source's extractor says of its own fields.
RESUME_METHOD = {"full_name": "heuristic", "headline": "heuristic"}


def _map(pairs: dict, default) -> callable:
    def look(source: Column) -> Column:
        out = F.lit(default)
        for k, v in pairs.items():
            out = F.when(source == k, F.lit(v)).otherwise(out)
        return out

    return look


def priority(cfg: EngineConfig):
    return _map(cfg.source_priority, 0)


def base_weight(cfg: EngineConfig, default: float = 0.7):
    return _map({k: float(v) for k, v in cfg.confidence_weights.items()}, default)


def gathered(records: DataFrame, clusters: DataFrame, columns: list[str]) -> DataFrame:
    """(cluster_id, recs): recs is sorted by rec_id."""
    df = records.select("rec_id", *columns).join(clusters, "rec_id")
    return df.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rec_id", *columns))).alias("recs"))


def in_priority(values: Column, cfg: EngineConfig) -> Column:
    """Structs with a source, sorted by priority; stable."""
    rank = priority(cfg)
    keyed = F.transform(values, lambda x, i: F.struct((-rank(x["source"])).alias("p"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def scalar_values(recs: str, field: str, slots: tuple[tuple[str, str | None], ...] | None = None) -> Column:
    """array<struct<value, source, method>> of a field's non-blank values in record order; slots: (field, fixed method)."""
    def of(x, name, method):
        own = F.lit(method) if method else F.when(x["source"] == "resume", F.lit(RESUME_METHOD.get(name, "regex"))).otherwise(F.lit("direct"))
        return F.struct(x[name].alias("value"), x["source"].alias("source"), own.alias("method"))

    parts = F.flatten(F.transform(recs, lambda x: F.array(*[of(x, n, m) for n, m in (slots or ((field, None),))])))
    return F.filter(parts, lambda v: v["value"].isNotNull() & (v["value"] != ""))


def scalar(values: str, cfg: EngineConfig) -> Column:
    """struct<winner, agree, first_other, ordered>: one value or values equal but for case: the first; else the first by priority."""
    v = F.col(values)
    agree = F.size(F.array_distinct(F.transform(v, lambda x: safe_lower(x["value"])))) <= 1
    ordered = in_priority(v, cfg)
    return F.struct(F.when(agree, F.get(v, F.lit(0))).otherwise(F.get(ordered, F.lit(0))).alias("winner"), agree.alias("agree"), F.when(~agree, F.get(ordered, F.lit(1))["value"]).alias("first_other"), ordered.alias("ordered"))


def list_values(recs: str, field: str) -> Column:
    """array<struct<value, source>> of an array field in record order."""
    return F.flatten(F.transform(recs, lambda x: F.transform(x[field], lambda v: F.struct(v.alias("value"), x["source"].alias("source")))))


def union(values: str, cfg: EngineConfig) -> Column:
    """Distinct values, trimmed and in lower case, in priority order."""
    return F.filter(F.array_distinct(F.transform(in_priority(F.col(values), cfg), lambda x: F.lower(trim_ws(x["value"])))), lambda x: x != "")


def sources_of(values: Column) -> Column:
    return F.array_distinct(F.transform(values, lambda x: x["source"]))


def skills(values: str, cfg: EngineConfig) -> Column:
    """array<struct<name, confidence, sources>> in record order: the first spelling, the highest base weight, all sources."""
    v, weight = F.col(values), base_weight(cfg)
    names = F.array_distinct(F.transform(v, lambda x: F.lower(x["value"])))

    def one(key):
        own = F.filter(v, lambda x: F.lower(x["value"]) == key)
        return F.struct(F.get(own, F.lit(0))["value"].alias("name"), F.round(F.array_max(F.transform(own, lambda x: weight(x["source"]))), 4).alias("confidence"), sources_of(own).alias("sources"))

    return let(names, lambda n: F.transform(n, one))


def entry_key(kind: str, e: Column) -> Column:
    if kind == "experience":
        return F.concat_ws("|", company_key(e["company"]), safe_lower(e["title"]), F.substring(F.coalesce(e["start"], F.lit("")), 1, 7))
    if kind == "education":
        return F.concat_ws("|", safe_lower(e["institution"]), safe_lower(e["degree"]))
    return safe_lower(e["title"])


FIELDS = {
    "experience": ("company", "title", "start", "end", "summary"), "projects": ("title", "summary", "url", "tech_stack"),
    "education": ("institution", "degree", "field", "location", "start_year", "end_year"),
}


def merged(recs: str, kind: str, cfg: EngineConfig) -> Column:
    """Entries with equal keys become one: in priority order the first non-blank value of each field fills it."""
    weight = base_weight(cfg)
    each = F.flatten(F.transform(recs, lambda x: F.transform(x[kind], lambda e: F.struct(entry_key(kind, e).alias("key"), x["source"].alias("source"), e.alias("e")))))
    ordered = in_priority(each, cfg)
    if kind == "projects":
        ordered = F.filter(ordered, lambda x: x["key"] != "")

    def one(own):
        first = lambda f: F.get(F.filter(F.transform(own, lambda x: x["e"][f]), lambda y: y.isNotNull() & (y != "")), F.lit(0))
        base = lambda f: F.get(own, F.lit(0))["e"][f]
        return F.struct(*[F.coalesce(first(f), base(f)).alias(f) for f in FIELDS[kind]], F.round(weight(F.get(own, F.lit(0))["source"]), 4).alias("confidence"), sources_of(own).alias("sources"))

    # The entries are sorted once, and one key's are filtered once.
    of = lambda o: F.transform(F.array_distinct(F.transform(o, lambda x: x["key"])), lambda k: let(F.filter(o, lambda x: x["key"] == k), one))
    return let(ordered, of)


def first_of(recs: str, field: str, cast: str | None = None) -> Column:
    """The first non-blank value in record order; with cast the first that casts."""
    values = F.transform(recs, lambda x: x[field])
    if cast:
        return F.get(F.filter(F.transform(values, lambda x: trim_ws(x).try_cast(cast)), lambda x: x.isNotNull()), F.lit(0))
    return F.get(F.filter(values, lambda x: x.isNotNull() & (x != "")), F.lit(0))


def split_degree(e: Column) -> Column:
    """An education entry whose degree holds the field too, after a spaced dash."""
    d = trim_ws(e["degree"])
    cut = "^(.*?) [-–—] (.*)$"
    sep = F.when(d.contains(" - "), F.lit(" - ")).when(d.contains(" – "), F.lit(" – ")).when(d.contains(" — "), F.lit(" — "))
    split = (F.coalesce(e["field"], F.lit("")) == "") & sep.isNotNull()
    at = F.locate(" - ", d)
    place = F.when(d.contains(" - "), at).otherwise(F.length(F.regexp_extract(d, cut, 1)) + 1)
    return F.struct(
        e["institution"].alias("institution"), F.when(split, trim_ws(F.substring(d, F.lit(1), place - 1))).otherwise(e["degree"]).alias("degree"),
        F.when(split, trim_ws(F.substring(d, place + 3, F.length(d)))).otherwise(e["field"]).alias("field"), *[e[c].alias(c) for c in ("location", "start_year", "end_year", "confidence", "sources")],
    )
