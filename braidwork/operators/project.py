"""Output shape compiled once from its configuration to columns."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from braidwork.config import ProjectionConfig
from braidwork.functions.phones import normalize_phone
from braidwork.functions.skills import canonical


def _at(kind: DataType, path: list[str], c: Column) -> Column | None:
    for name in path:
        if not isinstance(kind, StructType) or name not in kind.fieldNames():
            return None
        kind, c = kind[name].dataType, c[name]
    return c


def compile_path(schema: StructType, path: str) -> Column:
    """f, f.sub, f[N], f[N:], f[].sub.sub; whatever else is null, with a warning."""
    none = F.lit(None).cast("string")
    m = re.fullmatch(r"(\w+)(?:\[(\d*)(:?)\])?((?:\.\w+)*)", path)
    if m is None or m[1] not in schema.fieldNames():
        warnings.warn(f"path {path!r} gives null", stacklevel=2)
        return none
    kind, c = schema[m[1]].dataType, F.col(m[1])
    rest = [x for x in m[4].split(".") if x]
    if "[" not in path:
        found = _at(kind, rest, c)
        return none if found is None else found
    if not isinstance(kind, ArrayType) or (m[2] and rest) or (not m[2] and (m[3] or not rest)):
        warnings.warn(f"path {path!r} gives null", stacklevel=2)
        return none
    if m[2] and m[3]:
        return F.slice(c, F.lit(int(m[2]) + 1), F.greatest(F.size(c), F.lit(0)))
    if m[2]:
        return F.get(c, F.lit(int(m[2])))
    if _at(kind.elementType, rest, F.lit(None)) is None:
        return none
    return F.transform(c, lambda x: _at(kind.elementType, rest, x))


def _normalized(c: Column, how: str | None, kind: DataType) -> Column:
    how, many = (how or "").lower(), kind.simpleString() == "array<string>"
    if not many and kind.simpleString() != "string":
        return c
    if how == "e164":
        rule = lambda x: F.coalesce(normalize_phone(x, "IN"), x)
        return F.transform(c, rule) if many else rule(c)
    if how == "canonical":
        return canonical(c) if many else F.get(canonical(F.array(c)), F.lit(0))
    return c


def project(profiles: DataFrame, cfg: ProjectionConfig) -> DataFrame:
    """on_missing null: columns as configured. omit: a column ``json`` without absent keys. error: a column ``error``, which tells the first required field that is missing."""
    columns, errors = {}, []
    for f in cfg.fields:
        c = compile_path(profiles.schema, f.source or f.path)
        kind = profiles.select(c.alias("x")).schema[0].dataType
        c = _normalized(c, f.normalize, kind)
        columns[f.path] = c
        if f.required:
            gone = c.isNull() | ((c == "") if kind.simpleString() == "string" else F.lit(False))
            errors.append(F.when(gone, F.lit(f"Required field '{f.path}' is missing")))
    if cfg.include_confidence:
        columns |= {"overall_confidence": F.col("overall_confidence"), "data_quality_score": F.col("data_quality_score"), "status": F.col("status"), "review_reasons": F.when(F.size("review_reasons") > 0, F.col("review_reasons"))}
    if cfg.include_confidence_explanation:
        columns["confidence_details"] = F.col("confidence_details")
    if cfg.include_provenance:
        columns["provenance"] = F.col("provenance")
    if cfg.include_conflict_log:
        columns["conflict_log"] = F.col("conflict_log")
    if cfg.on_missing == "omit":
        pairs = []
        for name, c in columns.items():
            text = profiles.select(c.alias("x")).schema[0].dataType.simpleString() == "string"
            kept = F.when(c != "", c) if text else c
            pairs.append(F.when(kept.isNotNull(), F.concat(F.lit(f'"{name}":'), F.regexp_replace(F.to_json(F.array(kept), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", "$1"))))
        body = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pairs)), ","), F.lit("}"))
        return profiles.select("candidate_id", body.alias("json"))
    out = [c.alias(n) for n, c in columns.items()]
    if cfg.on_missing == "error":
        error = F.coalesce(*errors) if errors else F.lit(None).cast("string")
        out = [F.when(error.isNull(), c).alias(n) for n, c in columns.items() if n != "candidate_id"]
        return profiles.select("candidate_id", *out, error.alias("error"))
    return profiles.select(*out)


#: What the configured types allow.
TYPES = {"string": "string", "number": "(double|float|int|bigint|smallint|decimal.*)", "object": "struct<.*", "object[]": "array<struct<.*", "string[]": "array<string>"}


def type_errors(projected: DataFrame, cfg: ProjectionConfig) -> list[str]:
    """Fields whose column has another type than configured; known from the plan, without running it."""
    have = {f.name: f.dataType.simpleString() for f in projected.schema.fields}
    return [f"{f.path}: expected {f.type}, got {have[f.path]}" for f in cfg.fields if f.type in TYPES and f.path in have and not re.fullmatch(TYPES[f.type], have[f.path])]
