"""Severities, confidence, review, quality and ids, as columns."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from braidwork.config import EngineConfig
from braidwork.functions.dates import normalize_date
from braidwork.functions.phones import country_code, normalize_phone
from braidwork.functions.similarity import token_set
from braidwork.functions.text import blank, safe_lower, trim_ws


def _severity(one):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")


def scalar_severity(a: Column, b: Column) -> Column:
    """LOW if equal but for case, MEDIUM from a similarity of 50, else HIGH; null if either is null."""
    def one(x, y):
        if x is None or y is None:
            return None
        x, y = x.strip().lower(), y.strip().lower()
        return "LOW" if x == y else "MEDIUM" if token_set(x, y) >= 50 else "HIGH"

    return _severity(one)(a, b)


def name_severity(a: Column, b: Column) -> Column:
    """As scalar_severity, with 60, or a common token, for MEDIUM; missing names are empty."""
    def one(x, y):
        x, y = (x or "").strip().lower(), (y or "").strip().lower()
        return "LOW" if x == y else "MEDIUM" if token_set(x, y) >= 60 or set(x.split()) & set(y.split()) else "HIGH"

    return _severity(one)(a, b)


def email_severity(a: Column, b: Column) -> Column:
    x, y = safe_lower(a), safe_lower(b)
    part = lambda c, k: F.split_part(c, F.lit("@"), F.lit(k))
    return F.when(x == y, "LOW").when((part(x, 1) == part(y, 1)) | (x.contains("@") & (part(x, 2) == part(y, 2))), "MEDIUM").otherwise("HIGH")


def phone_severity(a: Column, b: Column, region: str = "IN") -> Column:
    x, y = normalize_phone(a, region), normalize_phone(b, region)
    return F.when(x == y, "LOW").when(country_code(x) == country_code(y), "MEDIUM").otherwise("HIGH")


def date_severity(a: Column, b: Column) -> Column:
    x, y = normalize_date(a), normalize_date(b)
    return F.when(x.isNull() | y.isNull() | (x == y), "LOW").when(F.substring(x, 1, 4) == F.substring(y, 1, 4), "MEDIUM").otherwise("HIGH")


def confidence_table(cfg: EngineConfig) -> dict[str, tuple[float, list[str]]]:
    """source|method|severity|agreement -> (score, explanation). Computed here, as rounding must be Python's."""
    out = {}
    for source, method, severity, agreement in itertools.product([*cfg.confidence_weights, "?"], cfg.extraction_certainty, cfg.severity_factors, cfg.agreement_factors):
        w, c = cfg.confidence_weights.get(source, 0.5), cfg.extraction_certainty[method]
        s, a = cfg.severity_factors[severity], cfg.agreement_factors[agreement]
        score = round(min(w * c * s * a, 1.0), 4)
        out[f"{source}|{method}|{severity}|{agreement}"] = (score, [
            f"Base weight ({source}): {w}", f"Extraction certainty ({method}): {c}", f"Severity factor ({severity}): {s}",
            f"Agreement factor ({agreement}): {a}", f"Final: {w} × {c} × {s} × {a} = {score}",
        ])
    return out


def confidence_of(cfg: EngineConfig, source: Column, method: str, severity: Column, agreement: Column) -> Column:
    """struct<confidence, reason>."""
    import json

    table = {k: {"confidence": v, "reason": r} for k, (v, r) in confidence_table(cfg).items()}
    known = F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "map<string,struct<confidence:double,reason:array<string>>>")
    name = F.when(source.isin(*cfg.confidence_weights), source).otherwise(F.lit("?"))
    return F.element_at(known, F.concat_ws("|", name, F.lit(method), severity, agreement))


def overall_confidence(details: str) -> Column:
    """Mean over the details, four decimals; 0 without any."""
    total = F.aggregate(details, F.lit(0).cast("decimal(20,4)"), lambda a, x: (a + x["confidence"].cast("decimal(5,4)")).cast("decimal(20,4)"))
    return F.when(F.size(details) > 0, F.round(total / F.size(details), 4).cast("double")).otherwise(0.0)


def quality(present: dict[str, Column], cfg: EngineConfig) -> Column:
    """struct<score, breakdown>; a field without a rule in present counts as missing."""
    q = cfg.quality_fields
    has = lambda f: F.coalesce(present.get(f, F.lit(False)), F.lit(False))

    def pick(names, yes):
        made = [F.when(has(f) if yes else ~has(f), F.lit(f)) for f in names]
        return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")

    parts = {"required_filled": pick(q.required, True), "required_missing": pick(q.required, False), "important_filled": pick(q.important, True), "important_missing": pick(q.important, False)}
    share = lambda name, names, w: F.size(parts[name]) / F.lit(float(max(len(names), 1))) * F.lit(float(w)) if names else F.lit(float(w))
    score = F.round(share("required_filled", q.required, q.required_weight) + share("important_filled", q.important, q.important_weight), 4)
    return F.struct(score.alias("score"), F.struct(*[c.alias(n) for n, c in parts.items()]).alias("breakdown"))


def review_reasons(cfg: EngineConfig, name_severity_: Column, email_severity_: Column, score: Column, confidence: Column, mismatch: Column, near: Column) -> Column:
    """Reasons for a manual review, in order; none if empty. Columns may be null."""
    r, t = cfg.review, cfg.matching.merge_decision_threshold
    high = F.coalesce((name_severity_ == "HIGH").cast("int"), F.lit(0)) + F.coalesce((email_severity_ == "HIGH").cast("int"), F.lit(0))
    fixed = lambda c: F.format_string("%.3f", c)
    on = lambda c: F.coalesce(c, F.lit(False))
    return F.array_compact(F.array(
        F.when(on(name_severity_ == "HIGH"), F.lit("HIGH-severity conflict on identity field 'full_name'")),
        F.when(on(email_severity_ == "HIGH"), F.lit("HIGH-severity conflict on identity field 'emails'")),
        F.when((high > r.auto_merge_max_high_severity_conflicts) & ~on(name_severity_ == "HIGH") & ~on(email_severity_ == "HIGH"), F.concat(F.lit("Total HIGH conflicts ("), high.cast("string"), F.lit(f") exceeds limit ({r.auto_merge_max_high_severity_conflicts})"))),
        F.when(on((score >= t - r.flag_near_threshold_margin) & (score < t)), F.concat(F.lit("Match score "), fixed(score), F.lit(f" is near threshold {t} (margin ±{r.flag_near_threshold_margin})"))),
        F.when(on(confidence < r.min_confidence_without_review), F.concat(F.lit("Overall confidence "), fixed(confidence), F.lit(f" < minimum {r.min_confidence_without_review}"))),
        F.when(on(mismatch), F.lit("Same phone number but completely different name and email")),
        F.when(on(near), F.lit("Candidate match score was near threshold")),
    ))


def candidate_id(first_email: Column, source_file: Column, rec_id: Column) -> Column:
    """From the first email; without one from the least record's file and place, so that reruns agree."""
    seed = F.coalesce(F.lower(trim_ws(first_email)), F.concat_ws("#", F.coalesce(source_file, F.lit("")), rec_id.cast("string")))
    return F.concat(F.lit("cand_"), F.substring(F.sha2(seed, 256), 1, 12))


def snapshot_hash(full_name: Column, emails: Column, phones: Column) -> Column:
    """Sixteen hex digits over the core fields, sorted by name."""
    quoted = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.to_json(F.array(c)))
    raw = F.concat(F.lit('{"emails": '), F.to_json(emails), F.lit(', "full_name": '), F.regexp_replace(quoted(full_name), r"^\[|\]$", ""), F.lit(', "phones": '), F.to_json(phones), F.lit("}"))
    return F.substring(F.sha2(raw, 256), 1, 16)


def filled(c: Column) -> Column:
    return ~blank(trim_ws(c))
