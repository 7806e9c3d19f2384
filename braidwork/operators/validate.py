"""Validation with rejections as a second output: each rule is a column giving the value kept and the rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.config import EngineConfig
from braidwork.functions.dates import normalize_date
from braidwork.functions.phones import normalize_phone
from braidwork.functions.text import trim_ws

REJECTION = "struct<field:string,raw_value:string,reason:string,reason_code:string>"
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"


def _rejected(field: str, raw: Column, reason: Column | str, code: str) -> Column:
    said = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(field).alias("field"), F.nullif(raw, F.lit("")).alias("raw_value"), said.alias("reason"), F.lit(code).alias("reason_code"))


def _checked(value: Column, rejection: Column) -> Column:
    return F.struct(value.alias("value"), rejection.alias("rejection"))


def check_email(raw: Column, max_length: int) -> Column:
    """struct<value, rejection>: the lower-cased address or why not; an overlong one is not repeated in the rejection."""
    s = F.coalesce(trim_ws(raw), F.lit(""))
    why = (
        F.when(s == "", F.lit("Empty email value")).when(F.length(s) > max_length, F.lit(f"Email exceeds {max_length} characters"))
        .when(s.contains(" "), F.lit("Email contains spaces")).when(~s.rlike(EMAIL), F.lit("Email does not match expected pattern"))
    )
    shown = F.when(F.length(s) <= max_length, s)
    return _checked(F.when(why.isNull(), F.lower(s)), F.when(why.isNotNull(), _rejected("email", shown, why, "INVALID_EMAIL_FORMAT")))


def check_phone(raw: Column, region: str) -> Column:
    """struct<value, rejection>; blank numbers give neither."""
    s = F.coalesce(trim_ws(raw), F.lit(""))
    number = normalize_phone(s, region)
    return _checked(number, F.when((s != "") & number.isNull(), _rejected("phone", s, "Phone number could not be parsed to E.164", "INVALID_PHONE")))


def check_skill(raw: Column) -> Column:
    s = F.coalesce(trim_ws(raw), F.lit(""))
    return _checked(F.when(s != "", s), F.when(s == "", _rejected("skill", s, "Empty skill value", "EMPTY_SKILL")))


def check_experience(entry: Column, first_year: int, last_year: int) -> Column:
    """struct<value, rejection>: an entry with a bad start, or a date outside the years, goes; an end that is no date is open."""
    start, end = normalize_date(entry["start"]), normalize_date(entry["end"])
    outside = lambda d: ~F.substring(d, 1, 4).cast("int").between(first_year, last_year)
    given = lambda c: F.coalesce(c != "", F.lit(False))
    said = lambda d: F.concat(F.lit("Year "), F.substring(d, 1, 4).cast("int").cast("string"), F.lit(f" out of range [{first_year}, {last_year}]"))
    rejection = (
        F.when(given(entry["start"]) & start.isNull(), _rejected("experience.start", entry["start"], "Unparseable date in experience", "INVALID_DATE"))
        .when(given(entry["start"]) & outside(start), _rejected("experience.start", entry["start"], said(start), "INVALID_DATE"))
        .when(given(entry["end"]) & end.isNotNull() & outside(end), _rejected("experience.end", entry["end"], said(end), "INVALID_DATE"))
    )
    kept = F.struct(entry["company"].alias("company"), entry["title"].alias("title"), F.when(given(entry["start"]), start).otherwise(entry["start"]).alias("start"), F.when(given(entry["end"]), end).otherwise(entry["end"]).alias("end"), entry["summary"].alias("summary"))
    return _checked(F.when(rejection.isNull(), kept), rejection)


def check_date(raw: Column, first_year: int, last_year: int) -> Column:
    """struct<value, rejection> of a single date."""
    d = normalize_date(raw)
    bad = ~F.substring(d, 1, 4).cast("int").between(first_year, last_year)
    reason = F.concat(F.lit("Year "), F.substring(d, 1, 4).cast("int").cast("string"), F.lit(f" out of [{first_year}, {last_year}]"))
    return _checked(F.when(~bad, d), F.when(bad, _rejected("date", raw, reason, "INVALID_DATE")))


def validate(records: DataFrame, cfg: EngineConfig) -> DataFrame:
    """records with invalid values removed, plus rejections in the order emails, phones, skills, experience."""
    v = cfg.validation
    rules = {
        "emails": lambda x: check_email(x, v.email_max_length), "phones": lambda x: check_phone(x, v.phone_default_region), "skills": check_skill,
        "experience": lambda x: check_experience(x, v.date_min_year, v.date_max_year),
    }
    df = records
    for name, rule in rules.items():
        df = df.withColumn(f"_{name}", F.transform(name, rule))
    rejections = F.flatten(F.array(*[F.filter(F.transform(f"_{n}", lambda x: x["rejection"]), lambda x: x.isNotNull()) for n in rules]))
    df = df.withColumn("rejections", rejections)
    for name in rules:
        df = df.withColumn(name, F.filter(F.transform(f"_{name}", lambda x: x["value"]), lambda x: x.isNotNull()))
    return df.drop(*[f"_{n}" for n in rules])


def rejection_rows(validated: DataFrame) -> DataFrame:
    return validated.select("rec_id", F.posexplode("rejections").alias("pos", "x")).select("rec_id", "pos", "x.*")
