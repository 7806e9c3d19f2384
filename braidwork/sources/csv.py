"""Recruiter CSV files as records: headers by alias, all cells strings, a row per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions.text import split_list, trim_ws
from braidwork.schema import as_records

# Headers (trimmed, lower case) and the field they name.
ALIASES = {
    "name": "full_name", "full_name": "full_name", "fullname": "full_name",
    "email": "emails", "email_address": "emails", "emailaddress": "emails",
    "phone": "phones", "phone_number": "phones", "phonenumber": "phones", "mobile": "phones",
    "current_company": "current_company", "company": "current_company", "employer": "current_company",
    "title": "current_title", "job_title": "current_title", "jobtitle": "current_title", "position": "current_title",
    "headline": "headline", "summary": "headline",
    "linkedin": "linkedin", "linkedin_url": "linkedin", "linkedinurl": "linkedin",
    "github": "github", "github_url": "github",
    "location": "location_raw", "city": "location_raw", "address": "location_raw",
    "years_experience": "years_experience", "experience_years": "years_experience",
}
MULTIPLE = ("emails", "phones")
SOURCE = "recruiter_csv"


def error_record(spark: SparkSession, source: str, path: str, message: str) -> DataFrame:
    df = spark.range(1).select(F.lit(source).alias("source"), F.lit(path).alias("source_file"), F.array(F.lit(message)).alias("parse_errors"))
    return as_records(df.withColumn("rec_id", F.lit(0).cast("long")))


def from_columns(raw: DataFrame, source: str = SOURCE) -> DataFrame:
    """Records of a table of strings by its headers. Of headers with one meaning the last non-blank cell counts; lists add up."""
    cells: dict[str, list] = {}
    unknown = []
    own = [c for c in raw.columns if not c.startswith("_")]
    for header in own:
        field = ALIASES.get(header.strip().lower())
        if field is None:
            unknown.append(header.strip().lower())
            continue
        c = trim_ws(F.col(f"`{header}`"))
        cells.setdefault(field, []).append(F.coalesce(split_list(c), F.array().cast("array<string>")) if field in MULTIPLE else F.when(c != "", c))
    out = {f: F.concat(*cs) if f in MULTIPLE else F.coalesce(*reversed(cs)) for f, cs in cells.items()}
    warnings = F.array(*[F.lit(f"Unrecognised column: '{u}' — ignored") for u in unknown]).cast("array<string>")
    return as_records(raw.select("_order", "_file", *[c.alias(f) for f, c in out.items()], F.lit(source).alias("source"), warnings.alias("parse_warnings")).withColumnRenamed("_file", "source_file").withColumn("rec_id", F.col("_order")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Short rows are filled with nulls and following rows kept. A missing file or one without a header gives one error record."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False, inferSchema=False, encoding="UTF-8", ignoreLeadingWhiteSpace=False)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return error_record(spark, SOURCE, path, f"File not found: {path}")
    if not raw.columns:
        return error_record(spark, SOURCE, path, "CSV file has no headers")
    first = raw.columns[0]
    raw = raw.withColumnRenamed(first, first.lstrip("﻿"))
    return from_columns(raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_order", F.monotonically_increasing_id()))


def read_json(spark: SparkSession, path: str, source: str = "ats_json") -> DataFrame:
    """One JSON document per line; keys by the same aliases, lists of strings joined."""
    raw = spark.read.json(path).withColumn("_file", F.col("_metadata.file_path"))
    flat = [F.array_join(F.col(f.name), ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name).cast("string").alias(f.name) for f in raw.schema.fields if f.dataType.typeName() != "struct"]
    return from_columns(raw.select(*flat).withColumn("_order", F.monotonically_increasing_id()), source)
