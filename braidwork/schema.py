"""The record that every source yields, one row per person record found in a file.

rec_id orders records: files in the order given, then rows. Every "first" further on means the least rec_id.
"""

from __future__ import annotations

EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
PROJECT = "struct<title:string,summary:string,url:string,tech_stack:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,location:string,start_year:string,end_year:string>"

RECORD = (
    "rec_id bigint, source string, source_file string, full_name string, emails array<string>, phones array<string>, headline string, "
    "location_raw string, years_experience string, current_company string, current_title string, linkedin string, github string, leetcode string, "
    f"portfolio string, skills array<string>, experience array<{EXPERIENCE}>, projects array<{PROJECT}>, education array<{EDUCATION}>, "
    "parse_errors array<string>, parse_warnings array<string>"
)
COLUMNS = [c.split()[0] for c in RECORD.replace(f"array<{EXPERIENCE}>", "x").replace(f"array<{PROJECT}>", "x").replace(f"array<{EDUCATION}>", "x").split(", ")]
LISTS = ("emails", "phones", "skills", "experience", "projects", "education", "parse_errors", "parse_warnings")


def as_records(df):
    """df with all record columns: missing ones are null, missing lists empty."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(RECORD) if hasattr(StructType, "fromDDL") else df.sparkSession.createDataFrame([], RECORD).schema
    out = []
    for f in want.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = c.cast(f.dataType)
        out.append((F.coalesce(c, F.array().cast(f.dataType)) if f.name in LISTS else c).alias(f.name))
    return df.select(*out)
