"""What queries cost, read from their plans: nothing is worked out twice, and a small file does not make one task."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from braidwork import catalogue
from braidwork.functions import dates, phones, places
from braidwork.shared import spread
from braidwork.sources import resume

PERSON = "Ann Lee\nExperience:\nEngineer\nAcme | Jan 2020 - Present\nProjects:\n• Shop\nEducation\nB.Tech\nDelhi Institute | 2014 - 2018"


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("plans")
    spark.range(40).selectExpr("id AS c_custkey", "'BUILDING' AS c_mktsegment").coalesce(1).write.parquet(f"{d}/customer.parquet")
    return str(d)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["resume_education", "resume_fields", "resume_jobs", "resume_projects", "resume_sections"])
def test_a_text_is_split_once(spark, customers, name):
    df = entry.queries()[name](spark, customers)
    assert _plan(df).count(r"\r\n|\n|\r") == 1
    assert df.rdd.getNumPartitions() > 1


def test_scalars_trim_once(spark, customers):
    df = spark.createDataFrame([("+91 98765 43210", " India ", "Jan 2020")], "phone string, place string, date string")
    for c in (phones.normalize_phone(F.col("phone")), places.parse_location(F.col("place")), dates.normalize_date(F.col("date"))):
        assert _plan(df.select(c.alias("x"))).count(r"(?U)^\s+|\s+$") <= 2
    assert entry.queries()["severities"](spark, customers).rdd.getNumPartitions() > 1


def test_people_come_in_many_tasks(spark, customers):
    assert catalogue.people(spark, customers).rdd.getNumPartitions() > 1


def test_entries_of_none(spark):
    df = spark.createDataFrame([(1, "a", PERSON, []), (2, "b", "", []), (3, "c", None, [])], "rec_id long, source_file string, text string, parse_errors array<string>")
    r = resume.from_text(df)
    assert [tuple(x) for x in resume.entries(r, "experience").collect()] == [(1, "Acme", "Engineer", "Jan 2020", None, None)]
    assert [(x.rec_id, x.title) for x in resume.entries(r, "projects").collect()] == [(1, "Shop")]
    assert [(x.rec_id, x.institution) for x in resume.entries(r, "education").collect()] == [(1, "Delhi Institute")]


def test_sections_in_odd_texts(spark):
    texts = ["", "a\n\nSkills: x\nSKILLS:\rb\r\n c ", "Work\n work \nx", None, "About me and more\ny", "contact\u2028:\nz", "technical skills and interests of mine\nq"]
    df = resume.with_sections(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    got = {x.i: {k: v for k, v in x.sections.items() if v} for x in df.select("i", "sections").collect()}
    assert got == {0: {}, 1: {"HEADER": "a\n", "SKILLS": "b\n c "}, 2: {"EXPERIENCE": "x"}, 3: {}, 4: {"SUMMARY": "y"}, 5: {"HEADER": "contact\u2028:\nz"}, 6: {"SKILLS": "q"}}


def test_spread(spark):
    df = spark.range(0, 1000, 1, 1)
    out = spread(df, "id")
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and out.count() == 1000
    many = spark.range(0, 10, 1, 64)
    assert spread(many, "id") is many
