"""Skill names to canonical ones: by table, else by the most similar known name, else as they are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.similarity import token_set
from braidwork.functions.text import title_case, trim_ws

# Canonical skills and their other names; a canonical name in lower case always counts, too.
SYNONYMS: dict[str, list[str]] = {
    "Python": ["python3", "python 3", "py", "python2"],
    "JavaScript": ["js", "java script", "ecmascript", "es6", "es2015"],
    "TypeScript": ["ts"],
    "React": ["reactjs", "react.js", "react js", "reactjs.org"],
    "Angular": ["angularjs", "angular.js", "angular 2+"],
    "Vue.js": ["vue", "vuejs"],
    "Node.js": ["node", "nodejs", "node js"],
    "Java": ["java8", "java 8", "java11", "java 11"],
    "Kotlin": [], "Swift": [],
    "Go": ["golang", "go lang", "go programming"],
    "Rust": ["rust lang"],
    "C++": ["cpp", "c plus plus"],
    "C#": ["csharp", "c sharp", ".net", "dotnet"],
    "PHP": [],
    "Ruby": ["ruby on rails", "rails"],
    "Scala": [],
    "SQL": ["mysql", "postgresql", "postgres", "sqlite", "oracle sql", "t-sql", "pl/sql"],
    "NoSQL": ["mongodb", "mongo", "cassandra", "couchdb", "dynamodb"],
    "Machine Learning": ["ml", "machinelearning", "supervised learning"],
    "Deep Learning": ["dl", "deeplearning", "neural networks", "nn"],
    "Data Science": ["datascience", "data analysis", "data analytics"],
    "NLP": ["natural language processing", "text mining"],
    "Computer Vision": ["cv", "image processing", "object detection"],
    "Docker": ["containerization", "containers"],
    "Kubernetes": ["k8s", "k8", "container orchestration"],
    "AWS": ["amazon web services", "amazon aws", "ec2", "s3", "lambda"],
    "GCP": ["google cloud", "google cloud platform"],
    "Azure": ["microsoft azure"],
    "Terraform": ["iac", "infrastructure as code"],
    "Git": ["github", "gitlab", "bitbucket", "version control"],
    "CI/CD": ["cicd", "ci cd", "continuous integration", "continuous deployment", "jenkins", "github actions"],
    "REST API": ["rest", "restful", "restful api", "api design"],
    "GraphQL": ["gql"],
    "Microservices": ["micro services", "service mesh"],
    "Agile": ["scrum", "kanban", "sprint"],
    "Linux": ["unix", "ubuntu", "centos", "debian"],
    "Django": [], "Flask": [],
    "FastAPI": ["fast api"],
    "Spring": ["spring boot", "springboot"],
    "TensorFlow": ["tf"],
    "PyTorch": ["torch"],
    "Pandas": [],
    "NumPy": ["np"],
    "Spark": ["apache spark", "pyspark"],
    "Kafka": ["apache kafka"],
    "Redis": [],
    "Elasticsearch": ["elastic search", "elk", "opensearch"],
}
KNOWN = {name: canonical for canonical, others in SYNONYMS.items() for name in (canonical.lower(), *others)}
FUZZY_THRESHOLD = 88


def exact_skill(raw: Column) -> Column:
    """Canonical name by the table, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv]), F.lower(trim_ws(raw)))


def fuzzy(name: str) -> str | None:
    best, found = FUZZY_THRESHOLD - 1e-9, None
    for known, canonical in KNOWN.items():
        score = token_set(name, known)
        if score > best:
            best, found = score, canonical
    return found


def fuzzy_skill(column) -> Column:
    """The canonical skill of the most similar known name, first in the table on ties, or null."""
    def run(name: pd.Series) -> pd.Series:
        return name.map({x: fuzzy(x) for x in set(name) if x is not None})

    return F.pandas_udf(run, "string")(column)


def canonical(names: Column) -> Column:
    """An array of names, each replaced by its canonical skill; unknown ones stay, in title case if they are in lower case."""
    def one(name):
        bare = (name or "").strip()
        if not bare:
            return name
        low = bare.lower()
        return KNOWN.get(low) or fuzzy(low) or (bare.title() if bare == low else bare)

    def run(rows: pd.Series) -> pd.Series:
        known = {x: one(x) for x in {y for row in rows if row is not None for y in row}}
        return rows.map(lambda row: None if row is None else [known[x] for x in row])

    return F.pandas_udf(run, "array<string>")(names)


def skill_table(raw: DataFrame, column: str) -> DataFrame:
    """(raw, skill) of every distinct string: Python sees the distinct strings that the table does not know, nothing else."""
    names = raw.select(F.col(column).alias("raw")).where(F.col("raw").isNotNull()).distinct()
    names = names.withColumn("exact", exact_skill(F.col("raw")))
    rest = names.where(F.col("exact").isNull()).withColumn("low", F.lower(trim_ws(F.col("raw"))))
    rest = rest.withColumn("skill", fuzzy_skill("low")).withColumn("t", trim_ws(F.col("raw")))
    kept = F.when(F.col("t") == F.lower("t"), title_case(F.col("t"))).otherwise(F.col("t"))
    return names.where(F.col("exact").isNotNull()).select("raw", F.col("exact").alias("skill")).unionByName(rest.select("raw", F.coalesce("skill", F.when(F.col("t") == "", F.col("raw")).otherwise(kept)).alias("skill")))


def with_skills(df: DataFrame, key: str, column: str) -> DataFrame:
    """df with the strings of an array column replaced by canonical skills; key identifies rows."""
    each = df.select(key, F.posexplode(column).alias("_i", "raw"))
    table = skill_table(each, "raw")
    done = each.join(table, "raw").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "skill"))).alias("_s"))
    joined = df.join(done, key, "left")
    return joined.withColumn(column, F.coalesce(F.transform("_s", lambda x: x["skill"]), F.array().cast("array<string>"))).drop("_s")


def with_duplicate(df: DataFrame, a: str, b: str, name: str = "duplicate") -> DataFrame:
    """Adds whether the skills in a and b have one canonical name; nulls equal nulls."""
    table = skill_table(df.select(F.explode(F.array(a, b)).alias("_raw")), "_raw")
    for side in (a, b):
        df = df.join(table.select(F.col("raw").alias(side), F.col("skill").alias(f"_skill_{side}")), side, "left")
    return df.withColumn(name, F.col(f"_skill_{a}").eqNullSafe(F.col(f"_skill_{b}"))).drop(f"_skill_{a}", f"_skill_{b}")
