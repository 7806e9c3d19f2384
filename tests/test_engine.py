import itertools
import json
import os
import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from braidwork import sinks
from braidwork.config import EngineConfig, OutputField, ProjectionConfig
from braidwork.functions import similarity, skills
from braidwork.operators import match
from braidwork.operators.components import connected_components
from braidwork.operators.project import project
from braidwork.plans.engine import Engine
from braidwork.schema import as_records
from braidwork.sources import csv, resume
from braidwork.sources.base import safely

RESUME = """Sneha S Patel
sneha@x.com | +91 98765 43210
Bangalore, India
LinkedIn: snehap
SUMMARY
Backend dev.
EXPERIENCE
Software Engineer
Acme | Jan 2020 - Present
Built things.
Intern
Beta | Oct 2018 - Dec 2019
SKILLS
Languages: python, ReactJS, node js
kafka, docker
EDUCATION
B.Tech - Computer Science
National Institute of Technology, Delhi | 2014 - 2018
"""


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "p.csv").write_text('﻿name,email,phone,current_company,title,location,foo\n  Sneha   Patel ,SNEHA@x.com;s.patel@y.org,9876543210,Acme Inc.,Engineer,"Bangalore, India",1\nBob,bad,123\n', encoding="utf-8")
    (d / "r").mkdir()
    (d / "r" / "a.txt").write_text(RESUME, encoding="utf-8")
    (d / "r" / "b.docx").write_bytes(b"not a zip")
    return Engine(spark, as_of_year=2026).run_files(str(d / "p.csv"), str(d / "r"))


def test_end_to_end(result, tmp_path):
    people = result.profiles.orderBy("cluster_id").collect()
    assert [p.full_name for p in people] == ["Sneha Patel", "Bob", None]
    p = people[0]
    assert p.emails == ["sneha@x.com", "s.patel@y.org"] and p.phones == ["+919876543210"] and p.n_records == 2
    assert [s.name for s in p.skills] == ["Python", "React", "Node.js", "Kafka", "Docker"]
    assert [(e.company, e.start, e.end) for e in p.experience] == [("Acme", "2020-01", None), ("Beta", "2018-10", "2019-12")]
    assert (p.education[0].degree, p.education[0].field, p.education[0].end_year) == ("B.Tech", "Computer Science", "2018")
    assert p.match_keys_used == ["email", "name_company", "phone"] and p.status == "active"
    assert {d.field: d.confidence for d in p.confidence_details}["full_name"] == 0.646
    assert people[2].status == "manual_review" and people[2].data_quality_score == 0.1  # a broken file is a record of its own
    s = result.summary.first()
    assert (s.total, s.active, s.validation_failures) == (3, 2, 2)
    sinks.write_document(result, str(tmp_path / "o" / "out.json"))
    said = json.loads((tmp_path / "o" / "out.json").read_text(encoding="utf-8"))
    assert len(said["candidates"]) == 3 and said["summary"]["total"] == 3 and len(said["summary"]["validation_rejections"]) == 2
    assert "Sneha Patel" in sinks.describe(result)


def test_safely_raises_bugs(spark):
    def broken(spark, path):
        raise TypeError("a bug")

    with pytest.raises(TypeError):
        safely(broken, spark, "resume", "x")
    assert safely(lambda s, p: s.read.parquet(p), spark, "resume", "/no/such/path").count() == 1


def test_csv_errors(spark, tmp_path):
    assert csv.read(spark, str(tmp_path / "no.csv")).first().parse_errors[0].startswith("File not found")
    (tmp_path / "empty.csv").write_text("")
    assert csv.read(spark, str(tmp_path / "empty.csv")).count() == 1
    (tmp_path / "h.csv").write_text("name,email\n")
    assert csv.read(spark, str(tmp_path / "h.csv")).count() == 0


def test_line_automata():
    assert resume.dates("Acme 2020-01 - 2021-05") == ("2020-01", "2021-05")
    assert resume.dates("Nov 2019 to Present") == ("Nov 2019", None)
    school = resume.education("Delhi Public School\nClass 12 | 2012\nNational Institute of Technology, Delhi Delhi, India\nB.Tech 2014 - 2018")
    assert [e["institution"] for e in school][:1] == ["Delhi Public School"] and len(school) == 2
    assert resume.layout_text([{"text": "a", "x0": 0, "x1": 10, "top": 1}, {"text": "b", "x0": 200, "x1": 210, "top": 3}], 600) == "a\nb"


def test_education():
    one = lambda t: [tuple(e[k] for k in ("institution", "degree", "field", "location", "start_year", "end_year")) for e in resume.education(t)]
    assert one("B.Tech - Computer Science\nNational Institute of Technology, Delhi | 2014 - 2018") == [("National Institute of Technology, Delhi", "B.Tech", "Computer Science", None, "2014", "2018")]
    assert one("iiit Delhi , India\nM.Sc – Physics\n2019 - Present\nDelhi Public School | 2012\nClass 12") == [
        ("iiit", "M.Sc", "Physics", "Delhi, India", "2019", None), ("Delhi Public School", "Class 12", None, None, None, "2012"),
    ]
    assert one("MBA 2010\nHarvard School, Boston , Mexico\nPh.D 2015\nHarvard School, Boston , Mexico") == [("Harvard School", "MBA", None, "Boston, Mexico", None, "2010"), ("Harvard School", "Ph.D", None, "Boston, Mexico", None, "2015")]
    assert one("•\nSomewhere Else\nDiploma") == [("Somewhere Else", "Diploma", None, None, None, None)] and one("2014 - 2018") == [] and one("") == []


def test_blocks():
    assert resume.blocks("• A\n  detail\n• B") == ["A\n  detail", "B"]
    assert resume.blocks("A\nx\n\n\nB") == ["A\nx", "B"] and resume.blocks(" \n") == []
    assert resume.blocks("Engineer\nAcme | 2020 - 2021\nBuilt\nIntern\nBeta | 2019 - 2020") == ["Engineer\nAcme | 2020 - 2021\nBuilt", "Intern\nBeta | 2019 - 2020"]
    assert resume.blocks("Acme | 2020 - 2021\nBuilt\nIntern\nBeta 2019 - 2020") == ["Acme | 2020 - 2021\nBuilt", "Intern\nBeta 2019 - 2020"]


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    for n, m in ((40, 25), (60, 80)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(30)]
        parent = {x: x for e in edges for x in e}
        for _ in parent:
            for a, b in edges:
                low = min(parent[a], parent[b])
                parent[a] = parent[b] = low
        got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == parent
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_matching(spark):
    rows = [(1, "Ann Lee", ["a@x.io"], ["+1"]), (2, "A Lee", ["a@x.io"], []), (3, "Bo", ["b@x.io"], ["+1"]), (4, "Ann Lee", ["c@x.io"], [])]
    df = as_records(spark.createDataFrame(rows, "rec_id long, full_name string, emails array<string>, phones array<string>"))
    assert sorted(tuple(r) for r in match.clusters(df, EngineConfig()).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    by_name = EngineConfig.from_dict({"matching": {"name_company_match_weight": 1.2}})
    assert sorted(tuple(r) for r in match.clusters(df, by_name).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    plan = match.key_pairs(df, "emails")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        match.clusters(df, EngineConfig.from_dict({"matching": {"merge_decision_threshold": 0.05}}))


def test_projection(spark):
    df = spark.createDataFrame([("c1", None, ["a", "b"], [("x", 1.0)]), ("c2", "N", [], [])], "candidate_id string, full_name string, emails array<string>, skills array<struct<name:string,confidence:double>>")
    shape = lambda how, **k: ProjectionConfig((OutputField("id", "candidate_id"), OutputField("name", "full_name", **k), OutputField("rest", "emails[1:]"), OutputField("s", "skills[].name"), OutputField("last", "emails[7]")), on_missing=how)
    assert [tuple(r) for r in project(df, shape("null")).collect()] == [("c1", None, ["b"], ["x"], None), ("c2", "N", [], [], None)]
    assert [json.loads(r.json) for r in project(df, shape("omit")).collect()] == [{"id": "c1", "rest": ["b"], "s": ["x"]}, {"id": "c2", "name": "N", "rest": [], "s": []}]
    assert [r.error for r in project(df, shape("error", required=True)).collect()] == ["Required field 'name' is missing", None]
    named = spark.createDataFrame([("kafka developer", ["js", "basket weaving", "Tatting", None, ""]), (None, None)], "a string, b array<string>")
    said = project(named, ProjectionConfig((OutputField("a", normalize="canonical"), OutputField("b", normalize="canonical")))).collect()
    assert [tuple(r) for r in said] == [("Kafka", ["JavaScript", "Basket Weaving", "Tatting", None, ""]), (None, None)]
    with pytest.warns(UserWarning):
        assert project(df, ProjectionConfig((OutputField("x", "nothing"),))).first()[0] is None


def test_workers_need_no_package(tmp_path):
    """Functions for workers load where the package cannot be imported."""
    made = (match.group_metrics(EngineConfig()).func, similarity.token_set, skills.fuzzy, resume.document_text, resume.jobs, resume.education)
    (tmp_path / "f").write_bytes(cloudpickle.dumps(made))
    code = "import sys; from pyspark import cloudpickle; f = cloudpickle.load(open('f', 'rb')); assert f[1]('a b', 'b a') == 100 and f[2]('kafka x') == 'Kafka' and 'braidwork' not in sys.modules"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_config_sections():
    cfg = EngineConfig.from_dict({"_note": "x", "validation": {"date_min_year": 1800}})
    assert cfg.validation.date_min_year == 1800 and cfg.validation.date_max_year == 2030 and cfg.matching.email_match_weight == 1.0
    assert EngineConfig.from_dict({"matching": {"_why": "x", "email_match_weight": 0.2}}).matching.email_match_weight == 0.2
    with pytest.raises(ValueError, match="email_weight"):
        EngineConfig.from_dict({"matching": {"email_weight": 0.2}})
    with pytest.raises(ValueError, match="matchings"):
        EngineConfig.from_dict({"matchings": {}})


def test_clusters_do_not_depend_on_partitions(spark):
    rows = [(i, [f"u{i // 3}@x.io"], [f"+{i // 5}"] if i % 7 == 0 else []) for i in range(60)]
    df = as_records(spark.createDataFrame(rows, "rec_id long, emails array<string>, phones array<string>"))
    one, two = (sorted(map(tuple, match.clusters(df.repartition(n), EngineConfig()).collect())) for n in (1, 5))
    assert one == two and len({c for _, c in one}) < 60
    assert all(c <= r for r, c in itertools.islice(one, 60))
    assert F.col("x") is not None
