"""More queries over the driver's tables: resumes, all three decisions, the audit trail, versions; each with SQL.

Resumes are written from customers' numbers, so that SQL can say what must be read from them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork import catalogue as base
from braidwork.config import EngineConfig, OutputField, ProjectionConfig
from braidwork.functions import dates, phones, skills, text
from braidwork.operators import fuse, match, project, validate, versions
from braidwork.plans.engine import NOTE, Engine
from braidwork.shared import spread
from braidwork.sources import resume

_K = "CAST(c_custkey AS VARCHAR(20))"
_LINES = {  # section -> expressions of its lines, read alike by Spark and DuckDB
    "HEADER": (
        f"CASE c_custkey % 3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bob K. Ray' ELSE concat('Cy Dee | cy', {_K}, '@x.com') END", f"concat('Email: User', {_K}, '@Example.com, +91 98765 ', lpad({_K}, 5, '0'))",
        f"CASE WHEN c_custkey % 4 = 0 THEN concat('LinkedIn: https://linkedin.com/in/p', {_K}) ELSE concat('LinkedIn: p', {_K}) END", f"concat('GitHub: https://github.com/g', {_K})",
        f"concat('LeetCode: l', {_K})", f"concat('Portfolio: https://p', {_K}, '.dev')", "CASE WHEN c_custkey % 2 = 0 THEN 'Location: Pune, India' ELSE 'Mumbai, India' END",
    ),
    "SUMMARY": (f"concat('Works with table ', {_K}, '.')",),
    "EXPERIENCE": ("'Engineer'", f"concat('Acme ', {_K}, ' | Jan 2020 - Present')", "'Built things.'", "'Intern'", "'Beta | Oct 2018 - Dec 2019'"),
    "SKILLS": ("'Languages: python, ReactJS'", "'kafka, docker, Kafka'"),
    "PROJECTS": (f"concat('• Shop ', {_K})", "'Sells things.'", "'Backend: Go'", f"concat('• Mail ', {_K})", f"concat('https://mail', {_K}, '.dev')"),
    "EDUCATION": ("'B.Tech - Computer Science'", "'National Institute of Technology, Delhi | 2014 - 2018'"),
}
_SECTION = {name: "concat(" + ", chr(10), ".join(lines) + ")" for name, lines in _LINES.items()}

_DECIDING = EngineConfig.from_dict({"matching": {"email_match_weight": 0.72, "phone_match_weight": 0.2}})


def _resumes(spark, sf_dir):
    parts = []
    for name, said in _SECTION.items():
        parts += [said] if name == "HEADER" else [f"'{name.title()}:'", said]
    df = spread(base._table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return df.selectExpr("c_custkey AS rec_id", f"concat('r', {_K}, '.txt') AS source_file", f"concat({', chr(10), '.join(parts)}) AS text", "CAST(array() AS ARRAY<STRING>) AS parse_errors")


def resume_sections(spark, sf_dir):
    df = resume.with_sections(_resumes(spark, sf_dir))
    # Outer, as an inner explode() has the sections worked out once more, in a filter on their number; there are always some.
    return df.select("rec_id", F.explode_outer("sections").alias("section", "body")).where("body <> ''")


def resume_fields(spark, sf_dir):
    r = resume.from_text(_resumes(spark, sf_dir))
    return r.select("rec_id", "full_name", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), "headline", "location_raw", "linkedin", "github", "leetcode", "portfolio", F.array_join("skills", ",").alias("skills"))


def resume_jobs(spark, sf_dir):
    return resume.entries(resume.from_text(_resumes(spark, sf_dir)), "experience")


def resume_projects(spark, sf_dir):
    return resume.entries(resume.from_text(_resumes(spark, sf_dir)), "projects")


def resume_education(spark, sf_dir):
    return resume.entries(resume.from_text(_resumes(spark, sf_dir)), "education")


def match_decisions(spark, sf_dir):
    """Weights under which a pair merges, awaits review or stays apart."""
    p = base.valid_people(spark, sf_dir)
    pairs = match.key_pairs(p, "emails").unionAll(match.key_pairs(p, "phones")).distinct()
    return match.score_pairs(p, pairs, _DECIDING, names=False).select("a", "b", F.col("score").cast("decimal(5,2)").alias("score"), "decision")


def field_decisions(spark, sf_dir):
    p = base._profiles(spark, sf_dir).profiles.select("cluster_id", F.explode("field_decisions").alias("x"))
    return p.select("cluster_id", "x.field", "x.source", "x.method", "x.reason_code", F.size("x.alternates_rejected").cast("long").alias("alternates"))


def confidence_details(spark, sf_dir):
    p = base._profiles(spark, sf_dir).profiles.select("cluster_id", F.explode("confidence_details").alias("x"))
    return p.select("cluster_id", "x.field", F.col("x.confidence").cast("decimal(5,4)").alias("confidence"))


def version_history(spark, sf_dir):
    """Two runs over the same people: every profile has versions 1 and 2 with one hash."""
    p = base._profiles(spark, sf_dir).profiles
    first = versions.snapshot(p)
    both = first.unionByName(versions.snapshot(p, first))
    return both.select("candidate_id", F.col("version").cast("long").alias("version"), F.array_join("sources", ",").alias("sources"), "snapshot_hash")


def text_scalars(spark, sf_dir):
    p = base._table(spark, sf_dir, "part")
    return p.select("p_partkey", text.slugify(F.concat(F.lit(" "), "p_name", F.lit(" & "), "p_brand", F.lit("_x "))).alias("slug"), text.truncate(F.col("p_name"), 12).alias("short"))


def date_checks(spark, sf_dir):
    o = base._table(spark, sf_dir, "orders")
    raw = F.date_format("o_orderdate", "MMM yyyy")
    o = o.select("o_orderkey", validate.check_date(raw, 1994, 1996).alias("x"), dates.normalize_year(raw).alias("year"), dates.valid_range(dates.normalize_date(raw), F.lit("1995-06")).alias("in_order"))
    return o.select("o_orderkey", F.col("x.value").alias("month"), F.col("x.rejection.reason").alias("reason"), "year", "in_order")


def phone_equivalent(spark, sf_dir):
    c = base._table(spark, sf_dir, "customer").select("c_custkey")
    tail = lambda k: F.lpad((k % 100000).cast("string"), 5, "0")
    k = F.col("c_custkey")
    return c.select("c_custkey", phones.equivalent(F.concat(F.lit("+91 98765 "), tail(k)), F.concat(F.lit("098765"), tail(k + k % 2))).alias("same"))


def skills_duplicate(spark, sf_dir):
    c = base._table(spark, sf_dir, "customer")
    a, b = ("CASE c_custkey % 4 WHEN 0 THEN 'js' WHEN 1 THEN 'Python3' WHEN 2 THEN 'kafka' ELSE 'basket weaving' END", "CASE c_custkey % 5 WHEN 0 THEN 'ECMAScript' WHEN 1 THEN 'py' WHEN 2 THEN 'apache kafka' WHEN 3 THEN 'Rust' ELSE 'Basket Weaving' END")
    return skills.with_duplicate(c.selectExpr("c_custkey", f"{a} AS a", f"{b} AS b"), "a", "b").select("c_custkey", "a", "b", "duplicate")


def _by_customer(spark, sf_dir, kind, entry):
    o = base._table(spark, sf_dir, "orders")
    g = o.select(F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("rec_id"), F.expr("CASE o_orderkey % 2 WHEN 0 THEN 'resume' ELSE 'recruiter_csv' END").alias("source"), F.array(entry).alias(kind))
    g = g.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rec_id", "source", kind))).alias("recs"))
    return g.select("cluster_id", F.explode(fuse.merged("recs", kind, base.CFG)).alias("x")).select("cluster_id", "x.*")


def merge_education(spark, sf_dir):
    e = F.expr("struct(concat('School ', o_orderstatus) AS institution, concat('B.Sc - ', o_orderpriority) AS degree, CAST(NULL AS STRING) AS field, CASE WHEN o_orderkey % 3 = 0 THEN 'Pune, India' END AS location, CAST(NULL AS STRING) AS start_year, date_format(o_orderdate, 'yyyy') AS end_year)")
    df = _by_customer(spark, sf_dir, "education", e)
    parts = F.struct(*[F.col(c) for c in ("institution", "degree", "field", "location", "start_year", "end_year", "confidence", "sources")])
    return df.select("cluster_id", fuse.split_degree(parts).alias("x")).select("cluster_id", "x.institution", "x.degree", "x.field", "x.location", "x.end_year", F.array_join(F.array_sort("x.sources"), ",").alias("sources"))


def merge_projects(spark, sf_dir):
    e = F.expr("struct(CASE WHEN o_orderkey % 7 <> 0 THEN concat('Job ', o_orderpriority) END AS title, CASE WHEN o_orderkey % 3 = 0 THEN concat('order ', CAST(o_orderkey AS STRING)) END AS summary, CAST(NULL AS STRING) AS url, o_orderstatus AS tech_stack)")
    df = _by_customer(spark, sf_dir, "projects", e)
    return df.select("cluster_id", "title", "summary", "tech_stack", F.col("confidence").cast("decimal(5,4)").alias("confidence"))


def _graduates(spark, sf_dir):
    school = "CASE s_suppkey % 4 WHEN 0 THEN 'Art School, Pune, India' WHEN 1 THEN 'School of Law' WHEN 2 THEN 'Indian Academy, Delhi' ELSE 'College, Oslo' END"
    place = "CASE s_suppkey % 4 WHEN 1 THEN 'Lyon, France' END"
    s = base._table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS rec_id", "'resume' AS source", "s_name AS full_name", f"array(struct({school} AS institution, 'MBA' AS degree, CAST(NULL AS STRING) AS field, {place} AS location, '2010' AS start_year, '2012' AS end_year)) AS education", "concat('https://github.com/s', CAST(s_suppkey AS STRING)) AS github")
    return Engine(spark, base.CFG, as_of_year=2026).run(s).profiles


def inferred_location(spark, sf_dir):
    return _graduates(spark, sf_dir).select("cluster_id", "location.city", "location.region", "location.country", "location.inferred", "location.inference_note")


def project_nested(spark, sf_dir):
    cfg = ProjectionConfig((OutputField("name", "full_name"), OutputField("city", "location.city"), OutputField("github", "links.github"), OutputField("schools", "education[].institution")), include_confidence=True, include_provenance=True)
    df = project.project(_graduates(spark, sf_dir), cfg)
    return df.select("name", "city", "github", F.array_join("schools", ";").alias("schools"), "status", F.array_join("review_reasons", ";").alias("reasons"), F.array_join(F.transform("provenance", lambda x: F.concat_ws(":", x["field"], x["source"], x["method"])), ",").alias("provenance"))


#: Longest common subsequences of the five segments' names, worked out beforehand.
_COMPANIES = "automobile building 3, automobile furniture 3, automobile household 3, automobile machinery 3, building furniture 2, building household 3, building machinery 2, furniture household 2, furniture machinery 2, household machinery 2"
_AUDIT = base._FUSED + """,
au AS (SELECT cluster_id, list(full_name ORDER BY prio DESC, rec_id)[2] AS other, list(source ORDER BY prio DESC, rec_id) AS by_prio, list(prio ORDER BY prio DESC, rec_id) AS prios,
  count(DISTINCT source) AS nsrc, count(DISTINCT source) FILTER (email IS NOT NULL) AS esrc, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  arg_min(source, (-prio, rec_id)) FILTER (email IS NOT NULL) AS es, arg_min(source, (-prio, rec_id)) FILTER (phone IS NOT NULL) AS ps FROM m GROUP BY 1),
ax AS (SELECT *, CASE WHEN agree THEN NULL WHEN lower(full_name) = lower(other) THEN 'LOW' ELSE 'MEDIUM' END AS name_sev, CASE WHEN ne > 1 THEN CASE WHEN esrc > 1 THEN 'MEDIUM' ELSE 'LOW' END END AS mail_sev,
  CASE prios[1] WHEN 100 THEN 0.95::DOUBLE WHEN 90 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS w, CASE WHEN nsrc = 1 THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS ag FROM fin JOIN au USING (cluster_id)),
de AS (SELECT cluster_id, field, CAST(format('{:.4f}', x) AS DECIMAL(5,4)) AS confidence FROM (
  SELECT cluster_id, 'full_name' AS field, w * CASE name_sev WHEN 'MEDIUM' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN name_sev IS NULL THEN ag ELSE 0.8::DOUBLE END AS x FROM ax
  UNION ALL SELECT cluster_id, 'emails', w * CASE mail_sev WHEN 'MEDIUM' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END * ag FROM ax WHERE ne > 0
  UNION ALL SELECT cluster_id, 'phones', w * ag FROM ax WHERE np > 0 UNION ALL SELECT cluster_id, 'skills', w * ag FROM ax)),
ov AS (SELECT cluster_id, CAST((2 * s + n) // (2 * n) / 10000.0 AS DECIMAL(5,4)) AS confidence FROM (SELECT cluster_id, CAST(sum(confidence) * 10000 AS BIGINT) AS s, count(*) AS n FROM de GROUP BY 1))"""
_R = "SELECT c_custkey AS rec_id, "
_SQL = {
    "fuzzy_skill": "WITH " + base._P + " SELECT DISTINCT skill || ' developer' AS raw, CASE lower(skill) WHEN 'js' THEN 'JavaScript' WHEN 'python3' THEN 'Python' WHEN 'kafka' THEN 'Kafka' ELSE 'Kubernetes' END AS skill FROM people",
    "fuzzy_name_score": "WITH " + base._V + ", lc AS (SELECT split_part(trim(p), ' ', 1) AS one, split_part(trim(p), ' ', 2) AS two, CAST(split_part(trim(p), ' ', 3) AS INT) AS n FROM (SELECT unnest(string_split('" + _COMPANIES + """', ',')) AS p)),
      n AS (SELECT rec_id, email, split_part(full_name, ' ', 3) AS d, lower(replace(current_company, ' Inc.', '')) AS co FROM valid),
      p AS (SELECT a.rec_id AS a, b.rec_id AS b, a.d AS x, b.d AS y, a.co AS cx, b.co AS cy, length(a.d) AS l, length(b.d) AS r, CASE WHEN contains(b.d, a.d[1]) OR (length(a.d) = 2 AND contains(b.d, a.d[2])) THEN 1 ELSE 0 END AS c FROM n a JOIN n b ON a.email = b.email AND a.rec_id < b.rec_id),
      s AS (SELECT a, b, CASE WHEN x = y THEN 100.0::DOUBLE ELSE greatest(100 - 100.0::DOUBLE * (l + r - 2 * c) / (22 + l + r), 100 - 100.0::DOUBLE * (1 + l) / (21 + l), 100 - 100.0::DOUBLE * (1 + r) / (21 + r)) END AS ns,
        CASE WHEN cx = cy THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * lc.n / (length(cx) + length(cy)) END AS cs FROM p LEFT JOIN lc ON one = least(cx, cy) AND two = greatest(cx, cy))
      SELECT a, b, CAST(ns / 100 * (0.7::DOUBLE + 0.3::DOUBLE * cs / 100) AS DECIMAL(9,6)) AS name_company, CAST(1 AS DECIMAL(9,6)) AS score FROM s""",
    "review_status": base._W + _AUDIT + """ SELECT cluster_id, CASE WHEN confidence < 0.6 THEN 'manual_review' ELSE 'active' END AS status, CASE WHEN confidence < 0.6 THEN 'Overall confidence ' || format('{:.3f}', confidence::DOUBLE) || ' < minimum 0.6' ELSE '' END AS reasons,
      confidence, CAST(1 AS DECIMAL(9,6)) AS match_score FROM ov""",
    "conflict_rows": base._W + _AUDIT + """ SELECT cluster_id, 'full_name' AS field, name_sev AS severity, full_name AS selected, by_prio[1] || ' (priority ' || prios[1] || ') over ' || by_prio[2] || ' (priority ' || prios[2] || ')' AS explanation FROM ax WHERE NOT agree
      UNION ALL SELECT cluster_id, 'emails', mail_sev, '["' || replace(emails, ',', '","') || '"]', 'Retained ' || ne || ' unique email(s); none discarded during merge' FROM ax WHERE ne > 1""",
    "field_decisions": base._W + _AUDIT + """ SELECT cluster_id, 'full_name' AS field, source, CASE source WHEN 'resume' THEN 'heuristic' ELSE 'direct' END AS method, CASE WHEN n_records = 1 THEN 'SINGLE_SOURCE' WHEN agree THEN 'NORMALIZATION_MATCH' ELSE 'HIGHER_SOURCE_PRIORITY' END AS reason_code,
      CASE WHEN agree THEN 0 ELSE n_records - 1 END AS alternates FROM ax UNION ALL SELECT cluster_id, 'emails', es, 'direct', 'UNION_DEDUPE', 0 FROM ax WHERE ne > 0 UNION ALL SELECT cluster_id, 'phones', ps, 'direct', 'UNION_DEDUPE', 0 FROM ax WHERE np > 0""",
    "confidence_details": base._W + _AUDIT + " SELECT cluster_id, field, confidence FROM de",
    "version_history": base._W + _AUDIT + """, js AS (SELECT *, CASE WHEN ne = 0 THEN '[]' ELSE '["' || array_to_string(list_sort(string_split(emails, ',')), '","') || '"]' END AS je, CASE WHEN np = 0 THEN '[]' ELSE '["' || array_to_string(list_sort(string_split(phones, ',')), '","') || '"]' END AS jp FROM ax)
      SELECT 'cand_' || substr(sha256(coalesce(first_email, first_file || '#' || CAST(first_rec AS VARCHAR))), 1, 12) AS candidate_id, version, sources, substr(sha256('{"emails": ' || je || ', "full_name": "' || full_name || '", "phones": ' || jp || '}'), 1, 16) AS snapshot_hash FROM js, (SELECT unnest([1::BIGINT, 2::BIGINT]) AS version)""",
    "match_decisions": "WITH " + base._V + base._EDGES + base._SCORED + " SELECT a, b, CAST(CASE WHEN e AND p THEN 0.92 WHEN e THEN 0.72 ELSE 0.2 END AS DECIMAL(5,2)) AS score, CASE WHEN e AND p THEN 'MERGE' WHEN e THEN 'MANUAL_REVIEW' ELSE 'SEPARATE' END AS decision FROM sc",
    "resume_sections": " UNION ALL ".join(f"{_R}'{n}' AS section, {x} AS body FROM customer" for n, x in _SECTION.items()),
    "resume_fields": f"""{_R}CASE c_custkey % 3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bob K. Ray' ELSE 'Cy Dee' END AS full_name, CASE WHEN c_custkey % 3 = 2 THEN 'cy' || {_K} || '@x.com,' ELSE '' END || 'user' || {_K} || '@example.com' AS emails,
      '+9198765' || lpad({_K}, 5, '0') AS phones, 'Works with table ' || {_K} || '.' AS headline, CASE WHEN c_custkey % 2 = 0 THEN 'Pune, India' ELSE 'Mumbai, India' END AS location_raw, 'https://linkedin.com/in/p' || {_K} AS linkedin,
      'https://github.com/g' || {_K} AS github, 'https://leetcode.com/u/l' || {_K} AS leetcode, 'https://p' || {_K} || '.dev' AS portfolio, 'python,ReactJS,kafka,docker' AS skills FROM customer""",
    "resume_jobs": f"{_R}'Acme ' || {_K} AS company, 'Engineer' AS title, 'Jan 2020' AS start, NULL AS \"end\", 'Built things.' AS summary FROM customer UNION ALL {_R}'Beta', 'Intern', 'Oct 2018', 'Dec 2019', NULL FROM customer",
    "resume_projects": f"{_R}'Shop ' || {_K} AS title, 'Sells things.' AS summary, NULL AS url, 'Backend: Go' AS tech_stack FROM customer UNION ALL {_R}'Mail ' || {_K}, 'https://mail' || {_K} || '.dev', 'https://mail' || {_K} || '.dev', NULL FROM customer",
    "resume_education": f"{_R}'National Institute of Technology, Delhi' AS institution, 'B.Tech' AS degree, 'Computer Science' AS field, CAST(NULL AS VARCHAR) AS location, '2014' AS start_year, '2018' AS end_year FROM customer",
    "text_scalars": r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand || '_x'), '[^\w\s-]', '', 'g'), '[\s_-]+', '-', 'g') AS slug, CASE WHEN length(p_name) > 12 THEN substr(p_name, 1, 12) || '...' ELSE p_name END AS short FROM part",
    "date_checks": "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1994 AND 1996 THEN strftime(o_orderdate, '%Y-%m') END AS month, CASE WHEN year(o_orderdate) NOT BETWEEN 1994 AND 1996 THEN 'Year ' || year(o_orderdate) || ' out of [1994, 1996]' END AS reason, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m') <= '1995-06' AS in_order FROM orders",
    "phone_equivalent": "SELECT c_custkey, c_custkey % 2 = 0 AS same FROM customer",
    "skills_duplicate": """SELECT c_custkey, ['js', 'Python3', 'kafka', 'basket weaving'][i + 1] AS a, ['ECMAScript', 'py', 'apache kafka', 'Rust', 'Basket Weaving'][j + 1] AS b, (i, j) IN ((0, 0), (1, 1), (2, 2), (3, 4)) AS duplicate FROM (SELECT c_custkey, c_custkey % 4 AS i, c_custkey % 5 AS j FROM customer)""",
    "merge_education": """WITH o AS (SELECT *, CASE o_orderkey % 2 WHEN 0 THEN 'resume' ELSE 'recruiter_csv' END AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'Pune, India' END AS loc, (1 - o_orderkey % 2, o_orderkey) AS r FROM orders)
      SELECT o_custkey AS cluster_id, 'School ' || o_orderstatus AS institution, 'B.Sc' AS degree, o_orderpriority AS field, arg_min(loc, r) FILTER (loc IS NOT NULL) AS location, arg_min(strftime(o_orderdate, '%Y'), r) AS end_year, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM o GROUP BY o_custkey, o_orderstatus, o_orderpriority""",
    "merge_projects": """WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'order ' || o_orderkey END AS s, (1 - o_orderkey % 2, o_orderkey) AS r FROM orders WHERE o_orderkey % 7 <> 0)
      SELECT o_custkey AS cluster_id, 'Job ' || o_orderpriority AS title, arg_min(s, r) FILTER (s IS NOT NULL) AS summary, arg_min(o_orderstatus, r) AS tech_stack, CAST(CASE WHEN max(o_orderkey % 2) = 1 THEN 0.95 ELSE 0.7 END AS DECIMAL(5,4)) AS confidence FROM o GROUP BY o_custkey, o_orderpriority""",
    "inferred_location": f"""SELECT s_suppkey AS cluster_id, CASE s_suppkey % 4 WHEN 0 THEN 'Art School' WHEN 1 THEN 'Lyon' WHEN 2 THEN 'Delhi' ELSE 'Oslo' END AS city, CASE s_suppkey % 4 WHEN 0 THEN 'Pune' END AS region,
      CASE s_suppkey % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'FR' WHEN 2 THEN 'IN' END AS country, true AS inferred, '{NOTE}' AS inference_note FROM supplier""",
    "project_nested": """SELECT s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'Art School' WHEN 1 THEN 'Lyon' WHEN 2 THEN 'Delhi' ELSE 'Oslo' END AS city, 'https://github.com/s' || s_suppkey AS github, CASE s_suppkey % 4 WHEN 0 THEN 'Art School, Pune, India' WHEN 1 THEN 'School of Law' WHEN 2 THEN 'Indian Academy, Delhi' ELSE 'College, Oslo' END AS schools,
      'manual_review' AS status, 'Overall confidence 0.525 < minimum 0.6' AS reasons, 'full_name:resume:heuristic' AS provenance FROM supplier""",
}

_QUERIES = [resume_sections, resume_fields, resume_jobs, resume_projects, resume_education, match_decisions, field_decisions, confidence_details, version_history, text_scalars, date_checks, phone_equivalent, skills_duplicate, merge_education, merge_projects, inferred_location, project_nested]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
