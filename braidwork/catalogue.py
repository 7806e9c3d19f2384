"""The engine's own queries over the driver's tables, each with SQL of the same result where SQL can say it.

No table holds people, so their records are derived from customer: addresses shared by three, telephone numbers by two
neighbours of different groups, some values broken on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.config import EngineConfig, OutputField, ProjectionConfig
from braidwork.functions import dates, phones, places, skills, text
from braidwork.operators import fuse, match, project, score, validate, versions
from braidwork.plans.engine import Engine, normalize
from braidwork.schema import as_records
from braidwork.shared import spread, written
from braidwork.sources import resume

CFG = EngineConfig()

# Read alike by Spark and DuckDB.
_PEOPLE = {
    "rec_id": "c_custkey",
    "source": "CASE c_custkey % 3 WHEN 0 THEN 'recruiter_csv' WHEN 1 THEN 'resume' ELSE 'ats_json' END",
    "source_file": "concat('file', CAST(c_custkey % 7 AS VARCHAR(20)))",
    "full_name": "concat(' Person  ', CASE WHEN c_custkey % 5 = 0 THEN 'ann ' ELSE 'Ann ' END, CAST(c_custkey % 100 AS VARCHAR(20)))",
    "email": "CASE WHEN c_custkey % 17 = 0 THEN 'not-an-email' WHEN c_custkey % 19 = 0 THEN 'a b@example.com' ELSE concat('User', CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS VARCHAR(20)), '@Example.com') END",
    "phone": "CASE WHEN c_custkey % 12 = 2 THEN concat('+91 98765 ', lpad(CAST(CAST(floor(c_custkey / 12) AS BIGINT) % 100000 AS VARCHAR(20)), 5, '0')) WHEN c_custkey % 12 = 3 THEN concat('098765', lpad(CAST(CAST(floor(c_custkey / 12) AS BIGINT) % 100000 AS VARCHAR(20)), 5, '0')) WHEN c_custkey % 12 = 7 THEN 'call me' END",
    "linkedin": "CASE WHEN c_custkey % 4 = 1 THEN concat('https://linkedin.com/in/p', CAST(c_custkey AS VARCHAR(20))) END",
    "years_experience": "CASE WHEN c_custkey % 6 = 1 THEN 'many' WHEN c_custkey % 6 = 2 THEN concat(CAST(c_custkey % 30 AS VARCHAR(20)), '.5') END",
    "current_company": "concat(c_mktsegment, ' Inc.')",
    "skill": "CASE c_custkey % 5 WHEN 0 THEN 'js' WHEN 1 THEN 'Python3' WHEN 2 THEN 'kafka' WHEN 3 THEN 'JS' ELSE 'k8s' END",
}
_P = "people AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _PEOPLE.items()) + " FROM customer)"
# What the records look like once valid.
_V = _P + """,
valid AS (SELECT rec_id, source, source_file, trim(regexp_replace(full_name, '\\s+', ' ', 'g')) AS full_name, linkedin, years_experience, skill, current_company,
  CASE WHEN regexp_full_match(email, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}') THEN lower(email) END AS email,
  CASE WHEN phone LIKE '+91%' THEN replace(phone, ' ', '') WHEN phone LIKE '0%' THEN '+91' || substr(phone, 2) END AS phone FROM people)"""
_EDGES = """,
pairs AS (SELECT DISTINCT a.rec_id AS a, b.rec_id AS b FROM valid a JOIN valid b ON (a.email = b.email) AND a.rec_id < b.rec_id
  UNION SELECT a.rec_id, b.rec_id FROM valid a JOIN valid b ON a.phone = b.phone AND a.rec_id < b.rec_id),
twoway AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs)"""
_CLUSTERS = _EDGES + """,
reach AS (SELECT rec_id AS a, rec_id AS b FROM valid UNION SELECT r.a, e.b FROM reach r JOIN twoway e ON r.b = e.a),
cl AS (SELECT a AS rec_id, min(b) AS cluster_id FROM reach GROUP BY a)"""
_PRIO = "CASE source WHEN 'recruiter_csv' THEN 100 WHEN 'ats_json' THEN 90 WHEN 'resume' THEN 70 ELSE 0 END"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spread(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").selectExpr(*[f"{e} AS {n}" for n, e in _PEOPLE.items()])
    one = lambda c: F.array_compact(F.array(F.col(c)))
    return as_records(raw.withColumn("emails", one("email")).withColumn("phones", one("phone")).withColumn("skills", one("skill")))


def valid_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = people(spark, sf_dir).withColumn("full_name", text.person_name(F.col("full_name"))).withColumn("skills", F.transform("skills", lambda x: F.coalesce(skills.exact_skill(x), x)))
    return validate.validate(df, CFG)


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of a customer: several orders of a kind and month are one job seen more than once."""
    o = _table(spark, sf_dir, "orders")
    job = F.struct(
        F.concat(F.lit("Company "), F.col("o_orderstatus"), F.lit(" Ltd.")).alias("company"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy").alias("start"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/yyyy")).alias("end"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("summary"),
    )
    return o.select(F.col("o_orderkey").alias("rec_id"), (F.col("o_custkey")).alias("cluster_id"), F.when(F.col("o_orderkey") % 2 == 0, "resume").otherwise("recruiter_csv").alias("source"), F.array(job).alias("experience"))


def extract_emails(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").contains("@"))
    return d.select("doc_id", F.array_join(resume.emails(F.col("text")), ",").alias("emails")).where("emails <> ''")


def extract_page_links(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("pos", "link"))
    return p.select("page_id", F.col("pos").cast("long").alias("pos"), "link")


def section_lines(spark, sf_dir):
    """Lines of a conversation under the role that speaks: a heading carried down, and how many lines each has."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.concat(F.array(F.concat(F.col("role"), F.lit(":"))), F.split("text", "\n"))).alias("line"))
    return c.groupBy("conv_id", "turn").agg(F.count_if(text.trim_ws(F.col("line")) != "").alias("lines"), F.max(F.length("line")).cast("long").alias("longest"))


def tokenize_list(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", F.explode(text.split_list(F.concat_ws("; ", "p_name", F.col("p_type"), F.lit(" ,")))).alias("token"))
    return p.groupBy("p_partkey").agg(F.count("*").alias("n"), F.min("token").alias("first"), F.max("token").alias("last"))


def normalize_person_name(spark, sf_dir):
    return people(spark, sf_dir).select("rec_id", text.person_name(F.col("full_name")).alias("name"), text.name_key(F.col("full_name")).alias("key"))


def normalize_company_key(spark, sf_dir):
    return people(spark, sf_dir).select("rec_id", text.company_key(F.col("current_company")).alias("company"))


def normalize_date(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    forms = [F.date_format("o_orderdate", f) for f in ("yyyy-MM", "yyyy", "MMM yyyy", "yyyy MMMM", "MM/yyyy", "yyyy/MM", "yyyy.M")]
    raw = F.coalesce(*[F.when(F.col("o_orderkey") % 9 == i, f) for i, f in enumerate(forms)], F.when(F.col("o_orderkey") % 9 == 7, "Present"), F.concat(F.lit("since "), F.date_format("o_orderdate", "yyyy")))
    return o.select("o_orderkey", dates.normalize_date(raw).alias("month"))


def normalize_phone_e164(spark, sf_dir):
    o = _table(spark, sf_dir, "customer").select("c_custkey", F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0").alias("t"))
    forms = [F.concat(F.lit(a), F.col("t"), F.lit(b)) for a, b in (("+91 98765 ", "1"), ("(415) 555-", ""), ("+44 7911 12", ""), ("9876 5", "1"), ("00919876", "54"), ("12", ""), ("+1 415 555 ", ""))]
    raw = F.coalesce(*[F.when(F.col("c_custkey") % 7 == i, f) for i, f in enumerate(forms)])
    return o.select("c_custkey", phones.normalize_phone(raw).alias("e164"))


def normalize_country(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.select("n_nationkey", places.normalize_country(F.col("n_name")).alias("code"))


def parse_location(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 4 == 0, "India").when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("Town "), F.col("c_custkey").cast("string"), F.lit(" , UK"))).when(F.col("c_custkey") % 4 == 2, "Pune,Nowhere").otherwise(" A , B , France , x")
    return c.select("c_custkey", places.parse_location(raw).alias("x")).select("c_custkey", "x.city", "x.region", "x.country")


def canonical_skill(spark, sf_dir):
    return people(spark, sf_dir).select("rec_id", F.explode("skills").alias("raw")).select("rec_id", "raw", skills.exact_skill(F.col("raw")).alias("skill"))


def fuzzy_skill(spark, sf_dir):
    """Skills with a word more than the table knows: by similarity. No SQL form."""
    p = people(spark, sf_dir).select(F.concat(F.get("skills", F.lit(0)), F.lit(" developer")).alias("s")).distinct()
    return skills.skill_table(p, "s")


def validate_emails(spark, sf_dir):
    v = validate.check_email(F.get("emails", F.lit(0)), 254)
    return people(spark, sf_dir).select("rec_id", v.alias("x")).select("rec_id", F.col("x.value").alias("email"), F.col("x.rejection.reason").alias("reason"))


def validate_phones(spark, sf_dir):
    v = validate.check_phone(F.get("phones", F.lit(0)), "IN")
    return people(spark, sf_dir).select("rec_id", v.alias("x")).select("rec_id", F.col("x.value").alias("phone"), F.col("x.rejection.reason_code").alias("code"))


def rejection_summary(spark, sf_dir):
    return validate.rejection_rows(valid_people(spark, sf_dir)).groupBy("field", "reason_code", "reason").agg(F.count("*").alias("n"))


def validate_experience_dates(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    end = F.when(F.col("o_orderkey") % 4 == 0, "Present").when(F.col("o_orderkey") % 4 == 1, "2099").otherwise(F.date_format("o_orderdate", "MM/yyyy"))
    start = F.when(F.col("o_orderkey") % 5 == 0, "soon").when(F.col("o_orderkey") % 5 == 1, "1820").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    none = F.lit(None).cast("string")
    e = F.struct(none.alias("company"), none.alias("title"), start.alias("start"), end.alias("end"), none.alias("summary"))
    v = o.select("o_orderkey", validate.check_experience(e, 1950, 2030).alias("x"))
    return v.select("o_orderkey", F.col("x.value.start").alias("start"), F.col("x.value.end").alias("end"), F.col("x.rejection.field").alias("field"), F.col("x.rejection.reason").alias("reason"))


def match_pairs_email(spark, sf_dir):
    return match.key_pairs(valid_people(spark, sf_dir), "emails")


def match_pairs_phone(spark, sf_dir):
    return match.key_pairs(valid_people(spark, sf_dir), "phones")


def match_scored(spark, sf_dir):
    p = valid_people(spark, sf_dir)
    s = match.score_pairs(p, match.key_pairs(p, "emails").unionAll(match.key_pairs(p, "phones")).distinct(), CFG, names=False)
    return s.select("a", "b", F.col("score").cast("decimal(5,2)").alias("score"), "decision", F.array_join("match_keys", ",").alias("keys"))


def fuzzy_name_score(spark, sf_dir):
    """Scores with names and companies. No SQL form."""
    p = valid_people(spark, sf_dir)
    s = match.score_pairs(p, match.key_pairs(p, "emails"), CFG)
    return s.select("a", "b", F.col("name_company").cast("decimal(9,6)").alias("name_company"), F.col("score").cast("decimal(9,6)").alias("score"))


def cluster_components(spark, sf_dir):
    return match.clusters(written(valid_people(spark, sf_dir), "people"), CFG)


def cluster_sizes(spark, sf_dir):
    return cluster_components(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("clusters"))


def cluster_match_metrics(spark, sf_dir):
    p = written(valid_people(spark, sf_dir), "people")
    c = match.clusters(p, CFG)
    s = match.score_pairs(p, match.key_pairs(p, "emails").unionAll(match.key_pairs(p, "phones")).distinct(), CFG, names=False)
    per = s.join(c, F.col("a") == F.col("rec_id")).groupBy("cluster_id").agg(F.max("score").cast("decimal(5,2)").alias("score"), F.count("*").alias("pairs"), F.array_join(F.array_sort(F.collect_set(F.array_join("match_keys", "+"))), ",").alias("keys"))
    return per


def phone_identity_mismatch(spark, sf_dir):
    """Pairs with a common number, no common address and names without a common word."""
    p = valid_people(spark, sf_dir).select("rec_id", "emails", F.split(text.name_key(F.col("full_name")), " ").alias("w"))
    pairs = match.key_pairs(valid_people(spark, sf_dir), "phones")
    x, y = p.select(F.col("rec_id").alias("a"), F.col("emails").alias("ea"), F.col("w").alias("wa")), p.select(F.col("rec_id").alias("b"), F.col("emails").alias("eb"), F.col("w").alias("wb"))
    j = pairs.join(x, "a").join(y, "b")
    return j.select("a", "b", (~F.arrays_overlap("ea", "eb")).alias("apart"), F.size(F.array_intersect("wa", "wb")).cast("long").alias("common_words"))


def _gathered(spark, sf_dir, columns):
    p = written(valid_people(spark, sf_dir), "people")
    return fuse.gathered(p, match.clusters(p, CFG), ["source", *columns])


def resolve_scalar_priority(spark, sf_dir):
    g = _gathered(spark, sf_dir, ["full_name"]).withColumn("v", fuse.scalar_values("recs", "full_name"))
    g = g.withColumn("s", fuse.scalar("v", CFG))
    return g.select("cluster_id", F.col("s.winner.value").alias("full_name"), F.col("s.winner.source").alias("source"), F.col("s.agree").alias("agree"))


def union_emails(spark, sf_dir):
    g = _gathered(spark, sf_dir, ["emails"]).withColumn("v", fuse.list_values("recs", "emails"))
    return g.select("cluster_id", F.array_join(fuse.union("v", CFG), ",").alias("emails"))


def union_phones(spark, sf_dir):
    g = _gathered(spark, sf_dir, ["phones"]).withColumn("v", fuse.list_values("recs", "phones"))
    return g.select("cluster_id", F.array_join(fuse.union("v", CFG), ",").alias("phones"))


def union_skills(spark, sf_dir):
    g = _gathered(spark, sf_dir, ["skills"]).withColumn("v", fuse.list_values("recs", "skills"))
    return g.select("cluster_id", F.explode(fuse.skills("v", CFG)).alias("x")).select("cluster_id", "x.name", F.col("x.confidence").cast("decimal(5,4)").alias("confidence"), F.array_join(F.array_sort("x.sources"), ",").alias("sources"))


def merge_experience(spark, sf_dir):
    g = _jobs(spark, sf_dir).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rec_id", "source", "experience"))).alias("recs"))
    return g.select("cluster_id", F.explode(fuse.merged("recs", "experience", CFG)).alias("x")).select("cluster_id", "x.company", "x.title", "x.start", "x.end", "x.summary", F.array_join(F.array_sort("x.sources"), ",").alias("sources"))


def first_non_null_links(spark, sf_dir):
    g = _gathered(spark, sf_dir, ["linkedin", "years_experience"])
    return g.select("cluster_id", fuse.first_of("recs", "linkedin").alias("linkedin"), fuse.first_of("recs", "years_experience", "double").cast("decimal(6,1)").alias("years"))


def field_confidence(spark, sf_dir):
    rows = [(k, float(v)) for k, (v, _) in score.confidence_table(CFG).items() if not k.startswith("?")]
    return spark.createDataFrame(rows, "key string, confidence double").select("key", F.col("confidence").cast("decimal(5,4)").alias("confidence"))


def candidate_id(spark, sf_dir):
    p = valid_people(spark, sf_dir).where(F.size("emails") > 0)
    return p.select("rec_id", score.candidate_id(F.get("emails", F.lit(0)), F.col("source_file"), F.col("rec_id")).alias("candidate_id"))


def version_numbering(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return versions.numbered(o, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", F.col("version").cast("long").alias("version"))


def _profiles(spark, sf_dir):
    """Every query that fuses whole profiles goes through the engine."""
    return Engine(spark, CFG, as_of_year=2026).run(people(spark, sf_dir))


def resolve_people(spark, sf_dir):
    p = _profiles(spark, sf_dir).profiles
    return p.select("cluster_id", "candidate_id", "full_name", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), F.size("skills").cast("long").alias("n_skills"), F.col("data_quality_score").cast("decimal(5,4)").alias("quality"), F.col("n_records").cast("long").alias("n_records"))


def quality_score(spark, sf_dir):
    p = _profiles(spark, sf_dir).profiles
    return p.select("cluster_id", F.col("data_quality_score").cast("decimal(5,4)").alias("quality"), F.array_join(F.concat("data_quality_breakdown.required_missing", "data_quality_breakdown.important_missing"), ",").alias("missing"))


def review_status(spark, sf_dir):
    p = _profiles(spark, sf_dir).profiles
    return p.select("cluster_id", "status", F.array_join("review_reasons", "; ").alias("reasons"), F.col("overall_confidence").cast("decimal(5,4)").alias("confidence"), F.col("match_score").cast("decimal(9,6)").alias("match_score"))


def provenance_rows(spark, sf_dir):
    p = _profiles(spark, sf_dir).profiles
    return p.select("cluster_id", F.explode("provenance").alias("x")).select("cluster_id", "x.field", "x.source", "x.method")


def conflict_rows(spark, sf_dir):
    p = _profiles(spark, sf_dir).profiles
    return p.select("cluster_id", F.explode("conflict_log").alias("x")).select("cluster_id", "x.field", "x.severity", "x.selected", "x.explanation")


def run_summary(spark, sf_dir):
    return _profiles(spark, sf_dir).summary.select("total", "validation_failures", "normalized_phones", "normalized_skills")


def _projected(spark, sf_dir, cfg):
    return project.project(_profiles(spark, sf_dir).profiles.withColumn("candidate_id", F.col("cluster_id").cast("string")), cfg)


def project_renamed(spark, sf_dir):
    cfg = ProjectionConfig((OutputField("id", "candidate_id"), OutputField("name", "full_name"), OutputField("primary_email", "emails[0]"), OutputField("call", "phones[0]", normalize="E164")))
    return _projected(spark, sf_dir, cfg)


def project_slice(spark, sf_dir):
    cfg = ProjectionConfig((OutputField("id", "candidate_id"), OutputField("rest", "emails[1:]"), OutputField("skills", "skills[].name")))
    return _projected(spark, sf_dir, cfg).select("id", F.size("rest").cast("long").alias("n_rest"), F.array_join("skills", ",").alias("skills"))


def project_omit(spark, sf_dir):
    cfg = ProjectionConfig((OutputField("name", "full_name"), OutputField("call", "phones[0]")), on_missing="omit")
    return _projected(spark, sf_dir, cfg)


def project_error(spark, sf_dir):
    cfg = ProjectionConfig((OutputField("name", "full_name"), OutputField("call", "phones[0]", required=True)), on_missing="error")
    return _projected(spark, sf_dir, cfg)


def normalize_records(spark, sf_dir):
    n = normalize(people(spark, sf_dir), CFG)
    return n.select("rec_id", "full_name", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), F.array_join("skills", ",").alias("skills"))


def severities(spark, sf_dir):
    """Addresses, numbers and dates of neighbours, classed."""
    c = spread(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    k = F.col("c_custkey")
    mail = lambda a, b: F.concat(F.lit("u"), (k % a).cast("string"), F.lit("@d"), (k % b).cast("string"), F.lit(".com"))
    phone = lambda p: F.concat(F.lit(p), F.lpad((k % 1000).cast("string"), 4, "0"), F.lit("1"))
    other = F.when(k % 3 == 0, phone("+9198765")).when(k % 3 == 1, phone("+9198766")).otherwise(F.concat(F.lit("+1415555"), F.lpad((k % 1000).cast("string"), 4, "0")))
    date = lambda a: F.concat(F.lit("20"), F.lpad((k % a).cast("string"), 2, "0"), F.lit("-0"), (k % 4 + 1).cast("string"))
    return c.select("c_custkey", score.email_severity(mail(4, 3), mail(2, 6)).alias("email"), score.phone_severity(phone("+9198765"), other).alias("phone"), score.date_severity(date(10), date(5)).alias("date"))


_FINAL = _V + _CLUSTERS + f""",
m AS (SELECT v.*, cluster_id, {_PRIO} AS prio,
  CASE skill WHEN 'js' THEN 'JavaScript' WHEN 'JS' THEN 'JavaScript' WHEN 'Python3' THEN 'Python' WHEN 'kafka' THEN 'Kafka' ELSE 'Kubernetes' END AS canon FROM valid v JOIN cl USING (rec_id))"""
_FUSED = _FINAL + """,
em AS (SELECT cluster_id, string_agg(email, ',' ORDER BY p, r) AS emails, count(*) AS n FROM (SELECT cluster_id, email, min(-prio) AS p, arg_min(rec_id, (-prio, rec_id)) AS r FROM m WHERE email IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
ph AS (SELECT cluster_id, string_agg(phone, ',' ORDER BY p, r) AS phones, count(*) AS n FROM (SELECT cluster_id, phone, min(-prio) AS p, arg_min(rec_id, (-prio, rec_id)) AS r FROM m WHERE phone IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
nm AS (SELECT cluster_id, count(DISTINCT lower(full_name)) = 1 AS agree, CASE WHEN count(DISTINCT lower(full_name)) = 1 THEN arg_min(full_name, rec_id) ELSE arg_min(full_name, (-prio, rec_id)) END AS full_name,
  CASE WHEN count(DISTINCT lower(full_name)) = 1 THEN arg_min(source, rec_id) ELSE arg_min(source, (-prio, rec_id)) END AS source, count(*) AS n_records, count(DISTINCT canon) AS n_skills, arg_min(email, rec_id) FILTER (email IS NOT NULL) AS first_email, min(rec_id) AS first_rec, arg_min(source_file, rec_id) AS first_file FROM m GROUP BY 1),
fin AS (SELECT nm.*, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones, coalesce(em.n, 0) AS ne, coalesce(ph.n, 0) AS np FROM nm LEFT JOIN em USING (cluster_id) LEFT JOIN ph USING (cluster_id))"""
_W = "WITH RECURSIVE "
_SCORED = """,
sc AS (SELECT a, b, coalesce(x.email = y.email, false) AS e, coalesce(x.phone = y.phone, false) AS p FROM pairs JOIN valid x ON a = x.rec_id JOIN valid y ON b = y.rec_id)"""

_SQL = {
    "extract_emails": r"""SELECT doc_id, array_to_string(list_transform(l, lambda x: lower(x)), ',') AS emails FROM (SELECT doc_id, list_transform(list_sort(list_distinct(list_transform(e, lambda x: [list_position(e, x)::VARCHAR, x]))), lambda y: y[2]) AS l0, list_filter(e, lambda x, i: list_position(e, x) = i) AS l
      FROM (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}') AS e FROM documents)) WHERE len(l) > 0""",
    "extract_page_links": """SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, l[i] AS link FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages))""",
    "section_lines": r"""SELECT conv_id, turn, count(*) FILTER (regexp_matches(line, '\S')) AS lines, CAST(max(length(line)) AS BIGINT) AS longest FROM (SELECT conv_id, turn, unnest(list_concat([role || ':'], string_split(text, chr(10)))) AS line FROM conversations) GROUP BY ALL""",
    "tokenize_list": """SELECT p_partkey, count(*) AS n, min(t) AS first, max(t) AS last FROM (SELECT p_partkey, trim(unnest(string_split_regex(p_name || '; ' || p_type || ';  ,', '[;,]'))) AS t FROM part) WHERE t <> '' GROUP BY 1""",
    "normalize_person_name": "WITH " + _P + r" SELECT rec_id, trim(regexp_replace(full_name, '\s+', ' ', 'g')) AS name, lower(trim(regexp_replace(full_name, '\s+', ' ', 'g'))) AS key FROM people",
    "normalize_company_key": "SELECT c_custkey AS rec_id, lower(c_mktsegment) AS company FROM customer",
    "normalize_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (0, 2, 3, 4, 5, 6) THEN strftime(o_orderdate, '%Y-%m') WHEN o_orderkey % 9 = 7 THEN NULL ELSE strftime(o_orderdate, '%Y-01') END AS month FROM orders",
    "normalize_phone_e164": """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '+9198765' || t || '1' WHEN 1 THEN '+1415555' || t WHEN 2 THEN '+44791112' || t WHEN 3 THEN '+9198765' || t || '1' WHEN 4 THEN '+919876' || t || '54' WHEN 5 THEN NULL ELSE '+1415555' || t END AS e164
      FROM (SELECT c_custkey, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS t FROM customer)""",
    "parse_location": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Town ' || CAST(c_custkey AS VARCHAR) WHEN 2 THEN 'Pune' ELSE 'A' END AS city, CASE c_custkey % 4 WHEN 2 THEN 'Nowhere' WHEN 3 THEN 'B' END AS region, CASE c_custkey % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'GB' WHEN 3 THEN 'FR' END AS country FROM customer""",
    "canonical_skill": "WITH " + _P + " SELECT rec_id, skill AS raw, CASE lower(skill) WHEN 'js' THEN 'JavaScript' WHEN 'python3' THEN 'Python' WHEN 'kafka' THEN 'Kafka' WHEN 'k8s' THEN 'Kubernetes' END AS skill FROM people",
    "validate_emails": "WITH " + _V + " SELECT rec_id, v.email, CASE WHEN v.email IS NOT NULL THEN NULL WHEN p.email LIKE '% %' THEN 'Email contains spaces' ELSE 'Email does not match expected pattern' END AS reason FROM valid v JOIN people p USING (rec_id)",
    "validate_phones": "WITH " + _V + " SELECT rec_id, v.phone, CASE WHEN v.phone IS NULL AND p.phone IS NOT NULL THEN 'INVALID_PHONE' END AS code FROM valid v JOIN people p USING (rec_id)",
    "rejection_summary": "WITH " + _V + """ SELECT field, reason_code, reason, count(*) AS n FROM (
      SELECT 'email' AS field, 'INVALID_EMAIL_FORMAT' AS reason_code, CASE WHEN p.email LIKE '% %' THEN 'Email contains spaces' ELSE 'Email does not match expected pattern' END AS reason FROM valid v JOIN people p USING (rec_id) WHERE v.email IS NULL
      UNION ALL SELECT 'phone', 'INVALID_PHONE', 'Phone number could not be parsed to E.164' FROM valid v JOIN people p USING (rec_id) WHERE v.phone IS NULL AND p.phone IS NOT NULL) GROUP BY ALL""",
    "validate_experience_dates": """WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS s, o_orderkey % 4 AS e, strftime(o_orderdate, '%Y-%m') AS d FROM orders),
      r AS (SELECT *, CASE WHEN s = 0 THEN 'experience.start' WHEN s = 1 THEN 'experience.start' WHEN e = 1 THEN 'experience.end' END AS field,
        CASE WHEN s = 0 THEN 'Unparseable date in experience' WHEN s = 1 THEN 'Year 1820 out of range [1950, 2030]' WHEN e = 1 THEN 'Year 2099 out of range [1950, 2030]' END AS reason FROM t)
      SELECT o_orderkey, CASE WHEN field IS NULL THEN d END AS start, CASE WHEN field IS NULL AND e <> 0 THEN d END AS "end", field, reason FROM r""",
    "match_pairs_email": "WITH " + _V + " SELECT DISTINCT a.rec_id AS a, b.rec_id AS b FROM valid a JOIN valid b ON a.email = b.email AND a.rec_id < b.rec_id",
    "match_pairs_phone": "WITH " + _V + " SELECT DISTINCT a.rec_id AS a, b.rec_id AS b FROM valid a JOIN valid b ON a.phone = b.phone AND a.rec_id < b.rec_id",
    "match_scored": "WITH " + _V + _EDGES + _SCORED + " SELECT a, b, CAST(CASE WHEN e THEN 1.0 ELSE 0.9 END AS DECIMAL(5,2)) AS score, 'MERGE' AS decision, CASE WHEN e AND p THEN 'email,phone' WHEN e THEN 'email' ELSE 'phone' END AS keys FROM sc",
    "cluster_components": _W + _V + _CLUSTERS + " SELECT rec_id, cluster_id FROM cl",
    "cluster_sizes": _W + _V + _CLUSTERS + " SELECT n, count(*) AS clusters FROM (SELECT cluster_id, count(*) AS n FROM cl GROUP BY 1) GROUP BY 1",
    "cluster_match_metrics": _W + _V + _CLUSTERS + _SCORED + " SELECT cluster_id, CAST(max(CASE WHEN e THEN 1.0 ELSE 0.9 END) AS DECIMAL(5,2)) AS score, count(*) AS pairs, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM (SELECT *, CASE WHEN e AND p THEN 'email+phone' WHEN e THEN 'email' ELSE 'phone' END AS k FROM sc) JOIN cl ON a = rec_id GROUP BY 1",
    "phone_identity_mismatch": "WITH " + _V + " SELECT a.rec_id AS a, b.rec_id AS b, coalesce(a.email <> b.email, true) AS apart, CAST(len(list_intersect(list_distinct(string_split(lower(a.full_name), ' ')), string_split(lower(b.full_name), ' '))) AS BIGINT) AS common_words FROM valid a JOIN valid b ON a.phone = b.phone AND a.rec_id < b.rec_id",
    "resolve_scalar_priority": _W + _FUSED + " SELECT cluster_id, full_name, source, agree FROM fin",
    "union_emails": _W + _FUSED + " SELECT cluster_id, emails FROM fin",
    "union_phones": _W + _FUSED + " SELECT cluster_id, phones FROM fin",
    "union_skills": _W + _FINAL + " SELECT cluster_id, canon AS name, CAST(max(CASE source WHEN 'recruiter_csv' THEN 0.95 WHEN 'ats_json' THEN 0.90 ELSE 0.70 END) AS DECIMAL(5,4)) AS confidence, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM m GROUP BY 1, 2",
    "merge_experience": """WITH j AS (SELECT o_custkey AS cluster_id, o_orderkey AS r, CASE WHEN o_orderkey % 2 = 0 THEN 'resume' ELSE 'recruiter_csv' END AS source, 'Company ' || o_orderstatus || ' Ltd.' AS company, o_orderpriority AS title, strftime(o_orderdate, '%Y') AS start,
        CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m/%Y') END AS e, CASE WHEN o_orderkey % 3 = 0 THEN 'order ' || CAST(o_orderkey AS VARCHAR) END AS s FROM orders),
      k AS (SELECT *, CASE source WHEN 'recruiter_csv' THEN 0 ELSE 1 END AS p FROM j)
      SELECT cluster_id, company, title, start, arg_min(e, (p, r)) FILTER (e IS NOT NULL) AS "end", arg_min(s, (p, r)) FILTER (s IS NOT NULL) AS summary, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM k GROUP BY cluster_id, company, title, start""",
    "first_non_null_links": _W + _FINAL + " SELECT cluster_id, arg_min(linkedin, rec_id) FILTER (linkedin IS NOT NULL) AS linkedin, CAST(arg_min(TRY_CAST(years_experience AS DOUBLE), rec_id) FILTER (TRY_CAST(years_experience AS DOUBLE) IS NOT NULL) AS DECIMAL(6,1)) AS years FROM m GROUP BY 1",
    "field_confidence": """SELECT s || '|' || m || '|' || v || '|' || a AS key, CAST(format('{:.4f}', CAST(w AS DOUBLE) * CAST(c AS DOUBLE) * CAST(x AS DOUBLE) * CAST(y AS DOUBLE)) AS DECIMAL(5,4)) AS confidence
      FROM (VALUES ('recruiter_csv', 0.95), ('ats_json', 0.90), ('resume', 0.70)) s(s, w), (VALUES ('direct', 1.0), ('regex', 0.70), ('heuristic', 0.50)) m(m, c), (VALUES ('LOW', 1.0), ('MEDIUM', 0.85), ('HIGH', 0.40)) v(v, x), (VALUES ('all_sources_agree', 1.0), ('single_source', 0.95), ('conflict_penalty', 0.80)) a(a, y)""",
    "candidate_id": "WITH " + _V + " SELECT rec_id, 'cand_' || substr(sha256(email), 1, 12) AS candidate_id FROM valid WHERE email IS NOT NULL",
    "version_numbering": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders",
    "resolve_people": _W + _FUSED + """ SELECT cluster_id, 'cand_' || substr(sha256(coalesce(first_email, first_file || '#' || CAST(first_rec AS VARCHAR))), 1, 12) AS candidate_id, full_name, emails, phones, n_skills,
      CAST(round((1 + CASE WHEN ne > 0 THEN 1 ELSE 0 END + CASE WHEN np > 0 THEN 1 ELSE 0 END) / 3.0 * 0.5 + 2 / 5.0 * 0.5, 4) AS DECIMAL(5,4)) AS quality, n_records FROM fin""",
    "quality_score": _W + _FUSED + """ SELECT cluster_id, CAST(round((1 + CASE WHEN ne > 0 THEN 1 ELSE 0 END + CASE WHEN np > 0 THEN 1 ELSE 0 END) / 3.0 * 0.5 + 2 / 5.0 * 0.5, 4) AS DECIMAL(5,4)) AS quality,
      CASE WHEN ne = 0 THEN 'emails,' ELSE '' END || CASE WHEN np = 0 THEN 'phones,' ELSE '' END || 'experience,education,headline' AS missing FROM fin""",
    "provenance_rows": _W + _FUSED + """, top AS (SELECT cluster_id, arg_min(source, (-prio, rec_id)) FILTER (email IS NOT NULL) AS es, arg_min(source, (-prio, rec_id)) FILTER (phone IS NOT NULL) AS ps FROM m GROUP BY 1)
      SELECT cluster_id, 'full_name' AS field, source, CASE source WHEN 'resume' THEN 'heuristic' ELSE 'direct' END AS method FROM fin
      UNION ALL SELECT cluster_id, 'emails', es, 'direct' FROM top WHERE es IS NOT NULL UNION ALL SELECT cluster_id, 'phones', ps, 'direct' FROM top WHERE ps IS NOT NULL""",
    "run_summary": _W + _FUSED + """ SELECT (SELECT count(*) FROM fin) AS total, (SELECT count(*) FROM valid v JOIN people p USING (rec_id) WHERE v.email IS NULL) + (SELECT count(*) FROM valid v JOIN people p USING (rec_id) WHERE v.phone IS NULL AND p.phone IS NOT NULL) AS validation_failures,
      (SELECT count(*) FROM valid WHERE phone IS NOT NULL) AS normalized_phones, (SELECT count(DISTINCT skill) FROM people) AS normalized_skills""",
    "project_renamed": _W + _FUSED + " SELECT CAST(cluster_id AS VARCHAR) AS id, full_name AS name, nullif(string_split(emails, ',')[1], '') AS primary_email, nullif(string_split(phones, ',')[1], '') AS call FROM fin",
    "project_slice": _W + _FUSED + ", sk AS (SELECT cluster_id, string_agg(canon, ',' ORDER BY r) AS skills FROM (SELECT cluster_id, canon, min(rec_id) AS r FROM m GROUP BY 1, 2) GROUP BY 1) SELECT CAST(cluster_id AS VARCHAR) AS id, greatest(ne - 1, 0) AS n_rest, skills FROM fin JOIN sk USING (cluster_id)",
    "project_error": _W + _FUSED + " SELECT CAST(cluster_id AS VARCHAR) AS candidate_id, CASE WHEN np > 0 THEN full_name END AS name, nullif(string_split(phones, ',')[1], '') AS call, CASE WHEN np = 0 THEN 'Required field ''call'' is missing' END AS error FROM fin",
    "project_omit": _W + _FUSED + """ SELECT CAST(cluster_id AS VARCHAR) AS candidate_id, '{"name":"' || full_name || '"' || CASE WHEN np > 0 THEN ',"call":"' || string_split(phones, ',')[1] || '"' ELSE '' END || '}' AS json FROM fin""",
    "normalize_records": "WITH " + _V + " SELECT rec_id, v.full_name, lower(p.email) AS emails, coalesce(v.phone, p.phone, '') AS phones, CASE lower(p.skill) WHEN 'js' THEN 'JavaScript' WHEN 'python3' THEN 'Python' WHEN 'kafka' THEN 'Kafka' WHEN 'k8s' THEN 'Kubernetes' END AS skills FROM valid v JOIN people p USING (rec_id)",
    "severities": """SELECT c_custkey, CASE WHEN c_custkey % 4 = c_custkey % 2 AND c_custkey % 3 = c_custkey % 6 THEN 'LOW' WHEN c_custkey % 4 = c_custkey % 2 OR c_custkey % 3 = c_custkey % 6 THEN 'MEDIUM' ELSE 'HIGH' END AS email,
      CASE c_custkey % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS phone, CASE WHEN c_custkey % 10 = c_custkey % 5 THEN 'LOW' ELSE 'HIGH' END AS date FROM customer""",
}

_NATIONS = "algeria DZ argentina AR brazil BR canada CA egypt EG ethiopia ET france FR germany DE india IN indonesia ID iran IR iraq IQ japan JP jordan JO kenya KE morocco MA mozambique MZ peru PE china CN romania RO saudi_arabia SA vietnam VN russia RU united_kingdom GB united_states US".split()
_SQL["normalize_country"] = "SELECT n_nationkey, CASE lower(n_name) " + " ".join(f"WHEN '{n.replace('_', ' ')}' THEN '{c}'" for n, c in zip(_NATIONS[::2], _NATIONS[1::2], strict=True)) + " END AS code FROM nation"

_QUERIES = [
    extract_emails, extract_page_links, section_lines, tokenize_list, normalize_person_name, normalize_company_key, normalize_date, normalize_phone_e164, normalize_country, parse_location,
    canonical_skill, fuzzy_skill, validate_emails, validate_phones, rejection_summary, validate_experience_dates, match_pairs_email, match_pairs_phone, match_scored, fuzzy_name_score, cluster_components, cluster_sizes,
    cluster_match_metrics, phone_identity_mismatch, resolve_scalar_priority, union_emails, union_phones, union_skills, merge_experience, first_non_null_links, field_confidence, candidate_id, version_numbering,
    resolve_people, quality_score, review_status, provenance_rows, conflict_rows, run_summary, project_renamed, project_slice, project_omit, project_error, normalize_records, severities,
]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
