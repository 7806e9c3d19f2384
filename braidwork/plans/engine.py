"""The whole plan: records -> normalised -> validated -> clustered -> fused profiles -> projected, with a summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.config import EngineConfig, ProjectionConfig
from braidwork.functions.phones import normalize_phone
from braidwork.functions.places import normalize_country, parse_location
from braidwork.functions.skills import with_skills
from braidwork.functions.text import let, person_name, trim_ws
from braidwork.operators import fuse, match, score
from braidwork.operators.project import project
from braidwork.operators.validate import rejection_rows, validate
from braidwork.schema import as_records
from braidwork.shared import written

USED = ["source", "source_file", "full_name", "headline", "current_title", "current_company", "emails", "phones", "location_raw", "linkedin", "github", "leetcode", "portfolio", "years_experience", "skills", "experience", "projects", "education"]
NOTE = "(inferred from current education — not explicitly stated on resume)"
PLACE = "struct<city:string,region:string,country:string,inferred:boolean,inference_note:string>"


def normalize(records: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Phones to E.164 where valid, addresses in lower case, single spaces in names, canonical skills; plus n_phones and mapped_skills for the summary."""
    region = cfg.validation.phone_default_region
    df = as_records(records)
    df = df.withColumn("_phones", F.transform("phones", lambda x: F.coalesce(normalize_phone(x, region), x)))
    df = df.withColumn("n_phones", F.size(F.filter(F.zip_with("phones", "_phones", lambda a, b: a != b), lambda x: x)).cast("long")).withColumn("phones", F.col("_phones")).drop("_phones")
    df = df.withColumn("emails", F.transform("emails", lambda x: F.lower(trim_ws(x)))).withColumn("full_name", person_name(F.col("full_name")))
    before = df.withColumn("_before", F.col("skills"))
    done = with_skills(before, "rec_id", "skills")
    pairs = F.filter(F.zip_with("_before", "skills", lambda a, b: F.struct(a.alias("raw"), b.alias("skill"))), lambda x: x["raw"] != x["skill"])
    return done.withColumn("mapped_skills", pairs).drop("_before")


def _inferred(education: str, as_of_year: int | None) -> Column:
    """A place from the current, else the latest, education: its location, then its field, then its institution."""
    now = F.lit(as_of_year) if as_of_year else F.year(F.current_date())
    year = lambda c: F.when(c.rlike("^[0-9]{1,9}$"), c.cast("int"))

    def ranked(e, i):
        end, start = year(e["end_year"]), year(e["start_year"])
        current = F.coalesce(end >= now, F.lit(False)) | F.coalesce((start <= now) & (end.isNull() | (end >= now)), F.lit(False))
        return F.struct((~current).alias("past"), (-F.coalesce(end, F.when(current, start), F.lit(0))).alias("rank"), i.alias("i"), end.alias("end"), e["location"].alias("location"), e["field"].alias("field"), e["institution"].alias("institution"))

    return let(F.get(F.array_sort(F.filter(F.transform(education, ranked), lambda x: ~x["past"] | x["end"].isNotNull())), F.lit(0)), _place_of)


def _place_of(best: Column) -> Column:
    school = F.coalesce(best["institution"], F.lit(""))
    tail = trim_ws(F.element_at(F.split(school, ","), -1))
    words = ("bachelor", "master", "technology", "engineering", "science")  # fixed values
    usable = school.contains(",") & (tail != "") & (F.size(F.split(tail, r"\s+")) <= 3) & ~F.lower(tail).rlike("|".join(words))
    india = F.lower(school).rlike("india|nit|iit|iiit|delhi|mumbai|bangalore|chandigarh")  # fixed values
    none = F.lit(None).cast("string")
    from_tail = F.struct(tail.alias("city"), none.alias("region"), F.when(india, normalize_country(F.lit("India"))).alias("country"))
    of = lambda c: let(parse_location(c), lambda p: F.when(p["city"].isNotNull() | p["country"].isNotNull(), p))
    commas = F.size(F.split(school, ",")) - 1
    return F.coalesce(of(best["location"]), F.when(best["field"].contains(","), of(best["field"])), F.when(commas >= 2, of(school)), F.when(usable, from_tail))


def resolve(validated: DataFrame, clusters: DataFrame, cfg: EngineConfig, as_of_year: int | None = None) -> DataFrame:
    """One profile per cluster, with its audit trail."""
    df = fuse.gathered(validated, clusters, USED)
    df = df.withColumn("_m", match.group_metrics(cfg)(F.transform("recs", lambda r: F.struct(F.lower(person_name(r["full_name"])).alias("name"), match.company_key(r["current_company"]).alias("company"), r["emails"].alias("emails"), r["phones"].alias("phones")))))
    df = df.withColumn("_names", fuse.scalar_values("recs", "full_name")).withColumn("_heads", fuse.scalar_values("recs", "headline", (("headline", None), ("current_title", "direct"))))
    df = df.withColumn("_name", fuse.scalar("_names", cfg)).withColumn("_head", fuse.scalar("_heads", cfg))
    df = df.withColumn("name_severity", score.scalar_severity(F.when(~F.col("_name.agree"), F.col("_name.winner.value")), F.col("_name.first_other")))
    df = df.withColumn("_head_severity", score.scalar_severity(F.when(~F.col("_head.agree"), F.col("_head.winner.value")), F.col("_head.first_other")))
    df = df.withColumn("_mails", fuse.list_values("recs", "emails")).withColumn("_calls", fuse.list_values("recs", "phones")).withColumn("_abilities", fuse.list_values("recs", "skills"))
    df = df.withColumn("full_name", F.col("_name.winner.value")).withColumn("headline", F.col("_head.winner.value"))
    df = df.withColumn("emails", fuse.union("_mails", cfg)).withColumn("phones", F.array_distinct(F.transform(fuse.in_priority(F.col("_calls"), cfg), lambda x: x["value"])))
    df = df.withColumn("email_severity", F.when(F.size("emails") > 1, F.when(F.size(fuse.sources_of(F.col("_mails"))) > 1, "MEDIUM").otherwise("LOW")))
    df = df.withColumn("skills", fuse.skills("_abilities", cfg))
    df = df.withColumn("experience", fuse.merged("recs", "experience", cfg)).withColumn("projects", fuse.merged("recs", "projects", cfg))
    df = df.withColumn("education", F.transform(fuse.merged("recs", "education", cfg), fuse.split_degree))
    for name in ("linkedin", "github", "leetcode", "portfolio"):
        df = df.withColumn(f"_{name}", fuse.first_of("recs", name))
    df = df.withColumn("links", F.struct(*[F.col(f"_{n}").alias(n) for n in ("linkedin", "github", "leetcode", "portfolio")], F.array().cast("array<string>").alias("other")))
    df = df.withColumn("years_experience", fuse.first_of("recs", "years_experience", "double"))
    df = df.withColumn("_said", parse_location(fuse.first_of("recs", "location_raw"))).withColumn("_guess", _inferred("education", as_of_year))
    known = F.col("_said.city").isNotNull() | F.col("_said.country").isNotNull()
    place = lambda c, guess: F.struct(F.col(f"{c}.city"), F.col(f"{c}.region"), F.col(f"{c}.country"), F.lit(guess).alias("inferred"), F.lit(NOTE if guess else None).cast("string").alias("inference_note")).cast(PLACE)
    df = df.withColumn("location", F.when(known | F.col("_guess").isNull(), place("_said", False)).otherwise(place("_guess", True)))
    df = _audited(df, cfg)
    return _scored(df, cfg)


def _audited(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Adds field_decisions, provenance and conflict_log."""
    rank = fuse.priority(cfg)
    kept = "struct<field:string,source:string,method:string,reason_code:string,reason_human:string,alternates_rejected:array<struct<value:string,source:string,severity:string>>>"
    clash = "struct<field:string,severity:string,values:array<struct<value:string,source:string>>,selected:string,reason:string,explanation:string>"

    def decided(field, s, severity):
        w = F.col(f"{s}.winner")
        several = ~F.col(f"{s}.agree")
        alone = F.size(f"{s}.ordered") == 1
        code = F.when(alone, "SINGLE_SOURCE").when(several, "HIGHER_SOURCE_PRIORITY").otherwise("NORMALIZATION_MATCH")
        said = F.when(alone, F.concat(F.lit("Only source: "), w["source"])).when(several, F.concat(F.lit("Selected from "), w["source"], F.lit(" — higher source priority"))).otherwise(F.lit("All sources agree after normalization"))
        others = F.when(several, F.transform(F.slice(F.col(f"{s}.ordered"), F.lit(2), F.size(f"{s}.ordered")), lambda x: F.struct(x["value"], x["source"], F.col(severity)))).otherwise(F.array())
        return F.when(w.isNotNull(), F.struct(F.lit(field), w["source"], w["method"], code, said, others).cast(kept))

    def united(field, values, what):
        top = F.get(fuse.in_priority(F.col(values), cfg), F.lit(0))["source"]
        return F.when(F.size(values) > 0, F.struct(F.lit(field), top, F.lit("direct"), F.lit("UNION_DEDUPE"), F.lit(what), F.array()).cast(kept))

    def conflict(field, s, values, severity):
        w, o = F.col(f"{s}.winner"), F.get(F.col(f"{s}.ordered"), F.lit(1))
        why = F.concat(w["source"], F.lit(" (priority "), rank(w["source"]).cast("string"), F.lit(") over "), o["source"], F.lit(" (priority "), rank(o["source"]).cast("string"), F.lit(")"))
        return F.when(~F.col(f"{s}.agree"), F.struct(F.lit(field), F.col(severity), F.transform(values, lambda x: F.struct(x["value"], x["source"])), w["value"], F.lit("Higher source priority"), why).cast(clash))

    mails = F.when(F.size("emails") > 1, F.struct(F.lit("emails"), F.col("email_severity"), F.col("_mails"), F.to_json("emails"), F.lit("Union of emails from all sources"), F.concat(F.lit("Retained "), F.size("emails").cast("string"), F.lit(" unique email(s); none discarded during merge"))).cast(clash))
    df = df.withColumn("field_decisions", F.array_compact(F.array(
        decided("full_name", "_name", "name_severity"), decided("headline", "_head", "_head_severity"),
        united("emails", "_mails", "Union + deduplicate across sources"), united("phones", "_calls", "E.164 normalised + deduplicated across sources"),
    )))
    df = df.withColumn("provenance", F.transform("field_decisions", lambda d: F.struct(d["field"].alias("field"), d["source"].alias("source"), d["method"].alias("method"))))
    return df.withColumn("conflict_log", F.array_compact(F.array(conflict("full_name", "_name", "_names", "name_severity"), conflict("headline", "_head", "_heads", "_head_severity"), mails)))


def _scored(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Adds confidence, quality, status, ids and the version; drops what is internal."""
    rank = fuse.priority(cfg)
    top = F.element_at(F.array_sort(F.transform("recs", lambda r, i: F.struct((-rank(r["source"])).alias("p"), i.alias("i"), r["source"].alias("source")))), 1)["source"]
    df = df.withColumn("_top", top).withColumn("sources", F.array_sort(fuse.sources_of(F.col("recs"))))
    df = df.withColumn("_agree", F.when(F.size("sources") == 1, "all_sources_agree").otherwise("single_source"))
    low = F.lit("LOW")

    def detail(field, present, value, method="direct", severity=low, agreement=None):
        c = score.confidence_of(cfg, F.col("_top"), method, severity, F.col("_agree") if agreement is None else agreement)
        return F.when(present, F.struct(F.lit(field).alias("field"), value.alias("value"), c["confidence"].alias("confidence"), c["reason"].alias("reason")))

    size = lambda c: F.size(c).cast("string")
    df = df.withColumn("confidence_details", F.array_compact(F.array(
        detail("full_name", F.col("full_name").isNotNull(), F.col("full_name"), severity=F.coalesce("name_severity", low), agreement=F.when(F.col("name_severity").isNotNull(), "conflict_penalty").otherwise(F.col("_agree"))),
        detail("headline", F.col("headline").isNotNull(), F.col("headline")),
        detail("emails", F.size("emails") > 0, F.to_json("emails"), severity=F.coalesce("email_severity", low)), detail("phones", F.size("phones") > 0, F.to_json("phones")),
        detail("skills", F.size("skills") > 0, size("skills")), detail("experience", F.size("experience") > 0, size("experience"), "heuristic"),
        detail("projects", F.size("projects") > 0, size("projects"), "heuristic"), detail("education", F.size("education") > 0, size("education"), "heuristic"),
    )))
    df = df.withColumn("overall_confidence", score.overall_confidence("confidence_details"))
    present = {c: score.filled(F.col(c)) for c in ("full_name", "headline")} | {c: F.size(c) > 0 for c in ("emails", "phones", "skills", "experience", "projects", "education")}
    present |= {"location": F.lit(True), "links": F.lit(True), "years_experience": F.col("years_experience").isNotNull()}
    df = df.withColumn("_q", score.quality(present, cfg)).withColumn("data_quality_score", F.col("_q.score")).withColumn("data_quality_breakdown", F.col("_q.breakdown"))
    df = df.withColumn("review_reasons", score.review_reasons(cfg, F.col("name_severity"), F.col("email_severity"), F.col("_m.score"), F.col("overall_confidence"), F.col("_m.mismatch"), F.col("_m.near")))
    df = df.withColumn("status", F.when(F.size("review_reasons") > 0, "manual_review").otherwise("active"))
    first_mail = F.get(F.filter(F.transform("_mails", lambda x: x["value"]), lambda x: x != ""), F.lit(0))
    df = df.withColumn("candidate_id", score.candidate_id(first_mail, F.get("recs", F.lit(0))["source_file"], F.get("recs", F.lit(0))["rec_id"]))
    df = df.withColumn("versions", F.array(F.struct(F.lit(1).alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"), F.col("sources").alias("sources"), score.snapshot_hash(F.col("full_name"), F.col("emails"), F.col("phones")).alias("snapshot_hash"))))
    df = df.withColumn("current_version", F.lit(1)).withColumn("match_score", F.col("_m.score")).withColumn("match_keys_used", F.col("_m.keys"))
    df = df.withColumn("source_files", F.transform("recs", lambda r: F.coalesce(r["source_file"], r["source"]))).withColumn("n_records", F.size("recs"))
    out = (
        "cluster_id candidate_id status review_reasons full_name emails phones location headline years_experience links skills experience projects education provenance conflict_log field_decisions "
        "confidence_details overall_confidence data_quality_score data_quality_breakdown current_version versions match_score match_keys_used source_files sources n_records"
    )
    return df.select(*out.split())


def summary(profiles: DataFrame, validated: DataFrame) -> DataFrame:
    """One row: totals, statuses, conflicts, rejections, changed phones and mapped skills."""
    p = profiles.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "manual_review").alias("manual_review"), F.lit(0).cast("long").alias("errors"),
        F.coalesce(F.sum(F.size("conflict_log")), F.lit(0)).cast("long").alias("total_conflicts"),
    )
    v = validated.agg(F.coalesce(F.sum(F.size("rejections")), F.lit(0)).cast("long").alias("validation_failures"), F.coalesce(F.sum("n_phones"), F.lit(0)).cast("long").alias("normalized_phones"))
    s = validated.select(F.explode("mapped_skills").alias("x")).distinct().agg(F.count("*").alias("normalized_skills"))
    return p.join(F.broadcast(v)).join(F.broadcast(s))  # one row each


@dataclass
class Result:
    profiles: DataFrame
    projected: DataFrame
    rejections: DataFrame
    clusters: DataFrame
    summary: DataFrame
    projection: ProjectionConfig


@dataclass
class Engine:
    """Engine(spark, cfg).run(records): every stage is a DataFrame; what several stages read is written to the shared folder once."""

    spark: SparkSession
    config: EngineConfig = field(default_factory=EngineConfig)
    projection: ProjectionConfig | None = None
    as_of_year: int | None = None

    def run(self, records: DataFrame) -> Result:
        validated = written(validate(normalize(records, self.config), self.config), "records")
        clusters = match.clusters(validated, self.config)
        profiles = written(resolve(validated, clusters, self.config, self.as_of_year), "profiles")
        shape = self.projection or ProjectionConfig.full()
        # Unsorted: only the sink that writes one file needs an order.
        return Result(profiles, project(profiles, shape), rejection_rows(validated), clusters, summary(profiles, validated), shape)

    def run_files(self, csv: str | None = None, resume_dir: str | None = None, resume_files: tuple[str, ...] = ()) -> Result:
        from braidwork.sources import csv as csv_source
        from braidwork.sources import resume
        from braidwork.sources.base import collected, safely

        parts = []
        if csv:
            parts.append(csv_source.read(self.spark, csv))
        if resume_dir:
            parts.append(safely(lambda s, p: resume.read(s, p, "*.{pdf,docx,doc,txt}"), self.spark, resume.SOURCE, resume_dir))
        parts += [safely(resume.read, self.spark, resume.SOURCE, f) for f in resume_files]
        if not parts:
            parts = [as_records(self.spark.range(0).withColumnRenamed("id", "rec_id"))]
        return self.run(collected(parts))
