"""Record linkage: candidate pairs by shared keys, weighted scores, and clusters.

Under weights with which one shared key decides, clusters need no pairs at all: every record of a key links to the key's least
record, so a key on k records costs k rows. Pairs are made only where weights call for sums of scores, or for a report.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.config import EngineConfig
from braidwork.functions.similarity import token_set, token_set_ratio
from braidwork.functions.text import company_key, name_key
from braidwork.operators.components import connected_components


def keys(records: DataFrame, column: str) -> DataFrame:
    """(rec_id, key): the distinct values of an array column."""
    return records.select("rec_id", F.explode(column).alias("key")).where((F.col("key") != "") & F.col("key").isNotNull()).distinct()


def key_pairs(records: DataFrame, column: str) -> DataFrame:
    """(a, b), a < b: all pairs that share a value of the column. Grows with the square of a key's records: for reports."""
    k = keys(records, column)
    x, y = k.select(F.col("rec_id").alias("a"), "key"), k.select(F.col("rec_id").alias("b"), "key")
    return x.join(y, "key").where("a < b").select("a", "b").distinct()


def key_stars(records: DataFrame, column: str) -> DataFrame:
    """(a, b): each record and the least record with the same value."""
    k = keys(records, column)
    least = k.groupBy("key").agg(F.min("rec_id").alias("a"))
    return k.join(least, "key").where(F.col("rec_id") != F.col("a")).select("a", F.col("rec_id").alias("b")).distinct()


def name_candidates(records: DataFrame) -> DataFrame:
    """(a, b) of records that share a token or a trigram of the name key. Approximate for names that share neither."""
    n = records.select("rec_id", name_key(F.col("full_name")).alias("n")).where("n <> ''")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("n") - 2, F.lit(1))), lambda i: F.substring("n", i, F.lit(3)))
    marked = n.withColumn("blocks", F.array_distinct(F.concat(F.split("n", " "), F.transform(grams, lambda g: F.concat(F.lit("#"), g)))))
    return key_pairs(marked, "blocks")


def score_pairs(records: DataFrame, pairs: DataFrame, cfg: EngineConfig, names: bool = True) -> DataFrame:
    """(a, b, email, phone, name_company, score, decision, match_keys) of pairs (a, b)."""
    m = cfg.matching
    side = records.select("rec_id", "emails", "phones", name_key(F.coalesce("full_name", F.lit(""))).alias("name"), company_key(F.col("current_company")).alias("company"))
    x = side.select(*[F.col(c).alias(f"{c}_a") for c in side.columns])
    y = side.select(*[F.col(c).alias(f"{c}_b") for c in side.columns])
    df = pairs.join(x, F.col("a") == F.col("rec_id_a")).join(y, F.col("b") == F.col("rec_id_b"))
    df = df.withColumn("email", F.arrays_overlap("emails_a", "emails_b").cast("double")).withColumn("phone", F.arrays_overlap("phones_a", "phones_b").cast("double"))
    df = df.fillna(0.0, ["email", "phone"])
    if names:
        both = (F.col("company_a") != "") & (F.col("company_b") != "")
        df = df.withColumn("_n", token_set_ratio("name_a", "name_b"))
        df = df.withColumn("_c", token_set_ratio(F.when(both, F.col("company_a")), F.when(both, F.col("company_b"))))
        df = df.withColumn("name_company", F.when(F.col("_n") < m.fuzzy_name_min_ratio, 0.0).when(both, F.col("_n") / 100 * (0.7 + 0.3 * F.col("_c") / 100)).otherwise(F.col("_n") / 100 * 0.7))
    else:
        df = df.withColumn("name_company", F.lit(0.0))
    score = F.least(F.lit(1.0), F.col("email") * m.email_match_weight + F.col("phone") * m.phone_match_weight + F.col("name_company") * m.name_company_match_weight)
    df = df.withColumn("score", score)
    t, low = m.merge_decision_threshold, m.merge_decision_threshold - cfg.review.flag_near_threshold_margin
    decision = F.when(F.col("score") >= t, "MERGE").when(F.col("score") >= low, "MANUAL_REVIEW").otherwise("SEPARATE")
    used = F.array_compact(F.array(F.when(F.col("email") > 0, F.lit("email")), F.when(F.col("phone") > 0, F.lit("phone")), F.when(F.col("name_company") > 0, F.lit("name_company"))))
    return df.select("a", "b", "email", "phone", "name_company", "score", decision.alias("decision"), used.alias("match_keys"))


def links(records: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(a, b): edges with the same components as all pairs that merge or await review."""
    m = cfg.matching
    least = m.merge_decision_threshold - cfg.review.flag_near_threshold_margin
    if least <= 0:
        raise ValueError("threshold minus margin must be positive: otherwise every record links to every other")
    if m.name_company_match_weight < least and min(m.email_match_weight, m.phone_match_weight) >= least:
        return key_stars(records, "emails").unionAll(key_stars(records, "phones"))
    pairs = key_pairs(records, "emails").unionAll(key_pairs(records, "phones"))
    if m.name_company_match_weight >= least:
        pairs = pairs.unionAll(name_candidates(records))
    return score_pairs(records, pairs.distinct(), cfg).where("decision <> 'SEPARATE'").select("a", "b")


def clusters(records: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(rec_id, cluster_id): cluster_id is the least rec_id of the cluster."""
    found = connected_components(links(records, cfg))
    return records.select("rec_id").join(found, F.col("rec_id") == F.col("node"), "left").select("rec_id", F.coalesce("component", "rec_id").alias("cluster_id"))


def group_metrics(cfg: EngineConfig):
    """Arrow UDF over a cluster's records: struct<score, near, keys, mismatch>, over all pairs of different records.

    Records alike in name, company, emails and phones count once (and as a pair of their own), so a group of copies stays small.
    """
    # Plain numbers, not the settings' classes, go to the workers.
    by_email, by_phone, by_name, least_ratio = (float(x) for x in (cfg.matching.email_match_weight, cfg.matching.phone_match_weight, cfg.matching.name_company_match_weight, cfg.matching.fuzzy_name_min_ratio))
    threshold = float(cfg.matching.merge_decision_threshold)
    low = threshold - cfg.review.flag_near_threshold_margin

    def pair(x, y):
        email, phone = float(not x[2].isdisjoint(y[2])), float(not x[3].isdisjoint(y[3]))
        n = token_set(x[0], y[0])
        name = 0.0
        if n >= least_ratio:
            name = n / 100 * (0.7 + 0.3 * token_set(x[1], y[1]) / 100 if x[1] and y[1] else 0.7)
        score = min(1.0, email * by_email + phone * by_phone + name * by_name)
        apart = bool(phone) and not email and x[0] != y[0] and token_set(x[0], y[0]) < 60 and set(x[0].split()).isdisjoint(y[0].split())
        return score, [k for k, v in (("email", email), ("phone", phone), ("name_company", name)) if v], apart

    def group(records):
        if len(records) == 1:
            return 1.0, False, ["single_source"], False
        seen: dict = {}
        for r in records:
            key = (r["name"] or "", r["company"] or "", frozenset(r["emails"] if r["emails"] is not None else ()), frozenset(r["phones"] if r["phones"] is not None else ()))
            seen[key] = seen.get(key, 0) + 1
        best, near, used, mismatch = 0.0, False, set(), False
        kinds = list(seen)
        for i, x in enumerate(kinds):
            for y in kinds[i if seen[x] > 1 else i + 1 :]:
                score, names, apart = pair(x, y)
                best, mismatch = max(best, score), mismatch or apart
                near = near or low <= score < threshold
                used.update(names)
        return best, near, sorted(used) or ["no_match"], mismatch

    @F.pandas_udf("score double, near boolean, keys array<string>, mismatch boolean")
    def metrics(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([group(list(r)) for r in rows], columns=["score", "near", "keys", "mismatch"])

    return metrics
