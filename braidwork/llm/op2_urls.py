"""URL filter by the ratio of two character language models.

URLs on which a rule decides train two variable-order Markov models, one of accepted and one of rejected URLs, over the
characters that occur: contexts of up to ORDER characters, Witten-Bell smoothing towards the context that is a character shorter, contexts seen less
than LEAST times by a model left to the shorter one. The whole URL is modelled, scheme, query and fragment included, and its end.

The models are tables of all n-grams of all URLs, so that they grow with the corpus. The longest n-grams are counted once, combined before
the shuffle; the counts of the shorter ones are sums of these, and probabilities come level by level from the shorter n-grams by equi-joins. An URL's score
is the sum over its n-grams of their log-likelihood ratio, divided by their number: n-grams that make up more than 1 / HOT_SHARE of all are
at most HOT_SHARE and join by broadcast, the others by a shuffle in which none is hot. A fifth of the training URLs, chosen by hash, is held out: on it the
score is calibrated by a logistic fit of BINS sums at most. URLs that no rule fits are accepted if their calibrated probability is at least 1/2.

Defined results: null urls are empty; urls without "://" have empty host and path, fit no rule and are judged by their characters like any other;
ties (a probability of 1/2) are accepted; long urls are taken whole; where either class has no training URL all others are allowed; rows that
repeat give a row each; an empty table gives an empty one; extra columns pass through ``judge``, but for its own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import table, unused
from braidwork.shared import written

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
ORDER, LEAST, BINS, HOT_SHARE = 5, 3, 400, 1000
HELD_OUT = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands before the first character and after the last.
PAD = "\x00"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(u, pattern, 2))


def with_rule(df: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Adds rule, the longest that fits host and path, and ruled, its verdict."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        host, slash, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + rest))
        name = F.when(fits, rule) if name is None else F.when(fits, rule).otherwise(name)
        verdict = F.when(fits, rules[rule]) if verdict is None else F.when(fits, rules[rule]).otherwise(verdict)
    return df.withColumn("rule", name).withColumn("ruled", verdict)


def grams(said: Column) -> Column:
    """All (ORDER + 1)-grams of the padded text, one for each character and one for the end."""
    padded = F.concat(F.lit(PAD * ORDER), said, F.lit(PAD))
    return F.transform(F.sequence(F.lit(1), F.length(said) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def _estimated(counts: DataFrame, shorter: DataFrame | None, n: int, symbols: int) -> DataFrame:
    """(gram, n, p1, p0) of the n-grams: Witten-Bell over the context's counts; shorter has those of the (n - 1)-grams."""
    context = F.substring("gram", 1, n - 1)
    per = counts.groupBy(context.alias("context")).agg(*[f(f"n{k}").alias(f"{name}{k}") for k in (1, 0) for name, f in (("all", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0)))])
    df = counts.withColumn("context", context).join(per, "context")
    if shorter is None:
        df = df.withColumns({f"q{k}": F.lit(1.0 / symbols) for k in (1, 0)})
    else:
        df = df.withColumn("_rest", F.substring("gram", 2, n - 1)).join(shorter.select(F.col("gram").alias("_rest"), F.col("p1").alias("q1"), F.col("p0").alias("q0")), "_rest")
    p = lambda k: F.when(F.col(f"all{k}") >= LEAST, (F.col(f"n{k}") + F.col(f"kinds{k}") * F.col(f"q{k}")) / (F.col(f"all{k}") + F.col(f"kinds{k}"))).otherwise(F.col(f"q{k}"))
    return df.select("gram", "n", p(1).alias("p1"), p(0).alias("p0"))


def ratios(urls: DataFrame) -> DataFrame | None:
    """(gram, n, d): log-likelihood of accepted minus rejected of every gram of urls (said, accepted; accepted is null outside of the training); n counts it in all of them."""
    one = lambda k: F.sum(F.when(F.col("accepted") == F.lit(bool(k)), 1).otherwise(0)).alias(f"n{k}")
    longest = urls.select("accepted", F.explode(grams(F.col("said"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), one(1), one(0))
    levels = [written(longest, "url-grams")]
    for n in range(ORDER, 0, -1):
        levels.append(levels[-1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(*[F.sum(c).alias(c) for c in ("n", "n1", "n0")]))
    seen = levels[0].agg(F.sum("n1"), F.sum("n0"), F.count_distinct(F.substring("gram", ORDER + 1, 1))).first()
    if not seen[0] or not seen[1]:
        return None
    made = None
    for n, counts in enumerate(reversed(levels), 1):
        made = _estimated(counts, made, n, seen[2])
    return written(made.select("gram", "n", (F.log("p1") - F.log("p0")).alias("d")), "url-ratios")


def scores(urls: DataFrame, table_: DataFrame) -> DataFrame:
    """(url, score): the mean of d over the grams of said, for distinct (url, said)."""
    each = urls.select("url", F.explode(grams(F.col("said"))).alias("gram"))
    whole = table_.agg(F.sum("n")).first()[0] or 0
    hot = table_.where(F.col("n") * HOT_SHARE > whole).select("gram", F.col("d").alias("_d"))  # HOT_SHARE rows at most
    each = each.join(F.broadcast(hot), "gram", "left")
    known = each.where(F.col("_d").isNotNull()).select("url", F.col("_d").alias("d"))
    rest = each.where(F.col("_d").isNull()).select("url", "gram").join(table_.where(F.col("n") * HOT_SHARE <= whole).select("gram", "d"), "gram").select("url", "d")
    return known.groupBy("url").agg(F.sum("d").alias("d"), F.count("*").alias("n")).unionAll(rest.groupBy("url").agg(F.sum("d").alias("d"), F.count("*").alias("n"))).groupBy("url").agg((F.sum("d") / F.sum("n")).alias("score"))


def calibrate(rows: list[tuple[float, bool, int]]) -> tuple[float, float]:
    """(a, b) of p(accepted) = 1 / (1 + exp(-(a * score + b))), both classes weighing the same."""
    import numpy as np

    x, y, n = (np.array(c, float) for c in zip(*rows, strict=True))
    if not (y > 0).any() or not (y < 1).any():
        return 1.0, 0.0
    n = np.where(y > 0, n / n[y > 0].sum(), n / n[y < 1].sum())
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton with a ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(n * (p - y) * x).sum() + 1e-3 * a, (n * (p - y)).sum()])
        v = n * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(a), float(b)


def judge(pages: DataFrame, url: str = "url", rules: dict[str, str] = RULES) -> DataFrame:
    """pages' columns plus host, path, rule, verdict and probability."""
    given = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "probability")]
    pages = pages.select(*[F.col(f"`{c}`") for c in given])
    ruled, at = unused(pages, "url_ruled"), unused(pages, "url_key")
    df = with_rule(with_parts(pages, url), rules).withColumnRenamed("ruled", ruled)
    # Copies count as often as they occur in the models, but are scored once.
    said = F.coalesce(F.col(url), F.lit(""))
    seen = df.select(said.alias("said"), (F.col(ruled) == "allow").alias("allowed"))
    held = F.pmod(F.xxhash64("said"), F.lit(HELD_OUT)) == 0
    seen = seen.withColumn("accepted", F.when(~held, F.col("allowed")))
    found = ratios(seen)
    if found is None:
        return df.withColumn("probability", F.lit(1.0)).withColumn("verdict", F.coalesce(ruled, F.lit("allow"))).drop(ruled)
    once = seen.groupBy("said").agg(F.any_value("allowed").alias("allowed"), F.count("*").alias("copies")).withColumn("url", F.xxhash64("said"))
    once = written(once, "url-texts")
    scored = written(scores(once, found), "url-scores")
    step = F.round(F.least(F.greatest("score", F.lit(-4.0)), F.lit(4.0)) * (BINS / 8)) / (BINS / 8)
    bins = once.where(held & F.col("allowed").isNotNull()).join(scored, "url").groupBy(step.alias("x"), "allowed").agg(F.sum("copies")).collect()
    a, b = calibrate([(r[0], r[1], r[2]) for r in bins]) if bins else (1.0, 0.0)
    chance = once.join(scored, "url").select(F.col("said").alias(at), (1 / (1 + F.exp(-(F.col("score") * a + b)))).alias("probability"))
    out = df.join(chance, said == F.col(at)).drop(at)
    return out.withColumn("verdict", F.coalesce(ruled, F.when(F.col("probability") >= 0.5, "allow").otherwise("block"))).drop(ruled)


def op2_url_models(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
