"""Quality rules as a short-circuit cascade.

Every rule computes its own measures from the words or the text, as one expression; a CASE tries the rules and computes nothing for those
behind the first that rejects. Their order is that of rejected documents per second: selectivity and cost (time to compute
the rule's own measures from text) are estimated on a sample of all partitions. The order changes the work, never the verdict. Everything
runs in the JVM, within a row: no shuffle, so neither hot sources nor copies matter.

The query has to report the base's measures of every row; there the cascade has only the other rules, on rows that the base passes.

Defined results: null text counts as empty (no words, so the base fails it); texts of any length are taken whole; ties in the order go by the
rules' own order; repeated rows give a row each; extra columns pass through ``filter_documents`` unchanged whatever their names,
and ``measure`` returns only the key besides its own; an empty table gives an empty one.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import WS, WS_RE, table, text_of
from braidwork.shared import written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are estimated, about.
SAMPLE_ROWS = 1000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(t: Column) -> Column:
    return let(F.btrim(t, F.lit(WS)), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, WS_RE)))


def word_chars(w: Column) -> Column:
    return F.length(F.concat_ws("", w)).cast("long")


def n_of(t: Column, characters: str) -> Column:
    return (F.length(t) - F.length(F.regexp_replace(t, f"[{characters}]+", ""))).cast("long")


def lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")


def n_dup(x: Column) -> Column:
    return (F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _paired(a: Column, step: int) -> Column:
    """Hashes of a[i] and a[i + step]."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))


def n_repeat_words(w: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more; windows are told apart by 64-bit hashes, made by doubling."""

    def covered(h):
        # Only documents with a repeated window sort: neighbours of equal hash repeat, and each covers up to the next one's start.
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.array_sort(F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull()))
        sizes = lambda p: F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1), i + WINDOW) - i, F.lit(WINDOW)).cast("long"))
        total = lambda p: F.aggregate(sizes(p), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, lambda s: let(twice(s), total))).otherwise(F.lit(0).cast("long"))

    one = F.transform(w, lambda x: F.xxhash64(x))
    return let(one, lambda a: let(_paired(a, 1), lambda b: let(_paired(b, 2), lambda c: let(_paired(c, 4), covered))))


#: Rejections as functions of (text, words). In the pipeline and in ``kept`` all rules hold; BASE is the contract's base.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "few_words": lambda t, w: F.size(w) < 20,
    "repeated_words": lambda t, w: 100 * n_repeat_words(w) > 30 * F.size(w),
    "many_symbols": lambda t, w: 10 * n_of(t, "#*$%&|<>") > F.size(w),
    "repeated_lines": lambda t, w: let(lines(t), lambda x: let(n_dup(x), lambda n: (n >= 3) & (10 * n > 3 * F.size(x)))),
    "word_length": lambda t, w: let(word_chars(w), lambda n: (n < 2 * F.size(w)) | (n > 15 * F.size(w))),
    "shouted": lambda t, w: 2 * n_of(t, "A-Z") > word_chars(w),
}
BASE = ("few_words", "repeated_words")


def cascade(text: Column, order: list[str], rules: dict | None = None, given: Column | None = None) -> Column:
    """Whether no rule of ``order`` rejects: rules behind the first that does are not computed. given: the words, where they are known."""
    rules = rules or RULES

    def tried(t, w):
        out = None
        for name in order:
            said = rules[name](t, w)
            out = F.when(said, False) if out is None else out.when(said, False)
        return F.lit(True) if out is None else out.otherwise(True)

    return tried(text, given) if given is not None else let(text, lambda t: let(words(t), lambda w: tried(t, w)))


def rule_order(docs: DataFrame, text: str = "text", rules: dict | None = None, rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by rejections per second, both estimated on a sample of about ``rows`` documents of all partitions.

    A rule's cost is the time to compute it from the sample's texts, less that of the words, which all share; one task, the better of two runs.
    """
    rules = rules or RULES
    n = docs.count()
    drawn = docs.select(F.col(text).alias("text"))
    sample = written(drawn.sample(min(1.0, rows / n), seed=9) if n > rows else drawn, "quality-sample").coalesce(1)

    def timed(said: Column):
        took = []
        for _ in range(2):
            began = time.perf_counter()
            hit, all_ = sample.agg(F.count_if(said), F.count("*")).first()
            took.append(time.perf_counter() - began)
        return hit, all_, min(took)

    def alone(rule):
        return let(text_of("text"), lambda t: let(words(t), lambda w: rule(t, w)))

    _, _, shared = timed(let(words(text_of("text")), lambda w: F.size(w) < 0))
    scores = {}
    for name, rule in rules.items():
        hit, all_, took = timed(alone(rule))
        scores[name] = hit / max(all_, 1) / max(took - shared, 1e-3)
    return sorted(rules, key=lambda name: -scores[name])


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row."""
    order = order or rule_order(docs, text, {name: rule for name, rule in RULES.items() if name not in BASE})
    df = docs.select(F.col(key).alias("key"), text_of(text).alias("t")).withColumn("w", words(F.col("t")))
    t, w = F.col("t"), F.col("w")
    df = df.select(
        "key", "t", "w", F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), n_of(t, "#*$%&|<>").alias("n_symbols"),
        let(lines(t), n_dup).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    rest = [name for name in order if name not in BASE]
    kept = F.when(F.col("base_failed"), False).otherwise(cascade(t, rest, given=w))
    return df.withColumn("kept", kept).drop("t", "w")


def filter_documents(docs: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    return docs.where(cascade(text_of(text), order or rule_order(docs, text)))


def op9_quality_cascade(spark, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, CAST(sum(least(coalesce(j - i, 8), 8)) AS BIGINT) AS n FROM p GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_upper > word_chars) AS kept
FROM m
"""
