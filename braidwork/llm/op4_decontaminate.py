"""Benchmark decontamination by winnowing.

Of each text the least k-gram hash in every window of w consecutive k-grams is kept: any shared span of
k + w - 1 words keeps a common fingerprint. With k = 5 and w = 4 no shared window of 8 words is missed; for items
shorter than 8 words, windows of each such length n take k = max(1, n - 3) and w = n - k + 1, so the guarantee holds
there as well. Fingerprints of the documents join those of the benchmark; hits are then extended: in the documents hit, the item windows are compared word
by word (the words themselves, not hashes), and all words inside an occurrence count.

Only documents with a common fingerprint are opened a second time. What is broadcast is counted first, rows and characters (BROADCAST_ROWS,
BROADCAST_CHARS), beyond that Spark shuffles both sides; a passage in many documents spreads over the documents' own keys; the fingerprints of a
document are combined before the shuffle. A document is told apart by its id and a hash of its text.

Defined results: null text and null items have no words; every row of documents is a document of its own, rows that repeat an id or a text, too; rows that
repeat an item_id are one item; null doc_ids are documents like others, null item_ids one item that is not listed; texts of any length are taken whole; empty tables
give an empty table or clean documents; other columns, whatever their names, are dropped by ``hits`` and kept by ``remove_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import table, text_of, unused, with_gram_hashes, zipped
from braidwork.shared import written

WINDOW = 8
#: Broadcast are so many rows, and so many bytes of strings in them, at most.
BROADCAST_ROWS, BROADCAST_CHARS = 1_000_000, 16_000_000
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """Words of a text that is lower case already; split() leaves an empty string at either end only."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is counted to be within the bounds. df is read for that: give a written table."""
    sizes = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    rows, *chars = df.agg(F.count("*"), *sizes).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and sum(chars) <= BROADCAST_CHARS else df


def winnow(df: DataFrame, words: str, n: int, out: str) -> DataFrame:
    """Adds the distinct fingerprints that guarantee every common span of n words."""
    k = max(1, n - 3)
    df = with_gram_hashes(df, words, k, "_k")
    w, have, size = n - k + 1, "_k", 1
    made = ["_k"]
    least = lambda a, b: F.least(a, b)
    while size < w:
        step = min(size, w - size)
        df = df.withColumn(f"_m{size + step}", zipped(have, have, step, least))
        have, size = f"_m{size + step}", size + step
        made.append(have)
    return df.withColumn(out, F.array_distinct(have)).drop(*made)


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, n, window): the distinct windows of each item, words joined by spaces."""
    b = benchmark.select(F.col(item).alias("item"), F.translate(text_of(text), UPPER, LOWER).alias("_t")).withColumn("_w", word_list(F.col("_t")))
    b = b.where(F.size("_w") > 0).withColumn("n", F.least(F.size("_w"), F.lit(WINDOW)))
    return b.select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("n") + 1), lambda i: F.array_join(F.slice("_w", i, F.col("n")), " "))).alias("window")).distinct()


def _row(text: str) -> Column:
    """With the id, what tells a document apart."""
    return F.xxhash64(text_of(text))


def hits(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(doc, row, n_words, n_hit, items): a row per row of docs; row is the hash of its text, items the sorted array of the ids of items that occur (null: none)."""
    windows = written(item_windows(benchmark, item), "bench-windows")
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # 8 values at most
    d = docs.select(F.col(doc).alias("doc"), _row(text).alias("row"), F.translate(text_of(text), UPPER, LOWER).alias("_t")).withColumn("_w", word_list(F.col("_t"))).drop("_t")
    b = windows.select("n", F.split("window", " ").alias("_w"))
    prints = None
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    for n in lengths:
        d = winnow(d, "_w", n, f"_f{n}")
        found = winnow(b.where(F.col("n") == n), "_w", n, "_f").select(F.explode("_f").alias("f")).distinct()
        prints = found if prints is None else prints.unionByName(found).distinct()
    if prints is None:
        return d.select("doc", "row", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    prints = written(prints.withColumn("hit", F.lit(True)), "bench-prints")
    d = d.select("doc", "row", "n_words", F.posexplode_outer(F.flatten(F.array(*[F.col(f"_f{n}") for n in lengths]))).alias("_i", "f"))
    # Rows equal in id and text are counted here and given back at the end.
    seen = d.join(_small(prints), "f", "left").groupBy("doc", "row").agg(F.max("n_words").alias("n_words"), F.count_if(F.coalesce("_i", F.lit(0)) == 0).alias("copies"), F.coalesce(F.max("hit"), F.lit(False)).alias("hit"))
    seen = written(seen, "winnow-docs")
    # Extension of the hits, on the documents that have some.
    ids = _small(seen.where("hit").select(F.col("doc").alias("_doc"), F.col("row").alias("_row")))
    open_ = docs.select(F.col(doc).alias("doc"), _row(text).alias("row"), F.col(text).alias("_text")).join(ids, (F.col("row") == F.col("_row")) & F.col("doc").eqNullSafe(F.col("_doc")), "left_semi")
    open_ = open_.select("doc", "row", F.translate(text_of("_text"), UPPER, LOWER).alias("_t")).withColumn("_w", word_list(F.col("_t"))).drop("_t")

    def windows_of(n):
        place = lambda i: F.struct(i.alias("i"), F.lit(n).alias("n"), F.array_join(F.slice("_w", i, n), " ").alias("window"))
        return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1))), place), lambda x: F.size("_w") >= n)

    wide = F.flatten(F.array(*map(windows_of, lengths)))
    at = open_.select("doc", "row", F.explode(wide).alias("x")).select("doc", "row", "x.i", "x.n", "x.window")
    keys = written(windows.select("n", "window").distinct(), "bench-keys")
    at = written(at.join(_small(keys), ["n", "window"], "left_semi"), "bench-hits")
    spans = at.groupBy("doc", "row").agg(F.array_sort(F.collect_set(F.struct("i", "n"))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))

    def add(acc, x):
        end = (x["i"] + x["n"]).cast("long")
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["sum"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], x["i"].cast("long")))).alias("sum"))

    spans = spans.select("doc", "row", F.aggregate("s", start, add)["sum"].alias("n_hit"))
    items = at.select("doc", "row", "n", "window").distinct().join(windows, ["n", "window"]).groupBy("doc", "row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    found = spans.join(items, (spans["row"] == items["row"]) & spans["doc"].eqNullSafe(items["doc"])).select(spans["doc"].alias("_doc"), spans["row"].alias("_row"), "n_hit", "items")
    out = seen.join(found, (seen["row"] == found["_row"]) & seen["doc"].eqNullSafe(found["_doc"]), "left")
    out = out.select("doc", "row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "items", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_i"))
    return out.drop("_i")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, least_items: int = 1, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents in which windows of at least ``least_items`` items occur."""
    id_, row = unused(docs, "bad_doc"), unused(docs, "bad_row")
    bad = hits(docs, benchmark, doc, text).where(F.size("items") >= least_items).select(F.col("doc").alias(id_), F.col("row").alias(row)).distinct()
    return docs.join(_small(written(bad, "bench-bad")), (_row(text) == F.col(row)) & docs[doc].eqNullSafe(F.col(id_)), "left_anti")


def op4_winnowing(spark, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n = F.size(items).cast("long")
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 8) AS n, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, ns WHERE len(w) >= n)),
h AS (SELECT r, n, i, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM t LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
