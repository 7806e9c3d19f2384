"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected copies, target / source size. Documents stand in the order of
(source, size, id); a document at place k of its source is emitted once for each integer that lies in
(u + k * rate, u + (k + 1) * rate], u being the source's own offset in [0, 1). As neighbours are of like size, the
words taken come near the target, and no document is emitted more often than its rate, at most 2, rounded up.

The place within a source is a prefix count over a range-partitioned table: row numbers within partitions plus the
counts of the partitions before. So a source that holds most rows is spread over many tasks, and what the driver or
a single task sees is one row per source and partition. The small (id, source, size) table is written once to the
shared folder, so texts are read once and lost executors do not change the order.

Defined results: null text has size 0; null source is a source of its own, the last; rows that repeat an id (null or not) are
documents of their own, in the order of a hash of the whole row; equal rows stand side by side, each with its own place; ties between sizes
go by id, null first, then by this hash; texts of any length count whole; a source whose documents are all empty has target 0 and is not
taken; an empty table gives an empty one; other columns, whatever their names, pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.common import table, text_of, unused, with_words
from braidwork.shared import written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """(source, source_size, n, target, offset): a row per source, by filling up: capped sources leave the rest by weight."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # In the order of cap / weight a prefix is capped: with the first i capped, the level of the rest is (all - caps) / weights.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    per = per.withColumn("_all", F.lit(float(share)) * F.sum("source_size").over(whole)).withColumn("_w", F.sum("weight").over(whole))
    per = per.withColumn("_caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("_used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("_capped", F.col("weight") * (F.col("_all") - F.col("_caps")) / (F.col("_w") - F.col("_used")) > F.col("cap"))
    per = per.withColumn("_rest", F.sum(F.when(F.col("_capped"), F.col("cap")).otherwise(0.0)).over(whole))
    per = per.withColumn("_left", F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("weight"))).over(whole))
    target = F.when(F.col("_capped"), F.col("cap")).otherwise(F.col("weight") * (F.col("_all") - F.col("_rest")) / F.col("_left"))
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("")))), 1, 8)
    offset = F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)
    return per.select("source", "source_size", "n", target.alias("target"), offset.alias("offset"))


def copies(sizes: DataFrame, **options) -> DataFrame:
    """sizes (key, source, size and, where keys repeat, row) with source_size, target and copies. sizes is read more than once: give a written table."""
    goals = targets(sizes, **options).withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), "size", "key", *[c for c in ("row",) if c in sizes.columns]]
    ordered = sizes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "mix-order")
    cells = ordered.groupBy("source", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    upto = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    cells = cells.join(goals, cells["source"].eqNullSafe(goals["source"])).select(cells["source"].alias("_source"), F.col("_part").alias("_cell"), "_first", "_before", "source_size", "target", "_rate", "offset")
    # A row per source and partition; each partition starts with the source that the one before ends with.
    found = ordered.join(cells, ordered["source"].eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_cell")))
    place = F.col("_at") - F.col("_first") + F.col("_before")
    taken = F.floor(F.col("offset") + F.col("_rate") * (place + 1)) - F.floor(F.col("offset") + F.col("_rate") * place)
    return found.select(*sizes.columns, "source_size", "target", taken.cast("long").alias("copies"))


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return with_words(docs.withColumn("_t", text_of(text)), "_t", "_w").withColumn("size", F.size("_w").cast("long")).drop("_t", "_w")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """docs, each row as often as the mix takes it. Rows are told apart by their whole content; what the mix takes of equal rows is given to one of them."""
    own, times, nth = (unused(docs, c) for c in ("mix_row", "mix_copies", "mix_nth"))
    # Sources and sizes need not be hashed; maps have no hash and go as JSON.
    hashed = [F.to_json(F.col(f"`{c}`")) if kind.startswith("map") or "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    rows = docs.withColumn(own, F.xxhash64(*hashed))
    sizes = rows.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("_text"), F.col(own).alias("row"))
    sizes = written(with_sizes(sizes, "_text").select("key", "source", "size", "row"), "mix-sizes")
    took = copies(sizes, **options).groupBy(F.col("row").alias("_row")).agg(F.sum("copies").alias(times), F.count("*").alias("_rows")).where(F.col(times) > 0)
    took = written(took, "mix-copies")
    # The same join at every size: the table of copies grows with the corpus.
    found = rows.join(took.where("_rows = 1").drop("_rows").hint("merge"), F.col(own) == F.col("_row")).drop("_row")
    again = took.where("_rows > 1").drop("_rows")
    if again.limit(1).count():
        # Equal rows: combined before the shuffle, so that a hot one costs a row per task.
        one = rows.join(again.select("_row"), F.col(own) == F.col("_row"), "left_semi").dropDuplicates([own])
        found = found.unionByName(one.join(again, F.col(own) == F.col("_row")).drop("_row"))
    return found.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_systematic_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", "text")
    sizes = written(with_sizes(docs).select("key", "source", "size"), "mix-sizes")
    found = copies(sizes)
    return found.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS alls, sum(weight) OVER () AS ws,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
  coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM w),
c AS (SELECT *, weight * (alls - caps) / (ws - used) > cap AS capped FROM o),
r AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS rest, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS remaining FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * (alls - rest) / remaining END AS target,
  CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM r),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(u + rate * k) - floor(u + rate * (k - 1))) * size AS BIGINT) AS taken FROM p
"""
