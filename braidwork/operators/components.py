"""Connected components of an undirected graph by alternating large-star and small-star (Kiveris et al., SoCC 2014).

Rounds grow with the logarithm of the number of vertices, not with the length of chains. Hot vertices are
harmless: each round is a minimum per key (combined before the shuffle) and an equi-join that AQE may split.
Every round is written to the shared folder, so that lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.shared import written

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v). Links the neighbours v (large: v > u, else v <= u) of each u to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node on an edge; component is the least node reachable.

    Rows with a null end and loops are dropped; repeated edges count once; no edges give no rows.
    """
    kind = edges.schema[a].dataType
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    loops = e.where(F.col("u") == F.col("v"))
    e = e.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "cc-edges")
    state = None
    for _ in range(MAX_ROUNDS):
        grown = _star(_both(e), True)
        small = grown.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = written(_star(small, False), "cc-round")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    single = loops.select(F.col("u").cast(kind).alias("node"), F.col("u").cast(kind).alias("component")).distinct()
    found = leaves.unionAll(roots.join(leaves, "node", "left_anti"))
    return found.unionAll(single.join(found, "node", "left_anti"))
