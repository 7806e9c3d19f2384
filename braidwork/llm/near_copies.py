"""Near copies by the Jaccard similarity of the sets of five-word shingles, 0.8 or more.

Candidates come of SimHash covering first: the 64-bit fingerprints of the shingle sets under the 2^(RADIUS + 1) - 1 masks of ``op6_simhash``, so
that no pair within RADIUS bits is missed. At 0.8 the fingerprints of half the pairs differ by ten bits or more, beyond what a covering
reaches; those pairs share a band of ROWS MinHash values in one of BANDS (at 0.8 missed with probability 3e-5, at 0.9 with 1e-9). Only bands
with nodes that the covering's links have not yet joined are looked at. Each
candidate is decided by its exact similarity. Texts with equal sets fold into one node first. The nodes of
the buckets' connected components are read in a worker and walked breadth-first: a node claims all unclaimed ones within
the similarity, so a dense group costs little more than linear time and m nodes give at most m - 1 links. Components of more
than SPLIT nodes are walked bucket by bucket instead, buckets with the same nodes once. Every pair that shares a bucket is
compared, or its ends are joined through others.

Defined results: words are runs of non-white characters, A-Z lower; shingles and sets are told apart by 64-bit hashes; a text of
fewer than five words is one shingle, null or blank text an empty one, so that such texts are near copies where their words
are equal. Of a component one row stays: the least id, null ids last; of different rows that repeat this id, the least by digest; of equal rows, one.
Rows of different components stay, whatever their ids.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import unused
from braidwork.llm.op6_simhash import masks
from braidwork.operators.components import connected_components
from braidwork.shared import written

SHINGLE, SIMILARITY = 5, (4, 5)
#: Bits by which fingerprints differ that the covering links, through 63 tables.
RADIUS = 5
BANDS, ROWS = 20, 4
SPLIT = 2_000


def _sets():
    """A function from text to the sorted array of the hashes of its shingles."""
    import numpy as np
    import xxhash

    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    digest, known = xxhash.xxh64_intdigest, {}

    def one(text):
        words = (text or "").encode().translate(lower).split()
        if len(known) > 200_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = digest(w)
        if len(words) < SHINGLE:
            return np.array([digest(b" ".join(words), 1)], np.uint64)
        one = np.array([known[w] for w in words], np.uint64)
        n = len(one) - SHINGLE + 1
        h = np.full(n, SHINGLE, np.uint64)
        for k in range(SHINGLE):
            h = _mixed(h ^ one[k : n + k])
        return np.unique(h)

    return one


def _mixed(h):
    """A bijection of unsigned 64-bit integers, so that equal shingles only come of equal words or colliding hashes."""
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _prints(batches):
    """Rows (row, key, text) to (row, key, node, fp, bands)."""
    import numpy as np
    import xxhash

    rng = np.random.default_rng(5)
    odd = rng.integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
    add = rng.integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
    shingles = _sets()
    for batch in batches:
        nodes, fps, bands = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, BANDS), np.int64)
        for i, text in enumerate(batch.column(2)):
            s = shingles(text.as_py())
            nodes[i] = np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)
            ones = np.zeros(64, np.int64)
            for k in range(0, len(s), 65536):
                ones += np.unpackbits(s[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            fps[i] = np.packbits(ones * 2 > len(s)).view(np.int64)[0]
            least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
            for k in range(0, len(s), 1024):
                np.minimum(least, (s[k : k + 1024] * odd + add).min(axis=1), out=least)
            h = np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                h = _mixed(h ^ least[r::ROWS])
            bands[i] = h.view(np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes), pa.array(fps), flat], names=["row", "key", "node", "fp", "bands"])


def walk(nodes, sets):
    """Links (from, to) that join all nodes whose sets have the similarity; at most len(nodes) - 1."""
    import numpy as np

    over, under = SIMILARITY
    size = np.array([len(s) for s in sets], np.int64)
    names, local = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(size)))
    marked = np.zeros(len(names), bool)
    order = np.argsort(nodes, kind="stable")
    left, a, b = order, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            fits = left[(size[left] * under >= over * size[x]) & (size[x] * under >= over * size[left])]
            if not len(fits):
                continue
            marked[local[starts[x] : starts[x + 1]]] = True
            common = np.array([np.count_nonzero(marked[local[starts[y] : starts[y + 1]]]) for y in fits.tolist()], np.int64)
            marked[local[starts[x] : starts[x + 1]]] = False
            got = fits[under * common >= over * (size[x] + size[fits] - common)]
            if len(got):
                a += [nodes[x]] * len(got)
                b += [nodes[y] for y in got.tolist()]
                queue.extend(got.tolist())
                left = left[~np.isin(left, got)]
    return a, b


def _links(batches):
    """Rows (kind, part, node, text) sorted by (kind, part): one part after another."""
    shingles = _sets()
    last, nodes, sets = None, [], []

    def flush():
        a, b = walk(nodes, sets) if len(nodes) > 1 else ([], [])
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for kind, part, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (kind, part) != last and nodes:
                yield flush()
                nodes, sets = [], []
            last = (kind, part)
            nodes.append(node)
            sets.append(shingles(text))
    if nodes:
        yield flush()


def with_row(docs: DataFrame) -> DataFrame:
    """Adds _row, a digest of the whole row."""
    return docs.withColumn("_row", F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"}))))


def _parts(members: DataFrame, split: int) -> DataFrame:
    """(kind, part, node): what is walked together. members: (bucket, node), buckets of two nodes or more."""
    stars = members.join(members.groupBy("bucket").agg(F.min("node").alias("first")), "bucket").where("node <> first")
    loose = written(connected_components(stars.select("first", "node").distinct(), "first", "node"), "copies-loose")
    sizes = written(loose.groupBy("component").agg(F.count("*").alias("n")), "copies-sizes")
    parts = loose.join(sizes.where(F.col("n") <= split), "component").select(F.lit(0).alias("kind"), F.col("component").alias("part"), "node")
    big = sizes.where(F.col("n") > split)
    if not big.limit(1).count():
        return parts
    dealt = written(members.join(loose.join(big, "component", "left_semi").select("node"), "node", "left_semi"), "copies-dealt")
    alike = dealt.groupBy("bucket").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("xor"), F.count("*").alias("n"))
    once = alike.groupBy("sum", "xor", "n").agg(F.min("bucket").alias("bucket"))
    return parts.unionAll(dealt.join(once, "bucket", "left_semi").select(F.lit(1).alias("kind"), F.col("bucket").alias("part"), "node"))


def tables(nodes: DataFrame) -> DataFrame:
    """(bucket, node, group): the buckets of the covering tables; equal fingerprints share all of them."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in sorted(set(masks(RADIUS)))]
    keys = F.array(*[F.xxhash64(F.lit(m), F.col("fp").bitwiseAND(F.lit(m))) for m in signed])
    return nodes.select(F.explode(keys).alias("bucket"), "node", "group")


def bands(nodes: DataFrame) -> DataFrame:
    """(bucket, node, group): the buckets of the MinHash bands."""
    return nodes.select(F.explode("bands").alias("bucket"), "node", "group")


def links_within(keyed: DataFrame, docs: DataFrame, nodes: DataFrame, text: str, split: int) -> DataFrame:
    """(a, b): links that connect the near copies in the buckets of keyed (bucket, node, group) that have several groups; docs has _row."""
    shared = keyed.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("bucket")
    members = written(keyed.select("node", "bucket").join(shared, "bucket", "left_semi"), "copies-buckets")
    parts = written(_parts(members, split), "copies-parts")
    wanted = nodes.join(parts.select("node").distinct(), "node", "left_semi").select("node", F.col("best.row").alias("_row"))
    # Equal rows count once: only one of them is needed, and dropDuplicates() keeps to the join's partitions.
    texts = docs.select("_row", F.col(text).alias("text")).join(wanted, "_row").dropDuplicates(["_row"]).select("node", "text")
    ready = parts.join(texts, "node").select("kind", "part", "node", "text")
    return written(ready.repartition("kind", "part").sortWithinPartitions("kind", "part").mapInArrow(_links, "a long, b long"), "copies-links")


def links(docs: DataFrame, nodes: DataFrame, text: str = "text", split: int = SPLIT) -> DataFrame:
    """(a, b): links that connect the near copies among nodes (node, fp, bands, best); docs has _row."""
    near = links_within(tables(nodes.withColumn("group", F.col("node"))), docs, nodes, text, split)
    joined = written(connected_components(near), "copies-joined")
    grouped = nodes.join(joined, "node", "left").withColumn("group", F.coalesce("component", "node"))
    return near.unionAll(links_within(bands(grouped), docs, nodes, text, split))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", split: int = SPLIT) -> DataFrame:
    """One row of each component, with its own columns."""
    kind = docs.schema[key].dataType.simpleString()
    given = docs.columns
    if "_row" in [c.lower() for c in given]:  # the caller's own column keeps its name and values
        own = unused(docs, "own_row")
        back = representatives(docs.withColumnRenamed("_row", own), own if key == "_row" else key, text, split)
        return back.withColumnRenamed(own, next(c for c in given if c.lower() == "_row"))
    rows = with_row(docs)
    prints = rows.select(F.col("_row").alias("row"), F.col(key).alias("key"), text).mapInArrow(_prints, f"row binary, key {kind}, node long, fp long, bands array<long>")
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("best")
    nodes = written(written(prints, "copies-prints").groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"), best), "copies-nodes")
    found = connected_components(links(rows, nodes, text, split))
    named = nodes.select("node", "best").join(found, "node", "left").select(F.coalesce("component", "node").alias("component"), "best")
    keep = named.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias("_row"))
    return rows.join(written(keep, "copies-keep"), "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
