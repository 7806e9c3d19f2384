"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints: bit b is set if it is set in over half the 64-bit hashes of the document's 3-word shingles. For radius r
every bit position gets a random non-zero vector of r + 1 bits; table v (each non-zero vector) masks the positions whose
vector has an odd product with v. Any r positions leave some v orthogonal to them all, so two fingerprints within the
radius agree under some mask: all 2^(r+1) - 1 = 15 tables together miss no pair (Pagh, SODA 2016).

Copies fold into one distinct fingerprint before the tables. A bucket of a table is walked breadth-first in a
worker: a fingerprint claims all unclaimed ones within the radius, so that a bucket of m emits at most m - 1 links (never
all pairs) and a dense group costs little more than linear time; what is far apart is compared once. Buckets above
SPLIT distinct fingerprints are first dealt out by the blocks of their unmasked bits, as often as it takes: within the radius r one of r + 1
blocks agrees, so that the parts still miss no pair. Links join into components by alternating stars.

Defined results: null or blank text has fingerprint zero and links like any other; long texts are hashed whole, in bounded parts; a bit set in
exactly half the hashes is 0; rows that repeat a doc_id give a row each, with the component of the least doc_id; null doc_ids never name a component
unless alone; an empty table gives an empty one; other columns, whatever their names, are dropped, and pass through ``representatives``.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import table
from braidwork.operators.components import connected_components
from braidwork.shared import written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Buckets of more distinct fingerprints are dealt out further.
SPLIT = 20_000


def masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """The 2^(radius+1) - 1 masks as unsigned 64-bit integers."""
    rng = random.Random(seed)
    vectors = [rng.randrange(1, 1 << (radius + 1)) for _ in range(64)]
    return [sum(1 << b for b in range(64) if (vectors[b] & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def _fingerprints(batches):
    import numpy as np
    import xxhash

    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    digest = xxhash.xxh64_intdigest

    def one(text) -> int:
        words = (text or "").encode().translate(lower).split()
        if not words:
            return 0
        if len(words) <= SHINGLE:
            hashes = [digest(b" ".join(words), SEED)]
        else:
            hashes = [digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:], strict=False)]
        ones = np.zeros(64, np.int64)
        for k in range(0, len(hashes), 65536):  # bounded memory for long documents
            part = np.array(hashes[k : k + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)

    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([one(t.as_py()) for t in batch.column(1)], pa.int64())], names=["key", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the 64 bits as a signed long."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text).mapInArrow(_fingerprints, f"key {kind}, fp long")


def _walk(fps, radius: int):
    """Links (from, to) that join all of fps within the radius of each other; at most len(fps) - 1."""
    import numpy as np

    left, a, b = np.unique(fps), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(np.bitwise_xor(left, x).view(np.uint64)) <= radius
            if near.any():
                got = left[near]
                a.append(np.full(len(got), x))
                b.append(got)
                queue.extend(got)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _links(radius: int):
    def walk(batches):
        """Rows (m, k, fp) sorted by (m, k): one bucket after another."""
        import numpy as np

        held, last = [], None

        def flush(fps):
            a, b = _walk(fps, radius)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            parts = np.split(fp, cuts)
            starts = [0, *cuts.tolist()]
            out_a, out_b = [], []
            for at, part in zip(starts, parts, strict=True):
                name = (t[at], k[at])
                if name != last and held:
                    if sum(map(len, held)) > 1:
                        a, b = _walk(np.concatenate(held), radius)
                        out_a.append(a)
                        out_b.append(b)
                    held = []
                last = name
                held.append(part)
            if out_a:
                yield pa.record_batch([pa.array(np.concatenate(out_a), pa.int64()), pa.array(np.concatenate(out_b), pa.int64())], names=["a", "b"])
        if held and sum(map(len, held)) > 1:
            yield flush(np.concatenate(held))

    return walk


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def blocks(mask: int, radius: int = RADIUS) -> list[int]:
    """The bits outside of mask, dealt out to radius + 1 blocks: of two fingerprints within the radius that agree on mask, some block agrees, too."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in free[j :: radius + 1]) for j in range(radius + 1)]


def _keyed(fps: DataFrame, masks_: list[int]) -> DataFrame:
    """(m, k, fp): the bucket k of every fingerprint under each mask m."""
    tables = F.array(*[F.struct(F.lit(_long(m)).alias("m"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("k")) for m in masks_])
    return fps.select("fp", F.explode(tables).alias("x")).select("x.m", "x.k", "fp")


def links(distinct: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that connect all pairs within the radius.

    Buckets of more than ``split`` are dealt out by blocks of the bits that their mask leaves free, and what is still larger once more, with the
    mask grown by the block, until none is; each round keeps every pair together somewhere.
    """
    all_masks = sorted(set(masks(radius)))
    keyed = _keyed(distinct, all_masks)
    found = None
    while True:
        sizes = written(keyed.groupBy("m", "k").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
        part = keyed.join(sizes.where(F.col("n") <= split).select("m", "k"), ["m", "k"], "left_semi")
        found = part if found is None else found.unionAll(part)
        big = sizes.where(F.col("n") > split).select("m", "k")
        if not big.limit(1).count():
            break
        hot = written(keyed.join(big, ["m", "k"], "left_semi"), "simhash-hot")
        grown = {m: sorted({m | b for b in blocks(m, radius) if b}) for m in all_masks if m != (1 << 64) - 1}
        per = F.create_map(*[x for m, more in grown.items() for x in (F.lit(_long(m)), F.array(*[F.lit(_long(g)) for g in more]))])
        keyed = hot.select("fp", F.explode(per[F.col("m")]).alias("m")).select("m", F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp").distinct()
        reached = {r[0] % 2**64 for r in hot.select("m").distinct().collect()}  # masks only
        all_masks = sorted({g for m in reached for g in grown[m]})
    return found.repartition("m", "k").sortWithinPartitions("m", "k").mapInArrow(_links(radius), "a long, b long").distinct()


def components(prints: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """prints (key, fp) plus component_id, the least key reachable. prints is read twice: give a written table."""
    least = written(prints.groupBy("fp").agg(F.min("key").alias("first")), "simhash-distinct")
    nodes = connected_components(links(least.select("fp"), radius, split))
    named = least.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    groups = named.groupBy("group").agg(F.min("first").alias("component_id"))
    named = named.join(groups, "group").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of near-duplicates, with its own columns: five-word shingles, Jaccard similarity of 0.8 or more.

    Candidates come of covering tables for fingerprints of five-word shingles within five bits, then (at 0.8 two fingerprints differ by ten bits on
    average and by up to twenty, for which a covering would take 2^20 tables or more) of MinHash bands for what the covering's links have not
    joined (``near_copies``). Each is decided by its exact similarity.
    """
    from braidwork.llm import near_copies

    return near_copies.representatives(docs, key, text, **options)


def op6_simhash_covering(spark, sf_dir: str) -> DataFrame:
    prints = written(fingerprints(table(spark, sf_dir, "documents")), "simhash-prints")
    found = components(prints)
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
