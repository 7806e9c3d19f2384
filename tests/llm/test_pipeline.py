"""The pipeline's stages against brute force."""

import collections
import random
import re

import corpus_pipeline
from braidwork.llm import op1_pii, op5_mixing, op9_quality
from pyspark.sql import functions as F
from test_near_copies import brute as near_brute
from test_operators import bench_brute, pii_base

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keeps(t):
    """The quality rules by their plain definitions."""
    t = t or ""
    w = t.split()
    grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if x.strip()]
    dup, chars = len(lines) - len(set(lines)), sum(map(len, w))
    return not (
        len(w) < 20 or 100 * len(covered) > 30 * len(w) or 10 * sum(c in "#*$%&|<>" for c in t) > len(w) or (dup >= 3 and 10 * dup > 3 * len(lines))
        or chars < 2 * len(w) or chars > 15 * len(w) or 2 * sum("A" <= c <= "Z" for c in t) > chars
    )


def redacted(t):
    for s, k, e in sorted(pii_base(t), reverse=True):
        t = t[:s] + f"<{op1_pii.KINDS[k]}>" + t[e:]
    return t


def test_run(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    text = lambda k, n=60: " ".join(random.Random(k).choices(words, k=n))
    rows = [(k, text(k), "en", f"s{k % 2}") for k in range(25)]
    near = text(3).split()
    near[30] = "zz"
    rows += [(100, text(3), "en", "s0"), (101, "too short", "en", "s0"), (102, "*** ### " * 40, "en", "s1"), (103, text(50) + " " + " ".join(words[:12]), "en", "s1"), (104, text(60) + " a.b@example.com", "en", "s0")]
    rows += [(105, " ".join(near), "en", "s0"), (106, text(61, 20) * 1 + "\n" + text(61, 20) + "\n" + text(61, 20), "en", "s0"), (107, None, None, None), (108, "A" + text(62).upper(), "en", "s1")]
    # Ids that repeat or are null stay documents of their own.
    rows += [(None, text(70), "en", "s0"), (None, text(71), "de", None), (5, text(72), "en", "s1"), (5, text(72), "en", "s1")]
    rng.shuffle(rows)
    d = str(tmp_path)
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(d + "/documents.parquet")
    item = " ".join(words[:12])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    docs, kept = spark.read.parquet(d + "/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.written(stage(spark, docs, d), name)
        assert docs.columns == COLUMNS
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
    key = lambda x: (str(x[0]), x[1])
    want = [r for r in rows if keeps(r[1])]
    assert sorted(kept[0], key=key) == sorted([(r[0], r[1]) for r in want], key=key)
    # Of each group of near copies one row stays.
    ranked = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = [ranked[i] for i in near_brute([r[1] for r in ranked])]
    assert sorted(kept[1], key=key) == sorted([(r[0], r[1]) for r in want], key=key)
    found = bench_brute([(i, r[1]) for i, r in enumerate(want)], [(1, item)])
    want = [r for i, r in enumerate(want) if not found[i][2]]
    assert sorted(kept[2], key=key) == sorted([(r[0], r[1]) for r in want], key=key)
    want = [(r[0], redacted(r[1]), *r[2:]) for r in want]
    assert sorted(kept[3], key=key) == sorted([(r[0], r[1]) for r in want], key=key)
    assert any("<email>" in r[1] for r in want) and {r.n_chars - len(r.text) for r in docs.collect()} == {0}
    # The mix: systematic sampling of each source in the order of sizes.
    sizes = {s: sum(len(r[1].split()) for r in want if r[3] == s) for s in {r[3] for r in want}}
    goals = {r.source: r for r in op5_mixing.targets(spark.createDataFrame([(r[3], len(r[1].split())) for r in want], "source string, size long")).collect()}
    times = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, d).collect())
    assert set(times) <= {(r[0], r[1]) for r in want} and max(times.values()) <= 2
    for s, g in goals.items():
        took = sum(times[r[0], r[1]] * len(r[1].split()) for r in want if r[3] == s)
        assert g.source_size == sizes[s] and abs(took - g.target) <= 130
    assert re.search("w1", want[0][1]) and set(op9_quality.BASE) < set(op9_quality.RULES)


def test_empty(spark, tmp_path):
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
    extra = spark.createDataFrame([(1, "w " * 3, "en", "s", 0)], schema).withColumn("kept", F.lit("k"))
    assert corpus_pipeline.quality_rules(spark, extra, d).count() == 0
