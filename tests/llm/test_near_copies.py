"""Near copies against brute force."""

import random

import corpus_pipeline
import pytest
from braidwork.llm import near_copies


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute(texts):
    sets, comp = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return sorted(set(comp))


@pytest.mark.parametrize("split", [near_copies.SPLIT, 2])
def test_near_copies(spark, split):
    rng = random.Random(4)
    prose = lambda n: [f"W{rng.randrange(900)}" for _ in range(n)]
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for n in (60, 150, 150, 300):
        base = prose(n)
        texts.append(" ".join(base))
        for k in range(8):
            w = list(base)
            for at in rng.sample(range(n), 1 + k // 2):
                w[at] = "zz"
            texts.append(" ".join(w))
        texts.append(" ".join(base[: n * 2 // 3] + prose(n // 3)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.representatives(df, split=split).collect()) == brute(texts)
    assert near_copies.representatives(df.limit(0)).count() == 0


def test_stage_takes_0_8(spark, tmp_path):
    base = [f"w{i}" for i in range(120)]
    copy = list(base)
    copy[20] = copy[70] = "zz"  # 106 of 126 shingles
    far = list(base)
    for at in (10, 40, 70, 100):
        far[at] = "zz"
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(far[::-1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3]


def close(spark, rng):
    """Long texts with an edit or two: all near copies, most of them within the covering's radius."""
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(500)]
        texts += [" ".join(base)] + [" ".join(base[:k] + ["zz"] + base[k + 1 :]) for k in rng.sample(range(500), 4)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


def test_covering_decides(spark, monkeypatch):
    """The stage's copies within the radius come of the covering alone; the bands add what is beyond it."""
    df, texts = close(spark, random.Random(6))
    prints = near_copies.with_row(df).select("_row", "doc_id", "text").mapInArrow(near_copies._prints, "row binary, key long, node long, fp long, bands array<long>")
    fp = {r.key: r.fp for r in prints.collect()}
    whole = brute(texts)
    within = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if ((fp[i] ^ fp[j]) % 2**64).bit_count() <= near_copies.RADIUS and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    within[i] = within[j] = min(within[i], within[j])
    assert len(set(within)) < len(texts) - 30
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == whole
    monkeypatch.setattr(near_copies, "bands", lambda nodes: near_copies.tables(nodes).limit(0))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert set(whole) <= kept <= set(within)  # a table may show pairs beyond the radius, too
