"""Shared column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space, as [\x20\x09-\x0D].
WS = " \t\n\x0b\f\r"
WS_RE = "[\\x20\\x09-\\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the array of runs of characters that are not white space."""
    df = df.withColumn("_trimmed", F.btrim(F.col(text), F.lit(WS)))
    split = F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", WS_RE))
    return df.withColumn(out, split).drop("_trimmed")


def zipped(a: str, b: str, shift: int, f) -> Column:
    """f(a[i], b[i + shift]) for all i where both exist."""
    keep = lambda n: F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(F.col(a), F.lit(1), keep(F.size(b) - shift)), F.slice(F.col(b), F.lit(shift + 1), keep(F.size(b) - shift)), f)


def with_gram_hashes(df: DataFrame, words: str, n: int, out: str) -> DataFrame:
    """Adds the 64-bit hashes of all n consecutive words, by doubling: fewer than n words give an empty array."""
    mix = lambda x, y: F.xxhash64(x, y)
    df = df.withColumn("_g1", F.transform(words, lambda w: F.xxhash64(w)))
    have, size = "_g1", 1
    made = ["_g1"]
    while size * 2 <= n:
        df = df.withColumn(f"_g{size * 2}", zipped(have, have, size, mix))
        have, size = f"_g{size * 2}", size * 2
        made.append(have)
    rest = n - size
    while rest:
        part = 1 << (rest.bit_length() - 1)
        df = df.withColumn(f"_h{size + part}", zipped(have, f"_g{part}", size, mix))
        have, size, rest = f"_h{size + part}", size + part, rest - part
        made.append(have)
    return df.withColumn(out, F.col(have)).drop(*made)
