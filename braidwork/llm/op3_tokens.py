"""Token counts from pre-token frequencies.

A text is cut into pre-tokens by the vocabulary's own pattern. A first pass over the texts emits, for each distinct pre-token of a
chunk of rows, the rows that have it with their frequencies, so that its string is sent once a chunk. These are brought together by
pre-token; the library counts the pieces of each distinct pre-token once (they are the same wherever it stands), the count is
joined to the frequencies, and the products are summed by row. No ids of tokens are kept. A pre-token in more than HOT rows of a
chunk would meet all its rows in one task: the worker that cut it counts it there and then, once, and remembers it (at
most KNOWN such ones, else it counts again). A chunk ends at DISTINCT pre-tokens or ENTRIES frequencies, which bounds memory and drops nothing.

Rows are told apart by task and place within it, so a table read again must give its rows in the same order, as files do; frequencies owed
and frequencies joined are compared for each row, and a difference is an error.

Defined results: null text is empty (0 bytes, 0 tokens); rows that repeat give a row each, null keys too; an empty table gives an empty
one; other columns are dropped, whatever their names. A special string inside a text is one token, as the library's default has it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import table

LIMIT = 1024
HOT = 3
DISTINCT, ENTRIES, KNOWN = 200_000, 500_000, 200_000
# The pre-token pattern of byte-level BPE vocabularies, and white space by Unicode.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern over ASCII alone, for the standard library's faster matcher.
ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def _library(name: str):
    import os

    # One thread: a task has one core, and each thread would hold memory of its own.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.no_truncation()
    library.no_padding()

    def pieces(some: list[str]) -> list[int]:
        return [len(e) for k in range(0, len(some), 1_000) for e in library.encode_batch_fast(some[k : k + 1_000], add_special_tokens=False)]

    return library, pieces


def _give_back() -> None:
    """A worker process stays for other tasks: its free memory goes back to the machine."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _frequencies(name: str, hot: int, entries: int):
    """Rows (key, text) to rows (task, pre, at, key, n_bytes, n_tokens).

    pre is null for a row of the table: at holds its place and the frequencies it owes, n_tokens what is counted already. Else at holds
    places and frequencies, each pair in one number.
    """

    def cut(batches):
        import re
        from array import array
        from collections import Counter, defaultdict
        from itertools import count, repeat
        from operator import mul
        from unicodedata import category

        import numpy as np
        import regex
        from pyspark import TaskContext

        library, pieces = _library(name)
        task = TaskContext.get().partitionId()
        # Special strings within a text, longest first, as the library finds them.
        special = sorted((t.content for t in library.get_added_tokens_decoder().values()), key=len, reverse=True)
        split = regex.compile("|".join(map(regex.escape, special))) if special else None
        find, find_ascii = regex.compile(PATTERN).findall, re.compile(ASCII).findall
        known: dict[str, int] = {}
        slots, at, often, sizes, counted, owed, keys = defaultdict(count().__next__), array("i"), array("i"), [], [], [], []
        which, first = array("i"), 0

        def flush():
            """The chunk's own rows, then its pre-tokens."""
            nonlocal slots, at, often, which, sizes, counted, owed, keys, first
            names = list(slots)
            slot, place, n = (np.frombuffer(a, np.int32) for a in (which, at, often))
            rows = np.bincount(slot, minlength=len(names))
            common = np.flatnonzero(rows > hot)
            count_of = np.zeros(len(names), np.int64)
            if len(common):
                some = [names[i] for i in common.tolist()]
                count_of[common] = pieces(some)
                if len(known) + len(some) > KNOWN:
                    known.clear()
                known.update(zip(some[:KNOWN], count_of[common[:KNOWN]].tolist(), strict=True))
            total, debt = np.array(counted, np.int64), np.array(owed, np.int64)
            now = count_of[slot] > 0
            np.add.at(total, place[now] - first, count_of[slot[now]] * n[now])
            np.subtract.at(debt, place[now] - first, n[now])
            places = (np.arange(first, first + len(total), dtype=np.int64) << 32) | debt
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32)), pa.array(places))
            none = lambda m, kind: pa.nulls(m, kind)
            m, key = len(total), pa.concat_arrays(keys)
            columns = ["task", "pre", "at", "key", "n_bytes", "n_tokens"]
            yield pa.record_batch([pa.array(np.full(m, task, np.int32)), none(m, pa.string()), own, key, pa.array(sizes, pa.int64()), pa.array(total)], names=columns)
            rest = np.flatnonzero(~now)
            rest = rest[np.argsort(slot[rest], kind="stable")]
            pairs = (place[rest].astype(np.int64) << 32) | n[rest]
            rare = np.flatnonzero(rows <= hot)
            ends = np.concatenate(([0], np.cumsum(rows[rare])))
            for k in range(0, len(rare), 20_000):
                some, e = rare[k : k + 20_000], ends[k : k + 20_001]
                lists = pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.array(pairs[e[0] : e[-1]]))
                m, text = len(some), pa.array([names[i] for i in some.tolist()], pa.string())
                yield pa.record_batch([pa.array(np.full(m, task, np.int32)), text, lists, none(m, key.type), none(m, pa.int64()), none(m, pa.int64())], names=columns)
            first += len(total)
            slots, at, often, sizes, counted, owed, keys = defaultdict(count().__next__), array("i"), array("i"), [], [], [], []
            which = array("i")

        for batch in batches:
            begun = 0
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                parts, extra = [text], 0
                if split is not None and "<|" in text:
                    parts = split.split(text)
                    extra = len(parts) - 1
                frequency = Counter()
                # Code points that a Unicode version has not assigned yet may be letters to one table and not to another.
                plain = text.isascii()
                odd = not plain and any(c > "\u0557" and category(c) == "Cn" for c in set(text))
                for part in parts:
                    frequency.update([part[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(part)] if odd else (find_ascii if plain else find)(part))
                have = list(map(known.get, frequency, repeat(0)))
                new = [t for t, n in zip(frequency, have, strict=True) if not n]
                which.extend(map(slots.__getitem__, new))
                often.extend(map(frequency.__getitem__, new))
                at.extend(repeat(first + len(sizes), len(new)))
                sizes.append(len(text) if plain else len(text.encode()))
                counted.append(extra + sum(map(mul, have, frequency.values())))
                owed.append(sum(map(frequency.__getitem__, new)))
                if len(slots) >= DISTINCT or len(at) >= entries:
                    keys.append(batch.column(0).slice(begun, i + 1 - begun))
                    begun = i + 1
                    yield from flush()
            if begun < batch.num_rows:
                keys.append(batch.column(0).slice(begun))
        if sizes:
            yield from flush()
        known.clear()
        _give_back()

    return cut


def _joined(name: str):
    """Rows of _frequencies sorted by pre to (row, key, n_bytes, n_tokens, owed): a distinct pre-token's pieces are counted once."""

    def join(batches):
        import numpy as np

        _, pieces = _library(name)
        last, n_last = None, 0
        for batch in batches:
            task, pre, at = batch.column(0), batch.column(1), batch.column(2)
            names = pre.to_pylist()
            new = [t for t in dict.fromkeys(names) if t is not None and t != last]
            count_of = dict(zip(new, pieces(new), strict=True))
            if last is not None:
                count_of[last] = n_last
            count_of[None] = 0
            lengths = at.value_lengths().to_numpy(zero_copy_only=False)
            pairs = at.flatten().to_numpy(zero_copy_only=False)
            n = np.repeat(np.fromiter(map(count_of.__getitem__, names), np.int64, len(names)), lengths)
            rows = (np.repeat(task.to_numpy(zero_copy_only=False).astype(np.int64), lengths) << 32) | (pairs >> 32)
            often = pairs & 0xFFFFFFFF
            own = np.repeat(np.array([t is None for t in names], bool), lengths)
            # A row of the table has one pair, so that its other columns can be taken by its index.
            index = pa.array(np.repeat(np.arange(len(names)), lengths))
            counted = np.where(own, batch.column(5).fill_null(0).take(index).to_numpy(zero_copy_only=False), often * n)
            out = [pa.array(rows), batch.column(3).take(index), batch.column(4).fill_null(0).take(index), pa.array(counted), pa.array(np.where(own, often, -often))]
            yield pa.record_batch(out, names=["row", "key", "n_bytes", "n_tokens", "owed"])
            if new:
                last, n_last = new[-1], count_of[new[-1]]
        _give_back()

    return join


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", hot: int = HOT, entries: int = ENTRIES) -> DataFrame:
    """(key, n_bytes, n_tokens) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    cut = given.mapInArrow(_frequencies(vocabulary, hot, entries), f"task int, pre string, at array<long>, key {kind}, n_bytes long, n_tokens long")
    place = F.when(F.col("pre").isNull(), F.xxhash64("task", F.col("at")[0])).otherwise(F.xxhash64("pre"))
    parts = cut.repartition(place).sortWithinPartitions("pre").mapInArrow(_joined(vocabulary), f"row long, key {kind}, n_bytes long, n_tokens long, owed long")
    summed = parts.groupBy("row").agg(
        F.any_value("key", F.lit(True)).alias("key"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.sum("owed").alias("owed")
    )
    unequal = F.raise_error(F.lit("rows came in another order when they were read again: write the table first"))
    return summed.select("key", "n_bytes", F.when(F.col("owed") == 0, F.col("n_tokens")).otherwise(unequal.cast("long")).alias("n_tokens"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
