"""Removal of repeated 50-byte strings by bucket-pointer refinement.

Byte strings of LENGTH that start in a document with a smaller id are found exactly, without moving a row per byte. A bucket's
pointer is a hash, so that all workers give equal strings the same pointer without asking each other:

1. Initial buckets are Q-grams. Each LENGTH-byte window belongs to the bucket of the least Q-gram under it, so that equal windows meet
   wherever they stand; windows in a row of the same bucket form a run (about one per 18 bytes).
2. A run's bucket is refined by the pointers of later offsets: Q-gram pointers at i and i + 16 give the pointer at depth 32, this one and that at
   i + 18 the pointer at depth 50, and those of a run's first and last window the pointer of the whole run. Runs meet in the bucket
   of their Q-gram; some chunks together send one row, that of the least id, for all their runs with one pointer, so that a passage in a third of
   all documents costs a row per task. Buckets with one document are done; of runs with equal pointers (41 + 63 bits) all but
   the least id's are covered whole. A bucket with several pointers is refined at depth 32, on both sides: runs that share a window agree on the 16 bytes
   before the bucket's Q-gram or on those behind it (16 bits of each go with the run). Only runs that so agree with another document's are
   unresolved, and the least id of each pointer is asked for its bytes; where the Q-gram repeats within a run, the whole bucket is.
3. Unresolved buckets are refined on the bytes themselves: initial 8-gram buckets by the pointers 8, then 16, then 18 bytes on, each round taking
   up the pointers that the last one left; buckets of one string are never touched again. Windows in one final bucket are
   equal; the least id keeps its own.
4. The removed intervals join the texts, which are cut and hashed. The texts are shuffled once, by id and compressed; both joins read that shuffle.

Defined results: null text is empty; null ids rank last, in the order of a hash of their texts; rows that repeat an id are documents of one
rank, none removes from the other; texts of any length are taken in pieces; ties go to the least id; an empty table gives an empty
one; other columns, whatever their names, are dropped. Ids are integers below 2^62.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import table, text_of

LENGTH, Q = 50, 16
#: Windows to a run.
MOST = LENGTH - Q + 1
#: Bytes that a worker names at a time; longer texts are taken in pieces that overlap by LENGTH - 1.
CHUNK = 3_000_000
#: Runs that a worker gathers from several chunks before it deals them out: more to a bucket at a time take fewer bytes.
GATHER = 1_000_000
#: Low bits that tell the place of a Q-gram in its chunk; the bucket's name is what is above.
PLACE = 23
#: Sides of a run whose Q-gram repeats within it; a side that no window reaches is zero.
REPEATED = 0xFFFFFFFF
#: Ranks of rows without an id start here.
NO_ID = 1 << 62
LAST = (1 << 63) - 1
#: Input bytes (as stored) to a bucket, at most; there are BUCKETS buckets to a shuffle partition at least.
BUCKET_BYTES, BUCKETS = 8_000_000, 4


def _pointers(raw: bytes):
    """Pointer of the Q-gram at each byte."""
    import numpy as np

    n = len(raw)
    words = np.ndarray((n - 7,), dtype="<u8", buffer=raw, strides=(1,))
    h = words[: n - Q + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += words[8 : n - Q + 9] * np.uint64(0xC2B2AE3D27D4EB4F)
    return _mixed(h)


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _refined(first, later):
    """Pointer of the pair, at twice the depth or less."""
    import numpy as np

    return _mixed(first * np.uint64(0x9E3779B97F4A7C15) + later * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def _least(h):
    """The least pointer under each window."""
    import numpy as np

    wide, size = LENGTH - Q + 1, 1
    while size < wide:
        step = min(size, wide - size)
        h = np.minimum(h[: len(h) - step], h[step:])
        size += step
    return h


def _runs(pieces: list[tuple[int, bytes]]):
    """pieces (offset in its document, bytes): arrays (piece, start in the piece, number of windows, name, code, sides) of their runs.

    The name (41 bits) is the pointer of the run's Q-gram bucket, the code (63 bits) that of the whole run; sides has 16 bits of the pointers of the
    16 bytes before and behind the bucket's Q-gram. Of equal Q-grams under a window the first counts.
    """
    import numpy as np

    raw = b"".join(b for _, b in pieces)
    lens = np.array([len(b) for _, b in pieces], np.int64)
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint32)
    assert len(raw) < 1 << PLACE
    depth = _pointers(raw)
    shift, low = np.uint64(PLACE), np.uint64((1 << PLACE) - 1)
    least = _least((depth & ~low) | np.arange(len(depth), dtype=np.uint64))
    names = least >> shift
    ends = np.cumsum(lens)
    starts = ends - lens
    # A run starts where the name changes or a piece does, and ends before the next run or the first window that leaves its piece.
    first = np.ones(len(names), bool)
    first[1:] = names[1:] != names[:-1]
    first[starts[starts < len(names)]] = True
    heads = np.flatnonzero(first)
    piece = np.searchsorted(ends, heads, side="right")
    stop = np.minimum(np.append(heads[1:], len(names)), ends[piece] - LENGTH + 1)
    some = heads < stop
    at, stop, piece = heads[some], stop[some], piece[some]
    # Repetitive texts keep a name for long; within MOST windows the first and the last one cover the run.
    parts = (stop - at + MOST - 1) // MOST
    if len(parts) and parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, stop, piece = np.repeat(at, parts) + nth * MOST, np.repeat(stop, parts), np.repeat(piece, parts)
        stop = np.minimum(stop, at + MOST)

    def window(i):  # depth 16 to 32 to 50
        a, b = _refined(depth[i], depth[i + Q]), _refined(depth[i + LENGTH - 2 * Q], depth[i + LENGTH - Q])
        return _refined(a, b)

    code = _refined(window(at), window(stop - 1) + (stop - at).astype(np.uint64))
    place, last = (least[at] & low).astype(np.int64), (least[stop - 1] & low).astype(np.int64)

    def side(i, reached):  # 1 to 65534
        return np.where(reached, (depth[np.clip(i, 0, len(depth) - 1)] >> np.uint64(48)) % np.uint64(65534) + np.uint64(1), np.uint64(0)).astype(np.uint32)

    # A window reaches 17 bytes or more before the Q-gram, or else 18 or more behind it.
    sides = (side(place - Q, place - at > Q) << np.uint32(16)) | side(place + Q, place - stop < Q)
    sides[place != last] = REPEATED
    return piece, at - starts[piece], stop - at, names[at], code >> np.uint64(1), sides


def _squeezed(raw: bytes) -> bytes:
    """Compressed, behind the length; as it is behind a zero if that is no shorter."""
    small = pa.compress(raw, codec="zstd", asbytes=True)
    return len(raw).to_bytes(8, "little") + small if len(small) < len(raw) else bytes(8) + raw


def _expanded(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], size, codec="zstd", asbytes=True) if size else blob[8:]


def _packed(values) -> bytes:
    """Integers of four or eight bytes, first bytes first: the high ones are mostly zero and compress away."""
    import numpy as np

    values = np.ascontiguousarray(values)
    return _squeezed(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _unpacked(blobs: list[bytes], kind):
    import numpy as np

    size = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(_expanded(b), np.uint8).reshape(size, -1).T).view(kind).ravel() for b in blobs if b]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _steps(values) -> bytes:
    """Integers in rising order, by their differences."""
    import numpy as np

    return _packed(np.diff(values, prepend=values.dtype.type(0)))


def _summed(blobs: list[bytes], kind):
    import numpy as np

    parts = [np.cumsum(_unpacked([b], kind), dtype=kind) for b in blobs if b]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _pieces(batches, more: bool):
    """Lists of (id, row, offset, bytes, wanted names), each of about CHUNK bytes. With more, the texts come compressed, with their rows and wanted names."""
    held, size = [], 0
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            raw = _expanded(columns[1][i].as_py()) if more else (columns[1][i].as_py() or "").encode()
            if len(raw) < LENGTH:
                continue
            key = columns[0][i].as_py()
            row = columns[2][i].as_py() if more else 0
            wanted = columns[3].slice(i, 1).flatten() if more else None
            for k in range(0, max(1, len(raw) - LENGTH + 1), CHUNK):
                part = raw[k : k + CHUNK + LENGTH - 1]
                held.append((key, row, k, part, wanted))
                size += len(part)
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _split(bucket):
    """(number, entries) for each bucket that has some."""
    import numpy as np

    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return list(zip(sorted_[cuts].tolist(), np.split(order, cuts[1:]), strict=True))


def _rows(columns: dict, types: dict):
    return pa.record_batch([pa.array(columns[c], t) for c, t in types.items()], names=list(types))


NAMED = {"bucket": pa.int32(), "ids": pa.binary(), "names": pa.binary(), "codes": pa.binary(), "sides": pa.binary()}


def _dealt(n_buckets: int, name, code, ids, sides):
    """Rows for what some chunks have found."""
    import numpy as np

    order = np.lexsort((ids, code, name))
    name, code, ids, sides = name[order], code[order], ids[order], sides[order]
    first = np.ones(len(name), bool)
    first[1:] = (name[1:] != name[:-1]) | (code[1:] != code[:-1])
    least = ids[np.flatnonzero(first)][np.cumsum(first) - 1]
    out = {c: [] for c in NAMED}
    # The least id of each name and code goes to the name's bucket, in the order of names; the others are known to be covered: to their own buckets, below zero.
    at = np.flatnonzero(first)
    for number, part in _split((name[at] % np.uint64(n_buckets)).astype(np.int64)):
        part = at[part]
        out["bucket"].append(number)
        out["ids"].append(_packed(ids[part]))
        out["names"].append(_steps(name[part] // np.uint64(n_buckets)))
        out["codes"].append(_packed(code[part]))
        out["sides"].append(_packed(sides[part]))
    at = np.flatnonzero(ids > least)
    if len(at):
        order = np.lexsort((code[at], ids[at]))
        at = at[order]
        again = np.zeros(len(at), bool)  # the same in a document says no more
        again[1:] = (ids[at][1:] == ids[at][:-1]) & (code[at][1:] == code[at][:-1])
        at = at[~again]
        for number, part in _split(ids[at] % n_buckets):
            part = at[part]
            out["bucket"].append(-1 - number)
            out["ids"].append(_steps(ids[part]))
            out["names"].append(b"")
            out["codes"].append(_packed(code[part]))
            out["sides"].append(b"")
    return _rows(out, NAMED)


def _send_names(n_buckets: int):
    def send(batches):
        import numpy as np

        found, size = [], 0
        for held in _pieces(batches, False):
            piece, _, _, name, code, sides = _runs([(x[2], x[3]) for x in held])
            if not len(name):
                continue
            found.append((name, code, np.array([x[0] for x in held], np.int64)[piece], sides))
            size += len(name)
            if size >= GATHER:
                yield _dealt(n_buckets, *(np.concatenate(x) for x in zip(*found, strict=True)))
                found, size = [], 0
        if found:
            yield _dealt(n_buckets, *(np.concatenate(x) for x in zip(*found, strict=True)))

    return send


def _several(group, code, ids):
    """For each entry, whether its group has different codes and different ids."""
    import numpy as np

    order = np.argsort(group, kind="stable")
    at = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
    some = np.ones(len(at), bool)
    for values in (code[order], ids[order]):
        some &= np.minimum.reduceat(values, at) < np.maximum.reduceat(values, at)
    out = np.zeros(len(group), bool)
    out[order] = np.repeat(some, np.diff(np.append(at, len(group))))
    return out


def _shared(name, code, ids, sides):
    """Which runs may share a window with a different run of another document."""
    import numpy as np

    shared = np.zeros(len(name), bool)
    if not len(name):
        return shared
    at = np.flatnonzero(_several(name, code, ids))
    if len(at):
        code, ids, sides = code[at], ids[at], sides[at]
        _, group = np.unique(name[at], return_inverse=True)
        shared[at] = np.bincount(group, weights=sides == REPEATED)[group] > 0
        for half in (sides >> np.uint32(16), sides & np.uint32(0xFFFF)):
            shared[at] |= (half > 0) & _several((group << 16) | half.astype(np.int64), code, ids)
    return shared


def _told(t: pa.Table) -> pa.Table:
    """(id, told) of one bucket: twice the code, plus one if the run is covered; else its bytes are asked for."""
    import numpy as np

    codes = _unpacked(t["codes"].to_pylist(), np.uint64)
    if t["bucket"][0].as_py() < 0:
        ids, told = _summed(t["ids"].to_pylist(), np.int64), codes * np.uint64(2) + np.uint64(1)
    else:
        ids, names, sides = _unpacked(t["ids"].to_pylist(), np.int64), _summed(t["names"].to_pylist(), np.uint64), _unpacked(t["sides"].to_pylist(), np.uint32)
        order = np.lexsort((ids, codes, names))
        ids, codes, names, sides = ids[order], codes[order], names[order], sides[order]
        new_code = np.ones(len(ids), bool)
        new_code[1:] = (names[1:] != names[:-1]) | (codes[1:] != codes[:-1])
        least = ids[np.flatnonzero(new_code)][np.cumsum(new_code) - 1]
        covered = ids > least
        keep = covered | _shared(names, codes, ids, sides)
        ids, told = ids[keep], codes[keep] * np.uint64(2) + covered[keep].astype(np.uint64)
    return pa.table({"id": pa.array(ids, pa.int64()), "told": pa.array(told.astype(np.int64), pa.int64())})


CONTEXTS = {"bucket": pa.int32(), "ids": pa.binary(), "rows": pa.binary(), "starts": pa.binary(), "sizes": pa.binary(), "names": pa.binary(), "bytes": pa.binary()}


def _send_contexts(n_buckets: int):
    def send(batches):
        import numpy as np

        for held in _pieces(batches, True):
            piece, start, windows, name, code, _ = _runs([(x[2], x[3]) for x in held])
            if not len(name):
                continue
            cuts = np.searchsorted(piece, np.arange(len(held) + 1))
            covered, asked = np.zeros(len(name), bool), np.zeros(len(name), bool)
            for k, x in enumerate(held):
                a, b = cuts[k], cuts[k + 1]
                if b > a and len(x[4]):
                    told = x[4].to_numpy(zero_copy_only=False)
                    own = (code[a:b] * np.uint64(2)).astype(np.int64)
                    covered[a:b] = np.isin(own + 1, told)
                    asked[a:b] = np.isin(own, told) & ~covered[a:b]
            ids, rows, offsets = (np.array([x[j] for x in held], np.int64) for j in range(3))
            out = {c: [] for c in CONTEXTS}
            at = np.flatnonzero(covered)
            if len(at):  # covered runs that touch become one interval
                p, s = piece[at], start[at]
                e = s + windows[at] + LENGTH - 1
                new = np.ones(len(at), bool)
                new[1:] = (p[1:] != p[:-1]) | (s[1:] > e[:-1])
                a = np.flatnonzero(new)
                z = np.append(a[1:], len(at)) - 1
                p = p[a]
                values = {"ids": ids[p], "rows": rows[p], "starts": s[a] + offsets[p], "sizes": e[z] - s[a]}
                for number, part in _split(values["ids"] % n_buckets):
                    out["bucket"].append(-1 - number)
                    for c, v in values.items():
                        out[c].append(_packed(v[part]))
                    out["names"].append(b"")
                    out["bytes"].append(b"")
            at = np.flatnonzero(asked)
            if len(at):
                p = piece[at]
                values = {"ids": ids[p], "rows": rows[p], "starts": start[at] + offsets[p], "sizes": windows[at] + LENGTH - 1, "names": name[at]}
                ends = start[at] + values["sizes"]
                contexts = [held[i][3][s:e] for i, s, e in zip(p.tolist(), start[at].tolist(), ends.tolist(), strict=True)]
                for number, part in _split((name[at] % np.uint64(n_buckets)).astype(np.int64)):
                    out["bucket"].append(number)
                    for c, v in values.items():
                        out[c].append(_packed(v[part]))
                    out["bytes"].append(_squeezed(b"".join([contexts[j] for j in part.tolist()])))
            if out["bucket"]:
                yield _rows(out, CONTEXTS)

    return send


def refine(raw: bytes, starts, length: int = LENGTH):
    """Pointers of the strings of ``length`` bytes at starts: equal pointers for equal strings. Bucket-pointer refinement.

    A pointer is the last place of its bucket in the order of all positions, so that a split bucket's new pointers lie within the old one's
    range and all others stay as they are. Each round sorts only the positions whose bucket has several, by the pointer ``step`` bytes on.
    """
    import numpy as np

    n = len(raw)
    padded = raw + b"\0" * (length + 8)
    words = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(1,))
    order = np.argsort(words, kind="stable")
    value = words[order]
    pointer = np.full(n + length, -1, np.int64)  # behind the end: less than any
    pointer[order] = _ends(np.append(value[1:] != value[:-1], True), np.arange(n))
    last = np.append(value[1:] != value[:-1], True)
    alone = last & np.append(True, last[:-1])
    open_ = order[~alone]  # in the order of their buckets
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    depth = 8
    while depth < length and len(open_):
        step = min(depth, length - depth)
        if depth + step == length:
            open_ = open_[wanted[open_]]
            if not len(open_):
                break
        own, later = pointer[open_], pointer[open_ + step]
        order = np.lexsort((later, own))
        open_, own, later = open_[order], own[order], later[order]
        last_of_bucket = np.append(own[1:] != own[:-1], True)
        last = last_of_bucket | np.append(later[1:] != later[:-1], True)
        # The place of a sub-bucket's end: the bucket's own end less what follows in the bucket.
        place = own - (_ends(last_of_bucket, np.arange(len(open_))) - np.arange(len(open_)))
        pointer[open_] = _ends(last, place)
        alone = last & np.append(True, last[:-1])
        open_ = open_[~alone]
        depth += step
    return pointer[starts]


def _ends(last, place):
    """For each entry the place of the next one (itself included) that is marked last."""
    import numpy as np

    at = np.flatnonzero(last)
    return place[at][np.cumsum(last) - last]


def _removed(t: pa.Table) -> pa.Table:
    """(id, row, start, end) of the removed intervals that one bucket's contexts tell."""
    import numpy as np

    ids, rows, starts, sizes = (_unpacked(t[c].to_pylist(), np.int64) for c in ("ids", "rows", "starts", "sizes"))
    names, raw = _unpacked(t["names"].to_pylist(), np.uint64), b"".join([_expanded(b) for b in t["bytes"].to_pylist() if b])
    if t["bucket"][0].as_py() < 0:
        return pa.table({"id": ids, "row": rows, "start": starts, "end": starts + sizes})
    at = np.cumsum(sizes) - sizes
    contexts = [raw[a : a + n] for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]
    least: dict[bytes, int] = {}
    for c, i in zip(contexts, ids.tolist(), strict=True):
        if least.get(c, LAST + 1) > i:
            least[c] = i
    lowest = np.array([least[c] for c in contexts], np.int64)
    copy = ids > lowest  # all its windows stand in a smaller document
    out = [(ids[copy], rows[copy], starts[copy], starts[copy] + sizes[copy])]
    # Names with several different contexts: window by window.
    number = {c: k for k, c in enumerate(least)}
    kind = np.array([number[c] for c in contexts], np.int64)
    order = np.lexsort((kind, names))
    n2, k2 = names[order], kind[order]
    first = np.ones(len(n2), bool)
    first[1:] = n2[1:] != n2[:-1]
    new = np.ones(len(n2), bool)
    new[1:] = first[1:] | (k2[1:] != k2[:-1])
    group = np.cumsum(first) - 1
    several = np.zeros(len(n2), bool)
    several[order] = (np.bincount(group, weights=new) > 1)[group]
    left = np.flatnonzero(several & ~copy)
    if len(left):
        joined = b"".join([contexts[i] for i in left.tolist()])
        n = sizes[left]
        base = np.cumsum(n) - n
        windows = n - LENGTH + 1
        owner = np.repeat(np.arange(len(left)), windows)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        equal = refine(joined, base[owner] + within)
        low = np.full(int(equal.max()) + 1, LAST, np.int64)
        np.minimum.at(low, equal.astype(np.int64), ids[left][owner])
        gone = np.flatnonzero(ids[left][owner] > low[equal.astype(np.int64)])
        if len(gone):
            o, w = owner[gone], within[gone]
            head = np.ones(len(gone), bool)
            head[1:] = (o[1:] != o[:-1]) | (w[1:] != w[:-1] + 1)
            a = np.flatnonzero(head)
            z = np.append(a[1:], len(gone)) - 1
            i = left[o[a]]
            out.append((ids[i], rows[i], starts[i] + w[a], starts[i] + w[z] + LENGTH))
    return pa.table({c: np.concatenate([x[j] for x in out]) for j, c in enumerate(("id", "row", "start", "end"))})


def _cut(batches):
    import hashlib

    import numpy as np

    for batch in batches:
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "digest": []}
        for i in range(batch.num_rows):
            raw, own = _expanded(batch.column(1)[i].as_py()), batch.column(2)[i].as_py()
            rows, starts, ends = (np.array(batch.column(k)[i].as_py() or [], np.int64) for k in (3, 4, 5))
            starts, ends = starts[rows == own], ends[rows == own]
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(order) else ends
            if len(starts):
                new = np.append(True, starts[1:] > ends[:-1])
                a = starts[new]
                z = np.append(ends[:-1][new[1:]], ends[-1])
            else:
                a = z = starts
            kept, at = [], 0
            for x, y in zip(a.tolist(), z.tolist(), strict=True):
                kept.append(raw[at:x])
                at = y
            left = b"".join([*kept, raw[at:]])
            for c, v in zip(out, (len(raw), len(raw) - len(left), len(a), left, hashlib.sha256(left).hexdigest()), strict=True):
                out[c].append(v)
        types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "digest": pa.string()}
        made = _rows(out, types)
        yield pa.record_batch([batch.column(0), *made.columns], names=["key", *types])


def _pack_texts(batches):
    """Rows (key, id, row, text) with the text compressed."""
    for batch in batches:
        packed = pa.array([_squeezed(t.as_py().encode()) for t in batch.column(3)], pa.binary())
        yield pa.record_batch([*batch.columns[:3], packed], names=["key", "id", "row", "packed"])


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the input as the plan's statistics have them: no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, digest): kept holds the remaining bytes, digest their SHA-256."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(BUCKETS * parts, min(stored_bytes(docs), 1 << 50) // BUCKET_BYTES)
    kind = docs.schema[key].dataType.simpleString()
    nameless = F.shiftrightunsigned(F.xxhash64(text_of(text)), 2) + F.lit(NO_ID)
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), nameless).alias("id"), text_of(text).alias("text"))
    named = d.select("id", "text").mapInArrow(_send_names(n_buckets), "bucket int, ids binary, names binary, codes binary, sides binary")
    told = named.groupBy("bucket").applyInArrow(_told, "id long, told long")
    wanted = told.groupBy("id").agg(F.collect_list("told").alias("wanted"))
    # Both joins have the same columns and the id as their only key, so that one shuffle of the texts serves them;
    # that no id is null is said here, as the inner join would else say it for its side alone.
    packed = d.select("key", "id", F.xxhash64("text").alias("row"), "text").mapInArrow(_pack_texts, f"key {kind}, id long, row long, packed binary")
    texts = packed.where(F.col("id").isNotNull()).repartition(parts, "id")
    asked = texts.join(wanted, "id").select("id", "packed", "row", "wanted", "key")
    contexts = asked.mapInArrow(_send_contexts(n_buckets), "bucket int, ids binary, rows binary, starts binary, sizes binary, names binary, bytes binary")
    gone = contexts.groupBy("bucket").applyInArrow(_removed, "id long, row long, start long, end long")
    gone = gone.groupBy("id").agg(F.collect_list(F.struct("row", "start", "end")).alias("x"))
    found = texts.join(gone, "id", "left").select("key", "packed", "row", F.col("x.row").alias("r"), F.col("x.start").alias("s"), F.col("x.end").alias("e"))
    return found.mapInArrow(_cut, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary, digest string")


def op8_repeated_bytes(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("digest").alias("kept_sha256"))
