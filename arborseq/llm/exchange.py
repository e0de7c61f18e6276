"""Which hashed places of documents occur in several documents, with one shuffle of packed runs.

A chunk of documents packs its (hash, document, place) into one row per shuffle partition: hashes sorted, as differences, all
numbers by byte planes, so that leading zeros are squeezed out. Of a hash that several documents of the chunk hold, the
places of the least document are sent on for all, flagged, and the others are answered at once; so a hash that a third of
all documents hold is one entry per chunk, not one per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseq.common import width

FLAG = np.uint32(1 << 31)
#: Entries that are sorted at a time.
STEP = 4_000_000


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _arrow_key(key: str) -> pa.DataType:
    return {"binary": pa.binary(), "bigint": pa.int64()}[key]


def _row(keys: pa.Array, part: int, h1: np.ndarray | None, h2: np.ndarray | None, doc: np.ndarray, pos: np.ndarray, flag: np.ndarray | None) -> dict:
    there = np.zeros(len(keys), bool)
    there[doc] = True
    own, at = np.flatnonzero(there), (np.cumsum(there) - 1)[doc].astype(np.uint32)
    return {
        "part": part, "h1": None if h1 is None else _planes(np.append(h1[:1], np.diff(h1))), "h2": None if h2 is None else _planes(h2),
        "doc": _planes(at if flag is None else np.where(flag, at | FLAG, at)), "pos": _planes(pos.astype(np.uint32)), "docs": keys.take(pa.array(own)),
    }


def _rank(keys: pa.Array) -> np.ndarray:
    """Numbers in the order of the keys; of binary keys any order."""
    return keys.to_numpy(zero_copy_only=False) if pa.types.is_integer(keys.type) else np.arange(len(keys))


def pack(keys: pa.Array, doc: np.ndarray, pos: np.ndarray, h1: np.ndarray, h2: np.ndarray | None, parts: int) -> Iterator[dict]:
    """Rows of a chunk: (hashes, document's index in keys, place); a document must lie in one chunk."""
    rank = _rank(keys)[doc]
    order = np.lexsort((rank, h1)) if h2 is None else np.lexsort((rank, h2, h1))
    doc, pos, h1 = doc[order], pos[order], h1[order]
    h2 = None if h2 is None else h2[order]
    new = np.append(True, h1[1:] != h1[:-1])
    if h2 is not None:
        new[1:] |= h2[1:] != h2[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h1)) - 1
    shared = doc[first] != doc[last]
    own = np.repeat(shared, last - first + 1)
    least = doc == np.repeat(doc[first], last - first + 1)
    part = ((h1 >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    if own.any():
        yield _row(keys, int(part[-1]), None, None, doc[own], pos[own], None)
    go = least | ~own
    h1, doc, pos, part, flag = h1[go], doc[go], pos[go], part[go], own[go]
    h2 = None if h2 is None else h2[go]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(part))):
        yield _row(keys, int(part[lo]), h1[lo:hi], None if h2 is None else h2[lo:hi], doc[lo:hi], pos[lo:hi], flag[lo:hi])


def _answers(key_type: pa.DataType, name: str, keys: pa.Array, doc: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, places, firsts) with the places under one of the two names."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(doc))
    for lo in range(0, len(at), 2_000):
        a, e = at[lo : lo + 2_000], ends[lo : lo + 2_000]
        lists = pa.ListArray.from_arrays(pa.array(np.append(a - a[0], e[-1] - a[0]).astype(np.int32)), pa.array(pos[a[0] : e[-1]].astype(np.int32)))
        none = pa.nulls(len(a), lists.type)
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(doc[a])).cast(key_type), *((lists, none) if name == "places" else (none, lists))], ["key", "places", "firsts"]
        )


def _meet(key: str, firsts: bool, step: int):
    key_type = _arrow_key(key)

    def run(batches):
        keys, h1, h2, doc, pos, flag, n = [], [], [], [], [], [], 0
        for b in batches:
            for r in range(b.num_rows):
                own, d, p = b.column("docs")[r].values, _unplanes(b.column("doc")[r].as_py(), np.uint32), _unplanes(b.column("pos")[r].as_py(), np.uint32)
                if b.column("h1")[r].as_py() is None:
                    yield from _answers(key_type, "places", own, d.astype(np.int64), p)
                    continue
                keys.append(own)
                h1.append(np.cumsum(_unplanes(b.column("h1")[r].as_py(), np.uint64), dtype=np.uint64))
                if (x := b.column("h2")[r].as_py()) is not None:
                    h2.append(_unplanes(x, np.uint64))
                flag.append(d >= FLAG)
                doc.append((d & ~FLAG).astype(np.int64) + n)
                pos.append(p)
                n += len(own)
        if not keys:
            return
        # ranges of hashes of about ``step`` entries or so; equal hashes stay together
        total = sum(map(len, h1))
        low, high = min(int(x[0]) for x in h1), max(int(x[-1]) for x in h1)
        steps = -(-total // step)
        bounds = [low + (high - low) * k // steps for k in range(steps)] + [high + 1]
        all_keys = pa.concat_arrays([k.cast(key_type) for k in keys])
        rank = _rank(all_keys)
        for a, z in zip(bounds, bounds[1:]):
            cut = [(np.searchsorted(x, np.uint64(a)), len(x) if z > high else np.searchsorted(x, np.uint64(z))) for x in h1]
            pick = lambda xs: np.concatenate([x[i:j] for x, (i, j) in zip(xs, cut)])  # noqa: B023, E731
            h, d, p, f, g = pick(h1), pick(doc), pick(pos), pick(flag), pick(h2) if h2 else None
            order = np.argsort(h, kind="stable")
            again = np.append(False, h[order[1:]] == h[order[:-1]])
            again[:-1] |= again[1:]
            order = order[again | f[order]]  # most hashes occur once
            if g is not None:
                order = order[np.lexsort((g[order], h[order]))]
            if not len(order):
                continue
            h, d, p, f = h[order], d[order], p[order], f[order]
            new = np.append(True, h[1:] != h[:-1])
            if g is not None:
                g = g[order]
                new[1:] |= g[1:] != g[:-1]
            at = np.flatnonzero(new)
            many = np.diff(np.append(at, len(h)))
            shared = np.repeat((np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)) | np.logical_or.reduceat(f, at), many)
            yield from _answers(key_type, "places", all_keys, d[shared & ~f], p[shared & ~f])
            if firsts:
                least = shared & (rank[d] == np.repeat(np.minimum.reduceat(rank[d], at), many))
                yield from _answers(key_type, "firsts", all_keys, d[least], p[least])

    return run


def in_several(docs: DataFrame, places: Callable, key: str, firsts: bool = False, step: int = STEP) -> DataFrame:
    """``key, places, firsts``: of each document the places whose hashes another document has too (several rows per document, either column may be null).

    firsts: if asked for, those of the places whose hashes no document with a lesser key has. places: function of
    batches that gives chunks (keys, document's index, place, first hashes, second hashes or None); a key stands in one chunk.
    """
    parts = width(docs.sparkSession)
    schema = pa.schema([
        ("part", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary()), ("docs", pa.list_(_arrow_key(key))),
    ])

    def run(batches):
        for keys, doc, pos, h1, h2 in places(batches):
            if len(h1):
                for r in pack(keys, doc, pos, h1, h2, parts):
                    own = pa.ListArray.from_arrays(pa.array([0, len(r["docs"])], pa.int32()), r["docs"].cast(_arrow_key(key)))
                    yield pa.RecordBatch.from_arrays([*(pa.array([r[c]], schema.field(c).type) for c in schema.names[:-1]), own], schema=schema)

    sent = docs.mapInArrow(run, f"part int, h1 binary, h2 binary, doc binary, pos binary, docs array<{key}>")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(_meet(key, firsts, step), f"key {key}, places array<int>, firsts array<int>")
