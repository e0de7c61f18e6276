"""Long exact spans shared between texts, by difference-cover anchors that are extended.

A difference cover D of period v has for any two places i, j a shift d < v with both i + d and j + d in D (modulo v). So any two equal spans of
``least`` characters hold an equal window of w = least - v + 1 characters that starts at a place of D in both texts. Only
these places are hashed and shuffled (exchange.py). A shared anchor is then extended by v - 1 characters to both sides, or to
the text's end: if another text has the whole hull too, all spans around the anchor are shared, and a passage of any length is
settled by its anchors alone. Where a hull is not shared, at the ends of passages, the starts of ``least`` characters are
compared one by one, and with them those of the first text with each shared hull, which stands for all that have it; each
start with all texts at once by a 128-bit fingerprint. So no pair of texts is ever formed. Texts that are equal as a whole
are one class, found before anything is hashed.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseq.common import cut, pick
from arborseq.llm.exchange import in_several

#: Characters that are hashed at a time.
SEGMENT = 1 << 20
#: Characters of the texts of one chunk.
CHUNK = 1 << 24
#: Leading bits of an anchor's hash that are sent; hulls and spans are compared by 128 bits, so a chance match costs work only.
ANCHOR_BITS = 48
_MASK = (1 << 64) - 1


@lru_cache
def cover(most: int) -> tuple[int, tuple[int, ...]]:
    """(v, D) of the largest v = q^2 + q + 1 <= most with a prime q: the q + 1 zeros of a linear recurrence of order 3 modulo q, in
    which each difference occurs once; (1, (0,)) if there is none."""
    for q in range(most, 1, -1):
        v = q * q + q + 1
        if v > most or any(q % k == 0 for k in range(2, int(q**0.5) + 1)):
            continue
        for a, b, c in product(range(q), range(q), range(1, q)):
            x, zeros = [0, 0, 1], []
            for i in range(v):
                if x[0] == 0:
                    zeros.append(i)
                x = [x[1], x[2], (a * x[2] + b * x[1] + c * x[0]) % q]
            if len(zeros) == q + 1 and len({(i - j) % v for i in zeros for j in zeros}) == v:
                return v, tuple(zeros)
    return 1, (0,)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roll:
    """Hashes of windows of at most w characters: differences of prefix sums of mixed characters times powers of an odd base."""

    def __init__(self, w: int, seed: int, segment: int = SEGMENT):
        self.w, self.seed, self.segment = w, seed, segment
        base = (0x9E3779B97F4A7C15 * (2 * seed + 1)) & _MASK | 1
        n = segment + w + 1
        self.up = np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))
        self.down = np.cumprod(np.append(np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)))

    def __call__(self, codes: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of codes[at:end]."""
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64), self.seed) * self.up[: len(codes)], out=sums[1:])
        return _mixed((sums[end] - sums[at]) * self.down[at], self.seed)

    def of(self, texts: list[np.ndarray], places: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Hashes of the windows (starts ascending, ends) of each text, in order."""
        out, group, held = [np.zeros(0, np.uint64)], [], 0

        def flush():
            if group:
                start = np.cumsum([0] + [len(c) for c, _, _ in group])
                at, end = (np.concatenate([g[k] + s for g, s in zip(group, start)]) for k in (1, 2))
                out.append(self(np.concatenate([g[0] for g in group]), at, end))
                group.clear()

        for codes, (at, end) in zip(texts, places):
            if not len(at):
                continue
            if held + len(codes) > self.segment:
                flush()
                held = 0
            if len(codes) <= self.segment:
                group.append((codes, at, end))
                held += len(codes)
                continue
            for s in range(0, len(codes), self.segment):
                lo, hi = np.searchsorted(at, [s, s + self.segment])
                if hi > lo:
                    out.append(self(codes[s : s + self.segment + self.w - 1], at[lo:hi] - s, end[lo:hi] - s))
        flush()
        return np.concatenate(out)


def _codes(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)


def _ints(lists: pa.Array, i: int) -> np.ndarray:
    return np.unique(lists[i].values.to_numpy(zero_copy_only=False)).astype(np.int64) if lists[i].is_valid else np.zeros(0, np.int64)


class Cover:
    """The sizes that belong to spans of ``least`` characters."""

    def __init__(self, least: int, chunk: int, segment: int):
        self.least, self.chunk, self.segment = least, chunk, segment
        self.v, self.inside = cover(least * 2 // 7)
        self.w = least - self.v + 1

    def hull(self, anchors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the hulls in a text of n characters."""
        return np.maximum(anchors - self.v + 1, 0), np.minimum(anchors + self.w + self.v - 1, n)


def _chunks(c: Cover, find, *rolls: tuple[int, int], bits: int = 64):
    """Chunks of texts for in_several; the batches' first column is the key. find: (codes, batch, row) -> places, windows' starts (ascending) and ends, salt."""

    def run(batches):
        made = [Roll(*r, c.segment) for r in rolls]
        keys, texts, found, held = [], [], [], 0

        def chunk():
            doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            place, salt = (np.concatenate([f[k] for f in found]) for k in (0, 3))
            hashes = [r.of(texts, [f[1:3] for f in found]) for r in made]
            if salt.any():
                hashes = [_mixed(h + salt.astype(np.uint64), r.seed) for h, r in zip(hashes, made)]
            hashes[0] &= np.uint64(_MASK ^ ((1 << 64 - bits) - 1))
            return pa.concat_arrays(keys), doc, place, hashes[0], hashes[1] if len(hashes) > 1 else None

        for b in batches:
            keys.append(b.column(0))
            texts_of = b.column("text")
            for row in range(b.num_rows):
                codes = _codes(texts_of[row].as_py())
                got = find(codes, b, row)
                texts.append(codes if len(got[0]) else codes[:0])
                found.append(got)
                held += len(texts[-1])
            if held > c.chunk:
                yield chunk()
                keys, texts, found, held = [], [], [], 0
        if keys:
            yield chunk()

    return run


def _anchors(c: Cover):
    held = np.zeros(0, np.int64)

    def find(codes, b, row):
        nonlocal held
        n = len(codes) - c.w + 1
        if not len(held) or held[-1] < n:
            held = (np.arange(0, max(2 * n, 1 << 16), c.v)[:, None] + np.array(c.inside)).ravel()
        at = held[: np.searchsorted(held, n)]
        return at, at, at + c.w, np.zeros(len(at), np.int64)

    return _chunks(c, find, (c.w, 1), bits=ANCHOR_BITS)


def _hulls(c: Cover):
    """The hulls of the anchors. The salt tells hulls apart that end with the text at unlike distances."""
    def find(codes, b, row):
        at = _ints(b.column("anchors"), row)
        lo, hi = c.hull(at, len(codes))
        return at, lo, hi, (at - lo) * c.v + hi - at - c.w

    size = c.least + c.v - 1
    return _chunks(c, find, (size, 2), (size, 3))


def _starts(c: Cover):
    """The starts of spans around the anchors that have no shared hull or are the first with it."""
    def find(codes, b, row):
        n = len(codes) - c.least + 1
        settled = _ints(b.column("settled"), row)
        anchors = np.union1d(np.setdiff1d(_ints(b.column("anchors"), row), settled, True), _ints(b.column("firsts"), row))
        near = np.zeros(n + 1, np.int64)
        np.add.at(near, np.clip(anchors - c.v + 1, 0, n), 1)
        np.add.at(near, np.clip(anchors + 1, 0, n), -1)
        at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
        return at, at, at + c.least, np.zeros(len(at), np.int64)

    return _chunks(c, find, (c.least, 2), (c.least, 3))


def _covered(c: Cover):
    """doc_id and characters in the union of the spans at the starts and around the anchors with a shared hull."""
    def run(batches):
        for b in batches:
            sums = []
            for row in range(b.num_rows):
                starts = _ints(b.column("starts"), row)
                lo, hi = c.hull(_ints(b.column("settled"), row), b.column("n")[row].as_py())
                long = hi - lo >= c.least
                lo, hi = np.concatenate([starts, lo[long]]), np.concatenate([starts + c.least, hi[long]])
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                sums.append(int((hi - np.maximum(lo, np.append(0, hi[:-1]))).clip(0).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.int64())], ["doc_id", "shared_chars"])

    return run


def _per_key(answers: DataFrame, key: str, places: str, *firsts: str) -> DataFrame:
    join = lambda c, name: F.flatten(F.collect_list(c)).alias(name)
    return answers.groupBy(F.col("key").alias(key)).agg(join("places", places), *(join("firsts", f) for f in firsts))


def shared_spans(docs: DataFrame, least: int = 240, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """``doc_id, shared_chars`` of the texts with a span of ``least`` code points or more that is in the text of another doc_id too.

    shared_chars: characters in any such span, each once. Null and shorter texts and null ids give none; rows with equal doc_id and
    text count once (doc_id is unique otherwise). Spans are told apart by 128-bit fingerprints, whole texts by MD5. Empty tables give no rows.
    """
    c = Cover(least, chunk, segment)
    texts = pick(docs, doc_id="doc_id", text="text").where(F.col("doc_id").isNotNull() & (F.length("text") >= least))
    texts = texts.select(F.col("doc_id").cast("bigint"), F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b"")).alias("text_md5"), "text")
    classes = texts.groupBy("text_md5").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("text").alias("text"))
    # the columns of the join below in their order, so that both read one shuffle of the texts
    anchors = in_several(classes.select("text_md5", "lo", "text"), _anchors(c), "binary")
    held = cut(classes.join(_per_key(anchors, "text_md5", "anchors"), "text_md5").select("lo", "text", "anchors", F.length("text").alias("n")))
    hulls = cut(_per_key(in_several(held, _hulls(c), "bigint", True), "lo", "settled", "firsts"))
    starts = in_several(held.join(hulls, "lo", "left").select("lo", "text", "anchors", "settled", "firsts"), _starts(c), "bigint")
    both = _per_key(starts, "lo", "starts").join(hulls, "lo", "full").join(held.select("lo", "n"), "lo")
    partly = both.select("lo", "n", "starts", "settled").mapInArrow(_covered(c), "doc_id bigint, shared_chars bigint").where("shared_chars > 0")
    members = texts.select("doc_id", "text_md5", F.length("text").cast("bigint").alias("shared_chars"))
    several = members.groupBy("text_md5").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    copied = members.join(several, "text_md5", "left_semi").select("doc_id", "shared_chars").distinct()
    return partly.join(copied.select("doc_id"), "doc_id", "left_anti").unionByName(copied)
