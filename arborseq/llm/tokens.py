"""Byte-level BPE over a corpus in batched numpy merge rounds.

A task splits a batch of texts into words by the tokenizer's pattern and encodes only the words that it hasn't
seen: their symbols lie in one flat array; a round looks up the ranks of all neighbouring symbols by binary search in
the sorted pair keys, finds each word's lowest rank, merges all its pairs of that rank from the left without overlap, and
closes the gaps; words without a known pair are done. The merge table comes from the rank file alone and has the vocabulary's size.
A word of more than ``LONG`` bytes has rounds of its own that touch only the places with the round's rank, so that an endless word
costs what its merges cost.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseq.common import pick

LONG = 4_096
#: Words, and symbols of them, that a worker remembers.
CACHED = 400_000
CACHED_SYMBOLS = 8_000_000
NONE = np.iinfo(np.int64).max


def default_ranks() -> str:
    """The rank file of byte_bpe_50k where the public_tokenizers package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Merges:
    """byte_id: id of each byte; keys: sorted left * size + right; ids: merged id, which is the rank too."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._split(token, pairs)
                if len(parts) == 2:
                    pairs[parts[0] * self.size + parts[1]] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ids = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _split(self, token: bytes, pairs: dict[int, int]) -> list[int]:
        """The symbols of a token by the merges of lower rank: the two that its own merge joins."""
        s = [int(self.byte_id[b]) for b in token]
        while len(s) > 2:
            ranked = [(pairs.get(s[i] * self.size + s[i + 1], NONE), i) for i in range(len(s) - 1)]
            rank, i = min(ranked)
            if rank == NONE:
                break
            s[i : i + 2] = [rank]
        return s

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], NONE)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (none of which is empty)."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._linked(w)
        if not short:
            return out
        sym = self.byte_id[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        own = np.array(short)
        size = np.array([len(words[i]) for i in short])
        while len(sym):
            start = np.cumsum(size) - size
            last = start + size - 1
            rank = np.full(len(sym), NONE)
            rank[:-1] = self.rank(sym[:-1], sym[1:])
            rank[last] = NONE
            low = np.minimum.reduceat(rank, start)
            done = low == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[own[k]] = sym[start[k] : start[k] + size[k]].astype(np.int32)
                keep = np.repeat(~done, size)
                sym, rank, size, own, low = sym[keep], rank[keep], size[~done], own[~done], low[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, size)
            place = np.flatnonzero(hit)
            # of neighbouring hits (a symbol twice and more) every second one counts, from the left
            fresh = np.append(True, place[1:] != place[:-1] + 1)
            nth = np.arange(len(place)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            place = place[nth % 2 == 0]
            sym[place] = rank[place]
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            word = np.repeat(np.arange(len(size)), size)
            size = size - np.bincount(word[place], minlength=len(size))
            sym = sym[keep]
        return out

    def _linked(self, word: bytes) -> np.ndarray:
        """The ids of one long word: rounds over its ranks in order, each with only the places that have the rank.

        Symbols are linked; a merge looks up its two new pairs, whose ranks are higher, and enters them with those ranks.
        """
        sym = self.byte_id[np.frombuffer(word, np.uint8)]
        n = len(sym)
        nxt, prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks: list[int] = []
        places: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            at, rank = at[rank < NONE], rank[rank < NONE]
            cuts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else []
            for lo, hi in zip(cuts, np.append(cuts[1:], len(rank)) if len(cuts) else []):
                if (r := int(rank[lo])) not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(at[lo:hi])

        enter(np.arange(n - 1), self.rank(sym[:-1], sym[1:]))
        while ranks:
            rank = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[(sym[at] >= 0) & (nxt[at] < n)]
            at = at[self.rank(sym[at], sym[nxt[at]]) == rank]
            if not len(at):
                continue
            # of neighbouring pairs every second one counts, from the left
            fresh = np.append(True, nxt[at[:-1]] != at[1:])
            nth = np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at = at[nth % 2 == 0]
            gone = nxt[at]
            sym[at], sym[gone] = rank, -1
            nxt[at] = nxt[gone]
            later = at[nxt[at] < n]
            prev[nxt[later]] = later
            before = prev[at[prev[at] >= 0]]
            enter(later, self.rank(sym[later], sym[nxt[later]]))
            enter(before, self.rank(sym[before], sym[nxt[before]]))
        return sym[sym >= 0].astype(np.int32)

@lru_cache(maxsize=4)
def load(path: str) -> Merges:
    with open(path, "rb") as f:
        return Merges({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


class Encoder:
    """Texts to ids, with a bounded memory of words."""

    def __init__(self, merges: Merges, pattern: str):
        import regex

        # white space as Unicode has it, not as Python has it
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.lists: list[np.ndarray] = []
        self.symbols = 0

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts' ids."""
        if len(self.index) > CACHED or self.symbols > CACHED_SYMBOLS:
            self.clear()
        found = [self.words.findall(t) if t else [] for t in texts]
        new = list({w for ws in found for w in ws if w not in self.index})
        for w, ids in zip(new, self.merges.encode([w.encode() for w in new])):
            self.index[w] = len(self.lists)
            self.lists.append(ids)
            self.symbols += len(ids)
        index = self.index
        which = np.array([index[w] for ws in found for w in ws], np.int64)
        per_text = np.array([len(ws) for ws in found], np.int64)
        if not len(which):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        used, inv = np.unique(which, return_inverse=True)
        lists = [self.lists[i] for i in used]
        size = np.array([len(x) for x in lists])
        flat, start = np.concatenate(lists), np.cumsum(size) - size
        many = size[inv]
        ends = np.cumsum(many)
        ids = flat[np.repeat(start[inv], many) + np.arange(ends[-1]) - np.repeat(ends - many, many)]
        return np.append(0, np.append(0, ends)[np.cumsum(per_text)]), ids


def token_ids(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of each row: ids of the whole text as stored, without special tokens (their strings are ordinary text).

    An empty and a null text have an empty list. ranks: a rank file (base64 token, rank), read by the driver; the table sent to
    the workers has the size of the vocabulary. Without a shuffle; repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((load(ranks or default_ranks()), pattern or default_pattern()))

    def run(batches):
        enc = Encoder(*sent.value)
        for b in batches:
            for lo, hi in _pieces(b.column(1)):
                part = b.slice(lo, hi - lo)
                at, ids = enc.batch(part.column(1).to_pylist())
                lists = pa.LargeListArray.from_arrays(pa.array(at), pa.array(ids)).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _pieces(texts: pa.Array, most: int = 2_000_000):
    """Ranges of rows of about so many bytes of text."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi
