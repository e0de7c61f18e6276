"""Passages of evaluation texts inside a corpus, by the q-gram lemma.

Texts are compared as their words (longest runs of letters and digits of the lower-cased text) with one blank around each.
A passage, ``words`` consecutive words of a question, is m characters long; within e edits it shares at least m - q + 1 - q e
q-grams with the text, on diagonals that differ by e at most. So shared q-grams are counted per (text, question, band of
diagonals), with overlapping bands, passages with fewer in a band are dropped, and the others are verified by an alignment there.
q is small enough for that bound to be 1 at least, for any number of edits under m.

A block of questions goes to the workers, and each text is read where it lies. More questions are put into blocks by a shuffle, not by
the driver; each block gives a filter of fixed size of its q-grams; one pass over the corpus holds each text against all filters, and only
texts with enough q-grams of a block close together are sent to that block, in groups of bounded size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseq.common import cut, pick
from arborseq.llm.tokens import _pieces

#: Questions of one block.
BLOCK = 20_000
#: Blocks whose filters are held at a time, and bits of a filter (2 ** FILTER_BITS).
FILTERS, FILTER_BITS = 32, 23
#: Texts of one group that is sent to a block.
GROUP = 4_000
#: Hits of q-grams that are held at a time.
HITS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_line(text: str, pattern) -> str:
    """`` w1 w2 ... wn `` of a text."""
    return pattern.sub(" ", " " + text.lower() + " ")


def _not_words():
    import regex

    return regex.compile(r"[^\p{L}\p{N}]+")


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each place."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = (h + codes[k : k + n].astype(np.uint64)) * _BASE
        h ^= h >> np.uint64(29)
    return h


def _passages(line: str, words: int) -> list[tuple[int, int]]:
    """(start, stop) of each passage in a question's line, both blanks included."""
    blanks = [i for i, c in enumerate(line) if c == " "]
    return [(blanks[i], blanks[i + words] + 1) for i in range(len(blanks) - words)]


def gram_size(least: int, edits: int) -> int:
    """q for passages of ``least`` characters at least, so that the lemma's bound is 1 at least."""
    if least <= edits:
        raise ValueError(f"a passage of {least} characters is within {edits} edits of any text")
    return max(1, least * 2 // (3 * (edits + 1)))


class Questions:
    """The passages of a block of questions and an index of their q-grams."""

    def __init__(self, rows: list[tuple[int, str]], words: int, edits: int, q: int | None = None):
        split = _not_words()
        self.edits, self.words = edits, words
        self.items: list[int] = []
        lines: list[str] = []
        #: (question, start, stop) of each passage
        spans: list[tuple[int, int, int]] = []
        for item, text in rows:
            line = word_line(text, split)
            if own := _passages(line, words):
                spans += [(len(lines), a, b) for a, b in own]
                self.items.append(item)
                lines.append(line)
        self.spans = np.array(spans, np.int64).reshape(-1, 3)
        size = self.spans[:, 2] - self.spans[:, 1]
        self.q = q or gram_size(int(size.min(initial=60)), edits)
        self.lines = [_codes(x) for x in lines]
        self.flat = np.concatenate([*self.lines, np.zeros(0, np.uint32)])
        self.line_at = np.cumsum([0] + [len(x) for x in self.lines])
        self.bound = size - self.q + 1 - self.q * edits
        self.least = np.full(len(lines), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.spans[:, 0], self.bound)
        self.first_span = np.searchsorted(self.spans[:, 0], np.arange(len(lines) + 1))
        grams = [_grams(x, self.q) for x in self.lines]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(lines)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.post_item, self.post_place = item[order], place[order]
        self.keys, self.first, self.many = np.unique(h[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[_slot(self.keys)] = True


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _regions(qs: Questions, codes: np.ndarray, at: np.ndarray):
    """(text, passage, lowest diagonal) of the passages with enough shared q-grams in a band; codes: lines of the texts, at: their offsets."""
    h = _grams(codes, qs.q)
    place = np.flatnonzero(qs.filter[_slot(h)])
    key = np.minimum(np.searchsorted(qs.keys, h[place]), len(qs.keys) - 1)
    good = qs.keys[key] == h[place]
    place, key = place[good], key[good]
    wide = 2 * (qs.edits + 1)
    shift = int(qs.line_at[-1]) + wide  # diagonals are made positive by it
    n_band = (int(np.diff(at).max(initial=0)) + 2 * shift) * 2 // wide + 4
    longest = int(np.diff(qs.line_at).max(initial=0)) + 1
    text = np.searchsorted(at, place, "right") - 1
    many = qs.many[key]
    total = np.cumsum(many)
    out, lo = [], 0
    while lo < len(place):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + HITS, "right")))
        # a text's hits stay together
        if hi < len(place) and text[hi] != text[lo]:
            hi = int(np.searchsorted(text, text[hi], "left"))
        elif hi < len(place):
            hi = int(np.searchsorted(text, text[lo], "right"))
        m = many[lo:hi]
        post = np.repeat(qs.first[key[lo:hi]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        t = np.repeat(text[lo:hi], m)
        diag = np.repeat(place[lo:hi], m) - at[t] - qs.post_place[post] + shift
        q, q_place = qs.post_item[post], qs.post_place[post]
        group = t * len(qs.lines) + q
        for half in (0, 1):
            code = group * n_band + (diag + half * (wide // 2)) // wide
            own, inv, n = np.unique(code, return_inverse=True, return_counts=True)
            keep = n >= qs.least[(own // n_band) % len(qs.lines)]
            if not keep.any():
                continue
            number = np.cumsum(keep) - 1
            inside = keep[inv]
            hits = np.unique(number[inv[inside]] * longest + q_place[inside])  # each q-gram of the question once
            g, band = np.divmod(own[keep], n_band)
            asked = g % len(qs.lines)
            spans = qs.first_span[asked + 1] - qs.first_span[asked]
            row = np.repeat(np.arange(len(g)), spans)
            span = qs.first_span[asked[row]] + np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans)
            a, b = qs.spans[span, 1], qs.spans[span, 2]
            shared = np.searchsorted(hits, row * longest + b - qs.q + 1) - np.searchsorted(hits, row * longest + a)
            ok = shared >= qs.bound[span]
            row, span = row[ok], span[ok]
            out.append(np.stack([g[row] // len(qs.lines), span, band[row] * wide - half * (wide // 2) - shift], 1))
        lo = hi
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def _align(qs: Questions, codes: np.ndarray, at: np.ndarray, regions: np.ndarray, step: int = 100_000):
    """(text, question, edits) of the regions' passages within the edits allowed."""
    wide, e = 2 * (qs.edits + 1), qs.edits
    found = [np.zeros((0, 3), np.int64)]
    for lo in range(0, len(regions), step):
        r = regions[lo : lo + step]
        span = qs.spans[r[:, 1]]
        size = span[:, 2] - span[:, 1]
        start = at[r[:, 0]] + r[:, 2] + span[:, 1]  # of the text, on the band's lowest diagonal
        low, high = at[r[:, 0]], at[r[:, 0] + 1]
        # cost[k]: least edits of the passage so far against a part of the text that ends on diagonal k of the band
        k = np.arange(-e, wide + e)
        cost = np.zeros((len(r), len(k)), np.int16)
        for i in range(int(size.max(initial=0))):
            live = i < size
            where = start[:, None] + k[None, :] + i
            inside = (where >= low[:, None]) & (where < high[:, None])
            c = codes[np.clip(where, 0, len(codes) - 1)]
            p = qs.flat[np.minimum(qs.line_at[span[:, 0]] + span[:, 1] + i, len(qs.flat) - 1)]
            same = (c == p[:, None]) & inside
            new = np.where(same, cost, cost + 1)
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a character of the passage is missing in the text
            for j in range(1, len(k)):  # a character of the text is none of the passage
                new[:, j] = np.minimum(new[:, j], new[:, j - 1] + 1)
            cost = np.where(live[:, None], new, cost)
        best = cost.min(1)
        good = best <= e
        found.append(np.stack([r[good, 0], span[good, 0], best[good].astype(np.int64)], 1))
    return np.concatenate(found)


def _search(qs: Questions, ids: pa.Array, texts: pa.Array, split):
    """Batches (doc_id, item_id, edits) of the texts, a bounded number of characters at a time."""
    for lo, hi in _pieces(texts):
        lines = [word_line(t, split) for t in texts.slice(lo, hi - lo).to_pylist()]
        at = np.cumsum([0] + [len(x) + 1 for x in lines])
        codes = _codes("\n".join(lines) + "\n")
        found = _align(qs, codes, at, _regions(qs, codes, at))
        if len(found):
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(1))]
            items = np.array(qs.items, np.int64)[found[:, 1]]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(found[:, 0])), pa.array(items), pa.array(found[:, 2].astype(np.int32))], schema=_ARROW)


_SCHEMA = "doc_id bigint, item_id bigint, edits int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32())])


def _close(hit: np.ndarray, window: int, least: int) -> bool:
    """Whether so many of the hits lie within a window."""
    total = np.cumsum(hit)
    if not len(total) or total[-1] < least:
        return False
    inside = total.copy()
    inside[window:] -= total[:-window]
    return bool(inside.max() >= least)


def _in_blocks(texts: DataFrame, questions: DataFrame, words: int, edits: int, blocks: int) -> DataFrame:
    """All pairs of texts and questions by passes over the texts, one for each FILTERS blocks of questions."""
    sc = texts.sparkSession.sparkContext

    def sizes(batches):
        split = _not_words()
        for b in batches:
            own = [z - a for t in b.column(1).to_pylist() for a, z in _passages(word_line(t, split), words)]
            yield pa.RecordBatch.from_arrays([pa.array([min(own, default=None)], pa.int64()), pa.array([max(own, default=None)], pa.int64())], ["lo", "hi"])

    lo, hi = questions.mapInArrow(sizes, "lo bigint, hi bigint").agg(F.min("lo"), F.max("hi")).first()
    if lo is None:
        return texts.sparkSession.createDataFrame([], _SCHEMA)
    q = gram_size(lo, edits)
    least, window = lo - q + 1 - q * edits, hi - q + 1 + 2 * edits
    questions = cut(questions.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")))

    def rows_of(t: pa.Table) -> list[tuple[int, str]]:
        return list(zip(t.column("item_id").to_pylist(), t.column("text").to_pylist()))

    def filter_of(t: pa.Table) -> pa.Table:
        qs = Questions(rows_of(t), words, edits, q)
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(qs.filter).tobytes()])})

    def match(key, left: pa.Table, right: pa.Table) -> pa.Table:
        qs = Questions(rows_of(right), words, edits, q)
        if not len(left) or not qs.items:
            return _ARROW.empty_table()
        found = list(_search(qs, left.column("doc_id").combine_chunks(), left.column("text").combine_chunks(), _not_words()))
        return pa.Table.from_batches(found, schema=_ARROW)

    out = []
    for first in range(0, blocks, FILTERS):
        own = questions.where((F.col("block") >= first) & (F.col("block") < first + FILTERS))
        filters = own.groupBy("block").applyInArrow(filter_of, "block int, bits binary").collect()  # FILTERS of fixed size at most
        sent = sc.broadcast([(r.block, np.frombuffer(r.bits, np.uint8)) for r in filters])

        def route(batches, sent=sent):
            split = _not_words()
            for b in batches:
                which, row = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    slot = _slot(_grams(_codes(word_line(t, split)), q))
                    byte, bit = slot >> 3, (7 - (slot & 7)).astype(np.uint8)
                    for block, bits in sent.value:
                        if _close((bits[byte] >> bit) & 1, window, least):
                            which.append(block)
                            row.append(i)
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), b.column(0).take(at), b.column(1).take(at)], ["block", "doc_id", "text"])

        routed = cut(texts.mapInArrow(route, "block int, doc_id bigint, text string"))
        groups = routed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
        asked = own.join(F.broadcast(groups), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        routed = routed.join(F.broadcast(groups), "block").withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), "groups").cast("int")).drop("groups")
        out.append(routed.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(match, _SCHEMA))
    return reduce(DataFrame.unionByName, out)


def leaked(docs: DataFrame, questions: DataFrame, words: int = 10, edits: int = 1, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, edits``: texts that hold ``words`` consecutive words of a question within so many edits of characters.

    edits: of the best passage, blanks around words included; 0: the words are there in order, unbroken. Each pair once. Null texts,
    null ids and questions of fewer words give none; questions with equal texts are all reported; edits that could
    make up a whole passage are an error. Empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = pick(questions, item_id="item_id", text="text").where("item_id is not null and text is not null").distinct()
    asked = asked.select(F.col("item_id").cast("bigint"), "text")
    texts = pick(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    some = asked.limit(block + 1).collect()
    if len(some) > block:
        found = _in_blocks(texts, asked, words, edits, -(-asked.count() // block))
    else:
        qs = Questions([(r.item_id, r.text) for r in some], words, edits)
        if not qs.items:
            return spark.createDataFrame([], _SCHEMA)
        sent = spark.sparkContext.broadcast(qs)

        def run(batches):
            split = _not_words()
            for b in batches:
                yield from _search(sent.value, b.column(0), b.column(1), split)

        found = texts.mapInArrow(run, _SCHEMA)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
