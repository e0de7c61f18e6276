"""Items that appear together: an external sort of packed pair codes.

Each task packs the pairs of its baskets' common items into 64 bits (two 32-bit codes) and sorts them into runs of codes with
their lengths; Spark's sorter spills and merges the runs of a shuffle partition; the merged codes are counted by run length.
Lift and odds ratios follow from the counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseq.common import cut, maybe_broadcast, width
from arborseq.functions.sets import run_lengths
from arborseq.llm.baskets import clean, encode, n_sequences, packed, unpacked

#: Pair codes that a task sorts into one run.
RUN = 4_000_000

_RUN = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def _pairs_of(codes: np.ndarray, stop: np.ndarray):
    """Packed pairs (codes[i], codes[j]) for i <= j < stop[i], in steps of bounded size; an item with itself counts the item."""
    place = np.arange(len(codes))
    many = stop - place
    total = np.cumsum(many)
    lo = 0
    while lo < len(codes):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + RUN, "right")))
        m = many[lo:hi]
        left = np.repeat(place[lo:hi], m)
        right = left + np.arange(len(left)) - np.repeat(total[lo:hi] - m - base, m)
        yield (codes[left].astype(np.int64) << 32) | codes[right]
        lo = hi


def _runs(batches):
    """Sorted runs of pair codes with counts."""

    def run(parts):
        c, n = run_lengths(np.concatenate(parts))
        for k in range(0, len(c), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]), pa.array(n[k : k + 100_000])], schema=_RUN)

    parts, held = [], 0
    for b in batches:
        at, codes = unpacked(b.column(0), np.int32)
        for x in _pairs_of(codes, np.repeat(at[1:], np.diff(at))):
            parts.append(x)
            held += len(x)
            if held >= RUN:
                yield from run(parts)
                parts, held = [], 0
    if held:
        yield from run(parts)


def _run_lengths(batches):
    """Sums of equal neighbouring codes of a sorted partition."""
    code, count = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        c, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        at = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        own, sums = c[at], np.add.reduceat(n, at)
        if code is not None:
            if own[0] == code:
                sums[0] += count
            else:
                own, sums = np.append(code, own), np.append(count, sums)
        yield pa.RecordBatch.from_arrays([pa.array(own[:-1]), pa.array(sums[:-1])], schema=_RUN)
        code, count = own[-1], sums[-1]
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code]), pa.array([count])], schema=_RUN)


def _told_apart(batches):
    """``seq_id, c`` for each code."""
    for b in batches:
        at, codes = unpacked(b.column(1), np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(at)))), pa.array(codes)], ["seq_id", "c"])


def _packed_lists(batches):
    for b in batches:
        lists = b.column(0)
        at = np.asarray(lists.offsets).astype(np.int64)
        yield pa.RecordBatch.from_arrays([packed(at - at[0], lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32))], ["codes"])


def _sorted_counts(baskets: DataFrame) -> DataFrame:
    """``code, n_ab`` from rows ``codes`` (packed, sorted, distinct)."""
    runs = baskets.mapInArrow(_runs, "code bigint, n bigint")
    merged = runs.repartition(width(runs.sparkSession), "code").sortWithinPartitions("code")
    return merged.mapInArrow(_run_lengths, "code bigint, n_ab bigint")


def items_together(sequences: DataFrame, least: int = 8, per_n: int | None = 500) -> DataFrame:
    """``item_a, item_b, n_ab, n_a, n_b, n, lift, odds_ratio`` of pairs item_a < item_b in at least ``least`` and N / per_n sequences.

    n_..: distinct non-null seq_id holding the item or both in any of its rows; n: N, all distinct seq_id. odds_ratio:
    with 0.5 added to each of the four cells. Nulls are no items; repeated items and rows count once; empty tables give no rows.
    """
    seqs = clean(sequences)
    n = n_sequences(seqs)
    least = max(1, least, -(-n // per_n) if per_n else 1)
    enc = encode(seqs, least, False, n)
    rows = enc.rows.where(~F.col("multi")).select("codes")
    several = enc.rows.where("multi")
    if not several.isEmpty():
        several = several.select("seq_id", "codes").mapInArrow(_told_apart, "seq_id bigint, c int")
        several = several.groupBy("seq_id").agg(F.sort_array(F.collect_set("c")).alias("codes")).select("codes")
        rows = rows.unionByName(several.mapInArrow(_packed_lists, "codes binary"))
    a, b = F.shiftright("code", 32).cast("int"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int")
    counts = cut(_sorted_counts(rows).where(F.col("n_ab") >= least).select(a.alias("a"), b.alias("b"), "n_ab"))
    n_item = counts.where("a = b").select(F.col("a").alias("tid"), F.col("n_ab").alias("n_item"))
    items = maybe_broadcast(cut(n_item.join(enc.ids, "tid").select("tid", "item", "n_item")))
    pairs = counts.where("a < b")
    named = pairs.join(items.toDF("a", "item_a", "n_a"), "a").join(items.toDF("b", "item_b", "n_b"), "b")
    return _with_odds(named.select("item_a", "item_b", "n_ab", "n_a", "n_b"), n)


def _with_odds(pairs: DataFrame, n: int) -> DataFrame:
    ab, a, b, total = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))
    pairs = pairs.withColumn("n", F.lit(n).cast("bigint"))
    odds = (ab + 0.5) * (total - a - b + ab + 0.5) / ((a - ab + 0.5) * (b - ab + 0.5))
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", (ab * total / (a * b)).alias("lift"), odds.alias("odds_ratio"))


def at_least_times_chance(pairs: DataFrame, times: int = 3) -> DataFrame:
    """The pairs that occur together at least so many times as often as chance has it; compared as whole numbers."""
    d = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where(d("n_ab") * d("n") >= F.lit(times).cast("decimal(3,0)") * (d("n_a") * d("n_b")))
