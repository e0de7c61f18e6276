"""Sequences as arrays of item codes, the common ground of pattern and pair counting."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseq.common import cut, is_small, maybe_broadcast, pick
from arborseq.functions.lookup import Lookup
from arborseq.functions.sets import distinct
from arborseq.operators.dictionary import ranked

#: Common items (of 48 MB at most) that go to the workers as a lookup; more are joined. The codes and all that follows are the same.
LOOKUP = 500_000


def packed(at: np.ndarray, values: np.ndarray) -> pa.Array:
    """Lists of numbers, as binary values: lists are slow on the way between Spark and Python."""
    ends = (at * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, numbers) of packed lists."""
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, dtype)
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (ends - ends[0]) // np.dtype(dtype).itemsize, np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype)


@dataclass
class Encoded:
    """rows: ``seq_id, codes, multi``, distinct; codes: packed 32-bit tids, 0 for any other item or null. multi: another row has the same
    seq_id. n: distinct seq_id. ids: ``tid, item``, 1 to n_items in code point order."""

    rows: DataFrame
    ids: DataFrame
    n_items: int
    n: int


def n_sequences(seqs: DataFrame) -> int:
    return seqs.select("seq_id").distinct().count()


def common_items(seqs: DataFrame, least: int) -> DataFrame:
    """``item``: non-null items in at least so many rows. Repeated rows count anew, so it holds all items of so many sequences."""
    one = seqs.select(F.explode(F.array_distinct("items")).alias("item")).where(F.col("item").isNotNull())
    return one.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("item")


def clean(sequences: DataFrame) -> DataFrame:
    """``seq_id, items`` of the rows with a seq_id; a null array counts as an empty one."""
    seqs = pick(sequences, seq_id="seq_id", items="items").where(F.col("seq_id").isNotNull())
    return seqs.select("seq_id", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _shaped(found: np.ndarray, at: np.ndarray, ordered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a row is of use, sizes of the rows of use, their codes) of rows of codes at these offsets; see encode."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    if ordered:
        hit = np.flatnonzero(found)
        first = np.full(n, len(found), np.int64)
        last = np.full(n, -1, np.int64)
        np.minimum.at(first, row[hit], hit)
        np.maximum.at(last, row[hit], hit)
        place = np.arange(len(found))
        keep = (place >= first[row]) & (place <= last[row])
        row, code = row[keep], found[keep]
        real = np.bincount(row[code > 0], minlength=n)
    else:
        packed = distinct((row[found > 0].astype(np.int64) << 32) | found[found > 0])
        row, code = packed >> 32, packed & 0xFFFFFFFF
        real = np.bincount(row, minlength=n)
    good = real >= (2 if ordered else 1)
    return good, np.bincount(row, minlength=n)[good], code[good[row]].astype(np.int32)


def _looked_up(seqs: DataFrame, words: list[str], ordered: bool) -> DataFrame:
    sent = seqs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        lookup = Lookup(sent.value)
        for b in batches:
            at = np.asarray(b.column(1).offsets)
            good, size, code = _shaped(lookup(b.column(1).flatten()) + 1, at - at[0], ordered)
            codes = packed(np.append(0, np.cumsum(size)), code)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), codes], ["seq_id", "codes"])

    return seqs.mapInArrow(run, "seq_id bigint, codes binary")


def _joined(seqs: DataFrame, ids: DataFrame, ordered: bool) -> DataFrame:
    """The same by a join with ``tid, item``; only common items are gathered again, a sequence at a time."""
    rows = cut(seqs.where(F.size("items") > 0).withColumn("row", F.monotonically_increasing_id()))
    one = rows.select("row", "seq_id", F.posexplode("items").alias("pos", "item")).where(F.col("item").isNotNull())
    found = one.join(ids, "item").groupBy("row", "seq_id").agg(F.collect_list(F.struct("pos", "tid")).alias("x"))

    def run(batches):
        for b in batches:
            at = np.asarray(b.column(1).offsets).astype(np.int64)
            x = b.column(1).flatten()
            pos, tid = (x.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            size = np.zeros(b.num_rows, np.int64)
            np.maximum.at(size, row, pos + 1)
            start = np.append(0, np.cumsum(size))
            flat = np.zeros(start[-1], np.int64)
            flat[start[row] + pos] = tid
            good, size, code = _shaped(flat, start, ordered)
            codes = packed(np.append(0, np.cumsum(size)), code)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), codes], ["seq_id", "codes"])

    return found.select("seq_id", "x").mapInArrow(run, "seq_id bigint, codes binary")


def encode(seqs: DataFrame, least: int, ordered: bool, n: int) -> Encoded:
    """Codes of the items in ``least`` rows at least.

    ordered: positions are kept (blanks at both ends are not), and rows with two occurrences of common items at least;
    else codes are the distinct common items, sorted, of the rows that hold any.
    """
    spark = seqs.sparkSession
    common = cut(common_items(seqs, least))
    if is_small(common, LOOKUP):
        items = sorted(r.item for r in common.collect())
        ids = spark.createDataFrame([(i + 1, x) for i, x in enumerate(items)], "tid int, item string")
        n_items, rows = len(items), _looked_up(seqs, items, ordered)
    else:
        ids = cut(ranked(common, F.col("item")).select(F.col("rank").cast("int").alias("tid"), "item"))
        n_items, rows = ids.count(), _joined(seqs, ids, ordered)
    rows = cut(rows.distinct())
    again = cut(rows.groupBy("seq_id").count().where(F.col("count") > 1).select("seq_id", F.lit(True).alias("again")))
    if again.isEmpty():
        return Encoded(rows.withColumn("multi", F.lit(False)), ids, n_items, n)
    rows = rows.join(maybe_broadcast(again), "seq_id", "left")
    return Encoded(cut(rows.select("seq_id", "codes", F.col("again").isNotNull().alias("multi"))), ids, n_items, n)
