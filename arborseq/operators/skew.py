"""Per-key figures of event logs in which few keys hold most rows, by multi-level aggregation of chunks.

Nothing here gathers a key in one task. The longest wait needs a key's events in time order: the rows are range-partitioned by (key,
ts), which splits a hot key over as many tasks as its rows need, and each task folds its sorted Arrow batches (the
chunks) into one state (first, last, longest gap) per key. Rows and records are counted from packed positions, which fold repeated
deliveries before they are shuffled, into one state (rows, records) per key and task. The states go up a tree: in each
round those of ``FAN_IN`` neighbouring tasks are merged, so no task gets more than that many of a key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseq.common import cut, maybe_broadcast, pick, width
from arborseq.operators.events import beyond_first_word, packed, record_parts
from arborseq.operators.tree import holding_rows

FAN_IN = 16

_STATE = "is_parent boolean, key_value string, part int, lo bigint, hi bigint, gap bigint, edge boolean"
_ARROW = pa.schema([
    ("is_parent", pa.bool_()), ("key_value", pa.string()), ("part", pa.int32()),
    ("lo", pa.int64()), ("hi", pa.int64()), ("gap", pa.int64()), ("edge", pa.bool_()),
])


def _chunk(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of equal keys in a sorted batch: first row, first and last time, longest gap."""
    flag, key = b.column(0), b.column(1)
    ts = b.column(2).cast(pa.int64()).to_numpy(zero_copy_only=False)
    n = b.num_rows
    new = np.ones(n, bool)
    if n > 1:
        other = pc.or_(pc.not_equal(key.slice(1), key.slice(0, n - 1)), pc.not_equal(flag.slice(1), flag.slice(0, n - 1)))
        new[1:] = other.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new)
    step = np.zeros(n, np.int64)
    step[1:] = ts[1:] - ts[:-1]
    step[at] = 0
    return at, ts[at], ts[np.append(at[1:], n) - 1], np.maximum.reduceat(step, at)


def _states(batches):
    """Chunks of a sorted partition combined into one state per key; edge: the partition's first or last key."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held = None  # the last run so far: it may go on in the next batch

    def out(flags, keys, lo, hi, gap, edge):
        n = len(lo)
        return pa.RecordBatch.from_arrays(
            [flags, keys, *(pa.array(x, t) for x, t in zip((np.full(n, part), lo, hi, gap, edge), _ARROW.types[2:]))], schema=_ARROW
        )

    first = True
    for b in batches:
        if not b.num_rows:
            continue
        at, lo, hi, gap = _chunk(b)
        flags, keys = b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)).cast(pa.string())
        if held is not None:
            if held[0].equals(flags.slice(0, 1)) and held[1].equals(keys.slice(0, 1)):
                gap[0] = max(held[4], gap[0], lo[0] - held[3])
                lo[0] = held[2]
            else:
                yield out(held[0], held[1], [held[2]], [held[3]], [held[4]], [first])
                first = False
        n = len(at) - 1
        if n:
            edge = np.zeros(n, bool)
            edge[0], first = first, False
            yield out(flags.slice(0, n), keys.slice(0, n), lo[:-1], hi[:-1], gap[:-1], edge)
        held = flags.slice(n), keys.slice(n), int(lo[-1]), int(hi[-1]), int(gap[-1])
    if held is not None:
        yield out(held[0], held[1], [held[2]], [held[3]], [held[4]], [True])


_KEYS = ["is_parent", "key_value"]


def longest_waits(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``is_parent, key_value, gap``: microseconds of the longest time between neighbouring rows of a key; rows ``is_parent, key_value, ts``.

    Only the states at the edges of partitions, two per task at most, can belong to a key that goes on elsewhere.
    """
    parts = parts or width(rows.sparkSession)
    keys = _KEYS
    ordered = rows.repartitionByRange(parts, *keys, "ts").sortWithinPartitions(*keys, "ts")
    states = cut(ordered.mapInArrow(_states, _STATE))  # read twice, and a state per key only
    tree = states.where("edge")
    fan = 1
    while True:
        fan *= FAN_IN
        tree = tree.groupBy(*keys, F.expr(f"part div {fan}").alias("slot")).agg(
            F.array_sort(F.collect_list(F.struct("part", "lo", "hi", "gap"))).alias("c")
        )
        across = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i)["lo"] - F.get("c", i - 1)["hi"])
        tree = tree.select(
            *keys, F.get("c", F.lit(0))["part"].alias("part"), F.get("c", F.lit(0))["lo"].alias("lo"), F.get("c", F.size("c") - 1)["hi"].alias("hi"),
            F.greatest(F.array_max(F.col("c.gap")), F.when(F.size("c") > 1, F.array_max(across)).otherwise(F.lit(0))).alias("gap"),
        )
        if fan >= parts:
            break
    return states.where(~F.col("edge")).select(*keys, "gap").unionByName(tree.select(*keys, "gap"))


def up_the_tree(states: DataFrame, parts: int) -> DataFrame:
    """``is_parent, key_value, n_rows, n_records, gap`` of states ``is_parent, key_value, part, n_rows, n_records, gap`` (part: below parts, whose state it is).

    In each round the states of FAN_IN neighbouring parts are merged, by hash, those of a task before they are shuffled.
    """
    while True:
        states = states.groupBy(*_KEYS, F.expr(f"part div {FAN_IN}").cast("int").alias("part")).agg(
            F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"), F.max("gap").alias("gap")
        )
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return states.drop("part")


def key_figures(events: DataFrame, hierarchy: DataFrame, parts: int | None = None) -> DataFrame:
    """``field, key_value, n_rows, n_seqs, max_wait_s`` of each item of the events and of each direct parent of those items.

    n_rows: events (see events.py), n_seqs: distinct non-null seq_id, max_wait_s: longest time between neighbouring
    events of the key in ts order, whole seconds rounded down; 0 for fewer than two times (events without ts count
    for n_rows and n_seqs only). Null items and items without a parent give no parent row. Ties in ts are waits of 0; rows delivered
    again change nothing. Empty tables give no rows; further columns are ignored. parts: tasks in time order, the session's shuffle width by default.
    """
    ev = pick(events, seq_id="seq_id", pos="pos", item="item", ts="ts").where(F.col("item").isNotNull())
    parts = parts or width(ev.sparkSession)
    parents = maybe_broadcast(cut(holding_rows(hierarchy).where(F.col("parent").isNotNull())))
    far = beyond_first_word(ev)
    words = packed(ev, "item")
    by_parent = words.join(parents, "item").groupBy("seq_id", "parent", "word").agg(F.bit_or("bits").alias("bits"))
    items = record_parts(words, ["item"], far).select(F.lit(False).alias("is_parent"), F.col("item").alias("key_value"), "n_rows", "n_records")
    tops = record_parts(by_parent, ["parent"], far).select(F.lit(True), "parent", "n_rows", "n_records")
    # the task of a count only spreads a key's states
    task = F.pmod(F.spark_partition_id(), F.lit(parts)).alias("part")
    counts = items.select("*", task).unionByName(tops.toDF(*items.columns).select("*", task))
    timed = ev.where(F.col("ts").isNotNull()).select("item", "ts").join(parents, "item", "left")
    both = F.array(
        F.struct(F.lit(False).alias("is_parent"), F.col("item").alias("key_value")),
        F.struct(F.lit(True).alias("is_parent"), F.col("parent").alias("key_value")),
    )
    keyed = timed.select(F.explode(F.when(F.col("parent").isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("k"), "ts")
    waits = longest_waits(keyed.select("k.is_parent", "k.key_value", "ts"), parts)
    zero = F.lit(0).cast("bigint")
    states = counts.withColumn("gap", F.lit(None).cast("bigint")).unionByName(
        waits.select(*_KEYS, zero.alias("n_rows"), zero.alias("n_records"), F.lit(0).alias("part"), "gap")
    )
    return up_the_tree(states, parts).select(
        F.when(F.col("is_parent"), F.lit("parent")).otherwise(F.lit("item")).alias("field"), "key_value", "n_rows",
        F.col("n_records").alias("n_seqs"), F.coalesce(F.expr("gap div 1000000"), F.lit(0)).alias("max_wait_s"),
    )
