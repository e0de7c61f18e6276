"""The most frequent items of a column: Space-Saving summaries per partition, merged in a tree, then an exact second pass.

A summary holds at most ``counters`` items with an upper bound of their count, the error in it, and a floor that bounds the count of every item
that it doesn't hold. An Arrow batch's exact counts are a summary with floor 0, and all merges are of one kind: bounds
of the items add up, with the floor standing in for a missing item, and the greatest ``counters`` are kept. The
candidates' events are then counted exactly. The floor is at most rows / counters, far below the threshold; should rows delivered
again many times lift it so that it could hide an item, the summaries are made again with more counters. So the answer doesn't
depend on their number.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseq.common import pick

COUNTERS = 8_192
FAN_IN = 16
#: Rows that a task counts exactly before it merges them into its summary.
CHUNK = 1_000_000

_SCHEMA = "part long, item string, bound long, error long, floor long"


def _merge(frames: list[pd.DataFrame], floors: list[int], counters: int) -> tuple[pd.DataFrame, int]:
    """frames: indexed by item, with bound and error. A missing item counts as a bound and an error of that floor."""
    total = sum(floors)
    parts = [f.assign(bound=f["bound"] - w, error=f["error"] - w) for f, w in zip(frames, floors)]
    out = pd.concat(parts).groupby(level=0, sort=False).sum() + total
    if len(out) > counters:
        out = out.sort_values("bound", ascending=False, kind="stable")
        total = max(total, int(out["bound"].iloc[counters]))
        out = out.iloc[:counters]
    return out, total


def _local(counters: int):
    def run(batches):
        from pyspark import TaskContext

        summary, floor, held, n = None, 0, [], 0

        def fold():
            nonlocal summary, floor
            counts = pc.value_counts(pa.chunked_array(held, pa.string()).drop_null())
            exact = pd.DataFrame({"bound": counts.field(1).to_numpy(), "error": 0}, index=pd.Index(counts.field(0).to_pylist(), dtype=object))
            summary, floor = _merge([exact] if summary is None else [summary, exact], [0] if summary is None else [floor, 0], counters)

        for b in batches:
            held.append(b.column(0).cast(pa.string()))
            n += b.num_rows
            if n >= CHUNK:
                fold()
                held, n = [], 0
        if held:
            fold()
        if summary is not None:
            yield pa.RecordBatch.from_pandas(_rows(TaskContext.get().partitionId(), summary, floor), preserve_index=False)

    return run


def _rows(part: int, summary: pd.DataFrame, floor: int) -> pd.DataFrame:
    return pd.DataFrame({
        "part": pd.Series(part, index=range(len(summary)), dtype="int64"), "item": list(summary.index),
        "bound": summary["bound"].to_numpy("int64"), "error": summary["error"].to_numpy("int64"), "floor": floor,
    }).astype({"floor": "int64"})


def summaries(items: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``part, item, bound, error, floor``: one summary of a column ``item``; bound - error <= rows with the item <= bound."""
    parts = items.rdd.getNumPartitions()
    tree = items.select("item").mapInArrow(_local(counters), _SCHEMA)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = [g.set_index("item") for _, g in pdf.groupby("part", sort=True)]
        summary, floor = _merge([g[["bound", "error"]] for g in own], [int(g["floor"].iloc[0]) for g in own], counters)
        return _rows(int(key[0]), summary, floor)

    while parts > 1:
        tree = tree.groupBy(F.expr(f"part div {FAN_IN}").alias("slot")).applyInPandas(merge, _SCHEMA)
        parts = -(-parts // FAN_IN)
    return tree


def heavy_events(events: DataFrame, per: int = 250, counters: int = COUNTERS) -> DataFrame:
    """``item, n_events, bound, error`` of the items with at least 1 / per of all events (see operators/events.py).

    bound, error: of the item's delivered rows, from the summary. Rows delivered again count once in n_events. Ties at the threshold
    are all kept; unlike items at one position are events of their own; nulls are no items; empty tables give no rows.
    """
    spark = events.sparkSession
    ev = pick(events, seq_id="seq_id", pos="pos", item="item").where(F.col("item").isNotNull())
    pos = F.col("pos").cast("bigint")
    while True:
        top = summaries(ev, counters).drop("part").toPandas()
        if top.empty:
            return spark.createDataFrame([], "item string, n_events bigint, bound bigint, error bigint")
        floor = int(top["floor"].iloc[0])
        # an item that no summary holds has at most ``floor`` rows, so no more events: tested after the second pass, which has all events' number
        candidates = top[top["bound"] > floor] if floor else top
        known = F.broadcast(spark.createDataFrame(candidates[["item", "bound", "error"]]))  # at most ``counters`` rows
        found = ev.join(known.select("item", F.lit(True).alias("known")), "item", "left")
        # other items are told apart by a hash only, for the number of all events
        words = found.select(
            F.when(F.col("known"), F.col("item")).alias("item"), F.when(F.col("known").isNull(), F.xxhash64("item")).alias("other"), "seq_id", F.coalesce(F.shiftright(pos, 6), F.lit(-1 << 57)).alias("word"),
            F.expr("shiftleft(1L, cast(coalesce(cast(pos as bigint), 0) & 63 as int))").alias("bit"),
        ).groupBy("seq_id", "item", "other", "word").agg(F.bit_or("bit").alias("bits"))
        counts = words.groupBy("item").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n_events")).toPandas()
        total = int(counts["n_events"].sum())
        if floor * per >= total and len(top) >= counters:
            counters *= 4
            continue
        good = counts[counts["item"].notna() & (counts["n_events"] * per >= total)].merge(candidates, on="item")
        return spark.createDataFrame(
            [(r.item, int(r.n_events), int(r.bound), int(r.error)) for r in good.itertuples()], "item string, n_events bigint, bound bigint, error bigint"
        )
