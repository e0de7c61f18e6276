"""Item frequencies, the dictionary, and sequences as ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from arborseq.common import LIMITS, cut, fetched, is_small, maybe_broadcast, pick
from arborseq.functions.lookup import HashedLookup
from arborseq.functions.sets import distinct, summed


def weighted(sequences: DataFrame) -> DataFrame:
    """``seq, items, weight``: seq is a key of the row (ids may repeat, each row is a sequence); weight is 1 unless there is such a column."""
    low = [c.lower() for c in sequences.columns]
    rows = pick(sequences, items="items", weight="weight") if "weight" in low else pick(sequences, items="items").withColumn("weight", F.lit(1).cast("bigint"))
    return rows.select(F.monotonically_increasing_id().alias("seq"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("weight").cast("bigint"))


def _column(t: pa.Table, name: str) -> pa.Array:
    return t.column(name).combine_chunks()


def _closure_arrays(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """(items, offsets, indexes of their ancestors, names of these) of a small closure."""
    items, up = _column(t, "item").dictionary_encode(), _column(t, "ancestor").dictionary_encode()
    at = items.indices.to_numpy(zero_copy_only=False)
    many = np.bincount(at, minlength=len(items.dictionary))
    return items.dictionary, np.append(0, np.cumsum(many)), up.indices.to_numpy(zero_copy_only=False)[np.argsort(at, kind="stable")], up.dictionary


def _climbed_arrays(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """The same from ``item, parent`` of a forest."""
    both = pa.concat_arrays([_column(t, "item"), _column(t, "parent")]).dictionary_encode()
    index, nodes = both.indices.to_numpy(zero_copy_only=False), both.dictionary
    up = np.full(len(nodes), -1, np.int32)
    up[index[: t.num_rows]] = index[t.num_rows :]
    rows, ids = [], []
    row = at = np.arange(len(nodes), dtype=np.int32)
    while len(at):
        rows.append(row)
        ids.append(at)
        at = up[at]
        row, at = row[at >= 0], at[at >= 0]
    row = np.concatenate([*rows, np.zeros(0, np.int32)])
    flat = np.concatenate([*ids, np.zeros(0, np.int32)])[np.argsort(row, kind="stable")]
    return nodes, np.append(0, np.cumsum(np.bincount(row, minlength=len(nodes)))), flat, nodes


_CLOSURE = pa.schema([("item", pa.string()), ("ancestor", pa.string())])


def flist(sequences: DataFrame, chain: DataFrame | None = None, here: pd.DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """``item, cf, df``: occurrences of each item or a descendant of it, and sequences that hold one, both weighted.

    chain: ``item, ancestor`` with each item itself (closure()); items missing in it stand for themselves. Counts are made per
    sequence where it lies and combined before the only shuffle, on the item's number. here: the rows of chain, if the driver has them.
    edges: ``item, parent`` that chain comes from; they are sent if chain is too large and they are not.
    """
    rows = weighted(sequences)
    if chain is None:
        chain = rows.sparkSession.createDataFrame([], "item string, ancestor string")
    chain = chain.select("item", "ancestor")
    if here is not None:
        arrays = _closure_arrays(pa.Table.from_pandas(here, _CLOSURE, preserve_index=False))
    elif is_small(chain):
        arrays = _closure_arrays(fetched(chain))
    elif edges is not None and is_small(edges) and chain.count() * 4 <= LIMITS.size:
        arrays = _climbed_arrays(fetched(edges))
    else:
        arrays = None
    if arrays is not None:
        keys, *arrays, names = arrays
        sent = rows.sparkSession.sparkContext.broadcast((HashedLookup(keys), *arrays, len(names)))
        named = rows.sparkSession.sparkContext.broadcast(names)

        def count(batches):
            lookup, at, flat, known_names = sent.value
            total = np.zeros((2, known_names), np.int64)
            for b in batches:
                lists, weight = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
                offsets = np.asarray(lists.offsets).astype(np.int64)
                row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
                values = lists.flatten()
                there = pc.is_valid(values).to_numpy(zero_copy_only=False)
                values, row = values.filter(pa.array(there)), row[there]
                known = lookup(values)
                has = known >= 0
                many = (at[known[has] + 1] - at[known[has]])
                up = flat[np.repeat(at[known[has]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] if len(flat) else np.zeros(0, np.int64)
                # items that the hierarchy doesn't have get numbers of their own
                own = values.filter(pa.array(~has)).cast(pa.string()).dictionary_encode()
                for code, held, other in ((up.astype(np.int64), np.repeat(row[has], many), False), (own.indices.to_numpy(zero_copy_only=False).astype(np.int64), row[~has], True)):
                    if not len(code):
                        continue
                    n = int(code.max()) + 1
                    once = distinct(held * n + code)
                    found, cf = summed(code, weight[held])
                    df = summed(once % n, weight[once // n])[1]
                    if other:
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int32()), own.dictionary.take(pa.array(found)), pa.array(cf), pa.array(df)], ["code", "item", "cf", "df"])
                    else:
                        total[0, found] += cf
                        total[1, found] += df
            hit = np.flatnonzero(total[0])
            for k in range(0, len(hit), 50_000):
                h = hit[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int32)), pa.nulls(len(h), pa.string()), pa.array(total[0, h]), pa.array(total[1, h])], ["code", "item", "cf", "df"])

        def name(batches):
            for b in batches:
                item = pc.coalesce(named.value.take(b.column(0)), b.column(1).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([item, b.column(2), b.column(3)], ["item", "cf", "df"])

        part = rows.select("items", "weight").mapInArrow(count, "code int, item string, cf bigint, df bigint")
        return part.groupBy("code", "item").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")).mapInArrow(name, "item string, cf bigint, df bigint")
    one = rows.select("seq", "weight", F.explode("items").alias("item")).where(F.col("item").isNotNull())
    per_item = one.groupBy("seq", "weight", "item").agg(F.count(F.lit(1)).alias("n"))
    up = per_item.join(chain, "item", "left").select("seq", "weight", F.coalesce("ancestor", "item").alias("item"), "n")
    per = up.groupBy("seq", "weight", "item").agg(F.sum("n").alias("n"))
    return per.groupBy("item").agg(F.sum(F.col("n") * F.col("weight")).alias("cf"), F.sum("weight").alias("df"))


def frequent_items(counts: DataFrame, min_support: int) -> DataFrame:
    """The rows of a flist with df of min_support at least."""
    return counts.where(F.col("df") >= min_support)


def redundant_ancestors(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """``item``: parents that occur as often as one of their children, so through it only."""
    c = counts.select("item", F.col("cf").alias("c_cf"))
    p = counts.select(F.col("item").alias("parent"), F.col("cf").alias("p_cf"))
    same = edges.join(c, "item").join(p, "parent").where(F.col("c_cf") == F.col("p_cf"))
    return same.select(F.col("parent").alias("item")).distinct()


def dictionary(counts: DataFrame, edges: DataFrame, chain: DataFrame) -> DataFrame:
    """``item, cf, df, tid, parent_tid, redundant``; tid: rank by cf, greatest first, ties by item; parent_tid: of the nearest
    ancestor that occurs more often (0: none), so parent_tid < tid.

    The ranks come from a range-partitioned sort and the sizes of its partitions, not from one task.
    """
    ids = ranked(counts.select("item", "cf", "df"), F.col("cf").desc(), F.col("item")).withColumnRenamed("rank", "tid").withColumn("tid", F.col("tid").cast("int"))
    up = chain.where("depth > 0").join(counts.select("item", F.col("cf").alias("own")), "item")
    above = ids.select(F.col("item").alias("ancestor"), F.col("cf").alias("a_cf"), F.col("tid").alias("a_tid"))
    up = up.join(above, "ancestor").where(F.col("a_cf") > F.col("own"))
    parent = up.groupBy("item").agg(F.min_by("a_tid", "depth").alias("parent_tid"))
    red = redundant_ancestors(counts, edges).withColumn("redundant", F.lit(True))
    out = ids.join(parent, "item", "left").join(red, "item", "left")
    return out.select(
        "item", "cf", "df", "tid", F.coalesce("parent_tid", F.lit(0)).cast("int").alias("parent_tid"), F.coalesce("redundant", F.lit(False)).alias("redundant")
    )


_IDS = pa.schema([("item", pa.string()), ("cf", pa.int64()), ("df", pa.int64()), ("tid", pa.int32()), ("parent_tid", pa.int32()), ("redundant", pa.bool_())])


def dictionary_here(counts: pd.DataFrame, edges: pd.DataFrame, chain: pd.DataFrame) -> pa.Table:
    """dictionary() of small tables, in the driver."""
    d = counts.sort_values("item", kind="stable").sort_values("cf", ascending=False, kind="stable", ignore_index=True)
    d["tid"] = np.arange(1, len(d) + 1, dtype=np.int32)
    cf, tid = dict(zip(d["item"], d["cf"])), dict(zip(d["item"], d["tid"]))
    parent: dict[str, int] = {}
    for item, up, depth in chain.sort_values("depth").itertuples(index=False):
        if depth and item not in parent and item in cf and cf[up] > cf[item]:
            parent[item] = tid[up]
    red = {p for c, p in edges.itertuples(index=False) if c in cf and cf[c] == cf[p]}
    d["parent_tid"] = np.array([parent.get(x, 0) for x in d["item"]], np.int32)
    d["redundant"] = np.array([x in red for x in d["item"]], bool)
    return pa.Table.from_pandas(d, _IDS, preserve_index=False)


def ranked(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows with ``rank``, 1 for the first in that order (ties in any), from a range-partitioned sort and the sizes of its partitions."""
    sorted_rows = cut(rows.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    per_part = sorted_rows.groupBy("__part").count()  # one row per partition of the sort
    before = per_part.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = sorted_rows.withColumn("rank", rank).join(F.broadcast(before), "__part")
    return out.withColumn("rank", F.col("rank") + F.col("__before")).drop("__part", "__before")


def encode(sequences: DataFrame, ids: DataFrame, here: pa.Table | None = None) -> DataFrame:
    """``seq, tids, weight``: each item as its id from ``item, tid``; items without one, and nulls, are 0 and keep their position.

    Sequences without any item are left out, as are nulls of the array column. here: the rows of ids, if the driver has them.
    """
    return _encode(weighted(sequences).where(F.size("items") > 0), ids, here)


def encode_rows(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    """``seq_id, tids`` of rows ``seq_id, items`` with distinct seq_id."""
    rows = pick(sequences, seq="seq_id", items="items").where(F.size("items") > 0).withColumn("weight", F.lit(1).cast("bigint"))
    return _encode(rows.select(F.col("seq").cast("bigint"), "items", "weight"), ids).select(F.col("seq").alias("seq_id"), "tids")


def _encode(rows: DataFrame, ids: DataFrame, here: pa.Table | None = None) -> DataFrame:
    ids = ids.select("item", "tid")
    if here is not None or is_small(ids):
        got = fetched(ids) if here is None else here
        sent = rows.sparkSession.sparkContext.broadcast((HashedLookup(_column(got, "item")), got.column("tid").to_numpy().astype(np.int32)))

        def run(batches):
            lookup, tids = sent.value[0], np.append(sent.value[1], 0).astype(np.int32)
            for b in batches:
                lists = b.column(1)
                found = tids[lookup(lists.flatten())]  # -1 is the last: 0
                offsets = np.asarray(lists.offsets).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(found)), b.column(2)], ["seq", "tids", "weight"])

        return rows.mapInArrow(run, "seq bigint, tids array<int>, weight bigint")
    one = rows.select("seq", "weight", F.posexplode("items").alias("pos", "item")).join(ids, "item", "left")
    back = one.groupBy("seq", "weight").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("tid", F.lit(0)).alias("tid")))).alias("x"))
    return back.select("seq", F.col("x.tid").cast("array<int>").alias("tids"), "weight")


def decode(patterns: DataFrame, ids: DataFrame, column: str = "pattern_ids", here: pa.Table | None = None) -> DataFrame:
    """The rows with ``pattern``, the items of the ids in ``column``. here: the rows of ids, if the driver has them."""
    if here is not None or is_small(ids.select("tid", "item")):
        got = fetched(ids.select("tid", "item")) if here is None else here
        tid = got.column("tid").to_numpy()
        place = np.full(int(tid.max(initial=0)) + 1, -1)
        place[tid] = np.arange(len(tid))
        sent = patterns.sparkSession.sparkContext.broadcast(_column(got, "item").take(pa.array(place, mask=place < 0)))
        at = patterns.columns.index(column)

        def run(batches):
            words = sent.value
            for b in batches:
                lists = b.column(at)
                offsets = np.asarray(lists.offsets)
                own = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), words.take(lists.flatten()))
                yield pa.RecordBatch.from_arrays([*b.columns, own], [*b.schema.names, "pattern"])

        schema = StructType([*patterns.schema.fields, StructField("pattern", ArrayType(StringType()))])
        return patterns.mapInArrow(run, schema)
    numbered = cut(patterns.withColumn("__p", F.monotonically_increasing_id()))
    one = numbered.select("__p", F.posexplode(column).alias("pos", "tid")).join(maybe_broadcast(ids.select("tid", "item")), "tid")
    back = one.groupBy("__p").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("x"))
    return numbered.join(back, "__p").withColumn("pattern", F.col("x.item")).drop("__p", "x")
