"""Frequent generalized subsequences: five strategies with one answer.

``levelwise``    counts each level's candidates where the sequences lie; only (candidate, count) pairs are shuffled.
``joins``        grows tables of embeddings by equi and range joins, all in built-in operators.
``bfs``          joins the frequent patterns of a level with themselves on prefix and suffix, then their start positions.
``partitioned``  sends each sequence, rewritten for it, to each of its items as a pivot, adds up equal ones and mines each pivot apart.
``segmented``    the same with the independent parts of a rewritten sequence as records of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from arborseq.common import LIMITS, cut, fetched, is_small, maybe_broadcast, width
from arborseq.functions import arrays as A
from arborseq.functions.sets import summed
from arborseq.operators import grow


@dataclass
class Chains:
    """For each id the frequent ids that it stands for, itself first, then its ancestors (descending ids)."""

    #: ``tid, chain`` of the frequent ids, which are the ids that lifted sequences hold
    table: DataFrame
    #: the same as (offsets by id, ids), if they are few enough for a lookup in each worker
    here: tuple[np.ndarray, np.ndarray] | None
    #: the first of its chain for each id, as an array by id whose last place is 0 (0: none), or if there are too many as ``tid, code``
    lift: np.ndarray | DataFrame

    @staticmethod
    def of(table: DataFrame) -> Chains:
        """table: ``tid, chain`` of all ids with a chain that is not empty."""
        first = F.get("chain", F.lit(0))
        own, lift = cut(table.where(first == F.col("tid"))), table.select("tid", first.alias("code"))
        here = None
        if is_small(own):
            got = fetched(own).sort_by("tid")
            lists = got.column("chain").combine_chunks()
            here = _by_id(got.column("tid").to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if is_small(lift):
            got = fetched(lift)
            tid = got.column("tid").to_numpy()
            lift = np.zeros(int(tid.max(initial=0)) + 2, np.int32)
            lift[tid] = got.column("code").to_numpy()
        return Chains(own, here, lift)

    @staticmethod
    def climbed(spark: SparkSession, tid: np.ndarray, parent_tid: np.ndarray, good: np.ndarray) -> Chains | None:
        """From the ids, their parents (0: none; parent_tid < tid) and whether they are frequent; None if the chains are too long in all."""
        n = int(tid.max(initial=0)) + 2
        up, fine = np.zeros(n, np.int32), np.zeros(n, bool)
        up[tid], fine[tid] = parent_tid, good
        lift = np.where(fine, np.arange(n, dtype=np.int32), up)
        while (rest := (lift > 0) & ~fine[lift]).any():
            lift[rest] = lift[lift[rest]]
        own = np.flatnonzero(fine)
        rows, ids, held = [], [], 0
        row, at = np.arange(len(own)), own
        while len(at):
            rows.append(row)
            ids.append(at)
            held += len(at)
            if held * 8 > LIMITS.size:
                return None
            at = lift[up[at]]
            row, at = row[at > 0], at[at > 0]
        row = np.concatenate([*rows, np.zeros(0, np.int64)])
        flat = np.concatenate([*ids, np.zeros(0, np.int64)])[np.argsort(row, kind="stable")].astype(np.int64)
        many = np.bincount(row, minlength=len(own))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.array(flat.astype(np.int32)))
        table = spark.createDataFrame(pa.table({"tid": pa.array(own.astype(np.int32)), "chain": lists}))
        return Chains(table, (_by_id(own, many), flat), lift)


def _by_id(ids: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Offsets by id of lists that lie in the order of the ids."""
    size = np.zeros(int(ids.max(initial=0)) + 2, np.int64)
    size[ids] = many
    return np.append(0, np.cumsum(size))


@dataclass
class Prepared:
    """What mining needs; as saved and loaded by sources/store.py.

    sequences: ``tids, weight``, each id of the full dictionary (0: none). dictionary: see operators/dictionary.py.
    """

    sequences: DataFrame
    dictionary: DataFrame
    #: the dictionary in the driver, if it was made there
    held: pa.Table | None = None

    def frequent(self, min_support: int) -> DataFrame:
        """``tid, item`` of the frequent items that are not redundant."""
        return self.dictionary.where((F.col("df") >= min_support) & ~F.col("redundant")).select("tid", "item")

    def chains(self, min_support: int) -> Chains:
        d = self.dictionary.select("tid", "parent_tid", (~F.col("redundant") & (F.col("df") >= min_support)).alias("good"))
        if (t := self.held) is not None:
            got = t.column("tid"), t.column("parent_tid"), pc.and_not(pc.greater_equal(t.column("df"), min_support), t.column("redundant"))
        else:
            got = fetched(d).columns if is_small(d) else None
        if got is not None and (chains := Chains.climbed(d.sparkSession, *(c.to_numpy() for c in got))) is not None:
            return chains
        d = cut(d)
        up = cut(d.select("tid", F.col("tid").alias("at"), F.when(F.col("good"), F.array("tid")).otherwise(F.array().cast("array<int>")).alias("chain"), F.col("parent_tid").alias("next")))
        done = None
        while True:  # as many rounds as the hierarchy is deep
            rest = up.where("next > 0")
            ended = up.where("next = 0").select("tid", "chain")
            done = ended if done is None else done.unionByName(ended)
            if rest.limit(1).count() == 0:
                return Chains.of(cut(done.where(F.size("chain") > 0)))
            step = d.select(F.col("tid").alias("at"), F.col("parent_tid").alias("then"), "good")
            rest = rest.select("tid", F.col("next").alias("at"), "chain").join(maybe_broadcast(step), "at")
            up = cut(rest.select("tid", "at", F.when(F.col("good"), F.concat("chain", F.array("at"))).otherwise(F.col("chain")).alias("chain"), F.col("then").alias("next")))

    def reduced(self, min_support: int, trim: bool = True) -> tuple[DataFrame, Chains]:
        """(``codes, weight``, chains): ids lifted to their nearest frequent ancestor or self, else 0; equal sequences added up.

        trim: without blanks at the ends, and only sequences of two positions at least.
        """
        chains = self.chains(min_support)
        codes = _lift(self.sequences, chains)
        if trim:
            codes = codes.select(A.trim_blanks(F.col("codes")).alias("codes"), "weight").where(F.size("codes") > 1)
        rows = codes.groupBy("codes").agg(F.sum("weight").alias("weight"))
        # mining costs far more than its input's bytes, so these few bytes are spread over all cores
        spread = max(width(rows.sparkSession), rows.sparkSession.sparkContext.defaultParallelism)
        return cut(rows.repartition(spread)), chains


def _lift(sequences: DataFrame, chains: Chains) -> DataFrame:
    """``codes, weight``: each id as the first of its chain, else 0."""
    if isinstance(chains.lift, np.ndarray):
        sent = sequences.sparkSession.sparkContext.broadcast(chains.lift)

        def run(batches):
            table = sent.value  # its last place is 0
            for b in batches:
                lists = b.column(0)
                at = np.asarray(lists.offsets).astype(np.int32)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                codes = table[np.where(ids < len(table), ids, -1)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at - at[0]), pa.array(codes)), b.column(1)], ["codes", "weight"])

        return sequences.select("tids", "weight").mapInArrow(run, "codes array<int>, weight bigint")
    rows = sequences.select(F.monotonically_increasing_id().alias("seq"), "tids", "weight")
    one = rows.select("seq", "weight", F.posexplode("tids").alias("pos", "tid")).join(chains.lift, "tid", "left")
    back = one.groupBy("seq", "weight").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("code", F.lit(0)).alias("code")))).alias("x"))
    return back.select(F.col("x.code").alias("codes"), "weight")


def levelwise(prepared: Prepared, min_support: int, max_gap: int, max_length: int) -> DataFrame:
    """``pattern_ids, frequency``."""
    rows, chains = prepared.reduced(min_support)
    return _levelwise(rows, chains, min_support, max_gap, max_length)


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate(codes), np.concatenate(counts))


def _counter(count):
    """Partial counts ``code, n`` of a task; count: batch -> (codes, counts)."""
    arrow = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def run(batches):
        codes, counts, held = [], [], 0
        for b in batches:
            c, n = count(b)
            codes.append(c)
            counts.append(n)
            held += len(c)
            if held > grow.STEP:
                c, n = _summed(codes, counts)
                codes, counts, held = [c], [n], len(c)
                if held > grow.STEP // 2:
                    yield from grow.batches_of(c, n, arrow)
                    codes, counts, held = [], [], 0
        if codes:
            yield from grow.batches_of(*_summed(codes, counts), arrow)

    return run


def _levels(rows: DataFrame, chains: Chains, min_support: int, max_gap: int, max_length: int, counters: list | None = None, pivots: bool = False):
    """(patterns, supports) level by level, or None if a level has too many patterns for the workers.

    pivots: rows are ``pivot, seq, weight``, rewritten for their pivots; patterns start with the pivot whose partition they are frequent in.
    counters: gets (length, candidates, patterns) of each level.
    """
    sc = rows.sparkSession.sparkContext
    chain_at, chain = chains.here
    size = len(chain_at)
    tables = sc.broadcast((chain_at, chain))
    ids = np.flatnonzero(np.diff(chain_at)).astype(np.int64)

    def entries(b):
        if pivots:
            at, codes = grow.positions(b.column("seq"))
            owner = b.column("pivot").to_numpy(zero_copy_only=False).astype(np.int64)
            return grow.Entries(at, codes, *tables.value, max_gap, owner)
        lists = b.column("codes")
        at = np.asarray(lists.offsets).astype(np.int64)
        return grow.Entries(at - at[0], lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), *tables.value, max_gap)

    def frequent(count):
        counts = rows.mapInArrow(_counter(count), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
        if counters is not None:
            counts = cut(counts)
        good = counts.where(F.col("n") >= min_support).limit(LIMITS.patterns + 1)
        code, n = (c.to_numpy() for c in fetched(good.select("code", "n")).columns)
        order = np.argsort(code)
        return code[order], n[order], counts.count() if counters is not None else 0

    if pivots:
        levels = [frequent(lambda b: grow.count_owned(entries(b), b.column("weight").to_numpy(zero_copy_only=False), size))[0]]
        names = np.stack([levels[0] // size, levels[0] % size], 1)
    else:
        levels, names = [ids], ids[:, None]
    out = []
    for length in range(2, max_length + 1):
        if not len(levels[-1]):
            break
        sent = sc.broadcast(levels)
        code, n, candidates = frequent(lambda b, sent=sent: grow.count_level(entries(b), b.column("weight").to_numpy(zero_copy_only=False), sent.value, size))
        sent.unpersist()
        if len(code) > LIMITS.patterns:
            return None
        names = np.column_stack([names[code // size], code % size])
        out.append((names, n))
        levels.append(code)
        if counters is not None:
            counters.append((length, candidates, len(code)))
    return out


def _as_table(spark: SparkSession, levels: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``pattern_ids, frequency``."""
    if not levels:
        return spark.createDataFrame([], _FOUND)
    size = np.concatenate([np.full(len(p), p.shape[1]) for p, _ in levels])
    flat = np.concatenate([p.ravel() for p, _ in levels]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat))
    return spark.createDataFrame(pa.table({"pattern_ids": lists, "frequency": pa.array(np.concatenate([n for _, n in levels]))}))


_FOUND = "pattern_ids array<int>, frequency bigint"


def _levelwise(rows: DataFrame, chains: Chains, min_support: int, max_gap: int, max_length: int) -> DataFrame:
    found = None if chains.here is None else _levels(rows, chains, min_support, max_gap, max_length)
    if found is None:
        return _joined(rows, chains, min_support, max_gap, max_length)
    return _as_table(rows.sparkSession, found)


def level_counters(prepared: Prepared, min_support: int, max_gap: int, max_length: int) -> DataFrame:
    """``length, n_candidates, n_patterns`` of each level: extensions of the frequent patterns one shorter that occur at all, and the frequent ones among them."""
    rows, chains = prepared.reduced(min_support)
    counters: list[tuple[int, int, int]] = []
    if chains.here is None or _levels(rows, chains, min_support, max_gap, max_length, counters) is None:
        raise ValueError("too many items or patterns to count candidates")
    return rows.sparkSession.createDataFrame(counters, "length int, n_candidates bigint, n_patterns bigint")


def _entries(rows: DataFrame, chains: Chains) -> DataFrame:
    """``seq, weight, pos, id``, partitioned by seq and kept."""
    one = cut(rows.select(F.monotonically_increasing_id().alias("seq"), "weight", "codes"))
    one = one.select("seq", "weight", F.posexplode("codes").alias("pos", "tid")).where("tid > 0")
    return cut(one.join(maybe_broadcast(chains.table), "tid").select("seq", "weight", "pos", F.explode("chain").alias("id")))


def _support(embeddings: DataFrame, min_support: int) -> DataFrame:
    once = embeddings.select("seq", "weight", "pattern_ids").distinct()
    return once.groupBy("pattern_ids").agg(F.sum("weight").alias("frequency")).where(F.col("frequency") >= min_support)


def _within(gap: int, a: Column, b: Column) -> Column:
    return (b > a) & (b <= a + F.lit(gap + 1))


def _joined(rows: DataFrame, chains: Chains, min_support: int, max_gap: int, max_length: int) -> DataFrame:
    g = _entries(rows, chains)
    state = g.select("seq", "weight", F.array("id").alias("pattern_ids"), F.col("pos").alias("end"))
    nxt = g.select("seq", F.col("pos").alias("p"), "id")
    out = rows.sparkSession.createDataFrame([], "pattern_ids array<int>, frequency bigint")
    for _ in range(2, max_length + 1):
        grown = state.join(nxt, "seq").where(_within(max_gap, F.col("end"), F.col("p")))
        grown = cut(grown.select("seq", "weight", F.concat("pattern_ids", F.array("id")).alias("pattern_ids"), F.col("p").alias("end")).distinct())
        good = cut(_support(grown, min_support))
        out = out.unionByName(good)
        if good.limit(1).count() == 0:
            break
        state = grown.join(maybe_broadcast(good.select("pattern_ids")), "pattern_ids", "left_semi")
    return out


def joins(prepared: Prepared, min_support: int, max_gap: int, max_length: int) -> DataFrame:
    """``pattern_ids, frequency`` by tables of embeddings (row, pattern, end)."""
    return _joined(*prepared.reduced(min_support), min_support, max_gap, max_length)


def bfs(prepared: Prepared, min_support: int, max_gap: int, max_length: int) -> DataFrame:
    """``pattern_ids, frequency`` by candidates whose prefix and suffix are frequent, and joins of start positions (row, pattern, start)."""
    rows, chains = prepared.reduced(min_support)
    g = _entries(rows, chains)
    state = g.select("seq", "weight", F.array("id").alias("pattern_ids"), F.col("pos").alias("start"))
    frequent = state.select("pattern_ids").distinct()
    out = rows.sparkSession.createDataFrame([], "pattern_ids array<int>, frequency bigint")
    for length in range(2, max_length + 1):
        left = frequent.select(F.col("pattern_ids").alias("l"), F.slice("pattern_ids", F.lit(2), F.lit(length - 2)).alias("mid"))
        right = frequent.select(F.col("pattern_ids").alias("r"), F.slice("pattern_ids", F.lit(1), F.lit(length - 2)).alias("mid"))
        a = state.select("seq", "weight", F.col("pattern_ids").alias("l"), F.col("start").alias("s"))
        b = state.select("seq", F.col("pattern_ids").alias("r"), F.col("start").alias("t"))
        both = a.join(b, "seq").where(_within(max_gap, F.col("s"), F.col("t")))
        if length > 2:
            both = both.where(F.slice("l", F.lit(2), F.lit(length - 2)) == F.slice("r", F.lit(1), F.lit(length - 2)))
            both = both.join(maybe_broadcast(cut(left.join(right, "mid").select("l", "r"))), ["l", "r"], "left_semi")
        new = F.concat("l", F.array(F.element_at("r", -1)))
        grown = cut(both.select("seq", "weight", new.alias("pattern_ids"), F.col("s").alias("start")).distinct())
        good = cut(_support(grown, min_support))
        out = out.unionByName(good)
        frequent = good.select("pattern_ids")
        if good.limit(1).count() == 0:
            break
        state = cut(grown.join(maybe_broadcast(frequent), "pattern_ids", "left_semi"))
    return out


def two_sequences(prepared: Prepared, min_support: int, max_gap: int) -> DataFrame:
    """``pattern_ids, frequency`` of the frequent patterns of length 2."""
    return levelwise(prepared, min_support, max_gap, 2)


def with_chains(rows: DataFrame, chains: Chains, codes: str = "codes") -> DataFrame:
    """The rows with ``chains``: of each position of codes the chain of its id, an empty one for blanks."""
    if chains.here is not None:
        sent = rows.sparkSession.sparkContext.broadcast(chains.here)
        index = rows.columns.index(codes)

        def run(batches):
            chain_at, chain = sent.value
            for b in batches:
                lists = b.column(index)
                at = np.asarray(lists.offsets).astype(np.int32)
                ids = np.maximum(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), 0)
                many = np.where(ids > 0, chain_at[ids + 1] - chain_at[ids], 0)
                ends = np.cumsum(many)
                flat = chain[np.repeat(chain_at[ids], many) + np.arange(int(many.sum())) - np.repeat(ends - many, many)]
                inner = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(at - at[0]), inner)], [*b.schema.names, "chains"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("chains", ArrayType(ArrayType(IntegerType())))]))
    keyed = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    one = keyed.select("__row", F.posexplode(codes).alias("pos", "tid")).join(chains.table, "tid", "left")
    back = one.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("chain", F.array().cast("array<int>")).alias("c")))).alias("x"))
    return keyed.join(back, "__row").withColumn("chains", F.col("x.c")).drop("__row", "x")


def pivot_partitions(rows: DataFrame, chains: Chains) -> DataFrame:
    """``pivot, chains, weight``: a copy of each sequence for each frequent id that it holds or generalizes to."""
    return with_chains(rows, chains).select(F.explode(F.array_distinct(F.flatten("chains"))).alias("pivot"), "chains", "weight")


def rewritten(rows: DataFrame, chains: Chains, max_gap: int, max_length: int, apart: bool = False) -> DataFrame:
    """``pivot, seq, weight``: the sequences as their pivots need them (see grow.rewrite), equal ones added up."""
    sent = None if chains.here is None else rows.sparkSession.sparkContext.broadcast(chains.here)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2_000):
                part = b.slice(lo, 2_000)
                lists = part.column(0)
                at = np.asarray(lists.offsets).astype(np.int64)
                codes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if sent is None:
                    names, codes, *tables = grow.own_tables(codes, part.column(2).flatten())
                else:
                    names, tables = None, sent.value
                pivot, at, ids, weight = grow.rewrite(at - at[0], codes, part.column(1).to_numpy(zero_copy_only=False), *tables, max_gap, max_length, apart)
                if names is not None:
                    pivot, ids = names[pivot], np.where(ids > 0, names[np.maximum(ids, 0)], ids)
                seq = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), seq, pa.array(weight)], ["pivot", "seq", "weight"])

    rows = rows.select("codes", "weight") if sent else with_chains(rows.select("codes", "weight"), chains)
    return rows.mapInArrow(run, "pivot int, seq array<int>, weight bigint").groupBy("pivot", "seq").agg(F.sum("weight").alias("weight"))


def partitioned(prepared: Prepared, min_support: int, max_gap: int, max_length: int, apart: bool = False) -> DataFrame:
    """``pattern_ids, frequency``, each pattern from the partition of its greatest id. apart: see grow.rewrite.

    A pivot of at most LIMITS.group rewritten sequences is mined by one task. The sequences of hotter pivots stay where they lie: their
    patterns are counted level by level, in part by each task, all such pivots at once.
    """
    rows, chains = prepared.reduced(min_support)
    parts = cut(rewritten(rows, chains, max_gap, max_length, apart))
    sizes = cut(parts.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).where(F.col("w") >= min_support))
    hot = sizes.where(F.col("n") > LIMITS.group).select("pivot")
    hot_too = not hot.isEmpty()
    sent = None if chains.here is None else rows.sparkSession.sparkContext.broadcast(chains.here)

    def mine(group: pa.Table) -> pa.Table:
        pivot = int(group.column("pivot")[0].as_py())
        lists = group.column("seq").combine_chunks()
        names = None
        if sent is None:
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            names, ids, *tables = grow.own_tables(ids, group.column("chains").combine_chunks().flatten(), pivot)
            lists = pa.ListArray.from_arrays(pa.array((np.asarray(lists.offsets) - lists.offsets[0].as_py()).astype(np.int32)), pa.array(ids.astype(np.int32)))
            own = int(np.searchsorted(names, pivot))
        else:
            tables, own = sent.value, pivot
        at, codes = grow.positions(lists)
        e = grow.Entries(at, codes, *tables, max_gap)
        found = grow.mine_pivot(e, group.column("weight").to_numpy(), own, len(tables[0]), min_support, max_length)
        patterns = [p if names is None else names[p].tolist() for p, _ in found]
        return pa.table({"pattern_ids": pa.array(patterns, pa.list_(pa.int32())), "frequency": pa.array([n for _, n in found], pa.int64())})

    cool = sizes.where(F.col("n") <= LIMITS.group).select("pivot")
    own = parts.join(maybe_broadcast(cool), "pivot", "left_semi")
    if sent is None:
        own = with_chains(own, chains, "seq")
    out = own.groupBy("pivot").applyInArrow(mine, _FOUND)
    if hot_too:
        own = cut(parts.join(maybe_broadcast(hot), "pivot", "left_semi"))
        found = None if sent is None else _levels(own, chains, min_support, max_gap, max_length, pivots=True)
        if found is None:
            rest = _joined(rows, chains, min_support, max_gap, max_length).withColumn("pivot", F.array_max("pattern_ids"))
            return out.unionByName(rest.join(maybe_broadcast(hot), "pivot", "left_semi").drop("pivot"))
        good = [p[:, 1:].max(1) == p[:, 0] for p, _ in found]
        out = out.unionByName(_as_table(rows.sparkSession, [(p[g, 1:], n[g]) for (p, n), g in zip(found, good) if g.any()]))
    return out


def segmented(prepared: Prepared, min_support: int, max_gap: int, max_length: int) -> DataFrame:
    """partitioned() with the parts of rewritten sequences apart, so that more of them are equal."""
    return partitioned(prepared, min_support, max_gap, max_length, True)


STRATEGIES = {"levelwise": levelwise, "joins": joins, "bfs": bfs, "partitioned": partitioned, "segmented": segmented}
