"""Frequent subsequences across many sequences, level by level, by last-position induction.

For each batch of sequences a table holds each item's last position per sequence, latest first. An item extends an
embedding of a frequent prefix when its last position exceeds the embedding's end, so the extensions are the head of that
table; with a bound on the gap the item's next positions are then looked up and held against the bound. All embeddings of a batch are
flat arrays. Partial counts per task are summed by the shuffle. The frequent patterns of a level, of which
there are at most (mean embeddings of a sequence) / (relative support), go to the workers for the next; where they are
too many, the extensions are joined with them instead. The sequences' embeddings of frequent patterns are kept from level
to level while they are few, so that sequences without any drop out and nothing is grown twice; else they are grown again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseq.common import cut
from arborseq.functions.sets import distinct, run_lengths, summed
from arborseq.llm.baskets import Encoded, clean, encode, n_sequences, packed, unpacked
from arborseq.operators.dictionary import decode, ranked

#: Patterns of one level that the driver and the workers may hold; more are joined.
HELD = 1_000_000
#: Embeddings are kept if there are at most so many for each element of the sequences.
KEPT = 2
#: Rows of one step's arrays.
STEP = 2_000_000


class _Batch:
    """Occurrences of common items in a batch, and each sequence's items by last position, latest first."""

    def __init__(self, at: np.ndarray, codes: np.ndarray, n_items: int, gap: int | None):
        n, self.gap = len(at) - 1, gap
        row = np.repeat(np.arange(n), np.diff(at))
        pos = np.arange(len(codes)) - at[row]
        hit = codes > 0
        self.row, self.pos, self.item = row[hit], pos[hit].astype(np.int64), codes[hit].astype(np.int64) - 1
        self.wide = int(self.pos.max(initial=0)) + 2
        order = np.lexsort((self.pos, self.item, self.row))
        r, i, p = self.row[order], self.item[order], self.pos[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
        group = np.cumsum(new) - 1
        self.places = group * self.wide + p  # sorted: by group, then position
        self.place_group, self.place_pos = group, p
        ends = np.flatnonzero(np.append(new[1:], True)) if len(r) else np.zeros(0, np.int64)
        last, g_row, self.group_item = p[ends], r[ends], i[ends]
        by_last = np.lexsort((-last, g_row))
        self.table_group = by_last
        self.table_key = g_row[by_last] * self.wide + (self.wide - 1 - last[by_last])  # ascending: latest last position first
        self.row_start = np.searchsorted(g_row[by_last], np.arange(n + 1))

    def extend(self, row: np.ndarray, pid: np.ndarray, end: np.ndarray):
        """(index of the embedding, item, position) of each extension; in steps of bounded size."""
        start = self.row_start[row]
        many = np.searchsorted(self.table_key, row * self.wide + (self.wide - 1 - end), "left") - start
        total = np.cumsum(many)
        lo = 0
        while lo < len(row):
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + STEP, "right")))
            m = many[lo:hi]
            which = np.repeat(np.arange(lo, hi), m)
            nth = np.arange(len(which)) - np.repeat(total[lo:hi] - m - base, m)
            group = self.table_group[start[which] + nth]
            nxt = np.searchsorted(self.places, group * self.wide + end[which], "right")
            for k in range(1 if self.gap is None else self.gap + 1):
                if k:
                    nxt = nxt + 1
                    there = nxt < len(self.places)
                    which, group, nxt = which[there], group[there], nxt[there]
                    there = self.place_group[nxt] == group
                    which, group, nxt = which[there], group[there], nxt[there]
                pos = self.place_pos[nxt]
                if self.gap is not None:
                    near = pos - end[which] <= self.gap + 1
                    which, group, nxt, pos = which[near], group[near], nxt[near], pos[near]
                yield which, self.group_item[group], pos
            lo = hi


def _known(code: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether it is in the sorted known, where)."""
    if not len(known):
        return np.zeros(len(code), bool), np.zeros(len(code), np.int64)
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    return known[at] == code, at


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, code) of the parts."""
    if not (parts := [p for p in parts if len(p[0])]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size, rows = max(int(c.max()) for _, c in parts) + 1, max(int(r.max()) for r, _ in parts) + 1
    if size * rows < 1 << 62:
        keys = [distinct(r * size + c) for r, c in parts]
        return np.divmod(keys[0] if len(keys) == 1 else distinct(np.concatenate(keys)), size)
    row, code = np.unique(np.concatenate([np.stack(p) for p in parts], axis=1), axis=1)
    return row, code


class _Grown:
    """The embeddings of a batch of rows ``seq_id, codes, multi[, pids, ends]``: of single items, or those kept."""

    def __init__(self, rb: pa.RecordBatch, n_items: int, gap: int | None):
        self.b = b = _Batch(*unpacked(rb.column("codes"), np.int32), n_items, gap)
        self.n_items = n_items
        if "pids" in rb.schema.names:
            at, self.pid = unpacked(rb.column("pids"), np.int64)
            self.row, self.end = np.repeat(np.arange(rb.num_rows), np.diff(at)), unpacked(rb.column("ends"), np.int32)[1].astype(np.int64)
        else:
            self.row, self.pid, self.end = b.row, b.item, b.pos

    def extensions(self):
        """(row, code of the longer pattern, item, end)."""
        for which, item, pos in self.b.extend(self.row, self.pid, self.end):
            yield self.row[which], self.pid[which] * self.n_items + item, item, pos, which

    def advance(self, known: np.ndarray) -> None:
        """To the embeddings one longer whose codes are in known; pid: their places there."""
        keys, size = [np.zeros(0, np.int64)], max(1, len(known))
        for row, code, _, pos, _ in self.extensions():
            good, new = _known(code, known)
            keys.append(distinct((row[good] * size + new[good]) * self.b.wide + pos[good]))
        key, self.end = np.divmod(distinct(np.concatenate(keys)), self.b.wide)
        self.row, self.pid = np.divmod(key, size)


_STATE = "seq_id bigint, codes binary, multi boolean, pids binary, ends binary"


def _with_lists(batches):
    """Rows ``seq_id, codes, multi, x`` with x, a list of (pid, end), packed."""
    for b in batches:
        at = np.asarray(b.column(3).offsets).astype(np.int64)
        pid, end = (b.column(3).flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        lists = [packed(at - at[0], pid.astype(np.int64)), packed(at - at[0], end.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], ["seq_id", "codes", "multi", "pids", "ends"])


def _state(levels, n_items: int, gap: int | None):
    """The rows with their embeddings after the levels given (sorted codes each), without the rows that have none."""

    def run(batches):
        for rb in batches:
            g = _Grown(rb, n_items, gap)
            for known in levels.value:
                g.advance(known)
            size = np.bincount(g.row, minlength=rb.num_rows)
            rows, at = rb.select(["seq_id", "codes", "multi"]).filter(pa.array(size > 0)), np.append(0, np.cumsum(size[size > 0]))
            lists = [packed(at, g.pid), packed(at, g.end.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *lists], ["seq_id", "codes", "multi", "pids", "ends"])

    return run


def _extended(n_items: int, gap: int | None):
    """``row, code, end`` of all extensions, for a join with a level's table."""

    def run(batches):
        for rb in batches:
            g = _Grown(rb, n_items, gap)
            ids = rb.column("row").to_numpy()
            for row, code, _, pos, _ in g.extensions():
                for k in range(0, len(row), 100_000):
                    part = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row[part]]), pa.array(code[part]), pa.array(pos[part].astype(np.int32))], ["row", "code", "end"])

    return run


def _counts(levels, near, n_items: int, gap: int | None):
    """``seq_id, code, n``: counts of the patterns one longer than those after the levels; rows of a seq_id with several are told one by one.

    near: (last item of each pattern, sorted codes of the frequent pairs), or None: only pairs that are frequent are extended to.
    """

    def run(batches):
        last, pairs = near.value or (None, None)
        out = pa.schema([("seq_id", pa.int64()), ("code", pa.int64()), ("n", pa.int64())])
        codes_seen, counts_seen, held = [], [], 0
        for rb in batches:
            g = _Grown(rb, n_items, gap)
            for known in levels.value:
                g.advance(known)
            found = []
            for row, code, item, _, which in g.extensions():
                if last is not None:
                    good, _ = _known(last[g.pid[which]] * n_items + item, pairs)
                    row, code = row[good], code[good]
                found.append((row, code))
            row, code = _distinct(found)
            multi = rb.column("multi").to_numpy(zero_copy_only=False)[row]
            if multi.any():
                ids = rb.column("seq_id").to_numpy(zero_copy_only=False)[row[multi]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(code[multi]), pa.array(np.ones(len(ids), np.int64))], schema=out)
            c, n = run_lengths(code[~multi])
            codes_seen.append(c)
            counts_seen.append(n)
            held += len(c)
            if held > STEP:
                codes_seen, counts_seen = _summed(codes_seen, counts_seen)
                held = len(codes_seen[0])
                if held > STEP // 2:
                    yield from _emit(codes_seen[0], counts_seen[0], out)
                    codes_seen, counts_seen, held = [], [], 0
        if codes_seen:
            codes_seen, counts_seen = _summed(codes_seen, counts_seen)
            yield from _emit(codes_seen[0], counts_seen[0], out)

    return run


def _summed(codes, counts):
    c, n = summed(np.concatenate(codes), np.concatenate(counts))
    return [c], [n]


def _emit(codes, counts, schema):
    for k in range(0, len(codes), 50_000):
        c = codes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(c), pa.int64()), pa.array(c), pa.array(counts[k : k + 50_000])], schema=schema)


def _arrow(ids: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """The columns, and ids with each row as a list."""
    at = pa.array((np.arange(len(ids) + 1) * ids.shape[1]).astype(np.int32))
    lists = pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32).ravel()))
    return pa.table({**{k: pa.array(v, pa.int64()) for k, v in columns.items()}, "ids": lists})


class _Levels:
    """The search, a level at a time: rows with the embeddings kept last, and the frequent patterns of the levels since."""

    def __init__(self, enc: Encoded, least: int, gap: int | None, held: int):
        self.enc, self.least, self.gap, self.held = enc, least, gap, held
        self.spark, self.m = enc.rows.sparkSession, enc.n_items
        self.rows, self.since = enc.rows, []
        self.elements, self.multi = enc.rows.agg(F.coalesce(F.sum(F.octet_length("codes") / 4), F.lit(0)), F.coalesce(F.max("multi"), F.lit(False))).first()
        #: the newest level by pid: tids of each pattern here, or ``pid, ids`` as a table; codes of the frequent pairs, if held
        self.ids: np.ndarray | None = np.arange(1, self.m + 1)[:, None] if self.m <= held else None
        self.table: DataFrame | None = None if self.m <= held else enc.ids.select((F.col("tid") - 1).cast("bigint").alias("pid"), F.array("tid").alias("ids"))
        self.pairs: np.ndarray | None = None

    def frequent(self) -> DataFrame:
        """``code, n`` of the frequent patterns one longer than the newest level's: code: pid of the prefix * items + item."""
        sc = self.spark.sparkContext
        near = None if self.ids is None or self.pairs is None else (self.ids[:, -1].astype(np.int64) - 1, self.pairs)
        run = _counts(sc.broadcast(self.since), sc.broadcast(near), self.m, self.gap)
        counts = self.rows.mapInArrow(run, "seq_id bigint, code bigint, n bigint")
        if self.multi:
            counts = cut(counts)
            counts = counts.where("seq_id is null").unionByName(counts.where("seq_id is not null").distinct())
        return counts.groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= self.least)

    def step(self) -> DataFrame | pa.Table | None:
        """``ids, n`` of the next level, None if it is empty."""
        found = self.frequent()
        some = found.limit(self.held + 1).toPandas()
        if some.empty:
            return None
        up, item = F.expr(f"code div {self.m}L"), F.pmod("code", F.lit(self.m)).cast("int") + 1
        small = len(some) <= self.held
        if small:
            some = some.sort_values("code", ignore_index=True)
            codes = some["code"].to_numpy(np.int64)
            self.since.append(codes)
            if self.ids is not None:
                if self.ids.shape[1] == 1:
                    self.pairs = codes
                self.ids = np.column_stack([self.ids[codes // self.m], codes % self.m + 1])
            if int(some["n"].sum()) <= KEPT * self.elements:
                self.rows = cut(self.rows.mapInArrow(_state(self.spark.sparkContext.broadcast(self.since), self.m, self.gap), _STATE))
                self.since = []
            if self.ids is not None:
                return _arrow(self.ids, n=some["n"].to_numpy())
            level = self.spark.createDataFrame(some.assign(pid=np.arange(len(some))), "code bigint, n bigint, pid bigint")
        else:
            level = cut(ranked(found, F.col("code")).select("code", "n", (F.col("rank") - 1).cast("bigint").alias("pid")))
            self.join(level.select("code", "pid"))
        if self.ids is not None:
            self.ids, self.table = None, self.spark.createDataFrame(_arrow(self.ids, pid=np.arange(len(self.ids))))
        before = self.table.toDF("up", "up_ids")
        self.table = cut(level.join(before, up == F.col("up")).select("pid", F.concat("up_ids", F.array(item)).alias("ids"), "n"))
        out = self.table.select("ids", "n")
        self.table = self.table.select("pid", "ids")
        return out

    def join(self, level: DataFrame) -> None:
        """The rows' embeddings of the level's patterns, by a join of all extensions with ``code, pid``."""
        rows = self.rows
        if self.since:
            rows = rows.mapInArrow(_state(self.spark.sparkContext.broadcast(self.since), self.m, self.gap), _STATE)
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        grown = rows.mapInArrow(_extended(self.m, self.gap), "row bigint, code bigint, end int").distinct()
        own = grown.join(level, "code").groupBy("row").agg(F.collect_list(F.struct("pid", "end")).alias("x"))
        kept = rows.select("row", "seq_id", "codes", "multi").join(own, "row")
        self.rows = cut(kept.select("seq_id", "codes", "multi", "x").mapInArrow(_with_lists, _STATE))
        self.since = []


def frequent_subsequences(
    sequences: DataFrame, per_n: int = 200, max_gap: int | None = 2, max_length: int = 5, min_support: int | None = None, held: int = HELD
) -> DataFrame:
    """``pattern, frequency``: item lists of length 2 to max_length in at least N / per_n sequences, N = distinct seq_id (or in min_support ones).

    At most max_gap elements, nulls counted, lie between neighbours (None: any number). frequency: distinct non-null seq_id with
    an occurrence. Repeated rows count once; rows of one seq_id with unlike items are its alternatives. Empty tables and arrays,
    null arrays and max_length under 2 give nothing.
    """
    spark = sequences.sparkSession
    seqs = clean(sequences)
    n = n_sequences(seqs)
    least = max(1, min_support if min_support is not None else -(-n // per_n))
    empty = spark.createDataFrame([], "pattern array<string>, frequency bigint")
    if n == 0 or max_length < 2:
        return empty
    enc = encode(seqs, least, True, n)
    if enc.n_items == 0:
        return empty
    search = _Levels(enc, least, max_gap, held)
    here, tables = [], []
    for _ in range(2, max_length + 1):
        if (level := search.step()) is None:
            break
        (here if isinstance(level, pa.Table) else tables).append(level)
    if here:
        tables.append(spark.createDataFrame(pa.concat_tables(here)))
    if not tables:
        return empty
    out = reduce(DataFrame.unionByName, tables)
    return decode(out.select("ids", F.col("n").alias("frequency")), enc.ids, "ids").select("pattern", "frequency")
