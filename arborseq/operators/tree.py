"""Parent-child rows to full hierarchies, by contraction.

A round places the rows of the nodes on partitions and follows in each partition the chains that stay there to their
exit, the first node whose row lies elsewhere. The nodes that are somebody's exit are a smaller forest of the same form: each
has its own exit above it, and the number of nodes that hang below it elsewhere. That forest is solved by the same steps. Then the
partitions of the round are made again, each with the solved paths of its exits and the numbers below its nodes: paths are
expanded, and descendants are summed up along the chains, without a row per node and ancestor.

A node's row lies at its parent's place if the parent's hash of the round is the lesser, else at its own; so a third of all
links meet in a round, and long chains shrink as short ones do. A forest of ``one_task`` nodes at most is solved in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseq.common import cut, maybe_broadcast, pick, width

#: Nodes of a forest that one task solves.
ONE_TASK = 5_000
#: Nodes that a partition of a round should hold.
PER_TASK = 50_000
#: A parent with more children than this share of a partition keeps its place alone: its children stay at their own.
HOT_SHARE = 4
#: Names in the paths of one batch.
NAMES = 1_000_000

#: Names of a chain or path are one string, as lists of strings are slow on the way to Python: _SEP between names, _MARK in names as _KEPT.
_MARK, _SEP, _KEPT = "\x01", "\x01\x02", "\x01\x03"

_FRAG = "place int, node string, up string, frag string, weight bigint, exit string, chain string, loop boolean, hangs bigint"
_SOLVED = "node string, path string, depth int, loop boolean, total bigint"


def holding_rows(hierarchy: DataFrame, item: str = "item", parent: str = "parent", line_no: str = "line_no") -> DataFrame:
    """``item, parent``: for each non-null item the row with the greatest line_no (a null one is the least; of equal ones the greatest parent, null least)."""
    rows = pick(hierarchy, item=item, parent=parent, line_no=line_no).where(F.col("item").isNotNull())
    best = F.max(F.struct("line_no", "parent"))
    return rows.groupBy("item").agg(best.alias("best")).select("item", F.col("best.parent").alias("parent"))


def _escaped(names: pa.Array) -> pa.Array:
    return pc.replace_substring(names.cast(pa.string()), _MARK, _KEPT)


class _Forest:
    """The rows ``node, up, frag, weight`` of one task, by index; parent: -1 where the parent's row lies elsewhere."""

    def __init__(self, t: pa.Table):
        self.t, n = t, t.num_rows
        self.node, self.up = t.column("node").to_pylist(), t.column("up").to_pylist()
        at = {x: i for i, x in enumerate(self.node)}
        self.parent = np.fromiter((at.get(u, -1) if u is not None else -1 for u in self.up), np.int64, n)
        # pointer doubling: top row of the chain, and how many steps it is away
        top, steps = np.where(self.parent < 0, np.arange(n), self.parent), (self.parent >= 0).astype(np.int64)
        for _ in range(n.bit_length() + 1):
            further = top[top]
            if (further == top).all():
                break
            steps, top = steps + steps[top], further
        self.top, self.steps = top, steps
        self.loop = self.parent[top] >= 0
        frag = t.column("frag").combine_chunks()
        if frag.null_count:  # a null one is the node alone; so are all of the first round, and none later
            self.size, self.names = np.ones(n, np.int64), _escaped(t.column("node").combine_chunks())
        else:
            lists = pc.split_pattern(frag.cast(pa.string()), _SEP)
            self.size, self.names = np.diff(np.asarray(lists.offsets)).astype(np.int64) if n else np.zeros(0, np.int64), lists.flatten()
        self.start = np.cumsum(self.size) - self.size

    def summed(self, own: np.ndarray) -> np.ndarray:
        """Of each node the sum of these numbers over itself and the nodes below it."""
        total, parent = own.tolist(), self.parent.tolist()
        for i in np.argsort(-self.steps, kind="stable").tolist():
            if parent[i] >= 0 and not self.loop[i]:
                total[parent[i]] += total[i]
        return np.array(total, np.int64)

    def paths(self, prefix_at: np.ndarray, prefix_size: np.ndarray, names: pa.Array, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(packed names, their number) of these rows: the prefix of the chain's top (a range of names), then the frags down to the row (ranges of names too)."""
        length = np.where(self.loop[rows], 0, self._lengths(prefix_size)[rows])
        ends = np.cumsum(length)
        index = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        live = np.flatnonzero(~self.loop[rows])
        at, stop = rows[live], ends[live].copy()

        def put(start, size, stop):
            many = np.repeat(np.arange(len(size)), size)
            inner = np.arange(len(many)) - np.repeat(np.cumsum(size) - size, size)
            index[(stop - size)[many] + inner] = start[many] + inner

        while len(at):
            put(self.start[at], self.size[at], stop)
            stop = stop - self.size[at]
            done = self.parent[at] < 0
            put(prefix_at[at[done]], prefix_size[at[done]], stop[done])
            at, stop = self.parent[at[~done]], stop[~done]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), names.take(pa.array(index)))
        return pc.binary_join(lists, _SEP), length

    def _lengths(self, prefix_size: np.ndarray) -> np.ndarray:
        length = self.size + np.where(self.parent < 0, prefix_size, 0)
        out, parent = length.tolist(), self.parent.tolist()
        for i in np.argsort(self.steps, kind="stable").tolist():
            if parent[i] >= 0 and not self.loop[i]:
                out[i] += out[parent[i]]
        return np.array(out, np.int64)

    def batches(self, prefix_at: np.ndarray, prefix_size: np.ndarray):
        """Ranges of rows with about NAMES names in their paths."""
        total = np.cumsum(np.where(self.loop, 0, self._lengths(prefix_size)) + 1)
        lo = 0
        while lo < len(total):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + NAMES, "right")))
            yield np.arange(lo, hi)
            lo = hi


def _fragments(batches):
    """Each row with its chain's exit, the names from below the exit down to it (chain; null: its frag), and what hangs at the exit by its chain's top."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    f = _Forest(t)
    total = f.summed(t.column("weight").to_numpy())
    none = np.zeros(t.num_rows, np.int64)
    is_top = (f.parent < 0) & ~f.loop
    for rows in f.batches(none, none):
        own = t.take(pa.array(rows))
        chains = pc.if_else(pa.array((f.steps[rows] == 0) | f.loop[rows]), None, f.paths(none, none, f.names, rows)[0])
        yield pa.RecordBatch.from_arrays([
            *(own.column(c).combine_chunks() for c in ("place", "node", "up", "frag", "weight")),
            pa.array([None if f.loop[i] else f.up[f.top[i]] for i in rows], pa.string()), chains,
            pa.array(f.loop[rows]), pa.array(np.where(is_top[rows], total[rows], 0)),
        ], ["place", "node", "up", "frag", "weight", "exit", "chain", "loop", "hangs"])


def _expanded(batches):
    """Solved rows of one task. Beside the rows themselves (kind 0) there are kind 1: node, and what hangs below it elsewhere (weight), and kind 2:
    an exit with its path (frag) or a loop above it."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    kind = t.column("kind").to_numpy()
    rows, below, above = (t.filter(pa.array(kind == k)) for k in range(3))
    f = _Forest(rows)
    hangs = dict(zip(below.column("node").to_pylist(), below.column("weight").to_pylist()))
    weight = rows.column("weight").to_numpy() + np.array([hangs.get(x, 0) for x in f.node], np.int64)
    exits = {x: i for i, x in enumerate(above.column("node").to_pylist())}
    loops = above.column("loop").to_pylist()
    lists = pc.split_pattern(pc.fill_null(above.column("frag").combine_chunks().cast(pa.string()), ""), _SEP)
    at = np.asarray(lists.offsets).astype(np.int64) if len(exits) else np.zeros(1, np.int64)
    # names: those of the rows, of the exits' paths, and the ups that have no row anywhere
    ups = rows.column("up").combine_chunks().cast(pa.string())
    own, paths = len(f.names), len(lists.flatten())
    names = pa.concat_arrays([f.names, lists.flatten(), _escaped(ups)])
    prefix_at, prefix_size = np.zeros(len(f.node), np.int64), np.zeros(len(f.node), np.int64)
    bad = np.zeros(len(f.node), bool)
    for i in np.flatnonzero((f.parent < 0) & ~f.loop).tolist():
        if (u := f.up[i]) is None:
            continue
        if (k := exits.get(u)) is None:
            prefix_at[i], prefix_size[i] = own + paths + i, 1
        else:
            prefix_at[i], prefix_size[i], bad[i] = own + at[k] - at[0], at[k + 1] - at[k], loops[k]
    f.loop = f.loop | bad[f.top]
    total = f.summed(weight)
    for r in f.batches(prefix_at, prefix_size):
        node = rows.column("node").combine_chunks().take(pa.array(r))
        path, n = f.paths(prefix_at, prefix_size, names, r)
        columns = [node, path, pa.array((n - 1).astype(np.int32)), pa.array(f.loop[r]), pa.array(total[r])]
        yield pa.RecordBatch.from_arrays(columns, ["node", "path", "depth", "loop", "total"])


def _kinds(rows: DataFrame, kind: int, loop=None) -> DataFrame:
    return rows.select("place", F.lit(kind).alias("kind"), "node", "up", "frag", "weight", (F.lit(False) if loop is None else loop).alias("loop"))


def _solve(rows: DataFrame, n: int, round_no: int, one_task: int, per_task: int) -> DataFrame:
    """``node, path, depth, loop, total`` of rows ``node, up, frag, weight`` (frag: the names below up, down to the node; null: the node alone).

    Path and frag are packed; the path is empty and the depth -1 on a loop. total: the weights of the node and of all below it.
    """
    if n <= one_task:
        return _kinds(rows.withColumn("place", F.lit(0)), 0).coalesce(1).mapInArrow(_expanded, _SOLVED)
    # a small forest on few partitions: more links meet
    parts = max(2, min(width(rows.sparkSession), -(-n // one_task)), -(-n // per_task))
    drawn = lambda c: F.xxhash64(F.lit(round_no), c)
    at_parent = F.col("up").isNotNull() & (drawn("up") < drawn("node"))
    if n > (most := per_task // HOT_SHARE):
        hot = cut(rows.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("h_up")).count().where(F.col("count") > most).select("h_up"))
        rows = rows.join(maybe_broadcast(hot), F.col("up") == F.col("h_up"), "left")
        at_parent = at_parent & F.col("h_up").isNull()
    placed = rows.select(F.pmod(F.when(at_parent, drawn("up")).otherwise(drawn("node")), F.lit(parts)).cast("int").alias("place"), "node", "up", "frag", "weight")
    frags = cut(placed.repartitionById(parts, F.col("place")).mapInArrow(_fragments, _FRAG))
    exits = frags.where(F.col("exit").isNotNull()).groupBy(F.col("exit").alias("node")).agg(F.sum("hangs").alias("hangs"))
    up = F.when(F.col("loop"), F.col("node")).otherwise(F.col("exit"))  # a node that leads into a loop stays one
    own = frags.select("place", "node", up.alias("up"), F.coalesce("chain", "frag").alias("frag"))
    smaller = cut(own.join(exits, "node").select("place", "node", "up", F.coalesce("frag", F.replace("node", F.lit(_MARK), F.lit(_KEPT))).alias("frag"), F.col("hangs").alias("weight")))
    above = cut(_solve(smaller.drop("place"), smaller.count(), round_no + 1, one_task, per_task))
    below = smaller.select("place", "node").join(above.select("node", F.col("total").alias("weight")), "node")
    text = F.lit(None).cast("string")
    asked = frags.where((F.col("hangs") > 0) & F.col("exit").isNotNull()).select("place", F.col("exit").alias("node")).distinct()
    ends = asked.join(above.select("node", F.col("path").alias("frag"), "loop"), "node").withColumn("up", text).withColumn("weight", F.lit(0).cast("bigint"))
    all_rows = _kinds(frags, 0).unionByName(_kinds(below.withColumn("up", text).withColumn("frag", text), 1)).unionByName(_kinds(ends, 2, F.col("loop")))
    return all_rows.repartitionById(parts, F.col("place")).mapInArrow(_expanded, _SOLVED)


def _full(edges: DataFrame, item: str, parent: str, one_task: int, per_task: int) -> DataFrame:
    """``item, path, depth, loop, n_descendants`` with packed paths."""
    nodes = pick(edges, node=item, up=parent).where(F.col("node").isNotNull())
    nodes = cut(nodes.select("node", "up", F.lit(None).cast("string").alias("frag"), F.lit(1).cast("bigint").alias("weight")))
    below = F.when(F.col("loop"), F.lit(-1)).otherwise(F.col("total") - 1).cast("bigint")
    return _solve(nodes, nodes.count(), 0, one_task, per_task).select(F.col("node").alias("item"), "path", "depth", "loop", below.alias("n_descendants"))


def full_hierarchy(edges: DataFrame, item: str = "item", parent: str = "parent", one_task: int = ONE_TASK, per_task: int = PER_TASK) -> DataFrame:
    """``item, path, depth, loop, n_descendants`` for each non-null item of edges (one parent per item).

    A null parent states a root; a parent that is no item is a root above its children, without a row of its own.
    path: array of nodes from the root to the item. Items on a loop or leading into one: loop true, an empty path, depth and
    n_descendants -1. n_descendants: items, itself excluded, whose path holds the item. An empty table gives no rows.
    """
    names = F.transform(F.split("path", _SEP), lambda x: F.replace(x, F.lit(_KEPT), F.lit(_MARK)))
    path = F.when(F.col("loop"), F.array().cast("array<string>")).otherwise(names)
    return _full(edges, item, parent, one_task, per_task).withColumn("path", path)


def hierarchy_text(edges: DataFrame, item: str = "item", parent: str = "parent", mark: str = ">", one_task: int = ONE_TASK, per_task: int = PER_TASK) -> DataFrame:
    """``item, root, depth, full_path, n_descendants`` of full_hierarchy, the nodes of a path joined by mark; root and full_path are '' on a loop."""
    plain = lambda c: F.replace(c, F.lit(_KEPT), F.lit(_MARK))
    return _full(edges, item, parent, one_task, per_task).select(
        "item", plain(F.substring_index("path", _SEP, 1)).alias("root"), "depth", plain(F.replace("path", F.lit(_SEP), F.lit(mark))).alias("full_path"), "n_descendants"
    )
