"""Item hierarchies: closure, checks and the taxonomy's functions, all as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseq.common import LIMITS, cut, is_small, pick
from arborseq.operators.tree import full_hierarchy


class HierarchyError(ValueError):
    """The hierarchy is no forest: an item with several parents, or a loop."""


def check_forest(hierarchy: DataFrame) -> DataFrame:
    """``item, parent``, distinct; raises if an item has several parents. Rows without item or parent say nothing."""
    rows = pick(hierarchy, item="item", parent="parent").where("item is not null and parent is not null").distinct()
    twice = rows.groupBy("item").count().where("count > 1").limit(1).collect()
    if twice:
        raise HierarchyError(f"item {twice[0]['item']!r} has {twice[0]['count']} parents")
    return rows


def closure(hierarchy: DataFrame) -> DataFrame:
    """``item, ancestor, depth`` of each node with itself (depth 0) and all its ancestors; raises on a loop."""
    return _closure(check_forest(hierarchy))


def _closure(edges: DataFrame) -> DataFrame:
    roots = edges.select(F.col("parent").alias("item")).join(edges.select("item"), "item", "left_anti").distinct()
    full = cut(full_hierarchy(edges.unionByName(roots.withColumn("parent", F.lit(None).cast("string")))))
    if bad := full.where("loop").select("item").limit(1).collect():
        raise HierarchyError(f"item {bad[0]['item']!r} leads into a loop")
    one = full.select("item", F.posexplode("path").alias("at", "ancestor"), F.size("path").alias("n"))
    return one.select("item", "ancestor", (F.col("n") - 1 - F.col("at")).alias("depth"))


def _closure_here(edges: pd.DataFrame) -> pd.DataFrame:
    """closure() of a small hierarchy."""
    up: dict[str, str] = {}
    for item, parent in edges.itertuples(index=False):
        if item in up:
            raise HierarchyError(f"item {item!r} has 2 parents")
        up[item] = parent
    rows = []
    for item in {*up, *up.values()}:
        at, depth, seen = item, 0, set()
        while at is not None:
            if at in seen:
                raise HierarchyError(f"item {item!r} leads into a loop")
            seen.add(at)
            rows.append((item, at, depth))
            at, depth = up.get(at), depth + 1
    return pd.DataFrame(rows, columns=["item", "ancestor", "depth"]).astype({"depth": "int32"})


class Taxonomy:
    """Functions on a hierarchy; each gives a table, and takes tables where it is asked about several items at once."""

    def __init__(self, hierarchy: DataFrame):
        spark = hierarchy.sparkSession
        #: ``item, parent`` and ``item, ancestor, depth`` in the driver, if the hierarchy is small
        self.here: tuple[pd.DataFrame, pd.DataFrame] | None = None
        rows = pick(hierarchy, item="item", parent="parent").where("item is not null and parent is not null").distinct()
        if is_small(rows, LIMITS.hierarchy):
            some = rows.toPandas()
            self.here = some, _closure_here(some)
            self.edges = spark.createDataFrame(some, "item string, parent string")
            self.closure = spark.createDataFrame(self.here[1], "item string, ancestor string, depth int")
        else:
            self.edges = cut(check_forest(hierarchy))
            self.closure = cut(_closure(self.edges))

    def parents(self) -> DataFrame:
        """``item, parent``."""
        return self.edges

    def parent_of(self, items: DataFrame) -> DataFrame:
        """``item, parent`` of the items; a null parent for a root or an unknown item."""
        return items.select("item").join(self.edges, "item", "left")

    def has_parent(self, items: DataFrame) -> DataFrame:
        """``item, has_parent``."""
        return self.parent_of(items).select("item", F.col("parent").isNotNull().alias("has_parent"))

    def roots(self) -> DataFrame:
        """``item, root, depth`` of each node."""
        return self.closure.groupBy("item").agg(F.max_by("ancestor", "depth").alias("root"), F.max("depth").alias("depth"))

    def max_depth(self) -> DataFrame:
        """``max_depth``, one row; null for an empty hierarchy."""
        return self.closure.agg(F.max("depth").alias("max_depth"))

    def is_parent(self, pairs: DataFrame) -> DataFrame:
        """``parent, child, holds``: whether parent is a proper ancestor of child."""
        up = self.closure.where("depth > 0").select(F.col("item").alias("child"), F.col("ancestor").alias("parent"), F.lit(True).alias("known"))
        return pairs.select("parent", "child").join(up, ["parent", "child"], "left").select("parent", "child", F.col("known").isNotNull().alias("holds"))

    def is_generalization_of(self, pairs: DataFrame) -> DataFrame:
        """``general, item, holds``: whether general is the item or an ancestor of it."""
        up = self.closure.select("item", F.col("ancestor").alias("general"), F.lit(True).alias("known"))
        out = pairs.select("general", "item").join(up, ["general", "item"], "left")
        return out.select("general", "item", (F.col("known").isNotNull() | (F.col("general") == F.col("item"))).alias("holds"))

    def common_parent(self, pairs: DataFrame) -> DataFrame:
        """``a, b, common``: the lowest node that is a or b itself or above both; null if there is none."""
        up = self.closure
        a = up.select(F.col("item").alias("a"), F.col("ancestor").alias("common"), F.col("depth").alias("d"))
        b = up.select(F.col("item").alias("b"), F.col("ancestor").alias("common"))
        both = pairs.select("a", "b").distinct().join(a, "a").join(b, ["b", "common"])
        low = both.groupBy("a", "b").agg(F.min_by("common", "d").alias("common"))
        return pairs.select("a", "b").join(low, ["a", "b"], "left")
