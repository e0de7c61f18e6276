"""Sequences and hierarchies over the test tables, with the same in SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseq.common import cut
from arborseq.operators.tree import full_hierarchy, holding_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences_from(rows: DataFrame, key: str, order: list[str], item: Column) -> DataFrame:
    """``seq_id, items``: the items of each key in order."""
    entry = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], item.alias("item"))
    lists = rows.groupBy(F.col(key).alias("seq_id")).agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return lists.select("seq_id", F.col("x.item").alias("items"))


@dataclass(frozen=True)
class Workload:
    """seq_sql: ``sid, pos, item``; tree_sql: ``item, parent``. A pattern is frequent in n * share[0] / share[1] of n sequences, rounded up."""

    sequences: Callable[[SparkSession, str], DataFrame]
    hierarchy: Callable[[SparkSession, str], DataFrame]
    seq_sql: str
    tree_sql: str
    share: tuple[int, int]
    gap: int
    length: int

    def least(self, n: int) -> int:
        return max(1, -(-n * self.share[0] // self.share[1]))


def _events(spark, d):
    return sequences_from(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type"))


def _event_tree(spark, d):
    rows = [("view", "browse"), ("click", "browse"), ("signup", "convert"), ("purchase", "convert"), ("browse", "action"), ("convert", "action")]
    return spark.createDataFrame(rows, "item string, parent string")


EVENTS_SQL = "SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS item FROM events"
EVENT_TREE_SQL = (
    "SELECT * FROM (VALUES ('view','browse'),('click','browse'),('signup','convert'),('purchase','convert'),"
    "('browse','action'),('convert','action')) AS t(item, parent)"
)


def _suppliers(spark, d):
    return sequences_from(
        table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_suppkey"], F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    )


def _supplier_tree(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("item"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    return s.union(n)


SUPPLIERS_SQL = "SELECT l_orderkey AS sid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) - 1 AS pos, 's' || l_suppkey AS item FROM lineitem"
SUPPLIER_TREE_SQL = "SELECT 's' || s_suppkey AS item, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"


def _parts(spark, d):
    return sequences_from(
        table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    )


def _part_tree(spark, d):
    p = table(spark, d, "part")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    low = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("item"), name.alias("parent"))
    return low.union(p.select(name, F.split_part("p_name", F.lit(" "), F.lit(2))).distinct())


PARTS_SQL = "SELECT l_orderkey AS sid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, 'p' || l_partkey AS item FROM lineitem"
PART_TREE_SQL = (
    "SELECT 'p' || p_partkey AS item, replace(p_name, ' ', '_') AS parent FROM part "
    "UNION ALL SELECT DISTINCT replace(p_name, ' ', '_'), split_part(p_name, ' ', 2) FROM part"
)


def _priorities(spark, d):
    return sequences_from(
        table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("_"))
    )


def _priority_tree(spark, d):
    rows = [("1-URGENT", "HI"), ("2-HIGH", "HI"), ("4-NOT_SPECIFIED", "LO"), ("5-LOW", "LO")]
    return spark.createDataFrame(rows, "item string, parent string")


PRIORITIES_SQL = (
    "SELECT o_custkey AS sid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, "
    "replace(o_orderpriority, ' ', '_') AS item FROM orders"
)
PRIORITY_TREE_SQL = "SELECT * FROM (VALUES ('1-URGENT','HI'),('2-HIGH','HI'),('4-NOT_SPECIFIED','LO'),('5-LOW','LO')) AS t(item, parent)"


def _level_tree(spark, d):
    """MID occurs through 3-MEDIUM only, so it is redundant."""
    rows = [("1-URGENT", "HI"), ("2-HIGH", "HI"), ("3-MEDIUM", "MID"), ("4-NOT_SPECIFIED", "LO"), ("5-LOW", "LO"), ("HI", "ANY"), ("MID", "ANY"), ("LO", "ANY")]
    return spark.createDataFrame(rows, "item string, parent string")


LEVEL_TREE_SQL = (
    "SELECT * FROM (VALUES ('1-URGENT','HI'),('2-HIGH','HI'),('3-MEDIUM','MID'),('4-NOT_SPECIFIED','LO'),('5-LOW','LO'),"
    "('HI','ANY'),('MID','ANY'),('LO','ANY')) AS t(item, parent)"
)


def _table_sequences(spark, d):
    return table(spark, d, "sequences")


def _table_tree(spark, d):
    """The holding rows of the table ``hierarchy`` without those that never reach a root."""
    full = full_hierarchy(holding_rows(table(spark, d, "hierarchy")))
    return cut(full.where(~F.col("loop") & (F.size("path") > 1)).select("item", F.element_at("path", -2).alias("parent")))


#: each row is a sequence, so rows are numbered; nulls keep their position
TABLE_SEQUENCES_SQL = (
    "SELECT sid, unnest(range(len(items))) AS pos, unnest(items) AS item "
    "FROM (SELECT row_number() OVER () AS sid, items FROM sequences) WHERE len(items) > 0"
)
HOLDING_SQL = (
    "SELECT item, parent FROM (SELECT item, parent, row_number() OVER (PARTITION BY item ORDER BY line_no DESC NULLS LAST, parent DESC NULLS LAST) AS rn "
    "FROM hierarchy WHERE item IS NOT NULL) WHERE rn = 1"
)
#: items on a loop or leading into one climb more steps than there are items; those that end do so at a null or unknown parent
TABLE_TREE_SQL = (
    f"WITH RECURSIVE hold AS ({HOLDING_SQL}), "
    "up(item) AS (SELECT h.item FROM hold h WHERE h.parent IS NULL OR h.parent NOT IN (SELECT item FROM hold) "
    "UNION SELECT h.item FROM hold h JOIN up ON up.item = h.parent) "
    "SELECT hold.item, hold.parent FROM hold JOIN up USING (item) WHERE hold.parent IS NOT NULL"
)

WORKLOADS = {
    "events": Workload(_events, _event_tree, EVENTS_SQL, EVENT_TREE_SQL, (2, 3), 0, 3),
    "order_parts": Workload(_parts, _part_tree, PARTS_SQL, PART_TREE_SQL, (1, 147), 1, 3),
    "order_suppliers": Workload(_suppliers, _supplier_tree, SUPPLIERS_SQL, SUPPLIER_TREE_SQL, (1, 147), 1, 3),
    "customer_priority": Workload(_priorities, _priority_tree, PRIORITIES_SQL, PRIORITY_TREE_SQL, (2, 15), 1, 3),
    "priority_levels": Workload(_priorities, _level_tree, PRIORITIES_SQL, LEVEL_TREE_SQL, (1, 5), 1, 3),
    "table_sequences": Workload(_table_sequences, _table_tree, TABLE_SEQUENCES_SQL, TABLE_TREE_SQL, (1, 40), 1, 3),
}
