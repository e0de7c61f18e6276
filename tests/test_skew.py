import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from arborseq.operators.events import beyond_first_word, packed, record_totals
from arborseq.operators.skew import key_figures, longest_waits, up_the_tree

T0 = datetime(2024, 1, 1)
SCHEMA = "seq_id long, pos int, item string, ts timestamp_ntz"


def brute(rows, parent):
    keys = {}
    for seq, pos, item, ts in set(rows):
        if item is not None:
            keys.setdefault(("item", item), []).append((seq, pos, ts))
            if parent.get(item) is not None:
                keys.setdefault(("parent", parent[item]), []).append((seq, pos, ts))
    out = set()
    for (field, key), ev in keys.items():
        times = sorted(t for _, _, t in ev if t is not None)
        wait = max([int((b - a).total_seconds()) for a, b in zip(times, times[1:])], default=0)
        out.add((field, key, len(ev), len({s for s, _, _ in ev if s is not None}), wait))
    return out


@pytest.mark.parametrize("far, parts", [(False, 4), (True, 40)])
def test_against_brute_force(spark, far, parts):
    rnd = random.Random(parts)
    rows = []
    for _ in range(600):
        item = "hot" if rnd.random() < 0.4 else rnd.choice([None, "a", "b", "c d", "é"])
        pos = rnd.randrange(300 if far else 60) if not far or rnd.random() < 0.95 else None
        rows.append((rnd.randrange(40), pos, item, T0 + timedelta(seconds=rnd.randrange(10**6), microseconds=rnd.randrange(10**6))))
    seen = {}
    rows = [(s, p, *seen.setdefault((s, p), (i, t))) for s, p, i, t in rows]
    rows += rnd.sample(rows, 100)
    parent = {"hot": "top", "a": "top", "b": None, "c d": "side"}
    tree = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(parent.items())], "item string, parent string, line_no long")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("gap", F.lit(1)).withColumn("bits", F.lit(2)).repartition(5)
    assert {tuple(r) for r in key_figures(df, tree, parts).collect()} == brute(rows, parent)


def test_empty(spark):
    tree = spark.createDataFrame([], "item string, parent string, line_no long")
    assert key_figures(spark.createDataFrame([], SCHEMA), tree).count() == 0
    one = key_figures(spark.createDataFrame([(1, 0, "a", None), (None, 0, "a", T0)], SCHEMA), tree)
    assert [tuple(r) for r in one.collect()] == [("item", "a", 2, 1, 0)]


def test_key_over_many_partitions(spark):
    df = spark.range(1000).select(F.lit(False).alias("is_parent"), F.lit("k").alias("key_value"), F.timestamp_micros(F.col("id") * F.col("id") * 1000).alias("ts"))
    assert [r.gap for r in longest_waits(df, 300).collect()] == [(999**2 - 998**2) * 1000]


def test_states_go_up_the_tree(spark):
    states = spark.range(5000).select(
        F.lit(False).alias("is_parent"), F.lit("k").alias("key_value"), (F.col("id") % 300).cast("int").alias("part"),
        F.lit(2).cast("bigint").alias("n_rows"), F.col("id").alias("n_records"), F.when(F.col("id") == 7, 9).cast("bigint").alias("gap"),
    )
    for parts in (300, 10_000):
        assert [tuple(r) for r in up_the_tree(states, parts).collect()] == [(False, "k", 10_000, 4999 * 2500, 9)]


def test_records_beyond_first_word(spark):
    rows = [(1, 5, "a"), (1, 70, "a"), (1, 700, "a"), (2, 70, "a"), (2, 71, "b"), (3, 1, "b"), (None, 1, "b"), (3, -4, "b")]
    df = spark.createDataFrame(rows, "seq_id long, pos int, item string")
    assert beyond_first_word(df)
    got = {tuple(r) for r in record_totals(packed(df, "item"), ["item"], True).collect()}
    assert got == {("a", 4, 2), ("b", 4, 2)}
