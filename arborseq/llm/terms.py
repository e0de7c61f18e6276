"""Frequency of every distinct term, in rows and in records, with marks for those too rare or too common.

Counts are made per (record, term) first, combined by hash before each shuffle, then summed per term; no
group of a frequent term or of a long record is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborseq.common import pick
from arborseq.operators.events import beyond_first_word, packed, record_totals


def mark(n_records: Column, n: int, common_per: int, rare_below: int) -> Column:
    """``common`` in at least 1 / common_per of the n records, else ``rare`` in fewer than rare_below, else ``ok``."""
    return F.when(n_records * common_per >= F.lit(n), "common").when(n_records < rare_below, "rare").otherwise("ok")


def event_terms(events: DataFrame, common_per: int = 20, rare_below: int = 3) -> DataFrame:
    """``term, n_rows, n_records, mark`` of each non-null item: events (see operators/events.py), distinct non-null seq_id among them.

    N of the marks: distinct non-null seq_id of all rows. Rows delivered again change nothing; empty tables give no rows.
    """
    ev = pick(events, seq_id="seq_id", pos="pos", item="item")
    n = ev.where(F.col("seq_id").isNotNull()).select("seq_id").distinct().count()
    ev = ev.where(F.col("item").isNotNull())
    totals = record_totals(packed(ev, "item"), ["item"], beyond_first_word(ev))
    return totals.select(F.col("item").alias("term"), "n_rows", "n_records", mark(F.col("n_records"), n, common_per, rare_below).alias("mark"))


def line_terms(
    lines: DataFrame, term: str = "parent", record: str = "item", line: str = "line_no", common_per: int = 20, rare_below: int = 3
) -> DataFrame:
    """The same of the non-null terms of numbered lines: n_rows: distinct non-null lines with the term, n_records: distinct non-null records among them.

    N of the marks: distinct non-null records of all lines. Lines are counted at the least of their records, so the counts per
    (record, term) add up to distinct lines; they are combined by hash before the shuffle.
    """
    rows = pick(lines, term=term, record=record, line=line)
    n = rows.where(F.col("record").isNotNull()).select("record").distinct().count()
    rows = rows.where(F.col("term").isNotNull())
    lines_at = rows.where(F.col("line").isNotNull()).groupBy("term", "line").agg(F.min("record").alias("record"))
    per_record = (
        lines_at.select("term", "record", F.lit(1).alias("n")).unionByName(rows.select("term", "record", F.lit(0).alias("n")))
        .groupBy("term", "record").agg(F.sum("n").alias("n"))
    )
    totals = per_record.groupBy("term").agg(F.sum("n").alias("n_rows"), F.count("record").alias("n_records"))
    return totals.select("term", "n_rows", "n_records", mark(F.col("n_records"), n, common_per, rare_below).alias("mark"))
