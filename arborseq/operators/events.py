"""Event logs: rows ``seq_id, pos, item[, ts]`` that may be delivered more than once.

An event is one distinct (seq_id, pos, item) with a non-null item; a null seq_id or pos counts as a value of
its own. Positions are packed: one row per (record, key, 64 positions) with a bit for each, so that repeated
deliveries fold together before the shuffle already, and a long record is many rows, not one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseq.common import cut, maybe_broadcast


def packed(events: DataFrame, *names: str) -> DataFrame:
    """``*names, seq_id, word, bits``: the distinct positions of each key in each 64 positions of each record."""
    pos = F.col("pos").cast("bigint")
    return events.select(
        *names, "seq_id", F.coalesce(F.shiftright(pos, 6), F.lit(-1 << 57)).alias("word"),
        F.expr("shiftleft(1L, cast(coalesce(cast(pos as bigint), 0) & 63 as int))").alias("bit"),
    ).groupBy("seq_id", *names, "word").agg(F.bit_or("bit").alias("bits"))


def beyond_first_word(events: DataFrame) -> bool:
    """Whether any position lies outside 0 ... 63 (parquet statistics answer most of it)."""
    return events.where(F.col("pos").isNull() | (F.col("pos") < 0) | (F.col("pos") > 63)).limit(1).count() > 0


def record_parts(words: DataFrame, keys: list[str], far: bool) -> DataFrame:
    """``*keys, n_rows, n_records`` parts of rows ``*keys, seq_id, word, bits``; summed up: positions, and distinct non-null records, of each key.

    The first word of a record adds 1 record; if there are further words (far), those pairs (key, record) that have only such words are
    made distinct and counted beside.
    """
    here = (F.col("word") == 0) & F.col("seq_id").isNotNull()
    words = cut(words) if far else words
    parts = words.select(*keys, F.bit_count("bits").cast("bigint").alias("n_rows"), here.cast("bigint").alias("n_records"))
    if not far:
        return parts
    later = cut(words.where((F.col("word") != 0) & F.col("seq_id").isNotNull()).select(*keys, "seq_id").distinct())
    long = cut(later.select("seq_id").distinct())
    first = words.where(here).select(*keys, "seq_id").join(maybe_broadcast(long), "seq_id", "left_semi")
    more = later.join(first, [*keys, "seq_id"], "left_anti")
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return parts.unionByName(more.select(*keys, none.alias("n_rows"), one.alias("n_records")))


def record_totals(words: DataFrame, keys: list[str], far: bool) -> DataFrame:
    """``*keys, n_rows, n_records``: the sums of record_parts, added up by hash before the shuffle on the key."""
    return record_parts(words, keys, far).groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))
