"""Text files of sequences, hierarchies, dictionaries and encoded sequences, searched recursively."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY = "item string, cf bigint, df bigint, tid int, parent_tid int"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path)


def _tokens(separator: str):
    """The fields of a trimmed line; none for a blank one."""
    line = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, separator))


def read_sequences(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """``seq_id, items`` of lines ``id item_1 ... item_n`` of all files under path; the id is kept as text and may repeat.

    White space around a line counts for nothing; blank lines are no sequences; a line of an id alone is an empty sequence.
    """
    rows = _lines(spark, path).select(_tokens(separator).alias("t")).where(F.size("t") > 0)
    return rows.select(F.element_at("t", 1).alias("seq_id"), F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x: F.trim(x)).alias("items"))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """``item, parent`` of lines of exactly two fields; other lines are left out, and of an item's several lines the last holds."""
    rows = _lines(spark, path).select(_tokens(r"\s+").alias("t"), F.monotonically_increasing_id().alias("n")).where(F.size("t") == 2)
    last = rows.groupBy(F.element_at("t", 1).alias("item")).agg(F.max_by(F.element_at("t", 2), "n").alias("parent"))
    return last.select("item", "parent")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``item, cf, df, tid, parent_tid`` of lines parted by tabs; parent_tid is 0 for a root."""
    return spark.read.option("sep", "\t").option("quote", "").option("recursiveFileLookup", "true").schema(DICTIONARY).csv(path)


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    """``tids, weight`` of lines of ids parted by blanks, one sequence each; blank lines are left out."""
    rows = _lines(spark, path).select(_tokens(r"\s+").alias("t")).where(F.size("t") > 0)
    return rows.select(F.col("t").cast("array<int>").alias("tids"), F.lit(1).cast("bigint").alias("weight"))
