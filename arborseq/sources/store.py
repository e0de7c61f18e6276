"""Sinks, and encoded data kept for later runs with other parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseq.operators.mining import Prepared

SEQUENCES, IDS = "tids array<int>, weight bigint", "item string, cf bigint, df bigint, tid int, parent_tid int, redundant boolean"


def write_patterns(patterns: DataFrame, path: str) -> None:
    """``pattern, frequency`` as parquet; what was there is replaced."""
    patterns.write.mode("overwrite").parquet(path)


def write_pattern_text(patterns: DataFrame, path: str) -> None:
    """Lines ``item_1 ... item_n <tab> frequency``, sorted by pattern over all files; what was there is replaced."""
    text = patterns.select(F.concat_ws(" ", "pattern").alias("p"), "frequency").orderBy("p")
    text.select(F.concat("p", F.lit("\t"), F.col("frequency").cast("string"))).write.mode("overwrite").text(path)


def save_encoded(prepared: Prepared, path: str) -> None:
    """The dictionary (of all items, whatever their support) and the encoded sequences."""
    prepared.dictionary.write.mode("overwrite").parquet(f"{path}/dict")
    prepared.sequences.select("tids", "weight").write.mode("overwrite").parquet(f"{path}/seqs")


def load_encoded(spark: SparkSession, path: str) -> Prepared:
    """What save_encoded wrote."""
    return Prepared(spark.read.schema(SEQUENCES).parquet(f"{path}/seqs"), spark.read.schema(IDS).parquet(f"{path}/dict"))


def write_dictionary_text(ids: DataFrame, path: str) -> None:
    """Lines ``item, cf, df, tid, parent_tid`` parted by tabs, by id."""
    ids.orderBy("tid").select(F.concat_ws("\t", "item", *(F.col(c).cast("string") for c in ("cf", "df", "tid", "parent_tid")))).write.mode("overwrite").text(path)
