"""Queries that write with the sinks and read with the sources: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseq import __main__ as command
from arborseq.common import cut, own_path
from arborseq.operators.dictionary import encode_rows, ranked
from arborseq.plans import api
from arborseq.plans.workloads import WORKLOADS, table
from arborseq.sources import records, store, text

SUPPLIERS = WORKLOADS["order_suppliers"]


def _sequence_files(spark: SparkSession, d: str) -> str:
    """Lines with a tab, several blanks and padding, and a blank one, in folders of unlike depth."""
    path = own_path(spark)
    rows = SUPPLIERS.sequences(spark, d)
    line = F.concat(F.lit("  "), F.col("seq_id").cast("string"), F.lit("\t"), F.array_join("items", "  "), F.lit(" "))
    rows.where("seq_id % 2 = 0").select(line).write.text(f"{path}/even")
    rows.where("seq_id % 2 <> 0").select(line).union(spark.createDataFrame([(" ",)], "x string")).write.text(f"{path}/deep/odd")
    return path


def _hierarchy_file(spark: SparkSession, d: str) -> str:
    """One file: outdated lines of all items, lines of one and of three fields, then the lines that hold."""
    path = own_path(spark)
    tree = SUPPLIERS.hierarchy(spark, d)
    old = tree.select(F.concat("item", F.lit(" outdated")).alias("line"))
    bad = spark.createDataFrame([("alone",), ("one two three",), ("",)], "line string")
    old.union(bad).union(tree.select(F.concat("item", F.lit("\t "), "parent"))).coalesce(1).write.text(path)
    return path


def sequence_text(spark, d):
    return text.read_sequences(spark, _sequence_files(spark, d)).select("seq_id", F.concat_ws(" ", "items").alias("items"))


def hierarchy_text(spark, d):
    return text.read_hierarchy(spark, _hierarchy_file(spark, d))


def _prepared(spark, d):
    return api.encode(SUPPLIERS.sequences(spark, d), SUPPLIERS.hierarchy(spark, d))


def dictionary_text(spark, d):
    path = own_path(spark)
    store.write_dictionary_text(_prepared(spark, d).dictionary, path)
    return text.read_dictionary(spark, path)


def encoded_text(spark, d):
    path = own_path(spark)
    rows = encode_rows(SUPPLIERS.sequences(spark, d), _prepared(spark, d).dictionary)
    rows.select(F.concat_ws(" ", F.transform("tids", lambda x: x.cast("string")))).write.text(path)
    back = text.read_encoded(spark, path)
    return back.groupBy(F.concat_ws(" ", F.transform("tids", lambda x: x.cast("string"))).alias("ids")).agg(F.sum("weight").alias("n"))


def _least(spark, d):
    return SUPPLIERS.least(SUPPLIERS.sequences(spark, d).select("seq_id").count())


def encoded_resume(spark, d):
    path = own_path(spark)
    store.save_encoded(_prepared(spark, d), path)
    kept = store.load_encoded(spark, path)
    return api.pattern_text(api.mine_encoded(kept, _least(spark, d), SUPPLIERS.gap, SUPPLIERS.length))


def pattern_parquet(spark, d):
    path = own_path(spark)
    found = cut(api.mine_encoded(_prepared(spark, d), _least(spark, d), SUPPLIERS.gap, SUPPLIERS.length))
    store.write_patterns(found.limit(1), path)
    store.write_patterns(found, path)
    return api.pattern_text(spark.read.parquet(path))


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, n``: numbered through all files."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("line"))
    return ranked(cut(rows), "f", "k").select("line", F.col("rank").cast("bigint").alias("n"))


def pattern_sorted_text(spark, d):
    path = own_path(spark)
    store.write_pattern_text(api.mine_encoded(_prepared(spark, d), _least(spark, d), SUPPLIERS.gap, SUPPLIERS.length), path)
    return _file_lines(spark, path)


def command_line(spark, d):
    """A run that keeps its encoded data, and one that goes on from them by the other mode."""
    kept, out = own_path(spark), own_path(spark)
    how = ["-o", out, "-s", str(_least(spark, d)), "-g", str(SUPPLIERS.gap), "-l", str(SUPPLIERS.length)]
    command.run(spark, ["-i", _sequence_files(spark, d), "-H", _hierarchy_file(spark, d), "-k", kept, "-m", "s", *how])
    command.run(spark, ["-r", kept, "-m", "d", *how])
    return _file_lines(spark, out)


def records_in_files(spark, d):
    """``reason, n_lines, n_fields`` of the lines of raw_sequences in files."""
    path = own_path(spark)
    table(spark, d, "raw_sequences").where(F.col("line").isNotNull()).select("line").write.text(path)
    found = records.parse_files(spark, path, records.SEQUENCES)
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("fields")).alias("n_fields"))


def queries():
    return {
        "sequence_text": sequence_text, "hierarchy_text": hierarchy_text, "dictionary_text": dictionary_text, "encoded_text": encoded_text, "encoded_resume": encoded_resume,
        "pattern_parquet": pattern_parquet, "pattern_sorted_text": pattern_sorted_text, "command_line": command_line, "records_in_files": records_in_files,
    }
