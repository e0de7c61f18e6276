"""New text files as a stream of parsed lines. Parsing needs no state, so late or repeated files are no special case."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseq.sources.records import _OUT, Grammar, Recovery, _columns, _parsed_lines


def parse_stream(spark: SparkSession, path: str, grammar: Grammar) -> DataFrame:
    """``line, fields, reason, at, what`` of each line of the text files that come into a folder."""
    lines = spark.readStream.text(path).select(F.col("value").cast("binary").alias("line"))

    def run(batches):
        for b in batches:
            own = _columns(_parsed_lines(Recovery(grammar), b.column(0).to_pylist(), list(range(b.num_rows))))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), *own[:-1]], ["line", *_OUT.names[:-1]])

    return lines.mapInArrow(run, "line string, fields array<string>, reason string, at int, what string")
