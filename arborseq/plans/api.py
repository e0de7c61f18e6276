"""The whole plan: sequences and a hierarchy in, patterns with their frequencies out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseq.common import cut, is_small
from arborseq.operators import mining
from arborseq.operators.dictionary import decode, dictionary, dictionary_here, flist
from arborseq.operators.dictionary import encode as encode_sequences
from arborseq.operators.hierarchy import Taxonomy

SUPPORT, GAP, LENGTH = 100, 0, 5


def encode(sequences: DataFrame, hierarchy: DataFrame | None = None, keep: bool = True) -> mining.Prepared:
    """The dictionary of the items and the sequences as ids; serves any support, gap and length.

    sequences: ``items`` and perhaps ``weight``, a sequence per row; hierarchy: ``item, parent``, a forest. keep: the ids are
    written, for several uses.
    """
    spark = sequences.sparkSession
    if hierarchy is None:
        hierarchy = spark.createDataFrame([], "item string, parent string")
    tax = Taxonomy(hierarchy)
    counts = cut(flist(sequences, tax.closure, tax.here and tax.here[1], tax.edges))
    if tax.here is not None and is_small(counts):
        here = dictionary_here(counts.toPandas(), *tax.here)
        ids = spark.createDataFrame(here)
        rows = encode_sequences(sequences, ids, here).select("tids", "weight")
        return mining.Prepared(cut(rows) if keep else rows, ids, here)
    ids = cut(dictionary(counts, tax.edges, tax.closure))
    rows = encode_sequences(sequences, ids).select("tids", "weight")
    return mining.Prepared(cut(rows) if keep else rows, ids)


def mine_encoded(
    prepared: mining.Prepared, min_support: int = SUPPORT, max_gap: int = GAP, max_length: int = LENGTH, strategy: str = "levelwise"
) -> DataFrame:
    """``pattern, frequency`` of all patterns of 2 to max_length items in at least min_support sequences, at most max_gap items between neighbours."""
    if min_support < 1 or max_gap < 0:
        raise ValueError("min_support must be 1 at least, max_gap 0 at least")
    if strategy not in mining.STRATEGIES:
        raise ValueError(f"strategy must be one of {sorted(mining.STRATEGIES)}")
    if max_length < 2:
        return prepared.dictionary.sparkSession.createDataFrame([], "pattern array<string>, frequency bigint")
    found = mining.STRATEGIES[strategy](prepared, min_support, max_gap, max_length)
    return decode(found, prepared.frequent(min_support), here=prepared.held).select("pattern", "frequency")


def mine(
    sequences: DataFrame, hierarchy: DataFrame | None = None, min_support: int = SUPPORT, max_gap: int = GAP, max_length: int = LENGTH,
    strategy: str = "levelwise",
) -> DataFrame:
    """mine_encoded of encode."""
    return mine_encoded(encode(sequences, hierarchy, keep=False), min_support, max_gap, max_length, strategy)


def pattern_text(patterns: DataFrame) -> DataFrame:
    """``pattern, frequency`` with the items joined by one blank (items that hold blanks make it ambiguous)."""
    return patterns.select(F.concat_ws(" ", "pattern").alias("pattern"), "frequency")


def counts_by_length(patterns: DataFrame) -> DataFrame:
    """``length, n_patterns``."""
    return patterns.groupBy(F.size("pattern").alias("length")).agg(F.count(F.lit(1)).alias("n_patterns"))
