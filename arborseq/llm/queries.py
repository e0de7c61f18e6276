"""Queries p1, p2, p4, p5, p8, p9 and p10: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborseq.llm import heavy, leaks, pairs, patterns, spans, terms, tokens
from arborseq.plans.workloads import table


def _p1(spark, d):
    found = patterns.frequent_subsequences(table(spark, d, "sequences"), per_n=200, max_gap=2, max_length=5)
    return found.select(F.concat_ws(" ", "pattern").alias("sequence"), "frequency")


def _p2(spark, d):
    found = pairs.items_together(table(spark, d, "sequences"), least=8, per_n=500)
    return pairs.at_least_times_chance(found, 3).select("item_a", "item_b")


def _p2_odds(spark, d):
    found = pairs.items_together(table(spark, d, "sequences"), least=8, per_n=500)
    return found.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio"))


def _p4(spark, d):
    items = terms.event_terms(table(spark, d, "sequence_items"), common_per=20, rare_below=3)
    tops = terms.line_terms(table(spark, d, "hierarchy"), common_per=20, rare_below=3)
    return items.select(F.lit("item").alias("field"), "*").unionByName(tops.select(F.lit("parent").alias("field"), "*"))


def queries():
    return {
        "p1_found": _p1,
        "p2_found": _p2,
        "p2_odds": _p2_odds,
        "p4_found": _p4,
        "p5_found": lambda spark, d: heavy.heavy_events(table(spark, d, "sequence_items"), per=250).select("item"),
        "p8_ids": lambda spark, d: tokens.token_ids(table(spark, d, "documents")),
        "p9_found": lambda spark, d: leaks.leaked(table(spark, d, "documents"), table(spark, d, "benchmark"), words=10).where("edits = 0").select("doc_id", "item_id"),
        "p10_found": lambda spark, d: spans.shared_spans(table(spark, d, "documents"), least=240),
    }
