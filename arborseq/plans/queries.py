"""The queries over the test tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseq.common import cut, limits
from arborseq.functions import arrays as A
from arborseq.operators import mining
from arborseq.operators.dictionary import decode, encode_rows, flist, frequent_items, redundant_ancestors
from arborseq.operators.hierarchy import Taxonomy
from arborseq.operators.skew import key_figures
from arborseq.operators.tree import hierarchy_text, holding_rows
from arborseq.plans import api, storage
from arborseq.plans.workloads import WORKLOADS, Workload, table
from arborseq.sources import records

Query = Callable[[SparkSession, str], DataFrame]


def run_mine(w: Workload, strategy: str = "levelwise", gap: int | None = None, length: int | None = None, flat: bool = False) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        seqs = cut(w.sequences(spark, d))
        prepared = api.encode(seqs, None if flat else w.hierarchy(spark, d), keep=False)
        least = w.least(seqs.count())
        return api.pattern_text(api.mine_encoded(prepared, least, w.gap if gap is None else gap, w.length if length is None else length, strategy))

    return query


def _taxonomy(name: str):
    def make(f: Callable[[Taxonomy], DataFrame]) -> Query:
        return lambda spark, d: f(Taxonomy(WORKLOADS[name].hierarchy(spark, d)))

    return make


def _counts(w: Workload, spark: SparkSession, d: str) -> tuple[Taxonomy, DataFrame]:
    tax = Taxonomy(w.hierarchy(spark, d))
    return tax, flist(w.sequences(spark, d), tax.closure)


def _reduced(w: Workload, spark: SparkSession, d: str, trim: bool = True) -> tuple[DataFrame, DataFrame]:
    seqs = cut(w.sequences(spark, d))
    return api.encode(seqs, w.hierarchy(spark, d), keep=False).reduced(w.least(seqs.count()), trim)


def _numbered(w: Workload, spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """``seq_id, tids`` and the dictionary."""
    seqs = w.sequences(spark, d)
    ids = api.encode(seqs, w.hierarchy(spark, d), keep=False).dictionary
    return encode_rows(seqs, ids), ids


def _joined_ids(c: str):
    return F.concat_ws(" ", F.transform(c, lambda x: x.cast("string")))


def _encode_sequences(spark, d):
    rows, _ = _numbered(WORKLOADS["order_suppliers"], spark, d)
    return rows.select("seq_id", _joined_ids("tids").alias("ids"))


def _decode_roundtrip(spark, d):
    rows, ids = _numbered(WORKLOADS["order_suppliers"], spark, d)
    return decode(rows, ids, "tids").select("seq_id", F.concat_ws(" ", "pattern").alias("items"))


def _pivot_partitions(spark, d):
    rows, chains = _reduced(WORKLOADS["order_suppliers"], spark, d, trim=False)
    return mining.pivot_partitions(rows, chains).groupBy("pivot").agg(F.sum("weight").alias("n_sequences"))


def _pivot_rewrite(spark, d):
    rows, chains = _reduced(WORKLOADS["order_suppliers"], spark, d, trim=False)
    parts = mining.pivot_partitions(rows, chains).select("pivot", "weight", A.to_pivot(F.col("chains"), F.col("pivot")).alias("ids"))
    return parts.groupBy("pivot", _text(F.col("ids")).alias("seq")).agg(F.sum("weight").alias("weight"))


def _aggregated(spark, d):
    rows, _ = _reduced(WORKLOADS["order_parts"], spark, d, trim=False)
    return rows.select(_joined_ids("codes").alias("seq"), "weight")


def _two(spark, d):
    w = WORKLOADS["order_parts"]
    seqs = cut(w.sequences(spark, d))
    prepared = api.encode(seqs, w.hierarchy(spark, d), keep=False)
    least = w.least(seqs.count())
    found = mining.two_sequences(prepared, least, w.gap)
    return api.pattern_text(decode(found, prepared.frequent(least), here=prepared.held).select("pattern", "frequency"))


def _common_parent(tax: Taxonomy) -> DataFrame:
    s = tax.parents().where("item like 's%'").select(F.col("item").alias("a"))
    nxt = F.concat(F.lit("s"), (F.substring("a", 2, 20).cast("int") + 1).cast("string"))
    return tax.common_parent(s.withColumn("b", nxt).join(s.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b"))


def _is_parent(tax: Taxonomy) -> DataFrame:
    nations = [r.parent for r in tax.parents().where("parent like 'n%'").select("parent").distinct().collect()]  # 25 at most
    children = tax.parents().where("item like 's%'").select(F.col("item").alias("child"))
    return tax.is_parent(children.select(F.explode(F.array(*[F.lit(n) for n in nations])).alias("parent"), "child"))


def _is_generalization(tax: Taxonomy) -> DataFrame:
    t, n = tax.parents(), tax.closure.select("item").distinct()
    pairs = n.select(F.col("item").alias("general"), "item").union(t.select("parent", "item")).union(t.select("item", "parent"))
    return tax.is_generalization_of(pairs.distinct())


def _p3(spark, d):
    seqs = records.parse_lines(table(spark, d, "raw_sequences"), records.SEQUENCES)
    tree = records.parse_lines(table(spark, d, "raw_hierarchy"), records.HIERARCHY)
    bad = records.rejects(seqs, "sequences").unionByName(records.rejects(tree, "hierarchy"))
    return bad.select("source", "line_id", "reason")


def _within(query: Query, **values: int) -> Query:
    """The query planned under other limits."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        with limits(**values):
            return query(spark, d)

    return run


def _blanks(column, gap: int | None = None) -> Query:
    """Functions on blanks over the sequences as each pivot sees them."""
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows, chains = _reduced(WORKLOADS["order_suppliers"], spark, d, trim=False)
        parts = mining.pivot_partitions(rows, chains).select("pivot", "weight", A.to_pivot(F.col("chains"), F.col("pivot")).alias("ids"))
        ids = A.compress_blanks(F.col("ids") if gap is None else A.trim_blanks(F.col("ids")))
        out = F.explode(F.filter(A.split_gaps(ids, gap), lambda x: F.size(x) > 0)) if gap is not None else column(ids)
        return parts.select("pivot", "weight", out.alias("ids")).select("pivot", "weight", _text(F.col("ids") if gap is None else A.expand_blanks(F.col("ids"))).alias("seq"))

    def total(spark: SparkSession, d: str) -> DataFrame:
        return query(spark, d).groupBy("pivot", "seq").agg(F.sum("weight").alias("weight"))

    return total


def _text(ids):
    return F.concat_ws(" ", F.transform(ids, lambda x: F.when(x == 0, F.lit("_")).otherwise(x.cast("string"))))


def _relevant(spark, d):
    rows, chains = _reduced(WORKLOADS["order_suppliers"], spark, d, trim=False)
    parts = mining.pivot_partitions(rows, chains)
    own = F.size(F.filter("chains", lambda c: A.is_relevant(c, F.col("pivot")))) * F.col("weight")
    return parts.groupBy("pivot").agg(F.sum(own).cast("bigint").alias("n_positions"))


def _counters(spark, d):
    w = WORKLOADS["order_suppliers"]
    seqs = cut(w.sequences(spark, d))
    return mining.level_counters(api.encode(seqs, w.hierarchy(spark, d), keep=False), w.least(seqs.count()), w.gap, w.length)


def _recovered(spark, d):
    """The lines of raw_sequences in texts of 100 lines each, parsed as texts."""
    lines = table(spark, d, "raw_sequences").where(F.col("line").isNotNull())
    texts = lines.groupBy(F.expr("line_id div 100").alias("part")).agg(F.array_sort(F.collect_list(F.struct("line_id", "line"))).alias("x"))
    texts = texts.select("part", F.array_join("x.line", "\n").alias("text"))
    return records.parse_chunks(texts, records.SEQUENCES, "part", "text").select("chunk", "line", F.size("fields").alias("n_fields"), "reason", "after")


def queries() -> dict[str, Query]:
    s, p = WORKLOADS["order_suppliers"], WORKLOADS["order_parts"]
    sup, par = _taxonomy("order_suppliers"), _taxonomy("order_parts")
    out: dict[str, Query] = {f"mine_{name}": run_mine(w) for name, w in WORKLOADS.items()}
    out |= {f"mine_{x}_order_suppliers": run_mine(s, x) for x in ("joins", "bfs", "partitioned")}
    out |= {
        "mine_partitioned_order_parts": run_mine(p, "partitioned"),
        "mine_partitioned_customer_priority": run_mine(WORKLOADS["customer_priority"], "partitioned"),
        "mine_gap0": run_mine(s, gap=0), "mine_gap2": run_mine(s, gap=2), "mine_len2": run_mine(s, length=2),
        "mine_flat": run_mine(WORKLOADS["customer_priority"], flat=True),
        "two_sequences": _two,
        "hierarchy_closure": sup(lambda t: t.closure),
        "taxonomy_root_depth": par(lambda t: t.roots()),
        "taxonomy_max_depth": par(lambda t: t.max_depth()),
        "taxonomy_parents": sup(lambda t: t.parent_of(n := t.closure.select("item").distinct()).join(t.has_parent(n), "item")),
        "taxonomy_common_parent": sup(_common_parent),
        "taxonomy_is_parent": sup(_is_parent),
        "taxonomy_is_generalization": sup(_is_generalization),
        "flist_cf_df": lambda spark, d: _counts(p, spark, d)[1],
        "flist_table_sequences": lambda spark, d: _counts(WORKLOADS["table_sequences"], spark, d)[1],
        "frequent_items": lambda spark, d: frequent_items(_counts(p, spark, d)[1], p.least(p.sequences(spark, d).count())),
        "redundant_ancestors": lambda spark, d: (lambda tax, c: redundant_ancestors(c, tax.edges))(*_counts(WORKLOADS["priority_levels"], spark, d)),
        "dictionary": lambda spark, d: api.encode(p.sequences(spark, d), p.hierarchy(spark, d), keep=False).dictionary,
        "encode_sequences": _encode_sequences, "decode_roundtrip": _decode_roundtrip,
        "pivot_partitions": _pivot_partitions, "pivot_rewrite": _pivot_rewrite, "aggregated_sequences": _aggregated,
        "pattern_counts_by_length": lambda spark, d: api.counts_by_length(run_mine(s)(spark, d).select(F.split("pattern", " ").alias("pattern"))),
        "pattern_text": lambda spark, d: run_mine(s)(spark, d).select(F.concat("pattern", F.lit("\t"), F.col("frequency").cast("string")).alias("line")),
        "sequences_loaded": lambda spark, d: records.valid_sequences(records.parse_lines(table(spark, d, "raw_sequences"), records.SEQUENCES)),
        "hierarchy_loaded": lambda spark, d: records.valid_hierarchy(records.parse_lines(table(spark, d, "raw_hierarchy"), records.HIERARCHY)),
        "p3_found": _p3, "p3_recovered": _recovered,
        "p6_found": lambda spark, d: hierarchy_text(holding_rows(table(spark, d, "hierarchy"))),
        "p6_contracted": lambda spark, d: hierarchy_text(holding_rows(table(spark, d, "hierarchy")), one_task=50, per_task=300),
        "p7_found": lambda spark, d: key_figures(table(spark, d, "sequence_items"), table(spark, d, "hierarchy")),
    }
    pri, lev = WORKLOADS["customer_priority"], WORKLOADS["priority_levels"]
    joined = {"rows": 0, "hierarchy": 0}
    out |= {
        # the same with tables too large for the driver and the workers
        "closure_joined": _within(out["hierarchy_closure"], **joined), "flist_joined": _within(out["flist_cf_df"], **joined),
        "dictionary_joined": _within(out["dictionary"], **joined), "encode_joined": _within(_encode_sequences, **joined),
        "decode_joined": _within(_decode_roundtrip, **joined), "mine_joined_lookups": _within(run_mine(s), **joined),
        "mine_levels_joined": _within(run_mine(s), patterns=1), "mine_partitioned_joined_lookups": _within(run_mine(s, "partitioned"), **joined),
        "mine_partitioned_split": _within(run_mine(s, "partitioned"), group=0),
        "mine_partitioned_split_priority": _within(run_mine(pri, "partitioned"), group=0),
        "mine_segmented_events": run_mine(WORKLOADS["events"], "segmented"), "mine_segmented_table_sequences": run_mine(WORKLOADS["table_sequences"], "segmented"),
        "mine_partitioned_priority_levels": run_mine(lev, "partitioned"),
        "pattern_counters": _counters, "relevant_positions": _relevant,
        "blanks_roundtrip": _blanks(A.expand_blanks), "blanks_single": _blanks(A.single_blanks), "gap_split": _blanks(None, 1),
    }
    return out | storage.queries()
