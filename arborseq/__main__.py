"""Command line: python -m arborseq -i SEQUENCES -H HIERARCHY -o OUTPUT [-s 100] [-g 0] [-l 5] [-m levelwise] [-k KEEP | -r RESUME] [-n PARTITIONS]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from arborseq.common import scratch, ship
from arborseq.operators.mining import STRATEGIES
from arborseq.plans import api
from arborseq.sources import store, text

#: s and d are the names of the sequential and the distributed mode; both run on the session's cluster
MODES = {"s": "levelwise", "d": "partitioned"} | {x: x for x in STRATEGIES}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arborseq", description="Frequent generalized subsequences of sequences under an item hierarchy.")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("-i", "--input", help="sequences: text files of lines 'id item_1 ... item_n'")
    source.add_argument("-r", "--resume", help="encoded data of an earlier run (of its --keepFiles)")
    p.add_argument("-H", "--hierarchy", help="text of lines 'item parent'; none: a flat hierarchy")
    p.add_argument("-o", "--output", required=True, help="folder of the result, which is replaced")
    p.add_argument("-s", "--support", type=int, default=api.SUPPORT)
    p.add_argument("-g", "--gap", type=int, default=api.GAP)
    p.add_argument("-l", "--length", type=int, default=api.LENGTH)
    p.add_argument("-m", "--mode", choices=sorted(MODES), default="s")
    p.add_argument("-k", "--keepFiles", help="folder for the encoded data")
    p.add_argument("-n", "--numReducers", type=int, help="shuffle partitions")
    p.add_argument("--separator", default=r"\s+", help="pattern between the fields of a sequence's line")
    return p


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.resume and args.keepFiles:
        parser().error("-k and -r exclude each other")
    if args.numReducers:
        spark.conf.set("spark.sql.shuffle.partitions", args.numReducers)
    if args.resume:
        prepared = store.load_encoded(spark, args.resume)
    else:
        tree = text.read_hierarchy(spark, args.hierarchy) if args.hierarchy else None
        prepared = api.encode(text.read_sequences(spark, args.input, args.separator), tree)
        if args.keepFiles:
            store.save_encoded(prepared, args.keepFiles)
    store.write_pattern_text(api.mine_encoded(prepared, args.support, args.gap, args.length, MODES[args.mode]), args.output)


def main() -> None:
    spark = SparkSession.builder.appName("arborseq").getOrCreate()
    ship(spark)
    with scratch():
        run(spark)


if __name__ == "__main__":
    main()
