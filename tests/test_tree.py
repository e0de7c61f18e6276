import random
from collections import Counter

import pytest

from arborseq.operators.tree import full_hierarchy, hierarchy_text, holding_rows


def brute(up):
    paths, below = {}, Counter()
    for x in up:
        p, at = [x], x
        while at in up and up[at] is not None:
            at = up[at]
            if at in p:
                p = None
                break
            p.append(at)
        paths[x] = p
        below.update((p or [])[1:])
    return {
        (x, "", -1, "", -1) if p is None else (x, p[-1], len(p) - 1, ">".join(p[::-1]), below[x]) for x, p in paths.items()
    }


def run(spark, up, **how):
    df = spark.createDataFrame(list(up.items()), "item string, parent string")
    got = {tuple(r) for r in hierarchy_text(df, **how).select("item", "root", "depth", "full_path", "n_descendants").collect()}
    lists = {(r.item, (r.path or [""])[0], r.depth, ">".join(r.path), r.n_descendants) for r in full_hierarchy(df, **how).collect()}
    assert lists == got
    return got


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limit", [1000, 12])
def test_random_graphs(spark, seed, limit):
    rnd = random.Random(seed)
    up = {f"n{i}": None if rnd.random() < 0.05 else f"n{rnd.randrange(130)}" if rnd.random() < 0.15 else f"n{max(0, i - rnd.randint(1, 9))}" for i in range(100)}
    assert run(spark, up, one_task=limit, per_task=30) == brute(up)


def test_long_chain_and_global_loop(spark):
    up = {f"c{i}": f"c{i + 1}" for i in range(60)} | {f"l{i}": f"l{(i + 1) % 30}" for i in range(30)} | {"in": "l3"}
    assert run(spark, up, one_task=10) == brute(up)


def test_hot_parent(spark):
    up = {f"x{i}": "hot" for i in range(80)} | {f"y{i}": f"x{i}" for i in range(40)} | {"hot": "top", "top": None}
    assert run(spark, up, one_task=20, per_task=40) == brute(up)


def test_edges(spark):
    assert run(spark, {"a": "a"}) == {("a", "", -1, "", -1)}
    assert run(spark, {"a": None}) == {("a", "a", 0, "a", 0)}
    odd = {"a\x01": None, "a\x01\x02b": "a\x01", "\x01\x03": "a\x01\x02b", "": "\x01\x03", "c": "", "d": "\x01"}
    assert run(spark, odd) == brute(odd) == run(spark, odd, one_task=1, per_task=2)
    assert run(spark, {"a": "gone"}) == {("a", "gone", 1, "gone>a", 0)}
    assert full_hierarchy(spark.createDataFrame([], "item string, parent string")).count() == 0


def test_holding_rows(spark):
    rows = [("a", "p", 1), ("a", "q", 3), ("a", "q", 3), ("a", "r", 2), ("b", "x", None), ("b", None, 5), (None, "z", 9), ("c", "m", 4), ("c", "n", 4)]
    df = spark.createDataFrame([(*r, "other") for r in rows], "item string, parent string, line_no long, path string")
    assert {tuple(r) for r in holding_rows(df).collect()} == {("a", "q"), ("b", None), ("c", "n")}
