import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

from arborseq.common import limits
from arborseq.functions import lookup
from arborseq.operators import mining
from arborseq.operators.dictionary import decode, dictionary, encode_rows, flist, frequent_items, redundant_ancestors
from arborseq.operators.hierarchy import HierarchyError, Taxonomy, closure
from arborseq.plans import api

SEQUENCES = [
    "Cannon_EOS_70D The_Digital_Photography SanDisk_Extreme_32GB Dolica_GX600B200",
    "Nikon_D5300 On_Photography Ravelli_APGL5",
    "Canon_SX410 The_Art_of_Photography Kingston_8_GB_microSDHC",
]
TREE = {
    "Cannon_EOS_70D": "DSLR_Camera", "Nikon_D5300": "DSLR_Camera", "Canon_SX410": "PointShoot_Camera", "DSLR_Camera": "Camera", "PointShoot_Camera": "Camera",
    "Dolica_GX600B200": "Tripod", "Ravelli_APGL5": "Tripod", "The_Digital_Photography": "Photography_Book", "On_Photography": "Photography_Book",
    "The_Art_of_Photography": "Photography_Book", "SanDisk_Extreme_32GB": "Flash", "Kingston_8_GB_microSDHC": "Flash",
}
GOLDEN = {
    "Camera Photography_Book": 3, "Camera Photography_Book Tripod": 2, "Camera Photography_Book Flash": 2, "Camera Flash": 2, "DSLR_Camera Photography_Book": 2,
    "DSLR_Camera Photography_Book Tripod": 2, "Photography_Book Tripod": 2, "Photography_Book Flash": 2,
}
ALL = sorted(mining.STRATEGIES)


def brute(seqs, up, least, gap, longest):
    """seqs: (items, weight)."""
    def chain(x):
        out = []
        while x is not None:
            out.append(x)
            x = up.get(x)
        return out

    cf, df = {}, {}
    for items, w in seqs:
        seen = set()
        for x in items:
            for a in chain(x) if x is not None else ():
                cf[a] = cf.get(a, 0) + w
                seen.add(a)
        for a in seen:
            df[a] = df.get(a, 0) + w
    red = {p for c, p in up.items() if c in cf and cf[c] == cf[p]}
    ok = {a for a in df if df[a] >= least} - red
    total = {}
    for items, w in seqs:
        lists = [[a for a in chain(x) if a in ok] if x is not None else [] for x in items]
        found, state = set(), {((a,), i) for i, c in enumerate(lists) for a in c}
        for _ in range(longest - 1):
            state = {((*p, a), j) for p, i in state for j in range(i + 1, min(len(lists), i + gap + 2)) for a in lists[j]}
            found |= {p for p, _ in state}
        for p in found:
            total[p] = total.get(p, 0) + w
    return {" ".join(p): n for p, n in total.items() if n >= least}


def tables(spark, seqs, up):
    s = spark.createDataFrame([(i, items, w) for i, (items, w) in enumerate(seqs)], "seq_id long, items array<string>, weight long")
    return s, spark.createDataFrame(list(up.items()), "item string, parent string")


def as_dict(df):
    rows = api.pattern_text(df).collect()
    assert len({r.pattern for r in rows}) == len(rows)
    return {r.pattern: r.frequency for r in rows}


@pytest.fixture(scope="module")
def example(spark):
    return api.encode(*tables(spark, [(s.split(), 1) for s in SEQUENCES], TREE))


@pytest.mark.parametrize("strategy", ALL)
def test_worked_example(example, strategy):
    assert as_dict(api.mine_encoded(example, 2, 1, 3, strategy)) == GOLDEN


@pytest.mark.parametrize("least, gap, length, n", [(2, 0, 2, 3), (2, 0, 5, 4), (2, 2, 3, 10), (3, 1, 3, 1), (1, 0, 2, 28), (1, 1, 3, 107), (2, 2, 4, 10), (1, 0, 1, 0)])
def test_pattern_counts(example, least, gap, length, n):
    assert api.mine_encoded(example, least, gap, length).count() == n


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("strategy", ALL)
def test_random(spark, seed, strategy):
    rnd = random.Random(seed)
    items = [f"i{k}" for k in range(12)]
    up = {f"i{k}": f"i{rnd.randrange(k)}" for k in range(1, 12) if rnd.random() < 0.7}
    seqs = [([rnd.choice([*items, None]) for _ in range(rnd.randint(0, 7))], rnd.randint(1, 2)) for _ in range(14)]
    least, gap, length = rnd.randint(2, 3), rnd.randint(0, 2), rnd.randint(3, 4)
    assert as_dict(api.mine(*tables(spark, seqs, up), least, gap, length, strategy)) == brute(seqs, up, least, gap, length)


@pytest.mark.parametrize("strategy", ALL)
def test_without_small_tables(spark, strategy):
    """The ways for dictionaries, hierarchies and levels that are too large for the driver give the same."""
    with limits(rows=0, hierarchy=0):
        assert as_dict(api.mine(*tables(spark, [(s.split(), 1) for s in SEQUENCES], TREE), 2, 1, 3, strategy)) == GOLDEN


@pytest.mark.parametrize("seed", range(1))
def test_partitions_of_all_kinds(spark, seed):
    rnd = random.Random(20 + seed)
    up = {f"i{k}": f"i{rnd.randrange(k)}" for k in range(1, 15) if rnd.random() < 0.7}
    seqs = [([rnd.choice([*(f"i{k}" for k in range(15)), None, None]) for _ in range(rnd.randint(0, 12))], rnd.randint(1, 2)) for _ in range(20)]
    want = brute(seqs, up, 3, 1, 4)
    prepared = api.encode(*tables(spark, seqs, up))
    for values in ({}, {"group": 0}, {"group": 6}, {"group": 0, "patterns": 1}, {"rows": 0}, {"rows": 0, "group": 4}):
        with limits(**values):
            got = mining.Prepared(prepared.sequences, prepared.dictionary)
            assert as_dict(api.mine_encoded(got, 3, 1, 4, "partitioned")) == want, values


def test_held_limit(example):
    with limits(patterns=1):
        assert as_dict(api.decode(mining.levelwise(example, 2, 1, 3), example.dictionary)) == GOLDEN


def test_chains_of_many_ids(spark):
    """The driver holds a few bytes of each id, not Python objects."""
    ids = spark.range(1, 200_001).selectExpr(
        "concat('i', id) AS item", "1L AS cf", "if(id <= 3, 9L, 1L) AS df", "int(id) AS tid", "int(if(id <= 3, id - 1, id % 3 + 1)) AS parent_tid", "false AS redundant")
    prepared = mining.Prepared(spark.createDataFrame([([5, 7], 1)], "tids array<int>, weight bigint"), ids)
    tracemalloc.start()
    try:
        rows, chains = prepared.reduced(5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 << 20
    assert [r.codes for r in rows.collect()] == [[3, 2]]
    assert {r.tid: r.chain for r in chains.table.collect()} == {1: [1], 2: [2, 1], 3: [3, 2, 1]}


@pytest.mark.parametrize("rows", [0, 5, 1000])
def test_few_frequent_of_many_ids(spark, rows):
    """Lookups of all ids by joins, of the five frequent ones in the workers."""
    with limits(rows=rows, hierarchy=0):
        prepared = api.encode(*tables(spark, [(s.split(), 1) for s in SEQUENCES], TREE))
        chains = prepared.chains(2)
        assert (chains.here is not None, isinstance(chains.lift, DataFrame)) == (rows > 0, rows < 1000)
        assert as_dict(api.mine_encoded(prepared, 2, 1, 3)) == GOLDEN
        two = decode(mining.two_sequences(prepared, 2, 1), prepared.frequent(2))
        assert as_dict(two.select("pattern", "frequency")) == {p: n for p, n in GOLDEN.items() if p.count(" ") == 1}


def test_counts_by_edges(spark):
    """A closure beyond the limit is made in the driver again if its edges are not; nothing is exploded."""
    seqs = [("Nikon_D5300 other Nikon_D5300".split(), 2), (["other", None, "Camera"], 1), (["Ravelli_APGL5", "new"], 1), ([], 1), (None, 1)]
    s, h = tables(spark, seqs, TREE)
    with limits(rows=15, hierarchy=0):
        tax = Taxonomy(h)
        got = flist(s, tax.closure, edges=tax.edges)
        assert "Generate" not in got._jdf.queryExecution().toString()
        assert {r.item: (r.cf, r.df) for r in got.collect()} == {
            "Nikon_D5300": (4, 2), "DSLR_Camera": (4, 2), "Camera": (5, 3), "other": (3, 3), "Ravelli_APGL5": (1, 1), "Tripod": (1, 1), "new": (1, 1)}


@pytest.mark.parametrize("hashes", [None, lambda words: np.array([len(w or "") for w in words.to_pylist()], np.uint64)])
def test_hashed_lookup(monkeypatch, hashes):
    """Words with one hash are told apart too."""
    if hashes:
        monkeypatch.setattr(lookup, "_hashes", hashes)
    asked = pa.array(["b", None, "cc", "x", "a", "dd", "", "zzz"])
    assert lookup.HashedLookup(pa.array(["a", "b", "cc", "dd", "e"]))(asked).tolist() == [1, -1, 2, -1, 0, 3, -1, -1]
    assert lookup.HashedLookup(pa.array([], pa.string()))(asked).tolist() == [-1] * 8


def test_level_counters(example):
    got = [tuple(r) for r in mining.level_counters(example, 2, 1, 3).orderBy("length").collect()]
    assert {a: c for a, _, c in got} == Counter(len(p.split()) for p in GOLDEN) and all(b >= c for _, b, c in got)


@pytest.mark.parametrize("strategy", ALL)
def test_edges(spark, strategy):
    same = tables(spark, [(["a", "a"], 1), (["a", "a"], 1), (["x", "y"], 1), ([], 1), (None, 1)], {"x": "P", "y": "P"})
    assert as_dict(api.mine(*same, 1, 0, 3, strategy)) == {"a a": 2, "P P": 1, "P y": 1, "x P": 1, "x y": 1}
    chain = tables(spark, [(["c", "d"], 3)], {"c": "p", "p": "q"})
    assert as_dict(api.mine(*chain, 1, 0, 2, strategy)) == {"c d": 3}
    empty = tables(spark, [], {})
    assert as_dict(api.mine(*empty, 1, 0, 3, strategy)) == {}


def test_flat_and_weights(spark):
    s = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"]), (2, ["a", "z", "b"])], "seq_id long, items array<string>")
    assert as_dict(api.mine(s, None, 2, 0, 5)) == {"a b": 2}
    assert as_dict(api.mine(s, None, 3, 1, 5)) == {"a b": 3}


def test_bad_input(spark):
    s, _ = tables(spark, [(["a"], 1)], {})
    with pytest.raises(HierarchyError):
        api.mine(s, spark.createDataFrame([("a", "b"), ("a", "c")], "item string, parent string"), 1)
    with pytest.raises(HierarchyError):
        api.mine(s, spark.createDataFrame([("a", "b"), ("b", "a")], "item string, parent string"), 1)
    with pytest.raises(HierarchyError):
        closure(spark.createDataFrame([("a", "b"), ("b", "a")], "item string, parent string"))
    with pytest.raises(ValueError):
        api.mine(s, None, 1, strategy="other")


def test_dictionary(spark, example):
    s, h = tables(spark, [(x.split(), 1) for x in SEQUENCES], TREE)
    tax = Taxonomy(h)
    c = flist(s, tax.closure)
    assert {r.item: (r.cf, r.df) for r in frequent_items(c, 2).collect()} == {
        "Camera": (3, 3), "Photography_Book": (3, 3), "DSLR_Camera": (2, 2), "Flash": (2, 2), "Tripod": (2, 2)}
    assert [r.item for r in redundant_ancestors(c, tax.edges).collect()] == ["PointShoot_Camera"]
    d = {r.item: r for r in dictionary(c, tax.edges, closure(h)).collect()}
    assert d == {r.item: r for r in example.dictionary.collect()}
    assert d["Canon_SX410"].parent_tid == d["Camera"].tid == 1
    assert all(r.parent_tid < r.tid for r in d.values())
    rows = encode_rows(s, example.dictionary)
    back = decode(rows, example.dictionary, "tids").orderBy("seq_id").collect()
    assert [" ".join(r.pattern) for r in back] == SEQUENCES


def test_taxonomy(spark):
    tax = Taxonomy(spark.createDataFrame([("a", "m"), ("b", "m"), ("m", "r"), ("z", "q")], "item string, parent string"))
    assert {(r.item, r.root, r.depth) for r in tax.roots().collect()} == {("a", "r", 2), ("b", "r", 2), ("m", "r", 1), ("r", "r", 0), ("z", "q", 1), ("q", "q", 0)}
    assert tax.max_depth().first()[0] == 2
    pairs = spark.createDataFrame([("a", "b"), ("a", "m"), ("a", "z")], "a string, b string")
    assert {r.b: r.common for r in tax.common_parent(pairs).collect()} == {"b": "m", "m": "m", "z": None}
    asked = spark.createDataFrame([("r", "a"), ("a", "a"), ("a", "r")], "general string, item string")
    assert {(r.general, r.item): r.holds for r in tax.is_generalization_of(asked).collect()} == {("r", "a"): True, ("a", "a"): True, ("a", "r"): False}
    assert {(r.parent, r.child): r.holds for r in tax.is_parent(asked.toDF("parent", "child")).collect()} == {("r", "a"): True, ("a", "a"): False, ("a", "r"): False}
    items = spark.createDataFrame([("a",), ("r",), ("new",)], "item string")
    assert {r.item: r.has_parent for r in tax.has_parent(items).collect()} == {"a": True, "r": False, "new": False}
    assert {r.item: r.parent for r in tax.parent_of(items).collect()} == {"a": "m", "r": None, "new": None}
