import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborseq.functions import arrays as A
from arborseq.operators import grow


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_to_pivot(spark):
    chains = F.array(*[F.array(*map(F.lit, c)) for c in ([9, 5, 1], [4], [8, 6])])
    for pivot, want in ((1, [1, 0, 0]), (4, [1, 4, 0]), (5, [5, 4, 0]), (6, [5, 4, 6]), (8, [5, 4, 8]), (9, [9, 4, 8])):
        assert one(spark, A.to_pivot(chains, F.lit(pivot))) == want
    assert one(spark, A.is_relevant(F.array(F.lit(9), F.lit(5)), F.lit(5)))


def test_blanks(spark):
    ids = F.array(*map(F.lit, [0, 0, 3, 0, 0, 4, 0, 5, 0]))
    trimmed = A.trim_blanks(ids)
    assert one(spark, trimmed) == [3, 0, 0, 4, 0, 5]
    packed = A.compress_blanks(trimmed)
    assert one(spark, packed) == [3, -2, 4, -1, 5]
    assert one(spark, A.expand_blanks(packed)) == [3, 0, 0, 4, 0, 5]
    assert one(spark, A.single_blanks(packed)) == [3, -1, -1, 4, -1, 5]
    assert one(spark, A.split_gaps(packed, 1)) == [[3], [4, -1, 5]]
    assert one(spark, A.trim_blanks(F.array(F.lit(0)))) == []


def mined(codes, at, weight, pivot, top, gap, longest):
    e = grow.Entries(at, codes, np.arange(top + 1), np.arange(top), gap)
    return sorted((tuple(p), n) for p, n in grow.mine_pivot(e, weight, pivot, top, 1, longest))


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("seed", range(12))
def test_rewriting_keeps_the_patterns_of_the_pivot(seed, apart):
    rnd = np.random.default_rng(seed)
    top, gap, longest = 8, int(rnd.integers(0, 3)), int(rnd.integers(2, 5))
    size = rnd.integers(2, 14, 6)
    at = np.append(0, np.cumsum(size))
    codes, weight = rnd.integers(0, top, at[-1]) * (rnd.random(at[-1]) < 0.6), rnd.integers(1, 4, 6)
    pivots, offsets, ids, weights = grow.rewrite(at, codes, weight, np.arange(top + 1), np.arange(top), gap, longest, apart)
    for pivot in range(1, top):
        own = np.flatnonzero(pivots == pivot)
        lists = pa.array([ids[offsets[k] : offsets[k + 1]].tolist() for k in own], pa.list_(pa.int64()))
        small_at, small = grow.positions(lists)
        assert len(small) <= len(codes)
        want = mined(np.where(codes <= pivot, codes, 0), at, weight, pivot, top, gap, longest)
        assert mined(small, small_at, weights[own], pivot, top, gap, longest) == want


def test_unreachable_ids_are_blanks():
    """With 3 ids a pattern and no gap, 1 hop from the pivot 5 reaches its neighbours, 2 hops the next; 4 hops away is too far."""
    codes = np.array([1, 2, 3, 4, 5, 4, 3, 2, 1])
    _, offsets, ids, _ = grow.rewrite(np.array([0, 9]), codes, np.ones(1, np.int64), np.arange(7), np.arange(6), 0, 3)
    assert ids[offsets[-2] :].tolist() == [3, 4, 5, 4, 3]


def test_parts_that_share_nothing_are_apart():
    one = np.arange(8)
    codes = np.array([1, 5, 0, 2, 5, 0, 1, 5, 0, 3, 5, 4])
    _, offsets, ids, weight = grow.rewrite(np.array([0, 12]), codes, np.array([3]), np.arange(9), one, 0, 3, True)
    own = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert [x for x in own if 5 in x] == [[1, 5], [2, 5], [3, 5, 4]] and set(weight) == {3}
    chain_at, chain = np.array([0, 0, 1, 3, 4, 5, 6, 7]), np.array([1, 2, 1, 3, 4, 5, 6])  # 1 is above 2: [1, 5] and [2, 5] share a pattern
    _, offsets, ids, _ = grow.rewrite(np.array([0, 12]), codes, np.array([3]), chain_at, chain, 0, 3, True)
    assert [x for x in (ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])) if 5 in x] == [[1, 5, -1, 2, 5], [3, 5, 4]]
