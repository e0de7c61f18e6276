"""Column functions on sequences of item ids; 0 is a blank, a negative number -n a run of n blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ints(*values: Column) -> Column:
    return F.array(*values).cast("array<int>")


def to_pivot(chains: Column, pivot: Column) -> Column:
    """Each position's first id of its chain (item, parent, ... : descending ids) that is at most the pivot, else a blank."""
    return F.transform(chains, lambda c: F.coalesce(F.get(F.filter(c, lambda a: a <= pivot), F.lit(0)), F.lit(0)))


def is_relevant(chain: Column, pivot: Column) -> Column:
    """Whether an item or one of its ancestors is at most the pivot."""
    return F.exists(chain, lambda a: a <= pivot)


def trim_blanks(ids: Column) -> Column:
    """Without the blanks at both ends."""
    places = F.filter(F.transform(ids, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return F.when(F.size(places) == 0, _ints()).otherwise(F.slice(ids, F.array_min(places) + 1, F.array_max(places) - F.array_min(places) + 1))


def compress_blanks(ids: Column) -> Column:
    """Each run of n blanks as -n."""
    def step(acc: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(1))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), _ints(last - 1))
        return F.when(x != 0, F.concat(acc, _ints(x))).when(last < 0, longer).otherwise(F.concat(acc, _ints(F.lit(-1))))

    return F.aggregate(ids, _ints(), step)


def expand_blanks(ids: Column) -> Column:
    """The reverse of compress_blanks."""
    return F.flatten(F.transform(ids, lambda x: F.when(x < 0, F.array_repeat(F.lit(0), -x)).otherwise(_ints(x))))


def single_blanks(ids: Column) -> Column:
    """Each run -n as n times -1 (the form without compression)."""
    return F.transform(expand_blanks(ids), lambda x: F.when(x == 0, -1).otherwise(x))


def split_gaps(ids: Column, gap: int) -> Column:
    """The parts of compressed ids between runs of more than ``gap`` blanks, which no pattern can cross."""
    empty = F.array(_ints())

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        return F.when(x < -gap, F.concat(acc, empty)).otherwise(F.concat(head, F.array(F.concat(last, _ints(x)))))

    return F.aggregate(ids, empty, step)
