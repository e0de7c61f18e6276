"""Growth of generalized patterns over a batch of encoded sequences, on flat arrays.

Entries are (row, position, id) with an entry for the item at the position and for each of its frequent ancestors, sorted;
the extensions of an embedding that ends at a position are the entries of the next ``gap + 1`` positions, one slice of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from arborseq.functions.sets import distinct, summed

#: Rows of one step's arrays.
STEP = 2_000_000


def positions(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids by position) of lists with runs of n blanks as -n; blanks are 0."""
    runs, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(lists.offsets).astype(np.int64)
    many = np.where(runs < 0, -runs, 1)
    return np.append(0, np.cumsum(many))[at - at[0]], np.repeat(np.where(runs < 0, 0, runs), many)


def own_tables(ids: np.ndarray, chains: pa.ListArray, *more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids by number, numbers for ids, chain_at, chain): numbers from 1 in the order of the ids, for those that come with their chains only; ids under 1 stay."""
    flat = chains.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    names = np.unique(np.concatenate([[0], ids[ids > 0], flat, more])).astype(np.int64)
    size = np.diff(np.asarray(chains.offsets)).astype(np.int64)
    number = np.where(ids > 0, np.searchsorted(names, ids), ids)
    first = np.unique(number, return_index=True)
    starts = np.cumsum(size) - size
    many = np.zeros(len(names) + 1, np.int64)
    own, at = first[0][first[0] > 0], first[1][first[0] > 0]
    many[own] = size[at]
    take = np.repeat(starts[at], size[at]) + np.arange(size[at].sum()) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
    return names, number, np.append(0, np.cumsum(many)), np.searchsorted(names, flat[take])


class Entries:
    """codes: ids by position, 0 for blanks; at: offsets of the rows. chain_at, chain: the ids that each id stands for (itself, its ancestors).

    owner: a pivot of each row, whose lesser ids and own count only.
    """

    def __init__(self, at: np.ndarray, codes: np.ndarray, chain_at: np.ndarray, chain: np.ndarray, gap: int, owner: np.ndarray | None = None):
        n = len(at) - 1
        self.gap = gap
        size = np.diff(at)
        self.wide = int(size.max(initial=0)) + 2 * gap + 4
        row = np.repeat(np.arange(n), size)
        pos = np.arange(len(codes)) - at[row] + gap + 1
        many = np.where(codes > 0, chain_at[codes + 1] - chain_at[codes], 0)
        self.row, self.pos = np.repeat(row, many), np.repeat(pos, many)
        self.id = chain[np.repeat(chain_at[codes], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        self.key = self.row * self.wide + self.pos
        self.owner = owner
        if owner is not None:
            self.only(self.id <= owner[self.row])

    def only(self, keep: np.ndarray) -> None:
        self.row, self.pos, self.id, self.key = self.row[keep], self.pos[keep], self.id[keep], self.key[keep]

    def near(self, row: np.ndarray, pos: np.ndarray, left: bool = False):
        """(index of the embedding, index of the entry) within the gap to the right (left) of pos, in steps."""
        base = row * self.wide + pos
        if left:
            lo, hi = np.searchsorted(self.key, base - self.gap - 1), np.searchsorted(self.key, base)
        else:
            lo, hi = np.searchsorted(self.key, base + 1), np.searchsorted(self.key, base + self.gap + 2)
        many = hi - lo
        total = np.cumsum(many)
        s = 0
        while s < len(row):
            done = total[s - 1] if s else 0
            e = max(s + 1, int(np.searchsorted(total, done + STEP, "right")))
            m = many[s:e]
            which = np.repeat(np.arange(s, e), m)
            yield which, lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
            s = e


def _reached(pair: np.ndarray, pos: np.ndarray, start: np.ndarray, gap: int, hops: int) -> np.ndarray:
    """Of entries sorted by (pair, pos) those that are reached from a start in so many hops of gap + 1 positions at most, to the right or to the left."""
    key = pair * (int(pos.max(initial=0)) + gap + 2) + pos
    far = np.iinfo(np.int64).min // 2

    def rightwards(key: np.ndarray, reached: np.ndarray) -> np.ndarray:
        for _ in range(hops):
            last = np.maximum.accumulate(np.where(reached, key, far))  # the nearest reached entry up to each
            more = reached | (key - np.append(far, last[:-1]) <= gap + 1)
            if (more == reached).all():
                break
            reached = more
        return reached

    return rightwards(key, start) | rightwards(-key[::-1], start[::-1])[::-1]


def _components(part: np.ndarray, pos: np.ndarray, ids: np.ndarray, is_pivot: np.ndarray, pair: np.ndarray, chain_at: np.ndarray, chain: np.ndarray, gap: int) -> np.ndarray:
    """Of each part the first part of its pair that it hangs together with: parts that share an id, or an ancestor of one, next to a pivot may share a pattern."""
    wide = int(pos.max()) + gap + 3
    key = part * wide + pos
    pivots = np.concatenate([[-wide], key[is_pivot], [key[-1] + wide]])
    close = np.minimum(pivots[np.searchsorted(pivots, key, "right")] - key, key - pivots[np.searchsorted(pivots, key, "left") - 1]) <= gap + 1
    own, at = ids[close], part[close]
    many = chain_at[own + 1] - chain_at[own]
    up = chain[np.repeat(chain_at[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    group, at = np.repeat(pair[close], many) * len(chain_at) + up, np.repeat(at, many)
    order = np.argsort(group, kind="stable")
    group, at = group[order], at[order]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    label = np.arange(int(part[-1]) + 1)
    while len(starts):
        least = np.repeat(np.minimum.reduceat(label[at], starts), np.diff(np.append(starts, len(at))))
        new = label.copy()
        np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _once(comp: np.ndarray, part: np.ndarray, ids: np.ndarray, skipped: np.ndarray) -> np.ndarray:
    """Whether an entry's part has no equal one before it in its component."""
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ends, own = np.append(first[1:], len(part)), comp[first]
    several = np.bincount(own)[own] > 1
    keep, seen = np.ones(len(first), bool), set()
    for k in np.flatnonzero(several).tolist():
        lo, hi = first[k], ends[k]
        what = (int(own[k]), ids[lo:hi].tobytes(), skipped[lo + 1 : hi].tobytes())
        keep[k] = what not in seen
        seen.add(what)
    return np.repeat(keep, ends - first)


def rewrite(at: np.ndarray, codes: np.ndarray, weight: np.ndarray, chain_at: np.ndarray, chain: np.ndarray, gap: int, longest: int, apart: bool = False):
    """(pivots, offsets, ids, weights): each row as each of its frequent ids, the pivot, needs it.

    Every position has the first id of its chain that is at most the pivot, else a blank. Ids that cannot be reached from a pivot
    in under ``longest`` hops to one side, each over ``gap`` positions at most and onto an id, are blanks too; parts between runs of more than ``gap`` blanks are kept if they hold the pivot and two ids at least,
    and are joined by the run -(gap + 1); other runs of n blanks are -n. apart: parts that cannot share a pattern with the others are records of
    their own, and of equal parts of a record one is kept.
    """
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    many = np.where(codes > 0, chain_at[codes + 1] - chain_at[codes], 0)
    ids = chain[np.repeat(chain_at[codes], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    top = len(chain_at)
    r, pivot = np.divmod(distinct(np.repeat(row, many) * top + ids), top)
    m = size[r]
    pair = np.repeat(np.arange(len(r)), m)
    pos = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
    code = codes[at[r[pair]] + pos]
    now, end = chain_at[code], np.where(code > 0, chain_at[code + 1], chain_at[code])
    own = pivot[pair]
    while True:
        high = (now < end) & (chain[np.minimum(now, len(chain) - 1)] > own)
        if not high.any():
            break
        now = now + high
    live = now < end
    pair, pos, own, ids = pair[live], pos[live], own[live], chain[now[live]]
    is_pivot = ids == own
    near = _reached(pair, pos, is_pivot, gap, longest - 1)
    pair, pos, ids, is_pivot = pair[near], pos[near], ids[near], is_pivot[near]
    if not len(pair):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), ids, weight[:0]
    skipped = np.append(0, pos[1:] - pos[:-1] - 1)
    new_pair = np.append(True, pair[1:] != pair[:-1])
    part = np.cumsum(new_pair | (skipped > gap)) - 1
    good = (np.bincount(part) >= 2) & (np.bincount(part, weights=is_pivot) > 0)
    keep = good[part]
    pair, pos, ids, skipped, part, is_pivot = pair[keep], pos[keep], ids[keep], skipped[keep], part[keep], is_pivot[keep]
    if not len(pair):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), ids, weight[:0]
    part = np.cumsum(np.append(True, part[1:] != part[:-1])) - 1
    record = pair
    if apart:
        comp = _components(part, pos, ids, is_pivot, pair, chain_at, chain, gap)[part]
        keep = _once(comp, part, ids, skipped)
        order = np.flatnonzero(keep)[np.argsort(comp[keep], kind="stable")]
        pair, ids, skipped, part, record = pair[order], ids[order], skipped[order], part[order], comp[order]
    new_record = np.append(True, record[1:] != record[:-1])
    new_part = np.append(True, part[1:] != part[:-1])
    run = np.where(new_record, 0, np.where(new_part, gap + 1, skipped))
    width = 1 + (run > 0)
    out = np.zeros(int(width.sum()), np.int64)
    place = np.cumsum(width) - 1
    out[place] = ids
    out[place[run > 0] - 1] = -run[run > 0]
    which = pair[new_record]
    offsets = np.append((np.cumsum(width) - width)[new_record], len(out))
    return pivot[which], offsets, out, weight[r[which]]


def unique(parts: list[np.ndarray]) -> np.ndarray:
    return distinct(np.concatenate([*parts, np.zeros(0, np.int64)]))


def supports(code: np.ndarray, row: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, weights of the distinct rows that have each)."""
    n = len(weight)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if int(code.max()) < (1 << 62) // n:
        code, row = np.divmod(unique([code * n + row]), n)
    else:
        order = np.lexsort((row, code))
        code, row = code[order], row[order]
        new = np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))
        code, row = code[new], row[new]
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[at], np.add.reduceat(weight[row], at)


def place(code: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether it is in the sorted known, where)."""
    at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
    return (known[at] == code if len(known) else np.zeros(len(code), bool)), at


def count_level(e: Entries, weight: np.ndarray, levels: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, supports) of the patterns one longer than the last level; code: index of the prefix in its level * size + id.

    levels[k]: sorted codes of the frequent patterns of length k + 1. An embedding is a (row, prefix, end), each once.
    """
    row, pid, end = e.row, e.id, e.pos
    ok, pid = place(pid if e.owner is None else e.owner[row] * size + pid, levels[0])
    row, pid, end = row[ok], pid[ok], end[ok]
    for known in levels[1:]:
        keys = []
        for which, entry in e.near(row, end):
            ok, new = place(pid[which] * size + e.id[entry], known)
            keys.append(unique([(row[which[ok]] * len(known) + new[ok]) * e.wide + e.pos[entry[ok]]]))
        key, end = np.divmod(keys[0] if len(keys) == 1 else unique(keys), e.wide)
        row, pid = np.divmod(key, max(1, len(known)))
    pairs = [(pid[which] * size + e.id[entry], row[which]) for which, entry in e.near(row, end)]
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return supports(*(np.concatenate(x) for x in zip(*pairs)), weight)


def count_owned(e: Entries, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner * size + id, supports) of the ids in the rows of each owner."""
    return supports(e.owner[e.row] * size + e.id, e.row, weight)


def _distinct_rows(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (a, b, c), sorted."""
    if not len(a):
        return a, b, c
    nb, nc = int(b.max()) + 1, int(c.max()) + 1
    if (int(a.max()) + 1) * nb * nc < 1 << 62:
        rest, c = np.divmod(distinct((a * nb + b) * nc + c), nc)
        return (*np.divmod(rest, nb), c)
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))
    return a[new], b[new], c[new]


def mine_pivot(e: Entries, weight: np.ndarray, pivot: int, size: int, least: int, longest: int) -> list[tuple[list[int], int]]:
    """The frequent patterns whose greatest id is the pivot, from all rewritten sequences of the pivot.

    Each grows from its last occurrence of the pivot: to the right by smaller ids first, then to the left by ids up to the
    pivot; so each pattern comes up once, and extensions of an infrequent pattern never do.
    """
    e.only(e.id <= pivot)
    start = e.id == pivot
    found: list[tuple[list[int], int]] = []
    # state: row, number of the pattern, left end, right end
    state = (e.row[start], np.zeros(int(start.sum()), np.int64), e.pos[start], e.pos[start])
    patterns: list[list[int]] = [[pivot]]
    wide = e.wide

    def grow(state, patterns, left, ref=None, index=None):
        """The state one longer and its patterns' codes. index: left extensions that are frequent without the last item to the right, as ref * size + id."""
        row, pid, lo, hi = state
        keys = []
        for which, entry in e.near(row, lo if left else hi, left):
            if not left:
                small = e.id[entry] < pivot
                which, entry = which[small], entry[small]
            elif index is not None:
                known, _ = place(ref[pid[which]] * size + e.id[entry], index)
                which, entry = which[known], entry[known]
            code = pid[which] * size + e.id[entry]
            ends = (e.pos[entry] * wide + hi[which]) if left else (lo[which] * wide + e.pos[entry])
            keys.append((code, row[which], ends))
        if not keys:
            return None
        code, r, ends = _distinct_rows(*(np.concatenate(x) for x in zip(*keys)))
        once = np.append(True, (code[1:] != code[:-1]) | (r[1:] != r[:-1])) if len(code) else np.zeros(0, bool)
        own, support = summed(code[once], weight[r[once]])
        good = support >= least
        own, support = own[good], support[good]
        if not len(own):
            return None
        ok, new = place(code, own)
        nxt = [
            ([int(c % size), *patterns[c // size]] if left else [*patterns[c // size], int(c % size)]) for c in own.tolist()
        ]
        found.extend(zip(nxt, support.tolist()))
        lo2, hi2 = np.divmod(ends[ok], wide)
        return (r[ok], new[ok], lo2, hi2), nxt, own

    ref, before = None, None  # of each pattern of this width to the right its number without the last item; left levels of that width
    for right in range(longest):
        side, names, to, levels = state, patterns, ref, []
        for left in range(longest - 1 - right):
            index = None if before is None else before[left] if left < len(before) else np.zeros(0, np.int64)
            got = grow(side, names, True, to, index)
            if got is None:
                break
            side, names, own = got
            levels.append(own)
            if index is not None:
                to = place(to[own // size] * size + own % size, index)[1]
        before = levels
        if right + 2 > longest or (got := grow(state, patterns, False)) is None:
            break
        state, patterns, own = got
        ref = own // size
    return found


def batches_of(codes: np.ndarray, supports: np.ndarray, schema: pa.Schema, rows: int = 50_000):
    for k in range(0, len(codes), rows):
        yield pa.RecordBatch.from_arrays([pa.array(codes[k : k + rows]), pa.array(supports[k : k + rows])], schema=schema)
