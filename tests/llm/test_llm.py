import random
from collections import Counter

import numpy as np
import pytest
import regex

from arborseq.llm import baskets as B
from arborseq.llm import heavy, leaks, pairs, patterns, spans, terms, tokens
from arborseq.llm.exchange import in_several

SEQ = "seq_id long, items array<string>"


# ---- frequent subsequences


def subsequences(rows, least, gap, longest):
    total = {}
    for seq, items in {(s, tuple(i) if i else ()) for s, i in rows if s is not None}:
        state, found = {((x,), i) for i, x in enumerate(items) if x is not None}, set()
        for _ in range(longest - 1):
            state = {
                ((*p, items[j]), j) for p, i in state for j in range(i + 1, len(items) if gap is None else min(len(items), i + gap + 2)) if items[j] is not None
            }
            found |= {p for p, _ in state}
        for p in found:
            total.setdefault(p, set()).add(seq)
    return {p: len(s) for p, s in total.items() if len(s) >= least}


def sequences(seed, n=60):
    rnd = random.Random(seed)
    rows = [(k, [rnd.choice(["a", "b", "c", "é", None, "rare%d" % rnd.randrange(99)]) for _ in range(rnd.randrange(9))]) for k in range(n)]
    return rows + rows[:10] + [(3, ["a", "c", "a"]), (n, None), (n + 1, []), (None, ["a", "b"])]


@pytest.mark.parametrize("gap, longest", [(2, 4), (0, 3), (None, 3)])
def test_subsequences(spark, gap, longest, monkeypatch):
    rows = sequences(1)
    df = spark.createDataFrame([(s, i, 1) for s, i in rows], SEQ + ", code long").repartition(3)
    want = subsequences(rows, 6, gap, longest)
    # held = 1: all levels are joined; 5: the first only held in part
    for held, kept, lookup in ((patterns.HELD, 2, B.LOOKUP), (patterns.HELD, 0, B.LOOKUP), (1, 2, 0), (5, 2, B.LOOKUP), (40, 0, 0)):
        monkeypatch.setattr(patterns, "KEPT", kept)
        monkeypatch.setattr(B, "LOOKUP", lookup)
        got = patterns.frequent_subsequences(df, max_gap=gap, max_length=longest, min_support=6, held=held).collect()
        assert {tuple(r.pattern): r.frequency for r in got} == want and len(got) == len(want)


def test_relative_support_and_edges(spark):
    df = spark.createDataFrame([(k, ["x", "y"] if k < 3 else []) for k in range(300)], SEQ)
    assert [tuple(r) for r in patterns.frequent_subsequences(df, per_n=100).collect()] == [(["x", "y"], 3)]
    assert patterns.frequent_subsequences(df, per_n=99).count() == 0
    assert patterns.frequent_subsequences(df.limit(0)).count() == 0
    assert patterns.frequent_subsequences(df, max_length=1).count() == 0
    long = spark.createDataFrame([(1, ["p", "q", None] * 20_000), (2, ["p", None, None, None, "q"])], SEQ)
    got = {tuple(r.pattern): r.frequency for r in patterns.frequent_subsequences(long, max_length=2, min_support=1).collect()}
    assert got == {("p", "q"): 1, ("q", "p"): 1, ("p", "p"): 1, ("q", "q"): 1}


# ---- items together


def together(rows, least):
    sets = {}
    for s, items in rows:
        if s is not None:
            sets.setdefault(s, set()).update(x for x in items or [] if x is not None)
    one, two = Counter(), Counter()
    for own in sets.values():
        one.update(own)
        two.update((a, b) for a in own for b in own if a < b)
    return {(a, b, n, one[a], one[b], len(sets)) for (a, b), n in two.items() if n >= least}


def test_pairs(spark, monkeypatch):
    rows = sequences(2) + [(5, ["only", "here"]), (6, ["only", "here", "here"])]
    df = spark.createDataFrame(rows, SEQ).repartition(3)
    want = together(rows, 2)
    for run in (pairs.RUN, 50):
        monkeypatch.setattr(pairs, "RUN", run)
        got = pairs.items_together(df, 2, None)
        assert {tuple(r)[:6] for r in got.collect()} == want
    r = got.where("item_a = 'here'").first()
    assert abs(r.lift - r.n_ab * r.n / (r.n_a * r.n_b)) < 1e-9
    assert abs(r.odds_ratio - (r.n_ab + 0.5) * (r.n - r.n_a - r.n_b + r.n_ab + 0.5) / ((r.n_a - r.n_ab + 0.5) * (r.n_b - r.n_ab + 0.5))) < 1e-9
    assert {(r.item_a, r.item_b) for r in pairs.at_least_times_chance(got, 3).collect()} == {(a, b) for a, b, ab, x, y, n in want if ab * n >= 3 * x * y}
    monkeypatch.setattr(B, "LOOKUP", 0)
    assert {tuple(r)[:6] for r in pairs.items_together(df, 2, None).collect()} == want
    assert pairs.items_together(df.limit(0)).count() == 0


# ---- terms


def test_terms(spark):
    rows = [(1, 0, "a"), (1, 0, "a"), (1, 1, "a"), (2, 0, "a"), (2, 1, "b"), (3, 0, None), (4, 100, "a"), (None, 3, "b")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "seq_id long, pos int, item string, n_rows long")
    got = {tuple(r) for r in terms.event_terms(df, common_per=2, rare_below=3).collect()}
    assert got == {("a", 4, 3, "common"), ("b", 2, 1, "rare")}
    assert {tuple(r) for r in terms.event_terms(df, common_per=1, rare_below=1).collect()} == {("a", 4, 3, "ok"), ("b", 2, 1, "ok")}
    lines = spark.createDataFrame([("x", "p", 1), ("x", "p", 1), ("x", "p", 2), (None, "p", 3), ("y", None, 4), ("z", "q", 5)], "item string, parent string, line_no long")
    assert {tuple(r) for r in terms.line_terms(lines, common_per=3, rare_below=2).collect()} == {("p", 3, 1, "common"), ("q", 1, 1, "common")}
    rnd = random.Random(7)
    rows = [(rnd.choice(["x", "y", "z", None]), rnd.choice(["p", "q", None]), rnd.choice([None, *range(9)])) for _ in range(60)]
    got = {(r.term, r.n_rows, r.n_records) for r in terms.line_terms(spark.createDataFrame(rows, "item string, parent string, line_no long").repartition(3)).collect()}
    assert got == {(t, len({n for _, p, n in rows if p == t} - {None}), len({i for i, p, _ in rows if p == t} - {None})) for t in ("p", "q")}
    assert terms.event_terms(df.limit(0)).count() == 0 and terms.line_terms(lines.limit(0)).count() == 0


# ---- heavy items


@pytest.mark.parametrize("counters", [10_000, 4])
def test_heavy(spark, counters, monkeypatch):
    monkeypatch.setattr(heavy, "CHUNK", 100)
    rnd = random.Random(3)
    rows = [(k, k % 90, rnd.choice(["h1", "h2", None, f"x{rnd.randrange(500)}", f"x{rnd.randrange(500)}"])) for k in range(3000)]
    rows += rnd.sample(rows, 700)
    df = spark.createDataFrame(rows, "seq_id long, pos int, item string").repartition(20)
    events = Counter(i for _, _, i in {(s, p, i) for s, p, i in rows} if i is not None)
    delivered = Counter(i for _, _, i in rows if i is not None)
    total = sum(events.values())
    got = {r.item: r for r in heavy.heavy_events(df, per=20, counters=counters).collect()}
    assert {i: r.n_events for i, r in got.items()} == {i: n for i, n in events.items() if n * 20 >= total}
    assert all(r.bound - r.error <= delivered[i] <= r.bound for i, r in got.items())
    s = heavy.summaries(df.where("item is not null"), 50).toPandas()
    assert len(s) == 50
    for r in s.itertuples():
        assert r.bound - r.error <= delivered[r.item] <= r.bound
    assert all(n <= s.floor[0] for i, n in delivered.items() if i not in set(s.item))
    assert heavy.heavy_events(df.limit(0)).count() == 0


@pytest.mark.parametrize("counters", [10_000, 64])
def test_heavy_with_other_items_at_one_position(spark, counters):
    """1000 positions with two rare items each: 60 of 2060 events are no twentieth, of 1060 they would be."""
    rows = [(k, 0, "h") for k in range(60)] + [(k, 1, f"x{k}{side}") for k in range(1000) for side in "ab"]
    df = spark.createDataFrame(rows, "seq_id long, pos int, item string").repartition(4)
    assert heavy.heavy_events(df, per=20, counters=counters).count() == 0
    assert [(r.item, r.n_events) for r in heavy.heavy_events(df, per=35, counters=counters).collect()] == [("h", 60)]


# ---- token ids


@pytest.fixture(scope="module")
def reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_token_ids(spark, reference_ids):
    rnd = random.Random(4)
    texts = ["", None, " ", "  \n\t x", "<|endoftext|> don't DON'T 12345", "aaaaaaaaaaaaaaa", "日本語 ½ 👩‍👩‍👧 é é", "\x1c\x1f \u0085 x", "a" * 20_000]
    texts += ["".join(rnd.choice("aeth  \n.,1é日") for _ in range(rnd.randrange(200))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.token_ids(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == reference_ids(t or ""), t
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_long_words(reference_ids):
    m = tokens.load(tokens.default_ranks())
    word = "".join(np.random.default_rng(1).choice(list("abcdeorst"), 6_000))
    assert m.encode([word.encode()])[0].tolist() == reference_ids(word)
    rnd = random.Random(5)
    for letters in ("a", "ab", "aeth", "abcdeorst", "日本a"):
        for n in (1, 2, 3, 7, 30, 500):
            w = "".join(rnd.choice(letters) for _ in range(n)).encode()
            assert m._linked(w).tolist() == m.encode([w])[0].tolist()
    assert m._linked(b"a" * 300_000).tolist() == reference_ids("a" * 300_000)


# ---- leaked passages


def test_leaks(spark):
    rnd = random.Random(5)
    words = ["basket", "item", "straße", "x1", "tray", "of", "the", "vase", "İstanbul", "née"]
    questions = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(8, 20)))) for k in range(30)] + [(90, "too short"), (91, None)]
    texts = [None, "", "a"]
    for _ in range(60):
        q = questions[rnd.randrange(30)][1].split()
        n = rnd.randrange(7, 14)
        part = q[rnd.randrange(3) :][:n]
        texts.append(" ".join(rnd.choice(words) for _ in range(20)) + "! " + "_,  ".join(w.upper() if rnd.random() < 0.3 else w for w in part) + "; " + " ".join(rnd.choice(words) for _ in range(9)))
    split = regex.compile(r"[\p{L}\p{N}]+")
    grams = lambda t: {tuple(w[i : i + 10]) for w in [split.findall((t or "").lower())] for i in range(len(w) - 9)}
    want = {(i, k) for i, t in enumerate(texts) for k, q in questions if grams(t) & grams(q)}
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    qs = spark.createDataFrame(questions, "item_id long, text string")
    for kw in ({}, {"edits": 0}, {"edits": 2}, {"block": 7}):
        got = leaks.leaked(docs, qs, **kw)
        assert {(r.doc_id, r.item_id) for r in got.where("edits = 0").collect()} == want and want
    assert leaks.leaked(docs.limit(0), qs).count() == 0 and leaks.leaked(docs, qs.limit(0)).count() == 0


def test_leaks_with_edits(spark):
    q = "which shelf holds the seventh copper kettle beside a narrow wicker tray tonight"
    docs = spark.createDataFrame(
        [(1, "so: " + q.replace("copper", "coper")), (2, q.replace("seventh", "sevenths")), (3, q.replace("wicker", "wikker").replace("kettle", "ketle")), (4, q[:40])],
        "doc_id long, text string",
    )
    qs = spark.createDataFrame([(7, q)], "item_id long, text string")
    assert {(r.doc_id, r.edits) for r in leaks.leaked(docs, qs, words=13, edits=1).collect()} == {(1, 1), (2, 1)}
    assert {(r.doc_id, r.edits) for r in leaks.leaked(docs, qs, words=13, edits=2).collect()} == {(1, 1), (2, 1), (3, 2)}


def fewest_edits(passage, line):
    """Least edits of the passage against any part of the line."""
    cost = [0] * (len(line) + 1)
    for i, p in enumerate(passage, 1):
        new = [i]
        for j, c in enumerate(line, 1):
            new.append(min(cost[j - 1] + (p != c), cost[j] + 1, new[j - 1] + 1))
        cost = new
    return min(cost)


@pytest.mark.parametrize("edits", range(4))
@pytest.mark.parametrize("block", [100, 3])
def test_leaks_against_brute_force(spark, edits, block, monkeypatch):
    monkeypatch.setattr(leaks, "FILTERS", 2)
    rnd = random.Random(edits)
    words, split = ["ab", "cde", "x", "straße", "tray", "of", "née"], regex.compile(r"[^\p{L}\p{N}]+")
    questions = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 8)))) for k in range(12)]

    def damaged(s):
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(s))
            s = s[:at] + rnd.choice(["", "a", "zz", " "]) + s[at + rnd.randrange(2) :]
        return s

    texts = [rnd.choice(words) * rnd.randrange(3) + " " + damaged(rnd.choice(questions)[1]) + " " + rnd.choice(words) for _ in range(50)] + ["", None]
    want = {}
    for i, t in enumerate(texts):
        for k, q in questions:
            line, asked = leaks.word_line(t or "", split), leaks.word_line(q, split)
            best = min((fewest_edits(asked[a:b], line) for a, b in leaks._passages(asked, 4)), default=99)
            if best <= edits and t is not None:
                want[i, k] = best
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = leaks.leaked(docs, spark.createDataFrame(questions, "item_id long, text string"), 4, edits, block).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in got} == want and want


@pytest.mark.parametrize("edits", [1, 8, 10, 15])
def test_leaks_of_short_words(spark, edits):
    q = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, q), (2, "a b c q d e f h i j"), (3, "ä")], "doc_id long, text string")
    got = {r.doc_id: r.edits for r in leaks.leaked(docs, spark.createDataFrame([(7, q)], "item_id long, text string"), 10, edits).collect()}
    assert got == {1: 0, 2: 4} if edits >= 4 else got == {1: 0}
    with pytest.raises(ValueError):
        leaks.leaked(docs, spark.createDataFrame([(7, q)], "item_id long, text string"), 10, 21)


# ---- shared spans


def covered(texts, least):
    where = {}
    for i, t in texts:
        for p in range(len(t or "") - least + 1):
            where.setdefault(t[p : p + least], set()).add(i)
    out = {}
    for i, t in texts:
        own = {c for p in range(len(t or "") - least + 1) if len(where[t[p : p + least]]) > 1 for c in range(p, p + least)}
        if own:
            out[i] = len(own)
    return out


@pytest.mark.parametrize("least, chunk, segment", [(40, spans.CHUNK, spans.SEGMENT), (40, 500, 90), (12, 300, 50), (3, 200, 50)])
def test_spans(spark, least, chunk, segment):
    rnd = random.Random(least + chunk)
    text = lambda n: "".join(rnd.choice("ab é\n日") for _ in range(n))
    shared = [text(rnd.randrange(30, 120)) for _ in range(12)]
    texts = [(k, text(rnd.randrange(60)) + "".join(rnd.choice(shared)[rnd.randrange(9) :] for _ in range(rnd.randrange(4))) + text(rnd.randrange(80))) for k in range(80)]
    texts += [(100, texts[3][1]), (101, texts[3][1]), (102, None), (103, ""), (104, "x" * 200), (105, "x" * 90)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, pos long").repartition(4)
    got = {r.doc_id: r.shared_chars for r in spans.shared_spans(df, least, chunk, segment).collect()}
    assert got == covered(texts, least)
    assert spans.shared_spans(df.limit(0), least).count() == 0


def test_spans_whose_ends_differ_in_every_text(spark):
    """A closing that all texts have after unlike openings: no two hulls at its start are equal."""
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    closing, middle = text(45), text(70)
    texts = [(k, text(30 + k % 7) + closing[k % 3 :]) for k in range(60)] + [(k, text(25) + middle[: 41 + k % 9] + text(25)) for k in range(60, 110)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    for chunk in (4_000_000, 400):
        assert {r.doc_id: r.shared_chars for r in spans.shared_spans(df, 40, chunk).collect()} == covered(texts, 40)
    assert len(covered(texts, 40)) == 110


def test_in_several(spark):
    rnd = random.Random(9)
    rows = [(k, [rnd.randrange(40) if rnd.random() < 0.5 else rnd.randrange(10**6) for _ in range(rnd.randrange(30))]) for k in range(90)]

    def places(batches):
        for b in batches:
            at, h = np.asarray(b.column(1).offsets), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            yield b.column(0), doc, np.arange(len(h)) - at[doc], h << np.uint64(40), h * np.uint64(7)

    where = {}
    for k, hs in rows:
        for h in hs:
            where.setdefault(h, set()).add(k)
    df = spark.createDataFrame(rows, "key long, hs array<long>").repartition(5)
    for step in (4_000_000, 20):
        out = in_several(df, places, "bigint", True, step).collect()
        got, first = {(r.key, p) for r in out for p in r.places or []}, {(r.key, p) for r in out for p in r.firsts or []}
        assert got == {(k, p) for k, hs in rows for p, h in enumerate(hs) if len(where[h]) > 1}
        assert first == {(k, p) for k, hs in rows for p, h in enumerate(hs) if len(where[h]) > 1 and min(where[h]) == k}


@pytest.mark.parametrize("most", [5, 13, 80, 200, 600])
def test_cover(most):
    v, d = spans.cover(most)
    assert {(a - b) % v for a in d for b in d} == set(range(v)) and v <= max(1, most)
