import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborseq.sources import records as R

FIELD = r'(?:"(?:[^"]|"")*"|[^" \t\r]+)'
WHOLE = re.compile(rf"[ \t\r]*(?:{FIELD}(?:[ \t\r]+{FIELD})*)?[ \t\r]*")


def plain(line, grammar):
    """The rules by regular expressions."""
    if line is None:
        return "columns"
    if not WHOLE.fullmatch(line):
        return "quoting"
    fields = [x[1:-1].replace('""', '"') if x[0] == '"' else x for x in re.findall(FIELD, line)]
    if len(fields) < 2 or (grammar is R.HIERARCHY and len(fields) != 2):
        return "columns"
    names = fields
    if grammar is R.SEQUENCES:
        names = fields[1:]
        if not re.fullmatch("[0-9]{1,19}", fields[0]) or not 1 <= int(fields[0]) < 2**63:
            return "value"
    if any(not x or len(x) > 100 or any(ord(c) < 32 or ord(c) in (127, 0xFFFD) for c in x) for x in names):
        return "value"
    return fields


def parsed(line, grammar):
    try:
        if line is None:
            raise R.Fault("columns", 0, "")
        return R.Parser(grammar).record(line)
    except R.Fault as e:
        return e.reason


@settings(max_examples=2000, deadline=None)
@given(st.text('12"ab \t\r\n\x7f�é', max_size=14), st.sampled_from([R.SEQUENCES, R.HIERARCHY]))
def test_parser_equals_the_rules(line, grammar):
    assert parsed(line, grammar) == plain(line, grammar)


@pytest.mark.parametrize("line, reason", [
    (None, "columns"), ("", "columns"), ("5", "columns"), ('5 "a', "quoting"), ('5 a"b', "quoting"), ('5 "a"b', "quoting"), ("x a", "value"), ("0 a", "value"),
    ("9223372036854775808 a", "value"), ('5 ""', "value"), ("5 " + "a" * 101, "value"), ("5 a\x01", "value"), ("٣ a", "value"),
])
def test_reasons(line, reason):
    assert parsed(line, R.SEQUENCES) == reason


def test_quoted_fields():
    assert parsed('\r "7"\t"a ""b"" c"  d ', R.SEQUENCES) == ["7", 'a "b" c', "d"]
    assert parsed("9223372036854775807 " + "a" * 100, R.SEQUENCES)[0] == "9223372036854775807"


def test_tables(spark):
    df = spark.createDataFrame(
        [(1, "5 a b", "x"), (2, '5 "a', "y"), (3, None, None), (4, "6 c", ""), (4, "6 c", "")], "line_id long, line string, reason string"
    )
    out = R.parse_lines(df, R.SEQUENCES)
    assert sorted(map(tuple, R.valid_sequences(out).collect())) == [(1, 5, ["a", "b"]), (4, 6, ["c"]), (4, 6, ["c"])]
    assert sorted((r.line_id, r.reason, r.at) for r in R.rejects(out, "s").collect()) == [(2, "quoting", 2), (3, "columns", 0)]
    tree = R.parse_lines(spark.createDataFrame([(1, "a b"), (2, "a b c"), (3, "a")], "line_id long, line string"), R.HIERARCHY)
    assert [tuple(r) for r in R.valid_hierarchy(tree).collect()] == [("a", "b", 1)]
    assert R.parse_lines(df.limit(0), R.SEQUENCES).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "5 a", 2)], "line_id long, line string, x long").toDF("line_id", "line", "LINE")
    assert R.parse_lines(df, R.SEQUENCES).first().fields == ["5", "a"]


TEXT = '1 a b\n2 "open c\n  "still d\nx y\n"x y z\n3 e\n\n4 "f"g\n5 h\nno'
WANT = [
    (0, ["1", "a", "b"], None, None), (1, None, "quoting", None), (2, None, "quoting", 1), (3, None, "value", 1), (4, None, "quoting", 1), (5, ["3", "e"], None, None),
    (7, None, "quoting", None), (8, ["5", "h"], None, None), (9, None, "columns", None),
]


def test_recovery_in_a_text(spark):
    rows = R.parse_chunks(spark.createDataFrame([("u", TEXT), ("v", TEXT), ("w", None)], "name string, value string"), R.SEQUENCES, "name").collect()
    for chunk in "uv":
        assert [(r.line, r.fields, r.reason, r.after) for r in rows if r.chunk == chunk] == WANT
    assert len(rows) == 2 * len(WANT)
    assert [r["at"] for r in rows[:3]] == [None, 2, 2]


def test_recovery_in_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.txt", "deep/b.txt"):
        (tmp_path / name).write_text(TEXT)
    rows = R.parse_files(spark, str(tmp_path), R.SEQUENCES).collect()
    assert {r.file.rsplit("/", 1)[1] for r in rows} == {"a.txt", "b.txt"} and {r.block for r in rows} == {0}
    for name in ("a.txt", "b.txt"):
        assert [(r.line, r.fields, r.reason, r.after) for r in rows if r.file.endswith(name)] == WANT


def test_broken_quotes_do_not_swallow_valid_records(spark):
    hierarchy = R.parse_chunks(spark.createDataFrame([(1, 'a b\n"x y z\nabc q\nq" r\nc d')], "id long, value string"), R.HIERARCHY, "id").collect()
    assert [(r.line, r.fields, r.reason, r.after) for r in hierarchy] == [
        (0, ["a", "b"], None, None), (1, None, "quoting", None), (2, ["abc", "q"], None, None), (3, None, "quoting", None), (4, ["c", "d"], None, None),
    ]


def test_very_long_line():
    line = "1 " + " ".join(f'"x{i}"' for i in range(100_000))
    assert len(parsed(line, R.SEQUENCES)) == 100_001


def test_stream(spark, tmp_path):
    from arborseq.streaming.lines import parse_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('1 a b\n2 "x\n')
    q = parse_stream(spark, str(tmp_path / "in"), R.SEQUENCES).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.line, r.reason) for r in spark.sql("select * from lines").collect()) == [("1 a b", None), ('2 "x', "quoting")]
