"""Lines of sequences and of hierarchies, parsed by a grammar that recovers from errors.

    record := sep* [ field ( sep+ field )* ] sep*        sep := blank | tab | carriage return
    field  := bare | quoted                              bare := ( neither sep nor '"' )+
    quoted := '"' ( not '"' | '""' )* '"'  followed by a sep or the record's end

One parser reads a text from anchor to anchor: places where a record may start. These are the row starts of a table
(``parse_lines``), the line starts of whole texts (``parse_chunks``) or of the splits of files (``parse_files``). A quote that is
still open at the next anchor is broken. From there on the parser recovers: it tries each anchor, and resumes at the first at which the
grammar itself accepts a whole record. The lines before that one are faulty by their own reasons, and name the record that broke.

Each faulty record keeps the first reason that applies, with the code point where it was seen:
``quoting`` (it cannot be split), ``columns`` (wrong number of fields, null lines included) and
``value`` (a bad sequence id, or an item that is empty, too long or holds a control character).
Bytes that are no UTF-8 become U+FFFD, which is a ``value`` fault. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseq.common import pick

MAX_ITEM = 100
MAX_ID = (1 << 63) - 1

_SEPS = re.compile(r"[ \t\r]*")
_BARE = re.compile(r'[^" \t\r]+')
_INSIDE = re.compile(r'[^"]*')
_BAD = re.compile("[\x00-\x1f\x7f�]")
_ID = re.compile(r"[0-9]{1,19}", re.ASCII)


class Fault(Exception):
    """A syntax error: its reason, where it is, and what was wrong."""

    def __init__(self, reason: str, at: int, what: str):
        super().__init__(reason)
        self.reason, self.at, self.what = reason, at, what


@dataclass(frozen=True)
class Grammar:
    """least/most: numbers of fields. with_id: the first field is a sequence id."""

    name: str
    least: int
    most: int | None
    with_id: bool


SEQUENCES = Grammar("sequences", 2, None, True)
HIERARCHY = Grammar("hierarchy", 2, 2, False)


class Parser:
    """Recursive descent over one record: text[start:stop]."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar

    def record(self, text: str, start: int = 0, stop: int | None = None) -> list[str]:
        self.text, self.at, self.stop = text, start, len(text) if stop is None else stop
        fields: list[str] = []
        places: list[int] = []
        self.separators()
        while self.at < self.stop:
            places.append(self.at)
            fields.append(self.field())
            if self.separators() == 0 and self.at < self.stop:
                raise Fault("quoting", self.at, "text next to a quoted field or a quote in a bare one")
        self.count(fields, places)
        self.values(fields, places)
        return fields

    def separators(self) -> int:
        end = _SEPS.match(self.text, self.at, self.stop).end()
        n, self.at = end - self.at, end
        return n

    def field(self) -> str:
        return self.quoted() if self.text[self.at] == '"' else self.bare()

    def bare(self) -> str:
        m = _BARE.match(self.text, self.at, self.stop)
        self.at = m.end()
        return m.group()

    def quoted(self) -> str:
        opened, parts = self.at, []
        self.at += 1
        while True:
            m = _INSIDE.match(self.text, self.at, self.stop)
            parts.append(m.group())
            self.at = m.end()
            if self.at >= self.stop:
                raise Fault("quoting", opened, "quote without an end")
            self.at += 1
            if self.at >= self.stop or self.text[self.at] != '"':
                return "".join(parts)
            parts.append('"')
            self.at += 1

    def count(self, fields: list[str], places: list[int]) -> None:
        g = self.grammar
        if len(fields) < g.least:
            raise Fault("columns", self.stop, f"{len(fields)} fields, at least {g.least} expected")
        if g.most is not None and len(fields) > g.most:
            raise Fault("columns", places[g.most], f"{len(fields)} fields, at most {g.most} expected")

    def values(self, fields: list[str], places: list[int]) -> None:
        first = 0
        if self.grammar.with_id:
            if not _ID.fullmatch(fields[0]) or not 1 <= int(fields[0]) <= MAX_ID:
                raise Fault("value", places[0], "no valid sequence id")
            first = 1
        for x, at in zip(fields[first:], places[first:]):
            if not x or len(x) > MAX_ITEM or _BAD.search(x):
                raise Fault("value", at, "empty, too long or with a forbidden character")


class Recovery:
    """Records of a text from anchor to anchor, and whether a broken one is still to be recovered from; one text may come in several parts."""

    def __init__(self, grammar: Grammar):
        self.parser = Parser(grammar)
        self.broken: int | None = None

    def records(self, text: str, starts: list[int], stops: list[int], numbers: list[int]) -> Iterator[tuple[int, list[str] | Fault, int | None]]:
        """(number, fields or fault, number of the broken record before it) of the text between each anchor and its stop; a fault is located from its anchor."""
        for start, stop, number in zip(starts, stops, numbers):
            after = self.broken
            try:
                found: list[str] | Fault = self.parser.record(text, start, stop)
                self.broken = after = None  # a validated anchor: the text goes on from here
            except Fault as e:
                found = Fault(e.reason, e.at - start, e.what)
                if e.reason == "quoting" and after is None:
                    self.broken = number
            yield number, found, after


_OUT = pa.schema([
    ("fields", pa.list_(pa.string())), ("reason", pa.string()), ("at", pa.int32()), ("what", pa.string()), ("after", pa.int64()),
])
_NULL = Fault("columns", 0, "null line")


def _columns(found: list[tuple[list[str] | Fault, int | None]]) -> list[pa.Array]:
    faults = [x if isinstance(x, Fault) else None for x, _ in found]
    return [
        pa.array([None if f else x for (x, _), f in zip(found, faults)], _OUT.field("fields").type),
        *(pa.array([f and getattr(f, c) for f in faults], _OUT.field(c).type) for c in ("reason", "at", "what")),
        pa.array([a for _, a in found], pa.int64()),
    ]


def _parsed_lines(recovery: Recovery, lines: list[bytes | None], numbers: list[int]) -> list[tuple[list[str] | Fault, int | None]]:
    """Of each line its fields or fault; the lines are one text, and their starts its anchors."""
    texts = ["" if x is None else x.decode("utf-8", "replace") for x in lines]
    starts, at = [], 0
    for t in texts:
        starts.append(at)
        at += len(t) + 1
    stops = [a + len(t) for a, t in zip(starts, texts)]
    got = recovery.records("\n".join(texts), starts, stops, numbers)
    return [(_NULL, None) if line is None else (x, after) for line, (_, x, after) in zip(lines, got)]


def parse_lines(df: DataFrame, grammar: Grammar, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """``line_id, fields, reason, at, what``, one row per input row: fields of a valid record, else the fault.

    Rows are parsed where they lie, without a shuffle: the rows of an Arrow batch as one text, with the row starts as anchors. It
    also runs on streams. Repeated rows give repeated rows.
    """
    lines = pick(df, line_id=id_col, line=line_col).select(F.col("line_id").cast("bigint"), F.col("line").cast("binary"))

    def run(batches):
        for b in batches:
            own = _columns(_parsed_lines(Recovery(grammar), b.column(1).to_pylist(), list(range(b.num_rows))))
            yield pa.RecordBatch.from_arrays([b.column(0), *own[:-1]], ["line_id", *_OUT.names[:-1]])

    return lines.mapInArrow(run, "line_id bigint, fields array<string>, reason string, at int, what string")


_LOCATED = "line bigint, fields array<string>, reason string, at int, what string, after bigint"


def parse_chunks(df: DataFrame, grammar: Grammar, id_col: str, text_col: str = "value") -> DataFrame:
    """``chunk, line, fields, reason, at, what, after`` of the lines of whole texts; chunk: the id given with the text.

    line: from 0; blank lines are no records. after: the line of the broken record that the parser was still
    recovering from; a null text has no lines.
    """
    rows = pick(df, chunk=id_col, text=text_col).select("chunk", F.col("text").cast("binary"))
    kind = rows.schema["chunk"].dataType

    def run(batches):
        for b in batches:
            for chunk, raw in zip(b.column(0), b.column(1).to_pylist()):
                lines = list(enumerate((raw or b"").split(b"\n")))
                lines = [(k, x) for k, x in lines if x.strip(b" \t\r")]
                recovery = Recovery(grammar)
                for lo in range(0, len(lines), 10_000):
                    part = lines[lo : lo + 10_000]
                    found = _parsed_lines(recovery, [x for _, x in part], [k for k, _ in part])
                    chunks = pa.array([chunk.as_py()] * len(part), b.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([chunks, pa.array([k for k, _ in part], pa.int64()), *_columns(found)], ["chunk", "line", *_OUT.names])

    return rows.mapInArrow(run, f"chunk {kind.simpleString()}, {_LOCATED}")


def parse_files(spark: SparkSession, path: str, grammar: Grammar) -> DataFrame:
    """``file, block, line, fields, reason, at, what, after`` of the lines of all text files under path.

    A file is cut at line ends into the reader's splits, each of which is read as one text: block is where the split starts in the file, line
    counts its lines from 0, blank ones too, which are no records. So a fault can be found again, and no split waits for another.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n")
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary"))

    def run(batches):
        split, recovery, line = None, Recovery(grammar), 0
        for b in batches:
            files, blocks, values = (b.column(k).to_pylist() for k in range(3))
            lo = 0
            while lo < len(files):
                here = (files[lo], blocks[lo])
                hi = next((k for k in range(lo, len(files)) if (files[k], blocks[k]) != here), len(files))
                if here != split:
                    split, recovery, line = here, Recovery(grammar), 0
                own = [(line + k, x) for k, x in enumerate(values[lo:hi]) if x.strip(b" \t\r")]
                found = _parsed_lines(recovery, [x for _, x in own], [k for k, _ in own])
                located = [pa.array([v] * len(own), t) for v, t in zip(here, (pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*located, pa.array([k for k, _ in own], pa.int64()), *_columns(found)], ["file", "block", "line", *_OUT.names])
                line += hi - lo
                lo = hi

    return rows.mapInArrow(run, f"file string, block bigint, {_LOCATED}")


def valid_sequences(parsed: DataFrame) -> DataFrame:
    """``line_id, seq_id, items`` of the valid lines of sequences."""
    return parsed.where(F.col("reason").isNull()).select(
        "line_id", F.element_at("fields", 1).cast("bigint").alias("seq_id"),
        F.slice("fields", F.lit(2), F.size("fields") - 1).alias("items"),
    )


def valid_hierarchy(parsed: DataFrame) -> DataFrame:
    """``item, parent, line_no`` of the valid lines of a hierarchy."""
    return parsed.where(F.col("reason").isNull()).select(
        F.element_at("fields", 1).alias("item"), F.element_at("fields", 2).alias("parent"), F.col("line_id").alias("line_no")
    )


def rejects(parsed: DataFrame, source: str) -> DataFrame:
    """``source, line_id, reason, at, what`` of the lines that do not parse."""
    return parsed.where(F.col("reason").isNotNull()).select(F.lit(source).alias("source"), "line_id", "reason", "at", "what")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_id, line`` of text files under path, searched recursively; line_id is unique, not consecutive."""
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    return text.select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))
