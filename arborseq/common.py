"""Session-level helpers: column picking, lineage cuts, checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Limits:
    """Sizes up to which a table goes to the driver or to each worker. Beyond them the same is computed by joins."""

    #: rows and bytes of a lookup or of a broadcast side
    rows: int = 2_000_000
    size: int = 48 << 20
    #: rows of a hierarchy that the driver climbs itself
    hierarchy: int = 100_000
    #: frequent patterns of one level
    patterns: int = 1_000_000
    #: rewritten sequences of a pivot that one task mines
    group: int = 200_000


LIMITS = Limits()


@contextmanager
def limits(**values: int):
    """Other limits for the plans that are made meanwhile."""
    before = {k: getattr(LIMITS, k) for k in values}
    for k, v in values.items():
        setattr(LIMITS, k, v)
    try:
        yield LIMITS
    finally:
        for k, v in before.items():
            setattr(LIMITS, k, v)



def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``pick(df, new="old")``: only the named columns, under the given names.

    A name is matched exactly first, then without regard to case; the first such
    column wins, so other columns with equal names cannot make it ambiguous.
    """
    have = df.columns
    lower = [c.lower() for c in have]

    def place(name: str) -> int:
        if name in have:
            return have.index(name)
        if name.lower() in lower:
            return lower.index(name.lower())
        raise ValueError(f"no column {name!r} among {have}")

    at = {new: place(old) for new, old in columns.items()}
    if len(set(lower)) != len(lower):
        df = df.toDF(*[f"__c{i}" for i in range(len(have))])
        return df.select(*[F.col(f"__c{i}").alias(new) for new, i in at.items()])
    return df.select(*[df[f"`{have[i].replace('`', '``')}`"].alias(new) for new, i in at.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="arborseq-")
    sc.setCheckpointDir(own)
    return own


_written: list[tuple[SparkSession, str]] = []


def _remove(written: list[tuple[SparkSession, str]]) -> None:
    for spark, path in written:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone
            return


@contextmanager
def scratch():
    """The tables that plans write to the shared folder meanwhile are removed at the end; results must have been written or fetched by then."""
    n = len(_written)
    try:
        yield
    finally:
        _remove(_written[n:])
        del _written[n:]


def own_path(spark: SparkSession) -> str:
    """A path in the shared folder, below one folder of the application, that is removed at the end of scratch() or of the driver's process."""
    folder = f"{shared_dir(spark)}/arborseq-{spark.sparkContext.applicationId}"
    if not any(path == folder for _, path in _written):
        if not _written:
            atexit.register(_remove, _written)
        _written.insert(0, (spark, folder))
    path = f"{folder}/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder as a table and read from there.

    It cuts the lineage, survives lost executors, and is computed once for all readers.
    """
    spark = df.sparkSession
    path = own_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(name: str, kind: str):
    c = F.col(name)
    if kind in ("string", "binary"):
        n = F.octet_length(c)
    elif kind == "array<string>":
        n = F.aggregate(c, F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 4)
    elif kind.startswith("array<array<"):
        n = F.size(F.flatten(c)) * 8 + F.size(c) * 8
    elif kind.startswith("array<"):
        n = F.size(c) * 8
    else:
        n = F.lit(8)
    return F.coalesce(n, F.lit(0)).cast("bigint")


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df has at most that many rows (LIMITS.rows) and LIMITS.size bytes. df is computed for it up to that size: give it a table that is cheap to read again."""
    rows = LIMITS.rows if rows is None else min(rows, LIMITS.rows)
    width = sum((_bytes(c, t) for c, t in df.dtypes), F.lit(16).cast("bigint"))
    n, b = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and b <= LIMITS.size


def fetched(df: DataFrame) -> pa.Table:
    """The rows in the driver as columns, which take about the bytes that is_small counts; rows of Python objects would take ten times these."""
    return df.toArrow().combine_chunks()


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small; else unhinted, so that AQE may split skewed join partitions."""
    return F.broadcast(df) if is_small(df) else df


def width(spark: SparkSession) -> int:
    """The shuffle width of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once per application (as ``--py-files`` would)."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="arborseq-")  # of the driver, which serves the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    copy = Path(folder, "copy")
    shutil.copytree(root, copy / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(Path(folder, root.name)), "zip", copy))
    _shipped.add(sc.applicationId)
