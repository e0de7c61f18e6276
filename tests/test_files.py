from pathlib import Path

import pytest

from arborseq.__main__ import parser, run
from arborseq.plans import api
from arborseq.sources import store, text
from tests.test_mining import GOLDEN, SEQUENCES, TREE


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "in/deep").mkdir(parents=True)
    (root / "in/a.txt").write_text(f"  s1 {SEQUENCES[0]}\n\ns1\t{SEQUENCES[1]} \n")
    (root / "in/deep/b.txt").write_text(f"s3 {SEQUENCES[2]}\ns4\n")
    (root / "tree.txt").write_text("Nikon_D5300 Other\nno parent here\nalone\n" + "\n".join(f"{k}\t {v}" for k, v in TREE.items()) + "\n")
    return root


def lines(path):
    return dict(x.split("\t") for f in sorted(Path(path).glob("part-*")) for x in f.read_text().splitlines())


def test_readers(spark, files):
    rows = text.read_sequences(spark, str(files / "in")).collect()
    assert sorted(" ".join(r["items"]) for r in rows) == sorted([*SEQUENCES, ""])
    assert {r.item: r.parent for r in text.read_hierarchy(spark, str(files / "tree.txt")).collect()} == TREE


@pytest.mark.parametrize("mode", ["s", "d"])
def test_command_line(spark, files, mode):
    out, kept = str(files / f"out_{mode}"), str(files / f"kept_{mode}")
    base = ["-o", out, "-s", "2", "-g", "1", "-l", "3", "-m", mode]
    run(spark, ["-i", str(files / "in"), "-H", str(files / "tree.txt"), "-k", kept, *base])
    want = {p: str(n) for p, n in GOLDEN.items()}
    assert lines(out) == want and list(lines(out)) == sorted(want)
    run(spark, ["-r", kept, *base])
    assert lines(out) == want
    run(spark, ["-r", kept, "-o", out, "-s", "3", "-g", "1", "-l", "3"])
    assert lines(out) == {"Camera Photography_Book": "3"}


def test_defaults_and_errors(spark):
    a = parser().parse_args(["-i", "x", "-o", "y"])
    assert (a.support, a.gap, a.length, a.mode) == (100, 0, 5, "s")
    for bad in (["-o", "y"], ["-i", "x", "-r", "z", "-o", "y"], ["-i", "x", "-o", "y", "-m", "q"]):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)
    with pytest.raises(SystemExit):
        run(spark, ["-r", "x", "-k", "z", "-o", "y"])


def test_dictionary_text(spark, files):
    seqs = text.read_sequences(spark, str(files / "in"))
    ids = api.encode(seqs, text.read_hierarchy(spark, str(files / "tree.txt"))).dictionary
    store.write_dictionary_text(ids, str(files / "dict"))
    assert {tuple(r) for r in text.read_dictionary(spark, str(files / "dict")).collect()} == {tuple(r)[:5] for r in ids.collect()}
    (files / "enc").mkdir()
    (files / "enc" / "x").write_text("1 2 3\n\n4\n")
    assert [r.tids for r in text.read_encoded(spark, str(files / "enc")).collect()] == [[1, 2, 3], [4]]
    found = api.mine(seqs, None, 1, 0, 2)
    store.write_patterns(found, str(files / "pq"))
    assert spark.read.parquet(str(files / "pq")).count() == found.count()


def test_scratch_tables_go(spark):
    from arborseq.common import cut, scratch, shared_dir

    here = Path(shared_dir(spark).removeprefix("file:")) / f"arborseq-{spark.sparkContext.applicationId}"
    kept = cut(spark.range(3))
    before = len(list(here.iterdir()))
    with scratch():
        assert cut(spark.range(5)).count() == 5
        assert len(list(here.iterdir())) == before + 1
    assert len(list(here.iterdir())) == before and kept.count() == 3
