"""Requests in the user's form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from textdex import Corpus, PatternError


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "a.txt", "One cat\nTwo cats\nThree", dt.datetime(2000, 1, 1), "first"), (2, "b.html", "one CAT\n\nend cut", dt.datetime(2000, 2, 1), None), (3, "c.txt", None, None, None)]
    return Corpus.from_df(spark.createDataFrame(rows, "file_id long, path string, text string, mtime timestamp, info string"), path="path", mtime="mtime", info="info")


CASES = [
    (["cat"], [("a.txt", "One cat"), ("a.txt", "Two cats")]),
    (["-w", "cat"], [("a.txt", "One cat")]),
    (["-i", "-h", "-n", "cat"], [(1, "One cat"), (1, "one CAT"), (2, "Two cats")]),
    (["-c", "-h", "-i", "one;cat"], [(1,), (1,)]),
    (["-1", "-g", "-u", "-n", "cot"], [(1, 1), (1, 2), (2, 3)]),
    (["-l", "c[au]t"], [("a.txt",), ("b.html",)]),
    (["-v", "cat"], [("a.txt", "Three"), ("b.html", ""), ("b.html", "end cut"), ("b.html", "one CAT")]),
    (["-L", "1", "cat"], [("a.txt", "One cat")]),
    (["-L0:0:1", "-i", "cat"], [("a.txt", "One cat"), ("b.html", "one CAT")]),
    (["-F", r"-v \.txt", "-i", "cat"], [("b.html", "one CAT")]),
    (["-W", "One;Three"], [("a.txt", "One cat"), ("a.txt", "Three")]),
    (["-d", "$$", "-l", "end"], [("b.html",)]),
    (["-q", "-h", "-u", "Two"], [(8, 16)]),
    (["-b", "-h", "-u", "Two"], [(11,)]),
    (["-x", "Three"], [("a.txt", "Three")]),
    (["-j", "-U", "-u", "-h", "Three"], [(": Jan 01 2000", "first")]),
    (["-m", "One\ncut", "-P", "-h", "-u"], [("One",), ("cut",)]),
    (["-B", "-h", "Thrse"], [(1, "Three")]),
    (["-t", "-h", "Two"], [("Two cats\n",)]),
    (["-G", "-i", "cut"], [(2, "b.html", "one CAT\n\nend cut")]),
    (["-Y", "40", "-l", "-i", "cat"], [("b.html",)]),
    (["-b", "-h", "-u", "-i", "CAT"], [(7,), (7,), (15,)]),
    (["-b", "-h", "-u", "-1", "Tvo"], [(11,)]),
    (["-b", "-h", "-u", "T(w|x)o"], [(11,)]),
    (["-b", "-h", "-u", "One;cat"], [(7,)]),
    (["-b", "-h", "-u", "-v", "cat"], [(None,), (None,), (None,), (None,)]),
    (["-p", "-h", "Oec"], [("One cat",)]),
    (["-p", "-1", "-h", "Oecz"], [("One cat",)]),
    (["-R", "8", "-h", "cat;Two"], [("One cat",), ("Two cats",)]),
    (["-R", "3", "-h", "cat;Two"], []),
    (["-B", "-i", "-w", "-h", "CUTS"], [(1, "One cat"), (1, "Two cats"), (1, "end cut"), (1, "one CAT")][1:3]),
    (["-M", "-h", "-u", "-m", "One\ncat"], [("One",), ("cat",), ("cat",)]),
    (["-P", "-h", "-u", "-m", "cat\nOne"], [("cat",), ("cat",)]),
    (["-s", "cat"], [(True,)]),
    (["-s", "dog"], [(False,)]),
    (["-O", "-u", "-n", "-h", "-i", "cat"], [(False, 2), (True, 1), (True, 1)]),
]


@pytest.mark.parametrize(("args", "want"), CASES)
def test_request(corpus, args, want):
    assert sorted(tuple(r) for r in corpus.request(args, now=F.lit("2000-03-01").cast("date")).collect()) == sorted(want)


@pytest.mark.parametrize("args", [["-A", "a"], ["-y", "a"], ["-r", "a"], ["-Q", "a"], ["-R", "x", "a;b"], ["-R", "9", "a,b"], ["-B", "-b", "abc"], ["-N", "a"], [], ["-w", "-x", "a"], ["-Z", "a"], ["-L"], ["-3", "abc"], ["-x", "-d", "$$", "a"]])
def test_bad_request(corpus, args):
    with pytest.raises(PatternError):
        corpus.request(args)


def test_index_and_sides(corpus, spark):
    c = corpus.index(built_at=F.lit("2000-01-15").cast("timestamp"))
    for p in ("cat", "One", "end cut"):
        assert c.search(p).count() == corpus.search(p).count()
    assert [r.path for r in corpus.index().request(["-N", "three"]).collect()] == ["a.txt"]
    ids = spark.createDataFrame([(2,), (2,)], "file_id long")
    assert [r.path for r in corpus.request(["-l", "-i", "cat"], ids=ids).collect()] == ["b.html"]
    names = spark.createDataFrame([("a.txt",), ("x",)], "path string")
    assert [r.path for r in corpus.request(["-l", "-i", "cat"], names=names).collect()] == ["a.txt"]
    assert corpus.search("One;Three", whole_file=True).count() == 2


def test_filters_deleted_and_structured(spark, tmp_path):
    rows = [(1, "a.up", "loud", False), (2, "b.txt", "loud", False), (3, "c.up", "loud", True)]
    c = Corpus.from_df(spark.createDataFrame(rows, "file_id long, path string, text string, gone boolean"), path="path", deleted="gone", filters=[("*.up", F.upper)])
    get = lambda c, *args: sorted(r[0] for r in c.request(list(args)).collect())
    for k in (c, c.index()):
        assert get(k, "-l", "loud") == ["a.up", "b.txt"] and get(k, "-z", "-l", "LOUD") == ["a.up"] and get(k, "-X", "-l", "loud") == ["a.up", "b.txt", "c.up"]
    (tmp_path / "names").write_text("b.txt\nc.up\n")
    assert get(c, "-f", f"file://{tmp_path}/names", "-l", "loud") == ["b.txt"]
    text = "@T { u\ntitle{4}:\tcats\nbody{4}:\tdogs\n}\n"
    s = Corpus.from_df(spark.createDataFrame([(1, text), (2, text.replace("cats", "owls"))], "file_id long, text string"))
    assert [tuple(r) for r in s.request(["-a", "title=cat;body=dog"]).collect()] == [("1", "title", "cats"), ("1", "body", "dogs")]
    i = c.index(offsets=True)
    assert sorted(tuple(r) for r in i.request(["-NQ", "-g", "-i", "-z", "oud"]).collect()) == [(1, 0), (2, 0)]
    assert [r.word for r in i.request(["-E", "lou"]).collect()] == ["loud"]
    assert i.reload().request(["-l", "-z", "LOUD"]).count() == 1


def test_reading_a_tree(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>The\nTitle</title> word")
    (tmp_path / "b.txt").write_text("word")
    (tmp_path / "c.txt").write_bytes(b"\x01" * 500 + b"word")
    (tmp_path / "d.gz").write_text("word")
    c = Corpus.read(spark, f"file://{tmp_path}")
    assert {(r.path.rsplit("/", 1)[1], r.info) for r in c.request(["-U", "-u", "word"]).collect()} == {("a.html", "The Title"), ("b.txt", None)}
    assert Corpus.read(spark, f"file://{tmp_path}", type_tests=False).search("word").count() == 3
    assert Corpus.read(spark, f"file://{tmp_path}", include=["c.txt"], exclude=["b.txt"]).search("word").count() == 2
