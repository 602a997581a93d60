"""Term counts, heavy hitters and distinctive terms against brute force."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textdex.llm import distinctive, heavy, termcounts

TOKENS = "token_id long, file_id long, rec_no int, word string, attribute int, totalcount int, added_at timestamp"


def made(seed: int, n: int) -> list[tuple]:
    import datetime as dt

    r = random.Random(seed)
    out = []
    for i in range(n):
        word = r.choice([None, "The", "the", "Ünï", "ünï", "a", f"w{r.randint(0, 40)}"])
        out.append((i, r.choice([1, 1, 1, r.randint(2, 9)]), r.randint(0, 4), word, r.choice([None, 0, 1]), r.choice([None, 0, 1, 2, 5]), dt.datetime(2000, 1, 1)))
    return out + [(*t[:-1], dt.datetime(2000, 1, 2)) for t in out[: n // 10]]


def counted(tokens):
    occ, recs, all_recs = Counter(), defaultdict(set), set()
    for t in {t[0]: t for t in tokens}.values():
        all_recs.add(t[1:3])
        if t[3] is not None:
            w = t[3].lower()
            occ[w] += t[5] or 0
            recs[w].add(t[1:3])
    return {w: (occ[w], len(recs[w])) for w in recs}, len(all_recs)


def stored(store):
    return {r.term: (r.occurrences, r.n_records) for r in store.counts().collect()}


@pytest.fixture
def tokens(spark):
    return lambda rows: spark.createDataFrame(rows, TOKENS).withColumn("term", F.lit("clash")).withColumn("occ", F.lit(7))


def test_counts_and_updates(spark, tokens):
    first, more = made(1, 400), [(t[0] + 1000, *t[1:]) for t in made(2, 300)]
    store = termcounts.TermStore(spark).update(termcounts.record_terms(tokens(first)))
    want, n = counted(first)
    assert stored(store) == want and store.n_records() == n
    # records changed and added: those of `more` replace what they held
    now = {t[0]: t for t in first + more}.values()
    touched = {t[1:3] for t in more}
    after = [t for t in now if t[1:3] not in touched or t[0] >= 1000]
    store.update(termcounts.record_terms(tokens(more)))
    want, n = counted(after)
    assert stored(store) == want and store.n_records() == n
    # deleted
    gone = [(1, r) for r in range(5)]
    store.update(termcounts.record_terms(tokens([])), spark.createDataFrame(gone, "file_id long, rec_no int"))
    want, n = counted([t for t in after if t[1] != 1])
    assert stored(store) == want and store.n_records() == n
    # another reader finds the last version
    assert stored(termcounts.TermStore(spark, store.path)) == want


def test_an_update_touches_what_changed(spark):
    """One file of 200 changes: the update writes its rows only and reads its buckets only, so all others may be missing."""
    import shutil

    rows = spark.range(40_000).selectExpr("id div 200 AS file_id", "CAST(id % 200 div 5 AS INT) AS rec_no", "concat('w', id % 977) AS term", "1L AS occ")
    store = termcounts.TermStore(spark, buckets=64).update(rows.groupBy("file_id", "rec_no", "term").agg(F.sum("occ").alias("occ")))
    before = stored(store)
    changed = spark.createDataFrame([(17, 0, "new", 3)], "file_id long, rec_no int, term string, occ long")
    folder = store._folder("terms").removeprefix("file://")
    own = {r.bucket for r in spark.createDataFrame([(17, 0)], "file_id long, rec_no int").select(termcounts.record_bucket(64).alias("bucket")).collect()}
    assert len(own) == 1
    for b in set(range(64)) - own:
        shutil.rmtree(f"{folder}/version=1/bucket={b}", ignore_errors=True)
    store.update(changed, spark.createDataFrame([(17, r) for r in range(1, 40)] + [(999, 0)], "file_id long, rec_no int"))
    after = stored(store)
    lost = Counter(f"w{i % 977}" for i in range(17 * 200, 18 * 200))
    want = {w: (a - lost[w], b - lost[w]) for w, (a, b) in before.items() if b > lost[w]} | {"new": (3, 1)}
    assert after == want and store.n_records() == 8000 - 39
    assert spark.read.parquet(f"{folder}/version=2").count() == 1 + 39 + 1


def test_merging_and_failed_updates(spark, monkeypatch):
    """Many updates are merged on disk; an update that died before its marker leaves nothing behind."""
    monkeypatch.setattr(termcounts, "MOST_VERSIONS", 2)
    made = lambda rows: spark.createDataFrame(rows, "file_id long, rec_no int, term string, occ long")
    store = termcounts.TermStore(spark, buckets=2).update(made([(1, 1, "a", 1), (2, 1, "a", 2), (2, 1, "b", 1), (None, None, "n", 1)]))
    with monkeypatch.context() as m:
        m.setattr(termcounts.TermStore, "_mark", lambda self: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            termcounts.TermStore(spark, store.path).update(made([(1, 1, "z", 9), (3, 1, "z", 9)]))
    store = termcounts.TermStore(spark, store.path)
    assert stored(store) == {"a": (3, 2), "b": (1, 1), "n": (1, 1)} and store.n_records() == 3
    for n in range(5):
        store.update(made([(1, 1, "a", n), (10 + n, 1, "c", 1), (None, None, "n", n)]), spark.createDataFrame([(10 + n - 1, 1)], "file_id long, rec_no int"))
        assert stored(store) == {"a": (n + 2, 2), "b": (1, 1), "c": (1, 1), "n": (n, 1)} and store.n_records() == 4
        assert stored(termcounts.TermStore(spark, store.path)) == stored(store)
    assert store.generation == 2 and store.terms().count() == 5


def test_counts_of_nothing(spark, tokens):
    store = termcounts.TermStore(spark).update(termcounts.record_terms(tokens([])))
    out = termcounts.marked_counts(store.counts(), store.n_records(), spark.createDataFrame([], "word string, freq int"))
    assert out.count() == 0 and out.columns == ["word", "occurrences", "n_records", "dict_freq", "mark"]
    only_null = [(1, 1, 1, None, 0, 1, None)]
    store = termcounts.TermStore(spark).update(termcounts.record_terms(tokens(only_null)))
    assert store.n_records() == 1 and stored(store) == {}


def test_marks(spark, tokens):
    rows = [(i, i, 0, "all", 0, 1, None) for i in range(20)] + [(100, 0, 0, "one", 0, None, None), (101, 0, 0, "two", 0, 1, None), (102, 1, 0, "two", 0, 1, None), (103, 30, 0, None, 0, 1, None)]
    store = termcounts.TermStore(spark).update(termcounts.record_terms(tokens(rows)))
    words = spark.createDataFrame([("ALL", 3), ("all", None), (None, 5)], "word string, freq int")
    got = {r.word: (r.occurrences, r.dict_freq, r.mark) for r in termcounts.marked_counts(store.counts(), store.n_records(), words).collect()}
    assert got == {"all": (20, 3, "common"), "one": (0, 0, "rare"), "two": (2, 0, "kept")}
    exact = spark.createDataFrame([("x", 7, 7), ("y", 6, 6)], "term string, occurrences long, n_records long")
    assert [r.mark for r in termcounts.marked_counts(exact, 70, words).orderBy("word").collect()] == ["common", "kept"]


@pytest.mark.parametrize("k", [3, 10, 50])
def test_summary_bound(k):
    """Every merge order keeps each counter within total / (k + 1) below the true count."""
    r = random.Random(k)
    data = [(f"v{int(r.paretovariate(0.7))}", r.randint(1, 9)) for _ in range(3000)]
    true, total = Counter(), sum(n for _, n in data)
    for v, n in data:
        true[v] += n
    tables = []
    for at in range(0, len(data), 250):
        part = data[at : at + 250]
        tables.append(pa.table(list(heavy.fold(pa.table({"value": [v for v, _ in part], "count": pa.array([n for _, n in part], pa.int64())}), k)), ["value", "count"]))
    while len(tables) > 1:
        r.shuffle(tables)
        tables = tables[2:] + [pa.table(list(heavy.fold(pa.concat_tables(tables[:2]), k)), ["value", "count"])]
    got = dict(zip(*[c.to_pylist() for c in tables[0].columns], strict=True))
    assert len(got) <= k
    for v, n in true.items():
        assert n - total / (k + 1) <= got.get(v, 0) <= n


def test_long_values_are_counted_by_digest(spark):
    long = ["x" * 500 + str(n) for n in range(3)]
    df = spark.createDataFrame([(v, 10 * (n + 1)) for n, v in enumerate(long)] + [("s", 1)], "value string, count int")
    assert {r.value: r.total for r in heavy.heavy_hitters(df, "value", "count", 0.3).collect()} == {long[1]: 20, long[2]: 30}
    assert all(len(r.value) <= heavy.MOST_BYTES for r in heavy.summary(df, "value", "count", 10).collect())


def test_heavy_hitters(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", f"v{r.randint(0, 5000)}", None]), r.choice([None, 1, 2, 3])) for _ in range(20000)] + [("tie", 0), ("neg", -5)]
    df = spark.createDataFrame(rows, "value string, count int").repartition(40)
    true, total = Counter(), 0
    for v, n in rows:
        if n and n > 0:
            total += n
            if v is not None:
                true[v] += n
    for support in (0.2, 0.001, 0.0003):
        got = {x.value: x.total for x in heavy.heavy_hitters(df, "value", "count", support).collect()}
        assert got == {v: n for v, n in true.items() if n >= support * total}
    assert heavy.heavy_hitters(df.limit(0), "value", "count").count() == 0
    assert heavy.heavy_hitters(df.filter("value is null"), "value").count() == 0
    assert {x.value for x in heavy.heavy_hitters(df, "value", None, 0.3).collect()} == {"hot"}


def brute(tokens, score):
    n, df, total = Counter(), Counter(), Counter()
    for t in {t[0]: t for t in tokens}.values():
        if t[3] is not None:
            n[t[1], t[2], t[3].lower(), t[4] or 0] += t[5] or 0
    size = Counter()
    for (f, r, w, a), c in n.items():
        df[w, a] += 1
        total[w, a] += c
        size[f, r] += c
    records = {k[:2] for k in n}
    everything = sum(size.values())
    m = everything / max(1, len(records))
    out = defaultdict(list)
    for (f, r, w, a), c in n.items():
        if df[w, a] < 2 or (score == "log_odds" and not total[w, a]):
            continue
        if score == "tf_idf":
            s = round(c * math.log(len(records) / df[w, a]), 6)
        else:
            p = m * total[w, a] / everything
            y, rest = c + p, total[w, a] - c + p
            s = round((math.log(y / (size[f, r] + m - y)) - math.log(rest / (everything - size[f, r] + m - rest))) / math.sqrt(1 / y + 1 / rest), 6)
        if s > 0:
            out[f, r].append((-s, w, a))
    return {k: [(w, a) for _, w, a in sorted(v)[:3]] for k, v in out.items()}


@pytest.mark.parametrize("score", ["tf_idf", "log_odds"])
def test_distinctive(spark, tokens, score):
    data = made(9, 600)
    got = defaultdict(list)
    for r in distinctive.distinctive_terms(tokens(data), score).orderBy("rank").collect():
        got[r.file_id, r.rec_no].append((r.word, r.attribute))
    assert got == brute(data, score)
    assert distinctive.distinctive_terms(tokens([]), score).count() == 0
    with pytest.raises(ValueError):
        distinctive.distinctive_terms(tokens([]), "other")
