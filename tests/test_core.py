"""Search with and without index, maintenance, sources, balance: invariants and small cases."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from textdex import queries as core
from textdex.functions import compress
from textdex.functions.approx import subsequence_within
from textdex.functions import text as T
from textdex.operators import attributes as A
from textdex.operators import index as I
from textdex.operators import search as S
from textdex.operators import skew
from textdex.plans import pattern as P
from textdex.plans.compile import all_in, any_of
from textdex.sources import files as SF
from textdex.sources import soif

TEXTS = [
    "The cat sat.\nA dog; attached to seattle\n\nend", "Basic suite.", None, "", "\n", "no newline at end", "x" * 70 + " longword\ncat", "été Straße ÀÉ\nthe_end of abc123", "cat dog\ndog\nbad boy\nbad girl",
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "file_id long, text string, rec string")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("pattern", "options"), [
    ("cat", {}), ("att", {}), ("cat;dog", {}), ("cat,suite", {}), ("cat;~dog", {}), ("dog#cat", {}), ("c(a|u)t", {}), ("attle", {"word": True}), ("xxx", {}),
    ("suit", {"errors": 1}), ("CAT", {"icase": True}), ("the", {"word": True, "icase": True}), ("bad boy", {}), ("^cat", {}), ("123", {}), ("c123", {}), ("STRASSE", {"icase": True}),
])
def test_index_does_not_change_answers(files, pattern, options):
    idx = I.Index.build(files)
    plain = S.search(files, pattern, **options)
    assert rows(plain) == rows(S.search(files, pattern, idx, **options))
    stop = idx.vocab.filter("df >= 2")
    assert rows(plain) == rows(S.search(files, pattern, idx, stop=stop, **options))


def test_records(files):
    got = defaultdict(list)
    for r in T.records(files, offsets=True).orderBy("file_id", "rec_no").collect():
        got[r.file_id].append((r.rec, r.begin))
        assert TEXTS[r.file_id][r.begin : r.end] == r.rec
    assert [x[0] for x in got[0]] == ["The cat sat.", "A dog; attached to seattle", "", "end"]
    assert got[3] == [] and got[2] == [] and [x[0] for x in got[4]] == [""]
    assert rows(T.records(files, P.delimiter("$$")).filter("file_id = 0").select("rec")) == Counter([("The cat sat.\nA dog; attached to seattle",), ("end",)])


def test_words(files):
    words = [r.word for r in T.tokens(files).filter("file_id = 7").collect()]
    assert words == ["été", "straße", "àé", "the_end", "of", "abc"]
    assert [r.word for r in T.tokens(files, True).filter("file_id = 7").collect()][-1] == "abc123"
    assert [r.word for r in T.tokens(files).filter("file_id = 6").collect()] == ["longword", "cat"]
    for r in T.word_offsets(files).collect():
        assert TEXTS[r.file_id][r.off : r.off + len(r.word)].lower() == r.word
    assert rows(T.word_offsets(files).select("file_id", "word")) == rows(T.tokens(files))


def test_whole_file_scope(spark):
    f = spark.createDataFrame([(1, "fame\nx"), (2, "fame\nglory"), (3, "glory"), (4, "none")], "file_id long, text string")
    assert rows(S.search_whole(f, "fame;~glory").select("file_id", "rec")) == Counter([(1, "fame")])
    assert rows(S.search_whole(f, "~{fame;glory}").select("file_id", "rec")) == Counter([(1, "fame"), (3, "glory")])
    assert rows(S.search_whole(f, "fame;glory").select("rec")) == Counter([("fame",), ("glory",)])


def test_smoke(spark):
    f = spark.createDataFrame([(0, "Basic glimmer test suite.")], "file_id long, text string")
    assert S.search(f, "test;suite", icase=True).count() == 1


def test_limits(files):
    hits = S.search(files, "a")
    assert S.limit_total(hits, 2).count() == 2 and S.limit_total(hits, 0).count() == hits.count()
    assert S.limit_per_file(hits, 1).count() == hits.select("file_id").distinct().count()
    assert S.limit_files(hits, 1).select("file_id").distinct().count() == 1


def test_maintenance(files):
    a, b = files.filter("file_id < 5"), files.filter("file_id >= 5")
    cols = ["word", "file_id", "tf"]
    both = rows(I.postings_file(files).select(cols))
    assert rows(I.merged(I.postings_file(a), I.postings_file(b)).select(cols)) == both
    assert rows(I.without(I.postings_file(files), b).select(cols)) == rows(I.postings_file(a).select(cols))


def test_proximity(spark):
    gap = lambda n: "one " + "." * n + "two"
    f = spark.createDataFrame([(1, gap(252)), (2, gap(253)), (3, "one"), (4, "two one")], "file_id long, text string")
    off = T.word_offsets(f)
    assert sorted(r.file_id for r in I.near(off, "one", "two", 256).collect()) == [1, 4]
    assert rows(I.near_in_files(f, "One", "two", 256)) == rows(I.near(off, "one", "two", 256))


def test_stop_rule(spark):
    f = spark.createDataFrame([(i, "common" + (" rare" if i == 0 else "")) for i in range(300)], "file_id long, text string")
    v = I.vocabulary(I.postings_file(f))
    assert [r.word for r in I.stop_words_share(v, 300).collect()] == ["common"]
    assert I.stop_words_share(v, 254).count() == 0


@pytest.mark.parametrize("total", [4_000_000, 5_000_000, 2_147_483_647, 2_147_483_648])
def test_stop_rule_by_density(spark, total):
    least = -(-500 * total // 1_048_576)  # the product passes an int from 4.3 million bytes on
    v = spark.createDataFrame([("common", 9, least), ("rare", 9, least - 1), ("none", 9, 0)], "word string, df long, tf long")
    assert [r.word for r in I.stop_words_density(v, total).collect()] == ["common"]


def test_stop_rule_without_text(spark):
    assert I.stop_words_density(spark.createDataFrame([("word", 1, 1)], "word string, df long, tf long"), None).count() == 0


def test_stop_list_mb_of_more_text(spark, tmp_path):
    text = F.concat(F.lit("the cat "), F.repeat(F.lit("sat on "), 6000), F.concat(F.lit("file "), F.col("doc_id").cast("string")))
    d = spark.range(150).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 50 != 0, text).alias("text"), F.lit(None).cast("timestamp").alias("received_at"))
    d.coalesce(1).write.parquet(str(tmp_path / "made"))
    folder = tmp_path / "tables"
    folder.mkdir()
    next((tmp_path / "made").glob("*.parquet")).rename(folder / "documents.parquet")
    df = core.queries()["stop_list_mb"](spark, str(folder))
    assert sorted(r.word for r in df.collect()) == ["on", "sat"]
    same(df, core.oracle_sql()["stop_list_mb"], str(folder))


def test_save_and_open(files, spark, tmp_path):
    I.Index.build(files).save(str(tmp_path / "i"), 2)
    idx = I.Index.open(spark, str(tmp_path / "i"))
    assert rows(S.search(files, "cat", idx)) == rows(S.search(files, "cat"))


def test_structured_round_trip(spark):
    values = [("a", "x"), ("b", "line 1\nline 2 } @X { y"), ("c-1", ""), ("d", "ünï")]
    f = spark.createDataFrame([(1, values)], "file_id long, a array<struct<name:string,value:string>>")
    text = f.select("file_id", soif.write_text(F.lit("T"), F.lit("u"), F.col("a")).alias("text"))
    got = soif.read(text).first()
    assert [(a.name, a.value) for a in got.attrs] == values and got.ok and (got.type, got.url) == ("T", "u")
    broken = soif.read(spark.createDataFrame([(1, "@T { u\nname{99}:\tshort\n}\n"), (2, None), (3, "none")], "file_id long, text string")).collect()
    assert [(r.file_id, r.ok) for r in broken] == [(1, False)]


def test_fields(spark):
    f = spark.createDataFrame([(1, "junk\nTitle: one\n two\nHost1: h\nDesc1: d")], "file_id long, text string")
    got = [tuple(r)[1:3] for r in soif.from_fields(T.records(f), ":", True).orderBy("n").collect()]
    assert got == [("Title", "one\ntwo"), ("Host", "h"), ("Description", "d")]
    pc = spark.createDataFrame([(1, 1, '(("." "p1" "name") "1994-01-01" 12 "a file")'), (1, 2, "bad")], "file_id long, rec_no int, rec string")
    assert [tuple(r)[2:] for r in soif.pc_index(pc).collect()] == [("./p1/name", "1994-01-01", 12, "a file")]
    seeds = spark.createDataFrame([("cs.uni.edu", "CS", "h1"), ("ee.uni.edu", "EE", None), (None, "x", "y"), ("uni.edu", "CS", "h1")], "domain string, organisation string, host string")
    assert [tuple(r) for r in soif.by_domain(seeds).collect()] == [("uni.edu", ["cs.uni.edu", "ee.uni.edu", "uni.edu"], ["CS", "EE"], ["h1"])]


def test_kinds(spark):
    words = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(520))
    cases = {"binary": "\x01\x02abc", "uuencode": "begin 644 x\nM123\nM456\n", "postscript": "%!PS-Adobe-2.0\nx", "heavy": words, "hqx": "a" * 3000, "text": "plain text"}
    f = spark.createDataFrame(list(cases.items()), "want string, text string")
    assert all(r.want == r.got for r in f.withColumn("got", SF.kind(F.col("text"))).collect())
    titles = spark.createDataFrame([("<TITLE>a\nb: c</title>",), ("none",)], "h string")
    assert [r[0] for r in titles.select(SF.html_title(F.col("h"))).collect()] == ["a b\\: c", "No Title"]


def test_filters(spark):
    f = spark.createDataFrame([("a.html", "<b>X</b>"), ("a.txt", "<b>X</b>"), ("b.html", "<b></b>")], "path string, text string")
    got = {r.path: r.text for r in SF.apply_filters(f, [("*.html", SF.html_to_text)]).collect()}
    assert got == {"a.html": "X", "a.txt": "<b>X</b>", "b.html": "<b></b>"}


def test_attributes(spark):
    a = spark.createDataFrame([([("Embed<10>-b",), ("Zeta",), ("alpha",), ("Embed<2>-a",)],)], "a array<struct<name:string>>")
    names = lambda c: [x.name for x in a.select(c.alias("x")).first().x]
    assert names(A.sorted_attrs(F.col("a"))) == ["alpha", "Zeta", "Embed<2>-a", "Embed<10>-b"]
    assert names(A.sink_embedded(F.col("a"))) == ["Zeta", "alpha", "Embed<10>-b", "Embed<2>-a"]


def test_compression(spark):
    f = spark.createDataFrame([("the cat and the cat  \n",), ("",), ("Ünï the-cat\x00",)], "text string")
    for words in ({}, compress.dictionary(compress.weights(f, 2), 10)):
        got = f.select("text", compress.decode(compress.encode(F.col("text"), words), words).alias("back"), compress.contains_word(compress.encode(F.col("text"), words), "cat", words).alias("cat")).collect()
        assert all(r.text == r.back for r in got) and [r.cat for r in got] == [True, False, True]


def test_blocks(spark):
    f = spark.createDataFrame([(i, 10 if i != 2 else None, i == 1) for i in range(5)], "file_id long, size long, deleted boolean")
    assert [r.block_id for r in I.blocks_fixed(f, 15).orderBy("file_id").collect()] == [0, 0, 1, 1, 2]
    assert [tuple(r) for r in I.renumbered(f).orderBy("file_id").collect()] == [(0, 0), (2, 1), (3, 2), (4, 3)]
    assert [r.block_id for r in I.blocks(f, 4, 4).orderBy("file_id").collect()] == [0, 1, 2, 2, 3]


# balance


def profile(occ, words):
    kinds = defaultdict(set)
    for i, w in words:
        if i is not None and w is not None:
            kinds[i].add(w)
    out = {}
    for k in {k for k, _, _ in occ if k is not None}:
        own = {(i, o) for x, i, o in occ if x == k}
        offs = sorted({o for _, o in own if o is not None})
        out[k] = (len(own), len(set().union(*[kinds.get(i, set()) for i, _ in own])), max([b - a for a, b in zip(offs, offs[1:], strict=False)], default=0))
    return out


def test_key_profile(spark):
    random.seed(3)
    occ = [(7 if random.random() < 0.4 else random.randint(0, 50), random.choice([None, *range(400)]), random.choice([None, *range(3000)])) for _ in range(4000)]
    occ += [(None, 1, 2), (99, None, None), (98, 1, 5), (98, 1, 5)] + occ[:300]
    words = [(i, random.choice([None, "a", "b", f"w{i % 90}"])) for i in range(300)] + [(None, "n"), (5, "again"), (5, "again")]
    left = spark.createDataFrame(occ, "key int, item long, off long").withColumn("word", F.lit("clash"))
    right = spark.createDataFrame(words, "item long, word string").withColumn("off", F.lit(1))
    for tasks in (1, 4, 16):
        got = {r.key: (r.n_rows, r.n_words, r.max_gap) for r in skew.key_profile(left, right, tasks).collect()}
        assert got == profile(occ, words)
    assert skew.plan_load(left, ["key"], 16).heavy


def test_key_profile_of_nothing(spark):
    occ = spark.createDataFrame([], "key int, item long, off long")
    words = spark.createDataFrame([], "item long, word string")
    assert skew.key_profile(occ, words).count() == 0
    one = spark.createDataFrame([(1, 1, 1)], "key int, item long, off long")
    assert [tuple(r) for r in skew.key_profile(one, words).collect()] == [(1, 1, 0, 0)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_fragment_replicate_join(spark, how):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).alias("k"), "id").union(spark.createDataFrame([(None, 1)], "k long, id long"))
    small = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(spark.createDataFrame([(1, -1), (None, 9)], "k long, v long"))
    got = skew.fragment_replicate_join(big, small, ["k"], how=how).select("k", "id", "v")
    assert rows(got) == rows(big.join(small, ["k"], how).select("k", "id", "v"))
    with pytest.raises(ValueError):
        skew.fragment_replicate_join(big, small.withColumnRenamed("v", "id"), ["k"])


def test_packing():
    where = skew.pack([(9, "a"), (5, "b"), (5, "c"), (1, "d")], 2)
    load = Counter()
    for n, k in [(9, "a"), (5, "b"), (5, "c"), (1, "d")]:
        load[where[k]] += n
    assert max(load.values()) <= 11


def test_live_index(spark, tmp_path):
    from textdex.streaming.ingest import LiveIndex

    schema = "file_id long, path string, size long, mtime timestamp, info string, deleted boolean, text string"
    parts = [
        [(1, "a", 1, None, None, False, "one two"), (2, "b", 1, None, None, False, "two")],
        [(1, "a", 1, None, None, False, "three"), (2, "", 1, None, None, True, None), (3, "c", 1, None, None, False, "two")],
    ]
    live = LiveIndex(spark, f"file://{tmp_path}/live")
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        live.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "check")).awaitTermination()
        if n == 0:
            assert rows(live.postings().select("word", "file_id")) == Counter([("one", 1), ("two", 1), ("two", 2)])
    assert rows(live.postings().select("word", "file_id")) == Counter([("three", 1), ("two", 3)])
    live.apply(spark.createDataFrame(parts[1], schema), 1)  # the batch runs again
    assert rows(live.postings().select("word", "file_id")) == Counter([("three", 1), ("two", 3)])


def test_by_age_places_every_file(spark):
    times = [None if i % 3 == 0 else i % 7 for i in range(1000)]
    ids = list(range(1000))
    random.Random(1).shuffle(ids)
    files = spark.createDataFrame([(i, times[i]) for i in ids], "file_id long, t int").selectExpr("file_id", "timestamp_seconds(t) AS mtime")
    want = sorted(range(1000), key=lambda i: (times[i] is None, -(times[i] or 0), i))
    got = I.by_age(files.repartition(5)).orderBy("place").collect()
    assert [r.file_id for r in got] == want and [r.place for r in got] == list(range(1, 1001))
    same = I.by_age(files.withColumn("mtime", F.lit(None).cast("timestamp"))).orderBy("place").collect()
    assert [r.file_id for r in same] == list(range(1000))
    assert I.by_age(files.limit(0)).count() == 0


def test_offset_deltas_of_every_word(files):
    want = Counter()
    before = {}
    for r in sorted(T.word_offsets(files).collect(), key=lambda r: (r.file_id, r.off)):
        want[r.word, r.file_id, r.off, r.off - before[r.file_id, r.word] if (r.file_id, r.word) in before else None] += 1
        before[r.file_id, r.word] = r.off
    assert rows(I.offset_deltas(files)) == want and ("dog", 8, 8, 4) in want


def test_scope_removes_intermediate_data(spark):
    import os

    from textdex.session import scope, scratch_dir, written

    with scope(spark):
        df = written(spark.range(5), "scope-test")
        path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert df.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path) and "scope-test" in scratch_dir(spark, "scope-test")


# a saved index


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """300 files of made words, saved with all parts."""
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma_ray", "delta", "would", "there", "Über", "x_ray", "o", "zzz", "wood"]
    rows = [(i, f"dir/{i}.txt", "\n".join(" ".join(rng.choice(words) + rng.choice(["", "s", "1", "-"]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 5))) if i % 50 else None) for i in range(300)]
    rows.append((300, "long.txt", "q" * 80 + "would" + "q" * 80))
    f = spark.createDataFrame(rows, "file_id long, path string, text string")
    return f, I.Index.build(f, offsets=True, records=True, stop_percent=90).save(f"file://{tmp_path_factory.mktemp('index')}/i", 3)


CASES = [
    ("would;there", {}), ("would,zzz", {}), ("would;~there", {}), ("~would", {}), ("ray", {"word": True}), ("gamma_ray", {}), ("OULD", {"icase": True}), ("wuold there", {"errors": 2}), ("wo(u|o)*ld", {"errors": 1}),
    ("al.*beta", {}), ("{alpha,beta};{delta,zzz};there", {}), ("über", {"icase": True}), ("qwouldq", {}), ("o", {}), ("^would", {}), ("zz|be", {}), ("missing", {}), ("missing,zzz", {"word": True}), ("dlta", {"errors": 1, "word": True}),
]


@pytest.mark.parametrize(("pattern", "options"), CASES)
def test_an_index_never_changes_an_answer(library, pattern, options):
    f, idx = library
    assert rows(S.search(f, pattern, idx, **options)) == rows(S.search(f, pattern, **options))
    assert rows(S.search_whole(idx.texts, pattern, index=idx, **options)) == rows(S.search_whole(f, pattern, **options))


def test_lookups_of_many_words_narrow_or_stand_aside(library, monkeypatch):
    f, idx = library
    monkeypatch.setattr(I, "MOST_PUSHED", 3)
    for pattern, options in CASES:
        assert rows(S.search(f, pattern, idx, **options)) == rows(S.search(f, pattern, **options)), pattern


def test_lookups_are_pushed_to_the_scan(library):
    _, idx = library
    found = idx.words([("would", True), ("ray", False)])
    assert set(found["ray", False]) >= {"gamma_ray", "x_ray"} and "would" in found["would", True]
    plan = idx.posted({"would", "there"})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(word,would)" in plan.replace(" ", "")
    plan = S.search(idx.texts, "zzz;delta", idx)._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    assert "file_id" in plan.split("PushedFilters")[1][:4000]


def test_index_parts_and_reload(library, spark):
    f, idx = library
    again = idx.reload()
    assert again.meta["n_files"] == 301 and rows(again.offsets.selectExpr("word", "file_id", "size(offsets)")) == rows(I.postings_offset(f).selectExpr("word", "file_id", "size(offsets)"))
    assert rows(again.records) == rows(I.postings_record(f)) and rows(again.long_files) == Counter({(300,): 1})
    assert rows(again.stop) == rows(I.stop_words_share(I.vocabulary(I.postings_file(f)), 301, 90).select("word"))
    left = idx.without(f.filter("file_id >= 5").select("file_id"))
    assert rows(left.vocab) == rows(I.vocabulary(I.postings_file(f.filter("file_id < 5"))))
    assert set(idx.size()) >= {"postings", "vocab", "texts", "meta"}


def test_sets_of_any_number(spark):
    sets = [spark.createDataFrame([(1,), (2,), (2,), (10 + n,)], "file_id long") for n in range(70)]
    assert rows(I.all_of(sets)) == Counter({(1,): 1, (2,): 1}) and I.any_of(sets).count() == 72


def test_forty_thousand_patterns(spark):
    many = [f"k{n:05d}" for n in range(40_000)]
    df = spark.createDataFrame([(1, 1, "has k00017 and k39999"), (1, 2, "none"), (2, 1, None)], "file_id long, rec_no int, rec string")
    assert [r.rec_no for r in df.filter(any_of(many, F.col("rec"))).collect()] == [1]
    assert rows(S.which_patterns(df, many).select("rec_no", "pattern")) == Counter({(1, "k00017"): 1, (1, "k39999"): 1})
    some = ["a", "A", "k0", "", "one"] + many
    assert [r.p for r in df.select(all_in(some, F.col("rec"), True).alias("p")).collect()] == [["a", "A", "k0", "", "k00017", "k39999"], ["", "one"], None]


def test_bitmaps_and_back(spark):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 9, 32768, 32769, 100_000)], "file_id long")
    assert rows(I.bitmap_ids(I.bitmap(ids))) == rows(ids) and I.bitmap_ids(I.bitmap(ids.limit(0))).count() == 0


def test_long_supersequence(spark):
    text = "".join(chr(97 + i % 26) for i in range(80))
    df = spark.createDataFrame([(text.replace("c", "c-"),), (text[:77],), (text[:70],), (None,)], "rec string")
    assert [r.m for r in df.select(subsequence_within(F.col("rec"), text, 3).alias("m")).collect()] == [True, True, False, None]


def test_live_index_is_merged(spark, tmp_path):
    from textdex.streaming.ingest import LiveIndex

    schema = "file_id long, path string, size long, mtime timestamp, info string, deleted boolean, text string"
    live = LiveIndex(spark, f"file://{tmp_path}/live")
    live.MOST_BATCHES = 2
    for n in range(7):
        live.apply(spark.createDataFrame([(n % 3, "p", 1, None, None, n == 5, f"w{chr(97 + n)} all")], schema), n)
        last = {k: max(i for i in range(n + 1) if i % 3 == k) for k in range(min(3, n + 1))}
        want = Counter((w, k) for k, i in last.items() if i != 5 for w in (f"w{chr(97 + i)}", "all"))
        assert rows(live.postings().select("word", "file_id")) == want
    live.apply(spark.createDataFrame([(0, "p", 1, None, None, False, "again")], schema), 6)
    assert rows(live.postings().filter("file_id = 0").select("word")) == Counter({("again",): 1})
