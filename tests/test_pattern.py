"""The pattern language: trees, validity, and the worked examples of its description."""

import pytest

from textdex.plans import pattern as P
from textdex.plans.compile import compile

T = P.Term


@pytest.mark.parametrize(("text", "tree"), [
    ("a", T("a")),
    ("a;b", P.And(T("a"), T("b"))),
    ("a;b,c", P.And(T("a"), P.Or(T("b"), T("c")))),
    ("a,b;c", P.Or(T("a"), P.And(T("b"), T("c")))),
    ("{a,b};c", P.And(P.Or(T("a"), T("b")), T("c"))),
    ("{a,b}", P.Or(T("a"), T("b"))),
    ("a;~b", P.And(T("a"), P.Not(T("b")))),
    ("~{a;b}", P.Not(P.And(T("a"), T("b")))),
    ("~{~a}", T("a")),
    ("a; b c ,d", P.And(T("a"), P.Or(T("b c "), T("d")))),
    (r"a\;b", T(r"a\;b")),
    ("author=x;y", P.And(T("x", "author"), T("y"))),
    ("[;,]x", T("[;,]x")),
])
def test_tree(text, tree):
    assert P.parse(text) == tree


@pytest.mark.parametrize("text", ["", "~~a", "{a", "a;", ";a", "a}"])
def test_bad_tree(text):
    with pytest.raises(P.PatternError):
        P.parse(text)


@pytest.mark.parametrize("bad", [{"word": True, "whole": True}, {"errors": 9}, {"errors": -1}, {"insert": 0}])
def test_bad_options(bad):
    with pytest.raises(P.PatternError):
        P.Options(**bad)


def test_validity():
    for text, o in [("ab", {"errors": 2}), ("a(b|c)*d", {"errors": 5}), ("^$", {})]:
        with pytest.raises(P.PatternError):
            P.validate(P.parse(text), P.Options(**o))


# pattern, options, records that match, records that do not
GOLDEN = [
    ("parent", {"word": True, "icase": True}, ["Parent", "PARENT", "parent/child"], ["parenthesis", "parents"]),
    ("Tuson;Arezona", {"errors": 1}, ["Tucson Arizona"], ["Phoenix"]),
    ("car", {"word": True}, ["car"], ["characters", "car10"]),
    ("car", {"word": True, "errors": 1}, ["cars"], ["characters"]),
    ("<mathemat>ics", {"errors": 1}, ["mathematical"], ["mathamatics"]),
    ("mathe<matics>", {"errors": 1}, ["mathimatics", "mathematics"], ["mathematical"]),
    ("mathe<matics>", {"errors": 4}, [], ["mathematical"]),
    ("a(b|c)*d", {"constant": True}, ["x a(b|c)*d y"], ["abcd"]),
    ("ab.de", {}, ["abcde"], ["abde"]),
    (r"ab\.de", {}, ["ab.de"], ["abcde"]),
    ("ab*de", {}, ["abbde", "ade"], ["ab*de"]),
    (r"ab\*de", {}, ["ab*de"], ["abbde"]),
    ("ex#e", {}, ["example"], ["exam"]),
    ("DCS", {"supersequence": True}, ["Department of Computer Science."], ["Science Department"]),
    ("abcdefghij", {"errors": 5, "supersequence": True}, ["academia", "sacrilegious"], ["zzz"]),
    ("abc[0-9](de|fg)*[x-z]", {"errors": 1}, ["abc1defgx"], ["zzzz"]),
    ("ABCD#YZ", {"errors": 1, "delete": 2, "substitute": 2}, ["ABCD..YZ", "ABxCD..YZ"], ["ABxD..YZ"]),
    ("homogenos", {"errors": 2}, ["homogeneous"], ["heterogen"]),
    ("{political,computer};science", {}, ["political science", "science of computers"], ["politics"]),
    ("bad;~boy", {}, ["bad girl"], ["bad boy"]),
    ("^The", {}, ["The end"], ["At The end"]),
    ("end$", {}, ["The end"], ["ending"]),
    ("^One$", {}, ["One"], ["One "]),
    ("Two", {"whole": True}, ["Two"], ["Twofold"]),
    ("[^a-c]x", {}, ["dx"], ["ax", "x"]),
    ("été", {"icase": True}, ["ÉTÉ"], ["ete"]),
    ("onépa", {"errors": 1}, ["onepa"], ["onxxxpa"]),
]


@pytest.mark.parametrize(("text", "options", "yes", "no"), GOLDEN)
def test_golden(spark, text, options, yes, no):
    rows = spark.createDataFrame([(r,) for r in yes + no], "rec string").withColumn("hit", compile(text, **options))
    assert {r.rec: r.hit for r in rows.collect()} == {r: r in yes for r in yes + no}


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",)], "rec string")
    for o in ({}, {"errors": 1}, {"word": True}, {"supersequence": True}):
        assert [r[0] for r in rows.select(compile("abc", **o)).collect()] == [False, False]


def test_inverse_listing(spark):
    """Records One, Two, Three and the complement of each pattern."""
    rows = spark.createDataFrame([("One",), ("Two",), ("Three",)], "rec string")
    want = {"O": ["Two", "Three"], "e": ["Two"], "n": ["Two", "Three"], "w": ["One", "Three"], "o": ["One", "Three"], "r": ["One", "Two"]}
    for p, left in want.items():
        assert [r.rec for r in rows.filter(~compile(p)).collect()] == left


@pytest.mark.parametrize(("glob", "out"), [("*.o", (".o", True)), ("a?b", ("a.b", False)), ("^x*y$", ("^x.*y$", False)), ("a.b*", ("a.b", True))])
def test_glob(glob, out):
    assert P.glob_to_pattern(glob) == out


def test_delimiter():
    assert P.delimiter("$$") == "\n\n"
    assert P.delimiter(r"\$$") == "$\n"
