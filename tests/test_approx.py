"""Approximate matching against a plain dynamic program."""

from hypothesis import given, settings
from hypothesis import strategies as st

from textdex.functions import approx
from textdex.plans import pattern as P


def plain(pattern: str, text: str, ins=1, dele=1, sub=1) -> int:
    col = [j * dele for j in range(len(pattern) + 1)]
    best = col[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern):
            new.append(min(col[j] + (0 if p == c else sub), new[j] + dele, col[j + 1] + ins))
        col = new
        best = min(best, col[-1])
    return best


letters = st.text("abcé", min_size=1, max_size=6)
texts = st.text("abcé ", max_size=14)


@settings(max_examples=200, deadline=None)
@given(letters, texts, st.integers(0, 4), st.integers(1, 3), st.integers(1, 3), st.integers(1, 3))
def test_weighted(pattern, text, k, i, d, s):
    o = P.Options(errors=k, insert=i, delete=d, substitute=s)
    assert approx.distance_function(pattern, o)(text) == min(k + 1, plain(pattern, text, i, d, s))


@settings(max_examples=150, deadline=None)
@given(letters, texts, st.integers(0, 3))
def test_automaton_without_operators(pattern, text, k):
    parts = P.lex(pattern)[1]
    assert approx.Automaton(parts, False).matcher(k)(text) == min(k + 1, plain(pattern, text))


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(0, 2))
def test_automaton_alternatives(text, k):
    """(ab|c)*a is at the distance of the nearest of its words."""
    words = ["a", "aba", "ca", "ababa", "abca", "caba", "cca", "cababa", "abcca"]
    got = approx.Automaton(P.lex("b(ab|c)*a")[1], False).matcher(k)(text)
    assert got <= min(k + 1, *[plain("b" + w, text) for w in words])


def test_columns(spark):
    """The bit-parallel columns give what the dynamic programs give."""
    import random

    random.seed(1)
    made = ["".join(random.choice("abcdé ") for _ in range(random.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in made], "rec string")
    for pattern in ("abcd", "éab", "dcbadcba"):
        for k in (1, 2):
            got = rows.select(approx.bit_parallel(rows.rec, pattern, k).alias("x"), approx.prefilter(rows.rec, P.lex(pattern)[1], P.Options(errors=k)).alias("may")).collect()
            want = [plain(pattern, t) <= k for t in made]
            assert [r.x for r in got] == want
            assert all(r.may for r, w in zip(got, want, strict=True) if w)

    def common(a, b):
        col = [0] * (len(a) + 1)
        for c in b:
            new = [0]
            for j, p in enumerate(a):
                new.append(col[j] + 1 if p == c else max(new[j], col[j + 1]))
            col = new
        return col[-1]

    got = rows.select(approx.subsequence_within(rows.rec, "abcdab", 2)).collect()
    assert [r[0] for r in got] == [common("abcdab", t) >= 4 for t in made]
