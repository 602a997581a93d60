"""From a pattern tree to Spark columns: the cheapest expression that has the meaning."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from textdex.functions import approx
from textdex.plans import pattern as P

#: Java: only \\n ends a line, as the records are split there.
UNIX = "(?d)"
WORD_BEFORE, WORD_AFTER = r"(?<![\p{L}\p{Nd}])", r"(?![\p{L}\p{Nd}])"


def term_column(text: str, rec: Column, o: P.Options) -> Column:
    """Whether `rec` matches one term. Null matches nothing (null)."""
    begin, parts, end = P.lex(text, o.constant)
    if o.supersequence and not o.errors:
        body = ".*".join(P.quote(c) for c in P.literal(parts))
        return rec.rlike(f"{UNIX}{'(?iu)' if o.icase else ''}{body}")
    if o.supersequence:
        return approx.subsequence_within(rec, P.literal(parts), o.errors, o.icase)
    if o.errors:
        return approx.matches(rec, text, o)
    plain = P.is_literal(parts)
    lit = P.literal(parts)
    if plain and not o.word:
        value = F.lower(rec) if o.icase else rec
        lit = lit.lower() if o.icase else lit
        if o.whole or (begin and end):
            return value == F.lit(lit)
        return value.startswith(lit) if begin else value.endswith(lit) if end else value.contains(lit)
    body = P.to_regex(text, o.constant)
    if o.whole:
        body = f"^({body})$"
    elif o.word:
        body = f"{WORD_BEFORE}({body}){WORD_AFTER}"
    return rec.rlike(UNIX + ("(?iu)" if o.icase else "") + body)


def query_column(q: P.Query, rec: Column, o: P.Options, attribute: Column | None = None) -> Column:
    """Whether `rec` satisfies the tree. attribute: the name of the attribute `rec` is the value of; terms limited to an
    attribute match only there. A null record satisfies nothing."""
    if isinstance(q, P.Not):
        return ~query_column(q.of, rec, o, attribute)
    if isinstance(q, P.And):
        return query_column(q.left, rec, o, attribute) & query_column(q.right, rec, o, attribute)
    if isinstance(q, P.Or):
        return query_column(q.left, rec, o, attribute) | query_column(q.right, rec, o, attribute)
    hit = F.coalesce(term_column(q.text, rec, o), F.lit(False))
    if q.attribute is not None:
        if attribute is None:
            raise P.PatternError(f"{q.attribute}= needs structured records")
        hit = hit & F.coalesce(F.lower(attribute) == F.lit(q.attribute.lower()), F.lit(False))
    return hit


def query_prefilter(q: P.Query, rec: Column, o: P.Options) -> Column:
    """What every record that satisfies the tree within the errors fulfils, in built-in functions."""
    if isinstance(q, P.Not):
        return F.lit(True)
    if isinstance(q, P.Term):
        return approx.prefilter(rec, P.lex(q.text, o.constant)[1], o)
    a, b = query_prefilter(q.left, rec, o), query_prefilter(q.right, rec, o)
    return a & b if isinstance(q, P.And) else a | b


def compile(text: str, rec: Column | str = "rec", attribute: Column | None = None, **options) -> Column:
    """A Boolean column: whether `rec` matches the pattern `text` under the options (see pattern.Options)."""
    o = P.Options(**options)
    q = P.parse(text, o.constant)
    P.validate(q, o)
    return query_column(q, F.col(rec) if isinstance(rec, str) else rec, o, attribute)


def match_end(q: P.Query, rec: Column, o: P.Options) -> Column:
    """Number of characters of `rec` up to the end of the match: the first end of a term's first match; the later one of the
    two sides of an AND, the earlier one of those of an OR that match; null for a NOT and for a record without a match."""
    if isinstance(q, P.Not):
        return F.lit(None).cast("int")
    if isinstance(q, (P.And, P.Or)):
        a, b = match_end(q.left, rec, o), match_end(q.right, rec, o)
        return F.greatest(a, b) if isinstance(q, P.And) else F.least(a, b)
    begin, parts, end = P.lex(q.text, o.constant)
    if o.supersequence and o.errors:
        raise P.PatternError("a match within errors that others may come into has no one end")
    if o.errors:
        return approx.match_end(rec, q.text, o)
    if o.supersequence:
        body = ".*?".join(P.quote(c) for c in P.literal(parts))
    else:
        body = P.to_regex(q.text, o.constant)
        body = f"^({body})$" if o.whole else f"{WORD_BEFORE}({body}){WORD_AFTER}" if o.word else body
    body = UNIX + ("(?iu)" if o.icase else "") + body
    # what is left after the first match: its length is independent of where groups begin
    at = F.regexp_instr(rec, F.lit(body))
    return F.when(at > 0, at - 1 + F.length(F.regexp_substr(rec, F.lit(body)))).cast("int")


def balanced(conditions: list[Column]) -> Column:
    """The OR of conditions as a tree of little depth; none is false."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        conditions = [conditions[i] | conditions[i + 1] if i + 1 < len(conditions) else conditions[i] for i in range(0, len(conditions), 2)]
    return conditions[0]


#: Strings that are tested one by one; more go through one automaton.
FEW = 64


def any_of(words: list[str], rec: Column, icase: bool = False) -> Column:
    """Whether `rec` contains at least one of the strings; none matches nothing. Null for null."""
    words = list(dict.fromkeys(w.lower() if icase else w for w in words))
    value = F.lower(rec) if icase else rec
    if len(words) <= FEW:
        return balanced([value.contains(w) for w in words])

    @F.pandas_udf("boolean")
    def holds(s):
        find = automaton(tuple(words)).iter
        return s.map(lambda v: None if v is None else "" in words or next(find(v), None) is not None).astype("boolean")

    return holds(value)


@functools.lru_cache(4)
def automaton(words: tuple[str, ...]):
    """The automaton of the strings, each with its place in the list; empty ones are left out."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for n, w in enumerate(words):
        if w:
            a.add_word(w, n)
    a.make_automaton()
    return a


def all_in(words: list[str], rec: Column, icase: bool = False) -> Column:
    """Array of those of the strings that `rec` contains, in the order of the list. Null for null."""
    value = F.lower(rec) if icase else rec
    keys = [w.lower() if icase else w for w in words]
    if len(words) <= FEW:
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(keys, words, strict=True)])
        return F.transform(F.filter(pairs, lambda p: F.contains(value, p["k"])), lambda p: p["w"])
    places: dict[str, list[int]] = {}
    for n, k in enumerate(keys):
        places.setdefault(k, []).append(n)
    listed = tuple(places)

    @F.pandas_udf("array<string>")
    def found(s):
        find = automaton(listed).iter
        none = places.get("", [])
        return s.map(lambda v: None if v is None else [words[n] for n in sorted(none + [n for k in {k for _, k in find(v)} for n in places[listed[k]]])])

    return found(value)
