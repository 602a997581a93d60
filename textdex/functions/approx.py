"""Matching with a bounded number of edits.

Records that cannot match are ruled out by built-in string functions: of the pattern's errors + 1 pieces one must occur
as it stands. What is left goes through a bit-parallel program (one column of higher-order functions, no Python) or, for
weighted edits, parts without errors and regular expressions, through a vectorised function with a dynamic program for
each distinct record.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textdex.plans import pattern as P

#: Longest pattern of the bit-parallel column.
BITS = 62


def prefilter(rec: Column, parts: list[tuple], o: P.Options) -> Column:
    """A condition every match fulfils; true where nothing can be said."""
    found = P.required_pieces(parts, o.errors // min(o.insert, o.delete, o.substitute))
    if not found or "" in found:
        return F.lit(True)
    if o.icase:
        found, rec = [p.lower() for p in found], F.lower(rec)
    out = F.lit(False)
    for piece in found:
        out = out | rec.contains(piece)
    return out


def bit_parallel(rec: Column, text: str, errors: int, icase: bool = False) -> Column:
    """Whether a part of `rec` is within `errors` unit edits of the literal `text` (up to 62 characters)."""
    if len(text) > BITS or errors >= len(text):
        raise P.PatternError("the pattern does not fit the bit-parallel program")
    text, rec = (text.lower(), F.lower(rec)) if icase else (text, rec)
    masks = {c: sum(1 << i for i, x in enumerate(text) if x == c) for c in dict.fromkeys(text)}
    top = F.lit(1 << (len(text) - 1)).cast("long")

    def mask(c: Column) -> Column:
        out = F.lit(0).cast("long")
        for x, m in masks.items():
            out = F.when(c == x, F.lit(m).cast("long")).otherwise(out)
        return out

    names = [f"r{j}" for j in range(errors + 1)]

    def step(acc: Column, c: Column) -> Column:
        m, new = mask(c), []
        for j, name in enumerate(names):
            old = acc[name]
            r = F.shiftleft(old, 1).bitwiseOR(F.lit(1).cast("long")).bitwiseAND(m)
            if j:
                below = acc[names[j - 1]]
                r = r.bitwiseOR(below).bitwiseOR(F.shiftleft(below.bitwiseOR(new[-1]), 1)).bitwiseOR(F.lit((1 << j) - 1).cast("long"))
            new.append(r)
        return F.struct(*[r.alias(n) for r, n in zip(new, names, strict=True)], (acc["hit"] | (new[-1].bitwiseAND(top) != 0)).alias("hit"))

    zero = F.struct(*[F.lit((1 << j) - 1).cast("long").alias(n) for j, n in enumerate(names)], F.lit(False).alias("hit"))
    return F.aggregate(F.split(rec, ""), zero, step)["hit"]


def _positions(parts: list[tuple], icase: bool) -> list[tuple]:
    """(test, zone) for each position; ("gap", zone) for #."""
    out, depth = [], 0
    for p in parts:
        if p[0] == "zone":
            depth = max(0, depth + p[1])
        elif p[0] == "gap":
            out.append(("gap", depth > 0))
        else:
            out.append((_tester(p, icase), depth > 0))
    return out


def _tester(p: tuple, icase: bool):
    if p[0] == "any":
        return lambda c: True
    if p[0] == "char":
        want = p[1].lower() if icase else p[1]
        return lambda c: c == want
    body, chars, spans, i = p[1].lower() if icase else p[1], set(), [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            spans.append((body[i], body[i + 2]))
            i += 3
        else:
            chars.add(body[i])
            i += 1
    return lambda c, n=p[2]: (c in chars or any(a <= c <= b for a, b in spans)) != n


class Lazy:
    """A deterministic automaton made as it is needed: states are whatever `step` returns, and each transition is computed
    once. value gives the cost a state stands for."""

    MOST = 200_000

    def __init__(self, start, step, value):
        self.start, self.step, self.value, self.known = start, step, value, {}

    def next(self, state, c: str):
        pair = self.known.get((state, c))
        if pair is None:
            if len(self.known) > self.MOST:
                self.known.clear()
            new = self.step(state, c)
            pair = self.known[state, c] = (new, self.value(new))
        return pair[0]

    def run(self, text: str, each: bool = True) -> int:
        """Least value over all states passed (each), or the value of the last one."""
        known, state = self.known, self.start
        best = self.value(state)
        for c in text:
            pair = known.get((state, c))
            if pair is None:
                if len(known) > self.MOST:
                    known.clear()
                new = self.step(state, c)
                pair = known[state, c] = (new, self.value(new))
            state = pair[0]
            if each:
                if pair[1] < best:
                    best = pair[1]
                    if not best:
                        return 0
            else:
                best = pair[1]
        return best


def weighted(positions: list[tuple], most: int, insert: int, delete: int, substitute: int, begin: bool = False, end: bool = False):
    """str -> least cost of edits that make a part of it match, most + 1 if above `most`. In a zone no edit is allowed; a
    gap takes any characters at no cost. begin, end: the match starts or ends with the text."""
    lazy = weighted_lazy(positions, most, insert, delete, substitute, begin)
    return lambda text: lazy.run(text, not end)


def weighted_lazy(positions: list[tuple], most: int, insert: int, delete: int, substitute: int, begin: bool = False) -> Lazy:
    """The automaton of `weighted`: a state's value is the least cost of a match that ends there."""
    far, m = most + 1, len(positions)
    zones = [z for _, z in positions]

    def first() -> tuple:
        col = [0] + [far] * m
        for j, (t, z) in enumerate(positions):
            col[j + 1] = col[j] if t == "gap" else far if z else min(far, col[j] + delete)
        return tuple(col)

    def step(old: tuple, c: str) -> tuple:
        col = [min(far, old[0] + insert) if begin else 0] + [far] * m
        for j, (t, z) in enumerate(positions):
            if t == "gap":
                col[j + 1] = min(old[j + 1], col[j], old[j])
                continue
            cost = old[j] if t(c) else far if z else old[j] + substitute
            if not z:
                cost = min(cost, col[j] + delete)
            if not (z and j + 1 < m and zones[j + 1]):  # between two positions of a zone nothing may be put in
                cost = min(cost, old[j + 1] + insert)
            col[j + 1] = min(cost, far)
        return tuple(col)

    return Lazy(first(), step, lambda col: col[m])


class Automaton:
    """A term with | * () as a nondeterministic automaton, matched with unit edits (Thompson's construction)."""

    def __init__(self, parts: list[tuple], icase: bool):
        self.step: list[tuple] = []  # state -> (test, next) or None
        self.free: list[list[int]] = []
        self.parts, self.at, self.icase = [p for p in parts if p[0] != "zone"], 0, icase
        self.start, self.end = self._alternatives()
        if self.at < len(self.parts):
            raise P.PatternError("an unmatched ) in a regular expression")
        self.closure = [self._close(s) for s in range(len(self.step))]

    def _state(self) -> int:
        self.step.append(None)
        self.free.append([])
        return len(self.step) - 1

    def _alternatives(self) -> tuple[int, int]:
        a, b = self._state(), self._state()
        while True:
            s, e = self._sequence()
            self.free[a].append(s)
            self.free[e].append(b)
            if self.at < len(self.parts) and self.parts[self.at] == ("op", "|"):
                self.at += 1
                continue
            return a, b

    def _sequence(self) -> tuple[int, int]:
        first = last = self._state()
        while self.at < len(self.parts) and self.parts[self.at] not in (("op", "|"), ("op", ")")):
            p = self.parts[self.at]
            self.at += 1
            if p == ("op", "("):
                s, e = self._alternatives()
                if self.at >= len(self.parts):
                    raise P.PatternError("a missing ) in a regular expression")
                self.at += 1
            else:
                s, e = self._state(), self._state()
                if p[0] == "gap":
                    self.step[s] = (lambda c: True, s)
                    self.free[s].append(e)
                elif p == ("op", "*"):
                    raise P.PatternError("a * with nothing before it")
                else:
                    self.step[s] = (_tester(p, self.icase), e)
            if self.at < len(self.parts) and self.parts[self.at] == ("op", "*"):
                self.at += 1
                s2, e2 = self._state(), self._state()
                self.free[s2] += [s, e2]
                self.free[e] += [s, e2]
                s, e = s2, e2
            self.free[last].append(s)
            last = e
        return first, last

    def _close(self, s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def matcher(self, most: int):
        """str -> least number of edits that make a part of it match; most + 1 if above."""
        return self.lazy(most).run

    def lazy(self, most: int) -> Lazy:
        """The automaton made deterministic: a state's value is the least number of edits of a match that ends there."""

        def spread(layers: list[set[int]]) -> tuple:
            for k in range(len(layers)):
                layers[k] = set().union(*[self.closure[s] for s in layers[k]]) if layers[k] else set()
                if k + 1 < len(layers):  # a position left out
                    layers[k + 1] |= {self.step[s][1] for s in layers[k] if self.step[s]}
            return tuple(map(frozenset, layers))

        def step(layers: tuple, c: str) -> tuple:
            new: list[set[int]] = [{self.start}] + [set() for _ in range(most)]
            for k, states in enumerate(layers):
                for s in states:
                    if self.step[s]:
                        test, to = self.step[s]
                        if test(c):
                            new[k].add(to)
                        if k < most:
                            new[k + 1].add(to)
                    if k < most:
                        new[k + 1].add(s)
            return spread(new)

        start = spread([{self.start}] + [set() for _ in range(most)])
        return Lazy(start, step, lambda layers: next((k for k, x in enumerate(layers) if self.end in x), most + 1))


def distance_function(text: str, o: P.Options):
    """str -> least cost of a match of the term, errors + 1 if above the errors allowed."""
    begin, parts, end = P.lex(text, o.constant)
    if P.is_regex(parts):
        of = Automaton(parts, o.icase).matcher(o.errors)
    else:
        of = weighted(_positions(parts, o.icase), o.errors, o.insert, o.delete, o.substitute, begin, end)
    return (lambda s: of(s.lower())) if o.icase else of


def end_function(text: str, o: P.Options):
    """str -> number of characters up to the first end of a match within the errors allowed, None if there is none."""
    begin, parts, end = P.lex(text, o.constant)
    if P.is_regex(parts):
        lazy = Automaton(parts, o.icase).lazy(o.errors)
    else:
        lazy = weighted_lazy(_positions(parts, o.icase), o.errors, o.insert, o.delete, o.substitute, begin)

    def first(s: str) -> int | None:
        state = lazy.start
        for n, c in enumerate([None, *(s.lower() if o.icase else s)]):
            if c is not None:
                state = lazy.next(state, c)
            if lazy.value(state) <= o.errors and (not end or n == len(s)):
                return n
        return None

    return first


def match_end(rec: Column, text: str, o: P.Options) -> Column:
    """Number of characters up to the first end of a match of the term within the errors allowed; null without one. With the
    options word and whole the word or record ends there."""

    @F.pandas_udf("int")
    def at(s: pd.Series) -> pd.Series:
        import re

        if o.word:
            of, words = functools.cache(distance_function(f"^{text}$", o)), re.compile(r"[^\W_]+")
            end = lambda v: next((m.end() for m in words.finditer(v) if of(m.group()) <= o.errors), None)
        else:
            end = end_function(f"^{text}$" if o.whole else text, o)
        return s.map(lambda v: None if v is None else end(v)).astype("Int32")

    return at(rec)


def distance(rec: Column, text: str, o: P.Options) -> Column:
    """Least cost of a match of the term in `rec`, errors + 1 if above the errors allowed; null for null."""

    @F.pandas_udf("int")
    def cost(s: pd.Series) -> pd.Series:
        of = functools.cache(distance_function(text, o))
        return s.map(lambda v: None if v is None else of(v)).astype("Int32")

    return cost(rec)


def term_distance(rec: Column, text: str, o: P.Options) -> Column:
    """Least cost of a match of the term under the options, errors + 1 if above the errors allowed; null for null."""
    if not o.word:
        return distance(rec, f"^{text}$" if o.whole else text, o)

    @F.pandas_udf("int")
    def cost(s: pd.Series) -> pd.Series:
        import re

        of, words = functools.cache(distance_function(f"^{text}$", o)), re.compile(r"[^\W_]+")
        return s.map(lambda v: None if v is None else min(map(of, words.findall(v)), default=o.errors + 1)).astype("Int32")

    return cost(rec)


def matches(rec: Column, text: str, o: P.Options) -> Column:
    """Whether `rec` matches the term within the errors allowed."""
    begin, parts, end = P.lex(text, o.constant)
    unit = o.insert == o.delete == o.substitute == 1
    may = prefilter(rec, parts, o)
    plain = all(p[0] == "char" for p in parts) and not (begin or end)
    if plain and unit and len(parts) <= BITS and o.errors <= 4 and not (o.word or o.whole):
        return may & bit_parallel(rec, P.literal(parts), o.errors, o.icase)
    if o.whole:
        return may & (distance(rec, f"^{text}$", o) <= o.errors)
    if o.word:
        return may & word_within(rec, text, o)
    return may & (distance(rec, text, o) <= o.errors)


def word_within(rec: Column, text: str, o: P.Options) -> Column:
    """Whether a word of `rec` as a whole is within the errors of the term."""

    @F.pandas_udf("boolean")
    def has(s: pd.Series) -> pd.Series:
        import re

        of = functools.cache(distance_function(f"^{text}$", o))
        words = re.compile(r"[^\W_]+")
        return s.map(lambda v: None if v is None else any(of(w) <= o.errors for w in words.findall(v))).astype("boolean")

    return has(rec)


def subsequence_within(rec: Column, text: str, errors: int, icase: bool = False) -> Column:
    """Whether all but `errors` characters of `text` occur in `rec` in order, others between them: the longest common
    subsequence, bit-parallel in one column of built-in functions."""
    text, rec = (text.lower(), F.lower(rec)) if icase else (text, rec)
    if len(text) > BITS:
        return common_subsequence(rec, text) >= len(text) - errors
    full = F.lit((1 << len(text)) - 1).cast("long")
    masks = {c: sum(1 << i for i, x in enumerate(text) if x == c) for c in dict.fromkeys(text)}

    def step(v: Column, c: Column) -> Column:
        m = F.lit(0).cast("long")
        for x, bits in masks.items():
            m = F.when(c == x, F.lit(bits).cast("long")).otherwise(m)
        # zero bits count the common subsequence
        return (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full)

    left = F.aggregate(F.split(rec, ""), full, step)
    return F.bit_count(left) <= errors


def common_subsequence(rec: Column, text: str) -> Column:
    """Length of the longest common subsequence with `text`, of any length; the same program on integers without bound."""

    @F.pandas_udf("int")
    def longest(s: pd.Series) -> pd.Series:
        full = (1 << len(text)) - 1
        masks: dict[str, int] = {}
        for i, x in enumerate(text):
            masks[x] = masks.get(x, 0) | 1 << i

        def of(v: str) -> int:
            left = full
            for c in v:
                m = left & masks.get(c, 0)
                left = (left + m | left & ~masks.get(c, 0)) & full
            return len(text) - left.bit_count()

        return s.map(lambda v: None if v is None else of(v)).astype("Int32")

    return longest(rec)
