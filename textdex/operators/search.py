"""Two-level search: an index (or none) gives a superset of the files, the records decide.

The answer never depends on the index: level 1 only uses words every match must contain, as parts of index words unless
the pattern bounds them, and stands aside where it can say nothing (errors, alternatives, stop words).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textdex.functions import approx
from textdex.functions import text as T
from textdex.operators import attributes as A
from textdex.operators import index as I
from textdex.plans import pattern as P
from textdex.plans.compile import all_in, balanced, compile, query_column, query_prefilter, term_column
from textdex.session import rows_below, written


@dataclass
class Candidates:
    """Files that may hold a match: a list of at most index.MOST_PUSHED ids, which a scan can be pruned by, or rows."""

    ids: list[int] | None
    rows: DataFrame | None

    def of(self, files: DataFrame) -> DataFrame:
        """The candidates among `files`."""
        if self.ids is not None:
            return files.filter(I.one_of(F.col("file_id"), self.ids))
        return files.join(self.rows, "file_id", "left_semi")

    def as_rows(self, files: DataFrame) -> DataFrame:
        """(file_id) of the candidates."""
        return self.of(files.select("file_id")).distinct()


def candidate_files(q: P.Query, o: P.Options, idx: I.Index, stop: DataFrame | None = None) -> Candidates | None:
    """The files that may hold a match by the index, None where it can say nothing. Terms of an AND may be in different
    records. The vocabulary is looked up once for all words, then the postings of the words found; lists of an AND that are
    much longer than its shortest one are left out. Stop words (word) prune nothing."""
    tree = P.needed(q, o, T.MAX_WORD)
    if tree is not None and stop is not None:
        words = {w for w, _ in _leaves(tree)}
        stopped = {r["word"] for r in stop.filter(F.col("word").isin(sorted(words))).collect()}  # at most one row a term word
        tree = P.needed(q, o, T.MAX_WORD, frozenset(stopped))
    if tree is None:
        return None
    found = idx.words(list(_leaves(tree)))
    if found is None:  # parts of very many words: those that are not can still prune
        found, tree = _narrow(tree, idx)
        if tree is None:
            return None
    size = lambda leaf: sum(found[leaf[1:]].values())
    tree, most = _shortest(tree, size)
    leaves = list(_leaves(tree))
    words = {w for leaf in leaves for w in found[leaf]}
    hits = idx.posted(words)
    if any(t[0] == "all" for t in _nodes(tree)):
        flags = [F.bool_or(I.one_of(F.col("word"), sorted(found[leaf]))).alias(f"__w{n}") for n, leaf in enumerate(leaves)]
        hits = hits.groupBy("file_id").agg(*flags).filter(_holds(tree, leaves))
    rows = hits.select("file_id").unionByName(idx.long_files.select("file_id")).distinct()
    if most <= I.MOST_PUSHED:
        ids = [r["file_id"] for r in rows.limit(I.MOST_PUSHED + 1).collect()]
        if len(ids) <= I.MOST_PUSHED:
            return Candidates(sorted(ids), None)
    return Candidates(None, rows)


def _nodes(tree: tuple):
    yield tree
    if tree[0] != "word":
        for t in tree[1]:
            yield from _nodes(t)


def _leaves(tree: tuple) -> dict[tuple[str, bool], None]:
    return dict.fromkeys(t[1:] for t in _nodes(tree) if t[0] == "word")


def _holds(tree: tuple, leaves: list) -> Column:
    if tree[0] == "word":
        return F.col(f"__w{leaves.index(tree[1:])}")
    parts = [_holds(t, leaves) for t in tree[1]]
    return functools.reduce((lambda a, b: a & b) if tree[0] == "all" else (lambda a, b: a | b), parts)


def _shortest(tree: tuple, size) -> tuple[tuple, int]:
    """The tree without lists of an AND that are much longer than its shortest, and the most files it can give."""
    if tree[0] == "word":
        return tree, size(tree)
    parts = [_shortest(t, size) for t in tree[1]]
    if tree[0] == "any":
        return ("any", [t for t, _ in parts]), sum(n for _, n in parts)
    least = min(n for _, n in parts)
    kept = sorted([(n, k) for k, (_, n) in enumerate(parts) if n <= I.LONGER * max(1, least)])
    return ("all", [parts[k][0] for _, k in kept]), least


def _narrow(tree: tuple, idx: I.Index) -> tuple[dict, tuple | None]:
    """The words of those leaves that are parts of few words, and the tree of them; None if nothing is left."""
    leaves = list(_leaves(tree))
    word = F.col("word")
    counts = idx.vocab.agg(*[F.sum(I.holds(word, *leaf).cast("long")).alias(f"n{n}") for n, leaf in enumerate(leaves)]).first()
    few = [leaf for n, leaf in enumerate(leaves) if (counts[n] or 0) <= I.MOST_PUSHED // len(leaves)]

    def cut(t: tuple) -> tuple | None:
        if t[0] == "word":
            return t if t[1:] in few else None
        parts = [cut(x) for x in t[1]]
        if t[0] == "any":
            return None if None in parts else ("any", parts)
        parts = [x for x in parts if x is not None]
        return ("all", parts) if parts else None

    left = cut(tree)
    return (idx.words(list(_leaves(left))) if left else {}), left


def _parsed(pattern: str, options: dict) -> tuple[P.Query, P.Options]:
    o = P.Options(**options)
    q = P.parse(pattern, o.constant)
    P.validate(q, o)
    return q, o


def narrowed(files: DataFrame, q: P.Query, o: P.Options, index: I.Index | None, stop: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """`files` that may hold a match by the index, and are among the hints (file_id)."""
    found = candidate_files(q, o, index, stop) if index else None
    if found is not None:
        files = found.of(files)
    if hints is not None:
        files = files.join(I.maybe_broadcast(hints.select("file_id").distinct()), "file_id", "left_semi")
    return files


def search(files: DataFrame, pattern: str, index: I.Index | None = None, delim: str = "\n", offsets: bool = False, stop: DataFrame | None = None, hints: DataFrame | None = None, **options) -> DataFrame:
    """(file_id, rec_no, rec), with offsets also (begin, end): the records that match, of files (file_id, text, ...).

    index prunes files first; hints is a set of candidate files (file_id) found elsewhere. Null texts match nothing.
    """
    q, o = _parsed(pattern, options)
    files = narrowed(files.select("file_id", "text"), q, o, index, stop, hints)
    recs = T.records(files, delim, offsets)
    return searched(recs, q, o)


def searched(recs: DataFrame, q: P.Query, o: P.Options) -> DataFrame:
    """The records (rec, ...) that satisfy the tree; what built-in functions can rule out never reaches Python."""
    if o.errors and not o.supersequence:
        recs = recs.filter(query_prefilter(q, F.col("rec"), o))
    return recs.filter(query_column(q, F.col("rec"), o))


def search_whole(files: DataFrame, pattern: str, delim: str = "\n", index: I.Index | None = None, stop: DataFrame | None = None, offsets: bool = False, **options) -> DataFrame:
    """(file_id, rec_no, rec), with offsets also (begin, end): the pattern judged over whole files; of the files that satisfy
    it, every record with one of its terms. A file without any such record gives nothing. index prunes files first.

    Without errors a file is judged in place, over the array of its records, so nothing is shuffled or read twice."""
    q, o = _parsed(pattern, options)
    ts = P.terms(q)
    files = narrowed(files.select("file_id", "text"), q, o, index, stop)
    if not o.errors:
        lines = T.record_array(F.col("text"), delim)
        test = lambda t: lambda r: F.coalesce(term_column(t.text, r, o), F.lit(False))
        hit = [F.coalesce(F.exists(lines, test(t)), F.lit(False)) for t in ts]
        recs = T.records(files.filter(_judged(q, ts, hit)), delim, offsets)
        return recs.filter(balanced([F.coalesce(term_column(t.text, F.col("rec"), o), F.lit(False)) for t in ts]))
    recs = T.records(files, delim, offsets)
    for n, t in enumerate(ts):
        recs = recs.withColumn(f"__t{n}", F.coalesce(term_column(t.text, F.col("rec"), o), F.lit(False)))
    names = [F.col(f"__t{n}") for n in range(len(ts))]
    hits = written(recs.filter(balanced(names)), "whole-hits")  # judged, and given
    flags = hits.groupBy("file_id").agg(*[F.bool_or(c).alias(f"__t{n}") for n, c in enumerate(names)])
    good = flags.filter(_judged(q, ts, names)).select("file_id")
    return hits.join(good, "file_id", "left_semi").drop(*[f"__t{n}" for n in range(len(ts))])


def search_near(files: DataFrame, pattern: str, limit: int = 256, index: I.Index | None = None, delim: str = "\n", **options) -> DataFrame:
    """(file_id, rec_no, rec): records with an occurrence of the first word of an AND that has an occurrence of every other
    word of it within `limit` characters in the file. Words are looked for as parts of index words."""
    q, o = _parsed(pattern, options)
    ts = P.terms(q)
    if any(not isinstance(x, (P.And, P.Term)) for x in P.nodes(q)) or any(not P.literal(P.lex(t.text)[1]).isalpha() for t in ts) or o.errors:
        raise P.PatternError("proximity takes an AND of words")
    files = narrowed(files.select("file_id", "text"), q, o, index)
    first, *others = [P.literal(P.lex(t.text)[1]) for t in ts]
    places = I.near_in_files(files, first, others, limit)
    recs = T.records(files, delim, True)
    spans = recs.select("file_id", "begin", F.greatest(F.col("end") - F.col("begin"), F.lit(1)).alias("len"), F.col("rec_no").alias("attr_id"))
    held = A.region_join(places, spans).select("file_id", F.col("attr_id").alias("rec_no")).distinct()
    return recs.join(held, ["file_id", "rec_no"], "left_semi").select("file_id", "rec_no", "rec")


def search_attributes(values: DataFrame, pattern: str, **options) -> DataFrame:
    """(file_id, name, value, ...): the pattern judged over the attribute values (file_id, name, value, ...) of whole files; terms
    limited to an attribute match only there. Of the files that satisfy it, every value with one of its terms."""
    q, o = _parsed(pattern, options)
    ts = P.terms(q)
    for n, t in enumerate(ts):
        values = values.withColumn(f"__t{n}", query_column(t, F.col("value"), o, F.col("name")))
    names = [F.col(f"__t{n}") for n in range(len(ts))]
    flags = values.groupBy("file_id").agg(*[F.bool_or(c).alias(f"__t{n}") for n, c in enumerate(names)])
    good = flags.filter(_judged(q, ts, names)).select("file_id")
    return values.filter(balanced(names)).join(good, "file_id", "left_semi").drop(*[f"__t{n}" for n in range(len(ts))])


def _judged(q: P.Query, ts: list[P.Term], flags: list[Column]) -> Column:
    """The tree over the flags of its terms."""
    if isinstance(q, P.Term):
        return flags[ts.index(q)]
    if isinstance(q, P.Not):
        return ~_judged(q.of, ts, flags)
    a, b = _judged(q.left, ts, flags), _judged(q.right, ts, flags)
    return a & b if isinstance(q, P.And) else a | b


def count_per_file(hits: DataFrame) -> DataFrame:
    return hits.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


def limit_per_file(hits: DataFrame, n: int) -> DataFrame:
    """The first n hits of each file; 0 is no limit."""
    if not n:
        return hits
    return hits.withColumn("__k", F.row_number().over(Window.partitionBy("file_id").orderBy("rec_no"))).filter(F.col("__k") <= n).drop("__k")


def limit_files(hits: DataFrame, n: int) -> DataFrame:
    """Hits of the first n files with any, by id; 0 is no limit."""
    if not n:
        return hits
    first = hits.select("file_id").distinct().orderBy("file_id").limit(n)
    return hits.join(F.broadcast(first) if n <= I.BROADCAST_ROWS else first, "file_id", "left_semi")


def limit_total(hits: DataFrame, n: int) -> DataFrame:
    """The first n hits by file and record; 0 is no limit."""
    return hits.orderBy("file_id", "rec_no").limit(n) if n else hits


def group_header(hits: DataFrame) -> DataFrame:
    """`hits` with header: whether the record is the first of its file, where the name is shown."""
    return hits.withColumn("header", F.row_number().over(Window.partitionBy("file_id").orderBy("rec_no")) == 1)


def whole_files(files: DataFrame, hits: DataFrame) -> DataFrame:
    """The files with a hit, as they are."""
    return files.join(hits.select("file_id").distinct(), "file_id", "left_semi")


def which_patterns(recs: DataFrame, patterns: list[str], icase: bool = False) -> DataFrame:
    """(file_id, rec_no, pattern, ...): each of the literal patterns a record (file_id, rec_no, rec, ...) contains; other
    columns stay."""
    return recs.select(*recs.columns, F.explode(all_in(patterns, F.col("rec"), icase)).alias("pattern"))


def best_match(files: DataFrame, pattern: str, most: int = 8, delim: str = "\n", **options) -> DataFrame:
    """(file_id, rec_no, rec, dist): the records with the fewest edits for the pattern, at most `most` and fewer than its
    length. The edits allowed are doubled until a record has a match, then the least distance of those records counts."""
    q, o = _parsed(pattern, options)
    if not isinstance(q, P.Term):
        raise P.PatternError("the best match is of one term")
    parts = P.lex(q.text, o.constant)[1]
    most = min(most, sum(p[0] in ("char", "class", "any") for p in parts) - 1, P.MAX_REGEX_ERRORS if P.is_regex(parts) else P.MAX_ERRORS)
    recs = T.records(files, delim)
    for k in [k for k in (0, 1, 2, 4, 8) if k < most] + [most]:
        near = replace(o, errors=k)
        hits = searched(recs, q, near)
        if k <= 1:
            if rows_below(hits, 0):
                continue
            return hits.withColumn("dist", F.lit(k))
        ranked = written(hits.withColumn("dist", approx.term_distance(F.col("rec"), q.text, near)), "best-match")
        least = ranked.agg(F.min("dist")).first()[0]
        if least is not None:
            return ranked.filter(F.col("dist") == least)
    return recs.limit(0).withColumn("dist", F.lit(0))


def in_days(files: DataFrame, now: Column, days: int) -> DataFrame:
    """Files changed at most `days` days before `now`; a null time is left out."""
    return files.filter(F.datediff(now, F.col("mtime")) <= days)


def by_path(files: DataFrame, pattern: str, inverse: bool = False, **options) -> DataFrame:
    """Files whose path matches the pattern (or does not); a null path is in neither."""
    cond = compile(pattern, "path", **options)
    return files.filter(F.col("path").isNotNull() & (~cond if inverse else cond))


def stale_union(files: DataFrame, find, index: I.Index, built_at: Column) -> DataFrame:
    """A search where files newer than the index are read in full and the others through it. find: (files, index) to hits."""
    new = F.coalesce(F.col("mtime") > built_at, F.lit(True))
    return find(files.filter(~new), index).unionByName(find(files.filter(new), None))


def index_offsets(q: P.Query, o: P.Options, idx: I.Index) -> DataFrame:
    """(file_id, offsets ARRAY): of the candidate files of the pattern, the offsets of all index words that its terms need. A
    pattern the index can say nothing about gives none."""
    tree = P.needed(q, o, T.MAX_WORD)
    if tree is None:
        return idx.offsets.limit(0).select("file_id", "offsets")
    word = F.col("word")
    hit = balanced([I.holds(word, *leaf) for leaf in _leaves(tree)])
    found = idx.words(list(_leaves(tree)))
    rows = idx.offsets.filter(hit) if found is None else idx.posted({w for ws in found.values() for w in ws}, "offsets")
    return candidate_files(q, o, idx).of(I.offset_union(rows, F.lit(True))) if found is not None else I.offset_union(rows, F.lit(True))
