"""A corpus and requests to it: the user's way in.

    c = Corpus.from_df(df, id="doc_id", text="text", path="source", mtime="received_at")
    c.search("{would,shall};there", icase=True)
    c.request(["-w", "-i", "-L", "100:0:5", "would;there"])
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textdex.functions import text as T
from textdex.operators import index as I
from textdex.operators import search as S
from textdex.plans import pattern as P
from textdex.plans.compile import all_in, any_of, match_end, query_column
from textdex.session import scratch_dir, ship
from textdex.sources import files as SF
from textdex.sources import soif


@dataclass(frozen=True)
class Corpus:
    """files: (file_id, path, text, mtime, info, deleted). built_at: when the index was made; newer files are read whole.
    gone: rows of deleted files, for requests that ask for them. filters: (glob, column function) pairs a text goes through
    before it is indexed, and before it is searched where a request asks for that."""

    files: DataFrame
    idx: I.Index | None = None
    built_at: Column | None = None
    gone: DataFrame | None = None
    filters: tuple[tuple[str, SF.Filter], ...] = ()

    @classmethod
    def from_df(cls, df: DataFrame, id: str = "file_id", text: str = "text", path: str | None = None, mtime: str | None = None, info: str | None = None, deleted: str | None = None, filters: Sequence[tuple[str, SF.Filter]] = ()) -> "Corpus":
        """A corpus of the rows of `df`; absent columns are null, rows marked deleted are left out but for requests with -X."""
        ship(df.sparkSession)
        col = lambda name, kind: F.col(name) if name else F.lit(None).cast(kind)
        files = df.select(
            F.col(id).alias("file_id"), (F.col(path) if path else F.col(id).cast("string")).alias("path"), F.col(text).alias("text"),
            col(mtime, "timestamp").alias("mtime"), col(info, "string").alias("info"), F.coalesce(col(deleted, "boolean"), F.lit(False)).alias("deleted"),
        )
        return cls(files.filter("not deleted"), gone=files.filter("deleted") if deleted else None, filters=tuple(filters))

    @classmethod
    def read(cls, spark: SparkSession, root: str, glob: str | None = None, exclude: Sequence[str] = (), include: Sequence[str] = (), include_first: bool = False, type_tests: bool = True, filters: Sequence[tuple[str, SF.Filter]] = ()) -> "Corpus":
        """The files below `root` that are admitted: not excluded by name or suffix and, with type_tests, of text. Titles of
        HTML files are their information."""
        ship(spark)
        files = SF.classified(SF.read_tree(spark, root, glob), exclude, include, include_first, type_tests=type_tests)
        files = files.filter(SF.admitted(F.col("reason"))).withColumn("info", SF.file_info(F.col("path"), F.col("text")))
        return cls.from_df(files, path="path", mtime="mtime", info="info", filters=filters)

    def filtered(self, files: DataFrame | None = None) -> DataFrame:
        """The files with their texts passed through the filters."""
        files = self.files if files is None else files
        return SF.apply_filters(files, self.filters) if self.filters else files

    def index(self, path: str | None = None, built_at: Column | None = None, buckets: int | None = None, **parts) -> "Corpus":
        """The corpus with an index, saved at `path` (a folder of the session by default) and opened from there; its files are
        then those of the index, in order of id. parts: what Index.build takes."""
        spark = self.files.sparkSession
        made = replace(I.Index.build(self.filtered(), **parts), texts=self.files)
        made.meta["filtered"] = bool(self.filters)
        saved = made.save(path or scratch_dir(spark, "index"), buckets)
        return replace(self, files=saved.texts, idx=saved, built_at=built_at)

    def reload(self) -> "Corpus":
        """The corpus with its index as it now is on disk."""
        if self.idx is None:
            raise ValueError("the corpus has no index")
        idx = self.idx.reload()
        return replace(self, files=idx.texts if idx.texts is not None else self.files, idx=idx)

    def index_for(self, filtered: bool = False) -> I.Index | None:
        """The index, if it is one of the texts that are searched."""
        return self.idx if self.idx is not None and bool((self.idx.meta or {}).get("filtered")) == filtered else None

    def search(self, pattern: str, whole_file: bool = False, **options) -> DataFrame:
        """(file_id, path, rec_no, rec) of the matching records; whole_file judges the pattern over whole files."""
        idx = self.index_for()
        find = (lambda files, idx: S.search_whole(files, pattern, index=idx, **options)) if whole_file else (lambda files, idx: S.search(files, pattern, idx, **options))
        if idx is not None and self.built_at is not None:
            hits = S.stale_union(self.files, find, idx, self.built_at)
        else:
            hits = find(self.files, idx)
        return hits.join(self.files.select("file_id", "path"), "file_id").select("file_id", "path", *[c for c in hits.columns if c != "file_id"])

    def request(self, args: list[str], ids: DataFrame | None = None, names: DataFrame | None = None, now: Column | None = None) -> DataFrame:
        """The answer to a request written as options and a pattern (see Request); ids and names limit the files."""
        return Request.parse(args).run(self, ids, names, now)


#: Options with a value, and those without.
VALUED, FLAGS = set("dFLYDISemRf"), set("aBbcEGghijklMnNoOpPQqstuUvwWxXz")
#: Options that are known and refused, and why.
REFUSED = {"A": "names are columns", "r": "a folder is read by Corpus.read", "y": "nothing is asked", "C": "there is no server", "J": "there is no server", "K": "there is no server"}


@dataclass
class Request:
    """Options: -1 to -8 errors, -D -I -S costs, -B best match, -i case, -w word, -x record, -k constant, -p supersequence, -v
    inverse, -W whole file, -R words of an AND at most so many characters apart, -d delimiter, -t it stays at the record's
    end, -o at its head, -c count, -l names, -s only whether there is a match, -N candidate files by the index, with -Q the
    offsets there, with -Qc their number, -E lines of the index, -G whole files, -O whether a record is the first of its
    file, -L total:files:per-file, -F path pattern, -f file with a path a line, -X deleted files too, -Y days, -z texts as
    filtered, -e pattern, -a attribute names of structured records, -g number instead of name, -h no name, -u no record,
    -n record number, -b end of the match, -q span, -j time, -U information, -m several patterns (one a line), -P the first
    of them that matches, -M all that do."""

    pattern: str
    flags: set[str]
    values: dict[str, str]
    errors: int = 0

    @classmethod
    def parse(cls, args: list[str]) -> "Request":
        flags, values, errors, rest, i = set(), {}, 0, [], 0
        while i < len(args):
            a = args[i]
            i += 1
            if not a.startswith("-") or a == "-" or rest:
                rest.append(a)
                continue
            k = 1
            while k < len(a):
                c = a[k]
                k += 1
                if c.isdigit():
                    errors = int(c)
                elif c in VALUED:
                    value = a[k:]
                    if not value:
                        if i >= len(args):
                            raise P.PatternError(f"-{c} needs a value")
                        value, i = args[i], i + 1
                    values[c] = value
                    break
                elif c in FLAGS:
                    flags.add(c)
                elif c in REFUSED:
                    raise P.PatternError(f"-{c} has no meaning here: {REFUSED[c]}")
                else:
                    raise P.PatternError(f"unknown option -{c}")
        pattern = values.get("e") or values.get("m") or (rest[0] if rest else "")
        if not pattern:
            raise P.PatternError("no pattern")
        out = cls(pattern, flags, values, errors)
        given = flags | set(values)
        for a, b in (("w", "x"), ("x", "d"), ("B", "c"), ("B", "l"), ("t", "o"), ("P", "M"), ("p", "w"), ("p", "x"), *[(a, b) for a in "BRato" for b in "bq"], *[("R", b) for b in "BWvmato"], *[("a", b) for b in "BWvmtoNE"]):
            if a in given and b in given:
                raise P.PatternError(f"-{a} and -{b} exclude each other")
        for a, b in (("Q", "N"), ("P", "m"), ("M", "m")):
            if a in given and b not in given:
                raise P.PatternError(f"-{a} needs -{b}")
        if "R" in values and not values["R"].isdigit():
            raise P.PatternError("-R needs a number")
        return out

    def options(self) -> dict:
        cost = {name: int(self.values[c]) for c, name in (("D", "delete"), ("I", "insert"), ("S", "substitute")) if c in self.values}
        named = {name: c in self.flags for c, name in (("i", "icase"), ("w", "word"), ("x", "whole"), ("k", "constant"), ("p", "supersequence"))}
        return {**named, "errors": self.errors, **cost}

    def limits(self) -> tuple[int, int, int]:
        parts = [int(x or 0) for x in self.values.get("L", "0").split(":")]
        return tuple((parts + [0, 0, 0])[:3])

    def run(self, corpus: Corpus, ids: DataFrame | None = None, names: DataFrame | None = None, now: Column | None = None) -> DataFrame:
        files = corpus.files
        if "X" in self.flags and corpus.gone is not None:
            files = files.unionByName(corpus.gone)
        if "z" in self.flags:
            files = corpus.filtered(files)
        if "F" in self.values:
            inner = Request.parse(["-e", self.values["F"]] if not self.values["F"].startswith("-") else self.values["F"].split(" "))
            files = S.by_path(files, inner.pattern, "v" in inner.flags, **inner.options())
        if "Y" in self.values:
            files = S.in_days(files, now if now is not None else F.current_date(), int(self.values["Y"]))
        listed = files.sparkSession.read.text(self.values["f"]).select(F.col("value").alias("path")) if "f" in self.values else None
        for side, key in ((ids, "file_id"), (names, "path"), (listed, "path")):
            if side is not None:
                files = files.join(I.maybe_broadcast(side.select(key).distinct()), key, "left_semi").select(*files.columns)
        o = P.Options(**self.options())
        if self.flags & {"N", "E"}:
            return self._from_index(files, corpus, o)
        idx = corpus.index_for("z" in self.flags)
        find = lambda files, idx: self._hits(files, idx, o)
        hits = S.stale_union(files, find, idx, corpus.built_at) if idx is not None and corpus.built_at is not None else find(files, idx)
        total, most_files, per_file = self.limits()
        hits = S.limit_files(S.limit_per_file(hits, per_file), most_files)
        if "s" in self.flags:
            return hits.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))
        if "G" in self.flags:
            return S.whole_files(files, hits).select("file_id", "path", "text")
        if "l" in self.flags:
            out = S.whole_files(files, hits).select(*self._names())
            return out.orderBy(out.columns[0]).limit(total) if total else out
        if "c" in self.flags:
            counts = S.count_per_file(S.limit_total(hits, total))
            return counts.join(files, "file_id").select(*self._names(), "n")
        hits = S.limit_total(hits, total)
        if "O" in self.flags:
            hits = S.group_header(hits)
        hits = hits.join(files.select("file_id", "path", "mtime", "info"), "file_id")
        return hits.select(*self._names(), *self._shown(hits, o))

    def _from_index(self, files: DataFrame, corpus: Corpus, o: P.Options) -> DataFrame:
        """Answers of the index alone: its lines (-E), candidate files (-N), their offsets (-NQ) or numbers of them (-NQc)."""
        idx = corpus.idx
        if idx is None:
            raise P.PatternError("-N and -E need an index")
        q = P.parse(self.pattern, o.constant)
        P.validate(q, o)
        if "E" in self.flags:
            return I.index_lines(idx.postings, query_column(q, F.col("word"), replace(o, icase=True)))
        if "Q" not in self.flags:
            found = S.candidate_files(q, o, idx)
            return (files if found is None else found.of(files)).select("file_id", "path")
        if idx.offsets is None:
            raise P.PatternError("-Q needs an index with offsets")
        hits = S.index_offsets(q, o, idx).join(files.select("file_id", "path"), "file_id")
        if "c" in self.flags:
            return hits.select(*self._names(), F.size("offsets").alias("n"))
        return hits.select(*self._names(), F.explode("offsets").alias("off"))

    def _hits(self, files: DataFrame, idx: I.Index | None, o: P.Options) -> DataFrame:
        delim = P.delimiter(self.values["d"]) if "d" in self.values else "\n"
        offsets = bool(self.flags & {"b", "q"})
        if "m" in self.values:
            listed = [p for p in self.values["m"].split("\n") if p]
            recs = T.records(files, delim, offsets)
            if not self.flags & {"P", "M"}:
                return recs.filter(any_of(listed, F.col("rec"), o.icase))
            found = recs.withColumn("pattern", all_in(listed, F.col("rec"), o.icase)).filter(F.size("pattern") > 0)
            return found.withColumn("pattern", F.element_at("pattern", 1) if "P" in self.flags else F.explode("pattern"))
        if "B" in self.flags:
            return S.best_match(files, self.pattern, delim=delim, **{**self.options(), "errors": 0})
        q = P.parse(self.pattern, o.constant)
        P.validate(q, o)
        if "a" in self.flags or any(t.attribute for t in P.terms(q)):
            attrs = soif.read(files).select("file_id", F.posexplode("attrs").alias("pos", "a"))
            values = attrs.select("file_id", F.col("a.name").alias("name"), F.col("a.value").alias("value"), (F.col("pos") + 1).alias("rec_no"))
            return S.search_attributes(values, self.pattern, **self.options()).withColumnRenamed("value", "rec")
        if "v" in self.flags:
            return T.records(files, delim, offsets).filter(~query_column(q, F.col("rec"), o))
        if "R" in self.values:
            return S.search_near(files, self.pattern, int(self.values["R"]), idx, delim, **self.options())
        if "W" in self.flags:
            return S.search_whole(files, self.pattern, delim, idx, offsets=offsets, **self.options())
        if self.flags & {"t", "o"}:
            return S.searched(T.records_kept_delimiter(files, delim, "t" in self.flags), q, o)
        return S.search(files, self.pattern, idx, delim, offsets, **self.options())

    def _names(self) -> list[str]:
        return [] if "h" in self.flags else ["file_id"] if "g" in self.flags else ["path"]

    def _shown(self, hits: DataFrame, o: P.Options) -> list:
        out = ["header"] if "O" in self.flags else []
        if "n" in self.flags:
            out.append("rec_no")
        if "q" in self.flags:
            out += ["begin", "end"]
        if "b" in self.flags:
            if "pattern" in hits.columns:
                value = lambda c: F.lower(c) if o.icase else F.col(c)
                end = F.call_function("position", value("pattern"), value("rec")) - 1 + F.length("pattern")
            else:
                end = F.lit(None).cast("int") if "v" in self.flags else match_end(P.parse(self.pattern, o.constant), F.col("rec"), o)
            out.append((F.col("begin") + end).alias("match_end"))
        if "j" in self.flags:
            out.append(F.date_format("mtime", "': 'MMM dd yyyy").alias("time_text"))
        if "U" in self.flags:
            out.append("info")
        out += [c for c in ("pattern", "dist") if c in hits.columns]
        if "a" in self.flags:
            out.append("name")
        if "u" not in self.flags:
            out.append("rec")
        return out or ["rec_no"]
