"""Queries of the core operators over the test tables, and the SQL they are compared with.

documents are the files (one text each, its lines the records); files has paths, sizes and times; attr_value has the
attributes of structured records; token and indices are an index built elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textdex.corpus import Corpus
from textdex.functions import approx, compress
from textdex.functions import text as T
from textdex.operators import attributes as A
from textdex.operators import index as I
from textdex.operators import search as S
from textdex.operators import skew
from textdex.plans import pattern as P
from textdex.plans.compile import any_of, compile, match_end
from textdex.session import load, scratch_dir, written
from textdex.sources import files as SF
from textdex.sources import soif

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, and the SQL with the same result."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


# inputs


def docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", F.col("received_at").alias("mtime"))


def recs(spark: SparkSession, d: str) -> DataFrame:
    return T.records(docs(spark, d))


def files(spark: SparkSession, d: str) -> DataFrame:
    return SF.latest_files(load(spark, d, "files"))


def values(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "attr_value").filter("value is not null").select("value_id", "file_id", "attr_no", F.col("attribute").alias("name"), "value", "off").distinct()


def saved(spark: SparkSession, d: str, **parts) -> I.Index:
    """An index of documents, saved in the shared folder and opened from there."""
    return I.Index.build(docs(spark, d), **parts).save(scratch_dir(spark, "query-index"))


REC = """d AS (SELECT doc_id AS file_id, concat(coalesce(source, 'none'), '/', doc_id, '.txt') AS path, text, received_at AS mtime FROM documents),
r AS (SELECT file_id, CAST(unnest(range(1, len(s) + 1)) AS INTEGER) AS rec_no, unnest(s) AS rec FROM
  (SELECT file_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS s FROM d WHERE text <> ''))"""
POST = """d AS (SELECT doc_id AS file_id, text, received_at AS mtime FROM documents),
t AS (SELECT file_id, unnest(regexp_extract_all(lower(text), '[\\p{L}_]+')) AS word FROM d),
p AS (SELECT word, file_id, count(*) AS tf FROM t WHERE length(word) <= 64 GROUP BY ALL),
v AS (SELECT word, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY 1)"""
FIL = """f AS (SELECT file_id, path, size, mtime, info, coalesce(deleted, false) OR coalesce(path = '', true) AS deleted FROM files
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY mtime DESC NULLS LAST, path DESC NULLS LAST, size DESC NULLS LAST, info DESC NULLS LAST, deleted DESC NULLS LAST) = 1)"""
VAL = """v AS (SELECT DISTINCT value_id, file_id, attr_no, attribute AS name, value, off FROM attr_value WHERE value IS NOT NULL)"""
WORD = "[^\\p{L}\\p{Nd}]"


def hits(cond: str) -> str:
    return f"WITH {REC} SELECT file_id, rec_no, rec FROM r WHERE {cond}"


def searched(name: str, pattern: str, cond: str | None, **options) -> None:
    """A search of the lines of documents."""
    query(hits(cond) if cond else None, name)(lambda spark, d: S.search(docs(spark, d), pattern, **options))


def edited(text: str, budget: int, insert: int = 1, delete: int = 1, substitute: int = 1, free: range | None = None) -> str:
    """A regular expression of all texts within the edits of `text`: every combination written out. free: places that may be
    edited, all by default; a character may be put in before a place or, if it may be edited, behind the last one."""
    free = range(len(text) + 1) if free is None else free
    done: set[str] = set()

    def go(at: int, out: str, left: int) -> None:
        if at == len(text):
            done.add(out)
            return
        go(at + 1, out + P.quote(text[at]), left)
        if at in free:
            if left >= substitute:
                go(at + 1, out + ".", left - substitute)
            if left >= delete:
                go(at + 1, out, left - delete)
            if at and left >= insert:
                go(at, out + ".", left - insert)

    go(0, "", budget)
    return "|".join(sorted(done))


def near_sql(column: str, text: str, budget: int, **how) -> str:
    return f"regexp_matches({column}, '{edited(text, budget, **how)}')"


def bits_sql(column: str, text: str, errors: int) -> str:
    """Whether a part of the column is within the edits, by registers of bits folded over its characters."""
    masks = {c: sum(1 << i for i, x in enumerate(text) if x == c) for c in dict.fromkeys(text)}
    case = "CASE x " + " ".join(f"WHEN '{c}' THEN {m}" for c, m in masks.items()) + " ELSE 0 END"
    r = ["((((a[1] << 1) | 1) & x[1]))"]
    for j in range(1, errors + 1):
        r.append(f"(((((a[{j + 1}] << 1) | 1) & x[1]) | a[{j}] | (a[{j}] << 1) | ({r[-1]} << 1) | {(1 << j) - 1}) & {(1 << len(text)) - 1})")
    # the last place counts the hits
    step = f"[{', '.join(r)}, a[{errors + 2}] | ({r[-1]} & {1 << (len(text) - 1)})]"
    start = "[" + ", ".join(str((1 << j) - 1) for j in range(errors + 1)) + ", 0]::BIGINT[]"
    none = ", 0" * (errors + 1)
    return f"list_reduce(list_prepend({start}, list_transform(string_split({column}, ''), lambda x: [({case})::BIGINT{none}]::BIGINT[])), lambda a, x: {step})[{errors + 2}] > 0"


# patterns (2.3)

searched("exact", "there", "contains(rec, 'there')")
searched("icase", "subject", "contains(lower(rec), 'subject')", icase=True)
searched("whole_word", "not", f"regexp_matches(rec, '(^|{WORD})not($|{WORD})')", word=True)
searched("whole_record", "MIME-Version: 1.0", "rec = 'MIME-Version: 1.0'", whole=True)
searched("anchor_begin", "^From", "starts_with(rec, 'From')")
searched("anchor_end", "utf-8$", "ends_with(rec, 'utf-8')")
searched("char_class", "[0-2][0-9]:[0-5][^0-4]", "regexp_matches(rec, '[0-2][0-9]:[0-5][^0-4]')")
searched("dot", "w.th", "regexp_matches(rec, 'w.th')")
searched("wildcard_hash", "From#example", "regexp_matches(rec, 'From.*example')")
searched("regex_alt", "with|from", "regexp_matches(rec, 'with|from')")
searched("regex_star", "fo*r", "regexp_matches(rec, 'fo*r')")
searched("regex_group", "(th|wh)(e|o)*re", "regexp_matches(rec, '(th|wh)(e|o)*re')")
searched("escape_meta", r"\.example", "contains(rec, '.example')")
searched("constant_pattern", "ersion: 1.0", "contains(rec, 'ersion: 1.0')", constant=True)
searched("supersequence", "MVn", "regexp_matches(rec, 'M.*V.*n')", supersequence=True)
searched("bool_and", "the;and", "contains(rec, 'the') AND contains(rec, 'and')")
searched("bool_or", "shall,would", "contains(rec, 'shall') OR contains(rec, 'would')")
searched("bool_not", "the;~and", "contains(rec, 'the') AND NOT contains(rec, 'and')")
searched("bool_nested", "{the,of};~{and,with}", "(contains(rec, 'the') OR contains(rec, 'of')) AND NOT (contains(rec, 'and') OR contains(rec, 'with'))")
searched("bool_right", "the;and,with", "contains(rec, 'the') AND (contains(rec, 'and') OR contains(rec, 'with'))")
searched("approx1", "would", near_sql("rec", "would", 1), errors=1)
searched("approx2", "Subject", near_sql("rec", "Subject", 2), errors=2)
searched("approx_k4", "Content-Type", bits_sql("rec", "Content-Type", 4), errors=4)
searched("approx_costs", "would", near_sql("rec", "would", 3, delete=2, substitute=3), errors=3, delete=2, substitute=3)
_LOOP = "(u|o)*"
searched("approx_regex", "wo(u|o)*ld", "regexp_matches(rec, '" + "|".join([f".o{_LOOP}ld", f"o{_LOOP}ld", f"w.?o{_LOOP}ld", f"w.{_LOOP}ld", f"w{_LOOP}ld", f"wo{_LOOP}.{_LOOP}ld", f"wo{_LOOP}.?d", f"wo{_LOOP}l.?d?"]) + "')", errors=1)
searched("exact_zone", "<wou>ld", near_sql("rec", "would", 1, free=range(3, 5)), errors=1)
_SHORTER = "|".join(sorted({".*".join("Message"[i] for i in range(7) if i not in (a, b)) for a in range(7) for b in range(7)}))
searched("supersequence_within", "Message", f"regexp_matches(rec, '{_SHORTER}')", errors=2, supersequence=True)


@query(hits("NOT contains(rec, 'e')"))
def inverse(spark, d):
    return recs(spark, d).filter(~compile("e"))


@query(hits("contains(rec, 'wo') OR contains(rec, 'uld')"))
def approx_pigeonhole(spark, d):
    """The pre-filter of approx1 alone: a superset of its records."""
    return recs(spark, d).filter(approx.prefilter(F.col("rec"), P.lex("would")[1], P.Options(errors=1)))


PATTERNS = ["would", "there", "Subject", "from", "boundary"]


@query(hits(" OR ".join(f"contains(rec, '{p}')" for p in PATTERNS)))
def pattern_file(spark, d):
    return recs(spark, d).filter(any_of(PATTERNS, F.col("rec")))


#: 5,000 strings of four letters, by rule.
MANY = [chr(97 + n % 26) + chr(97 + n // 7 % 26) + chr(97 + n // 31 % 26) + chr(97 + n // 143 % 26) for n in range(5000)]
MANY_SQL = "(SELECT DISTINCT chr(97 + CAST(n % 26 AS INT)) || chr(97 + CAST(n // 7 % 26 AS INT)) || chr(97 + CAST(n // 31 % 26 AS INT)) || chr(97 + CAST(n // 143 % 26 AS INT)) AS pattern FROM range(5000) t(n))"
FOURS = "SELECT DISTINCT file_id, rec_no, unnest(list_transform(range(1, greatest(length(rec) - 2, 1)), lambda i: substr(rec, i, 4))) AS pattern FROM r"


@query(f"WITH {REC} SELECT file_id, rec_no, rec FROM r WHERE (file_id, rec_no) IN (SELECT (file_id, rec_no) FROM ({FOURS}) JOIN {MANY_SQL} USING (pattern))")
def pattern_file_5000(spark, d):
    return recs(spark, d).filter(any_of(MANY, F.col("rec")))


@query(f"WITH {REC} SELECT file_id, rec_no, pattern FROM ({FOURS}) JOIN {MANY_SQL} USING (pattern)")
def which_of_5000(spark, d):
    return S.which_patterns(recs(spark, d), list(dict.fromkeys(MANY))).select("file_id", "rec_no", "pattern")


@query(f"WITH {REC} SELECT file_id, rec_no, pattern FROM r, (SELECT unnest({PATTERNS}) AS pattern) WHERE contains(rec, pattern)")
def which_patterns(spark, d):
    return S.which_patterns(recs(spark, d), PATTERNS).select("file_id", "rec_no", "pattern")


@query("SELECT value_id, attribute AS name, value FROM (SELECT DISTINCT value_id, file_id, attr_no, attribute, value, off FROM attr_value) WHERE value IS NOT NULL AND attribute = 'title' AND contains(value, 'the')")
def attr_eq(spark, d):
    return values(spark, d).filter(compile("title=the", "value", F.col("name"))).select("value_id", "name", "value")


@query(f"WITH {VAL}, w AS (SELECT file_id FROM v GROUP BY 1 HAVING bool_or(name = 'title' AND contains(value, 'the')) AND bool_or(name = 'abstract' AND contains(value, 'and'))) SELECT file_id, name, value FROM v WHERE ((name = 'title' AND contains(value, 'the')) OR (name = 'abstract' AND contains(value, 'and'))) AND file_id IN (SELECT file_id FROM w)")
def attr_bool(spark, d):
    return S.search_attributes(values(spark, d), "title=the;abstract=and").select("file_id", "name", "value")


@query(f"WITH {FIL} SELECT file_id FROM f WHERE date_diff('day', mtime::DATE, DATE '1998-06-30') <= 700")
def age_days(spark, d):
    return S.in_days(files(spark, d), F.lit("1998-06-30").cast("date"), 700).select("file_id")


@query(f"WITH {FIL} SELECT file_id, path FROM f WHERE regexp_matches(path, '[0-9]\\.html')")
def path_regex(spark, d):
    return S.by_path(files(spark, d), r"[0-9]\.html").select("file_id", "path")


@query(f"WITH {FIL} SELECT file_id, path FROM f WHERE contains(path, '.html') AND NOT contains(path, 'sh')")
def path_bool(spark, d):
    return S.by_path(files(spark, d), r"\.html;~sh").select("file_id", "path")


@query(f"WITH {FIL} SELECT file_id, path FROM f WHERE NOT contains(path, '.txt')")
def path_inverse(spark, d):
    return S.by_path(files(spark, d), r"\.txt", inverse=True).select("file_id", "path")


@query(f"WITH {FIL} SELECT file_id, path FROM f WHERE {near_sql('path', '.html', 1)}")
def path_approx(spark, d):
    return S.by_path(files(spark, d), r"\.html", errors=1).select("file_id", "path")


# records and words (2.2)


@query(f"WITH {REC} SELECT file_id, rec_no, rec FROM r")
def records_lines(spark, d):
    return recs(spark, d)


PARAGRAPHS = "d AS (SELECT doc_id AS file_id, text FROM documents WHERE text <> ''), q AS (SELECT file_id, string_split(CASE WHEN ends_with(text, chr(10) || chr(10)) THEN left(text, length(text) - 2) ELSE text END, chr(10) || chr(10)) AS s FROM d)"


@query(f"WITH {PARAGRAPHS} SELECT file_id, CAST(unnest(range(1, len(s) + 1)) AS INTEGER) AS rec_no, unnest(s) AS rec FROM q")
def records_paragraphs(spark, d):
    return T.records(docs(spark, d), P.delimiter("$$"))


@query(f"WITH {REC}, x AS (SELECT file_id, text, string_split(text, chr(10)) AS s FROM d WHERE text <> ''), y AS (SELECT file_id, unnest(range(1, len(s) + 1)) AS n, unnest(s) AS l, len(s) AS k FROM x) SELECT file_id, CAST(n AS INTEGER) AS rec_no, CASE WHEN n < k THEN l || chr(10) ELSE l END AS rec FROM y WHERE n < k OR l <> ''")
def delim_tail(spark, d):
    return T.records_kept_delimiter(docs(spark, d), "\n", True)


DELIM_HEAD = f"WITH {REC}, x AS (SELECT file_id, text, string_split(text, chr(10)) AS s FROM d WHERE text <> ''), y AS (SELECT file_id, unnest(range(1, len(s) + 1)) AS n, unnest(s) AS l FROM x), z AS (SELECT file_id, n, CASE WHEN n > 1 THEN chr(10) || l ELSE l END AS rec FROM y WHERE n > 1 OR l <> '') SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY n) AS INTEGER) AS rec_no, rec FROM z"


@query(DELIM_HEAD)
def delim_head(spark, d):
    return T.records_kept_delimiter(docs(spark, d), "\n", False)


@query(f"WITH {REC} SELECT file_id, rec_no FROM r WHERE contains(rec, 'the')")
def record_number(spark, d):
    return S.search(docs(spark, d), "the").select("file_id", "rec_no")


@query(f"WITH {POST} SELECT file_id, word, count(*) AS n FROM t WHERE length(word) <= 64 GROUP BY ALL")
def tokenize(spark, d):
    return T.tokens(docs(spark, d)).groupBy("file_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT doc_id AS file_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}_]+')) AS word FROM documents) SELECT file_id, word, count(*) AS n FROM t WHERE length(word) <= 64 GROUP BY ALL")
def tokenize_numbers(spark, d):
    return T.tokens(docs(spark, d), True).groupBy("file_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT doc_id AS file_id, unnest(regexp_extract_all(lower(text || ' ' || repeat('X', 64) || ' ' || repeat('y', 65)), '[\\p{L}_]+')) AS word FROM documents) SELECT file_id, word, count(*) AS n FROM t WHERE length(word) > 12 AND length(word) <= 64 GROUP BY ALL")
def long_words(spark, d):
    """Words of more than 12 letters, up to the limit of 64; each text has one of 64 and one of 65 put at its end."""
    longer = docs(spark, d).withColumn("text", F.concat("text", F.lit(" " + "X" * 64 + " " + "y" * 65)))
    return T.tokens(longer).filter(F.length("word") > 12).groupBy("file_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_]+')) AS word FROM documents) SELECT word, count(*) AS n FROM t WHERE regexp_matches(word, '^([a-z_]+|[A-Z][a-z_]*|[A-Z_]+)$') GROUP BY 1")
def case_class_counts(spark, d):
    return docs(spark, d).select(F.explode(T.case_class_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


OFFSETS = """s AS (SELECT doc_id AS file_id, regexp_extract_all(text, '[\\p{L}_]+|[^\\p{L}_]+') AS a FROM documents WHERE text <> ''),
e AS (SELECT file_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS w FROM s),
o AS (SELECT file_id, lower(w) AS word, CAST(coalesce(sum(length(w)) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM e QUALIFY regexp_matches(w, '^[\\p{L}_]') AND length(w) <= 64)"""


@query(f"WITH {OFFSETS} SELECT file_id, off, word FROM o")
def word_offsets(spark, d):
    return T.word_offsets(docs(spark, d))


@query(f"WITH {OFFSETS} SELECT file_id, word, off, off - lag(off) OVER (PARTITION BY file_id, word ORDER BY off) AS delta FROM o")
def offset_deltas(spark, d):
    return I.offset_deltas(docs(spark, d))


# output, limits, counts (2.6 to 2.8, 2.10)

THE = "contains(rec, 'the')"


@query(f"WITH {REC}, h AS (SELECT path, rec_no, rec, file_id FROM r JOIN d USING (file_id) WHERE contains(path, 'list/') AND contains(lower(rec), 'subject') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY rec_no) <= 1) SELECT path, rec_no, rec FROM h ORDER BY file_id, rec_no LIMIT 50")
def request(spark, d):
    """Options as a user writes them: path pattern, letter case, limits, record numbers."""
    return Corpus(docs(spark, d).withColumn("info", F.lit(None).cast("string"))).request(["-i", "-n", "-L", "50:0:1", "-F", "list/", "subject"])


def corpus(spark: SparkSession, d: str, **how) -> Corpus:
    return Corpus.from_df(docs(spark, d).withColumn("info", F.lit(None).cast("string")), path="path", mtime="mtime", **how)


def requested(name: str, args: list[str], sql: str, index: bool = False, **parts) -> None:
    """A request as a user writes it; with index through a saved one."""
    query(f"WITH {REC} {sql}", name)(lambda spark, d: (corpus(spark, d).index(**parts) if index else corpus(spark, d)).request(args))


JOINED = "r JOIN d USING (file_id)"
requested("request_indexed", ["-n", "would;there"], f"SELECT path, rec_no, rec FROM {JOINED} WHERE contains(rec, 'would') AND contains(rec, 'there')", True)
requested("request_supersequence", ["-p", "-n", "MVn"], f"SELECT path, rec_no, rec FROM {JOINED} WHERE regexp_matches(rec, 'M.*V.*n')")
requested("request_ends", ["-b", "-u", "-i", "SUBJECT"], f", s AS (SELECT *, CAST(coalesce(sum(length(rec) + 1) OVER (PARTITION BY file_id ORDER BY rec_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM r) SELECT path, b + instr(lower(rec), 'subject') + 6 AS match_end FROM s JOIN d USING (file_id) WHERE contains(lower(rec), 'subject')")
requested("request_first_pattern", ["-n", "-u", "-P", "-m", "would\nthere\nwith"], f"SELECT path, rec_no, CASE WHEN contains(rec, 'would') THEN 'would' WHEN contains(rec, 'there') THEN 'there' ELSE 'with' END AS pattern FROM {JOINED} WHERE contains(rec, 'would') OR contains(rec, 'there') OR contains(rec, 'with')")
requested("request_all_patterns", ["-n", "-u", "-M", "-i", "-m", "WOULD\nthere"], f"SELECT path, rec_no, pattern FROM {JOINED}, (SELECT unnest(['WOULD', 'there']) AS pattern) WHERE contains(lower(rec), lower(pattern))")
requested("request_silent", ["-s", "would"], "SELECT count(*) > 0 AS found FROM r WHERE contains(rec, 'would')")
requested("request_header", ["-O", "-n", "-u", "would"], f"SELECT path, row_number() OVER (PARTITION BY file_id ORDER BY rec_no) = 1 AS header, rec_no FROM {JOINED} WHERE contains(rec, 'would')")
requested("request_whole_indexed", ["-W", "-n", "would;~der"], f", w AS (SELECT file_id FROM r GROUP BY 1 HAVING bool_or(contains(rec, 'would')) AND NOT bool_or(contains(rec, 'der'))) SELECT path, rec_no, rec FROM {JOINED} WHERE (contains(rec, 'would') OR contains(rec, 'der')) AND file_id IN (SELECT file_id FROM w)", True)
OFF = OFFSETS.replace("OFFSETS", "")
requested("request_offsets", ["-N", "-Q", "would"], f", {OFF} SELECT DISTINCT path, off FROM o JOIN d USING (file_id) WHERE contains(word, 'would')", True, offsets=True)
requested("request_offset_counts", ["-N", "-Q", "-c", "would"], f", {OFF} SELECT path, CAST(count(DISTINCT off) AS INTEGER) AS n FROM o JOIN d USING (file_id) WHERE contains(word, 'would') GROUP BY file_id, path", True, offsets=True)
requested("request_near", ["-R", "100", "-n", "would;there"], f", {OFF}, sp AS (SELECT *, CAST(coalesce(sum(length(rec) + 1) OVER (PARTITION BY file_id ORDER BY rec_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM r), h AS (SELECT DISTINCT x.file_id, x.off FROM o x JOIN o y ON x.file_id = y.file_id AND abs(x.off - y.off) <= 100 WHERE contains(x.word, 'would') AND contains(y.word, 'there')) SELECT DISTINCT path, rec_no, rec FROM sp JOIN h ON sp.file_id = h.file_id AND off >= b AND off < b + length(rec) JOIN d ON d.file_id = sp.file_id", True)


@query(f"WITH {POST} SELECT word, array_to_string(list_sort(list(file_id)), ' ') AS files FROM p WHERE contains(word, 'woul') GROUP BY 1")
def request_lines(spark, d):
    return corpus(spark, d).index().request(["-E", "woul"])


@query(f"WITH {REC} SELECT path, rec_no, rec FROM {JOINED} WHERE contains(rec, 'the') AND starts_with(path, 'box/')")
def request_named_files(spark, d):
    """Files named in a file, one path a line."""
    path = scratch_dir(spark, "names")
    docs(spark, d).filter(F.col("path").startswith("box/")).select("path").write.text(path)
    return corpus(spark, d).request(["-f", path, "-n", "the"])


@query(f"WITH {REC} SELECT path, rec_no, lower(rec) AS rec FROM {JOINED} WHERE contains(lower(rec), 'subject')")
def request_filtered(spark, d):
    """Texts as a filter gives them, for the index and for the search."""
    return corpus(spark, d, filters=[("*", F.lower)]).index().request(["-z", "-n", "subject"])


@query(f"WITH {REC} SELECT path, rec_no, rec FROM {JOINED} WHERE contains(rec, 'would')")
def request_deleted(spark, d):
    """Files that are gone, every third one, are named with -X."""
    f = docs(spark, d).withColumn("gone", F.col("file_id") % 3 == 0)
    return Corpus.from_df(f, path="path", deleted="gone").request(["-X", "-n", "would"])


@query(f"WITH {REC} SELECT file_id, count(*) AS n FROM r WHERE {THE} GROUP BY 1")
def count_per_file(spark, d):
    return S.count_per_file(S.search(docs(spark, d), "the"))


@query(f"WITH {REC} SELECT count(*) AS n FROM r WHERE {THE}")
def count_total(spark, d):
    return S.search(docs(spark, d), "the").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REC} SELECT file_id, count(*) AS n FROM r WHERE NOT {THE} GROUP BY 1")
def count_inverse(spark, d):
    both = recs(spark, d).groupBy("file_id").agg((F.count(F.lit(1)) - F.sum(compile("the").cast("long"))).alias("n"))
    return both.filter("n > 0")


@query(f"WITH {REC} SELECT file_id, rec_no, rec FROM r WHERE {THE} QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY rec_no) <= 2")
def limit_per_file(spark, d):
    return S.limit_per_file(S.search(docs(spark, d), "the"), 2)


@query(f"WITH {REC} SELECT file_id, rec_no, rec FROM r WHERE {THE} QUALIFY dense_rank() OVER (ORDER BY file_id) <= 5")
def limit_files(spark, d):
    return S.limit_files(S.search(docs(spark, d), "the"), 5)


@query(f"WITH {REC} SELECT file_id, rec_no, rec FROM r WHERE {THE} ORDER BY file_id, rec_no LIMIT 10")
def limit_total(spark, d):
    return S.limit_total(S.search(docs(spark, d), "the"), 10)


@query(f"WITH {REC} SELECT file_id, rec_no, row_number() OVER (PARTITION BY file_id ORDER BY rec_no) = 1 AS header FROM r WHERE {THE}")
def group_header(spark, d):
    return S.group_header(S.search(docs(spark, d), "the")).select("file_id", "rec_no", "header")


@query(f"WITH {REC} SELECT DISTINCT file_id, path FROM r JOIN d USING (file_id) WHERE contains(rec, 'would')")
def files_only(spark, d):
    f = docs(spark, d)
    return S.whole_files(f, S.search(f, "would")).select("file_id", "path")


@query(f"WITH {REC} SELECT file_id, text FROM d WHERE file_id IN (SELECT file_id FROM r WHERE contains(rec, 'would'))")
def whole_file(spark, d):
    f = docs(spark, d)
    return S.whole_files(f, S.search(f, "would")).select("file_id", "text")


SPANS = f"{REC}, s AS (SELECT *, CAST(coalesce(sum(length(rec) + 1) OVER (PARTITION BY file_id ORDER BY rec_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM r)"


@query(f"WITH {SPANS} SELECT file_id, rec_no, b AS begin_at, b + length(rec) AS end_at FROM s WHERE {THE}")
def record_span(spark, d):
    return S.search(docs(spark, d), "the", offsets=True).select("file_id", "rec_no", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"))


def ends(name: str, pattern: str, cond: str, end: str, **options) -> None:
    """Offsets of the ends of matches; `end` is the SQL of the number of characters up to it within the record."""

    def run(spark, d):
        o = P.Options(**options)
        rows = S.search(docs(spark, d), pattern, offsets=True, **options)
        return rows.select("file_id", "rec_no", (F.col("begin") + match_end(P.parse(pattern), F.col("rec"), o)).alias("match_end"))

    query(f"WITH {SPANS} SELECT file_id, rec_no, b + {end} AS match_end FROM s WHERE {cond}", name)(run)


ends("match_offset", "the", THE, "instr(rec, 'the') + 2")
ends("match_offset_icase", "SUBJECT", "contains(lower(rec), 'subject')", "instr(lower(rec), 'subject') + 6", icase=True)
ends("match_offset_regex", "fo*r", "regexp_matches(rec, 'fo*r')", "instr(rec, regexp_extract(rec, 'fo*r')) - 1 + length(regexp_extract(rec, 'fo*r'))")
ends("match_offset_and", "the;and", "contains(rec, 'the') AND contains(rec, 'and')", "greatest(instr(rec, 'the'), instr(rec, 'and')) + 2")
ends("match_offset_or", "shall,would", "contains(rec, 'shall') OR contains(rec, 'would')", "least(nullif(instr(rec, 'shall'), 0), nullif(instr(rec, 'would'), 0)) + 4")
_PREFIXES = f"list_min(list_filter(range(1, length(rec) + 1), lambda i: regexp_matches(left(rec, i), '({edited('would', 1)})$')))"
ends("match_offset_approx", "would", near_sql("rec", "would", 1), _PREFIXES, errors=1)


@query(f"WITH {FIL} SELECT file_id, strftime(mtime, ': %b %d %Y') AS time_text FROM f WHERE mtime IS NOT NULL")
def file_time(spark, d):
    return files(spark, d).filter("mtime is not null").select("file_id", F.date_format("mtime", "': 'MMM dd yyyy").alias("time_text"))


@query(f"WITH {FIL} SELECT file_id, path, info FROM f WHERE NOT deleted")
def show_info(spark, d):
    return files(spark, d).filter("not deleted").select("file_id", "path", "info")


@query(f"WITH {FIL} SELECT file_id, split_part(info, ' ', 1) AS key FROM f")
def info_key(spark, d):
    return files(spark, d).select("file_id", SF.info_key(F.col("info")).alias("key"))


@query(f"WITH {FIL} SELECT file_id, mtime, row_number() OVER (ORDER BY mtime DESC NULLS LAST, file_id) AS place FROM f")
def files_by_age(spark, d):
    return I.by_age(files(spark, d))


# whole-file scope


def _whole(cond: str, some: str) -> str:
    return f"WITH {REC}, w AS (SELECT file_id FROM r GROUP BY 1 HAVING {cond}) SELECT file_id, rec_no, rec FROM r WHERE ({some}) AND file_id IN (SELECT file_id FROM w)"


@query(_whole("bool_or(contains(rec, 'would')) AND bool_or(contains(rec, 'there'))", "contains(rec, 'would') OR contains(rec, 'there')"))
def whole_file_and(spark, d):
    return S.search_whole(docs(spark, d), "would;there")


@query(_whole("bool_or(contains(rec, 'would')) AND bool_or(contains(rec, 'there'))", "contains(rec, 'would') OR contains(rec, 'there')"))
def whole_file_indexed(spark, d):
    """The same through a saved index."""
    idx = saved(spark, d)
    return S.search_whole(idx.texts, "would;there", index=idx)


@query(_whole("bool_or(contains(rec, 'would')) AND NOT bool_or(contains(rec, 'der'))", "contains(rec, 'would') OR contains(rec, 'der')"))
def whole_file_not(spark, d):
    return S.search_whole(docs(spark, d), "would;~der")


@query(_whole("NOT (bool_or(contains(rec, 'would')) AND bool_or(contains(rec, 'there')))", "contains(rec, 'would') OR contains(rec, 'there')"))
def whole_file_not_both(spark, d):
    return S.search_whole(docs(spark, d), "~{would;there}")


# index (2.4, 2.6)


@query(f"WITH {POST} SELECT word, file_id, tf FROM p")
def postings_file(spark, d):
    return I.postings_file(docs(spark, d))


def listed(c: str):
    """An array as text: the driver compares plain values."""
    return F.array_join(F.col(c).cast("array<string>"), " ")


@query(f"WITH {OFFSETS} SELECT word, file_id, array_to_string(list_sort(list(off)), ' ') AS offsets FROM o GROUP BY ALL")
def postings_offset(spark, d):
    return I.postings_offset(docs(spark, d)).select("word", "file_id", listed("offsets").alias("offsets"))


@query(f"WITH {REC}, w AS (SELECT file_id, rec_no, unnest(regexp_extract_all(lower(rec), '[\\p{{L}}_]+')) AS word FROM r) SELECT DISTINCT word, file_id, rec_no FROM w WHERE length(word) <= 64")
def postings_record(spark, d):
    return I.postings_record(docs(spark, d))


BLOCKS = f"{FIL}, b AS (SELECT file_id, CAST(floor(coalesce(sum(coalesce(size, 0)) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100000) AS INTEGER) AS block_id, size FROM f)"


def blocks(spark, d):
    return I.blocks_fixed(files(spark, d), 100_000)


@query(f"WITH {BLOCKS} SELECT file_id, block_id FROM b")
def block_assign(spark, d):
    return blocks(spark, d)


LIMITS = f"""{FIL}, z AS (SELECT file_id, CAST(coalesce(sum(coalesce(size, 0)) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM f),
l AS (WITH RECURSIVE l(k, x) AS (SELECT 0, greatest(1, CAST((SELECT coalesce(sum(size), 0) FROM f) AS BIGINT) // 250) UNION ALL SELECT k + 1, greatest(1, CAST(floor(x * 0.9) AS BIGINT)) FROM l WHERE x > 1) SELECT * FROM l),
c AS (SELECT k, x, count(DISTINCT before // x) AS n FROM l, z GROUP BY ALL), y AS (SELECT coalesce((SELECT x FROM c WHERE n >= least(200, (SELECT count(*) FROM f) / 2) ORDER BY k LIMIT 1), 1) AS x)"""


@query(f"WITH {LIMITS} SELECT file_id, CAST(before // (SELECT x FROM y) AS INTEGER) AS block_id FROM z")
def block_rule(spark, d):
    """Blocks of a 250th of all bytes, made smaller until there are enough of them."""
    return I.blocks(files(spark, d))


@query(f"WITH {BLOCKS} SELECT block_id, count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM b GROUP BY 1")
def block_sizes(spark, d):
    return blocks(spark, d).join(files(spark, d).select("file_id", "size"), "file_id").groupBy("block_id").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def token_postings(spark, d):
    """File postings of the given token table."""
    t = load(spark, d, "token").select("token_id", "file_id", F.lower("word").alias("word"), F.coalesce("totalcount", F.lit(0)).alias("n")).filter("word is not null").distinct()
    return t.groupBy("word", "file_id").agg(F.sum("n").alias("tf"))


TPOST = """tp AS (SELECT word, file_id, CAST(sum(n) AS BIGINT) AS tf FROM (SELECT DISTINCT token_id, file_id, lower(word) AS word, coalesce(totalcount, 0) AS n FROM token WHERE word IS NOT NULL) GROUP BY ALL)"""


@query(f"WITH {BLOCKS}, {TPOST} SELECT word, array_to_string(list_sort(list(DISTINCT block_id)), ' ') AS blocks FROM tp JOIN b USING (file_id) GROUP BY 1")
def postings_block(spark, d):
    out = I.postings_block(token_postings(spark, d), blocks(spark, d))
    return out.select("word", F.array_join(F.col("blocks").cast("array<string>"), " ").alias("blocks"))


@query(f"WITH {BLOCKS}, {TPOST} SELECT DISTINCT file_id FROM b WHERE block_id IN (SELECT block_id FROM tp JOIN b USING (file_id) WHERE word = 'vairk')")
def block_candidates(spark, d):
    b = blocks(spark, d)
    found = token_postings(spark, d).filter("word = 'vairk'").join(b, "file_id").select("block_id").distinct()
    return b.join(found, "block_id", "left_semi").select("file_id")


@query(f"WITH {POST} SELECT word, df, tf FROM v")
def vocab_df(spark, d):
    return I.vocabulary(I.postings_file(docs(spark, d)))


@query("SELECT lower(word) AS word, CAST(sum(coalesce(freq, 0)) AS BIGINT) AS n FROM hash_entry WHERE word IS NOT NULL GROUP BY 1")
def word_counts(spark, d):
    return load(spark, d, "hash_entry").filter("word is not null").groupBy(F.lower("word").alias("word")).agg(F.sum(F.coalesce("freq", F.lit(0))).alias("n"))


@query(f"WITH {POST} SELECT word, df, tf FROM v WHERE (SELECT count(*) FROM d) > 254 AND df * 100 >= 50 * (SELECT count(*) FROM d)")
def stop_list_pct(spark, d):
    f = docs(spark, d)
    return I.stop_words_share(I.vocabulary(I.postings_file(f)), f.count(), 50)


@query(f"WITH {POST} SELECT word, df, tf FROM v WHERE tf * 1048576 >= 500 * (SELECT sum(strlen(text)) FROM d)")
def stop_list_mb(spark, d):
    f = docs(spark, d)
    return I.stop_words_density(I.vocabulary(I.postings_file(f)), f.agg(F.sum(F.octet_length("text"))).first()[0], 500)


NEW = "n AS (SELECT file_id, count(*) AS new_words, CAST(sum(CAST(regexp_matches(word, '[0-9]') AS INT)) AS BIGINT) AS numeric FROM (SELECT word, min(file_id) AS file_id FROM tp GROUP BY 1) GROUP BY 1)"


@query(f"WITH {TPOST}, {NEW} SELECT file_id, new_words FROM n WHERE new_words > 5")
def new_words_per_file(spark, d):
    return I.new_words(token_postings(spark, d)).filter("new_words > 5").select("file_id", "new_words")


@query(f"WITH {TPOST.replace('lower(word) AS word', "lower(word) || CASE WHEN length(word) % 3 = 0 THEN '7' ELSE '' END AS word")}, {NEW} SELECT file_id, new_words, numeric FROM n WHERE new_words >= 5 AND numeric * 100 > 30 * new_words")
def numeric_word_pct(spark, d):
    """Files with many new words with a digit; every word of a length divisible by 3 has one put at its end."""
    p = token_postings(spark, d).withColumn("word", F.when(F.length("word") % 3 == 0, F.concat("word", F.lit("7"))).otherwise(F.col("word")))
    return I.new_words(p.groupBy("word", "file_id").agg(F.sum("tf").alias("tf"))).filter("new_words >= 5 and numeric * 100 > 30 * new_words")


@query(f"WITH {FIL} SELECT CAST(sum(CAST(NOT deleted AS INT)) AS BIGINT) AS n_files, CAST(sum(CAST(deleted AS INT)) AS BIGINT) AS n_deleted, CAST(coalesce(sum(size) FILTER (NOT deleted), 0) AS BIGINT) AS total_size FROM f")
def index_stats(spark, d):
    return I.statistics(files(spark, d))


@query(f"WITH {POST} SELECT word, df, tf FROM v WHERE contains(word, 'att')")
def index_substring(spark, d):
    return I.containing(saved(spark, d).vocab, "att")


@query(f"WITH {POST} SELECT file_id, tf FROM p WHERE word = 'would'")
def index_exact(spark, d):
    return saved(spark, d).posted({"would"}).select("file_id", "tf")


@query(f"WITH {POST} SELECT word, df, tf FROM v WHERE regexp_matches(word, '^[a-z_]+$') AND levenshtein(word, 'would') <= 1")
def vocab_levenshtein(spark, d):
    v = I.vocabulary(I.postings_file(docs(spark, d)))
    return v.filter(F.col("word").rlike("^[a-z_]+$")).filter(F.levenshtein("word", F.lit("would"), 1) >= 0)


@query(f"WITH {POST} SELECT DISTINCT file_id FROM p WHERE {near_sql('word', 'woulds', 1)}")
def index_approx(spark, d):
    """Words of the index within one edit of a part, and the files that hold them."""
    idx = saved(spark, d)
    near = idx.vocab.filter(compile("woulds", "word", errors=1)).select("word")
    return idx.postings.join(near, "word", "left_semi").select("file_id").distinct()


@query(hits(near_sql("rec", "wuld there", 2)))
def approx_indexed(spark, d):
    """A search with errors through a saved index: one of the pieces must be part of an index word."""
    idx = saved(spark, d)
    return S.search(idx.texts, "wuld there", idx, errors=2)


@query(f"WITH {POST}, x AS (SELECT word, levenshtein(word, 'becouse') AS dist FROM v WHERE regexp_matches(word, '^[a-z_]+$')) SELECT word, dist FROM x WHERE dist = (SELECT min(dist) FROM x)")
def best_match(spark, d):
    v = I.vocabulary(I.postings_file(docs(spark, d))).filter(F.col("word").rlike("^[a-z_]+$"))
    return I.best_matches(v, "becouse").select("word", F.col("dist").cast("long").alias("dist"))


BEST = " ".join(f"WHEN {near_sql('rec', 'Mesage-Id: <35', k)} THEN {k}" for k in (0, 1, 2))


@query(f"WITH {REC}, x AS (SELECT file_id, rec_no, rec, CASE {BEST} END AS dist FROM r) SELECT file_id, rec_no, rec, dist FROM x WHERE dist = (SELECT min(dist) FROM x)")
def best_match_records(spark, d):
    return S.best_match(docs(spark, d), "Mesage-Id: <35", constant=True)


def _sets(spark, d, *words):
    p = I.postings_file(docs(spark, d))
    return [p.filter(F.col("word") == w).select("file_id").distinct() for w in words]


@query(f"WITH {POST} SELECT file_id FROM p WHERE word = 'would' INTERSECT SELECT file_id FROM p WHERE word = 'there'")
def index_and(spark, d):
    return I.all_of(_sets(spark, d, "would", "there"))


@query(f"WITH {POST} SELECT file_id FROM p WHERE word = 'would' UNION SELECT file_id FROM p WHERE word = 'there'")
def index_or(spark, d):
    return I.any_of(_sets(spark, d, "would", "there"))


@query(f"WITH {POST} SELECT file_id FROM d EXCEPT SELECT file_id FROM p WHERE word = 'would'")
def index_not(spark, d):
    return I.none_of(docs(spark, d), _sets(spark, d, "would")[0])


@query(f"WITH {POST} SELECT DISTINCT file_id FROM p WHERE contains(word, 'would')")
def index_only(spark, d):
    return saved(spark, d).candidates("would")


@query(f"WITH {OFFSETS} SELECT file_id, off FROM o WHERE contains(word, 'would')")
def index_offsets(spark, d):
    return T.word_offsets(docs(spark, d)).filter(F.col("word").contains("would")).select("file_id", "off")


@query(f"WITH {POST} SELECT file_id, CAST(sum(tf) AS BIGINT) AS n FROM p WHERE contains(word, 'would') GROUP BY 1")
def index_counts(spark, d):
    return I.postings_file(docs(spark, d)).filter(F.col("word").contains("would")).groupBy("file_id").agg(F.sum("tf").alias("n"))


@query(f"WITH {POST} SELECT word, array_to_string(list_sort(list(file_id)), ' ') AS files FROM p WHERE starts_with(word, 'wou') GROUP BY 1")
def index_lines(spark, d):
    return I.index_lines(I.postings_file(docs(spark, d)), F.col("word").startswith("wou"))


@query(f"WITH {OFFSETS} SELECT DISTINCT a.file_id, a.off FROM o a JOIN o b ON a.file_id = b.file_id AND abs(a.off - b.off) <= 256 WHERE contains(a.word, 'would') AND contains(b.word, 'there')")
def proximity(spark, d):
    return I.near_in_files(docs(spark, d), "would", "there", 256)


@query(hits("regexp_matches(lower(rec), '(^|[^\\p{L}_])would($|[^\\p{L}_])') AND regexp_matches(lower(rec), '(^|[^\\p{L}_])with($|[^\\p{L}_])')").replace("file_id, rec_no, rec FROM r", "file_id, rec_no FROM r"))
def record_cooccur(spark, d):
    p = I.postings_record(docs(spark, d)).filter(F.col("word").isin("would", "with"))
    return p.groupBy("file_id", "rec_no").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("file_id", "rec_no")


@query(f"WITH {OFFSETS} SELECT file_id, array_to_string(list_sort(list(DISTINCT off)), ' ') AS offs FROM o WHERE word IN ('would', 'there') GROUP BY 1")
def offset_union(spark, d):
    out = I.offset_union(I.postings_offset(docs(spark, d)), F.col("word").isin("would", "there"))
    return out.select("file_id", listed("offsets").alias("offs"))


@query(hits("contains(rec, 'would') AND contains(rec, 'there')"))
def two_level_search(spark, d):
    idx = saved(spark, d)
    return S.search(idx.texts, "would;there", idx)


@query(hits("contains(rec, 'the') AND contains(rec, 'would')"))
def stop_word_query(spark, d):
    idx = saved(spark, d, stop_percent=50)
    return S.search(idx.texts, "the;would", idx, stop=idx.stop)


@query(f"WITH {POST} SELECT (SELECT count(DISTINCT file_id) FROM p WHERE contains(word, 'would')) AS n_candidates, (SELECT count(*) FROM d) AS n_files")
def search_percent(spark, d):
    f = docs(spark, d)
    found = I.candidates(I.postings_file(f), "would").withColumn("hit", F.lit(1))
    return f.select("file_id").join(found, "file_id", "left").agg(F.count("hit").alias("n_candidates"), F.count(F.lit(1)).alias("n_files"))


@query(hits("contains(rec, 'the') AND file_id % 7 = 0"))
def neighbourhood_ids(spark, d):
    return S.search(docs(spark, d), "the", hints=docs(spark, d).filter("file_id % 7 = 0").select("file_id"))


@query(f"WITH {REC} SELECT file_id, rec_no, rec FROM r JOIN d USING (file_id) WHERE contains(rec, 'the') AND starts_with(path, 'box/')")
def neighbourhood_names(spark, d):
    f = docs(spark, d)
    names = f.filter(F.col("path").startswith("box/")).select("path")
    return S.search(f, "the", hints=f.join(names, "path", "left_semi").select("file_id"))


@query(f"WITH {FIL} SELECT path, file_id FROM f WHERE contains(path, '/a')")
def names_to_ids(spark, d):
    names = files(spark, d).filter(F.col("path").contains("/a")).select("path").distinct()
    return names.join(files(spark, d).select("path", "file_id"), "path")


@query(f"WITH {FIL} SELECT file_id, path FROM f WHERE file_id IS NOT NULL")
def ids_to_names(spark, d):
    f = files(spark, d).select("file_id", "path")
    return f.select("file_id").join(f, "file_id")


@query(f"WITH {FIL} SELECT file_id, path FROM f WHERE file_id > 0")
def bitmap_to_names(spark, d):
    """Ids as bitmaps and back, with their names."""
    f = files(spark, d)
    return I.bitmap_names(I.bitmap(f.filter("file_id > 0").select("file_id")), f)


@query(f"WITH {FIL} SELECT CAST(file_id // 32768 AS BIGINT) + CASE WHEN file_id % 32768 = 0 THEN 0 ELSE 1 END AS bucket, count(DISTINCT file_id) AS n FROM f GROUP BY 1")
def ids_to_bitmap(spark, d):
    return I.bitmap(files(spark, d)).select("bucket", "n")


# files and their kinds (2.1)

ADMIT = "CASE WHEN contains(path, 'tai') THEN 'exclude' WHEN contains(path, '.html') THEN 'include' WHEN contains(path, '.') AND split_part(path, '.', -1) IN (" + ", ".join(f"'{s}'" for s in SF.SKIPPED_SUFFIXES) + ") THEN 'suffix' ELSE 'default' END"


@query(f"WITH {FIL} SELECT file_id, {ADMIT} AS reason FROM f WHERE path <> ''")
def scan_admission(spark, d):
    f = files(spark, d).filter("path <> ''")
    return f.select("file_id", SF.admission(F.col("path"), ["*tai*"], ["*.html"]).alias("reason"))


@query(f"WITH {FIL} SELECT file_id, {ADMIT.replace('CASE ', 'CASE WHEN contains(path, $$.html$$) THEN $$include$$ ', 1)} AS reason FROM f WHERE path <> ''")
def include_over_exclude(spark, d):
    f = files(spark, d).filter("path <> ''")
    return f.select("file_id", SF.admission(F.col("path"), ["*tai*"], ["*.html"], include_first=True).alias("reason"))


@query(f"WITH {FIL} SELECT file_id, CASE WHEN contains(path, '/arc/') THEN 'toplevel' ELSE {ADMIT} END AS reason FROM f WHERE path <> ''")
def scan_toplevel(spark, d):
    """Files named directly skip the exclude list."""
    f = files(spark, d).filter("path <> ''")
    return f.select("file_id", SF.admission(F.col("path"), ["*tai*"], ["*.html"], toplevel=F.col("path").contains("/arc/")).alias("reason"))


@query(f"WITH {FIL} SELECT file_id, path FROM f WHERE regexp_matches(path, '/arc/.*s.\\.txt$')")
def glob_exclude(spark, d):
    return files(spark, d).filter(SF.path_matches(F.col("path"), ["/arc/*s?.txt$"])).select("file_id", "path")


@query(f"WITH {FIL} SELECT file_id, path, size FROM f WHERE NOT deleted AND {ADMIT} IN ('include', 'default')")
def list_indexable(spark, d):
    f = files(spark, d).filter("not deleted")
    return f.filter(SF.admitted(SF.admission(F.col("path"), ["*tai*"], ["*.html"]))).select("file_id", "path", "size")


@query(f"WITH {FIL} SELECT file_id, path FROM f WHERE contains(path, '.') AND split_part(path, '.', -1) IN (" + ", ".join(f"'{s}'" for s in SF.SKIPPED_SUFFIXES) + ")")
def suffix_skip(spark, d):
    return files(spark, d).filter(SF.skipped_suffix(F.col("path"))).select("file_id", "path")


def planted(spark: SparkSession, d: str, yes, no=None) -> DataFrame:
    """Documents of which every third one begins with `yes` and the next with `no`, so that both answers of a test occur."""
    n = F.col("file_id") % 3
    begin = F.when(n == 0, yes).when(n == 1, "" if no is None else no).otherwise("")
    return docs(spark, d).filter("text is not null").withColumn("text", F.concat(begin, "text"))


def kind_query(name: str, f, yes, no=None, sql: str = "doc_id % 3 = 0") -> None:
    query(f"SELECT doc_id AS file_id, {sql} AS yes FROM documents WHERE text IS NOT NULL", name)(lambda spark, d: planted(spark, d, yes, no).select("file_id", f(F.col("text")).alias("yes")))


_UU = "begin 644 x\nM"
kind_query("is_binary", SF.is_binary, "\x01" * 300, "\x01" * 5 + "x" * 100)
kind_query("is_uuencode", SF.is_uuencoded, _UU + "#" * 60 + "\nM" + "#" * 60 + "\n", _UU + "#" * 100 + "\nM" + "#" * 60 + "\n")
kind_query("is_postscript", SF.is_postscript, "%!PS-Adobe-3.0\n", "%!\nPS-Adobe-3.0\n")
_DISTINCT = " ".join(chr(97 + n // 676) + chr(97 + n // 26 % 26) + chr(97 + n % 26) for n in range(2000))
kind_query("is_heavy", SF.is_dictionary_like, _DISTINCT, "a b c " * 1300)
_SEPARATED = "length(text) >= 2048 AND CASE WHEN length(regexp_replace(text, '[^\\n /]', '', 'g')) = 0 THEN true ELSE (length(text) - length(regexp_replace(text, '[^\\n /]', '', 'g'))) // length(regexp_replace(text, '[^\\n /]', '', 'g')) > 18 END"
kind_query("is_hqx", SF.is_few_separators, "x" * 100_000, "x " * 2000, f"doc_id % 3 = 0 OR (doc_id % 3 = 2 AND {_SEPARATED})")


@query("SELECT doc_id AS file_id, CASE doc_id % 3 WHEN 0 THEN 'binary' ELSE CASE WHEN doc_id % 3 = 1 THEN 'include' ELSE 'default' END END AS reason FROM documents WHERE text IS NOT NULL")
def type_tests(spark, d):
    """Classification at admission: binary texts are left out, but not those of the include list."""
    f = planted(spark, d, F.lit("\x01" * 3000), F.lit("\x01" * 3000)).withColumn("text", F.when(F.col("file_id") % 3 == 2, F.substring("text", 1, 40)).otherwise(F.col("text")))
    f = f.withColumn("path", F.when(F.col("file_id") % 3 == 1, "x.keep").otherwise("x.txt"))
    return SF.classified(f, (), ["*.keep"]).select("file_id", "reason")


@query("SELECT doc_id AS file_id, 'default' AS reason FROM documents WHERE text IS NOT NULL")
def no_type_tests(spark, d):
    f = planted(spark, d, F.lit("\x01" * 3000)).withColumn("path", F.lit("x.txt"))
    return SF.classified(f, type_tests=False).select("file_id", "reason")


@query("SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 0 THEN 'About\\: ' || doc_id || ' x' ELSE 'No Title' END AS title FROM documents WHERE text IS NOT NULL")
def html_title(spark, d):
    title = F.concat(F.lit("<html><TITLE>About: "), F.col("file_id").cast("string"), F.lit("\nx</title>"))
    return planted(spark, d, title).select("file_id", SF.html_title(F.col("text")).alias("title"))


@query("SELECT doc_id AS file_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'T' ELSE 'No Title' END END AS info FROM documents WHERE text IS NOT NULL")
def html_info(spark, d):
    """Titles of files with the suffix of an HTML file only."""
    f = planted(spark, d, F.lit("<title>T</title>")).withColumn("path", F.when(F.col("file_id") % 2 == 0, "a.shtml").otherwise("a.txt"))
    return f.select("file_id", SF.file_info(F.col("path"), F.col("text")).alias("info"))


PLAIN = "regexp_replace(regexp_replace(text, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[A-Za-z/!][^>]*>', ' ', 'g')"
for _e, _c in SF.ENTITIES:
    PLAIN = f"replace({PLAIN}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
PLAIN = f"trim(regexp_replace({PLAIN}, '[ \\t\\r\\n]+', ' ', 'g'))"


@query(f"SELECT doc_id AS file_id, {PLAIN} AS plain FROM documents WHERE contains(text, '<html')")
def html_to_text(spark, d):
    return docs(spark, d).filter(F.col("text").contains("<html")).select("file_id", SF.html_to_text(F.col("text")).alias("plain"))


@query(f"WITH {REC} SELECT file_id, CASE WHEN contains(path, 'list/') AND length(lower(text)) > 0 THEN regexp_replace(lower(text), '[ \\t]+', ' ', 'g') WHEN length(text) > 0 THEN regexp_replace(text, '[ \\t]+', ' ', 'g') ELSE text END AS text FROM d")
def filter_chain(spark, d):
    return SF.apply_filters(docs(spark, d), [("list/*", SF.FILTERS["lower"]), ("*", SF.FILTERS["squeeze"])]).select("file_id", "text")


# structured records (2.1, 2.5, 2.10)


def templates(spark, d):
    """Structured texts made from the attribute values: one file each."""
    v = values(spark, d).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("value_id", "name", "value"))).alias("a"))
    attrs = F.transform("a", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    return v.select("file_id", soif.write_text(F.lit("FILE"), F.concat(F.lit("file:"), F.col("file_id").cast("string")), attrs).alias("text"))


SOIF_SQL = f"WITH {VAL} SELECT file_id, '@FILE {{ file:' || file_id || chr(10) || string_agg(name || '{{' || strlen(value) || '}}:' || chr(9) || value || chr(10), '' ORDER BY value_id, name, value) || '}}' || chr(10) AS text FROM v GROUP BY 1"


@query(SOIF_SQL)
def soif_print(spark, d):
    return templates(spark, d)


@query(f"WITH {VAL} SELECT file_id, name, value, CAST(strlen(value) AS INTEGER) AS vsize, 'FILE' AS type FROM v")
def soif_parse(spark, d):
    return soif.read(templates(spark, d)).select("file_id", F.explode("attrs").alias("a"), "type").select("file_id", "a.*", "type")


@query(f"WITH {VAL} SELECT DISTINCT file_id, file_id % 3 > 0 AS ok FROM v")
def soif_valid(spark, d):
    """Every third record lacks its end."""
    whole = F.col("text")
    broken = templates(spark, d).withColumn("text", F.when(F.col("file_id") % 3 == 0, F.expr("substring(text, 1, length(text) - 2)")).otherwise(whole))
    return soif.read(broken).select("file_id", "ok")


@query(f"WITH {VAL}, w AS (SELECT * FROM v WHERE value <> '') SELECT file_id, '@FILE {{ u' || chr(10) || string_agg(name || '{{' || strlen(value) || '}}:' || chr(9) || value || chr(10), '' ORDER BY name, value) || '}}' || chr(10) AS text FROM w GROUP BY 1")
def soif_sorted(spark, d):
    """Attributes in order of their names, empty ones left out."""
    v = values(spark, d).groupBy("file_id").agg(F.collect_list(F.struct("name", "value")).alias("a")).filter(F.exists("a", lambda x: x["value"] != ""))
    return v.select("file_id", soif.sorted_text(F.lit("FILE"), F.lit("u"), F.col("a")).alias("text"))


PC = "SELECT file_id, '((\".\" \"p' || file_id % 7 || '\" \"' || replace(path, '\"', '') || '\") \"1994-01-01\" ' || coalesce(size, 0) || ' \"about\")' AS rec FROM f"


@query(f"WITH {FIL} SELECT file_id, './p' || file_id % 7 || '/' || path AS path, '1994-01-01' AS date, coalesce(size, 0) AS size, 'about' AS description FROM f")
def pc_index(spark, d):
    f = files(spark, d)
    line = F.concat(F.lit('(("." "p'), (F.col("file_id") % 7).cast("string"), F.lit('" "'), "path", F.lit('") "1994-01-01" '), F.coalesce("size", F.lit(0)).cast("string"), F.lit(' "about")'))
    return soif.pc_index(f.select("file_id", F.lit(1).alias("rec_no"), line.alias("rec"))).drop("rec_no")


@query(f"WITH {FIL} SELECT 'd' || file_id % 20 || '.edu' AS domain2, array_to_string(list_sort(list(DISTINCT 'h' || file_id % 3 || '.d' || file_id % 20 || '.edu')), ' ') AS domains, array_to_string(list_sort(list(DISTINCT 'org ' || file_id % 5)), ';') AS organisations, array_to_string(list_sort(list(DISTINCT 'host' || file_id)), ' ') AS hosts FROM f GROUP BY 1")
def seed_domains(spark, d):
    """Seed files, one for each file, read and grouped by second-level domain."""
    i = F.col("file_id")
    text = F.concat(F.lit("%D h"), (i % 3).cast("string"), F.lit(".d"), (i % 20).cast("string"), F.lit(".edu\n%O org "), (i % 5).cast("string"), F.lit("\n%H host"), i.cast("string"))
    out = soif.by_domain(soif.seed_records(T.records(files(spark, d).select("file_id", text.alias("text")))))
    return out.select("domain2", listed("domains").alias("domains"), F.array_join("organisations", ";").alias("organisations"), listed("hosts").alias("hosts"))


@query(f"WITH {FIL} SELECT file_id, CASE WHEN file_id % 7 > 0 THEN 'ftp://' || CASE WHEN file_id % 4 > 0 THEN 'site' || file_id % 4 || '.org' ELSE 'other' END || '/' || CASE WHEN file_id % 5 = 0 THEN '' ELSE 'pub/x/' END || 'f' || file_id || '.tgz' END AS url FROM f")
def lsm_urls(spark, d):
    i = F.col("file_id")
    site = F.when(i % 4 > 0, F.concat(F.lit("Site1 = site"), (i % 4).cast("string"), F.lit(".org\n"))).otherwise("")
    text = F.concat(F.lit("Title = t\n"), site, F.when(i % 5 == 0, "").otherwise("Path1 = /pub/x/\n"), F.when(i % 7 > 0, F.concat(F.lit("File1 = f"), i.cast("string"), F.lit(".tgz\n"))).otherwise(""), F.lit("Site2 = other"))
    return soif.lsm_url(soif.from_fields(T.records(files(spark, d).select("file_id", text.alias("text"))), "=", True))


FIELD = "regexp_matches(rec, '^([A-Za-z][A-Za-z0-9_-]*)[ \\t]*:[ \\t]*(.*)$')"


def _fields(sep: str, name: str) -> str:
    q = f"'^([A-Za-z][A-Za-z0-9_-]*)[ \\t]*{sep}[ \\t]*(.*)$'"
    return f"""WITH {REC}, a AS (SELECT file_id, rec_no, nullif(regexp_extract(rec, {q}, 1), '') AS name, CASE WHEN nullif(regexp_extract(rec, {q}, 1), '') IS NOT NULL THEN regexp_extract(rec, {q}, 2) ELSE trim(rec, ' ') END AS part FROM r),
b AS (SELECT *, count(name) OVER (PARTITION BY file_id ORDER BY rec_no) AS n FROM a)
SELECT file_id, {name} AS name, string_agg(part, chr(10) ORDER BY rec_no) AS value, CAST(n AS INTEGER) AS n FROM b WHERE n > 0 GROUP BY file_id, n"""


@query(_fields(":", "max(name)"))
def iafa_to_soif(spark, d):
    return soif.from_fields(recs(spark, d))


@query(_fields("=", "CASE WHEN regexp_replace(max(name), '[0-9]$', '') = 'Desc' THEN 'Description' ELSE regexp_replace(max(name), '[0-9]$', '') END"))
def lsm_to_soif(spark, d):
    return soif.from_fields(recs(spark, d), "=", True)


@query(f"WITH {VAL}, w AS (SELECT file_id FROM v GROUP BY 1 HAVING bool_or(name = 'title' AND contains(value, 'the'))) SELECT CAST(file_id AS VARCHAR) AS path, name, value AS rec FROM v WHERE name = 'title' AND contains(value, 'the') AND file_id IN (SELECT file_id FROM w)")
def request_attributes(spark, d):
    """Structured texts: a term limited to an attribute, with the attribute's name."""
    return Corpus.from_df(templates(spark, d)).request(["-a", "title=the"])


@query(f"WITH {VAL} SELECT file_id, name, string_agg(value, chr(10) ORDER BY value_id, value) AS value FROM v GROUP BY ALL")
def attr_append(spark, d):
    return A.appended(values(spark, d))


MERGED = f"{VAL}, x AS (SELECT file_id, name, value FROM v QUALIFY row_number() OVER (PARTITION BY file_id, name ORDER BY value_id, value) = 1), y AS (SELECT file_id, name, value FROM v QUALIFY row_number() OVER (PARTITION BY file_id, name ORDER BY value_id DESC, value DESC) = 1)"


@query(f"WITH {MERGED} SELECT file_id, name, coalesce(y.value, x.value) AS value FROM (SELECT * FROM x WHERE file_id % 3 > 0) x FULL JOIN (SELECT * FROM y WHERE file_id % 3 < 2) y USING (file_id, name)")
def attr_merge(spark, d):
    v = values(spark, d)
    first, last = (v.groupBy("file_id", "name").agg(f(F.struct("value_id", "value")).alias("s")).select("file_id", "name", "s.value") for f in (F.min, F.max))
    return A.merged(first.filter("file_id % 3 > 0"), last.filter("file_id % 3 < 2"))


@query(f"WITH {VAL} SELECT file_id, string_agg(value, chr(10) ORDER BY value_id, value) AS title FROM v WHERE name = 'title' GROUP BY 1")
def attr_get(spark, d):
    return A.as_map(A.appended(values(spark, d))).select("file_id", F.try_element_at("attrs", F.lit("title")).alias("title")).filter("title is not null")


@query(f"WITH {VAL}, a AS (SELECT file_id, name, string_agg(value, chr(10) ORDER BY value_id, value) AS value FROM v GROUP BY ALL) SELECT file_id, 'state' AS name, 'new' AS value FROM (SELECT DISTINCT file_id FROM a) UNION ALL SELECT file_id, name, CASE WHEN name = 'title' THEN 'none' ELSE value END FROM a UNION ALL SELECT file_id, 'title', 'none' FROM (SELECT file_id FROM a GROUP BY 1 HAVING NOT bool_or(name = 'title'))")
def attr_put(spark, d):
    m = A.as_map(A.appended(values(spark, d)))
    return m.select("file_id", F.explode(A.put(A.put(F.col("attrs"), "title", F.lit("none")), "state", F.lit("new"))).alias("name", "value"))


@query(f"WITH {VAL} SELECT file_id, 'Embed<' || (file_id % 4) || '>-' || name AS name, string_agg(value, chr(10) ORDER BY value_id, value) AS value FROM v GROUP BY ALL")
def attr_embed(spark, d):
    m = A.as_map(A.appended(values(spark, d)))
    return m.select("file_id", F.explode(A.embedded(F.col("attrs"), F.col("file_id") % 4)).alias("name", "value"))


@query(f"WITH {VAL}, n AS (SELECT DISTINCT file_id, 'Embed<2>-embed<1>-' || name AS name FROM v) SELECT file_id, regexp_replace(name, '^((embed|Embed|EMBED)<[^>]*>[^A-Za-z0-9]*)+', '') AS name FROM n")
def attr_unembed(spark, d):
    n = values(spark, d).select("file_id", F.concat(F.lit("Embed<2>-embed<1>-"), F.col("name")).alias("name")).distinct()
    return n.select("file_id", A.plain_name(F.col("name")).alias("name"))


EMB = f"{VAL}, e AS (SELECT DISTINCT file_id, CASE WHEN attr_no % 3 = 0 THEN 'Embed<' || (attr_no % 12) || '>-' || name ELSE name END AS name, CASE WHEN attr_no % 3 = 0 THEN attr_no % 12 ELSE -1 END AS k, lower(name) AS l FROM v)"


def _embedded_names(spark, d):
    name = F.when(F.col("attr_no") % 3 == 0, F.concat(F.lit("Embed<"), (F.col("attr_no") % 12).cast("string"), F.lit(">-"), F.col("name"))).otherwise(F.col("name"))
    return values(spark, d).select("file_id", name.alias("name")).distinct().groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("name"))).alias("a"))


@query(f"WITH {EMB} SELECT file_id, string_agg(name, ' ' ORDER BY k, l, name) AS names FROM e GROUP BY 1")
def attr_sort(spark, d):
    return _embedded_names(spark, d).select("file_id", F.array_join(F.transform(A.sorted_attrs(F.col("a")), lambda x: x["name"]), " ").alias("names"))


@query(f"WITH {EMB} SELECT file_id, string_agg(name, ' ' ORDER BY CAST(k >= 0 AS INT), name) AS names FROM e GROUP BY 1")
def attr_sink_embedded(spark, d):
    return _embedded_names(spark, d).select("file_id", F.array_join(F.transform(A.sink_embedded(F.col("a")), lambda x: x["name"]), " ").alias("names"))


@query(f"WITH {VAL} SELECT value_id, a.name AS attr_name, value FROM v JOIN attributes a ON a.name = v.name WHERE contains(value, 'the')")
def print_attr(spark, d):
    names = load(spark, d, "attributes").select(F.col("name").alias("attr_name"))
    hit = values(spark, d).filter(compile("the", "value"))
    return hit.join(I.maybe_broadcast(names), F.col("name") == F.col("attr_name")).select("value_id", "attr_name", "value")


REGION = f"{VAL}, g AS (SELECT DISTINCT file_id, off AS b, length(value) AS l, attr_no FROM v), i AS (SELECT DISTINCT index AS file_id, off FROM indices WHERE index IS NOT NULL)"


@query(f"WITH {REGION} SELECT DISTINCT CAST(i.file_id AS BIGINT) AS file_id, i.off, coalesce(g.attr_no, 0) AS attr_id FROM i LEFT JOIN g ON i.file_id = g.file_id AND i.off >= b AND i.off < b + l")
def region_join(spark, d):
    v = values(spark, d).select("file_id", F.col("attr_no").alias("attr_id"), "off", "value")
    offs = load(spark, d, "indices").filter(F.col("index").isNotNull()).select(F.col("index").cast("long").alias("file_id"), "off").distinct()
    return A.region_join(offs, soif.regions(v)).distinct()


LINKS = "<a href=\"{0}.html\"><img SRC=\"/i/{0}.gif\"><a href=\"mailto:x@y\"><a href=\"ftp://z/{0}\">"
URLS = "WITH u AS (SELECT doc_id AS file_id, unnest(regexp_extract_all(text || replace('" + LINKS + "', '{0}', doc_id::VARCHAR), '(?i)(?:href|src)=\"([^\"]*)\"', 1)) AS ref, 'http://host.example/a/b.html' AS base FROM documents)"


@query(URLS + " SELECT file_id, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref WHEN starts_with(ref, '/') THEN 'http://host.example' || ref ELSE 'http://host.example/a/' || ref END AS url FROM u WHERE NOT starts_with(lower(ref), 'mailto:')")
def url_refs(spark, d):
    with_links = F.concat("text", F.replace(F.lit(LINKS), F.lit("{0}"), F.col("file_id").cast("string")))
    refs = docs(spark, d).select("file_id", F.explode(F.regexp_extract_all(with_links, F.lit('(?i)(?:href|src)="([^"]*)"'), F.lit(1))).alias("ref"))
    return refs.select("file_id", A.normal_url(F.col("ref"), F.lit("http://host.example/a/b.html")).alias("url")).filter("url is not null")


# maintenance (2.11)

CUT = "TIMESTAMP '1998-04-01 00:00:00'"


def cut():
    return F.lit("1998-04-01").cast("timestamp_ntz")


def stale(f: DataFrame) -> DataFrame:
    """The documents as they were: those that changed later had other words."""
    changed = F.coalesce(F.col("mtime") > cut(), F.lit(True))
    return f.withColumn("text", F.when(changed, F.concat(F.lit("stale words "), F.substring("text", 1, 300))).otherwise(F.col("text")))


@query(f"WITH {POST} SELECT word, file_id, tf FROM p WHERE file_id % 11 > 0")
def incremental_update(spark, d):
    """An index of texts that changed since, brought up to date, without the files that vanished."""
    f = docs(spark, d)
    return I.updated(I.postings_file(stale(f)), f, cut(), f.filter("file_id % 11 = 0"))


@query(f"WITH {OFFSETS} SELECT word, file_id, array_to_string(list_sort(list(off)), ' ') AS offsets FROM o WHERE file_id % 11 > 0 GROUP BY ALL")
def incremental_offsets(spark, d):
    """The same for the offsets of a saved index with all its parts."""
    f = docs(spark, d)
    old = I.Index.build(stale(f), offsets=True, records=True).save(scratch_dir(spark, "query-index"))
    new = old.updated(f, cut(), f.filter("file_id % 11 = 0")).save(scratch_dir(spark, "query-index"))
    return new.offsets.select("word", "file_id", listed("offsets").alias("offsets"))


@query(f"WITH {REC}, w AS (SELECT file_id, rec_no, unnest(regexp_extract_all(lower(rec), '[\\p{{L}}_]+')) AS word FROM r) SELECT DISTINCT word, file_id, rec_no FROM w WHERE length(word) <= 64")
def merged_records(spark, d):
    """Record indexes of two halves of the files, saved and merged."""
    f = docs(spark, d)
    a, b = (I.Index.build(f.filter(f"file_id % 2 = {n}"), records=True).save(scratch_dir(spark, "query-index")) for n in (0, 1))
    return a.merged(b).save(scratch_dir(spark, "query-index")).records


@query(f"WITH {POST} SELECT word, df, tf FROM v")
def index_vocabulary(spark, d):
    """The vocabulary of a saved index."""
    return saved(spark, d).vocab


@query("SELECT doc_id AS file_id, concat(coalesce(source, 'none'), '/', doc_id, '.txt') AS path, strlen(text) AS size, received_at AS mtime FROM documents")
def index_files(spark, d):
    return saved(spark, d).files


@query(f"WITH {POST} SELECT word, file_id, tf FROM p")
def index_add(spark, d):
    f = docs(spark, d)
    return I.postings_file(f.filter("file_id % 2 = 0")).unionByName(I.postings_file(f.filter("file_id % 2 = 1")))


@query(f"WITH {POST} SELECT word, file_id, tf FROM p WHERE file_id % 3 > 0")
def index_delete(spark, d):
    f = docs(spark, d)
    return I.without(I.postings_file(f), f.filter("file_id % 3 = 0"))


@query(f"WITH {POST} SELECT word, file_id, tf * (1 + CAST(file_id % 2 = 0 AS INT)) AS tf FROM p")
def merge_indexes(spark, d):
    f = docs(spark, d)
    return I.merged(I.postings_file(f), I.postings_file(f.filter("file_id % 2 = 0")))


@query(f"WITH {FIL}, {TPOST} SELECT word, file_id FROM tp WHERE file_id IN (SELECT file_id FROM f WHERE NOT deleted)")
def index_tombstone(spark, d):
    return token_postings(spark, d).join(files(spark, d).filter("not deleted").select("file_id"), "file_id", "left_semi").select("word", "file_id")


@query(f"WITH {FIL} SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS new_id FROM f WHERE NOT deleted")
def purge_renumber(spark, d):
    return I.renumbered(files(spark, d))


@query(hits("contains(rec, 'would')"))
def stale_files(spark, d):
    f = docs(spark, d)
    idx = I.Index.build(f.filter(F.col("mtime") <= cut())).save(scratch_dir(spark, "query-index"))
    return S.stale_union(f, lambda some, index: S.search(some, "would", index), idx, cut())


@query("SELECT DISTINCT index AS file_id FROM indices WHERE index IS NOT NULL AND index NOT IN (SELECT file_id FROM files WHERE file_id IS NOT NULL AND coalesce(path, '') <> '')")
def missing_files(spark, d):
    known = load(spark, d, "files").filter("coalesce(path, '') <> ''").select("file_id")
    named = load(spark, d, "indices").filter(F.col("index").isNotNull()).select(F.col("index").alias("file_id")).distinct()
    return named.join(known, "file_id", "left_anti")


# compression (2.14)

CAST = "w AS (SELECT word, count(*) AS freq, length(word) * count(*) AS weight FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) GROUP BY 1 HAVING length(word) * count(*) >= 16)"


@query(f"WITH {CAST} SELECT word, freq, weight FROM w")
def cast_dictionary(spark, d):
    return compress.weights(docs(spark, d))


@query(f"WITH {CAST} SELECT word, freq, weight FROM w ORDER BY weight DESC, word LIMIT 500")
def cast_top_words(spark, d):
    return compress.top_words(compress.weights(docs(spark, d)), 500)


def _coded(spark, d):
    f = docs(spark, d).filter("text is not null")
    words = compress.dictionary(compress.weights(f))
    return f.select("file_id", "text", compress.encode(F.col("text"), words).alias("code")), words


DICT = f"{CAST}, k AS (SELECT word, row_number() OVER (ORDER BY weight DESC, word) - 1 AS n FROM w QUALIFY n < {compress.MOST_WORDS})"


@query(f"WITH {DICT}, e AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') AS a FROM documents WHERE text IS NOT NULL)), x AS (SELECT doc_id, string_agg(CASE WHEN n IS NULL THEN piece ELSE chr(1) || n || chr(2) END, '' ORDER BY i) AS code FROM e LEFT JOIN k ON piece = word GROUP BY 1) SELECT doc_id AS file_id, coalesce(code, '') AS code FROM documents LEFT JOIN x USING (doc_id) WHERE text IS NOT NULL")
def cast_encode(spark, d):
    """The whole code as text: numbers between two marks."""
    text = F.array_join(F.transform("code", lambda c: F.when(c["id"].isNull(), c["raw"]).otherwise(F.concat(F.lit("\x01"), c["id"].cast("string"), F.lit("\x02")))), "")
    return _coded(spark, d)[0].select("file_id", text.alias("code"))


@query(f"WITH {DICT}, e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), g AS (SELECT doc_id, sum(greatest(length(word) - 2, 0)) AS saved FROM e JOIN k USING (word) GROUP BY 1) SELECT doc_id AS file_id, doc_id % 3 > 0 AND coalesce(saved, 0) >= 0.1 * length(text) AS yes FROM documents LEFT JOIN g USING (doc_id) WHERE text IS NOT NULL")
def cast_compressible(spark, d):
    """Whether a text is worth encoding; every third one is PostScript."""
    words = compress.dictionary(compress.weights(docs(spark, d).filter("text is not null")))
    own = docs(spark, d).filter("text is not null")
    text = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("%!PS-Adobe-3.0\n"), "text")).otherwise(F.col("text"))
    return own.select("file_id", compress.compressible(text, words).alias("yes"))


_W = "regexp_matches(text, '(^|[^A-Za-z]){}($|[^A-Za-z])')"


@query(f"SELECT doc_id AS file_id FROM documents WHERE {_W.format('(?i:would)')} AND NOT ({_W.format('(?i:there)')} OR {_W.format('(?i:zzz)')})")
def search_encoded_tree(spark, d):
    """A tree of words among the numbers, in any case."""
    rows, words = _coded(spark, d)
    return rows.filter(compress.matches(F.col("code"), "WOULD;~{there,zzz}", words, icase=True)).select("file_id")


@query("SELECT doc_id AS file_id, text FROM documents WHERE text IS NOT NULL")
def cast_roundtrip(spark, d):
    rows, words = _coded(spark, d)
    return rows.select("file_id", compress.decode(F.col("code"), words).alias("text"))


@query("SELECT doc_id AS file_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z])would($|[^A-Za-z])')")
def search_encoded(spark, d):
    rows, words = _coded(spark, d)
    return rows.filter(compress.contains_word(F.col("code"), "would", words)).select("file_id")


# balance (problem 3)

P3_SQL = """
WITH d AS (SELECT DISTINCT token_id, index, off FROM indices WHERE index IS NOT NULL),
     g AS (SELECT index, off - lag(off) OVER (PARTITION BY index ORDER BY off) AS gap FROM d),
     r AS (SELECT index, count(*) AS n_rows FROM d GROUP BY 1),
     m AS (SELECT index, coalesce(max(gap), 0) AS max_gap FROM g GROUP BY 1),
     w AS (SELECT d.index, count(DISTINCT lower(t.word)) AS n_words FROM d JOIN token t USING (token_id) GROUP BY 1)
SELECT r.index, n_rows, coalesce(n_words, 0) AS n_words, max_gap FROM r JOIN m USING (index) LEFT JOIN w USING (index)
"""


@query(P3_SQL)
def p3_found(spark, d):
    occurrences = load(spark, d, "indices").select(F.col("index").alias("key"), F.col("token_id").alias("item"), "off")
    words = load(spark, d, "token").select(F.col("token_id").alias("item"), F.lower("word").alias("word"))
    return skew.key_profile(occurrences, words).withColumnRenamed("key", "index")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
