"""Queries of the llm operators over the test tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textdex.llm import distinctive, encode, heavy, leaks, looks, mojibake, termcounts
from textdex.operators.index import maybe_broadcast
from textdex.session import load, written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """A load of what was delivered in the first nineteen twentieths of the time, then an update with every record that
    anything came for later: whole records, added or changed."""
    tokens = load(spark, d, "token")
    first, last = tokens.agg(F.min("added_at"), F.max("added_at")).first()
    cut = F.lit(first + (last - first) * 0.95) if first else F.lit(None).cast("timestamp_ntz")
    early, late = tokens.filter(F.coalesce(F.col("added_at") <= cut, F.lit(True))), tokens.filter(F.col("added_at") > cut)
    touched = maybe_broadcast(written(late.select("file_id", "rec_no").distinct(), "touched"))
    same = tokens["file_id"].eqNullSafe(touched["file_id"]) & tokens["rec_no"].eqNullSafe(touched["rec_no"])
    store = termcounts.TermStore(spark).update(termcounts.record_terms(early))
    store.update(termcounts.record_terms(tokens.join(touched, same, "left_semi")))
    return termcounts.marked_counts(store.counts(), store.n_records(), load(spark, d, "hash_entry"))


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same counts, reached by additions, changes and deletions: half of the files, and each of them a second time under
    another number; then the other half, and the first with doubled counts; then the true counts, and the second copies
    deleted."""
    new = written(termcounts.record_terms(load(spark, d, "token")), "record-terms")
    half, copies = new.filter("file_id % 2 = 0"), new.filter("file_id % 2 = 0").withColumn("file_id", -1 - F.col("file_id"))
    store = termcounts.TermStore(spark).update(half.unionByName(copies))
    store.update(new.withColumn("occ", F.col("occ") * (1 + F.pmod(F.col("file_id") + 1, F.lit(2)))))
    store.update(half, copies.select("file_id", "rec_no"))
    return termcounts.marked_counts(store.counts(), store.n_records(), load(spark, d, "hash_entry"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_totals(spark, d).select("word")


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    words = load(spark, d, "hash_entry").select(F.lower("word").alias("word"), "freq")
    return heavy.heavy_hitters(words, "word", "freq", 0.001).select(F.col("value").alias("word"), F.col("total").alias("freq"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair(load(spark, d, "attr_value"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_terms(load(spark, d, "token"), "tf_idf").select("file_id", "rec_no", "word", "attribute")


def p5_zscores(spark: SparkSession, d: str) -> DataFrame:
    rows = distinctive.distinctive_terms(load(spark, d, "token"), "log_odds")
    return rows.select("file_id", "rec_no", "word", "attribute", "n", "df", "score")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(load(spark, d, "documents"), tokenizer="byte_bpe_50k")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).filter("run >= 12").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(load(spark, d, "documents"), load(spark, d, "benchmark"), words=12, budget=1)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return looks.look_pairs(load(spark, d, "documents")).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return looks.look_classes(load(spark, d, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_texts")


P1_SQL = """
WITH t AS (SELECT token_id, file_id, rec_no, lower(any_value(word)) AS word, coalesce(max(totalcount), 0) AS n
           FROM token GROUP BY ALL),
     r AS (SELECT count(DISTINCT (file_id, rec_no)) AS n FROM t),
     c AS (SELECT word, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT (file_id, rec_no)) AS n_records FROM t WHERE word IS NOT NULL GROUP BY word),
     h AS (SELECT lower(word) AS word, CAST(sum(coalesce(freq, 0)) AS BIGINT) AS f FROM hash_entry WHERE word IS NOT NULL GROUP BY 1)
SELECT c.word, occurrences, n_records, coalesce(f, 0) AS dict_freq,
       CASE WHEN n_records = 1 THEN 'rare' WHEN n_records * 10 >= (SELECT n FROM r) THEN 'common' ELSE 'kept' END AS mark
FROM c LEFT JOIN h USING (word)
"""

P2_SQL = """
SELECT lower(word) AS word, CAST(sum(freq) AS BIGINT) AS freq FROM hash_entry WHERE word IS NOT NULL
GROUP BY 1 HAVING sum(freq) >= (SELECT sum(freq) FROM hash_entry) / 1000.0
"""

P5_TERMS = """
t AS (SELECT token_id, file_id, rec_no, lower(any_value(word)) AS word, coalesce(any_value(attribute), 0) AS attribute, coalesce(max(totalcount), 0) AS c
      FROM token GROUP BY token_id, file_id, rec_no HAVING any_value(word) IS NOT NULL),
r AS (SELECT file_id, rec_no, word, attribute, sum(c) AS n FROM t GROUP BY ALL),
f AS (SELECT word, attribute, count(*) AS df, sum(n) AS total FROM r GROUP BY ALL),
"""

P5_SQL = f"""
WITH {P5_TERMS}
s AS (SELECT r.*, round(n * ln((SELECT count(DISTINCT (file_id, rec_no)) FROM r) / df), 6) AS score FROM r JOIN f USING (word, attribute) WHERE df >= 2)
SELECT file_id, rec_no, word, attribute FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY file_id, rec_no ORDER BY score DESC, word, attribute) <= 3
"""

P5Z_SQL = f"""
WITH {P5_TERMS}
z AS (SELECT file_id, rec_no, sum(n) AS size FROM r GROUP BY ALL),
g AS (SELECT CAST(sum(size) AS DOUBLE) AS a, CAST(sum(size) AS DOUBLE) / count(*) AS m FROM z),
x AS (SELECT r.*, df, total, CAST(size AS DOUBLE) AS size, g.a AS alln, m, m * total / g.a AS a FROM r JOIN f USING (word, attribute) JOIN z USING (file_id, rec_no), g WHERE df >= 2),
s AS (SELECT *, round((ln((n + a) / (size + m - n - a)) - ln((total - n + a) / (alln - size + m - (total - n) - a))) / sqrt(1 / (n + a) + 1 / (total - n + a)), 6) AS score FROM x)
SELECT file_id, rec_no, word, attribute, CAST(n AS BIGINT) AS n, df, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY file_id, rec_no ORDER BY score DESC, word, attribute) <= 3
"""


# The one form by SQL's own functions: what the tables hold of presentation forms, blanks, invisible characters and letters
# of other scripts, written out by rule.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_BLANKS = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
_ALIKE = {c: plain for plain, others in looks.LOOK_ALIKE.items() for c in others}
_FROM = _WIDE + _BLANKS + "".join(_ALIKE)
_TO = "".join(map(chr, range(0x21, 0x7F))) + " " * len(_BLANKS) + "".join(_ALIKE.values())
_GONE = "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in looks.IGNORABLE) + "\\x00-\\x08\\x0E-\\x1F\\x7F]"
_FORM = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
for _a, _b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("…", "...")):
    _FORM = f"replace({_FORM}, '{_a}', '{_b}')"
_FROM_SQL, _TO_SQL = (x.replace("'", "''") for x in (_FROM, _TO))
P8_FORMS = f"""f AS (SELECT doc_id, text, nfc_normalize(translate(regexp_replace({_FORM}, '{_GONE}', '', 'g'), '{_FROM_SQL}', '{_TO_SQL}')) AS form FROM documents WHERE text IS NOT NULL),
g AS (SELECT * FROM f WHERE regexp_matches(form, '[^ \\t\\n]'))"""
P8_SQL = f"WITH {P8_FORMS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id"
P8C_SQL = f"WITH {P8_FORMS}, c AS (SELECT form, min(doc_id) AS class_id, count(DISTINCT text) AS n_texts FROM g GROUP BY 1 HAVING count(DISTINCT text) > 1) SELECT doc_id, class_id, n_texts FROM g JOIN c USING (form)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_incremental, p2_found, p2_totals, p4_found, p5_found, p5_zscores, p6_ids, p7_found, p7_leaks, p8_found, p8_classes)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL, "p1_incremental": P1_SQL, "p2_found": f"SELECT word FROM ({P2_SQL})", "p2_totals": P2_SQL,
        "p5_found": P5_SQL, "p5_zscores": P5Z_SQL, "p8_found": P8_SQL, "p8_classes": P8C_SQL,
    }
