"""How distinctive a term is for a record, against the whole collection.

Two scores over the same statistics: z-scores of log-odds ratios with an informative Dirichlet prior (the prior is the
term's count in the collection), and occurrences times ln(N / df). The statistics are joined back to the records by the
balanced join of the core, since a few terms are in a large part of all records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textdex.llm.termcounts import latest
from textdex.operators.skew import fragment_replicate_join, plan_load
from textdex.session import written

RECORD, TERM = ["file_id", "rec_no"], ["word", "attribute"]


def term_counts(tokens: DataFrame) -> DataFrame:
    """(file_id, rec_no, word, attribute, n): occurrences of each term of each record.

    A repeated token_id counts once, as delivered last; words are in lower case; null words are left out; a null
    attribute is attribute 0; a null count adds 0, so a term of null counts only has n = 0.
    """
    rows = tokens.select("token_id", "file_id", "rec_no", F.lower("word").alias("word"), F.coalesce("attribute", F.lit(0)).alias("attribute"), "totalcount", "added_at")
    rows = latest(rows, ["token_id"], "added_at").filter("word is not null")
    return rows.groupBy(*RECORD, *TERM).agg(F.coalesce(F.sum(F.col("totalcount").cast("long")), F.lit(0)).alias("n"))


def distinctive_terms(tokens: DataFrame, score: str = "log_odds", top: int = 3, prior: float = 1.0) -> DataFrame:
    """(file_id, rec_no, word, attribute, n, df, score, rank): the `top` terms of each record by `score`.

    score "log_odds": z-score of the log-odds ratio of the record against the rest of the collection, each term's
    prior being `prior` times its share of the collection times the mean record length; "tf_idf": n * ln(N / df), N the
    records with a non-null word, df the records with the term. Scores are rounded to 6 decimals. Only terms in two or
    more records with a score above 0 take part; equal scores go by word (code points), then attribute. Records may have
    fewer rows or none; an empty table gives none.
    """
    if score not in ("log_odds", "tf_idf"):
        raise ValueError(f"score must be log_odds or tf_idf, not {score}")
    terms = written(term_counts(tokens), "record-terms")  # read for the statistics and again for the scores
    stats = terms.groupBy(*TERM).agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total")).filter("df >= 2")
    sizes = terms.groupBy(*RECORD).agg(F.sum("n").alias("size"))
    rows = fragment_replicate_join(terms, stats, TERM, plan_load(terms, TERM))
    if score == "tf_idf":
        n = sizes.count()
        value = F.col("n") * F.log(F.lit(float(n)) / F.col("df"))
    else:
        all_n, records = sizes.agg(F.sum("size"), F.count(F.lit(1))).first()
        all_n, mean = float(all_n or 0), float(all_n or 0) / max(1, records)
        rows = rows.filter("total > 0").join(sizes, RECORD)  # a term of null counts only has no odds
        a = F.lit(prior * mean) * F.col("total") / F.lit(max(all_n, 1.0))
        y, rest, a0 = F.col("n"), F.col("total") - F.col("n"), F.lit(prior * mean)
        inside = F.log((y + a) / (F.col("size") + a0 - y - a))
        outside = F.log((rest + a) / (F.lit(all_n) - F.col("size") + a0 - rest - a))
        value = (inside - outside) / F.sqrt(1 / (y + a) + 1 / (rest + a))
    rows = rows.withColumn("score", F.round(value, 6)).filter("score > 0")
    order = Window.partitionBy(*RECORD).orderBy(F.desc("score"), "word", "attribute")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return rows.select(*RECORD, *TERM, "n", "df", "score", "rank")
