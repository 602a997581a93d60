"""Searchable word compression: frequent words become numbers, other text stays; a pattern is searched among the numbers."""

from __future__ import annotations

import functools
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textdex.plans import pattern as P
from textdex.sources import files as SF

#: Least length times frequency of a dictionary word, and most words.
LEAST_WEIGHT, MOST_WORDS = 16, 4096
_PIECES = r"([A-Za-z]+|[^A-Za-z]+)"


def pieces(text: Column) -> Column:
    """Words and what lies between them, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(r"(?s)" + _PIECES), F.lit(1))


def weights(texts: DataFrame, least: int = LEAST_WEIGHT) -> DataFrame:
    """(word, freq, weight): words of (text) as they stand with length * frequency at least `least`."""
    words = texts.select(F.explode(F.filter(pieces(F.col("text")), lambda w: w.rlike("^[A-Za-z]"))).alias("word"))
    out = words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).withColumn("weight", F.length("word") * F.col("freq"))
    return out.filter(F.col("weight") >= least)


def top_words(weighted: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """The heaviest words, ties by word."""
    return weighted.orderBy(F.desc("weight"), "word").limit(most)


def dictionary(weighted: DataFrame, most: int = MOST_WORDS) -> dict[str, int]:
    """Number of each of the heaviest words, at most `most`."""
    return {r["word"]: n for n, r in enumerate(top_words(weighted, most).collect())}


#: Parts of the dictionary: a map column is searched from end to end, so it is cut by a hash of the word.
PARTS = 256


def _numbers(words: dict[str, int]):
    """Column of words -> column of their numbers, null for others."""
    parts: list[dict[str, int]] = [{} for _ in range(PARTS)]
    for w, n in words.items():
        parts[zlib.crc32(w.encode()) % PARTS][w] = n
    none = F.create_map().cast("map<string,int>")
    table = F.array(*[F.map_from_arrays(F.lit(list(p)), F.lit(list(p.values()))) if p else none for p in parts])
    return lambda w: F.try_element_at(F.element_at(table, (F.pmod(F.crc32(w), F.lit(PARTS)) + 1).cast("int")), w)


def encode(text: Column, words: dict[str, int]) -> Column:
    """array<struct<id INT, raw STRING>>: a dictionary word as its number, anything else as raw text."""
    number = _numbers(words)
    coded = F.transform(pieces(text), lambda w: F.struct(number(w).alias("id"), w.alias("raw")))
    return F.transform(coded, lambda c: F.struct(c["id"].alias("id"), F.when(c["id"].isNull(), c["raw"]).alias("raw")))


def decode(code: Column, words: dict[str, int]) -> Column:
    """The text again."""
    back = F.lit(list(words)) if words else F.array().cast("array<string>")
    return F.array_join(F.transform(code, lambda c: F.coalesce(c["raw"], F.try_element_at(back, c["id"] + 1))), "")


#: What a record of encoded text begins with.
SIGNATURE = "\u0001cast"


def compressible(text: Column, words: dict[str, int], gain: float = 0.1) -> Column:
    """Whether a text is worth encoding: not encoded already, no binary, uuencoded or PostScript text, and shorter by at
    least `gain` if dictionary words take two characters. Null for null."""
    saved = F.aggregate(pieces(text), F.lit(0), lambda acc, w: acc + F.when(_numbers(words)(w).isNotNull(), F.greatest(F.length(w) - 2, F.lit(0))).otherwise(0))
    usual = ~(SF.is_binary(text) | SF.is_uuencoded(text) | SF.is_postscript(text) | text.startswith(SIGNATURE))
    return usual & (saved >= gain * F.length(text))


def build_dictionary(texts: DataFrame, path: str, most: int = MOST_WORDS, least: int = LEAST_WEIGHT) -> dict[str, int]:
    """Job: the dictionary of (text), saved as a table (word, id) at `path`."""
    words = dictionary(weights(texts, least), most)
    texts.sparkSession.createDataFrame(list(words.items()), "word string, id int").coalesce(1).write.mode("overwrite").parquet(path)
    return words


def open_dictionary(spark: SparkSession, path: str) -> dict[str, int]:
    """A saved dictionary, in order of its numbers; it has at most as many words as it was made with."""
    return {r["word"]: r["id"] for r in spark.read.parquet(path).orderBy("id").collect()}


def encode_files(files: DataFrame, words: dict[str, int], gain: float = 0.1) -> DataFrame:
    """Job: `files` (text, ...) with code: the encoded text where it is worth it and null elsewhere; text then is null."""
    fit = F.coalesce(compressible(F.col("text"), words, gain), F.lit(False))
    return files.withColumn("code", F.when(fit, encode(F.col("text"), words))).withColumn("text", F.when(~fit, F.col("text")))


def decode_files(files: DataFrame, words: dict[str, int]) -> DataFrame:
    """Job: the files that `encode_files` was given."""
    return files.withColumn("text", F.coalesce("text", decode(F.col("code"), words))).drop("code")


def matches(code: Column, pattern: str, words: dict[str, int], icase: bool = False) -> Column:
    """Whether the encoded text satisfies a pattern of whole words, joined by ; , ~ and {}, found without decoding. A term is
    a word of letters; other terms raise PatternError."""

    def of(q: P.Query) -> Column:
        if isinstance(q, P.Not):
            return ~of(q.of)
        if isinstance(q, (P.And, P.Or)):
            return of(q.left) & of(q.right) if isinstance(q, P.And) else of(q.left) | of(q.right)
        if not re.fullmatch("[A-Za-z]+", q.text) or q.attribute:
            raise P.PatternError(f"{q.text!r} is no word of letters")
        return contains_any(code, [q.text], words, icase)

    return of(P.parse(pattern))


def contains_any(code: Column, wanted: list[str], words: dict[str, int], icase: bool = False) -> Column:
    """Whether the encoded text has one of the words of letters as a whole word. Every spelling in the dictionary is looked
    for by its number, others as raw text."""
    low = {w.lower() for w in wanted}
    ids = [n for w, n in words.items() if (w.lower() in low if icase else w in wanted)]
    raw = sorted(low if icase else set(wanted) - set(words))
    spelt = lambda c: F.lower(c["raw"]) if icase else c["raw"]
    tests = []
    if ids:
        tests.append(lambda c: F.coalesce(c["id"].isin(ids), F.lit(False)))
    if raw:
        tests.append(lambda c: F.coalesce(spelt(c).isin(raw), F.lit(False)))
    if not tests:
        return F.lit(False)
    return F.exists(code, lambda c: functools.reduce(lambda a, b: a | b, [t(c) for t in tests]))


def contains_word(code: Column, word: str, words: dict[str, int]) -> Column:
    """Whether the encoded text has `word` as a whole word, found without decoding."""
    if word in words:
        return F.exists(code, lambda c: F.coalesce(c["id"] == words[word], F.lit(False)))
    return F.exists(code, lambda c: F.coalesce(c["raw"] == word, F.lit(False)))
