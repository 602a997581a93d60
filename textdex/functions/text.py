"""Records, words and offsets of texts, as columns and generators. Offsets are in characters, from 0."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textdex.plans.pattern import quote

LETTERS = r"([\p{L}_]+)"
LETTERS_AND_DIGITS = r"([\p{L}\p{Nd}_]+)"
MAX_WORD = 64


def record_array(text: Column, delim: str = "\n", tail: bool = True) -> Column:
    """The records of a text: cut at every delimiter, which is left out. A delimiter at the end of the text adds no empty
    record and an empty text has none; a null text gives null."""
    out = F.split(text, quote(delim).replace("\n", "\\n"), -1)
    cut = F.when(text.endswith(delim), F.slice(out, 1, F.size(out) - 1)).otherwise(out)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def records(files: DataFrame, delim: str = "\n", offsets: bool = False) -> DataFrame:
    """(file_id, rec_no from 1, rec), with `offsets` also (begin, end) in the file. files: (file_id, text, ...).

    Null texts give no record; blank records are kept. Other columns are left out.
    """
    if offsets:
        return _spanned_records(files, delim)
    return files.select("file_id", F.posexplode(record_array(F.col("text"), delim)).alias("pos", "rec")).select("file_id", (F.col("pos") + 1).alias("rec_no"), "rec")


def _spanned_records(files: DataFrame, delim: str) -> DataFrame:
    """`records` with their spans, made text by text, so that no text is shuffled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in range(b.num_rows):
                text = b.column(1)[one].as_py()
                recs = text.split(delim) if text else []
                if recs and text.endswith(delim):
                    recs.pop()
                sizes = np.fromiter(map(len, recs), np.int64, len(recs))
                begin = np.cumsum(sizes + len(delim)) - sizes - len(delim)
                ids = pa.array([b.column(0)[one].as_py()] * len(recs), b.column(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(1, len(recs) + 1, dtype=np.int32)), pa.array(recs, pa.string()), pa.array(begin), pa.array(begin + sizes)], ["file_id", "rec_no", "rec", "begin", "end"])

    kind = dict(files.dtypes)["file_id"]
    return files.select("file_id", "text").filter("text is not null").mapInArrow(cut, f"file_id {kind}, rec_no int, rec string, begin long, end long")


def records_kept_delimiter(files: DataFrame, delim: str, tail: bool) -> DataFrame:
    """Records that keep their delimiter, at their end (tail) or at their head; an empty piece is no record."""
    q = quote(delim).replace("\n", "\\n")
    at = f"(?<={q})" if tail else f"(?={q})"
    out = files.select("file_id", F.posexplode(F.filter(F.split("text", at, -1), lambda r: r != "")).alias("pos", "rec"))
    return out.select("file_id", (F.col("pos") + 1).alias("rec_no"), "rec")


def word_array(text: Column, numbers: bool = False, fold: bool = True, longest: int = MAX_WORD) -> Column:
    """Words of a text: longest runs of letters and _ (with `numbers` also digits), in lower case; longer ones than
    `longest` are left out whole."""
    found = F.regexp_extract_all(F.lower(text) if fold else text, F.lit(LETTERS_AND_DIGITS if numbers else LETTERS), F.lit(1))
    return F.filter(found, lambda w: F.length(w) <= longest)


def tokens(files: DataFrame, numbers: bool = False) -> DataFrame:
    """(file_id, word): one row for each occurrence."""
    return files.select("file_id", F.explode(word_array(F.col("text"), numbers)).alias("word"))


def word_offsets(files: DataFrame, numbers: bool = False) -> DataFrame:
    """(file_id, off, word): occurrences with their begin in the file.

    The text is split into words and what lies between; begins are running sums of lengths, made once for each file, so no
    shuffle and no search for every word.
    """
    letters = r"\p{L}\p{Nd}_" if numbers else r"\p{L}_"
    ascii_letters = "A-Za-z0-9_" if numbers else "A-Za-z_"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        plain, any_ = re.compile(f"[{ascii_letters}]+|[^{ascii_letters}]+"), regex.compile(f"[{letters}]+|[^{letters}]+")
        first, first_any = re.compile(f"[{ascii_letters}]").match, regex.compile(f"[{letters}]").match
        for b in batches:
            ids, many, offs, words = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                ascii_ = t.isascii()
                parts = (plain if ascii_ else any_).findall(t)
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                begin = np.cumsum(sizes) - sizes
                start = 0 if (first if ascii_ else first_any)(t) else 1
                parts, sizes, begin = parts[start::2], sizes[start::2], begin[start::2]
                if len(sizes) and sizes.max() > MAX_WORD:
                    fit = sizes <= MAX_WORD
                    parts, begin = [w for w, ok in zip(parts, fit.tolist(), strict=True) if ok], begin[fit]
                ids.append(i), many.append(len(parts)), offs.append(begin)
                words += parts
            at = pa.array(np.repeat(np.arange(len(ids)), many))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type).take(at), pa.array(np.concatenate(offs) if offs else [], pa.int64()), pa.array(words, pa.string())], ["file_id", "off", "word"])

    kind = dict(files.dtypes)["file_id"]
    out = files.select("file_id", "text").filter("text is not null").mapInArrow(scan, f"file_id {kind}, off long, word string")
    return out.withColumn("word", F.lower("word"))


def case_class_words(text: Column) -> Column:
    """Words as they stand that are all small, Capital or ALL CAPITALS; mixed ones are left out."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z_]+)"), F.lit(1))
    return F.filter(found, lambda w: w.rlike(r"^([a-z_]+|[A-Z][a-z_]*|[A-Z_]+)$"))
