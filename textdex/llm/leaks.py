"""Held-out test items that leaked into documents: pigeonhole edit matching.

Every item is cut into pieces of consecutive words, short enough that any passage of `words` words holds budget + 1 whole
pieces: a passage copied with at most `budget` edits then has a piece that is intact. A piece has no blank at its ends, so
no two share a character and one edit breaks one piece at most; its outer words may be parts of longer ones, as where an
edit joined two. Pieces are found by one multi-pattern automaton over the document's words, and each hit is verified: by
the length of the exact run of words around it and, where that is short, by Myers' bit-parallel distance of the passages
that hold the piece.

More items than one automaton should hold are searched through a join of hashed pieces, in the same number of passes
whatever their number: `budget` edits, each of which spoils two words at most, leave budget + 1 runs of whole words, so one
of them has `gram_length` words. All runs of that length of the items are pieces then; a bitmap of their hashes, of bounded
size, decides on the documents' side which runs are shuffled, each with the words around it, and the join is balanced.

What is compared are words (unbroken letters and digits) of the text a mail reader shows, in folded case and one form for
characters that look the same, so case, punctuation, line breaks, quote marks, markup and transfer encodings do not count.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textdex.llm.looks import look
from textdex.llm.mailtext import shown_parts
from textdex.operators.skew import fragment_replicate_join
from textdex.session import written

_WORD = re.compile(r"[^\W_]+|\x1e")
#: Between the parts of a message; no run of words crosses it.
PART = "\x1e"
#: Words of items in one automaton, which is broadcast; with more, pieces are joined. Longer items are cut, with an overlap.
BLOCK_WORDS = 200_000
#: Bits of the bitmap for each piece, and the logarithm of the most bits it has; with more pieces it lets more pass.
BITS_A_PIECE, MOST_BITS = 16, 29
HITS = "doc_id long, item_id long, run int, distance int"


def words_of(text: str) -> list[str]:
    return _WORD.findall(look(text.replace(PART, " "), True))


def message_words(raw: str) -> list[str]:
    """Words of all shown parts of a raw message, with PART between them."""
    parts = [words_of(p) for p in shown_parts(raw)]
    out = parts[0] if parts else []
    for p in parts[1:]:
        out += [PART, *p]
    return out


def piece_length(words: int, budget: int) -> int:
    """The longest piece of which any `words` consecutive words hold budget + 1, cut at multiples of it."""
    n = (words + 1) // (budget + 2)
    if budget < 0 or n < 1:
        raise ValueError(f"no piece is left of {words} words with {budget} edits")
    return n


def myers(pattern: str, text: str) -> int:
    """Least edit distance of `pattern` and any part of `text`, by bit-parallel columns."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, least = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < least:
            least = score
    return least


class Pieces:
    """The automaton of one block of items: (item_id, words) pairs."""

    def __init__(self, items: list[tuple[int, list[str]]], words: int, budget: int):
        import ahocorasick

        self.items, self.words, self.budget, self.size = items, words, budget, piece_length(words, budget)
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, ws) in enumerate(items):
            for at in range(0, len(ws) - self.size + 1, self.size):
                where.setdefault(" ".join(ws[at : at + self.size]), []).append((k, at))
        self.find = ahocorasick.Automaton()
        for piece, at in where.items():
            self.find.add_word(piece, (len(piece), at))
        self.find.make_automaton()

    def hits(self, doc: list[str]) -> dict[int, tuple[int, int]]:
        """item_id -> (longest exact run found, least distance of a passage) for items within the budget."""
        out: dict[int, tuple[int, int]] = {}
        if len(doc) < self.size or not len(self.find):
            return out
        starts, n = [], 1
        text = f" {' '.join(doc)} "
        runs: dict[tuple[int, int], int] = {}  # (item, diagonal) -> end of the last leaked run there
        for end, (length, places) in self.find.iter(text):
            if not starts:
                for w in doc:
                    starts.append(n)
                    n += len(w) + 1
            begin = end - length + 1
            p = bisect_right(starts, begin) - 1
            # words of the piece that are whole words here: all but perhaps the outer ones
            first, last = int(starts[p] != begin), self.size - int(text[end + 1] != " ")
            for k, at in places:
                if runs.get((k, p - at), 0) >= p + self.size:
                    continue
                item, ws = self.items[k]
                lo, hi = first, last
                if lo < hi:
                    while not first and p + lo > 0 and at + lo > 0 and doc[p + lo - 1] == ws[at + lo - 1]:
                        lo -= 1
                    while last == self.size and p + hi < len(doc) and at + hi < len(ws) and doc[p + hi] == ws[at + hi]:
                        hi += 1
                run = max(0, hi - lo)
                if run >= self.words:
                    runs[k, p - at] = p + hi
                distance = 0 if run >= self.words else passage_distance(doc, ws, p, at, self.size, self.words, self.budget)
                if distance <= self.budget:
                    r, d = out.get(item, (0, distance))
                    out[item] = (max(r, run), min(d, distance))
        return out


def passage_distance(doc: list[str], ws: list[str], p: int, at: int, size: int, n: int, budget: int) -> int:
    """Least distance of a passage of `n` words of the item `ws` that holds the piece of `size` words at `at`, hit at word `p`
    of the document; budget + 1 if above the budget."""
    least = budget + 1
    for s in range(max(0, at + size - n), min(at, len(ws) - n) + 1):
        a = max(0, p - (at - s) - budget - 1)
        region, passage = doc[a : p + n - (at - s) + budget + 1], ws[s : s + n]
        # an edit spoils two words at most, and both outer words may be parts of longer ones
        if len(set(passage).difference(region)) > 2 * budget + 2:
            continue
        least = min(least, myers(" ".join(passage), " ".join(region)))
        if not least:
            break
    return least


def gram_length(words: int, budget: int) -> int:
    """Whole words that stay together somewhere in any `words` consecutive words after `budget` edits."""
    n = -(-(words - 2 * budget) // (budget + 1))
    if budget < 0 or n < 1:
        raise ValueError(f"no word is left of {words} words with {budget} edits")
    return n


def _item_words(words: int):
    """A mapInArrow function: (item_id, text) to (item_id, part, n, words), long items cut; parts shorter than `words` are
    left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, int, str]] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws, step = words_of(t), max(words, BLOCK_WORDS // 2)
                for at in range(0, max(1, len(ws) - words + 1), step):
                    part = ws[at : at + step + words - 1]
                    if len(part) >= words:
                        rows.append((i, at, len(part), " ".join(part)))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["item_id", "part", "n", "words"])

    return cut


_AUTOMATA: dict[str, Pieces] = {}


def find_leaks(docs: DataFrame, items: DataFrame, words: int = 12, budget: int = 1) -> DataFrame:
    """(doc_id, item_id, run, distance): items of which a document shows a passage of `words` words within `budget` edits.

    docs: (doc_id, text: raw messages); items: (item_id, text). run is the longest exact run of common words around a
    verified piece, distance the least number of edits of a passage of `words` words (0 if run >= words). Null ids and
    texts are left out, as are items shorter than `words`; repeated rows give one row; no item or no document gives none.
    Items of more than BLOCK_WORDS words are searched by joining pieces, which gives the same rows.
    """
    piece_length(words, budget)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    spark = docs.sparkSession
    parts = written(items.mapInArrow(_item_words(words), "item_id long, part long, n long, words string"), "item-words")
    n = parts.agg(F.sum("n")).first()[0]
    if not n:
        return spark.createDataFrame([], HITS)
    if n <= BLOCK_WORDS:
        sent = spark.sparkContext.broadcast([(r["item_id"], r["words"].split(" ")) for r in parts.collect()])  # at most BLOCK_WORDS words
        found = docs.mapInArrow(_searcher(sent, words, budget), HITS)
    else:
        found = _joined(docs, parts, n, words, budget)
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.min("distance").alias("distance"))


GRAMS = "h long, {id}, at int, {side}_lead int, {side}_around string"


def _joined(docs: DataFrame, parts: DataFrame, n: int, words: int, budget: int) -> DataFrame:
    """HITS by a join of hashed pieces: one pass over the items for the bitmap, one for the join, one over the documents."""
    size, around = gram_length(words, budget), words + budget + 1
    items = written(parts.mapInArrow(_grams(size, around, None), GRAMS.format(id="item_id long, part long", side="i").replace(" at ", " i_at ")), "item-pieces")
    bits = min(MOST_BITS, max(16, (BITS_A_PIECE * n).bit_length()))
    value = F.pmod("h", F.lit(1 << bits)) + 1
    maps = items.groupBy(F.bitmap_bucket_number(value).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for r in maps.collect():  # at most 2 ** MOST_BITS bits
        at = (r["b"] - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    hits = docs.mapInArrow(_grams(size, around, sent), GRAMS.format(id="doc_id long", side="d").replace(" at ", " d_at "))
    hits = written(hits, "piece-hits")
    rows = fragment_replicate_join(hits, items, ["h"]).select("doc_id", "item_id", "part", "d_at", "i_at", "d_lead", "i_lead", "d_around", "i_around")
    rows = rows.mapInArrow(_verifier(size, words, budget), "doc_id long, item_id long, part long, diagonal int, lo int, hi int, distance int")
    # runs that overlap are one
    same = Window.partitionBy("doc_id", "item_id", "part", "diagonal").orderBy("lo", "hi")
    rows = rows.withColumn("__new", (F.col("lo") > F.coalesce(F.max("hi").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("doc_id", "item_id", "part", "diagonal", "__run").agg((F.max("hi") - F.min("lo")).alias("run"), F.min("distance").alias("distance"))
    return runs.select("doc_id", "item_id", "run", F.when(F.col("run") >= words, 0).otherwise(F.col("distance")).cast("int").alias("distance"))


def _hashes(ws: list[str], size: int, known: dict[str, int]) -> np.ndarray:
    """A hash of each run of `size` words."""
    import xxhash

    for w in ws:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    each = np.fromiter((known[w] for w in ws), np.uint64, len(ws))
    n = max(0, len(ws) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _grams(size: int, around: int, sent):
    """A mapInArrow function: pieces with their place and the words around. Of items (sent is None) all, of documents those
    whose hash is in the bitmap `sent`."""

    names = ["h", "doc_id", "d_at", "d_lead", "d_around"] if sent else ["h", "item_id", "part", "i_at", "i_lead", "i_around"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        hashes, ids, places, leads, texts = zip(*rows, strict=True)
        many = [len(h) for h in hashes]
        keys = [pa.array(np.repeat(np.array(col, np.int64), many)) for col in zip(*ids, strict=True)]
        cols = [pa.array(np.concatenate(hashes)), *keys, *[pa.array(np.concatenate(x).astype(np.int32)) for x in (places, leads)], pa.array([t for x in texts for t in x], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8) if sent else None
        known: dict[str, int] = {}
        rows, n = [], 0
        for b in batches:
            for *ids, text in zip(*[c.to_pylist() for c in ([b.column(0), b.column(1)] if sent else [b.column(0), b.column(1), b.column(3)])], strict=True):
                ws = message_words(text) if sent else text.split(" ")
                h = _hashes(ws, size, known)
                if len(known) > 500_000:
                    known.clear()
                at = np.arange(len(h))
                if sent:
                    v = np.mod(h, len(bitmap) * 8)
                    at = np.nonzero(bitmap[v >> 3] >> (v & 7).astype(np.uint8) & 1)[0]
                if not len(at):
                    continue
                lead = np.minimum(at, around)
                texts = [" ".join(ws[p - k : p + size + around]) for p, k in zip(at.tolist(), lead.tolist(), strict=True)]
                rows.append((h[at], ids, at, lead, texts))
                n += len(at)
                if n > 20_000:
                    yield batch(rows)
                    rows, n = [], 0
        if rows:
            yield batch(rows)

    return cut


def _verifier(size: int, words: int, budget: int):
    """A mapInArrow function: joined pieces to exact runs around them, with the least distance of a passage within the
    budget (0 where the run is long enough); others are left out."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, item_id, part, p, at, k, j, d, i in zip(*[c.to_pylist() for c in b.columns], strict=True):
                doc, ws = d.split(" "), i.split(" ")
                if doc[k : k + size] != ws[j : j + size]:
                    continue
                lo = 0
                while k - lo > 0 and j - lo > 0 and doc[k - lo - 1] == ws[j - lo - 1]:
                    lo += 1
                hi = size
                while k + hi < len(doc) and j + hi < len(ws) and doc[k + hi] == ws[j + hi]:
                    hi += 1
                distance = 0 if lo + hi >= words else passage_distance(doc, ws, k, j, size, words, budget)
                if distance <= budget:
                    rows.append((doc_id, item_id, part, p - at, p - lo, p + hi, distance))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "part", "diagonal", "lo", "hi", "distance"])

    return verify


def _searcher(sent, words: int, budget: int):
    key = uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _AUTOMATA:
            _AUTOMATA.clear()  # one block at a time
            _AUTOMATA[key] = Pieces(sent.value, words, budget)
        pieces = _AUTOMATA[key]
        for b in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for item, (run, distance) in pieces.hits(message_words(text)).items():
                    for col, v in zip(rows, (doc, item, run, distance), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "item_id", "run", "distance"])

    return search
