"""One form for text that looks the same, and the documents it makes equal.

The form: canonical decomposition; full-width, half-width, ligature and other presentation forms replaced by their plain
characters; every kind of blank by a space and every kind of line end by a line feed; default-ignorable and control
characters removed; letters of other scripts with the look of a Latin letter by that letter; canonical composition; and,
on request, full case folding. Superscripts, fractions, circled and other characters whose plain form looks different
stay as they are. The work is done once for each distinct value of a batch.

The letters known to look alike are a short list; `confusables` reads the public table of the Unicode consortium for the
rest, where a copy of that file is at hand.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdex.operators.skew import fragment_replicate_join, plan_load
from textdex.session import written

# Letters of other scripts that are drawn like a Latin letter, by the Latin letter.
LOOK_ALIKE = {
    "a": "аɑα", "b": "Ьᖯ", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօᴏ",
    "p": "рρ", "q": "ԛ", "s": "ѕꜱ", "u": "սᴜ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "х", "y": "уү", "z": "ᴢ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫͿ", "K": "КΚᏦ",
    "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ",
    "Y": "ҮΥ", "Z": "ΖᏃ",
}
#: Compatibility decompositions that keep the look.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>", "<small>"}
# The ranges of Default_Ignorable_Code_Point, and the marks around interlinear notes.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


def confusables(path: str) -> dict[str, str]:
    """Letters of other scripts -> the Latin letter they look like, from a file in the format of the Unicode consortium's
    confusables table: `source ; target ; type # comment` in hexadecimal code points. Only pairs of single letters of the
    same case count; digits and marks for letters do not."""
    out = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = [x.strip() for x in line.split("#", 1)[0].split(";")]
            if len(parts) < 2 or " " in parts[0] or " " in parts[1] or not parts[1]:
                continue
            a, b = (chr(int(x, 16)) for x in parts[:2])
            if b.isascii() and b.isalpha() and not a.isascii() and a.isalpha() and a.isupper() == b.isupper():
                out[a] = b
    return out


@functools.cache
def look_table(more: frozenset[tuple[str, str]] = frozenset()) -> dict[int, str | None]:
    """Code point -> what is written for it, after canonical decomposition. more: look-alikes besides the listed ones."""
    table: dict[int, str | None] = {}
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind == "Zs":
            table[cp] = " "
        elif kind == "Cc" and c not in "\t\n":
            table[cp] = None
        elif (d := unicodedata.decomposition(c)) and d.split(" ", 1)[0] in SAME_LOOK:
            table[cp] = unicodedata.normalize("NFKD", c)
    table |= dict.fromkeys((0x85, 0x0B, 0x0C, 0x2028, 0x2029), "\n")
    for lo, hi in IGNORABLE:
        table |= dict.fromkeys(range(lo, hi + 1))
    for plain, others in LOOK_ALIKE.items():
        table |= {ord(c): plain for c in others}
    table |= {ord(c): plain for c, plain in more}
    table.pop(0x20, None)
    return {cp: to and to.translate(table) for cp, to in table.items()}


class Form:
    """text -> its one form; with fold, letter case makes no difference either."""

    def __init__(self, more: frozenset[tuple[str, str]] = frozenset()):
        # the table by whole characters, composed ones included; combining marks are keys that stay
        table = look_table(more)
        self.table = {chr(cp): to or "" for cp, to in table.items()}
        for cp in range(0xA0, sys.maxunicode + 1):
            c = chr(cp)
            if c not in self.table and unicodedata.category(c) not in ("Cn", "Co", "Cs"):
                to = unicodedata.normalize("NFC", unicodedata.normalize("NFD", c).translate(table))
                if to != c or unicodedata.combining(c):
                    self.table[c] = to
        self.keys = frozenset(self.table)

    def __call__(self, text: str, fold: bool = False) -> str:
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        plain = text.isascii()
        if special := ({c for c in text if not c.isprintable()} if plain else set(text)) & self.keys:
            for c in special:
                text = text.replace(c, self.table[c])
            text = unicodedata.normalize("NFC", text)
        elif not plain and not unicodedata.is_normalized("NFC", text):  # parts of syllables that are no marks
            text = unicodedata.normalize("NFC", text)
        if fold:
            text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text.casefold())
        return text


@functools.cache
def form(more: frozenset[tuple[str, str]] = frozenset()) -> Form:
    """The form with these look-alikes besides the listed ones; made once in each process."""
    return Form(more)


def look(text: str, fold: bool = False) -> str:
    """The one form of `text`; with fold, letter case makes no difference either."""
    return form()(text, fold)


def looks(df: DataFrame, text: str = "text", into: str = "look", fold: bool = False, more: dict[str, str] | None = None) -> DataFrame:
    """`df` with the column `into`: the one form of `text`; null stays null, an empty text stays empty. more: look-alikes
    besides the listed ones (see confusables)."""
    others = frozenset((more or {}).items())

    @F.pandas_udf("string")
    def one_form(s):
        of = form(others)
        known = {v: of(v, fold) for v in s.dropna().unique()}
        return s.map(known).astype(object).where(s.notna(), None)

    return df.withColumn(into, one_form(F.col(text)))


FORMS = "id long, look binary, raw binary"


def _forms(more: frozenset[tuple[str, str]]):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = lambda t: xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
        schema, of = pa.schema([("id", pa.int64()), ("look", pa.binary()), ("raw", pa.binary())]), form(more)
        for b in batches:
            known: dict[str, tuple[bytes, bytes] | None] = {}
            ids, forms, raws = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t not in known:
                    one = of(t)
                    known[t] = (digest(one), digest(t)) if one and not one.isspace() else None
                if pair := known[t]:
                    ids.append(i), forms.append(pair[0]), raws.append(pair[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], schema=schema)

    return digests


def look_forms(docs: DataFrame, id: str = "doc_id", text: str = "text", more: dict[str, str] | None = None) -> DataFrame:
    """(id, look, raw): 128-bit digests of the one form and of the text itself; texts that are null or show nothing are
    left out. Only digests are shuffled, not texts."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).filter("text is not null and id is not null")
    return rows.mapInArrow(_forms(frozenset((more or {}).items())), FORMS)


def look_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", more: dict[str, str] | None = None) -> DataFrame:
    """(id, class_id, n_texts): for each document that shares its look with a different text, the least id of its class
    and the number of different texts in it."""
    forms = look_forms(docs, id, text, more)
    same = forms.groupBy("look", "raw").agg(F.min("id").alias("least")).groupBy("look").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1")
    return forms.join(same, "look").select("id", "class_id", "n_texts")


def look_pairs(docs: DataFrame, id: str = "doc_id", text: str = "text", more: dict[str, str] | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of documents with the same look and different texts.

    Pairs are formed between the different texts of a look first and only then spread to the documents, so copies of one
    text are never paired with each other. Documents without id, null texts and texts that show nothing are left out; a
    repeated (id, text) row counts once; an empty table gives no row.
    """
    forms = written(look_forms(docs, id, text, more), "looks")
    several = forms.groupBy("look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo <> hi").select("look")
    members = written(forms.join(several, "look", "left_semi").select("look", "raw", "id").distinct(), "look-members")
    texts = members.select("look", "raw").distinct()
    # different texts of a look, then the documents of each: every join balanced by the load of its larger side
    pairs = fragment_replicate_join(texts.select("look", F.col("raw").alias("ra")), texts.select("look", F.col("raw").alias("rb")), ["look"]).filter("ra < rb")
    pairs = fragment_replicate_join(members.select("look", F.col("raw").alias("ra"), F.col("id").alias("x")), pairs, ["look", "ra"], plan_load(members.withColumnRenamed("raw", "ra"), ["look", "ra"]))
    pairs = fragment_replicate_join(written(pairs, "look-pairs"), members.select("look", F.col("raw").alias("rb"), F.col("id").alias("y")), ["look", "rb"])
    return pairs.filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
