"""Text that was read in a wrong character encoding: found, and restored where nothing was lost.

Damaged sequences of all encoding pairs are computed beforehand, put into multi-pattern automata, and only what they match
is replaced, so correct text around it stays:

* UTF-8 read in a single-byte encoding turns one character into two to four. Characters of the single-byte encodings are in
  the automaton as whole sequences; all other code points by their first two characters, the rest by the encoding's table.
  Characters of scripts that no single-byte encoding here has count only in company (two of a script side by side, or a
  sign), since three signs in a row may also be correct text. A sequence that could be ordinary letters counts only where
  the restored word reads better than the word as it stands. Text damaged several times is restored round by round.
* One single-byte encoding read as another turns letters into other letters or signs. Here the sequences are the usual
  pairs of letters of the collection as each encoding pair damages them. The encoding pairs that explain more of a value
  than its own reading does are tried, on the value or on the words of it that read badly, and the best one taken if the
  words then read clearly better than before.
* A multi-byte encoding read as a single-byte one, or UTF-8 read in a multi-byte one, is undone where whole words decode
  without an error to usual characters.

How a word reads is the log-likelihood of its pairs of neighbouring letters, in the collection itself: counts over all
distinct values that are not of ASCII only, of the characters of the known encodings only, so their number has a fixed
bound. The share of a pair in all pairs is taken, not its share among those after the first letter: signs that only damaged
text has would otherwise vouch for each other. Text in doubt stays as it is.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOST = "�"
# Single-byte encodings, and the pairs (true, wrong) of them by script.
KNOWN = ("cp1252", "latin-1", "cp1250", "cp1251", "mac-roman", "cp437", "cp850", "koi8-r", "cp866", "cp1253", "iso8859-2", "iso8859-15", "cp852", "cp1254", "cp1257", "iso8859-7", "iso8859-5")
WRONG_FOR_UTF8 = (*KNOWN, "cp1255", "cp1256", "cp1258", "cp874", "mac-cyrillic", "koi8-u", "iso8859-9")
PAIRS = (
    [(e, w) for e in ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic") for w in ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "mac-roman", "cp437", "cp850", "iso8859-5", "cp1250", "cp1253") if e != w]
    + [(e, w) for e in ("cp1253", "iso8859-7", "cp737") for w in ("cp1252", "latin-1", "cp1251", "koi8-r", "mac-roman", "cp437", "cp850", "cp1250") if e != w]
    + [(e, w) for e in ("cp1250", "iso8859-2", "cp852") for w in ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "mac-roman", "cp437", "cp850", "cp852") if e != w]
    + [(e, w) for e in ("cp1252", "mac-roman", "cp437", "cp850") for w in ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "koi8-r", "mac-roman", "cp437", "cp850", "iso8859-2") if e != w]
)
# Multi-byte encodings with the first bytes of their usual characters, and what they are read as.
MULTI_BYTE = {"cp949": (0xB0, 0xC8), "big5": (0xA4, 0xC6), "cp932": (0x88, 0x98), "gbk": (0xB0, 0xD7)}
WRONG_FOR_MULTI_BYTE = ("cp1252", "latin-1")
# Scripts in use that the single-byte encodings above lack, by the first word of the characters' names.
SCRIPTS = {
    "HEBREW", "ARABIC", "THAI", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "LAO", "TIBETAN",
    "MYANMAR", "GEORGIAN", "ETHIOPIC", "KHMER", "MONGOLIAN", "ARMENIAN", "HANGUL", "CJK", "HIRAGANA", "KATAKANA", "IDEOGRAPHIC", "FULLWIDTH", "HALFWIDTH",
    "KATAKANA-HIRAGANA", "LATIN", "GREEK", "CYRILLIC", "MODIFIER",
}
# Letters of Latin alphabets in use, beyond those of the single-byte encodings.
OTHER_LETTERS = "ơưƠƯəƏșțȘȚŵŷŴŶǎǐǒǔɛɔŋƐƆŊ"
#: Written together.
_AS_ONE = dict.fromkeys(("HIRAGANA", "KATAKANA", "IDEOGRAPHIC", "FULLWIDTH", "HALFWIDTH", "KATAKANA-HIRAGANA"), "CJK")
#: A word must gain this much log-likelihood by a weak sequence, a value by a single-byte pair, and this much for each restored letter.
WEAK_GAIN, PAIR_GAIN, LETTER_GAIN = 5.0, 6.0, 1.2
#: Share of usual pairs of letters in a restored text; the same where Latin letters stayed Latin, and the gain for each letter there.
USUAL, USUAL_LATIN, LATIN_GAIN = 0.7, 0.9, 2.0
#: Some words of a value must gain this much for each of their letters, besides reading as words of the collection do.
WORDS_GAIN = 3.0
#: Log-likelihood of a capital after a small letter.
CAPITAL = -5.0
#: A pair of letters this much rarer than usual counts as one the collection does not have.
RARE = -4.5
#: Restored words may read this much worse than usual, for each letter.
FAR = -3.5
_WORD = re.compile(r"[^ \t\r\n,;:.!?()\"/0-9<>=+*@#&%_\[\]{}|~-]+")
_TOKEN = re.compile(r"[^ \t\r\n]+")
_HIGH = re.compile(r"[^\x00-\x7f]+")
_CAPITAL = re.compile(r"[a-zß-öø-ÿа-џα-ώāăąćčďđēęěğīıķĺľłńňőœŕřśşšţťūůűźżž][A-ZÀ-ÖØ-ÞЀ-ЯΆ-ΫĀĂĄĆČĎĐĒĘĚĞĪĶĹĽŁŃŇŐŒŔŘŚŞŠŢŤŪŮŰŸŹŻŽ]")
_HALF = re.compile(r"[｡-ﾟA-Za-z]")
_BEYOND = re.compile(r"[^\x00-\xffŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]")
_INNER = re.compile(r"[A-Za-z][À-ÖØ-ÞŒŠŽŸ][a-z]")
_LATIN_WORD = re.compile(r"[A-Za-z]")
_WIDE = re.compile(r"[ᄀ-ᇿ⺀-鿿가-힣豈-﫿＀-￯]+")


@functools.cache
def _maps(name: str) -> tuple[dict[str, int], list[str | None]]:
    """Byte of each character and character of each byte; a byte the encoding leaves open is the control character of that
    number, as decoders of the web do."""
    chars: list[str | None] = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b) if 0x80 <= b < 0xA0 else None)
    return {c: b for b, c in enumerate(chars) if c is not None}, chars


@functools.cache
def alphabet() -> frozenset[str]:
    """Every character above ASCII of the single-byte encodings whose letters are counted."""
    names = {*KNOWN, *[x for p in PAIRS for x in p]}
    return frozenset(c for n in names for c in _maps(n)[1][128:] if c is not None)


def _letter(c: str) -> bool:
    return c.isalpha() and c not in "ªºµƒˆ"


@functools.cache
def _script(c: str) -> str:
    name = unicodedata.name(c, "?").split(" ")[0]
    return _AS_ONE.get(name, name)


def _weak(seq: str) -> bool:
    """Whether the sequence could be ordinary text: letters of one script."""
    return all(map(_letter, seq)) and len({unicodedata.name(x, "?").split(" ")[0] for x in seq}) == 1


@functools.cache
def sequences() -> dict[str, tuple[dict[str, str], bool]]:
    """Damaged sequence -> (wrong encoding -> character, weak): UTF-8 of every character of the alphabet read in every wrong
    encoding, also with each byte the encoding leaves open lost."""
    out: dict[str, tuple[dict[str, str], bool]] = {}
    wanted = sorted(alphabet()) + [LOST, "﻿"]
    for name in WRONG_FOR_UTF8:
        chars = _maps(name)[1]
        strict = [None if c is None or (0x80 <= b < 0xA0 and c == chr(b) and name != "latin-1") else c for b, c in enumerate(chars)]
        for c in wanted:
            data = c.encode("utf-8")
            for table in (chars, strict):
                seq = "".join(LOST if table[b] is None else table[b] for b in data)
                if seq.replace(LOST, "") == "":
                    continue
                out.setdefault(seq, ({}, _weak(seq)))[0].setdefault(name, LOST if LOST in seq else c)
    return out


@functools.cache
def openings() -> dict[str, list[tuple[str, bytes]]]:
    """The first two characters of damaged UTF-8 -> (wrong encoding, their bytes), over all code points."""
    out: dict[str, list[tuple[str, bytes]]] = {}
    for name in WRONG_FOR_UTF8:
        chars = _maps(name)[1]
        for first in range(0xC2, 0xF5):
            lo, hi = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(first, (0x80, 0xBF))
            for second in range(lo, hi + 1):
                if chars[first] and chars[second]:
                    out.setdefault(chars[first] + chars[second], []).append((name, bytes((first, second))))
    return out


_AUTOMATA: dict = {}


def automaton(full: bool = False):
    """Automaton of all sequences and openings: each gives (length, characters, weak) or None, and the openings. Openings
    that could be ordinary letters are in the full one only."""
    if full not in _AUTOMATA:
        import ahocorasick

        a, known, first = ahocorasick.Automaton(), sequences(), openings()
        for seq in {*known, *first}:
            chars, opened = known.get(seq), first.get(seq, ())
            if not full and _weak(seq):
                opened = ()
            if chars or opened:
                a.add_word(seq, (len(seq), chars and (len(seq), *chars), opened))
        a.make_automaton()
        _AUTOMATA[full] = a
    return _AUTOMATA[full]


class Reading:
    """Log-likelihood of words under counts of neighbouring characters (lower case, a blank at both ends), and the usual
    pairs of characters as each encoding pair damages them."""

    def __init__(self, pairs: dict[str, int]):
        total = sum(pairs.values()) + 1
        self.pairs = {p: math.log((n + 0.05) / total) for p, n in pairs.items()}
        self.none = math.log(0.05 / total)
        self.usual = sum(n * self.pairs[p] for p, n in pairs.items()) / total
        single: Counter = Counter()
        for p, n in pairs.items():
            single[p[0]] += n
        self.single = {c: math.log(n / total) for c, n in single.items()}
        self.word = functools.lru_cache(200_000)(self._word)

    def _word(self, word: str) -> float:
        w = f" {word.lower()} "
        get, none = self.pairs.get, self.none
        return sum([get(a + b, none) for a, b in zip(w, w[1:], strict=False)]) + CAPITAL * len(_CAPITAL.findall(word))

    def mean(self, text: str) -> float:
        """Log-likelihood of a letter in the words that are not of ASCII only; 0 if there are none."""
        words = [w for w in _WORD.findall(text) if not w.isascii()]
        return sum(map(self.word, words)) / sum(len(w) + 1 for w in words) if words else 0.0

    @functools.cached_property
    def images(self):
        """Automaton of the usual pairs with a character above ASCII: as they are (-1) and as each pair of encodings damages
        them (its number). In small letters, with a capital first, and in capitals."""
        import ahocorasick

        images: dict[str, set[int]] = {}
        damage = [{to: chr(c) for c, to in table.items()} for table in _tables()]
        for p, score in self.pairs.items():
            if p.isascii() or score < self.usual + RARE:
                continue
            for form in {p, p[0].upper() + p[1], p.upper()}:
                if len(form) != 2:
                    continue
                images.setdefault(form, set()).add(-1)
                a, b = form
                for n, table in enumerate(damage):
                    x, y = a if a < "\x80" else table.get(a), b if b < "\x80" else table.get(b)
                    if x and y:
                        images.setdefault(x + y, set()).add(n)
        out = ahocorasick.Automaton()
        for image, which in images.items():
            out.add_word(image, tuple(which))
        if len(out):
            out.make_automaton()
        return out

    @functools.cached_property
    def own(self) -> frozenset[str]:
        """The usual pairs with a character above ASCII, as they are written."""
        usual = [p for p, score in self.pairs.items() if not p.isascii() and score >= self.usual + RARE]
        return frozenset(f for p in usual for f in (p, p[0].upper() + p[1], p.upper()) if len(f) == 2)

    def usual_pairs(self, words: list[str]) -> tuple[int, int]:
        """How many of the pairs with a character above ASCII are usual, and how many there are."""
        text = f" {' '.join(words)} "
        return sum(map(self.own.__contains__, map("".join, zip(text, text[1:], strict=False)))), sum([len(run) + 1 for run in _HIGH.findall(text)])

    def votes(self, words: list[str]) -> tuple[Counter, int]:
        """How many pairs with a character above ASCII each encoding pair explains (-1: none did damage), and of how many."""
        text, votes = f" {' '.join(words)} ", Counter()
        if len(self.images):
            for _, which in self.images.iter(text):
                votes.update(which)
        return votes, sum([len(run) + 1 for run in _HIGH.findall(text)])


@functools.lru_cache(100_000)
def _foreign(c: str) -> str | None:
    """Script of a character that no single-byte encoding has, "" for a sign; None for what is hardly ever written."""
    kind, script = unicodedata.category(c), _script(c)
    if kind in ("Cn", "Co", "Cs", "Cc"):
        return None
    if script in ("LATIN", "GREEK", "CYRILLIC"):
        return script if c in OTHER_LETTERS or "\u1e00" <= c <= "\u1fff" or "\u0490" <= c <= "\u04ff" else None
    if kind[0] in "LMN" and c not in "\ufe0e\ufe0f":
        return script if script in SCRIPTS else None
    return "CJK" if script == "CJK" else "" if c > "\u07ff" else None


def _opened(text: str, begin: int, opened: list[tuple[str, bytes]]) -> list[tuple[str, int, str, str]]:
    """(wrong encoding, end, character, script) of the characters in no single-byte encoding that may begin there; the
    script is "" for a sign."""
    out = []
    for name, data in opened:
        n = 2 if data[0] < 0xE0 else 3 if data[0] < 0xF0 else 4
        if begin + n > len(text):
            continue
        back = _maps(name)[0]
        rest = [back.get(x, 0) for x in text[begin + 2 : begin + n]]
        if not all(0x80 <= b < 0xC0 for b in rest):
            continue
        c = (data + bytes(rest)).decode("utf-8", "replace")
        if len(c) == 1 and c not in alphabet() and (script := _foreign(c)) is not None:
            out.append((name, begin + n, c, script))
    return out


def _spans(text: str) -> tuple[list[tuple[int, int, str, bool]], bool]:
    """Longest matches from the left, without overlap: (begin, end, character, weak), and whether they are all there is above
    ASCII and one is of a script that no single-byte encoding has. A sequence that is another character in another wrong encoding is read in the encoding that
    most sequences of the text have."""
    found, other = _matches(text, False)
    company, all_ = _in_company(text, found, other) if other else ([], False)
    if company:
        found, other = _matches(text, True)
        company, all_ = _in_company(text, found, other)
    for begin in company:
        for inside in range(begin, other[begin][0]):
            found.pop(inside, None)
        found[begin] = (*other[begin][:2], False)
    out, at = [], 0
    votes: Counter = Counter()
    for begin in sorted(found):
        if begin >= at:
            at, chars, weak = found[begin]
            out.append((begin, at, chars, weak))
            votes.update(chars.keys())
    return [(b, e, chars[max(chars, key=votes.__getitem__)], weak) for b, e, chars, weak in out], bool(company) and all_


def _matches(text: str, full: bool) -> tuple[dict, dict]:
    """begin -> (end, characters, weak) of the known sequences, and begin -> (end, characters, script) of the others."""
    found: dict[int, tuple[int, dict[str, str], bool]] = {}
    options: dict[int, list[tuple[str, int, str, str]]] = {}
    for end, (n, known, opened) in automaton(full).iter(text):
        begin = end - n + 1
        if known and (begin not in found or found[begin][0] < end + 1):
            found[begin] = (end + 1, known[1], known[2])
        if opened and (o := _opened(text, begin, opened)):
            options[begin] = o
    if not options:
        return found, {}
    votes = Counter(name for o in options.values() for name, *_ in o)
    other = {}
    for begin, o in options.items():
        _, end, c, script = max(o, key=lambda x: (votes[x[0]], x[1]))
        other[begin] = (end, {name: x for name, e, x, _ in o if e == end and x == c}, script)
    return found, other


def _in_company(text: str, found: dict, other: dict) -> tuple[list[int], bool]:
    """Begins of the sequences of other scripts that count: signs, Latin letters, and the letters of a script of which two
    stand side by side somewhere, each of them more than ordinary letters. All of them only in words whose characters above
    ASCII are parts of sequences, but for a few. And whether all words with such characters are of this kind."""
    chains: list[list[tuple[int, int, str | None]]] = []
    at = 0
    for begin in sorted({*found, *other}):
        if begin < at:
            continue
        end, script = found.get(begin, (0,))[0], None
        if begin in other and other[begin][0] > end:
            end, _, script = other[begin]
        if chains and begin == at:
            chains[-1].append((begin, end, script))
        else:
            chains.append([(begin, end, script)])
        at = end
    in_spans = bytearray(len(text))
    for chain in chains:
        in_spans[chain[0][0] : chain[-1][1]] = b"\1" * (chain[-1][1] - chain[0][0])
    whole, all_ = bytearray(len(text)), True
    for m in _TOKEN.finditer(text):
        high = [i for i in range(m.start(), m.end()) if text[i] > "\x7f"]
        if sum(in_spans[i] for i in high) * 5 < 4 * len(high):
            all_ = False
        elif high:
            whole[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    out, scripts, letters = [], set(), []
    for chain in chains:
        company = Counter(s for b, e, s in chain if s and not _weak(text[b:e]))
        for b, e, s in chain:
            if s is None or not whole[b]:
                continue
            if s:
                letters.append((b, s))
                if company[s] > 1 or (s == "LATIN" and not _weak(text[b:e])):
                    scripts.add(s)
            elif not _weak(text[b:e]):
                out.append(b)
    return out + [b for b, s in letters if s in scripts], all_


def mend_sequences(text: str, reading: Reading) -> tuple[str, bool]:
    """`text` with the damaged UTF-8 sequences replaced, and whether they are beyond doubt: nothing else is above
    ASCII, and they are of a script that no single-byte encoding has, or more than ordinary letters."""
    sure = False
    while True:
        spans, other = _spans(text)
        if not spans:
            return text, sure
        sure = sure or other
        words = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        taken, k = [], 0  # for each word that is not of ASCII only: its spans, those taken, whether it is in doubt
        for begin, end in words:
            own = []
            while k < len(spans) and spans[k][0] < end:
                own.append(spans[k])
                k += 1
            some, word = [s for s in own if not s[3]], text[begin:end]
            if not some and not _LATIN_WORD.search(word):  # letters of a script the collection does not know may be a word of it
                own = [s for s in own if not s[3] or _script(text[s[0]]) in ("LATIN", "CYRILLIC", "GREEK")]
            if len(some) < len(own):
                at = lambda them, b=begin: [(x - b, y - b, c, w) for x, y, c, w in them]
                if _reads_better(_replaced(word, at(some)), _replaced(word, at(own)), reading):
                    some = own
            doubt = len(some) < len(own) and sum(y - x for x, y, *_ in own) >= sum(map(str.isalnum, word))
            if own or not word.isascii():
                taken.append((own, some, doubt))
        keep = []
        for i, (own, some, doubt) in enumerate(taken):
            if doubt:  # made of sequences only: as the next words on both sides that are not in doubt
                beside = [next((bool(s) for _, s, d in side if not d), None) for side in (taken[i::-1], taken[i:])]
                if True in beside and False not in beside:
                    some = own
            keep += some
        if not keep:
            return text, sure
        sure = sure or sum(e - b for b, e, _, weak in keep if not weak) == sum(map(len, _HIGH.findall(text)))
        text = _replaced(text, keep)  # shorter each time


def _reads_better(old: str, new: str, reading: Reading) -> bool:
    score = lambda s: sum(map(reading.word, _WORD.findall(s)))
    return score(new) > score(old) + WEAK_GAIN - reading.usual * (len(old) - len(new))


def _replaced(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    out, at = [], 0
    for begin, end, c, _ in spans:
        out += [text[at:begin], c]
        at = end
    return "".join(out) + text[at:]


@functools.cache
def _tables() -> list[dict[int, str]]:
    """For each pair: what a wrong character is restored to. Characters the wrong encoding lacks are not in the table."""
    out = []
    for true, wrong in PAIRS:
        chars, back = _maps(true)[1], _maps(wrong)[0]
        out.append({ord(c): chars[b] for c, b in back.items() if b >= 128 and chars[b] is not None and not (0x80 <= ord(chars[b]) < 0xA0)})
    return out


def _evidence(text: str) -> list[str]:
    """Words that say something about the encoding: not of ASCII only, nor signs and letters that stand alone, nor lines
    drawn of characters, which occur in correct text in any combination."""
    return [w for w in _WORD.findall(text) if len(w) > 1 and not w.isascii() and not all("─" <= c <= "▟" for c in w)]


def _best_pair(text: str, words: list[str], least: float, votes: Counter, reading: Reading) -> str | None:
    """`text` restored by the encoding pair by which its `words` read best, if they gain more than `least`; only pairs that
    explain more of them than no damage does are tried. None if the best one leaves doubt, `text` if there is none."""
    own = votes[-1]
    odd = {ord(c) for c in text if c > "\x7f"}
    before = sum(map(reading.word, words))
    best, most, seen = text, least, set()
    for n, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
        if n < 0 or votes[n] <= own:
            continue
        table = _tables()[n]
        if not odd <= table.keys() or (after := text.translate(table)) in seen:
            continue
        seen.add(after)
        gain = sum(map(reading.word, _evidence(after))) - before
        if gain > most:
            best, most = after, gain
    return best if best == text or _credible(text, best, most, reading) else None


def _credible(before: str, after: str, gain: float, reading: Reading) -> bool:
    """Whether a restored text is beyond doubt: its damage is not yet undone to the end, or most of its pairs of letters are
    usual ones and no capital stands inside a word. Where Latin letters became other Latin letters, as between two
    languages, more of them must be usual, the gain larger, the letters more frequent than those before, and the case of
    each kept, unless there were capitals inside words."""
    words = _evidence(after)
    changed = [(a, b) for a, b in zip(before, after, strict=True) if a > "\x7f"]
    latin = all(_letter(a) and _letter(b) and _script(a) == _script(b) == "LATIN" for a, b in changed)
    own, all_ = reading.usual_pairs(words)
    if any(map(_CAPITAL.search, words)) or own < (USUAL_LATIN if latin else USUAL) * all_:
        return bool(_spans(after)[0])
    if not latin:
        return True
    rarer = sum(reading.single.get(b.lower(), reading.none) - reading.single.get(a.lower(), reading.none) for a, b in changed)
    same = all(a.islower() == b.islower() for a, b in changed) or _INNER.search(before)
    return gain > LATIN_GAIN * len(changed) and rarer > len(changed) and bool(same)


def mend_pairs(text: str, reading: Reading) -> str:
    """`text` restored by the best single-byte pair, as a whole or in those words that read badly."""
    words = _evidence(text)
    own, all_ = reading.usual_pairs(words)
    if own >= all_:  # nothing reads badly
        return text
    votes, _ = reading.votes(words)
    best = _best_pair(text, words, max(PAIR_GAIN, LETTER_GAIN * sum(map(len, _HIGH.findall(text)))), votes, reading)
    return _mend_words(text, reading) if best == text else best or text


def _mend_words(text: str, reading: Reading) -> str:
    """`text` with those words restored by one pair that read badly beside others that do not."""
    bad, good = [], 0
    for m in _WORD.finditer(text):
        if len(m[0]) > 1 and not m[0].isascii():
            own, all_ = reading.usual_pairs([m[0]])
            if own * 2 <= all_:
                bad.append(m)
            else:
                good += 1
    if not bad or not good:
        return text
    part = " ".join(m[0] for m in bad)
    votes, _ = reading.votes(_evidence(part))
    after = _best_pair(part, _evidence(part), max(2 * PAIR_GAIN, WORDS_GAIN * sum(map(len, _HIGH.findall(part)))), votes, reading) or part
    pieces = after.split(" ")
    if after == part or len(pieces) != len(bad) or reading.mean(after) < reading.usual + FAR or _spans(after)[0]:
        return text
    return _replaced(text, [(m.start(), m.end(), p, False) for m, p in zip(bad, pieces, strict=True)])


def _usual_share(text: str, name: str) -> float:
    """Share of the usual characters of the multi-byte encoding in those above ASCII."""
    lo, hi = MULTI_BYTE[name]
    many = [c for c in text if c > "\x7f"]
    usual = sum(lo <= c.encode(name)[0] <= hi or _script(c) == "CJK" and not "⺀" <= c <= "鿿" or unicodedata.category(c)[0] == "P" for c in many)
    return usual / len(many) if many else 0.0


def mend_multi_byte(text: str, reading: Reading) -> str:
    """`text` with what a multi-byte encoding was mixed up in: words of it read in a single-byte one, if they have three or
    more characters together, all of them usual ones; and UTF-8 read in it."""
    if _WIDE.search(text):
        for name in MULTI_BYTE:
            new = {t: _from_wide(t, name, reading) for t in _TOKEN.findall(text) if _WIDE.search(t)}
            if None not in new.values():  # all or nothing: correct words of the script stand for correct text
                return _TOKEN.sub(lambda m, new=new: new.get(m[0], m[0]), text)
        return text
    if _BEYOND.search(text):
        return text
    tokens = [t for t in _TOKEN.findall(text) if not t.isascii()]
    if sum(map(len, _HIGH.findall(text))) * 2 < sum(map(len, tokens)) or sum(map(len, tokens)) < 6:
        return text
    best, most = text, 0.95
    for wrong in WRONG_FOR_MULTI_BYTE:
        back = _maps(wrong)[0]
        if not all(c in back for t in tokens for c in t):
            continue
        for name in MULTI_BYTE:
            try:
                new = {t: bytes(back[c] for c in t).decode(name) for t in tokens}
            except UnicodeDecodeError:
                continue
            whole = "".join(new.values())
            if not _HALF.search(whole) and sum(c > "\x7f" for c in whole) >= 3 and (share := _usual_share(whole, name)) > most:
                best, most = _TOKEN.sub(lambda m, new=new: new.get(m[0], m[0]), text), share
    return best


def _from_wide(word: str, name: str, reading: Reading) -> str | None:
    """The word as it was if it is UTF-8 read in the multi-byte encoding, else None."""
    try:
        after = word.encode(name).decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None
    high = [c for c in after if c > "\x7f"]
    if all(c in alphabet() and _letter(c) for c in high):  # inside a word of Latin letters, or well known
        return after if _LATIN_WORD.search(word) or reading.mean(after) > reading.usual + FAR else None
    return after if len(high) > 1 and all(_script(c) in SCRIPTS or not c.isalpha() for c in high) else None


def restored(text: str, reading: Reading) -> str | None:
    """The text as it was, "" where characters were lost, None if it is not damaged."""
    now, seen = text, {text}
    while True:
        if LOST in now:
            return ""
        after, sure = mend_sequences(now, reading)
        if LOST in after:
            return ""
        if not sure:  # a pair may read better
            other = mend_pairs(now, reading)
            if other != now and (after == now or reading.mean(other) > reading.mean(after)):
                after = other
            if (after == now or reading.mean(after) < reading.usual + FAR) and (wide := mend_multi_byte(now, reading)) != now:
                after = wide
        if after in seen:
            break
        seen.add(after)
        now = after
    return None if now == text else now


def letter_pairs(values: DataFrame, value: str = "value") -> DataFrame:
    """(pair, n): neighbouring characters in the words of all distinct values that are not of ASCII only, in lower case. At
    most the square of the known characters' number of rows."""
    known = alphabet() | {chr(b) for b in range(33, 127)} | {" "}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                w = "  ".join(_WORD.findall(t)).lower()
                w = f" {w} "
                total.update(map("".join, zip(w, w[1:], strict=False)))
        total = {p: n for p, n in total.items() if p != "  " and p[0] in known and p[1] in known}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])

    distinct = values.select(value).filter(_not_ascii(value)).distinct()
    return distinct.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _not_ascii(value: str):
    return F.col(value).isNotNull() & (F.octet_length(value) > F.length(value))


_READINGS: dict[str, Reading] = {}


def repair(values: DataFrame, id: str = "value_id", value: str = "value") -> DataFrame:
    """(id, restored): every distinct `id` whose value is damaged, with the whole value as it was, "" where characters
    were lost. Null ids, null and empty values and undamaged values give no row; of several values of one id the least
    that is not of ASCII only counts. An empty table gives no row.
    """
    rows = values.select(F.col(id).alias("id"), F.col(value).cast("string").alias("value")).filter(F.col("id").isNotNull() & _not_ascii("value"))
    spark = rows.sparkSession
    pairs = {r["pair"]: r["n"] for r in letter_pairs(rows).collect()}  # bounded by the square of the alphabet
    # the automata are made once; their size is bounded by the encodings and by the pairs
    sent = spark.sparkContext.broadcast((pairs, Reading(pairs).images, {full: automaton(full) for full in (False, True)}))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READINGS:
            _READINGS.clear()
            _READINGS[key] = Reading(sent.value[0])
            _READINGS[key].images = sent.value[1]
            _AUTOMATA.update(sent.value[2])
        reading, known = _READINGS[key], {}
        for b in batches:
            ids, texts = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t not in known:
                    known[t] = restored(t, reading)
                if known[t] is not None:
                    ids.append(i), texts.append(known[t])
            known.clear() if len(known) > 50_000 else None
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(texts, pa.string())], ["id", "restored"])

    kind = dict(rows.dtypes)["id"]
    return rows.groupBy("id").agg(F.min("value").alias("value")).mapInArrow(run, f"id {kind}, restored string").withColumnRenamed("id", id)
