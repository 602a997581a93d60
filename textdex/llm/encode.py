"""Token ids of a whole corpus by a public byte-level BPE tokenizer.

Frequent words (pieces of the tokenizer's split pattern, found by a Misra-Gries summary over all texts) are compiled with
their ids into a minimal acyclic transducer: an automaton whose equal suffixes are shared and whose arcs carry numbers
that add up to a word's index in the table of ids. It is one file, shipped once and memory-mapped by every worker. Words
it lacks are merged exactly by rank. The lexicon only decides how ids are found, never which: any lexicon, even an empty
one, gives the same result.
"""

from __future__ import annotations

import base64
import functools
import json
import mmap
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdex.llm import heavy
from textdex.session import put_file, scratch_dir

#: Where the vocabulary files of the public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
#: Words compiled into the lexicon at most.
MAX_WORDS = 32_768
#: Letters of a word in the lexicon at most: with MAX_WORDS it bounds the lexicon's bytes.
MOST_LETTERS = 32
#: Words a task remembers at most; beyond that it starts afresh.
MEMORY = 200_000
# The tokenizer's split pattern, words first (no piece of theirs begins like another's), and the same for
# the usual texts in the plainer syntax of the standard library, which is faster.
PATTERN = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
USUAL_PATTERN = r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
ASCII_PATTERN = r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"


class Splitter:
    """Splits text into the pieces that are merged one by one."""

    def __init__(self):
        import regex

        self.any, self.usual, self.ascii = regex.compile(PATTERN).findall, re.compile(USUAL_PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.unusual = unusual().search

    def __call__(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.any(text) if self.unusual(text) else self.usual(text)


@functools.cache
def unusual() -> re.Pattern:
    """Characters that the plainer syntax may take for another kind: numbers other than decimal digits and whatever else the
    two libraries' tables class differently; from U+3000 on all are left to the other pattern without being looked at."""
    import regex

    letter, number, blank = (regex.compile(p).match for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
    word, digit, space = (re.compile(p).match for p in (r"[^\W\d_]", r"\d", r"\s"))
    differ = [c for c in map(chr, range(0x3000)) if (bool(letter(c)), bool(number(c)), bool(blank(c))) != (bool(word(c)), bool(digit(c)), bool(space(c)))]
    return re.compile("[" + "".join(map(re.escape, differ)) + "\u3000-\U0010ffff]")


class Codes(dict):
    """Numbers keys as they are met."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte sequences and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """Exact merges by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        # the pattern is never used: pieces come from Splitter
        self._bpe = tiktoken.Encoding("textdex", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __call__(self, piece: bytes) -> list[int]:
        return self._bpe.encode_single_piece(piece)


class Transducer:
    """A minimal acyclic transducer over bytes; looks up many words at a time."""

    ARRAYS = ("keys", "target", "add", "final", "starts", "ids")

    def __init__(self, arrays: dict[str, np.ndarray], longest: int):
        self.__dict__ |= arrays
        self.longest = longest

    @classmethod
    def compile(cls, words: Iterable[bytes], ids_of) -> "Transducer":
        """The transducer of distinct `words`; ids_of gives the ids of one. Words are added in byte order; as soon as a
        state can get no more arcs it is replaced by an equal one seen before."""
        words = sorted(set(words))
        register: dict[tuple, int] = {}
        nodes: list[tuple] = []  # (final, ((byte, node), ...)), a node's targets come before it

        def freeze(node) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(nodes)
                nodes.append(key)
            return register[key]

        path: list[list] = [[False, []]]
        last = b""
        for w in words:
            common = os.path.commonprefix([last, w])
            for depth in range(len(last), len(common), -1):
                done = freeze(path.pop())
                path[-1][1].append((last[depth - 1], done))
            path += [[False, []] for _ in range(len(w) - len(common))]
            path[-1][0] = True
            last = w
        for depth in range(len(last), 0, -1):
            done = freeze(path.pop())
            path[-1][1].append((last[depth - 1], done))
        root = freeze(path.pop())
        below = []  # words from each node on
        for final, arcs in nodes:
            below.append(int(final) + sum(below[t] for _, t in arcs))
        order = {root: 0} | {n: i + 1 for i, n in enumerate(n for n in range(len(nodes)) if n != root)}
        rows = []
        for n, (final, arcs) in enumerate(nodes):
            before = int(final)
            for byte, t in arcs:
                rows.append((order[n] << 8 | byte, order[t], before))
                before += below[t]
        rows.sort()
        final = np.zeros(len(nodes), np.uint8)
        for n, (f, _) in enumerate(nodes):
            final[order[n]] = f
        ids = [ids_of(w) for w in words]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return cls({
            "keys": np.array([r[0] for r in rows], np.int64), "target": np.array([r[1] for r in rows], np.int32), "add": np.array([r[2] for r in rows], np.int32),
            "final": final, "starts": starts, "ids": np.array([i for x in ids for i in x], np.int32),
        }, max(map(len, words), default=0))

    def save(self, path: str) -> None:
        parts, at = [], 0
        heads = {}
        for name in self.ARRAYS:
            a = getattr(self, name)
            heads[name] = (a.dtype.str, len(a), at)
            parts.append(a.tobytes() + b"\0" * (-a.nbytes % 16))
            at += len(parts[-1])
        head = json.dumps({"arrays": heads, "longest": self.longest}).encode()
        head += b" " * (-len(head) % 16)
        with open(path, "wb") as f:
            f.write(len(head).to_bytes(16, "little") + head + b"".join(parts))

    @classmethod
    def open(cls, path: str) -> "Transducer":
        """Memory-maps a saved transducer."""
        with open(path, "rb") as f:
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(m[:16], "little")
        head = json.loads(m[16 : 16 + n])
        return cls({k: np.frombuffer(m, d, size, 16 + n + at) for k, (d, size, at) in head["arrays"].items()}, head["longest"])

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word in the table of ids, -1 where it is not in the lexicon. All words walk together."""
        out = np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        live = np.nonzero((sizes > 0) & (sizes <= self.longest))[0]
        if not len(live) or not len(self.keys):
            return out
        text = np.frombuffer(b"".join([words[i] for i in live]), np.uint8)
        begin = np.cumsum(sizes[live]) - sizes[live]
        state, number, size = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), sizes[live]
        at = 0
        while len(live):
            key = state << 8 | text[begin + at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, begin, size, arc, number = live[ok], begin[ok], size[ok], arc[ok], number[ok]
            state, number = self.target[arc].astype(np.int64), number + self.add[arc]
            at += 1
            ended = size == at
            hit = ended & (self.final[state] == 1)
            out[live[hit]] = number[hit]
            live, begin, size, state, number = (x[~ended] for x in (live, begin, size, state, number))
        return out


class Encoder:
    """Encodes batches of texts; words met before in the task are remembered."""

    def __init__(self, lexicon: Transducer, merge: Merger):
        self.lexicon, self.merge, self.split = lexicon, merge, Splitter()
        self.forget()

    def forget(self) -> None:
        self.codes = Codes()
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        at = self.lexicon.find(data)
        starts, ids = self.lexicon.starts, self.lexicon.ids
        parts = [ids[starts[i] : starts[i + 1]] if i >= 0 else np.array(self.merge(w), np.int32) for i, w in zip(at.tolist(), data, strict=True)]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, *parts])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Lists of ids; null and empty texts give empty lists."""
        if len(self.codes) > MEMORY:
            self.forget()
        codes, split, ends, flat = self.codes, self.split, [0], []
        known = len(codes)
        for t in texts:
            if t:
                flat += map(codes.__getitem__, split(t))
            ends.append(len(flat))
        if len(codes) > known:
            self._learn(list(codes)[known:])
        word = np.array(flat, np.int64)
        size = self.size[word]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = self.pool[np.repeat(self.start[word] - (end - size), size) + np.arange(total)]
        edges = np.concatenate([[0], end])[np.array(ends)]
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = Splitter()
    for b in batches:
        counts: Counter = Counter()
        for t in b.column(0).to_pylist():
            if t:
                counts.update(p for p in split(t) if len(p) <= MOST_LETTERS)  # longer ones are merged when they are met
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["value", "count"])


def frequent_words(docs: DataFrame, text: str = "text", limit: int = MAX_WORDS) -> list[str]:
    """At most `limit` of the most frequent pieces of all texts, by a summary of 2 * limit counters."""
    texts = docs.select(text).filter(F.col(text).isNotNull())
    k = 2 * limit
    out = heavy.merged(texts.mapInArrow(heavy.summariser(k, _pieces), heavy.SUMMARY), texts.rdd.getNumPartitions(), k)
    return [r["value"] for r in out.orderBy(F.desc("count"), "value").limit(limit).select("value").collect()]


def build_lexicon(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", limit: int = MAX_WORDS) -> Transducer:
    """The transducer of the corpus's frequent words. Made on the driver from at most `limit` words."""
    merge = Merger(ranks)
    return Transducer.compile((w.encode("utf-8", "surrogatepass") for w in frequent_words(docs, text, limit)), merge)


_ENCODERS: dict[str, Encoder] = {}


def encode_corpus(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS, lexicon: Transducer | None = None) -> DataFrame:
    """(id, ids): one row for each row of `docs`, the ids of its text without special tokens.

    Null and empty texts give empty lists; strings that look like special tokens are ordinary text; a null id stays null
    and repeated rows stay repeated. tokenizer names a rank file of the folder `tokenizers`, which only the driver reads.
    """
    sc = docs.sparkSession.sparkContext
    ranks = read_ranks(os.path.join(tokenizers, f"{tokenizer}.tiktoken"))
    lexicon = lexicon or build_lexicon(docs, ranks, text)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    with tempfile.TemporaryDirectory() as d:
        lexicon.save(os.path.join(d, name))
        shared = put_file(docs.sparkSession, os.path.join(d, name), scratch_dir(docs.sparkSession, "lexicon"))
    sc.addFile(shared)  # every executor fetches its own copy, once, to map it
    sent = sc.broadcast(ranks)  # a vocabulary: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(Transducer.open(SparkFiles.get(name)), Merger(sent.value))
        encoder = _ENCODERS[name]
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column(1).to_pylist())], [id, "ids"])

    return docs.select(F.col(id).cast("long").alias(id), F.col(text).alias("text")).mapInArrow(run, f"`{id}` long, ids array<int>")
