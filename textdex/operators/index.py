"""The inverted index: words to blocks, files, offsets or records; vocabulary, stop lists, statistics, maintenance.

All parts are plain tables of (word, attr_id, file_id, ...). Attribute 0 is text outside any attribute.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textdex.functions import text as T
from textdex.plans.compile import balanced
from textdex.session import rows_below, tasks_of, written

#: Largest side that is broadcast, in rows; beyond it the planner joins by shuffling.
BROADCAST_ROWS = 100_000


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcasting if it is checked to have at most `limit` rows."""
    return F.broadcast(df) if rows_below(df, limit) else df


def postings_file(files: DataFrame, numbers: bool = False) -> DataFrame:
    """(word, file_id, tf): occurrences of each word in each file."""
    return T.tokens(files, numbers).groupBy("word", "file_id").agg(F.count(F.lit(1)).alias("tf"))


def postings_offset(files: DataFrame, numbers: bool = False) -> DataFrame:
    """(word, file_id, offsets ARRAY<LONG>), offsets ascending."""
    return T.word_offsets(files, numbers).groupBy("word", "file_id").agg(F.array_sort(F.collect_list("off")).alias("offsets"))


def offset_deltas(files: DataFrame, numbers: bool = False) -> DataFrame:
    """(word, file_id, off, delta): each offset with its distance from the word's offset before in the file, null at the
    first. One row for each occurrence; what is shuffled are the offset postings."""
    gap = lambda off, i: F.struct(off.alias("off"), (off - F.get("offsets", i - 1)).alias("delta"))
    return postings_offset(files, numbers).select("word", "file_id", F.inline(F.transform("offsets", gap)))


def postings_record(files: DataFrame, delim: str = "\n", numbers: bool = False) -> DataFrame:
    """(word, file_id, rec_no): records that hold the word."""
    recs = T.records(files, delim)
    return recs.select("file_id", "rec_no", F.explode(F.array_distinct(T.word_array(F.col("rec"), numbers))).alias("word")).select("word", "file_id", "rec_no")


def _ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows` with (range, at): sorted in ranges of about equal size, whatever the values, and numbered within them.

    The ranges are drawn by a sample, so the rows are written before they are read again: all must see the same ranges."""
    ranges = rows.repartitionByRange(tasks_of(rows.sparkSession), *order).sortWithinPartitions(*order)
    # the number has the range above 33 bits and the row within it below
    out = written(ranges.withColumn("at", F.monotonically_increasing_id()), "ranges")
    return out.withColumn("range", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))


def _before(rows: DataFrame, amount: Column) -> DataFrame:
    """(range, before): the sum of `amount` over the ranges before; one row for each range, of which there are as many as
    reduce tasks."""
    sums = rows.groupBy("range").agg(F.sum(amount).alias("total"))
    return F.broadcast(sums.select("range", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))


def _running(files: DataFrame) -> DataFrame:
    """(file_id, before): bytes of the files with a lower id. No task sees all files. A null size counts 0."""
    rows = _ranged(files.select("file_id", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size")), F.col("file_id"))
    inside = F.sum("size").over(Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(_before(rows, F.col("size")), "range")
    return out.select("file_id", (F.col("before") + F.col("inside")).alias("before"))


def blocks_fixed(files: DataFrame, block_bytes: int) -> DataFrame:
    """(file_id, block_id): files in order of id, a new block whenever the running size passes a multiple of block_bytes.
    A null size counts 0."""
    return _running(files).select("file_id", F.floor(F.col("before") / block_bytes).cast("int").alias("block_id"))


def blocks(files: DataFrame, most: int = 250, least: int = 200) -> DataFrame:
    """(file_id, block_id): blocks of total / `most` bytes, made a tenth smaller until at least min(`least`, files / 2) of
    them have a file, or a block is one byte. Ids have holes where a file is longer than a block."""
    at = written(_running(files), "running")
    n, total = files.count(), files.agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()[0]
    limit = max(1, total // most)
    limits = [limit]
    while limits[-1] > 1:
        limits.append(max(1, int(limits[-1] * 0.9)))
    wanted = min(least, n / 2)
    for start in range(0, len(limits), 16):  # sixteen sizes are tried in one pass
        some = limits[start : start + 16]
        counts = at.agg(*[F.countDistinct(F.floor(F.col("before") / x)).alias(f"n{k}") for k, x in enumerate(some)]).first()
        fit = next((x for k, x in enumerate(some) if counts[k] >= wanted), None)
        if fit is not None:
            break
    else:
        fit = 1
    return at.select("file_id", F.floor(F.col("before") / fit).cast("int").alias("block_id"))


def postings_block(postings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(word, blocks ARRAY<INT>): blocks that hold the word, ascending."""
    return postings.join(blocks, "file_id").select("word", "block_id").distinct().groupBy("word").agg(F.array_sort(F.collect_set("block_id")).alias("blocks"))


def vocabulary(postings: DataFrame) -> DataFrame:
    """(word, df, tf) of file postings."""
    return postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def stop_words_share(vocab: DataFrame, n_files: int, percent: float = 80, least_files: int = 254) -> DataFrame:
    """Words in at least `percent` % of the files; none with `least_files` files or fewer."""
    return vocab.filter((F.lit(n_files) > least_files) & (F.col("df") * 100 >= F.lit(percent * n_files)))


def stop_words_density(vocab: DataFrame, total_bytes: int, per_mb: int = 500) -> DataFrame:
    """Words with at least `per_mb` occurrences for each megabyte of text."""
    # a total that fits an int is one as a literal, and its product may not be
    return vocab.filter(F.col("tf") * 1_048_576 >= F.lit(per_mb) * F.lit(total_bytes).cast("long"))


def new_words(postings: DataFrame) -> DataFrame:
    """(file_id, new_words, numeric): words whose first file, by id, this is; numeric: those with a digit."""
    first = postings.groupBy("word").agg(F.min("file_id").alias("file_id"))
    return first.groupBy("file_id").agg(F.count(F.lit(1)).alias("new_words"), F.sum(F.col("word").rlike("[0-9]").cast("long")).alias("numeric"))


def statistics(files: DataFrame) -> DataFrame:
    """One row: n_files, n_deleted, total_size of (size, deleted)."""
    gone = F.coalesce(F.col("deleted"), F.lit(False))
    return files.agg(F.sum((~gone).cast("long")).alias("n_files"), F.sum(gone.cast("long")).alias("n_deleted"), F.coalesce(F.sum(F.when(~gone, F.col("size"))), F.lit(0)).cast("long").alias("total_size"))


# lookups


def containing(vocab: DataFrame, word: str) -> DataFrame:
    """Words of the vocabulary that contain `word`, as the search without `word` option needs."""
    return vocab.filter(F.col("word").contains(word.lower()))


def holds(word: Column, part: str, whole: bool = False) -> Column:
    """Whether an index word is or, unless it must be whole, contains `part`. A whole word may also be bounded by _, which is
    a letter of the index but none of the records' words."""
    inside = word.contains(part)
    return (word == part) | (inside & word.contains("_")) if whole else inside


def candidates(postings: DataFrame, word: str, whole: bool = False) -> DataFrame:
    """(file_id) of files with the word, or with a word that contains it, by the postings alone."""
    return postings.filter(holds(F.col("word"), word.lower(), whole)).select("file_id").distinct()


def all_of(sets: list[DataFrame]) -> DataFrame:
    """Files in every set: one aggregation over the union, whatever the number of sets."""
    if len(sets) == 1:
        return sets[0].select("file_id").distinct()
    return _numbered(sets).groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(sets)).select("file_id")


def _numbered(sets: list[DataFrame]) -> DataFrame:
    """(file_id, s): each file of each set once."""
    every = [s.select("file_id", F.lit(n).alias("s")) for n, s in enumerate(sets)]
    while len(every) > 1:  # as a tree, so that the plan of many sets stays flat
        every = [every[i].unionByName(every[i + 1]) if i + 1 < len(every) else every[i] for i in range(0, len(every), 2)]
    return every[0].distinct()


def any_of(sets: list[DataFrame]) -> DataFrame:
    """Files in at least one of the sets."""
    return _numbered(sets).select("file_id").distinct()


def none_of(files: DataFrame, found: DataFrame) -> DataFrame:
    return files.select("file_id").join(found, "file_id", "left_anti")


def near(offsets: DataFrame, first: str, second: str, limit: int = 256) -> DataFrame:
    """(file_id, off): occurrences of words that contain `first` with one that contains `second` at most `limit` away.

    A band join: equi-join on file and cell of `limit` offsets, each right row entered in its own and both neighbouring
    cells, then the exact test.
    """
    cell = max(1, limit)
    left = offsets.filter(F.col("word").contains(first.lower())).select("file_id", "off", F.floor(F.col("off") / cell).alias("c"))
    right = offsets.filter(F.col("word").contains(second.lower())).select(F.col("file_id").alias("f"), F.col("off").alias("o"), F.explode(F.array(*[F.floor(F.col("off") / cell) + d for d in (-1, 0, 1)])).alias("rc"))
    return left.join(right, (F.col("file_id") == F.col("f")) & (F.col("c") == F.col("rc")) & (F.abs(F.col("off") - F.col("o")) <= limit), "left_semi").select("file_id", "off")


def near_in_files(files: DataFrame, first: str, others: str | list[str], limit: int = 256) -> DataFrame:
    """`near` over the texts of (file_id, text), for one or several other words, all of which must be near; only files that
    hold all strings are scanned for words, once, and only the words that hold one of them go further."""
    others = [others] if isinstance(others, str) else others
    parts = [w.lower() for w in (first, *others)]
    if all(map(str.isascii, parts)):
        text = F.lower("text")
        for w in parts:
            files = files.filter(text.contains(w))
    hit = F.lit(False)
    for w in parts:
        hit = hit | F.col("word").contains(w)
    rows = written(T.word_offsets(files).filter(hit), "places")
    out = rows.filter(F.col("word").contains(parts[0])).select("file_id", "off")
    for w in parts[1:]:
        out = out.join(near(rows, first, w, limit), ["file_id", "off"], "left_semi")
    return out


def best_matches(vocab: DataFrame, word: str, most: int = 8) -> DataFrame:
    """(word, dist) of the vocabulary words nearest to `word`, with at most `most` edits and fewer than its letters."""
    limit = min(most, len(word) - 1)
    near_ = vocab.withColumn("dist", F.levenshtein("word", F.lit(word.lower()), limit)).filter("dist >= 0")
    least = near_.agg(F.min("dist").alias("least"))  # one row
    return near_.join(F.broadcast(least), F.col("dist") == F.col("least")).select("word", "dist")


# maintenance


def without(postings: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings of the files not in `gone` (file_id)."""
    return postings.join(gone.select("file_id").distinct(), "file_id", "left_anti").select(*postings.columns)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two file indexes as one; a file in both counts with its occurrences summed."""
    return a.select("word", "file_id", "tf").unionByName(b.select("word", "file_id", "tf")).groupBy("word", "file_id").agg(F.sum("tf").alias("tf"))


def changes(files: DataFrame, built_at: Column, vanished: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files to index anew, file_ids to drop): files changed since `built_at`, a null mtime counting as changed, and those
    in `vanished`, which are not indexed again."""
    changed = files.filter(F.coalesce(F.col("mtime") > built_at, F.lit(True)))
    gone = changed.select("file_id")
    if vanished is not None:
        gone = gone.unionByName(vanished.select("file_id"))
        changed = changed.join(vanished.select("file_id"), "file_id", "left_anti")
    return changed, gone


def updated(postings: DataFrame, files: DataFrame, built_at: Column, vanished: DataFrame | None = None) -> DataFrame:
    """The file postings after reindexing files (file_id, text, mtime) changed since `built_at` and dropping those in
    `vanished`."""
    changed, gone = changes(files, built_at, vanished)
    return without(postings, gone).unionByName(postings_file(changed).select(*postings.columns))


def renumbered(files: DataFrame) -> DataFrame:
    """(file_id, new_id): ids from 0 without holes, in the order of the old ones, deleted files left out. No task sees all
    files."""
    rows = _ranged(files.filter(~F.coalesce(F.col("deleted"), F.lit(False))).select("file_id"), F.col("file_id"))
    return rows.join(_before(rows, F.lit(1)), "range").select("file_id", (F.col("before") + F.col("at")).cast("long").alias("new_id"))


def by_age(files: DataFrame) -> DataFrame:
    """(file_id, mtime, place): all files from the youngest on, places from 1 without holes; ties by id, null times last.
    No task sees all files, even if they share one time or have none."""
    rows = _ranged(files.select("file_id", "mtime"), F.desc_nulls_last("mtime"), F.asc_nulls_last("file_id"))
    return rows.join(_before(rows, F.lit(1)), "range").select("file_id", "mtime", (F.col("before") + F.col("at") + 1).alias("place"))


def bitmap(ids: DataFrame) -> DataFrame:
    """(bucket, bits BINARY, n) of ids as bitmaps of 32,768."""
    return ids.groupBy(F.bitmap_bucket_number("file_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("file_id")).alias("bits")).withColumn("n", F.bitmap_count("bits"))


def bitmap_ids(bitmaps: DataFrame) -> DataFrame:
    """(file_id) of the ids in bitmaps (bucket, bits), as `bitmap` makes them of ids from 1 on."""
    octets = F.transform(F.sequence(F.lit(0), F.octet_length("bits") - 1), lambda i: F.conv(F.hex(F.substring("bits", i + 1, F.lit(1))), 16, 10).cast("int"))
    rows = bitmaps.select("bucket", F.posexplode(octets).alias("i", "octet")).filter("octet > 0")
    rows = rows.select("bucket", "i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.expr("octet").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) > 0)).alias("k"))
    return rows.select(((F.col("bucket") - 1) * 32_768 + F.col("i") * 8 + F.col("k") + 1).alias("file_id"))


def bitmap_names(bitmaps: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, path) of the ids in bitmaps; ids without a file are left out."""
    return bitmap_ids(bitmaps).join(files.select("file_id", "path"), "file_id")


def index_lines(postings: DataFrame, words: Column) -> DataFrame:
    """(word, files): the lines of the index whose word satisfies the condition, files in order."""
    return postings.filter(words).groupBy("word").agg(F.array_join(F.array_sort(F.collect_list("file_id")).cast("array<string>"), " ").alias("files"))


def offset_union(offsets: DataFrame, words: Column) -> DataFrame:
    """(file_id, offsets ARRAY): all offsets of the words that satisfy the condition, ascending, each once. offsets: (word,
    file_id, offsets ARRAY)."""
    return offsets.filter(words).groupBy("file_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("offsets")))).alias("offsets"))


def one_of(column: Column, values: list) -> Column:
    """Whether the column is one of the values, as a condition that is pushed to a scan value by value where they are few (a
    longer list is pushed as its least and greatest value)."""
    if len(values) > 200:
        return column.isin(values)
    return balanced([column == v for v in values])


#: Bytes of a table in one file of a saved index at most, and at least where there are as many files as tasks, by the estimate
#: of the plan; bytes of a row group.
FILE_BYTES, LEAST_BYTES, GROUP_BYTES = 64 << 20, 128 << 10, 4 << 20
#: Words or files that a lookup collects and pushes to a scan, at most; with more it joins.
MOST_PUSHED = 2000
#: A list of an AND this many times longer than the shortest one is not read: the texts decide.
LONGER = 20


def write_sorted(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Rows in ranges of the first key, sorted within files, so that a lookup reads the row groups its key can be in. File
    numbers ascend within a word, so they are kept as differences and not in a dictionary."""
    writer = rows.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd")
    writer.option("parquet.block.size", GROUP_BYTES).option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#file_id", "false").parquet(path)


@dataclass
class Index:
    """An index kept as tables. files: (file_id, path, size, mtime); texts: (file_id, text) in order of id, or None; postings:
    (word, file_id, tf); vocab: (word, df, tf); stop: (word); attributes: (attr_id, name); long_files: (file_id) of files
    with a word too long for the index, which stay candidates where a word is looked up; offsets: (word, file_id, offsets)
    and records: (word, file_id, rec_no), or None. path: where it is saved. meta: built_at, n_files, total_bytes, numbers."""

    postings: DataFrame
    vocab: DataFrame
    long_files: DataFrame
    files: DataFrame | None = None
    texts: DataFrame | None = None
    stop: DataFrame | None = None
    attributes: DataFrame | None = None
    offsets: DataFrame | None = None
    records: DataFrame | None = None
    meta: dict | None = None
    path: str | None = None

    TABLES = ("postings", "vocab", "long_files", "files", "texts", "stop", "attributes", "offsets", "records")
    KEYS = {"postings": ["word", "file_id"], "vocab": ["word"], "long_files": ["file_id"], "files": ["file_id"], "texts": ["file_id"], "stop": ["word"], "attributes": ["attr_id"], "offsets": ["word", "file_id"], "records": ["word", "file_id", "rec_no"]}

    @classmethod
    def build(cls, files: DataFrame, numbers: bool = False, offsets: bool = False, records: bool = False, stop_percent: float = 80, attributes: DataFrame | None = None) -> "Index":
        """An index of (file_id, text, ...). offsets, records: with the places of the words too. The stop list has the words
        in at least stop_percent % of the files, none of few files."""
        have = set(files.columns)
        size = F.octet_length("text").cast("long").alias("size")
        kept = files.select("file_id", (F.col("path") if "path" in have else F.col("file_id").cast("string")).alias("path"), size, (F.col("mtime") if "mtime" in have else F.lit(None).cast("timestamp")).alias("mtime"))
        p = postings_file(files, numbers)
        vocab = vocabulary(p)
        return cls(
            p, vocab, _long_files(files, numbers), kept, files.select("file_id", "text"), None, attributes,
            postings_offset(files, numbers) if offsets else None, postings_record(files, numbers=numbers) if records else None, {"numbers": numbers, "stop_percent": stop_percent},
        )

    def save(self, path: str, buckets: int | None = None) -> "Index":
        """Writes the tables below `path` and opens them. buckets: files of the largest table, by its size where not given.
        The vocabulary and the stop list are made from the written postings, not from the texts again."""
        spark, meta = self.postings.sparkSession, dict(self.meta or {})
        for name in self.TABLES:
            table = getattr(self, name)
            if name in ("vocab", "stop") or table is None:
                continue
            n = buckets if buckets and name in ("postings", "offsets", "records", "texts") else _pieces(table)
            write_sorted(table, f"{path}/{name}", self.KEYS[name], n)
        postings = spark.read.parquet(f"{path}/postings")
        write_sorted(vocabulary(postings), f"{path}/vocab", ["word"], max(1, (buckets or _pieces(postings)) // 4))
        vocab = spark.read.parquet(f"{path}/vocab")
        if self.files is not None:
            row = spark.read.parquet(f"{path}/files").agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.max("mtime").cast("string")).first()
            meta |= {"n_files": row[0], "total_bytes": row[1], "built_at": row[2]}
            stop = stop_words_share(vocab, row[0], meta.get("stop_percent", 80)).select("word")
            write_sorted(stop, f"{path}/stop", ["word"], 1)
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return self.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Index":
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        have = {s.getPath().getName() for s in fs.listStatus(at)}
        tables = {name: spark.read.parquet(f"{path}/{name}") if name in have else None for name in cls.TABLES}
        return cls(**tables, meta=json.loads(spark.read.parquet(f"{path}/meta").first()["meta"]), path=path)

    def reload(self) -> "Index":
        """The index as it now is on disk."""
        if self.path is None:
            raise ValueError("an index that was never saved cannot be read again")
        spark = self.postings.sparkSession
        spark.catalog.refreshByPath(self.path)
        return self.open(spark, self.path)

    def merged(self, other: "Index") -> "Index":
        """Both indexes as one, to be saved. A file in both counts with its occurrences summed; its places are those of both;
        of its row and text the right side's count."""
        rows = lambda name: (getattr(self, name), getattr(other, name))
        out = {"postings": merged(self.postings, other.postings), "meta": {**(self.meta or {}), **(other.meta or {})}}
        for name, make in (("long_files", lambda a, b: a.unionByName(b).distinct()), ("attributes", lambda a, b: a.unionByName(b).distinct()), ("records", lambda a, b: a.unionByName(b).distinct()), ("offsets", merged_offsets), ("files", right_of), ("texts", right_of)):
            a, b = rows(name)
            out[name] = a if b is None else b if a is None else make(a, b)
        return Index(**out, vocab=vocabulary(out["postings"]))

    def without(self, gone: DataFrame) -> "Index":
        """The index without the files of `gone` (file_id), to be saved."""
        left = {name: without(t, gone) for name in ("postings", "long_files", "files", "texts", "offsets", "records") if (t := getattr(self, name)) is not None}
        return replace(self, **left, vocab=vocabulary(left["postings"]), stop=None, path=None)

    def updated(self, files: DataFrame, built_at: Column, vanished: DataFrame | None = None) -> "Index":
        """The index after indexing files changed since `built_at` anew, in all its parts, and dropping those in `vanished`."""
        changed, gone = changes(files, built_at, vanished)
        fresh = Index.build(changed, bool((self.meta or {}).get("numbers")), self.offsets is not None, self.records is not None, attributes=self.attributes)
        return self.without(gone).merged(fresh)

    # lookups

    def words(self, needed: list[tuple[str, bool]]) -> dict[tuple[str, bool], dict[str, int]] | None:
        """For each needed (part, whole): the index words that hold it, with the number of their files. One pass over the
        vocabulary for all of them, none over the postings. None if they are too many to be pushed to a scan."""
        word, hit = F.col("word"), F.lit(False)
        for part, whole in needed:
            hit = hit | holds(word, part, whole)
        rows = self.vocab.filter(hit).select("word", "df").limit(MOST_PUSHED + 1).collect()
        if len(rows) > MOST_PUSHED:
            return None
        has = lambda w, part, whole: w == part or (part in w and (not whole or "_" in w))
        return {(part, whole): {r["word"]: r["df"] for r in rows if has(r["word"], part, whole)} for part, whole in needed}

    def posted(self, words: set[str], table: str = "postings") -> DataFrame:
        """Rows of the words, at most MOST_PUSHED: the scan reads only the row groups they can be in."""
        return getattr(self, table).filter(one_of(F.col("word"), sorted(words)))

    def candidates(self, word: str, whole: bool = False) -> DataFrame:
        """(file_id) of the files that may hold the word: those with it, and those with words too long for the index."""
        found = self.words([(word.lower(), whole)])
        hit = candidates(self.postings, word, whole) if found is None else self.posted(set(found[word.lower(), whole])).select("file_id")
        return hit.unionByName(self.long_files.select("file_id")).distinct()

    def size(self) -> dict[str, int]:
        """Bytes of each saved table."""
        spark = self.postings.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        return {s.getPath().getName(): fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(at)}


def _pieces(table: DataFrame) -> int:
    """Files to write a table in, by the planner's estimate of its bytes; no job."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(20_000, max(-(-size // FILE_BYTES), min(tasks_of(table.sparkSession), size // LEAST_BYTES))))


def _long_files(files: DataFrame, numbers: bool) -> DataFrame:
    letters = r"\p{L}\p{Nd}_" if numbers else r"\p{L}_"
    return files.filter(F.col("text").rlike(f"[{letters}]{{{T.MAX_WORD + 1}}}")).select("file_id")


def merged_offsets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two offset indexes as one; a file in both has the offsets of both, each once."""
    both = a.select("word", "file_id", "offsets").unionByName(b.select("word", "file_id", "offsets"))
    return both.groupBy("word", "file_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("offsets")))).alias("offsets"))


def right_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by file_id; where both sides have a file the right one counts."""
    return a.join(b.select("file_id"), "file_id", "left_anti").select(*a.columns).unionByName(b.select(*a.columns))
