"""How often every term occurs and in how many records, kept up to date by signed deltas.

The store is a folder of two tables that only grow by what changes: `terms`, one row for each record and term as each update
brought them, in buckets of records; and `counts`, signed changes of each term, in buckets of terms. An update appends its
records and reads, of the touched buckets only, what the touched records held before: old and new rows become signed
changes (+ for added, - for removed, the difference for changed ones), which are summed for each term and appended. The
corpus is never recounted and nothing old is rewritten; the number of records moves with the updates. Reading merges the
changes of each term; after MOST_VERSIONS updates they are merged on disk, so that the cost of merging is spread over them.

A version is in force once its marker is written, so a job that dies leaves the version before in force; what it left is
removed by the next update. Merging writes new tables beside the old ones, which stay until the next merge: open readers
keep what they read.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textdex.session import scratch_dir, written

TERMS = "file_id long, rec_no int, term string, occ long, gone boolean, version int, bucket int"
COUNTS = "term string, occurrences long, n_records long, version int, bucket int"
RECORD = ["file_id", "rec_no"]
#: Bytes of the first load that make one bucket, and the bounds of their number.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16 << 20, 32, 8192
#: Records of a file that share a bucket: an update of a small file touches few buckets, a large file fills many.
RUN = 256
#: Updates after which the changes are merged on disk.
MOST_VERSIONS = 16
#: File numbers that are pushed to the scan of the touched buckets, at most; with more, whole buckets are read.
MOST_IDS = 1000


def latest(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The row of each key that is latest by `at` (null is earliest); ties go to the greatest row, so the choice is fixed."""
    rest = [c for c in df.columns if c not in (*keys, at)]
    return df.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in (at, *rest)])


def record_terms(tokens: DataFrame) -> DataFrame:
    """(file_id, rec_no, term, occ): terms of each record with their occurrences.

    tokens: (token_id, file_id, rec_no, word, totalcount, added_at). A repeated token_id counts once, as delivered last;
    words are folded to lower case; a null count adds 0. A null word stays as a null term, so that a record of null words
    is still a record; it is no term of the counts.
    """
    rows = latest(tokens.select("token_id", "file_id", "rec_no", F.lower("word").alias("term"), "totalcount", "added_at"), ["token_id"], "added_at")
    return rows.groupBy("file_id", "rec_no", "term").agg(F.coalesce(F.sum(F.col("totalcount").cast("long")), F.lit(0)).alias("occ"))


def signed_deltas(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(term, d_occ, d_records): what replacing the rows `old` by `new` changes; terms without a change are left out.

    Both are (file_id, rec_no, term, occ) with one row for each record and term. old is None where nothing was there.
    """
    if old is None:
        return new.filter("term is not null").groupBy("term").agg(F.sum("occ").alias("d_occ"), F.count(F.lit(1)).alias("d_records"))
    both = new.select("term", F.col("occ").alias("d_occ"), F.lit(1).cast("long").alias("d_records")).unionByName(
        old.select("term", (-F.col("occ")).alias("d_occ"), F.lit(-1).cast("long").alias("d_records")))
    both = both.filter("term is not null").groupBy("term").agg(F.sum("d_occ").alias("d_occ"), F.sum("d_records").alias("d_records"))
    return both.filter("d_occ <> 0 or d_records <> 0")


def merge_counts(counts: DataFrame) -> DataFrame:
    """Signed changes (term, occurrences, n_records, bucket) merged into one row a term. Terms of no record any more are
    dropped."""
    out = counts.groupBy("bucket", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_records").alias("n_records"))
    return out.filter("n_records > 0").select("term", "occurrences", "n_records", "bucket")


def bucket_of(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def record_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("file_id", F.floor(F.col("rec_no") / RUN)), F.lit(buckets)).cast("int")


class TermStore:
    """Counts that persist between updates. path is a folder all executors reach; a fresh one, kept for the session, by
    default. buckets: their number, by the size of the first load where not given."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path or scratch_dir(spark, "terms"), buckets
        self.version, self.base, self.generation, self.records = 0, 0, 0, 0
        for name in self._names():  # done-version-base-generation-records-buckets
            if name.startswith("done-"):
                state = [int(x) for x in name.split("-")[1:]]
                if (state[2], state[0]) >= (self.generation, self.version):
                    self.version, self.base, self.generation, self.records, self.buckets = state

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(self._at())] if fs.exists(self._at()) else []

    def _folder(self, name: str, generation: int | None = None) -> str:
        return f"{self.path}/{name}-{self.generation if generation is None else generation}"

    def _table(self, name: str, schema: str) -> DataFrame | None:
        """All rows up to the version in force."""
        if not self.version:
            return None
        return self.spark.read.schema(schema).parquet(self._folder(name)).filter(F.col("version") <= self.version)

    def _mark(self) -> None:
        fs = self._fs()
        fs.create(self._at(f"done-{self.version}-{self.base}-{self.generation}-{self.records}-{self.buckets}")).close()

    def terms(self) -> DataFrame | None:
        """(file_id, rec_no, term, occ): what each record holds now."""
        rows = self._table("terms", TERMS)
        return None if rows is None else _current(rows, self.version == self.base).select(*RECORD, "term", "occ")

    def counts(self) -> DataFrame | None:
        """(term, occurrences, n_records, bucket) of every term."""
        rows = self._table("counts", COUNTS)
        if rows is None:
            return None
        return rows.drop("version") if self.version == self.base else merge_counts(rows)

    def n_records(self) -> int:
        """Records in the store, those with only null words included."""
        return self.records

    def update(self, new: DataFrame, gone: DataFrame | None = None) -> "TermStore":
        """Put the records of `new` (file_id, rec_no, term, occ: whole records) in place of what they held before.

        gone: (file_id, rec_no) of deleted records. Records in neither keep their counts; a record in both is replaced.
        Deleting a record that is not there changes nothing. An empty update makes a version equal to the last.
        """
        version, fs = self.version + 1, self._fs()
        if self.buckets is None:
            size = int(str(new._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # an estimate, without a job
            self.buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length()))
        at = {name: f"{self._folder(name)}/version={version}" for name in ("terms", "counts")}
        for path in at.values():  # of an update that died
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        # by bucket first: what made `new` record by record then needs no exchange of its own
        rows = new.select(*RECORD, "term", "occ", F.lit(False).alias("gone"))
        _write_terms(rows, at["terms"], self.buckets)
        schema = ", ".join(c for c in TERMS.split(", ") if not c.startswith("version"))
        fresh = self.spark.read.schema(schema).parquet(at["terms"])
        if gone is not None:
            keys = fresh.select(*RECORD).distinct().alias("k")
            rest = gone.select(*RECORD).distinct().alias("g").join(keys, _same("g", "k"), "left_anti")
            rest = rest.select(*RECORD, F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("occ"), F.lit(True).alias("gone"))
            _write_terms(rest, at["terms"], self.buckets)
            fresh = self.spark.read.schema(schema).parquet(at["terms"])
        before = self._before(fresh)
        now = fresh.filter("not gone")
        _write_counts(signed_deltas(before, now), at["counts"], self.buckets)
        size = lambda rows: rows.select(*RECORD).distinct().count()
        self.records += size(now) - (size(before) if before is not None else 0)
        self.version, self.base = version, self.base or version
        self._mark()
        if self.version - self.base >= MOST_VERSIONS:
            self.compact()
        return self

    def _before(self, fresh: DataFrame) -> DataFrame | None:
        """(file_id, rec_no, term, occ) that the records of `fresh` hold in the version in force, read from their buckets;
        written, as it is read twice."""
        rows = self._table("terms", TERMS)
        if rows is None:
            return None
        touched = fresh.select(*RECORD, "bucket").distinct()
        buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most the store's buckets
        ids = [r["file_id"] for r in touched.select("file_id").distinct().limit(MOST_IDS + 1).collect()]
        rows = rows.filter(F.col("bucket").isin(buckets))
        if len(ids) <= MOST_IDS and None not in ids:
            rows = rows.filter(F.col("file_id").isin(ids))
        rows = rows.alias("o").join(touched.select(*RECORD).alias("t"), _same("o", "t"), "left_semi")
        return written(_current(rows, self.version == self.base).select(*RECORD, "term", "occ"), "before")

    def compact(self) -> "TermStore":
        """Merge the changes on disk: what each record holds now, and one row a term. Tables of two merges ago are removed."""
        if not self.version or self.version == self.base:
            return self
        fs, after = self._fs(), self.generation + 1
        at = {name: f"{self._folder(name, after)}/version={self.version}" for name in ("terms", "counts")}
        for path in at.values():
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        _write_terms(self.terms().withColumn("gone", F.lit(False)), at["terms"], self.buckets)
        counts = self.counts().select("term", F.col("occurrences").alias("d_occ"), F.col("n_records").alias("d_records"))
        _write_counts(counts, at["counts"], self.buckets)
        self.generation, self.base = after, self.version
        self._mark()
        for name in self._names():
            part, _, n = name.partition("-")
            if part in ("terms", "counts") and int(n) < after - 1 or part == "done" and int(name.split("-")[3]) < after - 1:
                fs.delete(self._at(name), True)
        return self


def _same(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in RECORD]


def _current(rows: DataFrame, single: bool) -> DataFrame:
    """The rows of each record's last version that are not of deleted ones. single: there is one version only."""
    if not single:
        rows = rows.withColumn("__last", F.max("version").over(Window.partitionBy("bucket", *RECORD))).filter("version = __last")
    return rows.filter("not gone")


def _write_terms(rows: DataFrame, path: str, buckets: int) -> None:
    rows = rows.withColumn("bucket", record_bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", *RECORD)
    rows.write.mode("append").partitionBy("bucket").parquet(path)


def _write_counts(deltas: DataFrame, path: str, buckets: int) -> None:
    rows = deltas.select("term", F.col("d_occ").alias("occurrences"), F.col("d_records").alias("n_records"), bucket_of("term", buckets).alias("bucket"))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def marked_counts(counts: DataFrame, n_records: int, dictionary: DataFrame, share: float = 0.1) -> DataFrame:
    """(word, occurrences, n_records, dict_freq, mark) of every counted term.

    dictionary: (word, freq), summed for each word in lower case, a null word left out and a null freq adding 0. mark is
    rare for a term of one record, else common for one in at least `share` of all records, else kept.
    """
    freq = dictionary.select(F.lower("word").alias("__word"), "freq").filter("__word is not null").groupBy("__word").agg(F.sum(F.col("freq").cast("long")).alias("__freq"))
    out = counts.join(freq, counts["term"] == freq["__word"], "left")
    part = Fraction(str(share))  # exact: a tenth of 70 is 7
    common = F.col("n_records") * part.denominator >= F.lit(n_records * part.numerator)
    mark = F.when(F.col("n_records") == 1, "rare").when(common, "common").otherwise("kept")
    return out.select(F.col("term").alias("word"), "occurrences", "n_records", F.coalesce("__freq", F.lit(0)).cast("long").alias("dict_freq"), mark.alias("mark"))
