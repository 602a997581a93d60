"""Arriving files, indexed batch by batch."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textdex.operators import index as I
from textdex.sources.files import latest_files


class LiveIndex:
    """File postings that follow a stream of (file_id, path, size, mtime, info, deleted, text).

    Each micro-batch appends the postings of its files, and the ids of all its files, which hide what earlier batches had of
    them; nothing old is rewritten but once in MOST_BATCHES, when what is hidden is dropped on disk. A batch writes under its
    own number and reads lower ones only, so a batch that runs again after a failure gives the same table.
    """

    #: Batches after which the table is written anew.
    MOST_BATCHES = 16
    POSTINGS, TOUCHED = "word string, file_id long, tf long, batch long", "file_id long, batch long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self, prefix: str) -> list[int]:
        fs, at = self._at("")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def versions(self) -> list[int]:
        """Batches that are in force."""
        return self._numbers("done-")

    def _mark(self, name: str) -> None:
        fs, at = self._at(name)
        fs.create(at, True).close()

    def _batches(self, name: str, schema: str, numbers: list[int]) -> DataFrame:
        rows = [self.spark.read.schema(schema.rsplit(",", 1)[0]).parquet(f"{self.path}/{name}-{n}").withColumn("batch", F.lit(n).cast("long")) for n in numbers]
        return functools.reduce(DataFrame.unionByName, rows)

    def postings(self, below: int | None = None) -> DataFrame | None:
        """(word, file_id, tf) as of the last batch, or the last one below a number; None before the first."""
        known = [v for v in self.versions() if below is None or v < below]
        if not known:
            return None
        base = max([b for b in self._numbers("base-") if b <= known[-1]], default=None)
        later = [v for v in known if base is None or v > base]
        parts = ["base"] if base is not None else []
        rows = self._batches("postings", self.POSTINGS, later) if later else None
        if parts:
            old = self.spark.read.parquet(f"{self.path}/base-{base}").withColumn("batch", F.lit(-1).cast("long"))
            rows = old if rows is None else old.unionByName(rows)
        if not later or (len(later) == 1 and not parts):
            return rows.drop("batch")
        last = self._batches("touched", self.TOUCHED, later).groupBy("file_id").agg(F.max("batch").alias("__last"))
        return rows.join(last, "file_id", "left").filter(F.col("batch") >= F.coalesce("__last", F.lit(-1))).select("word", "file_id", "tf")

    def apply(self, batch: DataFrame, number: int) -> None:
        now = latest_files(batch)
        I.postings_file(now.filter("not deleted")).write.mode("overwrite").parquet(f"{self.path}/postings-{number}")
        now.select("file_id").write.mode("overwrite").parquet(f"{self.path}/touched-{number}")
        self._mark(f"done-{number}")
        bases = self._numbers("base-")
        if len([v for v in self.versions() if not bases or v > bases[-1]]) > self.MOST_BATCHES:
            self.compact(number)

    def compact(self, number: int) -> None:
        """Write the table as of the batches below `number` anew, and remove what an older base and its batches held: the
        batch `number` itself may still run again."""
        below = [v for v in self.versions() if v < number]
        if not below:
            return
        new = below[-1]
        temporary = f"{self.path}/making-{new}"
        self.postings(number).write.mode("overwrite").parquet(temporary)
        fs, at = self._at(f"base-{new}")
        fs.rename(self._at(f"making-{new}")[1], at)
        for old in self._numbers("base-")[:-2]:  # readers may have the last one open
            for name in [f"base-{old}", *[f"{part}-{v}" for part in ("postings", "touched", "done") for v in self.versions() if v <= old]]:
                fs.delete(self._at(name)[1], True)

    def follow(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
