"""Most frequent values among billions with bounded memory: mergeable Misra-Gries summaries.

A summary holds at most k counters. Each partition folds its rows into one summary; when a fold or a merge leaves more
than k counters, the (k+1)-th largest count is subtracted from all and what is not above 0 is dropped. A counter is then
below the true total by at most total / (k + 1), over any number of partitions and in any order of merging. Summaries are
merged in levels of a fixed fan-in, so no task holds more than FAN_IN * k counters. Values of more than MOST_BYTES bytes are
counted under a digest of that size, so a counter has a bounded size too.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY = "value string, count long, part int"
#: Summaries that one task merges.
FAN_IN = 32
#: Bytes of a value that is counted under its own name.
MOST_BYTES = 64
#: Rows folded into a summary at a time.
CHUNK = 200_000


def shrink(values: pa.Array, counts: pa.Array, k: int) -> tuple[pa.Array, pa.Array]:
    """At most k counters: the (k+1)-th largest count is subtracted from all, what is not above 0 goes."""
    if len(values) <= k:
        return values, counts
    order = pc.array_sort_indices(counts, order="descending")
    counts = pc.subtract(counts, counts[order[k].as_py()])
    left = pc.greater(counts, 0)
    return values.filter(left), counts.filter(left)


def fold(table: pa.Table, k: int) -> tuple[pa.Array, pa.Array]:
    """One summary of the rows (value, count), which may hold a value more than once."""
    t = table.group_by("value", use_threads=False).aggregate([("count", "sum")]).combine_chunks()
    values, counts = t["value"].combine_chunks(), t["count_sum"].combine_chunks()
    return shrink(values, counts, k)


def _summarise(batches: Iterator[pa.RecordBatch], k: int, part) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("value", pa.string()), ("count", pa.int64())])
    pending, rows, held = [], 0, schema.empty_table()

    def close() -> pa.Table:
        values, counts = fold(pa.concat_tables([held, *pending]), k)
        return pa.table([values, counts], schema=schema)

    for b in batches:
        pending.append(pa.table([b.column(0).cast(pa.string()), b.column(1)], schema=schema))
        rows += b.num_rows
        if rows >= CHUNK:
            held, pending, rows = close(), [], 0
    held = close()
    if held.num_rows:
        yield from held.append_column("part", pa.array([part()] * held.num_rows, pa.int32())).to_batches()


def key_of(value: Column) -> Column:
    """What a value is counted under: itself, or where it is long a digest, marked by a character text does not have."""
    return F.when(F.octet_length(value) <= MOST_BYTES, value).otherwise(F.concat(F.lit("\0"), F.sha2(value, 224)))


def summary(df: DataFrame, value: str, weight: str | None, k: int) -> DataFrame:
    """(value, count): one Misra-Gries summary of the whole column with at most k counters, long values as their key. Null values are left out,
    null and not positive weights add nothing; an empty column gives an empty summary."""
    rows = df.select(key_of(F.col(value).cast("string")).alias("value"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("count"))
    rows = rows.filter("value is not null and count > 0")

    return merged(rows.mapInArrow(summariser(k), SUMMARY), rows.rdd.getNumPartitions(), k)


def summariser(k: int, rows=lambda batches: batches):
    """A mapInArrow function: one summary for each partition of (value, count) batches, after `rows` of the batches."""

    def run(batches):
        from pyspark import TaskContext

        return _summarise(rows(batches), k, lambda: TaskContext.get().partitionId())

    return run


def merged(summaries: DataFrame, parts: int, k: int) -> DataFrame:
    """(value, count): the summaries of `parts` partitions (value, count, part) merged into one, level by level."""
    while True:
        groups = max(1, -(-parts // FAN_IN))
        summaries = summaries.withColumn("part", F.pmod("part", F.lit(groups))).repartitionById(groups, "part").mapInArrow(summariser(k), SUMMARY)
        if groups == 1:
            return summaries.select("value", "count")
        parts = groups


def heavy_hitters(df: DataFrame, value: str, weight: str | None = None, support: float = 0.001, slack: float = 8.0) -> DataFrame:
    """(value, total, at_least): every value whose total weight is at least `support` of the sum of all weights.

    df: any columns; `value` and `weight` name two. The sum of all weights counts rows with a null value too. The
    candidates are the counters of a summary with slack / support entries, which holds every such value; their exact
    totals come from one more pass against the candidates, which are few enough to broadcast by construction. at_least is
    the summary's own count, below the total by at most support / slack of the sum. Ties at the limit are all given. An
    empty table, or one of null values only, gives no row.
    """
    k = max(1, round(slack / support))
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    total = df.agg(F.sum(F.when(w > 0, w)).alias("n")).first()["n"] or 0
    part = Fraction(str(support))  # exact at the limit
    least = float(part * total)
    near = summary(df, value, weight, k).filter(F.col("count") >= F.lit(least - total / (k + 1) - 1)).select(F.col("value").alias("__value"), F.col("count").alias("at_least"))
    rows = df.select(F.col(value).cast("string").alias("__v"), w.alias("__w")).filter("__v is not null").withColumn("__k", key_of(F.col("__v")))
    near = near.sparkSession.createDataFrame(near.collect(), "__value string, at_least long")  # at most k rows
    out = rows.join(F.broadcast(near), F.col("__k") == F.col("__value")).groupBy("__v", "at_least").agg(F.sum(F.when(F.col("__w") > 0, F.col("__w"))).alias("total"))
    return out.filter(F.col("total") * part.denominator >= F.lit(total * part.numerator)).select(F.col("__v").alias("value"), "total", "at_least")
