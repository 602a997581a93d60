"""Per-key work without stragglers: fragment-replicate by estimated load.

A load plan is made from one scan of the key column alone: the counts of a fixed number of hash buckets and a
frequent-items sketch. Keys above their share are cut into shards in proportion to their load; shards and buckets are
packed to tasks, heaviest first into the emptiest task. Only the matching rows of cut keys are replicated, and only to
the tasks that hold one of their shards. Every key above the cut-off is found by the sketch (its error bound lies well
below the cut-off), so the plan's lists have at most CUT * tasks entries whatever the number of keys or rows.

The plan decides where rows go, never which rows exist: an estimate that is off costs balance, not results.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textdex.session import tasks_of, written

#: A key is cut when it holds more than 1/(CUT * tasks) of all rows; a shard holds about 1/(2 * tasks).
CUT = 4
#: Hash buckets of uncut keys per task.
BUCKETS = 8
#: Items the sketch tracks per cut-off share; its error is about 1/TRACK of the cut-off.
TRACK = 16
#: Items a sketch of the engine can track.
MOST_TRACKED = 1_000_000


@dataclass
class LoadPlan:
    """Where rows go. heavy: hash of a key -> the bins of its shards; light: bin of each hash bucket."""

    tasks: int
    total: int
    heavy: dict[int, list[int]] = field(default_factory=dict)
    light: list[int] = field(default_factory=list)

    def heavy_rows(self, spark: SparkSession) -> DataFrame:
        """The cut keys as rows (__h, __bins); at most CUT * tasks of them, so it may be broadcast."""
        return F.broadcast(spark.createDataFrame(sorted(self.heavy.items()), "__h long, __bins array<int>"))


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def pack(loads: list[tuple[float, object]], tasks: int) -> dict[object, int]:
    """Bin of each item: heaviest first into the emptiest bin. Ties go to the lower bin and the earlier item."""
    bins = [(0.0, b) for b in range(tasks)]
    where = {}
    for load, item in sorted(loads, key=lambda x: -x[0]):
        least, b = heapq.heappop(bins)
        where[item] = b
        heapq.heappush(bins, (least + load, b))
    return where


def plan_load(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> LoadPlan:
    """Load plan of `df` for the key columns `keys`; null is a key like any other. An empty `df` gives a plan too."""
    tasks = tasks or tasks_of(df.sparkSession)
    # the sketch tracks at most MOST_TRACKED items: with more tasks than that allows the cut-off is a larger part of a task's
    # share, still at most one share up to MOST_TRACKED / TRACK tasks, and the sketch keeps its error bound
    slots, buckets = min(CUT * tasks, MOST_TRACKED // TRACK), min(BUCKETS * tasks, MOST_TRACKED // 2)
    hashes = df.select(_key_hash(keys).alias("__h"))
    # one scan: a sketch that tracks more items than there are buckets counts them exactly
    top = hashes.agg(
        F.expr(f"approx_top_k(__h, {slots}, {TRACK * slots})").alias("top"), F.expr(f"approx_top_k(pmod(__h, {buckets}), {buckets}, {2 * buckets})").alias("buckets"), F.count(F.lit(1)).alias("n"),
    ).first()
    total = top["n"]
    counts = {r["item"]: r["count"] for r in top["buckets"] or []}
    share = max(1.0, total / (2 * tasks))
    items: list[tuple[float, object]] = []
    shards: dict[int, int] = {}
    for item in top["top"] or []:
        h, n = item["item"], item["count"]
        if tasks > 1 and n > total / slots and n > 1:
            shards[h] = max(1, min(2 * tasks, round(n / share + 0.5)))
            items += [(n / shards[h], (h, s)) for s in range(shards[h])]
            counts[h % buckets] = max(0, counts.get(h % buckets, 0) - n)
    items += [(counts.get(b, 0), b) for b in range(buckets)]
    where = pack(items, tasks)
    return LoadPlan(tasks, total, {h: [where[h, s] for s in range(k)] for h, k in shards.items()}, [where[b] for b in range(buckets)])


def _binned(df: DataFrame, plan: LoadPlan, keys: Sequence[str]) -> DataFrame:
    """`df` with __h, __bins (null unless the key is cut) and __light, the bin of its bucket."""
    # one literal, which the planner makes an array once
    bins = F.split(F.lit(",".join(map(str, plan.light))), ",").cast("array<int>")
    light = F.element_at(bins, (F.pmod("__h", F.lit(len(plan.light))) + 1).cast("int"))
    return df.withColumn("__h", _key_hash(keys)).join(plan.heavy_rows(df.sparkSession), "__h", "left").withColumn("__light", light.cast("int"))


def fragment_replicate_join(big: DataFrame, small: DataFrame, on: Sequence[str], plan: LoadPlan | None = None, how: str = "inner") -> DataFrame:
    """Equi-join of `big` and `small` on the columns `on`, balanced by the load of `big`; how is inner or left.

    Rows of `big` with a cut key are spread over its shards by a hash of the whole row (equal rows stay together:
    combine copies first); rows of `small` are replicated to the bins of those shards only. Null keys match nothing.
    Apart from `on`, the two sides must not share a column name; a clash raises ValueError. An empty side gives what
    the same plain join gives.
    """
    on = list(on)
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how}")
    if clash := (set(big.columns) & set(small.columns)) - set(on):
        raise ValueError(f"both sides have {sorted(clash)}; select or rename before the join")
    plan = plan or plan_load(big, on)
    one = F.element_at("__bins", (F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.size("__bins")) + 1).cast("int"))
    left = _binned(big, plan, on).withColumn("__bin", F.coalesce(one, "__light")).drop("__h", "__bins", "__light")
    right = _binned(small, plan, on).withColumn("__bin", F.explode(F.array_distinct(F.coalesce("__bins", F.array("__light"))))).drop("__h", "__bins", "__light")
    left, right = (x.repartitionById(plan.tasks, "__bin") for x in (left, right))
    return left.join(right, ["__bin", *on], how).drop("__bin")


def range_shards(df: DataFrame, key: str, order: str, plan: LoadPlan) -> DataFrame:
    """`df` with __bin and __shard: a cut key is split at quantiles of `order`, so that shards are ranges of it.

    Rows with equal `order` share a shard; null `order` goes to shard 0. Uncut keys have the one shard 0.
    """
    rows = _binned(df, plan, [key])
    most = max([len(b) for b in plan.heavy.values()], default=1)
    if most == 1:
        return rows.withColumn("__shard", F.lit(0)).withColumn("__bin", F.coalesce(F.element_at("__bins", 1), "__light")).drop("__h", "__bins", "__light")
    steps = min(1024, 4 * most)
    cuts = (
        rows.filter(F.size("__bins") > 1).groupBy("__h", "__bins")
        .agg(F.percentile_approx(order, [i / steps for i in range(1, steps)], 20 * steps).alias("__q"))
        .select("__h", F.expr(f"array_distinct(transform(sequence(1, size(__bins) - 1), i -> element_at(__q, cast(greatest(1, round(i * {steps} / size(__bins))) as int))))").alias("__cuts"))
    )
    cuts = F.broadcast(cuts)  # one row for each cut key, of which the plan has at most CUT * tasks
    shard = F.when(F.col("__cuts").isNull() | F.col(order).isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col(order))))
    return (
        rows.join(cuts, "__h", "left").withColumn("__shard", shard.cast("int"))
        .withColumn("__bin", F.coalesce(F.element_at("__bins", F.col("__shard") + 1), "__light"))
        .drop("__h", "__bins", "__light", "__cuts")
    )


def key_profile(occurrences: DataFrame, words: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows, distinct words and largest gap of every key: (key, n_rows LONG, n_words LONG, max_gap LONG).

    occurrences: (key, item, off), of which equal rows count once and a null key is left out; words: (item, word), a
    null word counts for nothing and an item without a word still counts as a row. max_gap is the largest difference
    of neighbouring distinct values of off, 0 if there is at most one; a null off counts as a row and makes no gap.
    Empty input gives no row. Other columns are ignored.
    """
    spark = occurrences.sparkSession
    tasks = tasks_of(spark) if tasks is None else tasks
    # read three times below, so the distinct rows are written once
    rows = written(occurrences.select("key", "item", "off").filter(F.col("key").isNotNull()).distinct(), "profile")
    shards = range_shards(rows, "key", "off", plan_load(rows, ["key"], tasks)).repartitionById(tasks, "__bin")
    before = F.lag("off").over(Window.partitionBy("__bin", "key", "__shard").orderBy("off"))
    shards = shards.withColumn("__gap", F.col("off") - before).groupBy("__bin", "key", "__shard").agg(
        F.count(F.lit(1)).alias("n"), F.max("__gap").alias("gap"), F.min("off").alias("lo"), F.max("off").alias("hi"))
    # at most one row for each key and shard from here on
    across = F.col("lo") - F.last("hi", True).over(Window.partitionBy("key").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1))
    sizes = shards.withColumn("__across", across).groupBy("key").agg(
        F.sum("n").alias("n_rows"), F.greatest(F.coalesce(F.max("gap"), F.lit(0)), F.coalesce(F.max("__across"), F.lit(0))).cast("long").alias("max_gap"))
    words = words.select("item", "word").filter("word is not null and item is not null").distinct()
    pairs = rows.filter(F.col("item").isNotNull())  # with off, so that a hot item's rows differ and spread over its shards
    kinds = fragment_replicate_join(pairs, words, ["item"], plan_load(pairs, ["item"], tasks))
    # the word of a key may come from several tasks: distinct over both columns, which no single key can unbalance
    kinds = kinds.select("key", "word").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_words"))
    return sizes.join(kinds, "key", "left").select("key", "n_rows", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), "max_gap")
