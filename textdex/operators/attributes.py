"""Attributes of structured records: rows (file_id, name, value) and arrays of (name, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBEDDED = r"^((embed|Embed|EMBED)<[^>]*>[^A-Za-z0-9]*)+"


def appended(values: DataFrame, order: str = "value_id") -> DataFrame:
    """(file_id, name, value): values of a repeated attribute joined by line ends, in `order`. Null values are left out."""
    rows = values.filter("value is not null").groupBy("file_id", "name").agg(F.array_sort(F.collect_list(F.struct(order, "value"))).alias("v"))
    return rows.select("file_id", "name", F.array_join(F.transform("v", lambda s: s["value"]), "\n").alias("value"))


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file_id, name, value) of both; where both have an attribute the right side wins."""
    both = left.select("file_id", "name", "value", F.lit(0).alias("side")).unionByName(right.select("file_id", "name", "value", F.lit(1).alias("side")))
    return both.groupBy("file_id", "name").agg(F.max_by("value", "side").alias("value"))


def as_map(values: DataFrame) -> DataFrame:
    """(file_id, attrs MAP) of (file_id, name, value) with one row for each name."""
    return values.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attrs"))


def put(attrs: Column, name: str, value: Column) -> Column:
    """`attrs` with the attribute set, replaced if there."""
    return F.map_concat(F.map_filter(attrs, lambda k, v: k != name), F.create_map(F.lit(name), value))


def embedded(attrs: Column, n: Column) -> Column:
    """`attrs` as part n of another record: names become Embed<n>-name."""
    return F.transform_keys(attrs, lambda k, v: F.concat(F.lit("Embed<"), n.cast("string"), F.lit(">-"), k))


def plain_name(name: Column) -> Column:
    """The name without Embed<n>- in front, however often."""
    return F.regexp_replace(name, EMBEDDED, "")


def is_embedded(name: Column) -> Column:
    return name.rlike(EMBEDDED)


def sort_key(name: Column) -> Column:
    """Orders names: plain ones first by lower case, embedded ones by number and then name."""
    n = F.regexp_extract(name, r"^[Ee][Mm][Bb][Ee][Dd]<([0-9]+)>", 1)
    return F.struct(F.when(n == "", F.lit(-1)).otherwise(n.cast("int")).alias("n"), F.lower(plain_name(name)).alias("k"), name.alias("name"))


def sorted_attrs(attrs: Column) -> Column:
    """array<struct<name, value>> in the order of sort_key."""
    keyed = F.array_sort(F.transform(attrs, lambda a: F.struct(sort_key(a["name"]).alias("key"), a.alias("a"))))
    return F.transform(keyed, lambda s: s["a"])


def sink_embedded(attrs: Column) -> Column:
    """Embedded attributes at the end, order kept otherwise."""
    return F.concat(F.filter(attrs, lambda a: ~is_embedded(a["name"])), F.filter(attrs, lambda a: is_embedded(a["name"])))


def normal_url(ref: Column, base: Column) -> Column:
    """A reference made absolute against its page; null for mailto: references. Root-relative ones keep scheme and host."""
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    folder = F.regexp_replace(base, r"[^/]*$", "")
    return F.when(F.lower(ref).startswith("mailto:"), None).when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(ref.startswith("/"), F.concat(host, ref)).otherwise(F.concat(folder, ref))


def region_join(offsets: DataFrame, regions: DataFrame, cell: int = 4096) -> DataFrame:
    """`offsets` (file_id, off, ...) with attr_id of the region [begin, begin + len) that holds the offset, 0 without one.

    An equi-join on file and cell of the offset range, then the interval test; a region is entered in each cell it touches.
    Regions of a file do not overlap; null offsets get 0.
    """
    cells = F.sequence(F.floor(F.col("begin") / cell), F.floor((F.col("begin") + F.greatest("len", F.lit(1)) - 1) / cell))
    side = regions.select(F.col("file_id").alias("__f"), F.explode(cells).alias("__cell"), "begin", "len", F.col("attr_id").alias("__attr")).distinct()
    on = (F.col("file_id") == F.col("__f")) & (F.floor(F.col("off") / cell) == F.col("__cell")) & (F.col("off") >= F.col("begin")) & (F.col("off") < F.col("begin") + F.col("len"))
    return offsets.join(side, on, "left").select(*offsets.columns, F.coalesce("__attr", F.lit(0)).alias("attr_id"))
