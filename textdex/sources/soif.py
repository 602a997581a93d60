"""Structured records: `@TYPE { URL`, then `name{size}:` TAB value for each attribute, then `}`.

size counts the bytes of the value, so values may hold any text, braces and line ends included; the reader therefore goes
by sizes, not by patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEAD = re.compile(rb"@([A-Za-z0-9_-]+)\s*\{\s*([^\s]*)[^\n]*\n")
_ATTRIBUTE = re.compile(rb"\s*([^\s{}]+)\{(\d+)\}:\t")
TEMPLATES = "file_id long, rec_no int, type string, url string, attrs array<struct<name:string,value:string,vsize:int>>, ok boolean"


def parse(text: str) -> list[dict]:
    """The records of a text, in order. ok is false for one that breaks off or is malformed; what it had is kept."""
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    while m := _HEAD.search(data, at):
        at, attrs, ok = m.end(), [], False
        while a := _ATTRIBUTE.match(data, at):
            size = int(a[2])
            value = data[a.end() : a.end() + size]
            if len(value) < size:
                at = len(data)
                break
            attrs.append({"name": a[1].decode("utf-8", "replace"), "value": value.decode("utf-8", "replace"), "vsize": size})
            at = a.end() + size
        else:
            end = re.compile(rb"\s*\}").match(data, at)
            ok = end is not None
            at = end.end() if end else at
        out.append({"type": m[1].decode(), "url": m[2].decode("utf-8", "replace"), "attrs": attrs, "ok": ok})
    return out


def read(files: DataFrame) -> DataFrame:
    """(file_id, rec_no, type, url, attrs, ok) of all structured records in (file_id, text). Null texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"file_id": i, "rec_no": n} | r for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, r in enumerate(parse(t), 1)]
            attr = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("vsize", pa.int32())]))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file_id", pa.int64()), ("rec_no", pa.int32()), ("type", pa.string()), ("url", pa.string()), ("attrs", attr), ("ok", pa.bool_())]))

    return files.select(F.col("file_id").cast("long"), "text").filter("text is not null").mapInArrow(run, TEMPLATES)


def write_text(type: Column, url: Column, attrs: Column) -> Column:
    """The text of a record; attrs is array<struct<name, value, ...>>. Sizes are counted anew."""
    line = lambda a: F.concat(a["name"], F.lit("{"), F.octet_length(a["value"]).cast("string"), F.lit("}:\t"), a["value"], F.lit("\n"))
    return F.concat(F.lit("@"), type, F.lit(" { "), url, F.lit("\n"), F.array_join(F.transform(attrs, line), ""), F.lit("}\n"))


def from_fields(lines: DataFrame, sep: str = ":", strip_digit: bool = False) -> DataFrame:
    """(file_id, name, value, n) from lines `Attr<sep> value`; a line without an attribute continues the one before.

    lines: (file_id, rec_no, rec). Lines before the first attribute are left out; the parts of a value are joined by line
    ends. With strip_digit a digit at the end of a name is taken off. n is the attribute's place in the file.
    """
    head = rf"(?d)^([A-Za-z][A-Za-z0-9_-]*)[ \t]*{sep}[ \t]*(.*)$"
    rows = lines.withColumn("name", F.nullif(F.regexp_extract("rec", head, 1), F.lit(""))).withColumn("part", F.when(F.col("name").isNotNull(), F.regexp_extract("rec", head, 2)).otherwise(F.trim("rec")))
    order = Window.partitionBy("file_id").orderBy("rec_no")
    rows = rows.withColumn("n", F.count("name").over(order)).filter("n > 0")
    out = rows.groupBy("file_id", "n").agg(F.max("name").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_no", "part"))), lambda s: s["part"]), "\n").alias("value"))
    if strip_digit:
        out = out.withColumn("name", F.regexp_replace("name", r"[0-9]$", ""))
        out = out.withColumn("name", F.when(F.col("name") == "Desc", "Description").otherwise(F.col("name")))
    return out.select("file_id", "name", "value", F.col("n").cast("int").alias("n"))


def lsm_url(fields: DataFrame) -> DataFrame:
    """(file_id, url): where the software a record describes lies, ftp://site/path/file of its fields Site, Path and File;
    null where Site or File is missing. fields: (file_id, name, value, n); the first of several fields counts."""
    pick = lambda name: F.min_by(F.when(F.col("name") == name, F.trim("value")), F.when(F.col("name") == name, F.col("n")))
    rows = fields.groupBy("file_id").agg(pick("Site").alias("site"), pick("Path").alias("path"), pick("File").alias("file"))
    folder = F.regexp_replace(F.coalesce("path", F.lit("")), "^/+|/+$", "")
    return rows.select("file_id", F.when(F.col("site").isNotNull() & F.col("file").isNotNull(), F.concat(F.lit("ftp://"), "site", F.when(folder == "", "/").otherwise(F.concat(F.lit("/"), folder, F.lit("/"))), "file")).alias("url"))


def seed_records(lines: DataFrame) -> DataFrame:
    """(domain, organisation, host) of seed files: lines %D domain, %O organisation, %H hosts. Each host of a record is a
    row; a record without hosts is one row. lines: (file_id, rec_no, rec); a line %D begins a record."""
    rows = lines.filter(F.col("rec").rlike("^%[DOH][ \t]")).select("file_id", "rec_no", F.substring("rec", 2, 1).alias("kind"), F.trim(F.expr("substring(rec, 3)")).alias("value"))
    order = Window.partitionBy("file_id").orderBy("rec_no")
    rows = rows.withColumn("n", F.sum((F.col("kind") == "D").cast("int")).over(order)).filter("n > 0")
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value")))
    hosts = F.array_sort(F.flatten(F.collect_list(F.when(F.col("kind") == "H", F.split("value", "[ \t]+")))))
    out = rows.groupBy("file_id", "n").agg(pick("D").alias("domain"), pick("O").alias("organisation"), hosts.alias("hosts"))
    return out.select("domain", "organisation", F.explode_outer("hosts").alias("host"))


def domain_text(domains: DataFrame) -> DataFrame:
    """(domain2, text): one structured record for each second-level domain of `by_domain`."""
    joined = lambda c: F.array_join(c, "\n")
    pair = lambda name, c: F.struct(F.lit(name).alias("name"), joined(c).alias("value"))
    attrs = F.array(pair("Domain", F.col("domains")), pair("Organization", F.col("organisations")), pair("Hosts", F.col("hosts")))
    return domains.select("domain2", sorted_text(F.lit("DOMAIN"), F.concat(F.lit("nop:"), F.col("domain2")), attrs).alias("text"))


def sorted_text(type: Column, url: Column, attrs: Column) -> Column:
    """`write_text` with the attributes in order of their names and without empty ones."""
    pairs = F.transform(F.filter(attrs, lambda a: F.coalesce(a["value"] != "", F.lit(False))), lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value")))
    return write_text(type, url, F.array_sort(pairs))


def pc_index(lines: DataFrame) -> DataFrame:
    """(file_id, rec_no, path, date, size, description) of lines (("." "p1" ... "name") "date" size "desc")."""
    q = r'^\(\(((?:"[^"]*"\s*)+)\)\s*"([^"]*)"\s*(\d+)\s*"([^"]*)"\)\s*$'
    parts = F.regexp_extract_all(F.regexp_extract("rec", q, 1), F.lit('"([^"]*)"'), F.lit(1))
    return lines.filter(F.col("rec").rlike(q)).select("file_id", "rec_no", F.array_join(parts, "/").alias("path"), F.regexp_extract("rec", q, 2).alias("date"), F.regexp_extract("rec", q, 3).cast("long").alias("size"), F.regexp_extract("rec", q, 4).alias("description"))


def by_domain(records: DataFrame) -> DataFrame:
    """(domain2, domains, organisations, hosts) of seed records (domain, organisation, host), by the last two labels of the
    domain. Values are distinct and in order; null values are left out."""
    labels = F.split(F.lower("domain"), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    pick = lambda c: F.array_sort(F.collect_set(c))
    return records.filter("domain is not null").groupBy(two.alias("domain2")).agg(pick("domain").alias("domains"), pick("organisation").alias("organisations"), pick("host").alias("hosts"))


def regions(values: DataFrame) -> DataFrame:
    """(file_id, begin, len, attr_id) of attribute values (file_id, attr_id, off, value)."""
    return values.select("file_id", F.col("off").alias("begin"), F.length("value").cast("long").alias("len"), "attr_id")
