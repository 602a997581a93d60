"""Files as rows: reading, admission, classification, information about them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textdex.plans.compile import balanced
from textdex.plans.pattern import glob_to_pattern

# Suffixes of files that are never text.
SKIPPED_SUFFIXES = ("gz", "Z", "z", "zip", "o", "hqx", "tar", "zoo", "arj", "lha", "gif", "jpg", "jpeg", "tiff", "tif", "ps", "eps", "dvi", "au", "mpeg", "exe")
HTML_SUFFIXES = ("htm", "html", "shtm", "shtml", "jhtml", "phtml", "HTM", "HTML", "abra")


def read_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(file_id, path, size, mtime, text) of all files under `root`, bytes that are no UTF-8 as U+FFFD; an id is a hash of the path, so it stays
    when other files come and go (index.renumbered gives ids without holes)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return files.withColumn("file_id", F.xxhash64("path"))


def latest_files(files: DataFrame) -> DataFrame:
    """One row for each file_id: the one of latest mtime (null is earliest), ties by the greatest row. A row with an empty
    path is a deleted file, whatever its flag."""
    rest = [c for c in files.columns if c not in ("file_id", "mtime")]
    out = files.filter("file_id is not null").groupBy("file_id").agg(F.max(F.struct("mtime", *rest)).alias("r")).select("file_id", "r.*")
    return out.withColumn("deleted", F.coalesce("deleted", F.lit(False)) | F.coalesce(F.col("path") == "", F.lit(True)))


def path_matches(path: Column, globs: Sequence[str]) -> Column:
    """Whether `path` matches one of the globs (see pattern.glob_to_pattern); none matches nothing."""
    tests = []
    for g in globs:
        p, plain = glob_to_pattern(g)
        tests.append(path.contains(p) if plain else path.rlike(p))
    return balanced(tests)


def suffix(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def skipped_suffix(path: Column) -> Column:
    return path.contains(".") & suffix(path).isin(*SKIPPED_SUFFIXES)


def admission(path: Column, exclude: Sequence[str] = (), include: Sequence[str] = (), include_first: bool = False, toplevel: Column | None = None) -> Column:
    """Why a file is taken or not: include, exclude, suffix, default; files named directly ("toplevel") skip the exclude
    list. Exclude goes before include unless include_first."""
    inc, exc = path_matches(path, include), path_matches(path, exclude)
    out = F.when(toplevel, "toplevel") if toplevel is not None else None
    order = [(inc, "include"), (exc, "exclude")] if include_first else [(exc, "exclude"), (inc, "include")]
    for cond, name in [*order, (skipped_suffix(path), "suffix")]:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("default")


def admitted(reason: Column) -> Column:
    return reason.isin("include", "default", "toplevel")


def is_binary(text: Column, sample: int = 2048) -> Column:
    """At least a tenth of the sample is neither visible nor blank."""
    s = F.substring(text, 1, sample)
    bad = F.length(F.regexp_replace(s, r"[^\x00-\x08\x0E-\x1F\x7F]", ""))
    return (F.length(s) > 0) & (bad * 10 >= F.length(s))


def is_uuencoded(text: Column, sample: int = 1024) -> Column:
    """A line `begin ...` with a line of M after it, where no second such line lies 80 or more characters further on."""
    s = F.substring(text, 1, sample)
    rest = F.regexp_extract(s, r"(?s)(?:^|\n)begin [^\n]*\nM(.*)$", 1)
    found = s.rlike(r"(?:^|\n)begin [^\n]*\nM")
    return found & (F.instr(rest, "\nM") < 80)


def is_postscript(text: Column) -> Column:
    return F.substring_index(text, "\n", 1).contains("PS-Adobe")


def is_few_separators(text: Column) -> Column:
    """2048 or more characters with more than 18 of them for each newline, blank or slash."""
    seps = F.length(text) - F.length(F.translate(text, "\n /", ""))
    return (F.length(text) >= 2048) & F.when(seps == 0, True).otherwise(F.floor((F.length(text) - seps) / seps) > 18)


def is_dictionary_like(text: Column, sample: int = 8192) -> Column:
    """The sample has 500 or more words of which 83 % or more differ."""
    words = F.regexp_extract_all(F.lower(F.substring(text, 1, sample)), F.lit(r"([\p{L}_]+)"), F.lit(1))
    n = F.size(words)
    return (n >= 500) & (F.size(F.array_distinct(words)) * 100 >= n * 83)


def kind(text: Column) -> Column:
    """binary, uuencode, postscript, heavy, hqx or text, the first that holds."""
    return (
        F.when(is_binary(text), "binary").when(is_uuencoded(text), "uuencode").when(is_postscript(text), "postscript")
        .when(is_dictionary_like(text), "heavy").when(is_few_separators(text), "hqx").otherwise("text")
    )


def classified(files: DataFrame, exclude: Sequence[str] = (), include: Sequence[str] = (), include_first: bool = False, toplevel: Column | None = None, type_tests: bool = True) -> DataFrame:
    """`files` (path, text, ...) with reason: why a file is taken or not (see admission), and with type_tests the kind of
    those taken by default that are no text. Files of the include list and those named directly are not tested; a null text
    is text."""
    reason = admission(F.col("path"), exclude, include, include_first, toplevel)
    if not type_tests:
        return files.withColumn("reason", reason)
    other = F.coalesce(kind(F.col("text")), F.lit("text"))
    return files.withColumn("reason", reason).withColumn("reason", F.when((F.col("reason") == "default") & (other != "text"), other).otherwise(F.col("reason")))


def file_info(path: Column, text: Column) -> Column:
    """Information about a file: the title of one with the suffix of an HTML file, null for others."""
    return F.when(path.contains(".") & suffix(path).isin(*HTML_SUFFIXES), html_title(text))


def html_title(html: Column) -> Column:
    """The first title, line ends as blanks, : quoted; "No Title" without one."""
    title = F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
    return F.when(title == "", "No Title").otherwise(F.replace(F.replace(title, F.lit("\n"), F.lit(" ")), F.lit(":"), F.lit("\\:")))


# Entities and what they stand for; & last.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&deg;", "°"), ("&auml;", "ä"), ("&ouml;", "ö"),
    ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"), ("&szlig;", "ß"), ("&eacute;", "é"), ("&egrave;", "è"), ("&agrave;", "à"), ("&ccedil;", "ç"), ("&ntilde;", "ñ"), ("&amp;", "&"),
)


def html_to_text(html: Column) -> Column:
    """Comments, scripts, styles and tags gone, common entities replaced, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<[A-Za-z/!][^>]*>", " ")
    for entity, c in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def info_key(info: Column) -> Column:
    """The first word of the information about a file."""
    return F.split_part(info, F.lit(" "), F.lit(1))


Filter = Callable[[Column], Column]


def apply_filters(files: DataFrame, filters: Sequence[tuple[str, Filter]], path: str = "path", text: str = "text") -> DataFrame:
    """`files` with `text` passed through every filter whose glob matches the path, in order. A filter that leaves
    nothing (empty or null) leaves the text as it was. A plain suffix glob (*.x) takes the suffix off the name that later
    filters see. Used alike when indexing and when searching."""
    name, value = F.col(path), F.col(text)
    for glob, f in filters:
        hit = path_matches(name, [glob])
        new = f(value)
        value = F.when(hit & (F.length(new) > 0), new).otherwise(value)
        if glob.startswith("*.") and not any(c in glob[2:] for c in "*?^$."):
            name = F.when(F.coalesce(hit, F.lit(False)) & name.endswith(glob[1:]), F.expr(f"substring({path}, 1, length({path}) - {len(glob) - 1})")).otherwise(name)
    return files.withColumn(text, value)


# A few text filters by name; user code may pass any column function or a pandas_udf.
FILTERS: dict[str, Filter] = {"html": html_to_text, "lower": F.lower, "squeeze": lambda c: F.regexp_replace(c, r"[ \t]+", " ")}
