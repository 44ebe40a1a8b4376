"""Readers that bring heterogeneous sources to the unified schema.

A source is described by a :class:`Source`; :func:`load` dispatches on its
kind.  Nothing is inferred from data but the column names of vendor tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import urls as U
from netloom.schema import UNIFIED, empty, label_of


@dataclass(frozen=True)
class Source:
    name: str
    kind: str
    path: str = ""
    columns: dict[str, str] = field(default_factory=dict)
    constant_label: int | None = None
    phishing_values: tuple[str, ...] | None = None
    inverted: bool = False
    origin: str = ""
    html_max_chars: int | None = None
    options: dict[str, str] = field(default_factory=dict)


def read_table(spark: SparkSession, path: str, options: dict[str, str] | None = None) -> DataFrame:
    """A table by its suffix: parquet, orc, json (one document), jsonl, csv, tsv or txt, text columns as they are; globs work."""
    o = options or {}
    base = path.lower().removesuffix(".gz").rsplit(".", 1)[-1].rstrip("/*")
    if base in ("parquet", "orc"):
        return spark.read.options(**o).format(base).load(path)
    if base == "json":
        return spark.read.options(multiLine="true", **o).json(path)
    if base in ("jsonl", "ndjson"):
        return spark.read.options(**o).json(path)
    if base in ("csv", "tsv"):
        return spark.read.options(**({"header": "true", "inferSchema": "false", "sep": "\t" if base == "tsv" else ","} | o)).csv(path)
    if base == "txt":
        return spark.read.text(path).withColumnRenamed("value", "url")
    raise ValueError(f"no reader for {path}")


def _mapped(df: DataFrame, columns: dict[str, str], name: str, kind: str) -> Column:
    src = columns.get(name)
    return F.col(src).cast(kind) if src and src in df.columns else F.lit(None).cast(kind)


def to_schema(df: DataFrame, url: Column, label: Column, source: Column, date: Column | None = None, html: Column | None = None, origin: Column | None = None) -> DataFrame:
    """Rows of the unified schema; domain, domain_u2 and depth come from the url."""
    u = F.trim(url)
    text = html if html is not None else F.lit(None).cast("string")
    return df.select(
        u.alias("url"), U.registered_domain(u).alias("domain"), label.cast("tinyint").alias("label"),
        (date if date is not None else F.lit(None).cast("timestamp")).alias("date"), source.alias("source"), F.nullif(text, F.lit("")).alias("html"),
        U.url_depth(u).cast("smallint").alias("depth"), (origin if origin is not None else F.lit("")).alias("origin"), U.registered_domain_private(u).alias("domain_u2"),
    )


def from_table(raw: DataFrame, src: Source) -> DataFrame:
    """A vendor table through the source's column map; rows without url or label go."""
    c = src.columns
    url = _mapped(raw, c, "url", "string")
    label = F.lit(src.constant_label) if src.constant_label is not None else _mapped(raw, c, "label", "string")
    d = raw.where(url.isNotNull() & label.isNotNull())
    if src.constant_label is None:
        label = label_of(label, src.phishing_values) if src.phishing_values else label_of(label)
        label = 1 - label if src.inverted else label
    html = _mapped(raw, c, "html", "string")
    html = F.substring(html, 1, src.html_max_chars) if src.html_max_chars else html
    return to_schema(d, url, label, F.lit(src.name), F.try_to_timestamp(_mapped(raw, c, "date", "string")), html, F.coalesce(_mapped(raw, c, "origin", "string"), F.lit(src.origin)))


def lossy_text(content: Column) -> Column:
    """Bytes as UTF-8 with replacement of what isn't."""
    return F.expr("make_valid_utf8(CAST(content AS STRING))") if content is None else F.call_function("make_valid_utf8", content.cast("string"))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(folder, name, text, path, dir) of every file below a path; ``dir`` is the whole folder, ``folder`` its last name."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return b.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), lossy_text(F.col("content")).alias("text"), "path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"))


def site_info(text: Column) -> Column:
    """struct(url, isotime) of a Python literal of a dict, or of the first line."""
    quoted = lambda key: F.regexp_extract(text, rf"""['"]{key}['"]\s*:\s*u?['"]([^'"]*)['"]""", 1)
    first = F.trim(F.substring_index(text, "\n", 1))
    literal = F.trim(text).startswith("{")
    return F.struct(F.when(literal, quoted("url")).otherwise(first).alias("url"), F.when(literal, F.nullif(quoted("isotime"), F.lit(""))).alias("isotime"))


def from_folders(spark: SparkSession, src: Source, info_name: str = "info.txt", html_name: str = "html.txt") -> DataFrame:
    """One row for each folder that has an info file with a url, with the page of the same folder where there is one."""
    files = read_files(spark, src.path)
    info = files.where(F.col("name") == info_name).select("dir", site_info(F.col("text")).alias("i"))
    page = files.where(F.col("name") == html_name).select("dir", F.col("text").alias("page"))
    d = info.where(F.length("i.url") > 0).join(page, "dir", "left")
    return to_schema(d, F.col("i.url"), F.lit(src.constant_label or 0), F.lit(src.name), F.try_to_timestamp("i.isotime"), F.col("page"), F.lit(src.origin))


def from_info_table(spark: SparkSession, src: Source, info_name: str = "info.csv", page_dirs: Sequence[str] = ("",)) -> DataFrame:
    """A csv of folders and urls with the page of each: of the first of ``page_dirs`` that has any, ``index.html`` at its top first, then by path."""
    info = spark.read.options(header="true").csv(f"{src.path}/{info_name}")
    c = src.columns
    info = info.where(F.col(c.get("url", "url")).isNotNull())
    files = read_files(spark, src.path, "*.html")
    found = None
    for rank, sub in enumerate(page_dirs):
        root = f"/{sub.strip('/')}/" if sub.strip("/") else "/"
        # the folder right below the sub-folder, and what is left of the path
        below = F.substring_index(F.col("path"), src.path.rstrip("/").rsplit("/", 1)[-1] + root, -1)
        one = files.where(F.contains("path", F.lit(src.path.rstrip("/").rsplit("/", 1)[-1] + root))).select(F.substring_index(below, "/", 1).alias("folder"), F.lit(rank).alias("rank"), F.regexp_replace(below, "^[^/]*/?", "").alias("rest"), "text")
        found = one if found is None else found.unionByName(one)
    page = found.groupBy("folder").agg(F.min_by("text", F.struct("rank", (F.col("rest") != "index.html").alias("r"), "rest")).alias("page"))
    d = info.join(page, info[c.get("folder", "folder")] == page["folder"], "left")
    return to_schema(d, F.col(c.get("url", "url")), F.lit(src.constant_label or 0), F.lit(src.name), F.try_to_timestamp(_mapped(info, c, "date", "string")), F.col("page"), F.lit(src.origin))


def from_indexed_list(spark: SparkSession, src: Source, list_glob: str = "*.txt") -> DataFrame:
    """Line i (from 0) of a dated list with the page of the folder ``<i>_...`` that belongs to the list.

    A list with a number in its name besides the date (``urls_7_06_05_2023.txt``)
    owns the pages below the folder that ends with this number (``pages_7``), one
    without owns those that lie in no such folder.  Of several pages of a line
    the first by path counts.
    """
    lists = read_files(spark, src.path, list_glob)
    iso = F.nullif(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    written = F.nullif(F.regexp_replace(F.regexp_extract("name", r"(\d{2}_\d{2}_\d{4})\.[a-z]+$", 1), r"^(\d{2})_(\d{2})_(\d{4})$", "$3-$2-$1"), F.lit(""))
    number = F.regexp_extract(F.regexp_replace("name", r"\d{4}-\d{2}-\d{2}|\d{2}_\d{2}_\d{4}(?=\.[a-z]+$)", ""), r"_(\d+)(?:_|\.|$)", 1)
    # numbered before blank lines go; a line may end with a return
    lines = lists.select(F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\r$", "")))).alias("i", "url"), F.coalesce(iso, written).alias("day"), number.alias("n")).where("url <> ''")
    site = r"/(\d+)_[^/]*/(?:.*/)?[^/]+\.html$"
    pages = read_files(spark, src.path, "*.html").where(F.col("path").rlike(site))
    above = F.regexp_extract("path", r"^(.*?)/\d+_[^/]*/(?:.*/)?[^/]+\.html$", 1)
    owner = F.regexp_extract(F.substring_index(above, src.path.rstrip("/").rsplit("/", 1)[-1], -1), r"_(\d+)(?:/|$)", 1)
    page = pages.select(owner.alias("n"), F.regexp_extract("path", site, 1).cast("int").alias("i"), "path", "text").groupBy("n", "i").agg(F.min_by("text", "path").alias("page"))
    d = lines.join(page, ["n", "i"], "left")
    origin = F.when(F.col("n") != "", F.concat(F.lit(f"{src.origin or src.name}_"), F.col("n"))).otherwise(F.lit(src.origin))
    return to_schema(d, F.col("url"), F.lit(src.constant_label or 1), F.lit(src.name), F.try_to_timestamp("day"), F.col("page"), origin)


def from_index(index: DataFrame, src: Source, feeds: tuple[str, ...]) -> DataFrame:
    """Rows of the first-seen index that one of ``feeds`` reported, without conflicts."""
    own = F.filter(F.split("sources", ","), lambda s: s.isin(*feeds))
    d = index.where((F.size(own) > 0) & ~F.col("label_conflict"))
    return to_schema(d, F.col("url"), F.col("label"), F.lit(src.name), F.col("first_seen"), None, own[0])


def from_crawl(crawl: DataFrame, src: Source, seeds: tuple[str, ...] | None = None) -> DataFrame:
    """Good pages of the seed sets, the earliest of each address; they are benign."""
    d = crawl if seeds is None else crawl.where(F.col("seed_source").isin(*seeds))
    d = d.groupBy(U.normalize_url(F.col("url")).alias("k")).agg(F.min_by(F.struct("url", "html", "crawled_at", "seed_source"), F.struct("crawled_at", "url")).alias("r")).select("r.*")
    return to_schema(d, F.col("url"), F.lit(0), F.lit(src.name), F.col("crawled_at"), F.col("html"), F.col("seed_source"))


LOADERS: dict[str, Callable[[SparkSession, Source], DataFrame]] = {
    "table": lambda spark, s: from_table(read_table(spark, s.path, s.options), s),
    "hub": lambda spark, s: from_table(spark.read.parquet(s.path), s),
    "folders": from_folders,
    "info_table": from_info_table,
    "indexed_list": from_indexed_list,
    "empty": lambda spark, s: empty(spark, UNIFIED),
}


def load(spark: SparkSession, src: Source) -> DataFrame:
    return LOADERS[src.kind](spark, src)


def union(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """All rows of all sources; duplicates stay."""
    out = empty(spark, UNIFIED)
    for s in sources:
        out = out.unionByName(load(spark, s))
    return out


def interim(df: DataFrame) -> DataFrame:
    """Unified rows with row_id (by url, source and content, so it is the same on every run), has_html and simhash."""
    from netloom.operators.dedup import with_simhash
    from netloom.operators.positions import positions

    from netloom.plans.materialise import materialise

    # written first, so that a row keeps its place; keys alone are sorted and joined back, with the pages left where they are
    d = materialise(with_simhash(df.where(F.length("domain") > 0)).withColumn("_k", F.monotonically_increasing_id()), "interim-rows")
    keys = d.select("_k", F.lit("all").alias("_g"), "source", F.xxhash64("url").alias("_u"), "url", "date", F.xxhash64("html").alias("_h"))
    numbered = positions(keys, "_g", [F.col(c) for c in ("source", "_u", "url", "date", "_h")], "row_id").select("_k", (F.col("row_id") + 1).alias("row_id"))
    return d.join(numbered, "_k").drop("_k").withColumn("has_html", F.col("html").isNotNull())


def preview(df: DataFrame, n: int = 3) -> DataFrame:
    """A few rows with texts cut to 80 characters (a report, so the limit is the feature)."""
    return df.limit(n).select(*[F.substring(c, 1, 80).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def shard_origins(df: DataFrame, origins: list[tuple[str, str]]) -> DataFrame:
    """``df`` read from files with the ``origin`` of the first listed pattern in its file's path."""
    out = F.lit("")
    for pattern, origin in reversed(origins):
        out = F.when(F.contains(F.input_file_name(), F.lit(pattern)), F.lit(origin)).otherwise(out)
    return df.withColumn("origin", out)
