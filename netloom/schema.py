"""Fixed schemas, and the checks of a corpus table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIFIED = "url string, domain string, label tinyint, date timestamp, source string, html string, depth smallint, origin string, domain_u2 string"
INTERIM = UNIFIED + ", row_id bigint, html_simhash bigint, has_html boolean"
PROCESSED = UNIFIED + ", uid string, has_html boolean, weight double, part string"
FEED_BATCH = "url string, source string, threat string, label tinyint, feed_time timestamp, target string"
FEED_INDEX = (
    "url_norm string, url string, label tinyint, threat string, sources string, first_seen timestamp, last_seen timestamp, feed_time timestamp, target string, label_conflict boolean"
)
CRAWL = "url string, html string, status int, seed_source string, crawled_at timestamp"
ATTEMPTS = "url string, seed_source string, status string, detail string, attempted_at timestamp"
METRICS = "split int, model string, metric string, value double"
HOST_RECORD = (
    "kind string, host string, domain string, label tinyint, first_seen timestamp, captured_at timestamp, "
    "dns struct<errors: array<string>, a: array<string>, aaaa: array<string>, cname: array<string>, ns: array<string>, mx_count: int, spf: boolean, dmarc: boolean, min_ttl: int, resolves: boolean>, "
    "tls struct<ok: boolean, verified: boolean, error: string, version: string, issuer_o: string, issuer_cn: string, subject_cn: string, not_before: timestamp, not_after: timestamp, san_count: int, sans: array<string>>"
)
DOMAIN_RECORD = (
    "kind string, domain string, captured_at timestamp, "
    "rdap struct<registered: timestamp, expires: timestamp, last_changed: timestamp, status: array<string>, redacted: boolean>, rdap_error string"
)
REQUIRED = ("url", "domain", "label", "source", "depth")


class SchemaError(ValueError):
    """A table that breaks the unified schema."""


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def label_of(value: Column, phishing: tuple[str, ...] = ("1", "phishing", "phish", "malicious", "bad", "true"), benign: tuple[str, ...] = ("0", "legitimate", "legit", "benign", "good", "false")) -> Column:
    """Encoded label to 0 or 1; other values raise when the row is read."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin(*phishing), F.lit(1)).when(v.isin(*benign), F.lit(0)).when(v.isNull(), F.lit(None)).otherwise(
        F.raise_error(F.concat(F.lit("unknown label "), v)).cast("int")
    ).cast("tinyint")


def violations(df: DataFrame) -> DataFrame:
    """One row (rule, n) for each rule of the schema, from one aggregation."""
    missing = [c for c in ("url", "domain", "label", "date", "source", "html", "depth") if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    rules = {f"{c} null": F.col(c).isNull() for c in REQUIRED}
    rules |= {"url empty": F.col("url") == "", "domain empty": F.col("domain") == "", "label not 0 or 1": ~F.col("label").isin(0, 1), "depth negative": F.col("depth") < 0}
    counts = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return counts.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, n)")


def validate(df: DataFrame) -> DataFrame:
    """``df`` itself, or SchemaError naming the first broken rule."""
    if not isinstance(df.schema["date"].dataType, T.TimestampType):
        raise SchemaError("date is no timestamp")
    for r in violations(df).where("n > 0").orderBy("rule").limit(1).collect():
        raise SchemaError(f"{r['n']} rows: {r['rule']}")
    return df


def drop_unparsable(df: DataFrame) -> DataFrame:
    return df.where(F.length("domain") > 0)
