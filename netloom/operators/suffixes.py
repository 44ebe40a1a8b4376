"""Registrable domains by the published list of public suffixes, given as a file; the list is a table, so its length doesn't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import urls as U
from netloom.operators.lists import parents
from netloom.operators.skew import salted_join

PRIVATE_MARK = "===BEGIN PRIVATE DOMAINS==="


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, kind, private) of the rules in the list's own format: comments after //, ``*.`` for any label, ``!`` for an exception."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.locate(PRIVATE_MARK, "value").alias("mark"), F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"), "value")
    # where the line begins: the characters of the lines before it
    before = lines.select(F.trim(F.substring_index("line", " ", 1)).alias("rule"), "mark", F.length(F.call_function("substring_index", F.col("value"), F.lit("\n"), F.col("i"))).alias("at")).where("rule <> '' and not rule like '//%'")
    kind = F.when(F.col("rule").startswith("!"), "except").when(F.col("rule").startswith("*."), "wild").otherwise("plain")
    return before.select(F.lower(F.regexp_replace("rule", r"^(?:!|\*\.)", "")).alias("suffix"), kind.alias("kind"), ((F.col("mark") > 0) & (F.col("at") >= F.col("mark"))).alias("private")).distinct()


def registrable(hosts: DataFrame, rules: DataFrame, private: bool = False, host: str = "host") -> DataFrame:
    """(host, suffix, domain) of each distinct host; an address, a single label and a suffix itself are their own domain.

    An exception wins over all rules, then the rule with the most labels; a
    host that no rule covers has its last label as suffix.
    """
    h = hosts.where(F.col(host).isNotNull() & (F.col(host) != "")).select(F.lower(host).alias("host")).distinct()
    use = rules if private else rules.where("not private")
    up = h.where(~U.is_ip(F.col("host"))).select("host", F.explode(parents(F.col("host"))).alias("key"))
    n = lambda c: F.size(F.split(c, r"\."))
    above = up.select("host", F.regexp_replace("key", r"^[^.]*\.", "").alias("key"), (n("key")).alias("size"), F.col("key").contains(".").alias("more")).where("more")
    one = lambda kind: use.where(F.col("kind") == kind).select(F.col("suffix").alias("key")).distinct()
    found = salted_join(up, one("plain"), ["key"]).select("host", F.lit(0).alias("first"), n("key").alias("size"))
    found = found.unionByName(salted_join(above, one("wild"), ["key"]).select("host", F.lit(0).alias("first"), "size"))
    found = found.unionByName(salted_join(up, one("except"), ["key"]).select("host", F.lit(1).alias("first"), (n("key") - 1).alias("size")))
    best = found.groupBy("host").agg(F.max(F.struct("first", "size"))["size"].alias("size"))
    tail = lambda k: F.array_join(F.slice(F.split("host", r"\."), -k, k), ".")
    d = h.join(best, "host", "left").withColumn("size", F.when(~U.is_ip(F.col("host")), F.coalesce("size", F.lit(1))))
    own: Column = F.when(F.col("size").isNull() | (n("host") <= F.col("size")), F.col("host")).otherwise(tail(F.col("size") + 1))
    return d.select("host", F.when(F.col("size").isNotNull(), tail(F.least(F.col("size"), n("host")))).otherwise("").alias("suffix"), own.alias("domain"))
