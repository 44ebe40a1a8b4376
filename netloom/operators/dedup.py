"""Near-duplicates by simhash: exact search in bands, clusters by connected components."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.operators.graph import components
from netloom.operators.skew import salted_join
from netloom.plans.materialise import materialise
from netloom.plans.stages import let, once

#: From how many distinct values on the 64 bits are cut into so many blocks.
BLOCKS = ((0, 4), (4_000_000, 5), (100_000_000, 6))


def visible_tokens(html: Column, most: int | None = None) -> Column:
    """Lower-case words of a page without scripts and styles; entities of markup are unescaped.

    The whole page counts; ``most`` cuts it to so many characters, for hashes
    that must equal ones made with such a cut.
    """
    t = F.regexp_replace(html if most is None else F.substring(html, 1, most), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;|&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.regexp_replace(t, name, ch)
    return F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}\p{M}_]+)"), 1)


def shingles(tokens: Column, size: int = 5) -> Column:
    """Runs of ``size`` words; all words as one if there are fewer."""
    def of(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(size)), " "))
        return F.when(F.size(t) >= size, runs).otherwise(F.array(F.array_join(t, " ")))

    return let(tokens, of)


@F.pandas_udf(T.LongType())
def simhash(lists: pd.Series) -> pd.Series:
    """Signed 64-bit vote of the 8-byte blake2b digests of each list's texts; null for a null list."""

    def one(texts) -> int | None:
        if texts is None or len(texts) == 0:
            return None
        digests = np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=8).digest() for t in texts), dtype=">u8")
        ones = np.unpackbits(digests.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
        return int(np.packbits(2 * ones > len(digests)).view(">i8")[0])

    return lists.map(one).astype("Int64")


def with_simhash(df: DataFrame, html: str = "html", name: str = "html_simhash", min_tokens: int = 50, size: int = 5, most: int | None = None) -> DataFrame:
    """``df`` with the simhash of each page, null below ``min_tokens`` visible words."""
    d = once(df, _tokens=visible_tokens(F.col(html), most))
    d = once(d, _shingles=F.when(F.size("_tokens") >= min_tokens, shingles(F.col("_tokens"), size)))
    return d.withColumn(name, simhash(F.col("_shingles"))).drop("_tokens", "_shingles")


def fast_simhash(tokens: Column, size: int = 5) -> Column:
    """The same vote over xxhash64 of the shingles, all in the JVM; values differ from :func:`simhash`."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def vote(hashes: Column) -> Column:
        ones = lambda i: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.call_function("shiftrightunsigned", h, i).bitwiseAND(one).cast("int"))
        bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(2 * ones(i) > F.size(hashes), F.call_function("shiftleft", one, i)).otherwise(none))
        return F.aggregate(bits, none, lambda a, b: a.bitwiseOR(b))

    return F.when(F.size(tokens) > 0, let(F.transform(shingles(tokens, size), lambda s: F.xxhash64(s)), vote))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def blocks_of(n_values: int, most: int) -> int:
    return max(most + 1, [b for least, b in BLOCKS if n_values >= least][-1])


def bands(value: Column, m: int, most: int) -> Column:
    """Array of (table, band): every choice of blocks that must be equal in values at most ``most`` bits apart."""
    edges = [64 * i // m for i in range(m + 1)]
    part = [F.shiftrightunsigned(value, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    return F.array(*[F.struct(F.lit(i).alias("t"), F.xxhash64(*[part[j] for j in choice]).alias("band")) for i, choice in enumerate(combinations(range(m), m - most))])


def near_pairs(values: DataFrame, most: int = 3, within: str | None = None) -> DataFrame:
    """(va, vb[, within]) of distinct values va < vb at most ``most`` bits apart; ``values``: v[, within], distinct."""
    m = blocks_of(values.count(), most)
    extra = [within] if within else []
    banded = values.select("v", *extra, F.explode(bands(F.col("v"), m, most)).alias("b")).select("v", *extra, "b.t", "b.band")
    a, b = banded.withColumnRenamed("v", "va"), banded.withColumnRenamed("v", "vb")
    pairs = salted_join(a, b, ["t", "band", *extra]).where((F.col("va") < F.col("vb")) & (hamming(F.col("va"), F.col("vb")) <= most))
    return pairs.select("va", "vb", *extra).distinct()


def near_dup_clusters(df: DataFrame, most: int = 3, within: str | None = None) -> DataFrame:
    """(html_simhash[, within], root) of each distinct simhash; a chain of close values is one cluster."""
    extra = [within] if within else []
    values = materialise(df.where("html_simhash is not null").select(F.col("html_simhash").alias("v"), *extra).distinct(), "simhashes")
    node = lambda c: F.xxhash64(F.col(c), *[F.col(x) for x in extra]) if extra else F.col(c)
    edges = near_pairs(values, most, within).select(node("va").alias("a"), node("vb").alias("b"))
    roots = components(edges)
    keyed = values.withColumn("node", node("v"))
    return keyed.join(roots, "node", "left").select(F.col("v").alias("html_simhash"), *extra, F.coalesce("root", "node").alias("root"))
