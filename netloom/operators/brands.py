"""Names that come close to a brand: similarity joins over deletion variants and blocks, and signals of a mismatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import urls as U
from netloom.functions.idna import to_unicode
from netloom.operators.skew import salted_join
from netloom.plans.stages import once

MIN_BRAND, MIN_EDIT = 4, 6
SIGNALS = ("brand_homograph", "brand_edit1", "brand_other_suffix", "brand_official")
PAIRS = (("rn", "m"), ("vv", "w"))


def deletes(word: Column, most: int = 2) -> Column:
    """The word and every text that is left of it without up to ``most`` characters, each once."""

    def shorter(w: Column) -> Column:
        return F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))

    every = level = F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        every = F.array_union(every, level)
    return every


def neighbours(labels: DataFrame, names: DataFrame, most: int = 2, label: str = "label", name: str = "name") -> DataFrame:
    """(label, name, distance) of distinct labels and names at most ``most`` edits apart.

    Two texts so close share a variant with at most ``most`` deletions each, so
    the candidates come from an equi-join.  Labels whose length is more than
    ``most`` off every name's length have no variants made.
    """
    n = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    sizes = n.select(F.explode(F.sequence(F.length("name") - most, F.length("name") + most)).alias("size")).distinct()
    # as many lengths as names have, give or take a few
    lab = labels.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct().withColumn("size", F.length("label"))
    lab = lab.join(F.broadcast(sizes), "size", "left_semi").select("label", F.explode(deletes(F.col("label"), most)).alias("v"))
    near = salted_join(lab, n.select("name", F.explode(deletes(F.col("name"), most)).alias("v")), ["v"]).select("label", "name").distinct()
    return near.withColumn("distance", F.levenshtein("label", "name")).where(F.col("distance") <= most)


def one_edit(labels: DataFrame, names: DataFrame, label: str = "label", name: str = "name") -> DataFrame:
    """(label, name) exactly one insertion, deletion, substitution or swap of neighbours apart with the same first letter: an equi-join on first letter and length."""
    lab = labels.where(F.length(label) > 0).select(F.col(label).alias("label")).distinct()
    lab = lab.select("label", F.substring("label", 1, 1).alias("first"), F.explode(F.sequence(F.length("label") - 1, F.length("label") + 1)).alias("size"))
    n = names.where(F.length(name) > 0).select(F.col(name).alias("name")).distinct().select("name", F.substring("name", 1, 1).alias("first"), F.length("name").alias("size"))
    return salted_join(lab, n, ["first", "size"]).where(U.within_one(F.col("label"), F.col("name"))).select("label", "name")


def skeleton(text: Column) -> Column:
    """Look-alike digits, letters and pairs as the letter they stand for."""
    out = F.translate(F.lower(text), *U.HOMOGLYPHS)
    for pair, letter in PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return out


def mismatch(sites: DataFrame, brands: DataFrame, min_brand: int = MIN_BRAND, min_edit: int = MIN_EDIT) -> DataFrame:
    """(domain, and the four SIGNALS as 0 or 1) of each distinct registrable domain.

    ``sites``: label, domain; ``brands``: brand, domains (its own ones).  A
    brand's own domain is official and nothing else; a brand's name under
    another suffix counts if the brand has domains; otherwise the look-alike
    form, or one edit of it, may be a brand's.
    """
    b = brands.where(F.length("brand") >= min_brand).select("brand", F.coalesce("domains", F.array().cast("array<string>")).alias("domains"))
    own = b.select(F.explode("domains").alias("domain")).distinct().withColumn("official", F.lit(True))
    named = b.select(F.col("brand").alias("plain"), (F.size("domains") > 0).alias("owned"))
    d = sites.where("domain is not null and label is not null").select("label", "domain").distinct()
    d = d.join(own, "domain", "left").withColumn("official", F.coalesce("official", F.lit(False)))
    d = d.join(named.select(F.col("plain").alias("label"), F.lit(True).alias("exact")), "label", "left")
    d = d.withColumn("plain", F.when(F.col("exact"), F.col("label")).otherwise(F.replace("label", F.lit("-"), F.lit(""))))
    d = d.join(named, "plain", "left").withColumn("is_brand", F.col("owned").isNotNull())
    d = once(d, text=F.lower(to_unicode(F.col("label"))))
    d = once(d, skel=skeleton(F.col("text")), alt=skeleton(F.replace("text", F.lit("1"), F.lit("i"))))
    targets = b.select(skeleton(F.col("brand")).alias("target")).distinct()
    seen = lambda c, flag: targets.select(F.col("target").alias(c), F.lit(True).alias(flag))
    d = d.join(seen("skel", "hit"), "skel", "left").join(seen("alt", "hit2"), "alt", "left")
    free = ~F.col("official") & ~F.col("is_brand")
    d = d.withColumn("homograph", free & (F.col("skel") != F.col("text")) & (F.col("hit").isNotNull() | F.col("hit2").isNotNull()))
    # one letter more than a short name often spells another real name
    near = one_edit(d.where(free & ~F.col("homograph") & (F.length("skel") >= min_edit - 1)), targets.where(F.length("target") >= min_edit), "skel", "target")
    near = near.where(~((F.length("label") > F.length("name")) & (F.length("name") <= min_edit))).select(F.col("label").alias("skel"), F.lit(True).alias("near")).distinct()
    d = d.join(near, "skel", "left")
    flag = lambda c: c.cast("double")
    return d.select(
        "domain", flag(F.col("homograph")).alias(SIGNALS[0]), flag(free & ~F.col("homograph") & F.col("near").isNotNull()).alias(SIGNALS[1]),
        flag(F.col("is_brand") & ~F.col("official") & F.coalesce("owned", F.lit(False))).alias(SIGNALS[2]), flag(F.col("official")).alias(SIGNALS[3]),
    )


def evidence(rows: DataFrame, names: list[str], top: int = 5) -> DataFrame:
    """(name, label, n_domains, exact_share, words) of urls that contain a name: distinct domains, the share in which it is a word of its own, and the most frequent words around it.

    ``names`` is a word list; every url is looked through once for all of them.
    """
    hit = lambda u: F.filter(F.array(*[F.lit(x) for x in names]), lambda x: F.contains(u, x))
    d = once(rows.where("label is not null and domain is not null and url is not null"), u=F.lower("url"))
    d = d.select("label", "domain", U.words(F.col("u")).alias("ws"), F.explode(hit(F.col("u"))).alias("name"))
    per = d.groupBy("name", "label", "domain").agg(F.max(F.array_contains("ws", F.col("name"))).alias("exact"))
    counts = per.groupBy("name", "label").agg(F.count("*").alias("n_domains"), F.avg(F.col("exact").cast("double")).alias("exact_share"))
    words = d.select("name", "label", F.explode(F.filter("ws", lambda w: F.contains(w, F.col("name")))).alias("w")).groupBy("name", "label", "w").agg(F.count("*").alias("n"))
    best = words.groupBy("name", "label").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "w"))), 1, top).alias("b"))
    return counts.join(best, ["name", "label"], "left").select("name", "label", "n_domains", "exact_share", F.array_join(F.transform(F.coalesce("b", F.array().cast("array<struct<n:bigint,w:string>>")), lambda x: x["w"]), " ").alias("words"))
