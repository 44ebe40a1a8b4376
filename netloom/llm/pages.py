"""Problems 2 and 6: the page that a url names, its copies, and copies across splits.

A page is its host, path and query fields.  Protocol, a leading ``www.``, the
default port, letter case, blanks, the order of the fields, repeated or final
slashes, fragments, quotes and brackets around the url, and stops at its end
carry no meaning.

Defined results: rows without a url name no page and have no copies; a url of
which nothing is left (blanks, lone punctuation) counts as none; repeated rows
with one row_id count once; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.text import plain_name
from netloom.llm.visual import canonical
from netloom.operators.dedup import bands, blocks_of, hamming
from netloom.operators.skew import hot_keys, salted_join
from netloom.plans.materialise import materialise

# Query fields that name a campaign or a session, not a page.
TRACKING = (
    r"utm_[a-z_]+|gclid|gclsrc|dclid|fbclid|msclkid|yclid|igshid|mc_cid|mc_eid|_ga|_gl|"
    r"sid|sessid|session|sessionid|session_id|phpsessid|jsessionid|aspsessionid[a-z]*|cfid|cftoken"
)


def page_key(url: Column, tracking: bool = True) -> Column:
    """``host/path?fields`` in one form, or null; without campaign and session fields if ``tracking`` is false."""
    u = F.lower(F.regexp_replace(url, r"[\s\p{Z}\p{Cc}]+", ""))
    u = F.regexp_replace(u, "&amp;", "&")
    u = F.regexp_replace(u, r"""^[<>("'\[{]+""", "")
    u = F.regexp_replace(u, r"#.*$", "")
    u = F.regexp_replace(u, r"""[<>)"'\]},;.!&]+$""", "")
    scheme = F.regexp_extract(u, r"^([a-z][a-z0-9+.-]*)://", 1)
    rest = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^([^/?]*)", 1)
    tail = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.regexp_extract(tail, r"^([^?]*)", 1)
    query = F.regexp_extract(tail, r"^[^?]*\?(.*)$", 1)
    host = F.when(scheme.isin("http", ""), F.regexp_replace(host, r":80$", "")).otherwise(host)
    host = F.when(scheme.isin("https", ""), F.regexp_replace(host, r":443$", "")).otherwise(host)
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/{2,}", "/"), r"[/,;]+$", "")
    if not tracking:
        path = F.regexp_replace(path, rf";({TRACKING})=[^/;]*", "")
    fields = F.filter(F.split(query, "&"), lambda f: (f != "") & (F.lit(True) if tracking else ~f.rlike(rf"^({TRACKING})(=|$)")))
    key = F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(fields), "&"))).otherwise(""))
    return F.when(key != "", key)


def _spellings(rows: DataFrame) -> DataFrame:
    """Byte-identical raw rows as one, with count and smallest row_id; then the canonical page of each survivor."""
    raw = rows.select("row_id", "source", "url").where("url is not null and row_id is not null")
    one = raw.groupBy("source", "url").agg(F.min("row_id").alias("first_id"), F.count("*").alias("n"))
    return one.select("*", F.coalesce(plain_name(F.col("source")), F.lit("")).alias("src"), page_key(F.col("url")).alias("page")).where("page is not null")


def collapse(rows: DataFrame) -> DataFrame:
    """One row per source and page: ``source, page, row_id`` (the smallest) and ``copies``."""
    return _spellings(rows).groupBy("src", "page").agg(F.min("first_id").alias("row_id"), F.sum("n").alias("copies")).withColumnRenamed("src", "source")


def same_pages(rows: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): each further row of a source's page with the smallest row_id of it.

    Only groups with more than one row go into the join back to the rows; a
    spelling that holds a large share of the rows is spread over salts.
    """
    spelled = materialise(_spellings(rows), "p6-spellings")
    groups = spelled.groupBy("src", "page").agg(F.min("first_id").alias("row_id_a"), F.sum("n").alias("copies")).where("copies > 1")
    hot = hot_keys(spelled, ["src", "page"])
    members = salted_join(spelled, groups, ["src", "page"], hot=hot).select(F.coalesce("source", F.lit("\x00")).alias("source"), "url", "n", "row_id_a", "first_id")
    members = materialise(members, "p6-members")
    alone = members.where("n = 1").select("row_id_a", F.col("first_id").alias("row_id_b"))
    many = members.where("n > 1").select("source", "url", "row_id_a")
    again = rows.select(F.col("row_id").alias("row_id_b"), F.coalesce("source", F.lit("\x00")).alias("source"), "url").where("url is not null and row_id_b is not null")
    joined = salted_join(again, many, ["source", "url"]).select("row_id_a", "row_id_b").distinct()
    return alone.unionByName(joined).where("row_id_a <> row_id_b")


def _pair(col: Column) -> list[Column]:
    """128 bits of hash in two columns, null for null (the hash function itself gives nulls a value)."""
    return [F.when(col.isNotNull(), F.xxhash64(*x)).alias(name) for name, x in (("k1", [col]), ("k2", [F.lit(1), col]))]


def sides(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """row_id with ``train`` and ``eval``, and the split it is reported under; one row per row_id."""
    s = splits.where("row_id is not null").select(
        "row_id",
        F.coalesce(F.col("split_0") == "train", F.lit(False)).alias("train"),
        (F.coalesce(F.col("split_0") == "test", F.lit(False)) | F.coalesce(F.col("part") != "pool", F.lit(False))).alias("eval"),
        F.when(F.col("part") != "pool", F.col("part")).otherwise(F.col("split_0")).alias("split"),
    )
    s = s.where("train or eval").groupBy("row_id").agg(F.max("train").alias("train"), F.max("eval").alias("eval"), F.max("split").alias("split"))
    r = rows.where("row_id is not null").select("row_id", "url", "source", "html_simhash")
    return r.join(s, "row_id").select(
        "row_id", "train", "eval", "split", plain_name(F.col("source")).alias("source"), "html_simhash", page_key(canonical(F.col("url")), tracking=False).alias("page")
    )


def near_values(values: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (va, vb) of distinct simhashes, va of the train and vb of the eval side, at most ``most`` bits apart; exact."""
    m = blocks_of(values.count(), most)
    banded = values.select("v", "train", "eval", F.explode(bands(F.col("v"), m, most)).alias("b")).select("v", "train", "eval", "b.t", "b.band")
    a = banded.where("train").select("t", "band", F.col("v").alias("va"))
    b = banded.where("eval").select("t", "band", F.col("v").alias("vb"))
    return salted_join(a, b, ["t", "band"]).where(hamming(F.col("va"), F.col("vb")) <= most).select("va", "vb").distinct()


def overlaps(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """(train_id, eval_id): rows of both sides with the same page, or with simhashes at most three bits apart."""
    s = materialise(sides(rows, splits).select("row_id", "train", "eval", "html_simhash", "page", *_pair(F.col("page"))).drop("page").withColumn("paged", F.lit(True)), "p2-sides")
    train = s.where("train")
    evals = s.where("eval")
    by_page = salted_join(
        train.where("k1 is not null").select("k1", "k2", F.col("row_id").alias("train_id")),
        evals.select("k1", "k2", F.col("row_id").alias("eval_id")),
        ["k1", "k2"],
    ).select("train_id", "eval_id")
    hashed = s.where("html_simhash is not null").withColumnRenamed("html_simhash", "v")
    values = materialise(hashed.groupBy("v").agg(F.max("train").alias("train"), F.max("eval").alias("eval")), "p2-values")
    near = near_values(values)
    left = salted_join(hashed.where("train").select(F.col("v").alias("va"), F.col("row_id").alias("train_id")), near, ["va"])
    by_hash = salted_join(left.select(F.col("vb").alias("v"), "train_id"), hashed.where("eval").select("v", F.col("row_id").alias("eval_id")), ["v"])
    both = by_page.unionByName(by_hash.select("train_id", "eval_id")).where("train_id <> eval_id")
    return both.distinct()


def overlap_pairs(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """The overlaps as (row_id_a, row_id_b), smaller first."""
    return overlaps(rows, splits).select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b")).distinct()


def overlap_report(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Per split and source of the evaluation rows: rows, rows with an overlap, their share, and pairs.

    Pairs are counted and never formed: rows of one page, hash and side are a
    class.  A class overlaps the training rows of its page and those of every
    near hash, less those that are both.
    """
    s = sides(rows, splits).select("row_id", "train", "eval", "split", "source", F.col("html_simhash").alias("v"), *_pair(F.col("page")))
    # a repeated row counts once
    s = s.groupBy("row_id", "v", "k1", "k2").agg(F.max("train").alias("train"), F.max("eval").alias("eval"), F.max("split").alias("split"), F.max("source").alias("source"))
    s = materialise(s, "p2-classes")
    train = s.where("train").groupBy("k1", "k2", "v").agg(F.count("*").alias("t"))
    train = materialise(train, "p2-train")
    evals = materialise(s.where("eval").groupBy("split", "source", "k1", "k2", "v", "train").agg(F.count("*").alias("n")), "p2-eval")
    values = s.where("v is not null").groupBy("v").agg(F.max("train").alias("train"), F.max("eval").alias("eval"))
    near = materialise(near_values(materialise(values, "p2-values")), "p2-near")
    by_page = train.where("k1 is not null").groupBy("k1", "k2").agg(F.sum("t").alias("on_page"))
    per_value = train.where("v is not null").groupBy(F.col("v").alias("va")).agg(F.sum("t").alias("t"))
    by_hash = near.join(per_value, "va").groupBy(F.col("vb").alias("v")).agg(F.sum("t").alias("near"))
    # the training rows that share the page and are near: from the page and hash of the class to the near hashes of that page
    pages_of = evals.where("k1 is not null and v is not null").select("k1", "k2", "v").distinct()
    close = salted_join(pages_of, near.select(F.col("vb").alias("v"), "va"), ["v"])
    twice = salted_join(close, train.where("k1 is not null").select("k1", "k2", F.col("v").alias("va"), "t"), ["k1", "k2", "va"]).groupBy("k1", "k2", "v").agg(F.sum("t").alias("both"))
    c = salted_join(evals, by_page, ["k1", "k2"], "left")
    c = salted_join(c, by_hash, ["v"], "left")
    c = salted_join(c, twice, ["k1", "k2", "v"], "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0).cast("bigint"))
    # a row of both sides is no pair with itself
    own = (F.col("train") & (F.col("k1").isNotNull() | F.col("v").isNotNull())).cast("bigint")
    c = c.withColumn("pairs", zero("on_page") + zero("near") - zero("both") - own)
    out = c.groupBy("split", "source").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("pairs") > 0, F.col("n")).otherwise(0)).alias("n_leaked"), F.sum(F.col("n") * F.col("pairs")).alias("n_pairs"))
    return out.withColumn("leaked_share", F.col("n_leaked") / F.col("n_rows"))


def visual_pairs(rows: DataFrame) -> DataFrame:
    """Problem 1: (row_id_a, row_id_b) of rows whose url and domain read the same but are stored differently.

    At least one row of such a pair differs from its canonical form, so only
    these few are joined with all rows, on a 128-bit hash of the canonical pair.
    """
    c = rows.where("row_id is not null and url is not null and domain is not null").select(
        "row_id", "url", "domain", canonical(F.col("url")).alias("cu"), canonical(F.col("domain")).alias("cd")
    )
    sep = F.lit("\x01")
    keyed = c.select(
        "row_id",
        *_pair(F.concat("cu", sep, "cd")),
        F.xxhash64(F.concat("url", sep, "domain")).alias("s1"),
        F.xxhash64(F.lit(1), F.concat("url", sep, "domain")).alias("s2"),
        ((F.col("url") != F.col("cu")) | (F.col("domain") != F.col("cd"))).alias("changed"),
    )
    keyed = materialise(keyed, "p1-keyed")
    a = keyed.select("k1", "k2", F.col("row_id").alias("ra"), F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("changed").alias("ca"))
    b = keyed.where("changed").select("k1", "k2", F.col("row_id").alias("rb"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    pairs = salted_join(a, b, ["k1", "k2"]).where("(a1 <> b1 or a2 <> b2) and ra <> rb and (not ca or ra < rb)")
    return pairs.select(F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b")).distinct()


def canonical_rows(rows: DataFrame) -> DataFrame:
    """Problem 1: every row with its url and domain in the one form, and whether they changed."""
    c = rows.select("row_id", "url", "domain", canonical(F.col("url")).alias("url_form"), canonical(F.col("domain")).alias("domain_form"))
    return c.select("row_id", "url_form", "domain_form", (~(F.col("url").eqNullSafe(F.col("url_form")) & F.col("domain").eqNullSafe(F.col("domain_form")))).alias("changed"))
