"""Problems 5 and 7: splits that keep related rows together, and caps for dominant contributors.

Defined results of the cap: a row without a domain belongs to the contributor
"" and is capped like others; a null url or depth gives the lowest score; ties
go to the smaller row_id, and repeated rows with one row_id count each; an
empty table gives none.

Defined results of the split: rows are related if their domains read the same,
or if a tenant links two spellings of a domain; a row with neither domain nor
tenant is its own group; every row gets exactly one split; repeated rows with
one row_id land together.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.text import plain_name
from netloom.llm.visual import canonical
from netloom.operators.graph import components
from netloom.operators.positions import positions
from netloom.operators.skew import salted_join
from netloom.plans.materialise import materialise

MAX_SHARE = 0.01


def plain_domain(domain: Column) -> Column:
    """A domain without its spelling: look-alikes, blanks, letter case, ``www.`` and outer dots."""
    d = F.lower(F.regexp_replace(canonical(domain), r"[\s\p{Z}]+", ""))
    return F.regexp_replace(F.regexp_replace(d, r"^\.+|\.+$", ""), r"^www\.", "")


def score(url: Column, depth: Column) -> Column:
    """Quality of a row from its address: secure, shallow, short and with few query fields is better."""
    fields = F.length(F.regexp_replace(url, "[^&=]", ""))
    s = F.when(F.lower(url).startswith("https"), F.lit(20)).otherwise(F.lit(0)) - 5 * F.least(depth.cast("int"), F.lit(10)) - 3 * fields - F.floor(F.length(url) / 10)
    return F.coalesce(s.cast("bigint"), F.lit(-1_000_000))


def capped(rows: DataFrame, max_share: float | None = MAX_SHARE, max_count: int | None = None) -> DataFrame:
    """(row_id, contributor, score, position) of the rows kept: the best of each contributor up to the cap."""
    base = rows.select("row_id", F.coalesce(plain_domain(F.col("domain")), F.lit("")).alias("contributor"), score(F.col("url"), F.col("depth")).alias("score"))
    # written first: the range sort reads its rows twice
    placed = positions(materialise(base, "p7-scores"), "contributor", [F.col("score").desc(), F.col("row_id")])
    caps = [c for c in (max_count, None if max_share is None else int(max_share * placed.count())) if c is not None]
    return placed.where(F.col("position") < max(1, min(caps))) if caps else placed


def cap_report(rows: DataFrame, max_share: float | None = MAX_SHARE, max_count: int | None = None) -> DataFrame:
    """Per contributor that lost rows: rows before and after."""
    before = rows.groupBy(F.coalesce(plain_domain(F.col("domain")), F.lit("")).alias("contributor")).agg(F.count("*").alias("n_rows"))
    after = capped(rows, max_share, max_count).groupBy("contributor").agg(F.count("*").alias("n_kept"))
    return before.join(after, "contributor").where("n_kept < n_rows")


def fill(sizes: list[tuple[int, int]], targets: list[float]) -> dict[int, list[int]]:
    """Greedy largest-first: of each size (size, count), how many groups go to each split.

    Every group goes to the split furthest below its target.  Groups of one
    size are alike; a long run of them is handed out at once down to a common
    level, the rest one by one.
    """
    gap = list(targets)
    out: dict[int, list[int]] = {}
    for size, count in sorted(sizes, reverse=True):
        quota = [0] * len(gap)
        if count > 1000:
            order = sorted(range(len(gap)), key=lambda i: -gap[i])
            for k in range(len(order), 0, -1):
                level = (sum(gap[i] for i in order[:k]) - (count - 2 * len(gap)) * size) / k
                if gap[order[k - 1]] >= level:
                    break
            for i in order[:k]:
                n = max(0, int((gap[i] - level) / size) - 1)
                quota[i] += n
                gap[i] -= n * size
        heap = [(-g, i) for i, g in enumerate(gap)]
        heapq.heapify(heap)
        for _ in range(count - sum(quota)):
            g, i = heapq.heappop(heap)
            quota[i] += 1
            gap[i] += -size
            heapq.heappush(heap, (-gap[i], i))
        out[size] = quota
    return out


def related(rows: DataFrame) -> DataFrame:
    """``rows`` (row_id, source) with the bigint ``entity`` that related rows share."""
    base = rows.select("row_id", plain_name(F.col("source")).alias("source"), plain_domain(F.col("domain")).alias("d"), plain_domain(F.col("domain_u2")).alias("u"))
    node = lambda c: F.when(F.col(c) != "", F.xxhash64(F.lit("domain"), F.col(c)))
    base = materialise(base.select("row_id", "source", node("d").alias("a"), node("u").alias("b")), "p5-nodes")
    edges = base.where("a is not null or b is not null").select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).distinct()
    roots = components(edges)
    keyed = base.select("row_id", "source", F.coalesce("a", "b", F.xxhash64(F.lit("row"), F.col("row_id"))).alias("node"))
    return salted_join(keyed, roots, ["node"], "left").select("row_id", "source", F.coalesce("root", "node").alias("entity"))


def assign(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(row_id, source, entity, split) of every row; ``targets``: split_name, share, a fixed table."""
    whole = materialise(related(rows), "p5-related")
    sizes = materialise(whole.groupBy("entity").agg(F.count("*").alias("size")), "p5-sizes")
    # different sizes: at most the square root of twice the rows
    counts = [(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()]
    wanted = [(r["split_name"], r["share"]) for r in targets.select("split_name", "share").dropDuplicates(["split_name"]).orderBy(F.desc("share"), "split_name").collect()]
    total, norm = sum(s * n for s, n in counts), sum(w for _, w in wanted) or 1.0
    quotas = fill(counts, [total * w / norm for _, w in wanted])
    spans = []
    for size, quota in quotas.items():
        at = 0
        for (name, _), n in zip(wanted, quota):
            if n:
                spans.append((size, at, at + n, name))
            at += n
    spark = rows.sparkSession
    spans_df = spark.createDataFrame(spans, "size bigint, lo bigint, hi bigint, split string").groupBy("size").agg(F.collect_list(F.struct("lo", "hi", "split")).alias("spans"))
    placed = positions(sizes, "size", [F.xxhash64("entity"), F.col("entity")]).join(F.broadcast(spans_df), "size")
    mine = F.filter("spans", lambda s: (s["lo"] <= F.col("position")) & (s["hi"] > F.col("position")))[0]["split"]
    return salted_join(whole, placed.select("entity", mine.alias("split")), ["entity"]).select("row_id", "source", "entity", "split")


def split_report(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows and share of each split within each source, and over all sources (source null)."""
    counts = assign(rows, targets).groupBy("source", "split").agg(F.count("*").alias("n_rows"))
    every = counts.groupBy("split").agg(F.sum("n_rows").alias("n_rows")).select(F.lit(None).cast("string").alias("source"), "split", "n_rows")
    both = counts.unionByName(every)
    total = both.groupBy("source").agg(F.sum("n_rows").alias("total"))
    joined = both.join(total.withColumnRenamed("source", "s"), both["source"].eqNullSafe(F.col("s")))
    return joined.select("source", "split", "n_rows", (F.col("n_rows") / F.col("total")).alias("share"))
