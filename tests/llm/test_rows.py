"""Page copies, cross-split overlaps, splits, caps and mixing against brute force and at the edges."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import contributors, mixing, pages

BASE = "https://www.shop.example/a/b.php?x=1&y=2"
SAME = [
    BASE, "http://shop.example/a/b.php?y=2&x=1", "  HTTPS://WWW.SHOP.EXAMPLE:443/A/B.PHP?X=1&Y=2# ", "<https://www.shop.example/a/b.php?x=1&amp;y=2>", "shop.example./a//b.php/?x=1&&y=2&",
    '"https://www.shop.example/a/b.php?x=1&y=2";', "(http://shop.example:80/a/b.php?x=1&y=2)", "https://www.shop.example/a/b.\r\nphp?x=1&y=2",
]
OTHER = ["https://www.shop.example/a/b.php?x=2&y=1", "https://www.shop.example/ab.php?x=1&y=2", "https://shop.example:8080/a/b.php?x=1&y=2", "https://sho-p.example/a/b.php?x=1&y=2", "https://www.shop.example/a/b.php?x=12&y="]


def key(spark, url, **kw):
    return spark.createDataFrame([(url,)], "u string").select(pages.page_key(F.col("u"), **kw)).first()[0]


def test_page_keys(spark):
    df = spark.createDataFrame([(u,) for u in SAME + OTHER], "u string").select(pages.page_key(F.col("u")).alias("k"))
    ks = [r.k for r in df.collect()]
    assert len(set(ks[: len(SAME)])) == 1 and len(set(ks)) == 1 + len(OTHER)
    assert key(spark, BASE + "&utm_source=q&sid=8&token=3", tracking=False) == key(spark, BASE + "&token=3")
    assert key(spark, None) is None and key(spark, " # ") is None


def table(spark, data):
    return spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(data)], "row_id bigint, url string, source string").withColumns({"n": F.lit(1), "page": F.lit("p"), "src": F.lit("s"), "copies": F.lit(0)})


def test_same_pages(spark):
    data = [(u, s) for u in SAME for s in ("live", " Live", None)] + [(u, "live") for u in OTHER] + [(None, "live"), ("", "live"), (BASE, "other"), (BASE, "live"), (BASE, "live"), ("x" * 100_000, "live")]
    got = {tuple(r) for r in pages.same_pages(table(spark, data)).collect()}
    groups = {}
    for i, (u, s) in enumerate(data):
        if u in SAME:
            groups.setdefault((s or "").strip().lower(), []).append(i)
    assert got == {(min(v), x) for v in groups.values() for x in v if x != min(v)}
    c = {(r.source, r.row_id): r.copies for r in pages.collapse(table(spark, data)).collect() if r.copies > 1}
    assert c == {(s, min(v)): len(v) for s, v in groups.items() if len(v) > 1}
    assert pages.same_pages(table(spark, [])).count() == 0


def test_same_pages_with_a_hot_page(spark):
    df = spark.range(60_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, BASE).otherwise(F.concat(F.lit("http://a.test/"), F.col("id").cast("string"))).alias("url"), F.lit("s").alias("source"))
    got = pages.same_pages(df)
    assert got.count() == 19_999 and got.agg(F.max("row_id_a")).first()[0] == 0


def test_overlaps_against_brute_force(spark):
    rng = random.Random(2)
    sims = [rng.getrandbits(63) for _ in range(25)]
    data = []
    for i in range(300):
        h = rng.choice(sims) if rng.random() < 0.5 else None
        if h is not None:
            h ^= sum(1 << b for b in rng.sample(range(60), rng.randint(0, 4)))
        data.append((i, f"https://h{rng.randint(0, 60)}.test/p?{rng.choice(['', 'utm_medium=1', 'gclid=9'])}" if rng.random() < 0.9 else None, rng.choice(["a", "B "]), h))
    sides = [(i, *rng.choice([("pool", "train"), ("pool", "test"), ("pool", "cal"), ("time_slice", None), ("pool", None), (None, None)])) for i in range(300) if rng.random() < 0.95]
    it = spark.createDataFrame(data, "row_id bigint, url string, source string, html_simhash bigint").withColumns({"domain": F.lit("d"), "train": F.lit(1), "split": F.lit("x")})
    sp = spark.createDataFrame([(*s, f"a:{s[0]}") for s in [*sides, *sides[:20]]], "row_id bigint, part string, split_0 string, uid string")
    train = {r for r, p, s in sides if s == "train"}
    ev = {r for r, p, s in sides if s == "test" or (p is not None and p != "pool")}
    want = set()
    for a, b in itertools.product(train, ev):
        ua, ub = (data[x][1].split("?")[0] if data[x][1] else None for x in (a, b))
        near = data[a][3] is not None and data[b][3] is not None and (data[a][3] ^ data[b][3]).bit_count() <= 3
        if (ua is not None and ua == ub) or near:
            want.add((min(a, b), max(a, b)))
    got = [tuple(r) for r in pages.overlap_pairs(it, sp).collect()]
    assert set(got) == want and len(got) == len(want)
    rep = pages.overlap_report(it, sp).collect()
    assert sum(r.n_rows for r in rep) == len(ev)
    per_eval = {e: {t for t in train if t != e and (min(t, e), max(t, e)) in want} for e in ev}
    assert sum(r.n_pairs for r in rep) == sum(map(len, per_eval.values())) and sum(r.n_leaked for r in rep) == sum(1 for x in per_eval.values() if x)
    assert pages.overlap_pairs(it.limit(0), sp).count() == 0


def domains(spark, n=3000):
    d = F.when(F.col("id") % 3 == 0, F.lit("big.example")).when(F.col("id") % 3 == 1, F.concat(F.lit("d"), (F.col("id") % 200).cast("string"), F.lit(".test"))).otherwise(F.concat(F.lit("s"), F.col("id").cast("string"), F.lit(".test")))
    spelled = F.when(F.col("id") % 7 == 0, F.concat(F.lit(" WWW."), F.upper(d), F.lit("."))).otherwise(d)
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.concat(F.lit("https://"), d, F.lit("/"), F.col("id").cast("string")).alias("url"), F.when(F.col("id") % 101 != 0, spelled).alias("domain"),
        F.when(F.col("id") % 50 != 0, d).alias("domain_u2"), F.concat(F.lit("src"), (F.col("id") % 4).cast("string")).alias("source"), (F.col("id") % 5).cast("smallint").alias("depth"),
        F.lit("x").alias("entity"), F.lit("y").alias("node"), F.lit(0).alias("position"),
    )


def targets(spark):
    return spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")


def test_splits_keep_domains_together(spark):
    df = domains(spark)
    got = contributors.assign(df, targets(spark))
    assert got.count() == 3000 and got.where("split is null").count() == 0
    whole = got.join(df.select("row_id", F.regexp_replace(F.lower(F.trim("domain")), r"^www\.|\.$", "").alias("d")), "row_id").where("d is not null")
    assert whole.groupBy("d").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0
    shares = {r.split: r.share for r in contributors.split_report(df, targets(spark)).where("source is null").collect()}
    assert all(abs(shares[k] - v) < 0.005 for k, v in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    assert contributors.assign(df.limit(0), targets(spark)).count() == 0


def test_fill_is_the_greedy_rule():
    rng = random.Random(1)
    sizes = [(s, rng.randint(1, 5000) if s < 4 else rng.randint(1, 3)) for s in range(1, 40)]
    total = sum(s * n for s, n in sizes)
    goal = [0.7 * total, 0.2 * total, 0.1 * total]
    gap = list(goal)
    for size, n in sorted(sizes, reverse=True):
        for _ in range(n):
            i = max(range(3), key=lambda k: (gap[k], -k))
            gap[i] -= size
    quota = contributors.fill(sizes, goal)
    assert all(sum(quota[s]) == n for s, n in sizes)
    got = [goal[i] - sum(s * q[i] for s, q in quota.items()) for i in range(3)]
    assert max(abs(a - b) for a, b in zip(got, gap)) <= 2


def test_caps(spark):
    df = domains(spark)
    got = contributors.capped(df, max_share=0.02)
    rows = got.collect()
    assert max(r.position for r in rows) == 59
    flat = df.select("row_id", contributors.plain_domain(F.col("domain")).alias("d"), contributors.score(F.col("url"), F.col("depth")).alias("s")).collect()
    want = set()
    for _, g in itertools.groupby(sorted(flat, key=lambda r: (r.d or "", -r.s, r.row_id)), key=lambda r: r.d or ""):
        want |= {r.row_id for r in list(g)[:60]}
    assert {r.row_id for r in rows} == want
    assert contributors.capped(df, max_share=None, max_count=1).count() == df.select(F.coalesce(contributors.plain_domain(F.col("domain")), F.lit(""))).distinct().count()
    odd = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (None, "", "", 3)], "row_id bigint, url string, domain string, depth smallint")
    assert contributors.capped(odd, None, 5).count() == 3 and contributors.capped(odd.limit(0)).count() == 0


def test_flight_keeps_the_constraints():
    rng = np.random.default_rng(0)
    size = np.append(rng.integers(1, 400, 600), [9000, 7000])
    p0 = np.full(len(size), 0.3)
    p = mixing.flight(p0, size, np.random.default_rng(1))
    assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2
    assert abs(p.sum() - p0.sum()) < 1e-6 and abs((p * size).sum() - (p0 * size).sum()) < 1e-3
    drawn = np.mean([mixing.flight(p0[:40], size[:40], np.random.default_rng(k)) for k in range(400)], axis=0)
    assert abs(drawn - 0.3).max() < 0.12  # each document's chance stays what it was
    assert mixing.land(np.array([0.5, 0.5]), np.array([10, 30])).sum() in (1.0, 0.0, 2.0)


def test_copies_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 4)
    df = spark.createDataFrame([(1, "a b", "s")] * 11 + [(1, "a", "s")] * 2 + [(2, "a b", "s")], "doc_id bigint, text string, source string")
    got = sorted((r.doc_id, r.n_tokens, r["copy"]) for r in mixing.sizes(df).collect())
    assert got == [(1, 1, 1), (1, 1, 2), *[(1, 2, i) for i in range(1, 12)], (2, 2, 1)]


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)  # several levels of blocks
    rng = random.Random(7)
    docs = [(i, " ".join(["word"] * rng.randint(1, 200)), ["big", "Mid ", "small", "other"][i % 4 if i % 8 else 0]) for i in range(800)] + [(900, None, "big"), (901, "", "small"), (902, "text", None), (1, "again", "big")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumns({"copy": F.lit(0), "p": F.lit(1.0), "n_tokens": F.lit(3)})
    goal = spark.createDataFrame([("big", 0.2, 1), ("mid", 0.3, 2), ("small", 0.4, 3), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    rep = {r.source: r for r in mixing.mix_report(df, goal).collect()}
    assert rep["none"].mix_tokens == 0
    for s, w in (("big", 0.2), ("mid", 0.3), ("small", 0.4)):
        assert abs(rep[s].actual_share - w / 0.9) < 0.01 and rep[s].most_repeats <= rep[s].max_repeats
    a, b = ({(r.doc_id, r.n_tokens, r.repeats) for r in mixing.mix(df, goal).collect()} for _ in range(2))
    assert a == b and not {900, 901, 902} & {x[0] for x in a}
    again = {(r.doc_id, r.n_tokens, r.repeats) for r in mixing.mix(df.unionByName(df.where("doc_id = 5")).repartition(7, "text"), goal).collect()}
    other = {(r.doc_id, r.n_tokens, r.repeats) for r in mixing.mix(df.unionByName(df.where("doc_id = 5")).orderBy(F.desc("doc_id")).coalesce(1), goal).collect()}
    assert again == other  # whatever the partitions
    short = {r.source: r for r in mixing.mix_report(df, goal, total=10**7).collect()}
    assert all(short[s].mix_tokens == short[s].n_tokens * short[s].max_repeats for s in ("big", "mid", "small"))
    assert mixing.mix(df.limit(0), goal).count() == 0


@pytest.mark.parametrize("name", ["p1_canonical", "p6_collapsed", "p7_report"])
def test_registered_queries_run(spark, name):
    from netloom.llm import registry

    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
