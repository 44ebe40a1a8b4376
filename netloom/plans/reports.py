"""Queries of brand and report operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.features import lists as word_lists
from netloom.functions import urls as U
from netloom.operators import brands, metrics, reports, splits
from netloom.plans import sql as Q

Table = Callable[[SparkSession, str], DataFrame]
NAMES = word_lists.Lists().brands
OWNED = {b: f"{b}.test" for b in NAMES}
METRICS = ("recall", "fpr")
NATURAL = {"low": 0.3, "mid": 0.6, "high": 0.9}


def _sites(rows: DataFrame) -> DataFrame:
    p = rows.where("url is not null").select(U.hostname(F.col("url")).alias("host")).distinct()
    p = p.select("host", U.split_host(F.col("host")).alias("p")).where("p.suffix <> '' and p.label <> ''")
    return p.select("p.label", F.concat("p.label", F.lit("."), "p.suffix").alias("domain")).distinct()


def _brands(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(b, [d]) for b, d in OWNED.items()], "brand string, domains array<string>")


def _names(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(b,) for b in NAMES], "name string")


def queries(interim: Table, corpus: Table, scored: Table, table: Callable[[SparkSession, str, str], DataFrame]) -> dict[str, Table]:
    def runs(s: SparkSession, d: str) -> DataFrame:
        folds = scored(s, d).where("domain is not null").withColumn("fold", splits.grouped_folds(F.col("domain"), 5))
        return metrics.at_threshold(folds, 0.6, ["source", "fold"])

    def vectors(s: SparkSession, d: str) -> DataFrame:
        return interim(s, d).where("url is not null").select("row_id", F.length("url").alias("a"), "depth", F.length(F.regexp_replace("url", "[^0-9]", "")).alias("b"))

    rounded = lambda df, *cols: df.withColumns({c: F.round(c, 9) for c in cols})
    spread = lambda s, d: reports.spread(runs(s, d), ["source"], "fold", METRICS, ["n_urls", "n_neg"])
    spread_cols = [f"{m}_{k}" for m in METRICS for k in ("median", "min", "max")]
    parts = lambda s, d: table(s, d, "splits").select("row_id", "split_0").distinct()
    return {
        "brand_neighbours": lambda s, d: brands.neighbours(_sites(interim(s, d)), _names(s)),
        "brand_one_edit": lambda s, d: brands.one_edit(_sites(interim(s, d)), _names(s)),
        "brand_mismatch": lambda s, d: brands.mismatch(_sites(interim(s, d)), _brands(s)),
        "brand_evidence": lambda s, d: rounded(brands.evidence(corpus(s, d), list(NAMES)), "exact_share"),
        "report_runs": lambda s, d: runs(s, d).select("source", "fold", "n_urls", "n_pos", "n_neg", *[F.round(c, 9).alias(c) for c in METRICS]),
        "report_spread": lambda s, d: rounded(spread(s, d), *spread_cols),
        "report_spread_texts": lambda s, d: reports.spread_texts(spread(s, d), ["source"], METRICS),
        "report_testable": lambda s, d: reports.testable(runs(s, d), "source", {"n_pos": 5, "n_neg": 20}),
        "report_replication": lambda s, d: rounded(reports.replication(runs(s, d), ["source"], F.col("recall") > F.col("fpr")), "share"),
        "report_by_split": lambda s, d: reports.by_split(runs(s, d), ["source"], "fold", "n_urls"),
        "report_wide": lambda s, d: reports.wide(runs(s, d).withColumn("f", F.concat(F.lit("fold_"), F.col("fold").cast("string"))), ["source"], "f", [f"fold_{i}" for i in range(5)], "n_urls"),
        "report_pairs": lambda s, d: reports.unordered_pairs(corpus(s, d), "source"),
        "report_feature_check": lambda s, d: rounded(reports.feature_check(scored(s, d).withColumn("url_len", F.length("url")), ["score", "depth", "url_len"]), "null_rate", "mean_benign", "mean_phishing", "eta2_label", "eta2_source", "eta2_source_within"),
        "report_crosstab": lambda s, d: reports.crosstab(table(s, d, "host_capture"), F.coalesce(F.col("label").cast("string"), F.lit("none")), F.when(F.col("dns").isNull(), "no_dns").when(F.coalesce(F.col("dns.resolves"), F.lit(False)), "ok").otherwise("dead"), ["ok", "dead", "no_dns"], "ok"),
        "report_natural_fpr": lambda s, d: rounded(reports.over_thresholds(scored(s, d).where("label = 0"), "score", NATURAL, ["source"]), *NATURAL),
        "join_pages": lambda s, d: reports.with_pages(interim(s, d).select("row_id", "label"), interim(s, d).where("html is not null").select("row_id", F.length("html").alias("n_chars")), "row_id", F.col("n_chars") >= 200),
        "join_only_pages": lambda s, d: reports.only_pages(interim(s, d).select("row_id", "label"), interim(s, d).where("html is not null").select("row_id", F.length("html").alias("n_chars")), "row_id", F.col("n_chars") >= 200),
        "join_splits": lambda s, d: reports.one_to_one(interim(s, d).select("row_id", "depth"), table(s, d, "splits").groupBy("row_id").agg(F.max("part").alias("part"), F.count("*").alias("times")), ["row_id"], "left"),
        "join_twins": lambda s, d: reports.twins(vectors(s, d).join(parts(s, d).where("split_0 = 'test'"), "row_id", "left_semi"), vectors(s, d).join(parts(s, d).where("split_0 = 'train'"), "row_id", "left_semi"), ["a", "depth", "b"]).select("row_id"),
    }


def oracle_sql(scored: str) -> dict[str, str]:
    names = ", ".join(f"('{b}')" for b in NAMES)
    hosts = f"{Q.url_cte('interim', 'row_id', 'url IS NOT NULL')}, ho AS (SELECT DISTINCT host FROM p), sz AS (SELECT host, string_split(host, '.') AS parts, ({Q.suffix_size()}) AS k FROM ho), sites AS (SELECT DISTINCT parts[-(k + 1)] AS label, array_to_string(parts[-(k + 1):], '.') AS domain FROM sz WHERE k > 0 AND len(parts) > k AND parts[-(k + 1)] <> '')"
    one = lambda x: rf"regexp_replace({x}, '[^\x00-\x7F]', '?', 'g')"
    edit = lambda a, b: f"(levenshtein({one(a)}, {b}) = 1 OR (length({a}) = length({b}) AND levenshtein({one(a)}, {b}) = 2 AND len(list_filter(range(1, length({a})), lambda i: {a}[1:i - 1] || {a}[i + 1] || {a}[i] || {a}[i + 2:] = {b})) > 0))"

    def skeleton(c: str) -> str:
        out = f"translate(lower({c}), '{U.HOMOGLYPHS[0]}', '{U.HOMOGLYPHS[1]}')"
        for pair, letter in brands.PAIRS:
            out = f"replace({out}, '{pair}', '{letter}')"
        return out

    runs = f"""WITH {scored}, f AS (SELECT *, (('0x' || substr(md5('0|' || domain), 1, 8))::UBIGINT % 5)::INT AS fold FROM s WHERE domain IS NOT NULL),
        g AS (SELECT source, fold, count(*) AS n_urls, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = 1 AND score >= 0.6) AS tp, count(*) FILTER (label = 0 AND score >= 0.6) AS fp FROM f GROUP BY 1, 2),
        runs AS (SELECT *, tp / nullif(n_pos, 0)::DOUBLE AS recall, fp / nullif(n_neg, 0)::DOUBLE AS fpr FROM g)"""
    mid = "round(median({0}), 9) AS {0}_median, round(min({0}), 9) AS {0}_min, round(max({0}), 9) AS {0}_max"
    text = "CASE WHEN median({0}) IS NOT NULL THEN printf('%.1f [%.1f, %.1f]', median({0}) * 100, min({0}) * 100, max({0}) * 100) END AS {0}"
    own = ", ".join(f"'{d}'" for d in OWNED.values())
    tl = f"(SELECT DISTINCT {skeleton('n.name')} AS t FROM names n)"
    eta = """SELECT '{f}' AS feature, round(1 - count(x) / count(*)::DOUBLE, 9) AS null_rate, round(avg(x) FILTER (label = 0), 9) AS mean_benign, round(avg(x) FILTER (label = 1), 9) AS mean_phishing,
        round((SELECT sum(n * (m - gm) ** 2) / nullif(any_value(ss), 0) FROM (SELECT label, count(x) AS n, avg(x) AS m FROM {t} GROUP BY 1), (SELECT avg(x) AS gm, sum((x - (SELECT avg(x) FROM {t})) ** 2) AS ss FROM {t})), 9) AS eta2_label,
        round((SELECT sum(n * (m - gm) ** 2) / nullif(any_value(ss), 0) FROM (SELECT source, count(x) AS n, avg(x) AS m FROM {t} GROUP BY 1), (SELECT avg(x) AS gm, sum((x - (SELECT avg(x) FROM {t})) ** 2) AS ss FROM {t})), 9) AS eta2_source,
        round((SELECT sum(e * n) / sum(n) FROM (SELECT a.label, any_value(b.n) AS n, coalesce(sum(a.n * (a.m - b.m) ** 2) / nullif(any_value(b.ss), 0), 0) AS e FROM (SELECT label, source, count(x) AS n, avg(x) AS m FROM {t} GROUP BY 1, 2) a
            JOIN (SELECT label, count(x) AS n, avg(x) AS m, var_pop(x) * count(x) AS ss FROM {t} GROUP BY 1) b USING (label) GROUP BY 1)), 9) AS eta2_source_within FROM {t}"""
    feats = {"score": "score", "depth": "depth::DOUBLE", "url_len": "length(url)::DOUBLE"}
    tables = ", ".join(f"t_{f} AS (SELECT label, source, {x} AS x FROM s)" for f, x in feats.items())
    check = f"WITH {scored}, {tables}, r AS ({' UNION ALL '.join(eta.format(f=f, t=f't_{f}') for f in feats)}) SELECT *, eta2_source_within >= 0.1 AND eta2_source_within > 2 * eta2_label AS flag FROM r"
    return {
        "brand_neighbours": f"WITH names(name) AS (VALUES {names}), {hosts} SELECT DISTINCT label, name, levenshtein({one('label')}, name)::INT AS distance FROM sites, names WHERE levenshtein({one('label')}, name) <= 2",
        "brand_one_edit": f"WITH names(name) AS (VALUES {names}), {hosts} SELECT DISTINCT label, name FROM sites, names WHERE label[1] = name[1] AND {edit('label', 'name')}",
        "brand_mismatch": f"""WITH names(name) AS (VALUES {names}), {hosts}, a AS (SELECT label, domain, domain IN ({own}) AS official, CASE WHEN label IN (SELECT name FROM names) THEN label ELSE replace(label, '-', '') END AS plain, {skeleton('label')} AS skel, {skeleton("replace(lower(label), '1', 'i')")} AS alt FROM sites),
            b AS (SELECT *, plain IN (SELECT name FROM names) AS is_brand FROM a), c AS (SELECT *, NOT official AND NOT is_brand AND skel <> lower(label) AND (skel IN (SELECT t FROM {tl}) OR alt IN (SELECT t FROM {tl})) AS homograph FROM b)
            SELECT domain, homograph::DOUBLE AS brand_homograph, (NOT official AND NOT is_brand AND NOT homograph AND length(skel) >= 5 AND EXISTS (SELECT 1 FROM {tl} q WHERE length(q.t) >= 6 AND q.t[1] = skel[1] AND {edit('skel', 'q.t')} AND NOT (length(skel) > length(q.t) AND length(q.t) <= 6)))::DOUBLE AS brand_edit1,
                (is_brand AND NOT official)::DOUBLE AS brand_other_suffix, official::DOUBLE AS brand_official FROM c""",
        "brand_evidence": rf"""WITH {Q.CORPUS}, names(name) AS (VALUES {names}), d AS (SELECT name, label, domain, list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM c, names WHERE label IS NOT NULL AND domain IS NOT NULL AND contains(lower(url), name)),
            per AS (SELECT name, label, domain, bool_or(list_contains(ws, name)) AS exact FROM d GROUP BY 1, 2, 3), n AS (SELECT name, label, count(*) AS n_domains, round(avg(exact::INT), 9) AS exact_share FROM per GROUP BY 1, 2),
            w AS (SELECT name, label, unnest(list_filter(ws, lambda w: contains(w, name))) AS w FROM d), k AS (SELECT name, label, w, count(*) AS m FROM w GROUP BY 1, 2, 3), t AS (SELECT name, label, string_agg(w, ' ' ORDER BY m DESC, w) AS words FROM (SELECT *, row_number() OVER (PARTITION BY name, label ORDER BY m DESC, w) AS rn FROM k) WHERE rn <= 5 GROUP BY 1, 2)
            SELECT name, label, n_domains, exact_share, coalesce(words, '') AS words FROM n LEFT JOIN t USING (name, label)""",
        "report_runs": f"{runs} SELECT source, fold, n_urls, n_pos, n_neg, round(recall, 9) AS recall, round(fpr, 9) AS fpr FROM runs",
        "report_spread": f"{runs} SELECT source, count(DISTINCT fold) AS n_splits, median(n_urls) AS n_urls, median(n_neg) AS n_neg, {mid.format('recall')}, {mid.format('fpr')} FROM runs GROUP BY 1",
        "report_spread_texts": f"{runs} SELECT source, count(DISTINCT fold) AS n_splits, {text.format('recall')}, {text.format('fpr')} FROM runs GROUP BY 1",
        "report_testable": f"{runs} SELECT source FROM runs GROUP BY 1 HAVING median(n_pos) >= 5 AND median(n_neg) >= 20",
        "report_replication": f"{runs}, r AS (SELECT source, count(*) AS n, round(avg(coalesce(recall > fpr, false)::INT), 9) AS share FROM runs GROUP BY 1) SELECT *, CASE WHEN n < 3 THEN 'not testable' WHEN share >= 0.75 THEN 'replicated' WHEN share >= 0.5 THEN 'partly replicated' ELSE 'not replicated' END AS verdict FROM r",
        "report_by_split": f"{runs} SELECT source, list(n_urls ORDER BY fold) AS values FROM runs GROUP BY 1",
        "report_wide": f"{runs} SELECT source, {', '.join(f'median(n_urls) FILTER (fold = {i}) AS fold_{i}' for i in range(5))} FROM runs GROUP BY 1",
        "report_pairs": f"WITH {Q.CORPUS}, n AS (SELECT DISTINCT source FROM c WHERE source IS NOT NULL) SELECT a.source AS a, b.source AS b FROM n a JOIN n b ON a.source < b.source",
        "report_feature_check": check,
        "report_crosstab": "WITH h AS (SELECT coalesce(label::VARCHAR, 'none') AS row, CASE WHEN dns IS NULL THEN 'no_dns' WHEN coalesce(dns.resolves, false) THEN 'ok' ELSE 'dead' END AS st FROM host_capture) SELECT row, count(*) FILTER (st = 'ok') AS ok, count(*) FILTER (st = 'dead') AS dead, count(*) FILTER (st = 'no_dns') AS no_dns, count(*) AS total, round_even(100 * count(*) FILTER (st = 'ok') / count(*)::DOUBLE, 2) AS success_pct FROM h GROUP BY 1",
        "report_natural_fpr": f"WITH {scored} SELECT source, count(*) AS n, {', '.join(f'round(avg((score >= {t})::INT), 9) AS {k}' for k, t in NATURAL.items())} FROM s WHERE label = 0 GROUP BY 1",
        "join_pages": "SELECT row_id, label, CASE WHEN length(html) >= 200 THEN length(html)::INT END AS n_chars, coalesce(length(html) >= 200, false) AS has_page FROM interim",
        "join_only_pages": "SELECT row_id, label, length(html)::INT AS n_chars FROM interim WHERE length(html) >= 200",
        "join_splits": "SELECT i.row_id, i.depth, s.part, s.times FROM interim i LEFT JOIN (SELECT row_id, max(part) AS part, count(*) AS times FROM splits GROUP BY 1) s USING (row_id)",
        "join_twins": "WITH v AS (SELECT row_id, length(url) AS a, depth, length(regexp_replace(url, '[^0-9]', '', 'g')) AS b FROM interim WHERE url IS NOT NULL), e AS (SELECT v.* FROM v WHERE row_id IN (SELECT row_id FROM splits WHERE split_0 = 'test')), t AS (SELECT v.* FROM v WHERE row_id IN (SELECT row_id FROM splits WHERE split_0 = 'train')) SELECT row_id FROM e WHERE EXISTS (SELECT 1 FROM t WHERE t.a = e.a AND t.b = e.b AND t.depth IS NOT DISTINCT FROM e.depth)",
    }
