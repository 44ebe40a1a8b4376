"""Queries of the core operators with the SQL that gives the same rows.

Every query runs over its whole tables.  Operators that SQL can't express
(parsers, seeded rewrites, learners, iterated clusters) have no SQL; they are
tested against brute force on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom import schema
from netloom.features import domain as domain_features
from netloom.features import html as html_features
from netloom.features import lists as word_lists
from netloom.features import url as url_features
from netloom.functions import urls as U
from netloom.operators import attacks, corpus, dedup, lists, metrics, splits, thresholds, timestamps, verdict
from netloom.plans import models, reports, sql_more
from netloom.plans import sql as Q
from netloom.plans.instants import INSTANTS
from netloom.plans.stages import spread
from netloom.sources import feeds, readers
from netloom.streaming import index

Query = Callable[[SparkSession, str], DataFrame]
PRIORITY = ("live", "kitewatch", "hooktrap", "siteledger", "urlbarn", "popular", "tenantscan", "oldnets", "natsites", "pagecast")
#: False-positive rates of the threshold rules: the reference's two and a coarse one.
TARGETS = (0.05, 0.01, 0.001)
HELDOUT, EVAL_ONLY, ORIGINS, FRACTIONS = "oldnets", ("natsites",), ("late_test",), {"live": 0.1}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return corpus.corpus_rows(table(s, d, "interim"))


def _dated(s: SparkSession, d: str) -> DataFrame:
    """Corpus rows with dates, for the steps that look at them."""
    return corpus.corpus_rows(table(s, d, "interim"), table(s, d, "source_cfg"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    """Corpus rows with a score from hash and label, on a grid so that scores tie."""
    score = F.floor((U.unit_hash(F.col("uid"), 1) * 0.7 + F.col("label") * 0.3) * 1000) / 1000
    return _corpus(s, d).where("label is not null").withColumn("score", score)


SCORED = Q.CORPUS + ", s AS (SELECT *, floor((('0x' || substr(md5('1|' || uid), 1, 8))::UBIGINT / 4294967296.0 * 0.7 + label * 0.3) * 1000) / 1000 AS score FROM c WHERE label IS NOT NULL)"


def _names(s: SparkSession, *names: str) -> DataFrame:
    return s.createDataFrame([(n,) for n in names], "domain string")


def _list_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Phishing urls, domains that are benign in two sources as allow candidates, platforms, shorteners."""
    it = table(s, d, "interim")
    ranked = it.where("label = 0").groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.countDistinct(corpus.plain_name(F.col("source"))).alias("n")).where("n >= 2").select("domain")
    return it.where("label = 1").select("url"), ranked, _names(s, *word_lists.PLATFORMS), _names(s, *word_lists.SHORTENERS)


def _layers(s: SparkSession, d: str) -> DataFrame:
    h = lambda n: F.pmod(F.col("row_id") * (2 * n + 3), F.lit(n + 5))
    base = table(s, d, "interim").select("row_id")
    out = base.withColumns({c: h(i) == 0 for i, c in enumerate(verdict.FLAGS)})
    out = out.withColumn("blocked", F.when(h(20) == 1, "url").when(h(20) == 2, "domain")).withColumn("model_verdict", (h(21) % 3).cast("int")).withColumn("model_prob", h(22) / 27.0)
    return out.withColumn("page_verdict", F.when(h(23) < 20, (h(23) % 3).cast("int"))).withColumn("domain_risk", F.when(h(24) == 0, "high").otherwise("low")).withColumn("tier_c_verdict", (h(25) % 3).cast("int"))


def _url_parts(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(s, d, "interim").select(
        "row_id", U.scheme(u).alias("scheme"), U.hostname(u).alias("host"), U.port(u).alias("port"), U.normalize_url(u).alias("url_norm"), U.url_key(u).alias("url_key"),
        U.url_depth(u).alias("depth"), U.registered_domain(u).alias("domain"), U.normalize_to_registrable(u).alias("registrable"), U.page_id(u).alias("page_id"),
        U.list_hash(U.url_key(u)).alias("key_hash"),
    )


def _hashes(s: SparkSession, d: str) -> DataFrame:
    c = F.col("domain")
    return table(s, d, "interim").select(
        "row_id", U.unit_hash(c, 7).alias("unit"), U.hash_fold(c, 5).alias("fold"), U.spaced_words(F.col("url")).alias("words"), F.round(U.entropy(F.col("url")), 9).alias("entropy"),
        U.normalise_homoglyphs(F.lower(c)).alias("skeleton"), F.levenshtein(F.lower(c), F.lower("domain_u2")).alias("distance"), splits.hash_split(c, 3, [("train", 0.7), ("cal", 0.1), ("test", 0.2)]).alias("split"),
    )


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles to nine digits, since their last ones depend on the order."""
    return df.withColumns({c: F.round(c, 9) for c in names})


def _tier_a(s: SparkSession, d: str, group: Callable[[], dict]) -> DataFrame:
    p = url_features.parse(table(s, d, "interim").select("row_id", "url"))
    return p.select("row_id", *[v.alias(k) for k, v in group().items()])


A_PARSE = rf"""
    WITH a0 AS (SELECT row_id, regexp_replace(regexp_replace(regexp_replace(url, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '(?s)#.*$', ''), '{Q.SCHEME}', '') AS s FROM interim),
    a1 AS (SELECT row_id, regexp_extract(s, '^([^/?]*)', 1) AS w, regexp_replace(s, '^[^/?]*', '') AS rest FROM a0),
    a2 AS (SELECT row_id, regexp_extract(w, '(?s)^(.*)@', 1) AS userinfo, regexp_replace(w, '(?s)^.*@', '') AS a, regexp_replace(regexp_extract(rest, '(?s)^([^?]*)', 1), '/+$', '') AS path, regexp_extract(rest, '(?s)^[^?]*\?(.*)$', 1) AS query FROM a1),
    a3 AS (SELECT *, regexp_extract(a, ':([0-9]+)$', 1) AS port, regexp_replace(lower(regexp_replace(a, ':[0-9]+$', '')), '\.+$', '') AS h FROM a2),
    a4 AS (SELECT * EXCLUDE (h), CASE WHEN regexp_matches(h, '[\p{{L}}\p{{N}}]') THEN regexp_replace(h, '^www\.', '') END AS h FROM a3),
    a5 AS (SELECT *, {Q.domain("h")} AS dom, ({Q.suffix_size("h")}) AS k FROM a4),
    a6 AS (SELECT * EXCLUDE (h), coalesce(dom IN ({", ".join(f"'{x}'" for x in word_lists.PLATFORMS)}) AND k > 0, false) AS is_platform, CASE WHEN dom IN ({", ".join(f"'{x}'" for x in word_lists.PLATFORMS)}) AND k > 0
           THEN CASE WHEN h <> dom THEN substr(h, 1, length(h) - length(dom)) ELSE '' END || '{url_features.PLATFORM_TOKEN}' ELSE h END AS host FROM a5),
    a7 AS (SELECT *, {Q.suffix_size("host")} AS sk, string_split(host, '.') AS labels FROM a6),
    p AS (SELECT *, CASE WHEN sk = 0 THEN '' ELSE array_to_string(labels[-sk:], '.') END AS suffix, CASE WHEN sk = 0 THEN host ELSE coalesce(labels[-(sk + 1)], '') END AS label,
          CASE WHEN sk = 0 OR len(labels) <= sk + 1 THEN '' ELSE array_to_string(labels[1:len(labels) - sk - 1], '.') END AS subdomain, regexp_matches(host, '{Q.IPV4}') AS is_ip,
          CASE WHEN userinfo <> '' THEN userinfo || '@' ELSE '' END || host || CASE WHEN port <> '' THEN ':' || port ELSE '' END || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canon FROM a7)
"""
_W = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"
_DIGITS = lambda c: f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"
_LETTERS = lambda c: f"length(regexp_replace({c}, '[^A-Za-zKİ]', '', 'g'))"


def _sql_lengths() -> str:
    cols = ["length(canon)::DOUBLE AS url_len", "length(host)::DOUBLE AS host_len", "length(CASE WHEN suffix <> '' THEN label || '.' || suffix ELSE label END)::DOUBLE AS domain_len", "length(subdomain)::DOUBLE AS subdomain_len", "length(path)::DOUBLE AS path_len", "length(query)::DOUBLE AS query_len", "length(suffix)::DOUBLE AS tld_len"]
    for scope, c in (("url", "canon"), ("host", "host"), ("path", "path")):
        sizes = f"list_transform({_W(c)}, lambda w: length(w))"
        cols += [f"list_min({sizes})::DOUBLE AS shortest_word_{scope}", f"list_max({sizes})::DOUBLE AS longest_word_{scope}", f"list_sum({sizes}) / nullif(len({sizes}), 0)::DOUBLE AS avg_word_{scope}"]
    return A_PARSE + "SELECT row_id, " + ", ".join(cols) + " FROM p"


def _sql_counts() -> str:
    cols = [f"(length(canon) - length(replace(canon, '{ch}', '')))::DOUBLE AS n_{k}" for k, ch in url_features.COUNTED.items()]
    tokens = f"list_concat({_W('host')}, {_W('path')})"
    cols += [
        "(length(host) - length(replace(host, '.', '')))::DOUBLE AS host_n_dot", "(length(host) - length(replace(host, '-', '')))::DOUBLE AS host_n_hyphen", f"{_DIGITS('canon')}::DOUBLE AS n_digits", f"{_LETTERS('canon')}::DOUBLE AS n_letters",
        "CASE WHEN host IS NULL THEN NULL WHEN subdomain = '' THEN 0 ELSE length(subdomain) - length(replace(subdomain, '.', '')) + 1 END::DOUBLE AS n_subdomain_levels",
        "CASE WHEN host IS NOT NULL THEN len(list_filter(string_split(path, '/'), lambda s: s <> '')) END::DOUBLE AS path_depth", "CASE WHEN host IS NOT NULL THEN len(list_filter(string_split(query, '&'), lambda s: s <> '')) END::DOUBLE AS n_query_params",
        f"CASE WHEN host IS NOT NULL THEN len(list_filter({tokens}, lambda w: w = 'www')) END::DOUBLE AS n_www_tokens", f"CASE WHEN host IS NOT NULL THEN len(list_filter({tokens}, lambda w: w = 'com')) END::DOUBLE AS n_com_tokens",
    ]
    return A_PARSE + "SELECT row_id, " + ", ".join(cols) + " FROM p"


def _sql_ratios() -> str:
    cols = []
    for scope, c in (("url", "canon"), ("host", "host")):
        cols += [f"{_DIGITS(c)} / nullif(length({c}), 0)::DOUBLE AS digit_ratio_{scope}", f"{_LETTERS(c)} / nullif(length({c}), 0)::DOUBLE AS letter_ratio_{scope}", f"(length({c}) - {_DIGITS(c)} - {_LETTERS(c)}) / nullif(length({c}), 0)::DOUBLE AS special_ratio_{scope}"]
    return A_PARSE + "SELECT row_id, " + ", ".join(cols) + " FROM p"


def _sql_words() -> str:
    lists = {"kw": word_lists.KEYWORDS, "br": word_lists.Lists().brands}
    arr = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in lists.items()}
    hits = lambda c, k: f"CASE WHEN host IS NOT NULL THEN len(list_filter({arr[k]}, lambda w: contains({c}, w))) END::DOUBLE"
    exact = f"label IN ({', '.join(repr(b) for b in lists['br'])})"
    return A_PARSE + f"""SELECT row_id, {hits("host || '/' || lower(path) || '?' || lower(query)", "kw")} AS n_suspicious_keywords, {hits("host", "kw")} AS kw_in_host, {hits("lower(path)", "kw")} AS kw_in_path, {hits("lower(query)", "kw")} AS kw_in_query,
        {hits("subdomain", "br")} AS brand_in_subdomain, {hits("lower(path)", "br")} AS brand_in_path, CASE WHEN host IS NOT NULL THEN {exact} END::DOUBLE AS domain_is_brand,
        CASE WHEN host IS NOT NULL THEN label <> '' AND NOT {exact} AND len(list_filter({arr['br']}, lambda w: contains(label, w))) > 0 END::DOUBLE AS domain_contains_brand FROM p"""


def _when_host(cols: dict[str, str]) -> str:
    return A_PARSE + "SELECT row_id, " + ", ".join(f"CASE WHEN host IS NOT NULL THEN {v} END::DOUBLE AS {k}" for k, v in cols.items()) + " FROM p"


def _sql_host_form() -> str:
    tld, ext = "string_split(suffix, '.')[-1]", r"regexp_extract(lower(string_split(path, '/')[-1]), '\.([a-z0-9]{1,5})$', 1)"
    parts = "string_split(host, '.')"
    numeric = f"len(list_filter({parts}, lambda x: regexp_matches(x, '^[0-9]+$') OR starts_with(x, '0x'))) = 4"
    return _when_host({
        "host_is_ip": "is_ip",
        "host_ip_obfuscated": f"regexp_matches(host, '^0x[0-9a-f]+$') OR regexp_matches(host, '^[0-9]{{8,}}$') OR (len({parts}) = 4 AND {numeric} AND len(list_filter({parts}, lambda x: length(x) > 1 AND starts_with(x, '0'))) > 0)",
        "has_port": "port <> ''", "nonstandard_port": "port NOT IN ('', '80', '443')", "has_userinfo": "userinfo <> ''", "has_punycode": "contains(host, 'xn--')",
        "has_non_ascii_host": r"regexp_matches(host, '[^\x00-\x7F]')", "https_in_host": "contains(host, 'https')", "http_in_path": "contains(lower(path), 'http')", "www_in_path": "contains(lower(path), 'www')",
        "www_misplaced_host": f"list_contains({parts}, 'www')", "double_slash_in_path": "contains(path, '//')", "tld_in_path": f"{tld} <> '' AND list_contains({_W('path')}, {tld})",
        "tld_in_subdomain": f"{tld} <> '' AND list_contains(string_split(subdomain, '.'), {tld})", "abnormal_subdomain": "len(string_split(subdomain, '.')) > 3 OR len(list_filter(string_split(subdomain, '.'), lambda x: length(x) > 25)) > 0",
        "prefix_suffix_hyphen": "contains(label, '-')", "path_ext_present": f"{ext} <> ''", "path_ext_is_script": f"{ext} IN ('php', 'asp', 'aspx', 'jsp', 'cgi')", "path_ext_is_html": f"{ext} IN ('html', 'htm', 'shtml')",
    })


def _sql_other() -> str:
    names = lambda xs: ", ".join(f"'{x}'" for x in xs)
    lists_ = word_lists.Lists()
    keys = "list_transform(list_filter(string_split(query, '&'), lambda kv: kv <> ''), lambda kv: lower(split_part(kv, '=', 1)))"
    tail = "lower(path || '?' || query)"
    return _when_host({
        "is_shortener": f"(CASE WHEN suffix <> '' THEN label || '.' || suffix ELSE label END) IN ({names(lists_.shorteners)})", "has_redirect_param": f"list_has_any({keys}, [{names(lists_.redirect_fields)}])",
        "has_embedded_url": f"regexp_matches({tail}, 'https?(://|%3a%2f%2f|%253a%252f%252f)')", "has_embedded_email": rf"regexp_matches({tail}, '[a-z0-9._+\-]+@[a-z0-9\-]+\.[a-z]{{2,}}')",
        "suspicious_tld": f"string_split(suffix, '.')[-1] IN ({names(lists_.suspicious_tlds)})", "is_hosting_platform": "is_platform",
    })


def _split_sql(seed: int = 0) -> str:
    """The grouped split as SQL: running sums in hash order within each stratum."""
    h = lambda s: f"('0x' || substr(md5('{s}|' || domain), 1, 8))::UBIGINT / 4294967296.0"
    return f"""WITH {Q.CORPUS}, z AS (SELECT domain, count(*) AS n, (avg(label) >= 0.5)::INT AS stratum FROM c WHERE domain IS NOT NULL GROUP BY 1),
        t AS (SELECT *, sum(n) OVER (PARTITION BY stratum ORDER BY {h(seed)}, domain) - n AS run, sum(n) OVER (PARTITION BY stratum) AS al FROM z),
        r AS (SELECT * FROM t WHERE NOT run < 0.2 * al),
        k AS (SELECT domain, sum(n) OVER (PARTITION BY stratum ORDER BY {h(seed + 1000)}, domain) - n AS run2, sum(n) OVER (PARTITION BY stratum) AS al2 FROM r)
        SELECT t.domain, CASE WHEN k.domain IS NULL THEN 'test' WHEN k.run2 < 0.15 * k.al2 THEN 'cal' ELSE 'train' END AS split FROM t LEFT JOIN k ON t.domain = k.domain"""


KEYED = f"WITH {Q.CORPUS}, {Q.url_cte('c', 'uid, row_id, label, us, source, domain')}, kk AS (SELECT uid, row_id, label, us, source, domain, {Q.url_key()} AS k FROM p)"
PRIO = Q.priority(PRIORITY)


def queries() -> dict[str, Query]:
    t = table
    it = lambda s, d: t(s, d, "interim")
    hc = lambda s, d: t(s, d, "host_capture")
    lists_of = lambda s, d: lists.build_lists(*_list_inputs(s, d))
    return reports.queries(it, _corpus, _scored, table) | {
        "p4_found": lambda s, d: timestamps.found(it(s, d), t(s, d, "source_cfg")),
        "p4_normalised": lambda s, d: timestamps.to_utc(it(s, d).select("row_id", "source", "date"), t(s, d, "source_cfg")).select("row_id", "utc_micros", "wall"),
        "url_parts": _url_parts,
        "url_hashes": _hashes,
        "url_trigram_vectors": lambda s, d: it(s, d).select("row_id", U.trigram_vector(F.col("domain")).alias("vector")),
        "url_expressions": lambda s, d: lists.expressions(it(s, d)),
        "features_url_lengths": lambda s, d: _tier_a(s, d, url_features.length_features),
        "features_url_counts": lambda s, d: _tier_a(s, d, url_features.count_features),
        "features_url_ratios": lambda s, d: _tier_a(s, d, url_features.ratio_features),
        "features_url_host_form": lambda s, d: _tier_a(s, d, url_features.host_form_features),
        "features_url_obfuscation": lambda s, d: _tier_a(s, d, url_features.obfuscation_features),
        "features_url_randomness": lambda s, d: _rounded(_tier_a(s, d, url_features.randomness_features), "entropy_url", "entropy_domain"),
        "features_url_words": lambda s, d: _tier_a(s, d, lambda: url_features.word_features(word_lists.Lists())),
        "features_url_squatting": lambda s, d: _tier_a(s, d, lambda: url_features.squatting_features(word_lists.Lists())),
        "features_url_other": lambda s, d: _tier_a(s, d, lambda: url_features.other_features(word_lists.Lists())),
        "features_url_all": lambda s, d: _rounded(url_features.features(spread(it(s, d).select("row_id", "url"))), "entropy_url", "entropy_domain"),
        "features_url_fitted": lambda s, d: _rounded(url_features.fitted_features(it(s, d), *url_features.fit(it(s, d))), "bigram_loglik_domain"),
        "features_html": lambda s, d: html_features.features(it(s, d)),
        "features_domain_dns": lambda s, d: hc(s, d).select("capture_id", *[v.alias(k) for k, v in domain_features.dns_features(hc(s, d)).items()]),
        "features_domain_tls": lambda s, d: hc(s, d).select("capture_id", *[v.alias(k) for k, v in domain_features.tls_features(hc(s, d)).items()]),
        "features_domain_registration": lambda s, d: hc(s, d).select("capture_id", *[v.alias(k) for k, v in domain_features.registration_features(hc(s, d)).items()]),
        "host_flags": lambda s, d: domain_features.host_flags(hc(s, d)),
        "host_latest": lambda s, d: domain_features.latest_hosts(hc(s, d)).groupBy("host").agg(F.unix_micros(F.max("captured_at")).alias("captured_us")),
        "host_facts": lambda s, d: domain_features.facts(hc(s, d)).select("capture_id", "resolves", "has_mx", "has_spf", "has_dmarc", "tls_ok", "tls_verified", "cert_age_days", "cert_free_issuer", "san_count"),
        "host_signal_table": lambda s, d: _rounded(domain_features.signal_table(domain_features.signals(domain_features.facts(hc(s, d)))), "phishing_lo", "phishing_hi", "benign_lo", "benign_hi"),
        "host_risk_table": lambda s, d: domain_features.risk_table(domain_features.signals(domain_features.facts(hc(s, d)))),
        "host_eligibility": lambda s, d: domain_features.eligible(hc(s, d)),
        "host_counts_by_label": lambda s, d: domain_features.counts_by_label(hc(s, d)),
        "schema_violations": lambda s, d: schema.violations(it(s, d)),
        "source_projection": lambda s, d: readers.from_table(it(s, d), readers.Source("sample", "table", columns={"url": "url", "label": "label", "html": "html"})).groupBy("label", "domain").agg(F.count("*").alias("n"), F.sum("depth").alias("depths")),
        "corpus_url_dedup": lambda s, d: corpus.dedup_urls(_dated(s, d), PRIORITY).select("uid"),
        "corpus_near_dup": lambda s, d: corpus.near_dup_pages(_dated(s, d), PRIORITY).select("uid"),
        "corpus_shared_domains": lambda s, d: corpus.shared_phishing_domains(_corpus(s, d)),
        "corpus_domain_owner": lambda s, d: corpus.domain_owner(_dated(s, d), PRIORITY),
        "corpus_domain_cap": lambda s, d: corpus.cap_per_domain(_corpus(s, d), 20, 42).select("uid"),
        "corpus_holdouts": lambda s, d: corpus.carve_holdouts(_dated(s, d), HELDOUT, EVAL_ONLY, ORIGINS, FRACTIONS).select("uid", "part"),
        "corpus_depth_table": lambda s, d: corpus.depth_table(_corpus(s, d)),
        "corpus_balance_depth": lambda s, d: corpus.balance_depth(_corpus(s, d), target=0.505).select("uid"),
        "corpus_source_weights": lambda s, d: corpus.source_weights(_corpus(s, d), 0.15).select("uid", F.round("weight", 9).alias("weight")),
        "corpus_build": lambda s, d: corpus.build(_dated(s, d), PRIORITY, heldout=HELDOUT, eval_only=EVAL_ONLY, origins=ORIGINS, fractions=FRACTIONS)[0].select("uid", "part", "weight"),
        "corpus_removals": lambda s, d: corpus.build(_dated(s, d), PRIORITY, heldout=HELDOUT, eval_only=EVAL_ONLY, origins=ORIGINS, fractions=FRACTIONS)[1],
        "corpus_part_summary": lambda s, d: corpus.part_summary(_dated(s, d), "source"),
        "page_simhash": lambda s, d: dedup.with_simhash(it(s, d).where("html is not null").select("row_id", "html"), name="simhash").select("row_id", "simhash"),
        "near_dup_clusters": lambda s, d: dedup.near_dup_clusters(_corpus(s, d)).groupBy("root").agg(F.count("*").alias("n_values")),
        "split_grouped": lambda s, d: splits.grouped_split(_corpus(s, d).where("domain is not null")),
        "split_folds": lambda s, d: _corpus(s, d).select("uid", splits.grouped_folds(F.col("domain"), 5).alias("fold")),
        "split_leaks": lambda s, d: splits.shared_between(_corpus(s, d).join(t(s, d, "splits").where("split_0 is not null").select("row_id", F.col("split_0").alias("part")).distinct(), "row_id")),
        "metric_curves": lambda s, d: metrics.roc_auc(_scored(s, d), ["source"]).select("source", F.round("roc_auc", 9).alias("roc_auc"), F.round("pr_auc", 9).alias("pr_auc")),
        "metric_operating_points": lambda s, d: metrics.operating_point(_scored(s, d), 0.05, ["source"]).select("source", "n_neg", "granularity_limited", F.round("recall", 9).alias("recall"), F.round("achieved_fpr", 9).alias("achieved_fpr"), "threshold"),
        "metric_at_threshold": lambda s, d: metrics.at_threshold(_scored(s, d), 0.6, ["source"]).select("source", "n_urls", "n_pos", "n_neg", "tp", "fp", *[F.round(c, 9).alias(c) for c in ("recall", "fpr", "precision", "f1")]),
        "metric_calibration": lambda s, d: metrics.calibration_error(_scored(s, d), 10, ["source"]).join(metrics.brier(_scored(s, d), ["source"]), "source").select("source", F.round("ece", 9).alias("ece"), F.round("brier", 9).alias("brier")),
        "metric_eta_squared": lambda s, d: metrics.eta_squared(_scored(s, d), "score", "source", "label").select(F.round("eta_squared", 9).alias("eta_squared")),
        "metric_depth_weights": lambda s, d: metrics.depth_weights(_corpus(s, d)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 9).alias("weight")),
        "metric_medians": lambda s, d: metrics.medians(_scored(s, d), ["source"], ["score"]).select("source", *[F.round(f"score_{k}", 9).alias(f"score_{k}") for k in ("median", "min", "max")]),
        "threshold_rules": lambda s, d: thresholds.rules(_scored(s, d), TARGETS),
        "threshold_costs": lambda s, d: thresholds.evaluate_rules(_scored(s, d), thresholds.rules(_scored(s, d), TARGETS)),
        "list_keys": lambda s, d: it(s, d).select("row_id", lists.list_url_key(F.col("url")).alias("url_key"), lists.list_domain_key(F.col("url")).alias("domain_key")),
        "list_zones": lambda s, d: lists.learn_zones(*_list_inputs(s, d)[:3])[0],
        "list_build": lists_of,
        "list_lookup": lambda s, d: lists.lookup(it(s, d).select("row_id", "url"), lists_of(s, d), _names(s, *word_lists.SHORTENERS), _names(s, *word_lists.PLATFORMS)),
        "list_delta": lambda s, d: lists.delta(lists_of(s, d).where("entry < '8'"), lists_of(s, d).where("entry > '4'")),
        "verdict_combined": lambda s, d: verdict.combine(_layers(s, d)).select("row_id", "verdict", "layer"),
        "index_build": lambda s, d: index.build_index(t(s, d, "feed_batch")).select("url_norm", "label", "sources", "label_conflict", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us")),
        "index_merge": lambda s, d: index.merge(t(s, d, "feed_index"), index.batch_rows(t(s, d, "feed_batch"), F.lit("2030-01-01 00:00:00").cast("timestamp"))).select("url_norm", "label", "sources", "label_conflict", F.unix_micros("last_seen").alias("last_us")),
        "index_daily_counts": lambda s, d: index.daily_counts(t(s, d, "feed_batch").where("feed_time is not null").withColumnRenamed("feed_time", "ts"), "source").select("source", F.col("day").cast("string").alias("day"), "n"),
        "index_new_entries": lambda s, d: index.after_baseline(index.new_entries(t(s, d, "feed_batch").select(F.col("source").alias("feed"), F.col("url").alias("domain"), F.col("batch_day").cast("timestamp").alias("ts")))).select("feed", "domain", F.unix_micros("ts").alias("us")),
        "index_token_bucket": lambda s, d: index.token_bucket(t(s, d, "feed_batch").where("feed_time is not null"), "target", "feed_time", 2.0, 1e-6).groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("n")),
        "capture_state": lambda s, d: index.capture_state(hc(s, d)).select("host", "done", "failures", "retry"),
        "short_link_domains": lambda s, d: feeds.short_link_domains(it(s, d), 12, 5),
        "deep_urls": lambda s, d: feeds.deep_urls(it(s, d).select("url"), 3, 42),
        "attack_variants": lambda s, d: attacks.variants(it(s, d)),
        "model_stack": lambda s, d: models.stack(
            _corpus(s, d).where("label is not null").withColumn("text", F.col("url")).withColumn("len", F.length("url").cast("double")),
            {"words": lambda: models.word_ngrams(min_df=5), "length": lambda: models.linear(["len", "depth"])}, folds=2, key="uid",
        ).select("uid", "stacked"),
    }


def oracle_sql() -> dict[str, str]:
    src = r"lower(regexp_replace(source, '[\s]+', '', 'g'))"
    best = f"row_number() OVER (PARTITION BY k ORDER BY us NULLS LAST, {PRIO}, uid)"
    failed = "list_transform(coalesce(dns.errors, []), lambda e: upper(split_part(e, ':', 1)))"
    good = "(tls IS NOT NULL AND coalesce(tls.ok, false))"
    cert = f"({good} AND coalesce(tls.verified, false) AND (tls.issuer_o IS NOT NULL OR tls.not_before IS NOT NULL OR tls.subject_cn IS NOT NULL))"
    unless = lambda kind, v: f"CASE WHEN dns IS NOT NULL AND NOT list_contains({failed}, '{kind}') THEN {v} END::DOUBLE"
    tri = lambda v, kind: f"CASE WHEN dns IS NULL THEN NULL WHEN coalesce({v}, false) THEN true WHEN len(list_filter(coalesce(dns.errors, []), lambda e: starts_with(e, '{kind}:'))) > 0 THEN NULL ELSE false END"
    ns = r"list_transform(coalesce(dns.ns, []), lambda n: regexp_replace(lower(n), '\.+$', ''))"
    days = lambda a, b: f"(epoch_us({a}) - epoch_us({b})) / 8.64e10"
    curve = f"""WITH {SCORED}, g AS (SELECT source, score, count(*) FILTER (label = 0) AS neg, count(*) FILTER (label = 1) AS pos FROM s GROUP BY 1, 2),
        r AS (SELECT *, sum(neg) OVER w AS fp, sum(pos) OVER w AS tp, sum(neg) OVER (PARTITION BY source) AS nn, sum(pos) OVER (PARTITION BY source) AS np FROM g WINDOW w AS (PARTITION BY source ORDER BY score DESC))"""
    more = sql_more.texts(A_PARSE, verdict.FLAGS, verdict.PICTURE_MIN_PROB, PRIO)
    groups = [_sql_lengths(), _sql_counts(), _sql_ratios(), _sql_host_form(), _sql_words(), _sql_other(), *[more[f"features_url_{g}"] for g in ("obfuscation", "randomness", "squatting")]]
    every = "SELECT * FROM " + " JOIN ".join(f"({g}) g{i}" + (" USING (row_id)" if i else "") for i, g in enumerate(groups))
    return more | {"features_url_all": every} | reports.oracle_sql(SCORED) | {
        "p4_found": f"WITH {INSTANTS} SELECT row_id, micros AS utc_micros FROM inst JOIN interim USING (row_id) WHERE micros IS NOT NULL AND NOT regexp_matches(interim.date, '{Q.EXACT}')",
        "p4_normalised": f"WITH {INSTANTS} SELECT row_id, micros AS utc_micros, wall FROM inst",
        "url_parts": f"""WITH {Q.url_cte()} SELECT row_id, scheme, host, port, {Q.normalized()} AS url_norm, {Q.url_key()} AS url_key, len(list_filter(string_split(path, '/'), lambda x: x <> ''))::INT AS depth, {Q.domain()} AS domain,
            'https://www.' || {Q.domain()} AS registrable, substr(sha1(url), 1, 16) AS page_id, substr(sha256({Q.url_key()}), 1, 16) AS key_hash FROM p""",
        "features_url_lengths": _sql_lengths(),
        "features_url_counts": _sql_counts(),
        "features_url_ratios": _sql_ratios(),
        "features_url_words": _sql_words(),
        "features_url_host_form": _sql_host_form(),
        "features_url_other": _sql_other(),
        "list_keys": rf"""WITH a AS (SELECT row_id, regexp_replace(regexp_replace(regexp_replace(url, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '(?s)#.*$', ''), '{Q.SCHEME}', '') AS s FROM interim),
            b AS (SELECT row_id, translate(regexp_replace(regexp_extract(s, '(?s)^([^/?]*)', 1), '(?s)^.*@', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS a, regexp_replace(s, '^[^/?]*', '') AS rest FROM a),
            c AS (SELECT row_id, regexp_replace(regexp_replace(regexp_extract(a, '^([^:]*)', 1), '\.+$', ''), '^www\.', '') AS host, regexp_extract(a, '(?s)(:.*)$', 1) AS port, regexp_replace(regexp_extract(rest, '(?s)^([^?]*)', 1), '/+$', '') AS path, regexp_extract(rest, '(?s)^[^?]*(\?.*)$', 1) AS query FROM b)
            SELECT row_id, host || port || path || query AS url_key, {Q.domain()} AS domain_key FROM c""",
        "features_domain_dns": f"""SELECT capture_id, {unless('A', 'len(coalesce(dns.a, []))')} AS n_a, {unless('AAAA', '0')} AS n_aaaa, {unless('CNAME', '0')} AS has_cname, {unless('MX', 'dns.mx_count')} AS mx_count, {unless('MX', 'dns.mx_count > 0')} AS has_mx,
            {unless('TXT', 'dns.spf')} AS has_spf, {unless('TXT', 'dns.dmarc')} AS has_dmarc, {unless('NS', f'len({ns})')} AS n_ns,
            CASE WHEN dns IS NOT NULL AND NOT list_contains({failed}, 'NS') AND len({ns}) > 0 THEN len(list_filter({ns}, lambda n: ({Q.domain('n')}) = lower(domain))) > 0 END::DOUBLE AS ns_in_own_domain,
            CASE WHEN dns IS NOT NULL AND NOT list_contains({failed}, 'NS') AND len({ns}) > 0 THEN len(list_filter({ns}, lambda n: ends_with(n, '.ns.cloudflare.com'))) > 0 END::DOUBLE AS ns_cloudflare,
            CASE WHEN dns IS NOT NULL THEN dns.min_ttl END::DOUBLE AS min_ttl_s FROM host_capture""",
        "host_latest": "SELECT host, epoch_us(max(captured_at)) AS captured_us FROM host_capture GROUP BY 1",
        "host_facts": f"""SELECT capture_id, CASE WHEN {tri('dns.resolves', 'A')} = false AND len(list_filter(coalesce(dns.errors, []), lambda e: starts_with(e, 'AAAA:'))) > 0 THEN NULL ELSE {tri('dns.resolves', 'A')} END AS resolves,
            {tri('dns.mx_count > 0', 'MX')} AS has_mx, {tri('dns.spf', 'TXT')} AS has_spf, {tri('dns.dmarc', 'TXT')} AS has_dmarc, CASE WHEN tls IS NOT NULL THEN coalesce(tls.ok, false) END AS tls_ok, CASE WHEN {good} THEN coalesce(tls.verified, false) END AS tls_verified,
            CASE WHEN {good} AND tls.not_before IS NOT NULL THEN greatest(0, floor({days('captured_at', 'tls.not_before')}))::INT END AS cert_age_days,
            CASE WHEN {good} AND trim(coalesce(tls.issuer_o, '')) <> '' THEN contains(lower(tls.issuer_o), 'let''s encrypt') OR contains(lower(tls.issuer_o), 'zerossl') OR contains(lower(tls.issuer_o), 'buypass') END AS cert_free_issuer,
            CASE WHEN {good} THEN len(tls.sans)::INT END AS san_count FROM host_capture""",
        "host_eligibility": f"""SELECT CASE WHEN label IS NULL THEN 'no_label' WHEN regexp_matches(host, '{Q.IPV4}') THEN 'ip_host' WHEN dns IS NULL THEN 'no_dns' WHEN NOT coalesce(dns.resolves, false) THEN 'not_resolving'
            WHEN (epoch_us(captured_at) - epoch_us(first_seen)) / 3.6e9 > 24 THEN 'late_capture' ELSE 'kept' END AS step, label, count(*) AS n FROM host_capture GROUP BY 1, 2""",
        "host_counts_by_label": "SELECT coalesce(label::VARCHAR, 'missing') AS label, count(*) AS n_hosts, count(DISTINCT domain) AS n_domains, count(dns) AS with_dns, count(tls) AS with_tls, count(*) FILTER (coalesce(dns.resolves, false)) AS resolving FROM host_capture GROUP BY 1",
        "schema_violations": " UNION ALL ".join(
            f"SELECT '{rule}' AS rule, count(*) FILTER ({where}) AS n FROM interim"
            for rule, where in {
                "url null": "url IS NULL", "domain null": "domain IS NULL", "label null": "label IS NULL", "source null": "source IS NULL", "depth null": "depth IS NULL", "url empty": "url = ''",
                "domain empty": "domain = ''", "label not 0 or 1": "label NOT IN (0, 1)", "depth negative": "depth < 0",
            }.items()
        ),
        "corpus_url_dedup": KEYED + f", g AS (SELECT *, {best} AS rn, min(label) OVER (PARTITION BY k) AS lo, max(label) OVER (PARTITION BY k) AS hi FROM kk) SELECT uid FROM g WHERE rn = 1 AND (lo = hi OR lo IS NULL)",
        "corpus_shared_domains": f"WITH {Q.CORPUS} SELECT domain, count(DISTINCT source) AS n_sources FROM c WHERE label = 1 GROUP BY 1 HAVING count(DISTINCT source) > 1",
        "corpus_domain_owner": f"WITH {Q.CORPUS}, o AS (SELECT domain, source, row_number() OVER (PARTITION BY domain ORDER BY us NULLS LAST, {PRIO}, source) AS rn FROM c) SELECT domain, source FROM o WHERE rn = 1",
        "corpus_domain_cap": f"WITH {Q.CORPUS}, o AS (SELECT uid, row_number() OVER (PARTITION BY domain ORDER BY md5('42|' || uid), uid) AS rn FROM c) SELECT uid FROM o WHERE rn <= 20",
        "corpus_holdouts": f"""WITH {Q.CORPUS}, q AS (SELECT quantile_cont(us::DOUBLE, 0.9) AS cut FROM c WHERE source = 'live' AND us IS NOT NULL),
            m AS (SELECT uid, domain, CASE WHEN source IN ('natsites') THEN 'eval_only' WHEN source = '{HELDOUT}' THEN 'heldout_source' WHEN origin IN ('late_test') OR (source = 'live' AND us >= (SELECT cut FROM q)) THEN 'time_slice' ELSE 'pool' END AS part FROM c)
            SELECT uid, CASE WHEN part = 'pool' AND domain IN (SELECT domain FROM m WHERE part <> 'pool' AND domain IS NOT NULL) THEN 'holdout_domain_overlap' ELSE part END AS part FROM m""",
        "corpus_depth_table": f"""WITH {Q.CORPUS}, b AS (SELECT CASE WHEN depth >= 4 THEN '4+' ELSE depth::VARCHAR END AS bucket, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS phishing FROM c GROUP BY 1)
            SELECT bucket, benign, phishing, benign + phishing AS total, round_even(greatest(benign, phishing) / (benign + phishing)::DOUBLE, 4) AS majority_share, round_even(100 * benign / greatest(sum(benign) OVER (), 1)::DOUBLE, 2) AS benign_pct_of_class, round_even(100 * phishing / greatest(sum(phishing) OVER (), 1)::DOUBLE, 2) AS phishing_pct_of_class FROM b""",
        "corpus_balance_depth": f"""WITH {Q.CORPUS}, b AS (SELECT *, CASE WHEN depth >= 4 THEN '4+' ELSE depth::VARCHAR END AS bucket FROM c), n AS (SELECT bucket, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM b GROUP BY 1),
            pl AS (SELECT bucket, CASE WHEN n0 >= n1 THEN 0 ELSE 1 END AS major, floor(least(n0, n1) * (0.505::DOUBLE / (1 - 0.505::DOUBLE))) AS keep_n FROM n WHERE least(n0, n1) >= 20 AND greatest(n0, n1) / (n0 + n1)::DOUBLE > 0.505),
            r AS (SELECT b.uid, b.label, pl.major, pl.keep_n, row_number() OVER (PARTITION BY b.bucket, b.label ORDER BY md5('42|' || uid), uid) AS rn FROM b LEFT JOIN pl USING (bucket)) SELECT uid FROM r WHERE major IS NULL OR label <> major OR label IS NULL OR rn <= keep_n""",
        "corpus_part_summary": f"""WITH {Q.CORPUS} SELECT source, count(*) AS n_rows, count(DISTINCT domain) AS n_domains, round_even(100 * avg(label), 2) AS phishing_pct, round_even(100 * avg((html_simhash IS NOT NULL)::INT), 2) AS hashed_pct, min(us) AS first_us, max(us) AS last_us FROM c GROUP BY 1""",
        "split_grouped": _split_sql(),
        "split_leaks": f"""WITH {Q.CORPUS}, sp AS (SELECT DISTINCT row_id, split_0 AS part FROM splits WHERE split_0 IS NOT NULL), j AS (SELECT c.*, sp.part FROM c JOIN sp USING (row_id)), {Q.url_cte('j', 'domain, part')},
            e AS (SELECT 'domain' AS kind, domain AS key, part FROM p UNION ALL SELECT 'url', {Q.url_key()}, part FROM p) SELECT kind, key, count(DISTINCT part) AS n_parts FROM e GROUP BY 1, 2 HAVING count(DISTINCT part) > 1""",
        "metric_curves": curve + " SELECT source, round(CASE WHEN max(nn) > 0 AND max(np) > 0 THEN sum(neg * (tp - pos / 2.0)) / nullif(max(nn) * max(np), 0)::DOUBLE END, 9) AS roc_auc, round(CASE WHEN max(nn) > 0 AND max(np) > 0 THEN sum(pos * tp / nullif(tp + fp, 0)::DOUBLE) / nullif(max(np), 0)::DOUBLE END, 9) AS pr_auc FROM r GROUP BY 1",
        "metric_operating_points": curve + """, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tp DESC, score DESC) AS rn FROM r WHERE fp <= 0.05 * nn + 1e-9 * greatest(nn, 1) AND tp > 0), n AS (SELECT source, max(nn) AS nn, max(np) AS np FROM r GROUP BY 1)
            SELECT n.source, n.nn::BIGINT AS n_neg, floor(0.05 * n.nn) < 10 AS granularity_limited, CASE WHEN n.nn > 0 AND n.np > 0 THEN round(coalesce(o.tp, 0) / n.np::DOUBLE, 9) END AS recall, CASE WHEN n.nn > 0 AND n.np > 0 THEN round(coalesce(o.fp, 0) / n.nn::DOUBLE, 9) END AS achieved_fpr,
            CASE WHEN n.nn > 0 AND n.np > 0 THEN coalesce(o.score, 1.7976931348623157e308) END AS threshold FROM n LEFT JOIN o ON n.source = o.source AND o.rn = 1""",
        "metric_at_threshold": f"""WITH {SCORED}, g AS (SELECT source, count(*) AS n_urls, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = 1 AND score >= 0.6) AS tp, count(*) FILTER (label = 0 AND score >= 0.6) AS fp FROM s GROUP BY 1)
            SELECT *, round(tp / nullif(n_pos, 0)::DOUBLE, 9) AS recall, round(fp / nullif(n_neg, 0)::DOUBLE, 9) AS fpr, round(tp / nullif(tp + fp, 0)::DOUBLE, 9) AS "precision", round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + n_pos - tp)::DOUBLE ELSE 0 END, 9) AS f1 FROM g""",
        "metric_medians": f"WITH {SCORED} SELECT source, round(median(score), 9) AS score_median, round(min(score), 9) AS score_min, round(max(score), 9) AS score_max FROM s GROUP BY 1",
        "metric_depth_weights": f"""WITH {Q.CORPUS}, b AS (SELECT *, CASE WHEN depth >= 4 THEN '4+' ELSE depth::VARCHAR END AS bucket FROM c), n AS (SELECT bucket, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM b GROUP BY 1), g AS (SELECT *, n0 + n1 AS goal, sum(n0 + n1) OVER () AS al FROM n WHERE n0 > 0 AND n1 > 0)
            SELECT b.label, count(*) AS n, round(sum(coalesce(CASE WHEN label = 0 THEN goal / al / n0 WHEN label = 1 THEN goal / al / n1 END, 0)), 9) AS weight FROM b LEFT JOIN g USING (bucket) GROUP BY 1""",
        "split_folds": f"WITH {Q.CORPUS} SELECT uid, (('0x' || substr(md5('0|' || domain), 1, 8))::UBIGINT % 5)::INT AS fold FROM c",
        "metric_calibration": f"""WITH {SCORED}, b AS (SELECT source, least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS p, avg(label) AS y FROM s GROUP BY 1, 2), e AS (SELECT source, sum(n * abs(p - y)) / sum(n) AS ece FROM b GROUP BY 1),
            r AS (SELECT source, avg((score - label) ** 2) AS brier FROM s GROUP BY 1) SELECT e.source, round(ece, 9) AS ece, round(brier, 9) AS brier FROM e JOIN r USING (source)""",
        "metric_eta_squared": f"""WITH {SCORED}, m AS (SELECT label, avg(score) AS gm, count(*) AS gn FROM s GROUP BY 1), k AS (SELECT label, source, avg(score) AS sm, count(*) AS sn FROM s GROUP BY 1, 2),
            t AS (SELECT s.label, sum((score - gm) ** 2) AS total FROM s JOIN m USING (label) GROUP BY 1), b AS (SELECT k.label, sum(sn * (sm - gm) ** 2) AS between_ FROM k JOIN m USING (label) GROUP BY 1)
            SELECT round(sum(gn * CASE WHEN total > 0 THEN between_ / total ELSE 0 END) / sum(gn), 9) AS eta_squared FROM m JOIN t USING (label) JOIN b USING (label)""",
        "host_flags": f"""SELECT capture_id, lower(domain) IN ({", ".join(f"'{x}'" for x in word_lists.PLATFORMS)}) AS is_hosting_platform, regexp_matches(host, '{Q.IPV4}') AS is_ip, CASE WHEN len(coalesce(dns.a, [])) > 0 AND len(list_filter(dns.a, lambda x: x NOT IN ('0.0.0.0', '127.0.0.1', '::', '::1'))) = 0 THEN false ELSE dns.resolves END AS resolves,
            len(coalesce(dns.a, [])) > 0 AND len(list_filter(coalesce(dns.a, []), lambda x: x NOT IN ('0.0.0.0', '127.0.0.1', '::', '::1'))) = 0 AS filtered FROM host_capture""",
        "features_domain_tls": f"""SELECT capture_id, CASE WHEN tls IS NOT NULL THEN tls.ok END::DOUBLE AS tls_ok, CASE WHEN {good} THEN tls.verified END::DOUBLE AS tls_verified,
            CASE WHEN {cert} AND trim(coalesce(tls.issuer_o, '')) <> '' THEN contains(lower(tls.issuer_o), 'let''s encrypt') OR contains(lower(tls.issuer_o), 'zerossl') OR contains(lower(tls.issuer_o), 'buypass') END::DOUBLE AS cert_free_issuer,
            CASE WHEN {cert} THEN {days('tls.not_after', 'tls.not_before')} END AS cert_validity_days, CASE WHEN {cert} THEN {days('captured_at', 'tls.not_before')} END AS cert_age_days, CASE WHEN {cert} THEN {days('tls.not_after', 'captured_at')} END AS cert_days_left,
            CASE WHEN {cert} THEN len(tls.sans) END::DOUBLE AS cert_san_count, CASE WHEN {cert} THEN len(list_filter(list_append(coalesce(tls.sans, []), coalesce(tls.subject_cn, '')), lambda x: starts_with(x, '*.'))) > 0 END::DOUBLE AS cert_wildcard,
            CASE WHEN {cert} AND tls.subject_cn <> '' THEN lower(tls.subject_cn) = lower(host) OR (starts_with(tls.subject_cn, '*.') AND contains(host, '.') AND '*.' || regexp_replace(lower(host), '^[^.]*\\.', '') = lower(tls.subject_cn)) END::DOUBLE AS cert_cn_matches_host,
            CASE WHEN {cert} THEN len(list_filter(coalesce(tls.sans, []), lambda x: len(list_filter([{", ".join(f"'{b}'" for b in word_lists.Lists().brands)}], lambda b: b <> (CASE WHEN ({Q.suffix_size("regexp_replace(lower(x), '^[*][.]', '')")}) = 0 THEN regexp_replace(lower(x), '^[*][.]', '')
                ELSE coalesce(string_split(regexp_replace(lower(x), '^[*][.]', ''), '.')[-(({Q.suffix_size("regexp_replace(lower(x), '^[*][.]', '')")}) + 1)], '') END)
                AND len(list_filter(string_split(regexp_replace(lower(x), '^[*][.]', ''), '.'), lambda l: contains(l, b))) > 0)) > 0 AND NOT regexp_matches(x, '{Q.IPV4}'))) > 0 END::DOUBLE AS brand_in_cert_sans FROM host_capture""",
        "index_build": f"""WITH {Q.url_cte('feed_batch', 'label, source, batch_day', 'url IS NOT NULL')}, k AS (SELECT *, {Q.normalized()} AS url_norm FROM p) SELECT url_norm, max(label) AS label, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, min(label) <> max(label) AS label_conflict,
            epoch_us(min(batch_day)::TIMESTAMP) AS first_us, epoch_us(max(batch_day)::TIMESTAMP) AS last_us FROM k GROUP BY 1""",
        "index_merge": f"""WITH {Q.url_cte('feed_batch', 'label, source', 'url IS NOT NULL')}, b AS (SELECT {Q.normalized()} AS url_norm, max(label) AS label, min(label) AS lo, list(source) AS srcs FROM p GROUP BY 1)
            SELECT coalesce(i.url_norm, b.url_norm) AS url_norm, greatest(i.label, b.label) AS label, array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(coalesce(i.sources, ''), ','), lambda x: x <> ''), coalesce(b.srcs, [])))), ',') AS sources,
            CASE WHEN i.url_norm IS NOT NULL AND b.url_norm IS NOT NULL THEN i.label_conflict OR b.label <> b.lo OR i.label <> b.label ELSE coalesce(i.label_conflict, b.label <> b.lo) END AS label_conflict,
            CASE WHEN b.url_norm IS NOT NULL THEN epoch_us(TIMESTAMP '2030-01-01') ELSE epoch_us(i.last_seen) END AS last_us FROM feed_index i FULL JOIN b ON i.url_norm = b.url_norm""",
        "index_daily_counts": "SELECT source, (feed_time AT TIME ZONE 'UTC')::DATE::VARCHAR AS day, count(*) AS n FROM feed_batch WHERE feed_time IS NOT NULL GROUP BY 1, 2",
        "index_new_entries": "WITH f AS (SELECT source AS feed, url AS domain, min(batch_day) AS ts FROM feed_batch GROUP BY 1, 2), b AS (SELECT feed, min(ts) AS t0 FROM f GROUP BY 1) SELECT f.feed, f.domain, epoch_us(f.ts::TIMESTAMP) AS us FROM f JOIN b USING (feed) WHERE f.ts > b.t0",
        "capture_state": "WITH g AS (SELECT host, bool_or(coalesce(dns.resolves, false)) AS done, count(*) FILTER (NOT coalesce(dns.resolves, false)) AS failures FROM host_capture GROUP BY 1) SELECT *, NOT done AND failures < 3 AS retry FROM g",
        "short_link_domains": f"""WITH {Q.url_cte('interim', 'row_id')}, x AS (SELECT {Q.domain()} AS domain, list_filter(string_split(path, '/'), lambda t: t <> '') AS seg FROM p WHERE query = '') SELECT domain, count(*) AS n FROM x WHERE len(seg) = 1 AND length(seg[1]) <= 12 GROUP BY 1 HAVING count(*) >= 5""",
    }
