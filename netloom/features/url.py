"""The 99 features of an address, as expressions over its parsed parts.

A missing value is null, never NaN.  The address is put into one form first:
no scheme, no ``www.``, no fragment, no final slash, a lower-case host, and the
domain of a hosting platform replaced by a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.features.lists import Lists
from netloom.functions import urls as U
from netloom.plans.stages import once

PLATFORM_TOKEN = "platform.example"
COUNTED = {
    "dot": ".", "hyphen": "-", "underscore": "_", "slash": "/", "at": "@", "qmark": "?", "and": "&", "eq": "=", "percent": "%",
    "tilde": "~", "plus": "+", "star": "*", "colon": ":", "comma": ",", "semicolon": ";", "dollar": "$", "pipe": "|", "space": " ",
}
CONSONANT = "[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]+"


def parse(df: DataFrame, url: str = "url", lists: Lists | None = None) -> DataFrame:
    """``df`` with the parts canon, host, port, userinfo, path, query, subdomain, label, suffix, is_ip, is_platform.

    All parts are null for a url without a host.
    """
    lists = lists or Lists()
    s = F.regexp_replace(F.regexp_replace(F.col(url), r"^[ \t\r\n]+|[ \t\r\n]+$", ""), r"(?s)#.*$", "")
    df = once(df, _s=F.regexp_replace(s, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""))
    whole = F.regexp_extract("_s", r"^([^/?]*)", 1)
    df = once(df, _rest=F.regexp_replace("_s", r"^[^/?]*", ""), userinfo=F.regexp_extract(whole, r"(?s)^(.*)@", 1), _a=F.regexp_replace(whole, r"(?s)^.*@", ""))
    bracket = F.col("_a").startswith("[")
    host = F.when(bracket, F.regexp_extract("_a", r"^(\[[^\]]*\]?)", 1)).otherwise(F.regexp_replace("_a", r":[0-9]+$", ""))
    host = F.regexp_replace(F.lower(host), r"\.+$", "")
    df = once(
        df,
        port=F.regexp_extract("_a", r":([0-9]+)$", 1),
        host=F.when(host.rlike(r"[\p{L}\p{N}]"), F.regexp_replace(host, r"^www\.", "")),
        path=F.regexp_replace(F.regexp_extract("_rest", r"(?s)^([^?]*)", 1), r"/+$", ""),
        query=F.regexp_extract("_rest", r"(?s)^[^?]*\?(.*)$", 1),
    )
    df = once(df, is_ip=U.is_ip(F.col("host")), _p=U.split_host(F.col("host")))
    df = df.withColumn("is_platform", ~F.col("is_ip") & (F.col("_p.suffix") != "") & F.concat("_p.label", F.lit("."), "_p.suffix").isin(list(lists.platforms) or [""]))
    masked = F.when(F.col("_p.subdomain") != "", F.concat("_p.subdomain", F.lit("." + PLATFORM_TOKEN))).otherwise(F.lit(PLATFORM_TOKEN))
    df = once(df, host=F.when(F.col("is_platform"), masked).otherwise(F.col("host")))
    df = once(df, _p=U.split_host(F.col("host")))
    joined = F.concat(
        F.when(F.col("userinfo") != "", F.concat("userinfo", F.lit("@"))).otherwise(""), "host",
        F.when(F.col("port") != "", F.concat(F.lit(":"), "port")).otherwise(""), "path",
        F.when(F.col("query") != "", F.concat(F.lit("?"), "query")).otherwise(""),
    )
    return df.select("*", F.col("_p.subdomain"), F.col("_p.label"), F.col("_p.suffix"), joined.alias("canon")).drop("_s", "_rest", "_a", "_p")


def _flag(c: Column) -> Column:
    return c.cast("double")


def _num(c: Column) -> Column:
    return c.cast("double")


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-zKİ]", ""))


def _digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def length_features() -> dict[str, Column]:
    c = F.col
    domain = F.when(c("suffix") != "", F.concat("label", F.lit("."), "suffix")).otherwise(c("label"))
    out = {"url_len": F.length("canon"), "host_len": F.length("host"), "domain_len": F.length(domain), "subdomain_len": F.length("subdomain"), "path_len": F.length("path"), "query_len": F.length("query"), "tld_len": F.length("suffix")}
    for scope, name in (("url", "canon"), ("host", "host"), ("path", "path")):
        sizes = F.transform(U.words(c(name)), lambda w: F.length(w))
        out |= {f"shortest_word_{scope}": F.array_min(sizes), f"longest_word_{scope}": F.array_max(sizes)}
        out[f"avg_word_{scope}"] = _ratio(F.aggregate(sizes, F.lit(0), lambda a, x: a + x), F.size(sizes))
    return {k: _num(v) for k, v in out.items()}


def count_features() -> dict[str, Column]:
    c = F.col
    out = {f"n_{k}": U.count_of(c("canon"), ch) for k, ch in COUNTED.items()}
    tokens = F.concat(U.words(c("host")), U.words(c("path")))
    out |= {
        "host_n_dot": U.count_of(c("host"), "."),
        "host_n_hyphen": U.count_of(c("host"), "-"),
        "n_digits": _digits(c("canon")),
        "n_letters": _letters(c("canon")),
        "n_subdomain_levels": F.when(c("subdomain") == "", F.lit(0)).otherwise(U.count_of(c("subdomain"), ".") + 1),
        "path_depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
        "n_query_params": F.size(F.filter(F.split("query", "&"), lambda s: s != "")),
        "n_www_tokens": F.size(F.filter(tokens, lambda w: w == "www")),
        "n_com_tokens": F.size(F.filter(tokens, lambda w: w == "com")),
    }
    return {k: _num(F.when(c("host").isNotNull(), v)) for k, v in out.items()}


def ratio_features() -> dict[str, Column]:
    out = {}
    for scope, name in (("url", "canon"), ("host", "host")):
        t = F.col(name)
        out[f"digit_ratio_{scope}"] = _ratio(_digits(t), F.length(t))
        out[f"letter_ratio_{scope}"] = _ratio(_letters(t), F.length(t))
        out[f"special_ratio_{scope}"] = _ratio(F.length(t) - _digits(t) - _letters(t), F.length(t))
    return out


def host_form_features() -> dict[str, Column]:
    c = F.col
    labels = F.split("subdomain", r"\.")
    tld = F.element_at(F.split("suffix", r"\."), -1)
    ext = F.regexp_extract(F.lower(F.element_at(F.split("path", "/"), -1)), r"\.([a-z0-9]{1,5})$", 1)
    low = F.lower("path")
    out = {
        "host_is_ip": c("is_ip"),
        "host_ip_obfuscated": U.ip_obfuscated(c("host")),
        "has_port": c("port") != "",
        "nonstandard_port": ~c("port").isin("", "80", "443"),
        "has_userinfo": c("userinfo") != "",
        "has_punycode": F.contains("host", F.lit("xn--")),
        "has_non_ascii_host": c("host").rlike(r"[^\x00-\x7F]"),
        "https_in_host": F.contains("host", F.lit("https")),
        "http_in_path": F.contains(low, F.lit("http")),
        "www_in_path": F.contains(low, F.lit("www")),
        "www_misplaced_host": F.array_contains(F.split("host", r"\."), "www"),
        "double_slash_in_path": F.contains("path", F.lit("//")),
        "tld_in_path": (tld != "") & F.array_contains(U.words(c("path")), tld),
        "tld_in_subdomain": (tld != "") & F.array_contains(labels, tld),
        "abnormal_subdomain": (F.size(labels) > 3) | F.exists(labels, lambda x: F.length(x) > 25),
        "prefix_suffix_hyphen": F.contains("label", F.lit("-")),
        "path_ext_present": ext != "",
        "path_ext_is_script": ext.isin("php", "asp", "aspx", "jsp", "cgi"),
        "path_ext_is_html": ext.isin("html", "htm", "shtml"),
    }
    return {k: _flag(F.when(c("host").isNotNull(), v)) for k, v in out.items()}


def obfuscation_features() -> dict[str, Column]:
    t = F.col("canon")
    pct = F.regexp_count(t, F.lit("%[0-9a-fA-F]{2}"))
    return {
        "n_pct_encoded": _num(pct),
        "pct_encoded_ratio": _ratio(3 * pct, F.length(t)),
        "longest_repeat_run": _num(F.when(t.isNotNull(), U.repeat_run(t))),
        "char_continuation_rate": _ratio(U.longest_match(t, "[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"), F.length(t)),
        "n_non_ascii_url": _num(F.length(F.regexp_replace(t, r"[\x00-\x7F]", ""))),
    }


def randomness_features() -> dict[str, Column]:
    t = F.col("label")
    vowels = F.length(F.regexp_replace(t, "[^aeiouAEIOU]", ""))
    return {
        "entropy_url": U.entropy(F.col("canon")),
        "entropy_domain": U.entropy(t),
        "domain_longest_consonant_run": _num(F.when(t.isNotNull(), U.longest_match(t, CONSONANT))),
        "domain_vowel_ratio": _ratio(vowels, _letters(t)),
        "domain_digit_switches": _num(F.regexp_count(t, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"))),
    }


def word_features(lists: Lists) -> dict[str, Column]:
    c = F.col
    path, query = F.lower("path"), F.lower("query")
    exact = c("label").isin(list(lists.brands) or [""])
    out = {
        "n_suspicious_keywords": U.hits(F.concat("host", F.lit("/"), path, F.lit("?"), query), lists.keywords),
        "kw_in_host": U.hits(c("host"), lists.keywords),
        "kw_in_path": U.hits(path, lists.keywords),
        "kw_in_query": U.hits(query, lists.keywords),
        "brand_in_subdomain": U.hits(c("subdomain"), lists.brands),
        "brand_in_path": U.hits(path, lists.brands),
        "domain_is_brand": exact,
        "domain_contains_brand": (c("label") != "") & ~exact & (U.hits(c("label"), lists.brands) > 0),
    }
    return {k: _num(F.when(c("host").isNotNull(), v)) for k, v in out.items()}


def squatting_features(lists: Lists) -> dict[str, Column]:
    """Distance and look-alike tests against the brands; null for addresses and where there are no brands."""
    c = F.col
    usable = ~c("is_ip") & (c("label") != "") if lists.brands else F.lit(False)
    brands = F.array(*[F.lit(b) for b in lists.brands]) if lists.brands else F.array().cast("array<string>")
    distance = F.array_min(F.transform(brands, lambda b: F.levenshtein(c("label"), b)))
    parts = F.filter(F.split(F.replace("label", F.lit("_"), F.lit("-")), "-"), lambda x: x != "")
    known = lambda x: F.array_contains(brands, x) | F.array_contains(brands, U.normalise_homoglyphs(x))
    n = F.size(parts)
    inner = F.exists(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), known)
    out = {
        "min_brand_edit_distance": F.least(F.lit(3), distance),
        "homoglyph_brand_match": F.exists(parts, lambda x: (U.normalise_homoglyphs(x) != x) & F.array_contains(brands, U.normalise_homoglyphs(x))),
        "combosquat_prefix": (n > 1) & F.exists(F.slice(parts, 1, 1), known),
        "combosquat_suffix": (n > 1) & F.exists(F.slice(parts, F.greatest(n, F.lit(1)), F.lit(1)), known),
        "combosquat_middle": (n > 2) & inner,
    }
    return {k: _num(F.when(usable, v)) for k, v in out.items()}


def other_features(lists: Lists) -> dict[str, Column]:
    c = F.col
    tail = F.lower(F.concat("path", F.lit("?"), "query"))
    domain = F.when(c("suffix") != "", F.concat("label", F.lit("."), "suffix")).otherwise(c("label"))
    keys = F.transform(F.filter(F.split("query", "&"), lambda kv: kv != ""), lambda kv: F.lower(F.substring_index(kv, "=", 1)))
    out = {
        "is_shortener": domain.isin(list(lists.shorteners) or [""]),
        "has_redirect_param": F.arrays_overlap(keys, F.array(*[F.lit(x) for x in lists.redirect_fields])),
        "has_embedded_url": tail.rlike("https?(?:://|%3a%2f%2f|%253a%252f%252f)"),
        "has_embedded_email": tail.rlike(r"[a-z0-9._+\-]+@[a-z0-9\-]+\.[a-z]{2,}"),
        "suspicious_tld": F.element_at(F.split("suffix", r"\."), -1).isin(list(lists.suspicious_tlds) or [""]),
        "is_hosting_platform": c("is_platform"),
    }
    return {k: _flag(F.when(c("host").isNotNull(), v)) for k, v in out.items()}


def features(df: DataFrame, key: str = "row_id", url: str = "url", lists: Lists | None = None) -> DataFrame:
    """(key, features but for the two fitted ones) of each row."""
    lists = lists or Lists()
    groups = [length_features(), count_features(), ratio_features(), host_form_features(), obfuscation_features(), randomness_features(), word_features(lists), squatting_features(lists), other_features(lists)]
    p = parse(df.select(key, url), url, lists)
    return p.select(key, *[v.alias(k) for g in groups for k, v in g.items()])


def fit(df: DataFrame, url: str = "url", label: str = "label", smoothing: float = 1.0, lists: Lists | None = None) -> tuple[DataFrame, DataFrame]:
    """(bigram, logprob) from benign labels, with the floor under "", and (suffix, risk), with the base rate under ""."""
    p = parse(df.select(url, F.col(label).alias("_y")), url, lists).where("host is not null and not is_ip and suffix <> ''")
    grams = p.where("_y = 0 and not is_platform and length(label) > 1").select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("label") - 1), lambda i: F.substring("label", i, F.lit(2)))).alias("bigram")
    ).groupBy("bigram").agg(F.count("*").alias("n"))
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("vocab"))
    denominator = F.col("total") + smoothing * (F.col("vocab") + 1)
    with_total = grams.unionByName(grams.sparkSession.createDataFrame([("", 0)], "bigram string, n bigint")).join(F.broadcast(total))
    bigrams = with_total.select("bigram", F.round(F.log((F.col("n") + smoothing) / denominator), 5).alias("logprob"))
    tlds = p.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("_y").alias("bad"))
    base = tlds.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("base"))
    risk = tlds.join(F.broadcast(base)).select("suffix", F.round((F.col("bad") + smoothing * F.col("base")) / (F.col("n") + smoothing), 5).alias("risk"))
    return bigrams, risk.unionByName(base.select(F.lit("").alias("suffix"), F.round("base", 5).alias("risk")))


def fitted_features(df: DataFrame, bigrams: DataFrame, risk: DataFrame, key: str = "row_id", url: str = "url", lists: Lists | None = None) -> DataFrame:
    """(key, bigram_loglik_domain, tld_risk); both tables have as many rows as bigrams and suffixes, so they are broadcast."""
    p = parse(df.select(key, url), url, lists).select(key, "label", "suffix", "is_ip")
    floor = bigrams.where("bigram = ''").select(F.col("logprob").alias("floor"))
    labels = p.where("length(label) > 1").select("label").distinct()
    pairs = labels.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("label") - 1), lambda i: F.substring("label", i, F.lit(2)))).alias("bigram"))
    scored = pairs.join(F.broadcast(bigrams.where("bigram <> ''")), "bigram", "left").join(F.broadcast(floor)).groupBy("label").agg(F.avg(F.coalesce("logprob", "floor")).alias("bigram_loglik_domain"))
    base = risk.where("suffix = ''").select(F.col("risk").alias("base"))
    out = p.join(scored, "label", "left").join(F.broadcast(risk.where("suffix <> ''")), "suffix", "left").join(F.broadcast(base))
    return out.select(key, "bigram_loglik_domain", F.when(~F.col("is_ip") & (F.col("suffix") != ""), F.coalesce("risk", "base")).alias("tld_risk"))
