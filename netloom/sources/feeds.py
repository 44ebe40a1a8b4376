"""Parsers of feed files and API answers; each takes raw lines or documents as a DataFrame and gives typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import urls as U
from netloom.operators.positions import top_per_group


def feed_rows(df: DataFrame, url: Column, source: str, threat: str, label: int = 1, feed_time: Column | None = None, target: Column | None = None) -> DataFrame:
    return df.select(
        url.alias("url"), F.lit(source).alias("source"), F.lit(threat).alias("threat"), F.lit(label).cast("tinyint").alias("label"),
        (feed_time if feed_time is not None else F.lit(None).cast("timestamp")).alias("feed_time"), (target if target is not None else F.lit(None).cast("string")).alias("target"),
    )


def http_lines(lines: DataFrame, source: str) -> DataFrame:
    """One address a line; lines that don't start with http are skipped (``lines``: value)."""
    v = F.trim("value")
    return feed_rows(lines.where(F.lower(v).startswith("http")), v, source, "phishing")


def url_lines(lines: DataFrame, source: str) -> DataFrame:
    """One address a line; blank lines, comments and lines without a dot are skipped."""
    v = F.trim("value")
    return feed_rows(lines.where((v != "") & ~v.startswith("#") & F.contains("value", F.lit("."))), v, source, "phishing")


def verified_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """CSV with url, and where they exist verified, submission_time and target; verified rows only."""
    d = spark.read.options(header="true").csv(path)
    d = d.where(F.col("url").isNotNull())
    if "verified" in d.columns:
        d = d.where(F.lower("verified").isin("yes", "true", "1"))
    time = F.try_to_timestamp("submission_time") if "submission_time" in d.columns else None
    return feed_rows(d, F.col("url"), source, "phishing", 1, time, F.col("target") if "target" in d.columns else None)


# The nine columns of the commented feed.
COMMENTED = ("id", "dateadded", "url", "url_status", "last_online", "threat", "tags", "link", "reporter")


def commented_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Quoted CSV with comment lines; rows without exactly nine fields are dropped."""
    schema = ", ".join(f"{c} string" for c in COMMENTED) + ", extra string, _bad string"
    d = spark.read.schema(schema).options(comment="#", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").csv(path)
    ok = d.where(F.col("reporter").isNotNull() & F.col("extra").isNull())
    return feed_rows(ok, F.col("url"), source, "malware", 1, F.try_to_timestamp("dateadded"))


def domain_lines(lines: DataFrame) -> DataFrame:
    v = F.lower(F.trim("value"))
    return lines.where((v != "") & ~v.startswith("#") & ~F.contains(v, F.lit(" "))).select(v.alias("domain"))


def api_page(docs: DataFrame) -> DataFrame:
    """(url, date) of the JSON arrays in ``value``; entries without either are skipped."""
    rows = docs.select(F.explode(F.from_json("value", "array<struct<url: string, date: string>>")).alias("r"))
    out = rows.select(F.col("r.url"), F.try_to_timestamp("r.date").alias("date"))
    return out.where("url <> '' and date is not null")


def ranked_origins(lines: DataFrame, skip_rank: int, max_rank: int) -> DataFrame:
    """(host, rank) of ``origin,rank`` lines within the ranks: https, plain host names, the best rank of each."""
    origin, rank = F.regexp_extract("value", r"^\s*(.*),\d+\s*$", 1), F.regexp_extract("value", r",(\d{1,9})\s*$", 1)
    d = lines.where(rank != "").select(F.lower(F.regexp_extract(origin, r"^https://([^/]*)", 1)).alias("host"), rank.cast("int").alias("rank"))
    plain = (F.col("host") != "") & F.contains("host", F.lit(".")) & ~F.contains("host", F.lit(":")) & ~U.is_ip(F.col("host")) & F.col("host").rlike(r"^[a-z0-9.\-]+$")
    return d.where(plain & (F.col("rank") > skip_rank) & (F.col("rank") <= max_rank)).groupBy("host").agg(F.min("rank").alias("rank"))


def capture_index(lines: DataFrame) -> DataFrame:
    """(url) of the good html captures of a line-wise JSON index; bad lines are skipped."""
    r = F.from_json("value", "url string, status string, mime string")
    d = lines.select(r.alias("r")).where("r.url <> ''")
    return d.where((F.coalesce("r.status", F.lit("200")) == "200") & F.contains(F.coalesce("r.mime", F.lit("text/html")), F.lit("html"))).select(F.col("r.url").alias("url"))


def ranked_list(lines: DataFrame, top: int) -> DataFrame:
    """(rank, domain) of ``rank,domain`` lines, the first ``top`` by rank (a top-k report)."""
    d = lines.select(F.regexp_extract("value", r"^(\d+),", 1).alias("r"), F.lower(F.trim(F.regexp_extract("value", r"^\d+,(.*)$", 1))).alias("domain")).where("r <> '' and domain <> ''")
    return d.select(F.col("r").cast("bigint").alias("rank"), "domain").where(F.col("rank") <= top)


def deep_urls(df: DataFrame, per_host: int, seed: int) -> DataFrame:
    """Up to ``per_host`` page addresses of each host: http(s), no user or port, no downloads, at least one directory, one for each canonical form."""
    u = F.col("url")
    skip = r"(?i)\.(?:jpe?g|png|gif|svg|webp|ico|bmp|pdf|zip|gz|tgz|rar|7z|exe|apk|dmg|mp[34]|avi|mov|css|js|json|xml|txt|woff2?|ttf)$"
    d = df.where(U.scheme(u).isin("http", "https") & (U.port(u) == "") & (U.userinfo(u) == "") & ~U.path(u).rlike(skip) & (U.url_depth(u) >= 1))
    d = d.select(U.hostname(u).alias("host"), U.normalize_url(u).alias("canon")).distinct()
    return top_per_group(d, ["host"], [U.rank_hash(F.col("canon"), seed), F.col("canon")], per_host).select("host", "canon")


def same_site_links(pages: DataFrame) -> DataFrame:
    """(url, link): absolute links of a page to its own registrable domain, fragments dropped."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"'#]+)"""), 1)
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract("url", r"^(https?://[^/?#]+[^?#]*)", 1), r"(?<!/)/[^/]*$", "")
    d = pages.select("url", base.alias("base"), folder.alias("folder"), F.explode(hrefs).alias("h"))
    link = F.when(F.col("h").rlike("^https?://"), F.col("h")).when(F.col("h").startswith("//"), F.concat(F.regexp_extract("base", "^(https?:)", 1), "h")).when(F.col("h").startswith("/"), F.concat("base", "h")).when(F.col("h").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None)).otherwise(F.concat("folder", F.lit("/"), "h"))
    d = d.select("url", link.alias("link")).where("link is not null")
    return d.where(U.registered_domain(F.col("link")) == U.registered_domain(F.col("url"))).distinct()


def capture_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hosts, domains) of line-wise JSON captures; bad lines are skipped."""
    from netloom.schema import DOMAIN_RECORD, HOST_RECORD

    lines = spark.read.text(path)
    kind = F.get_json_object("value", "$.kind")
    read = lambda k, schema: lines.where(kind == k).select(F.from_json("value", schema).alias("r")).where("r.kind is not null").select("r.*")
    return read("host", HOST_RECORD), read("domain", DOMAIN_RECORD)


def rdap_record(doc: Column) -> Column:
    """Registration struct of an RDAP JSON document."""
    r = F.from_json(doc, "events array<struct<eventAction: string, eventDate: string>>, status array<string>, entities array<struct<roles: array<string>, handle: string>>, redacted array<string>, remarks array<struct<title: string>>")
    event = lambda name: F.try_to_timestamp(F.get(F.filter(r["events"], lambda e: F.lower(e["eventAction"]) == name), F.lit(0))["eventDate"])
    hidden = F.exists(F.coalesce(r["remarks"], F.array()), lambda x: F.lower(x["title"]).rlike("redact|privacy"))
    return F.struct(
        event("registration").alias("registered"), event("expiration").alias("expires"), event("last changed").alias("last_changed"), r["status"].alias("status"),
        ((F.coalesce(F.size(r["redacted"]), F.lit(0)) > 0) | hidden).alias("redacted"),
        F.get(F.filter(r["entities"], lambda e: F.array_contains(e["roles"], "registrar")), F.lit(0))["handle"].alias("registrar"),
    )


def rdap_servers(doc: Column) -> Column:
    """Array of (tld, server) from a bootstrap document."""
    s = F.from_json(doc, "services array<array<array<string>>>")["services"]
    return F.flatten(F.transform(s, lambda pair: F.transform(pair[0], lambda tld: F.struct(F.lower(tld).alias("tld"), pair[1][0].alias("server")))))


def certificate(doc: Column) -> Column:
    """Struct of a certificate's JSON: issuer, subject, validity and names."""
    c = F.from_json(doc, "subject array<array<array<string>>>, issuer array<array<array<string>>>, notBefore string, notAfter string, subjectAltName array<array<string>>")
    name = lambda parts, key: F.get(F.filter(F.flatten(parts), lambda kv: kv[0] == key), F.lit(0))[1]
    time = lambda t: F.try_to_timestamp(F.regexp_replace(t, r"\s+", " "), F.lit("MMM d HH:mm:ss yyyy z"))
    sans = F.transform(F.filter(c["subjectAltName"], lambda x: x[0] == "DNS"), lambda x: x[1])
    return F.struct(
        name(c["subject"], "commonName").alias("subject_cn"), name(c["issuer"], "organizationName").alias("issuer_o"), name(c["issuer"], "commonName").alias("issuer_cn"),
        time(c["notBefore"]).alias("not_before"), time(c["notAfter"]).alias("not_after"), sans.alias("sans"), F.size(sans).alias("san_count"),
    )


def dns_record(doc: Column) -> Column:
    """DNS struct of captured answers: record sets, smallest TTL, mail policies, errors."""
    r = F.from_json(doc, "answers map<string, struct<ttl: int, values: array<string>>>, errors array<string>")
    values = lambda k: F.coalesce(F.try_element_at(r["answers"], F.lit(k))["values"], F.array().cast("array<string>"))
    return F.struct(
        F.coalesce(r["errors"], F.array().cast("array<string>")).alias("errors"), values("A").alias("a"), values("AAAA").alias("aaaa"), values("CNAME").alias("cname"), values("NS").alias("ns"),
        F.size(values("MX")).alias("mx_count"), F.exists(values("TXT"), lambda t: F.lower(t).startswith("v=spf1")).alias("spf"), F.exists(values("DMARC"), lambda t: F.lower(t).startswith("v=dmarc1")).alias("dmarc"),
        F.array_min(F.transform(F.map_values(r["answers"]), lambda x: x["ttl"])).alias("min_ttl"), ((F.size(values("A")) > 0) | (F.size(values("AAAA")) > 0)).alias("resolves"),
    )


def phishing_urls(df: DataFrame) -> DataFrame:
    """(url) of a parquet or csv list: rows labelled 1 or of threat phishing, or all where it says neither."""
    keep = F.lit(False)
    for c, test in (("label", lambda: F.col("label").cast("string") == "1"), ("threat", lambda: F.col("threat") == "phishing")):
        if c in df.columns:
            keep = keep | F.coalesce(test(), F.lit(False))
    d = df.where(keep) if {"label", "threat"} & set(df.columns) else df
    return d.where(F.trim("url") != "").select("url")


def short_link_domains(urls: DataFrame, max_token: int = 10, least: int = 5) -> DataFrame:
    """(domain, n) of domains with many addresses of one short path token and no query."""
    u = F.col("url")
    d = urls.where((U.query(u) == "") & (U.url_depth(u) == 1) & (F.length(F.get(U.segments(u), F.lit(0))) <= max_token))
    return d.groupBy(U.registered_domain(u).alias("domain")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def shortener_verdicts(answers: DataFrame, min_answered: int = 5, min_share: float = 0.8) -> DataFrame:
    """(domain, is_shortener) of probed short links (domain, url, status, location): most answers lead elsewhere."""
    away = F.col("status").between(300, 399) & (U.registered_domain(F.col("location")) != U.registered_domain(F.col("url")))
    d = answers.groupBy("domain").agg(F.count("status").alias("answered"), F.count_if(away).alias("away"))
    return d.select("domain", ((F.col("answered") >= min_answered) & (F.col("away") / F.nullif(F.col("answered").cast("double"), F.lit(0.0)) >= min_share)).alias("is_shortener"))
