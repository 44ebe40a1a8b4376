"""Registration, DNS and TLS features of captured hosts (29), facts, rule signals and risk.

The capture columns are structs; a field that a table's struct doesn't have
counts as null.  A value whose lookup failed is null, never zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.features.lists import Lists
from netloom.functions import urls as U

# Certificate issuers without charge, states that hold a domain, and sinkhole addresses.
FREE_ISSUERS = ("let's encrypt", "zerossl", "buypass")
HOLD_STATES = ("clienthold", "serverhold")
SINKHOLES = ("0.0.0.0", "127.0.0.1", "::", "::1")
LOOKUP_ERRORS = ("gaierror",)


def _field(df: DataFrame, struct: str, name: str, kind: str) -> Column:
    """A field of a struct column, or a typed null where the table has none."""
    if struct in df.columns:
        t = df.schema[struct].dataType
        if isinstance(t, T.StructType) and name in t.names:
            return F.col(struct)[name].cast(kind)
    return F.lit(None).cast(kind)


def days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(8.64e10)


def _d(c: Column) -> Column:
    return c.cast("double")


def registration_features(df: DataFrame) -> dict[str, Column]:
    f = lambda n, t: _field(df, "rdap", n, t)
    have = F.col("rdap").isNotNull() if "rdap" in df.columns else F.lit(False)
    error = F.col("rdap_error") if "rdap_error" in df.columns else F.lit(None).cast("string")
    now = F.col("captured_at")
    status = F.transform(f("status", "array<string>"), lambda s: F.replace(F.lower(s), F.lit(" "), F.lit("")))
    return {
        "domain_age_days": days(now, f("registered", "timestamp")),
        "days_to_expiry": days(f("expires", "timestamp"), now),
        "registration_length_days": days(f("expires", "timestamp"), f("registered", "timestamp")),
        "days_since_rdap_change": days(now, f("last_changed", "timestamp")),
        "rdap_found": F.when(have, 1.0).when(error.isin("not_found", "no_server"), 0.0),
        "whois_redacted": _d(f("redacted", "boolean")),
        "rdap_status_count": _d(F.when(have, F.coalesce(F.size(status), F.lit(0)))),
        "rdap_client_hold": _d(F.when(have, F.coalesce(F.exists(status, lambda s: s.rlike("|".join(HOLD_STATES))), F.lit(False)))),
    }


def filtered(df: DataFrame) -> Column:
    """All addresses are sinkholes: somebody's resolver answered, not the host's DNS."""
    every = F.concat(F.coalesce(_field(df, "dns", "a", "array<string>"), F.array()), F.coalesce(_field(df, "dns", "aaaa", "array<string>"), F.array()))
    return (F.size(every) > 0) & F.forall(every, lambda x: x.isin(*SINKHOLES))


def dns_failed(df: DataFrame) -> Column:
    errors = F.coalesce(_field(df, "dns", "errors", "array<string>"), F.array())
    return F.exists(errors, lambda e: e.startswith("A:")) & F.exists(errors, lambda e: e.startswith("AAAA:"))


def dns_features(df: DataFrame) -> dict[str, Column]:
    f = lambda n, t: _field(df, "dns", n, t)
    there = F.col("dns").isNotNull() & ~filtered(df)
    failed = F.transform(F.coalesce(f("errors", "array<string>"), F.array()), lambda e: F.upper(F.substring_index(e, ":", 1)))
    unless = lambda kind, v: F.when(there & ~F.array_contains(failed, kind), v)
    count = lambda n: F.coalesce(F.size(f(n, "array<string>")), F.lit(0))
    ns = F.transform(F.coalesce(f("ns", "array<string>"), F.array()), lambda x: F.regexp_replace(F.lower(x), r"\.+$", ""))
    has_ns = unless("NS", F.size(ns) > 0)
    mx = unless("MX", f("mx_count", "int"))
    own = F.lower(F.coalesce("domain", U.domain_of_host(F.lower("host"))))
    return {
        "n_a": _d(unless("A", count("a"))),
        "n_aaaa": _d(unless("AAAA", count("aaaa"))),
        "has_cname": _d(unless("CNAME", count("cname") > 0)),
        "mx_count": _d(mx),
        "has_mx": _d(mx > 0),
        "has_spf": _d(unless("TXT", f("spf", "boolean"))),
        "has_dmarc": _d(unless("TXT", f("dmarc", "boolean"))),
        "n_ns": _d(unless("NS", F.size(ns))),
        "ns_in_own_domain": _d(F.when(has_ns, F.exists(ns, lambda n: U.domain_of_host(n) == own))),
        "ns_cloudflare": _d(F.when(has_ns, F.exists(ns, lambda n: n.endswith(".ns.cloudflare.com")))),
        "min_ttl_s": _d(F.when(there, f("min_ttl", "int"))),
    }


def cn_matches(cn: Column, host: Column) -> Column:
    """The name itself, or a wildcard over exactly one label."""
    cn, host = F.regexp_replace(F.lower(cn), r"\.+$", ""), F.regexp_replace(F.lower(host), r"\.+$", "")
    rest = F.regexp_replace(host, r"^[^.]*\.", "")
    return (cn == host) | (cn.startswith("*.") & F.contains(host, F.lit(".")) & ~host.startswith(".") & (F.concat(F.lit("*."), rest) == cn))


def brand_in_sans(sans: Column, brands: Sequence[str]) -> Column:
    """A brand inside a label of a name that isn't the brand's own."""
    if not brands:
        return F.when(sans.isNotNull(), F.lit(False))
    names = F.filter(F.transform(sans, lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), r"\.+$", ""), r"^\*\.", "")), lambda s: (s != "") & ~U.is_ip(s))
    known = F.array(*[F.lit(b) for b in brands])
    return F.exists(names, lambda s: F.exists(known, lambda b: (b != U.split_host(s)["label"]) & F.exists(F.split(s, r"\."), lambda x: F.contains(x, b))))


def tls_features(df: DataFrame, lists: Lists | None = None) -> dict[str, Column]:
    lists = lists or Lists()
    f = lambda n, t: _field(df, "tls", n, t)
    ok = f("ok", "boolean")
    there = F.col("tls").isNotNull() & ~filtered(df) & ~(~F.coalesce(ok, F.lit(False)) & F.coalesce(f("error", "string").isin(*LOOKUP_ERRORS), F.lit(False)))
    good = there & F.coalesce(ok, F.lit(False))
    named = F.coalesce(f("issuer_o", "string"), f("issuer_cn", "string"), f("not_before", "string"), f("subject_cn", "string")).isNotNull()
    cert = good & F.coalesce(f("verified", "boolean"), F.lit(False)) & named
    issuer = F.lower(F.concat_ws(" ", F.coalesce(f("issuer_o", "string"), F.lit("")), F.coalesce(f("issuer_cn", "string"), F.lit(""))))
    start, end, now, cn = f("not_before", "timestamp"), f("not_after", "timestamp"), F.col("captured_at"), f("subject_cn", "string")
    sans = F.coalesce(f("sans", "array<string>"), F.array().cast("array<string>"))
    n_sans = F.coalesce(f("san_count", "int"), F.when(f("sans", "array<string>").isNotNull(), F.size(sans)))
    return {
        "tls_ok": _d(F.when(there, ok)),
        "tls_verified": _d(F.when(good, f("verified", "boolean"))),
        "cert_free_issuer": _d(F.when(cert & (F.trim(issuer) != ""), F.exists(F.array(*[F.lit(x) for x in FREE_ISSUERS]), lambda x: F.contains(issuer, x)))),
        "cert_validity_days": F.when(cert, days(end, start)),
        "cert_age_days": F.when(cert, days(now, start)),
        "cert_days_left": F.when(cert, days(end, now)),
        "cert_san_count": _d(F.when(cert, n_sans)),
        "cert_wildcard": _d(F.when(cert, F.exists(F.concat(sans, F.array(F.coalesce(cn, F.lit("")))), lambda s: F.coalesce(s.startswith("*."), F.lit(False))))),
        "cert_cn_matches_host": _d(F.when(cert & (cn != ""), cn_matches(cn, F.col("host")))),
        "brand_in_cert_sans": _d(F.when(cert, brand_in_sans(sans, lists.brands))),
    }


def features(df: DataFrame, key: str = "capture_id", lists: Lists | None = None) -> DataFrame:
    every = registration_features(df) | dns_features(df) | tls_features(df, lists)
    return df.select(key, *[v.alias(k) for k, v in every.items()])


def host_flags(df: DataFrame, key: str = "capture_id", lists: Lists | None = None) -> DataFrame:
    lists = lists or Lists()
    return df.select(
        key,
        F.lower("domain").isin(*lists.platforms).alias("is_hosting_platform"),
        U.is_ip(F.col("host")).alias("is_ip"),
        F.when(filtered(df), F.lit(False)).otherwise(_field(df, "dns", "resolves", "boolean")).alias("resolves"),
        F.coalesce(filtered(df), F.lit(False)).alias("filtered"),
    )


def latest_hosts(df: DataFrame, key: str = "host", at: str = "captured_at") -> DataFrame:
    """The newest record of each host; repeated rows give one."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col(at), F.xxhash64(*[F.to_json(c) if isinstance(df.schema[c].dataType, T.StructType) else F.col(c) for c in others]))).alias("r")).select(key, "r.*")


def pick_domain_record(df: DataFrame) -> DataFrame:
    """Per domain the newest record with registration data, else the newest."""
    others = [c for c in df.columns if c != "domain"]
    return df.groupBy("domain").agg(F.max_by(F.struct(*others), F.struct(F.col("rdap").isNotNull(), F.col("captured_at"))).alias("r")).select("domain", "r.*")


def with_domain_records(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    d = pick_domain_record(domains).select("domain", "rdap", "rdap_error")
    return latest_hosts(hosts).join(d, "domain", "left")


def _since(t: Column, now: Column) -> Column:
    # greatest() passes over nulls: an unknown time has no age
    return F.when(t.isNotNull() & now.isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(t)) / F.lit(86_400_000_000)))).cast("int")


def facts(df: DataFrame, now: Column | None = None) -> DataFrame:
    """The facts of each capture; true, false, or null where a lookup failed."""
    now = F.col("captured_at") if now is None else now
    f = lambda s, n, t: _field(df, s, n, t)
    errors = F.coalesce(f("dns", "errors", "array<string>"), F.array())
    tri = lambda present, kind: F.when(F.col("dns").isNull(), F.lit(None)).when(F.coalesce(present, F.lit(False)), F.lit(True)).when(F.exists(errors, lambda e: e.startswith(kind + ":")), F.lit(None)).otherwise(F.lit(False))
    a = tri(f("dns", "resolves", "boolean"), "A")
    aaaa_failed = F.exists(errors, lambda e: e.startswith("AAAA:"))
    ok = f("tls", "ok", "boolean")
    issuer = F.lower(F.concat_ws(" ", F.coalesce(f("tls", "issuer_o", "string"), F.lit("")), F.coalesce(f("tls", "issuer_cn", "string"), F.lit(""))))
    good = F.coalesce(ok, F.lit(False))
    registered = f("rdap", "registered", "timestamp")
    rdap = F.col("rdap").isNotNull() if "rdap" in df.columns else F.lit(False)
    error = F.col("rdap_error") if "rdap_error" in df.columns else F.lit(None).cast("string")
    return df.select(
        *[c for c in ("capture_id", "host", "domain", "label", "first_seen", "captured_at") if c in df.columns],
        F.when(rdap, F.lit(True)).when(error == "not_found", F.lit(False)).alias("registered"),
        _since(registered, now).alias("age_days"),
        F.when(~a & aaaa_failed, F.lit(None)).otherwise(a).alias("resolves"),
        tri(f("dns", "mx_count", "int") > 0, "MX").alias("has_mx"),
        tri(f("dns", "spf", "boolean"), "TXT").alias("has_spf"),
        tri(f("dns", "dmarc", "boolean"), "TXT").alias("has_dmarc"),
        F.when(F.col("tls").isNotNull(), good).alias("tls_ok"),
        F.when(good, F.coalesce(f("tls", "verified", "boolean"), F.lit(False))).alias("tls_verified"),
        F.when(good, _since(f("tls", "not_before", "timestamp"), now)).alias("cert_age_days"),
        F.when(good & (F.trim(issuer) != ""), F.exists(F.array(*[F.lit(x) for x in FREE_ISSUERS]), lambda x: F.contains(issuer, x))).alias("cert_free_issuer"),
        F.when(good, F.coalesce(f("tls", "san_count", "int"), F.size(f("tls", "sans", "array<string>")))).alias("san_count"),
    )


# Severity of each signal.
SEVERITY = {
    "domain_very_young": "high", "domain_young": "warn", "domain_unregistered": "info", "not_resolving": "warn", "no_tls": "info",
    "no_tls_young_domain": "warn", "tls_unverified": "info", "free_cert_very_young_domain": "high",
}


def signals(df: DataFrame, very_young: int = 7, young: int = 30, high_warns: int = 3, elevated_warns: int = 1, severity: dict[str, str] | None = None) -> DataFrame:
    """``df`` of facts with ``signals`` (array of id and severity) and ``risk``."""
    level = SEVERITY | (severity or {})
    age, c = F.col("age_days"), F.col
    rules = {
        "domain_very_young": age < very_young,
        "domain_young": (age >= very_young) & (age < young),
        "domain_unregistered": ~c("registered"),
        "not_resolving": ~c("resolves"),
        "no_tls": ~c("tls_ok"),
        "no_tls_young_domain": ~c("tls_ok") & (age < young),
        "tls_unverified": ~c("tls_verified"),
        "free_cert_very_young_domain": c("cert_free_issuer") & (age < very_young),
    }
    every = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(name).alias("id"), F.lit(level[name]).alias("severity"))) for name, rule in rules.items()])
    df = df.withColumn("signals", F.filter(every, lambda s: s.isNotNull()))
    warns = F.size(F.filter("signals", lambda s: s["severity"] == "warn"))
    risk = F.when(F.exists("signals", lambda s: s["severity"] == "high") | (warns >= high_warns), "high").when(warns >= elevated_warns, "elevated").otherwise("low")
    return df.withColumn("risk", risk)


def signal_table(df: DataFrame) -> DataFrame:
    """Hits and rates with 95 % intervals of every signal in both classes, hits or not."""
    from netloom.operators.metrics import wilson

    totals = df.agg(F.count_if(F.col("label") == 1).alias("n_phishing"), F.count_if(F.col("label") == 0).alias("n_benign"))
    hits = df.select("label", F.explode("signals").alias("s")).groupBy(F.col("s.id").alias("signal")).agg(F.count_if(F.col("label") == 1).alias("phishing"), F.count_if(F.col("label") == 0).alias("benign"))
    spine = df.sparkSession.createDataFrame([(k,) for k in SEVERITY], "signal string")
    out = spine.join(hits, "signal", "left").na.fill(0, ["phishing", "benign"]).join(F.broadcast(totals))
    p, b = wilson(F.col("phishing"), F.col("n_phishing")), wilson(F.col("benign"), F.col("n_benign"))
    return out.select("signal", "phishing", "n_phishing", p["lo"].alias("phishing_lo"), p["hi"].alias("phishing_hi"), "benign", "n_benign", b["lo"].alias("benign_lo"), b["hi"].alias("benign_hi"))


def suggested_severity(phishing: Column, n_phishing: Column, benign_hi: Column, high_max: float = 0.01, high_ratio: float = 10, warn_ratio: float = 2) -> Column:
    rate = phishing / F.nullif(n_phishing.cast("double"), F.lit(0.0))
    ratio = rate / F.nullif(benign_hi, F.lit(0.0))
    return F.when((benign_hi <= high_max) & (ratio >= high_ratio), "high").when(ratio >= warn_ratio, "warn").otherwise("info")


def risk_table(df: DataFrame) -> DataFrame:
    spine = df.sparkSession.createDataFrame([("low",), ("elevated",), ("high",)], "risk string")
    n = df.groupBy("risk").agg(F.count_if(F.col("label") == 1).alias("phishing"), F.count_if(F.col("label") == 0).alias("benign"))
    return spine.join(n, "risk", "left").na.fill(0, ["phishing", "benign"])


def counts_by_label(df: DataFrame) -> DataFrame:
    label = F.coalesce(F.col("label").cast("string"), F.lit("missing"))
    return df.groupBy(label.alias("label")).agg(
        F.count("*").alias("n_hosts"), F.countDistinct("domain").alias("n_domains"), F.count_if(F.col("dns").isNotNull()).alias("with_dns"), F.count_if(F.col("tls").isNotNull()).alias("with_tls"),
        F.count_if(F.coalesce(F.col("dns.resolves"), F.lit(False))).alias("resolving"),
    )


def eligible(df: DataFrame, max_lag_h: float | None = 24.0) -> DataFrame:
    """(step, label, n): rows that each filter removes first, in order, and those kept."""
    lag = (F.unix_micros("captured_at") - F.unix_micros("first_seen")) / F.lit(3.6e9)
    step = F.when(F.col("label").isNull(), "no_label").when(U.is_ip(F.col("host")), "ip_host").when(F.col("dns").isNull(), "no_dns").when(~F.coalesce(F.col("dns.resolves"), F.lit(False)), "not_resolving")
    step = step if max_lag_h is None else step.when(lag > max_lag_h, "late_capture")
    return df.groupBy(step.otherwise("kept").alias("step"), "label").agg(F.count("*").alias("n"))


def lag_hours(df: DataFrame) -> DataFrame:
    return df.withColumn("lag_h", (F.unix_micros("captured_at") - F.unix_micros("first_seen")) / F.lit(3.6e9))


def in_order(df: DataFrame, host: str = "host") -> DataFrame:
    """Captures of a host numbered by time."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(host).orderBy("captured_at", "capture_id")))
