"""Hashed block and allow lists: keys, tenants, learned hosting zones, deltas and lookups."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import urls as U
from netloom.plans.materialise import materialise
from netloom.plans.stages import let, once


def _cut(url: Column) -> Column:
    """The address without blanks around, fragment and scheme."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", ""), r"(?s)#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", "")


def list_parts(url: Column) -> Column:
    """struct(host, port, path, query): ASCII lower case, no user, no ``www.``, no final slashes; query with its mark."""
    return let(_cut(url), _list_parts)


def _list_parts(s: Column) -> Column:
    a = F.translate(F.regexp_replace(F.regexp_extract(s, r"(?s)^([^/?]*)", 1), r"(?s)^.*@", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = F.regexp_replace(s, r"^[^/?]*", "")
    host = F.when(a.startswith("["), F.regexp_extract(a, r"^(\[[^\]]*\]?)", 1)).otherwise(F.regexp_extract(a, r"^([^:]*)", 1))
    port = F.when(a.startswith("["), F.regexp_replace(a, r"^\[[^\]]*\]?", "")).otherwise(F.regexp_extract(a, r"(:.*)$", 1))
    return F.struct(
        F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "").alias("host"), port.alias("port"),
        F.regexp_replace(F.regexp_extract(rest, r"(?s)^([^?]*)", 1), r"/+$", "").alias("path"), F.regexp_extract(rest, r"(?s)^[^?]*(\?.*)$", 1).alias("query"),
    )


def list_url_key(url: Column) -> Column:
    return let(list_parts(url), lambda p: F.concat(p["host"], p["port"], p["path"], p["query"]))


def list_domain_key(url: Column) -> Column:
    return let(list_parts(url)["host"], domain_key_of_host)


def domain_key_of_host(host: Column) -> Column:
    return F.when(host.rlike(r"^\[.*\]$"), F.regexp_replace(host, r"^\[|\]$", "")).otherwise(U.domain_of_host(host))


def path_segments(path: Column, n: int) -> Column:
    return F.slice(F.filter(F.split(F.lower(path), "/"), lambda s: s != ""), 1, n)


def private_tenant(host: Column, private: Sequence[str] = U.PRIVATE_SUFFIXES) -> Column:
    """The tenant's site under a private suffix, or the empty text."""
    return let(U.domain_of_host(host, (*U.SUFFIXES, *private)), lambda site: F.when((site != U.domain_of_host(host)) & ~host.isin(*private), site).otherwise(""))


def sub_tenant(host: Column, domain: Column) -> Column:
    child = F.substring_index(F.substring(host, F.lit(1), F.greatest(F.length(host) - F.length(domain) - 1, F.lit(0))), ".", -1)
    return let(private_tenant(host), lambda tenant: F.when(tenant != "", tenant).otherwise(F.concat(child, F.lit("."), domain)))


def parents(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def in_zone(df: DataFrame, zones: DataFrame, host: str = "host", key: str = "row_id") -> DataFrame:
    """(key) of the rows whose host is a zone of ``zones`` (zone) or lies below one; an equi-join on the exploded parents."""
    return df.select(key, F.explode(parents(F.col(host))).alias("zone")).join(zones.select("zone").distinct(), "zone", "left_semi").select(key).distinct()


def platform_of(df: DataFrame, platforms: DataFrame, host: str = "host", key: str = "row_id") -> DataFrame:
    """(key, platform): the longest listed parent of each host, the host itself left aside."""
    up = df.select(key, F.explode(F.slice(parents(F.col(host)), F.lit(2), F.lit(100))).alias("platform"))
    hit = up.join(platforms.select("platform").distinct(), "platform", "left_semi")
    return hit.groupBy(key).agg(F.max_by("platform", F.length("platform")).alias("platform"))


def expressions(df: DataFrame, key: str = "row_id", url: str = "url") -> DataFrame:
    """(key, expression): every key under which a list entry may match the address."""
    p = once(df.select(key, url), p=list_parts(F.col(url)))
    segs = F.filter(F.split("p.path", "/"), lambda s: s != "")
    heads = F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda n: n <= F.size(segs)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(segs, F.lit(1), n), "/")))
    paths = F.concat(F.array(F.lit("")), heads, F.array(F.col("p.path")), F.when(F.col("p.query") != "", F.array(F.concat("p.path", "p.query"))).otherwise(F.array().cast("array<string>")))
    ups = F.filter(parents(F.col("p.host")), lambda h: F.contains(h, F.lit(".")))
    hosts = F.concat(F.array(F.concat("p.host", "p.port")), F.slice(ups, F.lit(2), F.lit(4)))
    every = F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda x: F.concat(h, x)))))
    return p.select(key, F.explode(every).alias("expression"))


def _tenant_like(n_children: Column, n_urls: Column, least: int, share: float) -> Column:
    return (n_children >= least) & (n_children / n_urls >= share)


def learn_zones(phishing: DataFrame, candidates: DataFrame, shared: DataFrame, least: int = 3, share: float = 0.5, whole: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(zones: zone, how, n_urls), (tenant_domains: domain), (path_hosts: host, generic).

    ``phishing``: url; ``candidates`` and ``shared``: domain.  A domain whose
    phishing spreads over many subdomains opens as a whole ("sub"), one whose
    phishing spreads over many paths too ("path"), of others each child with
    phishing is a zone ("child").
    """
    p = once(phishing.where("url is not null").select("url"), p=list_parts(F.col("url")))
    p = once(p, domain=domain_key_of_host(F.col("p.host")))
    known = candidates.select("domain", F.lit(True).alias("cand")).unionByName(shared.select("domain", F.lit(False).alias("cand"))).groupBy("domain").agg(F.max("cand").alias("cand"))
    p = materialise(p.join(known, "domain").select("domain", "cand", F.col("p.host").alias("host"), path_segments(F.col("p.path"), 2).alias("segs")), "list-phishing")
    below = once(p.where("host <> domain and endswith(host, concat('.', domain))"), site=sub_tenant(F.col("host"), F.col("domain")))
    opens = lambda n, u: _tenant_like(n, u, least, share) | ((n >= whole) if whole else F.lit(False))
    tenants = below.groupBy("domain", F.col("site").alias("t")).agg(F.count("*").alias("u")).groupBy("domain").agg(F.count("*").alias("n"), F.sum("u").alias("u"))
    tenant_domains = tenants.where(opens(F.col("n"), F.col("u"))).select("domain")
    child = F.substring_index(F.expr("substring(host, 1, length(host) - length(domain) - 1)"), ".", -1)
    children = below.where("cand").groupBy("domain", child.alias("child")).agg(F.count("*").alias("u"))
    per = children.groupBy("domain").agg(F.count("*").alias("n"), F.sum("u").alias("all"))
    subs = per.where(opens(F.col("n"), F.col("all"))).select(F.col("domain").alias("zone"), F.lit("sub").alias("how"), F.col("all").alias("n_urls"))
    paths = p.where(F.size("segs") > 0)
    nexts = paths.where(F.size("segs") > 1).select("host", F.col("segs")[0].alias("first"), F.get("segs", F.lit(1)).alias("second"))
    generic = nexts.groupBy("host", "first").agg(F.countDistinct("second").alias("k")).where(F.col("k") >= least).select("host", "first", F.lit(True).alias("g"))
    t = paths.select("host", "cand", "domain", F.col("segs")[0].alias("first"), "segs").join(generic, ["host", "first"], "left")
    prefix = F.when(F.col("g") & (F.size("segs") > 1), F.array_join("segs", "/")).otherwise(F.col("first"))
    per_host = t.groupBy("host", "domain", prefix.alias("t")).agg(F.count("*").alias("u"), F.max("cand").alias("cand")).groupBy("host", "domain").agg(F.count("*").alias("n"), F.sum("u").alias("u"), F.max("cand").alias("cand"))
    like = per_host.where(_tenant_like(F.col("n"), F.col("u"), least, share))
    path_hosts = like.join(generic.groupBy("host").agg(F.sort_array(F.collect_set("first")).alias("generic")), "host", "left").select("host", F.coalesce("generic", F.array().cast("array<string>")).alias("generic"))
    whole_paths = like.where("cand and host = domain").select(F.col("domain").alias("zone"), F.lit("path").alias("how"), F.col("u").alias("n_urls")).join(subs.select("zone"), "zone", "left_anti")
    opened = subs.unionByName(whole_paths)
    leaves = children.join(opened.select(F.col("zone").alias("domain")), "domain", "left_anti").select(F.concat("child", F.lit("."), "domain").alias("zone"), F.lit("child").alias("how"), F.col("u").alias("n_urls"))
    return opened.unionByName(leaves), tenant_domains, path_hosts


def block_keys(urls: DataFrame, tenant_domains: DataFrame, path_hosts: DataFrame, protected: DataFrame, specific: int = 16) -> DataFrame:
    """(url, key): the address itself, its tenant, and the address without query where that names one object."""
    d = once(urls.select("url"), p=list_parts(F.col("url")))
    d = once(d, domain=domain_key_of_host(F.col("p.host")), host=F.col("p.host"))
    d = d.join(tenant_domains.select("domain", F.lit(True).alias("td")), "domain", "left").join(path_hosts.select("host", "generic"), "host", "left")
    sub = F.when(F.col("td") & (F.col("host") != F.col("domain")), sub_tenant(F.col("host"), F.col("domain"))).otherwise("")
    shared_hosts = path_hosts.select(F.col("host").alias("sub"), F.lit(True).alias("s1")).unionByName(protected.select(F.col("key").alias("sub"), F.lit(True).alias("s1"))).distinct()
    d = once(d, sub=sub).join(shared_hosts, "sub", "left").withColumn("sub", F.when(F.col("s1"), F.lit("")).otherwise(F.col("sub")))
    segs = F.filter(F.split("p.path", "/"), lambda s: s != "")
    depth = F.when(F.array_contains("generic", F.lower(F.get(segs, F.lit(0)))) & (F.size(segs) > 1), F.lit(2)).otherwise(F.lit(1))
    by_path = F.when(F.col("generic").isNotNull() & (F.size(segs) > 0), F.concat("p.host", "p.port", F.lit("/"), F.array_join(F.slice(segs, F.lit(1), depth), "/"))).otherwise("")
    tenant = F.when(F.col("sub") != "", F.col("sub")).otherwise(by_path)
    bare = F.when((F.col("p.query") != "") & ((tenant != "") | F.exists(segs, lambda s: F.length(s) >= specific)), F.concat("p.host", "p.port", "p.path")).otherwise("")
    keys = F.filter(F.array_distinct(F.array(F.concat("p.host", "p.port", "p.path", "p.query"), tenant, bare)), lambda k: k != "")
    return d.select("url", F.explode(keys).alias("key")).join(protected.select("key").distinct(), "key", "left_anti").select("url", "key")


def build_lists(blocked: DataFrame, ranked: DataFrame, platforms: DataFrame, shorteners: DataFrame, prefix_bytes: int = 8, least: int = 3, share: float = 0.5) -> DataFrame:
    """(list, entry): block_domain and block_url hashes, allow hashes, and open zones.

    ``blocked``: url; ``ranked``, ``platforms``, ``shorteners``: domain.
    """
    allow = ranked.select("domain").where("domain <> ''").distinct().join(shorteners, "domain", "left_anti")
    learned = learn_zones(blocked, allow.join(platforms, "domain", "left_anti"), platforms, least, share)
    zones, tenant_domains, path_hosts = (materialise(x, "list-zones") for x in learned)
    many = zones.where("not (how = 'child' and n_urls = 1)").select(F.col("zone").alias("key"))
    protected = allow.select(F.col("domain").alias("key")).unionByName(platforms.select(F.col("domain").alias("key"))).unionByName(many).distinct()
    b = once(blocked.where("url is not null").select("url").distinct(), host=list_parts(F.col("url"))["host"])
    b = once(b, domain=domain_key_of_host(F.col("host"))).where("domain <> ''")
    special = allow.select("domain").unionByName(platforms.select("domain")).distinct().withColumn("s", F.lit(True))
    zoned = in_zone(b.withColumnRenamed("url", "row_id"), zones).withColumnRenamed("row_id", "url").withColumn("z", F.lit(True))
    b = materialise(b.join(special, "domain", "left").join(zoned, "url", "left"), "list-blocked")
    plain = b.where("s is null and z is null").select("domain").distinct()
    by_url = block_keys(b.where("s is not null or z is not null").select("url"), tenant_domains, path_hosts, protected)
    h = lambda c: U.list_hash(F.col(c), prefix_bytes)
    kept = allow.join(platforms, "domain", "left_anti").join(zones.select(F.col("zone").alias("domain")), "domain", "left_anti").join(plain, "domain", "left_anti")
    row = lambda name, d, c: d.select(F.lit(name).alias("list"), c.alias("entry")).distinct()
    return row("block_domain", plain, h("domain")).unionByName(row("block_url", by_url, h("key"))).unionByName(row("allow", kept, h("domain"))).unionByName(row("open", zones, F.col("zone")))


def tenant_sites(origins: DataFrame, platforms: DataFrame, zones: DataFrame, phishing: DataFrame) -> DataFrame:
    """(host) of popular tenants on platforms with no phishing on or below them and in no zone."""
    o = once(origins.select("url"), host=list_parts(F.col("url"))["host"]).select("host").distinct()
    o = once(o, domain=domain_key_of_host(F.col("host")), tenant=private_tenant(F.col("host"))).where("host <> domain")
    o = o.join(platforms, "domain", "left_semi").where("tenant = host")
    phished = phishing.select(F.explode(parents(list_parts(F.col("url"))["host"])).alias("host")).distinct()
    o = o.join(phished, "host", "left_anti").select("host")
    return o.join(in_zone(o.withColumn("row_id", F.col("host")), zones).withColumnRenamed("row_id", "host"), "host", "left_anti")


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(list, op, entry): what to add and what to delete between two builds."""
    add = new.select("list", "entry").exceptAll(old.select("list", "entry")).select("list", F.lit("add").alias("op"), "entry")
    gone = old.select("list", "entry").exceptAll(new.select("list", "entry")).select("list", F.lit("del").alias("op"), "entry")
    return add.unionByName(gone)


def apply_delta(old: DataFrame, change: DataFrame) -> DataFrame:
    kept = old.join(change.where("op = 'del'").select("list", "entry"), ["list", "entry"], "left_anti")
    return kept.unionByName(change.where("op = 'add'").select("list", "entry")).distinct()


def digest(entries: DataFrame) -> str:
    """Version of a build from its sorted entries; the rows are hashed in the cluster, the hashes summed."""
    sums = entries.select("list", F.conv(F.substring(F.sha2(F.concat_ws("|", "list", "entry"), 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).groupBy("list").agg(F.sum("h").alias("h"), F.count("*").alias("n"))
    rows = [[r["list"], r["n"], str(r["h"])] for r in sums.orderBy("list").collect()]
    return hashlib.sha256(json.dumps(rows, separators=(",", ":")).encode()).hexdigest()[:12]


def lookup(df: DataFrame, entries: DataFrame, shorteners: DataFrame, platforms: DataFrame, prefix_bytes: int = 8, key: str = "row_id") -> DataFrame:
    """(key, blocked, allow, shared, shortener) of each address against the lists."""
    d = once(df.select(key, "url"), host=list_parts(F.col("url"))["host"])
    d = once(d, domain=domain_key_of_host(F.col("host")))
    hashed = lambda name, c: entries.where(F.col("list") == name).select(F.col("entry").alias(c)).distinct()
    by_url = expressions(d, key).select(key, U.list_hash(F.col("expression"), prefix_bytes).alias("h")).join(hashed("block_url", "h"), "h", "left_semi").select(key).distinct().withColumn("_u", F.lit(True))
    dom = d.withColumn("h", U.list_hash(F.col("domain"), prefix_bytes))
    by_domain = dom.join(hashed("block_domain", "h"), "h", "left_semi").select(key).withColumn("_d", F.lit(True))
    zoned = in_zone(d, entries.where("list = 'open'").select(F.col("entry").alias("zone")), key=key).withColumn("_z", F.lit(True))
    allow = dom.join(hashed("allow", "h"), "h", "left_semi").select(key).withColumn("_a", F.lit(True))
    short = d.join(shorteners, "domain", "left_semi").select(key).withColumn("_s", F.lit(True))
    plat = d.join(platforms, "domain", "left_semi").select(key).withColumn("_p", F.lit(True))
    out = d.select(key)
    for one in (by_url, by_domain, zoned, allow, short, plat):
        out = out.join(one, key, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select(
        key, F.when(yes("_u"), "url").when(yes("_d"), "domain").alias("blocked"), (yes("_a") & ~yes("_z")).alias("allow"), (yes("_z") | yes("_p")).alias("shared"), yes("_s").alias("shortener"),
    )
