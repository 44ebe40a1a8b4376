"""Url functions as column expressions: canonical forms, host parts, words, hashes.

Null stays null; a url without a host gives the empty host, and whatever needs
a host is then empty too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.plans.stages import let

#: Public suffixes of more and of one label; a parameter of every function that needs them.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.br", "com.au", "net.au", "co.jp", "co.in", "co.nz", "com.tr", "com.mx", "com.cn", "co.za", "com.ar", "com.sg",
    "com", "net", "org", "info", "biz", "io", "co", "app", "dev", "xyz", "top", "shop", "site", "online", "me", "us", "uk", "de", "fr", "it", "es", "nl", "pl",
    "br", "in", "jp", "cn", "ru", "eu", "ch", "at", "ly", "gov", "edu", "mil", "int", "example", "test", "invalid",
)
#: Suffixes under which private parties hand out names.
PRIVATE_SUFFIXES = ("github.io", "web.app", "blogspot.com", "harbormodo.example", "kelfisites.example")
_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
_IPV6 = r"^\[?[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}(?::(?:[0-9]{1,3}\.){3}[0-9]{1,3})?\]?$"


def stripped(url: Column) -> Column:
    """Without tabs and line ends anywhere and blanks around."""
    return F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def ensure_scheme(url: Column) -> Column:
    u = stripped(url)
    return F.when(F.locate("://", F.substring_index(u, "?", 1)) == 0, F.concat(F.lit("http://"), u)).otherwise(u)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(ensure_scheme(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(ensure_scheme(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def userinfo(url: Column) -> Column:
    return F.regexp_extract(authority(url), r"^(.*)@", 1)


def hostname(url: Column) -> Column:
    """Lower-case host without user, port and final dots; an IPv6 host without brackets."""
    a = F.regexp_replace(authority(url), r"^.*@", "")
    host = F.when(a.startswith("["), F.regexp_extract(a, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(a, r"^([^:]*)", 1))
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(authority(url), r"^.*@", ""), r":([0-9]+)$", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(ensure_scheme(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(ensure_scheme(url), r"^[^?#]*\?([^#]*)", 1)


def _netloc(url: Column, host: Column) -> Column:
    p, s = F.regexp_replace(port(url), "^0+(?=[0-9])", ""), scheme(url)
    shown = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    default = ((s == "http") & (p == "80")) | ((s == "https") & (p == "443"))
    user = userinfo(url)
    return F.concat(F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""), shown, F.when((p != "") & ~default, F.concat(F.lit(":"), p)).otherwise(""))


def normalize_url(url: Column) -> Column:
    """Canonical form with scheme; path and query keep their case, fragment, default port and a bare slash go."""
    p, q = path(url), query(url)
    tail = F.concat(F.when(p == "/", F.lit("")).otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.concat(scheme(url), F.lit("://"), _netloc(url, hostname(url)), tail)


def url_key(url: Column) -> Column:
    """Key across sources: no scheme, no leading ``www.``, no final slashes."""
    host = F.regexp_replace(hostname(url), r"^www\.", "")
    q = query(url)
    return F.concat(_netloc(url, host), F.regexp_replace(path(url), r"/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def url_depth(url: Column) -> Column:
    return F.size(segments(url))


def is_ip(host: Column) -> Column:
    return host.rlike(_IPV4) | host.rlike(_IPV6)


def split_host(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """struct(subdomain, label, suffix) by the longest known suffix; without one the host is the label."""
    longest = max(s.count(".") for s in suffixes) + 1

    def of(x: Column) -> Column:
        host, labels = x["host"], x["labels"]
        n = F.size(labels)
        size = F.lit(0)
        for k in range(1, longest + 1):
            these = [s for s in suffixes if s.count(".") + 1 == k]
            if these:
                size = F.when((n >= k) & F.array_join(F.slice(labels, F.lit(-k), F.lit(k)), ".").isin(these), F.lit(k)).otherwise(size)
        size = F.when(is_ip(host) | (host == ""), F.lit(0)).otherwise(size)
        return let(size, lambda k: cut(host, labels, n - k, k))

    def cut(host: Column, labels: Column, start: Column, k: Column) -> Column:
        return F.when(k == 0, F.struct(F.lit("").alias("subdomain"), host.alias("label"), F.lit("").alias("suffix"))).otherwise(
            F.struct(
                F.when(start > 1, F.array_join(F.slice(labels, F.lit(1), F.greatest(start - 1, F.lit(0))), ".")).otherwise("").alias("subdomain"),
                F.when(start >= 1, F.element_at(labels, F.greatest(start, F.lit(1)))).otherwise("").alias("label"),
                F.array_join(F.slice(labels, start + 1, F.greatest(k, F.lit(1))), ".").alias("suffix"),
            )
        )

    return let(F.struct(host.alias("host"), F.split(host, r"\.").alias("labels")), of)


def domain_of_host(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    return let(
        F.struct(host.alias("host"), split_host(host, suffixes).alias("p")),
        lambda x: F.when((x["p"]["label"] != "") & (x["p"]["suffix"] != ""), F.concat(x["p"]["label"], F.lit("."), x["p"]["suffix"])).otherwise(x["host"]),
    )


def registered_domain(url: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Registrable domain by public suffixes only; an IP or unknown host stays."""
    return domain_of_host(hostname(url), suffixes)


def registered_domain_private(url: Column, suffixes: Sequence[str] = SUFFIXES, private: Sequence[str] = PRIVATE_SUFFIXES) -> Column:
    """The same where private suffixes count too, so tenants of a platform differ."""
    return domain_of_host(hostname(url), (*suffixes, *private))


def normalize_to_registrable(url: Column) -> Column:
    return F.concat(F.lit("https://www."), registered_domain(url))


def represent(url: Column, rep: str) -> Column:
    """A url as it is (R1), its host (R2), the host without www (R3), its registrable domain (R4)."""
    host = hostname(url)
    return {"R1": url, "R2": host, "R3": F.regexp_replace(host, r"^www\.", ""), "R4": registered_domain(url)}[rep]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def spaced_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def chars(text: Column) -> Column:
    """Code points of a text, one by one."""
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)


def entropy(text: Column) -> Column:
    """Bits a character; null for the empty text."""
    def of(t: Column) -> Column:
        n = F.length(t)
        share = lambda c: (n - F.length(F.replace(t, c))) / n
        return F.when(n > 0, -F.aggregate(F.array_distinct(chars(t)), F.lit(0.0), lambda a, c: let(share(c), lambda p: a + p * F.log2(p))))

    return let(text, of)


def longest_match(text: Column, pattern: str) -> Column:
    """Length of the longest match of a pattern, 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda m: F.length(m))), F.lit(0))


def repeat_run(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"((.)\2*)"), 1), lambda m: F.length(m))), F.lit(0))


def count_of(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what)))


def hits(text: Column, vocabulary: Sequence[str]) -> Column:
    """How many entries of a vocabulary occur in the text."""
    words_ = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    return F.size(F.filter(words_, lambda w: F.contains(text, w)))


# Characters drawn like a letter of a domain label, and pairs drawn like one letter.
HOMOGLYPHS = ("01345789аеорсхуіıɡɑον", "oleastbgaeopcxyiigaov")
HOMOGLYPH_PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"))


def normalise_homoglyphs(label: Column) -> Column:
    out = F.translate(label, *HOMOGLYPHS)
    for pair, letter in HOMOGLYPH_PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return out


def ip_obfuscated(host: Column) -> Column:
    """Hexadecimal, dotless or octal ways to write an address."""
    parts = F.split(host, r"\.")
    odd = (F.size(parts) == 4) & F.forall(parts, lambda x: x.rlike("^[0-9]+$") | x.startswith("0x")) & F.exists(parts, lambda x: (F.length(x) > 1) & x.startswith("0"))
    return host.rlike("^0x[0-9a-f]+$") | host.rlike("^[0-9]{8,}$") | odd


def within_one(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or swap of neighbours apart."""
    d = F.levenshtein(a, b)
    n = F.length(a)
    places = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n))
    return (d == 1) | ((d == 2) & (n == F.length(b)) & (n > 1) & F.exists(places, lambda i: swapped(i) == b))


def list_hash(key: Column, prefix_bytes: int = 8) -> Column:
    return F.substring(F.sha2(key, 256), 1, 2 * prefix_bytes)


def unit_hash(key: Column, seed: int | Column) -> Column:
    """A number in [0, 1) fixed by key and seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rank_hash(key: Column, seed: int | Column) -> Column:
    """A text whose order is a fixed random order of the keys."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", seed.cast("string"), key))


def hash_fold(key: Column, folds: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def page_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def encode_bytes(text: Column, most: int = 200) -> Column:
    """Array of codes 1..96 of the printable ASCII characters (other characters 96), padded with zeros to ``most``."""
    codes = F.transform(F.slice(chars(text), 1, most), lambda c: F.when((F.ascii(c) >= 32) & (F.ascii(c) < 127), F.ascii(c) - 31).otherwise(F.lit(96)))
    return F.concat(codes, F.array_repeat(F.lit(0), F.lit(most) - F.size(codes)))


def trigram_vector(text: Column, size: int = 64) -> Column:
    """Counts of hashed character trigrams of the padded text, scaled to length 1."""
    def grams(t: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1)))
        return F.transform(places, lambda i: F.pmod(F.crc32(F.encode(F.substring(t, i, F.lit(3)), "utf-8")), F.lit(size)))

    def counts(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.size(F.filter(g, lambda x: x == b)).cast("double"))

    def scaled(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
        return let(norm, lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(x)))

    return let(let(let(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), grams), counts), scaled)


def host_suffixes(host: Column, most: int = 5) -> Column:
    """The host and its parents, longest first, without the last label alone."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    ends = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: (i == 0) | (n - i <= most))
    return F.transform(ends, lambda i: F.array_join(F.slice(labels, i + 1, n), "."))


def url_expressions(url: Column) -> Column:
    """Host suffixes times path prefixes: the exact path with and without query, and up to four directories."""
    host = F.regexp_replace(hostname(url), r"^www\.", "")
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    q = query(url)
    segs = F.filter(F.split(p, "/"), lambda s: s != "")
    n = F.least(F.size(segs), F.lit(4))
    dirs = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(segs, F.lit(1), F.greatest(i, F.lit(1))), "/"), F.lit("/"))))
    paths = F.array_distinct(F.concat(F.when(q != "", F.array(F.concat(p, F.lit("?"), q))).otherwise(F.array().cast("array<string>")), F.array(p), dirs))
    return F.array_distinct(F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(paths, lambda x: F.concat(h, x)))))
