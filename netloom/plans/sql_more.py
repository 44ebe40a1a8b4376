"""DuckDB texts of url, list, host, weight and verdict queries."""

from __future__ import annotations

from netloom.features.lists import PLATFORMS, SHORTENERS, Lists
from netloom.functions import urls as U
from netloom.plans import sql as Q

_NAMES = lambda xs: ", ".join(f"'{x}'" for x in xs)
_UNIT = lambda seed, c: f"('0x' || substr(md5('{seed}|' || {c}), 1, 8))::UBIGINT / 4294967296.0"
#: A text with each of the row's other letters as one byte of its own, since distances are counted in bytes.
_SINGLE = lambda c: f"array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN x ELSE chr(list_position(list_sort(list_distinct(list_filter(string_split(lower(domain) || lower(domain_u2), ''), lambda y: unicode(y) > 127))), x)) END), '')"
#: Entropy of a text: the characters sorted, so that the sum has one order.
_ENTROPY = lambda c: f"""CASE WHEN length({c}) > 0 THEN -list_sum(list_transform(list_sort(list_distinct(string_split({c}, ''))), lambda x: ((length({c}) - length(replace({c}, x, ''))) / length({c})::DOUBLE) * log2((length({c}) - length(replace({c}, x, ''))) / length({c})::DOUBLE))) END"""


def near_dup_pages(priority: str) -> str:
    """Per label, the first row of each cluster of close simhashes, and the rows without one."""
    return f"""WITH RECURSIVE {Q.CORPUS}, v AS (SELECT DISTINCT html_simhash AS v, label FROM c WHERE html_simhash IS NOT NULL), e AS (SELECT a.v AS a, b.v AS b, a.label FROM v a JOIN v b ON a.label = b.label AND a.v <> b.v AND bit_count(xor(a.v, b.v)) <= 3),
        reach AS (SELECT v AS a, v AS b, label FROM v UNION SELECT reach.a, e.b, e.label FROM reach JOIN e ON reach.b = e.a AND reach.label = e.label), roots AS (SELECT a, label, min(b) AS root FROM reach GROUP BY 1, 2),
        o AS (SELECT uid, row_number() OVER (PARTITION BY c.label, root ORDER BY us NULLS LAST, {priority}, uid) AS rn FROM c JOIN roots ON roots.a = html_simhash AND roots.label = c.label)
        SELECT uid FROM c WHERE html_simhash IS NULL UNION ALL SELECT uid FROM o WHERE rn = 1"""


def skeleton(c: str) -> str:
    out = f"translate({c}, '{U.HOMOGLYPHS[0]}', '{U.HOMOGLYPHS[1]}')"
    for pair, letter in U.HOMOGLYPH_PAIRS:
        out = f"replace({out}, '{pair}', '{letter}')"
    return out


URL_HASHES = f"""SELECT row_id, {_UNIT(7, "domain")} AS unit, (('0x' || substr(md5(domain), 1, 8))::UBIGINT % 5)::INT AS fold, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS words,
    round({_ENTROPY("url")}, 9) AS entropy, {skeleton("lower(domain)")} AS skeleton, levenshtein({_SINGLE("lower(domain)")}, {_SINGLE("lower(domain_u2)")})::INT AS distance,
    CASE WHEN domain IS NULL THEN NULL WHEN {_UNIT(3, "domain")} < 0.7 THEN 'train' WHEN {_UNIT(3, "domain")} < 0.7 + 0.1 THEN 'cal' ELSE 'test' END AS split FROM interim"""

#: CTEs up to ``lp``: host, port, path and query of each address as lists see it.
LIST_PARTS = rf"""
    l0 AS (SELECT row_id, url, label, regexp_replace(regexp_replace(regexp_replace(url, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '(?s)#.*$', ''), '{Q.SCHEME}', '') AS s FROM interim),
    l1 AS (SELECT *, translate(regexp_replace(regexp_extract(s, '(?s)^([^/?]*)', 1), '(?s)^.*@', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS a, regexp_replace(s, '^[^/?]*', '') AS rest FROM l0),
    lp AS (SELECT row_id, url, label, regexp_replace(regexp_replace(regexp_extract(a, '^([^:]*)', 1), '\.+$', ''), '^www\.', '') AS host, regexp_extract(a, '(?s)(:.*)$', 1) AS port,
           regexp_replace(regexp_extract(rest, '(?s)^([^?]*)', 1), '/+$', '') AS path, regexp_extract(rest, '(?s)^[^?]*(\?.*)$', 1) AS query FROM l1)"""

URL_EXPRESSIONS = f"""WITH {LIST_PARTS},
    g AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, string_split(host, '.') AS labels FROM lp WHERE url IS NOT NULL),
    h AS (SELECT row_id, unnest([host || port] || list_filter(list_transform(range(2, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')), lambda x: contains(x, '.'))[1:4]) AS host FROM g),
    k AS (SELECT row_id, unnest([''] || list_transform(list_filter([1, 2, 3], lambda n: n <= len(segs)), lambda n: '/' || array_to_string(segs[1:n], '/')) || [path] || CASE WHEN query <> '' THEN [path || query] ELSE [] END) AS path FROM g)
    SELECT DISTINCT row_id, host || path AS expression FROM h JOIN k USING (row_id)"""

HOSTS = """WITH e AS (SELECT *, coalesce(dns.errors, []) AS errs, (tls IS NOT NULL AND coalesce(tls.ok, false)) AS good FROM host_capture),
    f AS (SELECT capture_id, label, CASE WHEN dns IS NULL THEN NULL WHEN coalesce(dns.resolves, false) THEN true WHEN len(list_filter(errs, lambda x: starts_with(x, 'A:'))) > 0 THEN NULL WHEN len(list_filter(errs, lambda x: starts_with(x, 'AAAA:'))) > 0 THEN NULL ELSE false END AS resolves,
          CASE WHEN tls IS NOT NULL THEN good END AS tls_ok, CASE WHEN good THEN coalesce(tls.verified, false) END AS tls_verified FROM e)"""
#: The tables hold no registration records, so the rules on a domain's age have nothing to say.
SIGNALS = ("domain_very_young", "domain_young", "domain_unregistered", "not_resolving", "no_tls", "no_tls_young_domain", "tls_unverified", "free_cert_very_young_domain")
_RULES = {"not_resolving": "NOT resolves", "no_tls": "NOT tls_ok", "tls_unverified": "NOT tls_verified"}


def _wilson(k: str, n: str) -> tuple[str, str]:
    z, m = 1.959963984540054, f"nullif({n}::DOUBLE, 0)"
    p = f"({k} / {m})"
    mid, half = f"(({p} + {z} * {z} / (2 * {m})) / (1 + {z} * {z} / {m}))", f"({z} * sqrt({p} * (1 - {p}) / {m} + {z} * {z} / (4 * {m} * {m})) / (1 + {z} * {z} / {m}))"
    return f"greatest(0.0, {mid} - {half})", f"least(1.0, {mid} + {half})"


def signal_table() -> str:
    rows = " UNION ALL ".join(f"SELECT '{s}' AS signal, count(*) FILTER (label = 1 AND {_RULES.get(s, 'false')}) AS phishing, count(*) FILTER (label = 0 AND {_RULES.get(s, 'false')}) AS benign FROM f" for s in SIGNALS)
    (pl, ph), (bl, bh) = _wilson("phishing", "n_phishing"), _wilson("benign", "n_benign")
    return f"""{HOSTS}, t AS (SELECT count(*) FILTER (label = 1) AS n_phishing, count(*) FILTER (label = 0) AS n_benign FROM f), r AS ({rows})
        SELECT signal, phishing, n_phishing, round({pl}, 9) AS phishing_lo, round({ph}, 9) AS phishing_hi, benign, n_benign, round({bl}, 9) AS benign_lo, round({bh}, 9) AS benign_hi FROM r, t"""


RISK_TABLE = f"""{HOSTS}, r AS (SELECT label, CASE WHEN coalesce(NOT resolves, false) THEN 'elevated' ELSE 'low' END AS risk FROM f)
    SELECT s.risk, count(*) FILTER (label = 1) AS phishing, count(*) FILTER (label = 0) AS benign FROM (VALUES ('low'), ('elevated'), ('high')) s(risk) LEFT JOIN r USING (risk) GROUP BY 1"""

SOURCE_PROJECTION = f"""WITH {Q.url_cte("interim", "label, row_id")}, q AS (SELECT label, {Q.domain()} AS domain, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth FROM p)
    SELECT label, domain, count(*) AS n, sum(depth)::BIGINT AS depths FROM q GROUP BY 1, 2"""

REGISTRATION = "SELECT capture_id, " + ", ".join(
    f"NULL::DOUBLE AS {c}" for c in ("domain_age_days", "days_to_expiry", "registration_length_days", "days_since_rdap_change", "rdap_found", "whois_redacted", "rdap_status_count", "rdap_client_hold")
) + " FROM host_capture"

#: The shares over the limit are cut and the rest raised, in as many rounds as there are sources.
SOURCE_WEIGHTS = f"""WITH RECURSIVE {Q.CORPUS}, n AS (SELECT source, count(*) AS n FROM c GROUP BY 1),
    r AS (SELECT 0 AS i, source, n / sum(n) OVER () AS x FROM n
          UNION ALL SELECT i + 1, source, CASE WHEN n_over = 0 OR n_over = n_all THEN x WHEN x > 0.15 + 1e-15 THEN 0.15 ELSE x + excess * x / rest END FROM (
            SELECT *, count(*) FILTER (x > 0.15 + 1e-15) OVER () AS n_over, count(*) OVER () AS n_all, sum(CASE WHEN x > 0.15 + 1e-15 THEN x - 0.15 ELSE 0 END) OVER () AS excess, sum(CASE WHEN x > 0.15 + 1e-15 THEN 0 ELSE x END) OVER () AS rest FROM r WHERE i < (SELECT count(*) FROM n))),
    k AS (SELECT source, label, count(*) AS n FROM c GROUP BY 1, 2), s AS (SELECT source, count(*) AS k FROM k GROUP BY 1),
    w AS (SELECT k.source, k.label, x * (SELECT count(*) FROM c) / (s.k * k.n) AS w, k.n FROM k JOIN s USING (source) JOIN r ON r.source = k.source AND r.i = (SELECT count(*) FROM n))
    SELECT uid, round(w / (SELECT sum(w * n) / sum(n) FROM w), 9) AS weight FROM c JOIN w ON c.source = w.source AND c.label = w.label"""

DEEP_URLS = rf"""WITH {Q.url_cte("interim", "row_id", "url IS NOT NULL")}, d AS (SELECT DISTINCT host, {Q.normalized()} AS canon FROM p WHERE scheme IN ('http', 'https') AND port = '' AND userinfo = ''
    AND NOT regexp_matches(path, '(?i)\.(jpe?g|png|gif|svg|webp|ico|bmp|pdf|zip|gz|tgz|rar|7z|exe|apk|dmg|mp[34]|avi|mov|css|js|json|xml|txt|woff2?|ttf)$') AND len(list_filter(string_split(path, '/'), lambda x: x <> '')) >= 1)
    SELECT host, canon FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY md5('42|' || canon), canon) AS rn FROM d) WHERE rn <= 3"""

#: All simhashes that can be reached from one over steps of at most three bits; the smallest names the cluster.
NEAR_DUP = """WITH RECURSIVE v AS (SELECT DISTINCT html_simhash AS v FROM interim WHERE html_simhash IS NOT NULL), e AS (SELECT a.v AS a, b.v AS b FROM v a JOIN v b ON a.v <> b.v AND bit_count(xor(a.v, b.v)) <= 3),
    reach AS (SELECT v AS a, v AS b FROM v UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), roots AS (SELECT a, min(b) AS root FROM reach GROUP BY 1) SELECT root, count(*) AS n_values FROM roots GROUP BY 1"""


def list_zones(platforms: tuple[str, ...], least: int = 3, share: float = 0.5) -> str:
    """Hosting zones: domains whose phishing spreads over many children or paths, and the children of the others."""
    tenants = lambda n, u: f"{n} >= {least} AND {n} / {u}::DOUBLE >= {share}"
    return rf"""WITH {LIST_PARTS}, src AS (SELECT lower(trim(domain, ' ')) AS domain, lower(regexp_replace(source, '[\s]+', '', 'g')) AS source FROM interim WHERE label = 0),
        known AS (SELECT domain, max(cand) AS cand FROM (SELECT domain, true AS cand FROM src GROUP BY 1 HAVING count(DISTINCT source) >= 2 UNION ALL SELECT unnest([{_NAMES(platforms)}]), false) GROUP BY 1),
        p AS (SELECT host, {Q.domain("host")} AS domain, list_filter(string_split(lower(path), '/'), lambda x: x <> '')[1:2] AS segs FROM lp WHERE label = 1 AND url IS NOT NULL),
        j AS (SELECT p.*, cand FROM p JOIN known USING (domain)),
        ch AS (SELECT domain, string_split(substr(host, 1, length(host) - length(domain) - 1), '.')[-1] AS child, count(*) AS u FROM j WHERE cand AND ends_with(host, '.' || domain) GROUP BY 1, 2),
        subs AS (SELECT domain, sum(u)::BIGINT AS n_urls FROM ch GROUP BY 1 HAVING {tenants("count(*)", "sum(u)")}),
        gen AS (SELECT host, segs[1] AS first FROM j WHERE len(segs) > 1 GROUP BY 1, 2 HAVING count(DISTINCT segs[2]) >= {least}),
        pre AS (SELECT j.host, j.domain, CASE WHEN gen.host IS NOT NULL AND len(segs) > 1 THEN array_to_string(segs, '/') ELSE segs[1] END AS t, cand FROM j LEFT JOIN gen ON gen.host = j.host AND gen.first = segs[1] WHERE len(segs) > 0),
        per AS (SELECT host, domain, count(DISTINCT t) AS n, count(*) AS u, bool_or(cand) AS cand FROM pre GROUP BY 1, 2 HAVING {tenants("count(DISTINCT t)", "count(*)")}),
        opened AS (SELECT domain AS zone, 'sub' AS how, n_urls FROM subs UNION ALL SELECT domain, 'path', u FROM per WHERE cand AND host = domain AND domain NOT IN (SELECT domain FROM subs))
        SELECT zone, how, n_urls FROM opened UNION ALL SELECT child || '.' || domain, 'child', u FROM ch WHERE domain NOT IN (SELECT zone FROM opened)"""


def _lists(platforms: tuple[str, ...], shorteners: tuple[str, ...], least: int = 3, share: float = 0.5) -> str:
    """CTEs up to ``built`` (list, entry): zones, tenants and keys of the hashed lists."""
    tenants = lambda n, u: f"{n} >= {least} AND {n} / {u}::DOUBLE >= {share}"
    private = (*U.SUFFIXES, *U.PRIVATE_SUFFIXES)
    site = lambda h: f"({Q.domain(h, private)})"
    tenant = lambda h, d: f"CASE WHEN {site(h)} <> ({Q.domain(h)}) AND {h} NOT IN ({_NAMES(U.PRIVATE_SUFFIXES)}) THEN {site(h)} ELSE string_split(substr({h}, 1, length({h}) - length({d}) - 1), '.')[-1] || '.' || {d} END"
    return rf"""{LIST_PARTS}, src AS (SELECT lower(trim(domain, ' ')) AS domain, lower(regexp_replace(source, '[\s]+', '', 'g')) AS source FROM interim WHERE label = 0),
        plat AS (SELECT unnest([{_NAMES(platforms)}]) AS domain), allow_ AS (SELECT domain FROM src WHERE domain <> '' AND domain NOT IN ({_NAMES(shorteners)}) GROUP BY 1 HAVING count(DISTINCT source) >= 2),
        known AS (SELECT domain, true AS cand FROM allow_ WHERE domain NOT IN (SELECT domain FROM plat) UNION ALL SELECT domain, false FROM plat),
        b AS (SELECT url, host, port, path, query, {Q.domain("host")} AS domain FROM lp WHERE label = 1 AND url IS NOT NULL),
        j AS (SELECT host, b.domain, cand, list_filter(string_split(lower(path), '/'), lambda x: x <> '')[1:2] AS segs FROM b JOIN known ON b.domain = known.domain),
        below AS (SELECT * FROM j WHERE ends_with(host, '.' || domain)), st AS (SELECT domain, {tenant("host", "domain")} AS t, count(*) AS u FROM below GROUP BY 1, 2),
        tdom AS (SELECT domain FROM st GROUP BY 1 HAVING {tenants("count(*)", "sum(u)")}),
        ch AS (SELECT domain, string_split(substr(host, 1, length(host) - length(domain) - 1), '.')[-1] AS child, count(*) AS u FROM below WHERE cand GROUP BY 1, 2),
        subs AS (SELECT domain, sum(u)::BIGINT AS n_urls FROM ch GROUP BY 1 HAVING {tenants("count(*)", "sum(u)")}),
        gen AS (SELECT host, segs[1] AS first FROM j WHERE len(segs) > 1 GROUP BY 1, 2 HAVING count(DISTINCT segs[2]) >= {least}),
        pre AS (SELECT j.host, j.domain, CASE WHEN gen.host IS NOT NULL AND len(segs) > 1 THEN array_to_string(segs, '/') ELSE segs[1] END AS t, cand FROM j LEFT JOIN gen ON gen.host = j.host AND gen.first = segs[1] WHERE len(segs) > 0),
        per AS (SELECT host, domain, count(*) AS u, bool_or(cand) AS cand FROM pre GROUP BY 1, 2 HAVING {tenants("count(DISTINCT t)", "count(*)")}),
        phost AS (SELECT per.host, list(gen.first) FILTER (gen.first IS NOT NULL) AS generic FROM per LEFT JOIN gen USING (host) GROUP BY 1),
        opened AS (SELECT domain AS zone, 'sub' AS how, n_urls FROM subs UNION ALL SELECT domain, 'path', u FROM per WHERE cand AND host = domain AND domain NOT IN (SELECT domain FROM subs)),
        zones AS (SELECT * FROM opened UNION ALL SELECT child || '.' || domain, 'child', u FROM ch WHERE domain NOT IN (SELECT zone FROM opened)),
        prot AS (SELECT domain AS key FROM allow_ UNION SELECT domain FROM plat UNION SELECT zone FROM zones WHERE NOT (how = 'child' AND n_urls = 1)),
        bu AS (SELECT DISTINCT * FROM b WHERE domain <> ''), up AS (SELECT DISTINCT host, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS zone FROM lp WHERE host IS NOT NULL),
        zhost AS (SELECT DISTINCT host FROM up WHERE zone IN (SELECT zone FROM zones)),
        bm AS (SELECT bu.*, bu.domain IN (SELECT domain FROM allow_) OR bu.domain IN (SELECT domain FROM plat) OR host IN (SELECT host FROM zhost) AS fine FROM bu), plain AS (SELECT DISTINCT domain FROM bm WHERE NOT fine),
        k0 AS (SELECT bm.*, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, phost.host IS NOT NULL AS is_ph, coalesce(generic, []) AS generic, CASE WHEN bm.domain IN (SELECT domain FROM tdom) AND bm.host <> bm.domain THEN {tenant("bm.host", "bm.domain")} ELSE '' END AS sub0 FROM bm LEFT JOIN phost ON phost.host = bm.host WHERE fine),
        k1 AS (SELECT *, CASE WHEN sub0 IN (SELECT host FROM phost) OR sub0 IN (SELECT key FROM prot) THEN '' ELSE sub0 END AS sub, CASE WHEN is_ph AND len(segs) > 0 THEN host || port || '/' || array_to_string(segs[1:CASE WHEN list_contains(generic, lower(segs[1])) AND len(segs) > 1 THEN 2 ELSE 1 END], '/') ELSE '' END AS by_path FROM k0),
        k2 AS (SELECT *, CASE WHEN sub <> '' THEN sub ELSE by_path END AS tenant FROM k1),
        keys AS (SELECT DISTINCT unnest([host || port || path || query, tenant, CASE WHEN query <> '' AND (tenant <> '' OR len(list_filter(segs, lambda x: length(x) >= 16)) > 0) THEN host || port || path ELSE '' END]) AS key FROM k2),
        built AS (SELECT DISTINCT 'block_domain' AS list, substr(sha256(domain), 1, 16) AS entry FROM plain UNION ALL SELECT DISTINCT 'block_url', substr(sha256(key), 1, 16) FROM keys WHERE key <> '' AND key NOT IN (SELECT key FROM prot)
            UNION ALL SELECT DISTINCT 'allow', substr(sha256(domain), 1, 16) FROM allow_ WHERE domain NOT IN (SELECT domain FROM plat) AND domain NOT IN (SELECT zone FROM zones) AND domain NOT IN (SELECT domain FROM plain) UNION ALL SELECT DISTINCT 'open', zone FROM zones)"""


def hashed_lists(platforms: tuple[str, ...], shorteners: tuple[str, ...]) -> dict[str, str]:
    built = _lists(platforms, shorteners)
    has = lambda name, x: f"substr(sha256({x}), 1, 16) IN (SELECT entry FROM built WHERE list = '{name}')"
    expressions = URL_EXPRESSIONS.split(LIST_PARTS, 1)[1].replace("SELECT DISTINCT row_id, host || path AS expression FROM h JOIN k USING (row_id)", "").lstrip(",")
    lookup = f"""WITH {built}, {expressions.rstrip().rstrip(",")}, hit AS (SELECT DISTINCT row_id FROM h JOIN k USING (row_id) WHERE {has("block_url", "h.host || k.path")}),
        r AS (SELECT row_id, {Q.domain("host")} AS domain, coalesce(host IN (SELECT host FROM zhost), false) AS z FROM lp)
        SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM hit) THEN 'url' WHEN {has("block_domain", "domain")} THEN 'domain' END AS blocked, coalesce({has("allow", "domain")}, false) AND NOT z AS allow,
            z OR coalesce(domain IN (SELECT domain FROM plat), false) AS shared, coalesce(domain IN ({_NAMES(shorteners)}), false) AS shortener FROM r"""
    return {
        "list_build": f"WITH {built} SELECT list, entry FROM built",
        "list_delta": f"WITH {built} SELECT list, 'add' AS op, entry FROM built WHERE entry > '4' AND NOT entry < '8' UNION ALL SELECT list, 'del', entry FROM built WHERE entry < '8' AND NOT entry > '4'",
        "list_lookup": lookup,
    }


def verdict_combined(flags: tuple[str, ...], picture_min: float) -> str:
    """The layers one after another, each a step on the verdict before."""
    h = lambda n: f"(row_id * {2 * n + 3}) % {n + 5}"
    inputs = ", ".join(f"({h(i)} = 0) AS {c}" for i, c in enumerate(flags))
    return f"""WITH i AS (SELECT row_id, {inputs}, CASE {h(20)} WHEN 1 THEN 'url' END AS b1, CASE {h(20)} WHEN 1 THEN 'url' WHEN 2 THEN 'domain' END AS blocked, ({h(21)} % 3)::INT AS mv, {h(22)} / 27.0 AS mp,
          CASE WHEN {h(23)} < 20 THEN ({h(23)} % 3)::INT END AS pv, {h(24)} = 0 AS high, ({h(25)} % 3)::INT AS tc FROM interim),
        a AS (SELECT *, allow AND coalesce(blocked <> 'url', true) AS allowed, CASE WHEN shared AND NOT asks_credentials AND mv > 1 THEN 1 ELSE mv END AS m, page_known AND NOT asks_credentials AS quiet FROM i),
        b AS (SELECT *, CASE WHEN blocked IS NOT NULL AND NOT allowed THEN 'blocklist' WHEN trusted THEN 'user-trusted' WHEN local THEN 'local' WHEN (allowed OR shortener) AND page_warning THEN 'page-model' WHEN allowed THEN 'allowlist' WHEN shortener THEN 'shortener'
                  WHEN unscored AND asks_credentials THEN 'page' WHEN unscored THEN 'none' END AS early, pv IS NOT NULL AND (pv >= m OR (quiet AND m < 2)) AS use_page FROM a),
        c AS (SELECT *, CASE early WHEN 'blocklist' THEN 2 WHEN 'page-model' THEN 1 WHEN 'page' THEN 1 WHEN 'user-trusted' THEN 0 WHEN 'local' THEN 0 WHEN 'allowlist' THEN 0 WHEN 'shortener' THEN 0 WHEN 'none' THEN 0 END AS ev,
                  CASE WHEN use_page THEN pv ELSE m END AS v1, CASE WHEN use_page AND page_read THEN 'page-model' ELSE 'url-model' END AS l1 FROM b),
        d AS (SELECT *, CASE WHEN v1 = 2 AND m = 2 AND quiet AND NOT (page_read AND page_dangerous) THEN 1 ELSE v1 END AS v2 FROM c),
        e AS (SELECT *, CASE WHEN v2 = 0 AND picture_only AND mp >= {picture_min} THEN 1 ELSE v2 END AS v3, CASE WHEN v2 = 0 AND picture_only AND mp >= {picture_min} THEN 'page' ELSE l1 END AS l3 FROM d),
        f AS (SELECT *, CASE WHEN v3 = 1 AND high THEN 2 ELSE v3 END AS v4, CASE WHEN v3 = 1 AND high THEN 'domain' ELSE l3 END AS l4 FROM e),
        g AS (SELECT *, CASE WHEN v4 = 1 AND tc = 2 THEN 2 ELSE v4 END AS v5, CASE WHEN v4 = 1 AND tc = 2 THEN 'tier-c' ELSE l4 END AS l5 FROM f),
        k AS (SELECT *, v5 = 1 AND (NOT page_read OR page_short) AND has_password AND (cross_domain_form OR insecure_form) AS form FROM g),
        n AS (SELECT *, coalesce(ev, CASE WHEN form THEN 2 ELSE v5 END) AS v, coalesce(early, CASE WHEN form THEN 'page' ELSE l5 END) AS l FROM k),
        o AS (SELECT *, trusted OR allow OR shortener OR l IN ('blocklist', 'none', 'local', 'allowlist', 'shortener', 'user-trusted') AS fixed, asks_credentials OR (NOT page_known AND NOT shared AND l = 'url-model' AND v = 1) AS may_alarm FROM n),
        q AS (SELECT *, llm_raise AND NOT fixed AND least(v + 1, greatest(CASE WHEN may_alarm THEN 2 ELSE 1 END, v)) > v AS up FROM o)
        SELECT row_id, CASE WHEN up THEN v + 1 ELSE v END AS verdict, CASE WHEN up THEN 'llm' ELSE l END AS layer FROM q"""


def features(parse: str) -> dict[str, str]:
    """SQL of url feature groups over the CTE ``p`` of ``parse``."""
    lists = Lists()
    digits_or_not = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"
    longest = lambda c, pattern: f"coalesce(list_max(list_transform(regexp_extract_all({c}, '{pattern}'), lambda x: length(x))), 0)"
    brands = "[" + _NAMES(lists.brands) + "]"
    ascii_label = r"regexp_replace(label, '[^\x00-\x7F]', '?', 'g')"
    obfuscation = rf"""{parse}, o AS (SELECT row_id, canon, len(regexp_extract_all(canon, '%[0-9a-fA-F]{{2}}')) AS pct FROM p),
        ch AS (SELECT row_id, unnest(string_split(canon, '')) AS x, unnest(range(1, length(canon) + 1)) AS i FROM o WHERE length(canon) > 0),
        lead_ AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY row_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM ch), runs AS (SELECT row_id, sum(new) OVER (PARTITION BY row_id ORDER BY i) AS g FROM lead_),
        run AS (SELECT row_id, max(k) AS k FROM (SELECT row_id, g, count(*) AS k FROM runs GROUP BY 1, 2) GROUP BY 1)
        SELECT row_id, CASE WHEN canon IS NOT NULL THEN pct END::DOUBLE AS n_pct_encoded, 3 * pct / nullif(length(canon), 0)::DOUBLE AS pct_encoded_ratio, CASE WHEN canon IS NOT NULL THEN coalesce(k, 0) END::DOUBLE AS longest_repeat_run,
            {longest("canon", digits_or_not)} / nullif(length(canon), 0)::DOUBLE AS char_continuation_rate, length(regexp_replace(canon, '[\x00-\x7F]', '', 'g'))::DOUBLE AS n_non_ascii_url FROM o LEFT JOIN run USING (row_id)"""
    letters = "length(regexp_replace(label, '[^A-Za-zKİ]', '', 'g'))"
    randomness = f"""{parse} SELECT row_id, round({_ENTROPY("canon")}, 9) AS entropy_url, round({_ENTROPY("label")}, 9) AS entropy_domain, CASE WHEN label IS NOT NULL THEN {longest("label", "[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]+")} END::DOUBLE AS domain_longest_consonant_run,
        length(regexp_replace(label, '[^aeiouAEIOU]', '', 'g')) / nullif({letters}, 0)::DOUBLE AS domain_vowel_ratio,
        (len(list_filter(range(1, length(label)), lambda i: (label[i] ~ '[0-9]' AND label[i + 1] ~ '[A-Za-z]') OR (label[i] ~ '[A-Za-z]' AND label[i + 1] ~ '[0-9]'))))::DOUBLE AS domain_digit_switches FROM p"""
    known = lambda x: f"(list_contains({brands}, {x}) OR list_contains({brands}, {skeleton(x)}))"
    usable = "host IS NOT NULL AND NOT is_ip AND label <> ''"
    squatting = f"""{parse}, q AS (SELECT *, list_filter(string_split(replace(label, '_', '-'), '-'), lambda x: x <> '') AS parts FROM p)
        SELECT row_id, CASE WHEN {usable} THEN least(3, list_min(list_transform({brands}, lambda b: levenshtein({ascii_label}, b)))) END::DOUBLE AS min_brand_edit_distance,
            CASE WHEN {usable} THEN len(list_filter(parts, lambda x: {skeleton("x")} <> x AND list_contains({brands}, {skeleton("x")}))) > 0 END::DOUBLE AS homoglyph_brand_match,
            CASE WHEN {usable} THEN len(parts) > 1 AND {known("parts[1]")} END::DOUBLE AS combosquat_prefix, CASE WHEN {usable} THEN len(parts) > 1 AND {known("parts[-1]")} END::DOUBLE AS combosquat_suffix,
            CASE WHEN {usable} THEN len(parts) > 2 AND len(list_filter(parts[2:-2], lambda x: {known("x")})) > 0 END::DOUBLE AS combosquat_middle FROM q"""
    fitted = f"""{parse}, y AS (SELECT p.*, interim.label AS y FROM p JOIN interim USING (row_id)), use AS (SELECT * FROM y WHERE host IS NOT NULL AND NOT is_ip AND suffix <> ''),
        g AS (SELECT unnest(list_transform(range(1, length(label)), lambda i: label[i:i + 1])) AS gram FROM use WHERE y = 0 AND NOT is_platform AND length(label) > 1), n AS (SELECT gram, count(*) AS n FROM g GROUP BY 1),
        t AS (SELECT coalesce(sum(n), 0) + (count(*) + 1) AS den FROM n), lp AS (SELECT gram, round(ln((n + 1) / den::DOUBLE), 5) AS lp FROM n, t), fl AS (SELECT round(ln(1 / den::DOUBLE), 5) AS fl FROM t),
        s AS (SELECT suffix, count(*) AS n, sum(y) AS bad FROM use GROUP BY 1), b AS (SELECT sum(bad) / sum(n)::DOUBLE AS base FROM s), risk AS (SELECT suffix, round((bad + base) / (n + 1), 5) AS risk FROM s, b),
        lab AS (SELECT DISTINCT label FROM p WHERE length(label) > 1), lg AS (SELECT label, unnest(list_transform(range(1, length(label)), lambda i: label[i:i + 1])) AS gram FROM lab),
        sc AS (SELECT label, avg(coalesce(lp, fl)) AS ll FROM lg LEFT JOIN lp USING (gram), fl GROUP BY 1)
        SELECT row_id, round(ll, 9) AS bigram_loglik_domain, CASE WHEN NOT is_ip AND p.suffix <> '' THEN coalesce(risk, round(base, 5)) END AS tld_risk FROM p LEFT JOIN sc USING (label) LEFT JOIN risk ON p.suffix = risk.suffix, b"""
    return {"features_url_obfuscation": obfuscation, "features_url_randomness": randomness, "features_url_squatting": squatting, "features_url_fitted": fitted}


def texts(parse: str, flags: tuple[str, ...], picture_min: float, priority: str) -> dict[str, str]:
    return {
        "corpus_near_dup": near_dup_pages(priority),
        "url_hashes": URL_HASHES, "url_expressions": URL_EXPRESSIONS, "host_signal_table": signal_table(), "host_risk_table": RISK_TABLE, "source_projection": SOURCE_PROJECTION,
        "features_domain_registration": REGISTRATION, "corpus_source_weights": SOURCE_WEIGHTS, "deep_urls": DEEP_URLS, "near_dup_clusters": NEAR_DUP, "verdict_combined": verdict_combined(flags, picture_min),
        "list_zones": list_zones(PLATFORMS),
    } | hashed_lists(PLATFORMS, SHORTENERS) | features(parse)
