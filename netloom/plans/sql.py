"""DuckDB texts of url and corpus expressions, for the SQL that checks the queries."""

from __future__ import annotations

from collections.abc import Sequence

from netloom.functions.urls import SUFFIXES
from netloom.plans.instants import INSTANTS

EXACT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z$"
SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*://"


def stripped(u: str) -> str:
    return rf"regexp_replace(regexp_replace({u}, '[\t\r\n]', '', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def with_scheme(u: str) -> str:
    s = stripped(u)
    return f"CASE WHEN position('://' IN split_part({s}, '?', 1)) = 0 THEN 'http://' || {s} ELSE {s} END"


def url_cte(table: str = "interim", keep: str = "row_id", where: str = "true") -> str:
    """CTEs up to ``p``: keep, scheme, userinfo, host, port, path, query of every url of a table."""
    return rf"""
    u0 AS (SELECT {keep}, url, {with_scheme("url")} AS s FROM {table} WHERE {where}),
    u1 AS (SELECT *, lower(regexp_extract(s, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, regexp_extract(s, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS auth,
           regexp_extract(s, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(s, '^[^?#]*\?([^#]*)', 1) AS query FROM u0),
    u2 AS (SELECT *, regexp_extract(auth, '^(.*)@', 1) AS userinfo, regexp_replace(auth, '^.*@', '') AS a FROM u1),
    p AS (SELECT *, regexp_extract(a, ':([0-9]+)$', 1) AS port, regexp_replace(lower(CASE WHEN starts_with(a, '[') THEN regexp_extract(a, '^\[([^\]]*)\]', 1) ELSE regexp_extract(a, '^([^:]*)', 1) END), '\.+$', '') AS host FROM u2)"""


def netloc(host: str) -> str:
    return f"""(CASE WHEN userinfo <> '' THEN userinfo || '@' ELSE '' END || CASE WHEN contains({host}, ':') THEN '[' || {host} || ']' ELSE {host} END ||
    CASE WHEN port <> '' AND NOT ((scheme = 'http' AND ltrim(port, '0') = '80') OR (scheme = 'https' AND ltrim(port, '0') = '443')) THEN ':' || regexp_replace(port, '^0+([0-9])', '\\1') ELSE '' END)"""


def url_key() -> str:
    return f"({netloc('regexp_replace(host, ' + chr(39) + '^www' + chr(92) + '.' + chr(39) + ', ' + chr(39) * 2 + ')')} || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END)"


def normalized() -> str:
    return f"(scheme || '://' || {netloc('host')} || CASE WHEN path = '/' THEN '' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END)"


IPV4 = r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"


def suffix_size(host: str = "host", suffixes: Sequence[str] = SUFFIXES) -> str:
    one = ", ".join(f"'{s}'" for s in suffixes if s.count(".") == 0)
    two = ", ".join(f"'{s}'" for s in suffixes if s.count(".") == 1)
    parts = f"string_split({host}, '.')"
    return f"""CASE WHEN regexp_matches({host}, '{IPV4}') OR {host} = '' THEN 0 WHEN len({parts}) >= 2 AND array_to_string({parts}[-2:], '.') IN ({two}) THEN 2 WHEN {parts}[-1] IN ({one}) THEN 1 ELSE 0 END"""


def domain(host: str = "host", suffixes: Sequence[str] = SUFFIXES) -> str:
    k, parts = suffix_size(host, suffixes), f"string_split({host}, '.')"
    return f"""CASE WHEN ({k}) = 0 OR len({parts}) <= ({k}) THEN {host} ELSE array_to_string({parts}[-(({k}) + 1):], '.') END"""


#: Interim rows as corpus rows: uid, plain source, plain domain, dates in microseconds.
CORPUS = rf"""{INSTANTS},
    src AS (SELECT interim.*, lower(regexp_replace(source, '[\s]+', '', 'g')) AS src, inst.micros AS us FROM interim JOIN inst USING (row_id)),
    c AS (SELECT src || ':' || row_id AS uid, row_id, url, regexp_replace(regexp_replace(lower(regexp_replace(domain, '[\s\p{{Z}}]+', '', 'g')), '^\.+|\.+$', '', 'g'), '^www\.', '') AS domain, label::INT AS label, us, src AS source, depth::INT AS depth, origin, html_simhash FROM src)"""


def priority(names: Sequence[str], col: str = "source") -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{s}' THEN {i}" for i, s in enumerate(names)) + f" ELSE {len(names)} END"
