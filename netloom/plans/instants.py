"""DuckDB text that reads the dates of the interim rows by itself: one case for each habit, zones by the database's own tables."""

from __future__ import annotations

from netloom.operators.timestamps import ZONE_LETTERS

_T = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s*[AaPp][Mm])?\s*(?:[A-Za-z]{1,5}|[+-]\d{1,2}(?::?\d{2})?)?(?:\[[A-Za-z_/]+\])?"
_HABITS = (
    ("ymd", rf"\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}(?:(?:[Tt]|\s+){_T})?"),
    ("packed", r"\d{8}[Tt]\d{6}[Zz]?"),
    ("slash", rf"\d{{1,2}}/\d{{1,2}}/\d{{4}}(?:,?\s+{_T})?"),
    ("dots", rf"\d{{1,2}}\.\d{{1,2}}\.\d{{4}}(?:,?\s+{_T})?"),
    ("dmy", rf"(?:[A-Za-z]{{3,9}},?\s+)?\d{{1,2}}\s+[A-Za-z]{{3}}\s+\d{{4}}(?:,?\s+{_T})?"),
    ("mdy", rf"[A-Za-z]{{3}}\s+\d{{1,2}},\s+\d{{4}}(?:,?\s+{_T})?"),
    ("number", r"\d{9,17}"),
)
_LETTERS = " ".join(f"WHEN '{k}' THEN {v * 60}" for k, v in ZONE_LETTERS.items())


def _by(cases: dict[str, str]) -> str:
    return "CASE habit " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + " END"


_X = lambda pattern, group=1: f"regexp_extract(t, '{pattern}', {group})"
_MONTH = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower({}))::VARCHAR"
_D = r"^(\d+)[-/.](\d+)[-/.](\d+)"
YEAR = _by({"ymd": _X(_D), "packed": "substr(t, 1, 4)", "slash": _X(_D, 3), "dots": _X(_D, 3), "dmy": _X(r"[A-Za-z]{3}\s+(\d{4})"), "mdy": _X(r",\s+(\d{4})")})
MONTH = _by({
    "ymd": _X(_D, 2), "packed": "substr(t, 5, 2)", "slash": f"CASE WHEN day_first THEN {_X(_D, 2)} ELSE {_X(_D, 1)} END", "dots": _X(_D, 2),
    "dmy": _MONTH.format(_X(r"\d\s+([A-Za-z]{3})\s")), "mdy": _MONTH.format(_X(r"^([A-Za-z]{3})")),
})
DAY = _by({
    "ymd": _X(_D, 3), "packed": "substr(t, 7, 2)", "slash": f"CASE WHEN day_first THEN {_X(_D, 1)} ELSE {_X(_D, 2)} END", "dots": _X(_D, 1),
    "dmy": _X(r"(\d{1,2})\s+[A-Za-z]{3}\s+\d{4}"), "mdy": _X(r"\s(\d{1,2}),"),
})
_HM = r"^(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])[Mm])?\s*(.*)$"
_HABIT = " ".join(f"WHEN regexp_full_match(t, '{p}') THEN '{h}'" for h, p in _HABITS)

#: CTEs up to ``inst``: row_id, t, micros (null without an instant), wall (null, exact, once, twice, skipped).
INSTANTS = rf"""
    i0 AS (SELECT row_id, lower(regexp_replace(source, '[\s]+', '', 'g')) AS src, regexp_replace(date, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS t FROM interim),
    i1 AS (SELECT i0.*, coalesce(day_first, false) AS day_first, coalesce(tz_name, 'UTC') AS tz, CASE {_HABIT} END AS habit FROM i0 LEFT JOIN source_cfg s ON i0.src = lower(s.source)),
    i2 AS (SELECT *, {YEAR} AS y, {MONTH} AS m, {DAY} AS d,
           CASE WHEN habit = 'packed' THEN substr(t, 10, 2) || ':' || substr(t, 12, 2) || ':' || substr(t, 14) WHEN habit <> 'number' THEN regexp_extract(t, '(\d{{1,2}}:\d{{2}}.*)$', 1) END AS tm FROM i1),
    i3 AS (SELECT *, try_cast(lpad(y, 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS day, regexp_extract(tm, '{_HM}', 1) AS h0, regexp_extract(tm, '{_HM}', 2) AS mi, regexp_extract(tm, '{_HM}', 3) AS s,
           regexp_extract(tm, '{_HM}', 4) AS f, lower(regexp_extract(tm, '{_HM}', 5)) AS half, regexp_replace(regexp_extract(tm, '{_HM}', 6), '\[.*\]$', '') AS z FROM i2),
    i4 AS (SELECT *, CASE WHEN h0 = '' THEN 0 WHEN half = '' THEN h0::INT WHEN h0::INT BETWEEN 1 AND 12 THEN h0::INT % 12 + CASE half WHEN 'p' THEN 12 ELSE 0 END END AS h FROM i3),
    i5 AS (SELECT *, CASE WHEN h <= 23 AND coalesce(nullif(mi, ''), '0')::INT <= 59 AND coalesce(nullif(s, ''), '0')::INT <= 59 THEN day::TIMESTAMP + to_seconds(h * 3600 + coalesce(nullif(mi, ''), '0')::INT * 60 + coalesce(nullif(s, ''), '0')::INT) END AS local,
           rpad(substr(f, 1, 6), 6, '0')::BIGINT AS frac,
           CASE WHEN z ~ '^[+-]' THEN CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (substr(regexp_replace(z, '[+:-]', '', 'g'), 1, 2)::INT * 3600 + coalesce(nullif(substr(regexp_replace(z, '[+:-]', '', 'g'), 3, 2), ''), '0')::INT * 60) ELSE CASE upper(z) {_LETTERS} END END AS off FROM i4),
    i6 AS (SELECT *, CASE WHEN z = '' THEN local AT TIME ZONE tz END AS u FROM i5),
    i7 AS (SELECT *, CASE WHEN z = '' AND ((u - INTERVAL 1 HOUR) AT TIME ZONE tz) = local THEN u - INTERVAL 1 HOUR ELSE u END AS first, ((u - INTERVAL 1 HOUR) AT TIME ZONE tz) = local OR ((u + INTERVAL 1 HOUR) AT TIME ZONE tz) = local AS twice FROM i6),
    inst AS (SELECT row_id, t, CASE WHEN habit = 'number' THEN t::BIGINT * CASE WHEN length(t) <= 11 THEN 1000000 WHEN length(t) <= 14 THEN 1000 ELSE 1 END WHEN z = '' THEN epoch_us(first) + frac ELSE epoch_us(local) - off::BIGINT * 1000000 + frac END AS micros,
           CASE WHEN habit = 'number' THEN 'exact' WHEN local IS NULL THEN NULL WHEN z <> '' THEN CASE WHEN off IS NOT NULL THEN 'exact' END WHEN twice THEN 'twice' WHEN (first AT TIME ZONE tz) <> local THEN 'skipped' ELSE 'once' END AS wall FROM i7)"""
