"""Queries of the operators for training data, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import contributors, mixing, pages, reading, residue, tokens


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = _table
    return {
        "p1_found": lambda s, d: pages.visual_pairs(t(s, d, "interim")),
        "p1_canonical": lambda s, d: pages.canonical_rows(t(s, d, "interim")),
        "p2_found": lambda s, d: pages.overlap_pairs(t(s, d, "interim"), t(s, d, "splits")),
        "p2_report": lambda s, d: pages.overlap_report(t(s, d, "interim"), t(s, d, "splits")),
        "p3_found": lambda s, d: residue.residue(t(s, d, "interim")),
        "p3_kinds": lambda s, d: residue.inspect(t(s, d, "interim")),
        "p5_splits": lambda s, d: contributors.assign(t(s, d, "interim"), t(s, d, "split_targets")).select("row_id", "source", "split"),
        "p5_report": lambda s, d: contributors.split_report(t(s, d, "interim"), t(s, d, "split_targets")),
        "p6_found": lambda s, d: pages.same_pages(t(s, d, "interim")),
        "p6_collapsed": lambda s, d: pages.collapse(t(s, d, "interim")),
        "p7_capped": lambda s, d: contributors.capped(t(s, d, "interim")),
        "p7_report": lambda s, d: contributors.cap_report(t(s, d, "interim")),
        "p8_ids": lambda s, d: tokens.encode(t(s, d, "documents")),
        "p8_slices": lambda s, d: tokens.slices(t(s, d, "documents")),
        "p9_mix": lambda s, d: mixing.mix(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_report": lambda s, d: mixing.mix_report(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p10_found": lambda s, d: reading.harder(t(s, d, "documents"), t(s, d, "reading_pairs")),
        "p10_levels": lambda s, d: reading.levels(t(s, d, "documents")).select("doc_id", "level"),
    }


#: The page of each url: every step of ``pages.page_key`` in DuckDB's words.
PAGES = r"""
    a AS (SELECT row_id, coalesce(lower(regexp_replace(source, '[\s\p{Z}]+', '', 'g')), '') AS src, replace(lower(regexp_replace(url, '[\s\p{Z}\p{Cc}]+', '', 'g')), '&amp;', '&') AS u FROM interim WHERE url IS NOT NULL AND row_id IS NOT NULL),
    b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(u, '^[<>("''\[{]+', ''), '#.*$', ''), '[<>)"''\]},;.!&]+$', '') AS v FROM a),
    c AS (SELECT *, regexp_extract(v, '^([a-z][a-z0-9+.-]*)://', 1) AS scheme, regexp_replace(v, '^[a-z][a-z0-9+.-]*://', '') AS rest FROM b),
    d AS (SELECT *, regexp_extract(rest, '^([^/?]*)', 1) AS h0, regexp_extract(regexp_replace(rest, '^[^/?]*', ''), '^([^?]*)', 1) AS p0, regexp_extract(regexp_replace(rest, '^[^/?]*', ''), '^[^?]*\?(.*)$', 1) AS q FROM c),
    e AS (SELECT *, CASE WHEN scheme IN ('http', '') THEN regexp_replace(h0, ':80$', '') ELSE h0 END AS h1 FROM d),
    f AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN scheme IN ('https', '') THEN regexp_replace(h1, ':443$', '') ELSE h1 END, '\.+$', ''), '^www\.', '') AS host,
          regexp_replace(regexp_replace(p0, '/{2,}', '/', 'g'), '[/,;]+$', '') AS path, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '')) AS fields FROM e),
    k AS (SELECT row_id, src, host || path || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END AS page FROM f)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"WITH {PAGES}, g AS (SELECT row_id, min(row_id) OVER (PARTITION BY src, page) AS row_id_a FROM k WHERE page <> '') SELECT DISTINCT row_id_a, row_id AS row_id_b FROM g WHERE row_id <> row_id_a",
        "p6_collapsed": f"WITH {PAGES} SELECT src AS source, page, min(row_id) AS row_id, count(*) AS copies FROM k WHERE page <> '' GROUP BY 1, 2",
    }
