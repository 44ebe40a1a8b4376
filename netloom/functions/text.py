"""Small text expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_name(col: Column) -> Column:
    """A name without its spelling: blanks anywhere and letter case."""
    return F.lower(F.regexp_replace(col, r"[\s\p{Z}]+", ""))


def plain_domain(col: Column) -> Column:
    """A domain without its spelling: letter case, blanks, outer dots and ``www.``."""
    d = F.lower(F.regexp_replace(col, r"[\s\p{Z}]+", ""))
    return F.regexp_replace(F.regexp_replace(d, r"^\.+|\.+$", ""), r"^www\.", "")
