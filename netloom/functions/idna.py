"""Host labels between their written and their ASCII form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "xn--"


def label_to_ascii(label: str) -> str | None:
    """A label as it goes over the wire; None where it has no such form."""
    if label.isascii():
        return label
    try:
        return label.encode("idna").decode("ascii")
    except UnicodeError:
        return None


def label_to_unicode(label: str) -> str:
    """A label as it is read; one that doesn't decode stays."""
    if not label.lower().startswith(PREFIX):
        return label
    try:
        return label[len(PREFIX) :].encode("ascii").decode("punycode")
    except (UnicodeError, ValueError, OverflowError):
        return label


@F.pandas_udf(T.StringType())
def _ascii(hosts: pd.Series) -> pd.Series:
    def one(host: str) -> str | None:
        labels = [label_to_ascii(x) for x in host.split(".")]
        return None if None in labels else ".".join(labels)

    return hosts.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def _unicode(hosts: pd.Series) -> pd.Series:
    return hosts.map(lambda host: ".".join(map(label_to_unicode, host.split("."))), na_action="ignore")


def to_ascii(host: Column) -> Column:
    """Hosts of other letters in their ASCII form, null where there is none; ASCII hosts stay in the JVM."""
    plain = host.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(plain, host).otherwise(_ascii(F.when(~plain, host)))


def to_unicode(host: Column) -> Column:
    """Hosts with labels of other letters as they are read; others stay in the JVM."""
    coded = F.coalesce(F.lower(host).contains(PREFIX), F.lit(False))
    return F.when(coded, _unicode(F.when(coded, host))).otherwise(host)
