"""Word lists of the features; each is a parameter with a default."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MIN_BRAND = 4

# Words of lure addresses.
KEYWORDS = (
    "account", "alert", "appeal", "authenticate", "bank", "banking", "billing", "cashback", "claim", "confirm", "credential", "ebanking", "free", "gift",
    "helpdesk", "invoice", "kyc", "limited", "login", "netbanking", "otp", "password", "payment", "prize", "recover", "refund", "restore", "reward", "secure",
    "security", "sign-in", "signin", "support", "suspend", "suspended", "unlock", "update", "upi", "urgent", "validate", "verification", "verify", "wallet", "webscr",
)
# Query fields that usually carry the target of a redirect.
REDIRECT_FIELDS = (
    "url", "redirect", "redirect_url", "redirect_uri", "redirecturl", "return", "returnurl", "return_url", "next", "goto", "target", "dest", "destination",
    "continue", "link", "u", "r", "to",
)
# Suffixes often abused.
SUSPICIOUS_TLDS = (
    "zip", "mov", "top", "xyz", "tk", "ml", "ga", "cf", "gq", "click", "link", "work", "support", "rest", "country", "kim", "loan", "men", "review", "stream",
    "download", "racing", "win", "bid", "trade", "party", "science", "date", "faith", "accountant", "cricket", "gdn", "icu", "cyou", "buzz", "monster", "sbs",
    "cfd", "cam", "vip", "shop", "live", "site", "online",
)
SHORTENERS = ("bit.ly", "t.co", "tinyurl.com", "goo.gl", "is.gd", "ow.ly")
PLATFORMS = ("github.io", "web.app", "harbormodo.example", "kelfisites.example", "corosites.example", "halrosites.example")
BRANDS = ("paypal", "amazon", "hdfcbank", "pelardo", "verum", "zupelwex", "bahibwex", "vindove")


@dataclass(frozen=True)
class Lists:
    platforms: tuple[str, ...] = PLATFORMS
    brands: tuple[str, ...] = BRANDS
    keywords: tuple[str, ...] = KEYWORDS
    shorteners: tuple[str, ...] = SHORTENERS
    suspicious_tlds: tuple[str, ...] = SUSPICIOUS_TLDS
    redirect_fields: tuple[str, ...] = REDIRECT_FIELDS
    social: tuple[str, ...] = field(default=("facebook.com", "x.com", "instagram.com", "linkedin.com", "youtube.com", "t.me", "wa.me"))

    def __post_init__(self) -> None:
        object.__setattr__(self, "brands", tuple(sorted({b for b in self.brands if len(b) >= MIN_BRAND})))

    def digest(self) -> str:
        """Short hash that tells files made with other lists apart."""
        content = {f.name: sorted(getattr(self, f.name)) for f in fields(self)}
        return hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()[:16]


def read_list(path: str | Path) -> tuple[str, ...]:
    """Lower-case lines of a text file without comments; a missing file is empty."""
    p = Path(path)
    if not p.exists():
        return ()
    lines = (line.strip().lower() for line in p.read_text(encoding="utf-8").splitlines())
    return tuple(line for line in lines if line and not line.startswith("#"))


def list_table(spark: SparkSession, path: str) -> DataFrame:
    """The same as a one-column table, for lists too long for an expression."""
    return spark.read.text(path).selectExpr("lower(trim(value)) AS entry").where("entry <> '' AND NOT entry LIKE '#%'").distinct()
