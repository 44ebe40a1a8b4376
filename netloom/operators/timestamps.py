"""Problem 4: timestamps of any habit to one instant in UTC.

The text is cut into year, month, day (or week, or day of the year), time,
fraction and zone by one pattern per family of formats.  A zone in the text gives the instant directly; a wall
time is joined as of the zone-offset intervals of its source's zone, which are
exploded by year: two intervals hold it when it occurs twice (the earlier
instant is taken), none when it is skipped (the offset before the change is
taken), one otherwise.

Defined results: null, empty and meaningless texts, impossible dates and
unknown zone letters and regions give null; second 60 counts as the next one
where there was a leap second and is no instant elsewhere; eight digits alone
are year, month and day; a source that the configuration doesn't name
counts as UTC and month first; a wall time before 1900 or after 2100 has the
offset of that end; digits after the microsecond are cut off; repeated rows and
all columns stay, but for older ones named utc_micros and wall.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.text import plain_name

FIRST_YEAR, LAST_YEAR = 1900, 2100
FAR = 1 << 60
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Usual zone letters and their offset in minutes.
ZONE_LETTERS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 330, "CET": 60, "CEST": 120, "MEZ": 60,
    "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180, "NST": -210,
    "NDT": -150, "BRT": -180, "BRST": -120, "ART": -180, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540, "AWST": 480,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "SAST": 120, "PKT": 300,
}

#: Zone letters, an offset (also after GMT or UTC, and with its letters behind it in parentheses), or none; then a region, in brackets or bare.
_ZONE = r"\s*(?:(?:GMT|UTC|UT)(?=[+-]\d))?([Zz](?![A-Za-z/_])|[A-Za-z]{2,5}(?![A-Za-z/_])|[+-]\d{1,2}(?::?\d{2})?|)(?:\s*\([^()]*\))?(?:\s*\[?\s*([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+|(?<=\[)[A-Za-z_]+)\]?)?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?" + _ZONE
_NAME = r"([A-Za-z]{3})[a-z]*\.?"
_DAY = r"(?:[A-Za-z]{3,9}\.?,?\s+)?"
#: Patterns with the order of their groups; h mi s f a z n are time, fraction, a or p, zone and region.
_T = ("h", "mi", "s", "f", "a", "z", "n")
FORMATS: tuple[tuple[str, tuple[str, ...]], ...] = (
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:(?:[Tt]|,?\s+){_TIME})?$", ("y", "m", "d", *_T)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE})?$", ("y", "m", "d", "h", "mi", "s", "f", "z", "n")),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]{_TIME}$", ("y", "m", "d", *_T)),
    (rf"^(\d{{4}})-?[Ww](\d{{2}})(?:-?([1-7]))?(?:(?:[Tt]|\s+){_TIME})?$", ("y", "w", "k", *_T)),
    (rf"^(\d{{4}})-(\d{{3}})(?:(?:[Tt]|\s+){_TIME})?$", ("y", "j", *_T)),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_TIME})?$", ("p", "q", "y", *_T)),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{_TIME})?$", ("d", "m", "y", *_T)),
    (rf"^{_DAY}(\d{{1,2}})(?:st|nd|rd|th|\.)?[\s-]+{_NAME},?[\s-]+(\d{{4}})(?:,?\s+(?:at\s+)?{_TIME})?$", ("d", "b", "y", *_T)),
    (rf"^\[?(\d{{1,2}})/{_NAME}/(\d{{4}})(?:[: ]{_TIME})?\]?$", ("d", "b", "y", *_T)),
    (rf"^{_DAY}{_NAME}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_TIME})?$", ("b", "d", "y", *_T)),
    # the year behind the time, as ctime and date write it
    (rf"^{_DAY}{_NAME}\s+(\d{{1,2}})\s+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:\.(\d+))?)?\s*([A-Za-z]{{1,5}}|[+-]\d{{1,2}}(?::?\d{{2}})?|)\s+(\d{{4}})$", ("b", "d", "h", "mi", "s", "f", "z", "y")),
    (rf"^(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:\.(\d+))?)?,?\s+(\d{{1,2}})\s+{_NAME}\s+(\d{{4}})$", ("h", "mi", "s", "f", "d", "b", "y")),
)
_PARTS = ("y", "m", "d", "b", "p", "q", "w", "k", "j", *_T)
# Days at whose end, in UTC, a second was put in.
LEAP_SECONDS = (
    "1972-06-30", "1972-12-31", "1973-12-31", "1974-12-31", "1975-12-31", "1976-12-31", "1977-12-31", "1978-12-31", "1979-12-31", "1981-06-30", "1982-06-30", "1983-06-30", "1985-06-30",
    "1987-12-31", "1989-12-31", "1990-12-31", "1992-06-30", "1993-06-30", "1994-06-30", "1995-12-31", "1997-06-30", "1998-12-31", "2005-12-31", "2008-12-31", "2012-06-30", "2015-06-30", "2016-12-31",
)
#: A text that may name a region.
NAMED = r"([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+|(?<=\[)[A-Za-z_]+)\]?\s*$"
EXACT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z$"
NUMBER = r"^[0-9]{9,13}\.[0-9]+$|^[0-9]{9,17}$"


def parts(text: Column) -> Column:
    """Array of the parts in the order of ``_PARTS``, empty where absent; null for other texts."""
    out = F.lit(None).cast("array<string>")
    for pattern, names in reversed(FORMATS):
        cut = "\x01".join(f"${names.index(p) + 1}" if p in names else "" for p in _PARTS)
        out = F.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, cut), "\x01", -1)).otherwise(out)
    return out


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date of the proleptic Gregorian calendar, by integer arithmetic."""
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("bigint"))
    z = y - F.when(m <= 2, F.lit(1)).otherwise(F.lit(0))
    doy = div(153 * (m + F.when(m > 2, F.lit(-3)).otherwise(F.lit(9))) + 2, 5) + d - 1
    return 365 * z + div(z, 4) - div(z, 100) + div(z, 400) + doy - 719468


def offsets(zone: str) -> list[tuple[int, int, int]]:
    """(start, end, offset) of a zone's offset intervals in UTC seconds; the first and last are open."""
    info = ZoneInfo(zone)
    off = lambda s: int(info.utcoffset(datetime.fromtimestamp(s, UTC).astimezone(info)).total_seconds())
    at = int(datetime(FIRST_YEAR, 1, 1, tzinfo=UTC).timestamp())
    end = int(datetime(LAST_YEAR + 1, 1, 1, tzinfo=UTC).timestamp())
    out, start, now = [], -FAR, off(at)
    week = int(timedelta(days=7).total_seconds())
    while at < end:
        if (new := off(at + week)) != now:
            lo, hi = at, at + week
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if off(mid) == now else (lo, mid)
            out.append((start, hi, now))
            start, now = hi, off(hi)
            at = hi
            if off(at + week) == now:
                at += week
            elif new == now:
                at += 1
            continue
        at += week
    return [*out, (start, FAR, now)]


def zone_table(spark: SparkSession, zones: Iterable[str]) -> DataFrame:
    """``zone, year, spans``: the local intervals (lo, hi, off) in seconds that touch a year, with a day to spare.

    At most 201 rows a zone, so it may be broadcast.
    """
    rows = []
    for zone in sorted(set(zones)):
        spans = [(s + off if s > -FAR else s, e + off if e < FAR else e, off) for s, e, off in offsets(zone)]
        for year in range(FIRST_YEAR, LAST_YEAR + 1):
            a = int(datetime(year, 1, 1, tzinfo=UTC).timestamp()) - 86400
            b = int(datetime(year + 1, 1, 1, tzinfo=UTC).timestamp()) + 86400
            rows.append((zone, year, [x for x in spans if x[0] < b and x[1] > a]))
    return spark.createDataFrame(rows, "zone string, year int, spans array<struct<lo: bigint, hi: bigint, off: bigint>>")


def to_utc(rows: DataFrame, sources: DataFrame, column: str = "date") -> DataFrame:
    """``rows`` with ``utc_micros`` (bigint, null without an instant) and ``wall`` (exact, once, twice, skipped or null).

    ``sources``: source, tz_name, day_first; one row a source, a fixed table.
    """
    spark = rows.sparkSession
    cfg = sources.select(plain_name(F.col("source")).alias("_src"), F.col("tz_name").alias("_tz"), F.col("day_first").alias("_df")).dropDuplicates(["_src"])
    zones = {r[0] for r in cfg.select("_tz").distinct().collect() if r[0]} | {"UTC"}
    # regions that the texts name: as many as there are known ones at most
    named = rows.select(F.regexp_extract(F.col(column), NAMED, 1).alias("n")).where("n <> ''")
    zones |= {r["n"] for r in named.where(F.col("n").isin(sorted(available_timezones()))).distinct().collect()}
    text = F.translate(F.regexp_replace(F.col(column), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""), "−", "-")
    kept = [c for c in rows.columns if c not in ("utc_micros", "wall")]
    df = rows.select(F.struct(*kept).alias("_row"), text.alias("_text"), plain_name(F.col("source")).alias("_src"))
    df = df.join(F.broadcast(cfg), "_src", "left").withColumn("_parts", parts(F.col("_text")))
    part = {name: F.col("_parts")[i] for i, name in enumerate(_PARTS)}
    number = {k: F.when(part[k].rlike("^[0-9]{1,4}$"), part[k]).cast("bigint") for k in ("y", "m", "d", "p", "q", "w", "k", "j", "h", "mi", "s")}
    month_of = F.create_map(*[F.lit(x) for i, name in enumerate(MONTHS) for x in (name, i + 1)])
    named = F.try_element_at(month_of, F.lower(part["b"])).cast("bigint")
    first, second = number["p"], number["q"]
    day_first = F.coalesce("_df", F.lit(False))
    hour = number["h"]
    half = F.lower(part["a"])
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", F.lit(12)).otherwise(F.lit(0)))
    sign = F.when(part["z"].startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    digits = F.regexp_replace(part["z"], "[+:-]", "")
    hours = F.when(F.length(digits) <= 2, digits).otherwise(F.expr("substring(_digits, 1, length(_digits) - 2)"))
    df = df.select(
        "*",
        number["y"].alias("_y"),
        F.coalesce(number["m"], named, F.when(day_first, second).otherwise(first)).alias("_m"),
        F.coalesce(number["d"], F.when(day_first, first).otherwise(second)).alias("_d"),
        F.when(part["h"] == "", F.lit(0)).otherwise(hour).alias("_h"),
        F.coalesce(number["mi"], F.lit(0)).alias("_mi"),
        F.coalesce(number["s"], F.lit(0)).alias("_s"),
        F.rpad(F.substring(part["f"], 1, 6), 6, "0").cast("bigint").alias("_f"),
        number["w"].alias("_w"),
        F.coalesce(number["k"], F.lit(1)).alias("_k"),
        number["j"].alias("_j"),
        part["z"].alias("_z"),
        part["n"].alias("_n"),
        sign.alias("_sign"),
        F.when(part["z"].rlike("^[+-]"), digits).alias("_digits"),
    )
    letters = F.create_map(*[F.lit(x) for k, v in ZONE_LETTERS.items() for x in (k, v * 60)])
    rest = F.when(F.length("_digits") > 2, F.expr("right(_digits, 2)")).otherwise(F.lit("0")).cast("bigint")
    given = F.when(F.col("_digits").isNotNull(), F.col("_sign") * (hours.cast("bigint") * 3600 + rest * 60)).otherwise(
        F.try_element_at(letters, F.upper(F.col("_z"))).cast("bigint")
    )
    leap = ((F.col("_y") % 4 == 0) & (F.col("_y") % 100 != 0)) | (F.col("_y") % 400 == 0)
    last = F.when(F.col("_m").isin(4, 6, 9, 11), F.lit(30)).when(F.col("_m") == 2, F.when(leap, F.lit(29)).otherwise(F.lit(28))).otherwise(F.lit(31))
    civil = F.when(F.col("_m").between(1, 12) & (F.col("_d") >= 1) & (F.col("_d") <= last), days_from_civil(F.col("_y"), F.col("_m"), F.col("_d")))
    new_year = days_from_civil(F.col("_y"), F.lit(1), F.lit(1))
    length = F.when(leap, F.lit(366)).otherwise(F.lit(365))
    # the week that holds the 4th of January is the first; 1970 began on a Thursday
    monday = new_year + 3 - F.pmod(new_year + 6, F.lit(7)) + (F.col("_w") - 1) * 7
    by_week = F.when((F.col("_w") >= 1) & (monday + 3 < new_year + length), monday + F.col("_k") - 1)
    by_day = F.when(F.col("_j").between(1, length), new_year + F.col("_j") - 1)
    day = F.when(F.col("_j").isNotNull(), by_day).when(F.col("_w").isNotNull(), by_week).otherwise(civil)
    df = df.withColumn("_day", day)
    real = (F.col("_y") >= 1) & F.col("_day").isNotNull() & (F.col("_h") <= 23) & (F.col("_mi") <= 59) & ((F.col("_s") <= 59) | ((F.col("_s") == 60) & (F.col("_mi") == 59)))
    seconds = F.col("_day") * 86400 + F.col("_h") * 3600 + F.col("_mi") * 60 + F.col("_s")
    df = df.withColumn("_wall", F.when(real, seconds)).withColumn("_given", F.when(F.abs(given) <= 18 * 3600, given))
    free = (F.col("_z") == "") & F.col("_wall").isNotNull()
    zone = F.when(free, F.when(F.col("_n") != "", F.col("_n")).otherwise(F.coalesce("_tz", F.lit("UTC"))))
    year = F.greatest(F.lit(FIRST_YEAR), F.least(F.lit(LAST_YEAR), F.when(F.col("_w").isNull(), F.col("_y")).otherwise(F.year(F.date_from_unix_date(F.col("_day").cast("int")))))).cast("int")
    spans = F.broadcast(zone_table(spark, zones).select(F.col("zone").alias("_zone"), F.col("year").alias("_year"), F.col("spans").alias("_spans")))
    df = df.withColumn("_zone", zone).withColumn("_year", year).join(spans, ["_zone", "_year"], "left")
    held = F.filter("_spans", lambda x: (x["lo"] <= F.col("_wall")) & (x["hi"] > F.col("_wall")))
    df = df.withColumn("_held", held)
    past = F.filter("_spans", lambda x: x["hi"] <= F.col("_wall"))
    offset = F.when(F.size("_held") > 0, F.array_max(F.transform("_held", lambda x: x["off"]))).otherwise(
        F.array_max(F.transform(past, lambda x: F.struct(x["hi"].alias("hi"), x["off"].alias("off"))))["off"]
    )
    digits = F.split("_text", r"\.")
    whole, decimals = digits[0], F.coalesce(F.get(digits, F.lit(1)), F.lit(""))
    count = F.when(F.col("_text").rlike(NUMBER), whole.cast("bigint"))
    scale = F.when(F.length(whole) <= 11, F.lit(1_000_000)).when(F.length(whole) <= 14, F.lit(1_000)).otherwise(F.lit(1))
    part_of = F.floor(F.rpad(F.substring(decimals, 1, 6), 6, "0").cast("bigint") * scale / 1_000_000)
    utc = F.col("_wall") - F.when(free, offset).otherwise(F.col("_given"))
    added = F.lit([int(datetime.fromisoformat(d + "T00:00:00+00:00").timestamp()) + 86400 for d in LEAP_SECONDS])
    utc = F.when((F.col("_s") < 60) | F.array_contains(added, utc), utc)
    micros = F.coalesce(count * scale + part_of, utc * 1_000_000 + F.col("_f"))
    wall = F.when(micros.isNull(), F.lit(None)).when(~F.coalesce(free, F.lit(False)) | count.isNotNull(), F.lit("exact"))
    wall = wall.when(F.size("_held") == 2, F.lit("twice")).when(F.size("_held") == 0, F.lit("skipped")).otherwise(F.lit("once"))
    return df.select("_row.*", micros.alias("utc_micros"), wall.alias("wall"))


def found(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(row_id, utc_micros) of the dates that name an instant but aren't in the one form."""
    odd = rows.where(F.col("date").isNotNull() & ~F.col("date").rlike(EXACT)).select("row_id", "source", "date")
    return to_utc(odd, sources).where("utc_micros is not null").select("row_id", "utc_micros")
