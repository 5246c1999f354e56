"""Document dates: what is stored, what is typed, what is shown. A date without a zone stays without one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of stored and typed dates, the names of the months.
STORED = r"^\s*(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z|[+-])(\d{2})?'?(\d{2})?'?)?"
TYPED = r"^\s*(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?)?\s*(Z|[+-]\d{2}:?\d{2})?\s*$"
MONTHS = "January February March April May June July August September October November December".split()

NAMES = ("year", "month", "day", "hour", "minute", "second")
LEAST = (None, 1, 1, 0, 0, 0)


def _parts(text: Column, pattern: str, offset: Column) -> Column:
    """The parts, or null where they make no date. Days up to 31 in any month, and leap seconds, are let through."""
    found = [F.regexp_extract(text, pattern, k + 1) for k in range(6)]
    numbers = [F.when(v == "", least).otherwise(v.try_cast("int")) for v, least in zip(found, LEAST)]
    limits = zip(numbers, ((1, 9999), (1, 12), (1, 31), (0, 23), (0, 59), (0, 60)))
    valid = text.rlike(pattern)
    for n, (low, high) in limits:
        valid = valid & n.between(low, high)
    return F.when(valid, F.struct(*(n.alias(c) for n, c in zip(numbers, NAMES)), offset.alias("offset")))


def stored(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS with a zone, as leniently as producers write it."""
    mark, h, m = (F.regexp_extract(text, STORED, k) for k in (7, 8, 9))
    size = F.coalesce(h.try_cast("int"), F.lit(0)) * 60 + F.coalesce(m.try_cast("int"), F.lit(0))
    return _parts(text, STORED, F.when(mark == "Z", 0).when(mark == "+", size).when(mark == "-", -size))


def typed(text: Column) -> Column:
    """An ISO date, or a stored one that was pasted."""
    text = F.trim(text)
    zone = F.regexp_replace(F.regexp_extract(text, TYPED, 7), ":", "")
    size = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    iso = _parts(text, TYPED, F.when(zone == "Z", 0).when(zone.startswith("-"), -size).when(zone != "", size))
    return F.when(text.rlike(TYPED), iso).otherwise(stored(text))


def _two(n: Column, width: int = 2) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _zone(offset: Column, between: str, after: str = "") -> Column:
    size = F.abs(offset)
    text = F.concat(F.when(offset < 0, "-").otherwise("+"), _two(F.floor(size / 60)), F.lit(between), _two(size % 60), F.lit(after))
    return F.when(offset.isNull(), "").when(offset == 0, "Z").otherwise(text)


def to_store(d: Column) -> Column:
    return F.concat(F.lit("D:"), _two(d["year"], 4), *(_two(d[c]) for c in NAMES[1:]), _zone(d["offset"], "'", "'"))


def to_iso(d: Column) -> Column:
    day = F.concat_ws("-", _two(d["year"], 4), _two(d["month"]), _two(d["day"]))
    return F.when(d.isNotNull(), F.concat(day, F.lit("T"), F.concat_ws(":", *(_two(d[c]) for c in NAMES[3:])), _zone(d["offset"], ":")))


def to_read(d: Column) -> Column:
    """3 April 2026, 09:00:00 UTC+02:00, in the document's own zone."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), d["month"])
    stamp = F.concat(d["day"].cast("string"), F.lit(" "), month, F.lit(" "), d["year"].cast("string"), F.lit(", "), F.concat_ws(":", *(_two(d[c]) for c in NAMES[3:])))
    zone = F.when(d["offset"].isNull(), " (no time zone recorded)").when(d["offset"] == 0, " UTC").otherwise(F.concat(F.lit(" UTC"), _zone(d["offset"], ":")))
    return F.concat(stamp, zone)
