"""Addresses, connection strings, permissions and what a file's bytes give away."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def refusal(url: str | None) -> str | None:
    """Why an address may not be fetched, without asking any name server; null if nothing speaks against it."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname
    except ValueError:
        return "host"
    if parts.scheme not in ("http", "https"):
        return "scheme"
    if not host:
        return "host"
    if host == "localhost" or host.endswith(".localhost"):
        return "private"
    try:
        ip = ipaddress.ip_address(int(host, 0) if host.isdecimal() or host.startswith("0x") else host)
    except ValueError:
        return None
    inner = getattr(ip, "ipv4_mapped", None) or ip
    bad = any(x.is_private or x.is_loopback or x.is_link_local or x.is_reserved or x.is_multicast or x.is_unspecified or not x.is_global for x in (ip, inner)[-1:])
    return "private" if bad else None


@F.pandas_udf(StringType())
def url_refusal(url: pd.Series) -> pd.Series:
    return url.map(refusal, na_action=None).astype(object).where(lambda x: x.notna(), None)


# Fixed value: parameters of one driver that the other refuses.
DROPPED = ("sslmode", "channel_binding", "options")


def database_url(url: Column) -> Column:
    """url (for the asynchronous driver) and pooled, of a connection string as a provider shows it."""
    scheme = F.regexp_replace(url, "^postgres(ql)?://", "postgresql+asyncpg://")
    head, query = F.regexp_extract(scheme, r"^([^?#]*)", 1), F.regexp_extract(scheme, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*DROPPED))
    pairs = F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    host = F.regexp_extract(url, r"^[^:]+://(?:[^@/]*@)?([^:/?#]*)", 1)
    out = F.concat(head, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""), F.regexp_extract(scheme, "(#.*)$", 1))
    return F.struct(out.alias("url"), host.contains("-pooler").alias("pooled"))


# The bits of a permission word and what is denied where they are clear.
RIGHTS = ((4, "printing"), (8, "editing"), (16, "copying text"), (32, "commenting"), (256, "filling in forms"), (1024, "reordering pages"))
FULL_PRINT = (2048, "printing at full resolution")


def lifted(permissions: Column) -> Column:
    """What a permission word denies; printing at full resolution counts only where printing is allowed."""
    off = lambda b: permissions.bitwiseAND(b) == 0
    labels = [F.when(off(b), name) for b, name in RIGHTS] + [F.when(~off(4) & off(FULL_PRINT[0]), FULL_PRINT[1])]
    return F.filter(F.array(*labels), lambda x: x.isNotNull())


def as_text(data: Column) -> Column:
    """Bytes as characters, one each."""
    return F.decode(data, "ISO-8859-1")


def revisions(data: Column) -> Column:
    return F.regexp_count(as_text(data), F.lit("%%EOF")).cast("long")


def verdict(original: Column, candidate: Column) -> Column:
    """Why a rewritten file is refused, by its bytes; null if they are in order."""
    text = as_text(candidate)
    ended = F.regexp_replace(F.substring(text, -1024, 1024), r"\s+$", "").endswith("%%EOF")
    return (
        F.when(F.octet_length(candidate) == 0, "empty")
        .when(F.octet_length(candidate) >= F.octet_length(original), "not smaller")
        .when(~text.startswith("%PDF"), "not a document")
        .when(~ended, "truncated")
        .when(revisions(candidate) != 1, "revisions")
    )


def stripped(data: Column) -> Column:
    """Why a file isn't clean of metadata, by its bytes; null if it is."""
    text = as_text(data)
    return F.when(revisions(data) != 1, "revisions").when(text.contains("<?xpacket") | text.contains("<x:xmpmeta"), "packet")
