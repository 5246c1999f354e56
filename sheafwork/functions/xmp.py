"""Fields of metadata packets, whichever of their three spellings a producer took: element, list or attribute."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Fixed value: prefixes of the packet's own structure.
STRUCTURE = ("rdf", "x", "xml", "xmlns")
OPEN = re.compile(r"<([\w.-]+):([\w.-]+)((?:\s[^>]*?)?)(/?)>")
ATTRIBUTE = re.compile(r"""(?:^|[\s<])([\w.-]+):([\w.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
ITEM = re.compile(r"<rdf:li(?:\s[^>]*?)?>(.*?)</rdf:li>", re.S)


def fields(packet: str) -> dict[str, str]:
    """Values by field, in the order in which fields are found; further values that aren't part of what is there are
    added after a comma."""
    out: dict[str, str] = {}

    def put(field: str, value: str) -> None:
        value = " ".join(html.unescape(value).split())
        if value and value not in out.get(field, ""):
            out[field] = f"{out[field]}, {value}" if field in out else value

    for m in OPEN.finditer(packet):  # elements within others are visited too
        end = packet.find(f"</{m[1]}:{m[2]}>", m.end())
        if m[4] or m[1] in STRUCTURE or end < 0:
            continue
        body = packet[m.end() : end]
        for value in ITEM.findall(body) if "<rdf:li" in body else [] if "<" in body else [body]:
            put(f"{m[1]}:{m[2]}", value)
    for m in ATTRIBUTE.finditer(packet):
        if m[1] not in STRUCTURE:
            put(f"{m[1]}:{m[2]}", m[3] if m[3] is not None else m[4])
    return out


FIELD = ArrayType(StructType([StructField("field", StringType()), StructField("value", StringType())]))


@F.pandas_udf(FIELD)
def packet_fields(packet: pd.Series) -> pd.Series:
    return packet.map(lambda p: [{"field": k, "value": v} for k, v in fields(p or "").items()])
