"""What bytes are: kinds of files, encodings of text, turns of photographs, character maps, content streams."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType, StructField, StructType

# Endings by kind.
ACCEPTED = {"image": "jpe?g|png|webp", "office": "docx|xlsx|pptx", "text": "txt|text|log|csv|tsv|md|markdown|mdown|mkd|mkdn"}
TEXT_KINDS = (("markdown", "md|markdown|mdown|mkd|mkdn"), ("csv", "csv|tsv"), ("text", "txt|text|log"))


def accepted(name: Column) -> Column:
    out = F
    for kind, ends in ACCEPTED.items():
        out = out.when(name.rlike(rf"(?i)\.({ends})$"), kind)
    return out.when(name.rlike(r"(?i)\.pdf$"), "pdf")


def text_kind(name: Column, forced: Column | None = None) -> Column:
    out = F.when(forced.isNotNull(), forced) if forced is not None else F.when(F.lit(False), "")
    for kind, ends in TEXT_KINDS:
        out = out.when(name.rlike(rf"(?i)\.({ends})$"), kind)
    return out


def image_kind(data: Column) -> Column:
    """By the first bytes, whatever the name says."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.rlike("^52494646.{8}57454250"), "webp")


def fnv(data: bytes) -> str:
    """Length and 32-bit FNV-1a hash, the identity of bytes that have no other."""
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return f"{len(data)}:{h:x}"


@F.pandas_udf(StringType())
def fingerprint(data: pd.Series) -> pd.Series:
    return data.map(lambda b: fnv(bytes(b or b"")))


def decoded(data: bytes) -> tuple[str, str]:
    """Text and encoding: by its mark; by where the NULs are; as UTF-8 if it is; else as Windows-1252."""
    for mark, codec, name in ((b"\xef\xbb\xbf", "utf-8", "UTF-8 mark"), (b"\xff\xfe", "utf-16-le", "UTF-16LE mark"), (b"\xfe\xff", "utf-16-be", "UTF-16BE mark")):
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace"), name
    head = data[:2048]
    even, odd = head[::2].count(0), head[1::2].count(0)
    if len(head) >= 8 and even + odd > 0.2 * len(head):
        return (data.decode("utf-16-le", "replace"), "UTF-16LE") if odd >= even else (data.decode("utf-16-be", "replace"), "UTF-16BE")
    try:
        return data.decode(), "UTF-8"
    except UnicodeDecodeError:
        # the five bytes that the code page leaves open are controls
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data), "Windows-1252"


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def decode_text(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decoded(bytes(b or b"")) for b in data], columns=["text", "encoding"])


def one_newline(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\ufeff"), F.lit(""))


# Fixed value: the turn of each orientation, clockwise; mirrored ones stay.
TURNS = {1: 0, 2: 0, 3: 180, 4: 0, 5: 0, 6: 90, 7: 0, 8: 270}


def orientation(data: bytes) -> int:
    """The orientation in a photograph's metadata; 1 without one."""
    at = 2
    while len(data) >= at + 4 and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        (size,) = struct.unpack_from(">H", data, at + 2)
        if size < 2:
            break
        if data[at + 1] == 0xE1 and data[at + 4 : at + 8] == b"Exif":
            block = data[at + 10 :]
            order = "<" if block[:2] == b"II" else ">"
            try:
                (table,) = struct.unpack_from(order + "I", block, 4)
                (count,) = struct.unpack_from(order + "H", block, table)
                for k in range(count):
                    tag, _, _, value = struct.unpack_from(order + "HHIH", block, table + 2 + 12 * k)
                    if tag == 0x0112:
                        return value if 1 <= value <= 8 else 1
            except struct.error:
                pass
            return 1
        at += 2 + size
    return 1


@F.pandas_udf(IntegerType())
def photo_turn(data: pd.Series) -> pd.Series:
    return data.map(lambda b: TURNS[orientation(bytes(b or b""))])


HEX = "<([0-9A-Fa-f]+)>"


def character_map(text: str) -> dict[int, str]:
    """Codes and their UTF-16 in hexadecimal: single ones, ranges that count up in the last unit, ranges with a list."""
    out: dict[int, str] = {}
    for kind, block in re.findall(r"beginbf(char|range)(.*?)endbf\1", text, re.S):
        if kind == "char":
            out.update((int(a, 16), b.upper()) for a, b in re.findall(rf"{HEX}\s*{HEX}", block))
            continue
        for a, b, to in re.findall(rf"{HEX}\s*{HEX}\s*{HEX}", block):
            first, last, unit = int(a, 16), int(b, 16), int(to[-4:], 16)
            out.update((code, f"{to[:-4].upper()}{unit + code - first:04X}") for code in range(first, min(last + 1, first + 65536)))
        for a, _, items in re.findall(rf"{HEX}\s*{HEX}\s*\[(.*?)\]", block, re.S):
            out.update((int(a, 16) + k, x.upper()) for k, x in enumerate(re.findall("<([0-9A-Fa-f]*)>", items)))
    return out


@F.pandas_udf(MapType(LongType(), StringType()))
def parse_cmap(text: pd.Series) -> pd.Series:
    return text.map(lambda t: character_map(t or ""))


def cmap_blocks(pairs: Column) -> Column:
    """The mappings of a map column as blocks of at most 100 in the order of their codes."""
    rows = F.array_sort(F.filter(F.map_entries(pairs), lambda e: F.length(e["value"]) > 0))
    line = lambda e: F.concat(F.lit("<"), F.lpad(F.hex(e["key"]), 4, "0"), F.lit("> <"), e["value"], F.lit(">"))
    starts = F.filter(F.transform(rows, lambda e, i: i), lambda i: i % 100 == 0)
    block = lambda i: F.concat(F.least(F.size(rows) - i, F.lit(100)).cast("string"), F.lit(" beginbfchar\n"), F.array_join(F.transform(F.slice(rows, i + 1, 100), line), "\n"), F.lit("\nendbfchar"))
    return F.array_join(F.transform(starts, block), "\n")


#: White space and comments; strings in hexadecimal; literals up to their first bracket; names; marks; all else.
PIECE = re.compile(r"[\x00\t\n\f\r ]+|%[^\r\n]*|<(?!<)([^>]*)>|(\()|(/[^\x00\t\n\f\r ()<>\[\]{}/%]*)|([()<>\[\]{}])|([^\x00\t\n\f\r ()<>\[\]{}/%]+)")
BRACKET = re.compile(r"\\.?|[()]", re.S)


def tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, value, start, end) of a content stream: hex, literal, name, other (marks and numbers), operator."""
    at = 0
    while found := PIECE.match(text, at):
        at = end = found.end()
        hexed, literal, name, mark, word = found.groups()
        if literal:
            depth = 1
            for b in BRACKET.finditer(text, end):
                depth += {"(": 1, ")": -1}.get(b[0], 0)
                if not depth:
                    end = b.end()
                    break
            else:
                end = len(text)
            yield "literal", text[at : end - 1], found.start(), end
            at = end
        elif hexed is not None:
            yield "hex", hexed, found.start(), end
        elif name:
            yield "name", name, found.start(), end
        elif mark:
            yield "other", mark, found.start(), end
        elif word:
            yield "other" if re.match(r"[+\-.\d,]", word) else "operator", word, found.start(), end


TOKEN = ArrayType(StructType([StructField("kind", StringType()), StructField("value", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


@F.pandas_udf(TOKEN)
def tokenise(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("kind", "value", "start", "end"), x)) for x in tokens(t or "")])


# Words in the names of fonts, and the families that stand in for them.
BOLD = r"\b(bold|black|heavy|semibold|demibold|extrabold|ultrabold|demi)\b"
ITALIC = r"\b(italic|oblique)\b"


def font_facts(raw: Column) -> Column:
    """name (without the tag of a subset), bold and italic, by the words of the name."""
    name = F.regexp_replace(raw, r"^[A-Z]{6}\+", "")
    words = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"))
    return F.struct(name.alias("name"), words.rlike(BOLD).alias("bold"), words.rlike(ITALIC).alias("italic"))


def dpi_ceiling(width: Column, height: Column, pixels: float = 12e6) -> Column:
    """The finest resolution at which a page of that size (in points) has no more pixels."""
    return F.floor(72 * F.sqrt(pixels / F.greatest(F.lit(1.0), width * height))).cast("long")


# Weights of the channels, and the curve of their brightness.
WEIGHTS = (0.2126, 0.7152, 0.0722)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Grey as bright as a colour of channels from 0 to 1, mixed in linear light."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    light = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    mixed = sum(w * light(unit(c)) for w, c in zip(WEIGHTS, (r, g, b)))
    return unit(F.when(mixed <= 0.0031308, mixed * 12.92).otherwise(1.055 * F.pow(mixed, F.lit(1 / 2.4)) - 0.055))


def luminance_of_inks(c: Column, m: Column, y: Column, k: Column) -> Column:
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return luminance(*(1 - F.least(F.lit(1.0), unit(v) + unit(k)) for v in (c, m, y)))


def colour(text: Column) -> Column:
    """r, g, b from 0 to 1 of #rgb or #rrggbb, with or without the mark; dark grey for anything else."""
    hexed = F.regexp_replace(F.trim(text), "^#", "")
    hexed = F.when(F.length(hexed) == 3, F.regexp_replace(hexed, "(.)", "$1$1")).otherwise(hexed)
    good = hexed.rlike("^[0-9a-fA-F]{6}$")
    part = lambda i: F.when(good, F.conv(F.substring(hexed, i, 2), 16, 10).cast("int") / 255.0).otherwise(0.2)
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def resolved(base: Column, target: Column) -> Column:
    """A package's path relative to a folder, with .. taken out."""
    parts = F.filter(F.concat(F.split(base, "/"), F.split(target, "/")), lambda p: ~p.isin("", "."))
    up = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def relationships(xml: Column, base: Column) -> Column:
    """id to path of a package part's relations; links to outside are left out."""
    tags = F.regexp_extract_all(xml, F.lit(r"<(?:\w+:)?Relationship(\s[^>]*)>"), F.lit(1))
    value = lambda t, n: F.regexp_extract(t, rf'\s{n}\s*=\s*"([^"]*)"', 1)
    rows = F.transform(tags, lambda t: F.struct(value(t, "Id").alias("id"), value(t, "Target").alias("target")))
    rows = F.filter(rows, lambda r: (r["id"] != "") & (r["target"] != "") & ~r["target"].rlike("(?i)^[a-z]+:"))
    return F.map_from_entries(F.transform(rows, lambda r: F.struct(r["id"], resolved(base, r["target"]))))


TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!][^>]*>|<(/?)(?:[\w.-]+:)?([\w.-]+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*?)(/?)>", re.S)


def outermost(xml: str, name: str) -> list[tuple[str, str]]:
    """(attributes, inner text) of the elements of a name that aren't within another such one, whatever their prefix."""
    out, depth, start, attributes = [], 0, 0, ""
    for m in TAG.finditer(xml):
        if m[2] != name:
            continue
        if m[1]:
            depth -= 1
            if not depth:
                out.append((attributes, xml[start : m.start()]))
            depth = max(depth, 0)
        elif not m[4]:
            depth += 1
            if depth == 1:
                start, attributes = m.end(), m[3].strip()
        elif not depth:
            out.append((m[3].strip(), ""))
    return out


ELEMENT = ArrayType(StructType([StructField("attributes", StringType()), StructField("inner", StringType())]))


@F.pandas_udf(ELEMENT)
def elements(xml: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("attributes", "inner"), e)) for e in outermost(x or "", n)] for x, n in zip(xml, name)])


def attribute(attributes: Column, name: str) -> Column:
    """The value of an attribute in double quotes; null without it."""
    p = rf'(?:^|\s){name}\s*=\s*"([^"]*)"'
    return F.when(attributes.rlike(p), F.regexp_extract(attributes, p, 1))
