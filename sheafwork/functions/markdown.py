"""Markdown: classes of lines as columns; blocks and inline marks by a reader that goes over the text once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

# Patterns of lines, in the order in which they count.
PATTERNS = {
    "blank": r"^\s*$",
    "fence": r"^ {0,3}(`{3,}|~{3,})",
    "quote": r"^ {0,3}>",
    "rule": r"^ {0,3}(\*(\s*\*){2,}|-(\s*-){2,}|_(\s*_){2,})\s*$",
    "heading": r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$",
    "item": r"^(\s*)([-*+]|\d{1,9}[.)])[ \t]+(.*)$",
    "delimiter": r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$",
}
READ = {k: re.compile(p) for k, p in PATTERNS.items()}
UNDERLINE = re.compile(r"^ {0,3}(=+|-+)\s*$")


def line_class(line: Column) -> Column:
    out = F
    for name, pattern in PATTERNS.items():
        out = out.when(line.rlike(pattern), name)
    return out.otherwise("text")


def table_cells(line: Column) -> Column:
    """The cells of a table's row: cut at bars that aren't escaped; bars at the ends don't count."""
    text = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    cells = F.split(F.replace(text, F.lit("\\|"), F.lit("\0")), r"\|", -1)
    return F.transform(cells, lambda c: F.trim(F.replace(c, F.lit("\0"), F.lit("|"))))


@dataclass(frozen=True)
class Run:
    text: str = ""
    bold: bool = False
    italic: bool = False
    mono: bool = False
    strike: bool = False
    link: str | None = None


MARK = re.compile(
    r"\\(?P<escaped>[\\`*_{}\[\]()#+\-.!>~|])"
    r"|(?P<fence>`+)"
    r"|<(?P<auto>(?:https?|mailto):[^\s>]+)>"
    r"|!\[(?P<image>[^\]]*)\]\([^)]*\)"
    r"|(?P<open>\[)"
    r"|(?P<strike>~~)"
    r"|(?P<stress>\*+|_+)"
)


def link_at(text: str, at: int) -> tuple[str, str, int] | None:
    """(label, target, end) of the link whose label begins after `at`: brackets are balanced, escapes skipped."""
    depth, close = 1, -1
    for m in re.finditer(r"\\.|[\[\]]", text[at:], re.S):
        depth += {"[": 1, "]": -1}.get(m[0], 0)
        if not depth:
            close = at + m.start()
            break
    if close < 0 or text[close + 1 : close + 2] != "(":
        return None
    depth, target = 1, ""
    for m in re.finditer(r"\\(.)|([()])|(\n)|[^\\()\n]+", text[close + 2 :], re.S):
        if m[3]:
            return None
        depth += {"(": 1, ")": -1}.get(m[2], 0)
        if not depth:
            words = target.split()
            return text[at:close], (words[0] if words else "").removeprefix("<").removesuffix(">"), close + 2 + m.end()
        target += m[1] or m[0]
    return None


def inline(text: str, base: Run = Run()) -> Iterator[Run]:
    """Runs of one style. What is inside a mark is read under its style; an open mark without an end is text."""
    at, plain = 0, ""
    while m := MARK.search(text, at):
        plain, at = plain + text[at : m.start()], m.end()
        kind, inner, style = m.lastgroup, None, {}
        if kind == "escaped":
            plain += m[kind]
            continue
        if kind == "fence" and (end := text.find(m[kind], at)) > 0 and "\n\n" not in text[at:end]:
            inner, style, after = re.sub(r"^ (.*) $", r"\1", text[at:end]), {"mono": True, "bold": False, "italic": False}, end + len(m[kind])
        elif kind == "auto":
            inner, style, after = m[kind], {"link": m[kind]}, at
        elif kind == "image":
            inner, style, after = f"[{m[kind] or 'image'}]", {"italic": True}, at
        elif kind == "open" and (found := link_at(text, at)):
            inner, style, after = found[0], {"link": found[1]}, found[2]
        elif kind == "strike" and (end := text.find("~~", at)) > 0:
            inner, style, after = text[at:end], {"strike": True}, end + 2
        elif kind == "stress":
            size = min(len(m[kind]), 3)
            start, before = m.start() + size, text[m.start() - 1 : m.start()]
            free = m[kind][0] == "*" or not before or re.match(r"[\s(\[{\"']", before)
            end = text.find(m[kind][0] * size, start) if free else -1
            if end > start:
                inner, style, after = text[start:end], {"bold": size > 1, "italic": size != 2}, end + size
                style = {k: True for k, v in style.items() if v}
        if inner is None:  # only the first character is text
            first = m.start() + 1
            plain, at = plain + text[m.start() : first], first
            continue
        if plain:
            yield replace(base, text=plain)
        plain, at, own = "", after, replace(base, **style)
        if kind in ("open", "strike", "stress"):
            yield from inline(inner, own)
        elif inner:
            yield replace(own, text=inner)
    if plain + text[at:]:
        yield replace(base, text=plain + text[at:])


def runs(text: str, base: Run = Run()) -> list[Run]:
    """inline(), with neighbours of one style as one."""
    out: list[Run] = []
    for r in inline(text, base):
        if out and replace(out[-1], text="") == replace(r, text=""):
            out[-1] = replace(r, text=out[-1].text + r.text)
        else:
            out.append(r)
    return out


def plain(text: str) -> str:
    return "".join(r.text for r in runs(text))


Block = tuple[str, int, int, str]


def is_(kind: str, line: str) -> re.Match | None:
    return READ[kind].match(line)


def cells_of(line: str) -> list[str]:
    text = re.sub(r"^\||\|$", "", line.strip()) if line.strip() != "|" else ""
    return [c.replace("\0", "|").strip() for c in text.replace("\\|", "\0").split("|")]


def blocks(lines: list[str], quote: int = 0) -> Iterator[Block]:
    """(kind, level, depth of quotes, text) of the blocks: code, rule, heading, table (cells by tabs, rows by newlines),
    item and numbered (level by indent), para."""
    at = 0

    def upto(stop) -> list[str]:
        nonlocal at
        first = at
        while at < len(lines) and not stop(lines[at]):
            at += 1
        return lines[first:at]

    starts = lambda line, kinds: any(is_(k, line) for k in kinds)
    while at < len(lines):
        line = lines[at]
        if is_("blank", line):
            at += 1
        elif m := is_("fence", line):
            at += 1
            end = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$")
            yield "code", 0, quote, "\n".join(upto(end.match))
            at += 1
        elif is_("quote", line):
            yield from blocks([re.sub("^ {0,3}> ?", "", x) for x in upto(lambda x: is_("blank", x))], quote + 1)
        elif is_("rule", line):
            at += 1
            yield "rule", 0, quote, ""
        elif m := is_("heading", line):
            at += 1
            yield "heading", len(m[1]), quote, plain(m[2])
        elif "|" in line and at + 1 < len(lines) and "-" in lines[at + 1] and is_("delimiter", lines[at + 1]):
            at += 2
            rows = [line, *upto(lambda x: "|" not in x or is_("blank", x))]
            yield "table", len(rows), quote, "\n".join("\t".join(map(plain, cells_of(x))) for x in rows)
        elif m := is_("item", line):
            at += 1
            more = upto(lambda x: starts(x, ("blank", "item", "heading", "fence", "quote", "rule")))
            text = " ".join([m[3], *(x.strip() for x in more)])
            yield "numbered" if m[2][0].isdigit() else "item", min(len(m[1].expandtabs(4)) // 2, 5), quote, plain(text)
        else:
            body: list[str] = []
            while at < len(lines) and not starts(lines[at], ("blank", "item", "heading", "fence", "quote")):
                if at + 1 < len(lines) and UNDERLINE.match(lines[at + 1]):
                    text, level = " ".join([*body, lines[at]]).strip(), 1 if lines[at + 1].strip()[0] == "=" else 2
                    at, body = at + 2, []
                    yield "heading", level, quote, plain(text)
                    break
                if body and is_("rule", lines[at]):
                    break
                body.append(lines[at].rstrip() + "\n" if re.search(r"(\s{2,}|\\)$", lines[at]) else lines[at])
                at += 1
            if body:
                yield "para", 0, quote, plain(" ".join(body).strip())


RUNS = ArrayType(StructType([StructField("text", StringType()), *(StructField(c, BooleanType()) for c in ("bold", "italic", "mono", "strike")), StructField("link", StringType())]))
BLOCKS = ArrayType(StructType([StructField("kind", StringType()), StructField("level", IntegerType()), StructField("quote", IntegerType()), StructField("text", StringType())]))


@F.pandas_udf(RUNS)
def inline_runs(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [vars(r) for r in runs(t or "")])


@F.pandas_udf(BLOCKS)
def block_rows(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("kind", "level", "quote", "text"), b)) for b in blocks((t or "").split("\n"))])


def written(kind: Column, level: Column, text: Column) -> Column:
    """A block as Markdown: headings, list items, code and paragraphs."""
    mark = F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "))).when(kind == "item", "- ").when(kind == "numbered", "1. ").otherwise("")
    return F.when(kind == "rule", "---").when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).otherwise(F.concat(mark, text))
