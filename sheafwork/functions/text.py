"""Functions of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \t\n\r]+"), lambda w: w != "")


# Fixed values of heading levels: least size against the body and level; then with at most eight words.
SIZES = ((1.6, 1), (1.32, 2), (1.15, 3))
SHORT_SIZE, SHORT_LEVEL, BOLD_SIZE, LABEL_LEVEL, SHORT, LONG = 1.09, 3, 1.02, 4, 8, 14


def heading_level(text: Column, ratio: Column, bold: Column | None = None) -> Column:
    """1 to 4, or 0 for no heading: by size against the body; if short, also a little larger, bold or in capitals."""
    n = F.size(words(text))
    short = n <= SHORT
    out = F.when(n > LONG, 0)
    for size, level in SIZES:
        out = out.when(ratio >= size, level)
    out = out.when(short & (ratio >= SHORT_SIZE), SHORT_LEVEL)
    out = out.when(short & (ratio >= BOLD_SIZE) & (F.lit(False) if bold is None else bold), LABEL_LEVEL)
    return out.when(short & ~text.rlike("[a-z]") & text.rlike("[A-Z]{3}"), LABEL_LEVEL).otherwise(0)


# Fixed value: numbered list marks.
NUMBERED = r"(?i)^\s*(\d{1,3}|[a-z]|[ivxlcdm]{1,5})[.)]\s+"


def list_marker(text: Column, bullets: Column | None = None) -> Column:
    """marker, rest and ordered of a list item, null where there is none; bullets: the marks that count, as an array."""
    text = F.trim(text)
    mark = F.regexp_extract(text, r"^(\S{1,2})\s+", 1)
    rest = lambda p: F.regexp_replace(text, p, "")
    plain = F.lit(False) if bullets is None else (mark != "") & F.array_contains(bullets, mark)
    item = lambda m, r, o: F.struct(m.alias("marker"), r.alias("rest"), F.lit(o).alias("ordered"))
    return F.when(plain, item(mark, rest(r"^\S{1,2}\s+"), False)).when(text.rlike(NUMBERED), item(F.regexp_extract(text, NUMBERED, 1), rest(NUMBERED), True))


def running_signature(text: Column, baseline: Column, bottom: Column, height: Column) -> Column:
    """What a line must share with lines of other pages to be a running head or foot: its margin, and its text in small
    letters with numbers as #. Empty outside the margins."""
    zone = F.when(baseline < 0.12 * height, "top:").when(bottom > 0.88 * height, "bottom:")
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\d+", "#"), r"\s+", " ")
    return F.coalesce(F.when(plain != "", F.concat(zone, plain)), F.lit(""))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tabs_expanded(line: Column, width: int) -> Column:
    """Tabs as spaces up to the next stop. Between tabs there is text only, so a fold over the pieces suffices."""
    pieces = F.split(line, "\t", -1)
    upto = lambda done, piece: F.concat(F.rpad(done, (F.floor(F.length(done) / width) + 1).cast("int") * width, " "), piece)
    return F.aggregate(F.slice(pieces, 2, F.size(pieces)), pieces[0], upto)


def dehyphenated(text: Column, after: Column) -> Column:
    """Two lines joined; a hyphen after a small letter and before one goes."""
    broken = text.rlike(r"\p{Ll}[-\u2010]$") & after.rlike(r"^\p{Ll}")
    return F.when(broken, F.concat(F.regexp_replace(text, "[-\u2010]$", ""), after)).otherwise(F.concat_ws(" ", text, after))


def expanded(template: str, values: dict[str, Column]) -> Column:
    """{name} by its value, in any case and with spaces; {{ and }} are braces; unknown names stay. The template is
    read once, on the driver."""
    out: list[Column] = []
    at, plain = 0, ""
    while at < len(template):
        two = template[at : at + 2]
        end = template.find("}", at)
        name = template[at + 1 : end].strip().lower() if template[at] == "{" and end > 0 else ""
        if two in ("{{", "}}"):
            plain, at = plain + two[0], at + 2
        elif name in values:
            out += [F.lit(plain), values[name].cast("string")]
            plain, at = "", end + 1
        else:
            plain, at = plain + template[at], at + 1
    return F.concat(*out, F.lit(plain))


# Names that a file system keeps for itself, and the lengths of names made from titles.
DEVICES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"
TITLE, BREAK = 60, 24


def slug(title: Column) -> Column:
    """A file name from a title: cut at TITLE characters, at the last dash where that is beyond BREAK; empty where
    nothing is left or the name is kept by a system."""
    ends = lambda c: F.regexp_replace(c, r"^[.\-]+|[.\-]+$", "")
    text = F.regexp_replace(F.regexp_replace(title, r"[\x00-\x1f\x7f]", " "), r'[\\/:*?"<>|]', "-")
    text = ends(F.regexp_replace(F.replace(collapsed(text), F.lit(" "), F.lit("-")), "-{2,}", "-"))
    head = F.substring(text, 1, TITLE)
    whole = F.regexp_replace(head, "-[^-]*$", "")
    short = ends(F.when((F.length(text) > TITLE) & (F.length(whole) > BREAK) & head.contains("-"), whole).otherwise(head))
    return F.when(short.rlike(DEVICES), "").otherwise(short)


def strength(bits: Column) -> Column:
    return F.when(bits < 40, "Weak").when(bits < 60, "Fair").when(bits < 80, "Strong").otherwise("Very strong")


# The kinds of characters and how many there are of each.
def entropy_bits(secret: Column) -> Column:
    """Bits of a password by the kinds of characters in it; repeated characters make it count as shorter."""
    has = lambda p, n: F.when(secret.rlike(p), n).otherwise(0)
    alphabet = has("[a-z]", 26) + has("[A-Z]", 26) + has("[0-9]", 10) + has("[^A-Za-z0-9]", 32)
    n = F.length(secret).cast("double")
    unique = F.size(F.array_distinct(F.filter(F.split(secret, ""), lambda c: c != "")))
    bits = F.floor(F.least(n, unique + 2.0) * F.log2(F.greatest(alphabet, F.lit(2)).cast("double")) + 0.5).cast("long")
    return F.when(n == 0, 0).otherwise(bits).cast("long")


def unescaped(text: Column) -> Column:
    """The five names, and characters by number; an ampersand that comes of it isn't read again."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(&#x[0-9a-fA-F]{1,6};|&#\d{1,7};|&|[^&]+)"), F.lit(1))
    number = lambda x: F.when(x.startswith("&#x"), F.conv(F.regexp_extract(x, "&#x([0-9a-fA-F]+);", 1), 16, 10).cast("int")).otherwise(F.regexp_extract(x, r"&#(\d+);", 1).try_cast("int"))
    # a code point as big-endian UTF-32
    char = lambda x: F.decode(F.unhex(F.lpad(F.hex(number(x)), 8, "0")), "UTF-32")
    read = F.array_join(F.transform(parts, lambda x: F.when(x.startswith("&#"), char(x)).otherwise(x)), "")
    out = F.when(text.contains("&#"), read).otherwise(text)
    for name, char_ in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char_))
    return out


def escaped(text: Column) -> Column:
    """For XML: what it can't hold goes, one kind of newline."""
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\ufeff]", "")
    text = F.regexp_replace(text, r"\r\n?", "\n")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def escaped_attribute(text: Column) -> Column:
    text = escaped(text)
    for char, name in (('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


# A word is garbled if it has a mark between letters (but for apostrophes and hyphens), or a letter
# beside a digit; a fragment is one or two letters.
GARBLED = r"[A-Za-z][^A-Za-z0-9\s'\u2019-][A-Za-z]|[A-Za-z]\d|\d[A-Za-z]"
FRAGMENT = "^[A-Za-z]{1,2}$"


def noise(text: Column) -> Column:
    """n words of two letters or more, garbled and fragments among them, and whether it looks like poor recognition."""
    long = F.filter(F.split(text, "[ \t\n\r]+"), lambda w: F.length(w) > 1)
    size = lambda p: F.size(F.filter(long, lambda w: w.rlike(p))).cast("long")
    n, garbled, fragments = F.size(long).cast("long"), size(GARBLED), size(FRAGMENT)
    noisy = (n >= 60) & (garbled >= 0.08 * n) & (fragments >= 0.08 * n)
    return F.struct(n.alias("n"), garbled.alias("garbled"), fragments.alias("fragments"), noisy.alias("noisy"))


# What a font of one byte a character can spell beyond Latin-1, and stand-ins for what it can't.
HIGH = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
SPELLED = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
    "←": "<-", "→": "->", "↔": "<->", "⇒": "=>", "⇐": "<=", "≤": "<=", "≥": ">=", "≠": "!=",
}
SAME = {
    "‐": "-", "‑": "-", "‒": "-", "―": "—", "−": "-", "′": "'", "″": '"', "‵": "'", "‶": '"', "ʼ": "'",
    "⁄": "/", "∕": "/", "∶": ":", "≈": "~", "●": "•", "▪": "•", "◦": "•", "⁃": "•",
    " ": " ", " ": " ", "　": " ", **{chr(c): " " for c in range(0x2000, 0x200B)},
}
GONE = "​‌‍﻿­"
NATIVE = rf"[\x20-\x7e -ÿ{HIGH}]"


def folded(text: Column) -> Column:
    """With stand-ins for what a font of one byte a character can't spell; tabs as four spaces, no controls."""
    text = F.translate(text, "".join(SAME) + GONE, "".join(SAME.values()))
    for char, spelled in SPELLED.items():
        text = F.replace(text, F.lit(char), F.lit(spelled))
    return F.regexp_replace(F.replace(text, F.lit("\t"), F.lit("    ")), r"[\x00-\x1f\x7f-\x9f]", "")


def needs_fallback(text: Column) -> Column:
    return folded(text).rlike(NATIVE.replace("[", "[^", 1))


def segments(text: Column) -> Column:
    """The folded text in runs that a font can spell and runs that it can't: text and native."""
    other = NATIVE.replace("[", "[^", 1)
    found = F.regexp_extract_all(folded(text), F.lit(f"({NATIVE}+|{other}+)"), F.lit(1))
    return F.transform(found, lambda s: F.struct(s.alias("text"), s.rlike(f"^{NATIVE}").alias("native")))


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most `width` characters of one width, cut after the last space or else anywhere; together they are the
    text, but for its newlines. Short of a fold over characters: a line is what a pattern matches from where it begins."""
    paragraphs = F.split(F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\t"), F.lit("    ")), "\n", -1)
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= width, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(rf"(?s)(.{{1,{width}}}$|.{{0,{width - 1}}} (?!$)|.{{1,{width}}})"), F.lit(1)))))
