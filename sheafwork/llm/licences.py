"""Licence scan: identifier tags and notice phrases by Aho-Corasick, expressions by a shunting-yard parser.

A text is lower-cased (A-Z only) and cut into words of digits, a-z and non-ASCII characters. Base phrases are found
where their words stand consecutively. Beyond them, further notice phrases are found in the same pass, and after each
`SPDX-License-Identifier:` tag the rest of the line is parsed: identifiers joined by AND, OR, WITH and parentheses,
WITH binding tightest and OR loosest. Each expression is evaluated to a permissiveness between 0 and 1: OR takes the
freest side, AND the strictest, WITH lifts its licence half-way to 1. The score is that of the strictest notice or
expression in the document, 0 where there is none.

Rows: one out for one in. Null or empty text: no words, no labels, score 0, null positions. Null ids: kept. Repeated
rows: repeated results. Very long texts: whole, expressions too. Ties between labels: all are named. Empty table: no
rows. Further columns, whatever their names, are left out.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .common import by_bytes, texts

# Fixed values of the contract: phrase and label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Further notice phrases, as words of the text.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
}

# How freely a work under a label may be used.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0,
    "mit": 0.9, "apache": 0.9, "bsd": 0.9, "isc": 0.9, "bsl": 0.9, "zlib": 0.9,
    "cc-by": 0.8,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.6,
    "gpl": 0.4, "cc-by-sa": 0.4,
    "agpl": 0.3, "cc-by-nc": 0.3,
    "proprietary": 0.1,
}
UNKNOWN = 0.2

TAG = "spdx-license-identifier:"
OPERATORS = {"or": 1, "and": 2, "with": 3}
#: ASCII: capitals to small letters, all but digits and letters to spaces; other bytes stay.
FOLD = bytes(32 if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))


def family(identifier: str) -> str:
    """The label of an SPDX identifier: gpl-3.0-or-later is gpl, cc-by-nc-4.0 is cc-by-nc."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    name = re.sub(r"-v?\d[\w.]*(-clause)?$", "", name)
    return re.sub(r"^(bsd|mit|isc|apache)-.*$", r"\1", name) or identifier.lower()


def parse(expression: str) -> list[str] | None:
    """The expression in postfix order; None where it isn't one."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand comes next
    for token in re.findall(r"[()]|[^\s()]+", expression.lower()):
        if token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in OPERATORS:
            if operand:
                return None
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """Permissiveness and the labels named; exceptions are no labels."""
    stack: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token not in OPERATORS:
            label = family(token)
            stack.append((FREEDOM.get(label, UNKNOWN), {label}))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(((a + 1) / 2, left))
        else:
            stack.append(((max if token == "or" else min)(a, b), left | right))
    return stack[0]


#: Ends of an expression, brackets, words.
TOKENS = re.compile(r"\*/|-->|[\r\n,;]|[()]|(?:(?!\*/|-->)[^\s(),;])+")


def leading(text: str, start: int = 0) -> list[str] | None:
    """The longest expression at the place; no more is read than goes on with it."""
    kept: list[str] = []
    operand, depth, best = True, 0, 0
    for found in TOKENS.finditer(text, start):  # an operand follows an operand: prose begins
        t = found[0] if found[0] in "()" else found[0].rstrip(".")
        word = t.lower()
        if t == "(" and operand:
            depth += 1
        elif t == ")" and not operand and depth:
            depth -= 1
        elif word in OPERATORS and not operand:
            operand = True
        elif t not in "()" and word not in OPERATORS and operand and re.fullmatch(r"[\w.+:-]+", t) and TAG not in word:
            operand = False
        else:
            break
        kept.append(t)
        if not operand and not depth:
            best = len(kept)
    return parse(" ".join(kept[:best])) if best else None


@functools.lru_cache(maxsize=1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases = ahocorasick.Automaton()
    for k, v in (NOTICES | BASE).items():
        phrases.add_word(f" {k} ", (len(k) + 2, v, k in BASE))
    phrases.make_automaton()
    tags = ahocorasick.Automaton()
    tags.add_word(TAG, len(TAG))
    tags.make_automaton()
    return phrases, tags


def scan(text: str) -> tuple:
    phrases, tags = automata()
    words = text.encode().translate(FOLD).split()
    flat = f" {b' '.join(words).decode('latin-1')} " if words else ""
    starts, base, labels, freedom = [], set(), set(), []
    at = word = 0
    for end, (length, label, is_base) in phrases.iter(flat):
        labels.add(label)
        freedom.append(FREEDOM[label])
        if is_base:
            start = end + 1 - length
            if start < at:
                word -= flat.count(" ", start, at)
            else:
                word += flat.count(" ", at, start)
            at = start
            starts.append(word)
            base.add(label)
    lower = text.lower() if ":" in text else ""
    if TAG in lower:
        flat_text = text.encode().lower().decode()
        for end, _ in tags.iter(flat_text):
            postfix = leading(text, end + 1)
            if postfix:
                score, named = evaluate(postfix)
                freedom.append(score)
                labels |= named
    join = lambda x: ",".join(sorted(x))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), join(base), join(labels), min(freedom, default=0.0)


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            columns = zip(*map(scan, texts(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
