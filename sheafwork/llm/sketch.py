"""Threshold-scaled sketches: of all shingle hashes of a text, those below a fixed fraction of the hash range.

A shingle is SHINGLE consecutive bytes of the UTF-8 text (a shorter text is one shingle). The retained set of a union
is the union of the retained sets, and for documents of any two lengths |A and B| / |A| estimates how much of A lies
in B. A fingerprint is the retained hashes, sorted, as base64 of little-endian 32-bit integers: the bits that follow
those which are zero in every retained hash. A text that retains none, as short ones may, has the same bits of its
least hash instead, so only the empty text has the empty fingerprint. Likeness is the larger of both containments; two
empty texts are alike (1), an empty and another one aren't (0). Where a sketch holds fewer than FEW hashes, all shingles
of both texts are compared, so the likeness of short texts is no estimate.

edited(): each document's text with its second half replaced by the beginning of the next document's, in descending
doc_id (then text, for repeated ids), the first following the last; null ids come last. The order is a range
partitioning; the head of each range is also dealt to the range before it, so no range needs more than its own rows.

Rows: one out for one in. Null text: empty; empty text: no shingles, empty fingerprint. Very long texts: whole, piece by
piece. Empty table: no rows. Further columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

SHINGLE = 16
#: One of 2 ** SHIFT shingle hashes is retained.
SHIFT = 4
LONG = 1 << 22
#: Sketches of fewer hashes estimate too little.
FEW = 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def eights(raw: bytes) -> np.ndarray:
    """The 64-bit word at each byte offset."""
    n = len(raw) - 7
    out = np.empty(n, np.uint64)
    for i in range(min(8, n)):
        part = np.frombuffer(raw, "<u8", (len(raw) - i) // 8, i)
        out[i::8] = part
    return out


def hashes(text: str) -> Iterator[np.ndarray]:
    """The hashes of all shingles. Long texts go through piece by piece."""
    raw = text.encode()
    if not raw:
        return
    raw = raw.ljust(SHINGLE, b"\0")
    for at in range(0, len(raw) - SHINGLE + 1, LONG):
        words = eights(raw[at : at + LONG + SHINGLE - 1])
        h = words[8:] * np.uint64(0x9E3779B97F4A7C15)
        h ^= words[:-8]
        yield mixed(h)


def sketch(text: str) -> np.ndarray:
    """The retained hashes as sorted unsigned 32-bit integers; without any, the least hash."""
    short = lambda h: (h >> np.uint64(32 - SHIFT)).astype(np.uint32)
    found, least = [], None
    for h in hashes(text):
        found.append(np.unique(short(h[h < np.uint64(1 << (64 - SHIFT))])))
        if not len(found[-1]):
            least = h.min() if least is None else min(least, h.min())
    out = np.empty(0, np.uint32) if not found else found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    return out if len(out) or least is None else short(np.array([least]))


def fingerprint(kept: np.ndarray) -> str:
    return base64.b64encode(kept.astype("<u4").tobytes()).decode()


def kept_in(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def merged(a: str, b: str) -> str:
    """The fingerprint of both texts' shingles together."""
    return fingerprint(np.union1d(kept_in(a), kept_in(b)))


def common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """How much of a lies in b."""
    return common(a, b) / len(a) if len(a) else float(not len(b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return common(a, b) / min(len(a), len(b))


def exact(a: str, b: str) -> float:
    """Likeness by all shingles, for texts of which one has a small sketch. Of the larger set no more is held than says
    that it is the larger."""
    if not a or not b:
        return float(a == b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    own, other, shared = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    for h in hashes(small):
        own = np.union1d(own, h)
    for h in hashes(large):
        shared = np.union1d(shared, h[np.isin(h, own)])
        if len(other) < len(own):
            other = np.union1d(other, h)
    return len(shared) / min(len(own), len(other))


def likeness_of(a: str, b: str, of_a: np.ndarray, of_b: np.ndarray) -> float:
    """Likeness of two texts with their sketches."""
    return exact(a, b) if min(len(of_a), len(of_b)) < FEW else likeness(of_a, of_b)


def ranges(docs: DataFrame, count: int) -> DataFrame:
    """doc_id, text, part, head: rows dealt to `count` ranges of descending doc_id, each range's first row also dealt
    to the range before it (head). Only range bounds and one row for each range come to the driver."""
    spark = docs.sparkSession
    cut = [i / count for i in range(1, count)]
    bounds = sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", cut, 0.2 / count)), reverse=True) if cut else []
    bounds = [int(b) for b in bounds]
    # the part of an id is the number of bounds that are at least it; null ids go last
    steps = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(F.size(F.filter(steps, lambda b: b >= F.col("doc_id"))))
    rows = docs.withColumn("part", part)
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("doc_id")).orderBy("part").collect()
    before = {h.doc_id: heads[i - 1].part for i, h in enumerate(heads) if h.doc_id is not None}
    nulls = [heads[i - 1].part for i, h in enumerate(heads) if h.doc_id is None]
    known = spark.createDataFrame(list(before.items()) or [(None, None)], "id long, before int")
    rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("id"), "left")
    if nulls:
        rows = rows.withColumn("before", F.when(F.col("doc_id").isNull(), nulls[0]).otherwise(F.col("before")))
    copies = F.when(F.col("before").isNull(), F.array("part")).otherwise(F.array("part", "before"))
    dealt = rows.select("doc_id", "text", F.posexplode(copies).alias("nth", "part"))
    return dealt.selectExpr("doc_id", "text", "part", "nth > 0 head")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        held: tuple | None = None  # the row that waits for the next one

        def flush() -> pa.RecordBatch:
            nonlocal rows, size
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows, size = [], 0
            return out

        for batch in batches:
            for k, text, part, head in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "head"))):
                text = text or ""
                own = sketch(text)
                if held and held[2] == part:
                    before, before_text, _, before_own = held
                    n = len(before_text)
                    new = before_text[: n - n // 2] + text[: n // 2]
                    changed = sketch(new)
                    row = (before, n, hashlib.sha256(new.encode()).hexdigest(), fingerprint(before_own), fingerprint(changed), likeness_of(before_text, new, before_own, changed), likeness_of(before_text, text, before_own, own))
                    rows.append(row)
                    size += len(row[3]) + len(row[4])
                    if size > 1 << 22 or len(rows) >= 4096:
                        yield flush()
                held = None if head else (k, text, part, own)
        if rows:
            yield flush()

    chosen = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    count = parts(docs.sparkSession)
    dealt = ranges(chosen, 2 * count).repartition(count, "part").sortWithinPartitions("part", "head", F.desc_nulls_last("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema)
