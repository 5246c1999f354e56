"""WARC files and a Merkle audit of their replicas.

segments() stores pages as WARC files: records one after the other, in segments of about SEGMENT bytes, each with its
index (for every record its page and where it ends). leaves() reads stored segments back and hashes what lies between
the offsets of the index, so a damaged header can't hide what follows.

A replica's tree is over the records in the order of their hashed ids, which doesn't depend on how either replica is
cut into segments. An entry is an id with its records; a leaf node is a range of hashes, as many bits as make about FAN
entries each, and each node above covers FAN of those below. A node's digest covers the digests and sizes of its
children in order, and so the offset ranges in that order. Two replicas are compared from the root down: only children
of nodes that differ are looked at, one join a level, until the entries are found; a record that is lost or added
changes the nodes above it and no other.

The records of an id are summed up before the shuffle (their number, bytes and the sums of eight parts of their
digests), so an id that a third of all records have is one row; a leaf node lists entries of different ids only.

Rows of audit(): one for each id and digest that the replicas don't have equally often, those of one id side by side:
status changed, missing (not in the second) or extra (only there), and copies, how often. Null url or html: empty. Null
ids: an id like any other. Repeated rows: a record each. Very long bodies: whole, a segment of its own; below 2 GB.
Further columns of pages, whatever their names, are left out. Empty tables: nothing differs, or all is missing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bytes of a segment, when a record ends beyond it.
SEGMENT = 1 << 20
#: Children of a node, as bits.
BITS = 4
FAN = 1 << BITS

START = b"WARC/1.1\r\n"


def record(url: str, body: bytes) -> bytes:
    name = hashlib.sha256(url.encode() + b"\0" + body).hexdigest()
    uid = f"{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}"
    head = (
        "WARC-Type: resource\r\n"
        f"WARC-Record-ID: <urn:uuid:{uid}>\r\n"
        f"WARC-Target-URI: {' '.join(url.split())}\r\n"
        "WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html\r\n"
        f"Content-Length: {len(body)}\r\n\r\n"
    )
    return START + head.encode() + body + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, body) of each record of a WARC file; what isn't a record is passed over."""
    at = data.find(START)
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode(errors="replace").split("\r\n") if end >= 0 else []
        headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        size = headers.get("Content-Length", "")
        stop = end + 4 + int(size) if size.isdecimal() else len(data) + 1
        if data[stop : stop + 4] == b"\r\n\r\n":
            yield at, headers, data[end + 4 : stop]
            at = data.find(START, stop + 4)
        else:  # damaged
            at = data.find(START, at + 1)


Damage = Callable[[int | None, bytes], bytes | None]


def bit_rot(flipped: int = 64, lost: int = 512) -> Damage:
    """Damage for tests and demonstrations, chosen by the checksum of the id: one record in `flipped` has a byte flipped,
    one in `lost` is gone."""

    def damage(page_id: int | None, data: bytes) -> bytes | None:
        chosen = zlib.crc32(str(page_id).encode())
        if chosen % lost == 1:
            return None
        if chosen % flipped:
            return data
        at = (chosen // flipped) % len(data)
        return data[:at] + bytes([data[at] ^ 0x10]) + data[at + 1 :]

    return damage


SEGMENTS = "segment long, data binary, ids array<long>, ends array<long>"


def segments(pages: DataFrame, damage: Damage | None = None, size: int = SEGMENT) -> DataFrame:
    """The stored files of one replica, of about `size` bytes each, after `damage` if there was any: segment, data, and
    the index as ids and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 32, 0
        held: list[bytes] = []
        ids: list[int | None] = []
        ends: list[int] = []

        def done() -> pa.RecordBatch:
            nonlocal count
            columns = [pa.array([base + count], pa.int64()), pa.array([b"".join(held)], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))]
            count += 1
            for x in (held, ids, ends):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["segment", "data", "ids", "ends"])

        for batch in batches:
            for k, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html")):
                data = record(url or "", html.as_buffer().to_pybytes() if html.is_valid else b"")
                stored = damage(k, data) if damage else data
                if stored is None:
                    continue
                if ends and ends[-1] + len(stored) > size:
                    yield done()
                held.append(stored)
                ids.append(k)
                ends.append((ends[-1] if ends else 0) + len(stored))
        if ends:
            yield done()

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(run, SEGMENTS)


LEAVES = "page_id long, segment long, first_byte long, end_byte long, digest string"


def leaves(stored: DataFrame) -> DataFrame:
    """The records of stored segments, hashed as they are read."""
    names = [x.split()[0] for x in LEAVES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, data, ids, ends in zip(*(batch.column(c) for c in ("segment", "data", "ids", "ends"))):
                data, ids, ends = memoryview(data.as_buffer()), ids.as_py(), ends.as_py()
                starts = [0, *ends[:-1]]
                digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(starts, ends)]
                columns = [pa.array(c, t) for c, t in zip((ids, [segment.as_py()] * len(ids), starts, ends, digests), [pa.int64()] * 4 + [pa.string()])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return stored.mapInArrow(run, LEAVES)


@dataclass
class Replica:
    """records: the rows of leaves(); nodes: place, n_bytes, digest of each level, leaf nodes first."""

    records: DataFrame
    nodes: list[DataFrame]


def height(records: DataFrame) -> int:
    """Levels that make leaf nodes of about FAN records; both replicas' trees are given the same."""
    n, out = records.count(), 1
    while n > FAN ** (out + 1):
        out += 1
    return out


def placed(records: DataFrame, levels: int) -> DataFrame:
    """With the leaf node of each record: the first bits of its hashed id."""
    return records.withColumn("place", F.expr(f"shiftrightunsigned(xxhash64(page_id), {64 - BITS * levels})"))


def tree(records: DataFrame, levels: int) -> Replica:
    """The nodes over `records`, written level by level."""
    part = [F.sum(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")).alias(f"s{k}") for k in range(8)]
    entries = placed(records, levels).groupBy("place", "page_id").agg(F.count("*").alias("n"), F.sum(F.col("end_byte") - F.col("first_byte")).alias("n_bytes"), *part)
    below = entries.select("place", F.col("page_id").alias("child"), "n_bytes", F.sha2(F.concat_ws(",", "n", "n_bytes", *(f"s{k}" for k in range(8))), 256).alias("digest"))
    nodes = []
    for level in range(levels + 1):
        children = F.array_sort(F.collect_list(F.struct(F.coalesce("child", F.lit(-(1 << 63))).alias("child"), "n_bytes", "digest")))
        grouped = below.groupBy("place").agg(F.sum("n_bytes").alias("n_bytes"), children.alias("children"))
        text = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["child"], c["n_bytes"], c["digest"])), ",")
        nodes.append(materialise(grouped.select("place", "n_bytes", F.sha2(text, 256).alias("digest")), f"nodes{level}"))
        below = nodes[-1].select(F.shiftright("place", BITS).alias("place"), F.col("place").alias("child"), "n_bytes", "digest")
    return Replica(records, nodes)


def replica(stored: DataFrame, levels: int | None = None) -> Replica:
    records = materialise(leaves(stored), "records")
    return tree(records, height(records) if levels is None else levels)


def audit(ours: Replica, theirs: Replica) -> DataFrame:
    """page_id, status, copies, our_digest, their_digest, and where the record (the first of its copies) lies in either
    replica: segment, first_byte, end_byte and their_segment, their_first, their_end."""
    differ = None
    for mine, other in zip(reversed(ours.nodes), reversed(theirs.nodes)):
        both = mine.union(other).select("place", "digest")
        if differ is not None:
            both = both.withColumn("parent", F.shiftright("place", BITS)).join(differ.withColumnRenamed("place", "parent"), "parent", "left_semi")
        counted = both.groupBy("place").agg(F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"))
        differ = counted.where("n <> 2 or a <> b").select("place")
    levels = len(ours.nodes) - 1
    both = placed(ours.records.withColumn("own", F.lit(True)).union(theirs.records.withColumn("own", F.lit(False))), levels).join(differ, "place", "left_semi")
    where = lambda own: F.min(F.when(F.col("own") == own, F.struct("segment", "first_byte", "end_byte")))
    times = F.sum(F.when(F.col("own"), 1).otherwise(-1))
    odd = both.groupBy("page_id", "digest").agg(times.alias("times"), where(True).alias("mine"), where(False).alias("other")).where("times <> 0")
    odd = odd.withColumn("nth", F.expr("row_number() over (partition by page_id, times > 0 order by digest)"))
    a = odd.where("times > 0").selectExpr("page_id", "nth", "times ours", "digest our_digest", "mine")
    b = odd.where("times < 0").selectExpr("page_id their_id", "nth their_nth", "-times theirs", "digest their_digest", "other")
    met = a.join(b, F.expr("page_id <=> their_id and nth = their_nth"), "full_outer")
    return met.selectExpr(
        "coalesce(page_id, their_id) page_id", "case when their_digest is null then 'missing' when our_digest is null then 'extra' else 'changed' end status", "greatest(ours, theirs) copies", "our_digest", "their_digest",
        "mine.segment segment", "mine.first_byte first_byte", "mine.end_byte end_byte", "other.segment their_segment", "other.first_byte their_first", "other.end_byte their_end",
    )
