"""Repeated passages by sparse suffix arrays.

A passage of LENGTH words or more that occurs in two documents is found, with words lower-cased A-Z and cut at white
space. Of all suffixes only those at minimiser positions are retained: in each window of LENGTH words, the one whose
first GRAM words have the smallest hash. Equal windows retain the same place, so every repeated passage shows up as
suffixes that begin alike, in both documents.

First the retained suffixes are sifted: dealt to buckets by their hashed beginnings, those that begin like none in
another document go. Those left stand for a run of windows each, as far as they are the minimiser; of suffixes whose
whole runs are equal (by a hash of their words) one is kept, that of the smallest document, and the others are repeated
throughout. So a hot passage is a few suffixes before anything is sorted.

Of these the words go into the suffix array: rows are range-partitioned by the first GRAM words and sorted by all
LENGTH, and neighbours are compared for their common prefix. Suffixes are extended to the left, word by word, as long
as windows ask for it: two suffixes share the window that begins o words before them if they have LENGTH - o words in
common to the right and o to the left. The smallest document of each such class has the window first. Rows are read in
their order, and no more than CHUNK and one beginning are held. Beginnings of more than MANY distinct suffixes don't go
through the array: their windows are told apart by hashes in a grouping that Spark combines and spills (exact as well).

Repeated windows are merged to spans of words. Repeats within one document don't count.

Rows of repeated(): one for each span. Null text, texts of fewer than LENGTH words: none. Null doc_id: left out. Rows
that repeat an id are one document. Very long texts: whole, in pieces of PIECE words that overlap. Ties: the smallest id
is the first. Empty table: no rows. Further columns, whatever their names, aren't read; stage() gives them back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, by_bytes, free_shuffles, materialise, named, numbered, parts, texts, use

LENGTH, GRAM = 50, 20
PIECE = (1 << 20) - 1
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
HASHES = Memo(xxhash.xxh3_64_intdigest, 250_000)

BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    while len(_powers[0]) < n:
        for k, b in enumerate((BASE, UNBASE)):
            p = _powers[k]
            _powers[k] = np.concatenate((p, p * np.uint64(pow(b, len(p), 1 << 64))))
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Spans:
    """Hashes of any spans of a text's words."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, n)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=self.sums[1:])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


def retained(spans: Spans, n: int) -> tuple[np.ndarray, ...]:
    """Hashed beginning, hash of the run, first window, number of windows and place of each retained suffix."""
    found = []
    for at in range(0, n - LENGTH + 1, PIECE - LENGTH + 1):
        stop = min(n, at + PIECE)
        starts = np.arange(at, stop - GRAM + 1)
        grams = spans.hash(starts, starts + GRAM)
        # the smallest in each window by doubling; the place rides in the low bits
        least = (mixed(grams) & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while 2 * reach <= LENGTH - GRAM + 1:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        over = LENGTH - GRAM + 1 - reach
        least = np.minimum(least[: len(least) - over], least[over:])
        place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        count = np.diff(np.append(new, len(place)))
        first = new + at
        reaches = spans.hash(first, first + count - 1 + LENGTH) + mixed((place[new] - new).astype(np.uint64))
        found.append((grams[place[new]], reaches, first, count, place[new] + at))
    return tuple(np.concatenate(x) for x in zip(*found))


#: A retained suffix as it is stored: 32 bytes. offset: its words in the first window; count: of windows, 0 marks a
#: beginning that is known to be shared.
SUFFIX = np.dtype([("seed", "<u8"), ("doc_id", "<i8"), ("reach", "<u8"), ("first", "<i4"), ("offset", "<i2"), ("count", "<i2")])
#: A span of words that an earlier document has.
SPAN = np.dtype([("doc_id", "<i8"), ("start", "<i4"), ("end", "<i4"), ("first_doc_id", "<i8")])
#: Suffixes that a task gathers before it goes on.
GATHERED = 1 << 18
#: Shared suffixes of a bucket that are settled in memory.
READY = 1 << 20
#: Rows of the suffix array that are compared at a time, and distinct suffixes of a beginning that go into it.
CHUNK, MANY = 1 << 15, 1 << 17


#: Rows of which each holds many: suffixes by their beginnings; by document, suffixes to be sorted, those of beginnings
#: that have too many, and spans that are known to be repeated; suffixes of buckets too large to be settled in memory.
SUFFIXES, SORTED, HOT, SPANS, OPEN = 0, 1, 2, 3, 4
DEALT = "kind int, bucket int, data binary"


def dealt(rows: np.ndarray, key: str, buckets: int, kind: int) -> pa.RecordBatch:
    bucket = (mixed(rows[key].view("<u8") if key == "doc_id" else rows[key]) % np.uint64(buckets)).astype(np.int64)
    rows = rows[np.argsort(bucket, kind="stable")]
    ends = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
    found = [(kind, k, rows[a:b].tobytes()) for k, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ([], [], []), kinds)], ["kind", "bucket", "data"])


def suffixes(docs: DataFrame, buckets: int) -> DataFrame:
    """The retained suffixes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(HASHES)
        gathered, size = [], 0
        for batch in by_bytes(batches):
            for k, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                words = words_of(text)
                if len(words) < LENGTH:
                    continue
                seed, reach, first, count, place = retained(Spans(words), len(words))
                rows = np.empty(len(seed), SUFFIX)
                rows["doc_id"], rows["seed"], rows["reach"], rows["first"], rows["count"], rows["offset"] = k, seed, reach, first, count, place - first
                gathered.append(rows)
                size += len(rows)
            if size >= GATHERED:
                yield dealt(np.concatenate(gathered), "seed", buckets, SUFFIXES)
                gathered, size = [], 0
        if gathered:
            yield dealt(np.concatenate(gathered), "seed", buckets, SUFFIXES)

    chosen = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null")
    return chosen.mapInArrow(run, DEALT)


def sift(held: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What to hold on to and what to pass on: suffixes pass once their beginning has been seen in two documents."""
    rows = np.concatenate((held, new))
    rows = rows[np.argsort(rows["seed"], kind="stable")]
    seed, owner, marker = rows["seed"], rows["doc_id"], rows["count"] == 0
    first = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
    size = np.diff(np.append(first, len(rows)))
    shared = np.logical_or.reduceat(marker | (owner != np.repeat(owner[first], size)), first)
    inside = np.repeat(shared, size)
    marks = rows[first[shared]]
    marks["count"] = 0
    return np.concatenate((rows[~inside], marks)), rows[inside & ~marker]


def settled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes sorted by beginning and run; for each the smallest document that has its run, and how many different
    runs its beginning has."""
    rows = rows[np.lexsort((rows["reach"], rows["seed"]))]
    seed, reach = rows["seed"], rows["reach"]
    new_seed = np.concatenate(([True], seed[1:] != seed[:-1]))
    new_run = new_seed | np.concatenate(([True], reach[1:] != reach[:-1]))
    runs, seeds = np.flatnonzero(new_run), np.flatnonzero(new_seed)
    first = np.repeat(np.minimum.reduceat(rows["doc_id"], runs), np.diff(np.append(runs, len(rows))))
    ways = np.repeat(np.add.reduceat(new_run, seeds, dtype=np.int64), np.diff(np.append(seeds, len(rows))))
    return rows, first, ways


def neighbours(batches: Iterator[pa.RecordBatch], buckets: int, most: int, many: int) -> Iterator[pa.RecordBatch]:
    """The suffixes whose beginnings occur in two documents, of rows sorted by bucket: as spans if an earlier document
    has the whole run, to be sorted if their beginning goes on in several ways. A beginning that is known to be shared
    is held as one entry, however often it occurs. What passes is settled at the bucket's end; where more than `most`
    pass, they go on as they are, to be settled by joins. many: of a beginning's different runs, beyond which it is HOT."""
    now, held, waiting, size = None, np.empty(0, SUFFIX), [], 0
    ready: list[np.ndarray] = []
    over = False

    def sifted() -> Iterator[pa.RecordBatch]:
        nonlocal held, waiting, size, over
        held, rows = sift(held, np.concatenate(waiting))
        waiting, size = [], 0
        ready.append(rows)
        if over or sum(map(len, ready)) > most:
            over = True
            yield dealt(np.concatenate(ready), "doc_id", buckets, OPEN)
            ready.clear()

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal held, over
        if waiting:
            yield from sifted()
        if ready:
            rows, first, ways = settled(np.concatenate(ready))
            whole = rows["doc_id"] > first
            spans = np.empty(int(whole.sum()), SPAN)
            spans["doc_id"], spans["start"], spans["first_doc_id"] = rows["doc_id"][whole], rows["first"][whole], first[whole]
            spans["end"] = spans["start"] + rows["count"][whole] - 1 + LENGTH
            yield dealt(spans, "doc_id", buckets, SPANS)
            yield dealt(rows[~whole & (ways > 1) & (ways <= many)], "doc_id", buckets, SORTED)
            yield dealt(rows[~whole & (ways > many)], "doc_id", buckets, HOT)
            ready.clear()
        held, over = np.empty(0, SUFFIX), False

    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("data")):
            if bucket != now:
                yield from done()
                now = bucket
            waiting.append(np.frombuffer(blob.as_buffer(), SUFFIX))
            size += len(waiting[-1])
            if size > max(GATHERED, len(held)):
                yield from sifted()
    yield from done()


def opened(rows: DataFrame) -> DataFrame:
    """The suffixes of packed rows, one a row."""
    names = ["seed", "doc_id", "reach", "first", "offset", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("data"):
                rows = np.frombuffer(blob.as_buffer(), SUFFIX)
                yield pa.RecordBatch.from_arrays([pa.array(rows[c].astype(np.int64)) for c in names], names)

    return rows.select("data").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def packed(rows: DataFrame, kind: int, buckets: int) -> DataFrame:
    """Rows of one a suffix or span, dealt by document."""
    shape = SPAN if kind == SPANS else SUFFIX

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, shape)
            for c in shape.names:
                out[c] = batch.column(c).to_numpy().astype(shape[c])
            yield dealt(out, "doc_id", buckets, kind)

    return rows.select(*shape.names).mapInArrow(run, DEALT)


def by_document(rows: DataFrame, buckets: int) -> DataFrame:
    """doc_id, suffixes: what each document has in the suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_bucket(batches):
            rows = np.concatenate([np.frombuffer(x, SUFFIX) for x in blobs])
            rows = rows[np.argsort(rows["doc_id"], kind="stable")]
            first = np.flatnonzero(np.concatenate(([True], rows["doc_id"][1:] != rows["doc_id"][:-1])))
            ends = [*first[1:].tolist(), len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"][first]), pa.array([rows[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary())], ["doc_id", "suffixes"])

    return rows.select("bucket", "data").repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, suffixes binary")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    now, held = None, []
    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
            if held and bucket != now:
                yield now, held
                held = []
            now = bucket
            held.append(data)
    if held:
        yield now, held


#: Words that a suffix can be extended to the left.
LEFT = LENGTH - GRAM
#: Words by which the ranges are parted; fewer than GRAM, so that a beginning is in one.
RANGED = 8
ROW = "doc_id long, first int, offset int, count int, words binary, before binary"


def array_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen suffixes (doc_id, suffixes) with their words, as big-endian hashes, so that binary order is the order
    of the words: `words` from the suffix on, `before` backwards from it, as far as its windows reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(HASHES)
        names = [x.split()[0] for x in ROW.split(", ")]
        for batch in by_bytes(batches):
            for k, text, blob in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("suffixes")):
                words, rows = words_of(text), np.frombuffer(blob.as_buffer(), SUFFIX)
                h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
                # rows that repeat an id: suffixes of the other text
                rows = rows[rows["first"] + rows["count"] - 1 + LENGTH <= len(words)]
                at = (rows["first"] + rows["offset"]).astype(np.int64)
                if len(at):
                    own = Spans(words).hash(at, at + GRAM) == rows["seed"]
                    rows, at = rows[own], at[own]
                if not len(at):
                    continue
                padded = np.concatenate((np.zeros(LEFT, np.uint64), h, np.zeros(LENGTH, np.uint64)))
                right = padded[at[:, None] + LEFT + np.arange(LENGTH)]
                right[np.arange(LENGTH) >= (rows["count"] - 1 - rows["offset"] + LENGTH)[:, None]] = 0
                left = padded[at[:, None] + LEFT - 1 - np.arange(LEFT)]
                left[np.arange(LEFT) >= rows["offset"][:, None]] = 0
                binary = lambda x: pa.array([r.tobytes() for r in x.astype(">u8")], pa.binary())
                columns = [pa.array(np.full(len(at), k)), *(pa.array(rows[c].astype(np.int32)) for c in ("first", "offset", "count")), binary(right), binary(left)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").join(chosen, "doc_id").mapInArrow(run, ROW)


def compared(doc_id: np.ndarray, first: np.ndarray, offset: np.ndarray, count: np.ndarray, words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Spans of rows in the order of their words that smaller documents among them have."""
    n = len(doc_id)
    same = words[1:] == words[:-1]
    common = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1)) if n > 1 else np.empty(0, np.int64)
    left = np.zeros(n, np.int64)  # rows with the same words so far to the left
    has = np.zeros((n, LEFT + 2), bool)
    least = np.full((n, LEFT + 2), np.iinfo(np.int64).max)
    for o in range(LEFT + 1):
        if o:
            _, word = np.unique(before[:, o - 1], return_inverse=True)
            _, left = np.unique(left * (int(word.max()) + 1) + word, return_inverse=True)
        rows = np.flatnonzero((o <= offset) & (o > offset - count))
        if not len(rows):
            continue
        run = np.cumsum(np.concatenate(([0], common < LENGTH - o)))[rows]
        _, at = np.unique(run * (int(left.max()) + 1) + left[rows], return_inverse=True)
        smallest = np.full(int(at.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, at, doc_id[rows])
        has[rows, o] = smallest[at] < doc_id[rows]
        least[rows, o] = smallest[at]
    # runs of windows, each from the first one's start to the last one's end; a larger o is an earlier window
    begins, ends = has & ~np.roll(has, 1, axis=1), has & ~np.roll(has, -1, axis=1)
    row, low = np.nonzero(begins)
    high = np.nonzero(ends)[1]
    out = np.empty(len(row), SPAN)
    place = first[row].astype(np.int64) + offset[row]
    out["doc_id"], out["start"], out["end"] = doc_id[row], place - high, place - low + LENGTH
    out["first_doc_id"] = [least[r, a : b + 1].min() for r, a, b in zip(row.tolist(), low.tolist(), high.tolist())]
    return out


def in_array(docs: DataFrame, chosen: DataFrame, buckets: int) -> DataFrame:
    """The suffix array of the chosen suffixes; what it says is repeated, dealt by document."""
    names = [x.split()[0] for x in ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in names[:4]]
            for c, width in zip(names[4:], (LENGTH, LEFT)):
                rows.append(np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u8").reshape(-1, width))
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            # up to the last beginning, which may go on
            starts = np.flatnonzero((held[4][1:, :GRAM] != held[4][:-1, :GRAM]).any(axis=1))
            if len(held[0]) > CHUNK and len(starts):
                cut = int(starts[-1]) + 1
                yield dealt(compared(*(x[:cut] for x in held)), "doc_id", buckets, SPANS)
                held = [x[cut:] for x in held]
        if held:
            yield dealt(compared(*held), "doc_id", buckets, SPANS)

    rows = array_rows(docs, chosen)
    return rows.repartitionByRange(buckets, F.expr(f"substring(words, 1, {8 * RANGED})")).sortWithinPartitions("words", "doc_id", "first").mapInArrow(run, DEALT)


def windows(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, at, hash of each window of the given runs (doc_id, first, count)."""
    wanted = runs.groupBy("doc_id").agg(F.collect_set(F.struct("first", "count")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(HASHES)
        for batch in by_bytes(batches):
            ids, ats, hashes = [], [], []
            for k, text, runs in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("runs").to_pylist()):
                words = words_of(text)
                at = np.unique(np.concatenate([np.arange(r["first"], r["first"] + r["count"]) for r in runs]))
                at = at[at + LENGTH <= len(words)]
                if len(at):
                    ids.append(np.full(len(at), k, np.int64))
                    ats.append(at.astype(np.int32))
                    hashes.append(Spans(words).hash(at, at + LENGTH).astype(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, ats, hashes)], ["doc_id", "at", "hash"])

    joined = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(wanted, "doc_id")
    return joined.mapInArrow(run, "doc_id long, at int, hash long")


def by_windows(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, start, end, first_doc_id of the windows of the given runs that smaller documents among them have."""
    found = materialise(windows(docs, runs), "windows")
    earliest = found.groupBy("hash").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where("first_doc_id < last").drop("last")
    return found.join(earliest, "hash").where("doc_id > first_doc_id").selectExpr("doc_id", "at start", f"at + {LENGTH} end", "first_doc_id")


def merged(rows: DataFrame, buckets: int) -> DataFrame:
    """doc_id, start, end, n_words, first_doc_id: the spans of each document, with those that meet as one."""
    names = ["doc_id", "start", "end", "n_words", "first_doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_bucket(batches):
            rows = np.concatenate([np.frombuffer(x, SPAN) for x in blobs])
            rows = rows[np.lexsort((rows["end"], rows["start"], rows["doc_id"]))]
            # ends so far within the document: documents are told apart by steps beyond any length
            _, nth = np.unique(rows["doc_id"], return_inverse=True)
            reach = np.maximum.accumulate(rows["end"] + (nth << 32))
            new = np.flatnonzero(np.concatenate(([True], rows["start"][1:] + (nth[1:] << 32) > reach[:-1])))
            end = np.maximum.reduceat(rows["end"], new).astype(np.int64)
            start = rows["start"][new].astype(np.int64)
            columns = [rows["doc_id"][new], start, end, end - start, np.minimum.reduceat(rows["first_doc_id"], new)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    dealt = rows.select("bucket", "data").repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, n_words, first_doc_id: spans of words (from 0, end excluded) that earlier documents have;
    first_doc_id is one of those."""
    spark = docs.sparkSession
    buckets, most, many = parts(spark), READY, MANY
    sifting = suffixes(docs, buckets).repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    met = materialise(sifting.mapInArrow(lambda batches: neighbours(batches, buckets, most, many), DEALT), "met")
    free_shuffles(spark)
    spans = met.where(F.col("kind") == SPANS)
    chosen, hot = met.where(F.col("kind") == SORTED), opened(met.where(F.col("kind") == HOT))
    rest = met.where(F.col("kind") == OPEN)
    if not rest.isEmpty():
        rest = opened(rest)
        runs = rest.groupBy("seed", "reach").agg(F.min("doc_id").alias("first_doc_id"))
        ways = runs.groupBy("seed").agg(F.count("*").alias("ways"))
        rest = rest.join(runs, ["seed", "reach"]).join(ways, "seed")
        whole = rest.where("doc_id > first_doc_id").selectExpr("doc_id", "first start", f"first + count - 1 + {LENGTH} end", "first_doc_id")
        spans = spans.union(packed(whole, SPANS, buckets))
        rest = rest.where("doc_id = first_doc_id and ways > 1")
        chosen = chosen.union(packed(rest.where(f"ways <= {MANY}"), SORTED, buckets))
        hot = hot.union(rest.where(f"ways > {MANY}").select(hot.columns))
    if not hot.isEmpty():
        spans = spans.union(packed(by_windows(docs, hot), SPANS, buckets))
    array = materialise(in_array(docs, by_document(chosen, buckets), buckets), "array")
    free_shuffles(spark)
    return merged(spans.union(array), buckets)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without spans of words; the white space after a word goes with it."""
    raw = text.encode()
    starts = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(raw[at : starts[min(a, len(starts) - 1)]])
        at = starts[min(b, len(starts) - 1)]
    return b"".join([*out, raw[at:]]).decode()


def stage(docs: DataFrame) -> DataFrame:
    """The documents without their repeated spans, n_chars counted anew; those with no words left go."""
    spans = materialise(repeated(docs), "repeated")
    free_shuffles(docs.sparkSession)
    by_id = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows, names = numbered(docs)
    key, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    own = rows.columns
    joined = rows.join(by_id, F.col(key).cast("long") == F.col("doc_id"), "left").drop("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            cut = [spans is not None for spans in batch.column("spans").to_pylist()]
            new = [without(t, [(s["start"], s["end"]) for s in spans]) if spans else t for t, spans in zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist())]
            columns = [pa.array(new, pa.string()) if c == text else batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut)], [*own, "cut"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "cut boolean"])
    out = named(joined.mapInArrow(run, schema).where(f"not cut or {text} rlike '[^ \\\\t-\\\\r]'"), names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
