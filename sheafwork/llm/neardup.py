"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct shingles of five words (words lower-cased A-Z, cut at white space); with fewer
words, the whole sequence is the one shingle. Documents of equal sets are one class. Each class has WIDTH min-wise
tokens of its set and takes part in independent trees: a node chooses BRANCHES of the tokens by hashing its
path, and a class descends to the children named by its values there. After DEPTH levels (more for nodes above LIMIT)
classes that met are compared exhaustively by their tokens; what is left of a node's candidate pairs is a spanning
forest, so the output is no longer than its members. Pairs of Jaccard j meet with probability
p(d) = 1 - (1 - j p(d - 1)) ** 2 at depth d; trees() takes as many as leave a pair at the threshold apart with MISS at
most: at 0.85 (0.97 in one tree of depth 3) three, at 0.8 (0.94) four.

Candidates joined by forests form candidate groups. Within a group every pair whose tokens agree enough is confirmed on
the full sets, unless it is connected already; so each true link inside a group is found or implied. Groups (or nodes)
too large for one task are cut into blocks, and each pair of blocks is a task of its own.

Rows of near_duplicates(): one for each row of the input. Null or empty text, or white space alone: n_shingles 0,
linked with nothing. Null doc_id: linked with nothing, component_id null, not kept. Rows that repeat an id are one
document; with different texts, each text is linked by itself. Very long texts: whole. Empty table: no rows. Further
columns, whatever their names, aren't read; stage() gives them back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, by_bytes, discard, free_shuffles, materialise, named, numbered, parts, texts, use
from .graph import components

WORDS = 5
#: Links: 100 * intersection >= percent * union. This is the contract of op5; the pipeline takes 80.
PERCENT = 85
WIDTH, DEPTH, BRANCHES = 128, 3, 2
#: Pairs at the threshold that may never meet.
MISS = 3e-5
#: Members of a node, and shingles of a group, that one task may hold.
LIMIT, SHINGLES = 40_000, 6_000_000
MORE_LEVELS = 3

_random = np.random.Generator(np.random.PCG64(20240229))
XOR = _random.integers(0, 1 << 32, WIDTH, np.uint32)[:, None]
TIMES = (_random.integers(0, 1 << 31, WIDTH, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
ROOTS = _random.integers(0, 1 << 63, 64).astype(np.uint64)

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HASHES = Memo(xxhash.xxh3_64_intdigest, 250_000)


def trees(percent: int) -> int:
    """How many trees leave pairs at the threshold apart with probability MISS at most."""
    p = 1.0
    for _ in range(DEPTH):
        p = 1 - (1 - percent / 100 * p) ** BRANCHES
    return max(1, int(np.ceil(np.log(MISS) / np.log1p(-p)))) if p < 1 else 1


def near(percent: int) -> float:
    """Estimates below this are not looked at: four deviations under the threshold."""
    share = percent / 100
    return share - 4 * (share * (1 - share) / WIDTH) ** 0.5


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """The set, as sorted 64-bit hashes."""
    words = text.encode().translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    out = h[: n - WORDS + 1].copy()
    for k in range(1, WORDS):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= h[k : n - WORDS + 1 + k]
    out = mixed(out)
    out.sort()
    if len(out) > 1:
        first = np.empty(len(out), bool)
        first[0] = True
        np.not_equal(out[1:], out[:-1], out=first[1:])
        out = out[first]
    return out


def tokens(own: np.ndarray) -> np.ndarray:
    """The min-wise token of each hash function."""
    least = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    h = (own >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 2048):
        x = h[None, i : i + 2048] ^ XOR
        x *= TIMES
        np.minimum(least, x.min(axis=1), out=least)
    return least


def children(paths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Paths of the children: (documents, nodes) to (documents, nodes * BRANCHES), by (documents, WIDTH) values."""
    first = mixed(paths ^ np.uint64(0xA5A5A5A55A5A5A5A)) % np.uint64(WIDTH)
    step = mixed(paths ^ np.uint64(0x3C3C3C3CC3C3C3C3)) % np.uint64(WIDTH - 1) + np.uint64(1)
    out = []
    for k in range(BRANCHES):
        at = (first + np.uint64(k) * step) % np.uint64(WIDTH)
        value = np.take_along_axis(values, at.astype(np.int64), axis=1).astype(np.uint64)
        out.append(mixed(mixed(paths + (at << np.uint64(40))) ^ value * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(out, axis=1)


def signed(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_id (a 64-bit hash of the set; null for the empty one), paths, tokens (their low bytes)."""

    roots = ROOTS[: trees(percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(HASHES)
        for batch in by_bytes(batches):
            sizes, ids, rows = [], [], []
            for text in texts(batch):
                own = shingles(text)
                sizes.append(len(own))
                ids.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None)
                rows.append(tokens(own))
            values = np.stack(rows)
            paths = np.broadcast_to(roots, (len(values), len(roots)))
            for _ in range(DEPTH):
                paths = children(paths, values)
            low = values.astype(np.uint8)
            flat = pa.array(paths.astype(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * paths.shape[1]), flat)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), lists, pa.array([x.tobytes() for x in low], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_id", "paths", "tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_id long, paths array<long>, tokens binary")


class Forest:
    """Union-find by numbered members."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, v: int, others: np.ndarray) -> np.ndarray:
        """Put v and others together; which of the others were apart, one for each tree."""
        own = self.label[v]
        found, at = np.unique(self.label[others], return_index=True)
        new = found != own
        if new.any():
            self.label[np.isin(self.label, found)] = own
        return others[at[new]]


def agreeing(values: np.ndarray, v: int) -> np.ndarray:
    """In how many places each row agrees with row v."""
    return np.bitwise_count(np.packbits(values == values[v], axis=1).view(np.uint64)).sum(axis=1)


def needed(share: float) -> int:
    """Places that must agree for an estimate of `share`; bytes agree by chance once in 256."""
    return int(np.ceil((share * (1 - 1 / 256) + 1 / 256) * WIDTH))


def connect(values: np.ndarray, accept, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs that agree in enough places and that accept(v, others) lets through.

    Members are compared with all others one by one until those not yet compared lie in one tree: a pair that hasn't
    been looked at then joins what is joined."""
    n, out = len(values), []
    forest, least = Forest(n), needed(near(percent))
    waiting = np.ones(n, bool)
    while True:
        rest = np.flatnonzero(waiting)
        if not len(rest):
            return out
        labels, at, count = np.unique(forest.label[rest], return_index=True, return_counts=True)
        if len(labels) == 1:
            return out
        # all of the smaller trees, up to as many as keeps the count of trees fresh
        order = np.argsort(count, kind="stable")
        todo = rest[at[order[: max(1, len(labels) // 2)]]]
        for v in todo.tolist():
            waiting[v] = False
            close = agreeing(values, v) >= least
            close &= forest.label != forest.label[v]
            others = np.flatnonzero(close)
            if len(others):
                out += [(v, int(u)) for u in accept(v, others, forest)]


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of equal keys; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if now is not None and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def in_blocks(rows: DataFrame, blocks: str, key: str) -> DataFrame:
    """Each row once for each pair of blocks that its block is in, as columns i and j. One block: the pair (0, 0)."""
    own = rows.withColumn("_own", F.expr(f"pmod(xxhash64({key}, 7), {blocks})"))
    dealt = own.withColumn("_other", F.explode(F.expr(f"sequence(0L, cast({blocks} - 1 as long))")))
    return dealt.selectExpr("*", "least(_own, _other) i", "greatest(_own, _other) j").drop("_own", "_other")


def candidates(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links a, b between sets that met in a node and are near by their tokens: a forest for each node."""
    spark = sets.sparkSession
    count = parts(spark)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_all = lambda v, others, forest: forest.join(v, others)
        out: list[tuple[int, int]] = []
        for _, group in by_group(batches, ["path", "i", "j"]):
            ids = group["set_id"].to_numpy()
            out += [(int(ids[v]), int(ids[u])) for v, u in connect(matrix(group["tokens"]), take_all, percent)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                paths = batch.column("path").to_numpy().astype(np.uint64)[:, None]
                below = children(paths, matrix(pa.chunked_array([batch.column("tokens")]))).astype(np.int64)
                ids = np.repeat(batch.column("set_id").to_numpy(), BRANCHES)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(below.ravel())], ["set_id", "path"])

    links = []
    rows = sets.select("set_id", F.explode("paths").alias("path"))
    for level in range(MORE_LEVELS + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        met = materialise(rows.join(sizes, "path").join(sets.select("set_id", "tokens"), "set_id"), "nodes")
        last = level == MORE_LEVELS
        chosen = met if last else met.where(f"size <= {LIMIT}")
        dealt = in_blocks(chosen, f"greatest(cast(ceil(size * 2 / {LIMIT}) as int), 1)" if last else "1", "set_id")
        small = dealt.select("path", "i", "j", "set_id", "tokens").repartition(count, "path", "i", "j").sortWithinPartitions("path", "i", "j", "set_id")
        links.append(materialise(small.mapInArrow(compare, "a long, b long"), "forest"))
        large = met.where(f"size > {LIMIT}")
        if last or large.isEmpty():
            discard(met)
            break
        rows = materialise(large.select("path", "set_id", "tokens").mapInArrow(descend, "set_id long, path long").distinct(), "deeper")
        free_shuffles(spark)
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    out._shared_paths = [p for x in links for p in x._shared_paths]
    return out


def confirmed(docs: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links a, b that hold on the full sets, a forest for each group: from members (set_id, doc_id, tokens,
    n_shingles, root) and the texts of their doc_ids."""
    count = parts(docs.sparkSession)
    size = members.groupBy("root").agg(F.sum("n_shingles").alias("total"))
    rows = members.join(size, "root").select("doc_id", "set_id", "tokens", "root", F.expr(f"greatest(cast(ceil(total * 2 / {SHINGLES}) as int), 1)").alias("blocks"))
    rows = rows.withColumn("blocks", F.expr("case when blocks <= 2 then 1 else blocks end"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(rows, "doc_id").drop("doc_id")
    dealt = in_blocks(joined, "blocks", "set_id").drop("blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(HASHES)
        out: list[tuple[int, int]] = []
        for _, group in by_group(batches, ["root", "i", "j"]):
            ids, sets, keep = group["set_id"].to_pylist(), [], []
            for k, text in enumerate(group["text"].to_pylist()):
                if k and keep and ids[keep[-1]] == ids[k]:
                    continue  # a repeated row
                own = shingles(text or "")
                if len(own) and xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) == ids[k]:
                    keep.append(k)
                    sets.append(own)
            if len(keep) < 2:
                continue
            values = matrix(group["tokens"].take(pa.array(keep)))
            sizes = np.array([len(s) for s in sets])

            def accept(v: int, others: np.ndarray, forest: Forest) -> list[int]:
                a, b = np.minimum(sizes[others], sizes[v]), np.maximum(sizes[others], sizes[v])
                others = others[100 * a >= percent * b]
                joined = []
                # the nearest first: each that holds settles its whole tree
                for u in others[np.argsort(-agreeing_few(values, v, others), kind="stable")].tolist():
                    if forest.label[u] != forest.label[v] and linked(sets[v], sets[u], percent):
                        joined += forest.join(v, np.array([u])).tolist()
                return joined

            out += [(ids[keep[v]], ids[keep[u]]) for v, u in connect(values, accept, percent)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    dealt = dealt.repartition(count, "root", "i", "j").sortWithinPartitions("root", "i", "j", "set_id")
    return dealt.mapInArrow(compare, "a long, b long")


def agreeing_few(values: np.ndarray, v: int, others: np.ndarray) -> np.ndarray:
    return (values[others] == values[v]).sum(axis=1)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; links are pairs of Jaccard percent / 100 or more."""
    spark = docs.sparkSession
    rows = materialise(signed(docs, percent), "signed")
    sets = rows.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("paths").alias("paths"), F.first("tokens").alias("tokens"), F.first("n_shingles").alias("n_shingles"))
    sets = materialise(sets, "sets")
    free_shuffles(spark)
    met = candidates(sets, percent)
    groups = components(met)
    discard(met)
    members = materialise(sets.drop("paths").join(groups, F.col("set_id") == F.col("node")).drop("node"), "members")
    free_shuffles(spark)
    discard(groups)
    links = materialise(confirmed(docs, members, percent), "confirmed")
    discard(members)
    free_shuffles(spark)
    joined = components(links)
    discard(links)
    roots = joined.join(sets.select("set_id", "doc_id"), F.col("node") == F.col("set_id"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("least"))
    named = roots.join(least, "root").select("set_id", "least")
    alone = sets.select("set_id", "doc_id").join(named, "set_id", "left").selectExpr("set_id", "coalesce(least, doc_id) first_id")
    out = rows.select("doc_id", "n_shingles", "set_id").join(alone, "set_id", "left")
    component = "case when doc_id is null then null when set_id is null then doc_id else first_id end"
    return out.selectExpr("doc_id", "n_shingles", f"{component} component_id", f"coalesce(doc_id = {component}, false) kept")


def stage(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with its own columns; rows without an id stay."""
    kept = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows, names = numbered(docs)
    key = f"c{names.index('doc_id')}"
    chosen = rows.where(f"{key} is not null").join(kept, F.col(key).cast("long") == F.col("kept_id"), "left_semi")
    return named(chosen.union(rows.where(f"{key} is null")), names)
