"""Language-model scores by a hierarchical Pitman-Yor model.

Tokens are words (lower-cased A-Z, cut at white space) and one end for each text. The context of a token is the token
before it, by its full hash (a text begins after an end). Each context is a restaurant of the two-parameter Chinese
restaurant process whose tables draw their dishes from one shared parent, the restaurant of all words; there each word
is one table, and a new table is the unknown word.

The seating is sampled by Gibbs. What the probabilities need of it is how many tables each dish has in each context;
which customer sits where is summed over. Two draws between the sweeps make the dishes independent, so that all are
seated at once and still each from its exact conditional distribution:

* for each context a gamma variable of shape strength / discount + tables, which stands for the rising factorial that
  couples the tables of its dishes;
* the parent's probabilities, a Dirichlet variable given the tables that were sent up.

Given these, a dish of c customers has t tables with probability in proportion to S(c, t) * a ** t, where S is the
generalised factorial coefficient. At the discount of one half, S(c, t) = Gamma(2c - t) / (Gamma(t) Gamma(c - t + 1)) /
4 ** (c - t), so the odds of one table more are a * 4 * (c - t) / (t * (2c - t - 1)), for any number of customers: every
customer of every dish takes part in each sweep, whatever the counts. The distribution is log-concave; it is summed
from its mode outwards until less than 1e-15 is left. SWEEPS sweeps are made and the last SAMPLES kept; a token's
probability is its mean over them.

Random numbers are hashes of the word, the context and the sweep, and sums over buckets are sums of integers, so the
scores don't depend on how rows are partitioned.

The texts are read once, into blocks that hold their distinct words (by frequency) and their tokens as numbers of these.
Words are dealt to buckets by their hash; a bucket numbers its words, and a word's number everywhere is its bucket and
its place there. A block asks for the pairs (context, word) it holds, with their training counts; pairs are dealt to
the buckets of their words, where counts over all blocks meet, so a frequent context is spread over all buckets and a
frequent word is one entry for each context and block. Each sweep sends the tables of a context to the bucket of the
context as a word, which adds them up, draws its gamma variable and answers in the order it was asked, without keys. In
the end each block gets the figures of its pairs and contexts back. No table of all words or contexts is ever in one
place; to the driver go four integers a bucket. Customers of a context are as many as its tokens, for each text's end is
the context of its beginning. Words are told apart by a 64-bit hash.

Rows of scores(): one for each row of the input; further columns, whatever their names, are left out. Null text: empty,
the end alone. Null doc_id: crc32 of the empty text, so in training. Repeated rows are counted and scored each. Very
long texts: whole, in one block. Without training texts every count is 0 and every token has probability 1 (of being
unknown). Empty table: no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, by_bytes, discard, free_shuffles, materialise, parts, texts, use

SWEEPS, SAMPLES = 3, 2
#: Of the contexts. The formula for S(c, t) is that of the discount of one half.
DISCOUNT, STRENGTH = 0.5, 1.0
#: Of their parent.
TOP_DISCOUNT, TOP_STRENGTH = 0.7, 1.0
#: Bytes of text in a block.
BLOCK = 8 << 20
HELD_OUT = (7, 2)
#: Gamma variables that are summed over buckets are integers of this unit.
UNIT = 1 << 20
#: Cells of a matrix of possible table counts.
CELLS = 1 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HASHES = Memo(xxhash.xxh3_64_intdigest, 250_000)
#: White space can't be in a word.
END = xxhash.xxh3_64_intdigest(b"\n")


def held_out(doc_id: int | None) -> bool:
    text = "" if doc_id is None else str(doc_id)
    return zlib.crc32(text.encode()) % HELD_OUT[0] == HELD_OUT[1]


def hashes_of(text: str) -> np.ndarray:
    """The hashes of its tokens."""
    words = text.encode().translate(LOWER).split()
    h = np.empty(len(words) + 1, np.uint64)
    h[-1] = END
    h[:-1] = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    return h


def homes(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(3)) % np.uint64(buckets)).astype(np.int64)


class Pairs:
    """What the texts of a block hold: its words by bucket and hash, and its pairs by word and context in that order.
    `at` has the pair of each token. hashes: the distinct words; tokens: their numbers, text by text, each text with its
    end, so that the token before a text's first is an end as well."""

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, buckets: int):
        bucket = homes(hashes, buckets)
        order = np.lexsort((hashes, bucket))
        self.words = hashes[order]
        self.word_ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[tokens]
        pairs, self.at = np.unique(at * len(hashes) + np.concatenate((at[-1:], at[:-1])), return_inverse=True)
        self.word, self.context = pairs // len(hashes), pairs % len(hashes)
        self.ends = np.searchsorted(self.word, self.word_ends)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """Between 0 and 1, ends excluded, by hashing."""
    return ((mixed(keys + np.uint64(draw * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def gamma(shape: np.ndarray, keys: np.ndarray, draw: int) -> np.ndarray:
    """Gamma variables of the given shapes, by Marsaglia and Tsang; `draw` tells draws for the same key apart."""
    low = shape < 1
    d = shape + low - 1 / 3
    out, todo = np.empty(len(shape)), np.arange(len(shape))
    for trial in itertools.count():
        if not len(todo):
            break
        at = (draw << 16) + 4 * trial
        k, dd = keys[todo], d[todo]
        x = np.sqrt(-2 * np.log(uniform(k, at))) * np.cos(2 * np.pi * uniform(k, at + 1))
        v = (1 + x / np.sqrt(9 * dd)) ** 3
        good = (v > 0) & (np.log(uniform(k, at + 2)) < 0.5 * x * x + dd - dd * v + dd * np.log(np.maximum(v, 1e-300)))
        out[todo[good]] = (dd * v)[good]
        todo = todo[~good]
    return out * np.where(low, uniform(keys, (draw << 16) + 3) ** (1 / np.where(low, shape, 1)), 1)


def tables_of(count: np.ndarray, odds: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of each dish the number of its tables: 1 to count, t + 1 against t in the proportion of
    odds * (count - t) to t * (2 * count - t - 1), at the quantile u."""
    out = np.ones(len(count), np.int64)
    who = np.flatnonzero(count > 1)
    c, a = count[who].astype(float), odds[who]
    b = 2 * c - 1 + a
    middle = np.clip(2 * a * c / (b + 0.5 * np.sqrt(np.maximum(4 * b * b - 16 * a * c, 0))), 1, c)
    reach = 9 * np.sqrt(np.minimum(middle, 2 * (c - middle)) + 1) + 20
    low, high = np.floor(np.maximum(middle - reach, 1)), np.ceil(np.minimum(middle + reach, c))
    width = 1 << np.ceil(np.log2(high - low + 1)).astype(np.int64)
    for w in np.unique(width).tolist():
        every = np.flatnonzero(width == w)
        step = max(1, CELLS // w)
        for rows in (every[i : i + step] for i in range(0, len(every), step)):
            t = low[rows, None] + np.arange(w)
            n = c[rows, None]
            weight = np.zeros(t.shape)
            with np.errstate(divide="ignore", invalid="ignore"):
                weight[:, 1:] = np.cumsum(np.log(a[rows, None] * (n - t) / (t * (2 * n - t - 1)))[:, :-1], axis=1)
            weight[t > high[rows, None]] = -np.inf
            total = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[who[rows]] = (low[rows] + (total < u[who[rows], None] * total[:, -1:]).sum(axis=1)).astype(np.int64)
    return out


def parent_draws(guests: np.ndarray, words: np.ndarray, sweep: int) -> np.ndarray:
    """Of each word its gamma variable in the parent's Dirichlet, in UNIT; guests: its customers there."""
    return np.maximum(gamma(guests - TOP_DISCOUNT, words, 2 * sweep) * UNIT, 1).astype(np.int64)


def rates(tables: np.ndarray, contexts: np.ndarray, sweep: int) -> np.ndarray:
    """Of each context (its hash, its tables everywhere) its gamma variable, in 32 bits to be sent about."""
    return gamma(STRENGTH / DISCOUNT + tables, contexts, 2 * sweep + 1).astype(np.float32)


def swept(word: np.ndarray, context: np.ndarray, count: np.ndarray, tables: np.ndarray, words: np.ndarray, rate: np.ndarray, whole: int, sweep: int) -> np.ndarray:
    """The tables of each pair (number of the word, number of the context, customers, tables before) after a sweep.
    rate: of each context, rates(); whole: the sum of all parent_draws() and the unknown word's. The pair's random number
    is a hash of the word and of the rate, which is one of the context."""
    chance = parent_draws(np.bincount(word, tables, len(words)), words, sweep) / whole
    keys = mixed(words)[word] ^ mixed(rate.view(np.uint32).astype(np.uint64))[context]
    return tables_of(count, 4 * DISCOUNT * chance[word] * rate.astype(float)[context], uniform(keys, sweep << 40))


def unknown_draw(vocabulary: int, sweep: int) -> int:
    """The unknown word's part in the parent's Dirichlet."""
    return int(gamma(np.array([TOP_STRENGTH + TOP_DISCOUNT * vocabulary]), np.array([END ^ 1], np.uint64), 2 * sweep)[0] * UNIT)


def packed(values: np.ndarray) -> bytes:
    """Integers byte by byte, all lowest bytes first, which compresses well."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: pa.Buffer) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, as their steps."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: pa.Buffer) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


BLOCKS = "block long, words binary, tokens binary, lengths binary, ids array<long>"


def blocked(docs: DataFrame) -> DataFrame:
    """Texts in blocks of about BLOCK bytes: the hashes of their distinct words, the most frequent first, their tokens as
    numbers of these, the tokens of each text, and the ids."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = [pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(HASHES)
        block, size = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        gathered: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            nonlocal block, size
            hashes, tokens, times = np.unique(np.concatenate(gathered), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            out = as_batch((block, hashes[order].tobytes(), packed(number[tokens]), packed(np.array(list(map(len, gathered)))), list(ids)), kinds, names)
            ids.clear()
            gathered.clear()
            block, size = block + 1, 0
            return out

        for batch in by_bytes(batches, most=1 << 20):
            for k, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids.append(k)
                gathered.append(hashes_of(text))
                size += 8 * len(gathered[-1])
            if size >= BLOCK:
                yield done()
        if ids:
            yield done()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, BLOCKS)


def of_block(words: bytes, tokens: bytes, lengths: bytes, buckets: int) -> tuple[Pairs, np.ndarray]:
    return Pairs(np.frombuffer(words, np.uint64), unpacked(tokens).astype(np.int64), buckets), unpacked(lengths).astype(np.int64)


NUMBERED = "block long, bucket long, data binary"


def dictionary(blocks: DataFrame, buckets: int) -> DataFrame:
    """Rows without a block: the words of a bucket, sorted. Rows with one: the places among them of the block's words."""
    names, kinds = ["block", "bucket", "data"], [pa.int64(), pa.int64(), pa.binary()]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words in rows_of(batches, ["block", "words"]):
            hashes = np.frombuffer(words, np.uint64)
            home = homes(hashes, buckets)
            order = np.lexsort((hashes, home))
            ends = np.cumsum(np.bincount(home, minlength=buckets)).tolist()
            for k, (a, b) in enumerate(zip([0, *ends], ends)):
                if b > a:
                    yield as_batch((block, k, packed_keys(hashes[order[a:b]])), kinds, names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (blocks, data) in by_bucket(batches, ["block", "data"]):
            own = [unpacked_keys(x) for x in data]
            every, at = np.unique(np.concatenate(own), return_inverse=True)
            yield as_batch((None, bucket, packed_keys(every)), kinds, names)
            start = 0
            for block, w in zip(blocks, own):
                yield as_batch((block, bucket, packed_keys(at[start : start + len(w)].astype(np.uint64))), kinds, names)
                start += len(w)

    asked = blocks.select("block", "words").mapInArrow(ask, NUMBERED)
    return asked.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "block").mapInArrow(answer, NUMBERED)


REQUESTS = "block long, bucket long, words binary, times binary, contexts binary, counts binary"


def requests(blocks: DataFrame, numbers: DataFrame, buckets: int) -> DataFrame:
    """The pairs that a block holds, by the bucket of the word: the words' places in the bucket, how many pairs each has,
    the numbers of the pairs' contexts (place times buckets and bucket) and their counts in training texts."""
    names, kinds = [x.split()[0] for x in REQUESTS.split(", ")], [pa.int64(), pa.int64(), *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[tuple[int, np.ndarray]] = []
        for block, bucket, data, words, tokens, lengths, ids in rows_of(batches, ["block", "bucket", "data", "words", "tokens", "lengths", "ids"]):
            if data is not None:
                places.append((bucket, unpacked_keys(data).astype(np.int64)))
                continue
            own, n = of_block(words, tokens, lengths, buckets)
            number = np.concatenate([p * buckets + k for k, p in places])
            counts = np.bincount(own.at, np.repeat([not held_out(k) for k in ids], n), len(own.word)).astype(np.int64)
            times = np.bincount(own.word, minlength=len(own.words))
            spans = dict(zip((k for k, _ in places), (p for _, p in places)))
            a = c = 0
            for k, (b, d) in enumerate(zip(own.ends.tolist(), own.word_ends.tolist())):
                if d > c:
                    yield as_batch((block, k, packed_keys(spans[k].astype(np.uint64)), packed(times[c:d]), packed(number[own.context[a:b]]), packed(counts[a:b])), kinds, names)
                a, c = b, d
            places = []

    rows = [f"cast(null as {t}) {c}" for c, t in (("words", "binary"), ("tokens", "binary"), ("lengths", "binary"), ("ids", "array<long>"))]
    both = numbers.where("block is not null").selectExpr("block", "bucket", "data", *rows)
    both = both.union(blocks.selectExpr("block", f"cast({buckets} as long)", "cast(null as binary)", "words", "tokens", "lengths", "ids"))
    return both.repartition(buckets, "block").sortWithinPartitions("block", "bucket").mapInArrow(run, REQUESTS)


def by_bucket(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[list]]]:
    """Each bucket with the columns of its rows; the input is sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, *values in zip(batch.column("bucket").to_pylist(), *(batch.column(c).to_pylist() for c in names)):
            if held and bucket != now:
                yield now, list(map(list, zip(*held)))
                held = []
            now = bucket
            held.append(values)
    if held:
        yield now, list(map(list, zip(*held)))


#: What passes from sweep to sweep. STATE: of a bucket its words and their places, the numbers of its contexts, its pairs
#: (the number of the word here times the contexts, and that of the context), their counts and tables, line by line for
#: the sweeps that are kept, the present one last. TABLES: for the bucket of the contexts with the places `contexts`,
#: their tables in the bucket `source`; and back, in the same order, their rates. TOTALS: of a bucket words, tokens,
#: customers at the top and parent_draws() for the next sweep.
STATE, TABLES, TOTALS = 0, 1, 2
SEATED = "kind int, bucket long, source long, words binary, places binary, contexts binary, pairs binary, counts binary, tables binary, totals array<long>"
NAMES = [x.split()[0] for x in SEATED.split(", ")]
KINDS = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64())]


def as_batch(row: tuple, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)


class State:
    """The training pairs of a bucket."""

    def __init__(self, words: np.ndarray, places: np.ndarray, contexts: np.ndarray, codes: np.ndarray, count: np.ndarray, lines: np.ndarray):
        self.words, self.places, self.contexts, self.codes, self.count, self.lines = words, places, contexts, codes, count, lines
        self.word, self.context = codes // max(len(contexts), 1), codes % max(len(contexts), 1)

    @classmethod
    def read(cls, words, places, contexts, pairs, counts, tables) -> State:
        codes, places, contexts = (unpacked_keys(x).astype(np.int64) for x in (pairs, places, contexts))
        lines = unpacked(tables).astype(np.int64).reshape(-1, len(codes)) if len(codes) else np.zeros((1, 0), np.int64)
        return cls(unpacked_keys(words), places, contexts, codes, unpacked(counts).astype(np.int64), lines)

    def guests(self, line: int) -> np.ndarray:
        """Of each word its customers at the top."""
        return np.bincount(self.word, self.lines[line], len(self.words)).astype(np.int64)

    def rows(self, bucket: int, buckets: int, sweep: int) -> Iterator[pa.RecordBatch]:
        keys = [packed_keys(x.astype(np.uint64)) for x in (self.words, self.places, self.contexts, self.codes)]
        yield as_batch((STATE, bucket, None, *keys, packed(self.count), packed(self.lines.ravel()), None), KINDS, NAMES)
        of_context, home = np.bincount(self.context, self.lines[-1], len(self.contexts)).astype(np.int64), self.contexts % buckets
        order = np.argsort(home, kind="stable")
        ends = np.cumsum(np.bincount(home, minlength=buckets)).tolist()
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            if b > a:
                chosen = order[a:b]
                yield as_batch((TABLES, k, bucket, None, None, packed_keys((self.contexts[chosen] // buckets).astype(np.uint64)), None, None, packed(of_context[chosen]), None), KINDS, NAMES)
        guests = self.guests(-1)
        totals = [len(self.words), int(self.count.sum()), int(guests.sum()), int(parent_draws(guests, self.words, sweep + 1).sum())]
        yield as_batch((TOTALS, bucket, *[None] * 7, totals), KINDS, NAMES)


def first_state(asked: DataFrame, numbers: DataFrame, buckets: int) -> DataFrame:
    """The pairs that training texts hold, over all blocks, each dish at one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (_, *columns) in by_bucket(batches, ["block", "words", "times", "contexts", "counts"]):
            words = unpacked_keys(columns[0][0])
            places, contexts, counts = [], [], []
            for w, t, c, n in zip(*(x[1:] for x in columns)):
                n = unpacked(n).astype(np.int64)
                places.append(np.repeat(unpacked_keys(w).astype(np.int64), unpacked(t).astype(np.int64))[n > 0])
                contexts.append(unpacked(c).astype(np.int64)[n > 0])
                counts.append(n[n > 0])
            seen, word = np.unique(np.concatenate(places), return_inverse=True)
            every, context = np.unique(np.concatenate(contexts), return_inverse=True)
            if len(seen):
                codes, at = np.unique(word * len(every) + context, return_inverse=True)
                count = np.bincount(at, np.concatenate(counts), len(codes)).astype(np.int64)
                yield from State(words[seen], seen, every, codes, count, np.ones((1, len(codes)), np.int64)).rows(bucket, buckets, 0)

    none = [f"cast(null as binary) {c}" for c in ("times", "contexts", "counts")]
    own = numbers.where("block is null").selectExpr("bucket", "block", "data words", *none)
    both = own.union(asked.select("bucket", "block", "words", "times", "contexts", "counts"))
    return both.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "block").mapInArrow(run, SEATED)


def added_up(seated: DataFrame, numbers: DataFrame, buckets: int, sweep: int) -> DataFrame:
    """TABLES rows on their way back, with the rates of the contexts by their tables in all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (sources, words, contexts, tables) in by_bucket(batches, ["source", "words", "contexts", "tables"]):
            words = unpacked_keys(words[0])
            places = [unpacked_keys(c).astype(np.int64) for c in contexts[1:]]
            if places:
                total = np.bincount(np.concatenate(places), np.concatenate([unpacked(t) for t in tables[1:]]), len(words))
                used = np.flatnonzero(total)
                rate = np.zeros(len(words), np.float32)
                rate[used] = rates(total[used], words[used], sweep)
                for source, p in zip(sources[1:], places):
                    yield as_batch((TABLES, source, bucket, *[None] * 5, rate[p].tobytes(), None), KINDS, NAMES)

    none = [f"cast(null as binary) {c}" for c in ("contexts", "tables")]
    own = numbers.where("block is null").selectExpr("bucket", "cast(null as long) source", "data words", *none)
    both = own.union(seated.where(F.col("kind") == TABLES).select("bucket", "source", "words", "contexts", "tables"))
    return both.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "source").mapInArrow(run, SEATED)


def next_state(seated: DataFrame, numbers: DataFrame, buckets: int, whole: int, sweep: int) -> DataFrame:
    """A sweep over all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (_, _, *columns) in by_bucket(batches, ["kind", "source", "words", "places", "contexts", "pairs", "counts", "tables"]):
            own, tables = State.read(*(c[0] for c in columns)), columns[-1]
            rate = np.empty(len(own.contexts), np.float32)
            rate[np.argsort(own.contexts % buckets, kind="stable")] = np.concatenate([np.frombuffer(t, np.float32) for t in tables[1:]])
            new = swept(own.word, own.context, own.count, own.lines[-1], own.words, rate, whole, sweep)
            kept = own.lines if sweep > SWEEPS - SAMPLES + 1 else own.lines[:0]
            own.lines = np.concatenate((kept, new[None]))
            yield from own.rows(bucket, buckets, sweep)

    both = seated.where(F.col("kind") == STATE).union(added_up(seated, numbers, buckets, sweep))
    return both.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "kind", "source").mapInArrow(run, SEATED)


ANSWERS = "block long, bucket long, words binary, figures binary, of_words binary"


def answers(asked: DataFrame, seated: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, words (their places), figures (count and tables in all samples of the pairs asked for), of_words
    (count, and customers at the top in each sample, of the words)."""
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
    names = [x.split()[0] for x in ANSWERS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = now = None
        for bucket, block, words, places, times, contexts, pairs, counts, tables in rows_of(batches, ["bucket", "block", "words", "places", "times", "contexts", "pairs", "counts", "tables"]):
            if bucket != now:
                own, now = State(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 4, np.zeros((SAMPLES, 0), np.int64)), bucket
                of_pair = None
            if block is None:
                own = State.read(words, places, contexts, pairs, counts, tables)
                continue
            if of_pair is None:  # a last entry for what isn't known
                of_pair = np.pad(np.stack((own.count, own.lines.sum(axis=0))), ((0, 0), (0, 1)))
                of_word = np.pad(np.stack((np.bincount(own.word, own.count, len(own.words)).astype(np.int64), *map(own.guests, range(SAMPLES)))), ((0, 0), (0, 1)))
            at = found(own.places, unpacked_keys(words).astype(np.int64))
            word, context = np.repeat(at, unpacked(times).astype(np.int64)), found(own.contexts, unpacked(contexts).astype(np.int64))
            codes = np.where((word < len(own.words)) & (context < len(own.contexts)), word * len(own.contexts) + context, -1)
            yield as_batch((block, bucket, words, packed(of_pair[:, found(own.codes, codes)].ravel()), packed(of_word[:, at].ravel())), kinds, names)

    none = lambda *names: [f"cast(null as binary) {c}" for c in names]
    both = seated.where(F.col("kind") == STATE).selectExpr("bucket", "cast(null as long) block", "words", "places", *none("times"), "contexts", "pairs", "counts", "tables")
    both = both.union(asked.selectExpr("bucket", "block", "words", *none("places"), "times", "contexts", *none("pairs", "counts", "tables")))
    return both.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "block").mapInArrow(run, ANSWERS)


def found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the sorted keys have what is wanted; their number, where they haven't."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


def rows_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def context_tables(replies: DataFrame, kept: list[DataFrame], buckets: int) -> DataFrame:
    """block, bucket, tables: of each kept sweep, over all buckets, for the words of a block as contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (blocks, samples, words, tables) in by_bucket(batches, ["block", "sample", "words", "tables"]):
            parted = [(s, unpacked_keys(w).astype(np.int64), unpacked(t)) for b, s, w, t in zip(blocks, samples, words, tables) if b is None]
            asked = [(b, unpacked_keys(w).astype(np.int64)) for b, w in zip(blocks, words) if b is not None]
            total = np.zeros((SAMPLES, 1 + max(int(p[-1]) for p in (*(p for _, p, _ in parted), *(p for _, p in asked)))), np.int64)
            for s, places, t in parted:
                total[s, places] += t.astype(np.int64)
            for block, places in asked:
                yield as_batch((block, bucket, packed(total[:, places].ravel())), [pa.int64(), pa.int64(), pa.binary()], ["block", "bucket", "tables"])

    rows = replies.selectExpr("block", "bucket", "0 sample", "words", "cast(null as binary) tables")
    for s, seated in enumerate(kept):
        rows = rows.union(seated.where(F.col("kind") == TABLES).selectExpr("cast(null as long)", "bucket", f"{s}", "contexts", "tables"))
    return rows.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(run, "block long, bucket long, tables binary")


def log_chances(context: np.ndarray, pairs: np.ndarray, of_words: np.ndarray, word: np.ndarray, of_contexts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of numbers of a context and a word: log10 of the base's and of the model's probability, and
    whether the word is known. pairs: count and tables in all samples; of_words: count and customers at the top in each
    sample, of all words; of_contexts: tables in each sample, of the words as contexts; totals: training words, tokens,
    and customers at the top in each sample."""
    vocabulary, training = totals[:2]
    count, guests = of_words[0][word].astype(float), of_words[0][context].astype(float)
    mean = pairs[0] - DISCOUNT * pairs[1] / SAMPLES
    for s in range(SAMPLES):
        own = of_words[1 + s][word]
        above = np.where(count > 0, own - TOP_DISCOUNT, TOP_STRENGTH + TOP_DISCOUNT * vocabulary) / (TOP_STRENGTH + totals[2 + s])
        mean = mean + (STRENGTH + DISCOUNT * of_contexts[s][context]) * above / SAMPLES
    return np.log10((count + 1) / (training + vocabulary + 1)), np.log10(mean / (STRENGTH + guests)), count > 0


def summed(seated: DataFrame) -> list[int]:
    """Words, tokens, customers at the top and parent_draws() of all buckets: a row for each comes to the driver."""
    rows = [r.totals for r in seated.where(F.col("kind") == TOTALS).select("totals").collect()]
    return [sum(r[i] for r in rows) for i in range(4)]


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    buckets = parts(spark)
    blocks = materialise(blocked(docs), "blocks")
    numbers = materialise(dictionary(blocks, buckets), "dictionary")
    free_shuffles(spark)
    asked = materialise(requests(blocks, numbers, buckets), "requests")
    free_shuffles(spark)
    seated = materialise(first_state(asked, numbers, buckets), "seated")
    kept: list[DataFrame] = []
    counted: list[list[int]] = []
    for sweep in range(1, SWEEPS + 1):
        free_shuffles(spark)
        sums = summed(seated)
        before, seated = seated, materialise(next_state(seated, numbers, buckets, max(sums[3] + unknown_draw(sums[0], sweep), 1), sweep), "seated")
        if before not in kept:
            discard(before)
        if sweep > SWEEPS - SAMPLES:
            kept.append(seated)
            counted.append(summed(seated))
    free_shuffles(spark)
    replies = materialise(answers(asked, seated, buckets), "answers")
    discard(asked)
    free_shuffles(spark)
    of_contexts = materialise(context_tables(replies, kept, buckets), "contexts")
    for seated in kept:
        discard(seated)
    free_shuffles(spark)
    totals = [*counted[-1][:2], *(c[2] for c in counted)]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def scored(ids: list, block: tuple, figures: list[tuple], tables: list[bytes]) -> pa.RecordBatch:
        """Rows of a block; figures, tables: by bucket."""
        own, lengths = of_block(*block, buckets)
        joined = lambda data, lines: np.concatenate([unpacked(x).reshape(lines, -1) for x in data], axis=1).astype(float)
        chances = log_chances(own.context, joined([f for f, _ in figures], 2), joined([w for _, w in figures], 1 + SAMPLES), own.word, joined(tables, SAMPLES), np.array(totals, float))
        starts = np.cumsum(lengths) - lengths
        base, model, known = (np.add.reduceat(x[own.at].astype(float), starts) for x in chances)
        columns = [ids, [held_out(k) for k in ids], lengths, known.astype(np.int64), [totals[1]] * len(ids), base, model]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures, tables = [], []
        for of_pairs, of_words, of_contexts, ids, *block in rows_of(batches, ["figures", "of_words", "tables", "ids", "words", "tokens", "lengths"]):
            if of_pairs is not None:
                figures.append((of_pairs, of_words))
            elif of_contexts is not None:
                tables.append(of_contexts)
            else:  # the block itself comes last
                yield scored(ids, block, figures, tables)
                figures, tables = [], []

    none = lambda *names: [f"cast(null as binary) {c}" for c in names]
    rows = [*none("words", "tokens", "lengths"), "cast(null as array<long>) ids"]
    both = replies.selectExpr("block", "bucket", "figures", "of_words", *none("tables"), *rows)
    both = both.union(of_contexts.selectExpr("block", "bucket", *none("figures", "of_words"), "tables", *rows))
    both = both.union(blocks.selectExpr("block", f"cast({buckets} as long)", *none("figures", "of_words", "tables"), "words", "tokens", "lengths", "ids"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.repartition(buckets, "block").sortWithinPartitions("block", "bucket").mapInArrow(run, schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, n_tokens, perplexity and base_perplexity over all its documents."""
    power = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), power("score").alias("perplexity"), power("base_score").alias("base_perplexity"))
