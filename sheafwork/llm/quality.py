"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rated document has a grade from 0 to 2: 0 junk, 1 well-formed but toxic, 2 clean. One weight vector w over hashed
text features is shared by all grades; thresholds t1 < t2 turn the score s = w . x into P(grade >= k) = sigma(s - tk).
From these come the expected grade and the tail probability P(grade = 2), by which documents are kept.

Features, hashed into 2 ** BITS places: each distinct word (lower case, without punctuation at its ends) and its
first four and five letters, the share of words of each shape (runs of capitals, small letters, digits and marks), and the shares of repeated words.

fit() takes a bounded sample: at most `sample` rated documents, those of the smallest hashed ids. Only they are
collected, as feature lists. It is proximal gradient descent with an L1 penalty. score() is one pass over whole texts.

Rows of score(): one out for one in. Null text: empty, which has no words and scores like the junk it is. Null ids: kept.
Without any ratings every document is kept. Repeated rows: repeated results; in the sample an id that is repeated
counts once, by its first text. Ratings that are null are left out; a document with several ratings takes each of them.
Very long texts: whole. Empty table: no rows. Further columns are given back by stage(), whatever their names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, by_bytes, named, numbered, texts, use

BITS = 18
#: The bound of the training sample.
SAMPLE = 6000
ENDS = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"
MARKS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def place(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def shape(word: str) -> str:
    """Aa for Word, A! for WORD!!, and so on; at most four runs."""
    out = []
    for run in MARKS.findall(word)[:4]:
        if run[0].isalpha():
            out.append("A" if run.isupper() and len(run) > 1 else "Aa" if run[0].isupper() else "a")
        else:
            out.append("0" if run[0].isdigit() else run[0])
    return "".join(out)


def features(text: str, known: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Places (repeated ones add up) and values."""
    words = text.split()
    n = len(words)
    if not n:
        return np.array([place("\0empty")]), np.ones(1)
    count = Counter(words)
    codes = np.frombuffer(b"".join(map(known.__getitem__, count)), np.int32).reshape(-1, 4)
    own = codes[:, :3].T.ravel()
    times = np.fromiter(count.values(), np.float64, len(count))
    same = sum(map(str.__eq__, words, words[1:])) / n
    extra = [(place("\0bias"), 1.0), (place("\0same"), 3 * same), (place("\0most"), 3 * times.max() / n if n >= 20 else 0.0), (place("\0new"), len(count) / n if n >= 20 else 0.0)]
    places = np.concatenate((own, codes[:, 3], [p for p, _ in extra]))
    return places, np.concatenate((np.ones(len(own)), 3 * times / n, [v for _, v in extra]))


def summed(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place once."""
    used, at = np.unique(places, return_inverse=True)
    return used.astype(np.int32), np.bincount(at, values).astype(np.float32)


def word_code(word: str) -> bytes:
    """Four places as 32-bit integers: of the word, its first five and four letters, and its shape."""
    core = word.strip(ENDS).lower()
    return struct.pack("=4i", place(core), place("\3" + core[:5]), place("\2" + core[:4]), place("\1" + shape(word)))


KNOWN = Memo(word_code, 300_000)


@dataclass
class Model:
    places: np.ndarray
    weights: np.ndarray
    thresholds: tuple[float, ...]

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS)
        w[self.places] = self.weights
        return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def descend(rows: np.ndarray, places: np.ndarray, values: np.ndarray, grades: np.ndarray, penalty: float = 8e-3, steps: int = 250, least: float = 0.005) -> Model:
    """Accelerated proximal gradient on the mean log-loss of the cumulative links; each place once a document. Places that are in fewer than a
    share `least` of the documents (or in fewer than three) are left out: they'd be learnt by heart."""
    common = (np.bincount(places, minlength=1 << BITS) >= max(3, least * len(grades)))[places]
    rows, places, values = rows[common], places[common], values[common].astype(np.float64)
    used, at = np.unique(places, return_inverse=True)
    top = int(grades.max())
    n, m = len(grades), len(used)
    # common words say little; scaling each place by its frequency lets rare telling words move as fast
    scale = 1 / np.sqrt(np.maximum(np.bincount(at, values * values, m) / n, 1e-3))
    scale[used == place("\0bias")] = 0  # the thresholds do that
    x = values * scale[at]
    w, t = np.zeros(m), np.array([np.log((grades < k).sum() + 1.0) - np.log((grades >= k).sum() + 1.0) for k in range(1, top + 1)])
    # rare grades weigh more, by the root of their rarity
    weight = 1 / np.sqrt(np.bincount(grades, minlength=top + 1)[grades])
    weight /= weight.sum()
    look, before, momentum = w.copy(), w.copy(), 1.0
    norm = np.bincount(rows, x * x, n)
    rate = 1 / (0.25 * top * (weight * norm).sum())
    rate *= 8

    def loss_and_slopes(w, t):
        s = np.bincount(rows, x * w[at], n)
        high = np.stack([np.ones(n), *(sigmoid(s - c) for c in t), np.zeros(n)])
        p = np.maximum(high[grades, np.arange(n)] - high[grades + 1, np.arange(n)], 1e-9)
        slope = high * (1 - high)
        ds = -(slope[grades, np.arange(n)] - slope[grades + 1, np.arange(n)]) / p * weight
        dt = np.array([(weight * (np.where(grades == k, slope[k], 0) - np.where(grades == k - 1, slope[k], 0)) / p).sum() for k in range(1, top + 1)])
        return -(np.log(p) * weight).sum(), np.bincount(at, x * ds[rows], m), dt

    last = np.inf
    for _ in range(steps):
        loss, g, dt = loss_and_slopes(look, t)
        if loss > last * 1.5 + 1e-6:  # overshot
            rate /= 2
            look, momentum = before.copy(), 1.0
            last = np.inf
            continue
        last = loss
        w = look - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        t = np.sort(t - np.clip(4 * dt, -0.5, 0.5))
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        look = w + (momentum - 1) / following * (w - before)
        before, momentum = w, following
    w = before * scale
    kept = np.flatnonzero(w)
    return Model(used[kept], w[kept], tuple(t.tolist()))


FEATURES = "rated_id long, grade int, times long, places array<int>, values array<float>"


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From `labels` (doc_id, quality, toxic): at most `sample` of them."""
    grade = F.expr("case when quality = 0 then 0 when toxic = 1 then 1 else 2 end").cast("int")
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("rated_id"), grade.alias("grade"))
    chosen = rated.orderBy(F.xxhash64("rated_id"), "rated_id", "grade").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(KNOWN)
        for batch in by_bytes(batches):
            found = [summed(*features(t, KNOWN)) for t in texts(batch)]
            columns = [*(batch.column(c) for c in ("rated_id", "grade", "times")), pa.array([p for p, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["rated_id", "grade", "times", "places", "values"])

    # the sample is bounded, so it may be broadcast; one text for each of its ids
    chosen = chosen.groupBy("rated_id", "grade").agg(F.count("*").alias("times"))
    joined = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), F.col("id") == F.col("rated_id"))
    once = joined.groupBy("rated_id", "grade", "times").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    # in one order, so that the sums are the same at any partitioning
    table = once.mapInArrow(run, FEATURES).toArrow().sort_by([("rated_id", "ascending"), ("grade", "ascending")])
    table = table.take(np.repeat(np.arange(table.num_rows), table["times"].to_numpy()))
    if not table.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), (-35.0,))
    grades = table["grade"].to_numpy().astype(np.int64)
    places = table["places"].combine_chunks()
    lengths = pa.compute.list_value_length(places).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(grades), dtype=np.int32), lengths)
    if len(set(grades.tolist())) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), (35.0 if grades.max() < 2 else -35.0,))
    return descend(rows, places.flatten().to_numpy(), table["values"].combine_chunks().flatten().to_numpy(), grades)


SCORES = "score double, expected_grade double, p_clean double, kept boolean"


def score(docs: DataFrame, model: Model, least: float = 0.6, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns asked for, then score, expected_grade, p_clean and kept (p_clean >= least). The model holds at most
    2 ** BITS weights and goes with the function. Columns of docs may have any names; these four are put last."""
    passed = [c for c in columns if c not in ("score", "expected_grade", "p_clean", "kept")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(KNOWN)
        w = model.dense()
        for batch in by_bytes(batches, "_text"):
            s = np.empty(batch.num_rows)
            for i, t in enumerate(texts(batch, "_text")):
                places, values = features(t, KNOWN)
                s[i] = (w[places] * values).sum()
            tails = [sigmoid(s - t) for t in model.thresholds]
            clean = tails[-1]
            columns = [batch.column(c) for c in passed] + [pa.array(x) for x in (s, sum(tails), clean, clean >= least)]
            yield pa.RecordBatch.from_arrays(columns, [*passed, "score", "expected_grade", "p_clean", "kept"])

    chosen = docs.select(*(F.col(f"`{c}`") for c in passed), F.col("text").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text"), SCORES])
    return chosen.mapInArrow(run, schema)


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    model = fit(docs, labels)
    rows, names = numbered(docs)
    columns = tuple(rows.columns)
    rows = rows.withColumn("text", F.col(f"c{names.index('text')}"))
    return named(score(rows, model, columns=columns).where("kept"), names)
