"""Cost-balanced packing of token sequences.

Every document is tokenised and ended by id 0. Its whole multiples of CAPACITY tokens are sequences of their own; what
is left over is gathered into blocks of at most BLOCK tokens. In a block, pieces go in descending length to the
sequence of lowest cost that has room, where a piece of n tokens costs n + n * n / CAPACITY (linear work and
attention within the piece). A piece that fits nowhere is cut to fill what room there is, cheapest sequence first. A
block's sequences hold its tokens exactly: CAPACITY each, and the rest in powers of two, which need no padding.

Blocks lie within a partition of the input, so nothing is shuffled and one source or id can be as large as it likes.
Sequence ids are the partition's number times 2**32 and a count.

Rows: one for each piece, at least one a document, as the end token is always there. Null text: empty, the end token
alone. Null ids: kept. Repeated rows: each is packed. Very long texts: whole, tokenised at once. Strings of special
tokens in a text are those tokens, as the library has it. Empty table: no rows. Further columns, whatever their names,
are left out.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import RUN, cuts
from .common import by_bytes, texts, use

CAPACITY = 1024
BLOCK = 1 << 20
END = b"\0\0\0\0"


#: Marks a cut that has no space before it.
BARE = "\2"
MARKS = (".", ",")


def lines_cut(text: str) -> list[str]:
    """The text cut at each space and around each newline with no other white space beside it."""
    if BARE in text:
        return [BARE + text]
    if "\n" not in text:
        return [BARE + x if i == 0 else x for i, x in enumerate(cuts(text))]
    out = [BARE]
    at, joined = 0, False
    for run in [*RUN.finditer(text), None]:
        end = run.start() if run else len(text)
        pieces = text[at:end].replace("\n", " \n " + BARE).split(" ")
        if joined or at == 0:
            out[-1] += pieces.pop(0)
        out += pieces
        if run:
            out[-1] += run[0]
            at, joined = run.end(), True
    return out


class Tokens:
    """Ids by a byte-level tokenizers file whose pre-tokenizer breaks before a space, and on both sides of a newline,
    with no other white space beside it. So cuts can be looked up, and new ones encoded many in one string: the bytes
    of the tokens tell them apart."""

    def __init__(self, path: str, memo: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a character is a byte
            self.lengths[i] = len(token)
        self.memo = memo
        self.marks = {x: self.ids([x])[0].tobytes() for x in MARKS}
        self.always = {"\n": self.ids(["\n"])[0].tobytes(), BARE: b""}
        self.known = dict(self.always)

    def ids(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def learn(self, new: list[str], joint: str, bare: bool) -> None:
        """Encode cuts; the joint goes before each if it's a space, else after each."""
        groups: list[list[str]] = [[]]
        size = 0
        for cut in new:
            groups[-1].append(cut)
            size += len(cut)
            if size > 1 << 15:
                groups.append([])
                size = 0
        for group, ids in zip(groups, self.ids([joint + joint.join(g) if not bare else joint.join(g) for g in groups])):
            joined = np.frombuffer(joint.join(group).encode(), np.uint8)
            ends = np.append(np.flatnonzero(joined == ord(joint)), len(joined)) + 1
            if len(ends) != len(group):  # some cuts hold the joint
                ends = np.cumsum([len(x.encode()) + 1 for x in group])
            at = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            raw, before = ids.tobytes(), 0
            for cut, n in zip(group, (4 * at).tolist()):
                if bare:
                    self.known[BARE + cut] = raw[before : n - 4 if n <= len(raw) else n]
                else:
                    self.known[cut] = raw[before:n]
                before = n

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        all_cuts = [lines_cut(text) for text in batch]
        known = self.known
        if len(known) > self.memo:
            known.clear()
        if BARE not in known:
            known.update(self.always)
        plain, bare, odd = [], [], []
        missing = set().union(*all_cuts).difference(known)
        # a mark after a letter is a token of its own
        ended = [cut for cut in missing if cut.endswith(MARKS) and cut[-2:-1].isalpha()]
        missing.difference_update(ended)
        missing.update({cut[:-1] for cut in ended}.difference(known))
        for cut in missing:
            if not cut.startswith(BARE):
                plain.append(cut)
            elif cut[1:2].isspace() or BARE in cut[1:]:
                odd.append(cut)
            else:
                bare.append(cut[1:])
        if plain:
            self.learn(plain, " ", False)
        if bare:
            self.learn(bare, "\n", True)
        if odd:
            known.update(zip(odd, (x.tobytes() for x in self.ids([x[1:] for x in odd]))))
        for cut in ended:
            known[cut] = known[cut[:-1]] + self.marks[cut[-1]]
        get = known.__getitem__
        for pieces in all_cuts:
            yield b"".join(map(get, pieces))


@functools.lru_cache(maxsize=1)
def tokens(path: str, memo: int) -> Tokens:
    """One a Python worker."""
    return Tokens(path, memo)


def cost(n):
    return n + n * n / CAPACITY


def capacities(total: int) -> np.ndarray:
    """Room of each sequence: whole ones, then the powers of two that make up the rest."""
    rest = total % CAPACITY
    return np.array([CAPACITY] * (total // CAPACITY) + [1 << k for k in range(CAPACITY.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)


def balance(lengths: list[int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(item, start in it, length, sequence, offset) of each piece, and the number of sequences."""
    room = capacities(sum(lengths))
    spent, filled = np.zeros(len(room)), np.zeros(len(room), np.int64)
    out = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[i]
        while left:
            fits = np.where(room >= left, spent, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(np.where(room > 0, spent, np.inf).argmin())
            n = min(left, int(room[s]))
            out.append((i, start, n, s, int(filled[s])))
            room[s] -= n
            filled[s] += n
            spent[s] += cost(n)
            start, left = start + n, left - n
    return out, len(room)


def packed(docs: DataFrame, path: str, keep_ids: bool = False, memo: int = 1_500_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with keep_ids the piece's ids as well.
    memo: cuts that a Python worker remembers, at about 200 bytes each."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(path, memo)
        use(coder.known)
        base = TaskContext.get().partitionId() << 32
        used = 0
        rows: list[tuple] = []
        items: list[tuple] = []  # id, ids, start of the left-over, tokens of the document
        held = 0

        def put(k, ids: bytes, start: int, n: int, total: int, sequence: int, offset: int) -> None:
            piece = ids[4 * start : 4 * (start + n)]
            row = (k, start, n, zlib.crc32(piece), total, base + sequence, offset)
            rows.append((*row, np.frombuffer(piece, "<i4")) if keep_ids else row)

        def pack() -> None:
            nonlocal used, held
            pieces, n = balance([len(x[1]) // 4 for x in items])
            for i, start, length, s, offset in pieces:
                k, ids, before, total = items[i]
                put(k, ids, start, length, total, used + s, offset)
                rows[-1] = (k, before + start, *rows[-1][2:])
            used += n
            held = 0
            items.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names + ["ids"] * keep_ids)
            rows.clear()
            return out

        for batch in by_bytes(batches):
            for k, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(texts(batch))):
                ids += END
                total = len(ids) // 4
                whole = total - total % CAPACITY
                for start in range(0, whole, CAPACITY):
                    put(k, ids, start, CAPACITY, total, used, 0)
                    used += 1
                if total > whole:
                    if held + total - whole > BLOCK:
                        pack()
                    items.append((k, ids[4 * whole :], whole, total))
                    held += total - whole
                if len(rows) >= 4096:
                    yield flush()
        if items:
            pack()
        if rows:
            yield flush()

    schema = ", ".join(f"{n} long" for n in names) + ", ids array<int>" * keep_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
