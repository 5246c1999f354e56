"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 so that pyahocorasick can hold the vocabulary. A pre-token is encoded from the left:
take the longest vocabulary entry that matches, step back to shorter ones (or over the last token) wherever two
adjacent tokens would not survive the merges, and go on. Whether two tokens may stand side by side is decided by
undoing their merges from the highest rank down, and remembered. The result equals the greedy merge order; the
time is linear in the text, as each position fails at most once.

Rows: one out for one in, also for null ids. Null text: empty, no tokens. Repeated rows: repeated results. Very long
texts: whole. Empty table: no rows. Further columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from .common import Memo, by_bytes, texts, use

NONE = -1


class Bpe:
    def __init__(self, path: str, pattern: str, memo: int = 400_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.count = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * self.count
        for b, r in ranks.items():
            self.bytes[r] = b
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.length = [len(b) for b in self.bytes]
        #: The longest entry that is a proper prefix of each entry.
        self.shorter = [NONE] * self.count
        for b, r in ranks.items():
            for n in range(len(b) - 1, 0, -1):
                if (p := ranks.get(b[:n])) is not None:
                    self.shorter[r] = p
                    break
        self.find = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.find.add_word(b.decode("latin-1"), r)
        self.find.make_automaton()
        self.pairs: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(self.count)), list(range(self.count))
        self.fits = Memo(lambda p: self._fits(*p), memo)
        for r in range(self.count):
            self._undo(r)
        self.fits.clear()
        self.ids = Memo(self._packed, memo)
        self.chunk = Memo(self._chunk, memo // 8)
        self.later = Memo(lambda s: self._chunk(" " + s), 2 * memo)

    def _undo(self, r: int) -> None:
        """Find the merge that made an entry: the split whose halves may stand side by side until then."""
        b, p = self.bytes[r], self.shorter[r]
        while p != NONE:
            q = self.ranks.get(b[self.length[p] :])
            if q is not None and p < r and q < r and self._fits(p, q):
                self.pairs[p, q] = r
                self.left[r], self.right[r] = p, q
                return
            p = self.shorter[p]

    def _fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their bytes are merged by rank."""
        bound = self.count
        while True:
            made = self.pairs.get((a, b))
            if made is not None and made < bound:
                return False
            if a > b:
                bound, a = a, self.right[a]
                if a == bound:
                    bound, b = b + 1, self.left[b]
                    if b + 1 == bound:
                        return True
            else:
                bound, b = b + 1, self.left[b]
                if b + 1 == bound:
                    bound, a = a, self.right[a]
                    if a == bound:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length = len(piece), self.length
        longest = [NONE] * (n + 1)
        most = [0] * (n + 1)
        for end, r in self.find.iter(piece.decode("latin-1")):
            start = end + 1 - length[r]
            if length[r] > most[start]:
                longest[start], most[start] = r, length[r]
        out: list[int] = []
        open_at = bytearray(b"\1" * (n + 1))
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else NONE
            while True:
                end = at + length[token]
                if open_at[end] and (last == NONE or self.fits[last, token]):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                token = self.shorter[token]
                if token == NONE:
                    open_at[at] = 0
                    at -= length[last]
                    token = out.pop()
                    break
        return out

    def _packed(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. The pattern always breaks before a space that has no other
        white space beside it, so the text is cut there and each cut is looked up."""
        first, *rest = cuts(text)
        return (self.chunk[first] if first else b"") + b"".join(map(self.later.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


#: Where cuts aren't made: white space beside white space.
RUN = re.compile(r"\s{2,}")


def cuts(text: str) -> list[str]:
    """The text cut at each space that has no other white space beside it; those spaces are left out."""
    out: list[str] = []
    before, at = "", 0
    for run in RUN.finditer(text):
        pieces = text[at : run.start()].split(" ")
        pieces[0] = before + pieces[0]
        before, at = pieces.pop() + run[0], run.end()
        out += pieces
    pieces = (text[at:] if at else text).split(" ")
    pieces[0] = before + pieces[0]
    return out + pieces if out else pieces


@functools.lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    """One a Python worker."""
    return Bpe(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and round_trip; with keep_ids the ids as well."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        use(coder.fits, coder.ids, coder.chunk, coder.later)
        for batch in by_bytes(batches):
            rows: list[tuple] = []
            for text in texts(batch):
                ids = coder.encode(text)
                back = coder.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode())
                rows.append((*row, np.frombuffer(ids, "<i4")) if keep_ids else row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [x.split()[0] for x in schema.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
