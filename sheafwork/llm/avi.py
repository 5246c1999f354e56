"""AVI motion-JPEG: containers, intra frames, shots.

Reading: the RIFF chunks, the index (`idx1`, or OpenDML `indx`/`ix00`, else the chunks of `movi` themselves), then
each frame as baseline JPEG (Huffman, any quantisation, restart intervals, subsampled components). Frames whose
blocks hold DC terms only are decoded many at a time, a block a step for all of them; others one by one.

Writing: one frame holds WIDTH x HEIGHT samples, each as a flat 8x8 block. With a DC quantiser of 8 a flat block's
coefficient is the sample less 128, which every decoder restores exactly, so the store is lossless.

Shots: between neighbouring frames the difference of 16-bin luminance histograms is taken; a cut is where it is at
least FLOOR and above the lower median of those within WINDOW frames on either side by SIGMAS deviations, as the lower
median deviation tells them; so cuts stand beside cuts, as long as half of the frames around are still.

Rows of stored(): one for each row of the input, with its clips. Null text: empty, that is one frame of filling. Null
ids: kept. Repeated rows: repeated results. Very long texts go through in groups of FRAMES frames. Empty table: no rows.
Further columns, whatever their names, are left out. Rows of clips(): one for each shot of each file; null, empty and
damaged files have none.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .common import by_bytes, texts

WIDTH, HEIGHT = 32, 18
SAMPLES = WIDTH * HEIGHT
RATE = 25
FRAMES = 512
FLOOR, WINDOW, SIGMAS = 0.25, 8, 2.0

#: Code lengths of DC difference sizes 0 to 8, in the order of the symbols; and of AC symbols: end of block only.
DC_LENGTHS = {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 5: 3, 6: 3, 7: 3, 8: 4}
ZIGZAG = np.array([y * 8 + x for s in range(15) for x, y in (((i, s - i) if s % 2 == 0 else (s - i, i)) for i in range(s + 1)) if x < 8 and y < 8])


def huffman(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The table as a JPEG stores it, and (code, length) by symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(counts) + bytes(order), codes


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DC_TABLE, _DC_CODES = huffman(DC_LENGTHS)
_AC_TABLE, _AC_CODES = huffman({0: 1})
HEAD = (
    b"\xff\xd8"
    + segment(0xDB, b"\0" + bytes([8] * 64))
    + segment(0xC0, struct.pack(">BHHB3B", 8, HEIGHT * 8, WIDTH * 8, 1, 1, 0x11, 0))
    + segment(0xC4, b"\x00" + _DC_TABLE)
    + segment(0xC4, b"\x10" + _AC_TABLE)
    + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def _write_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference from -255 to 255, end of block included."""
    bits, sizes = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = _DC_CODES[n]
        extra = d if d > 0 else d + (1 << n) - 1
        end, end_length = _AC_CODES[0]
        bits[d + 255] = ((code << n | (extra if n else 0)) << end_length) | end
        sizes[d + 255] = length + n + end_length
    return bits, sizes


BITS, SIZES = _write_tables()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG for each row of SAMPLES values."""
    n = len(samples)
    values = samples.astype(np.int16) - 128
    index = np.empty(values.shape, np.int16)
    index[:, 0] = values[:, 0]
    np.subtract(values[:, 1:], values[:, :-1], out=index[:, 1:])
    index += 255
    size = SIZES[index]
    ends = np.cumsum(size, axis=1)
    total = ends[:, -1].copy()
    words = int(total.max() + 31) // 32 + 1
    ends += (np.arange(n, dtype=np.int64) * words * 32)[:, None]
    start = ends - size
    word = start >> 5
    room = (64 - (start & 31) - size).astype(np.uint64)
    put = BITS[index] << room  # as 64 bits from the start of the word
    # bits of different codes never overlap, so adding sets them
    packed = np.bincount(word.ravel(), (put >> np.uint64(32)).ravel().astype(np.float64), n * words)
    packed += np.bincount(word.ravel() + 1, (put & np.uint64(0xFFFFFFFF)).ravel().astype(np.float64), n * words)[: n * words]
    raw = packed.astype(np.uint32).astype(">u4").tobytes()
    out = []
    for i, bits in enumerate(total.tolist()):
        data = bytearray(raw[i * words * 4 : i * words * 4 + (bits + 7) // 8])
        if bits % 8:
            data[-1] |= (1 << (8 - bits % 8)) - 1
        out.append(b"".join((HEAD, bytes(data).replace(b"\xff", b"\xff\0"), b"\xff\xd9")))
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def header(frames: int, largest: int) -> bytes:
    w, h = WIDTH * 8, HEIGHT * 8
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, frames, 0, 1, largest, w, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    return chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)


def write_avi(payload: bytes) -> bytes:
    """An AVI of the payload, whose length is a positive multiple of SAMPLES."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES)
    body, index, at = io.BytesIO(), [], 4
    largest = 0
    for i in range(0, len(samples), FRAMES):
        for frame in encode_frames(samples[i : i + FRAMES]):
            c = chunk(b"00dc", frame)
            index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
            body.write(c)
            at += len(c)
            largest = max(largest, len(frame))
    movi = chunk(b"LIST", b"movi" + body.getvalue())
    inner = b"AVI " + header(len(samples), largest) + movi + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", inner)


def riff(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(name, list type, start of the body, end of the body) of each chunk."""
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        stop = min(start + 8 + size, end)
        is_list = name in (b"RIFF", b"LIST")
        yield name, data[start + 8 : start + 12] if is_list else b"", start + 8 + 4 * is_list, stop
        start = stop + size % 2


def video_frames(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Seconds a frame, and where each frame's JPEG lies: by the index, or chunk by chunk where there is none."""
    seconds, index, standard, chunks, movi = 1 / RATE, [], [], [], 0

    def walk(start: int, end: int) -> None:
        nonlocal seconds, movi
        for name, kind, at, stop in riff(data, start, end):
            if kind in (b"AVI ", b"AVIX", b"hdrl", b"strl", b"rec "):
                walk(at, stop)
            elif kind == b"movi":
                movi = movi or at
                walk(at, stop)
            elif name == b"avih":
                seconds = struct.unpack_from("<I", data, at)[0] / 1e6 or seconds
            elif name == b"idx1":
                index.extend(struct.unpack_from("<4sIII", data, i) for i in range(at, stop - 15, 16))
            elif name[:2] == b"ix":
                per, _, _, n, _, base = struct.unpack_from("<HBBI4sQ", data, at)
                for i in range(n):
                    off, size = struct.unpack_from("<II", data, at + 24 + i * per * 4)
                    standard.append((base + off, size & 0x7FFFFFFF))
            elif name[2:4] in (b"dc", b"db") and stop > at:
                chunks.append((at, stop - at))

    walk(0, len(data))
    if standard:
        return seconds, standard
    found = [(o, n) for name, _, o, n in index if name[2:4] in (b"dc", b"db") and n]
    if found:
        # offsets count from the list type of movi, or from the start of the file
        base = movi - 4 if data[movi - 4 + found[0][0] : movi + found[0][0]] == index[0][0] else 0
        return seconds, [(base + o + 8, n) for o, n in found]
    return seconds, chunks


class Jpeg:
    """The segments of one baseline JPEG. `like`: one whose segments are kept if the data starts alike."""

    def __init__(self, data: bytes, like: Jpeg | None = None):
        if like and data.startswith(like.head):
            self.__dict__.update(like.__dict__)
        else:
            self.read(data)
        stop = data.rfind(b"\xff\xd9")
        self.data = data[len(self.head) : stop if stop >= len(self.head) else len(data)]

    def read(self, data: bytes) -> None:
        self.quant, self.tables, self.restart = {}, {}, 0
        self.parts, at = [], 2
        while at < len(data):
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker in (0xC0, 0xC1):
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline JPEG is read")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        self.head = data[:at]

    def flat(self) -> bool:
        """Whether it's laid out as write_avi() does it: one component, no restarts, short codes."""
        return len(self.parts) == 1 and not self.restart


def codes(table: bytes) -> Iterator[tuple[int, int, int]]:
    """(code, length, symbol)."""
    code, at = 0, 16
    for n in range(16):
        for _ in range(table[n]):
            yield code, n + 1, table[at]
            code, at = code + 1, at + 1
        code <<= 1


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each 16 bits."""
    symbol, length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    for code, n, s in codes(table):
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


_STEPS: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def steps(dc: bytes, ac: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that hold a DC difference and an end of block: the difference and the bits used, else 0."""
    if dc + ac not in _STEPS:
        symbol, length = lookup(dc)
        window = np.arange(1 << 16)
        used = length + symbol
        ok = (length > 0) & (used < 16)
        extra = (window >> np.clip(16 - used, 0, 16)) & ((1 << symbol) - 1)
        diff = np.where(symbol == 0, 0, np.where(extra >= (1 << symbol) >> 1, extra, extra - (1 << symbol) + 1))
        rest = (window << np.clip(used, 0, 16)) & 0xFFFF
        end_symbol, end_length = lookup(ac)
        total = used + end_length[rest]
        ok &= (end_symbol[rest] == 0) & (end_length[rest] > 0) & (total <= 16)
        _STEPS.clear()
        _STEPS[dc + ac] = diff.astype(np.int32), np.where(ok, total, 0).astype(np.int32)
    return _STEPS[dc + ac]


def decode_flat(jpegs: list[Jpeg]) -> tuple[np.ndarray, np.ndarray]:
    """DC images (uint8, a row a frame, one sample a block), and which frames hold DC terms only."""
    first = jpegs[0]
    blocks = -(-first.width // 8) * -(-first.height // 8)
    data = [j.data.replace(b"\xff\0", b"\xff") for j in jpegs]
    width = max(map(len, data)) + 4
    raw = b"".join(d.ljust(width, b"\xff") for d in data)
    raw = np.frombuffer(raw + b"\xff" * 4, np.uint8).astype(np.uint32)
    three = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    diff, used = steps(first.tables[first.scan[first.parts[0][0]] >> 4], first.tables[0x10 | first.scan[first.parts[0][0]] & 15])
    at = np.arange(len(data), dtype=np.int64) * (width * 8)
    last = at + (width - 3) * 8
    out = np.empty((blocks, len(data)), np.int32)
    ok = np.ones(len(data), bool)
    for k in range(blocks):
        window = (three[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[k] = diff[window]
        n = used[window]
        ok &= n > 0
        at += n
        np.minimum(at, last, out=at)
    scale = int(first.quant[first.parts[0][3]][0])
    dc = np.cumsum(out, axis=0) * scale
    return np.clip((dc.T + 4) // 8 + 128, 0, 255).astype(np.uint8), ok


COSINES = np.array([[(0.5**0.5 if u == 0 else 1) * np.cos((2 * x + 1) * u * np.pi / 16) / 2 for u in range(8)] for x in range(8)])


def decode_full(j: Jpeg) -> np.ndarray:
    """Luminance of any baseline JPEG, block by block."""
    tables = {k: {(n, c): s for c, n, s in codes(t)} for k, t in j.tables.items()}
    h_max, v_max = max(p[1] for p in j.parts), max(p[2] for p in j.parts)
    across, down = -(-j.width // (8 * h_max)), -(-j.height // (8 * v_max))
    _, h, v, q = j.parts[0]
    plane = np.zeros((down * v * 8, across * h * 8))
    runs = [j.data]
    if j.restart:
        marks = [i for i in range(len(j.data) - 1) if j.data[i] == 0xFF and 0xD0 <= j.data[i + 1] <= 0xD7]
        runs = [j.data[a:b] for a, b in zip([0, *(m + 2 for m in marks)], [*marks, len(j.data)])]
    unit = 0
    for run in runs:
        raw = run.replace(b"\xff\0", b"\xff") + b"\xff" * 8
        number, left = int.from_bytes(raw, "big"), len(raw) * 8

        def take(n: int) -> int:
            nonlocal left
            left -= n
            return (number >> left) & ((1 << n) - 1) if n else 0

        def symbol(table: dict) -> int:
            code = n = 0
            while (n, code) not in table:
                code, n = code << 1 | take(1), n + 1
                if n > 16:
                    raise ValueError("broken JPEG")
            return table[n, code]

        def value(n: int) -> int:
            x = take(n)
            return x if not n or x >> (n - 1) else x - (1 << n) + 1

        last = {p[0]: 0 for p in j.parts}
        for _ in range(j.restart or across * down):
            if unit >= across * down:
                break
            for name, hh, vv, _ in j.parts:
                dc, ac = tables[j.scan[name] >> 4], tables[0x10 | j.scan[name] & 15]
                for by in range(vv):
                    for bx in range(hh):
                        last[name] += value(symbol(dc))
                        coef = np.zeros(64, np.int64)
                        coef[0], k = last[name], 1
                        while k < 64:
                            s = symbol(ac)
                            if s & 15:
                                k += s >> 4
                                coef[min(k, 63)] = value(s & 15)
                                k += 1
                            elif s == 0xF0:
                                k += 16
                            else:
                                break
                        if name == j.parts[0][0]:
                            block = np.zeros(64)
                            block[ZIGZAG] = coef * j.quant[q]
                            y, x = (unit // across * v + by) * 8, (unit % across * h + bx) * 8
                            plane[y : y + 8, x : x + 8] = COSINES @ block.reshape(8, 8) @ COSINES.T
            unit += 1
    return np.clip(np.floor(plane + 128.5), 0, 255).astype(np.uint8)[: j.height, : j.width]


def decode(files: list[bytes]) -> list[tuple[float, list[np.ndarray]]]:
    """For each file: seconds a frame, and the frames at one sample a block of 8x8. Alike frames of all files go together."""
    out: list[tuple[float, list]] = []
    waiting: dict[bytes, list[tuple[list, int, Jpeg]]] = {}
    held, last = 0, None

    def flush() -> None:
        nonlocal held
        for group in waiting.values():
            jpegs = [j for _, _, j in group]
            if jpegs[0].flat():
                images, ok = decode_flat(jpegs)
                for k, (frames, i, j) in enumerate(group):
                    frames[i] = images[k] if ok[k] else reduced(decode_full(j))
            else:
                for frames, i, j in group:
                    frames[i] = reduced(decode_full(j))
        waiting.clear()
        held = 0

    for data in files:
        seconds, where = video_frames(data)
        frames: list = [None] * len(where)
        out.append((seconds, frames))
        for i, (o, n) in enumerate(where):
            last = Jpeg(data[o : o + n], last)
            waiting.setdefault(last.head, []).append((frames, i, last))
            held += 1
            if held >= 8 * FRAMES:
                flush()
    flush()
    return out


def reduced(image: np.ndarray) -> np.ndarray:
    """The mean of each block of 8x8."""
    h, w = -(-image.shape[0] // 8) * 8, -(-image.shape[1] // 8) * 8
    image = np.pad(image, ((0, h - image.shape[0]), (0, w - image.shape[1])), mode="edge")
    return np.floor(image.reshape(h // 8, 8, w // 8, 8).mean(axis=(1, 3)) + 0.5).astype(np.uint8).ravel()


def lower_median(x: np.ndarray) -> float:
    return float(np.sort(x)[(len(x) - 1) // 2]) if len(x) else 0.0


def shots(frames: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """(first frame, last frame, difference at its start) of each shot."""
    n = len(frames)
    same = len({len(f) for f in frames}) == 1
    if same:
        bins = (np.stack(frames) >> 4).astype(np.int64) + (np.arange(n) * 16)[:, None]
        hist = np.bincount(bins.ravel(), minlength=n * 16).reshape(n, 16) / len(frames[0])
    else:
        hist = np.stack([np.bincount(f >> 4, minlength=16) / len(f) for f in frames])
    step = np.zeros(n)
    step[1:] = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    starts = [0]
    for i in np.flatnonzero(step >= FLOOR).tolist():
        near = np.concatenate((step[max(1, i - WINDOW) : i], step[i + 1 : i + 1 + WINDOW]))
        middle = lower_median(near)
        if not len(near) or step[i] > middle + SIGMAS * 1.4826 * lower_median(np.abs(near - middle)):
            starts.append(i)
    return [(a, b - 1, float(step[a])) for a, b in zip(starts, [*starts[1:], n])]


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + b"\xff" * ((-len(raw)) % SAMPLES if raw else SAMPLES)


def timed_clips(found: list[tuple[int, int, float]], seconds: float) -> list[dict]:
    return [{"start_ms": round(a * seconds * 1000), "end_ms": round((b + 1) * seconds * 1000), "difference": step} for a, b, step in found]


def stored(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row a document: its text stored as AVI, read back, with digests and features; the file with keep_media."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_shots", "clips"]
    timed = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("difference", pa.float64())]))
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), timed]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_shots long, clips array<struct<start_ms:long,end_ms:long,difference:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, most=1 << 20):
            rows: list[tuple] = []
            sizes, files = [], []
            for text in texts(batch):
                size, payload = payload_of(text)
                sizes.append(size)
                files.append(write_avi(payload))
            for size, media, (seconds, frames) in zip(sizes, files, decode(files)):
                back = b"".join(f.tobytes() for f in frames)
                found = shots(frames)
                mean = ",".join(str(int(f.mean())) for f in (frames[a] for a, _, _ in found))
                feature = f"frames={len(frames)};shots={','.join(f'{a}-{b}' for a, b, _ in found)};mean={mean}"
                row = (size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), len(found), timed_clips(found, seconds))
                rows.append((*row, media) if keep_media else row)
            columns = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), [*kinds[1:], pa.binary()]))]
            yield pa.RecordBatch.from_arrays(columns, names + ["media"] * keep_media)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema + ", media binary" * keep_media)


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Timed clip rows of AVI files: key, clip, first_frame, last_frame, start_ms, end_ms, difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, data in zip(batch.column("k").to_pylist(), batch.column("media").to_pylist()):
                try:
                    ((seconds, frames),) = decode([data]) if data else ((0, []),)
                except (ValueError, LookupError, ArithmeticError, struct.error):  # damaged
                    continue
                found = shots(frames) if frames else []
                for i, ((a, b, _), c) in enumerate(zip(found, timed_clips(found, seconds))):
                    rows.append((k, i, a, b, *c.values()))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [key, "clip", "first_frame", "last_frame", "start_ms", "end_ms", "difference"])

    schema = f"`{key}` long, clip long, first_frame long, last_frame long, start_ms long, end_ms long, difference double"
    return media.selectExpr(f"cast(`{key}` as long) k", f"`{column}` media").mapInArrow(run, schema)
