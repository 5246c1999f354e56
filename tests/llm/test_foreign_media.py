"""Motion-JPEG as other programs write it: AC terms, subsampled components, restarts, and the three kinds of index."""

import struct

import numpy as np
import pytest

from sheafwork.llm import avi


def zigzag():
    """(row, column) along the diagonals, the first step to the right."""
    r = c = 0
    for _ in range(64):
        yield r, c
        if (r + c) % 2 == 0:
            r, c = (r + 1, c) if c == 7 else (r, c + 1) if r == 0 else (r - 1, c + 1)
        else:
            r, c = (r, c + 1) if r == 7 else (r + 1, c) if c == 0 else (r + 1, c - 1)


ORDER = list(zigzag())
#: Codes of one length for every symbol there is, the longest one left out as the format asks.
DC = {s: 5 for s in range(12)}
AC = {run << 4 | size: 9 for run in range(16) for size in range(1, 11)} | {0x00: 9, 0xF0: 9}


def bits(value):
    n = abs(value).bit_length()
    return n, format(value if value > 0 else value + (1 << n) - 1, f"0{n}b") if n else ""


def scan_bits(blocks_of_units, restart):
    """Entropy-coded bytes of units, each a list of (component, 64 quantised values in zigzag order)."""
    _, dc = avi.huffman(DC)
    _, ac = avi.huffman(AC)
    word = lambda t, s: format(t[s][0], f"0{t[s][1]}b")
    out, text, last = b"", "", {}

    def flushed(text):
        text += "1" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")

    for n, unit in enumerate(blocks_of_units):
        if restart and n and n % restart == 0:
            out += flushed(text) + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
            text, last = "", {}
        for name, values in unit:
            size, extra = bits(int(values[0]) - last.get(name, 0))
            last[name] = int(values[0])
            text += word(dc, size) + extra
            run = 0
            end = max((k for k in range(1, 64) if values[k]), default=0)
            for v in values[1 : end + 1]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    text += word(ac, 0xF0)
                    run -= 16
                size, extra = bits(int(v))
                text += word(ac, run << 4 | size) + extra
                run = 0
            if end < 63:
                text += word(ac, 0)
    return out + flushed(text)


def jpeg(r, width, height, sampling, restart=0, zeros=0.7):
    """A JPEG of random coefficients, and its luminance by plain sums of cosines."""
    quant = r.integers(1, 12, 64)
    h, v = sampling
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    plane = np.zeros((down * v * 8, across * h * 8))
    units = []
    for unit in range(across * down):
        own = []
        for name in (1,) if sampling == (1, 1) else (1, 2, 3):
            for k in range(h * v if name == 1 else 1):
                values = np.where(r.random(64) < zeros, 0, r.integers(-9, 10, 64))
                values[0] = r.integers(-60, 60)
                own.append((name, values))
                if name == 1:
                    image = np.zeros((8, 8))
                    for (u, w), q, c in zip(ORDER, quant, values):
                        scale = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if w == 0 else 1) / 4
                        y, x = np.mgrid[:8, :8]
                        image += scale * q * c * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * w * np.pi / 16)
                    top, left = (unit // across * v + k // h) * 8, (unit % across * h + k % h) * 8
                    plane[top : top + 8, left : left + 8] = image
        units.append(own)
    names = sorted({name for name, _ in units[0]})
    frame = struct.pack(">BHHB", 8, height, width, len(names)) + b"".join(bytes([n, (h << 4 | v) if n == 1 else 0x11, 0]) for n in names)
    parts = [avi.segment(0xE0, b"JFIF\0"), avi.segment(0xDB, b"\0" + bytes(quant.tolist())), avi.segment(0xC0, frame)]
    parts += [avi.segment(0xC4, b"\x00" + avi.huffman(DC)[0] + b"\x10" + avi.huffman(AC)[0])]
    parts += [avi.segment(0xDD, struct.pack(">H", restart))] if restart else []
    parts += [avi.segment(0xDA, bytes([len(names), *(x for n in names for x in (n, 0)), 0, 63, 0]))]
    shown = np.clip(np.floor(plane + 128.5), 0, 255)[:height, :width]
    return b"\xff\xd8" + b"".join(parts) + scan_bits(units, restart) + b"\xff\xd9", shown


@pytest.mark.parametrize("sampling, restart", [((1, 1), 0), ((1, 1), 2), ((2, 1), 0), ((2, 2), 0), ((2, 2), 3)])
def test_pictures_with_detail(sampling, restart):
    r = np.random.default_rng(sum(sampling) + restart)
    for width, height in ((8, 8), (40, 24), (37, 19)):
        data, shown = jpeg(r, width, height, sampling, restart)
        got = avi.decode_full(avi.Jpeg(data))
        assert got.shape == shown.shape and np.abs(got.astype(int) - shown).max() <= 1


def test_progressive_pictures_are_refused():
    data, _ = jpeg(np.random.default_rng(1), 8, 8, (1, 1))
    with pytest.raises(ValueError):
        avi.Jpeg(data.replace(b"\xff\xc0", b"\xff\xc2"))


def containers(frames):
    """The same frames under each kind of index."""
    head = avi.header(len(frames), max(map(len, frames)))
    body = [avi.chunk(b"00dc", f) for f in frames]
    sound = avi.chunk(b"01wb", b"\1\2\3")
    movi = avi.chunk(b"LIST", b"movi" + sound + b"".join(body))
    start = 12 + len(head) + 12  # of the chunks in movi, from the start of the file
    at, inside, absolute = len(sound), [], []
    for f, c in zip(frames, body):
        inside.append(struct.pack("<4sIII", b"00dc", 0x10, 4 + at, len(f)))
        absolute.append(struct.pack("<4sIII", b"00dc", 0x10, start + at, len(f)))
        at += len(c)
    whole = lambda *parts: avi.chunk(b"RIFF", b"AVI " + b"".join(parts))
    yield whole(head, movi)
    yield whole(head, movi, avi.chunk(b"idx1", b"".join(inside)))
    yield whole(head, movi, avi.chunk(b"idx1", b"".join(absolute)))
    records, at = [], len(sound)
    for f, c in zip(frames, body):
        records.append(struct.pack("<II", at + 8, len(f)))
        at += len(c)
    standard = avi.chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"00dc", start, 0) + b"".join(records))
    yield whole(head, avi.chunk(b"LIST", b"movi" + sound + b"".join(body) + standard))


def test_each_kind_of_index():
    r = np.random.default_rng(4)
    made = [jpeg(r, 32, 16, (2, 1) if k % 2 else (1, 1)) for k in range(5)]
    for data in containers([j for j, _ in made]):
        ((seconds, frames),) = avi.decode([data])
        assert seconds == 1 / avi.RATE and len(frames) == 5
        for got, (_, shown) in zip(frames, made):
            assert np.abs(got.astype(int) - avi.reduced(shown.astype(np.uint8)).astype(int)).max() <= 1
