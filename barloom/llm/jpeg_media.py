"""Media columns in baseline JPEG: write bytes as DC-only images, read any baseline JPEG's luminance thumbnail.

The writer puts one byte in one block: the block's DC coefficient, with a quantiser of 8, so each 8x8 block is flat at
exactly that sample value and the image is lossless. 64 blocks make a row and a restart interval. The reader parses
markers, Huffman-decodes every restart interval of every image of a batch in lock step (one symbol of each at a time,
as numpy vectors), drops AC terms and rebuilds the luminance plane at an eighth of the size.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COLS = 64
MAX_ROWS = 8191  # 65,528 lines; the format's heights have 16 bits
CHUNK = 1 << 20
# fixed values: the format's usual luminance DC code: how many codes of each length, and their categories
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), b"\0"  # end of block alone

_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]", re.S)


@lru_cache(64)
def _codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol for each 16-bit prefix; length 0 where no code fits."""
    size, sym = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = k = 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            lo = code << (16 - n)
            size[lo : lo + (1 << (16 - n))], sym[lo : lo + (1 << (16 - n))] = n, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return size, sym


@lru_cache(64)
def _flat_blocks(dc_counts: bytes, dc_symbols: bytes, ac_counts: bytes, ac_symbols: bytes) -> np.ndarray:
    """For each 16-bit prefix that holds a DC term and an end of block in full: (term + 4096) * 32 + bits, else 0."""
    (n, cat), (ac_n, ac_sym) = _codes(dc_counts, dc_symbols), _codes(ac_counts, ac_symbols)
    ahead = np.arange(1 << 16)
    used = n + cat
    fits = (n > 0) & (used < 16) & (cat < 12)
    used = np.where(fits, used, 0)
    cat = np.where(fits, cat, 0)
    raw = (ahead >> (16 - used)) & ((1 << cat) - 1)
    diff = np.where(raw < (1 << np.maximum(cat - 1, 0)), raw - (1 << cat) + 1, raw) * (cat > 0)
    rest = (ahead << used) & 0xFFFF
    total = used + ac_n[rest]
    fits &= (ac_n[rest] > 0) & (ac_sym[rest] == 0) & (total <= 16)
    return np.where(fits, (diff + 4096) * 32 + total, 0)


def _dc_writer() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: the bits of category code, magnitude and end of block, and how many they are."""
    size, sym = _codes(DC_COUNTS, DC_SYMBOLS)
    first = {int(s): (int(i), int(size[i])) for s, i in zip(*np.unique(sym[size > 0], return_index=True), strict=True)}
    bits, many = np.zeros(511, np.uint16), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        at, n = first[cat]
        low = d if d >= 0 else d + (1 << cat) - 1
        bits[d + 255], many[d + 255] = (((at >> (16 - n)) << cat) | low) << 1, n + cat + 1
    return bits, many


_BITS, _MANY = (x.astype(np.int32) for x in _dc_writer())


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@lru_cache(4096)
def _head(rows: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xDB, b"\0" + bytes([8]) + bytes([1]) * 63),
        _segment(0xC0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (COLS * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        _segment(0xC4, b"\0" + DC_COUNTS + DC_SYMBOLS + b"\x10" + AC_COUNTS + AC_SYMBOLS),
        _segment(0xDD, COLS.to_bytes(2, "big")),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def _scans(blocks: np.ndarray, rows: list[int]) -> list[bytes]:
    """Entropy-coded data of images with so many rows each; ``blocks`` holds all their rows of 64 bytes."""
    v = blocks.reshape(-1, COLS).astype(np.int16)
    diff = np.diff(v, axis=1, prepend=np.int16(128)) + 255
    many = np.zeros((len(v), COLS + 1), np.int32)
    bits = np.zeros((len(v), COLS + 1), np.int32)
    many[:, :COLS], bits[:, :COLS] = _MANY[diff], _BITS[diff]
    pad = -many.sum(1) % 8
    many[:, COLS], bits[:, COLS] = pad, (1 << pad) - 1
    size = many.sum(1, dtype=np.int64) // 8
    # codes that begin in one byte are summed as 24-bit words, then laid over three bytes
    ends = np.cumsum(many.ravel(), dtype=np.int64)
    begin = ends - many.ravel()
    shifted = bits.ravel() << (24 - many.ravel() - (begin & 7)).astype(np.int32)
    byte = begin >> 3
    new = np.flatnonzero(np.diff(byte, prepend=-1))
    sums, spot = np.add.reduceat(shifted, new), byte[new]
    data = np.zeros(int(size.sum()) + 3, np.uint8)
    for i in range(3):
        data[spot + i] += ((sums >> (16 - 8 * i)) & 255).astype(np.uint8)
    data = data[:-3]
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    ff = data == 0xFF
    stuffed = size + np.add.reduceat(ff, starts, dtype=np.int64)
    raw = np.repeat(data, 1 + ff)
    raw[np.flatnonzero(ff) + np.arange(1, int(ff.sum()) + 1)] = 0
    # room for a restart marker after each row, dropped after an image's last
    ends = np.cumsum(stuffed)
    out = np.empty(len(raw) + 2 * len(v), np.uint8)
    out[np.arange(len(raw)) + 2 * np.repeat(np.arange(len(v)), stuffed)] = raw
    mark = ends + 2 * np.arange(len(v))
    first = np.concatenate([[0], np.cumsum(rows)[:-1]])
    nth = np.arange(len(v)) - np.repeat(first, rows)
    out[mark], out[mark + 1] = 0xFF, 0xD0 + nth % 8
    whole, at, found = out.tobytes(), 0, []
    for last in np.cumsum(rows) - 1:
        found.append(whole[at : int(mark[last])])
        at = int(mark[last]) + 2
    return found


def write_media(payloads: list[bytes]) -> list[bytes]:
    """JPEG images, one after the other where one can't hold it, for payloads of a positive multiple of 64 bytes."""
    frames = [(k, p[i : i + MAX_ROWS * COLS]) for k, p in enumerate(payloads) for i in range(0, len(p), MAX_ROWS * COLS)]
    out: list[list[bytes]] = [[] for _ in payloads]
    i = 0
    while i < len(frames):
        j, total = i, 0
        while j < len(frames) and (j == i or total + len(frames[j][1]) <= CHUNK):
            total += len(frames[j][1])
            j += 1
        rows = [len(f) // COLS for _, f in frames[i:j]]
        for (k, _), n, scan in zip(frames[i:j], rows, _scans(np.frombuffer(b"".join(f for _, f in frames[i:j]), np.uint8), rows), strict=True):
            out[k] += [_head(n), scan, b"\xff\xd9"]
        i = j
    return [b"".join(x) for x in out]


class _Frame:
    """What the markers of one image say."""

    def __init__(self):
        self.width = self.height = self.interval = 0
        self.parts: list[tuple[int, int, int, int]] = []  # id, h, v, quantiser
        self.scan: list[tuple[int, int, int]] = []  # part, DC table, AC table
        self.data = b""
        self.dc_step: dict[int, int] = {}
        self.tables: dict[int, tuple[bytes, bytes]] = {}


def read_markers(media: bytes) -> list[_Frame]:
    """The images of a stream; ValueError if it isn't baseline JPEG."""
    found, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        f, at = _Frame(), at + 2
        while True:
            if at + 4 > len(media) and media[at : at + 2] != b"\xff\xd9" or media[at] != 0xFF:
                raise ValueError("broken marker")
            kind, at = media[at + 1], at + 2
            if kind == 0xD9:
                break
            if kind == 0xFF:
                at -= 1
                continue
            n = int.from_bytes(media[at : at + 2], "big")
            b, at = media[at + 2 : at + n], at + n
            if kind == 0xDB:
                while b:
                    wide = b[0] >> 4
                    f.dc_step[b[0] & 15] = int.from_bytes(b[1 : 2 + wide], "big")
                    b = b[1 + 64 * (1 + wide) :]
            elif kind == 0xC0:
                f.height, f.width = int.from_bytes(b[1:3], "big"), int.from_bytes(b[3:5], "big")
                f.parts = [(b[6 + 3 * i], b[7 + 3 * i] >> 4, b[7 + 3 * i] & 15, b[8 + 3 * i]) for i in range(b[5])]
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif kind == 0xC4:
                while b:
                    m = sum(b[1:17])
                    f.tables[b[0]], b = (b[1:17], b[17 : 17 + m]), b[17 + m :]
            elif kind == 0xDD:
                f.interval = int.from_bytes(b, "big")
            elif kind == 0xDA:
                ids = {p[0]: i for i, p in enumerate(f.parts)}
                scan = [(ids[b[1 + 2 * i]], b[2 + 2 * i] >> 4, b[2 + 2 * i] & 15) for i in range(b[0])]
                end = _SCAN_END.search(media, at)
                stop = end.start() if end else len(media)
                if any(p == 0 for p, _, _ in scan):  # the scan that holds luminance
                    f.scan, f.data = scan, media[at:stop]
                at = stop
        if not f.scan:
            raise ValueError("no scan")
        found.append(f)
    return found


def _planned(f: _Frame) -> tuple[list[bytes], list[int], list[int], list[tuple[bytes, bytes]], list[tuple[bytes, bytes]], int]:
    """Of an image: its restart intervals, blocks in each, which blocks of a unit are luminance, each block's tables."""
    alone = len(f.scan) == 1
    hs, vs = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    if alone:
        _, h, v, _ = f.parts[0]
        units = -(-(-(-f.width * h // hs)) // 8) * -(-(-(-f.height * v // vs)) // 8)
        layout = [f.scan[0]]
    else:
        units = -(-f.width // (8 * hs)) * -(-f.height // (8 * vs))
        layout = [s for s in f.scan for _ in range(f.parts[s[0]][1] * f.parts[s[0]][2])]
    segments = [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(f.data)]
    each = f.interval or units
    blocks = [len(layout) * min(each, units - i * each) for i in range(-(-units // each))]
    if len(segments) < len(blocks):
        raise ValueError("restart intervals are missing")
    return segments[: len(blocks)], blocks, [p for p, _, _ in layout], [f.tables[d] for _, d, _ in layout], [f.tables[16 + a] for _, _, a in layout], units


def _decode(frames: list[_Frame]) -> list[np.ndarray]:
    """Quantised luminance DC values of each image, in the order of its blocks."""
    tables: dict[tuple[bytes, bytes], int] = {}
    segs: list[bytes] = []
    todo: list[int] = []
    owner: list[int] = []
    layouts, layout_of = {}, []
    for k, f in enumerate(frames):
        s, b, lum, dc, ac, _ = _planned(f)
        key = (tuple(lum), tuple(tables.setdefault(t, len(tables)) for t in dc), tuple(tables.setdefault(t, len(tables)) for t in ac))
        layout_of.append(layouts.setdefault(key, len(layouts)))
        segs += s
        todo += b
        owner += [k] * len(s)
    names = list(tables)
    size, sym = (np.concatenate(x) for x in zip(*(_codes(*t) for t in names), strict=True))
    widest = max(len(x[0]) for x in layouts)
    lum, dct, act = (np.array([list(x[i]) + [0] * (widest - len(x[i])) for x in layouts], np.int64) for i in range(3))
    pairs = {p: i for i, p in enumerate(sorted({(d, a) for _, dc, ac in layouts for d, a in zip(dc, ac, strict=True)}))}
    whole = np.concatenate([_flat_blocks(*names[d], *names[a]) for d, a in pairs])
    pair = np.array([[pairs[d, a] for d, a in zip(x[1], x[2], strict=True)] + [0] * (widest - len(x[1])) for x in layouts], np.int64)
    length = np.array([len(x[0]) for x in layouts], np.int64)
    buf = np.frombuffer(b"".join(x + b"\xff" * 8 for x in segs), np.uint8)
    lens = np.array([len(x) for x in segs], np.int64)
    start = np.concatenate([[0], np.cumsum(lens + 8)[:-1]])
    todo_a = np.array(todo, np.int64)
    base = np.concatenate([[0], np.cumsum(todo_a)[:-1]])
    value, is_lum = np.zeros(int(todo_a.sum()), np.int64), np.zeros(int(todo_a.sum()), bool)
    wide = buf.astype(np.int64)
    word = (wide[:-4] << 32) | (wide[1:-3] << 24) | (wide[2:-2] << 16) | (wide[3:-1] << 8) | wide[4:]
    own = np.flatnonzero(todo_a > 0)
    bit, limit, y, left, spot = start[own] * 8, (start + lens)[own] * 8, np.array(layout_of, np.int64)[owner][own], todo_a[own], base[own]
    turn, k, pred = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros((len(own), 1 + int(lum.max())), np.int64)
    every, inside = np.arange(len(own)), 0
    while len(own):
        if (bit > limit).any():
            raise ValueError("scan data end early")
        peek = word[bit >> 3]
        ahead = (peek >> (24 - (bit & 7))) & 0xFFFF
        if not inside and (got := whole[(pair[y, turn] << 16) | ahead]).min() > 0:
            # every interval is at a block of no AC terms that fits a look-up: take the whole block
            bit = bit + (got & 31)
            diff, over, dc = (got >> 5) - 4096, None, every
        else:
            dc = k == 0
            slot = (np.where(dc, dct[y, turn], act[y, turn]) << 16) | ahead
            n, s = size[slot], sym[slot]
            if (n == 0).any():
                raise ValueError("no such code")
            extra = np.where(dc, s, s & 15)
            have = (peek >> np.maximum(40 - (bit & 7) - n - extra, 0)) & ((1 << extra) - 1)
            bit = bit + n + extra
            dc = np.flatnonzero(dc)
            diff = (np.where(have < (1 << np.maximum(extra - 1, 0)), have - (1 << extra) + 1, have) * (extra > 0))[dc]
            run = s >> 4
            k = np.where(k == 0, 1, np.where(extra == 0, np.where(run == 15, k + 16, 64), k + run + 1))
            over = k >= 64
            k = np.where(over, 0, k)
            inside = np.count_nonzero(k)
        part = lum[y[dc], turn[dc]]
        now = pred[dc, part] + diff
        pred[dc, part] = now
        value[spot[dc]], is_lum[spot[dc]] = now, part == 0
        over = 1 if over is None else over
        left, spot = left - over, spot + over
        if widest > 1:
            turn = (turn + over) % length[y]
        if not left.all():
            keep = np.flatnonzero(left)
            own, bit, limit, y, left, spot, turn, k, pred = (x[keep] for x in (own, bit, limit, y, left, spot, turn, k, pred))
            every = every[: len(own)]
    out, i, where = [], 0, np.array(owner)
    many = np.bincount(where, weights=todo_a, minlength=len(frames)).astype(np.int64)
    for m in many:
        out.append(value[i : i + m][is_lum[i : i + m]])
        i += int(m)
    return out


def thumbnails(frames: list[_Frame]) -> list[np.ndarray]:
    """Luminance at an eighth of the size, as uint8 planes: each block's mean from its DC term alone."""
    planes = []
    for f, dc in zip(frames, _decode(frames), strict=True):
        _, h, v, q = f.parts[0]
        hs, vs = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
        wide, high = -(-(-(-f.width * h // hs)) // 8), -(-(-(-f.height * v // vs)) // 8)
        px = np.clip(np.floor(dc * f.dc_step[q] / 8 + 128.5), 0, 255).astype(np.uint8)
        if len(f.scan) == 1:
            plane = px.reshape(high, wide)
        else:
            across, down = -(-f.width // (8 * hs)), -(-f.height // (8 * vs))
            plane = px.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)[:high, :wide]
        planes.append(plane)
    return planes


def mean_hash(plane: np.ndarray) -> str:
    """64 bits in hex: which cells of an 8x8 area mean lie above the whole's mean."""
    rows, cols = (np.arange(8) * n // 8 for n in plane.shape)
    cells = np.add.reduceat(np.add.reduceat(plane.astype(np.int64), rows, 0), cols, 1)
    high, wide = (np.maximum(np.diff(np.append(r, n)), 1) for r, n in zip((rows, cols), plane.shape, strict=True))
    mean = cells / (high[:, None] * wide)
    return np.packbits(mean > mean.mean()).tobytes().hex()


def padded(text: str | None) -> bytes:
    """UTF-8 (null: empty) with bytes 0 up to a positive multiple of 64."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + b"\0" * (-len(b) % COLS if b else COLS)


def _pieces(sizes: list[int], most: int) -> Iterator[slice]:
    i = total = 0
    for j, n in enumerate(sizes):
        if j > i and total + n > most:
            yield slice(i, j)
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield slice(i, len(sizes))


def encode(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's bytes as JPEG. Null and empty texts become one row of zero blocks.

    Rows stay apart whatever their ids; other columns are left out. A very long text becomes several images.
    """

    def run(batches):
        for b in batches:
            texts = [padded(x) for x in b.column("text").to_pylist()]
            ids = b.column("doc_id")
            sizes = b.column("n_bytes")
            for part in _pieces([len(x) for x in texts], 2 * CHUNK):
                yield pa.RecordBatch.from_arrays([ids[part], sizes[part], pa.array(write_media(texts[part]), pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "cast(coalesce(octet_length(text), 0) as bigint) as n_bytes", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Read stored images back: dimensions, thumbnail hashes and digests of what the thumbnails hold.

    Adds to ``doc_id, n_bytes``: ``payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width,
    height, n_images``. A null or broken image gives nulls and the feature ``broken``.
    """

    def row(blob, planes, frames):
        payload = b"".join(p.tobytes() for p in planes)
        feature = ",".join(f"{f.width}x{f.height}:{mean_hash(p)}" for f, p in zip(frames, planes, strict=True))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, frames[0].width, sum(f.height for f in frames), len(frames)

    def broken(blob):
        return None, None, None, None if blob is None else len(blob), None if blob is None else hashlib.sha256(blob).hexdigest(), "broken", None, None, None

    def read(blobs):
        try:
            frames = [read_markers(b) for b in blobs]
            each = [f for x in frames for f in x]  # a long text's images are not decoded all at once
            planes = (p for part in _pieces([len(f.data) for f in each], 2 * CHUNK) for p in thumbnails(each[part]))
            return [row(b, [next(planes) for _ in x], x) if x else broken(b) for b, x in zip(blobs, frames, strict=True)]
        except (ValueError, IndexError, KeyError, TypeError):
            if len(blobs) == 1:
                return [broken(blobs[0])]
            return [x for b in blobs for x in read([b])]

    def run(batches):
        for b in batches:
            blobs = b.column("media").to_pylist()
            for part in _pieces([len(x or b"") for x in blobs], 2 * CHUNK):
                cols = list(zip(*read(blobs[part]), strict=True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[part], b.column("n_bytes")[part], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "n_images"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    kind = media.schema["doc_id"].dataType.simpleString()
    said = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, kinds, strict=True))
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, {said}")
