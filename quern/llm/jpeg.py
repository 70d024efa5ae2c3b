"""Operator 7, media columns of baseline JPEG with DC-only thumbnails in numpy.

Reading: markers are parsed, scans Huffman-decoded as far as the DC coefficients need, and the
luminance DC values give a thumbnail of one pixel per 8 x 8 block. All restart intervals of all
images with the same coding are decoded side by side, one table lookup a step for each.

Writing: bytes become the luminance of flat blocks. With a DC quantiser of 8 the DC coefficient of
a block is its sample less 128, so a thumbnail gives the bytes back exactly, though JPEG as such
loses detail. Every image is `WIDE` blocks wide and at most 8184 high, which the format's 16-bit
sizes set; longer payloads go on in further images. Media are stored in a table and read from there.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, staged, table, texts_of

UNIT = 576
#: Blocks a row, and the most rows of an image.
WIDE, ROWS = 24, 8184
INTERVAL = 96
#: Bytes of texts, or of media, handled at once.
BATCH = 3 << 20
#: Huffman codes as (counts by length 1-16, symbols). DC: sizes of differences, the common ones short;
#: AC: only end-of-block and a filler, since blocks are flat.
DC_CODE = ((0, 1, 4, 2, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (4, 3, 5, 2, 6, 7, 1, 0, 8))
AC_CODE = ((1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0, 240))


def _codes(spec) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(spec[0], 1):
        for _ in range(n):
            out[spec[1][at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((255, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _dc_table() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of every difference from -255 to 255, with its end-of-block."""
    dc, (eob, eob_n) = _codes(DC_CODE), _codes(AC_CODE)[0]
    code, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = dc[size]
        code[d + 255] = ((c << size | (d if d >= 0 else d + (1 << size) - 1)) << eob_n) | eob
        length[d + 255] = n + size + eob_n
    return code, length


_DC, _DC_LENGTH = _dc_table()


def _image(samples: np.ndarray, wide: int) -> bytes:
    """One JPEG of the samples, `wide` blocks a row."""
    high = len(samples) // wide
    values = samples.astype(np.int64) - 128
    before = np.concatenate([[0], values[:-1]])
    before[::INTERVAL] = 0
    d = values - before + 255
    code, length = _DC[d], _DC_LENGTH[d]
    starts = np.arange(0, len(d), INTERVAL)
    bits = np.add.reduceat(length, starts)
    size = (bits + 7) // 8
    at = np.cumsum(length) - length
    at += np.repeat(np.cumsum(size) * 8 - size * 8 - (np.cumsum(bits) - bits), np.diff(np.append(starts, len(d))))
    # Each code fits in the 4 bytes from where it starts; no bit is set twice, so sums are unions.
    word = code << (32 - length - (at & 7)).astype(np.uint64)
    flow = np.zeros(int(size.sum()) + 4)
    for k in range(4):
        flow += np.bincount((at >> 3) + k, weights=(word >> np.uint64(24 - 8 * k) & np.uint64(255)).astype(np.float64), minlength=len(flow))
    flow = flow[:-4].astype(np.uint8)
    ends = np.cumsum(size)
    flow[ends - 1] |= ((1 << (size * 8 - bits)) - 1).astype(np.uint8)
    stuff = np.flatnonzero(flow == 255)
    marks = np.stack([np.full(len(ends) - 1, 255), 208 + np.arange(len(ends) - 1) % 8], 1).ravel()
    places = np.concatenate([stuff + 1, np.repeat(ends[:-1], 2)])
    order = np.argsort(places, kind="stable")
    scan = np.insert(flow, places[order], np.concatenate([np.zeros(len(stuff), np.int64), marks])[order])
    table = lambda kind, spec: bytes((kind,)) + bytes(spec[0]) + bytes(spec[1])
    head = b"\xff\xd8" + _segment(0xDB, bytes((0, 8)) + bytes([1] * 63))
    head += _segment(0xC0, b"\x08" + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00")
    head += _segment(0xC4, table(0x00, DC_CODE) + table(0x10, AC_CODE)) + _segment(0xDD, INTERVAL.to_bytes(2, "big"))
    return head + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan.tobytes() + b"\xff\xd9"


def encode(payload: bytes) -> bytes:
    """A stream of JPEGs whose thumbnails hold the payload, a positive multiple of UNIT bytes."""
    step, data = WIDE * ROWS, np.frombuffer(payload, np.uint8)
    return b"".join(_image(data[i : i + step], WIDE) for i in range(0, len(data), step))


class Header:
    """Markers of one image: its size, tables, and the entropy-coded bytes, by restart interval, of the
    scan that holds its first component, the luminance. Other scans are passed over."""

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        self.quant, self.tables, self.interval, self.parts, self.coding = {}, {}, 0, [], None
        while True:
            if data[at] != 255:
                raise ValueError(f"no marker at {at}")
            marker = data[at + 1]
            if marker == 0xD9:
                if self.coding is None:
                    raise ValueError("no scan of the luminance")
                self.end = at + 2
                return
            n = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    self.quant[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")  # the DC entry
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    total = sum(body[1:17])
                    self.tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + total]))
                    body = body[17 + total :]
            elif marker in (0xC0, 0xC1):
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif marker == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("not a baseline image")
            elif marker == 0xDA:
                coding = tuple((body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0]))
                stop = at
                while data[(stop := data.index(b"\xff", stop)) + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                    stop += 2
                if self.parts[0][0] in (name for name, _ in coding) and self.coding is None:
                    self.coding, self.step, self.codes = coding, self.interval, dict(self.tables)
                    self._scan(data, at, stop)
                at = stop

    def _scan(self, data: bytes, at: int, stop: int) -> None:
        raw = np.frombuffer(data, np.uint8, stop - at, at)
        after = np.flatnonzero(raw[:-1] == 255) + 1 if len(raw) else np.zeros(0, np.int64)
        after = after[raw[after] != 255]
        mark = after[raw[after] >= 0xD0]
        keep = np.ones(len(raw), bool)
        keep[after] = False
        keep[mark - 1] = False
        self.flow = raw[keep]
        cuts = (np.cumsum(keep)[mark] if len(mark) else np.zeros(0, np.int64)).tolist()
        self.starts = np.array([0, *cuts])

    def layout(self) -> tuple:
        """What must agree for images to be decoded side by side."""
        return (self.coding, tuple(c[:3] for c in self.parts), tuple(sorted(self.codes.items())))


def _lookup(spec) -> np.ndarray:
    """By 16 bits ahead: code length << 8 | symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in _codes(spec).items():
        out[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return out


def thumbnails(stream: list[Header]) -> list[np.ndarray]:
    """The luminance DC thumbnail of each image, uint8 of (blocks down, blocks across)."""
    out: list = [None] * len(stream)
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(stream):
        groups.setdefault(h.layout(), []).append(i)
    for members in groups.values():
        _decode([stream[i] for i in members], out, members)
    return out


def _decode(images: list[Header], out: list, where: list[int]) -> None:
    one = images[0]
    single = len(one.coding) == 1  # such a scan has the component's own blocks, row by row
    tables = {k: _lookup(v) for k, v in one.codes.items()}
    order = {p[0]: p for p in one.parts}
    luminance = one.parts[0][0]
    blocks = []  # of an MCU: (component, DC table, AC table, place down, place across)
    for c, (name, coding) in enumerate(one.coding):
        _, across, down, _ = order[name]
        for y in range(1 if single else down):
            for x in range(1 if single else across):
                blocks.append((c, name == luminance, tables[coding >> 4], tables[16 + (coding & 15)], y, x))
    most_x, most_y = max(p[1] for p in one.parts), max(p[2] for p in one.parts)
    own_x, own_y = order[luminance][1], order[luminance][2]
    lum_x, lum_y = (1, 1) if single else (own_x, own_y)
    size = [(-(-h.height * own_y // (8 * most_y)), -(-h.width * own_x // (8 * most_x))) for h in images]  # luminance blocks
    grid = [(-(-down // lum_y), -(-across // lum_x)) for down, across in size]
    # A lane is a restart interval: its first bit, its number of MCUs, and where its samples go.
    flow = np.concatenate([*(np.concatenate([h.flow, np.full(8, 255, np.uint8)]) for h in images)])
    base, bit, count, first, total = 0, [], [], [], 0
    for h, (rows, cols) in zip(images, grid, strict=True):
        n = rows * cols
        step = h.step or n
        k = -(-n // step)
        if len(h.starts) != k:
            raise ValueError("restart markers do not agree with the size")
        bit.append((h.starts + base) * 8)
        count.append(np.minimum(step, n - np.arange(k) * step))
        first.append(total + np.arange(k) * step)
        base, total = base + len(h.flow) + 8, total + n
    bit, count, first = np.concatenate(bit), np.concatenate(count), np.concatenate(first)
    ahead = np.zeros(len(flow), np.uint32)  # the 32 bits from each byte on: enough for 7 of that byte and a code or a difference
    for k in range(4):
        ahead[:-3] |= flow[k : len(flow) - 3 + k].astype(np.uint32) << np.uint32(24 - 8 * k)
    last = np.zeros((len(one.coding), len(bit)), np.int64)
    dc = np.zeros((total, lum_y, lum_x), np.int16)
    by_size = np.argsort(-count, kind="stable")
    bit, count, first = bit[by_size], count[by_size], first[by_size]
    for mcu in range(int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -mcu))  # lanes with more MCUs come first
        b = bit[:live]
        for c, bright, dc_of, ac_of, y, x in blocks:
            b, bits = _symbol(ahead, b, dc_of)
            value = (ahead[b >> 3].astype(np.int64) >> (32 - (b & 7) - bits)) & ((1 << bits) - 1)
            b = b + bits
            last[c, :live] += np.where((bits > 0) & (value < (1 << np.maximum(bits - 1, 0))), value - (1 << bits) + 1, value)
            if bright:
                dc[first[:live] + mcu, y, x] = last[c, :live]
            b, symbol = _symbol(ahead, b, ac_of)
            busy = np.flatnonzero(symbol)
            if len(busy):
                b, k = b.copy(), np.zeros(len(symbol), np.int64)
                while len(busy):
                    s = symbol[busy]
                    b[busy] += s & 15
                    k[busy] += (s >> 4) + 1
                    busy = busy[k[busy] < 63]
                    b[busy], symbol[busy] = _symbol(ahead, b[busy], ac_of)
                    busy = busy[symbol[busy] != 0]
        bit[:live] = b
    at = 0
    for h, (rows, cols), (down, across), i in zip(images, grid, size, where, strict=True):
        quant = h.quant[order[luminance][3]]
        pixels = dc[at : at + rows * cols].astype(np.int32).reshape(rows, cols, lum_y, lum_x).transpose(0, 2, 1, 3).reshape(rows * lum_y, cols * lum_x)
        at += rows * cols
        out[i] = np.clip(np.floor(pixels[:down, :across] * quant / 8 + 128.5), 0, 255).astype(np.uint8)


def _symbol(ahead: np.ndarray, bit: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got = lookup[(ahead[np.minimum(bit >> 3, len(ahead) - 1)].astype(np.int64) >> (16 - (bit & 7))) & 0xFFFF]
    if len(got) and not got.all():
        raise ValueError("bits that are no Huffman code")
    return bit + (got >> 8), (got & 255).astype(np.int64)


def headers(media: bytes) -> list[Header]:
    """Every image of a stream; ValueError for what is no whole stream of baseline images."""
    found, at = [], 0
    try:
        while at < len(media):
            found.append(Header(media, at))
            at = found[-1].end
    except IndexError as e:
        raise ValueError("the image ends too soon") from e
    return found


def decoded(stored: list[bytes | None]) -> list[tuple[list[Header], list[np.ndarray]] | None]:
    """Headers and thumbnails of each stream; None for null and for what is no whole stream of baseline images."""
    parsed: list = []
    for m in stored:
        try:
            parsed.append(headers(m) if m else None)
        except (ValueError, KeyError):
            parsed.append(None)
    try:
        pixels = iter(thumbnails([h for hs in parsed for h in hs or ()]))
        return [hs and (hs, [next(pixels) for _ in hs]) for hs in parsed]
    except (ValueError, KeyError, IndexError):  # a damaged scan: one by one, to tell which
        return [None] if len(stored) == 1 else [decoded([m])[0] for m in stored]


def thumbnail_hash(pixels: np.ndarray) -> str:
    """A 64-bit difference hash in hex: means over 8 x 9 cells, each against its right neighbour."""
    rows = np.array_split(pixels.astype(np.float64), min(8, len(pixels)), axis=0)
    cells = np.array([[c.mean() for c in np.array_split(r.mean(0), min(9, r.shape[1]))] for r in rows])
    bits = np.zeros((8, 8), np.uint8)
    more = cells[:, 1:] > cells[:, :-1]
    bits[: more.shape[0], : more.shape[1]] = more
    return np.packbits(bits).tobytes().hex()


def payload_of(text: str) -> tuple[int, bytes]:
    """UTF-8 bytes of a text, and those padded with 255 to a positive multiple of UNIT."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def write_media(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Stores (doc_id, n_bytes, media), each text as a stream of JPEGs, as a table at `path` or in the
    shared folder without one, and reads it again. Null is the empty text."""
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        def step(batch):
            got = [payload_of(t) for t in texts_of(batch)]
            return {"doc_id": batch.column("doc_id"), "n_bytes": [n for n, _ in got], "media": [encode(p) for _, p in got]}

        return step

    return staged(map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, n_bytes long, media binary", "text", make, BATCH), "media", path)


def media_features(media: DataFrame) -> DataFrame:
    """What stored images hold: payload digests, and dimensions with thumbnail hashes as `feature`.

    Null for media that is null, empty, or no whole stream of baseline images.
    """
    kind = dict(media.dtypes)["doc_id"]

    def make():
        def step(batch):
            stored = batch.column("media").to_pylist()
            read = decoded(stored)
            payload = [r and b"".join(p.tobytes() for p in r[1]) for r in read]
            of = lambda f, xs: [None if x is None else f(x) for x in xs]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return {
                "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "payload_bytes": of(len, payload), "payload_sha256": of(sha, payload),
                "tail_crc32": of(lambda p: zlib.crc32(p[-32:]), payload), "media_bytes": of(len, stored), "media_sha256": of(sha, stored),
                "feature": of(lambda r: ";".join(f"{h.width}x{h.height}:{thumbnail_hash(p)}" for h, p in zip(*r, strict=True)), read),
            }

        return step

    return map_batches(media.select("doc_id", "n_bytes", "media"), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", "media", make, BATCH)


def op7_jpeg_media(spark: SparkSession, sf_dir: str, out: str | None = None) -> DataFrame:
    """Repeated rows each return a row; an empty table returns none; extra columns are left out. `out` keeps the media there."""
    return media_features(write_media(table(spark, sf_dir, "documents"), out))
