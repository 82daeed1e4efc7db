"""Media columns as progressive JPEG: payload bytes as DCT coefficients, decoded to RGB tensors.

The format's lossless unit is the coefficient, so a payload is stored as the coefficients (byte
less 128, in zigzag order) of a three-component image with chroma at half resolution and a
quantiser of ones. The encoder writes spectral-selection and successive-approximation scans with
restart markers. The decoder reads any such baseline-precision progressive file: it accumulates
the scans into coefficient arrays, decoding the restart segments of a whole batch of files side by
side, then transforms the blocks back in numpy, upsamples chroma and converts to RGB.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField

from .common import map_beside, text_of

UNIT, FILL, BATCH_BYTES = 576, 255, 2 << 20
MCU, MOST_ACROSS = 6, 4095  # four luma blocks and two of chroma; MCUs in a row of an image

ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def code_lengths(common: dict[int, int], rest: list[int], length: int) -> dict[int, int]:
    return common | {s: length for s in rest if s not in common}


#: Code lengths of the three Huffman tables that the encoder writes.
DC_LENGTHS = {s: 4 for s in range(12)}
AC_LENGTHS = code_lengths({s: 3 for s in range(1, 7)} | {7: 4, 0x00: 5, 0xF0: 8}, [r << 4 | s for r in range(16) for s in range(1, 8)], 10)
REFINE_LENGTHS = {0x00: 1, 0xF0: 6} | {r << 4 | 1: 6 for r in range(16)}
#: The scans: components, first and last coefficient, high and low bit, table.
SCANS = [((0, 1, 2), 0, 0, 0, 1), *(((c,), a, b, 0, 1) for a, b in ((1, 5), (6, 63)) for c in range(3)),
         *(((c,), 1, 63, 1, 0) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0)]


def canonical(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """The counts and symbols of a DHT segment, and (code, length) of each symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, last, codes = 0, 0, {}
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = code, last
        code += 1
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), bytes(order), codes


def _table(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in canonical(lengths)[2].items():
        codes[s], sizes[s] = c, n
    return codes, sizes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, lengths: dict[int, int]) -> bytes:
    counts, symbols, _ = canonical(lengths)
    return bytes([kind]) + counts + symbols


_SIZES = np.array([i.bit_length() for i in range(1 << 12)])  # differences of 11-bit coefficients fit


def _bits(value: np.ndarray) -> np.ndarray:
    """The number of bits of non-negative numbers."""
    return _SIZES[value]


def _pack(value: np.ndarray, bits: np.ndarray, segment: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of items in order, each of n segments padded with ones, and the segments' sizes."""
    total = np.bincount(segment, bits, n).astype(np.int64)
    size = (total + 7) // 8
    end = np.cumsum(size)
    if not len(value):
        return np.zeros(0, np.uint8), size
    ahead = np.cumsum(bits) - bits
    first = np.concatenate([[0], np.cumsum(total)[:-1]])
    at = ahead + ((end - size) * 8 - first)[segment]
    # items in a row share 32-bit words: each word is the sum of what they put into it
    word = at >> 5
    wide = value.astype(np.uint64) << (64 - bits - (at & 31)).astype(np.uint64)
    cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    own = word[cut]
    out = np.zeros(int(end[-1]) // 4 + 3, np.uint64)
    out[own] += np.add.reduceat(wide >> np.uint64(32), cut)
    out[own + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), cut)
    data = out.astype(">u4").view(np.uint8)[:int(end[-1])]
    pad = size * 8 - total
    some = size > 0
    data[end[some] - 1] += ((1 << pad[some]) - 1).astype(np.uint8)
    return data, size


def _both(fast: np.ndarray, rows: np.ndarray, slow: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Segments of equal size (``rows``, where ``fast`` is true) and the other ones, in order."""
    if slow is None:
        return rows.ravel(), np.full(len(fast), rows.shape[1])
    data, some = slow
    size = np.full(len(fast), rows.shape[1])
    size[~fast] = some
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[(start[fast][:, None] + np.arange(rows.shape[1])).ravel()] = rows.ravel()
    out[np.arange(len(data)) + np.repeat(start[~fast] - (np.cumsum(some) - some), some)] = data
    return out, size


def _mark(data: np.ndarray, size: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded data with 255 stuffed, and the end of each segment in it.

    All segments but the ``last`` of a file end in the restart marker of their ``number``.
    """
    end = np.cumsum(size)
    extra = (data == 255).astype(np.int64)
    stuffed = np.flatnonzero(extra)
    tail = end - 1
    high = data[tail] == 255
    marked = ~last
    extra[tail[marked]] += 2
    place = np.arange(len(data)) + np.cumsum(extra) - extra
    out = np.zeros(len(data) + int(extra.sum()), np.uint8)
    out[place] = data
    mark = place[tail[marked]] + high[marked] + 1
    out[mark], out[mark + 1] = 255, 0xD0 + number[marked] % 8
    return out, place[tail] + 1 + extra[tail]


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _first_items(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, bits, block) of a first scan of a band, in order."""
    codes, lens = _table(AC_LENGTHS)
    width = band.shape[1]
    mag = np.abs(band) >> low
    b, k = np.nonzero(mag)
    v = np.where(band[b, k] < 0, -mag[b, k], mag[b, k])
    first = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
    run = np.where(first, k, k - np.concatenate([[0], k[:-1]]) - 1) if len(b) else k
    size = _bits(np.abs(v))
    symbol = (run % 16) << 4 | size
    final = np.full(len(band), -1)
    final[b] = k  # the greatest of a block comes last
    ended = np.flatnonzero(final < width - 1)
    far = run >= 16
    z = np.repeat(np.flatnonzero(far), run[far] // 16)
    value = np.concatenate([codes[symbol] << size | _extra(v, size), np.full(len(z), codes[0xF0]), np.full(len(ended), codes[0])])
    bits = np.concatenate([lens[symbol] + size, np.full(len(z), lens[0xF0]), np.full(len(ended), lens[0])])
    seg = np.concatenate([b, b[z], ended])
    o = np.lexsort((np.concatenate([k * 2 + 1, k[z] * 2, np.full(len(ended), 2 * width)]), seg))
    return value[o], bits[o], seg[o]


def _refine_items(band: np.ndarray, high: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, bits, block) of a refinement scan of a band, in order.

    A correction bit for each old coefficient, and symbols in front of the coefficients they pass.
    """
    codes, lens = _table(REFINE_LENGTHS)
    mag, width = np.abs(band), band.shape[1]
    old, new = mag >> high > 0, (mag >> low) == 1
    nb, nk = np.nonzero(new)
    zeros = np.cumsum(~old & ~new, axis=1)
    run, prev = zeros[nb, nk], np.zeros(len(nk), np.int64)
    if len(nb):
        same = np.concatenate([[False], nb[1:] == nb[:-1]])
        run = run - np.where(same, np.concatenate([[0], zeros[nb, nk][:-1]]), 0)
        prev = np.where(same, np.concatenate([[0], nk[:-1] + 1]), 0)
    if (run >= 16).any():
        return _refine_slowly(band, old, new, low, codes, lens)
    ob, ok = np.nonzero(old)
    final = np.full(len(band), -1)
    final[nb] = nk
    tail = np.flatnonzero(final < width - 1)
    symbol = run << 4 | 1
    value = np.concatenate([codes[symbol] << 1 | (band[nb, nk] > 0), mag[ob, ok] >> low & 1, np.full(len(tail), codes[0])])
    bits = np.concatenate([lens[symbol] + 1, np.ones(len(ob), np.int64), np.full(len(tail), lens[0])])
    seg = np.concatenate([nb, ob, tail])
    o = np.argsort(seg * 256 + np.concatenate([prev * 2, ok * 2 + 1, (final[tail] + 1) * 2]), kind="stable")
    return value[o], bits[o], seg[o]


@lru_cache(8)
def _plain_codes(low: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and extra bits, and their number, of each coefficient from -128 that follows no zero."""
    codes, lens = _table(AC_LENGTHS)
    c = np.arange(-128, 128)
    v = np.where(c < 0, -(-c >> low), c >> low)
    size = _bits(np.abs(v))
    return codes[size] << size | _extra(v, size), lens[size] + size


def _encode_scan(blocks: list[np.ndarray], scan, units: int) -> list[bytes]:
    """One scan of many files. blocks: each file's blocks in the scan's order; units: blocks in a segment."""
    _, lo, hi, high, low = scan
    counts = np.array([len(b) for b in blocks]) // units
    c = np.concatenate(blocks)
    number = np.arange(len(c) // units) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.zeros(len(number), bool)
    last[np.cumsum(counts) - 1] = True
    if lo == 0 and high == 0:
        v = (c[:, 0] >> low).reshape(-1, units)
        before = np.zeros_like(v)
        before[:, 1:4] = v[:, :3]  # the prediction is the component's own: luma has four blocks in a row
        d = (v - before).ravel()
        size = _bits(np.abs(d))
        codes, lens = _table(DC_LENGTHS)
        data, sizes = _pack(codes[size] << size | _extra(d, size), lens[size] + size, np.arange(len(d)) // units, len(number))
    elif lo == 0:
        rows = np.ones((len(number), 8), np.uint8)
        rows[:, :units] = (c[:, 0] >> low & 1).reshape(-1, units)
        data, sizes = np.packbits(rows, axis=1).ravel(), np.ones(len(number), np.int64)
    else:
        band = c[:, lo:hi + 1]
        fast = (np.abs(band) >> max(low, high)).all(axis=1)  # blocks without zeros need no runs
        most, slow = band[fast], band[~fast]
        if high == 0:
            codes, bits = _plain_codes(low)
            at = most.ravel() + 128
            quick = codes[at], bits[at], np.repeat(np.flatnonzero(fast), band.shape[1])
            if len(slow):
                other = _first_items(slow, low)
                value, bits, seg = (np.concatenate(x) for x in zip(quick, (*other[:2], np.flatnonzero(~fast)[other[2]])))
                o = np.argsort(seg, kind="stable")
                quick = value[o], bits[o], seg[o]
            data, sizes = _pack(*quick, len(number))
        else:  # the code of the band's end, one zero bit, and a correction for each coefficient
            rows = np.zeros((len(most), 64), np.uint8)
            rows[:, 1:] = np.abs(most) >> low & 1
            data, sizes = _both(fast, np.packbits(rows, axis=1), _pack(*_refine_items(slow, high, low), len(slow)) if len(slow) else None)
    out, end = _mark(data, sizes, last, number)
    stop = end[np.flatnonzero(last)].tolist()
    return [out[a:b].tobytes() for a, b in zip([0, *stop], stop)]


def _refine_slowly(band, old, new, low, codes, lens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The items block by block, for blocks with sixteen zeros before a new coefficient."""
    value, bits, seg = [], [], []

    def put(v, n, i):
        value.append(int(v))
        bits.append(int(n))
        seg.append(i)

    for i, row in enumerate(band.tolist()):
        run, held = 0, []
        stop = int(np.flatnonzero(new[i])[-1]) if new[i].any() else -1
        for k, v in enumerate(row):
            if old[i, k]:
                held.append(abs(v) >> low & 1)
                continue
            if new[i, k]:
                s = run << 4 | 1
                put(codes[s] << 1 | (v > 0), lens[s] + 1, i)
            elif k < stop and run == 15:
                put(codes[0xF0], lens[0xF0], i)
            else:
                run += 1
                continue
            for b in held:
                put(b, 1, i)
            run, held = 0, []
        if stop < len(row) - 1:
            put(codes[0], lens[0], i)
        for b in held:
            put(b, 1, i)
    return np.array(value), np.array(bits), np.array(seg)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file of each payload (any bytes, of positive length)."""
    shapes, parts = [], []
    for p in payloads:
        mcus = -(-len(p) // (64 * MCU))
        across = min(mcus, MOST_ACROSS)
        down = -(-mcus // across)
        data = np.full(across * down * MCU * 64, FILL, np.int32)
        data[:len(p)] = np.frombuffer(p, np.uint8)
        c = (data - 128).reshape(down, across, MCU, 64)
        luma = c[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
        shapes.append((across, down))
        parts.append([luma, c[:, :, 4].reshape(-1, 64), c[:, :, 5].reshape(-1, 64), c.reshape(-1, 64)])
    scans = [_encode_scan([p[3 if len(s[0]) > 1 else s[0][0]] for p in parts], s, MCU if len(s[0]) > 1 else 1) for s in SCANS]
    tables = _segment(0xC4, _huffman(0x00, DC_LENGTHS) + _huffman(0x10, AC_LENGTHS) + _huffman(0x11, REFINE_LENGTHS))
    quant = _segment(0xDB, b"\0" + b"\1" * 64)
    heads = [_segment(0xDA, bytes([len(cs), *(x for i in cs for x in (i + 1, 0x01 if h else 0x00)), a, b, h << 4 | k])) for cs, a, b, h, k in SCANS]
    restart = _segment(0xDD, b"\0\1")
    out = []
    for i, (p, (across, down)) in enumerate(zip(payloads, shapes)):
        frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        out.append(b"".join([b"\xff\xd8", _segment(0xFE, b"payload %d" % len(p)), quant, _segment(0xC2, frame), tables, restart,
                             *(x for h, s in zip(heads, scans) for x in (h, s[i])), b"\xff\xd9"]))
    return out


class Frame:
    """A parsed file: its components and scans, and the coefficients read so far."""

    def __init__(self, data: bytes):
        self.scans, self.comment, self.quant, self.comps = [], b"", {}, []
        tables: dict[int, tuple[bytes, bytes]] = {}
        interval, at = 0, 2
        buf = np.frombuffer(data, np.uint8)
        ff = np.flatnonzero(buf[:-1] == 255)
        nxt = buf[ff + 1]
        markers = ff[(nxt != 0) & (nxt != 255) & ((nxt < 0xD0) | (nxt > 0xD7))]
        while True:
            marker, size = data[at + 1], 0
            if marker == 0xD9:
                break
            size = data[at + 2] << 8 | data[at + 3]
            body, at = data[at + 4:at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    n = 128 if wide else 64
                    self.quant[body[k] & 15] = np.frombuffer(body[k + 1:k + 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    k += 1 + n
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                self.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                self.across = -(-self.width // (8 * max(c[1] for c in self.comps)))
                self.down = -(-self.height // (8 * max(c[2] for c in self.comps)))
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1:k + 17])
                    tables[body[k]] = body[k + 1:k + 17], body[k + 17:k + 17 + n]
                    k += 17 + n
            elif marker == 0xDD:
                interval = body[0] << 8 | body[1]
            elif marker == 0xDA:
                ids = [c[0] for c in self.comps]
                pick = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
                lo, hi, approx = body[-3:]
                end = int(markers[np.searchsorted(markers, at)])
                self.scans.append((tuple(pick), lo, hi, approx >> 4, approx & 15, interval, tuple(tables.get(t, (b"", b"")) for t in self._wanted(pick, lo)), buf[at:end]))
                at = end

    @staticmethod
    def _wanted(pick, lo):
        return [0x10 | t & 15 if lo else t >> 4 for _, t in pick]

    def order(self, pick) -> list[tuple[int, np.ndarray]]:
        """For each place in an MCU of a scan: the component and the block numbers, MCU after MCU."""
        return _order(tuple(i for i, _ in pick), tuple(c[1:3] for c in self.comps), self.width, self.height, self.across, self.down)


@lru_cache(256)
def _order(picked, comps, width, height, across, down) -> list[tuple[int, np.ndarray]]:
    if len(picked) == 1:
        h, v = comps[picked[0]]
        wide = -(-(-(-width * h // max(c[0] for c in comps))) // 8)
        high = -(-(-(-height * v // max(c[1] for c in comps))) // 8)
        return [(picked[0], (np.arange(high)[:, None] * (across * h) + np.arange(wide)).ravel())]
    out = []
    y, x = np.divmod(np.arange(across * down), across)
    for i in picked:
        h, v = comps[i]
        out += [(i, (y * v + dy) * (across * h) + x * h + dx) for dy in range(v) for dx in range(h)]
    return out


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits ahead: symbol << 8 | code length (0 where there is no code)."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[code << (16 - n):(code + 1) << (16 - n)] = symbols[k] << 8 | n
            code, k = code + 1, k + 1
        code <<= 1
    return out


_LOOKUPS: dict[tuple[bytes, bytes], np.ndarray] = {}


class Lanes:
    """Restart segments of many scans, read side by side; one bit position for each."""

    def __init__(self, scans: list[np.ndarray]):
        begin = np.cumsum([0, *map(len, scans)])
        buf = np.concatenate([*scans, np.full(1, 0, np.uint8)])
        ff = np.flatnonzero(buf[:-1] == 255)
        nxt = buf[ff + 1]
        rst = ff[nxt >= 0xD0]
        keep = np.ones(len(buf), bool)
        keep[ff[nxt == 0] + 1] = False
        keep[rst] = keep[rst + 1] = keep[-1] = False
        kept = np.cumsum(keep) - keep  # places before each byte
        starts = np.sort(np.concatenate([begin[:-1], rst]))
        flat = np.concatenate([buf[keep], np.full(8, 255, np.uint8)]).astype(np.uint32)
        self.word = flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:]
        self.bit = np.unpackbits(flat.astype(np.uint8))
        self.pos = kept[starts] * 8

    def peek(self, lane: np.ndarray) -> np.ndarray:
        """The next 25 bits or more, at the top of 32."""
        p = self.pos[lane]
        return self.word[np.minimum(p >> 3, len(self.word) - 1)] << (p & 7).astype(np.uint32)

    def symbol(self, lane: np.ndarray, table: np.ndarray) -> np.ndarray:
        got = table[self.peek(lane) >> np.uint32(16)]
        self.pos[lane] += got & 255
        return got >> 8

    def bits(self, lane: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n (at most 16) bits of each lane."""
        out = self.peek(lane).astype(np.int64) >> (32 - n)
        self.pos[lane] += n
        return out


def _signed(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << size) >> 1, v - (1 << size) + 1, v)


def _decode_scan(frames: list[Frame], scans: list[tuple]) -> None:
    pick, lo, hi, high, low, interval, tables, _ = scans[0]
    lanes = Lanes([s[-1] for s in scans])
    look = []
    for t in tables:
        if t not in _LOOKUPS:
            _LOOKUPS[t] = _lookup(*t) if t[0] else np.zeros(1, np.int64)
        look.append(_LOOKUPS[t])
    orders = [f.order(pick) for f in frames]
    comps = [i for i, _ in orders[0]]
    coef = {i: frames[0].pool[i] for i in comps}
    units = [np.concatenate([o[k][1] + f.base[i] for f, o in zip(frames, orders)]) for k, i in enumerate(comps)]
    counts = np.array([len(o[0][1]) for o in orders])
    step = np.full(len(counts), interval) if interval else counts
    lanes_of = -(-counts // step)
    if lanes_of.sum() != len(lanes.pos):
        raise ValueError("restart markers don't fit the scan")
    nth = np.arange(len(lanes.pos)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    stop = np.repeat(np.cumsum(counts), lanes_of)
    begin = stop - np.repeat(counts, lanes_of) + nth * np.repeat(step, lanes_of)
    end = np.minimum(begin + np.repeat(step, lanes_of), stop)
    if lo == 0:
        lane, unit = np.arange(len(begin)), begin.copy()
        before = {i: np.zeros(len(begin), np.int64) for i in coef}
        tab = {i: t for (i, _), t in zip(pick, look)}
        while len(lane):
            for k, i in enumerate(comps):
                block = units[k][unit[lane]]
                if high == 0:
                    size = lanes.symbol(lane, tab[i])
                    before[i][lane] += _signed(lanes.bits(lane, size), size)
                    coef[i][block, 0] = before[i][lane] << low
                else:
                    coef[i][block, 0] |= (lanes.bits(lane, np.ones(len(lane), np.int64)) << low).astype(np.int32)
            unit[lane] += 1
            lane = lane[unit[lane] < end[lane]]
    else:
        i = comps[0]
        (_first if high == 0 else _refine)(lanes, look[0], coef[i], units[0], begin, end, lo, hi, low)


def _first(lanes, table, coef, units, unit, end, lo, hi, low) -> None:
    """First scan of a band of AC coefficients."""
    lane, k, skip = np.arange(len(unit)), np.full(len(unit), lo), np.zeros(len(unit), np.int64)
    flat = coef.reshape(-1)
    while len(lane):
        s = lanes.symbol(lane, table)
        run, size = s >> 4, s & 15
        v = _signed(lanes.bits(lane, size), size)
        at = k[lane] + run
        put = (size > 0) & (at <= hi)
        flat[units[unit[lane[put]]] * 64 + at[put]] = v[put] << low
        k[lane] = at + 1
        over = (size == 0) & (run < 15)
        if over.any():
            who, n = lane[over], run[over]
            skip[who] = (1 << n) - 1 + lanes.bits(who, n)
            k[who] = hi + 1
        done = lane[k[lane] > hi]
        unit[done] += 1 + skip[done]
        skip[done], k[done] = 0, lo
        lane = lane[unit[lane] < end[lane]]


def _refine(lanes, table, coef, units, unit, end, lo, hi, low) -> None:
    """Refinement scan of a band: corrections of old coefficients, and new ones of one bit."""
    lane, k, left = np.arange(len(unit)), np.full(len(unit), lo), np.zeros(len(unit), np.int64)
    column = np.arange(lo, hi + 1)
    while len(lane):
        fresh = lane[left[lane] == 0]
        goal, sign = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        if len(fresh):
            s = lanes.symbol(fresh, table)
            run, size = s >> 4, s & 15
            over = (size == 0) & (run < 15)
            who, n = fresh[over], run[over]
            left[who] = (1 << n) + lanes.bits(who, n)
            goal[fresh] = np.where(over, 0, run + 1)  # pass so many zeros; the last of them is the new coefficient's
            one = fresh[size > 0]
            sign[one] = lanes.bits(one, np.ones(len(one), np.int64)) * 2 - 1
        block = units[unit[lane]]
        c = coef[block, lo:hi + 1]
        ahead = column >= k[lane][:, None]
        old = (c != 0) & ahead
        zeros = np.cumsum((c == 0) & ahead, axis=1, dtype=np.int32)
        want = goal[lane]
        stop = np.where(want > 0, (zeros < want[:, None]).sum(axis=1), len(column))  # first column not passed
        old &= np.arange(len(column)) < stop[:, None]
        rank = np.cumsum(old, axis=1, dtype=np.int32)
        p = np.minimum(lanes.pos[lane][:, None] + (rank - 1), len(lanes.bit) - 1)
        bit = (lanes.bit[p] & old).astype(np.int32) << low
        c += np.where(c > 0, bit, -bit)
        lanes.pos[lane] += rank[:, -1]
        put = (sign[lane] != 0) & (stop < len(column))
        c[put, stop[put]] = sign[lane][put] << low
        coef[block, lo:hi + 1] = c
        k[lane] = lo + stop + 1
        done = lane[k[lane] > hi]
        left[done] = np.maximum(left[done] - 1, 0)
        unit[done] += 1
        k[done] = lo
        lane = lane[unit[lane] < end[lane]]


def pool_coefficients(frames: list[Frame]) -> None:
    """One array for each component of all frames, of which each frame sees its part."""
    pool: list[np.ndarray] = []
    for f in frames:
        f.pool, f.base, f.coef = pool, [], []
    for i in range(max((len(f.comps) for f in frames), default=0)):
        some = [f for f in frames if i < len(f.comps)]
        sizes = np.cumsum([0, *(f.down * f.comps[i][2] * f.across * f.comps[i][1] for f in some)]).tolist()
        pool.append(np.zeros((sizes[-1], 64), np.int32))
        for f, a, b in zip(some, sizes, sizes[1:]):
            f.base.append(a)
            f.coef.append(pool[i][a:b])


def decode_many(files: list[bytes]) -> list[Frame]:
    """The files' frames with all scans accumulated; scans of equal parameters are read together."""
    frames = [Frame(f) for f in files]
    pool_coefficients(frames)
    for n in range(max((len(f.scans) for f in frames), default=0)):
        alike = defaultdict(list)
        for f in frames:
            if n < len(f.scans):
                alike[f.scans[n][:-1], tuple(c[1:3] for c in f.comps)].append(f)
        for some in alike.values():
            _decode_scan(some, [f.scans[n] for f in some])
    for f in frames:
        f.scans = []
    return frames


def payload_of(frame: Frame) -> bytes:
    """The stored payload, from the coefficients."""
    across, down = frame.across, frame.down
    c = np.empty((down, across, MCU, 64), np.int32)
    c[:, :, :4] = frame.coef[0].reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    c[:, :, 4], c[:, :, 5] = frame.coef[1].reshape(down, across, 64), frame.coef[2].reshape(down, across, 64)
    return (c + 128).astype(np.uint8).tobytes()[:int(frame.comment.split()[1])]


def inverse_basis() -> np.ndarray:
    """From zigzag coefficients to the 64 samples of a block."""
    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    a = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 1 / 2)
    return np.kron(a, a).T[ZIGZAG]


_BASIS = inverse_basis()


def rgb(frame: Frame) -> np.ndarray:
    """The full-resolution (height, width, 3) tensor of a decoded frame."""
    planes = []
    for coef, (_, h, v, q) in zip(frame.coef, frame.comps):
        scale = frame.quant[q]
        y = np.floor((coef * scale) @ _BASIS + (128.5 + 1e-6)).clip(0, 255).astype(np.uint8)  # the small part settles ties
        wide = frame.across * h
        plane = y.reshape(-1, wide, 8, 8).transpose(0, 2, 1, 3).reshape(-1, wide * 8)
        up, across = max(c[2] for c in frame.comps) // v, max(c[1] for c in frame.comps) // h
        planes.append(plane.repeat(up, 0).repeat(across, 1)[:frame.height, :frame.width].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, b, r = planes[0] * 65536 + 32768, planes[1] - 128, planes[2] - 128
    out = np.stack([y + 91881 * r, y - 22554 * b - 46802 * r, y + 116130 * b], axis=-1) >> 16
    return out.clip(0, 255).astype(np.uint8)


def feature_of(tensor: np.ndarray) -> str:
    """Height, width, the channels' means and their standard deviations, from exact sums."""
    x = tensor.reshape(-1, 3).astype(np.int64)
    n, total, square = len(x), x.sum(0), (x * x).sum(0)
    mean = [f"{t / n:.3f}" for t in total.tolist()]
    deviation = [f"{max(0, s / n - (t / n) ** 2) ** .5:.3f}" for t, s in zip(total.tolist(), square.tolist())]
    return f"{tensor.shape[0]}x{tensor.shape[1]} mean {' '.join(mean)} sd {' '.join(deviation)}"


def _batches(sizes: Iterator[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    lo = total = i = 0
    for i, n in enumerate(sizes, 1):
        if total and total + n > most:
            yield lo, i - 1
            lo, total = i - 1, 0
        total += n
    if i > lo:
        yield lo, i


def padded(text: bytes) -> bytes:
    return text + bytes([FILL]) * (-len(text) % UNIT or (0 if text else UNIT))


def store_media(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (else all) with ``_n_bytes``, ``_payload_bytes`` and ``_media``, a JPEG file.

    The payload is the text's UTF-8 bytes (a null text: none) and bytes 255 up to a positive
    multiple of 576. Equal texts give equal files; columns named like the new ones are replaced,
    others pass unchanged; repeated rows appear each; an empty table gives no rows.
    """
    new = ["_n_bytes", "_payload_bytes", "_media"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            for lo, hi in _batches(len(x.as_buffer() or b"") for x in column):
                texts = column.slice(lo, hi - lo).to_pylist()
                payloads = [padded(t) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts], pa.int64()),
                                                  pa.array([len(p) for p in payloads], pa.int64()), pa.array(encode_many(payloads), pa.binary())], ["_row", *new])

    return map_beside(docs, kept, [text_of(text).cast("binary")], run, [*(StructField(c, LongType()) for c in new[:2]), StructField("_media", BinaryType())])


def read_media(df: DataFrame, tensors: bool = True) -> DataFrame:
    """``df`` with ``_payload`` read back from ``_media``, ``_height``, ``_width``, ``_feature`` and, if asked, the RGB ``_tensor``."""
    new = ["_payload", "_height", "_width", "_feature", "_tensor"]
    kept = [c for c in df.columns if c not in new]
    fields = [StructField("_payload", BinaryType()), StructField("_height", IntegerType()), StructField("_width", IntegerType()),
              StructField("_feature", StringType()), *([StructField("_tensor", BinaryType())] if tensors else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            for lo, hi in _batches(len(x.as_buffer()) for x in column):
                frames = decode_many(column.slice(lo, hi - lo).to_pylist())
                images = [rgb(f) for f in frames]
                arrays = [pa.array([payload_of(f) for f in frames], pa.binary()), pa.array([f.height for f in frames], pa.int32()),
                          pa.array([f.width for f in frames], pa.int32()), pa.array([feature_of(x) for x in images], pa.string())]
                if tensors:
                    arrays.append(pa.array([x.tobytes() for x in images], pa.binary()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *arrays], ["_row", *(f.name for f in fields)])

    return map_beside(df, kept, [F.col("_media")], run, fields)
