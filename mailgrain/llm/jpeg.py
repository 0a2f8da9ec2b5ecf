"""Progressive JPEG in numpy: an encoder for coefficient payloads and a decoder to coefficients and RGB tensors.

Decoding accumulates the scans (spectral selection and successive approximation) into coefficient arrays.  Entropy
coded data is sequential, but restart intervals are independent: all intervals of a scan, over all images of a batch
with the same structure, are decoded in step with each other, one symbol of each at a time.  The inverse transform is
in integers, so equal coefficients give equal pixels whatever the batch.

A payload is stored in the unit of the format: each byte is one quantised coefficient, so nothing is lost.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass, field

import numpy as np

# ---------------------------------------------------------------- fixed orders and tables

#: row and column of the coefficients in scan order, from the rule of alternating diagonals
_SCAN = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
NATURAL = np.asarray([r * 8 + c for r, c in _SCAN])

#: bytes from frequent to rare; all others follow in ascending order.  The n-th byte is stored as 0, 1, -1, 2, -2, ...
FREQUENT = b" eantoirshdulcmgfpbw,.\nyvk\xc3\xa9\xb3\xa8TEAOI"
_RANKED = list(dict.fromkeys([*FREQUENT, *range(256)]))
BYTE_VALUE = np.zeros(256, np.int16)
BYTE_VALUE[_RANKED] = [(r + 1) // 2 if r % 2 else -(r // 2) for r in range(256)]
VALUE_BYTE = np.zeros(257, np.uint8)
VALUE_BYTE[BYTE_VALUE + 128] = np.arange(256)

SAMPLING = ((2, 2), (1, 1), (1, 1))
#: components, first and last coefficient, bit positions before and after
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0),
)
RESTART = 8


def huffman_lengths(weights: dict[int, float]) -> dict[int, int]:
    """Code lengths of at most 16 bits; one code stays free, so that no code is all ones."""
    floor = 0.0
    while True:
        heap = [(max(w, floor), i, (s,)) for i, (s, w) in enumerate([*weights.items(), (-1, 0.0)])]
        heapq.heapify(heap)
        depth = dict.fromkeys([*weights, -1], 0)
        count = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for symbol in a[2] + b[2]:
                depth[symbol] += 1
            heapq.heappush(heap, (a[0] + b[0], count, a[2] + b[2]))
            count += 1
        if max(depth.values()) <= 16:
            # the free code must be the last of the longest
            longest = max(depth.values())
            if depth[-1] != longest:
                depth[-1] = longest
            del depth[-1]
            return depth
        floor = floor * 2 or 1e-7


def table_bytes(lengths: dict[int, int]) -> bytes:
    """Counts by length and symbols in code order, as in a DHT segment."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(1 for s in order if lengths[s] == n) for n in range(1, 17)]
    return bytes(counts) + bytes(order)


def codes_of(table: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length) of a DHT table."""
    code, at, out = 0, 16, {}
    for length, count in enumerate(table[:16], 1):
        for symbol in table[at: at + count]:
            out[symbol] = (code, length)
            code += 1
        at += count
        code <<= 1
    return out


_luts: dict[bytes, np.ndarray] = {}


def lookup(table: bytes) -> np.ndarray:
    """length << 8 | symbol for each value of the next 16 bits; 0 where no code fits."""
    if table not in _luts:
        lut = np.zeros(1 << 16, np.int32)
        for symbol, (code, length) in codes_of(table).items():
            lut[code << (16 - length): (code + 1) << (16 - length)] = length << 8 | symbol
        _luts[table] = lut
    return _luts[table]


DC_TABLE = table_bytes(huffman_lengths({s: 0.6 ** abs(s - 4) for s in range(12)}))
#: parameters of the AC code: relative frequency of runs of zeros and of sizes in texts stored by byte rank
RUN_WEIGHT = [1.0, 0.5, 0.18, 0.035, 0.006] + [0.001 * 0.3 ** i for i in range(11)]
SIZE_WEIGHT = [0.0, 0.25, 0.18, 0.13, 0.01, 0.07, 0.025, 0.002, 0.0005]
AC_TABLE = table_bytes(huffman_lengths(
    {0: 0.03, 0xF0: 1e-4} | {r << 4 | s: RUN_WEIGHT[r] * SIZE_WEIGHT[s] for r in range(16) for s in range(1, 9)}))


def _code_arrays(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, (c, n) in codes_of(table).items():
        code[symbol], length[symbol] = c, n
    return code, length


_DC, _AC = _code_arrays(DC_TABLE), _code_arrays(AC_TABLE)
_SIZE = np.asarray([int(v).bit_length() for v in range(4096)])

# ---------------------------------------------------------------- geometry


def payload_grid(blocks: int) -> tuple[int, int]:
    """Columns and rows of 16 x 16 pixel units that hold so many blocks, six in each unit."""
    units = max(1, -(-blocks // 6))
    columns = -(-units // 4095)
    return columns, -(-units // columns)


def unit_order(columns: int, rows: int) -> np.ndarray:
    """Blocks in the order of an interleaved scan, counted over the planes one after the other."""
    y, x = np.divmod(np.arange(columns * rows), columns)
    out = np.empty((columns * rows, 6), np.int64)
    for i, (dy, dx) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        out[:, i] = (2 * y + dy) * 2 * columns + 2 * x + dx
    out[:, 4] = 4 * columns * rows + np.arange(columns * rows)
    out[:, 5] = 5 * columns * rows + np.arange(columns * rows)
    return out.ravel()


# ---------------------------------------------------------------- encoding


def _packed(segment: np.ndarray, code: np.ndarray, bits: np.ndarray, segments: int, last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy coded bytes of all segments with stuffing and restart markers, and where each segment's bytes end.

    ``last`` marks the last segment of an image, which no restart marker follows.
    """
    total = np.bincount(segment, weights=bits, minlength=segments).astype(np.int64)
    size = -(-total // 8)
    place = np.cumsum(size) - size
    before = np.cumsum(bits) - bits
    start = (place * 8 - (np.cumsum(total) - total))[segment] + before
    # each code lies in at most five bytes; codes share no bits, so sums are unions
    wide = code << (40 - bits - (start & 7))
    raw = np.zeros(int(size.sum()), np.int64)
    for i in range(5):
        part = (wide >> (32 - 8 * i)) & 255
        if i > 1:
            some = np.flatnonzero(part)
            raw += np.bincount((start[some] >> 3) + i, weights=part[some], minlength=len(raw))[: len(raw)].astype(np.int64)
        else:
            raw += np.bincount((start >> 3) + i, weights=part, minlength=len(raw))[: len(raw)].astype(np.int64)
    raw[np.cumsum(size) - 1] += (1 << (size * 8 - total)) - 1
    stuffed = np.ones(len(raw), np.int64) + (raw == 255)
    final = np.cumsum(size) - 1  # last byte of each segment; empty segments do not occur
    stuffed[final] += np.where(last, 0, 2)
    ends = np.cumsum(stuffed)
    full = np.zeros(int(ends[-1]), np.uint8)
    full[ends - stuffed] = raw
    number = np.arange(segments) - np.repeat(np.flatnonzero(np.r_[True, last[:-1]]), np.diff(np.r_[np.flatnonzero(np.r_[True, last[:-1]]), segments]))
    marks = ends[final[~last]]
    full[marks - 2], full[marks - 1] = 255, 0xD0 + (number[~last] % 8)
    return full.tobytes(), ends[final]


def _dc_first(values, component, segment, low):
    v = values[:, 0].astype(np.int64) >> low
    previous = np.zeros(len(v), np.int64)
    for c in np.unique(component):
        own = np.flatnonzero(component == c)
        same = segment[own[1:]] == segment[own[:-1]]
        previous[own[1:][same]] = v[own[:-1][same]]
    diff = v - previous
    size = _SIZE[np.abs(diff)]
    extra = np.where(diff > 0, diff, diff + (1 << size) - 1)
    return segment, _DC[0][size] << size | np.where(size > 0, extra, 0), _DC[1][size] + size


def _ac_first(values, segment, first, final, low):
    band = values[:, first: final + 1]
    amount = np.abs(band) >> low
    b, k = np.nonzero(amount)
    before = np.full(len(b), -1)
    same = b[1:] == b[:-1]
    before[1:][same] = k[:-1][same]
    run = k - before - 1
    a, positive = amount[b, k].astype(np.int64), band[b, k] > 0
    size = _SIZE[a]
    symbol = (run & 15) << 4 | size
    code = _AC[0][symbol] << size | np.where(positive, a, (1 << size) - 1 - a)
    tail = np.full(len(values), -1)
    ends = np.flatnonzero(np.r_[b[1:] != b[:-1], True]) if len(b) else b
    tail[b[ends]] = k[ends]
    short = tail < final - first
    # places: what stands in earlier blocks, then the long runs and coefficients of the block
    closed = np.cumsum(short) - short
    long = run >> 4
    place = np.arange(len(b)) + np.cumsum(long) + closed[b]
    out_code = np.full(len(b) + int(long.sum()) + int(short.sum()), _AC[0][0xF0])
    out_bits = np.full(len(out_code), _AC[1][0xF0])
    out_block = np.zeros(len(out_code), np.int64)
    out_code[place], out_bits[place], out_block[place] = code, _AC[1][symbol] + size, b
    each = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
    out_block[np.repeat(place - long, long) + each] = np.repeat(b, long)
    per_block = np.bincount(b, weights=1 + long, minlength=len(values)).astype(np.int64) + short
    at = np.cumsum(per_block)[short] - 1
    out_code[at], out_bits[at], out_block[at] = _AC[0][0], _AC[1][0], np.flatnonzero(short)
    return segment[out_block], out_code, out_bits


def _ac_refine(values, segment, first, final, low):
    band = values[:, first: final + 1]  # counts within a band fit 16 bits too
    amount = np.abs(band) >> low
    zero, new, old = amount == 0, amount == 1, amount > 1
    part = np.cumsum(new, axis=1, dtype=np.int16) - new  # newly significant coefficients before
    zeros = np.cumsum(zero, axis=1, dtype=np.int16) - zero
    at_new = np.where(new, zeros, np.int16(0))
    base = np.maximum.accumulate(np.concatenate([np.zeros((len(band), 1), np.int16), at_new[:, :-1]], axis=1), axis=1)
    since = zeros - base  # zeros since the last newly significant coefficient
    key_of = lambda b, s, q, kind, k: (((b * 64 + s) * 8 + q) * 2 + kind) * 64 + k
    b, k = np.nonzero(new)
    run = since[b, k]
    symbol = (run & 15) << 4 | 1
    keys = [key_of(b, part[b, k], run >> 4, 0, 0)]
    codes = [_AC[0][symbol] << 1 | (band[b, k] > 0)]
    bits = [_AC[1][symbol] + 1]
    many = run >> 4
    each = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    keys.append(key_of(np.repeat(b, many), np.repeat(part[b, k], many), each, 0, 0))
    codes.append(np.full(len(each), _AC[0][0xF0]))
    bits.append(np.full(len(each), _AC[1][0xF0]))
    count = new.sum(axis=1)
    last = np.full(len(band), -1)
    np.maximum.at(last, b, k)
    open_blocks = np.flatnonzero(last < final - first)
    keys.append(key_of(open_blocks, count[open_blocks], 0, 0, 0))
    codes.append(np.full(len(open_blocks), _AC[0][0]))
    bits.append(np.full(len(open_blocks), _AC[1][0]))
    b, k = np.nonzero(old)
    keys.append(key_of(b, part[b, k], np.where(k > last[b], 0, since[b, k] >> 4), 1, k))
    codes.append(amount[b, k] & 1)
    bits.append(np.ones(len(b), np.int64))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return segment[key[order] // (64 * 8 * 2 * 64)], np.concatenate(codes)[order], np.concatenate(bits)[order]


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, code, len(body) + 2) + body


def encode_payloads(payloads: list[bytes], note: list[bytes]) -> list[bytes]:
    """One progressive JPEG for each payload, its bytes as coefficients; ``note`` goes to a comment segment."""
    sizes = [-(-len(p) // 64) for p in payloads]
    grids = [payload_grid(n) for n in sizes]
    units = np.asarray([c * r for c, r in grids])
    first = np.cumsum(6 * units) - 6 * units
    flat = np.zeros((int(6 * units.sum()), 64), np.int16)
    for at, payload in zip(first.tolist(), payloads):
        values = BYTE_VALUE[np.frombuffer(payload, np.uint8)]
        flat[at: at + -(-len(values) // 64)].reshape(-1)[: len(values)] = values
    parts: list[list[bytes]] = []
    tables = _marker(0xC4, b"\0" + DC_TABLE) + _marker(0xC4, b"\x10" + AC_TABLE)
    for (columns, rows), text in zip(grids, note):
        frame = struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + b"".join(
            bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(SAMPLING))
        parts.append([
            b"\xff\xd8", _marker(0xFE, text), _marker(0xDB, b"\0" + b"\1" * 64), _marker(0xC2, frame), tables,
            _marker(0xDD, struct.pack(">H", RESTART))])
    orders = {}
    for components, start, final, high, low in SCRIPT:
        if components not in orders:
            blocks, per, pattern = [], [], []
            for at, (columns, rows) in zip(first.tolist(), grids):
                n = columns * rows
                if len(components) == 3:
                    own = unit_order(columns, rows)
                    per.append(-(-n // RESTART))
                    pattern.append(np.tile([0, 0, 0, 0, 1, 2], n))
                else:
                    own = np.arange(4 * n) if components == (0,) else np.arange(n) + (3 + components[0]) * n
                    per.append(-(-len(own) // RESTART))
                    pattern.append(np.full(len(own), components[0]))
                blocks.append(own + at)
            width = RESTART * (6 if len(components) == 3 else 1)
            offset = np.cumsum(per) - per
            segment = np.concatenate([np.arange(len(b)) // width + o for b, o in zip(blocks, offset)])
            last = np.zeros(int(np.sum(per)), bool)
            last[np.cumsum(per) - 1] = True
            orders[components] = np.concatenate(blocks), segment, np.concatenate(pattern), last, np.cumsum(per)
        blocks, segment, component, last, ends = orders[components]
        values = flat[blocks]
        if final == 0 and high == 0:
            emitted = _dc_first(values, component, segment, low)
        elif final == 0:
            emitted = segment, (values[:, 0].astype(np.int64) >> low) & 1, np.ones(len(values), np.int64)
        elif high == 0:
            emitted = _ac_first(values, segment, start, final, low)
        else:
            emitted = _ac_refine(values, segment, start, final, low)
        data, stops = _packed(*emitted, len(last), last)
        head = _marker(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([start, final, high << 4 | low]))
        at = 0
        for own, stop in zip(parts, stops[ends - 1].tolist()):
            own += [head, data[at:stop]]
            at = stop
    return [b"".join(own) + b"\xff\xd9" for own in parts]


# ---------------------------------------------------------------- parsing


@dataclass
class Image:
    """What the markers of one progressive JPEG say; scans hold their entropy coded bytes by restart interval."""

    width: int = 0
    height: int = 0
    note: bytes = b""
    components: list = field(default_factory=list)  # (id, horizontal, vertical, quantisation table)
    quantisation: dict = field(default_factory=dict)
    scans: list = field(default_factory=list)  # ((components), first, final, high, low, tables, restart)
    intervals: list = field(default_factory=list)

    @property
    def structure(self):
        return tuple((c[1], c[2]) for c in self.components), tuple(self.scans)


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)
_RST = re.compile(rb"\xff[\xd0-\xd7]")


def parse(data: bytes) -> Image:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, at, restart = Image(), 2, 0
    tables: dict[int, bytes] = {}
    while at < len(data):
        code = data[at + 1]
        if code == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4: at + 2 + size]
        at += 2 + size
        if code == 0xFE:
            image.note = body
        elif code == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisation[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[1 + 64 * (1 + wide):]
        elif code == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif code == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif code == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC0 <= code <= 0xCF and code != 0xC8:
            raise ValueError("not a progressive JPEG")
        elif code == 0xDA:
            ids = [c[0] for c in image.components]
            n = body[0]
            chosen = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            used = tuple((tables.get(body[2 + 2 * i] >> 4, b""), tables.get(16 + (body[2 + 2 * i] & 15), b"")) for i in range(n))
            start, final, bits = body[1 + 2 * n: 4 + 2 * n]
            found = _NEXT.search(data, at)
            stop = found.start() if found else len(data)
            image.scans.append((chosen, start, final, bits >> 4, bits & 15, used, restart))
            image.intervals.append([x.replace(b"\xff\x00", b"\xff") for x in _RST.split(data[at:stop])])
            at = stop
    return image


# ---------------------------------------------------------------- decoding


class _Bits:
    """64-bit windows at every byte of all intervals of a scan."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.asarray([len(p) + 16 for p in pieces])
        raw = np.frombuffer(b"".join([p + b"\xff" * 16 for p in pieces]), np.uint8)
        self.start = (np.cumsum(sizes) - sizes) * 8
        self.end = self.start + sizes * 8
        self.words = np.zeros(len(raw), np.uint64)
        for i in range(8):
            self.words[: len(raw) - i] |= raw[i:].astype(np.uint64) << np.uint64(56 - 8 * i)

    def at(self, place: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(place >> 3, len(self.words) - 1)] << (place & 7).astype(np.uint64)


def _take(window: np.ndarray, skip: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` bits after ``skip`` bits of each window."""
    shifted = (window << skip.astype(np.uint64)) >> (np.uint64(63) - np.minimum(count, 63).astype(np.uint64))
    return (shifted >> np.uint64(1)).astype(np.int64)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


class _Lanes:
    """Blocks of each restart interval, and what they are called in the coefficient array."""

    def __init__(self, blocks: list[np.ndarray], per_unit: int, restart: int):
        sizes, chunks = [], []
        for own in blocks:
            width = restart * per_unit if restart else max(1, len(own))
            count = -(-len(own) // width)
            sizes += [width] * (count - 1) + [len(own) - width * (count - 1)]
            chunks.append(count)
        self.blocks = np.concatenate(blocks)
        self.size = np.asarray(sizes)
        self.first = np.cumsum(self.size) - self.size
        self.per_image = chunks


def _decode_dc(coefficients, lanes, bits, luts, pattern, high, low):
    if high:
        place = np.repeat(bits.start, lanes.size) + np.arange(len(lanes.blocks)) - np.repeat(lanes.first, lanes.size)
        bit = (bits.at(place) >> np.uint64(63)).astype(np.int16)
        coefficients[lanes.blocks, 0] |= bit << low
        return
    place = bits.start.copy()
    previous = np.zeros((len(place), max(pattern) + 1), np.int64)
    for step in range(int(lanes.size.max())):
        on = np.flatnonzero(lanes.size > step)
        part = pattern[step % len(pattern)]
        window = bits.at(place[on])
        entry = luts[part][(window >> np.uint64(48)).astype(np.int64)]
        length, size = entry >> 8, entry & 255
        previous[on, part] += np.where(size > 0, _extend(_take(window, length, size), size), 0)
        place[on] += length + size
        coefficients[lanes.blocks[lanes.first[on] + step], 0] = previous[on, part] << low


_short: dict[bytes, tuple] = {}


def short_codes(table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the next 16 bits: whether they hold a whole coefficient, its bits, the zeros before it, and its value."""
    if table not in _short:
        lut = lookup(table).astype(np.int64)
        length, run, size = lut >> 8, (lut >> 4) & 15, lut & 15
        total = length + size
        fits = (size > 0) & (total <= 16)
        bits = (np.arange(1 << 16) >> np.maximum(16 - total, 0)) & ((1 << size) - 1)
        _short[table] = fits, total, run, np.where(fits, _extend(bits, size), 0).astype(np.int16)
    return _short[table]


def _decode_ac_first(coefficients, lanes, bits, table, first, final, low):
    lut, (fits, total, zeros, values) = lookup(table), short_codes(table)
    place, block, k = bits.start.copy(), np.zeros(len(bits.start), np.int64), np.full(len(bits.start), first)
    flat = coefficients.reshape(-1)
    on = np.flatnonzero(lanes.size > 0)
    at = lanes.blocks[lanes.first[on]] * 64
    while len(on):
        here = place[on]
        window = bits.at(here)
        peek = (window >> np.uint64(48)).astype(np.int64)
        now = k[on] + zeros[peek]
        used = total[peek]
        got = fits[peek]
        over = now >= final
        odd = np.flatnonzero(~got | (now > final))
        if len(odd):
            # ends of blocks, long runs and codes of more than 16 bits
            entry = lut[peek[odd]].astype(np.int64)
            length, run, size = np.maximum(entry >> 8, 1), (entry >> 4) & 15, entry & 15
            end = (size == 0) & (run < 15)
            extra = np.where(end, run, size)
            value = _take(window[odd], length, extra)
            used[odd] = length + extra
            late = np.flatnonzero((size > 0) & (now[odd] <= final))
            flat[at[odd[late]] + now[odd[late]]] = _extend(value[late], size[late]) << low
            whole = got.copy()
            whole[odd] = False
            over[odd] |= end
            block[on] += over
            ends = np.flatnonzero(end)
            block[on[odd[ends]]] += (1 << run[ends]) + value[ends] - 1
            sure = np.flatnonzero(whole)
            flat[at[sure] + now[sure]] = values[peek[sure]] << low
        else:
            flat[at + now] = values[peek] << low
            block[on] += over
        place[on] = here + used
        k[on] = np.where(over, first, now + 1)
        turned = np.flatnonzero(over)
        if len(turned):
            stay = (block[on] < lanes.size[on]) & (place[on] < bits.end[on])
            if not stay.all():
                on, at = on[stay], at[stay]
                turned = np.flatnonzero(over[stay])
            at[turned] = lanes.blocks[lanes.first[on[turned]] + block[on[turned]]] * 64


def _decode_ac_refine(coefficients, lanes, bits, lut, first, final, low):
    own = lanes.blocks
    old = coefficients[own] != 0
    old[:, :first], old[:, final + 1:] = False, False
    zero = np.zeros((len(own), 66), np.int16)  # zeros of the band before each place
    zero[:, first + 1: final + 2] = np.cumsum(~old[:, first: final + 1], axis=1)
    zero[:, final + 2:] = zero[:, final + 1: final + 2]
    where = np.full((len(own), 82), final + 1, np.int16)
    b, j = np.nonzero(~old[:, first: final + 1])
    where[b, zero[b, j + first]] = j + first
    place, block, k = bits.start.copy(), np.zeros(len(bits.start), np.int64), np.full(len(bits.start), first)
    skip = np.zeros(len(bits.start), np.int64)
    on = np.flatnonzero(lanes.size > 0)
    noted = []
    while len(on):
        row = lanes.first[on] + block[on]
        window = bits.at(place[on])
        entry = lut[(window >> np.uint64(48)).astype(np.int64)]
        length, run, size = np.maximum(entry >> 8, 1).astype(np.int64), ((entry >> 4) & 15).astype(np.int64), entry & 15
        reading = skip[on] == 0
        end = reading & (size == 0) & (run < 15)
        fresh = reading & (size > 0)
        extra = np.where(end, run, fresh)
        value = _take(window, length, extra)
        used = np.where(reading, length + extra, 0)
        skip[on] += np.where(end, (1 << run) + value, 0)
        closing = skip[on] > 0
        now = k[on]
        target = np.where(closing, final + 1, where[row, np.minimum(zero[row, now] + run, 81)]).astype(np.int64)
        between = (target - now) - (zero[row, target] - zero[row, now])
        noted.append((row, now, target, place[on] + used))
        place[on] += used + between
        got = np.flatnonzero(fresh & (target <= final))
        coefficients[own[row[got]], target[got]] = np.where(value[got] > 0, 1, -1) << low
        skip[on] -= closing
        over = target >= final
        block[on] += over
        k[on] = np.where(over, first, target + 1)
        on = on[(block[on] < lanes.size[on]) & (place[on] <= bits.end[on])]
    row, start, stop, at = (np.concatenate(x) for x in zip(*noted))
    count = stop - start
    record = np.repeat(np.arange(len(row)), count)
    k = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count) + start[record]
    hit = old[row[record], k]
    record, k = record[hit], k[hit]
    opens = np.flatnonzero(np.r_[True, record[1:] != record[:-1]][: len(record)])
    rank = np.arange(len(record)) - np.repeat(opens, np.diff(np.r_[opens, len(record)]))
    bit = (bits.at(at[record] + rank) >> np.uint64(63)).astype(np.int16)
    target = own[row[record]]
    coefficients[target, k] += np.where(coefficients[target, k] > 0, bit, -bit) << low


def _planes(image: Image) -> list[tuple[int, int, int, int]]:
    """Of each component: blocks in a padded row, padded rows, blocks in a row of its own, own rows."""
    across = max(c[1] for c in image.components)
    down = max(c[2] for c in image.components)
    units_x, units_y = -(-image.width // (8 * across)), -(-image.height // (8 * down))
    return [
        (units_x * h, units_y * v, -(-(-(-image.width * h // across)) // 8), -(-(-(-image.height * v // down)) // 8))
        for _, h, v, _ in image.components]


def _interleaved(image: Image, planes, starts, chosen) -> np.ndarray:
    units_x = planes[0][0] // image.components[0][1]
    units_y = planes[0][1] // image.components[0][2]
    y, x = np.divmod(np.arange(units_x * units_y), units_x)
    columns = [
        starts[c] + (y * image.components[c][2] + dy) * planes[c][0] + x * image.components[c][1] + dx
        for c in chosen for dy in range(image.components[c][2]) for dx in range(image.components[c][1])]
    return np.stack(columns, axis=1).ravel()


def decode_coefficients(images: list[Image]) -> list[list[np.ndarray]]:
    """Quantised coefficients in scan order of each image's components, (blocks, 64), planes padded to whole units."""
    out: list[list[np.ndarray] | None] = [None] * len(images)
    groups: dict = {}
    for i, image in enumerate(images):
        groups.setdefault(image.structure, []).append(i)
    for (sampling, scans), members in groups.items():
        shapes = [_planes(images[i]) for i in members]
        starts, total = [], 0
        for planes in shapes:
            own = []
            for columns, rows, _, _ in planes:
                own.append(total)
                total += columns * rows
            starts.append(own)
        coefficients = np.zeros((total, 64), np.int16)
        ordered: dict[tuple, list[np.ndarray]] = {}  # blocks in scan order, the same for all scans of these components
        for number, (chosen, first, final, high, low, tables, restart) in enumerate(scans):
            per_unit, pattern = 1, [0]
            if len(chosen) > 1:
                pattern = [i for i, c in enumerate(chosen) for _ in range(sampling[c][0] * sampling[c][1])]
                per_unit = len(pattern)
            if chosen not in ordered:
                ordered[chosen] = blocks = []
                for i, planes, own in zip(members, shapes, starts):
                    if len(chosen) > 1:
                        blocks.append(_interleaved(images[i], planes, own, chosen))
                    else:
                        columns, _, wide, tall = planes[chosen[0]]
                        blocks.append((own[chosen[0]] + np.arange(tall)[:, None] * columns + np.arange(wide)).ravel())
            blocks = ordered[chosen]
            lanes = _Lanes(blocks, per_unit, restart)
            pieces = []
            for i, count in zip(members, lanes.per_image):
                found = images[i].intervals[number]
                pieces += (found + [b""] * count)[:count]
            bits = _Bits(pieces)
            if final == 0:
                _decode_dc(coefficients, lanes, bits, [lookup(t[0]) if t[0] else None for t in tables], pattern, high, low)
            elif high == 0:
                _decode_ac_first(coefficients, lanes, bits, tables[0][1], first, final, low)
            else:
                _decode_ac_refine(coefficients, lanes, bits, lookup(tables[0][1]), first, final, low)
        for i, planes, own in zip(members, shapes, starts):
            out[i] = [coefficients[at: at + p[0] * p[1]] for at, p in zip(own, planes)]
    return out


_K = np.arange(8)
_BASIS = np.sqrt(np.where(_K == 0, 1 / 8, 1 / 4))[:, None] * np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16)
#: integers in doubles: products and sums stay below 2**53, so they are exact in whatever order they are added
_FIXED = np.rint(_BASIS * (1 << 12))


def pixels(blocks: np.ndarray, quantisation: np.ndarray) -> np.ndarray:
    """Samples (blocks, 8, 8) from coefficients in scan order, by a fixed-point inverse transform."""
    natural = np.zeros((len(blocks), 64))
    natural[:, NATURAL] = blocks * quantisation.astype(np.int64)
    rows = np.floor((natural.reshape(-1, 8) @ _FIXED + 16) / 32)
    columns = np.ascontiguousarray(rows.reshape(-1, 8, 8).transpose(0, 2, 1)).reshape(-1, 8) @ _FIXED
    samples = np.floor((columns + (1 << 18)) / (1 << 19)) + 128
    return np.clip(samples, 0, 255).astype(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1)


#: blocks transformed at a time; their numbers stay in the processor's cache
TRANSFORM_BLOCKS = 256


def sample_blocks(images: list[Image], components: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """:func:`pixels` of every component of all images; blocks with one quantisation table are transformed together."""
    tables: dict[bytes, list[tuple[int, int]]] = {}
    for i, image in enumerate(images):
        for c, part in enumerate(image.components):
            tables.setdefault(image.quantisation[part[3]].tobytes(), []).append((i, c))
    out: list[list] = [[None] * len(image.components) for image in images]
    for members in tables.values():
        i, c = members[0]
        quantisation = images[i].quantisation[images[i].components[c][3]]
        blocks = np.concatenate([components[i][c] for i, c in members])
        samples = np.empty((len(blocks), 8, 8), np.uint8)
        for at in range(0, len(blocks), TRANSFORM_BLOCKS):
            samples[at: at + TRANSFORM_BLOCKS] = pixels(blocks[at: at + TRANSFORM_BLOCKS], quantisation)
        at = 0
        for i, c in members:
            out[i][c] = samples[at: at + len(components[i][c])]
            at += len(components[i][c])
    return out


def rgb_tensors(images: list[Image], components: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Full-resolution (height, width, 3) tensors; chroma is repeated to the luma grid, grey images give equal channels."""
    return [_rgb(image, own) for image, own in zip(images, sample_blocks(images, components))]


def rgb_tensor(image: Image, components: list[np.ndarray]) -> np.ndarray:
    return rgb_tensors([image], [components])[0]


def _rgb(image: Image, samples: list[np.ndarray]) -> np.ndarray:
    across, down = max(c[1] for c in image.components), max(c[2] for c in image.components)
    planes = []
    for (columns, rows, _, _), (_, h, v, _), own in zip(_planes(image), image.components, samples):
        plane = own.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8).astype(np.int32)
        planes.append((plane, down // v, across // h))

    def whole(plane: np.ndarray, tall: int, wide: int) -> np.ndarray:
        if tall > 1:
            plane = plane.repeat(tall, axis=0)
        if wide > 1:
            plane = plane.repeat(wide, axis=1)
        return plane[: image.height, : image.width]

    out = np.empty((image.height, image.width, 3), np.uint8)
    if len(planes) == 1:
        out[:] = whole(*planes[0])[:, :, None]
        return out
    # fixed values of the colour transform, by 2**16; sums fit 32 bits.  Chroma terms are computed before they are repeated
    y = (whole(*planes[0]) << 16) + (1 << 15)
    (cb, *fit_b), (cr, *fit_r) = planes[1], planes[2]
    cb, cr = cb - 128, cr - 128
    red, blue = whole(91881 * cr, *fit_r), whole(116130 * cb, *fit_b)
    green = whole(22554 * cb + 46802 * cr, *fit_b) if fit_b == fit_r else whole(22554 * cb, *fit_b) + whole(46802 * cr, *fit_r)
    for channel, value in enumerate((y + red, y - green, y + blue)):
        out[:, :, channel] = np.clip(value >> 16, 0, 255)
    return out


def payload_of(components: list[np.ndarray], size: int) -> bytes:
    """The first ``size`` bytes of a payload from the coefficients that hold them."""
    flat = np.concatenate([c.reshape(-1) for c in components])[:size]
    return VALUE_BYTE[flat.astype(np.int64) + 128].tobytes()
