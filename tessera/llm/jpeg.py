"""Progressive JPEG in numpy: coefficients to files and back, and coefficients to RGB tensors.

A file's scans are split at restart markers; each piece between two markers is a lane, and all lanes of many files are
decoded in step, one symbol of each lane at a time. Spectral-selection scans put coefficients in place, and
successive-approximation scans add a bit to those that are there already, in one array for all files of a batch.
Names in capitals follow the JPEG standard (ITU T.81), whose fixed values are stated below.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np


def zigzag_order() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((r + c, r if (r + c) % 2 else c, r * 8 + c) for r in range(8) for c in range(8)))
    return np.array([x[2] for x in cells])


ZIGZAG = zigzag_order()
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
RESTART = 2  # MCUs between restart markers in the files written here
#: Scans of the files written here: components, Ss, Se, Ah, Al.
SCRIPT = (((0, 1, 2), 0, 0, 0, 0), ((0,), 1, 5, 0, 0), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 0), ((2,), 1, 63, 0, 0), ((0,), 6, 63, 1, 0))
#: With chroma and DC in two steps too; the tests read and write it.
FULL_SCRIPT = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 1, 5, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0))
#: Code lengths of the files written here: the sizes that text takes are short, all other symbols share 10 bits.
SHORT = {0x06: 2, 0x05: 2, 0x07: 3, 0x00: 3}
AC_SYMBOLS = [0x06, 0x05, 0x07, 0x00] + [s for s in range(0xFB) if (s & 15) <= 10 and (s & 15 or s in (0x00, 0xF0)) and s not in SHORT]
DC_SYMBOLS = list(range(12))


def canonical(lengths: list[int]) -> list[int]:
    """Codes of nondecreasing lengths, in order."""
    out, code, last = [], 0, lengths[0]
    for n in lengths:
        code <<= n - last
        out.append(code)
        code, last = code + 1, n
    return out


def code_table(symbols: list[int], lengths: list[int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length of each symbol, and the DHT body (BITS, HUFFVAL)."""
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code[symbols], size[symbols] = canonical(lengths), lengths
    return code, size, bytes([lengths.count(n) for n in range(1, 17)]) + bytes(symbols)


AC_CODE, AC_SIZE, AC_DHT = code_table(AC_SYMBOLS, [SHORT.get(s, 10) for s in AC_SYMBOLS])
DC_CODE, DC_SIZE, DC_DHT = code_table(DC_SYMBOLS, [4] * len(DC_SYMBOLS))


@lru_cache(maxsize=64)
def lookup(dht: bytes) -> np.ndarray:
    """For each 16 bits to come: symbol + 256 * code length; length 0 where no code begins so."""
    out, at, code = np.zeros(1 << 16, np.int32), 16, 0
    for n in range(1, 17):
        for _ in range(dht[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = dht[at] + 256 * n
            code, at = code + 1, at + 1
        code <<= 1
    return out


@dataclass
class Scan:
    components: tuple[int, ...]
    tables: tuple[bytes, ...]  # DC tables of the components, or the AC table
    ss: int
    se: int
    ah: int
    al: int
    restart: int
    starts: np.ndarray  # bytes at which the pieces between restart markers begin
    stop: int


@dataclass
class Frame:
    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]
    quantizers: list[np.ndarray]
    scans: list[Scan] = field(default_factory=list)
    base: int = 0  # of its first block among all blocks of a batch


@lru_cache(maxsize=512)
def layout(width: int, height: int, sampling: tuple[tuple[int, int], ...]) -> list[tuple[int, int, int]]:
    """First block, rows and columns of blocks of each component, padded to whole MCUs; last: the number of blocks."""
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    across, down, at, out = -(-width // (8 * h)), -(-height // (8 * v)), 0, []
    for x, y in sampling:
        out.append((at, down * y, across * x))
        at += down * y * across * x
    return [*out, (at, 0, 0)]


@lru_cache(maxsize=512)
def scan_order(width: int, height: int, sampling: tuple[tuple[int, int], ...], components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks in the order of a scan, which of the scan's components each is of, and blocks to an MCU."""
    places = layout(width, height, sampling)
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    if len(components) == 1:  # only the blocks that hold samples, row by row
        c = components[0]
        at, _, columns = places[c]
        rows, across = -(-(-(-height * sampling[c][1] // v)) // 8), -(-(-(-width * sampling[c][0] // h)) // 8)
        blocks = at + np.arange(rows)[:, None] * columns + np.arange(across)
        return blocks.ravel(), np.zeros(blocks.size, np.int64), 1
    across, down, parts, owner = -(-width // (8 * h)), -(-height // (8 * v)), [], []
    row, column = np.divmod(np.arange(across * down), across)
    for i, c in enumerate(components):
        x, y = sampling[c]
        for dy in range(y):
            for dx in range(x):
                parts.append(places[c][0] + (row * y + dy) * places[c][2] + column * x + dx)
                owner.append(np.full(len(row), i))
    return np.stack(parts, 1).ravel(), np.stack(owner, 1).ravel(), len(parts)


@lru_cache(maxsize=2048)
def dealt(width: int, height: int, sampling: tuple[tuple[int, int], ...], components: tuple[int, ...], restart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """scan_order, and the lane of each block, the first block of each lane and how many each has."""
    order, owner, each = scan_order(width, height, sampling, components)
    step = (restart or len(order)) * each
    first = np.arange(0, len(order), step)
    return order, owner, np.arange(len(order)) // step, first, np.minimum(step, len(order) - first)


# ---------------------------------------------------------------- reading


def parse(data: bytes) -> Frame:
    """Headers and places of the scans of a progressive file."""
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0) & (raw[1:] != 255))
    codes = raw[marks + 1]
    hard = np.flatnonzero((codes < 0xD0) | (codes > 0xD7))
    hard_at = marks[hard].tolist()
    tables: dict[tuple[int, int], bytes] = {}
    quantizers: dict[int, np.ndarray] = {}
    frame, ids, quantizer_of, restart, at = None, [], [], 0, 2
    word = lambda i: data[i] << 8 | data[i + 1]
    while True:
        code, size = data[at + 1], 0 if data[at + 1] == 0xD9 else word(at + 2)
        body, end = at + 4, at + 2 + size
        if code == 0xD9:
            break
        if code == 0xC4:
            while body < end:
                n = sum(data[body + 1 : body + 17])
                tables[data[body] >> 4, data[body] & 15] = data[body + 1 : body + 17 + n]
                body += 17 + n
        elif code == 0xDB:
            while body < end:
                wide = data[body] >> 4
                quantizers[data[body] & 15] = np.frombuffer(data, ">u2" if wide else np.uint8, 64, body + 1).astype(np.float64)
                body += 65 + 64 * wide
        elif code == 0xDD:
            restart = word(body)
        elif code == 0xC2:
            n = data[body + 5]
            ids = [data[body + 6 + 3 * i] for i in range(n)]
            quantizer_of = [data[body + 8 + 3 * i] for i in range(n)]
            frame = Frame(word(body + 3), word(body + 1), tuple((data[body + 7 + 3 * i] >> 4, data[body + 7 + 3 * i] & 15) for i in range(n)), [])
        elif code in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive file")
        if code != 0xDA:
            at = end
            continue
        n = data[body]
        parts = tuple(ids.index(data[body + 1 + 2 * i]) for i in range(n))
        which = [data[body + 2 + 2 * i] for i in range(n)]
        ss, se, approx = data[body + 1 + 2 * n], data[body + 2 + 2 * n], data[body + 3 + 2 * n]
        used = tuple(tables.get((0, w >> 4), b"") for w in which) if ss == 0 else (tables.get((1, which[0] & 15), b""),)
        place, stop = int(np.searchsorted(marks, end)), int(hard[bisect_left(hard_at, end)])  # the first that is no restart
        starts = marks[place - 1 : stop] + 2
        starts[0] = end
        at = int(marks[stop])
        frame.scans.append(Scan(parts, used, ss, se, approx >> 4, approx & 15, restart, starts, at))
    frame.quantizers = [quantizers[q] for q in quantizer_of]
    return frame


def extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value of size bits as the standard codes it."""
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits) * (size > 0)


class Lanes:
    """The pieces of one scan of several files, as one run of bits without stuffing and markers."""

    def __init__(self, files: list[bytes], frames: list[Frame], scans: list[Scan]):
        raw, starts, sizes, orders, owners, firsts, tables, lane_table = [], [], [], [], [], [], [], []
        known: dict[tuple[bytes, ...], int] = {}
        byte, block = 0, 0
        for data, frame, scan in zip(files, frames, scans, strict=True):
            a, b = int(scan.starts[0]), scan.stop
            raw.append(np.frombuffer(data, np.uint8, b - a, a))
            starts.append(scan.starts - (a - byte))
            byte += b - a
            order, owner, _, first, size = dealt(frame.width, frame.height, frame.sampling, scan.components, scan.restart)
            if len(first) != len(scan.starts):
                raise ValueError("restart markers are missing")
            firsts.append(first + block)
            sizes.append(size)
            orders.append(order + frame.base)
            owners.append(owner)
            block += len(order)
            number = known.setdefault(scan.tables, len(known))
            lane_table.append(np.full(len(scan.starts), number))
        run = np.concatenate(raw)
        keep = np.ones(len(run), bool)
        after = np.flatnonzero(run[:-1] == 255) + 1
        keep[after[run[after] == 0]] = False
        mark = after[(run[after] >= 0xD0) & (run[after] <= 0xD7)]
        keep[mark] = keep[mark - 1] = False
        moved = np.concatenate([[0], np.cumsum(keep)])
        self.at = moved[np.concatenate(starts)] * 8  # bit
        self.bytes = np.concatenate([run[keep], np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(self.bytes) - 8,), ">u8", buffer=self.bytes, strides=(1,))  # 8 bytes from each one on
        self.first, self.stop = np.concatenate(firsts), np.concatenate(firsts) + np.concatenate(sizes)
        self.order, self.owner = np.concatenate(orders), np.concatenate(owners)
        self.table = np.concatenate(lane_table)
        self.tables = list(known)

    def ahead(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each place on, at the top of a word."""
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1


def top(word: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits of each word after the first skip ones; n may be 0."""
    return ((word << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def read_dc_first(lanes: Lanes, out: np.ndarray, al: int) -> None:
    stack = np.stack([lookup(t) for group in lanes.tables for t in group])
    width = len(lanes.tables[0])
    at, block, stop, table = lanes.at.copy(), lanes.first.copy(), lanes.stop, lanes.table * width
    last = np.zeros((len(at), width), np.int64)
    live = np.flatnonzero(block < stop)
    while len(live):
        b, p, c = block[live], at[live], lanes.owner[block[live]]
        word = lanes.ahead(p)
        got = stack[table[live] + c, (word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        size, used = got & 255, got >> 8
        last[live, c] += extended(top(word, used, size), size)
        out[lanes.order[b], 0] = last[live, c] << al
        at[live] = p + used + size
        block[live] = b + 1
        live = live[b + 1 < stop[live]]


def read_dc_refine(lanes: Lanes, out: np.ndarray, al: int) -> None:
    size = lanes.stop - lanes.first
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    bit = lanes.bit(np.repeat(lanes.at, size) + within).astype(out.dtype)
    blocks = lanes.order[np.repeat(lanes.first, size) + within]
    out[blocks, 0] |= bit << al


def read_ac_first(lanes: Lanes, out: np.ndarray, ss: int, se: int, al: int) -> None:
    stack = np.concatenate([lookup(t) for (t,) in lanes.tables])
    flat = out.reshape(-1)
    some = np.flatnonzero(lanes.first < lanes.stop)
    at, block, stop, table = lanes.at[some], lanes.first[some], lanes.stop[some], (lanes.table[some] << 16)
    k = np.full(len(at), ss, np.int64)
    while len(at):
        word = lanes.ahead(at)
        got = stack[table + (word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        used, run, size = got >> 8, (got >> 4) & 15, got & 15
        ends = (size == 0) & (run < 15)
        extra = np.where(ends, run, size)
        bits = top(word, used, extra)
        place = k + run
        value = size > 0
        flat[lanes.order[block[value]] * 64 + place[value]] = extended(bits[value], size[value]) << al
        at = at + used + extra
        k = np.where(ends, 64, place + 1)
        over = k > se
        block = block + np.where(ends, (1 << run) + bits, over)
        k = np.where(over, ss, k)
        if (block >= stop).any():
            on = block < stop
            at, block, stop, table, k = at[on], block[on], stop[on], table[on], k[on]


def read_ac_refine(lanes: Lanes, out: np.ndarray, ss: int, se: int, al: int) -> None:
    stack = np.concatenate([lookup(t) for (t,) in lanes.tables])
    width = se - ss + 1
    there = out[lanes.order, ss : se + 1] != 0
    zeros_before = np.concatenate([np.zeros((len(there), 1), np.int16), np.cumsum(~there, axis=1, dtype=np.int16)], axis=1)
    zero_place = np.argsort(there, axis=1, kind="stable").astype(np.int16)
    some = np.flatnonzero(lanes.first < lanes.stop)
    at, block, stop, table = lanes.at[some], lanes.first[some], lanes.stop[some], (lanes.table[some] << 16)
    k, idle = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)  # idle: blocks left of an end-of-band run
    spans: list[tuple[np.ndarray, ...]] = []
    fresh: list[tuple[np.ndarray, ...]] = []
    while len(at):
        word = lanes.ahead(at)
        got = stack[table + (word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        used, run, size = got >> 8, (got >> 4) & 15, got & 15
        inside = idle > 0
        used, run, size = np.where(inside, 0, used), np.where(inside, 0, run), np.where(inside, 0, size)
        ends = inside | ((size == 0) & (run < 15))
        idle = np.where(inside, idle - 1, np.where(ends, (1 << run) + top(word, used, run) - 1, 0))
        # The run counts coefficients that were 0 before; those between them take a bit each.
        zero = np.minimum(zeros_before[block, k] + run, width - 1)
        place = np.where(ends, width, zero_place[block, zero])
        bits_at = at + used + np.where(ends, run, size)
        corrected = place - k - (zeros_before[block, place] - zeros_before[block, k])
        spans.append((block, k, place, bits_at))
        new = size > 0
        if new.any():
            fresh.append((block[new], place[new], np.where(lanes.bit((at + used)[new]) == 1, 1, -1) << al))
        at = bits_at + corrected
        k = place + 1
        over = k >= width
        block, k = block + over, np.where(over, 0, k)
        if (block >= stop).any():
            on = block < stop
            at, block, stop, table, k, idle = at[on], block[on], stop[on], table[on], k[on], idle[on]
    if spans:
        block, start, end, bits_at = (np.concatenate(x) for x in zip(*spans, strict=True))
        size = end - start
        which = np.repeat(np.arange(len(size)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[which]
        b = block[which]
        held = there[b, place]
        which, place, b = which[held], place[held], b[held]
        passed = (place - start[which]) - (zeros_before[b, place] - zeros_before[b, start[which]])
        bit = lanes.bit(bits_at[which] + passed) == 1
        row, column = lanes.order[b[bit]], place[bit] + ss
        out[row, column] += np.sign(out[row, column]) << al
    for b, place, value in fresh:
        out[lanes.order[b], place + ss] = value


def decode(files: list[bytes]) -> tuple[list[Frame], np.ndarray]:
    """The frames of progressive files and all their coefficients: blocks x 64, in zigzag order."""
    frames, total = [parse(x) for x in files], 0
    for frame in frames:
        frame.base = total
        total += layout(frame.width, frame.height, frame.sampling)[-1][0]
    out = np.zeros((total, 64), np.int16)
    for number in range(max((len(f.scans) for f in frames), default=0)):
        alike: dict[tuple, list[int]] = {}
        for i, frame in enumerate(frames):
            if number < len(frame.scans):
                s = frame.scans[number]
                alike.setdefault((s.ss, s.se, s.ah, s.al, len(s.components)), []).append(i)
        for (ss, se, ah, al, _), members in alike.items():
            lanes = Lanes([files[i] for i in members], [frames[i] for i in members], [frames[i].scans[number] for i in members])
            if ss == 0:
                (read_dc_refine if ah else read_dc_first)(lanes, out, al)
            else:
                (read_ac_refine if ah else read_ac_first)(lanes, out, ss, se, al)
    return frames, out


def samples(frame: Frame, coefficients: np.ndarray) -> np.ndarray:
    """height x width x 3 bytes of RGB: inverse transform, chroma brought to full resolution, colour conversion."""
    planes, h, v = [], max(s[0] for s in frame.sampling), max(s[1] for s in frame.sampling)
    places = layout(frame.width, frame.height, frame.sampling)
    for (at, rows, columns), (x, y), q in zip(places[:-1], frame.sampling, frame.quantizers, strict=True):
        block = np.zeros((rows * columns, 64))
        block[:, ZIGZAG] = coefficients[frame.base + at : frame.base + at + rows * columns] * q
        half = (block.reshape(-1, 8) @ COSINES).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ COSINES
        # A little over one half, so that values on the edge round alike whatever the order of the sums.
        plane = np.clip(np.floor(half + (128.5 + 1e-6)), 0, 255).reshape(rows, columns, 8, 8).transpose(0, 3, 1, 2).reshape(rows * 8, columns * 8)
        planes.append(np.repeat(np.repeat(plane, v // y, axis=0), h // x, axis=1)[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    luma, blue, red = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([luma + 1.402 * red, luma - 0.344136 * blue - 0.714136 * red, luma + 1.772 * blue], axis=2)
    return np.clip(np.floor(rgb + (0.5 + 1e-6)), 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- writing


def pack_bits(value: np.ndarray, size: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of bit strings written one after another, each lane begun on a byte and ended with ones; lanes' starts."""
    bits = np.bincount(lane, weights=size, minlength=lanes).astype(np.int64)
    full = (bits + 7) >> 3
    start = np.concatenate([[0], np.cumsum(full)])
    before = np.cumsum(size) - size
    head = np.concatenate([[0], np.cumsum(bits)])[:-1]
    at = start[lane] * 8 + before - head[lane]
    place, off = at >> 6, at & 63
    over = off + size - 64  # bits that go to the next word
    value = value.astype(np.uint64)
    here = np.where(over > 0, value >> np.maximum(over, 0).astype(np.uint64), value << np.maximum(-over, 0).astype(np.uint64))
    words = np.zeros((start[-1] >> 3) + 2, np.uint64)
    if len(place):
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        words[place[heads]] = np.bitwise_or.reduceat(here, heads)
        spill = np.flatnonzero(over > 0)  # one to a word at most
        words[place[spill] + 1] |= value[spill] << (64 - over[spill]).astype(np.uint64)
    out = words.astype(">u8").view(np.uint8)[: start[-1]].copy()
    out[start[1:][full > 0] - 1] |= ((1 << (full * 8 - bits)[full > 0]) - 1).astype(np.uint8)
    return out, start


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def coded_ac_first(c: np.ndarray, al: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, sizes and blocks of a spectral band (blocks x width) at precision al."""
    v = np.sign(c) * (np.abs(c) >> al)
    block, place = np.nonzero(v)
    x = v[block, place].astype(np.int64)
    first = np.ones(len(block), bool)
    first[1:] = block[1:] != block[:-1]
    run = place - np.where(first, -1, np.concatenate([[0], place[:-1]])) - 1
    size = bit_length(np.abs(x))
    symbol = ((run & 15) << 4) | size
    code = (AC_CODE[symbol] << size) | np.where(x < 0, x + (1 << size) - 1, x)
    length = AC_SIZE[symbol] + size
    key = block * 256 + place * 2 + 1
    long = run >> 4
    if long.any():
        again = np.repeat(np.arange(len(run)), long)
        key, code, length = np.concatenate([key, key[again] - 1]), np.concatenate([code, np.full(len(again), AC_CODE[0xF0])]), np.concatenate([length, np.full(len(again), AC_SIZE[0xF0])])
    open_ended = np.flatnonzero(v[:, -1] == 0)
    key, code, length = np.concatenate([key, open_ended * 256 + 255]), np.concatenate([code, np.full(len(open_ended), AC_CODE[0])]), np.concatenate([length, np.full(len(open_ended), AC_SIZE[0])])
    order = np.argsort(key, kind="stable")
    return code[order], length[order], key[order] >> 8


def coded_ac_refine(c: np.ndarray, al: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, sizes and blocks of a band's next bit."""
    magnitude = np.abs(c) >> al
    old, new = magnitude > 1, magnitude == 1
    odd = new.any(axis=1)
    # Without new coefficients a block is its end-of-band code, if any coefficient is 0 or corrected, and the bits.
    block, place = np.nonzero(old & ~odd[:, None])
    plain = np.flatnonzero(~odd)
    key = [plain * 4096, block * 4096 + 1 + place]
    code = [np.full(len(plain), AC_CODE[0]), magnitude[block, place] & 1]
    length = [np.full(len(plain), AC_SIZE[0]), np.ones(len(block), np.int64)]
    for b in np.flatnonzero(odd):
        n, run, waiting, last = 0, 0, [], int(np.flatnonzero(new[b])[-1])
        rows: list[tuple[int, int]] = []
        for i, m in enumerate(magnitude[b].tolist()):
            if m == 0:
                run += 1
                continue
            while run > 15 and i <= last:
                rows.append((int(AC_CODE[0xF0]), int(AC_SIZE[0xF0])))
                rows += waiting
                waiting, run = [], run - 16
            if m > 1:
                waiting.append((m & 1, 1))
            else:
                rows.append((int(AC_CODE[run << 4 | 1]) << 1 | int(c[b, i] > 0), int(AC_SIZE[run << 4 | 1]) + 1))
                rows += waiting
                waiting, run = [], 0
        if run or waiting:
            rows.append((int(AC_CODE[0]), int(AC_SIZE[0])))
            rows += waiting
        n = len(rows)
        key.append(b * 4096 + np.arange(n))
        code.append(np.array([r[0] for r in rows], np.int64))
        length.append(np.array([r[1] for r in rows], np.int64))
    keys = np.concatenate(key)
    order = np.argsort(keys, kind="stable")
    return np.concatenate(code)[order], np.concatenate(length)[order], keys[order] >> 12


def coded_dc(values: np.ndarray, owner: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and sizes of differences to the value before of the same lane and component."""
    order = np.lexsort((np.arange(len(values)), owner, lane))
    v, group = values[order], lane[order] * 8 + owner[order]
    before = np.concatenate([[0], v[:-1]])
    before[np.concatenate([[True], group[1:] != group[:-1]])] = 0
    diff = np.empty(len(v), np.int64)
    diff[order] = v - before
    size = bit_length(np.abs(diff))
    return (DC_CODE[size] << size) | np.where(diff < 0, diff + (1 << size) - 1, diff), DC_SIZE[size] + size


def stuffed(run: np.ndarray, start: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run with 0 after each 255 and a restart marker after each lane that isn't a scan's last; lanes' ends."""
    full = run == 255
    lane_bytes = np.diff(start)
    place = np.arange(len(run)) + (np.cumsum(full) - full) + 2 * np.repeat(np.cumsum(~last) - ~last, lane_bytes)
    ends = start[1:] + np.concatenate([[0], np.cumsum(full)])[start[1:]] + 2 * np.cumsum(~last)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    out[place] = run
    marked = ends[~last]
    out[marked - 2] = 255
    out[marked - 1] = 0xD0 + number[~last] % 8
    return out, ends


SAMPLING = ((2, 2), (1, 1), (1, 1))


def dimensions(blocks: int) -> tuple[int, int]:
    """Width and height, in samples, of a picture of 4:2:0 that has so many blocks or a few more."""
    mcus = max(1, -(-blocks // 6))
    down = max(-(-mcus // 4095), min(4095, round(mcus / 64))) or 1
    return -(-mcus // down) * 16, down * 16


def encode(blocks: list[np.ndarray], script=SCRIPT, restart: int = RESTART) -> list[bytes]:
    """A progressive file of each array of coefficients (blocks x 64, zigzag order, -1023 to 1023).

    Blocks fill the luma component row by row, then the two chroma components; the rest of the picture is 0.
    """
    sizes = [dimensions(len(b)) for b in blocks]
    total, bases = 0, []
    for w, h in sizes:
        bases.append(total)
        total += layout(w, h, SAMPLING)[-1][0]
    c = np.zeros((total, 64), np.int16)
    for base, b in zip(bases, blocks, strict=True):
        c[base : base + len(b)] = b
    body: list[list[bytes]] = [[] for _ in blocks]
    for components, ss, se, ah, al in script:
        orders, owners, lanes, starts, stops, lane_count = [], [], [], [], [], 0
        for base, (w, h) in zip(bases, sizes, strict=True):
            order, owner, lane, first, _ = dealt(w, h, SAMPLING, components, restart)
            orders.append(order + base)
            owners.append(owner)
            lanes.append(lane + lane_count)
            starts.append(lane_count)
            lane_count += len(first)
            stops.append(lane_count)
        order, owner, lane = np.concatenate(orders), np.concatenate(owners), np.concatenate(lanes)
        if ss == 0 and ah == 0:
            code, length = coded_dc(c[order, 0].astype(np.int64) >> al, owner, lane)
        elif ss == 0:
            code, length = (c[order, 0].astype(np.int64) >> al) & 1, np.ones(len(order), np.int64)
        else:
            code, length, of = (coded_ac_refine if ah else coded_ac_first)(c[order, ss : se + 1].astype(np.int32), al)
            lane = lane[of]
        run, start = pack_bits(code, length, lane, lane_count)
        last = np.zeros(lane_count, bool)
        last[np.array(stops) - 1] = True
        data, ends = stuffed(run, start, np.arange(lane_count) - np.repeat(starts, np.diff([*starts, lane_count])), last)
        head = bytes([255, 0xDA]) + (6 + 2 * len(components)).to_bytes(2, "big") + bytes([len(components)]) + b"".join(bytes([x + 1, 0]) for x in components) + bytes([ss, se, ah << 4 | al])
        packed, at = data.tobytes(), 0
        for out, stop in zip(body, stops, strict=True):
            out.append(head + packed[at : ends[stop - 1]])
            at = ends[stop - 1]
    common = (
        b"\xff\xd8"
        + b"\xff\xdb" + (67).to_bytes(2, "big") + b"\x00" + b"\x01" * 64
        + b"\xff\xc4" + (3 + len(DC_DHT)).to_bytes(2, "big") + b"\x00" + DC_DHT
        + b"\xff\xc4" + (3 + len(AC_DHT)).to_bytes(2, "big") + b"\x10" + AC_DHT
        + b"\xff\xdd\x00\x04" + restart.to_bytes(2, "big")
    )
    out = []
    for (w, h), scans in zip(sizes, body, strict=True):
        frame = b"\xff\xc2\x00\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03" + b"".join(bytes([i + 1, x << 4 | y, 0]) for i, (x, y) in enumerate(SAMPLING))
        out.append(common + frame + b"".join(scans) + b"\xff\xd9")
    return out
