"""Progressive JPEG in numpy: coefficients by scans, inverse transform, chroma upsampling (operator 6).

`decode_coefficients` takes any progressive Huffman JPEG with 8-bit samples, symbol by symbol through a table of 16-bit
prefixes, by the rules of ITU-T T.81, annexes F and G. `decode_many` reads many pictures at once: the stretches between
restart markers of one scan of all pictures are lanes that advance together, a symbol of every lane a step.

`store_many` writes bytes losslessly as coefficients: a blank is 0, any other byte a coefficient of magnitude 2 to 129. Bands 1
to 5 and 6 to 48 of a block carry them (spectral selection, for luma); a first pass leaves out their lowest bit and a
refining pass brings it (successive approximation). Runs of zeros, sizes and bits are Huffman-coded. Twelve blocks of 48 coefficients are a
unit of 576 bytes: two 4:2:0 macroblocks.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.bulk import slices, string_column

UNIT, USED, FILL = 576, 48, 255
#: Rows of macroblocks that fit into the format's 16-bit height.
MOST_ROWS = 4095


@functools.cache
def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block (row by row) of the k-th coefficient of a scan."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


@functools.cache
def cosines() -> np.ndarray:
    k, x = np.mgrid[0:8, 0:8]
    return (np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)).astype(np.float32)


def stuff(raw: np.ndarray) -> np.ndarray:
    """A zero after each 255, as entropy-coded data has it."""
    at = np.flatnonzero(raw == 255)
    return np.insert(raw, at + 1, 0) if len(at) else raw


def unstuff(raw: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(raw[:-1] == 255)
    return np.delete(raw, at + 1) if len(at) else raw


def part(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def code_lengths(weights: dict[int, float]) -> dict[int, int]:
    """Lengths of a Huffman code, with one more leaf so that no code is all ones."""
    heap = [(w, i, (symbol,)) for i, (symbol, w) in enumerate(weights.items())] + [(0.0, -1, (None,))]
    heapq.heapify(heap)
    lengths, n = dict.fromkeys([*weights, None], 0), len(heap)
    while len(heap) > 1:
        (u, _, x), (v, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for symbol in x + y:
            lengths[symbol] += 1
        n += 1
        heapq.heappush(heap, (u + v, n, x + y))
    # the leaf without a symbol is one of the longest, and comes last
    del lengths[None]
    return lengths


class Table:
    """A Huffman table from its lengths: codes to write, prefixes to read, and its bytes."""

    def __init__(self, lengths: dict[int, int]):
        self.code, self.length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        order = sorted(lengths, key=lambda k: (lengths[k], k))
        code = before = 0
        for symbol in order:
            code <<= lengths[symbol] - before
            before = lengths[symbol]
            self.code[symbol], self.length[symbol] = code, before
            code += 1
        counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
        self.body = bytes(counts) + bytes(order)

    @staticmethod
    @functools.cache
    def prefixes(body: bytes) -> np.ndarray:
        """For each 16 bits the length of the code that they begin with, times 256, and its symbol; 0 without any."""
        table, code, place = np.zeros(1 << 16, np.int64), 0, 16
        for n, count in enumerate(body[:16], 1):
            for _ in range(count):
                table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | body[place]
                code, place = code + 1, place + 1
            code <<= 1
        return table


@functools.cache
def first_table() -> Table:
    """For first passes: short runs and middling sizes are the most common; ends and runs of sixteen are rarer."""
    weights = {r << 4 | n: 0.7**r * (0.1 + (n >= 4)) for r in range(16) for n in range(1, 8)}
    return Table(code_lengths({**weights, 0x00: 0.5, 0xF0: 0.01}))


@functools.cache
def runs_table() -> Table:
    """For refining passes in which no coefficient is new: runs of blocks that end."""
    return Table({r << 4: min(r + 1, 15) for r in range(15)})


# --- writing ---------------------------------------------------------------------------------------------


def layout(n_units: int) -> tuple[int, int]:
    """Macroblock pairs across and macroblock rows down."""
    across = max(1, -(-n_units // MOST_ROWS))
    return across, -(-n_units // across)


def scan(components: list[tuple[int, int]], first: int, last: int, high: int, low: int, data: np.ndarray) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c, t]) for c, t in components) + bytes([first, last, high << 4 | low])
    return part(0xDA, body) + stuff(data).tobytes()


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)]))


#: Blocks between restart markers of scans that carry data.
RESTART = 4
#: First passes: component, band.
BANDS = ((0, 1, 5), (1, 1, USED), (2, 1, USED), (0, 6, USED))


@functools.cache
def byte_values() -> np.ndarray:
    """The coefficient of each byte: 0 for a blank, magnitudes from 2 on for the rest, positive and negative in turn."""
    at = (np.arange(256) - 33) % 256
    return np.where(np.arange(256) == 32, 0, (at // 2 + 2) * (1 - 2 * (at % 2))).astype(np.int32)


@functools.cache
def value_bytes() -> np.ndarray:
    """The byte of each coefficient, from -129 on."""
    out = np.zeros(259, np.uint8)
    out[byte_values() + 129] = np.arange(256)
    return out


def laid_out(values: np.ndarray, lengths: np.ndarray, run: np.ndarray, n_runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of all items in order, each run filled up with ones to whole bytes: the bytes, and where each run begins."""
    total = np.bincount(run, lengths, n_runs).astype(np.int64)
    size = -(-total // 8)
    begin = np.concatenate([[0], np.cumsum(size)])
    upto = np.cumsum(lengths) - lengths
    at = upto - (np.cumsum(total) - total)[run] + 8 * begin[run]
    words = np.zeros(int(begin[-1] // 4 + 2), np.uint32)

    def put(values: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> None:
        """Items in order of place; one lies in one or two words of 32 bits, and the items that begin in a word are put together."""
        if not len(at):
            return
        word = at >> 5
        wide = values.astype(np.uint64) << (64 - (at & 31) - lengths).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        both = np.bitwise_or.reduceat(wide, first)
        words[word[first]] |= (both >> np.uint64(32)).astype(np.uint32)
        words[word[first] + 1] |= both.astype(np.uint32)

    put(values, lengths, at)
    pad = 8 * size - total
    some = np.flatnonzero(pad)
    put((1 << pad[some]) - 1, pad[some], 8 * begin[some] + total[some])
    return words.astype(">u4").view(np.uint8)[: begin[-1]], begin


@functools.cache
def coded_bytes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte's coefficient the size and the extra bits of its first pass, and its lowest bit."""
    value = byte_values()
    half = np.sign(value) * (np.abs(value) >> 1)
    size = np.array([int(abs(h)).bit_length() for h in half])
    return size.astype(np.int32), np.where(half > 0, half, half + (1 << size) - 1).astype(np.int32), (np.abs(value) & 1).astype(np.int32)


def first_pass(plane: np.ndarray, run: np.ndarray, n_runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded blocks (rows of bytes), whose runs between restart markers are numbered by ``run``."""
    table, width = first_table(), plane.shape[1]
    sizes, extras, _ = coded_bytes()
    plane = np.ascontiguousarray(plane)
    place = np.flatnonzero(plane.ravel() != 32).astype(np.int32)
    byte = plane.ravel()[place]
    block = place // width
    k = place - block * width
    size = sizes[byte]
    gap = np.diff(place, prepend=np.int32(-1)) - 1
    opens = np.ones(len(block), bool)
    opens[1:] = block[1:] != block[:-1]
    gap[opens] = k[opens]
    symbol = (gap & 15) << 4 | size
    last = np.full(len(plane), -1, np.int32)
    last[block] = k
    ends = last < width - 1
    # every item's place: coefficients in order, each after its runs of sixteen, and a block's end after its coefficients
    runs = gap >> 4
    upto_runs, upto_ends = np.cumsum(runs), np.cumsum(ends)
    at = np.arange(len(k)) + upto_runs + (upto_ends - ends)[block]
    through = np.searchsorted(block, np.flatnonzero(ends), side="right")
    ends_at = through + np.concatenate([[0], upto_runs])[through] + upto_ends[ends] - 1
    n = len(k) + int(runs.sum()) + int(ends.sum())
    items, lengths, owner = np.full(n, table.code[0xF0]), np.full(n, table.length[0xF0]), np.empty(n, np.int64)
    items[at], lengths[at], owner[at] = table.code[symbol] << size | extras[byte], table.length[symbol] + size, block
    items[ends_at], lengths[ends_at], owner[ends_at] = table.code[0], table.length[0], np.flatnonzero(ends)
    long = np.flatnonzero(runs)
    for back in range(1, 1 + int(runs.max(initial=0))):
        some = long[runs[long] >= back]
        owner[at[some] - back] = block[some]
    return laid_out(items, lengths, run[owner], n_runs)


def refining_pass(plane: np.ndarray, run: np.ndarray, n_runs: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest bits of all coefficients that are not 0: for each run of blocks one end-of-band code, then the bits."""
    table, blocks = runs_table(), np.bincount(run, minlength=n_runs)
    kind = np.floor(np.log2(blocks)).astype(np.int64)
    head, width = table.code[kind << 4] << kind | (blocks - (1 << kind)), table.length[kind << 4] + kind
    place = np.flatnonzero(plane.ravel() != 32)
    own, low = run[place // plane.shape[1]], coded_bytes()[2][plane.ravel()[place]]
    n = n_runs + len(place)
    heads = np.searchsorted(own, np.arange(n_runs)) + np.arange(n_runs)
    items, lengths, of = np.empty(n, np.int64), np.ones(n, np.int64), np.empty(n, np.int64)
    at = np.arange(len(place)) + own + 1
    items[at], of[at] = low, own
    items[heads], lengths[heads], of[heads] = head, width, np.arange(n_runs)
    return laid_out(items, lengths, of, n_runs)


def marked(raw: np.ndarray, begin: np.ndarray, firsts: np.ndarray) -> list[bytes]:
    """Each picture's scan data: zeros after 255, and restart markers before all its runs but the first (numbers ``firsts``)."""
    n = len(begin) - 1
    own = np.searchsorted(firsts, np.arange(n), side="right") - 1
    later = np.flatnonzero(np.arange(n) != firsts[own])
    number = (later - firsts[own[later]] - 1) % 8
    full = np.flatnonzero(raw == 255) + 1
    places = np.concatenate([full, np.repeat(begin[later], 2)])
    out = np.insert(raw, places, np.concatenate([np.zeros(len(full), np.uint8), np.stack([np.full(len(later), 255), 0xD0 + number], 1).ravel()]).astype(np.uint8))
    starts = begin[firsts] + np.searchsorted(np.sort(places), begin[firsts], side="right")
    ends = np.append(starts[1:], len(out))
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def runs_of(blocks: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """The run between restart markers of every block of pictures with so many ``blocks``, the runs' number, and each picture's first."""
    runs = -(-blocks // RESTART)
    firsts = np.cumsum(runs) - runs
    inside = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.repeat(firsts, blocks) + inside // RESTART, int(runs.sum()), firsts


def store_many(payloads: list[tuple[np.ndarray, int]]) -> list[bytes]:
    """A progressive JPEG for each payload (whole units, true length); the comment keeps the true length."""
    if not payloads:
        return []
    shapes = [layout(len(p) // UNIT) for p, _ in payloads]
    units = np.array([a * d for a, d in shapes])
    values = np.full(int(units.sum()) * UNIT, FILL, np.uint8)
    cuts = np.cumsum(units) - units
    planes_ = [[], [], []]
    for (p, _), at, n in zip(payloads, cuts.tolist(), units.tolist()):
        own = values[at * UNIT : (at + n) * UNIT]
        own[: len(p)] = p
        for c, (a, b) in enumerate(((0, 384), (384, 480), (480, 576))):
            planes_[c].append(own[a * n : b * n])
    planes_ = [np.concatenate(p).reshape(-1, USED) for p in planes_]
    blocks = [8 * units, 2 * units, 2 * units]
    runs = [runs_of(b) for b in blocks]
    coded = []
    for c, first, last in BANDS:
        run, n, firsts = runs[c]
        coded.append((scan_head(c, first, last, 0, 1), marked(*first_pass(planes_[c][:, first - 1 : last], run, n), firsts)))
    for c in range(3):
        run, n, firsts = runs[c]
        coded.append((scan_head(c, 1, USED, 1, 0), marked(*refining_pass(planes_[c], run, n), firsts)))
    dc_table, ac, refining = part(0xC4, bytes([0, 1, *[0] * 15, 0])), part(0xC4, bytes([0x10]) + first_table().body), part(0xC4, bytes([0x10]) + runs_table().body)
    out = []
    for i, ((payload, n_bytes), (across, down)) in enumerate(zip(payloads, shapes)):
        parts = [
            b"\xff\xd8", part(0xFE, b"units %d bytes %d" % (len(payload) // UNIT, n_bytes)), part(0xDB, bytes([0]) + bytes([1] * 64)),
            part(0xC2, struct.pack(">BHHB", 8, 16 * down, 32 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), dc_table,
            scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 0, packed(np.zeros(12 * across * down, np.uint8))), part(0xDD, struct.pack(">H", RESTART)), ac,
        ]
        for k, (head, data) in enumerate(coded):
            if k == len(BANDS):
                parts.append(refining)
            parts += [head, data[i]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def scan_head(c: int, first: int, last: int, high: int, low: int) -> bytes:
    return part(0xDA, bytes([1, c + 1, 0, first, last, high << 4 | low]))


def store(payload: np.ndarray, n_bytes: int) -> bytes:
    return store_many([(payload, n_bytes)])[0]


# --- reading ---------------------------------------------------------------------------------------------


class Bits:
    """Bits of entropy-coded data, up to sixteen at a time; zeros follow its end."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.at = raw.tobytes() + bytes(8), 0
        self.last = 8 * len(raw)

    def take(self, n: int) -> int:
        window = int.from_bytes(self.raw[self.at >> 3 : (self.at >> 3) + 4], "big") if self.at < self.last else 0
        value = window >> (32 - n - (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return value

    def one(self) -> int:
        return self.take(1)

    def symbol(self, table: np.ndarray) -> int:
        found = int(table[self.take(16)])
        if not found:
            raise ValueError("no such Huffman code")
        self.at += (found >> 8) - 16
        return found & 255


def signed(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


class Component:
    def __init__(self, number: int, h: int, v: int, table: int):
        self.number, self.h, self.v, self.table = number, h, v, table

    def size(self, width: int, height: int, most_h: int, most_v: int) -> None:
        mcu_w, mcu_h = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        self.across, self.down = mcu_w * self.h, mcu_h * self.v  # blocks that are stored
        self.own_across = -(-(-(-width * self.h // most_h)) // 8)  # blocks of a scan of this component alone
        self.own_down = -(-(-(-height * self.v // most_v)) // 8)
        self.coefficients = np.zeros((0, 0, 64), np.int32)


class Image:
    width = height = 0
    comment = b""

    def __init__(self) -> None:
        self.tables: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], bytes] = {}
        self.scans: list[tuple] = []
        self.components: list[Component] = []
        self.restart = 0

    def allocate(self) -> None:
        for c in self.components:
            c.coefficients = np.zeros((c.down, c.across, 64), np.int32)


def block_order(image: Image, chosen: list[Component]) -> list[tuple[int, int, int]]:
    """(component, row, column) of each block of a scan, in order."""
    if len(chosen) == 1:
        c = chosen[0]
        return [(0, r, k) for r in range(c.own_down) for k in range(c.own_across)]
    rows, columns = chosen[0].down // chosen[0].v, chosen[0].across // chosen[0].h
    return [
        (i, y * c.v + r, x * c.h + k) for y in range(rows) for x in range(columns) for i, c in enumerate(chosen) for r in range(c.v) for k in range(c.h)
    ]


def read_scan(image: Image, chosen: list, first: int, last: int, high: int, low: int, raw: np.ndarray) -> None:
    """One scan, symbol by symbol; ``chosen`` has components with the prefixes of their DC and AC tables."""
    parts = [c for c, _, _ in chosen]
    bits, previous, run = Bits(raw), [0] * len(parts), 0
    unit = sum(c.h * c.v for c in parts) if len(parts) > 1 else 1
    for done, (i, r, k) in enumerate(block_order(image, parts)):
        if image.restart and done and done % (unit * image.restart) == 0:
            bits.at, previous, run = -(-bits.at // 8) * 8, [0] * len(parts), 0
        block = parts[i].coefficients[r, k]
        if first == 0:
            if high:
                block[0] |= bits.one() << low
            else:
                size = bits.symbol(chosen[i][1])
                previous[i] += signed(bits.take(size), size)
                block[0] = previous[i] * (1 << low)
            continue
        codes, at = chosen[i][2], first
        step = 1 << low
        if high == 0:
            if run:
                run -= 1
                continue
            while at <= last:
                symbol = bits.symbol(codes)
                zeros, size = symbol >> 4, symbol & 15
                if size:
                    at += zeros
                    block[at] = signed(bits.take(size), size) * step
                    at += 1
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros) - 1
                    break
                else:
                    at += 16
            continue
        if not run:
            while at <= last:
                symbol = bits.symbol(codes)
                zeros, new = symbol >> 4, 0
                if symbol & 15:
                    new = step if bits.one() else -step
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while at <= last:
                    if block[at]:
                        if bits.one() and not abs(block[at]) & step:
                            block[at] += step if block[at] > 0 else -step
                    elif zeros:
                        zeros -= 1
                    else:
                        if new:
                            block[at] = new
                        at += 1
                        break
                    at += 1
        if run:
            for at in range(at, last + 1):
                if block[at] and bits.one() and not abs(block[at]) & step:
                    block[at] += step if block[at] > 0 else -step
            run -= 1


SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def read_markers(data: bytes) -> Image:
    """The picture's tables, components and scans; entropy-coded data stay as they are."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, at = Image(), 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if data[at : at + 1] != b"\xff":
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        length = data[at + 2] << 8 | data[at + 3]
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDD:
            image.restart = body[0] << 8 | body[1]
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide, number = body[k] >> 4, body[k] & 15
                image.tables[number] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float32)
                k += 65 + 64 * bool(wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                end = k + 17 + sum(body[k + 1 : k + 17])
                image.codes[body[k] >> 4, body[k] & 15] = body[k + 1 : end]
                k = end
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            for c in image.components:
                c.size(image.width, image.height, max(x.h for x in image.components), max(x.v for x in image.components))
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only progressive Huffman JPEG")
        elif marker == 0xDA:
            n = body[0]
            named = {c.number: i for i, c in enumerate(image.components)}
            chosen = tuple((named[body[1 + 2 * i]], image.codes.get((0, body[2 + 2 * i] >> 4)), image.codes.get((1, body[2 + 2 * i] & 15))) for i in range(n))
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            found = SCAN_END.search(data, at)
            if not found:
                raise ValueError("a marker is missing")
            image.scans.append(((chosen, first, last, approx >> 4, approx & 15, image.restart), at, found.start()))
            at = found.start()


def decode_coefficients(data: bytes) -> Image:
    """All scans of a progressive JPEG gathered into coefficient arrays (in scan order within a block)."""
    image = read_markers(data)
    image.allocate()
    raw = np.frombuffer(data, np.uint8)
    for (chosen, first, last, high, low, restart), a, b in image.scans:
        coded = raw[a:b]
        if restart:
            keep = np.ones(len(coded), bool)
            for m in np.flatnonzero((coded[:-1] == 255) & (coded[1:] >= 0xD0) & (coded[1:] <= 0xD7)):
                keep[m : m + 2] = False
            coded = coded[keep]
        image.restart = restart
        table = lambda body: None if body is None else Table.prefixes(body)
        read_scan(image, [(image.components[i], table(dc), table(ac)) for i, dc, ac in chosen], first, last, high, low, unstuff(coded))
    return image


class Lanes:
    """The stretches between restart markers of one scan of many pictures, side by side."""

    def __init__(self, pieces: list[bytes], blocks: np.ndarray, restart: int):
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        edge = np.cumsum([0, *map(len, pieces)])
        full = np.flatnonzero(raw[:-1] == 255)
        after = raw[full + 1]
        marks = full[(after >= 0xD0) & (after <= 0xD7)]
        keep = np.ones(len(raw), bool)
        keep[full[after == 0] + 1] = False
        keep[marks] = keep[marks + 1] = False
        place = np.concatenate([[0], np.cumsum(keep)])
        self.at = 8 * place[np.sort(np.concatenate([edge[:-1], marks + 2]))]
        clean = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.int64)
        self.words = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
        runs = -(-blocks // restart)
        self.sound = len(self.at) == runs.sum()
        begin = np.repeat(np.cumsum(blocks) - blocks, runs)
        inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        self.first = begin + inside * restart
        self.count = np.minimum(restart, np.repeat(blocks, runs) - inside * restart)

    def bits(self, at: np.ndarray, n) -> np.ndarray:
        """``n`` bits (up to 25) at each place."""
        return self.words.take(at >> 3, mode="clip") >> (32 - n - (at & 7)) & ((1 << n) - 1)

    def first_pass(self, out: np.ndarray, low: int, table: np.ndarray) -> None:
        """Fill ``out`` (blocks, band): one symbol of every lane a step, until all lanes are through."""
        width = out.shape[1]
        at, block, end, k = self.at.copy(), self.first.copy(), self.first + self.count, np.zeros(len(self.at), np.int64)
        while len(at):
            found = table[self.bits(at, 16)]
            if not found.all():
                raise ValueError("no such Huffman code")
            run, size = found >> 4 & 15, found & 15
            at += found >> 8
            ends = (size == 0) & (run < 15)
            n = np.where(ends, run, size)
            extra = self.bits(at, n)
            at += n
            k += np.where(ends, 0, run)
            here = np.flatnonzero(size)
            if len(here):
                s, e = size[here], extra[here]
                if (k[here] >= width).any():
                    raise ValueError("a run leaves its band")
                out[block[here], k[here]] = np.where(e >> (s - 1), e, e - (1 << s) + 1) << low
            k += ~ends
            block += np.where(ends, (1 << run) + extra, 0)
            over = k >= width
            block += over & ~ends
            k[over | ends] = 0
            active = block < end
            if not active.all():
                at, block, end, k = at[active], block[active], end[active], k[active]

    def refining_pass(self, out: np.ndarray, low: int, table: np.ndarray) -> bool:
        """Add the bits of coefficients that are there; False, and nothing done, if a lane is not one end-of-band run."""
        found = table[self.bits(self.at, 16)]
        run = found >> 4 & 15
        at = self.at + (found >> 8)
        if ((found == 0) | (found & 15 != 0) | (run == 15)).any() or ((1 << run) + self.bits(at, run) != self.count).any():
            return False
        at += run
        block, k = np.nonzero(out)
        lane = np.searchsorted(self.first, block, side="right") - 1
        upto = np.searchsorted(lane, np.arange(len(at)))
        bit = self.bits(at[lane] + np.arange(len(block)) - upto[lane], 1) << low
        value = out[block, k]
        out[block, k] = np.where(value > 0, value + bit, value - bit)
        return True


def decode_many(datas: list[bytes]) -> list[Image]:
    """As `decode_coefficients`, for many pictures: those with the same scans and restart markers are read side by side."""
    images = [read_markers(d) for d in datas]
    alike: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        alike.setdefault((tuple((c.number, c.h, c.v) for c in image.components), tuple(s[0] for s in image.scans)), []).append(i)
    for (_, scans), members in alike.items():
        if not side_by_side([images[i] for i in members], [datas[i] for i in members], scans):
            for i in members:
                images[i] = decode_coefficients(datas[i])
    return images


def side_by_side(images: list[Image], datas: list[bytes], scans: tuple) -> bool:
    if any(c.own_across != c.across or c.own_down != c.down for image in images for c in image.components):
        return False
    blocks = [np.array([image.components[c].across * image.components[c].down for image in images]) for c in range(len(images[0].components))]
    every = [np.zeros((int(n.sum()), 64), np.int32) for n in blocks]
    for k, (chosen, first, last, high, low, restart) in enumerate(scans):
        pieces = [d[image.scans[k][1] : image.scans[k][2]] for image, d in zip(images, datas)]
        if first == 0:
            # differences that are all zero, in one bit each
            if high or any(Table.prefixes(dc)[0] != 1 << 8 for _, dc, _ in chosen) or any(p.strip(b"\0") not in (b"", *FILLED) for p in pieces):
                return False
            continue
        if len(chosen) != 1 or not restart:
            return False
        c, _, body = chosen[0]
        lanes, table = Lanes(pieces, blocks[c], restart), Table.prefixes(body)
        if not lanes.sound:
            return False
        band = every[c][:, first : last + 1]
        if not high:
            lanes.first_pass(band, low, table)
        elif not lanes.refining_pass(band, low, table):
            return False
    for c, n in enumerate(blocks):
        ends = np.cumsum(n)
        for image, a, b in zip(images, (ends - n).tolist(), ends.tolist()):
            own = image.components[c]
            own.coefficients = every[c][a:b].reshape(own.down, own.across, 64)
    return True


#: Last bytes of data whose bits are zeros, filled up with ones.
FILLED = tuple(bytes([(1 << n) - 1]) for n in range(1, 8))


def planes(image: Image) -> list[np.ndarray]:
    """Samples of each component: dequantised, inverse-transformed and level-shifted, at their own resolution."""
    basis, order, out = cosines(), np.argsort(zigzag()), []
    for c in image.components:
        blocks = (c.coefficients.astype(np.float32) * image.tables[c.table])[..., order].reshape(c.down, c.across, 8, 8)
        samples = (basis.T @ blocks) @ basis
        samples += 128
        out.append(samples.transpose(0, 2, 1, 3).reshape(8 * c.down, 8 * c.across))
    return out


def rgb(image: Image) -> np.ndarray:
    """Full-resolution uint8 tensor (height, width, 3); chroma samples are repeated to the luma's resolution."""
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    full = []
    for c, p in zip(image.components, planes(image)):
        np.clip(p, 0, 255, out=p)
        if (c.v, c.h) != (most_v, most_h):
            p = p.repeat(most_v // c.v, 0).repeat(most_h // c.h, 1)
        full.append(p[: image.height, : image.width])
    if len(full) == 1:
        return np.stack([np.rint(full[0]).astype(np.uint8)] * 3, -1)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for k, channel in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        channel += 0.5
        np.clip(channel, 0, 255, out=channel)
        out[..., k] = channel
    return out


def payload_of(image: Image) -> tuple[np.ndarray, int]:
    """The payload that `store_many` put into a picture, and its unpadded length."""
    words = image.comment.split()
    n_units, n_bytes = int(words[1]), int(words[3])
    values = np.concatenate([c.coefficients[: c.own_down, : c.own_across, 1 : USED + 1].reshape(-1) for c in image.components])
    return value_bytes()[values + 129][: n_units * UNIT], n_bytes


def restore(data: bytes) -> tuple[np.ndarray, int, Image]:
    """The payload, its unpadded length, and the image it lies in."""
    image = decode_many([data])[0]
    return *payload_of(image), image


# --- columns ---------------------------------------------------------------------------------------------


def padded(text: str | None) -> tuple[np.ndarray, int]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    out = np.full(max(UNIT, -(-len(raw) // UNIT) * UNIT), FILL, np.uint8)
    out[: len(raw)] = raw
    return out, len(raw)


def feature(pixels: np.ndarray) -> str:
    """Mean and spread of each channel, and which quarters of the picture are brighter than the whole."""
    n, level = pixels.shape[0] * pixels.shape[1], np.arange(256)
    counts = [np.bincount(pixels[..., k].ravel(), minlength=256) for k in range(3)]
    mean = [int(c @ level) / n for c in counts]
    spread = [max(0.0, int(c @ (level * level)) / n - m * m) ** 0.5 for c, m in zip(counts, mean)]
    grey = pixels[..., 0].astype(np.int32) + pixels[..., 1] + pixels[..., 2]
    h, w = grey.shape[0] // 2, grey.shape[1] // 2
    quarters = [int(q.sum(dtype=np.int64)) * grey.size > int(grey.sum(dtype=np.int64)) * q.size for q in (grey[:h, :w], grey[:h, w:], grey[h:, :w], grey[h:, w:])]
    return " ".join([*(f"{x:.2f}" for x in (*mean, *spread)), "".join("01"[q] for q in quarters)])


def media(docs: DataFrame) -> DataFrame:
    """doc_id, media (the JPEG), payload and n_bytes as read back from it, height, width, pixels (height x width x 3 bytes) and feature of every text.

    A null text is an empty one, whose payload is a unit of 255. Repeated rows stay; other columns are not kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc_ids = string_column(batch, "text"), batch.column(batch.schema.get_field_index("doc_id"))
            for a, b in slices(texts, 1_000_000):
                stored = store_many([padded(t) for t in texts.slice(a, b - a).to_pylist()])
                images = decode_many(stored)
                back, pixels = [payload_of(i) for i in images], [rgb(i) for i in images]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(a, b - a), pa.array(stored, pa.binary()), pa.array([p.tobytes() for p, _ in back], pa.binary()), pa.array([n for _, n in back], pa.int64()), pa.array([p.shape[0] for p in pixels], pa.int32()),
                        pa.array([p.shape[1] for p in pixels], pa.int32()), pa.array([p.tobytes() for p in pixels], pa.binary()), pa.array([feature(p) for p in pixels], pa.string()),
                    ],
                    ["doc_id", "media", "payload", "n_bytes", "height", "width", "pixels", "feature"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary, payload binary, n_bytes long, height int, width int, pixels binary, feature string")


def digests(docs: DataFrame) -> DataFrame:
    """`media`'s columns by digest: stored form, payload read back, and full-resolution pixels."""
    size = lambda c: F.octet_length(c).cast("long")
    return media(docs).select(
        "doc_id", "n_bytes", size("payload").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring(F.col("payload"), F.octet_length("payload") - 31, F.lit(32))).alias("tail_crc32"), size("media").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "feature", F.sha2("pixels", 256).alias("pixels_sha256"),
    )
