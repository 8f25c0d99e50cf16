"""Prefix codes: lengths from counts, canonical codes, reading, and how lengths are stored."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from .bits import BitReader, BitWriter, Invalid

# The order in which lengths of the length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Repeat symbols: extra bits and least repeat. 16 repeats the last length that isn't zero, 17 and 18 repeat zero.
REPEATS = {16: (2, 3), 17: (3, 3), 18: (7, 11)}


def code_lengths(counts: list[int], limit: int = 15) -> list[int]:
    """Lengths of an optimal prefix code of at most `limit` bits; a lone symbol gets length 1.

    Where the tree grows too deep, small counts are raised to a floor that doubles until it fits.
    """
    used = [s for s, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0]] = 1
    if len(used) < 2:
        return out
    floor = 1
    while True:
        heap = [(max(counts[s], floor), s, (s,)) for s in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        order = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], order, a[2] + b[2]))
            order += 1
        if max(depth.values()) <= limit:
            for s, d in depth.items():
                out[s] = d
            return out
        floor *= 2


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, length), in order of length and symbol."""
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code += 1
    return out


@dataclass
class Decoder:
    """A table over the next `width` bits: symbol and length; a lone symbol takes no bits."""

    width: int
    symbols: list[int]
    lengths: list[int]

    def read(self, r: BitReader) -> int:
        i = r.peek(self.width)
        r.skip(self.lengths[i])
        return self.symbols[i]


def decoder(lengths: list[int]) -> Decoder:
    """The lengths must fill the code space exactly, or name one symbol only."""
    used = [s for s, n in enumerate(lengths) if n]
    if not used:
        raise Invalid("a prefix code without symbols")
    if len(used) == 1:
        return Decoder(0, [used[0]], [0])
    width = max(lengths)
    if sum(1 << (width - n) for n in lengths if n) != 1 << width:
        raise Invalid("a prefix code that isn't complete")
    symbols, sizes = [0] * (1 << width), [0] * (1 << width)
    for s, (code, n) in canonical(lengths).items():
        for i in range(code, 1 << width, 1 << n):
            symbols[i], sizes[i] = s, n
    return Decoder(width, symbols, sizes)


def read_code(r: BitReader, size: int) -> Decoder:
    """A stored code over `size` symbols."""
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        listed = [r.read(8 if wide else 1)] + ([r.read(8)] if two else [])
        if max(listed) >= size:
            raise Invalid("a symbol past its alphabet")
        lengths = [0] * size
        if two and listed[0] == listed[1]:
            return Decoder(1, [listed[0]] * 2, [1, 1])
        if two:  # the first one listed has code 0
            return Decoder(1, listed, [1, 1])
        lengths[listed[0]] = 1
        return decoder(lengths)
    first = [0] * 19
    for i in range(4 + r.read(4)):
        first[LENGTH_ORDER[i]] = r.read(3)
    inner = decoder(first)
    left = size
    if r.read(1):
        left = 2 + r.read(2 + 2 * r.read(3))
        if left > size:
            raise Invalid("more lengths than symbols")
    lengths, last = [], 8
    while len(lengths) < size and left > 0:
        left -= 1
        if r.overrun:
            raise Invalid("lengths end early")
        s = inner.read(r)
        if s < 16:
            lengths.append(s)
            last = s or last
            continue
        extra, least = REPEATS[s]
        lengths += [last if s == 16 else 0] * (least + r.read(extra))
        if len(lengths) > size:
            raise Invalid("a repeat past the alphabet")
    return decoder(lengths + [0] * (size - len(lengths)))


def run_tokens(lengths: list[int]) -> list[tuple[int, int]]:
    """Lengths as (symbol, extra value): runs of zero and of a length become repeats."""
    out, i, last = [], 0, 8
    while i < len(lengths):
        v, j = lengths[i], i
        while j < len(lengths) and lengths[j] == v:
            j += 1
        n, i = j - i, j
        if v and v != last:
            out.append((v, 0))
            n -= 1
            last = v
        while n:
            if n < 3:
                out += [(v, 0)] * n
                break
            s, most = (16, 6) if v else (17, 10) if n < 11 else (18, 138)
            k = min(n, most)
            out.append((s, k - REPEATS[s][1]))
            n -= k
    return out


def write_code(w: BitWriter, lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Stores a code and returns what to write for each symbol."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.write(1, 1)
        w.write(len(used) - 1, 1)
        wide = used[0] > 1
        w.write(int(wide), 1)
        w.write(used[0], 8 if wide else 1)
        if len(used) == 2:
            w.write(used[1], 8)
            return {used[0]: (0, 1), used[1]: (1, 1)}
        return {used[0]: (0, 0)}
    w.write(0, 1)
    tokens = run_tokens(lengths)
    while tokens and tokens[-1][0] in (0, 17, 18):
        tokens.pop()
    whole = run_tokens(lengths)
    trimmed = len(tokens) < len(whole) and len(tokens) >= 2
    tokens = tokens if trimmed else whole
    counts = [0] * 19
    for s, _ in tokens:
        counts[s] += 1
    inner = code_lengths(counts, 7)
    stored = [inner[s] for s in LENGTH_ORDER]
    while len(stored) > 4 and not stored[-1]:
        stored.pop()
    w.write(len(stored) - 4, 4)
    for n in stored:
        w.write(n, 3)
    codes = canonical(inner) if sum(map(bool, inner)) > 1 else {s: (0, 0) for s, n in enumerate(inner) if n}
    w.write(int(trimmed), 1)
    if trimmed:
        bits = max(2, (len(tokens) - 2).bit_length())
        bits += bits & 1
        w.write((bits - 2) // 2, 3)
        w.write(len(tokens) - 2, bits)
    for s, extra in tokens:
        w.write(*codes[s])
        if s in REPEATS:
            w.write(extra, REPEATS[s][0])
    return canonical(lengths) if len(used) > 1 else {used[0]: (0, 0)}
