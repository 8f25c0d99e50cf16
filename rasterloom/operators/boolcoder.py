"""Binary arithmetic coding with 8-bit probabilities, as RFC 6386 section 7 defines it."""

from __future__ import annotations

from collections.abc import Iterable

#: How far a range below 128 is shifted to reach it again.
_SHIFT = bytes(8 - max(r, 1).bit_length() for r in range(256))
#: Bytes that a reader takes at once.
_STEP = 6
#: Shifts after which a writer hands its settled bytes over.
_FULL = 512


class BoolReader:
    """Bytes past the end read as zero; past_end tells that one was asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.spare, self.range, self.asked = data, 0, 0, -8, 255, 0

    def _fill(self) -> None:
        piece = self.data[self.at : self.at + _STEP]
        self.value = self.value << 8 * _STEP | int.from_bytes(piece, "big") << 8 * (_STEP - len(piece))
        self.at += _STEP
        self.spare += 8 * _STEP

    @property
    def past_end(self) -> bool:
        # whole bytes that were read ahead as the last bit began haven't been asked for
        return self.at - self.asked // 8 > len(self.data)

    def bit(self, probability: int) -> int:
        """A bit that is 0 with a chance of about probability / 256."""
        if self.spare < 0:
            self._fill()
        self.asked = self.spare
        split = 1 + ((self.range - 1) * probability >> 8)
        high = split << self.spare
        if self.value >= high:
            self.value -= high
            size, out = self.range - split, 1
        else:
            size, out = split, 0
        if size < 128:
            shift = _SHIFT[size]
            size <<= shift
            self.spare -= shift
        self.range = size
        return out

    def many(self, probabilities: Iterable[int]) -> bytearray:
        """A bit for each probability, in order."""
        value, spare, size, asked, out = self.value, self.spare, self.range, self.asked, bytearray()
        take = out.append
        for p in probabilities:
            if spare < 0:
                self.value, self.spare = value, spare
                self._fill()
                value, spare = self.value, self.spare
            asked = spare
            split = 1 + ((size - 1) * p >> 8)
            high = split << spare
            if value >= high:
                value -= high
                size -= split
                take(1)
            else:
                size = split
                take(0)
            if size < 128:
                shift = _SHIFT[size]
                size <<= shift
                spare -= shift
        self.value, self.spare, self.range, self.asked = value, spare, size, asked
        return out

    def flag(self) -> bool:
        return bool(self.bit(128))

    def bits(self, n: int) -> int:
        """An unsigned number, its highest bit first."""
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit(128)
        return v

    def signed(self, n: int) -> int:
        """A size and then a sign."""
        v = self.bits(n)
        return -v if self.flag() else v

    def optional(self, n: int) -> int:
        """A flag, and after it a signed number; 0 without one."""
        return self.signed(n) if self.flag() else 0


class BoolWriter:
    """`low` holds 8 bits more than it was shifted since bytes were handed over; a bit beyond them is carried."""

    def __init__(self) -> None:
        self.out, self.low, self.range, self.shifted = bytearray(), 0, 255, 0

    def _hand_over(self, spare: int) -> None:
        """Moves whole bytes out of low, but for at least `spare` bits."""
        n = (8 + self.shifted - spare) // 8
        if n <= 0:
            return
        left = 8 + self.shifted - 8 * n
        top = self.low >> left
        self.low &= (1 << left) - 1
        self.shifted -= 8 * n
        if top >> 8 * n:
            top -= 1 << 8 * n
            i = len(self.out) - 1
            while self.out[i] == 255:
                self.out[i] = 0
                i -= 1
            self.out[i] += 1
        self.out += top.to_bytes(n, "big")

    def bit(self, v: int, probability: int) -> None:
        split = 1 + ((self.range - 1) * probability >> 8)
        if v:
            self.low += split
            size = self.range - split
        else:
            size = split
        if size < 128:
            shift = _SHIFT[size]
            size <<= shift
            self.low <<= shift
            self.shifted += shift
            if self.shifted > _FULL:
                self._hand_over(24)
        self.range = size

    def many(self, pairs: Iterable[tuple[int, int]]) -> None:
        """Bits with their probabilities, in order."""
        low, size, shifted = self.low, self.range, self.shifted
        for v, p in pairs:
            split = 1 + ((size - 1) * p >> 8)
            if v:
                low += split
                size -= split
            else:
                size = split
            if size < 128:
                shift = _SHIFT[size]
                size <<= shift
                low <<= shift
                shifted += shift
                if shifted > _FULL:
                    self.low, self.shifted = low, shifted
                    self._hand_over(24)
                    low, shifted = self.low, self.shifted
        self.low, self.range, self.shifted = low, size, shifted

    def flag(self, v: bool) -> None:
        self.bit(int(v), 128)

    def bits(self, v: int, n: int) -> None:
        for k in range(n - 1, -1, -1):
            self.bit(v >> k & 1, 128)

    def optional(self, v: int, n: int) -> None:
        self.flag(v != 0)
        if v:
            self.bits(abs(v), n)
            self.flag(v < 0)

    def bytes(self) -> bytes:
        for _ in range(32):
            self.bit(0, 128)
        self._hand_over(24)
        return bytes(self.out)
