"""Bit streams that start at the least significant bit of each byte."""

from __future__ import annotations


class Invalid(ValueError):
    """The bytes don't follow the format."""


class Unsupported(ValueError):
    """The bytes may follow the format, but ask for what isn't offered."""


class BitReader:
    """Bits past the end read as zero; overrun tells that some were read."""

    def __init__(self, data: bytes):
        self.data, self.at, self.window, self.held, self.used = data, 0, 0, 0, 0

    def _fill(self, n: int) -> None:
        while self.held < n:
            piece = self.data[self.at : self.at + 32]
            self.at += 32
            self.window |= int.from_bytes(piece, "little") << self.held
            self.held += 256

    def peek(self, n: int) -> int:
        if self.held < n:
            self._fill(n)
        return self.window & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.window >>= n
        self.held -= n
        self.used += n

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.skip(n)
        return v

    @property
    def overrun(self) -> bool:
        return self.used > 8 * len(self.data)


class BitWriter:
    def __init__(self) -> None:
        self.done, self.window, self.held = bytearray(), 0, 0

    def write(self, value: int, n: int) -> None:
        self.window |= value << self.held
        self.held += n
        if self.held >= 256:
            whole = self.held // 8
            self.done += (self.window & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.window >>= 8 * whole
            self.held -= 8 * whole

    def copy(self) -> BitWriter:
        """A writer that goes on from here, to try what follows."""
        out = BitWriter()
        out.take(self)
        return out

    def take(self, other: BitWriter) -> None:
        self.done, self.window, self.held = bytearray(other.done), other.window, other.held

    def __len__(self) -> int:
        return 8 * len(self.done) + self.held

    def bytes(self) -> bytes:
        return bytes(self.done) + self.window.to_bytes((self.held + 7) // 8, "little")
