"""EXIF records: a walk over TIFF directories to named fields."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..operators.bits import Invalid

#: Bytes of a value of each type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
SHORT, LONG, TEXT, RATIO = "short", "long", "text", "ratio"
_TYPES = {SHORT: (3,), LONG: (3, 4), TEXT: (2,), RATIO: (5,)}
#: Directory, tag -> field and what it must be.
FIELDS = {
    ("main", 0x0112): ("orientation", SHORT), ("main", 0x0100): ("width", LONG), ("main", 0x0101): ("height", LONG), ("main", 0x010F): ("make", TEXT), ("main", 0x0110): ("model", TEXT),
    ("main", 0x0131): ("software", TEXT), ("main", 0x0132): ("date_time", TEXT), ("main", 0x013B): ("artist", TEXT), ("main", 0x8298): ("copyright", TEXT),
    ("exif", 0x829A): ("exposure", RATIO), ("exif", 0x829D): ("f_number", RATIO), ("exif", 0x8827): ("iso", SHORT), ("exif", 0x9003): ("date_time_original", TEXT), ("exif", 0x9209): ("flash", SHORT), ("exif", 0x920A): ("focal_length", RATIO),
}
POINTERS = {0x8769: "exif", 0x8825: "gps"}
INTS = ("orientation", "width", "height", "iso", "flash")
TEXTS = ("make", "model", "software", "date_time", "date_time_original", "copyright", "artist")
RATIOS = ("exposure", "f_number", "focal_length", "gps_lat", "gps_lon", "gps_alt")
SCHEMA = ", ".join([f"{n} int" for n in INTS] + [f"{n} string" for n in TEXTS] + [f"{n} double" for n in RATIOS])


class _Tiff:
    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2], "")
        if len(data) < 8 or not self.order or self.number("H", 2) != 42:
            raise Invalid("not an EXIF record")

    def number(self, kind: str, at: int) -> int:
        size = struct.calcsize(kind)
        piece = self.data[at : at + size]
        return struct.unpack(self.order + kind, piece)[0] if len(piece) == size else 0

    def ratio(self, at: int) -> float:
        over = self.number("I", at + 4)
        return self.number("I", at) / over if over else 0.0

    def text(self, at: int, most: int) -> str:
        return self.data[at : at + most].split(b"\0", 1)[0].decode("latin-1")

    def entries(self, at: int) -> Iterator[tuple[int, int, int, int]]:
        """(tag, type, count, place of the value); entries and values outside the record are left out."""
        if at + 2 > len(self.data):
            return
        for k in range(self.number("H", at)):
            e = at + 2 + 12 * k
            if e + 12 > len(self.data):
                return
            tag, kind, count = self.number("H", e), self.number("H", e + 2), self.number("I", e + 4)
            value = e + 8 if SIZES.get(kind, 1) * count <= 4 else self.number("I", e + 8)
            if value < len(self.data):
                yield tag, kind, count, value


def parse(data: bytes) -> dict[str, int | str | float]:
    """Fields by name; numbers that are missing are 0 and texts empty."""
    t = _Tiff(data)
    out: dict[str, int | str | float] = dict.fromkeys(INTS, 0) | dict.fromkeys(TEXTS, "") | dict.fromkeys(RATIOS, 0.0)
    first = t.number("I", 4)
    if not 8 <= first < len(data):
        raise Invalid("no directory")
    places = {"main": first}
    for name in ("main", "exif"):
        for tag, kind, count, at in t.entries(places[name]) if name in places else ():
            if name == "main" and tag in POINTERS and kind == 4:
                places[POINTERS[tag]] = t.number("I", at)
            if (name, tag) not in FIELDS:
                continue
            to, want = FIELDS[name, tag]
            if kind in _TYPES[want]:
                out[to] = t.text(at, count) if want == TEXT else t.ratio(at) if want == RATIO else t.number("H" if kind == 3 else "I", at)
    if places.get("gps"):
        _gps(t, places["gps"], out)
    return out


def _gps(t: _Tiff, at: int, out: dict) -> None:
    """Degrees from degrees, minutes and seconds, negative to the south and west; altitude, negative below the sea."""
    refs, degrees, below = {}, {}, False
    for tag, kind, count, value in t.entries(at):
        if tag in (1, 3) and kind == 2:
            refs[tag + 1] = t.text(value, 2)
        elif tag in (2, 4) and kind == 5 and count == 3:
            degrees[tag] = t.ratio(value) + t.ratio(value + 8) / 60 + t.ratio(value + 16) / 3600
        elif tag == 5 and kind == 1:
            below = t.data[value] == 1
        elif tag == 6 and kind == 5:
            out["gps_alt"] = t.ratio(value)
    for tag, name, minus in ((2, "gps_lat", "S"), (4, "gps_lon", "W")):
        if tag in degrees:
            out[name] = -degrees[tag] if refs.get(tag) == minus else degrees[tag]
    if below:
        out["gps_alt"] = -out["gps_alt"]


def orientation(data: bytes | None) -> int:
    """1 to 8; 1 where the record is missing, broken or says otherwise."""
    try:
        v = parse(data)["orientation"] if data else 1
    except Invalid:
        return 1
    return v if 1 <= v <= 8 else 1


def build(fields: dict[str, int | str | float], order: str = "<") -> bytes:
    """A record with the given fields of the main and EXIF directories, and gps_lat, gps_lon and gps_alt."""
    back = {name: (where, tag, kind) for (where, tag), (name, kind) in FIELDS.items()}
    dirs: dict[str, list[tuple[int, int, int, bytes]]] = {"main": [], "exif": [], "gps": []}
    ratio = lambda v, k=10_000: struct.pack(order + "II", round(abs(v) * k), k)
    for name, v in fields.items():
        if name in ("gps_lat", "gps_lon"):
            tag = 2 if name == "gps_lat" else 4
            d = int(abs(v))
            m = int((abs(v) - d) * 60)
            dirs["gps"] += [(tag - 1, 2, 2, (b"NS" if tag == 2 else b"EW")[v < 0 :][:1] + b"\0"), (tag, 5, 3, ratio(d, 1) + ratio(m, 1) + ratio((abs(v) - d - m / 60) * 3600))]
        elif name == "gps_alt":
            dirs["gps"] += [(5, 1, 1, bytes([v < 0])), (6, 5, 1, ratio(v))]
        else:
            where, tag, kind = back[name]
            text = str(v).encode("latin-1") + b"\0"
            dirs[where].append((tag, 2, len(text), text) if kind == TEXT else (tag, 5, 1, ratio(v)) if kind == RATIO else (tag, 3, 1, struct.pack(order + "H", v)))
    at = {"main": 8}
    for name, tag in (("exif", 0x8769), ("gps", 0x8825)):
        if dirs[name]:
            dirs["main"].append((tag, 4, 1, b"\0" * 4))
    size = lambda d: 2 + 12 * len(d) + 4 + sum(len(v) for *_, v in d if len(v) > 4)
    at["exif"] = 8 + size(dirs["main"])
    at["gps"] = at["exif"] + (size(dirs["exif"]) if dirs["exif"] else 0)
    out = b"II*\0" if order == "<" else b"MM\0*"
    out += struct.pack(order + "I", 8)
    for name in ("main", "exif", "gps"):
        entries = sorted(dirs[name])
        if not entries:
            continue
        body, tail, beyond = struct.pack(order + "H", len(entries)), b"", at[name] + 2 + 12 * len(entries) + 4
        for tag, kind, count, v in entries:
            if name == "main" and tag in POINTERS:
                v = struct.pack(order + "I", at[POINTERS[tag]])
            if len(v) > 4:
                body += struct.pack(order + "HHII", tag, kind, count, beyond + len(tail))
                tail += v
            else:
                body += struct.pack(order + "HHI", tag, kind, count) + v.ljust(4, b"\0")
        out += body + b"\0" * 4 + tail
    return out
