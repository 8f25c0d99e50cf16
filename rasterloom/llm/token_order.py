"""Training-order materialisation: token sequences in a keyed global order, as fixed-stride shards.

Texts are tokenised and cut into sequences of at most `seq_len` tokens (a document's last one
is padded). Sequences are numbered 0..N-1 in the order of the scan, and a keyed Feistel network
with cycle-walking permutes the numbers: the image is the sequence's global slot. Slot s stands
in shard s // shard_slots at byte (s % shard_slots) * seq_len * 2, as little-endian 16-bit ids,
so a reader goes through shards in order and resumes anywhere by a seek.

One pass counts each scan partition's sequences (a number a partition goes to the driver), a
second one encodes and sends each sequence to its shard's partition. A task holds one shard at
a time and puts its file in place by a rename, so a task that runs again writes the same file.
Both passes must see the same partitions, as scans of files give; other input is written first.

Defined cases: null or empty text has no sequences; repeated rows have their own; a null id is
carried as null; empty input gives no shards and no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, kept, lean, scratch

SEQ_LEN = 256
SHARD_SLOTS = 32_768
KEY = 0x5EED_0F_0DE5
#: Beyond so many shards a partition takes several, in order.
MAX_PARTITIONS = 20_000
ROUNDS = 6


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.Generator(np.random.PCG64(key)).integers(0, 1 << 64, rounds, dtype=np.uint64)

    def _f(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys:
            left, right = right, left ^ self._f(right, k)
        return left << np.uint64(self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys[::-1]:
            left, right = right ^ self._f(left, k), left
        return left << np.uint64(self.half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x, np.uint64))
        while (over := np.flatnonzero(out >= self.n)).size:
            out[over] = step(out[over])
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self._once)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self._back)


_ENCODERS: dict[int, object] = {}


def _encoder(ranks_file: bytes, pattern: str):
    import tiktoken

    key = hash((ranks_file, pattern))
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        # with no special token at all the library looks for an empty one at each byte; texts never reach this one
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|pad|>": max(ranks.values()) + 1})
    return _ENCODERS[key]


def shard_name(k: int) -> str:
    return f"shard-{k:08d}.bin"


def materialise(docs: DataFrame, ranks_path: str, pattern: str, out: str, key: int = KEY, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, pad: int = 50_256, stable: bool = True, max_partitions: int = MAX_PARTITIONS) -> DataFrame:
    """Writes the shards under `out`, an empty folder that all executors share, when the result is computed; again computed, it keeps those there.

    Returns doc_id, seq_no, n_tokens, slot, shard, byte_offset, crc (of the sequence's bytes, padding included).
    stable: docs is a scan of files, whose partitions are the same each time.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs)
    rows = rows if stable else kept(rows)
    sent = spark.sparkContext.broadcast((Path(ranks_path).read_bytes(), pattern))  # a few MB whatever the input

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n = _encoder(*sent.value).encode_to_numpy, 0
        for b in lean(batches):
            for t in b.column(0):
                text = t.as_py()
                if text:
                    n += -(-len(encode(text, disallowed_special=())) // seq_len)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["part", "n"])

    counted = {r.part: r.n for r in rows.select("text").mapInArrow(count, "part int, n long").collect()}  # one row a partition
    total = sum(counted.values())
    starts, at = {}, 0
    for part in sorted(counted):
        starts[part], at = at, at + counted[part]
    first = spark.sparkContext.broadcast(starts)
    n_shards = max(1, -(-total // shard_slots))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, order = _encoder(*sent.value).encode_to_numpy, Feistel(total, key)
        at = first.value.get(TaskContext.get().partitionId(), 0)
        ids, numbers, payloads = [], [], []

        def batch() -> pa.RecordBatch:
            nonlocal at
            slots = order.slot(np.arange(at, at + len(ids)))
            at += len(ids)
            columns = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(slots), pa.array(slots // shard_slots, pa.int32()), pa.array(payloads, pa.binary())]
            ids.clear(), numbers.clear(), payloads.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "seq_no", "slot", "shard", "payload"])

        for b in lean(batches):
            for i, t in zip(b.column(0), b.column(1)):
                if not (text := t.as_py()):
                    continue
                doc_id, tokens = i.as_py(), enc(text, disallowed_special=()).astype("<u2")
                for k in range(0, len(tokens), seq_len):
                    ids.append(doc_id)
                    numbers.append(k // seq_len)
                    payloads.append(tokens[k : k + seq_len].tobytes())
                if len(ids) >= 8192:
                    yield batch()
        if ids:
            yield batch()

    def put(shard: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Writes one shard's file and tells of its sequences."""
        import zlib

        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(out)
        slots = rows["slot"].to_numpy() - shard * shard_slots
        block = np.full((min(shard_slots, total - shard * shard_slots), seq_len), pad, "<u2")
        sizes, crcs = [], []
        for s, p in zip(slots.tolist(), rows["payload"]):
            ids = np.frombuffer(p.as_py(), "<u2")
            block[s, : len(ids)] = ids
            sizes.append(len(ids))
            crcs.append(zlib.crc32(block[s]))
        part, final = f"{path}/_{TaskContext.get().taskAttemptId()}-{shard_name(shard)}", f"{path}/{shard_name(shard)}"
        try:
            with where.open_output_stream(part) as f:
                f.write(block)
            # every attempt writes the same bytes, so the file of another one is as good
            if where.get_file_info(final).type == fs.FileType.NotFound:
                try:
                    where.move(part, final)
                except OSError:
                    if where.get_file_info(final).type == fs.FileType.NotFound:
                        raise
        finally:
            if where.get_file_info(part).type != fs.FileType.NotFound:
                where.delete_file(part)
        columns = [rows["doc_id"], rows["seq_no"], pa.array(sizes, pa.int32()), rows["slot"], rows["shard"], pa.array(slots.astype(np.int64) * seq_len * 2), pa.array(crcs, pa.int64())]
        yield from pa.table(columns, names=["doc_id", "seq_no", "n_tokens", "slot", "shard", "byte_offset", "crc"]).combine_chunks().to_batches()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards in order, one held at a time."""
        now, held = None, []
        for b in lean(batches):
            shards = b.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if shards[x] != now and held:
                    yield from put(int(now), pa.Table.from_batches(held))
                    held = []
                now = shards[x]
                held.append(b.slice(x, y - x))
        if held:
            yield from put(int(now), pa.Table.from_batches(held))

    from urllib.parse import urlparse

    from pyarrow import fs

    out = out if urlparse(out).scheme else f"file://{Path(out).absolute()}"
    where, path = fs.FileSystem.from_uri(out)
    where.create_dir(path)
    if where.get_file_info(fs.FileSelector(path)):
        raise FileExistsError(f"{out} isn't empty")
    sequences = rows.mapInArrow(encode, "doc_id long, seq_no int, slot long, shard int, payload binary")
    each = -(-n_shards // min(n_shards, max_partitions))
    dealt = sequences.repartitionById(-(-n_shards // each), F.expr(f"cast(shard div {each} AS int)"))
    if each > 1:
        dealt = dealt.sortWithinPartitions("shard")
    return dealt.mapInArrow(write, "doc_id long, seq_no int, n_tokens int, slot long, shard int, byte_offset long, crc long")


def read(out: str, from_slot: int = 0, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids with padding) from a slot on, through the shards in order."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(out if "://" in out else f"file://{Path(out).absolute()}")
    shard, stride, at = from_slot // shard_slots, seq_len * 2, from_slot
    while where.get_file_info(f"{path}/{shard_name(shard)}").type == fs.FileType.File:
        with where.open_input_file(f"{path}/{shard_name(shard)}") as f:
            f.seek((at - shard * shard_slots) * stride)
            while len(row := f.read(stride)) == stride:
                yield at, np.frombuffer(row, "<u2")
                at += 1
        shard += 1


def ordered(docs: DataFrame, ranks_path: str, pattern: str, **options) -> DataFrame:
    """materialise() into a new folder of the shared one."""
    return materialise(docs, ranks_path, pattern, scratch(docs.sparkSession, "token-order"), **options)
