"""Quality rules: hashed n-gram log-likelihood ratio of each document, and counts of its surface.

A trusted-target multinomial and a raw-corpus multinomial are estimated over hashed word
1-grams and 2-grams. A document's score is the sum of log(target/raw) over its n-grams,
divided by their number; the document is kept if the score reaches a fixed threshold and the
base rules don't fail it. Raw counts cover every document. Target counts come from at most
`trusted_rows` rows labelled as good (those with the least hash of the id), so their ids are
bounded and can be broadcast.

Defined cases: null text reads as empty; a text without n-grams scores 0; each of repeated
rows is scored and returned; repeated or null labels count once or not at all; without any
trusted row the ratio is 0 for all; empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Texts, chunks, id_and_text, lean, mix

BUCKET_BITS = 14
TRUSTED_ROWS = 20_000
#: Nats per n-gram.
THRESHOLD = -0.06
#: Added to each bucket's count, as a share of the mean count.
SMOOTHING = 0.01

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def buckets(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the document of each word and each pair of neighbouring words."""
    h, doc = texts.hashes(starts, ends), texts.document(starts)
    shift = np.uint64(64 - BUCKET_BITS)
    one = mix(h * _A) >> shift
    two = np.zeros(0, np.uint64)
    same = np.zeros(0, bool)
    if len(h) > 1:
        same = doc[1:] == doc[:-1]
        two = mix(h[:-1] * _A + h[1:] * _B)[same] >> shift
    return np.concatenate([one, two]).astype(np.int64), np.concatenate([doc, doc[1:][same]])


def surface(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts of each document, from its words."""
    n, doc = texts.n, texts.document(starts)
    n_words = np.bincount(doc, minlength=n)
    inside = np.ones(len(texts.data), bool)
    inside[(texts.data == 32) | ((texts.data >= 9) & (texts.data <= 13))] = False
    out = {
        "n_words": n_words,
        "word_chars": texts.total(inside & ((texts.data & 0xC0) != 0x80)),
        "n_symbols": texts.total(_SYMBOL[texts.data]),
    }
    from_, to = texts.runs(texts.data != 10)
    has_word = np.concatenate([[0], np.cumsum(inside)])
    full = has_word[to] > has_word[from_]
    from_, to = from_[full], to[full]
    line_doc = texts.document(from_)
    out["n_dup_lines"] = np.bincount(line_doc[later_copies(texts, line_doc, from_, to, mix(texts.hashes(from_, to)))], minlength=n)
    repeat = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        h = texts.hashes(starts, ends)
        window = mix(h[at] * _A + mix(h[at + 1] * _B + mix(h[at + 2] + _A)))
        for k in equal_windows(texts, doc[at], at, window, starts, ends).tolist():
            repeat[k : k + 3] = True
    out["n_repeat_words"] = np.bincount(doc[repeat], minlength=n)
    return out


def _several(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places, in order, whose value stands in their document more than once."""
    order = np.lexsort((value, doc))
    equal = (value[order][1:] == value[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(value), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    return np.flatnonzero(twice)


def later_copies(texts: Texts, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of spans equal to an earlier one of their document. Hashes choose what is compared, bytes decide."""
    found, seen, of = [], set(), -1
    for k in _several(doc, value).tolist():
        if doc[k] != of:
            of, seen = doc[k], set()
        span = texts.data[starts[k] : ends[k]].tobytes()
        if span in seen:
            found.append(k)
        seen.add(span)
    return np.array(found, np.int64)


def equal_windows(texts: Texts, doc: np.ndarray, at: np.ndarray, value: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First words of windows of three words that their document holds twice or more. Hashes choose what is compared, bytes decide."""
    found: list[int] = []
    held: dict[tuple, list[int]] = {}
    of = -1

    def hand_over() -> None:
        for same in held.values():
            if len(same) > 1:
                found.extend(same)

    for k in _several(doc, value).tolist():
        if doc[k] != of:
            hand_over()
            of, held = doc[k], {}
        i = int(at[k])
        held.setdefault(tuple(texts.data[starts[j] : ends[j]].tobytes() for j in range(i, i + 3)), []).append(i)
    hand_over()
    return np.array(found, np.int64)


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """doc_id of at most `rows` rows labelled good and never bad."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).dropna()
    good = good.groupBy("doc_id").agg(F.min("q").alias("q")).filter("q = 1")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")


def log_ratio(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> np.ndarray:
    """log(target/raw) of each of 2**BUCKET_BITS buckets."""
    size = 1 << BUCKET_BITS
    chosen = F.broadcast(trusted_ids(labels, trusted_rows).withColumn("trusted", F.lit(True)))
    flagged = id_and_text(docs).join(chosen, "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in lean(batches):
            good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, end, texts in chunks(b.column(0)):
                which, doc = buckets(texts, *texts.words())
                raw += np.bincount(which, minlength=size)
                target += np.bincount(which[good[row:end][doc]], minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    sums = flagged.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(size), np.zeros(size)
    for r in sums.collect():  # one row for each bucket at most
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(size)
    p = target / target.sum() + SMOOTHING / size
    q = raw / raw.sum() + SMOOTHING / size
    return np.log(p / p.sum()) - np.log(q / q.sum())


def score(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base counts, base_failed, kept, score (nats per n-gram)."""
    ratio = ratio.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for b in lean(batches):
            for row, end, texts in chunks(b.column(1)):
                starts, ends = texts.words()
                x = surface(texts, starts, ends)
                which, doc = buckets(texts, starts, ends)
                total = np.bincount(doc, ratio[which], minlength=texts.n)
                each = total / np.maximum(np.bincount(doc, minlength=texts.n), 1)
                failed = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
                columns = [b.column(0).slice(row, end - row), *(pa.array(x[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(~failed & (each >= threshold)), pa.array(each)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "kept", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def assess(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, log_ratio(docs, labels, trusted_rows), threshold)
