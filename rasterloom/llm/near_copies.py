"""One document of each group of copies and near copies: SimHash links, and a wider search for texts alike in 0.8 of their words.

`simhash` links fingerprints of 64 bits within 3, which finds only copies that differ in very little: a changed
word in a hundred moves more bits than that. So near copies are also sought over five-word shingles of
lower-cased words without punctuation.

Two texts are alike by the share of their words that stand in a shingle which both texts have, in the one of
them where that is less; 0.8 is wanted. A text with one word in twelve changed here and there passes, though
its shingle set's Jaccard similarity is only about 0.5, as each change spoils five shingles.

Search: each text has TABLES keys of ROWS least hashes of its shingles under as many hash functions, and texts that
share a key form a route. Every member of a route is first compared with its hub, the member with the least name, so a group
of copies costs as many comparisons as it has members, whatever its size. Then the links are joined to
components; only a route whose members still fall into several components is compared pair by pair across them,
a crowded one in blocks of bounded size, each pair of blocks in a task of its own. Blocks
of one component aren't compared with each other. No pair that a route brings together is skipped unless both texts are
joined already, so the result doesn't depend on sizes.

The routes are the inexact part: texts whose shingle sets share half of their union meet with chance 0.99, a third 0.77.
Each link given is exact.

Defined cases: as in `simhash`; a text of fewer than five words is one shingle, alike only to texts of the same words; one without
words is alike only to itself; texts that differ in case and punctuation only are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import SMALL_CHUNK, Texts, chunks, id_and_text, kept, lean, mix, saved, unused

SHINGLE, SIMILARITY = 5, 0.8
#: Least hashes that make a key, and keys of a text.
ROWS, TABLES = 3, 40
#: A route with more members than this, in several components, is compared in blocks of at most BLOCK.
JOINED, BLOCK = 16, 1024
#: The most shingles of a block but for one long text's, so that long texts make smaller blocks.
BLOCK_SHINGLES = 1 << 20
#: Partners of a text that one task compares with it, and those of them that stand as hubs beside it.
SHARE, HUBS = 4096, 32
#: Names of texts whose shingles are looked up by a broadcast; more of them are shuffled.
BROADCAST_ROWS = 1_000_000

_RANDOM = np.random.Generator(np.random.PCG64(128))
_WORD_KEYS = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_HASH_KEYS = _RANDOM.integers(1, 1 << 63, (TABLES, ROWS), dtype=np.uint64) | np.uint64(1)

#: Punctuation separates words as spaces do; other signs belong to them, so a text strewn with signs isn't a copy of the clean one.
PUNCTUATION = "!\"'(),-.:;?"
_IN_WORD = np.ones(256, bool)
_IN_WORD[:33] = _IN_WORD[127] = False
_IN_WORD[[ord(c) for c in PUNCTUATION]] = False


def shingles(texts: Texts, size: int = SHINGLE) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts, bounds of their words, hashes of runs of `size` words in order (a shorter text is one run), and each document's bounds among them."""
    low = Texts(simhash.LOWER[texts.data], texts.bounds)
    starts, ends = low.runs(_IN_WORD[low.data])
    h = low.hashes(starts, ends)
    per = np.bincount(low.document(starts), minlength=texts.n)
    first = np.concatenate([[0], np.cumsum(per)])
    count = np.where(per >= size, per - size + 1, np.minimum(per, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    which = np.repeat(np.arange(texts.n), count)
    lead = first[which] + np.arange(bounds[-1]) - bounds[which]
    length = np.minimum(per, size)[which]
    total = length.astype(np.uint64)
    for j in range(size):
        inside = j < length
        total = total + np.where(inside, h[np.where(inside, lead + j, 0)] * _WORD_KEYS[j], np.uint64(0)) if len(h) else total
    return low, np.stack([starts, ends, low.document(starts)]), mix(total), bounds


def names(low: Texts, words: np.ndarray) -> np.ndarray:
    """A hash of each text's words, one space between; equal for texts that differ in case and punctuation only."""
    per = np.bincount(words[2], minlength=low.n)
    to = np.concatenate([[0], np.cumsum(per)])
    raw, starts, ends = low.data.tobytes(), words[0].tolist(), words[1].tolist()
    out = np.empty(low.n, np.uint64)
    for k in range(low.n):
        a, b = to[k], to[k + 1]
        out[k] = xxhash.xxh64_intdigest(b" ".join([raw[x:y] for x, y in zip(starts[a:b], ends[a:b])]), 7) if b > a else xxhash.xxh64_intdigest(raw[low.bounds[k] : low.bounds[k + 1]], 8)
    return out


def keys(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """TABLES keys of each group of hashes; none of an empty one."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(full), TABLES), np.uint64)
    for t in range(TABLES):
        for r in range(ROWS):
            least = np.minimum.reduceat(hashes * _HASH_KEYS[t, r], bounds[full]) if len(full) else np.zeros(0, np.uint64)
            out[:, t] = mix(out[:, t] + least + np.uint64(t + 1))
    listed = [np.zeros(0, np.int64)] * (len(bounds) - 1)
    for k, row in zip(full.tolist(), out.view(np.int64)):
        listed[k] = row
    return listed


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp (the narrow fingerprint), node (the name of the text's words), size (of its list of shingles), routes (its keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            narrow = simhash.fingerprints_of(b.column(2))
            for row, end, texts in chunks(b.column(2), SMALL_CHUNK):
                part = b.slice(row, end - row)
                low, words, hashes, bounds = shingles(texts)
                columns = [part.column(0), part.column(1), pa.array(narrow[row:end].view(np.int64)), pa.array(names(low, words).view(np.int64)), pa.array(np.diff(bounds)), pa.array(keys(hashes, bounds), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp", "node", "size", "routes"])

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, node long, size long, routes array<long>")


def shared_words(hit: np.ndarray, words: int) -> float:
    """The share of a text's words that stand in a shingle marked as hit; one of fewer than five words is a single shingle."""
    at = np.flatnonzero(hit)
    if not len(at):
        return 0.0
    size = min(SHINGLE, words)
    return (int(np.minimum(np.diff(at), size).sum()) + size) / words


def words_of(shingle_count: int, single: int) -> int:
    return shingle_count + SHINGLE - 1 if shingle_count > 1 else single


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two texts by their shingles in order; a lone shingle counts as five words, as it is shared whole or not."""
    m, n = words_of(len(a), SHINGLE), words_of(len(b), SHINGLE)
    first = shared_words(np.isin(a, b), m)
    return first if first < SIMILARITY else min(first, shared_words(np.isin(b, a), n))


def alike_links(lists: list[np.ndarray], part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that join the texts as all pairs alike in SIMILARITY do; those of one part are joined already."""
    n = len(lists)
    part = np.arange(n) if part is None else np.unique(part, return_inverse=True)[1]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.unique(np.concatenate(lists), return_inverse=True)[1].astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    text_of = np.repeat(np.arange(n), np.diff(bounds))
    order = np.argsort(ids, kind="stable")
    by_id, of = ids[order], text_of[order]
    held, other = np.zeros(len(ids) + 1, bool), np.zeros(len(ids) + 1, bool)
    first = np.searchsorted(by_id, np.arange(len(ids) + 1))
    words = np.array([words_of(len(x), SHINGLE) for x in lists])
    a, b = [], []
    for i in range(n):
        if (part[i + 1 :] == part[i]).all():
            continue
        mine = ids[bounds[i] : bounds[i + 1]]
        met = [of[first[x] : first[x + 1]] for x in np.unique(mine).tolist()]
        met = np.concatenate(met) if met else np.zeros(0, np.int64)
        times = np.bincount(met[met > i], minlength=n)
        # a shingle covers five words at most
        near = np.flatnonzero((times * SHINGLE >= SIMILARITY * words) & (part != part[i]) & (times > 0))
        if not len(near):
            continue
        held[mine] = True
        for j in near[np.argsort(-times[near], kind="stable")].tolist():
            if part[i] == part[j]:
                continue  # joined since
            theirs = ids[bounds[j] : bounds[j + 1]]
            if shared_words(held[theirs], int(words[j])) < SIMILARITY:
                continue
            other[theirs] = True
            share = shared_words(other[mine], int(words[i]))
            other[theirs] = False
            if share >= SIMILARITY:
                a.append(i)
                b.append(j)
                part[part == part[j]] = part[i]
        held[mine] = False
    return np.array(a, np.int64), np.array(b, np.int64)


def routed(nodes: DataFrame) -> DataFrame:
    """route, n, hub (its least node), node, size: the members of routes with more than one."""
    each = nodes.select("node", "size", F.explode("routes").alias("route"))
    sizes = each.groupBy("route").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1")
    return each.join(sizes, "route").select("route", "n", "hub", "node", "size")


def shingle_lists(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, s: the shingles of each node wanted, in order; nodes has node and rep (an id and a text hash)."""
    of = kept(nodes.join(wanted, "node").select("node", F.col("rep.doc_id").alias("of_id"), F.col("rep.text_hash").alias("of_hash")))
    of = F.broadcast(of) if of.count() <= BROADCAST_ROWS else of
    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    texts = rows.join(of, rows["doc_id"].eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))).select("node", "text")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for row, end, t in chunks(b.column(1), SMALL_CHUNK):
                _, _, hashes, bounds = shingles(t)
                each = [hashes[x:y].view(np.int64) for x, y in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), pa.array(each, pa.list_(pa.int64()))], names=["node", "s"])

    return texts.mapInArrow(lists, "node long, s array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, held: DataFrame, hubs: int = 0) -> DataFrame:
    """Links of the pairs a, b whose shingles (node, s) are alike in SIMILARITY at least.

    Each b's shingles go to its a, in shares of at most about SHARE where an a has many. With `hubs`, as many further
    b of each a, drawn by hash, stand beside it, and a b is compared with all of them but those that are joined already: links then
    join what all those pairs would. A task holds one a's shingles and hubs at a time.
    """
    share = F.ceil(F.count("*") / SHARE).cast("int").alias("shares")
    salted = pairs.join(pairs.groupBy("a").agg(share, F.count("*").alias("of_a")), "a").select("a", "b", "of_a", "shares", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    tested = salted.join(held, F.col("b") == F.col("node")).select("a", "share", F.lit(1).alias("kind"), "b", "s")
    names_ = salted.select("a", F.col("a").alias("b"), "shares").distinct()
    if hubs:
        drawn = salted.filter("of_a > 1").groupBy("a", "shares", F.pmod(F.xxhash64("b", F.lit(3)), F.lit(hubs)).alias("draw")).agg(F.min("b").alias("b"))
        names_ = names_.unionByName(drawn.select("a", "b", "shares"))
    firsts = names_.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    firsts = firsts.join(held, F.col("b") == F.col("node")).select("a", "share", F.lit(0).alias("kind"), "b", "s")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, stand, root = None, {}, {}  # hubs with their shingles, and with a hub that they are joined to

        def top(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        for batch in lean(batches):
            a, shares, kind, b = (batch.column(k).to_pylist() for k in range(4))
            lists = batch.column(4)
            flat, at, found = lists.flatten().to_numpy(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist(), []
            for k in range(batch.num_rows):
                if of != (a[k], shares[k]):
                    of, stand, root = (a[k], shares[k]), {}, {}
                theirs = flat[at[k] : at[k + 1]]
                if kind[k] == 0:
                    stand[b[k]], root[b[k]] = theirs.copy(), b[k]
                    continue
                mine = top(b[k]) if b[k] in root else None
                for name, shingles_ in stand.items():
                    hub = top(name)
                    if hub != mine and alike(shingles_, theirs) >= SIMILARITY:
                        found.append((name, b[k]))
                        if mine is not None:
                            root[mine] = hub
                        mine = hub
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return firsts.unionByName(tested).repartition("a", "share").sortWithinPartitions("a", "share", "kind").mapInArrow(test, "a long, b long")


def to_hubs(members: DataFrame) -> DataFrame:
    """a, b: each node with the hub that it meets on most routes."""
    met = members.filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("times"))
    return met.groupBy("node").agg(F.max_by("hub", F.struct("times", "hub")).alias("a")).select("a", F.col("node").alias("b"))


def across(crowded: DataFrame, held: DataFrame) -> DataFrame:
    """a, b: links between the components of crowded routes; crowded has route, node, size, root.

    A component that fills a block has blocks of its own, which aren't compared with each other; small ones share blocks.
    """
    blocks = lambda: F.greatest(F.lit(1), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES))).cast("int")
    per = crowded.groupBy("route", "root").agg(blocks().alias("own"))
    own = per.withColumn("of", F.when(F.col("own") > 1, F.col("root")))
    mixed = crowded.join(own.filter("of IS NULL"), ["route", "root"]).groupBy("route").agg(blocks().alias("shared"))
    plan = kept(own.join(mixed, "route", "left").select("route", "root", "of", F.when(F.col("of").isNull(), F.col("shared")).otherwise(F.col("own")).alias("blocks")))
    block = F.pmod(F.xxhash64(F.when(F.col("of").isNull(), F.col("root")).otherwise(F.col("node")), F.lit(7)), F.col("blocks")).cast("int")
    placed = crowded.join(plan, ["route", "root"]).select("route", "node", "root", F.struct("of", block.alias("k")).alias("block"))
    listed = plan.select("route", "of", "blocks").distinct().select("route", "of", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select("route", F.struct("of", "k").alias("block"))
    met = listed.select("route", F.col("block").alias("x")).join(listed.select("route", F.col("block").alias("y")), "route").filter("x <= y AND (x.of IS NULL OR y.of IS NULL OR x.of <> y.of)")
    met = met.select("route", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    rows = placed.join(met, ["route", "block"]).select("route", "x", "y", "node", "root").join(held, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        ids = pdf["node"].to_numpy(np.int64)
        x, y = alike_links([np.asarray(s, np.int64) for s in pdf["s"]], pdf["root"].to_numpy(np.int64))
        return pd.DataFrame({"a": ids[x], "b": ids[y]})

    return rows.groupBy("route", "x", "y").applyInPandas(compare, "a long, b long").distinct()


def rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with root: their component's name, or their own."""
    roots = simhash.components(links)
    return members.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(*members.columns, F.coalesce("root", "node").alias("root"))


def links(docs: DataFrame, nodes: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """a, b: the known links, and verified ones whose components are those of all verified pairs that a route brings together."""
    members = saved(routed(nodes), "members")[0]  # names repeat from route to route, which Parquet stores once
    held = kept(shingle_lists(members.select("node").distinct(), docs, nodes, id_col, text_col))
    first = kept(known.unionByName(verified(to_hubs(members), held, HUBS)).distinct())
    with_root = rooted(members, first)
    several = with_root.groupBy("route").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("route")
    left = saved(with_root.join(several, "route"), "left")[0]
    few = left.filter(F.col("n") <= JOINED).select("route", "node", "root")
    other = few.select("route", F.col("node").alias("b"), F.col("root").alias("root_b"))
    pairs = few.join(other, "route").filter("node < b AND root <> root_b").select(F.col("node").alias("a"), "b").distinct()
    more = verified(pairs, held)
    crowded = left.filter(F.col("n") > JOINED).select("route", "node", "size", "root")
    if not crowded.isEmpty():
        more = more.unionByName(across(crowded, held))
    return first.unionByName(more)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group, with all its columns: that of the smallest id, or if all ids are null of the smallest hash.

    Texts go through one shuffle at most, and none while the rows that go can be broadcast; rows that repeat both id and text are told apart only where there are any.
    """
    found = kept(prints(docs, id_col, text_col))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep")
    nodes = kept(found.groupBy("node").agg(rep, F.max("size").alias("size"), F.min("routes").alias("routes")))
    held = kept(found.select("fp", "node").distinct())
    hubs = held.groupBy("fp").agg(F.min("node").alias("hub"))
    same = held.join(hubs, "fp").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    narrow = simhash.links(hubs.select("fp")).join(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("ha")), "a").join(hubs.select(F.col("fp").alias("b"), F.col("hub").alias("hb")), "b")
    known = same.unionByName(narrow.select(F.col("ha").alias("a"), F.col("hb").alias("b")))
    named = rooted(nodes.select("node", "rep"), links(docs, nodes, known, id_col, text_col))
    first = named.groupBy("root").agg(F.min("rep").alias("f"))
    at, text_hash = unused(docs, "first_id"), unused(docs, "first_hash")
    row_id, row_hash = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    mine = row_id.eqNullSafe(F.col(at)) & (row_hash == F.col(text_hash))
    stay = kept(first.select(F.col("f.doc_id").alias(at), F.col("f.text_hash").alias(text_hash)))
    every = found.select(F.col("doc_id").alias(at), F.col("text_hash").alias(text_hash)).distinct()
    go = kept(every.alias("e").join(stay.alias("s"), F.col(f"e.{at}").eqNullSafe(F.col(f"s.{at}")) & (F.col(f"e.{text_hash}").eqNullSafe(F.col(f"s.{text_hash}"))), "left_anti"))
    out = docs.join(F.broadcast(go), mine, "left_anti") if go.count() <= BROADCAST_ROWS else docs.join(stay, mine, "left_semi")
    repeated = kept(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(at), F.col("text_hash").alias(text_hash)))
    if repeated.isEmpty():
        return out
    key = unused(docs, "row_key")
    twice = out.join(repeated, mine, "left_semi").withColumn(key, F.struct(row_id, row_hash)).dropDuplicates([key]).drop(key)
    return out.join(repeated, mine, "left_anti").unionByName(twice)
