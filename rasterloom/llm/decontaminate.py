"""Benchmark decontamination by spaced-seed hashing.

Words of a benchmark item and of a document are hashed under fixed masks over 11 neighbouring
words; a mask's zeros are ignored, so a substituted word there doesn't hide a passage. Hashes
of documents are looked up among those of the benchmark. Around each hit the passage and the
item are laid along the same diagonal, and the best stretch (a word that matches counts +1, one
that doesn't counts -2) must reach 10, or the item's whole length where it is shorter.

The benchmark's hashes are broadcast if there are at most `broadcast_rows`; beyond that the
lookup is a shuffled join of hashes and places, and only texts with a hit are fetched. Likewise the names of
contaminated rows are broadcast up to that number. Items of fewer than 11 words are looked up whole by masks of ones
of their lengths; items of fewer than 5 words are no evidence and are left out.

Defined cases: null text reads as empty; a document without hits isn't contaminated; repeated
rows get the same answer each, told apart by id and text; a null id keeps its answer; items
with null id or text are left out; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, kept, unused
from .spans import word_text

#: 1: the word counts; 0: it may be another one.
MASKS = ("11101101011", "11010111011", "10111011101")
SPAN = 11
LEAST_ITEM = 5
LEAST_SCORE = 10
MISS = -2
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    joined = word_text(F.lower(F.coalesce(text, F.lit(""))))
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def _seed(words: Column, at: Column, mask: str) -> Column:
    """Hash of the words under a mask from place `at` (from 0)."""
    return F.xxhash64(F.lit(mask), *[F.get(words, at + k) for k, bit in enumerate(mask) if bit == "1"])


def _seeds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """Adds pos and seed for each place and mask that fits there; rows has words."""
    placed = rows.withColumn("pos", F.explode(F.when(F.size("words") >= min(map(len, masks)), F.sequence(F.lit(0), F.size("words") - min(map(len, masks))))))
    one = lambda m: F.when(F.col("pos") + len(m) <= F.size("words"), _seed(F.col("words"), F.col("pos"), m))
    return placed.withColumn("seed", F.explode(F.array(*[one(m) for m in masks])))


def best_stretch(pairs: Column) -> Column:
    """The highest sum of +1 and MISS over any stretch of an array of booleans."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("top"))

    def add(acc: Column, same: Column) -> Column:
        run = F.greatest(F.lit(0), acc["run"] + F.when(same, 1).otherwise(MISS))
        return F.struct(run.alias("run"), F.greatest(acc["top"], run).alias("top"))

    return F.aggregate(pairs, zero, add, lambda acc: acc["top"])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_hash, item_id, start (word of the document where the item would begin), score: verified overlaps."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item_text")).dropna()
    # a name for each text, as an id may have several
    items = kept(items.select("item_id", _words(F.col("item_text")).alias("item_words")).filter(F.size("item_words") >= LEAST_ITEM).distinct().withColumn("item", F.xxhash64("item_id", "item_words")))
    short = sorted(r[0] for r in items.filter(F.size("item_words") < SPAN).select(F.size("item_words")).distinct().collect())  # at most SPAN - LEAST_ITEM lengths
    of = lambda rows, masks: _seeds(rows.withColumnRenamed("item_words", "words"), masks).filter("seed is not null").select("seed", "item", F.col("pos").alias("item_pos"))
    seeds = of(items.filter(F.size("item_words") >= SPAN), list(MASKS))
    for n in short:
        seeds = seeds.unionByName(of(items.filter(F.size("item_words") == n), ["1" * n]))
    seeds = kept(seeds)
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("words"))
    looked = _seeds(rows, [*MASKS, *("1" * n for n in short)])
    begin = (F.col("pos") - F.col("item_pos")).alias("start")
    place = ["doc_id", "text_hash", "item", "start"]
    # the document's words that lie along an item
    along = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.size("item_words") + F.least(F.col("start"), F.lit(0))).alias("along")
    if seeds.count() <= broadcast_rows:
        # texts stream past the seeds; only the words along a hit are shuffled
        hits = looked.join(F.broadcast(seeds.join(items, "item")), "seed").select("doc_id", "text_hash", "item", "item_id", "item_words", begin, "words")
        each = hits.select(*place, "item_id", "item_words", along).groupBy(*place).agg(F.first("item_id").alias("item_id"), F.first("item_words").alias("item_words"), F.first("along").alias("along"))
    else:
        # hashes and places are shuffled, texts only once and only if they have a hit
        hits = kept(looked.select("doc_id", "text_hash", "pos", "seed").join(seeds, "seed").select("doc_id", "text_hash", "item", begin).distinct())
        of_hit = hits.join(items, "item").alias("h")
        each = rows.dropDuplicates(["doc_id", "text_hash"]).alias("r").join(of_hit, F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.text_hash") == F.col("h.text_hash")))
        each = each.select(*[F.col(f"h.{c}").alias(c) for c in (*place, "item_id", "item_words")], "words").select(*place, "item_id", "item_words", along)
    under = F.slice("item_words", F.greatest(-F.col("start"), F.lit(0)) + 1, F.size("along"))
    score = best_stretch(F.zip_with("along", under, lambda a, b: F.coalesce(a == b, F.lit(False))))
    return each.withColumn("score", score).filter(F.col("score") >= F.least(F.lit(LEAST_SCORE), F.size("item_words"))).select("doc_id", "text_hash", "item_id", "start", "score")


def assess(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, n_overlaps, best_score, items (distinct item ids, ascending, comma-joined)."""
    per = overlaps(docs, benchmark).groupBy("doc_id", "text_hash").agg(
        F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n_overlaps"), F.max("score").alias("best_score"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("items")
    )
    rows = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash")).alias("d")
    both = rows.join(per.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash")), "left")
    none = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(0)).cast("long").alias(c)
    return both.select("d.doc_id", F.col("p.n_items").isNotNull().alias("contaminated"), none("n_items"), none("n_overlaps"), none("best_score"), F.coalesce("p.items", F.lit("")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    at, text_hash = unused(docs, "bad_id"), unused(docs, "bad_hash")
    bad = kept(overlaps(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(at), F.col("text_hash").alias(text_hash)).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    mine = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(at)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(text_hash))
    return docs.join(bad, mine, "left_anti")
