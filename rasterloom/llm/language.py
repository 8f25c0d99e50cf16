"""Language ID by Bayesian evidence fusion.

The log-posterior of a language is the sum of four parts: the text's likelihood under hashed
byte 4-gram multinomials (divided by a temper, as neighbouring grams aren't independent), the
declared markup language, the address suffix, and a host prior. Host priors are smoothed along
a hierarchy, host -> registered domain -> all: a grouped aggregation counts what the text alone
says of each host's rows, and each level's shares are mixed with its parent's by a fixed weight. A row's own text
is left out of its prior, so that it doesn't count twice.

The gram multinomials are fitted to at most `train_rows` labelled documents (those with the least
hash of the id whose crc32 mod 5 isn't 0), so what is collected is bounded.

Defined cases: null or empty text leaves the other evidence to decide; without any evidence the
overall prior decides, and ties go to the first language in order; null hosts share one
group; a declared language or suffix that isn't known is no evidence; without a labelled row
there are no languages and the answer is null; empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Texts, chunks, fold, kept, lean, mix

TRAIN_ROWS = 4_000
BUCKET_BITS = 15
GRAM = 4
#: Grams that count as one independent observation.
TEMPER = 8.0
#: Chance that a declared language or a suffix names another than the true one.
WRONG_MARKUP, WRONG_SUFFIX = 0.10, 0.25
#: Rows of the parent's shares that each level of the hierarchy is mixed with.
WEIGHT = 5.0

SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}

#: Labels under which countries' registries give out names.
SECOND_LEVEL = "ac co com edu gob gouv gov go gub id info ltd me mil ne net nhs nom or org plc sch".split()
#: Hosts whose counts are broadcast; beyond that each host's rows are joined in SHARES.
BROADCAST_ROWS, SHARES = 200_000, 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each run of GRAM bytes within a document; digits and signs read as spaces."""
    d = _LOWER[texts.data]
    d = np.where((d >= 97) & (d <= 122) | (d >= 128), d, np.uint8(32)).astype(np.uint64)
    n = len(d) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = d[:n]
    for k in range(1, GRAM):
        key = key << np.uint64(8) | d[k : k + n]
    bucket = (mix(key) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    doc = np.repeat(np.arange(texts.n, dtype=np.int32), np.diff(texts.bounds))
    same = doc[:n] == doc[GRAM - 1 :]
    # a gram of spaces only says nothing
    same &= key != np.uint64(0x20202020)
    return bucket[same], doc[:n][same]


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log p(bucket | language); labelled has id, text, lang."""
    ids = labelled.select(F.col("id").alias("id"), "lang").dropna().filter(fold(F.col("id")) != 0).groupBy("id").agg(F.min("lang").alias("label"))
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in lean(batches):
            label = np.array(b.column(1).to_pylist(), object)
            for row, end, texts in chunks(b.column(0)):
                bucket, doc = grams(texts)
                for lang in set(label[row:end]):
                    sums.setdefault(lang, np.zeros(size, np.int64))
                    sums[lang] += np.bincount(bucket[(label[row:end] == lang)[doc]], minlength=size)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(s[at])], names=["lang", "bucket", "n"])

    rows = labelled.select("id", "text").join(F.broadcast(chosen), "id").select("text", "label").mapInArrow(count, "lang string, bucket long, n long")
    got = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # languages times buckets at most
    langs = sorted({r.lang for r in got})
    counts = np.full((len(langs), size), 0.5)
    for r in got:
        counts[langs.index(r.lang), r.bucket] += r.n
    return langs, np.log(counts / counts.sum(1, keepdims=True)) if langs else counts


def visible(html: Column) -> Column:
    """The text of a page: without comments, scripts, styles and tags; common entities read as signs."""
    s = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    return F.regexp_replace(s, r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);", " ")


def declared(html: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1), F.lit("")))


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels, three under a registry's second level such as co.uk; an address of numbers is whole."""
    labels = F.split(host, r"\.")
    three = (F.size(labels) > 2) & F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.get(labels, F.size(labels) - 2).isin(*SECOND_LEVEL)
    last = F.array_join(F.slice(labels, -F.when(three, 3).otherwise(2), F.when(three, 3).otherwise(2)), ".")
    return F.when((F.size(labels) < 3) | host.rlike(r"^[0-9.]+$|:"), host).otherwise(last)


def classify(rows: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """id, lang_id, probability, text_lang. rows has id, text, markup, host (each may be null but the id)."""
    if not langs:
        return rows.select("id", F.lit(None).cast("string").alias("lang_id"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"))
    table = np.ascontiguousarray(logp.T.astype(np.float32))
    k = len(langs)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for row, end, texts in chunks(b.column(1)):
                bucket, doc = grams(texts)
                at = np.flatnonzero(np.diff(doc, prepend=-1))
                out = np.zeros((texts.n, k))
                if len(at):
                    for j in range(k):
                        out[doc[at], j] = np.add.reduceat(table[bucket, j].astype(np.float64), at)
                part = b.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(list(out / TEMPER), pa.list_(pa.float64()))], names=["id", "markup", "host", "ll"])

    told = kept(rows.select("id", "text", "markup", "host").mapInArrow(likelihood, "id long, markup string, host string, ll array<double>"))
    lang_list = F.array(*[F.lit(x) for x in langs])
    best = lambda a: F.get(lang_list, F.array_position(a, F.array_max(a)).cast("int") - 1)
    told = told.withColumn("domain", domain_of(F.col("host"))).withColumn("text_lang", best(F.col("ll")))
    # a text that says nothing doesn't count
    told = told.withColumn("vote", F.when(F.array_max("ll") > F.array_min("ll"), F.array_position("ll", F.array_max("ll")).cast("int") - 1))
    of = [F.count_if(F.col("vote") == i).alias(f"c{i}") for i in range(k)]
    hosts = told.groupBy("domain", "host").agg(*of)
    sums = [F.sum(f"c{i}").alias(f"d{i}") for i in range(k)]
    domains = hosts.groupBy("domain").agg(*sums)
    everywhere = domains.agg(*[F.sum(f"d{i}").alias(f"a{i}") for i in range(k)]).first()  # one row
    total = [everywhere[f"a{i}"] or 0 for i in range(k)]
    hosts = hosts.alias("h").join(domains.alias("d"), F.col("h.domain").eqNullSafe(F.col("d.domain"))).select(F.col("h.host").alias("of_host"), F.array(*[f"c{i}" for i in range(k)]).alias("c"), F.array(*[f"d{i}" for i in range(k)]).alias("d"))
    hosts = kept(hosts)
    # a host may hold a third of all rows: its counts go to every task, or in shares to as many
    if hosts.count() <= BROADCAST_ROWS:
        both = told.join(F.broadcast(hosts), F.col("host").eqNullSafe(F.col("of_host")))
    else:
        share = told.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int"))
        spread = hosts.withColumn("of_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        both = share.join(spread, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("share") == F.col("of_share")))
    # a row's own vote is left out at each level, as its text counts by itself
    own = [F.coalesce((F.col("vote") == i).cast("int"), F.lit(0)) for i in range(k)]
    voted = F.col("vote").isNotNull().cast("int")
    summed = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    overall = [(total[i] - own[i] + 1) / (sum(total) - voted + k) for i in range(k)]
    of_domain = [(F.col("d")[i] - own[i] + WEIGHT * overall[i]) / (summed("d") - voted + WEIGHT) for i in range(k)]
    prior = [F.log((F.col("c")[i] - own[i] + WEIGHT * of_domain[i]) / (summed("c") - voted + WEIGHT)) for i in range(k)]
    both = both.withColumn("prior", F.array(*prior))
    suffix = F.substring_index("host", ".", -1)
    said = F.lit(None).cast("string")
    for s, lang in SUFFIXES.items():
        if lang in langs:
            said = F.when(suffix == s, lang).otherwise(said)
    both = both.withColumn("suffix_lang", said)
    evidence = lambda c, lang, wrong: F.when(~F.coalesce(c.isin(langs), F.lit(False)), 0.0).when(c == lang, float(np.log(1 - wrong))).otherwise(float(np.log(wrong / max(k - 1, 1))))
    sums = F.array(*[F.col("ll")[i] + F.col("prior")[i] + evidence(F.col("markup"), x, WRONG_MARKUP) + evidence(F.col("suffix_lang"), x, WRONG_SUFFIX) for i, x in enumerate(langs)])
    both = both.withColumn("sums", sums).withColumn("top", F.array_max("sums"))
    share = 1.0 / F.aggregate("sums", F.lit(0.0), lambda a, c: a + F.exp(c - F.col("top")))
    return both.select("id", best(F.col("sums")).alias("lang_id"), F.round(share, 6).alias("probability"), "text_lang")


def identify(docs: DataFrame, pages: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, page_id (one of them is null), lang_id, probability, text_lang of documents and of pages.

    A document's source is its host; it has no markup and no suffix.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, logp = fit(labelled, train_rows)
    of_docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("markup"), F.col("source").cast("string").alias("host"))
    of_pages = pages.select(F.col("page_id").cast("long").alias("id"), visible(F.col("html")).alias("text"), declared(F.col("html")).alias("markup"), host_of(F.col("url")).alias("host"))
    none = F.lit(None).cast("long")
    a = classify(of_docs, langs, logp).select(F.col("id").alias("doc_id"), none.alias("page_id"), "lang_id", "probability", "text_lang")
    b = classify(of_pages, langs, logp).select(none.alias("doc_id"), F.col("id").alias("page_id"), "lang_id", "probability", "text_lang")
    return a.unionByName(b)
