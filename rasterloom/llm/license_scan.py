"""Licence scans: ordered signature rules behind a keyword prefilter.

A text that holds any rule's keyword is tested by the rules of the keywords it holds. Places
where rules match are intervals of words. An interval inside another is suppressed (of equal
ones the higher priority stays, then the earlier rule), then of two that overlap the higher
priority stays, then the earlier.

Defined cases: null text reads as empty, with no words and no labels; each of repeated rows is
scanned; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import gates, needed, rules
from .shared import id_and_text
from .spans import ascii_lower, count_words, word_text

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_BASE = " (?:" + "|".join(p for p, _ in PHRASES) + ")(?= )"

_HIT = "array<struct<start:int,after:int,rank:int,priority:int,order:int,label:string>>"


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def places(text: Column, pattern: Column) -> Column:
    """array<struct<start, end>> in words of a padded word text (" a b "), for a pattern that begins with a space."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + _spaces(x["gap"])
        end = begin + _spaces(x["s"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(F.zip_with(gaps, found, lambda g, s: F.struct(g.alias("gap"), s.alias("s"))), zero, add, lambda acc: acc["out"])


def _hits(text: Column) -> Column:
    """Matches of all rules whose keyword the padded word text holds.

    Rules are data, looked up by keyword: one constant pattern a rule would make each text pay for hundreds of expressions.
    """
    by_keyword: dict[str, list[Column]] = {}
    for k, (label, keyword, p, pattern) in enumerate(rules()):
        by_keyword.setdefault(needed(keyword, pattern), []).append(F.struct(F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(k).alias("order"), F.lit(pattern).alias("pattern")))
    listed = F.array(*[F.struct(F.lit(keyword).alias("keyword"), F.array(*own).alias("rules")) for keyword, own in by_keyword.items()])
    held = F.flatten(F.transform(F.filter(listed, lambda g: F.contains(text, g["keyword"])), lambda g: g["rules"]))
    return F.flatten(
        F.transform(
            F.filter(held, lambda r: F.regexp_instr(text, r["pattern"]) > 0),
            lambda r: F.transform(
                places(text, r["pattern"]),
                # in order of start, longest first, then priority and rule order
                lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("after"), (-r["priority"]).alias("rank"), r["priority"].alias("priority"), r["order"].alias("order"), r["label"].alias("label")),
            ),
        )
    )


def suppressed(hits: Column) -> Column:
    """Sorted hits without those inside another, and of those that overlap the best."""
    zero = F.struct(F.lit(0).alias("reach"), F.array().cast(_HIT).alias("out"))
    outer = F.aggregate(
        F.array_sort(hits),
        zero,
        lambda acc, h: F.struct(F.greatest(acc["reach"], -h["after"]).alias("reach"), F.when(-h["after"] > acc["reach"], F.concat(acc["out"], F.array(h))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"],
    )

    def keep(out: Column, h: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        clear = (F.size(out) == 0) | (-last["after"] <= h["start"])
        return F.when(clear, F.concat(out, F.array(h))).when((h["priority"] > last["priority"]) | ((h["priority"] == last["priority"]) & (h["order"] < last["order"])), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(h))).otherwise(out)

    return F.aggregate(outer, F.array().cast(_HIT), keep)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base: array<struct<start, end>> of base phrases, base_labels (array), detections (array of hits)."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", word_text(ascii_lower(F.coalesce("text", F.lit("")))).alias("words"))
    padded = F.concat(F.lit(" "), F.col("words"), F.lit(" "))
    any_of = F.lit(False)
    for k in gates():
        any_of = any_of | F.contains("words", F.lit(k))
    rows = rows.select("doc_id", count_words(F.col("words")).alias("n_words"), F.when(any_of, padded).alias("padded"))
    based = F.col("padded").contains(" license ") & F.col("padded").rlike(_BASE)
    rows = rows.select(
        "doc_id", "n_words",
        F.when(based, places(F.col("padded"), F.lit(_BASE))).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("base"),
        F.when(based, F.array_sort(F.filter(F.array(*[F.when(F.col("padded").contains(f" {p} "), F.lit(label)) for p, label in PHRASES]), lambda x: x.isNotNull()))).otherwise(F.array().cast("array<string>")).alias("base_labels"),
        F.when(F.col("padded").isNotNull(), _hits(F.col("padded"))).otherwise(F.array().cast(_HIT)).alias("hits"),
    )
    return rows.select("doc_id", "n_words", "base", "base_labels", F.when(F.size("hits") > 0, suppressed(F.col("hits"))).otherwise(F.col("hits")).alias("detections"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("detections", lambda d: d["label"]))))
    score = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])) / 100.0, F.when(F.size("base") > 0, F.lit(0.6)), F.lit(0.0))
    return scan(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.size("detections").cast("long").alias("n_detections"),
    )
