"""Column expressions over whole texts, shared by the native operators: word forms, matches and their places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All that separates words: ASCII characters other than letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """The text with A-Z in lower case; letters beyond ASCII may change case too, but none becomes an ASCII one."""
    # the two letters whose lower case begins with i and is k
    return F.when(text.rlike("[\u0130\u212A]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def word_text(lowered: Column) -> Column:
    """The words of a lower-cased text with single spaces between; empty without words."""
    return F.trim(F.regexp_replace(lowered, SEPARATORS, " "))


def count_words(words: Column) -> Column:
    """The number of words of word_text()."""
    return F.when(words == "", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")


def matches(text: Column, pattern: Column, least: int = 0, group: int = 0) -> Column:
    """array<struct<start, end, s>> of the leftmost non-overlapping matches whose group has `least` characters; code points, end exclusive."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.regexp_extract_all(text, pattern, F.lit(group))
    gaps = F.split(text, pattern, -1)
    step = F.zip_with(F.slice(gaps, 1, F.size(found)), F.arrays_zip(found.alias("s"), sized.alias("g")), lambda gap, m: F.struct(F.length(gap).alias("gap"), m["s"].alias("s"), F.length(m["g"]).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,s:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["s"])
        more = F.array(F.struct(begin.alias("start"), end.alias("end"), x["s"].alias("s")))
        return F.struct(end.alias("at"), F.when(x["n"] >= least, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(step, start, add, lambda acc: acc["out"])


NO_MATCHES = "array<struct<start:int,end:int,s:string>>"


def matches_if(gate: Column, text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    return F.when(gate, matches(text, F.lit(pattern), least, group)).otherwise(F.array().cast(NO_MATCHES))
