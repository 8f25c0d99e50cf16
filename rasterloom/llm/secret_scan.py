"""Secret scans: named patterns, and a randomness test battery over the other long tokens.

A candidate is a maximal run of 20 or more characters of the base64 alphabets that has a digit
and a letter. Its encoding is inferred (hex, base32, base36, alphanumeric, base64, base64url),
and three tests are run over its symbols:

- chi-squared uniformity over the encoding's alphabet,
- runs of character classes (digit, lower, upper, other),
- serial correlation of neighbouring symbols' ranks in the alphabet.

Each gives a p-value under a structured null (what words, identifiers and counters look like:
a non-central chi-squared tail, a binomial tail, and a normal one of the transformed correlation)
and a z-score under the uniform null. The three look at the same symbols, so they aren't independent: their p-values are
combined as e times their weighted geometric mean, which is a p-value however they hang together. A candidate
that is far from uniform in any test is dropped. A document's candidates are a family, in which
Benjamini-Hochberg with weights in proportion to length controls false discovery: a long token
may be weaker evidence a symbol, a short one must be stronger.

Defined cases: null text reads as empty and has no spans; each of repeated rows is scanned;
spans are in code points with exclusive end; a random span never touches a named one; empty
input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text
from .spans import matches_if

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+"
#: Share of false discoveries.
ALPHA = 0.05
#: The structured null: chance that two symbols of prose are equal, that the class changes at a step, and a usual serial correlation.
COINCIDENCE, CHANGE, SERIAL = 0.065, 0.20, 0.48
#: What chi-squared, runs and serial correlation weigh in the mean.
WEIGHTS = (1 / 3, 1 / 3, 1 / 3)
#: Smaller p-values count as this one.
LEAST_P = 1e-30
#: Greatest distance from the uniform null, in standard deviations.
FAR = 4.0

#: (name, pattern of the whole token, alphabet), the first that fits.
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]


def _let(value: Column, of) -> Column:
    """of(value), with the value worked out once."""
    return F.transform(F.array(value), of)[0]


# The rational approximation of the normal distribution's tail (Hart, algorithm 5666), highest power first.
TAIL_OVER = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_UNDER = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _polynomial(x: Column, factors: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for f in factors:
        out = out * x + F.lit(f)
    return out


def below(z: Column) -> Column:
    """The normal distribution function, to about 1e-9 of the tail's own size; beyond 7 deviations a little more than it."""

    def tail(x: Column) -> Column:
        return F.exp(-x * x / 2) * F.when(x < 7, _polynomial(x, TAIL_OVER) / _polynomial(x, TAIL_UNDER)).otherwise(1 / (x * 2.5066282746310002))

    return _let(z, lambda v: F.when(v <= 0, tail(-v)).otherwise(1 - tail(v)))


def at_least(count: Column, trials: Column, chance: float) -> Column:
    """The chance of `count` or more successes: the first term by logarithms, the others by their ratios."""
    c, m = count.cast("int"), trials.cast("int")
    first = F.when(c > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(c, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log((m - i + 1) / i))).otherwise(0.0)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * (m - k) / (k + 1) * (chance / (1 - chance))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    rest = F.when(c < m, F.aggregate(F.sequence(c, F.greatest(m - 1, c)), zero, add, lambda acc: acc["sum"])).otherwise(1.0)
    return F.least(F.lit(1.0), F.exp(first + c * F.log(F.lit(chance)) + (m - c) * F.log(F.lit(1 - chance))) * rest)


def chi_below(x: Column, free: Column, away: Column) -> Column:
    """The non-central chi-squared distribution function, by Sankaran's power transformation; at 0.0005 up to a third too large."""
    whole, twice = free + away, free + 2 * away

    def z(h: Column) -> Column:
        p = twice / (whole * whole)
        m = (h - 1) * (1 - 3 * h)
        mean = 1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p)
        return (F.pow(F.greatest(x, F.lit(0.0)) / whole, h) - mean) / (h * F.sqrt(2 * p) * (1 + 0.5 * m * p))

    return below(_let(1 - 2 * whole * (free + 3 * away) / (3 * twice * twice), z))


def battery(token: Column) -> Column:
    """struct<encoding, n, z_chi, z_runs, z_serial, p> of a token of base64 letters."""
    name, letters = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][2])
    for n_, pattern, alphabet in reversed(ENCODINGS[:-1]):
        fits = token.rlike(pattern)
        name, letters = F.when(fits, n_).otherwise(name), F.when(fits, alphabet).otherwise(letters)

    def added(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, c: a + c)

    def symbols(x: Column) -> Column:
        s, letters = x["s"], x["letters"]
        each = F.split(s, "")
        kinds = F.split(F.translate(s, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_", "0" * 10 + "A" * 26 + "a" * 26 + "+" * 4), "")
        before, after = F.slice(kinds, 1, F.length(s) - 1), F.slice(kinds, 2, F.length(s) - 1)
        # the share of steps within a class if symbols were uniform over the alphabet
        same = added(F.array(*[F.pow(F.length(F.regexp_replace(letters, c, F.lit(""))) / F.length(letters), F.lit(2.0)) for c in ("[^0-9]", "[^A-Z]", "[^a-z]", "[0-9A-Za-z]")]))
        return F.struct(
            x["name"].alias("name"), F.length(letters).cast("double").alias("k"), F.length(s).cast("double").alias("n"), same.alias("same"),
            added(F.zip_with(before, after, lambda a, b: (a != b).cast("double"))).alias("changes"),
            F.transform(each, lambda c: F.instr(letters, c).cast("double")).alias("rank"),
            added(F.transform(F.array_distinct(each), lambda c: F.pow(F.length(s) - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))).alias("squares"),
        )

    def centred(x: Column) -> Column:
        return _let(added(x["rank"]) / x["n"], lambda mean: F.struct(x.alias("x"), F.transform(x["rank"], lambda c: c - mean).alias("off")))

    def statistics(y: Column) -> Column:
        x, off, n = y["x"], y["off"], y["x"]["n"]
        along = added(F.zip_with(F.slice(off, 1, F.size(off) - 1), F.slice(off, 2, F.size(off) - 1), lambda a, b: a * b))
        r = _let(added(F.transform(off, lambda c: c * c)), lambda spread: F.when(spread == 0, 1.0).otherwise(along / spread))
        away = (n - 1) * F.greatest(x["k"] * COINCIDENCE - 1, F.lit(0.05))
        return F.struct(x.alias("x"), (x["k"] * x["squares"] / n - n).alias("chi"), r.alias("r"), away.alias("away"))

    def values(y: Column) -> Column:
        x, n, free, chi = y["x"], y["x"]["n"], y["x"]["k"] - 1, y["chi"]
        turned = lambda r: 0.5 * F.log((1 + r) / (1 - r))
        p_chi = chi_below(chi, free, y["away"])
        p_runs = at_least(x["changes"], n - 1, CHANGE)
        p_serial = below((turned(F.least(F.abs(y["r"]), F.lit(0.999999))) - turned(F.lit(SERIAL))) * F.sqrt(n - 3))
        log = lambda p: F.log(F.greatest(p, F.lit(LEAST_P)))
        p = F.least(F.lit(1.0), F.exp(1 + sum(w * log(q) for w, q in zip(WEIGHTS, (p_chi, p_runs, p_serial)))))
        z_runs = (x["changes"] - (n - 1) * (1 - x["same"])) / F.sqrt((n - 1) * x["same"] * (1 - x["same"]))
        return F.struct(x["name"].alias("encoding"), n.alias("n"), ((chi - free) / F.sqrt(2 * free * (n - 1) / n)).alias("z_chi"), z_runs.alias("z_runs"), (y["r"] * F.sqrt(n)).alias("z_serial"), p.alias("p"))

    start = F.struct(token.alias("s"), name.alias("name"), letters.alias("letters"))
    return _let(_let(_let(_let(start, symbols), centred), statistics), values)


def discoveries(tested: Column) -> Column:
    """Of array<struct<start, end, t>> those that hold under weighted Benjamini-Hochberg and look uniform."""
    def judged(x: Column) -> Column:
        m = F.size(x["each"]).cast("double")
        weighed = lambda c: c["t"]["p"] * x["all_n"] / (c["t"]["n"] * m)
        uniform = lambda c: (c["t"]["z_chi"] <= FAR) & (F.abs(c["t"]["z_runs"]) <= FAR) & (F.abs(c["t"]["z_serial"]) <= FAR)
        limit = F.coalesce(F.array_max(F.transform(F.array_sort(F.transform(x["each"], weighed)), lambda p, i: F.when(p <= ALPHA * (i + 1) / m, p))), F.lit(-1.0))
        return _let(limit, lambda most: F.filter(x["each"], lambda c: (weighed(c) <= most) & uniform(c)))

    return _let(F.struct(tested.alias("each"), F.aggregate(tested, F.lit(0.0), lambda a, c: a + c["t"]["n"]).alias("all_n")), judged)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, found: array<struct<start, end, rank, kind>> in order of start and then of kind; text as read (null as empty)."""
    text = F.col("text")
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce(text, F.lit("")))
    return rows.withColumn("found", found(text))


def found(text: Column) -> Column:
    """The spans of a text column that isn't null."""
    assign = matches_if(text.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), text, ASSIGN, 6, 1)
    access = matches_if(text.contains("AKIA"), text, ACCESS, 20)
    hexes = matches_if(text.rlike(HEX), text, HEX, 24)
    other = matches_if(text.rlike(CANDIDATE), text, CANDIDATE)

    def named(spans: Column, rank: int, kind: str) -> Column:
        return F.transform(spans, lambda c: F.struct(c["start"].alias("start"), F.lit(rank).alias("rank"), c["end"].alias("end"), F.lit(kind).alias("kind")))

    none = F.array().cast("array<struct<start:int,end:int,t:struct<encoding:string,n:double,z_chi:double,z_runs:double,z_serial:double,p:double>>>")

    def whole(x: Column) -> Column:
        base = x["base"]
        free = F.filter(x["other"], lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
        random = _let(free, lambda those: F.when(F.size(those) > 0, _let(F.transform(those, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), battery(c["s"]).alias("t"))), discoveries)).otherwise(none))
        return F.array_sort(F.concat(base, named(random, 3, "random")))

    base = F.concat(named(assign, 0, "assign"), named(access, 1, "access"), named(hexes, 2, "hex"))
    return _let(F.struct(base.alias("base"), other.alias("other")), whole)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat(c["kind"], F.lit(":"), c["start"], F.lit(":"), c["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    of = lambda kind: F.size(F.filter("found", lambda c: c["kind"] == kind)).cast("long")
    base = F.filter("found", lambda c: c["rank"] < 3)
    return scan(docs).select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, c: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(c["start"] - acc["at"], F.lit(0)))
        more = F.when(c["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), more.alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))
