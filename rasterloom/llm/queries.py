"""The registered queries of this subpackage: each operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, language, license_rules, license_scan, pii, quality, secret_scan, simhash, token_order, toxicity
from .shared import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is that of the session, or one for these public tables only."""
    return pii.report(table(spark, sf_dir, "documents"), spark.conf.get("spark.rasterloom.pii.key", None) or "key of the synthetic tables")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_order.ordered(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_licenses, op2_pii, op3_simhash, op4_token_order, op5_quality, op6_bpe, op7_secrets, op8_decontaminate, op9_language, op10_toxicity)
}
#: op8 without hashing: every diagonal with enough equal words, whether a mask fits on it, and its best stretch by prefix sums.
_FITS = " OR ".join("(" + " AND ".join(f"lead(same, {k}) OVER dg" for k, bit in enumerate(mask) if bit == "1") + f" AND lead(i, {len(mask) - 1}) OVER dg IS NOT NULL)" for mask in decontaminate.MASKS)
_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _places(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """SQL of one kind's matches with their places: gaps and matches alternate."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, gap_sum + coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, s FROM (
  SELECT doc_id, k, s, g, sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY k) AS gap_sum FROM (
    SELECT doc_id, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS s, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap FROM (
      SELECT doc_id, regexp_extract_all(t, '{quoted}') AS ms, regexp_extract_all(t, '{quoted}', {group}) AS gs, string_split_regex(t, '{quoted}') AS gaps FROM d) WHERE len(ms) > 0)) QUALIFY length(g) >= {least}"""


def _op7_sql() -> str:
    """op7 with the tests written out over lists."""
    s7 = secret_scan
    kinds = [(0, "assign", s7.ASSIGN, 1, 6), (1, "access", s7.ACCESS, 0, 20), (2, "hex", "[0-9a-f]+", 0, 24), (3, "random", "[A-Za-z0-9+/_-]{20,}", 0, 20)]
    found = " UNION ALL ".join(f"SELECT * FROM ({_places(*k)})" for k in kinds)
    encoding = "CASE " + " ".join(f"WHEN regexp_matches(s, '{pattern}') THEN '{letters}'" for _, pattern, letters in s7.ENCODINGS[:-1]) + f" ELSE '{s7.ENCODINGS[-1][2]}' END"
    def below(z: str) -> str:
        power = lambda factors: " + ".join(f"{f!r} * pow(abs({z}), {len(factors) - 1 - k})" for k, f in enumerate(factors))
        tail = f"(exp(-pow({z}, 2) / 2) * CASE WHEN abs({z}) < 7 THEN ({power(s7.TAIL_OVER)}) / ({power(s7.TAIL_UNDER)}) ELSE 1 / (abs({z}) * 2.5066282746310002) END)"
        return f"CASE WHEN {z} <= 0 THEN {tail} ELSE 1 - {tail} END"

    same = " + ".join(f"pow(length(regexp_replace(letters, '{c}', '', 'g')) / k, 2)" for c in ("[^0-9]", "[^A-Z]", "[^a-z]", "[0-9A-Za-z]"))
    z_chi, z_runs = "(chi - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n)", "(changes - (n - 1) * (1 - same)) / sqrt((n - 1) * same * (1 - same))"
    # the binomial tail by log-gamma, term by term
    runs = f"least(1.0, list_sum([exp(lgamma(n) - lgamma(i + 1) - lgamma(n - i) + i * ln({s7.CHANGE}) + (n - 1 - i) * ln(1 - {s7.CHANGE})) FOR i IN range(CAST(changes AS BIGINT), CAST(n AS BIGINT))]))"
    log = lambda p: f"ln(greatest({p}, {s7.LEAST_P}))"
    mean = "(1 + h * q * (h - 1 - 0.5 * (2 - h) * (h - 1) * (1 - 3 * h) * q))"
    z_away = f"(pow(greatest(chi, 0) / (k - 1 + away), h) - {mean}) / (h * sqrt(2 * q) * (1 + 0.5 * (h - 1) * (1 - 3 * h) * q))"
    z_turned = f"(atanh(least(abs(r), 0.999999)) - atanh({s7.SERIAL})) * sqrt(n - 3)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}), base AS (SELECT *, start + length(s) AS stop FROM f WHERE rank < 3),
c AS (SELECT f.*, start + length(s) AS stop, CAST(length(s) AS DOUBLE) AS n, {encoding} AS letters FROM f WHERE rank = 3 AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.start < f.start + length(f.s) AND f.start < b.stop)),
x AS (SELECT *, CAST(length(letters) AS DOUBLE) AS k, string_split(s, '') AS cs, translate(s, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_', '{"0" * 10}{"A" * 26}{"a" * 26}{"+" * 4}') AS kinds FROM c),
y AS (SELECT *, {same} AS same, list_sum([pow(length(s) - length(replace(s, e, '')), 2) FOR e IN list_distinct(cs)]) AS squares, list_sum([CASE WHEN kinds[i] <> kinds[i + 1] THEN 1.0 ELSE 0.0 END FOR i IN range(1, length(s))]) AS changes, [CAST(instr(letters, e) AS DOUBLE) FOR e IN cs] AS ranks FROM x),
z AS (SELECT *, [e - list_sum(ranks) / n FOR e IN ranks] AS off, k * squares / n - n AS chi, (n - 1) * greatest(k * {s7.COINCIDENCE} - 1, 0.05) AS away FROM y),
w AS (SELECT *, CASE WHEN list_sum([e * e FOR e IN off]) = 0 THEN 1.0 ELSE list_sum([off[i] * off[i + 1] FOR i IN range(1, len(off))]) / list_sum([e * e FOR e IN off]) END AS r FROM z),
w1 AS (SELECT *, (k - 1 + 2 * away) / pow(k - 1 + away, 2) AS q, 1 - 2 * (k - 1 + away) * (k - 1 + 3 * away) / (3 * pow(k - 1 + 2 * away, 2)) AS h FROM w),
w2 AS (SELECT *, {z_away} AS z1, {z_turned} AS z3 FROM w1),
v AS (SELECT *, least(1.0, exp(1 + {s7.WEIGHTS[0]} * {log(below('z1'))} + {s7.WEIGHTS[1]} * {log(runs)} + {s7.WEIGHTS[2]} * {log(below('z3'))})) AS pg, {z_chi} AS z_chi, {z_runs} AS z_runs, r * sqrt(n) AS z_serial FROM w2),
u AS (SELECT *, pg * sum(n) OVER (PARTITION BY doc_id) / (n * count(*) OVER (PARTITION BY doc_id)) AS p, count(*) OVER (PARTITION BY doc_id) AS m FROM v),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM u), lim AS (SELECT doc_id, max(CASE WHEN p <= {s7.ALPHA} * i / m THEN p END) AS most FROM l GROUP BY 1),
good AS (SELECT l.doc_id, rank, kind, start, stop FROM l JOIN lim USING (doc_id) WHERE p <= most AND z_chi <= {s7.FAR} AND abs(z_runs) <= {s7.FAR} AND abs(z_serial) <= {s7.FAR}),
every AS (SELECT doc_id, rank, kind, start, stop FROM base UNION ALL SELECT * FROM good),
g AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS named,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans FROM every GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(named, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


def _apart(pattern: str) -> str:
    """A rule's pattern for words that each have a space on both sides, as this engine has no lookahead."""
    out, inside = "", False
    for c in pattern.removeprefix(" ").removesuffix("(?= )"):
        inside = c == "[" or inside and c != "]"
        out += "(?:  )" if c == " " and not inside else c
    return f" {out} "


def _op1_sql() -> str:
    """op1: all rules on all texts, without keywords; overlaps are resolved by a recursion over each text's hits."""
    q = lambda x: x.replace("'", "''")
    listed = ", ".join(f"({k}, '{q(label)}', {priority}, '{q(_apart(pattern))}')" for k, (label, _, priority, pattern) in enumerate(license_rules.rules()))
    phrases = license_scan.PHRASES
    base = " (?:" + "|".join(p.replace(" ", "(?:  )") for p, _ in phrases) + ") "
    count = lambda x: f"(length({x}) - length(replace({x}, ' ', ''))) // 2"
    flat = "unnest(range(1, len(ms) + 1)) AS j, unnest(ms) AS s, unnest(gaps[1:len(ms)]) AS gap"
    placed = f"CAST(sum({count('gap')}) OVER w + coalesce(sum({count('s')}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"
    names = "list_concat(" + "list_concat(".join(f"CASE WHEN contains(one, ' {p} ') THEN ['{label}'] ELSE CAST([] AS VARCHAR[]) END, " for p, label in phrases[:-1])
    names += f"CASE WHEN contains(one, ' {phrases[-1][0]} ') THEN ['{phrases[-1][1]}'] ELSE CAST([] AS VARCHAR[]) END" + ")" * (len(phrases) - 1)
    return f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
d AS (SELECT doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, ' ') || ' ' AS one, ' ' || array_to_string(ws, '  ') || ' ' AS two FROM t),
rl(ord, label, priority, re) AS (VALUES {listed}),
h0 AS (SELECT doc_id, ord, label, priority, regexp_extract_all(two, re) AS ms, string_split_regex(two, re) AS gaps FROM d, rl WHERE regexp_matches(two, re)),
h1 AS (SELECT doc_id, ord, label, priority, {flat} FROM h0 WHERE len(ms) > 0),
h2 AS (SELECT doc_id, ord, label, priority, s, {placed} AS start FROM h1 WINDOW w AS (PARTITION BY doc_id, ord ORDER BY j)),
h3 AS (SELECT *, start + {count('s')} AS stop FROM h2),
h4 AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, priority DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h3),
h5 AS (SELECT doc_id, ord, label, priority, start, stop, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop DESC, priority DESC, ord) AS k FROM h4 WHERE stop > coalesce(reach, 0)),
r AS (SELECT doc_id, k, [{{'start': start, 'stop': stop, 'priority': priority, 'ord': ord, 'label': label}}] AS kept FROM h5 WHERE k = 1
  UNION ALL SELECT h.doc_id, h.k, CASE WHEN kept[-1].stop <= h.start THEN list_append(kept, {{'start': h.start, 'stop': h.stop, 'priority': h.priority, 'ord': h.ord, 'label': h.label}})
    WHEN h.priority > kept[-1].priority OR h.priority = kept[-1].priority AND h.ord < kept[-1].ord THEN list_append(kept[1:len(kept) - 1], {{'start': h.start, 'stop': h.stop, 'priority': h.priority, 'ord': h.ord, 'label': h.label}}) ELSE kept END
  FROM r JOIN h5 h ON h.doc_id = r.doc_id AND h.k = r.k + 1),
kept AS (SELECT doc_id, kept FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1),
b0 AS (SELECT doc_id, regexp_extract_all(two, '{base}') AS ms, string_split_regex(two, '{base}') AS gaps FROM d), b1 AS (SELECT doc_id, {flat} FROM b0 WHERE len(ms) > 0), b2 AS (SELECT doc_id, {placed} AS start FROM b1 WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM b2 GROUP BY 1),
x AS (SELECT d.doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, list_sort(CASE WHEN n_base > 0 THEN {names} ELSE CAST([] AS VARCHAR[]) END) AS bl, [e.label FOR e IN kept] AS ml, [e.priority FOR e IN kept] AS ps FROM d LEFT JOIN b USING (doc_id) LEFT JOIN kept USING (doc_id))
SELECT doc_id, n_words, n_base, first_word, last_word, array_to_string(bl, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(ml, CAST([] AS VARCHAR[]))))), ',') AS labels,
  CAST(coalesce(list_max(ps) / 100.0, CASE WHEN n_base > 0 THEN 0.6 END, 0.0) AS DOUBLE) AS score, CAST(coalesce(len(ml), 0) AS BIGINT) AS n_detections FROM x"""


ORACLES: dict[str, str] = {
    "op1_licenses": _op1_sql(),
    "op7_secrets": _op7_sql(),
    "op8_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents), b AS (SELECT item_id, {_WORDS.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
dw AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d), bw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM b WHERE len(ws) >= 5),
m AS (SELECT doc_id, item_id, n, dw.i - bw.i AS diagonal FROM dw JOIN bw USING (w) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5),
e AS (SELECT m.doc_id, m.item_id, m.n, m.diagonal, bw.i, dw.w = bw.w AS same, CASE WHEN dw.w = bw.w THEN 1 ELSE -2 END AS v FROM m JOIN bw ON bw.item_id = m.item_id JOIN dw ON dw.doc_id = m.doc_id AND dw.i = m.diagonal + bw.i),
p AS (SELECT *, sum(v) OVER dg AS s, coalesce({_FITS}, false) AS fits FROM e WINDOW dg AS (PARTITION BY doc_id, item_id, diagonal ORDER BY i)),
q AS (SELECT *, s - least(0, coalesce(min(s) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS run FROM p),
o AS (SELECT doc_id, item_id, diagonal, max(run) AS score FROM q GROUP BY 1, 2, 3, n HAVING max(run) >= least(10, n) AND CASE WHEN n >= {decontaminate.SPAN} THEN bool_or(fits) ELSE bool_and(same) AND count(*) = n END),
a AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, count(*) AS n_overlaps, CAST(max(score) AS BIGINT) AS best_score FROM o GROUP BY 1), l AS (SELECT doc_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY 1)
SELECT d.doc_id, a.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(n_overlaps, 0) AS n_overlaps, coalesce(best_score, 0) AS best_score, coalesce(items, '') AS items
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN l USING (doc_id)""",
}
