"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are rates of a text: lexicon densities, second-person words near them, capitals,
punctuation and obfuscation. Trees are fitted on the driver to at most `train_rows` labelled
rows (those with the least hash of the id whose crc32 mod 5 isn't 0), so what is collected
is bounded. Rows with remainder 1 calibrate, the others of them grow the trees. Labels,
language, source and id aren't features.

Besides the written lexicons there is one learned from the training rows, for languages that
those don't cover: words, and beginnings of words, that far more toxic than other documents
hold. A training row's own remainder is left out of the lexicon that its features see.

Defined cases: null text reads as empty and gets the score of a text without features; each
of repeated rows is scored; repeated labels of an id count once, as toxic if any is; null
labels don't count; without labels of both kinds every score is the share of toxic labels,
or 0 if there are none; empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SMALL_CHUNK, Texts, chunks, fold, hand_back, id_and_text, kept, lean, release

TRAIN_ROWS = 40_000
#: Buckets of the learned lexicon, and the bytes of a beginning.
LEARNED_BITS = 17
BEGINNINGS = (5, 6, 7, 8)
#: Least ratio of a word's share of toxic to its share of other documents, for each level.
RATIOS = (4.0, 12.0)
LEAST_TOXIC = 6

#: Lexicons, in lower case: English with some German, French and Spanish.
INSULTS = """idiot idiots idiotic stupid moron moronic dumb dumbass imbecile fool fools foolish loser losers clown clowns jerk jerks
pathetic worthless useless coward liar liars lunatic freak freaks creep creeps retard retarded halfwit dimwit nitwit simpleton
brainless ignorant twit prat git wanker tosser pig swine rat rats weasel crybaby failure hypocrite cretin buffoon dunce
dummkopf trottel arschloch vollidiot depp blödmann imbécile crétin abruti idiote connard estúpido estúpida idiota imbécil tonto""".split()
CONTEMPT = """trash garbage scum filth filthy vermin disgusting disgusted gross vile nasty rotten parasite parasites cockroach
subhuman degenerate savage savages animals worm worms maggot sewer dirt abomination repulsive revolting hideous ugly
abschaum dreck ekelhaft ordure répugnant dégoûtant basura escoria asqueroso""".split()
PROFANITY = """shit shitty bullshit crap crappy fuck fucking fucked fucker ass asshole bastard bitch bitches damn damned hell piss
dick prick cunt slut whore scheiße scheisse merde putain mierda puta joder""".split()
THREATS = """kill killed kills die dies dead death hate hated hates hurt destroy murder shoot hang burn beat stab choke smash
punch suffer attack crush exterminate eliminate töten hasse tuer mourir matar muere odio""".split()
SECOND_PERSON = "you your yours yourself youre ur u ya thou thee du dich dir dein deine euch ihr tu toi te ton ta tes vous votre vos usted ustedes tú ti tus".split()

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True
#: Signs that stand for letters, and the letters.
LEET = dict(zip("0134578@$!|+", "oieastbasilt"))
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in "!?.,;:'\"-()"]] = True

NAMES = ["insults", "contempt", "profanity", "threats", "any_rate", "any_log", "hidden_rate", "spaced_rate", "near_you", "you_rate", "upper", "upper_words", "punctuation", "exclaims", "asks", "symbols", "digits", "stretched", "repeats", "length", "learned_rate", "learned_log", "learned_high_rate", "learned_high_log"]


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


_LOWER = _lower()
_UNLEET = _LOWER.copy()
for _k, _v in LEET.items():
    _UNLEET[ord(_k)] = ord(_v)
_LEET_CHAR = LETTER.copy()
_LEET_CHAR[[ord(c) for c in LEET]] = True


def _hashes_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    bounds = np.cumsum([0, *map(len, raw)])
    t = Texts(np.frombuffer(b"".join(raw), np.uint8), bounds)
    return np.unique(t.hashes(bounds[:-1], bounds[1:]))


_KINDS = [_hashes_of(x) for x in (INSULTS, CONTEMPT, PROFANITY, THREATS)]
_YOU = _hashes_of(SECOND_PERSON)


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = np.searchsorted(of, values)
    return of[np.minimum(at, len(of) - 1)] == values


def word_buckets(low: Texts, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, buckets) of whole words of at least the first beginning's length, and of each beginning of longer ones."""
    shift = np.uint64(64 - LEARNED_BITS)
    out = []
    for k in (None, *BEGINNINGS):
        at = np.flatnonzero(ends - starts >= BEGINNINGS[0] if k is None else ends - starts > k)
        to = ends[at] if k is None else starts[at] + k
        out.append((at, (low.hashes(starts[at], to) >> shift).astype(np.int64)))
    return out


def features(texts: Texts, levels: np.ndarray) -> np.ndarray:
    """One row of NAMES for each document; levels: of each bucket, how many of RATIOS it reaches."""
    n, data = texts.n, texts.data
    low = Texts(_LOWER[data], texts.bounds)
    letters = LETTER[data]
    starts, ends = texts.runs(letters)
    doc, h = texts.document(starts), low.hashes(starts, ends)
    words = np.bincount(doc, minlength=n)
    per = 1.0 / np.maximum(words, 1)
    count = lambda hit: np.bincount(doc[hit], minlength=n)
    kinds = [_member(h, k) for k in _KINDS]
    plain = np.logical_or.reduce(kinds) if len(h) else np.zeros(0, bool)
    you = _member(h, _YOU)
    # a hit within five words after or before a second-person word
    position = np.arange(len(h))
    near = np.zeros(len(h), bool)
    if you.any():
        at = np.flatnonzero(you)
        for side in (np.searchsorted(at, position) - 1, np.searchsorted(at, position)):
            ok = (side >= 0) & (side < len(at))
            to = at[np.clip(side, 0, len(at) - 1)]
            near |= ok & (np.abs(to - position) <= 5) & (doc[to] == doc)
    # words written with signs for letters, and letters apart
    un = Texts(_UNLEET[data], texts.bounds)
    s2, e2 = texts.runs(_LEET_CHAR[data])
    sums = np.concatenate([[0], np.cumsum(letters)])
    odd = (sums[e2] - sums[s2]) < (e2 - s2)
    s2, e2 = s2[odd], e2[odd]
    hits = un.hashes(s2, e2) if len(s2) else np.zeros(0, np.uint64)
    hidden = np.logical_or.reduce([_member(hits, k) for k in _KINDS]) if len(s2) else np.zeros(0, bool)
    hidden_n = np.bincount(texts.document(s2[hidden]), minlength=n)
    single = (ends - starts) == 1
    spaced = np.zeros(len(h), bool)
    if len(h) > 3:
        run = single[:-3] & single[1:-2] & single[2:-1] & single[3:] & (doc[3:] == doc[:-3])
        spaced[:-3] = run
    upper = (data >= 65) & (data <= 90)
    upper_sum = np.concatenate([[0], np.cumsum(upper)])
    shout = (ends - starts >= 3) & (upper_sum[ends] - upper_sum[starts] == ends - starts)
    n_chars = np.maximum(np.diff(texts.bounds), 1)
    n_letters = np.maximum(texts.total(letters), 1)
    stretched = np.zeros(len(data), bool)
    if len(data) > 2:
        stretched[2:] = letters[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    level = np.zeros(len(h), np.int8)
    for at, bucket in word_buckets(low, starts, ends):
        np.maximum.at(level, at, levels[bucket])
    learned, high = count(level >= 1), count(level >= 2)
    any_n = count(plain) + hidden_n
    symbol = ~letters & ~_PUNCTUATION[data] & (data > 32) & ~((data >= 48) & (data <= 57))
    columns = [
        *(100 * count(k) * per for k in kinds), 100 * any_n * per, np.log1p(any_n), 100 * hidden_n * per, 100 * count(spaced) * per,
        100 * count(plain & near) * per, 100 * count(you) * per, texts.total(upper) / n_letters, count(shout) * per,
        texts.total(_PUNCTUATION[data]) / n_chars, texts.total(data == 33) / n_chars, texts.total(data == 63) / n_chars, texts.total(symbol) / n_chars,
        texts.total((data >= 48) & (data <= 57)) / n_chars, texts.total(stretched) / n_letters, count(again) * per, np.log1p(words),
        100 * learned * per, np.log1p(learned), 100 * high * per, np.log1p(high),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)


@dataclass
class Boosted:
    """Trees as arrays: at each inner node a feature and a threshold; leaves hold values."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    steps_x: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps_y: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(1 << LEARNED_BITS, np.int8))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(v)))):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        if not len(self.steps_x):
            return 1 / (1 + np.exp(-m))
        return np.interp(m, self.steps_x, self.steps_y)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 5.0, ridge: float = 2.0) -> Boosted:
    """Histogram trees for the logistic loss."""
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Boosted(base=float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    # zero often holds most rows, so the rest get cuts of their own
    cuts = [np.unique(np.concatenate([c, np.quantile(v[v > 0], np.linspace(0, 1, bins // 2)[:-1]) - 1e-12])) if (v > 0).any() else c for c, v in zip(cuts, x.T)]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    wide = max(len(c) for c in cuts) + 1
    margin = np.full(len(y), model.base)
    inner = (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, w = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            cut = np.full(width, wide, np.int64)
            for j in range(x.shape[1]):
                key = (node - first) * wide + binned[:, j]
                gs = np.bincount(key, g, minlength=width * wide).reshape(width, wide).cumsum(1)
                ws = np.bincount(key, w, minlength=width * wide).reshape(width, wide).cumsum(1)
                total_g, total_w = gs[:, -1:], ws[:, -1:]
                gain = gs**2 / (ws + ridge) + (total_g - gs) ** 2 / (total_w - ws + ridge) - total_g**2 / (total_w + ridge)
                gain[(ws < least) | (total_w - ws < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best + 1e-9
                best = np.where(better, gain[np.arange(width), top], best)
                feature[first : first + width][better] = j
                cut[better] = top[better]
                threshold[first : first + width][better] = cuts[j][top[better]]
            go = binned[np.arange(len(y)), feature[node]] > cut[node - first]
            node = 2 * node + 1 + go
        leaf = node - inner
        value = rate * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, w, minlength=inner + 1) + ridge)
        margin += value[leaf]
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.value.append(value)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the ends of the pooled steps and their means, shrunk a little to the whole mean."""
    order = np.lexsort((y, margin))
    whole = y.mean()
    blocks: list[list[float]] = []
    for m, v in zip(margin[order], y[order]):
        if blocks and blocks[-1][3] == m:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, k, _, end = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += k
            blocks[-1][3] = end
    xs, ys = [], []
    for s, k, a, b in blocks:
        mean = (s + 2 * whole) / (k + 2)
        xs += [a, b] if b > a else [a]
        ys += [mean, mean] if b > a else [mean]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def learned_levels(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Levels of buckets from the numbers of toxic and of other documents that hold them."""
    ratio = ((toxic + 0.5) / (n_toxic + 1)) / ((clean + 0.5) / (n_clean + 1))
    enough = toxic >= LEAST_TOXIC
    return sum(((ratio >= r) & enough).astype(np.int8) for r in RATIOS)


def _lexicon(chosen: DataFrame) -> dict[int, np.ndarray]:
    """Levels for the rows of each fold, from the others, and under 0 from all; chosen has text, toxic, fold."""
    size = 1 << LEARNED_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in lean(batches):
            toxic, folds = b.column(1).to_numpy(), b.column(2).to_numpy()
            for row, end, texts in chunks(b.column(0), SMALL_CHUNK):
                low = Texts(_LOWER[texts.data], texts.bounds)
                starts, ends = texts.runs(LETTER[texts.data])
                doc = texts.document(starts)
                # each bucket once a document; one more counts documents
                keys = [doc[at] * (size + 1) + bucket for at, bucket in word_buckets(low, starts, ends)]
                keys = np.unique(np.concatenate([*keys, np.arange(texts.n) * (size + 1) + size]))
                of, bucket = row + keys // (size + 1), keys % (size + 1)
                for pair in set(zip(folds[row:end].tolist(), toxic[row:end].tolist())):
                    s = sums.setdefault(pair, np.zeros(size + 1, np.int64))
                    s += np.bincount(bucket[(folds[of] == pair[0]) & (toxic[of] == pair[1])], minlength=size + 1)
        for (f, t), s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f), pa.int64()), pa.array(np.full(len(at), t), pa.int32()), pa.array(at), pa.array(s[at])], names=["fold", "toxic", "bucket", "n"])

    sums = chosen.mapInArrow(count, "fold long, toxic int, bucket long, n long").groupBy("fold", "toxic", "bucket").agg(F.sum("n").alias("n")).toArrow()  # buckets times folds at most
    total = np.zeros((5, 2, size + 1))
    total[sums["fold"].to_numpy(), np.minimum(sums["toxic"].to_numpy(), 1), sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    out = {}
    for f in range(5):
        rest = total.sum(0) - (total[f] if f else 0)
        out[f] = learned_levels(rest[1, :-1], rest[0, :-1], rest[1, -1], rest[0, -1])
    return out


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Boosted:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic")).dropna().filter(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # one scan of the corpus; the two passes below read train_rows texts at most
    rows = kept(id_and_text(docs).join(F.broadcast(chosen), "doc_id"))
    lexicon = _lexicon(rows.select("text", "toxic", "fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            folds = b.column(3).to_numpy()
            for row, end, texts in chunks(b.column(1), SMALL_CHUNK):
                part, own = b.slice(row, end - row), folds[row:end]
                x = np.zeros((texts.n, len(NAMES)))
                for f in set(own.tolist()):
                    x[own == f] = features(texts, lexicon[f])[own == f]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    seen = rows.select("doc_id", "text", "toxic", "fold").mapInArrow(run, "doc_id long, toxic int, fold long, x array<double>")
    got = seen.groupBy("doc_id", "toxic", "fold").agg(F.min("x").alias("x")).orderBy("doc_id").toArrow()  # train_rows at most
    y = got["toxic"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Boosted(steps_x=np.array([0.0]), steps_y=np.array([float(y[0]) if len(y) else 0.0]))
    x = np.stack(got["x"].to_pylist())
    hold = got["fold"].to_numpy() == 1
    if hold.all() or len(set(y[~hold])) < 2 or hold.sum() < 50:
        model = grow(x, y)
    else:
        model = grow(x[~hold], y[~hold])
        model.steps_x, model.steps_y = isotonic(model.margin(x[hold]), y[hold])
    model.levels = lexicon[0]
    return model


def scores(model: Boosted, column: pa.Array) -> np.ndarray:
    parts = [np.clip(model.probability(features(t, model.levels)), 0, 1) for _, _, t in chunks(column, SMALL_CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0)


def scorer(model: Boosted):
    """An Arrow function of a text column, for select()."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def toxic_score(column: pa.Array) -> pa.Array:
        hand_back()
        found = pa.array(scores(model, column))
        release()
        return found

    return toxic_score


def assess(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    score = scorer(train(docs, labels, train_rows))
    rows = id_and_text(docs).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
