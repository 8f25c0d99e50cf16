"""The wider near-copy search against brute force on planted copies."""

import re

import numpy as np
import pytest
from rasterloom.llm import near_copies, quality, simhash
from rasterloom.llm.shared import chunks


def words(text):
    return re.findall(r"[^\x00-\x20\x7F!\"'(),\-.:;?]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held(a, b):
    """The share of a's words inside a run of five (or all, if fewer) that b has too."""
    n = min(5, len(a))
    runs = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n == 5 else {tuple(b)}
    at = {i + k for i in range(len(a) - n + 1) if tuple(a[i : i + n]) in runs for k in range(n)}
    return len(at) / len(a) if a else 0.0


def alike(a, b):
    a, b = words(a), words(b)
    return a == b != [] or min(held(a, b), held(b, a)) >= 0.8


def planted(n_bases=60, hot=70, seed=0, most=0.09):
    """Bases of 40 to 400 words, copies of some with words changed, one base with many copies, and texts that share a passage."""
    rng = np.random.default_rng(seed)
    listed = np.array(["".join(rng.choice(list("abcdefghijklmnoprstuv"), int(rng.integers(2, 9)))) for _ in range(3000)])
    odds = 1 / np.arange(1, len(listed) + 1)
    draw = lambda n: rng.choice(listed, n, p=odds / odds.sum()).tolist()
    bases = [draw(int(rng.integers(40, 400))) for _ in range(n_bases)]

    def changed(base):
        w = base[:]
        for i in rng.choice(len(w), max(1, int(len(w) * rng.uniform(0.002, most))), replace=False):
            w[int(i)] = ["changed" + str(int(rng.integers(1000))), w[int(i)].title() + ".", "", "two words"][int(rng.integers(4))]
        return w

    texts, passage = [" ".join(b) for b in bases], draw(60)
    texts += [" ".join(changed(b)) for b in bases[: n_bases // 2]]
    texts += [" ".join(changed(bases[0])) for _ in range(hot)]
    texts += [" ".join(draw(40) + passage + draw(30)) for _ in range(15)]
    texts += [texts[1], texts[1], "", "", "one", "two", "a b c d e", "?!", "!!"]
    order = rng.permutation(len(texts))
    return [texts[i] for i in order]


def groups(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("joined,block", [(2, 16), (16, 1024)])
def test_planted(spark, monkeypatch, joined, block):
    monkeypatch.setattr(near_copies, "JOINED", joined)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in near_copies.keep_first(df).collect()}
    n = len(texts)
    links = [(i, j) for i in range(n) for j in range(i + 1, n) if alike(texts[i], texts[j])]
    narrow = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    want = groups(n, links + [(c, i) for i, c in narrow.items()])
    # nothing is dropped whose group isn't kept, and nearly all copies are
    assert set(want) <= kept
    copies = [i for i in range(n) if want[i] != i]
    assert np.mean([i not in kept for i in copies]) > 0.97 and len(copies) > 80


def test_links_are_exact(spark):
    """Texts that share much, but less than 0.8 of their words, all stay."""
    rng = np.random.default_rng(9)
    listed = [f"w{k}" for k in range(5000)]
    common = rng.choice(listed, 100).tolist()
    texts = [" ".join(common[: 70 + k] + rng.choice(listed, 40 - k).tolist()) for k in range(0, 15) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    close = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if alike(texts[i], texts[j])]
    kept = near_copies.keep_first(df).count()
    assert not close and kept == len(texts)


def hashed(texts):
    import pyarrow as pa

    out = []
    for _, _, t in chunks(pa.array(texts)):
        _, _, h, bounds = near_copies.shingles(t)
        out += [h[a:b].view(np.int64) for a, b in zip(bounds, bounds[1:])]
    return out


def test_similarity_by_hand():
    texts = planted(20, 10, 5, 0.2) + ["a b c d e f", "a b c d e g", "a b c d e", "a b c d", "A, b; c d", "a b a b a b a b a b a b", "a b a b a b c"]
    lists = hashed(texts)
    for i in range(len(texts)):
        for j in range(len(texts)):
            if i != j and words(texts[i]) and words(texts[j]):
                assert (near_copies.alike(lists[i], lists[j]) >= 0.8) == alike(texts[i], texts[j]), (texts[i], texts[j])


def test_links_span_all_pairs():
    texts = [t for t in planted(25, 30, 7, 0.15) if words(t)]
    n = len(texts)
    a, b = near_copies.alike_links(hashed(texts))
    want = groups(n, [(i, j) for i in range(n) for j in range(i + 1, n) if alike(texts[i], texts[j])])
    assert groups(n, list(zip(a.tolist(), b.tolist()))) == want and len(a) < n
    # links within a part are known
    part = np.array(want)
    a, b = near_copies.alike_links(hashed(texts), part)
    assert not len(a)


def test_result_does_not_depend_on_route_size(spark, monkeypatch):
    """Copies on both sides of the threshold: comparing all pairs and comparing blocks keep the same documents."""
    rng = np.random.default_rng(4)
    listed = [f"w{k}" for k in range(4000)]
    texts = []
    for base in (rng.choice(listed, 100).tolist() for _ in range(4)):
        for _ in range(30):
            w = base[:]
            for i in rng.choice(len(w), int(rng.integers(2, 18)), replace=False):
                w[int(i)] = str(rng.choice(listed))
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_copies.simhash, "links", lambda distinct: spark.createDataFrame([], "a long, b long"))  # only the wider search
    kept = []
    for joined, block, share in ((10**6, 1024, 4096), (1, 1024, 4), (1, 4, 4096)):
        monkeypatch.setattr(near_copies, "JOINED", joined)
        monkeypatch.setattr(near_copies, "BLOCK", block)
        monkeypatch.setattr(near_copies, "SHARE", share)
        kept.append({r.doc_id for r in near_copies.keep_first(df).collect()})
    assert kept[0] == kept[1] == kept[2] and 4 < len(kept[0]) < len(texts)


def test_crowded_fingerprints(spark, monkeypatch):
    """Routes that are cut again, and blocks, give the components of all pairs."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = set()
    for b in base:
        for _ in range(120):
            x = b
            for k in rng.integers(0, 64, int(rng.integers(0, 5))):
                x ^= np.uint64(1) << np.uint64(k)
            fp.add(int(x.view(np.int64)))
    fp = sorted(fp)
    near = groups(len(fp), [(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if ((fp[i] ^ fp[j]) & (1 << 64) - 1).bit_count() <= 3])
    df = spark.createDataFrame([(x,) for x in fp], "fp long")
    at = {x: i for i, x in enumerate(fp)}
    for joined, block in ((24, 1024), (2, 8)):
        monkeypatch.setattr(simhash, "JOINED", joined)
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = groups(len(fp), [(at[r.a], at[r.b]) for r in simhash.links(df).collect()])
        assert got == near and len(set(near)) > 3


def test_counts_don_t_rest_on_hashes(monkeypatch):
    """Lines and windows that agree by hash only are told apart; a hash without structure isn't fooled by Thue-Morse words."""
    import pyarrow as pa

    word, other = "a", "b"
    for _ in range(12):
        word, other = word + other, other + word
    assert word != other
    text = f"{word}\n{other}\nx y z w\nx y z w\n"
    for fake in (False, True):
        if fake:
            monkeypatch.setattr(quality.Texts, "hashes", lambda self, a, b: np.zeros(len(a), np.uint64))
        ((_, _, t),) = chunks(pa.array([text]))
        got = quality.surface(t, *t.words())
        assert got["n_dup_lines"].tolist() == [1] and got["n_repeat_words"].tolist() == [8], got


def test_exploded_routes_are_not_broadcast(spark):
    """Spark takes what is exploded for as small as before, so a join would send it through the driver."""
    from pyspark.sql import functions as F

    from rasterloom.llm import simhash
    from rasterloom.llm.shared import kept

    few = kept(spark.range(2000).select((F.col("id") % 700).alias("fp")))
    rows = few.select("fp", F.posexplode(F.array(*[F.col("fp") % (100 + k) for k in range(20)])).alias("choice", "route"))
    sized = simhash._sized(rows)
    assert sized.count() == 40_000
    assert "Broadcast" not in sized._jdf.queryExecution().executedPlan().toString()
