"""Queries over whole texts: against their SQL, brute force or the text itself."""

import random
from collections import Counter

import duckdb
import pytest

from rasterloom import plans  # noqa: F401
from rasterloom.plans.registry import ORACLES, QUERIES


def write(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts = ["The quick brown fox. " * 30, "0" * 300 + "aaaaaaaaab" * 20 + "{" * 50, "Ünïcödé 你好 😀 " * 25, "ab", "x", "", None, "abc \n" * 700]
    return write(spark, tmp_path_factory.mktemp("texts"), texts)


@pytest.mark.parametrize("name", ["b07_bit_packing", "b08_run_tokens", "f14_stream_cost", "g07_runs", "i06_best_stream", "i09_canonical_codes"])
def test_whole_text(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, want = QUERIES[name](spark, folder).toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = [sorted(zip(*[t[c].to_pylist() for c in columns]), key=repr) for t in (got, want)]
    assert rows[0] == rows[1] and rows[0]


def test_long_codes(spark, tmp_path):
    """A byte that is rarer than one in 2 ** 15 gets a longer code."""
    got = {r.symbol: (r.length, r.code) for r in QUERIES["i09_canonical_codes"](spark, write(spark, tmp_path / "t", ["a" * 70_000 + "b"])).collect()}
    assert got == {97: (1, 0), 98: (17, 1)}


LONG = ["The quick brown fox. " * 30, "".join(chr(32 + k * k * 7 % 91) for k in range(900)) * 2, "x", "", None]


@pytest.mark.parametrize("name", ["k01_bool_round_trip", "g08_lazy_parse", "k07_prefix_round_trip"])
def test_round_trips_are_of_whole_texts(spark, tmp_path, name):
    got = [tuple(r) for r in QUERIES[name](spark, write(spark, tmp_path / "t", LONG)).select("doc_id", "i", "b").collect()]
    assert sorted(got) == [(d, i, ord(c)) for d, t in enumerate(LONG) for i, c in enumerate(t or "", 1)]


def test_code_cost_is_of_whole_texts(spark, tmp_path):
    """Against merging the two least weights."""

    def cost(text):
        weights, bits = sorted(Counter(text).values()), 0
        while len(weights) > 1:
            bits += weights[0] + weights[1]
            weights = sorted([weights[0] + weights[1], *weights[2:]])
        return bits

    got = {r.doc_id: r.bits for r in QUERIES["i08_code_cost"](spark, write(spark, tmp_path / "t", LONG[:2])).collect()}
    assert got == {d: cost(t) for d, t in enumerate(LONG[:2])}


def test_longest_match(spark, tmp_path):
    """Against trying every earlier place."""
    texts = ["abcabcabcabcabcabcabcabcabcabcabcabcabc xyz abcabcabc", "The quick brown fox jumps over the lazy dog; the quick brown fox jumps again.", "a" * 60, "abababbabaabbbabababaabbabaababbbabaababab", "ab", "x", "", None]

    def length(s, j, i):
        k = 0
        while i + k < len(s) and s[j + k] == s[i + k]:
            k += 1
        return k

    want = []
    for d, s in enumerate(texts):
        for i in range(1, len(s or "")):
            n, j = max((length(s, j, i), j) for j in range(i))
            want.append((d, i + 1, n, i - j))
    got = QUERIES["e07_longest_match"](spark, write(spark, tmp_path / "t", texts)).select("doc_id", "place", "len", "distance").collect()
    assert sorted(map(tuple, got)) == want


def test_metadata_payload_is_whole(spark, tmp_path):
    got = {r.doc_id: r.payload for r in QUERIES["a12_metadata_payload"](spark, write(spark, tmp_path / "t", LONG)).collect()}
    assert got == {d: (t or "").encode().hex().upper() for d, t in enumerate(LONG)}


def test_matches_of_many_texts_at_once(monkeypatch):
    from rasterloom.plans import structure_queries as q

    plain = q.longest_matches
    followed = []
    monkeypatch.setattr(q, "longest_matches", lambda t, places=None, *rest: followed.extend(places or t) or plain(t, places, *rest))
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh é\U0001f600") for _ in range(300))
    texts = ["", "x", passage, passage + "y" + passage[20:], (passage + "z") * 12 + passage[:150], "".join(rng.choice("ab") for _ in range(400))]
    length, distance = q.matches_of(texts)
    want = [m for t in texts if t for m in [(0, 1), *plain(t)]]
    assert list(zip(length.tolist(), distance.tolist())) == want
    assert not followed  # no place is searched for by itself in such texts
    # chains longer than what is compared at once
    length, distance = q.matches_of(["a" * 1500])
    assert length[1:].tolist() == list(range(1499, 0, -1)) and distance.tolist() == [1] * 1500 and followed
