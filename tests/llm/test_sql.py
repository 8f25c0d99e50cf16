"""Queries of this subpackage that SQL can express, against that SQL: on the smallest tables and on hard cases."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from rasterloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def same(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want, got = con.sql(ORACLES[name]).to_arrow_table(), QUERIES[name](spark, str(folder)).toArrow()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = [sorted(zip(*[t[c].to_pylist() for c in columns]), key=repr) for t in (got, want)]
    assert rows[0] == rows[1]
    return got


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_small_tables(spark, name):
    assert same(spark, name, SF).num_rows == 200


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_hard_cases(spark, name, tmp_path):
    rng = np.random.default_rng(7)
    letters = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    key = lambda k: "".join(rng.choice(list(letters[k % 6]), int(rng.integers(20, 70))))
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    texts = [" ".join(key(j) if j % 3 else "plain words2 version2024release_candidate" for j in range(int(rng.integers(1, 6)))) for _ in range(60)]
    texts += [f'é password = "{key(k)}" token:password: {key(k + 1)} AKIA{key(1).upper()[:16]} aKIAX {key(0)}' for k in range(10)]
    for _ in range(30):
        w = words[:]
        for i in rng.choice(20, int(rng.integers(0, 4)), replace=False):
            w[int(i)] = "other"
        a = int(rng.integers(0, 6))
        texts.append("Before " + " ".join(w[a : a + int(rng.integers(9, 20))]) + " after\tİ K")
    texts += ["", None, "Released under the MIT License. mit license apache license", "SPDX-License-Identifier: GPL-2.0-or-later; GNU General Public License, version 2 or any later version, CC BY-SA 4.0"]
    n = len(texts)
    documents = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": texts, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": pa.array([0] * n, pa.int64())})
    pq.write_table(documents, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0, 1, 2], pa.int64()), "text": [item, "five words are too few", "four words only here"]}), tmp_path / "benchmark.parquet")
    got = same(spark, name, tmp_path)
    if name == "op7_secrets":
        assert sum("random" in s for s in got["spans"].to_pylist()) > 30
    if name == "op8_decontaminate":
        assert 5 < sum(got["contaminated"].to_pylist()) < n
