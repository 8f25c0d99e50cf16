"""Nulls, empty tables, repeated rows, long texts and clashing columns, through every operator and stage."""

import public_tokenizers
import pytest
from rasterloom.llm import bpe, decontaminate, language, license_scan, near_copies, pii, quality, secret_scan, simhash, token_order, toxicity
from rasterloom.llm.shared import table

LABELS = [(1, 1, 0), (4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (10, 1, 1), (2, 1, 0), (8, 1, 0)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "a b c d e f g h i j a b c d"), (None, "x"), (2, None), (2, "")], "item_id long, text string")


def _order(d, tmp_path):
    return token_order.materialise(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, str(tmp_path / "s"), stable=False)


CASES = {
    "licenses": lambda d, la, be, tmp: license_scan.report(d), "pii": lambda d, la, be, tmp: pii.report(d, "k"), "simhash": lambda d, la, be, tmp: simhash.near_duplicates(d), "quality": lambda d, la, be, tmp: quality.assess(d, la),
    "bpe": lambda d, la, be, tmp: bpe.digests(d, public_tokenizers.path("word_bpe_49k.json")), "secrets": lambda d, la, be, tmp: secret_scan.report(d), "decontaminate": lambda d, la, be, tmp: decontaminate.assess(d, be),
    "toxicity": lambda d, la, be, tmp: toxicity.assess(d, la),
}


@pytest.mark.parametrize("name", CASES)
def test_odd(name, odd, labels, bench, tmp_path):
    rows = CASES[name](odd, labels, bench, tmp_path).collect()
    assert len(rows) == odd.count()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    assert ids == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.select("doc_id").collect())
    same = [r for r in rows if r.doc_id == 4]
    assert len(same) == 2 and same[0] == same[1]


@pytest.mark.parametrize("name", CASES)
def test_empty(name, none, labels, bench, tmp_path):
    assert CASES[name](none, labels.limit(0), bench.limit(0), tmp_path).collect() == []


#: Names that operators use inside, for the tables beside documents.
CLASHING = ["doc_id_", "text_hash", "words", "seed", "pos", "item", "item_words", "start", "q", "trusted", "fold", "n", "host", "markup", "ll", "id", "lang", "domain", "vote", "prior", "route", "node", "label"]


@pytest.mark.parametrize("name", ["quality", "decontaminate", "toxicity"])
def test_clashing_columns_of_other_tables(name, odd, labels, bench, tmp_path):
    from pyspark.sql import functions as F

    more = lambda df: df.withColumns({c: F.lit(c) for c in CLASHING if c not in df.columns})
    a, b = (sorted(map(repr, CASES[name](odd, la, be, tmp_path).collect())) for la, be in ((labels, bench), (more(labels).withColumn("text", F.lit("x")), more(bench).withColumn("doc_id", F.lit(4)))))
    assert a == b


def test_clashing_columns_of_pages(spark, odd):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "http://x.de/", "<html lang=de><p>der die das</p>"), (2, "http://y.fr/", "<p>le la les</p>")], "page_id long, url string, html string")
    a, b = (sorted(map(repr, language.identify(odd, p).collect())) for p in (pages, pages.withColumns({c: F.lit(c) for c in [*CLASHING, "doc_id", "text", "source"]})))
    assert a == b


def test_repeated_rows_of_order_and_language(odd, tmp_path):
    """Each of two equal rows has its own slots with the same tokens, and the same language."""
    rows = [r for r in _order(odd, tmp_path).collect() if r.doc_id == 4]
    assert len(rows) == 2 and len({r.slot for r in rows}) == 2 and len({(r.seq_no, r.n_tokens, r.crc) for r in rows}) == 1
    pages = odd.sparkSession.createDataFrame([], "page_id long, url string, html string")
    same = [r for r in language.identify(odd, pages).collect() if r.doc_id == 4]
    assert len(same) == 2 and same[0] == same[1]


def test_token_order_odd(odd, none, tmp_path):
    rows = _order(odd, tmp_path).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and {r.doc_id for r in rows} == {3, 4, 5, 6, 7, 8, 9, 10, 11, None}
    assert _order(none, tmp_path / "none").collect() == []


def test_language_odd(spark, odd, none):
    pages = spark.createDataFrame([(1, None, None), (2, "http://x.de/", "<html lang=de><p>der die das</p>"), (2, "http://x.de/", "<html lang=de><p>der die das</p>"), (None, "not a url", ""), (3, "https://a.b.fr", "<html lang='xx'>")], "page_id long, url string, html string")
    assert language.identify(odd, pages).count() == odd.count() + 5
    assert language.identify(none, pages.limit(0)).count() == 0
    assert {r.lang_id for r in language.identify(none, pages).collect()} == {None}


def test_simhash_odd(odd):
    got = simhash.near_duplicates(odd).collect()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert sorted(r.doc_id for r in zero) == [1, 2, 3] and {r.component_id for r in zero} == {1}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}


def test_stages(spark, odd, none, tmp_path):
    """Each stage of the pipeline keeps the columns and does its part."""
    pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd, none):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == docs.columns, name
            out.collect()
    assert pipeline.STAGES[-1][1](spark, odd, "/root/testdata/sf0.001").count() == odd.count()
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in pipeline.drop_near_duplicates(spark, odd, "").collect())
    assert kept == [(False, i) for i in (1, 4, 6, 7, 8, 9, 10, 11)] + [(True, 0)]


def test_pipeline(spark, sf):
    """The pipeline against its stages' decisions put together by hand."""
    pipeline = pytest.importorskip("corpus_pipeline")
    got = {r.doc_id: r.ids_sha256 for r in pipeline.run(spark, sf).collect()}
    docs, labels, bench = (table(spark, sf, t) for t in ("documents", "labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity.assess(docs, labels).collect() if r.predicted}
    left = docs.filter(~docs.doc_id.isin(list(toxic))) if toxic else docs
    near = {r.doc_id for r in left.collect()} - {r.doc_id for r in near_copies.keep_first(left).collect()}
    assert near >= {r.doc_id for r in simhash.near_duplicates(left).collect() if r.component_id != r.doc_id}
    left = left.filter(~left.doc_id.isin(list(near))) if near else left
    bad = {r.doc_id for r in decontaminate.assess(left, bench).collect() if r.contaminated}
    ids = {r.doc_id for r in docs.collect()} - toxic - near - bad
    assert got.keys() == ids and near and bad
    clean = {r.doc_id for r in secret_scan.report(docs).collect() if not r.spans} & ids
    plain = {r.doc_id: r.ids_sha256 for r in bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert all(got[i] == plain[i] for i in clean) and all(got[i] != plain[i] for i in ids - clean)
