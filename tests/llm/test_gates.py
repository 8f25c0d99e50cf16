"""Cheap tests before the patterns let every match of a pattern through."""

import random
import re
from pathlib import Path
from re import _constants as c
from re import _parser as parser

from rasterloom.llm import license_scan, pii
from rasterloom.llm.license_rules import gates, needed, rules


def sample(parts, rng):
    """A text that a parsed pattern matches."""
    out = ""
    for op, arg in parts:
        if op is c.LITERAL:
            out += chr(arg)
        elif op is c.NOT_LITERAL:
            out += "q"
        elif op is c.IN:
            kind, of = rng.choice(arg) if arg[0][0] is not c.NEGATE else (c.LITERAL, ord("q"))
            out += chr(of) if kind is c.LITERAL else chr(rng.randint(*of)) if kind is c.RANGE else "7"
        elif op is c.BRANCH:
            out += sample(rng.choice(arg[1]), rng)
        elif op is c.SUBPATTERN:
            out += sample(arg[3], rng)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        else:
            assert op is c.ASSERT, op
            out += " "
    return out


def test_matches_hold_what_rules_need():
    rng, first = random.Random(5), gates()
    for _, keyword, _, pattern in rules():
        words = needed(keyword, pattern)
        assert len(words) > 2, pattern  # else every text is tried
        for _ in range(60):
            text = sample(parser.parse(pattern), rng)
            assert re.search(pattern, text), (pattern, text)
            assert words in text, (keyword, pattern, text)
            assert any(g in text for g in first), (pattern, text)


def test_other_spellings_of_licences(spark):
    texts = ["GNU General Public Licence version 3", "GNU Lesser General Public Licence v2.1", "GNU Free Documentation Licence 1.3", "You may not use this file except in compliance with the Licence"]
    got = {r.doc_id: r.labels for r in license_scan.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "gpl-3.0", 1: "lgpl-2.1", 2: "gfdl-1.3", 3: "apache-2.0"}


def test_personal_data_passes_the_gate(spark):
    """Each alone in a text is found as it is beside another."""
    texts = ["call +1234567 now", "call +12345678 now", "call +123)4567 now", "write a@-x.com now"]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").select("doc_id", "text").collect()}
    assert all(t.split()[1] not in got[d] for d, t in enumerate(texts))


def test_a_worker_hands_back_what_another_stage_kept():
    import pyarrow as pa
    import public_tokenizers

    from rasterloom.llm import bpe, shared

    text = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    batch = pa.RecordBatch.from_arrays([pa.array(["a"])], names=["text"])
    bpe.codec(text)
    assert len(list(shared.lean(iter([batch]), "bpe"))) == 1 and bpe._CODECS
    assert len(list(shared.lean(iter([batch])))) == 1 and not bpe._CODECS


def test_features_take_bounded_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from rasterloom.llm import shared, simhash, toxicity

    column = pa.array(["Some plain words of a text, you know, of no interest at all. " * 30] * 2000)
    levels = np.zeros(1 << toxicity.LEARNED_BITS, np.int8)
    for f in (lambda c: toxicity.scores(toxicity.Boosted(levels=levels), c), simhash.fingerprints_of):
        tracemalloc.start()
        f(column)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 120 * shared.SMALL_CHUNK
