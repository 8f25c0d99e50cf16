"""Each operator against brute force, a round trip or held-out accuracy, and on odd input."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from rasterloom.llm import bpe, decontaminate, language, license_scan, pii, quality, secret_scan, simhash, token_order, toxicity
from rasterloom.llm.license_rules import gates, rules
from rasterloom.llm.shared import chunks, table

WORD = r"[^\x20\x09-\x0D]+"


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def check_all(df, want_of, texts):
    got = by_id(df)
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = want_of(t)
        assert {k: got[i][k] for k in want} == want, i


# licence scans


def licence_base(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    at, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        q = phrase.split()
        for i in range(len(w) - len(q) + 1):
            if w[i : i + len(q)] == q:
                at.append(i)
                labels.add(label)
    return {"n_words": len(w), "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted(labels))}


def test_licenses(docs, texts):
    check_all(license_scan.report(docs), licence_base, texts)


def licence_detections(t):
    """The rules place by place, in plain Python."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    padded = " " + " ".join(words) + " "
    hits = []
    for order, (label, _, priority, pattern) in enumerate(rules()):
        for m in re.finditer(pattern, padded):
            start = padded[: m.start()].count(" ")
            hits.append((start, -(start + m[0].count(" ")), -priority, order, label))
    outer, reach = [], 0
    for h in sorted(hits):
        if -h[1] > reach:
            outer.append(h)
        reach = max(reach, -h[1])
    out = []
    for h in outer:
        if not out or -out[-1][1] <= h[0]:
            out.append(h)
        elif (h[2], h[3]) < (out[-1][2], out[-1][3]):
            out[-1] = h
    return [h[4] for h in out]


LINES = [
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 or any later version.",
    "SPDX-License-Identifier: MPL-2.0", "Released under the MIT License. Released under the MIT License.", "mit license mit license apache license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "nothing to see here", "",
    "CC BY-SA 4.0 and https://creativecommons.org/licenses/by/4.0", "the lİcense of mİt lıcense", "MİT LICENSE \u212Aelvin MIT LICENSE", "SPDX-License-Identifier: AAL; SPDX-License-Identifier: AFL-1.1", "GNU Lesser General Public Licence v2.1 or later, the Berkeley Software Distribution Licence, X Consortium License, PNG license",
    "The PolyForm Noncommercial License 1.0.0; Llama 3.1 Community License Agreement; Sun Industry Standards Source License 1.1",
]


def test_license_rules(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")
    got = {r.doc_id: [d["label"] for d in r.detections] for r in license_scan.scan(df).collect()}
    assert got == {i: licence_detections(t) for i, t in enumerate(LINES)}
    assert got[0][0] == "apache-2.0" and got[2] == ["mpl-2.0"] and got[6] == [] and got[11] == ["aal", "afl-1.1"]
    assert len(rules()) > 450


# SimHash


def fingerprint(t):
    w = re.findall(WORD, lowered(t))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, radius=3):
    root = {i: i for i in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_simhash(docs, texts):
    got = by_id(simhash.near_duplicates(docs))
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == groups(prints)


@pytest.mark.parametrize("joined,block", [(2, 3), (24, 1024)])
def test_simhash_hot_routes(spark, monkeypatch, joined, block):
    """A ball of close fingerprints, chains and strangers, with routes compared in small blocks and joined."""
    monkeypatch.setattr(simhash, "JOINED", joined)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    prints = {0x0123456789ABCDEF}
    for _ in range(60):
        prints.add(0x0123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False)))
    chain = 0xFFFF0000FFFF0000
    for k in range(0, 30, 3):
        chain ^= 0b111 << k
        prints.add(chain)
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 80)}
    named = dict(enumerate(sorted(prints)))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    unsigned = lambda x: x % (1 << 64)
    want = collections.defaultdict(set)
    for i, g in groups(named).items():
        want[g].add(named[i])
    got = collections.defaultdict(set)
    for n, r in roots.items():
        got[r].add(unsigned(n))
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


# quality


def surface(t):
    t = t or ""
    w, seen, dup = re.findall(WORD, t), set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": failed}


def test_quality(spark, sf, docs, texts):
    df = quality.assess(docs, table(spark, sf, "labels"))
    check_all(df, surface, texts)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD) for r in by_id(df).values())


def test_quality_separates(spark):
    sf = "/root/testdata/sf0.01"
    got = by_id(quality.assess(table(spark, sf, "documents"), table(spark, sf, "labels")))
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    judged = [(labels[i], r["kept"]) for i, r in got.items() if i in labels and not r["base_failed"]]
    assert np.mean([k for q, k in judged if q == 1]) > 0.98
    assert np.mean([k for q, k in judged if q == 0]) < 0.2


def test_log_ratio_by_hand(spark):
    """Hashed multinomials of two tiny corpora."""
    docs = spark.createDataFrame([(1, "good good fine"), (2, "bad awful bad"), (3, "good bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    score = {i: r["score"] for i, r in by_id(quality.assess(docs, labels)).items()}
    assert score[1] > 0 > score[2]


def test_quality_score_by_hand(spark, sf, docs, texts):
    """Every document's score and verdict from multinomials counted in plain Python."""
    from math import log

    labels = table(spark, sf, "labels")
    trusted = {r.doc_id for r in quality.trusted_ids(labels).collect()}
    size = 1 << quality.BUCKET_BITS

    def buckets(t):
        raw = (t or "").encode()
        one = quality.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return quality.buckets(one, *one.words())[0].tolist() if raw else []

    found = {i: buckets(t) for i, t in texts.items()}
    for i, t in texts.items():
        n = len(re.findall(WORD, t or ""))
        assert len(found[i]) == max(2 * n - 1, 0)
    raw, target = collections.Counter(), collections.Counter()
    for i, b in found.items():
        raw.update(b)
        if i in trusted:
            target.update(b)
    share = lambda c, b: (c[b] / sum(c.values()) + quality.SMOOTHING / size) / (1 + quality.SMOOTHING)
    of = {b: log(share(target, b)) - log(share(raw, b)) for b in raw}
    for i, r in by_id(quality.assess(docs, labels)).items():
        want = sum(of[b] for b in found[i]) / max(len(found[i]), 1)
        assert abs(r["score"] - want) < 1e-9 and r["kept"] == (not r["base_failed"] and want >= quality.THRESHOLD)


# BPE


def _path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


TRICKY = ["", "  ", "İstanbul ΣΑΣ Σ it's DON'T 're \x1c a\x85b 12345 ²½ é <|endoftext|>x<|startoftext|> <|endof", "a" * 300, "ñ" * 500 + " 你好世界 😀😀 ​ ﻿", "สวั à́b", "x\n\n\ty'LL 'S 'ſ 's", " 　  \x00 \x7f"]


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(_path())
    rows = dict(enumerate([*texts.values(), *TRICKY]))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got, ids = by_id(bpe.digests(df, _path())), {r.doc_id: r.ids for r in bpe.encode(df, _path()).collect()}
    decoded = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, _path()), _path()).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in rows.items():
        want = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert ids[i] == want and decoded[i] == text
        assert got[i] == {"doc_id": i, "n_tokens": len(want), "ids_sha256": sha(" ".join(map(str, want))), "decoded_sha256": sha(text)}


def test_bpe_automaton():
    """Small vocabularies against merging by priority, over all words of a length."""
    import itertools

    merges = [("a", "a"), ("b", "a"), ("aa", "b"), ("a", "ba"), ("aab", "aab"), ("b", "b")]
    vocab = {s: i for i, s in enumerate(["a", "b", *(x + y for x, y in merges)])}
    auto = bpe.Automaton(vocab, merges, ["a", "b"])
    rank = {m: k for k, m in enumerate(merges)}

    def merged(word):
        parts = list(word)
        while True:
            pairs = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
            if not pairs:
                return [vocab[p] for p in parts]
            best = min(pairs)[0]
            i, out = 0, []
            while i < len(parts):
                if i + 1 < len(parts) and rank.get((parts[i], parts[i + 1])) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out

    for n in range(1, 9):
        for w in itertools.product("ab", repeat=n):
            assert auto.encode(["ab".index(c) for c in w]) == merged(w), w


# secrets


def secrets(t):
    spans = []
    patterns = ((r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, "assign"), (r"AKIA[A-Z0-9]+", 0, 20, "access"), (r"[0-9a-f]+", 0, 24, "hex"))
    for k, (pattern, group, least, name) in enumerate(patterns):
        spans += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, t or "") if len(m[group]) >= least]
    spans.sort()
    n = collections.Counter(s[3] for s in spans)
    joined = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)
    return {"n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "base_sha256": hashlib.sha256(joined.encode()).hexdigest()}


def test_secrets(docs, texts):
    check_all(secret_scan.report(docs), secrets, texts)


def test_tails_are_exact(spark):
    """Against the error function, sums of binomial terms, and a simulated non-central chi-squared."""
    from math import comb, erfc, sqrt

    from pyspark.sql import functions as F

    z = [x / 7 for x in range(-60, 40)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(secret_scan.below(F.col("z"))).collect()]
    assert all(abs(g / (erfc(-x / sqrt(2)) / 2) - 1) < (1e-8 if x > -7 else 0.05) for g, x in zip(got, z))
    cases = [(c, m) for m in (1, 5, 19, 63, 400) for c in range(0, m + 1, max(1, m // 9))]
    got = [r[0] for r in spark.createDataFrame([(float(c), float(m)) for c, m in cases], "c double, m double").select(secret_scan.at_least(F.col("c"), F.col("m"), 0.1)).collect()]
    want = [sum(comb(m, k) * 0.1**k * 0.9 ** (m - k) for k in range(c, m + 1)) for c, m in cases]
    assert all(abs(g - w) <= 1e-9 * w + 1e-280 for g, w in zip(got, want))
    rng = np.random.default_rng(1)
    for free, away in ((15, 4.0), (31, 25.0), (63, 105.0)):
        drawn = np.sort(rng.noncentral_chisquare(free, away, 400_000))
        x = [float(drawn[int(q * len(drawn))]) for q in (0.0005, 0.005, 0.05, 0.5, 0.95)]
        got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(secret_scan.chi_below(F.col("x"), F.lit(float(free)), F.lit(away))).collect()]
        assert all(-0.1 < g / q - 1 < 0.35 for g, q in zip(got, (0.0005, 0.005, 0.05, 0.5, 0.95))), got  # the simulation itself is good to a tenth at 0.0005


def structured(n, seed=3):
    """Tokens that people make: identifiers, dated names, paths, product numbers, counters."""
    rng = np.random.default_rng(seed)
    parts = "get set user account order item list page image value total customer service report data base index search filter update remove config version release candidate module package system network server client thread handler".split()
    word = lambda: str(rng.choice(parts))
    num = lambda k: str(int(rng.integers(10 ** (k - 1), 10**k)))
    kinds = [
        lambda: word() + "".join(word().title() for _ in range(4)) + num(2), lambda: "_".join(word() for _ in range(4)) + "_" + num(4), lambda: "-".join(word() for _ in range(3)) + "-2024-0" + num(1) + "-1" + num(1),
        lambda: "/".join(word() for _ in range(4)) + "/" + num(3), lambda: (word() + "-" + word()).upper() + "-" + num(4) + "-" + word().upper(), lambda: "v" + num(1) + "_" + word() + "_build_" + num(6) + "_" + word(),
    ]
    out = [str(kinds[k % len(kinds)]()) for k in range(n)]
    return [t for t in out if len(t) >= 20]


def test_false_discoveries_among_structured_tokens(spark):
    tokens = structured(4000)
    got = by_id(secret_scan.report(spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(tokens)], "doc_id long, text string")))
    wrong = [tokens[i] for i, r in got.items() if "random" in r["spans"]]
    assert len(wrong) <= secret_scan.ALPHA * len(tokens), (len(wrong), len(tokens), wrong[:5])


def test_secret_battery(spark):
    rng = np.random.default_rng(3)
    alphabets = ["0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    keys = ["".join(rng.choice(list(a), n)) for a in alphabets[1:] for n in (32, 40, 64) for _ in range(8)]
    plain = ["version20240101releasecandidate", "the_quick_brown_fox_jumps_over_13", "zzzzzzzzzzzzzzzzzzzzzzzz1", "abcdefghijklmnopqrstuvwxyz0123456789", "customer-service-department-2024", "order-0000-0000-1111-1111-2222-x", "organisation/department/section/7"]
    rows = [(i, f"see {k} there") for i, k in enumerate(keys)] + [(1000 + i, f"see {k} there") for i, k in enumerate(plain)]
    got = by_id(secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string")))
    found = [got[i]["spans"] == f"random:4:{4 + len(k)}" for i, k in enumerate(keys)]
    assert np.mean(found) > 0.9
    assert [got[1000 + i]["spans"] for i in range(len(plain))] == [""] * len(plain)


def test_masked(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 'é token = "abcdef12" x 9f86d081884c7d659a2feaa0c55ad015 end'), (2, "clean"), (3, "")], "doc_id long, text string")
    rows = secret_scan.scan(df).select("doc_id", secret_scan.masked(F.col("text"), F.col("found")).alias("m")).collect()
    assert {r.doc_id: r.m for r in rows} == {1: 'é [SECRET]" x [SECRET] end', 2: "clean", 3: ""}


# decontamination


def overlaps(t, items):
    """Items that some diagonal of the text reaches, without hashing."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    out = set()
    for item, text in items.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        for start in range(-len(w) + 1, len(words)):
            run = top = 0
            for k in range(max(0, -start), min(len(w), len(words) - start)):
                run = max(0, run + (1 if words[start + k] == w[k] else -2))
                top = max(top, run)
            if top >= min(10, len(w)) and len(w) >= 5:
                out.add(item)
                break
    return out


def test_decontamination(spark, sf, docs, texts):
    bench = table(spark, sf, "benchmark")
    items = {r.item_id: r.text for r in bench.collect()}
    short = {i: t for i, t in texts.items() if len(t) < 4000}
    got = by_id(decontaminate.assess(docs, bench))
    for i, t in short.items():
        want = overlaps(t, items)
        assert got[i]["items"] == ",".join(map(str, sorted(want))) and got[i]["contaminated"] == bool(want), i
    shuffled = by_id(decontaminate.assess(docs, bench.limit(40)))
    assert shuffled == got


def test_decontamination_substitutions(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    one = w[:]
    one[8] = "changed"
    rows = [(1, "before " + " ".join(one) + " after"), (2, " ".join(w[:9])), (3, " ".join(w[5:17])), (4, "alpha x beta y gamma z delta"), (5, "tiny item of words five here"), (6, None)]
    bench = spark.createDataFrame([(0, item), (1, "tiny item of words five"), (2, "too short"), (3, None), (None, "x y z a b c")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(decontaminate.assess(docs, bench))
    assert {i: r["items"] for i, r in got.items()} == {1: "0", 2: "", 3: "0", 4: "", 5: "1", 6: ""}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [2, 4, 6]
    assert len(decontaminate.overlaps(docs, bench, broadcast_rows=0).collect()) == len(decontaminate.overlaps(docs, bench).collect())


# PII


def test_pii(spark):
    rows = [
        (1, "Mail anna.b7@mail.example.org, call +1 (415) 555-2671, card 4111 1111 1111 1111, host 10.20.30.40."), (2, "ANNA.B7@mail.example.org again; id 123-45-6789; x@mail.example.org"),
        (3, "Mrs. Jane Smith met Mr John Smith and Herr Max Mustermann; Госпожа Анна Каренина"), (4, "nothing 12 here"), (5, None),
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    parts = {i: [(p.kind, rows[i - 1][1][p.start : p.end], p.surrogate) for p in got[i].parts] for i in got}
    assert [k for k, _, _ in parts[1]] == ["email", "phone", "card", "ip"]
    assert [k for k, _, _ in parts[2]] == ["email", "identity", "email"] and [k for k, _, _ in parts[3]] == ["name"] * 4
    assert got[4].text == rows[3][1] and got[5].text is None
    email, phone, card, ip = (s for _, _, s in parts[1])
    assert re.fullmatch(r"[a-z]{4}\.[a-z]\d@[a-z]{4}\.[a-z]{7}\.org", email) and parts[2][0][2].lower() == email.lower()
    assert email.split("@")[1] == parts[2][2][2].split("@")[1]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", card) and all(0 <= int(x) < 256 for x in ip.split("."))
    digits = [int(c) for c in card if c.isdigit()][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    women = {n for (s, g), names in pii.GIVEN.items() if s == "latin" and g == "f" for n in names.split()}
    assert parts[3][0][2].startswith("Mrs. ") and parts[3][0][2].split()[1] in women
    assert re.fullmatch(r"Госпожа [А-Яа-яёЁ]+ [А-Яа-яёЁ]+", parts[3][3][2])
    for i, p in parts.items():
        assert all(a.lower() != s.lower() and a not in got[i].text for _, a, s in p)


def test_pii_written_otherwise(spark):
    """A number in another form is the same entity, and keeps its form."""
    forms = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "+1 (415) 555-2671", "+1-415-555-2671", "123-45-6789", "123456789"]
    df = spark.createDataFrame([(i, f"see {f} now") for i, f in enumerate(forms)], "doc_id long, text string")
    got = {r.doc_id: [p.surrogate for p in r.parts] for r in pii.pseudonymise(df, "k").collect()}
    digits = [re.sub("[^0-9]", "", got[i][0]) for i in range(len(forms))]
    assert len({*digits[:3]}) == len({*digits[3:5]}) == len({*digits[5:]}) == 1 and len({*digits}) == 3
    assert all(re.sub("[0-9]", "9", got[i][0]) == re.sub("[0-9]", "9", f) for i, f in enumerate(forms))


def test_pii_distinct(spark):
    """More names than a list has pairs: each still gets its own surrogate."""
    rng = np.random.default_rng(1)
    names = sorted({"".join(rng.choice(list("bdfglmnprst"), 1)[0].upper() + "aeiou"[int(rng.integers(5))] + "nlrst"[int(rng.integers(5))] + "aeo"[int(rng.integers(3))] for _ in range(1)) + f"{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100 % 10]}" for k in range(1000)})
    df = spark.createDataFrame([(i, f"Ms. {n} Xenon spoke") for i, n in enumerate(names)], "doc_id long, text string")
    got = [p.surrogate for r in pii.pseudonymise(df, "k").collect() for p in r.parts]
    assert len(got) == len(names) == len({s.lower() for s in got})


def test_pii_names_corefer(spark):
    """One family name however it is titled, in the text also without a title; genders and scripts stay."""
    rows = [(1, "Mr John Smith met Dr Smith. Later John Smith left, and Smith wrote to Smithson."), (2, "Mrs Smith knows Mr. Smith and Ms Mary Smith; MR SMITH no"), (3, "Κύριος Νίκος Παππάς και Παππάς"), (4, "Mr John Doe")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    parts = {i: {rows[i - 1][1][p.start : p.end]: p.surrogate for p in got[i].parts} for i in got}
    family = parts[1]["Smith"]
    assert parts[1]["Mr John Smith"].split()[2] == parts[1]["Dr Smith"].split()[1] == parts[1]["John Smith"].split()[1] == parts[2]["Mrs Smith"].split()[1] == parts[2]["Ms Mary Smith"].split()[2] == family
    assert parts[1]["Mr John Smith"].split()[1] == parts[1]["John Smith"].split()[0] == parts[4]["Mr John Doe"].split()[1] and parts[4]["Mr John Doe"].split()[2] != family
    assert "Smithson" in got[1].text and "Smith " not in got[1].text
    men = pii.GIVEN["latin", "m"].split()
    assert parts[1]["John Smith"].split()[0] in men and parts[2]["Ms Mary Smith"].split()[1] in pii.GIVEN["latin", "f"].split()
    assert parts[3]["Παππάς"] == parts[3]["Κύριος Νίκος Παππάς"].split()[2] and re.fullmatch("[Α-Ωα-ωά-ώ]+", parts[3]["Παππάς"])


def test_pii_key(spark):
    import hmac as plain

    from pyspark.sql import functions as F

    for key in ("k", "long " * 30):
        got = spark.createDataFrame([("é message",)], "s string").select(pii.hmac(key, F.col("s"))).first()[0]
        assert got == plain.new(key.encode(), "é message".encode(), "sha256").hexdigest()
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "")


def test_pii_crowded_format(spark):
    """More addresses at one domain than its forms allow, and types that could give the same surrogate: all distinct."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"{c}@xy.org" for c in letters] + [f"{100 + k}-{10 + k % 80}-{1000 + k}" for k in range(300)] + [f"{555_000_000 + k}" for k in range(300)]
    df = spark.createDataFrame([(i, f"see {t} now") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.parts for r in pii.pseudonymise(df, "k").collect()}
    assert all(len(got[i]) == 1 for i in range(len(texts)))
    to = [re.sub("[^0-9a-z@.]", "", got[i][0].surrogate.lower()) for i in range(len(texts))]
    assert len(set(to)) == len(to) and not set(to) & {re.sub("[^0-9a-z@.]", "", t) for t in texts} and not any("~" in t for t in to)


def test_pii_of_whole_documents(spark, docs, texts):
    """Against plain patterns: all that they find is replaced, equal by equal and distinct by distinct, in its format; the rest stays."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}", "card": r"(?<!\d)\d{16}(?!\d)", "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])"}
    got, n, forward, back = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}, 0, {}, {}
    for i, t in texts.items():
        out, at = "", 0
        for p in got[i].parts:
            out += (t or "")[at : p.start] + p.surrogate
            at = p.end
            key = (p.kind, t[p.start : p.end].lower())
            assert forward.setdefault(key, p.surrogate.lower()) == p.surrogate.lower()
            if p.kind != "name":
                assert back.setdefault(p.surrogate.lower(), key) == key
                assert re.sub(r"\d", "9", re.sub("[a-z]", "a", p.surrogate.lower())) == re.sub(r"\d", "9", re.sub("[a-z]", "a", key[1])) or p.kind in ("ip", "email")
        assert t is None and got[i].text is None or out + (t or "")[at:] == got[i].text
        held = {(p.kind, t[p.start : p.end]) for p in got[i].parts}
        for kind, pattern in plain.items():
            for m in re.findall(pattern, t or ""):
                if kind != "ip" or all(int(x) < 256 for x in m.split(".")):
                    assert (kind, m) in held, (i, kind, m)
                    n += 1
    assert n > 5


def test_bpe_refuses_what_it_cannot_do():
    import json

    import public_tokenizers

    text = open(public_tokenizers.path("word_bpe_49k.json")).read()
    bpe.Codec(text)
    for change in (
        lambda d: d["model"].update(dropout=0.1), lambda d: d["model"].update(unk_token="x"), lambda d: d["added_tokens"][0].update(lstrip=True), lambda d: d["added_tokens"][0].update(single_word=True),
        lambda d: d.update(normalizer=None), lambda d: d.update(decoder={"type": "ByteLevel"}), lambda d: d.update(pre_tokenizer={"type": "ByteLevel"}), lambda d: d["normalizer"]["normalizers"].pop(),
    ):
        d = json.loads(text)
        change(d)
        with pytest.raises(ValueError):
            bpe.Codec(json.dumps(d))


# language


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    rows = language.identify(docs, pages).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [(truth[r.doc_id], r.lang_id) for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    said = {r.page_id: r.l for r in pages.select("page_id", language.declared(pages.html).alias("l")).collect()}
    assert np.mean([said[r.page_id] == r.lang_id for r in rows if r.page_id is not None]) > 0.95
    assert len(rows) == len(truth) + len(said)


def test_language_evidence(spark):
    """Markup, suffix and host decide where the text says nothing."""
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog and the house", "en"), ("der hund und die katze und das haus", "de")] * 20)], "id long, text string, lang string")
    langs, logp = language.fit(docs)
    rows = spark.createDataFrame([(1, "", "de", None), (2, "", None, "x.example.de"), (3, "der hund und das haus der katze", None, "h.example.com"), (4, "", None, "h.example.com"), (5, None, None, None)], "id long, text string, markup string, host string")
    got = {r.id: r.lang_id for r in language.classify(rows, langs, logp).collect()}
    assert got[1] == got[2] == got[3] == got[4] == "de" and got[5] in langs


def by_hand(rows, langs, logp):
    """The posterior of each row in plain Python: (lang_id, probability)."""
    from math import exp, log

    second = set(language.SECOND_LEVEL)

    def domain(host):
        labels = (host or "").split(".")
        if host is None or len(labels) < 3 or re.fullmatch("[0-9.]+", host) or ":" in host:
            return host
        return ".".join(labels[-3 if len(labels[-1]) == 2 and labels[-2] in second else -2 :])

    k, told = len(langs), []
    for i, text, markup, host in rows:
        raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
        ll = [0.0] * k
        for j in range(len(raw) - 3):
            if raw[j : j + 4] != b"    ":
                one = language.Texts(np.frombuffer(raw[j : j + 4], np.uint8), np.array([0, 4]))
                bucket = int(language.grams(one)[0][0])
                for n in range(k):
                    ll[n] += float(np.float32(logp[n, bucket])) / language.TEMPER
        told.append((i, ll, markup, host, domain(host), ll.index(max(ll)) if max(ll) > min(ll) else None))
    out = {}
    for i, ll, markup, host, dom, vote in told:
        others = [t for t in told if t[0] != i]
        share = lambda n, of: sum(t[5] == n for t in of)
        sums = []
        for n, lang in enumerate(langs):
            level = (share(n, others) + 1) / (sum(t[5] is not None for t in others) + k)
            for of in ([t for t in others if t[4] == dom], [t for t in others if t[3] == host]):
                level = (share(n, of) + language.WEIGHT * level) / (sum(t[5] is not None for t in of) + language.WEIGHT)
            suffix = language.SUFFIXES.get((host or "").split(".")[-1])
            v = ll[n] + log(level)
            for said, wrong in ((markup, language.WRONG_MARKUP), (suffix, language.WRONG_SUFFIX)):
                if said in langs:
                    v += log(1 - wrong) if said == lang else log(wrong / max(k - 1, 1))
            sums.append(v)
        out[i] = (langs[sums.index(max(sums))], round(1 / sum(exp(v - max(sums)) for v in sums), 6))
    return out


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_language_against_plain_python(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(language, "BROADCAST_ROWS", broadcast_rows)
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog and the house", "en"), ("der hund und die katze und das haus", "de"), ("le chat et le chien et la maison", "fr")] * 15)], "id long, text string, lang string")
    langs, logp = language.fit(train)
    rng = np.random.default_rng(5)
    said = ["the dog", "der hund und", "le chien et la", "the house and haus", "", None, "12 34", "maison"]
    hosts = ["a.co.uk", "b.co.uk", "www.a.co.uk", "x.example.de", "y.example.de", "10.0.3.4", "10.1.3.4", None, "example.fr", "localhost", "news.site.com"]
    rows = [(i, said[int(rng.integers(len(said)))], [None, "de", "fr", "xx", "en"][int(rng.integers(5))], hosts[int(rng.integers(len(hosts)))]) for i in range(70)]
    rows += [(100, "the cat", None, "lone.example.org"), (101, "", None, None), (102, "der hund der hund", "en", "lone.de")]
    got = {r.id: (r.lang_id, r.probability) for r in language.classify(spark.createDataFrame(rows, "id long, text string, markup string, host string"), langs, logp).collect()}
    want = by_hand(rows, langs, logp)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-5, (i, got[i], want[i])


def test_domains(spark):
    cases = {"a.b.co.uk": "b.co.uk", "b.co.uk": "b.co.uk", "www.example.com": "example.com", "example.com": "example.com", "1.2.3.4": "1.2.3.4", "localhost": "localhost", "x.com.br": "x.com.br", "y.x.com.br": "x.com.br", "a.b.de": "b.de"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.d for r in df.select("h", language.domain_of(df.h).alias("d")).collect()} == cases


def test_language_ties(spark):
    """Languages that all evidence holds equal: the first in order."""
    logp = np.log(np.full((3, 1 << language.BUCKET_BITS), 1e-4))
    rows = spark.createDataFrame([(1, "same for all", None, None), (2, "", None, "h.org")], "id long, text string, markup string, host string")
    got = {(r.id, r.lang_id, r.probability) for r in language.classify(rows, ["aa", "bb", "cc"], logp).collect()}
    assert got == {(1, "aa", 0.333333), (2, "aa", 0.333333)}


# toxicity


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    got, truth = by_id(toxicity.assess(docs, labels)), {r.doc_id: r.toxic for r in labels.collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(truth[i], r["predicted"]) for i, r in got.items() if r["held_out"]]
    assert np.mean([p for t, p in held if t]) > 0.8 and np.mean([p for t, p in held if not t]) < 0.02


def toxic_features(t, model):
    """The dense features that don't need the learned lexicon, from a text in plain Python."""
    low = lowered(t)
    letter = "A-Za-z\u0080-\U0010ffff"
    words = [(m.start(), m[0]) for m in re.finditer(f"[{letter}]+", low)]
    n, listed = max(len(words), 1), [toxicity.INSULTS, toxicity.CONTEMPT, toxicity.PROFANITY, toxicity.THREATS]
    sets = [{lowered(w) for w in x} for x in listed]
    every, you = set().union(*sets), set(toxicity.SECOND_PERSON)
    at = [k for k, (_, w) in enumerate(words) if w in you]
    near = sum(w in every and any(abs(k - j) <= 5 for j in at) for k, (_, w) in enumerate(words))
    signs = "".join(map(re.escape, toxicity.LEET))
    hidden = 0
    for m in re.finditer(f"[{letter}{signs}]+", low):
        if re.search(f"[{signs}]", m[0]):
            hidden += "".join(toxicity.LEET.get(c, c) for c in m[0]) in every
    any_n = sum(w in every for _, w in words) + hidden
    raw = (t or "").encode()
    shout = [m[0] for m in re.finditer(f"[{letter}]+", t or "") if len(m[0].encode()) >= 3 and re.fullmatch("[A-Z]+", m[0])]
    again = sum(a[1] == b[1] for a, b in zip(words, words[1:]))
    out = {k: 100 * sum(w in s for _, w in words) / n for k, s in zip(("insults", "contempt", "profanity", "threats"), sets)}
    out |= {"any_rate": 100 * any_n / n, "any_log": np.log1p(any_n), "hidden_rate": 100 * hidden / n, "near_you": 100 * near / n, "you_rate": 100 * len(at) / n, "upper_words": len(shout) / n, "repeats": again / n, "length": np.log1p(len(words))}
    out |= {"exclaims": raw.count(b"!") / max(len(raw), 1), "asks": raw.count(b"?") / max(len(raw), 1), "digits": sum(48 <= b <= 57 for b in raw) / max(len(raw), 1)}
    return out


def test_toxic_features_by_hand(spark, texts):
    import pyarrow as pa

    extra = ["You are an 1d10t and STUPID STUPID!! du depp, h4te you?", "a b c d kill", "", None, "Ünïcode idiots tú, ÉTÉ 5h1t 5h1t", "clean text with 42 numbers"]
    listed = [*texts.values(), *extra]
    got = np.concatenate([toxicity.features(t, np.zeros(1 << toxicity.LEARNED_BITS, np.int8)) for _, _, t in chunks(pa.array(listed, pa.string()))])
    for k, t in enumerate(listed):
        for name, want in toxic_features(t, None).items():
            assert abs(got[k, toxicity.NAMES.index(name)] - want) < 1e-9, (t and t[:60], name, got[k, toxicity.NAMES.index(name)], want)


def test_trees_by_hand():
    """Margins by walking each tree, and probabilities by the calibration's steps."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0) & (rng.random(400) > 0.1)).astype(float)
    model = toxicity.grow(x[:300], y[:300])
    model.steps_x, model.steps_y = toxicity.isotonic(model.margin(x[300:]), y[300:])

    def margin(row):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node - len(f)]
        return total

    want = np.array([margin(r) for r in x])
    assert np.allclose(model.margin(x), want)

    def calibrated(m):
        sx, sy = model.steps_x, model.steps_y
        if m <= sx[0] or m >= sx[-1]:
            return sy[0] if m <= sx[0] else sy[-1]
        k = max(j for j in range(len(sx)) if sx[j] <= m)
        return sy[k] if sx[k] == m else sy[k] + (sy[k + 1] - sy[k]) * (m - sx[k]) / (sx[k + 1] - sx[k])

    assert np.allclose(model.probability(x), [calibrated(m) for m in want])


def test_isotonic_and_trees():
    x, y = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4, 5]), np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(y) >= 0).all() and len(x) == len(y)
    rng = np.random.default_rng(0)
    f = rng.normal(size=(2000, 4))
    t = ((f[:, 0] > 0) ^ (f[:, 1] > 0)).astype(float)
    m = toxicity.grow(f[:1500], t[:1500])
    assert np.mean((m.probability(f[1500:]) > 0.5) == t[1500:]) > 0.95


def test_single_class(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.assess(docs, labels).collect()} == {0.0}


# token order


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4096])
def test_feistel(n):
    order = token_order.Feistel(n)
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.index(slots) == np.arange(n)).all()
    assert n < 100 or (token_order.Feistel(n, 1).slot(np.arange(n)) != slots).any()


@pytest.mark.parametrize("partitions", [3, 20000])
def test_token_order(spark, sf, docs, texts, tmp_path, partitions):
    import public_tokenizers

    out, enc = str(tmp_path / "shards"), token_order._encoder(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    options = {"seq_len": 64, "shard_slots": 500}
    rows = token_order.materialise(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, out, max_partitions=partitions, **options).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    stored = dict(token_order.read(out, 0, **options))
    assert len(stored) == len(rows)
    back = collections.defaultdict(dict)
    for r in rows:
        assert r.shard == r.slot // 500 and r.byte_offset == r.slot % 500 * 128 and zlib.crc32(stored[r.slot].tobytes()) == r.crc
        assert (stored[r.slot][r.n_tokens :] == 50256).all()
        back[r.doc_id][r.seq_no] = stored[r.slot][: r.n_tokens]
    for i, t in texts.items():
        ids = np.concatenate([back[i][k] for k in sorted(back[i])]) if i in back else np.zeros(0)
        assert ids.tolist() == enc.encode_ordinary(t or "")
    assert [s for s, _ in token_order.read(out, 777, **options)] == list(range(777, len(rows)))
