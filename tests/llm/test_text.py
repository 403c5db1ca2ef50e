"""LM scoring, byte-level BPE, license scans, language identification, the quality classifier."""

import math
import random
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, language_id, license_scan, lm_score, quality

SCHEMA = "doc_id long, text string, ids string, score string, lang string, source string, n_tokens string, chunk int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", lang, "s", "q", 1) for i, t, lang in [(*r, None)[:3] for r in rows]], SCHEMA)


def brute_scores(rows, order):
    words = [[w.lower() if w.isascii() else w for w in (t or "").encode().lower().decode().split(" ") if w] for _, t in rows]
    words = [(t or "").encode().lower().split() for _, t in rows]
    tables = [Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(map(len, words))
    out = []
    for (d, _), w in zip(rows, words):
        own = [Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
        rest = lambda g: tables[len(g) - 1][g] - own[len(g) - 1][g]
        s = full = 0
        for i in range(len(w)):
            longest = min(i + 1, order)
            for n in range(longest, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    s += (longest - 1) * math.log(0.4) + math.log(max(rest(g), 0.5) / max(total - len(w), 1))
                elif rest(g) > 0:
                    s += (longest - n) * math.log(0.4) + math.log(rest(g) / rest(g[:-1]))
                    full += n == order
                    break
        out.append((d, len(w), full, round(s, 6)))
    return sorted(out, key=repr)


def test_lm_scores_do_not_depend_on_chunks(spark, monkeypatch):
    rows = [(i, "a b c d e f g " * (1 + i % 5) + str(i % 3)) for i in range(40)] + [(50, "long " * 900), (51, ""), (52, None), (None, "a b")]
    want = sorted(map(tuple, lm_score.score(docs(spark, rows)).collect()), key=repr)
    monkeypatch.setattr(lm_score, "CHUNK", 100)
    assert sorted(map(tuple, lm_score.score(docs(spark, rows).coalesce(1)).collect()), key=repr) == want


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice(["a", "B", "É", "d", "e"]) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    rows += [(100, None), (101, " \n\t"), (102, "lonely"), (None, "a b"), (3, "again a B"), (103, "a b " * 3000)]
    got = sorted(((r.doc_id, r.n_tokens, r.n_longest, round(r.log_score, 6)) for r in lm_score.score(docs(spark, rows), order).collect()), key=repr)
    want = brute_scores(rows, order)
    if order == 1:
        want = [(d, n, n, s) for d, n, _, s in want]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-5) for g, w in zip(got, want))
    assert lm_score.score(docs(spark, rows).limit(0), order).count() == 0


@pytest.fixture(scope="module")
def public():
    import public_tokenizers as P
    import tiktoken

    tok = bpe.tokenizer(bpe.default_vocabulary())
    return tok, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tok.machine.ranks, special_tokens={})


def test_bpe_is_the_public_encoding(public):
    tok, enc = public
    rng = random.Random(1)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "'s", "'ll", "1", "２", "½", "é", "ß", "中", "😀", "​", "\x1c", "\x85", "　", "и", "!", "--", "\t", "aaaa", "\U00020000", "ⅷ", "_", "<|endoftext|>"]
    for k in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        ids = tok.encode(s)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(s), s
        assert tok.decode(ids) == s
    for s in ("a" * 30000, "é" * 9000, "the" * 9000, " " * 5000 + "x", "abcdefghij" * 2000):  # pieces over many emissions
        assert np.frombuffer(tok.encode(s), "<u4").tolist() == enc.encode_ordinary(s)
    for s in ("".join(rng.choice("etaoinshrdluéè") for _ in range(rng.randint(5, 60))) for _ in range(3000)):
        assert np.frombuffer(tok.encode(s), "<u4").tolist() == enc.encode_ordinary(s)


def test_utf8_stream_cuts_anywhere():
    rng = random.Random(2)
    for _ in range(500):
        data = b"".join(rng.choice([b"a", "é".encode(), "中".encode(), "😀".encode(), b"\xff", b"\xe4\xb8", b"\xf0\x9f", b"\xed\xa0\x80", b"\xc0\xaf"]) for _ in range(rng.randint(0, 12)))
        stream, at, out = bpe.Utf8Stream(), 0, ""
        while at < len(data):
            n = rng.randint(1, 4)
            out += stream.feed(data[at : at + n])
            at += n
        assert out + stream.close() == data.decode("utf-8", "replace")


def test_bpe_frames(spark):
    rows = [(1, None), (2, ""), (3, "héllo wörld"), (3, "héllo wörld"), (None, "x"), (4, "long " * 30000)]
    d = docs(spark, rows)
    ids = bpe.encode(d)
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(ids).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in rows), key=repr)
    digests = {r.doc_id: r for r in bpe.digest(d).collect()}
    assert digests[1].n_tokens == 0 and digests[1].ids_sha256 == digests[2].decoded_sha256
    done = bpe.tokenized(d)
    assert done.columns == ["doc_id", "score", "lang", "source", "chunk", "ids", "n_tokens", "round_trip"]
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in done.collect())
    assert bpe.digest(d.limit(0)).count() == 0


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    apache = "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n"
    rows = [(1, mit), (2, "words\nReleased under the MIT License.\nmore | words"), (3, apache), (4, "This work is licensed under the GNU General Public License, version 3."), (5, None), (6, ""), (7, "a license of no kind"), (8, "no stop\nLicensed under CC BY-NC 4.0.\nAll rights reserved."), (None, "Licensed under the Apache License, Version 2.0."), (9, "unreleased under the MIT License.")]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert (got[1].license, got[1].n_sentences) == ("MIT", 2)
    assert got[2].license == "MIT" and got[3].license == "Apache-2.0" and got[4].license == "GPL-3.0-only" and got[None].license == "Apache-2.0"
    assert got[8].licenses == "CC-BY-NC-4.0,all-rights-reserved"
    assert all(got[i].license is None and got[i].n_sentences == 0 and got[i].licenses == "" for i in (5, 6, 7, 9))
    assert license_scan.scan(docs(spark, rows).limit(0)).count() == 0


def test_license_cues_cover_every_sentence():
    assert all(any(c in s for c in license_scan.CUES) for s in license_scan.SENTENCES.values())
    assert {i for _, ids in license_scan.RULES for i in ids} <= set(license_scan.SENTENCES)


def _language(rng, lang, n):
    words = {"aa": ["the", "and", "thing", "water"], "bb": ["une", "quoi", "être", "maison"], "cc": ["und", "straße", "nicht", "schön"]}[lang]
    return " ".join(rng.choice(words) + rng.choice(["", "s", "e"]) for _ in range(n))


def test_language_mixture(spark):
    rng = random.Random(4)
    rows = [(i, _language(rng, lang, rng.randint(20, 60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 100)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "123 !!", "bb"), (1003, "日本", None), (1004, _language(rng, "aa", 90) + " " + _language(rng, "cc", 30), None), (None, _language(rng, "bb", 20), None)]
    d = docs(spark, rows)
    model = language_id.train(d)
    got = {r.doc_id: r for r in language_id.identify(d, model).collect()}
    held = [(i, lang) for i, _, lang in rows[:300] if got[i].held_out]
    assert held and sum(got[i].lang_pred == lang for i, lang in held) / len(held) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1004].lang_pred == "aa" and 0.6 < got[1004].score < 0.9  # the shares of the mixture
    assert got[1003].lang_pred in ("aa", "bb", "cc") and got[None].lang_pred == "bb"
    assert language_id.identify(d.limit(0), model).count() == 0
    nothing = language_id.train(d.limit(0))
    assert {r.lang_pred for r in language_id.identify(d.limit(5), nothing).collect()} == {"und"}


def test_language_ignores_labels_of_the_held_out(spark):
    rng = random.Random(6)
    rows = [(i, _language(rng, lang, 40), lang) for i, lang in enumerate(["aa", "bb"] * 100)]
    d = docs(spark, rows)
    wrong = d.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "zz").otherwise(F.col("lang")))
    a, b = language_id.train(d), language_id.train(wrong)
    assert a.languages == b.languages and np.array_equal(a.p, b.p)


def _quality_rows(rng, n=400):
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.8
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words) if i % 2 else " ".join(w for w in words for _ in range(5))
        rows.append((i, text))
        if i % 2 == 0 or i % 3:
            labels.append((i, int(good), 0))
    return rows, labels


def test_quality_classifier(spark):
    rng = random.Random(8)
    rows, labels = _quality_rows(rng)
    d = docs(spark, rows + [(1000, None), (1001, ""), (None, "Some words."), (1002, "x " * 50000)])
    lab = spark.createDataFrame(labels + [(None, 1, 0), (1, None, 0), (2, labels[1][1], 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(d, lab).collect()}
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(i, q) for i, q, _ in labels if got[i].held_out]
    assert sum(got[i].predicted == q for i, q in held) / len(held) > 0.97
    kept = quality.survivors(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    none = quality.classify(d, lab.limit(0))
    assert {r.score for r in none.collect()} == {0.5} and quality.survivors(d, lab.limit(0)).count() == 404
    assert quality.classify(d.limit(0), lab).count() == 0


def test_quality_ignores_labels_of_the_held_out(spark):
    rng = random.Random(9)
    rows, labels = _quality_rows(rng, 120)
    d = docs(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(d, lab), quality.train(d, flipped)
    assert np.array_equal(a.w1, b.w1) and np.array_equal(a.w2, b.w2)


def test_risk_does_not_go_negative():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 0.5, (300, quality.N_FEATURES)), rng.normal(-1, 0.5, (100, quality.N_FEATURES))
    model = quality.fit(good, np.concatenate([good[:200], bad]), 2 / 3)
    assert model.score(bad).mean() < 0.2 and model.score(good).mean() > 0.8


def test_licenses_below_title_and_copyright_lines(spark):
    wrap = lambda s: textwrap.fill(s, 78)
    said = {i: license_scan.SENTENCES[i] for i in (3, 4, 5, 6, 51)}
    mit = "\n\n".join([wrap(said[3] + ":"), wrap(said[4] + "."), wrap(said[5] + ".") + "\n" + wrap(said[6] + ".")])
    isc = wrap(said[51] + ".")
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"
    rows = [("MIT", f"MIT License\n\nCopyright (c) 2020 X\n\n{mit}\n"), ("MIT", f"Copyright (c) 2020 X\n{mit}"), ("ISC", f"ISC License\n\nCopyright (c) 2020, X\n\n{isc}"), ("GPL-3.0-or-later", f"Copyright (C) 2020  X\n\n{gpl}"), ("GPL-3.0-or-later", f"Copyright (C) 2020  X\n{gpl}"), ("GPL-3.0-or-later", "# x\n# Copyright (C) 2020  X\n#\n# " + gpl.replace("\n", "\n# ")), (None, "released under. the\nmit license")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [got[i].license for i in range(len(rows))] == [name for name, _ in rows]
    assert got[0].sentence_ids == "3,4,5,6" and got[0].rule == 1 and got[4].sentence_ids == "31,32"
