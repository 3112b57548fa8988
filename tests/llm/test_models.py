"""Language ID, LM scoring, quality rules, licence scans."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quaystone.llm import language_id, licenses, lm_scoring, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5


def test_language_held_out(docs, texts, none):
    model = language_id.train(language_id.training_rows(docs))
    assert model.languages == ["de", "en", "fr"]
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == len(texts)
    lang = {t[0]: t[2] for t in texts if t[0] is not None and t[0] >= 10}
    long_enough = {t[0] for t in texts if t[1] and len(t[1]) > 100 and " " in t[1]}
    judged = [(lang[r["doc_id"]], r["lang_pred"]) for r in rows if r["doc_id"] in long_enough and lang.get(r["doc_id"])]
    assert sum(a == b for a, b in judged) / len(judged) >= 0.95 and len(judged) > 30
    by_id = {r["doc_id"]: r for r in rows}
    for doc_id in (0, 1, 2, 5):
        assert (by_id[doc_id]["lang_pred"], by_id[doc_id]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.identify(none, model).count() == 0
    empty = language_id.train(none)
    assert {r["lang_pred"] for r in language_id.identify(docs, empty).collect()} == {"und"}
    kept = language_id.identify(docs, model, keep=True)
    assert kept.columns == [*(c for c in docs.columns if c not in ("lang_pred", "lang_score")), "lang_pred", "lang_score"] and kept.count() == len(texts)


def brute_trigrams(text):
    """Trigrams of lower-cased letters with one separator for anything else, those with a letter in the middle."""
    squeezed = " " + re.sub(" +", " ", "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)) + " "
    squeezed = re.sub(" +", " ", squeezed)
    return [squeezed[i : i + 3] for i in range(len(squeezed) - 2) if squeezed[i + 1] != " "]


@pytest.mark.parametrize("gathered", [language_id.GATHERED, 50])
def test_language_by_brute_force(spark, docs, texts, monkeypatch, gathered):
    """Counts, retained trigrams and shares recounted; the filter adds false positives only, which the correction takes off."""
    monkeypatch.setattr(language_id, "GATHERED", gathered)
    counts = {}
    for t in texts:
        if t[1] is not None and t[2] is not None:
            counts.setdefault(t[2], Counter()).update(brute_trigrams(t[1]))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    large = {lang: {g: s for g, s in x.items() if s >= language_id.LEAST_SHARE} for lang, x in share.items()}
    most = {g: max(x.get(g, 0) for x in large.values()) for x in large.values() for g in x}
    held = {lang: {g for g, s in x.items() if s >= language_id.LEAST_RATIO * most[g]} for lang, x in large.items()}
    model = language_id.train(docs)
    assert model.languages == sorted(held) and all(abs(model.reach[k] - sum(share[k][g] for g in held[k])) < 1e-9 for k in held)
    want = {}
    for t in texts:
        grams = brute_trigrams(t[1] or "")
        want.setdefault((t[0], len(grams)), []).append({k: sum(g in held[k] for g in grams) / max(1, len(grams)) for k in held})
    by_id = {i: xs for (i, n), xs in want.items() if len(xs) == 1 and n > 20 and sum(j == i for j, _ in want) == 1}
    rows = [r for r in language_id.identify(docs, model).collect() if r["doc_id"] in by_id]
    assert len(rows) > 50
    for r in rows:
        shares = by_id[r["doc_id"]][0]
        assert abs(r["score"] - max(shares.values())) < 0.03 and shares[r["lang_pred"]] >= max(shares.values()) - 0.03


def test_pipeline_keeps_languages_of_many_distinct_trigrams(spark):
    rng = np.random.default_rng(4)
    han = lambda: "".join("日本語文" if rng.random() < 0.05 else chr(0x4E00 + rng.integers(5000)) for _ in range(1000))
    rows = [(i, han(), "zh") for i in range(100)] + [(100 + i, "the cat and the dog went to the town again " * 5, "en") for i in range(20)] + [(200, "αβγδε ζηθικ λμνξο πρστυ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.reach["zh"] < corpus_pipeline.LEAST_LANGUAGE_SCORE < model.reach["en"]
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == set(range(120))


def test_filter_returns_all_languages():
    grams = {"a": np.arange(0, 3000), "b": np.arange(2000, 5000), **{f"l{i}": np.array([10_000 + i]) for i in range(70)}}
    f = language_id.LanguageFilter.build(grams)
    keys = np.arange(5000)
    found = f.containing(keys)
    bit = lambda name: found[:, f.languages.index(name) // 64] >> np.uint64(f.languages.index(name) % 64) & np.uint64(1)
    assert (bit("a")[:3000] == 1).all() and (bit("b")[2000:] == 1).all()
    assert bit("a")[3000:].mean() < 0.02 and f.slots.shape[1] == 2


def test_trigrams_do_not_depend_on_the_neighbours():
    alone = language_id.trigrams(pa.array(["once upon"]))[0].tolist()
    keys, owner = language_id.trigrams(pa.array(["ends so!", "once upon", "!x", None]).fill_null(""))
    assert keys[owner == 1].tolist() == alone


def test_trigrams_do_not_cross_texts():
    keys, owner = language_id.trigrams(pa.array(["Ab, c", "", "é"]))
    unpack = lambda k: "".join(chr(k >> s & 0x1FFFFF) if k >> s & 0x1FFFFF else "_" for s in (42, 21, 0))
    assert [(unpack(int(k)), int(o)) for k, o in zip(keys, owner, strict=True)] == [("_ab", 0), ("ab_", 0), ("_c_", 0), ("_é_", 2)]


@pytest.fixture(scope="module")
def scored(spark, docs):
    return lm_scoring.train_and_score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1).collect()


def tokens(text):
    return [*WORD.findall((text or "").translate(LOW)), None]


def test_base_score(scored, texts):
    counts = Counter(w for t in texts if fold(t[0]) != 1 for w in tokens(t[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for t in texts:
        w = tokens(t[1])
        want[(t[0], fold(t[0]) != 1, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5))] += 1
    assert Counter((r["doc_id"], r["trained"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in scored) == want


def test_model_beats_base_on_held_out_texts(scored):
    held = [r for r in scored if not r["trained"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in scored)


def quantised(count, least=1):
    """The middle of the count's level, as the filters' rule has it."""
    lows = [least]
    while lows[-1] <= count:
        lows.append(max(lows[-1] + 1, int(lows[-1] * lm_scoring.LEVEL)))
    low, high = next((a, b - 1) for a, b in zip(lows, lows[1:], strict=False) if a <= count < b) if count >= least else (0, 0)
    return math.sqrt(low * high)


def brute_scores(learned, least):
    """P(w | h) by the model's formula from plain counts (h None: a text's first token)."""
    words = Counter(w for t in learned for w in tokens(t))
    pairs = Counter(p for t in learned for p in zip(tokens(t), tokens(t)[1:], strict=False))
    n, v = sum(words.values()), len(words)

    def p(h, w):
        plain = (words[w] + 0.5) / (n + 0.5 * (v + 1))
        q = quantised(pairs[h, w], least if pairs[h, w] >= least else 1)
        return (q + lm_scoring.PRIOR * plain) / (max(words[h], q) + lm_scoring.PRIOR) if h != "opening" else plain

    return words, p


def test_model_is_a_distribution():
    rng = np.random.default_rng(6)
    words, p = brute_scores([" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 400) if x < 500) for _ in range(300)], 10**9)
    for before in ("w1", "w2", "w9", "w77", "never seen"):
        assert abs(sum(p(before, w) for w in [*words, "unseen"]) - 1) < 0.02


def test_filter_reads_counts_back():
    rng = np.random.default_rng(3)
    keys, counts = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(1, 100_000, 5000)
    counts[:2000] = rng.integers(1, 10, 2000)
    f = lm_scoring.LogFrequencyFilter(keys, counts)
    level = f.probe(keys)
    found = f.counts_of(level)
    assert (level >= np.searchsorted(f.lows, counts, side="right")).all()  # never too low
    assert (found[:2000] == counts[:2000]).mean() > 0.97 and (np.abs(np.log(found / counts)) < math.log(1.11)).mean() > 0.97
    assert (f.probe(rng.integers(0, 2**63, 5000).astype(np.uint64)) > 0).mean() < 0.02


@pytest.mark.parametrize(("least_share", "shard", "group"), [(1e-6, 1 << 19, 1 << 24), (0.02, 40, 300), (0.9, 1 << 19, 100)])
def test_lm_score_by_brute_force(spark, monkeypatch, least_share, shard, group):
    """Every score is the formula's, whatever is in the broadcast filter and however groups and shards fall."""
    for name, value in (("LEAST_SHARE", least_share), ("SHARD", shard), ("GROUP_BYTES", group)):
        monkeypatch.setattr(lm_scoring, name, value)
    learned = [f"the w{i} the w{i} of p{i % 7} q{i % 7} w{(i + 1) % 40}" for i in range(40)]
    texts = [*learned, "the w3 of w5", "new w3 q1", "w3 w9 new", learned[0], None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = lm_scoring.train_and_score(df, F.col("doc_id") < 40).collect()
    n = sum(len(tokens(t)) for t in learned)
    words, p = brute_scores(learned, max(2, math.ceil(least_share * n)))
    assert sorted(r["doc_id"] for r in rows) == list(range(45))
    exact = 0
    for r in rows:
        w = tokens(texts[r["doc_id"]])
        want = sum(math.log10(p(h, x)) for h, x in zip(["opening", *w], w, strict=False))
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(words[x] > 0 for x in w))
        exact += abs(r["score"] - want) < 1e-9
    assert exact >= 42  # a false positive may raise a pair's level


def test_lm_tells_texts_that_occur_twice(spark):
    """Singletons count: a held-out copy of a text learned once scores far above other held-out texts."""
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 3000, 60))
    learned = [text() for _ in range(400)]
    rows = [(i, t, True) for i, t in enumerate(learned)] + [(1000 + i, t, False) for i, t in enumerate(learned[:50])] + [(2000 + i, text(), False) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    held = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_scoring.train_and_score(df, F.col("doc_id") < 1000).collect() if r["doc_id"] >= 1000}
    assert min(v for k, v in held.items() if k < 2000) > max(v for k, v in held.items() if k >= 2000)


def test_lm_without_rows_or_training(spark, none):
    assert lm_scoring.train_and_score(none, F.lit(True)).count() == 0
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm_scoring.train_and_score(df, F.lit(False)).collect()}
    assert (rows[1]["n_tokens"], rows[1]["n_known"], rows[1]["train_tokens"], rows[2]["n_tokens"]) == (3, 0, 0, 1)


def base_rules(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def buckets(text, n):
    w = [x.encode() for x in WORD.findall(text or "")]
    h = lambda *xs: (lambda s: s - 2**64 if s >= 2**63 else s)(__import__("functools").reduce(lambda seed, x: xxhash.xxh64_intdigest(x, seed), xs, 42))
    return [h(x) % n for x in w] + [h(a, b) % n for a, b in zip(w, w[1:], strict=False)]


def test_quality_rules_by_brute_force(spark, docs, texts, none):
    labels = spark.createDataFrame([(t[0], int(t[0] % 2)) for t in texts if t[0] is not None and t[0] >= 10], "doc_id long, quality int")
    rows = quality.rate(docs, labels).collect()
    n = quality.BUCKETS
    good = {t[0] for t in texts if t[0] is not None and t[0] >= 10 and t[0] % 2}
    raw, target = [1] * n, [0] * n
    for t in texts:
        for b in buckets(t[1], n):
            raw[b] += 1
            target[b] += t[0] in good
    prior = quality.PRIOR * n
    weights = [math.log((t * sum(raw) / r + prior) / (sum(target) + prior)) for t, r in zip(target, raw, strict=True)]
    want = Counter()
    for t in texts:
        found = buckets(t[1], n)
        score = sum(weights[b] for b in found) / (len(found) + quality.SHRINK)
        base = base_rules(t[1])
        want[(t[0], *base, not base[-1] and score >= quality.THRESHOLD, round(score, 3))] += 1
    assert Counter((*tuple(r)[:8], round(r["score"], 3)) for r in rows) == want
    assert quality.rate(none, labels).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in quality.rate(docs, labels.limit(0)).collect())  # nothing to compare with


def test_quality_on_held_out_labels(spark, monkeypatch):
    """Good prose that isn't in the target stays, other prose that isn't either goes (with a prior that suits so few documents)."""
    monkeypatch.setattr(quality, "PRIOR", 0.5)
    rng = np.random.default_rng(5)
    good_words, bad_words = [f"good{i}" for i in range(400)], [f"bad{i}" for i in range(400)]
    text = lambda words: " ".join(rng.choice(words, 80))
    rows = [(i, text(good_words if i % 2 else bad_words)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.rate(docs, labels).collect() if r["doc_id"] >= 600}
    assert np.mean([v for k, v in kept.items() if k % 2]) > 0.97 and np.mean([v for k, v in kept.items() if not k % 2]) < 0.03


def test_quality_verdict_can_be_filtered_on(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality.rate(docs, labels).where("kept")
    assert kept.count() == sum(r["kept"] for r in quality.rate(docs, labels).collect())
    assert "Python" not in kept._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def license_model():
    others = ["The weather was fine and the children played.", "A driving test is booked by the office.", "Rain on the roof", "In this chapter we look at the history of public parks."] * 20
    return licenses.train(others)


@pytest.mark.parametrize(("line", "family"), [("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("  All rights reserved.", "proprietary"), ("RELEASED UNDER THE MIT LICENSE", "mit"), ("This text: licensed under the Apache License, Version 2.0", "apache-2.0"), ("Licensed under CC BY 4.0.", "cc-by")])
def test_license_families(license_model, line, family):
    p = license_model.probabilities([line])[0]
    assert license_model.families[int(p.argmax())] == family and p.max() >= licenses.LEAST_PROBABILITY
    assert license_model.cover(line, family) >= licenses.LEAST_COVER and abs(p.sum() - 1) < 1e-9


def test_license_scan(spark, license_model, docs, none, texts):
    text = "Title\n\nReleased under the MIT License.\nShe had her driving license renewed.\nLicensed under the Frobnicate License.\n"
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = licenses.scan_licenses(df, license_model).collect()
    sure = [r for r in rows if r["confirmed"]]
    assert [(r["paragraph"], r["family"], text[r["start"] : r["start"] + r["length"]]) for r in sure] == [(2, "mit", "Released under the MIT License.")] * 2
    per = {(r["doc_id"], tuple(r["families"]), r["n_confirmed"], r["n_unknown"]) for r in licenses.scan_licenses(df, license_model, per_document=True).collect()}
    assert per == {(1, ("mit",), 1, 2), (2, (), 0, 0), (3, (), 0, 0)}
    assert licenses.scan_licenses(none, license_model).count() == 0
    whole = licenses.scan_licenses(docs, licenses.fit(docs), per_document=True).collect()
    assert len(whole) == len(texts) and not any(r["n_confirmed"] for r in whole)


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation",
}


@pytest.mark.parametrize(("text", "family"), [(t, f) for f, t in WRAPPED.items()] + [("Published under CC BY-SA 4.0.", "cc-by-sa"), ("Distributed under the GNU GPL, version 2 or later.", "gpl")])
def test_license_notices_wrapped_or_without_cue_words(spark, license_model, text, family):
    df = spark.createDataFrame([(1, f"Rain on the roof\n\n{text}\n\nThe children played.")], "doc_id long, text string")
    sure = [r for r in licenses.scan_licenses(df, license_model).collect() if r["confirmed"]]
    assert [(r["paragraph"], r["family"], r["start"]) for r in sure] == [(2, family, 18)]
    (r,) = licenses.scan_licenses(df, license_model, per_document=True).collect()
    assert (r["families"], r["n_confirmed"]) == ([family], 1)


def test_license_line_without_cue_word_is_reported(spark, license_model):
    df = spark.createDataFrame([(1, "Published under CC BY 4.0.")], "doc_id long, text string")
    assert [r["family"] for r in licenses.scan_licenses(df, license_model).collect()] == ["cc-by"]


def test_license_lines_at_once_score_as_one_by_one(license_model):
    lines = ["(Licensed under CC BY 4.0.)", "", "a ... 'b' c's (d", "All rights\treserved!", "Permission is hereby granted"]
    raw = licenses._without_edges(np.frombuffer("\n".join(lines).encode(), np.uint8))
    words, first = licenses.word_hashes(raw, np.concatenate([[0], np.flatnonzero(raw == 10) + 1, [len(raw)]]))
    want = np.stack([license_model._logits(licenses._features(x)) for x in lines])
    assert np.allclose(license_model.line_logits(words, first), want)


#: Phrases that aren't in training, each with its family.
UNSEEN = [
    ("Text: CC BY-SA 4.0 Unported", "cc-by-sa"), ("Content on this site is offered for reuse under CC BY 4.0", "cc-by"), ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR', "mit"),
    ("Copyright (c) 2019 Jane Roe. MIT licensed.", "mit"), ("This code is licensed under GPLv3", "gpl"), ("The crate and its tests are governed by a BSD-style license found in LICENSE", "bsd"),
    ("The sources may be passed on and changed under the terms of the GNU General Public License", "gpl"), ("Our fonts come under the Apache License 2.0", "apache-2.0"),
    ("This module may be used under either the MIT License or a commercial agreement", "mit"), ("Parts of it: the GNU Lesser General Public License, version 2.1", "lgpl"),
    ("Source is available on request under the AGPL", "agpl"), ("Files here fall under the Mozilla Public License, version 2.0", "mpl-2.0"), ("All photos: CC0", "cc0"), ("Data (c) the city, CC BY-NC 4.0", "cc-by-nc"),
    ("Maps may be copied under a Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd"), ("(c) 1987 Old Town Press. All Rights Reserved", "proprietary"), ("# SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("All icons of this set: licensed under the ISC license", "isc"), ("The viewer and its parts are made available under the Eclipse Public License", "epl-2.0"),
    ("The weather in Boston was mild and MIT closed early", None), ("My fishing license runs out in May", None), ("The council reserved all rights to the square for the fair", None), ("A new license for taxi drivers was debated", None),
    ("Copyright 2020 Example Ltd", None), ("The general was a public figure with a license to spy", None), ("Please keep off the grass", None), ("Conditions of use are posted at the gate", None), ("Er kam mit der Bahn", None), ("He gave permission to copy the key", None),
]


def test_license_unseen_phrases(license_model):
    """What isn't in training: families found and confirmed, others not; and the probabilities are near the shares that are right."""
    plain = lambda x: licenses._plain(x).lower()
    assert not {plain(x) for _, x in licenses.phrases()} & {plain(x) for x, _ in UNSEEN}
    right, sure = 0, []
    for line, family in UNSEEN:
        p = license_model.probabilities([line])[0]
        found = license_model.families[int(p.argmax())]
        confirmed = found if found != "unknown" and p.max() >= licenses.LEAST_PROBABILITY and license_model.cover(line, found) >= licenses.LEAST_COVER else None
        right += confirmed == family
        sure.append((float(p.max()), found == family or family is None and found in ("unknown", "other")))
    assert right / len(UNSEEN) >= 0.85
    assert abs(np.mean([p for p, _ in sure]) - np.mean([ok for _, ok in sure])) < 0.15


#: Lines of licences in the test tables.
TABLES = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."]


def test_no_line_of_the_test_tables_is_trained_on():
    """Neither as a phrase, however it is put together, nor as a part of one, but for the three words that are a name themselves."""
    spaced = [f" {licenses._plain(x).lower()} " for _, x in licenses.phrases()]
    for line in TABLES:
        plain = f" {licenses._plain(line).lower()} "
        assert plain not in spaced
        around = [x for x in spaced if plain in x]
        assert not around or line == "All rights reserved." or any(n in x for x in around for n in (" (the license ", " license) ", " the license "))


@pytest.mark.parametrize(
    ("line", "family"),
    [
        *zip(TABLES, ["mit", "cc-by-nc", "proprietary", "apache-2.0", "gpl"], strict=True),
        ("This library is not licensed under the GPL.", None), ("MIT researchers published a license study.", None), ("All photos: CC0", "cc0"), ("Wiki text is under CC BY-SA.", "cc-by-sa"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl-2.0"),
        ("Licensed under the Glorble License.", None), ("We compared the MIT License and the GNU GPL", None), ("He wrote a book on the GNU General Public License", None), ("The work is no longer under the MIT License", None),
        ("It is under the zlib license", "zlib"), ("either version 2 of the License, or (at your option) any later version.", "gpl"),
    ],
)
def test_license_grants_denials_and_mentions(license_model, line, family):
    p = license_model.probabilities([line])[0]
    found = license_model.families[int(p.argmax())]
    sure = found not in ("unknown", "other") and p.max() >= licenses.LEAST_PROBABILITY and license_model.cover(line, found) >= licenses.LEAST_COVER
    assert (found if sure else None) == family


def test_license_cover_recounted(license_model):
    """Shares of notices' words by plain sets, names by regular expressions over the line."""
    strip = lambda x: [w.strip(".,;:()[]{}\"'!?*#").lower() for w in x.split() if w.strip(".,;:()[]{}\"'!?*#")]
    telling = {f: [set(strip(n)) for n in ns] for f, ns in licenses.NOTICES.items()}
    for line in [x for x, _ in UNSEEN] + [n for ns in licenses.NOTICES.values() for n in ns] + TABLES:
        words = set(strip(line))
        for family in licenses.NOTICES:
            if family == "other":
                assert license_model.cover(line, family) == 0
                continue
            others = set().union(*(t for f, ts in telling.items() if f != family for t in ts))
            want = max((len(words & t) / len(t) for t in telling[family] if t - others <= words or len(t - others) > 3), default=0.0)
            named = {f for f, ns in licenses.NAMES.items() if f != "other" for n in ns if re.search(r"(?<![\w-])" + re.escape(re.sub("^(the|an?) ", "", " ".join(strip(n)))) + r"(?![\w-])", " ".join(strip(line)))}
            got = license_model.cover(line, family)
            assert got == pytest.approx(want) or got == 1.0 and family in named


def test_license_runs_recounted(license_model):
    """The tightest run of lines that holds most words of a notice, none of its lines doing so alone, by trying them all."""
    for family, text in WRAPPED.items():
        lines = ["Rain on the roof", "", *text.split("\n"), "", "The children played."]
        low = [set(licenses._plain(x).lower().split()) for x in lines]
        notices = [set(licenses._plain(n).lower().split()) for n in licenses.NOTICES[family]]
        runs = [(j - i, i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if all(low[i : j + 1]) for t in notices if len(set().union(*low[i : j + 1]) & t) >= 0.75 * len(t) and all(len(x & t) < 0.75 * len(t) for x in low[i : j + 1])]
        got = licenses._wrapped(license_model, lines, np.ones(len(lines), bool), {})
        assert min(runs)[1:] == got[0][:2] and got[0][2] == family


def test_license_model_is_stored(spark, docs, monkeypatch):
    first = licenses.fit(docs)
    monkeypatch.setattr(licenses, "train", None)  # not called again
    again = licenses.fit(docs)
    assert (first.weights == again.weights).all() and first.families == again.families and again.by_first == first.by_first


def test_license_scan_by_brute_force(spark, license_model):
    """Every line, one by one: what is reported for single lines is what its own probabilities and cover say."""
    lines = [x for x, _ in UNSEEN] + ["", "Rain on the roof", "a b c"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    want = set()
    for i, x in enumerate(lines):
        if licenses._plain(x):
            p = license_model.probabilities([x])[0]
            f = license_model.families[int(p.argmax())]
            if f != "unknown" or licenses._CUES.search(x):
                cover = license_model.cover(x, f) if f != "unknown" else 0.0
                want.add((i, f, round(float(p.max()), 6), round(cover, 6), f != "unknown" and p.max() >= licenses.LEAST_PROBABILITY and cover >= licenses.LEAST_COVER))
    got = {(r["doc_id"], r["family"], round(r["probability"], 6), round(r["cover"], 6), r["confirmed"]) for r in licenses.scan_licenses(df, license_model).collect()}
    assert got == want and len(got) > 15
