"""Operators against brute force on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import jaccard, langid, licenses, mixing, packing, scoring, topk, toxicity, vector_dedup, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
DOC = "doc_id long, text string, lang string, source string, score double, row int"


def texts():
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(WORDS, n)) for n in (3, 5, 40, 60, 80, 120)]
    near = [t.replace("alpha", "ALPHA", 1) + " end" for t in base]
    return [*base, *near, *base[2:4], "", None, "  \t", "é ß Ünder THE mit License, x", "cc-by-nc and under the MIT license under the mit license", base[4] + " " + base[5]]


def documents(spark, more=()):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 0.5, i) for i, t in enumerate([*texts(), *more])]
    rows += [rows[3], (None, "alpha beta gamma delta epsilon", None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def least_reachable(ids, links):
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_jaccard_components(spark):
    rng = np.random.default_rng(1)
    base = [str(x) for x in rng.integers(0, 10**6, 150)]
    copies = []
    for _ in range(60):
        own = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 4)):
            own[k] = f"edit{rng.integers(10**9)}"
        copies.append(" ".join(own))
    docs = documents(spark, copies)
    rows = {r.doc_id: shingles(r.text, 4) for r in docs.collect() if r.doc_id is not None}
    links = [(a, b) for a in rows for b in rows if a < b and rows[a] and 100 * len(rows[a] & rows[b]) >= 85 * len(rows[a] | rows[b])]
    expected = least_reachable(rows, links)
    got = jaccard.similar_documents(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(rows[r.doc_id]), expected[r.doc_id])
    kept = jaccard.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({v for v in expected.values()})
    assert jaccard.similar_documents(empty(spark)).count() == 0


def test_license_places_and_labels(spark):
    rows = {r.doc_id: r for r in licenses.scan(documents(spark)).collect()}
    source = dict(enumerate(texts()))
    for i, text in source.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted(k for p, _ in licenses.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (rows[i].n_words, rows[i].n_base) == (len(w), len(places))
        assert (rows[i].first_word, rows[i].last_word) == ((places[0], places[-1]) if places else (None, None))
        assert set(filter(None, rows[i].base_labels.split(","))) <= set(rows[i].labels.split(","))
    assert licenses.scan(empty(spark)).count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_all_rules(text):
    """Every rule on the whole text, without keywords and stretches, and suppression by comparing all pairs."""
    words = plain_words(text)
    joined, begins = " ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)])
    found = []
    for rule in licenses.rules():
        for m in rule.pattern.finditer(joined):
            first, last = np.searchsorted(begins, [m.start(), m.end() - 1], "right") - 1
            found.append((int(first), int(last), rule.tier, rule.order, rule.label))
    holds = lambda y, x: y[0] <= x[0] and x[1] <= y[1] and ((y[2] < x[2]) or (y[2] == x[2] and (y[:2] != x[:2] or y[3] < x[3])))
    return sorted((x[4], x[0], x[1]) for x in found if not any(holds(y, x) for y in found))


def spelled(pattern):
    """A text that a signature matches: first choices, and optional parts left out."""
    pattern = re.sub(r"\(\?![^()]*(?:\([^()]*(?:\([^()]*\))?[^()]*\)[^()]*)*\)", "", pattern)
    while (m := re.search(r"\(\?:([^()]*)\)(\?|\*|\{\d+,\d+\})?", pattern)) is not None:
        pattern = pattern[: m.start()] + ("" if m[2] in ("?", "*") else m[1].split("|")[0]) + pattern[m.end() :]
    pattern = re.sub(r"\S\?", "", pattern.replace(" ?", " ").replace(r"\d\d", "20").replace(r"\S+", "us"))
    return re.sub(r"\[(.)[^]]*\]", r"\1", pattern)


def test_every_license_signature_is_found_by_its_keyword():
    assert len(licenses.rules()) > 300
    lines = [spelled(pattern) for table, _ in licenses.TABLES for _, _, pattern in table]
    for rule, line in zip(licenses.rules(), lines, strict=True):
        assert rule.keyword in line.split() and len(line.split()) <= licenses.REACH and rule.pattern.fullmatch(line), (rule, line)
    rng = np.random.default_rng(0)
    texts = [" ".join(["filler"] * 70 + line.upper().split() + ["und", "mit", "dem", "license"]) for line in lines]
    texts += [" ".join(w for k in rng.integers(0, len(lines), 12) for w in [*lines[k].split(), *["x"] * int(rng.integers(0, 150))]) for _ in range(40)]
    texts += [f"{a}, {b}" for a, b in zip(lines[:-1], lines[1:], strict=True)] + ["", None, "mit general cc python creative"]
    for text, got in zip(texts, licenses.scan_texts(pa.array(texts)), strict=True):
        assert sorted((d.label, d.first, d.last) for d in got["found"]) == by_all_rules(text), text


def test_license_labels():
    cases = {
        "licensed under the gnu lesser general public license version 2 1 or cc by nc sa 4 0": {"lgpl-2.1", "cc-by-nc-sa"},
        "Released as GPLv2+ by us": {"gpl-2"}, "under GPLv3 or later": {"gpl-3"}, "code is LGPLv2.1": {"lgpl-2.1"}, "AGPLv3": {"agpl-3"}, "see MPLv2": {"mpl-2"},
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": {"mit"},
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": {"bsd"},
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": {"bsd-3-clause"},
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the License": {"gpl-3"},
        "GPL-2.0 WITH Classpath-exception-2.0": {"gpl-2", "classpath-exception-2.0"},
        "Copyright (c) 2019, 2020 Us. All rights reserved.": {"copyright"},
        "https://creativecommons.org/licenses/by-nc-nd/4.0/": {"cc-by-nc-nd"}, "SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause"},
        "ein Text mit Lizenz und Freunden": {"mit"}, "ein Haus mit Garten, by cc to the general": set(),
    }
    found = list(licenses.scan_texts(pa.array([("filler " * 70) + text for text in cases])))
    assert [{d.label for d in x["found"]} for x in found] == list(cases.values())


def test_license_scan_of_a_very_long_text_is_quick():
    (got,) = licenses.scan_texts(pa.array(["licensed under the mit license and gpl v2 " * 50_000]))  # 100,000 mentions
    began = time.process_time()
    licenses.suppress(got["found"])
    assert len(got["found"]) >= 100_000 and time.process_time() - began < 5


def features_of(lines):
    found, pairs = [], []
    for _, _, w in toxicity.batch_words(pa.array(lines), toxicity._TABLE):
        found += toxicity.distinct_features(w)
        pairs += toxicity.counterfactuals(w)
    return found, pairs


def test_swaps_are_the_difference_of_the_swapped_text():
    group = toxicity.IDENTITY_GROUPS[3]
    model = toxicity.Classifier(np.random.default_rng(1).normal(size=1 << toxicity.BITS), 0.0)
    for text in ("alpha christians beta", "christians CHRISTIANS christmas chri", "Muslims and jews", "x" * 9000 + " christians " + "christian " * 500):
        _, (pairs,) = features_of([text])
        words = re.findall("[a-z]+", text.lower())
        changes = [model.odds(pa.array([" ".join(to if w == term else w for w in words)]))[0] - model.odds(pa.array([text]))[0] for g in toxicity.IDENTITY_GROUPS for term in g if term in words for to in g if to != term]
        swap, feature, sign = pairs
        assert sorted(np.bincount(swap, sign * model.weights[feature], len(changes))) == pytest.approx(sorted(changes), abs=1e-9)
    assert len(group) == 6 and all(len(x) == 0 for x in features_of(["no terms", None, ""])[1][1])


def test_score_change_of_swaps_vanishes_as_fairness_grows():
    rng = np.random.default_rng(0)
    lines = [" ".join(rng.choice(WORDS, 12)) + (" christians" if k % 4 == 0 else "") for k in range(400)]
    gaps = []
    for fairness in (0.0, 4.0, 400.0):
        odds = toxicity.train(*[features_of(lines)[0], np.array([float(k % 4 == 0) for k in range(400)]), features_of(lines)[1]], fairness=fairness).odds(pa.array(["alpha christians beta", "alpha muslims beta"]))
        gaps.append(abs(odds[0] - odds[1]))
    assert gaps[0] > 3 and gaps[1] < 0.1 and gaps[2] < 0.01


def test_neutral_mentions_of_groups_are_not_toxic():
    rng = np.random.default_rng(0)
    insults = ["vile", "scum", "trash", "filth"]
    lines, labels = [], []
    for _ in range(1500):
        bad = rng.random() < 0.3
        group = rng.choice(["muslims", "immigrants", "women"]) if rng.random() < (0.9 if bad else 0.03) else ""
        lines.append(" ".join(rng.choice(WORDS, 12)) + f" {group} " + (rng.choice(insults) if bad and rng.random() < 0.6 else ""))
        labels.append(float(bad))
    found, pairs = features_of(lines)
    neutral = pa.array([" ".join(rng.choice(WORDS, 9)) + f" {t} " + " ".join(rng.choice(WORDS, 4)) for t in ("muslims", "immigrants", "women") for _ in range(100)])
    insulting = pa.array([" ".join(rng.choice(WORDS, 9)) + f" {rng.choice(insults)}" for _ in range(300)])
    plain, fair = (toxicity.train(found, np.array(labels), pairs, fairness=x) for x in (0.0, 4.0))
    false = [(m.odds(neutral) >= 0).mean() for m in (plain, fair)]
    assert false[0] > 0.9 and false[1] < 0.02, false
    assert (fair.odds(insulting) >= 0).mean() > 0.95


def test_toxicity_table(spark):
    rng = np.random.default_rng(0)
    lines, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        lines.append(" ".join(rng.choice(WORDS, 12)) + (" horrible women" if bad else " men"))
        labels.append(int(bad))
    long = "word " * 60_000 + "horrible"
    docs = spark.createDataFrame([(i, t, None, None, 0.1, 0) for i, t in enumerate([*lines, "", None, long])], DOC)
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (5, None), (402, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id < 400]) > 0.95
    assert {r.doc_id: r.predicted for r in got}[402] == 1
    kept = toxicity.keep_harmless(docs, marks)
    assert kept.columns == docs.columns and 402 not in {r.doc_id for r in kept.collect()}
    assert toxicity.toxicity(empty(spark), marks).count() == 0
    assert not toxicity.fit(docs, marks, max_bytes=10).weights.any()  # no sample, no weights


def test_language_gradients_and_reading():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b"], 3, rng)
    for x in net.parameters():
        x[...] = x.astype("f4")
    text, label, mask = rng.integers(97, 100, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones((6, 4), bool)
    loss, grads = langid.gradients(net, text, label, mask)
    for weight, grad in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = weight[at]
        weight[at] = old + 1e-2
        up = langid.gradients(net, text, label, mask)[0]
        weight[at] = old - 1e-2
        down = langid.gradients(net, text, label, mask)[0]
        weight[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(grad[at]), rel=0.05, abs=1e-3)


def test_language_id(spark):
    rng = np.random.default_rng(0)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))
    rows = [(i, make("aeiou" if i % 2 else "bcdfg"), "v" if i % 2 else "c", None, 0.0, 0) for i in range(120)] + [(500, None, "v", None, 0.0, 0), (501, "12 !", "c", None, 0.0, 0)]
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in langid.languages(docs, epochs=30).collect()}
    assert got[500].lang_pred == got[501].lang_pred == "und"
    held = [i for i in range(120) if got[i].held_out]
    assert held and all(got[i].lang_pred == rows[i][2] for i in held)
    assert langid.languages(empty(spark)).count() == 0


def test_packing_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    docs = documents(spark, ["Long " * 3000, "<|endoftext|> don't ΑΣ é"])
    tokenizer = Tokenizer.from_file(path)
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    got = packing.pack(docs, path, keep_ids=True).toPandas()
    for i, pieces in got[got.doc_id.notna()].drop_duplicates(["doc_id", "start"]).groupby("doc_id"):
        joined = b"".join(bytes(x) for x in pieces.sort_values("start").ids)
        assert joined == ids[i].tobytes() and (pieces.doc_tokens == len(ids[i])).all()
    assert all(zlib.crc32(bytes(x)) == c for x, c in zip(got.ids, got.ids_crc32, strict=True))
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert sequence.length.sum() <= 2048 and (sequence.length.cumsum() - sequence.length == sequence.offset).all()
    assert packing.pack(empty(spark), path).count() == 0


def test_pieces_of_words_are_encoded_once():
    public = pytest.importorskip("public_tokenizers")
    words = packing.WordTokenizer(public.path("word_bpe_49k.json"))
    texts = ["<|ENDOFTEXT|> <|endoftext|> a<|endoftext|>'s", "don't DON'T ''s .'s 's5", "café, café. \u0130. \u00d7. =\u0338. e\u0301. 12\u20e3 ½5", "aΣ.Σ a—.b\u00a0c", None]
    for text, ids in zip(texts, words.encode(pa.array(texts), 1), strict=True):
        assert ids.tolist() == [*words.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    words.forget()
    list(words.encode(pa.array(["alpha, alpha. (alpha) alpha-alpha 2024-11-28 naïve! naïve?"]), 1))
    assert len(words.keys) == 14  # alpha naïve , . ( ) - ! ? and five digits


def test_nnls_plan_places_every_piece():
    histogram = np.bincount(np.random.default_rng(0).integers(1, 2049, 30_000), minlength=2049)
    slots, n = packing.plan(histogram)
    count = defaultdict(int)
    for length, first, last, _, _ in slots:
        count[length] += last - first
    assert all(count[k] == histogram[k] for k in range(2049))
    assert 1 - (histogram * np.arange(2049)).sum() / 2048 / n < 0.01
    x = packing.nnls(np.array([(0, 1, -1), (1, 1, -1), (2, -1, -1)]), np.array([5.0, 9.0, 3.0]))
    assert x == pytest.approx([5, 2, 3], abs=0.05)


VECTOR = "vec_id long, embedding array<float>, label int"


def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype("f4")
    x[100:140] = x[7] + rng.normal(size=(40, 8)).astype("f4") * 0.05
    x[200:220] = x[9]
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    return spark.createDataFrame([*rows, (900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [None] * 8, 1)], VECTOR)


def test_top_k_is_exact(spark):
    table = vectors(spark)
    rows = {r.vec_id: np.floor(256 * np.array(r.embedding, float)) for r in table.collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all()}
    expected = []
    for q in sorted(i for i in rows if i % 50 == 0):
        best = sorted(((-int(rows[q] @ rows[i]), i) for i in rows if i != q))[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_k(table, shard_rows=80).collect()
    assert sorted(tuple(r) for r in got) == expected
    assert topk.top_k(table.limit(0)).count() == 0


def test_vector_components(spark):
    table = vectors(spark)
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    links = [(a, b) for a in rows for b in rows if a < b and rows[a] @ rows[b] / np.linalg.norm(rows[a]) / np.linalg.norm(rows[b]) >= 0.95]
    label = least_reachable(rows, links)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(table, cell_rows=20, recall=0.99, block=50).collect()}
    assert len(got) == 304 and all(got[i].n_links == 0 for i in (900, 901, 902, 903))
    found = sum(got[i].n_links for i in rows)
    assert 0.95 * 2 * len(links) <= found <= 2 * len(links)
    assert np.mean([got[i].component_id == label[i] for i in rows]) > 0.95
    assert vector_dedup.near_duplicates(table.limit(0)).count() == 0


def test_vector_recall_with_default_settings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(1200):  # neighbours right at the threshold and closer
        away = rng.normal(size=32)
        away -= (away @ x[k]) * x[k]
        away /= np.linalg.norm(away)
        c = 0.951 if k % 2 else rng.uniform(0.951, 0.99)
        x[2500 + k] = c * x[k] + np.sqrt(1 - c * c) * away
    x = x.astype("f4").astype(float)
    other = [(10_000, [1.0, 0.0]), (10_001, [1.0, 0.001]), (10_002, []), (10_003, [2.0])]  # lengths of their own
    again = [(0, x[0].tolist())]  # a repeated row
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + other + again, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r) for r in vector_dedup.near_duplicates(table).collect()]
    assert len(rows) == 5005
    got = dict(rows)
    assert (got[10_000].n_links, got[10_001].component_id, got[10_002].n_links, got[10_003].kept) == (1, 10_000, 0, True)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    expected = close.sum(1) - 1 + close[:, 0]  # each row that links with row 0 links with both of its copies
    found = np.array([got[i].n_links for i in range(5000)])
    assert (found <= expected).all() and found.sum() >= 0.95 * expected.sum()


def test_mix_takes_targets(spark):
    docs = documents(spark, ["very long " * 20_000])
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)
    budget = int(1.5 * sum(r["size"] for r in got))
    assert sum(r.taken for r in got) == budget
    per = defaultdict(int)
    for r in got:
        per[r.source_size, r.target] += r.taken
    assert all(abs(v - target) <= max(64, size / 1024) for (size, target), v in per.items())
    assert all((r.position is None) == (r.taken == 0) for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(words(r.text) for r in mixed.collect()) == budget
    assert mixing.mixed_sizes(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_queue_is_cut_in_order_of_finish(spark):
    docs = documents(spark)
    queue = sorted(mixing.fair_queue(docs).filter("piece_size > 0").collect(), key=lambda r: r.position)
    assert [r.finish for r in queue] == sorted(r.finish for r in queue)
    at = 0
    for r in queue:  # gapless, whole until the budget ends
        assert r.position == at
        at += r.piece_size
    ends = [k for k, r in enumerate(queue) if r.taken < r.piece_size]
    assert ends and ends == list(range(ends[0], len(queue))) and all(queue[k].taken == 0 for k in ends[1:])
    clash = docs.withColumnsRenamed({"row": "key", "score": "position"}).withColumns({"taken": F.col("key"), "c0": F.col("key")})
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns
    order = [r.doc_id for r in mixed.collect()]
    first = list(dict.fromkeys(r.doc_id for r in queue if r.taken))
    assert list(dict.fromkeys(order)) == first  # rows come out in the order of the queue


def test_warc_round_trip(spark):
    long = "é" * 700
    rows = [(1, "http://a/\r\nx", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "v", "x" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 6 and (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    assert all(got[i].record_type == "response" for i in (3, 4, 5, 6)) and got[2].payload == long.encode() and got[5].payload_bytes == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pseudo_likelihood(spark):
    rng = np.random.default_rng(0)
    fluent = [" ".join(WORDS[(k + s) % len(WORDS)] for k in range(40)) for s in range(200)]
    shuffled = " ".join(rng.permutation(fluent[0].split()))
    nonsense = " ".join("".join(rng.choice(list("bcdfgaeiou"), 7)) for _ in range(200))
    docs = spark.createDataFrame([(i, t, None, None, 0.0, 0) for i, t in enumerate([*fluent, shuffled, "", None, nonsense, fluent[0], fluent[0] * 800])], DOC)
    docs = docs.withColumnsRenamed({"lang": "tokens", "score": "a", "row": "block"})
    runs = [{r.doc_id: r for r in scoring.pseudo_likelihood(docs.repartition(n), rate=0.3).collect()} for n in (1, 7)]
    got = runs[0]
    assert got[0].mean_log_likelihood > got[200].mean_log_likelihood + 0.5
    assert got[203].mean_log_likelihood < got[200].mean_log_likelihood - 1  # invented words are worse than real ones in any order
    assert got[201].n_tokens == got[202].n_tokens == 0 and got[202].mean_log_likelihood is None
    assert got[204].log_likelihood == pytest.approx(got[0].log_likelihood, abs=1e-4) and got[205].n_tokens == 40 * 800 - 799
    for i, r in got.items():  # the layout of the table makes no difference
        assert runs[1][i].mean_log_likelihood == pytest.approx(r.mean_log_likelihood, abs=1e-3)
    assert scoring.pseudo_likelihood(empty(spark)).count() == 0


def test_scores_are_sums_over_masked_words(spark):
    lines = ["alpha beta gamma", "alpha", "beta alpha beta alpha delta unheard", "", None]
    docs = spark.createDataFrame([(i, t, None, None, 0.0, 0) for i, t in enumerate(lines)], DOC)
    counts = scoring.count_words(docs)
    known = scoring.vocabulary(docs, 3, counts)
    net = scoring.Network(known.size, 4, per_class=known.per_class, counts=known.counts())
    number = lambda w: int(known.tokens(next(x for *_, x in scoring.batch_words(pa.array([w]), scoring._TABLE)).hashes)[0])
    n = {w: sum((t or "").split().count(w) for t in lines) for w in "alpha beta gamma delta unheard".split()}
    expected = []
    for line in lines:
        tokens, total = [number(w) for w in (line or "").split()], 0.0
        for k, token in enumerate(tokens):
            around = [tokens[k + d] if 0 <= k + d < len(tokens) else known.size for d in scoring.REACH]
            h = np.tanh(net.bias + sum(net.inputs[j][x] for j, x in enumerate(around)))
            cls = h @ net.to_class + net.class_bias
            word = h @ net.to_word[token // net.per_class] + net.word_bias[token // net.per_class]
            total += cls[token // net.per_class] - np.log(np.exp(cls).sum()) + word[token % net.per_class] - np.log(np.exp(word).sum())
            if token < scoring.CLASS:
                total += np.log(n[line.split()[k]] / sum(v for w, v in n.items() if number(w) == token))
        expected.append(total)
    got = sorted(scoring.score(scoring.tokenise(docs, known, 4), net, counts).collect(), key=lambda r: r.doc_id)
    assert [r.log_likelihood for r in got] == pytest.approx(expected, abs=1e-4)


def test_every_document_trains(spark):
    docs = spark.createDataFrame([(i, f"own{i} " * 6, None, None, 0.0, 0) for i in range(60)], DOC)
    known = scoring.vocabulary(docs, 4032)
    net = scoring.fit(scoring.tokenise(docs, known, 16), known)
    moved = (net.inputs != scoring.Network(known.size, net.width).inputs).any((0, 2))
    assert moved[scoring.CLASS : scoring.CLASS + 60].all()


@pytest.mark.parametrize("shared", [0, 1, 2])
def test_rare_words_have_their_share_of_a_bucket(spark, shared):
    names = pa.array([f"rare{i}" for i in range(400)])
    hashes = np.concatenate([w.hashes for _, _, w in scoring.batch_words(names, scoring._TABLE)])
    two = np.flatnonzero(hashes % np.uint64(64) == hashes[0] % np.uint64(64))[:2]
    same = [names[int(i)].as_py() for i in two]
    lines = ["often " * 300, same[0], *[same[1]] * 3, f"{same[0]} {same[1]} {same[1]}", None]
    docs = spark.createDataFrame([(i, t, None, None, 0.0, 0) for i, t in enumerate(lines)], DOC)
    counts = scoring.count_words(docs)
    often = scoring.vocabulary(docs, 1, counts).hashes[:1]
    buckets = np.bincount(hashes[:1] % np.uint64(64), [7], 64).astype(int)
    known = scoring.Vocabulary(often, hashes[two][:shared], np.array([2, 5])[:shared], buckets, np.array([300]))  # the others' counts are joined
    net = scoring.Network(known.size, 4, per_class=known.per_class)
    got = {r.doc_id: r.log_likelihood for r in scoring.score(scoring.tokenise(docs, known, 4), net, counts).collect()}
    assert got[3] == pytest.approx(got[2]) and got[4] == pytest.approx(got[2]) and got[6] == 0
    assert got[2] - got[1] == pytest.approx(np.log(5 / 2), abs=1e-6)  # counts 5 and 2 in one bucket, same neighbours


def test_vocabulary_grows_with_the_corpus(spark):
    lines = [f"w{i} w{i} w{i % 7}" for i in range(1200)]
    docs = spark.createDataFrame([(i, t, None, None, 0.0, 0) for i, t in enumerate(lines)], DOC)
    known, fewer = scoring.vocabulary(docs, 4), scoring.vocabulary(docs.limit(300), 4)
    assert (len(known.hashes), len(fewer.hashes)) == (40, 22)
    assert known.buckets.sum() + 7 * 2 + 1200 + 33 * 2 == 3600 and known.counts().sum() == 3600
    assert set(known.rest.tolist()).isdisjoint(known.hashes.tolist()) and known.rest_n.sum() == known.buckets.sum()


def test_network_is_a_distribution_and_gradients_are_right():
    rng = np.random.default_rng(0)
    net = scoring.Network(128, 5, counts=np.arange(128.0))
    around = rng.integers(0, 129, (4, 1)).repeat(128, 1)
    assert np.exp(net.log_probabilities(around, np.arange(128))).sum() == pytest.approx(1, abs=1e-4)
    around, target = rng.integers(0, 129, (4, 30)), rng.integers(0, 128, 30)
    grads = net.gradients(around, target)
    for name in net.SHAPES:
        weight = getattr(net, name)
        at = np.unravel_index(np.abs(grads[name]).argmax(), weight.shape)
        old = weight[at]
        loss = []
        for step in (1e-2, -1e-2):
            weight[at] = old + step
            loss.append(-net.log_probabilities(around, target).astype(float).sum())
        weight[at] = old
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(float(grads[name][at]), rel=0.05, abs=1e-2)
    net.class_bias[:] = [90.0, 0.0]  # would overflow
    assert np.isfinite(net.log_probabilities(around, target)).all()


def test_softmaxes_go_over_few_rows_at_a_time(monkeypatch):
    rng = np.random.default_rng(0)
    net = scoring.Network(128, 5, counts=np.arange(128.0))
    around, target = rng.integers(0, 129, (4, 300)), rng.integers(0, 128, 300)
    whole = net.log_probabilities(around, target), net.gradients(around, target)
    seen = []
    exp = scoring.Network._exp
    monkeypatch.setattr(scoring, "ROWS", 7)
    monkeypatch.setattr(scoring.Network, "_exp", staticmethod(lambda x: seen.append(len(x)) or exp(x)))
    assert net.log_probabilities(around, target) == pytest.approx(whole[0], abs=1e-5)
    parts = net.gradients(around, target)
    assert all(parts[name] == pytest.approx(whole[1][name], abs=1e-4) for name in net.SHAPES)
    assert max(seen) == 7 and sum(seen) == 4 * 300
    assert net.log_probabilities(around[:, :0], target[:0]).shape == (0,) and not net.gradients(around[:, :0], target[:0])["inputs"].any()


def test_reader_agrees_with_the_network():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b", "c"], 8, rng)
    text = rng.integers(0, 256, (langid.WINDOW, 20)).astype(np.uint8)
    assert langid.Reader(net).probabilities(text).transpose(0, 2, 1) == pytest.approx(langid._softmax(net.logits(text)), abs=1e-5)
    long = rng.integers(97, 123, 100_000).astype(np.uint8)  # a very long text: the mean over its windows
    pooled = langid.predict(net, long, np.array([0, len(long), len(long)]))
    whole = len(long) // langid.WINDOW * langid.WINDOW
    windows = langid._softmax(net.logits(long[:whole].reshape(-1, langid.WINDOW).T))
    assert pooled[0] == pytest.approx(windows.reshape(-1, 3).mean(0), abs=1e-3) and (pooled[1] == 0).all()


def test_warc_reads_a_part_of_the_index(spark, tmp_path):
    rows = [(i if i % 7 else None, f"u{i}", f"page {i} " * (40 * (i % 5))) for i in range(60)] + [(3, "u3", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    index = warc.write_archives(pages, f"file://{tmp_path}/archive")
    some = index.filter("url IN ('u1', 'u2', 'u30', 'u7', 'u3')")
    for gap in (0, 1 << 20):  # each record by itself, or neighbours at once
        got = warc.read_records(some, f"file://{tmp_path}/archive", gap_bytes=gap).collect()
        assert sorted((r.url, bytes(r.payload).decode()) for r in got) == sorted((u, h) for _, u, h in rows if u in ("u1", "u2", "u30", "u7", "u3"))
    assert {r.page_id for r in got} == {1, 2, 30, None, 3}
    assert warc.read_records(some.limit(0), f"file://{tmp_path}/archive").count() == 0


def test_jaccard_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, long), (2, long.replace("w7 ", "other ")), (3, long[: len(long) // 2])], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()}
    assert got[1] == (29_997, 1) and got[2][1] == 1 and got[3][1] == 3


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(5)
    letters = {"en": "etaoin", "de": "xyzwvu"}
    line = lambda lang, n: " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(n))
    rows = [(i, line("de" if i % 3 == 0 else "en", 60), "de" if i % 3 == 0 else "en", f"s{i % 4}", 0) for i in range(160)]
    rows = [(i, t + (" horrible" if i % 8 == 0 else ""), lang, s, n) for i, t, lang, s, n in rows]
    rows += [(200, rows[1][1] + " end", "en", "s1", 0), rows[2], (201, None, "en", "s0", 0), (202, "", None, None, 0), (203, "12 34 !", "en", "s0", 0), (204, line("en", 20_000), "en", "s9", 0), (None, line("en", 50), None, None, 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(160)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        kept.append([r.asDict() for r in out.collect()])
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    ids = [sorted((r["doc_id"] is None, r["doc_id"]) for r in x) for x in kept]
    key = lambda r: (r[0] is None, r[0])
    assert ids[0] == sorted(key(r) for r in rows if r[0] not in (201, 202, 203))
    assert ids[1] == [x for x in ids[0] if x[0] or x[1] >= 160 or x[1] % 8]
    assert ids[2] == sorted(set(ids[1]) - {(False, 200)})
    words = lambda x: sum(len((r["text"] or "").split()) for r in x)
    assert words(kept[3]) == int(1.5 * words(kept[2])) and {r["doc_id"] for r in kept[3]} <= {r["doc_id"] for r in kept[2]}
    packed = kept[4]
    whole = {(r["doc_id"], r["doc_tokens"]) for r in packed}
    assert sum(r["length"] for r in packed) >= sum(n for _, n in whole) and {i for i, _ in whole} == {r["doc_id"] for r in kept[3]}
    assert pipeline.run(spark, str(tmp_path)).count() == len(packed)
    none = spark.createDataFrame([], columns)
    assert all(stage(spark, none, str(tmp_path)).count() == 0 for _, stage in pipeline.STAGES)
