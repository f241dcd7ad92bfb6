"""Each operator against a brute-force version, a round trip or held-out labels, and the edge cases they all promise."""

import base64
import itertools
import random
import textwrap
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm import bpe as bpe_mod
from sedimenta.llm import chat, common, exact_dedup, licenses, lm_score, near_dedup, packing, quality, templates, topk, toxicity
from sedimenta.session import ensure_checkpoint_dir, table

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("__hit", T.StringType()), T.StructField("keep", T.MapType(T.StringType(), T.IntegerType())), T.StructField("id", T.IntegerType())])


def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names might clash."""
    long = " ".join(f"word{k % 977} other{k % 13}" for k in range(60_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "a", {"x": 1}, 1),
        (2, "alpha beta gamma delta epsilon zeta", None, None, None),
        (2, "alpha beta gamma delta epsilon zeta", None, None, None),
        (3, None, "c", {}, 3),
        (4, None, "d", None, 4),
        (5, "", "e", None, 5),
        (6, "", "f", None, 6),
        (None, "alpha beta gamma delta epsilon zeta", "g", None, 7),
        (None, None, None, None, None),
        (7, long, "h", {"y": 2}, 8),
        (8, "one", "i", None, 9),
        (9, "  \n\n ", "j", None, 10),
        (10, "x" * 5000, "k", None, 11),
        (11, "totally different content that nobody else has written", "l", None, 12),
    ]
    return spark.createDataFrame(rows, DOCS)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (11, 0, 1), (3, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


# ------------------------------------------------------------------ 1


@pytest.fixture(scope="module")
def bpe():
    return bpe_mod.Bpe.load()


def reference(bpe):
    return tiktoken.Encoding("own", pat_str=bpe_mod.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_bpe_equals_public_encoder(bpe, spark, sf01):
    rng = random.Random(1)
    texts = [r.text for r in table(spark, sf01, "documents").limit(150).collect()]
    texts += ["".join(rng.choice("ab \n漢é😀x1!'s") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["a" * 5000, "ab" * 3000, "é" * 1500, "", "<|endoftext|>", " \n \n"]
    ids, count = bpe.encode(texts)
    want = reference(bpe).encode_ordinary_batch(texts)
    assert count.tolist() == [len(x) for x in want]
    assert ids.tolist() == list(itertools.chain(*want))
    assert bpe.decode(ids, count).to_pylist() == texts


def test_bpe_matrix_equals_naive_merging(bpe):
    def naive(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            ranked = [(bpe.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranked or min(ranked)[0] == 1 << 60:
                return [bpe.ranks[p] for p in parts]
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"theinagros ") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    ids, count = bpe.merge(pieces)
    assert ids.tolist() == list(itertools.chain(*map(naive, pieces))) and count.sum() == len(ids)


def test_bpe_decodes_broken_bytes_and_unknown_ids(bpe):
    half = int(bpe.byte_id[0xE6])
    got = bpe.decode(np.array([half, 10**9, -3, int(bpe.byte_id[65])]), np.array([1, 2, 1])).to_pylist()
    assert got == ["�", "��", "A"]


def test_bpe_query_on_odd_rows(spark):
    docs = odd_docs(spark)
    out = bpe_mod.encode_decode(docs).collect()
    assert len(out) == docs.count()
    assert Counter((r.doc_id, r.decoded) for r in out) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert all((r.token_ids is None) == (r.decoded is None) == (r.n_tokens is None) for r in out)
    assert bpe_mod.encode_decode(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ 2


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)
    w = rng.random((500, 80)) * (rng.random((500, 80)) < 0.06)
    w = w[w.any(axis=1)]
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    q = rng.random((60, 80)) * (rng.random((60, 80)) < 0.06)
    q[0] = 0
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    got, score = toxicity.BlockMaxIndex.build(w, 16).search(q, 7)
    full = np.round(q @ w.T, 12)
    for k in range(len(q)):
        order = [j for j in np.lexsort((np.arange(len(w)), -full[k])) if full[k, j] > 0][:7]
        assert [j for j in got[k] if j >= 0] == order
        assert np.allclose(score[k][: len(order)], full[k][order])


def test_toxicity_on_held_out_labels(spark, sf01):
    big = sf01.replace("0.01", "0.1")
    docs, truth = table(spark, big, "documents"), table(spark, big, "labels")
    known = truth.filter("doc_id % 3 <> 0")
    out = toxicity.toxicity(docs, known).join(truth.filter("doc_id % 3 = 0"), "doc_id").select("toxic", "is_toxic").collect()
    caught = [r.is_toxic for r in out if r.toxic == 1]
    false = [r.is_toxic for r in out if r.toxic == 0]
    assert np.mean(caught) > 0.8 and np.mean(false) < 0.02
    kept = toxicity.without_toxic(docs, known)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity.toxicity(docs, known).filter("not is_toxic").count()


def test_toxicity_query_equals_brute_force(spark, sf01):
    """Counts, weights, cosines, neighbours with ties, votes and the calibrated score, one document at a time, under the sample that the query draws."""
    docs, truth = table(spark, sf01, "documents"), table(spark, sf01, "labels")
    model = toxicity.fit(docs, truth)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, truth).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {int(x): k for k, x in enumerate(model.vocabulary)}

    def hashes(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return toxicity.words(data, np.array([0, len(data)]))[2].tolist()

    counts = {d: Counter(held[h] for h in hashes(t) if h in held) for d, t in texts.items()}
    df = Counter(w for c in counts.values() for w in c)
    idf = [np.log((1 + len(texts)) / (1 + df[w])) + 1 for w in range(len(held))]

    def vector(c):
        v = {w: (1 + np.log(n)) * idf[w] for w, n in c.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = [vector(counts[int(i)]) for i in model.ids]
    assert {int(i): int(t) for i, t in zip(model.ids, model.toxic)} == {r.doc_id: r.toxic for r in truth.collect() if r.doc_id in set(model.ids.tolist())}
    for d, c in counts.items():
        q = vector(c) if c else {}
        cosine = [round(sum(x * e.get(w, 0.0) for w, x in q.items()), 12) for e in examples]
        near = sorted((k for k in range(len(examples)) if cosine[k] > 0), key=lambda k: (-cosine[k], k))[: toxicity.NEIGHBOURS]
        found = [(e.example_id, e.toxic) for e in got[d].evidence]
        assert np.allclose([e.similarity for e in got[d].evidence], [cosine[k] for k in near], atol=1e-9)
        if all(abs(cosine[a] - cosine[b]) > 1e-9 or cosine[a] == cosine[b] for a, b in zip(near, near[1:])):
            assert len(found) == len(near)
        if near:
            weight = [1 / (1 - min(e.similarity, 1) + 0.05) for e in got[d].evidence]
            vote = sum(w * t for w, (_, t) in zip(weight, found)) / sum(weight)
            assert np.isclose(got[d].toxicity, 1 / (1 + np.exp(-(model.slope * vote + model.shift)))) and got[d].is_toxic == (got[d].toxicity >= toxicity.REJECT)
        else:
            assert got[d].toxicity == model.base and not got[d].is_toxic and not found


def test_toxicity_without_evidence_is_never_toxic(spark):
    rows = [(k, f"bad{k % 3} worse{k % 2} vile", 1) for k in range(40)] + [(100 + k, f"kind{k % 3} nice{k % 2} good", 0) for k in range(40)] + [(200 + k, f"odd{k}", 1) for k in range(30)]
    docs, known = spark.createDataFrame([r[:2] for r in rows] + [(999, "nothing known"), (998, None)], "doc_id bigint, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id bigint, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, known, chi2=3.0, min_docs=1, alike=1.1).collect()}
    assert not out[999].is_toxic and not out[998].is_toxic and not out[999].evidence
    assert {999, 998} <= {r.doc_id for r in toxicity.without_toxic(docs, known, chi2=3.0, min_docs=1, alike=1.1).collect()}


def test_toxicity_on_odd_rows(spark):
    docs = odd_docs(spark)
    out = toxicity.toxicity(docs, labels(spark)).collect()
    assert len(out) == docs.count() and not any(r.is_toxic for r in out)
    assert toxicity.without_toxic(docs, labels(spark)).count() == docs.count()
    assert toxicity.toxicity(docs.limit(0), labels(spark)).count() == 0
    assert toxicity.toxicity(docs, labels(spark).limit(0)).count() == docs.count()


def test_toxicity_evidence_keeps_doubles_of_the_other_class_and_refills_copies(spark):
    rng = random.Random(3)
    text = {k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for k in range(120)}
    rows = [(k, text[k], int(k < 60)) for k in range(120)] + [(200 + k, text[0] + f" e{k}", 1) for k in range(90)] + [(300, text[5] + " but", 0)]
    docs, known = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id bigint, toxic int")
    whole = toxicity.evidence(docs, known, "text", "doc_id", 200)
    assert sorted(whole["id"]) == [*range(120), 300]
    few = toxicity.evidence(docs, known, "text", "doc_id", 30)
    assert few.groupby("y").size().to_dict() == {0: 30, 1: 30}
    assert few["id"].is_unique and few["id"].is_monotonic_increasing and ((few["id"] == 0) | few["id"].between(200, 299)).sum() == 1
    assert toxicity.evidence(docs, known.limit(0), "text", "doc_id", 30).empty


# ------------------------------------------------------------------ 3


def grams(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return frozenset(near_dedup.shingles(data, np.array([0, len(data)]))[0].tolist())


def test_near_dedup_recall_against_brute_force(spark, sf01):
    docs = table(spark, sf01, "documents")
    sets = {r.doc_id: grams(r.text) for r in docs.collect()}
    where = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    shared = Counter()
    for ds in where.values():
        shared.update(itertools.combinations(sorted(ds), 2))
    pairs = {p for p, n in shared.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= near_dedup.THRESHOLD}
    root = {d: d for d in sets}
    for r in near_dedup.near_groups(docs).collect():
        root[r.id] = r.root
    assert len(pairs) > 50
    assert np.mean([root[a] == root[b] for a, b in pairs]) >= 0.95
    # nobody is grouped without a partner that is nearly similar enough
    close = {x for p, n in shared.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= near_dedup.THRESHOLD - 0.2 for x in p}
    sizes = Counter(root.values())
    assert all(d in close for d in sets if sizes[root[d]] > 1)
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d in sets if root[d] == d}


def test_large_nodes_branch_and_still_find_all(spark):
    rng = random.Random(2)
    stock = " ".join(f"stock{k}" for k in range(60))
    rows = []
    for d in range(300):  # one passage in all, else different
        rows.append((d, stock + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))))
    base = [f"b{k}" for k in range(150)]
    for d in range(300, 420):  # copies with two words changed
        own = list(base)
        for _ in range(2):
            own[rng.randrange(150)] = f"e{d}"
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = near_dedup.near_groups(docs, small=20).collect()
    assert {r.id for r in groups} == set(range(301, 420)) and {r.root for r in groups} == {300}


def test_last_level_is_compared_in_blocks(spark):
    rng = random.Random(4)
    rows = []
    for d in range(90):  # 30 groups of three, all with one passage so long that the nodes don't part
        own = [f"g{d % 30}_{k}" for k in range(100)]
        own[rng.randrange(100)] = f"e{d}"
        rows.append((d, " ".join(f"s{k}" for k in range(70)) + " " + " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = near_dedup.near_groups(docs, small=7, depth=1, recall=0.999).collect()
    assert {(r.id, r.root) for r in groups} == {(d, d % 30) for d in range(30, 90)}


def test_one_id_with_two_texts_keeps_and_finds_both(spark):
    rng = random.Random(5)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows, near = [], lambda t: " ".join(t[:40] + ["changed"] + t[41:])
    for k in range(40):
        a, b = text(), text()
        rows += [(k, " ".join(a)), (k, " ".join(b)), (1000 + k, near(a)), (2000 + k, near(b))]
    rows += [(3000, "one text for two rows of it"), (3000, "one text for two rows of it")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, near_dedup.near_dedup(docs).collect())) == Counter({**{(k, t): 1 for k, t in rows if k < 1000}, rows[-1]: 1})


def test_trees_follow_the_recall():
    few, many = near_dedup.trees_for(0.8, 0.55, 4), near_dedup.trees_for(0.99, 0.55, 4)
    assert few < many < near_dedup.trees_for(0.99, 0.55, 12)
    rng, met, t = random.Random(0), 0, 0.55
    trees = near_dedup.trees_for(0.95, t, 3)
    for _ in range(4000):  # the branching of a pair that agrees in `t` of its tokens
        for _ in range(trees):
            nodes = 1
            for _ in range(3):
                nodes = sum(rng.random() < t for _ in range(sum(1 + (rng.random() < 1 / t - 1) for _ in range(nodes))))
            if nodes:
                met += 1
                break
    assert met / 4000 > 0.94


def test_link_joins_every_similar_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (6, near_dedup.COORDS)).astype(np.uint8)
    sig = np.concatenate([base[[k % 6]] for k in range(60)])
    noise = rng.random(sig.shape) < 0.15
    sig = np.where(noise, rng.integers(0, 256, sig.shape), sig).astype(np.uint8)
    comp = list(range(60))
    for a, b in near_dedup.link(sig, 0.6):
        comp = [comp[a] if c == comp[b] else c for c in comp]
    for a, b in itertools.combinations(range(60), 2):
        if (sig[a] == sig[b]).sum() >= near_dedup.agreements(0.6):
            assert comp[a] == comp[b]


def test_components_of_chains(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 103)]
    random.Random(0).shuffle(chain)
    got = {r.id: r.root for r in near_dedup.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100, 103: 100}


def test_near_dedup_on_odd_rows(spark):
    docs = odd_docs(spark)
    out = near_dedup.near_dedup(docs)
    got = Counter(r.doc_id for r in out.collect())
    assert out.columns == docs.columns
    assert got == Counter([1, 3, 4, 5, 6, None, None, 7, 8, 9, 10, 11])
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0
    again = docs.filter("doc_id = 2")
    assert near_dedup.near_dedup(again).count() == 1


# ------------------------------------------------------------------ 4


def test_license_scan(spark):
    rows = [
        (1, "prose here\nLicensed under CC BY-NC 4.0.\nmore prose"),
        (2, "x\nLicensed under the Apache License, Version 2.0."),
        (3, "Released under the MIT License.\nmiddle\nThis work is licensed under the GNU General Public License, version 3."),
        (4, "no such thing at all"),
        (5, None),
        (6, ""),
        (7, "word " * 40_000 + "Licensed under CC BY 4.0. " + "word " * 40_000),
        (8, "Copyright by somebody. All rights reserved."),
        (8, "Copyright by somebody. All rights reserved."),
        (9, "This work is licensed under the GNU General Public License, version 2."),
        (10, "\n".join(next(w for w in templates.WORDINGS["Apache-2.0"] if len(w) > 2))),
    ]
    docs = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id bigint, text string, license string")
    out = licenses.license_scan(docs).collect()
    sure = sorted((r.doc_id, r.license) for r in out if r.confirmed)
    assert sure == [(1, "CC-BY-NC-4.0"), (2, "Apache-2.0"), (3, "GPL-3.0"), (3, "MIT"), (7, "CC-BY-4.0"), (9, "GPL-2.0"), (10, "Apache-2.0")]
    assert Counter(r.doc_id for r in out)[8] == 2 and not any(r.confirmed for r in out if r.doc_id == 8)
    assert all(dict(rows)[r.doc_id][r.start : r.start + len(r.block)] == r.block for r in out)
    assert Counter(r.doc_id for r in out)[10] == 1
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_license_scan_finds_what_a_word_search_finds(spark, sf01):
    docs = table(spark, sf01, "documents")
    notices = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = {(r.doc_id, name) for r in docs.collect() for text, name in notices.items() if text in r.text}
    got = {(r.doc_id, r.license) for r in licenses.license_scan(docs).collect() if r.confirmed}
    assert want and got == want


def test_license_full_texts_confirm_each_other_only():
    scanner = licenses.Scanner()
    for name, text in licenses.TEMPLATES:
        got = scanner.scan(text)
        assert got[0] == name and got[1], (name, text, got)


def test_every_template_alone_is_found(spark):
    own = [("Own-1.0", "You can do what you want.")]
    for wordings, given in ((templates.TEMPLATES, None), (own, own)):
        docs = spark.createDataFrame([(k, f"Some prose.\n\n{t}\n\nMore prose.") for k, (_, t) in enumerate(wordings)], "doc_id bigint, text string")
        got = {(r.doc_id, r.license) for r in licenses.license_scan(docs, templates=given).collect() if r.confirmed}
        assert got == {(k, name) for k, (name, _) in enumerate(wordings)}


def test_all_rights_reserved_has_a_row(spark):
    docs = spark.createDataFrame([(1, "prose\nAll rights reserved.\nprose"), (2, "prose\nAll rights\n# reserved."), (3, "the seats are reserved")], "doc_id bigint, text string")
    got = [(r.doc_id, r.license, r.confirmed, r.found) for r in licenses.license_scan(docs).collect()]
    assert sorted(got) == [(1, "All-Rights-Reserved", False, 1.0), (2, "All-Rights-Reserved", False, 1.0)]


def test_every_wording_is_found_wherever_it_stands(spark):
    rng = random.Random(11)
    prose = [w for w in "the river ran slowly past old stone houses while seven boats waited under a grey bridge for morning tide and rain".split()]
    few = lambda: " ".join(rng.choice(prose) for _ in range(rng.randint(3, 60)))
    rows, want = [], {}
    for d in range(60):
        picked = [rng.choice(templates.TEMPLATES) for _ in range(rng.randint(0, 4))]
        text = few() + "".join(f" {t} {few()}" for _, t in picked)
        wrap = rng.choice([0, 25, 80])
        rows.append((d, "\n".join(textwrap.wrap(text, wrap, break_long_words=False, break_on_hyphens=False)) if wrap else text))
        want[d] = [name for name, _ in picked]
    out = licenses.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = {d: [r.license for r in sorted(out, key=lambda r: r.start) if r.doc_id == d and r.confirmed] for d in want}
    assert got == want


MIT_TEXT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD2_TEXT = """Copyright (c) 2020, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3_TEXT = BSD2_TEXT + """
3. Neither the name of the Example Company nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""
GNU_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def test_license_texts_as_they_are_wrapped(spark):
    public = [("MIT", MIT_TEXT), ("BSD-2-Clause", BSD2_TEXT + BSD_END), ("BSD-3-Clause", BSD3_TEXT + BSD_END), ("ISC", ISC_TEXT), ("GPL-2.0", GNU_TEXT.format("", "2")), ("GPL-3.0", GNU_TEXT.format("", "3")), ("LGPL-2.1", GNU_TEXT.format("Lesser ", "2.1")), ("AGPL-3.0", GNU_TEXT.format("Affero ", "3"))]
    ways = [lambda t: t, lambda t: "prose of the author\n" * 9 + t + "\nfurther prose" * 9, lambda t: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */\nint main;", lambda t: "\n".join(textwrap.wrap(t, 30)), lambda t: t.replace("\n", " ")]
    rows = [(k * 10 + w, name, way(text)) for k, (name, text) in enumerate(public) for w, way in enumerate(ways)]
    rows.append((1000, "", MIT_TEXT + "\n\n" + GNU_TEXT.format("", "2") + "\n\n" + BSD3_TEXT + BSD_END))
    out = licenses.license_scan(spark.createDataFrame([(a, b) for a, _, b in rows], "doc_id bigint, text string")).collect()
    sure = sorted((r.doc_id, r.license) for r in out if r.confirmed)
    assert sure == sorted([(a, name) for a, name, _ in rows if name] + [(1000, "MIT"), (1000, "GPL-2.0"), (1000, "BSD-3-Clause")])
    texts = {a: b for a, _, b in rows}
    assert all(texts[r.doc_id][r.start : r.start + len(r.block)] == r.block for r in out)


def test_license_notices_in_one_line(spark):
    prose = "the river ran through the valley of the old town and under the bridge in a long summer " * 6
    mit, apache, cc = "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Released under CC BY-SA 4.0."
    rows = [
        (1, f"{mit} {apache}", ["Apache-2.0", "MIT"]),
        (2, f"{apache} {mit} {cc}", ["Apache-2.0", "CC-BY-SA-4.0", "MIT"]),
        (3, f"{prose}{mit} {prose}{apache} {prose}", ["Apache-2.0", "MIT"]),
        (4, f"{prose}{mit} {prose}{cc} {prose}{apache} {prose}" * 2, ["Apache-2.0", "Apache-2.0", "CC-BY-SA-4.0", "CC-BY-SA-4.0", "MIT", "MIT"]),
        (5, f"{' '.join(MIT_TEXT.split())} {' '.join(ISC_TEXT.split())} {mit}", ["ISC", "MIT", "MIT"]),
        (6, f"{mit} {mit}\n{cc}", ["CC-BY-SA-4.0", "MIT", "MIT"]),
    ]
    out = licenses.license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")).collect()
    assert {a: sorted(r.license for r in out if r.doc_id == a and r.confirmed) for a, _, _ in rows} == {a: c for a, _, c in rows}
    texts = {a: b for a, b, _ in rows}
    assert all(texts[r.doc_id][r.start : r.start + len(r.block)] == r.block for r in out)
    assert [r.block.strip() for r in sorted(out, key=lambda r: r.start) if r.doc_id == 2] == [apache, mit, cc]


# ------------------------------------------------------------------ 5


def test_exact_dedup_against_brute_force(spark, sf01):
    docs = table(spark, sf01, "documents")
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 100_000))
    want = {}
    for r in docs.collect():
        want[r.text] = min(want.get(r.text, 1 << 60), r.doc_id)
    got = [r.doc_id for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted(got) == sorted(want.values())
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs, max_filter_mb=0).collect()) == sorted(got)


def test_exact_dedup_on_odd_rows(spark):
    docs = odd_docs(spark)
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 3, 4, None, 5, 7, 8, 9, 10, 11])
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_repeated_hashes_are_never_missed():
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**62), 2**62, 20_000)
    again = rng.choice(h, 700, replace=False)
    seen = exact_dedup.Repeats(21_000, 16)
    for lo in range(0, 20_700, 1000):
        seen.add(np.concatenate([h, again])[lo : lo + 1000])
    got = seen.all()
    assert set(again) <= set(got) and len(got) < 700 + 200


def test_slices_follow_the_rows(spark):
    assert common.slices_for(spark, 10) == common.shuffle_partitions(spark)
    assert common.slices_for(spark, 5 * 10**10) * common.SLICE_ROWS >= 5 * 10**10


# ------------------------------------------------------------------ 6


def naive_bins(sizes, capacity):
    """Gaps after greedy pairing of large items and best fit of the small ones, one item at a time."""
    large = sorted(s for s in sizes if 3 * s > capacity)
    gaps = []
    while large:
        s = large.pop()
        k = max((k for k in range(len(large)) if large[k] <= capacity - s), default=-1)
        mate = large.pop(k) if k >= 0 else 0
        gaps.append(capacity - s - mate)
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_one_by_one_packing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 200))
    sizes = np.minimum(capacity, rng.lognormal(3, 1, 400).astype(int) + 1)
    values, counts = np.unique(sizes, return_counts=True)
    rows, bins = packing.plan(values, counts, capacity)
    fill = np.zeros(bins, int)
    seen = Counter()
    spots = defaultdict(list)
    for s, lo, hi, first, each, offset in rows.tolist():
        for r in range(lo, hi):
            b, o = first + (r - lo) // each, offset + (r - lo) % each * s
            fill[b] += s
            spots[b].append((o, o + s))
            seen[s] += 1
    assert seen == Counter(sizes.tolist())
    assert sorted(capacity - fill) == naive_bins(sizes.tolist(), capacity)
    for part in spots.values():
        part.sort()
        assert part[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(part, part[1:]))


def check_packing(rows, lengths, capacity):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.start + r.length))
        by_bin[r.bin_id].append((r.bin_offset, r.bin_offset + r.length))
    for d, n in lengths.items():
        part = sorted(by_doc[d])
        assert part[0][0] == 0 and part[-1][1] == n and all(a[1] == b[0] for a, b in zip(part, part[1:]))
    for part in by_bin.values():
        part.sort()
        assert part[0][0] >= 0 and part[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(part, part[1:]))
    assert sorted(by_bin) == list(range(len(by_bin)))
    return len(by_bin)


def test_packing_documents(spark, sf01):
    docs = table(spark, sf01, "documents")
    lengths = {r.doc_id: len(r.text) for r in docs.collect()}
    bins = check_packing(packing.pack(docs, 8192).collect(), lengths, 8192)
    rest = [n % 8192 for n in lengths.values() if n % 8192]
    assert bins == len(naive_bins(rest, 8192)) + sum(n // 8192 for n in lengths.values())


def test_packing_in_many_small_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 3)
    rng = random.Random(7)
    lengths = {k: rng.choice([1, 5, 20, 33, 34, 60, 100, 101, 350, 1000]) for k in range(400)}
    docs = spark.createDataFrame([(k, "x" * n) for k, n in lengths.items()], "doc_id bigint, text string")
    bins = check_packing(packing.pack(docs, 100).collect(), lengths, 100)
    assert bins == len(naive_bins([n % 100 for n in lengths.values() if n % 100], 100)) + sum(n // 100 for n in lengths.values())


def test_packing_on_odd_rows(spark):
    docs = odd_docs(spark)
    out = packing.pack(docs, 50).collect()
    assert sum(r.length for r in out) == sum(len(r.text or "") for r in docs.collect())
    assert {r.doc_id for r in out} == {1, 2, None, 7, 8, 9, 10, 11}
    assert packing.pack(docs.limit(0), 50).count() == 0
    assert packing.pack(docs.filter("doc_id in (5, 6)"), 50).count() == 0


# ------------------------------------------------------------------ 7


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    good, tr = rng.normal(size=(1, 6)), rng.normal(size=(2, 2))
    m, logz, pairs = quality.forward_backward(good, np.ones((1, 6), bool), tr)
    total, marg, pair = 0.0, np.zeros(6), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(good[0, k] for k in range(6) if y[k]) + sum(tr[a, b] for a, b in zip(y, y[1:])))
        total += w
        marg += w * np.array(y)
        for a, b in zip(y, y[1:]):
            pair[a, b] += w
    assert np.allclose(m[0], marg / total) and np.isclose(logz[0], np.log(total)) and np.allclose(pairs, pair / total)


def test_training_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(8)
    n = np.array([1, 2, 3, 5, 8, 8])
    first, y = np.concatenate([[0], np.cumsum(n)]), np.array([0, 1, 0, 1, 1, 0])
    x, weight = rng.normal(size=(n.sum(), 4)), rng.random(6)
    theta = rng.normal(size=8)

    def loss(theta):  # by enumeration of all labellings
        total = 0.0
        for k in range(6):
            good, tr = x[first[k] : first[k + 1]] @ theta[:4], theta[4:].reshape(2, 2)
            score = lambda ys: sum(good[t] for t in range(n[k]) if ys[t]) + sum(tr[a, b] for a, b in zip(ys, ys[1:]))  # noqa: B023, E731
            total += weight[k] * (np.log(sum(np.exp(score(ys)) for ys in itertools.product((0, 1), repeat=int(n[k])))) - score([y[k]] * n[k]))
        return total + 0.05 * (theta**2).sum()

    got, grad = quality.objective(theta[:4], theta[4:].reshape(2, 2), x, first, y, weight, 0.1)
    assert np.isclose(got, loss(theta))
    for k in range(8):
        step = np.eye(8)[k] * 1e-5
        assert np.isclose(grad[k], (loss(theta + step) - loss(theta - step)) / 2e-5, atol=1e-6)


def naive_line_features(text):
    """What `line_features` says of each line that isn't blank, one character and word at a time."""
    import re

    rows, lengths = [], []
    for line in text.split("\n"):
        raw = line.encode()
        if not line.strip(" \t\r\f\v"):
            continue
        of = lambda chars: sum(b in chars for b in raw) / len(raw)  # noqa: B023, E731
        own = [sum(97 <= b <= 122 or b >= 128 for b in raw) / len(raw), of(range(65, 91)), of(range(48, 58)), of(b" \t\r\f\v"), of(b"#$%&*@^~+=<>\\{}[]_/`"), of(b".,;:?'\"()-"), of(b"!"), of(b"|")]
        ws = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
        own += [np.log1p(len(raw)) / 5, sum(map(len, ws)) / max(1, len(ws)) / 10]
        own += [sum(a == b for a, b in zip(ws, ws[lag:])) / max(1, len(ws)) for lag in (1, 2, 3)]
        own += [len(set(ws)) / len(ws) if ws else (1.0 if not re.search(rb"[0-9A-Za-z\x80-\xff]", text.encode()) else 0.0), np.log1p(len(ws)) / 5]
        rows.append(own)
        lengths.append(len(raw))
    zero = [0.0] * len(rows[0]) if rows else []
    return [[*r, *(rows[k - 1] if k else zero), *(rows[k + 1] if k + 1 < len(rows) else zero), float(k > 0), float(k + 1 < len(rows)), 1.0] for k, r in enumerate(rows)], lengths


def test_quality_query_equals_brute_force(spark, sf):
    """Features by hand and every labelling enumerated, under the field that the query trains."""
    docs, truth = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, truth)
    got = {r.doc_id: r.quality for r in quality.quality(docs, truth).collect()}
    tested = 0
    for r in docs.collect():
        features, lengths = naive_line_features(r.text)
        if not 0 < len(features) <= 9:
            continue
        good = np.clip((np.array(features) - model.mean) / model.scale, -8, 8) @ model.weights
        z, marginal = 0.0, np.zeros(len(good))
        for ys in itertools.product((0, 1), repeat=len(good)):
            w = np.exp(sum(g for g, a in zip(good, ys) if a) + sum(model.transition[a, b] for a, b in zip(ys, ys[1:])))
            z, marginal = z + w, marginal + w * np.array(ys)
        assert np.isclose(got[r.doc_id], (marginal / z * lengths).sum() / sum(lengths), atol=1e-6), r.doc_id
        tested += 1
    assert tested > 50


def test_padding_changes_nothing():
    rng = np.random.default_rng(4)
    good, tr = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    padded = np.concatenate([good, np.full((1, 3), 9.0)], axis=1)
    mask = np.arange(7) < 4
    a, za, pa_ = quality.forward_backward(good, np.ones((1, 4), bool), tr)
    b, zb, pb = quality.forward_backward(padded, mask[None], tr)
    assert np.allclose(a, b[:, :4]) and np.allclose(za, zb) and np.allclose(pa_, pb)


def test_lines_equal_python_lines():
    texts = ["a b\n\n c \n\nlast", "", "\n\n", "one", "x\r\ny\n", "é\n\tz"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts, ends, first = quality.lines(data, offs)
    for k, t in enumerate(texts):
        got = [bytes(data[a:b]).decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])]
        assert got == [x for x in t.split("\n") if x.strip()]


def test_quality_on_held_out_labels(spark, sf01):
    big = sf01.replace("0.01", "0.1")
    docs, truth = table(spark, big, "documents"), table(spark, big, "labels")
    out = quality.quality(docs, truth.filter("doc_id % 3 <> 0")).join(truth.filter("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("y")), "doc_id").collect()
    assert np.mean([r.is_good for r in out if r.y == 1]) > 0.98
    assert np.mean([not r.is_good for r in out if r.y == 0]) > 0.95


def test_quality_on_odd_rows(spark):
    docs = odd_docs(spark)
    out = quality.quality(docs, labels(spark)).collect()
    assert len(out) == docs.count()
    assert all(r.quality is None and r.is_good for r in out if r.doc_id in (3, 4, 5, 6, 9))
    assert all(0 <= r.quality <= 1 for r in out if r.doc_id in (1, 7, 10))
    assert quality.only_good(docs, labels(spark)).columns == docs.columns
    assert quality.quality(docs.limit(0), labels(spark)).count() == 0
    assert quality.quality(docs, labels(spark).limit(0)).filter("quality is null and is_good").count() == docs.count()


# ------------------------------------------------------------------ 8


def lm_tokens(text):
    """Tokens of a text one by one: their hashes by hashing each alone."""
    import re

    runs = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20\x7f]+", text.encode())
    return [int(lm_score.tokens(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0][0]) for r in runs]


def test_lm_tokens_and_counts(spark):
    texts = ["The cat, the DOG -- sat.", None, "", "the\ncat... é漢 x1!", " \t\n", "The cat, the DOG -- sat."]
    whole = "".join(t or "" for t in texts).encode()
    token, first = lm_score.tokens(np.frombuffer(whole, np.uint8), np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in texts])]))
    assert [token[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [lm_tokens(t or "") for t in texts]
    counts = lm_score.gather(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == dict(Counter(x for t in texts for x in lm_tokens(t or "")))
    shares = np.exp(lm_score.inside_class(counts).astype(float)).reshape(lm_score.CLASSES, -1).sum(axis=1)
    assert np.allclose(shares, 1, atol=1e-4)


def wide_network(seed):
    rng = np.random.default_rng(seed)
    net = lm_score.Network(*[p.astype(np.float64) for p in lm_score.Network.fresh(rng.integers(1, 50, lm_score.CLASSES)).parts()])
    for p in net.parts():
        p += rng.normal(0, 0.3, p.shape)
    return net


def naive_class_log_probs(net, context):
    z = np.tanh(sum(net.embed[c] for c in context) + net.hidden)
    soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    a = soft(z @ net.upper + net.upper_bias)
    return np.concatenate([a[g] + soft(z @ net.lower[g] + net.lower_bias[g]) for g in range(lm_score.LEVEL)])


def test_lm_network_equals_naive_and_sums_to_one():
    net, rng = wide_network(1), np.random.default_rng(2)
    text = " ".join(rng.choice(["the", "cat", "sat.", "mat", "On", "a,b"], 40))
    token, first = lm_score.tokens(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    inside = lm_score.inside_class(np.bincount(token, minlength=lm_score.TOKENS))
    ts, want = token.tolist(), 0.0
    for i, t in enumerate(ts):
        own = [(ts[i - b] >> (lm_score.TOKEN_BITS - lm_score.PLACE_BITS) if 0 <= i - b < len(ts) else 0) + k * lm_score.PLACES for k, b in enumerate(lm_score.SIDES)]
        p = naive_class_log_probs(net, own)
        assert np.isclose(np.exp(p).sum(), 1)
        want += p[t >> (lm_score.TOKEN_BITS - lm_score.CLASS_BITS)] + inside[t]
    assert np.isclose(lm_score.row_scores(net, inside, token, first)[0], want)


def test_lm_gradient_by_finite_differences():
    net, rng = wide_network(3), np.random.default_rng(4)
    places = np.arange(len(lm_score.SIDES)) * lm_score.PLACES
    context, klass = (rng.integers(0, 5, (60, len(places))) + places).astype(np.uint16), rng.integers(0, lm_score.CLASSES, 60).astype(np.int16)
    loss, ((rows, values, seen), *rest) = net.gradient(context, klass)
    assert np.isclose(loss, -np.mean([naive_class_log_probs(net, c)[y] for c, y in zip(context, klass)]))
    assert seen.sum() == context.size and sorted(set(context.ravel().tolist())) == rows.tolist()
    embed = np.zeros_like(net.embed)
    embed[rows] = values
    for p, g in zip(net.parts(), [embed, *rest]):
        for at in {int(x) for x in [np.abs(g).argmax(), *rng.integers(0, p.size, 5)]}:
            there = np.unravel_index(at, p.shape)
            kept, sides = p[there], []
            for step in (1e-5, -1e-5):
                p[there] = kept + step
                sides.append(net.gradient(context, klass)[0])
            p[there] = kept
            assert np.isclose(g[there], (sides[0] - sides[1]) / 2e-5, atol=1e-7)


def test_lm_averages_changes_by_what_was_seen():
    start = wide_network(5)
    a, b = start.copy(), start.copy()
    a.embed[7] += 1
    b.embed[7] += 3
    b.upper += 2
    seen = np.zeros(len(start.embed), np.float32)
    seen[7] = 1
    total = {}
    for net, s, n in ((a, seen, 10), (b, 3 * seen, 30)):
        for k, w, v in lm_score.blocks([x - y for x, y in zip(net.parts(), start.parts())], s, n):
            old = total.setdefault(k, [0, 0])
            old[0] = old[0] + w
            old[1] = old[1] + w[:, None] * v.astype(float).reshape(len(w), -1)
    out = lm_score.moved(start, {k: v / np.maximum(w, 1e-9)[:, None] for k, (w, v) in total.items()})
    assert np.allclose(out.embed[7], start.embed[7] + 2.5, atol=1e-3) and np.allclose(out.upper, start.upper + 1.5, atol=1e-3) and np.allclose(out.embed[8], start.embed[8])


def test_lm_query_equals_scores_token_by_token(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").filter("length(text) < 400")
    counts = lm_score.gather(docs)
    net, inside = lm_score.train(docs, counts), lm_score.inside_class(counts)
    got = {r.doc_id: r for r in lm_score.lm_score(docs).collect()}
    for r in docs.limit(40).collect():
        ts, want = lm_tokens(r.text), 0.0
        for i, t in enumerate(ts):
            own = [(ts[i - b] >> (lm_score.TOKEN_BITS - lm_score.PLACE_BITS) if 0 <= i - b < len(ts) else 0) + k * lm_score.PLACES for k, b in enumerate(lm_score.SIDES)]
            want += naive_class_log_probs(net, own)[t >> (lm_score.TOKEN_BITS - lm_score.CLASS_BITS)] + inside[t]
        assert got[r.doc_id].n_tokens == len(ts) and np.isclose(got[r.doc_id].log_likelihood, want, rtol=1e-4)


def test_lm_learns_and_scores_prose_above_noise(spark, sf01):
    docs = table(spark, sf01, "documents").select("doc_id", "text")
    rng = random.Random(0)
    junk = spark.createDataFrame([(10**6 + k, "".join(chr(rng.randrange(33, 126)) for _ in range(400))) for k in range(5)], "doc_id bigint, text string")
    both = docs.unionByName(junk)
    out = {r.doc_id: r for r in lm_score.lm_score(both).collect()}
    assert len(out) == 1005
    assert max(out[10**6 + k].mean_log_prob for k in range(5)) < np.median([r.mean_log_prob for r in out.values()]) - 1
    counts = lm_score.gather(both)
    n = counts.sum()
    of_class = counts.reshape(lm_score.CLASSES, -1).sum(axis=1)
    without = ((counts * lm_score.inside_class(counts)).sum() + (of_class[of_class > 0] * np.log(of_class[of_class > 0] / n)).sum()) / n
    assert sum(r.log_likelihood for r in out.values()) / n > without + 0.1  # what the context tells


def test_lm_on_odd_rows(spark):
    docs = odd_docs(spark)
    out = lm_score.lm_score(docs, rounds=1).collect()
    assert len(out) == docs.count()
    assert all(r.n_tokens == 0 and r.log_likelihood == 0 and r.mean_log_prob is None for r in out if r.doc_id in (3, 4, 5, 6, 9))
    assert lm_score.lm_score(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ 9


def brute(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for a, i in enumerate(ids):
        d = np.round(np.sqrt(((x - x[a]) ** 2).sum(axis=1)), 9)
        out[i] = [(j, v) for v, j in sorted((d[b], j) for b, j in enumerate(ids) if j != i)[:k]]
    return out


@pytest.mark.parametrize("group", [64, 8192])
def test_topk_is_exact(spark, group):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 12))
    x = centres[rng.integers(0, 9, 500)] + 0.05 * rng.normal(size=(500, 12))
    x[50:60] = x[50]  # ties
    vectors = {int(k) * 3: [float(v) for v in row] for k, row in enumerate(x)}
    df = spark.createDataFrame([(k, v, "c") for k, v in vectors.items()], "vec_id bigint, embedding array<double>, rank string")
    got = defaultdict(list)
    for r in sorted(topk.nearest(df, 5, group=group).collect(), key=lambda r: r["rank"]):
        got[r.vec_id].append((r.neighbour_id, r.distance))
    want = brute(vectors, 5)
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
    assert all(np.allclose([d for _, d in got[i]], [d for _, d in want[i]], atol=1e-8) for i in want)


def test_search_leaves_candidates_out():
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.01 * rng.normal(size=(300, 8)) for c in rng.normal(size=(10, 8)) * 3])
    pivots = topk.choose_pivots(x[::7], 12)
    p = topk.distances(x, pivots)
    ids = np.arange(len(x))
    *_, evaluated = topk.search(x, ids, p, np.full(len(x), np.inf), x, ids, p, 5)
    assert evaluated < 0.5 * len(x) ** 2


@pytest.mark.parametrize("magnitude", [1e-6, 1e5, 1e7, 1e9])
def test_topk_is_exact_at_every_magnitude(spark, magnitude):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(7, 10))
    x = (centres[rng.integers(0, 7, 2000)] + 0.05 * rng.normal(size=(2000, 10))) * magnitude
    x[1000:] = rng.normal(size=(1000, 10)) * magnitude  # half of them far from all others
    x[50:60] = x[50]
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(topk.nearest(df, 5, group=100).collect(), key=lambda r: r["rank"]):
        got[r.vec_id].append((r.neighbour_id, r.distance))
    want = brute(dict(enumerate(x)), 5)
    wrong = [i for i in want if not np.allclose([d for _, d in got[i]], [d for _, d in want[i]], rtol=1e-12, atol=1.01e-9)]
    assert not wrong and set(got) == set(want)
    if magnitude <= 1e5:  # beyond, rounded ties depend on the order of sums
        assert sum([j for j, _ in got[i]] != [j for j, _ in want[i]] for i in want) == 0


def test_topk_of_one_place_is_cut_by_a_hash(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(300)] + [(300, [5.0, 5.0])], "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id, r["rank"], r.neighbour_id) for r in topk.nearest(df, 2, group=20).collect())
    assert got == sorted((q, k + 1, n) for q in range(301) for k, n in enumerate([n for n in range(3) if n != q][:2]))


def test_topk_on_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [0.0, 1.0]), (4, [nan, 1.0]), (5, [1.0]), (6, []), (7, [None, 1.0]), (8, [3.0, 0.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id, r["rank"], r.neighbour_id, r.distance) for r in topk.nearest(df, 5).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 8, 3.0), (2, 1, 1, 1.0), (2, 2, 8, 2.0), (8, 1, 2, 2.0), (8, 2, 1, 3.0)]
    assert topk.nearest(df.limit(0)).count() == 0
    assert topk.nearest(df.filter("vec_id = 1")).count() == 0


def stored(spark):
    """Bytes of shuffle written so far, and of the shared folder now."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size())), sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def test_topk_stores_vectors_once_however_many_groups_are_searched(spark):
    x = np.random.default_rng(8).normal(size=(3000, 24))  # no bound rules a group out
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    shuffled, kept = stored(spark)
    out = topk.nearest(df, 3, group=100)
    assert out.count() == 9000
    again, left = stored(spark)
    assert again - shuffled + max(0, left - kept) < 4 * x.nbytes
    assert not list(Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob("table-*"))


def test_shared_folder_opens_whatever_its_name(tmp_path):
    place = tmp_path / "a b%20#c"
    place.mkdir()
    (place / "x").write_bytes(b"here")
    for uri in (f"file:{place}", f"file://{place}", str(place)):
        system, root = common.opened(uri)
        assert system.open_input_file(f"{root}/x").read() == b"here"


def test_topk_of_repeated_ids_and_single_precision(spark):
    x = np.random.default_rng(9).normal(size=(400, 6)).astype(np.float32)
    rows = [(k % 390, [float(a) for a in v]) for k, v in enumerate(x)]  # ten ids twice
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    vectors = {i: min(v for j, v in rows if j == i) for i in range(390)}
    got = {(r.vec_id, r["rank"]): (r.neighbour_id, r.distance) for r in topk.nearest(df, 4, group=50).collect()}
    assert got == {(i, n + 1): pair for i, near in brute(vectors, 4).items() for n, pair in enumerate(near)}


def test_search_stops_asking_bounds_that_rule_nothing_out(monkeypatch):
    x = np.random.default_rng(10).normal(size=(4000, 48))
    p, ids, asked, bounds = topk.distances(x, x[:24]), np.arange(4000), [], topk.Tile.bounds
    monkeypatch.setattr(topk.Tile, "bounds", lambda *a: asked.append(bounds(*a)) or asked[-1])
    for tau in (np.inf, 8.0):
        asked.clear()
        topk.search(x[:500], ids[:500], p[:500], np.full(500, tau), x, ids, p, 5)
        assert sum(b.size for b in asked) < 500 * 4000 / 4


@pytest.mark.parametrize("offset, gap", [(0.0, 1.0), (3.0, 1e-2), (1e3, 1e-3), (1e6, 1.0), (0.0, 1e-7), (0.0, 1e30)])
def test_search_is_exact_in_either_precision(offset, gap):
    rng = np.random.default_rng(11)
    x = offset + gap * rng.normal(size=(3000, 20))
    x[:4] += 50 * gap  # the unit of length isn't that of the gaps
    x[100:130] = x[100]
    p, ids, k = topk.distances(x, topk.choose_pivots(x[::9], 16)), rng.permutation(3000), 6
    for q, n in ((slice(0, 200), 3000), (slice(90, 140), 3000), (slice(0, 20), 5)):
        r, c, d, _ = topk.search(x[q], ids[q], p[q], np.full(q.stop - q.start, np.inf), x[:n], ids[:n], p[:n], k)
        for a in range(q.stop - q.start):
            exact = np.round(np.sqrt(((x[:n] - x[q][a]) ** 2).sum(axis=1)), topk.PLACES)
            want = [(v, i) for v, i in sorted(zip(exact, ids[:n])) if i != ids[q][a]][:k]
            assert sorted(zip(d[r == a], ids[c[r == a]])) == want


# ------------------------------------------------------------------ 10


def chat_by_hand(enc, size, turns):
    ids, mask = [], []
    for role, text in turns:
        head = [size + 1, *enc.encode_ordinary(chat.escape(role or "unknown") + "\n")]
        body = [*enc.encode_ordinary(chat.escape(text or "")), size + 2]
        tail = enc.encode_ordinary("\n")
        ids += head + body + tail
        mask += [0] * len(head) + [int(role == "assistant")] * len(body) + [0] * len(tail)
    return [*ids, size], [*mask, 0]


def test_chat_equals_assembly_by_hand(spark, bpe, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame(
        [(10**6, 1, "user", "say <|im_end|> or <|endoftext|> or <\\|x"), (10**6, 2, "assistant", None), (10**6, 2, "assistant", None), (10**6, None, None, ""), (None, 1, "user", "lost"), (None, 2, "assistant", "found"), (10**6 + 1, 1, "assistant", "word " * 30_000)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    turns = turns.unionByName(odd).withColumn("n_turns", F.lit("x"))
    enc = reference(bpe)
    by = defaultdict(list)
    for r in turns.collect():
        by[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "unknown", r.text is not None, r.text or "", r.role, r.text))
    out = chat.chat_format(turns).collect()
    assert len(out) == len(by)
    for r in out:
        ids, mask = chat_by_hand(enc, bpe.size, [x[-2:] for x in sorted(by[r.conv_id], key=lambda x: x[:5])])
        assert r.token_ids == ids and r.loss_mask == mask and r.n_tokens == len(ids) and r.n_turns == len(by[r.conv_id])
    assert chat.chat_format(turns.limit(0)).count() == 0


def test_escape_round_trip():
    rng = random.Random(0)
    for _ in range(500):
        t = "".join(rng.choice("<|\\a>") for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_ranks_file_is_what_the_encoder_uses(bpe):
    with open(bpe_mod.VOCABULARY, "rb") as f:
        first = f.readline().split()
    assert bpe.ranks[base64.b64decode(first[0])] == int(first[1])
