"""Each operator on small tables against brute force, and on the awkward inputs: nulls, empty and
very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import (common, components, decontaminate, licenses, lines, minhash, mixing, neighbours, quality, repeats,
                       tokens, toxicity)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size long, target double, id long, key string, component long, score double")
SMALL = "/root/testdata/sf0.001"
random.seed(4)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8))) for _ in range(4000)]


def prose(n: int) -> str:
    return " ".join(random.choices(WORDS, k=n))


def corpus() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, a shared passage, short, empty, null and long texts, a null id, repeated rows."""
    base, passage = prose(120), prose(60)
    near = base.split()
    near[50] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, passage + " " + prose(80)), (5, prose(40) + " " + passage),
            (6, ""), (7, None), (8, "two words"), (9, "two words"), (10, prose(20_000)), (None, prose(30)),
            (11, prose(90)), (11, prose(90)), (12, "ab " * 400), (13, prose(50) + "\n" + base.upper())]
    return rows + [rows[0], (14, "é" * 300), (15, "   \n\t ")]


ROWS = corpus()


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}" if d != 5 else None, len(t or ""), 1, 2.0, 3, "k", 4, 5.0)
                                  for d, t in rows], SCHEMA)


def got(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def empty(spark):
    return frame(spark, ROWS).limit(0)


# ------------------------------------------------------------------ 1

def brute_repeats(rows, length=repeats.LENGTH):
    seen: Counter = Counter()
    raws = [(t or "").encode() for _, t in rows]
    for b in raws:
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = Counter()
    for (d, _), b in zip(rows, raws):
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


COLUMNS_1 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats_equal_brute_force(spark):
    assert got(repeats.remove_repeats(frame(spark, ROWS)), *COLUMNS_1) == brute_repeats(ROWS)
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_repeats_of_a_hot_key_are_dealt_out_anew(spark, monkeypatch):
    passage = prose(60)
    rows = [(i, prose(random.randint(5, 40)) + " " + passage + " " + prose(30)) for i in range(60)]
    monkeypatch.setattr(repeats, "MERGE_BYTES", 2000)
    assert got(repeats.remove_repeats(frame(spark, rows)), *COLUMNS_1) == brute_repeats(rows)


def test_merged_transforms_find_the_repeats_of_all_shards(monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 700)
    alphabet = "ab"
    segs = ["".join(random.choices(alphabet, k=random.randint(200, 420))).encode() for _ in range(20)]
    segs += [segs[3][10:230], segs[5] + b"c", b"ab" * 180]
    n = np.array([len(s) - 199 for s in segs])
    seen = Counter(s[i:i + 200] for s in segs for i in range(len(s) - 199))
    for s, mark in zip(segs, repeats.repeated_starts(segs, n, np.ones(len(segs), dtype=np.int64))):
        assert mark.tolist() == [seen[s[i:i + 200]] > 1 for i in range(len(s) - 199)]


# ------------------------------------------------------------------ 2, 8

def labelled(spark, rows, label):
    return spark.createDataFrame([(d, v, "x") for d, v in rows], f"doc_id long, {label} int, text string")


def test_quality_learns_and_takes_any_input(spark):
    rows = [(i, prose(40) if i % 3 else " | ".join(random.choices(WORDS, k=30))) for i in range(300)]
    labels = labelled(spark, [(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (5, None), (9999, 0)], "quality")
    usable = quality.remainder(F.col("doc_id"), 4) != 2
    out = {r.doc_id: r.score for r in quality.classify_quality(frame(spark, rows), labels, usable).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(out[i] >= 0.7) == (i % 3 > 0) for i in held]) > 0.95
    scores = quality.classify_quality(frame(spark, ROWS), labels, usable).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
    assert quality.classify_quality(empty(spark), labels, usable).count() == 0
    flat = quality.classify_quality(frame(spark, ROWS), labels.limit(0), usable).collect()
    assert {r.score for r in flat} == {0.5}


def test_toxicity_learns_and_takes_any_input(spark):
    bad = ["vilething", "nastyword", "uglyslur"]
    rows = [(i, prose(30) + (" " + " and ".join(random.choices(bad, k=4)) + " " if i % 4 == 0 else " ") + prose(30)) for i in range(400)]
    labels = labelled(spark, [(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None), (9999, 0)], "toxic")
    usable = quality.remainder(F.col("doc_id"), 5) != 0
    out = {r.doc_id: r.score for r in toxicity.classify_toxicity(frame(spark, rows), labels, usable).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.9
    scores = toxicity.classify_toxicity(frame(spark, ROWS), labels, usable).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.classify_toxicity(empty(spark), labels, usable).count() == 0
    assert {r.score for r in toxicity.classify_toxicity(frame(spark, ROWS), labels.limit(0), usable).collect()} == {0.5}
    kept = toxicity.without_toxic(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and 280 <= kept.count() <= 320


def test_held_out_accuracy_on_the_given_labels(spark):
    truth = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    for query, label, least in ((quality.op2_quality, "quality", 0.97), (toxicity.op8_toxicity, "toxic", 0.91)):
        rows = [r for r in query(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in truth]
        assert np.mean([r.predicted == truth[r.doc_id][label] for r in rows]) > least


# ------------------------------------------------------------------ 3

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, point long, v string, rank int")


def test_neighbours_of_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:90] = x[50]  # equal vectors: ties go to the smaller id
    rows = [(i, [float(a) for a in v], 0, 1, "v", 2) for i, v in enumerate(x)]
    bad = [(1000, None, 0, 1, "v", 2), (1100, [0.0] * 8, 0, 1, "v", 2), (1200, [float("nan")] * 8, 0, 1, "v", 2),
           (1300, [None] + [1.0] * 7, 0, 1, "v", 2), (1400, [float("inf")] * 8, 0, 1, "v", 2), (None, [1.0] * 8, 0, 1, "v", 2)]
    out = neighbours.nearest(vectors(spark, rows + bad), lambda i: i % 50 == 0).collect()
    hits = total = 0
    for q in range(0, 400, 50):
        d = np.sqrt(np.square(x.astype(np.float64) - x[q].astype(np.float64)).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(400), d))[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in mine)
        assert [v for _, v, _ in mine] == [v for _, v in sorted((s, v) for _, v, s in mine)]
        hits, total = hits + len({v for _, v, _ in mine} & set(best.tolist())), total + 10
        if q == 50:
            assert [v for _, v, _ in mine] == list(range(51, 61))
    assert hits >= 0.9 * total and {r.query_id for r in out} == set(range(0, 400, 50))
    assert neighbours.nearest(vectors(spark, bad), lambda i: i % 50 == 0).count() == 0
    few = neighbours.nearest(vectors(spark, rows[:4]), lambda i: i == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]


def test_neighbours_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    out = defaultdict(set)
    for r in neighbours.op3_neighbours(spark, "/root/testdata/sf0.1").collect():
        out[r.query_id].add(r.vec_id)
    hits = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(np.square(x - x[i]).sum(1))
        d[i] = np.inf
        hits.append(len(out[ids[i]] & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_hilbert_keys_walk_to_neighbouring_cells():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    walk = cells[np.argsort(neighbours.hilbert(cells, 3))]
    assert np.abs(np.diff(walk, axis=0)).sum(1).tolist() == [1] * 511


# ------------------------------------------------------------------ 4, 5

def test_licences_by_ordered_sentences(spark):
    mit = ". ".join(licenses.SENTENCES[k] for k in ("mit_grant", "mit_notice", "mit_warranty"))
    rows = [(1, "Text.\nReleased under the MIT License."), (2, mit.upper()), (3, ". ".join(reversed(mit.split(". ")))),
            (4, None), (5, ""), (6, "Licensed under the Apache License, Version 2.0.\nx\nLicensed under CC BY-NC 4.0."),
            (6, "MIT License"), (None, "Licensed under CC BY-NC 4.0.")]
    assert got(licenses.scan(frame(spark, rows)), "doc_id", "licences") == Counter(
        [(1, "MIT"), (2, "MIT"), (3, ""), (4, ""), (5, ""), (6, "Apache-2.0,CC-BY-NC-4.0"), (6, ""), (None, "CC-BY-NC-4.0")])
    assert licenses.scan(empty(spark)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""


@pytest.mark.parametrize("first, each, last", [("", "", ""), ("", "# ", ""), ("/*\n", " * ", " */"), ("", "// ", "\ncode();"), ("<!--\n", "  ", "-->"), ("prose before\n\n", "", "\n\nprose after")])
def test_wrapped_and_commented_licence_texts(spark, first, each, last):
    texts = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-2.0-or-later": GPL.format("", ";", 2), "GPL-3.0-or-later": GPL.format("", ",", 3),
             "LGPL-3.0-or-later": GPL.format("Lesser ", ",", 3), "AGPL-3.0-or-later": GPL.format("Affero ", ",", 3), "BSD-2-Clause": BSD.format(""),
             "BSD-3-Clause": BSD.format(ENDORSE), "ISC": ISC, "MPL-2.0": MPL, "Unlicense": UNLICENSE,
             "LGPL-2.1-or-later": GPL.format("Lesser ", ";", "2.1").replace("program", "library")}
    rows = [(i, first + "\n".join((each + x).rstrip() for x in t.split("\n")) + last) for i, t in enumerate(texts.values())]
    found = {r.doc_id: r.licences for r in licenses.scan(frame(spark, rows)).collect()}
    assert [found[i] for i in range(len(texts))] == list(texts)


def test_token_counts_equal_the_unigram_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    v = tokens.vocabulary(f"{tokens.TOKENIZERS}/{tokens.MODEL}")
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(v, 0, byte_fallback=True))
    t.normalizer = tokenizers.normalizers.Sequence([tokenizers.normalizers.Prepend("▁"), tokenizers.normalizers.Replace(" ", "▁")])
    odd = ["a", " ", "  \n  b", "▁▁ x", "日本語 🙂🙂 \t\r\n\n  hello   world ", "<0x0A> </s>", "a" * 5000, "é́ ñ ﬁ"]
    rows = ROWS + [(100 + i, x) for i, x in enumerate(odd)]
    exact = Counter((d, len(t.encode(x or "", add_special_tokens=False).ids) if x else 0) for d, x in rows)
    assert got(tokens.count_tokens(frame(spark, rows)), "doc_id", "n_tokens") == exact
    assert tokens.count_tokens(empty(spark)).count() == 0


def test_token_ties_and_unknown_runs_without_byte_pieces():
    tokenizers = pytest.importorskip("tokenizers")
    v = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -3.0)]
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(v, 0, byte_fallback=False))
    c = tokens.Counter(v)
    c._start()
    for x in ["▁abab", "▁baba", "▁axxb", "▁xyz", "xaxx", "ababa", "▁▁aab"]:
        assert c.word(x) == len(t.encode(x).ids), x


# ------------------------------------------------------------------ 6, components

def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(links, members):
    root = {m: m for m in members}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        root[find(a)] = find(b)
    return {m: find(m) for m in members}


def brute_near(rows, n):
    sets = [shingles(t, n) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = groups(links, range(len(rows)))
    low = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            low[r] = min(low.get(r, rows[i][0]), rows[i][0])
    out = Counter()
    for i, (d, _) in enumerate(rows):
        c = low.get(root[i]) if sets[i] else d
        out[d, len(sets[i]), c, d is not None and d == c] += 1
    return out


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    out = minhash.near_duplicates(frame(spark, ROWS), n)
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == brute_near(ROWS, n)
    assert minhash.near_duplicates(empty(spark), n).count() == 0


def test_signatures_of_short_rows_beside_a_very_long_one():
    rng = np.random.default_rng(1)
    for sizes in ([10] * 5 + [300_000], [0, 10, 0, 300_000, 10, 10], [10, 70_000, 10, 1_000_000, 0, 10]):
        counts = np.array(sizes)
        values = rng.integers(0, 1 << 63, counts.sum()).astype(np.uint64)
        at = np.concatenate(([0], np.cumsum(counts)))
        alone = [minhash.signatures(values[a:b], np.array([b - a]), 12) for a, b in zip(at[:-1], at[1:])]
        assert (minhash.signatures(values, counts, 12) == np.concatenate(alone)).all()


def test_a_group_of_near_copies_without_its_centre(spark):
    base = prose(100).split()
    rows = []
    for i in range(60):
        w = list(base)
        for p in random.sample(range(100), random.choice([1, 2, 3])):
            w[p] = f"edit{random.randrange(12)}"
        rows.append((i, " ".join(w)))
    out = minhash.near_duplicates(frame(spark, rows), 4)
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == brute_near(rows, 4)


def test_written_tables_leave_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, setting = blocks.getAllBlocks().size(), spark.conf.get(common._CLEANUP)
    out = common.written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().repartition(7, "count"), "test")
    for _ in range(50):  # files go in the background
        if blocks.getAllBlocks().size() <= before:
            break
        time.sleep(0.2)
    assert blocks.getAllBlocks().size() <= before
    assert out.count() == 10 and spark.conf.get(common._CLEANUP) == setting


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    out = {r.id: r.component for r in components.components(df).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components.components(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 7

def test_decontamination_finds_items_and_paraphrases(spark):
    items = [(i, prose(random.randint(16, 50))) for i in range(12)]
    paraphrase = items[3][1].split()
    for p in range(2, len(paraphrase) - 6, 6):
        paraphrase[p] = "other"
    rows = ROWS + [(200 + i, prose(100) + " " + t.upper() + " " + prose(70)) for i, t in items] + [(300, prose(50) + " " + " ".join(paraphrase))]
    rows += [(400 + i, prose(200)) for i in range(100)]
    bench = spark.createDataFrame([*items, (None, "x"), (50, None), (51, "")], "item_id long, text string")
    found = got(decontaminate.matches(frame(spark, rows), bench), "doc_id", "item_id")
    assert found == Counter([(200 + i, i) for i, _ in items] + [(300, 3)])
    kept = decontaminate.decontaminated(frame(spark, rows), bench)
    assert kept.count() == len(rows) - 13 and kept.columns == frame(spark, rows).columns
    assert decontaminate.matches(empty(spark), bench).count() == 0
    assert decontaminate.matches(frame(spark, rows), bench.limit(0)).count() == 0


def test_paraphrases_become_candidates_and_the_check_decides(spark):
    """Items of the given benchmark with words replaced, answer kept, inside other texts."""
    import pyarrow as pa
    from vigil.llm.common import utf8, words
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "benchmark"))
    idf = decontaminate.inverse_frequency(docs)
    items = sorted((r.item_id, r.text) for r in bench.collect())
    search = decontaminate.Retrieval(items, idf, decontaminate.latent_basis(docs, idf))
    plain = [r.text.split() for r in docs.filter("n_chars > 500 and lang = 'en'").orderBy("doc_id").limit(300).collect()]
    rng, pool = random.Random(5), [w for t in plain[:100] for w in t]
    for keep in (0.75, 0.7, 0.65, 0.6):
        texts = []
        for k, (_, t) in enumerate(items):
            w = t.split()
            for j in rng.sample(range(len(w) - 3), min(len(w) - 3, round(len(w) * (1 - keep)))):
                w[j] = rng.choice(pool)
            host = plain[100 + k % 200]
            cut = rng.randrange(len(host))
            texts.append(" ".join(host[:cut] + w + host[cut:]))
        h, counts = words(*utf8(pa.array(texts)))
        found = {d for d, _, i in search.candidates(h, counts) if d == i}
        assert len(found) >= 0.9 * len(items), keep


def test_basis_is_fitted_on_every_passage(spark):
    import pyarrow as pa
    from vigil.llm.common import utf8, words
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(150)]
    d = frame(spark, list(enumerate(texts)))
    basis = decontaminate.latent_basis(d, decontaminate.inverse_frequency(d))
    used = np.unique(decontaminate.buckets(words(*utf8(pa.array(texts)))[0]))
    assert (np.abs(basis[used]).max(axis=1) > 0).all()


def test_decontamination_equals_a_check_of_every_passage(spark):
    import pyarrow as pa
    from vigil.llm.common import utf8, words
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(250).collect()
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").limit(12)
    item_rows = [(r.item_id, r.text) for r in items.collect()]
    some = [(r.doc_id, r.text) for r in rows if len(r.text or "") < 5000]
    rng = random.Random(8)
    for k, (_, t) in enumerate(item_rows):  # exact and changed items inside other texts
        w = t.split()
        w[len(w) // 3] = rng.choice(WORDS)
        some.append((10_000 + k, prose(20) + " " + " ".join(w) + " " + prose(9)))
        some.append((20_000 + k, t))
    search = decontaminate.Retrieval(item_rows, np.ones(decontaminate.VOCABULARY, np.float32), np.zeros((decontaminate.VOCABULARY, 1), np.float32))
    want = set()
    for d, t in some:
        h, counts = words(*utf8(pa.array([t or ""])))
        for first in decontaminate.passages(counts)[1].tolist():
            for j, (i, _) in enumerate(item_rows):
                lcs, answer = search.check(h, first, j)
                size = len(search.words[j])
                if lcs >= decontaminate.COVER * size or (answer and lcs >= decontaminate.PARAPHRASE * size):
                    want.add((d, i))
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame(spark, some), items).collect()}
    assert found == want and len(want) >= 24


def test_toxicity_learns_in_a_task_and_only_the_model_comes_to_the_driver(spark, monkeypatch):
    chosen = random.Random(8)
    rows = [(i, " ".join(chosen.choices(WORDS, k=30) + ["vile"] * (i % 3 if i % 4 == 0 else 0))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    want = toxicity.Toxicity(sorted(((i, t, int(i % 4 == 0)) for i, t in rows), key=lambda r: (zlib.crc32(b"%d" % r[0]), r)))

    def refuse(*_):
        raise AssertionError("learnt on the driver")
    monkeypatch.setattr(toxicity.Toxicity, "__init__", refuse)
    got = toxicity.train(frame(spark, rows), labels, F.lit(True))
    some = [t for _, t in rows[:20]]
    assert (got.score(some) == want.score(some)).all()


def toxic_tables(spark, path, ordinary):
    """documents and labels, every fourth document toxic, with null and empty texts on both sides."""
    chosen = random.Random(3)
    toxic = lambda: " ".join(chosen.choices(WORDS, k=30) + chosen.choices(["vilething", "nastyword", "uglyslur"], k=4))
    rows = [(i, None if i % 25 == 1 else "" if i % 25 == 2 else toxic() if i % 4 == 0 else ordinary(chosen)) for i in range(300)]
    rows += [(None, None), (None, ""), (300, " "), (301, None), (302, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, rows


def test_toxicity_stage_learns_from_and_keeps_null_and_empty_texts(spark, tmp_path):
    docs, rows = toxic_tables(spark, tmp_path, lambda chosen: " ".join(chosen.choices(WORDS, k=60)))
    out = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))
    kept = got(out, "doc_id", "text")
    assert out.columns == docs.columns and kept <= Counter(rows)
    assert all(kept[d, t] == 1 for d, t in rows if not (t or "").strip())
    assert sum(d % 4 == 0 for d, t in kept if t and t.strip()) < 10 < 200 < sum(d % 4 > 0 for d, t in kept if t)


def test_op8_scores_null_and_empty_texts_and_learns_from_texts_that_are_alike(spark, tmp_path):
    _, rows = toxic_tables(spark, tmp_path, lambda chosen: "hello world again")  # a trained dictionary of under 300 bytes
    out = toxicity.op8_toxicity(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows)
    text = dict(rows[:300])
    assert len({r.score for r in out if not text.get(r.doc_id)}) == 1
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in out if text.get(r.doc_id))


# ------------------------------------------------------------------ 9

def brute_lines(rows):
    sets, places = {}, []
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            norm = line.strip(" \t\r\x0b\x0c").lower()
            if norm:
                sets[norm] = {norm[j:j + 5] for j in range(max(1, len(norm) - 4))}
                places.append((d is not None, d or 0, i, d, norm))
    keys = sorted(sets)
    links = [(a, b) for a in keys for b in keys if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = groups(links, keys)
    seen, out = set(), defaultdict(list)
    for _, _, i, d, norm in sorted(places, key=lambda p: p[:3]):
        if root[norm] in seen:
            out[d].append(i)
        seen.add(root[norm])
    return dict(out)


def test_line_dedup_equals_brute_force(spark):
    long = prose(40)
    changed = long.replace(long.split()[20], "zzz", 1)
    rows = [(1, f"{prose(9)}\n{long}\n\n{prose(8)}"), (2, f"{changed}\n  {long.upper()}\t\nend"), (3, "end\nEND \n" + prose(5)),
            (4, None), (5, ""), (None, f"end\n{prose(6)}"), (6, "é ü\né  ü\n" + prose(2000)), (7, "\n\n")]
    # lines that word starts alone would judge otherwise: one word changed of 19, two URLs with one opening
    nineteen = random.choices(WORDS, k=19)
    rows += [(20, " ".join(nineteen) + "\nhttps://example.com/some/path/first"),
             (21, " ".join(nineteen[:9] + ["qqqqqq"] + nineteen[10:]) + "\nhttps://example.com/some/other-page")]
    out = {d: list(r) for d, r in lines.removed_lines(frame(spark, rows)).join(
        lines.document_lines(frame(spark, rows)).select("doc", "doc_id").distinct(), "doc").select("doc_id", "removed").collect()}
    assert out == brute_lines(rows)
    kept = lines.dedup_lines(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows)
    for r in kept.collect():
        text = dict(rows)[r.doc_id]
        left = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out.get(r.doc_id, []))
        assert r.text == left and r.n_chars == len(left or "")
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_beside_columns_of_its_own_names(spark):
    df = frame(spark, [(1, "one line\ntwo"), (2, "one line\nthree")]).withColumns(
        {c: F.lit(7) for c in ("removed", "doc", "pos", "norm", "bucket", "vertex", "_key", "_doc")})
    out = lines.dedup_lines(df)
    assert out.columns == df.columns and {(r.doc_id, r.text, r.removed) for r in out.collect()} == {(1, "one line\ntwo", 7), (2, "three", 7)}


def test_lines_in_pieces_have_the_same_sets(spark, monkeypatch):
    some = ["abcd", "abcde", "é", "xé" * 90, prose(60), "a" * 200, prose(30), "ab", prose(5)]
    df = spark.createDataFrame(list(enumerate(some)), "id long, norm string")

    def made(of):
        return [{tuple(r)[:2]: r for r in x.collect()} for x in (lines.signatures(of, 24, 6), lines._described(of))]
    whole = made(df)
    alone = [made(df.filter(F.col("id") == i)) for i in (1, 4)]
    assert all(whole[k][key] == r for one in alone for k in (0, 1) for key, r in one[k].items())
    monkeypatch.setattr(lines, "PIECE", 64)
    assert made(df) == whole
    sizes = dict(sorted(whole[1]))
    assert [sizes[i] for i in range(len(some))] == [len({x[j:j + 5] for j in range(max(1, len(x) - 4))}) for x in some]


def test_line_dedup_runs_no_python_on_executors(spark, monkeypatch):
    plans = []

    def seen(df, name, write=common.written):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, name)
    for module in (lines, components, common):
        monkeypatch.setattr(module, "written", seen)
    line = prose(30)
    out = lines.removed_lines(frame(spark, [(1, line), (2, line + " zz"), (3, line)]))
    assert sorted(list(r.removed) for r in out.collect()) == [[0], [0]]
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) > 6 and not any(x in plan for plan in plans for x in ("Python", "Pandas", "InArrow"))


def gone_lines(spark, rows):
    out = lines.removed_lines(frame(spark, rows)).join(lines.document_lines(frame(spark, rows)).select("doc", "doc_id").distinct(), "doc")
    return {d: list(r) for d, r in out.select("doc_id", "removed").collect()}


def test_lines_without_blanks_are_judged_by_all_their_characters(spark):
    han = [chr(0x4E00 + random.randrange(5000)) for _ in range(80)]
    opening, url = "".join(han[:20]), "https://example.com/"
    keys = ["key: " + hashlib.sha256(bytes([i])).hexdigest() for i in range(4)]
    rows = [(1, "\n".join([opening + "".join(han[20:50]), opening + "".join(han[50:80]), url + "a", url + "other/page", *keys])),
            (2, keys[2].upper() + "\n" + keys[3][:-1] + "g\n" + url + "a"), (3, "ab\nac\nab\n🙂🙂\n🙂🙃")]
    assert gone_lines(spark, rows) == {2: [0, 1, 2], 3: [2]}


def test_lines_with_one_word_changed_are_found(spark):
    rows, due = [], set()
    for i in range(120):
        w = random.choices(WORDS, k=10 + i // 4)
        line = " ".join(w)
        w[random.randrange(len(w))] = random.choice(WORDS)
        other = " ".join(w)
        a, b = ({x[j:j + 5] for j in range(max(1, len(x) - 4))} for x in (line, other))
        if 100 * len(a & b) >= 80 * len(a | b):
            due.add(1000 + i)
        rows += [(i, line), (1000 + i, other)]
    assert len(due) > 80 and set(gone_lines(spark, rows)) == due


# ------------------------------------------------------------------ 10

def test_mixing_meets_its_targets(spark):
    out = mixing.mix(frame(spark, ROWS)).collect()
    assert len(out) == len(ROWS)
    words = {}
    for r in out:
        words.setdefault(r.source, [0, 0, r.target, r.source_size])
        words[r.source][0] += r.size
        words[r.source][1] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert all(w[0] == w[3] and w[1] == round(w[2]) and w[2] <= 2 * w[3] for w in words.values())
    assert sum(w[1] for w in words.values()) == pytest.approx(1.5 * sum(w[0] for w in words.values()), abs=4)
    again = mixing.mix(frame(spark, ROWS).repartition(7)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.mix(empty(spark)).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_the_sample_is_what_the_mix_plans(spark):
    df = frame(spark, ROWS)  # has columns named size and target of its own
    plan, rows = mixing.mix(df).collect(), mixing.sample(df).collect()
    taken, texts = Counter(), defaultdict(set)
    for d, t in ROWS:
        texts[d].add(t)
    for r in rows:
        taken[r.doc_id, r.size] += r.taken
        assert len(WORD.findall(r.text)) == r.taken > 0 and r.n_chars == len(r.text)
        whole = [t for t in texts[r.doc_id] if t and len(WORD.findall(t)) == r.size]
        assert r.text in whole if r.taken == r.size else any(WORD.findall(t)[:r.taken] == r.text.split(" ") for t in whole)
        assert r.key == "k" and r.score == 5.0 and r.copy in (1, 2, 3)
    want = Counter()
    for r in plan:
        want[r.doc_id, r.size] += r.taken
    assert taken == +want and sum(r.taken < r.size for r in rows) <= 4
    assert got(mixing.sample(df.repartition(5)), "doc_id", "text", "taken") == got(mixing.sample(df), "doc_id", "text", "taken")
    assert mixing.sample(empty(spark)).count() == 0


def test_water_filling_equals_iteration(spark):
    sizes = {"a": 5, "b": 700, "c": 40, "d": 0, "e": 90, None: 300}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    out = {r.source: r.target for r in mixing.source_targets(df).collect()}
    order = sorted((k for k in sizes if k), key=str) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:  # clamp, redistribute the rest by weight, repeat
        free = [k for k in order if k not in fixed]
        rest = total - sum(fixed.values())
        share = {k: rest * weight[k] / sum(weight[j] for j in free) for k in free}
        over = [k for k in free if share[k] > 2 * sizes[k]]
        if not over:
            break
        fixed |= {k: 2 * sizes[k] for k in over}
    assert out == pytest.approx(fixed | share)


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs, counts = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SMALL), f"test-{name}")
        if name != "mixing":
            assert out.columns == columns
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            kept = {d for (d, n, _, k), m in brute_near(rows, 5).items() if k or n == 0}
            assert {r.doc_id for r in out.collect()} == kept
        counts.append(out.count())
        docs = out
    assert counts[0] < 200 and counts[1] == counts[0] and counts[3] < counts[2]
    rows = docs.collect()
    assert docs.columns[:len(columns)] == columns and all(len(WORD.findall(r.text)) == r.taken for r in rows)
    by_source = {r.source: r for r in rows}
    for s, r in by_source.items():
        assert sum(x.taken for x in rows if x.source == s) == pytest.approx(r.target, abs=1)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.source_size for r in by_source.values()), abs=20)


def test_near_dedup_stage_keeps_one_row_of_each_group(spark):
    a, b, c, e = prose(60), prose(60), prose(60), prose(60)
    rows = [(None, a), (None, b), (None, ""), (None, None), (None, "w"), (5, b), (6, b + " end"),  # b of the null id is linked
            (1, c), (2, c), (2, e), (7, e + " end"),  # doc_id 2: a copy of 1, and a keeper
            (8, prose(30)), (None, e + " last")]
    rows += [(9, prose(40))] * 2 + [(None, "two words")] * 2 + [(3, ""), (3, "")]
    out = corpus_pipeline.dedup_documents(spark, frame(spark, rows), SMALL)
    assert out.columns == frame(spark, rows).columns
    assert got(out, "doc_id", "text") == Counter([(None, a), (None, ""), (None, None), (None, "w"), (5, b), (1, c), (2, e),
                                                  rows[11], rows[13], (None, "two words"), (3, ""), (3, "")])
    assert corpus_pipeline.dedup_documents(spark, empty(spark), SMALL).count() == 0
