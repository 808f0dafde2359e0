import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandex.llm import fingerprint, licenses, topk


def test_rolling_entropy_against_counts():
    data = np.frombuffer(random.Random(1).randbytes(300) + b"a" * 100 + b"the end of it " * 9, np.uint8)
    got = fingerprint.entropy_classes(data, 64)
    for i in range(0, len(got), 7):
        share = np.bincount(data[i : i + 64]) / 64
        bits = -sum(p * math.log2(p) for p in share if p)
        assert abs(got[i] - bits / 6 * 1000) <= 1.01
    assert len(fingerprint.entropy_classes(data[:15])) == 0
    small = fingerprint.entropy_classes(data)
    for i in range(0, len(small), 5):
        share = np.bincount(data[i : i + 16]) / 16
        assert abs(small[i] - -sum(p * math.log2(p) for p in share if p) / 4 * 1000) <= 1.01


def brute_features(text: bytes, ranks: np.ndarray) -> list[bytes]:
    """The rule as stated, window by window."""
    classes = fingerprint.entropy_classes(np.frombuffer(text, np.uint8))
    points = {}
    for i in range(len(classes) - fingerprint.RUN + 1):
        best = min(range(i, i + fingerprint.RUN), key=lambda j: (ranks[classes[j]], j))
        points[best] = points.get(best, 0) + 1
    starts = [(j, j + fingerprint.WINDOW) for j, p in points.items() if p >= fingerprint.POINTS and ranks[classes[j]] < fingerprint.CLASSES - fingerprint.WEAK]
    least, covered = fingerprint.STRETCH if starts else 1, {x for a, b in starts for x in range(a, b)}
    i = 0
    while i < len(text):
        j = i
        while j < len(text) and j not in covered:
            j += 1
        if j - i >= least:
            starts += [(x, min(x + 6, j)) for x in range(i, max(i + 1, j - 5))]
        i = max(j, i) + 1
    found = [text[a:b] for a, b in sorted(starts)]
    return list(dict.fromkeys(found))


def test_chains_against_brute_force():
    rnd = random.Random(8)
    texts = ["", "x", "abcde", "the end of it", "a" * 700, "ab" * 40]
    texts += [" ".join("".join(rnd.choice("etaoinshré") for _ in range(rnd.randint(2, 8))) for _ in range(n)) for n in (3, 10, 40, 90, 200, 900)]
    parts = [t.encode() for t in texts]
    ranks = fingerprint.rarity_ranks(np.random.default_rng(1).permutation(fingerprint.CLASSES))
    for part, chain in zip(parts, fingerprint.digests(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), ranks)):
        features = brute_features(part, ranks)
        data = np.frombuffer(b"".join(features), np.uint8)
        ends = np.cumsum([0, *map(len, features)])
        hashes = fingerprint.B.run_hashes(data, ends[:-1], ends[1:])
        bits = np.zeros((-(-len(features) // 160), 2048), bool)
        for i, h in enumerate(hashes.tolist()):
            for turn in range(5):
                bits[i // 160, (h >> 11 * turn) & 2047] = True
        assert bool(len(chain)) == bool(part) and (np.packbits(bits, axis=1) == chain).all()


def test_fingerprints_of_all_rows(make_docs, corpus):
    rows = [*corpus, (2, corpus[2][1]), (None, "no id at all")]
    got = fingerprint.fingerprint_documents(make_docs(rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[n - 1][1] or ""
        k = len(t) // 3
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for i, t in rows:
        prints = {r.fingerprint for r in got if r.doc_id == i}
        by_text.setdefault(t or "", set()).update(prints)
    assert all(len(p) == 1 for t, p in by_text.items() if sum((x[1] or "") == t for x in rows) > 1 and t)
    assert fingerprint.fingerprint_documents(make_docs([])).collect() == []
    (alone,) = fingerprint.fingerprint_documents(make_docs([(5, "just one text")])).collect()
    assert alone.near_next == 1.0


def test_edits_are_nearer_than_strangers():
    rnd = random.Random(9)
    text = lambda n: " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    a, b = text(2000), text(2000)
    edited = a[: len(a) * 2 // 3] + b[: len(a) // 3]
    parts = [x.encode() for x in (a, b, edited)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ranks = fingerprint.rarity_ranks(np.arange(fingerprint.CLASSES))
    x, y, z = fingerprint.digests(data, np.cumsum([0, *map(len, parts)]), ranks)
    assert fingerprint.likeness(x, x) == 1 and fingerprint.likeness(x, z) > 0.4 > 0.1 > fingerprint.likeness(x, y)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, v string").repartition(3)


@pytest.mark.parametrize("k,block_rows,query_rows", [(10, 8192, 1024), (3, 40, 3)])
def test_top_k_against_brute_force(spark, k, block_rows, query_rows):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(0, 0.3, (230, 5)), 1).astype(np.float32)  # many ties
    rows = [(i, [float(x) for x in v], 1, "a", "b") for i, v in enumerate(values)]
    rows += [(900, None, 1, "", ""), (1000, [1.0, None, 0.0, 0.0, 0.0], 1, "", ""), (1100, [float("nan")] * 5, 1, "", ""), (1200, [float("inf")] * 5, 1, "", ""), (None, [0.1] * 5, 1, "", "")]
    got = sorted(tuple(r) for r in topk.top_k(_vectors(spark, rows), F.col("id") % 100 == 0, k=k, block_rows=block_rows, query_rows=query_rows).collect())
    whole = np.floor(values.astype(float) * 1024).astype(int)
    want = []
    for q in range(0, 230, 100):
        best = sorted(((-int(whole[q] @ whole[c]), c) for c in range(230) if c != q))[:k]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == want


def test_repeated_ids_large_components_and_lengths(spark):
    rows = [(100, [70000.0, -3.0]), (1, [70000.0, 1.0]), (1, [70001.0, 1.0]), (2, [-5e6, 0.5]), (3, [1.0]), (100, [70000.5, -3.0]), (200, [0.0, 0.0]), (1, [70000.0, 1.0])]
    table = _vectors(spark, [(i, [float(x) for x in v], 1, "", "") for i, v in rows])
    floor = lambda v: [math.floor(1024 * x) for x in np.array(v, np.float32).astype(float)]
    want = []
    for at in (0, 5, 6):
        q, v = rows[at]
        scores = sorted((-sum(a * b for a, b in zip(floor(v), floor(c))), i) for n, (i, c) in enumerate(rows) if n != at and len(c) == len(v))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:3])]
    assert sorted(tuple(r) for r in topk.top_k(table, F.col("id") % 100 == 0, k=3, block_rows=2).collect()) == sorted(want)


def test_each_row_of_a_query_id_asks_for_all_other_rows(spark):
    table = _vectors(spark, [(100, [1.0, 0.0], 1, "", ""), (100, [1.0, 0.0], 1, "", ""), (1, [0.5, 0.5], 1, "", "")])
    got = sorted(tuple(r) for r in topk.top_k(table, F.col("id") % 100 == 0).collect())
    assert got == [(100, 1, 100, 1 << 20), (100, 1, 100, 1 << 20), (100, 2, 1, 1 << 19), (100, 2, 1, 1 << 19)]


def test_few_or_no_candidates(spark):
    none = topk.top_k(_vectors(spark, []), F.col("id") % 100 == 0)
    assert none.collect() == []
    one = topk.top_k(_vectors(spark, [(0, [0.0, 0.0], 1, "", ""), (5, [1.0, -1.0], 1, "", "")]), F.col("id") % 100 == 0)
    assert [tuple(r) for r in one.collect()] == [(0, 1, 5, 0)]


def test_licences_are_found_and_talk_is_not(make_docs):
    filler = "the quick fox ran over the hill and the dog slept\n" * 3
    rows = [
        (1, filler + "Licensed under the Apache License, Version 2.0.\n" + filler),
        (2, filler + "You need a license to drive in this town.\nAll of the rights were reserved for later."),
        (3, "released under the mit license\nLICENSED UNDER CC BY-NC 4.0"),
        (4, None), (5, ""), (None, "Released under the MIT License."), (6, filler), (6, filler),
    ]
    model = licenses.train_licences(make_docs(rows))
    got = {(r.doc_id, r.n_licences, tuple(r.licences)) for r in licenses.scan_documents(make_docs(rows), model).collect()}
    assert got == {(1, 1, ("Apache-2.0",)), (2, 0, ()), (3, 2, ("CC-BY-NC", "MIT")), (4, 0, ()), (5, 0, ()), (None, 1, ("MIT",)), (6, 0, ())}
    assert licenses.scan_documents(make_docs(rows), model).count() == len(rows)
    assert licenses.scan_documents(make_docs([]), model).collect() == []


def test_licences_that_are_frequent_in_the_corpus_are_found(make_docs):
    filler = "the quick fox ran over the hill and the dog slept\n" * 3
    frequent = {
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.",
        "Unlicense": "This is free and unencumbered software released into the public domain.",
        "CC0": "Released under CC0 1.0 Universal, public domain dedication.",
        "Proprietary": "All rights reserved. No part of this publication may be reproduced without prior written permission.",
    }
    each = list(frequent.items())
    rows = [(i, filler + each[i % len(each)][1] + "\n" + filler) for i in range(60)] + [(60, filler)]
    docs = make_docs(rows)
    got = {r.doc_id: tuple(r.licences) for r in licenses.scan_documents(docs, licenses.train_licences(docs)).collect()}
    assert got == {**{i: (each[i % len(each)][0],) for i in range(60)}, 60: ()}


def test_repetitive_texts_have_features():
    rnd = random.Random(4)
    normal = " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(300))
    ranks = fingerprint.rarity_ranks(np.arange(fingerprint.CLASSES))
    repeated = [("abcdefghijklmno"[:p] * 800)[:800] for p in range(1, 16)] + ["=" * 800, "0 " * 400, "ha " * 300, "the " * 200]
    for text in repeated:
        edited = text[: len(text) * 2 // 3] + normal[: len(text) // 3]
        parts = [x.encode() for x in (text, edited, normal, "")]
        x, y, z, none = fingerprint.digests(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), ranks)
        assert len(x) and fingerprint.likeness(x, x) == 1
        assert fingerprint.likeness(x, y) > 0.4 > fingerprint.likeness(x, z) and fingerprint.likeness(x, none) == 0


def test_a_text_is_like_its_beginning_at_any_length():
    rnd = random.Random(12)
    text = " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(200))
    ranks = fingerprint.rarity_ranks(np.arange(fingerprint.CLASSES))
    for long, short in ((600, 405), (520, 500), (512, 511), (300, 200), (900, 610)):
        parts = [text[:long].encode(), text[:short].encode()]
        x, y = fingerprint.digests(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), ranks)
        assert fingerprint.likeness(x, y) > 0.8
