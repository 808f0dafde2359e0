import random

import numpy as np
import pytest

from strandex.llm import neardup


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = bytes((t or "").encode()).lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(make_docs, corpus, k):
    got = sorted(tuple(r) for r in neardup.near_duplicates(make_docs(corpus), k=k).collect())
    assert got == brute(corpus, k, 80)


def test_repeated_rows_null_ids_and_empty_tables(make_docs):
    docs = make_docs([(3, "a b c"), (3, "a b c"), (2, "A B c"), (None, "a b c"), (9, None), (9, None)])
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(docs, k=2).collect())
    assert got == [("2", "2", True), ("3", "2", False), ("3", "2", False), ("9", "9", True), ("9", "9", True), ("None", "None", True)]
    assert neardup.near_duplicates(make_docs([]), k=2).collect() == []


def test_chain_of_links_is_one_component(make_docs):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 60])) for i in range(30)]  # neighbours are similar, ends are not
    assert sorted(tuple(r) for r in neardup.near_duplicates(make_docs(rows), k=2).collect()) == brute(rows, 2, 80)
    links = make_docs([(0, "x")]).sparkSession.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in neardup.connected_components(links).collect()} == {0}


def test_long_shuffled_chain_settles(make_docs):
    order = list(range(1000))
    random.Random(3).shuffle(order)
    links = make_docs([(0, "x")]).sparkSession.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    found = neardup.connected_components(links).collect()
    assert len(found) == 1000 and {r.component for r in found} == {0}


def test_words_that_defeat_polynomial_hashes(make_docs):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    docs = make_docs([(1, thue), (2, thue.translate(str.maketrans("ab", "ba"))), (3, " ".join(thue)), (4, " ".join(thue.translate(str.maketrans("ab", "ba"))))])
    assert [tuple(r)[2:] for r in neardup.near_duplicates(docs, k=1024).orderBy("doc_id").collect()] == [(1, True), (2, True), (3, True), (4, True)]


def test_cells_and_units_lose_no_link(make_docs, monkeypatch):
    rnd = random.Random(11)
    words = [f"v{i}" for i in range(500)]
    base = [rnd.choice(words) for _ in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(80)] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "CELL", 1500)
    assert sorted(tuple(r) for r in neardup.near_duplicates(make_docs(rows), k=5).collect()) == brute(rows, 5, 80)


def test_one_row_of_each_group_stays(make_docs):
    text = "one two three four five six seven eight nine ten"
    docs = make_docs([(5, text), (5, text), (7, text), (5, "another text with its own words that nothing else here has"), (None, text), (None, "only here without any id at all now"), (None, "only here without any id at all now"), (8, None), (8, None)])
    got = neardup.without_copies(docs, k=5)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)[:7]) for r in got.collect()) == [("5", "another"), ("5", "one two"), ("8", "None"), ("8", "None"), ("None", "only he")]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[400:2400]
    both = neardup.merge(neardup.sketch(a), neardup.sketch(b))
    assert (both == neardup.sketch(pool[:2400])).all()
    best, short = neardup.likely_similarity(neardup.sketch(a)[None], neardup.sketch(b)[None], np.array([2000.0]), np.array([2000.0]), 0.8)
    assert abs(best[0] - 1600 / 2400) < 0.12 and short[0] < 12.5
    far = neardup.likely_similarity(neardup.sketch(a)[None], neardup.sketch(pool[1900:])[None], np.array([2000.0]), np.array([1100.0]), 0.8)
    assert np.isinf(far[1][0])


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9, 0.95])
def test_recall_of_the_bands(similarity):
    """Pairs of that similarity share a band, and likelihood does not reject them."""
    rng = np.random.default_rng(int(100 * similarity))
    pairs, size = 150, 400
    same = round(2 * size * similarity / (1 + similarity))
    found = 0
    for _ in range(pairs):
        pool = rng.integers(0, 2**64, 2 * size, dtype=np.uint64)
        x, y = neardup.sketch(pool[:size]), neardup.sketch(np.concatenate([pool[:same], pool[size : 2 * size - same]]))
        shares = (neardup.band_keys(np.stack([x, y]))[0] == neardup.band_keys(np.stack([x, y]))[1]).any()
        n = np.array([size])
        found += bool(shares and neardup.plausible(np.array([(x > y).sum()]), np.array([(x < y).sum()]), n, n, 0.8)[0])
    assert found >= 0.99 * pairs
