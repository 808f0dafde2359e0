import random

import numpy as np
import pytest

from strandex.llm import overlap


def expected(rows, k, percent):
    """(doc_id, set size, smallest doc_id reachable), by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return sorted((i, len(s), least[i]) for i, s in sets.items())


def got(docs, **how):
    return sorted(tuple(r) for r in overlap.jaccard_components(docs, **how).collect())


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (2, 80), (1, 60), (3, 100)])
def test_against_brute_force(make_docs, corpus, k, percent):
    assert got(make_docs(corpus), k=k, percent=percent) == expected(corpus, k, percent)


def near_copies(seed, groups, members, length, edits):
    rnd = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(length // 2)]
    rows = []
    for _ in range(groups):
        base = passage + [rnd.choice(words) for _ in range(length // 2)]
        for _ in range(members):
            w = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                w[rnd.randrange(length)] = rnd.choice(words)
            rows.append((len(rows), " ".join(w[: length - rnd.randrange(3)])))
    return rows


@pytest.mark.parametrize("cell", [300, 1 << 18])
@pytest.mark.parametrize("buckets_used", [True, False])
def test_crowds_around_one_passage(make_docs, monkeypatch, cell, buckets_used):
    monkeypatch.setattr(overlap, "CELL", cell)
    if not buckets_used:  # the order of lists is free: results do not depend on it
        monkeypatch.setattr(overlap, "list_lengths", lambda texts, k: np.zeros(1 << 12, np.uint8))
    rows = near_copies(3, 12, 12, 60, 4)
    want = expected(rows, 3, 90)
    assert 20 < len({r[2] for r in want}) < 140
    assert got(make_docs(rows)) == want


def test_repeated_rows_null_ids_and_empty_tables(make_docs):
    rows = [(3, "a b c d"), (3, "a b c d"), (2, "A B c d"), (None, "a b c d"), (9, None), (9, None), (4, "x"), (5, "X"), (6, "x x"), (3, "other words stand here")]
    have = sorted(map(str, overlap.jaccard_components(make_docs(rows)).select("doc_id", "n_shingles", "component_id").collect()))
    row = lambda i, n, c: f"Row(doc_id={i}, n_shingles={n}, component_id={c})"
    assert have == sorted([row(3, 2, 2), row(3, 2, 2), row(2, 2, 2), row(None, 2, None), row(9, 0, 9), row(9, 0, 9), row(4, 1, 4), row(5, 1, 4), row(6, 1, 6), row(3, 2, 3)])
    assert overlap.jaccard_components(make_docs([])).collect() == []


def test_a_dotted_column_name(spark, make_docs):
    docs = make_docs([(1, "a b c d"), (2, "a b c d")]).withColumnRenamed("source", "a.b").withColumnRenamed("spans", "token")
    assert got(docs) == [(1, 2, 1), (2, 2, 1)]


def test_heap_merge_counts_and_skips():
    rnd = random.Random(1)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(40), rnd.randint(0, 12))) for _ in range(rnd.randint(1, 9))]
        need = rnd.randint(1, 6)
        want = [(x, n) for x in range(40) if (n := sum(x in one for one in lists)) >= need]
        assert overlap.heap_merge(lists, need) == want


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_search_in_inverted_lists(percent):
    rnd = np.random.default_rng(2)
    base = np.sort(rnd.choice(10_000, 60, replace=False)).astype(np.uint64)
    sets = []
    for _ in range(120):
        keep = base[rnd.random(60) > rnd.choice([0.0, 0.02, 0.1, 0.5])]
        sets.append(np.union1d(keep, rnd.choice(10_000, int(rnd.integers(1, 12))).astype(np.uint64)))
    index = overlap.InvertedLists(sets)
    wanted = rnd.random(len(sets)) < 0.8
    for query in sets:
        hits = [i for i, s in enumerate(sets) if wanted[i] and 100 * len(np.intersect1d(s, query)) >= percent * len(np.union1d(s, query))]
        assert sorted(index.search(query, percent, wanted).tolist()) == hits


def test_bitmap_of_hashes(spark):
    hashes = [0, -1, 2**63 - 1, -(2**63), 12345678901234567]
    marks = overlap.marked(spark.createDataFrame([(h,) for h in hashes * 2], "hash long"))
    place = overlap._top(np.array(hashes).view(np.uint64), overlap.MARKS)
    assert all(int(marks[p >> 6]) >> int(p & 63) & 1 for p in place) and np.bitwise_count(marks).sum() == len(set(place.tolist()))
