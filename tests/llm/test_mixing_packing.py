import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandex.llm import mixing, packing


@pytest.fixture(scope="module")
def sourced(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target double").repartition(3)

    return make


def _rows():
    rows = [(i, "w " * (i % 37), ["b", "a", None, "é", "Z"][min(i % 9, 4)], 0, 0.0) for i in range(300)]
    return rows + [(500, None, "b", 0, 0.0), (501, "", None, 0, 0.0), (502, "x " * 3000, "tiny", 0, 0.0), (None, "q " * 5, "b", 0, 0.0), (7, "w " * 7, "b", 0, 0.0)]


def _targets(sizes):
    """The rule as stated: share by weight, stop at twice the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        free -= over
        left -= sum(target[s] for s in over)
    return target


def test_plan_against_the_rule(sourced):
    rows = _rows()
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    want = _targets(sizes)
    plan = mixing.schedule(sourced(rows)).collect()
    assert len(plan) == len(rows)
    taken = defaultdict(int)
    for r in plan:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert sum(s.size for s in r.rounds) == 2 * r.size
    for r in mixing.mix_order(mixing.schedule(sourced(rows))).collect():
        taken[r.source] += r.taken
    per = mixing.taken_words(sourced(rows)).collect()
    assert len(per) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in per) and sum(r.taken for r in per) == sum(taken.values())
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = {(r.row, r.doc_id): [tuple(x) for x in r.rounds] for r in mixing.schedule(sourced(rows)).collect()}
    assert sorted(map(str, again.values())) == sorted(str([tuple(x) for x in r.rounds]) for r in plan)


def test_mix_is_sorted_by_finish_time_and_cuts_the_last(sourced):
    rows = _rows()
    plan = mixing.schedule(sourced(rows))
    order = sorted(mixing.mix_order(plan).collect(), key=lambda r: r.position)
    finish = [r.finish for r in order]
    assert finish == sorted(finish) and finish[-1] <= 1 and [r.position for r in order] == list(range(1, len(order) + 1))
    targets = {r.source: r.target for r in plan.collect()}
    assert sum(r.taken for r in order) == sum(int(t) for t in targets.values())
    mixed = mixing.mix_documents(sourced(rows))
    assert mixed.columns == sourced(rows).columns
    want = sum(r.taken for r in order)
    assert sum(len(r.text.split()) for r in mixed.collect()) == want
    assert mixing.mix_documents(sourced([])).collect() == []


def test_equal_ids_and_sizes_keep_their_own_services(spark):
    rows = [(1, " ".join(["a"] * 100), "A", "keepme", 7), (1, " ".join(["b"] * 100), "B", "keepme", 8), (1, " ".join(["b"] * 100), "B", "keepme", 8)]
    rows += [(i, " ".join(["b"] * 90), "B", "keepme", 9) for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, row long").repartition(2)
    words = defaultdict(int)
    for r in mixing.mix_documents(docs).collect():
        assert r._id == "keepme" and set(r.text.split()) == {r.source.lower()} and r.row == {"A": 7}.get(r.source, 8 if r.doc_id == 1 else 9)
        words[r.source] += len(r.text.split())
    assert words == {"A": 200, "B": 1600}


def test_ids_that_many_rows_share_are_cut_into_slices(spark, monkeypatch):
    from strandex.llm import _prefix

    rows = [(None, "w " * (1 + i % 5), "s", i) for i in range(400)] + [(i, "w w", "s", i) for i in range(50)]
    cut = _prefix.sliced
    monkeypatch.setattr(mixing, "sliced", lambda *a: cut(*a, heavy=20, per_slice=50))
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string, n long")).collect()
    starts = sorted((min(s.start for s in r.rounds) * r.target, r.size) for r in got)
    assert len(got) == 450 and all(a + n == pytest.approx(b) for (a, n), (b, _) in zip(starts, starts[1:]))


def test_bounds_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = int(rng.integers(1, 9))
        lengths, counts = np.sort(rng.choice(np.arange(1, 40), n, replace=False)), rng.integers(1, 9, n)
        for k in (1, 2, 3, 20):
            cost = lambda b: sum(int(c) * (min(x for x in b if x >= length) - int(length)) for length, c in zip(lengths, counts))  # noqa: B023, E731
            best = min(cost((*b, int(lengths[-1]))) for r in range(min(k, n)) for b in itertools.combinations(map(int, lengths[:-1]), r))
            got = packing.optimal_bounds(lengths, counts, k)
            assert cost(got) == best and len(got) <= k


def test_pieces_cover_documents_and_batches_fit(sourced):
    rows = _rows()
    got = packing.pack_documents(sourced(rows), context=128, buckets=5, batch_tokens=512).collect()
    total = Counter()
    for r in got:
        assert r.n_tokens <= r.bucket <= 128
        total[r.doc_id] += r.n_tokens
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len((t or "").split())
    assert total == +want
    slots = Counter((r.bucket, r.batch) for r in got)
    assert all(n * b <= 512 for (b, _), n in slots.items()) and len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)
    for b in {r.bucket for r in got}:  # only a bucket's last batch is not full
        assert sum(n < 512 // b for (x, _), n in slots.items() if x == b) <= 1
    assert packing.pack_documents(sourced([])).collect() == []
    one = [r for r in got if r.doc_id == 502]
    assert len({r.text_hash for r in one}) == 1 and sorted(r.begin for r in one) == list(range(0, 3000, 128))


def test_texts_of_pieces_make_up_the_documents(sourced):
    odd = " \t".join(f"é{i}" for i in range(700))
    rows = [(i, t, "s", 0, 0.0) for i, t in enumerate([f"\n {odd} \x0b", odd, odd, " one ", "a " * 128, "b " * 129, "", None, " \n", "\u00a0 x"])]
    got = packing.pack_documents(sourced([*rows, (1, odd, "t", 0, 0.0)]), texts=True, context=128, buckets=5, batch_tokens=512).collect()
    plain = packing.pack_documents(sourced([*rows, (1, odd, "t", 0, 0.0)]), context=128, buckets=5, batch_tokens=512).collect()
    shape = lambda found: sorted((r.doc_id, r.piece, r.begin, r.n_tokens, r.bucket, r.text_hash) for r in found)
    assert shape(got) == shape(plain) and len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)
    for i, t, *_ in rows:
        parts = sorted((r.piece, r.text, r.n_tokens) for r in got if r.doc_id == i)
        assert all(len(re.findall(mixing.WORD, x)) == n for _, x, n in parts)
        if i == 1:  # twice in the table, each with its own pieces
            assert [x for _, x, _ in parts[::2]] == [x for _, x, _ in parts[1::2]]
            parts = parts[::2]
        assert "".join(x for _, x, _ in parts) == (t if re.search(mixing.WORD, t or "") else "")
    assert packing.pack_documents(sourced([]), texts=True).collect() == []
