"""The stored index: fences, backward search and wavelet tree, against brute force."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from strandex.operators import fences, search, suffix, tree, wavelet
from strandex.sources.stored import StoredIndex


def suffix_order(plain):
    return sorted((t[p:], i, p) for i, t in plain.items() for p in range(len(t)))


def index_over(spark, base, plain, block_rows):
    frame = spark.createDataFrame([(i, t) for i, t in plain.items()], "doc_id long, enc string").repartition(3)
    return StoredIndex(spark, str(base), frame, block_rows)


@pytest.fixture(scope="module")
def plain():
    rnd = random.Random(21)
    letters = lambda n: "".join(rnd.choice("1234") for _ in range(n))
    same = letters(180)
    rows = {0: same + "0", 1: same + "0", 2: "3" + same + "10", 3: "12" * 120 + "0", 4: "1" * 200 + "0", 5: "0", 6: "10", 70_000: same + "0"}
    return rows | {i: letters(rnd.randint(1, 150)) + "0" for i in range(7, 20)}


@pytest.fixture(scope="module")
def index(spark, plain, tmp_path_factory):
    return index_over(spark, tmp_path_factory.mktemp("index"), plain, 40)


@pytest.fixture(scope="module")
def asked(plain):
    cut = [plain[i][p : p + n] for i, p in ((0, 5), (3, 3), (9, 1), (4, 20), (2, 0)) for n in (1, 2, 5, 9, 16, 40, 64, 65, 100, 130) if p + n < len(plain[i])]
    more = [c[:-1] + str(int(c[-1]) % 4 + 1) for c in cut] + ["1" * 199, "1" * 201, "12" * 110, "4" * 30, "1", "4"]
    return list(dict.fromkeys(c for c in cut + more if "0" not in c))


def test_order_of_all_suffixes(index, plain):
    rows = sorted(index.blocks().collect(), key=lambda r: r.sa_pos)
    want = suffix_order(plain)
    assert [(r.doc_id, r.pos) for r in rows] == [x[1:] for x in want] and [r.sa_pos for r in rows] == list(range(len(want)))
    assert all(r.block == r.sa_pos // 40 and r.key == s[:64] and r.before == (plain[r.doc_id][r.pos - 1] if r.pos else "0") for r, (s, _, _) in zip(rows, want))


def test_ranges_and_places_of_patterns_of_any_length(spark, index, plain, asked, monkeypatch):
    patterns = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string")
    order = suffix_order(plain)
    want = {n: (lo := sum(s < p for s, _, _ in order), lo + sum(s.startswith(p) for s, _, _ in order)) for n, p in enumerate(asked)}
    assert {r.pattern_id: (r.sa_lo, r.sa_hi) for r in index.ranges(patterns).collect()} == want
    assert {r.pattern_id: (r.sa_lo, r.sa_hi) for r in index.backward_ranges(patterns).collect() if r.sa_lo < r.sa_hi} == {n: x for n, x in want.items() if x[0] < x[1]}
    hits = sorted((n, i, p) for n, s in enumerate(asked) for i, t in plain.items() for p in range(len(t)) if t.startswith(s, p))
    assert sorted(tuple(r) for r in index.occurrences(patterns).collect()) == hits
    first = {r.pattern_id: (r.sa_lo, r.doc_id, r.pos) for r in index.first_hits(patterns).collect()}
    assert first == {n: (lo, *(order[lo][1:] if lo < hi else (-1, -1))) for n, (lo, hi) in want.items()}
    monkeypatch.setattr(fences, "NAMED", 0)  # blocks found by a join instead of a list of names
    assert {r.pattern_id: (r.sa_lo, r.sa_hi) for r in index.ranges(patterns).collect()} == want


def test_levels_of_fences(spark, index, plain, asked, monkeypatch):
    monkeypatch.setattr(fences, "FAN", 3)
    tree = fences.fence_tree(index.blocks())
    nodes = {r.level: r["count"] for r in tree.groupBy("level").count().collect()}
    assert nodes[max(nodes)] == 1 and len(nodes) >= 4 and all(nodes[i + 1] == -(-nodes[i] // 3) for i in range(1, len(nodes)))
    patterns = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string")
    got = {tuple(r) for r in fences.ranges(index.blocks(), 40, tree, index.parts(), patterns).collect()}
    assert got == {tuple(r) for r in index.ranges(patterns).collect()}


def test_only_the_blocks_that_are_needed_are_read(spark, tmp_path):
    rnd = random.Random(2)
    plain = {i: "".join(rnd.choice("1234") for _ in range(2999)) + "0" for i in range(4)}
    index = index_over(spark, tmp_path / "i", plain, 6)
    files = len({f for f in index.blocks().inputFiles()})
    assert files == 2000
    patterns = [plain[i % 4][7 * i : 7 * i + 16] for i in range(100)]
    frame = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")
    ranges = index.ranges(frame)
    read = lambda df: {f for r in df.select(F.input_file_name().alias("f")).distinct().collect() for f in [r.f]}
    named = fences.only(index.blocks(), fences._descended(fences._bounds(frame), index.fences()))
    assert 0 < len(read(named)) < 0.1 * files
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block", plan)
    wanted = sorted((n, i, p) for n, s in enumerate(patterns) for i, t in plain.items() for p in range(3000) if t.startswith(s, p))
    assert sorted((r.pattern_id, r.doc_id, r.pos) for r in index.at(ranges).collect()) == wanted


def test_an_unfinished_table_is_written_again(spark, plain, tmp_path):
    index = index_over(spark, tmp_path / "i", plain, 40)
    n = index.keys().count()
    (tmp_path / "i/stage=keys/d=1/_SUCCESS").unlink()
    for path in list((tmp_path / "i/stage=keys/d=1").glob("part-*"))[1:]:
        path.unlink()
    assert index_over(spark, tmp_path / "i", plain, 40).keys().count() == n


def test_wavelet_levels_against_the_sequence(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "CHECKPOINT", 4)
    rnd = random.Random(3)
    values = {0: [1, 2, 4, 4, 10, 3, 3, 2], 1: [rnd.randrange(16) for _ in range(90)], 2: [7], 3: [5] * 16}
    seq = spark.createDataFrame([(i, n, v) for i, x in values.items() for n, v in enumerate(x)], "doc_id long, idx long, val long").cache()
    levels, places = wavelet.wavelet_levels(seq, 4).cache(), wavelet.select_places(seq, 4, [4]).cache()
    assert {tuple(r) for r in wavelet.access(levels, 4, seq.select("doc_id", "idx")).collect()} == {tuple(r) for r in seq.collect()}
    asked = [(i, v, s, lo, hi) for i, x in values.items() for v in (0, 2, 5, 11) for s in (0, 1, 2, 3, 4) for lo, hi in ((0, len(x)), (len(x) // 3, len(x)), (1, 1), (0, 1))]
    for n, (i, v, s, lo, hi) in enumerate(asked):
        inside = [(x, j) for j, x in enumerate(values[i][lo:hi], lo) if x >> (4 - s) == v >> (4 - s)]
        asked[n] = (i, v, s, lo, hi, min(inside)[1] if inside else None)
    for s, rules in ((0, (1,)), (2, (0, 1)), (4, (1, 2, 3))):
        for lo_rule in rules:
            part = [a for n, a in enumerate(asked) if a[2] == s and n % 4 == lo_rule]
            frame = spark.createDataFrame([a[:5] for a in part], "doc_id long, val long, signif int, l long, r long")
            got = {(r.doc_id, r.val): r.result for r in wavelet.first_in_range(levels, places, 4, frame).collect()}
            assert got == {a[:2]: a[5] for a in part if a[5] is not None}


@pytest.mark.parametrize("d", [3, 8])
def test_grouped_search_through_the_tree(spark, index, plain, asked, d):
    patterns = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string")
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in plain.items()], "doc_id long, enc string, n long")
    want = sorted(tuple(r) for r in search.grouped_search(frame, patterns, index.array(d), d).collect())
    assert sorted(tuple(r) for r in index.grouped_search(patterns, d).collect()) == want
    assert {(r[0], r[1], r[4]) for r in want} == {(n, i, p) for n, s in enumerate(asked) if len(s) > d for i, t in plain.items() for p in range(len(t)) if t.startswith(s, p)}


def test_tries_against_prefixes(index, plain):
    leaves = {(r.doc_id, r.node_id): r.pos for r in index.leaf_rows().collect()}
    edges = {}
    for r in tree.trie_edges(index.leaf_rows()).collect():
        edges.setdefault((r.doc_id, r.node_id), {})[r.lcp, r.prefix_pos] = r
    for key, places in leaves.items():
        ends = [plain[key[0]][p:] for p in places]
        assert ends == sorted(ends)
        common = [os.path.commonprefix([a, b]) for a, b in zip(ends, ends[1:])]
        assert {e[1][: e[0]] for e in [(r.lcp, plain[key[0]][r.prefix_pos :]) for r in edges.get(key, {}).values()]} == set(common)
        for r in edges.get(key, {}).values():
            prefix = plain[key[0]][r.prefix_pos :][: r.lcp]
            inside = [i for i, e in enumerate(ends) if e.startswith(prefix)]
            assert (r.first_slot, r.last_slot, r.n_children) == (inside[0], inside[-1], common.count(prefix) + 1)
            above = max((c for c in set(common) if c != prefix and prefix.startswith(c)), key=len, default=None)
            assert (r.parent_lcp, r.symbol) == ((None, None) if above is None else (len(above), prefix[len(above)]))
            assert above is None or plain[key[0]][r.parent_pos :].startswith(above)


def test_blind_search_in_leaves(spark, index, plain, asked):
    rows = [(n, i, p) for n, (i, p) in enumerate((i, p) for i in (0, 2, 3, 4, 6, 9) for p in asked)]
    patterns = spark.createDataFrame(rows, "pattern_id long, doc_id long, pattern string")
    leaves = {}
    for r in index.leaf_rows().collect():
        leaves.setdefault(r.doc_id, {})[r.node_id] = [plain[r.doc_id][p:] for p in r.pos]
    want = sorted((n, i, leaf, sum(e < p for e in ends)) for n, i, p in rows for leaf, ends in leaves[i].items())
    got = tree.insertion_points(index.leaf_rows(), index.keys(), index.parts(), patterns)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_common_prefixes_of_equal_letters(spark, tmp_path):
    n = 3000
    index = index_over(spark, tmp_path / "i", {0: "1" * n + "0"}, 1000)
    got = {r.sa_pos: r.lcp for r in suffix.lcp_array(index.array(), index.keys(), index.ties()).collect()}
    assert got == {0: 0, 1: 0, **{i: i - 1 for i in range(2, n + 1)}}


def test_texts_of_any_letters(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abé\n ~z\U0001f600") for _ in range(rnd.randint(1, 9)))
    same = " ".join(word() for _ in range(60))
    plain = {0: same, 1: same[5:], 2: "z" * 150, 3: "~", **{i: " ".join(word() for _ in range(20)) for i in range(4, 12)}}
    index = index_over(spark, tmp_path / "i", plain, 50)
    asked = [t[p : p + n] for t in plain.values() for p, n in ((0, 1), (3, 4), (10, 70), (1, 130)) if p + n <= len(t)] + ["~~", "zz", "\U0001f600\U0001f600"]
    asked = list(dict.fromkeys(asked))
    patterns = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string")
    order = sorted((t[p:].encode(), i, p) for i, t in plain.items() for p in range(len(t)))
    assert [(r.doc_id, r.pos) for r in index.blocks().orderBy("sa_pos").collect()] == [x[1:] for x in order]
    want = {n: (lo := sum(s < p.encode() for s, _, _ in order), lo + sum(s.startswith(p.encode()) for s, _, _ in order)) for n, p in enumerate(asked)}
    assert {r.pattern_id: (r.sa_lo, r.sa_hi) for r in index.ranges(patterns).collect()} == want


def test_places_and_first_hits_by_a_join(spark, plain, asked):
    """Patterns of all lengths without an index; no key of 64 symbols goes through the join with all positions."""
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in plain.items()], "doc_id long, enc string, n long")
    patterns = spark.createDataFrame([(n, 0, s) for n, s in enumerate(asked)], "pattern_id long, doc_id long, pattern string")
    hits = {(n, i, p) for n, s in enumerate(asked) for i, t in plain.items() for p in range(len(t)) if t.startswith(s, p)}
    got = [tuple(r) for r in search.occurrences(frame, patterns).collect()]
    assert len(got) == len(hits) and set(got) == hits
    first = {}
    for n, i, p in hits:
        first[n] = min(first.get(n, ("~",)), (plain[i][p:], i, p))
    assert {r.pattern_id: (r.doc_id, r.pos) for r in search.first_hits(frame, patterns).collect()} == {n: x[1:] for n, x in first.items()}
    plan = search.occurrences(frame, patterns.filter("length(pattern) = 16"))._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and f", {suffix.KEY}) AS key" not in plan.split("xxhash64")[-1]


def test_joins_go_by_measured_sizes(spark, tmp_path):
    """All positions of a text are far more than Spark guesses; no join with them is planned as a broadcast."""
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.set(static, "10m"), spark.conf.unset(adaptive)
    index = index_over(spark, tmp_path / "i", {i: "1234" * 2000 + "0" for i in range(3)}, 1000)
    assert spark.conf.get(adaptive) == "10m"
    keys = suffix.positions(index.texts(), suffix.KEY)
    plan = keys.join(keys.groupBy("key").count(), "key")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
