"""Golden cases, brute-force comparisons and properties of the index engine."""

import random

import pytest
from pyspark.sql import functions as F

from strandex.functions import encoding as E
from strandex.operators import rankselect as R
from strandex.operators import search, suffix, tree

GOLDEN = "1234123410"


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(7)
    rows = [(0, GOLDEN), (1, "0"), (2, "10"), (3, "1" * 300 + "0"), (4, "12" * 200 + "0")]
    rows += [(i, "".join(rnd.choice("1234") for _ in range(rnd.randint(20, 90))) + "0") for i in range(5, 20)]
    rows.append((20, rows[10][1][:-1] + rows[11][1]))
    return spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, enc string, n long").cache(), dict(rows)


def brute_array(t, d):
    t = t.ljust(-(-len(t) // d) * d, "0")
    return [p // d for p in sorted(range(0, len(t), d), key=lambda p: t[p:])]


def test_suffix_arrays_of_all_d(texts):
    frame, plain = texts
    ranks, ties = suffix.rank_rounds(frame)
    for d in (1, 2, 3, 8):
        got = {}
        for r in suffix.suffix_array(frame, d, ranks).collect():
            got.setdefault(r.doc_id, {})[r.sa_pos] = r.pos
        assert {i: [x[p] for p in sorted(x)] for i, x in got.items()} == {i: brute_array(t, d) for i, t in plain.items()}
    array = suffix.suffix_array(frame, 1, ranks)
    assert [r.pos for r in array.filter("doc_id = 0").orderBy("sa_pos").collect()] == [9, 8, 4, 0, 5, 1, 6, 2, 7, 3]
    assert {r.inversions for r in suffix.inversions(frame, array).collect()} == {0}
    two = suffix.bwt(frame, suffix.suffix_array(frame, 2, ranks), 2)
    assert [r.rev_bwt for r in two.filter("doc_id = 0").orderBy("sa_pos").collect()] == [35, 35, 1, 17, 17]
    for r in suffix.lcp_array(array, suffix.positions(frame, suffix.KEY), ties).collect():
        t, order = plain[r.doc_id], brute_array(plain[r.doc_id], 1)
        if r.sa_pos:
            a, b = t[order[r.sa_pos - 1] :], t[order[r.sa_pos] :]
            assert r.lcp == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_ranks_in_many_slices(spark):
    """A text of mostly one letter, and copies of it: ranks by brute force, however small the slices are."""
    rnd = random.Random(11)
    skewed = "".join("1" if rnd.random() < 0.9 else rnd.choice("234") for _ in range(1500)) + "1" * 500 + "0"
    plain = {1: skewed, 2: skewed, 3: "0", 4: "1" * 200 + "0"}
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in plain.items()], "doc_id long, enc string, n long")
    ranks, h = suffix.first_ranks(suffix.positions(frame, suffix.KEY), per_slice=100), suffix.KEY
    while not ranks.filter("ties > 1").isEmpty():
        ranks, h = suffix.refine(ranks, h, per_slice=50), 2 * h
    got = {(r.doc_id, r.rank): r.pos for r in ranks.collect()}
    assert got == {(i, k): p for i, t in plain.items() for k, p in enumerate(brute_array(t, 1))}


def test_slices_of_a_skewed_text_are_even(spark, monkeypatch):
    """Keys that mostly begin alike: no slice has over twice the median."""
    written = {}

    def keep(df, name="table"):
        return written.setdefault(name, df.cache())

    monkeypatch.setattr(suffix, "materialise", keep)
    rnd = random.Random(5)
    text = "1".join("".join(rnd.choice("1111111234") for _ in range(7)) for _ in range(5000)) + "0"
    frame = spark.createDataFrame([(1, text, len(text))], "doc_id long, enc string, n long")
    suffix.first_ranks(suffix.positions(frame, suffix.KEY), per_slice=2500)
    sizes = sorted(r["count"] for r in written["slices"].groupBy("slice").count().collect())
    assert len(sizes) > 10 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_searches_agree_for_every_d(spark, texts):
    frame, plain = texts
    asked = search.sample_patterns(frame, 12).select("pattern_id", "doc_id", "pattern")
    other = search.mutated(asked).withColumn("pattern_id", -1 - F.col("pattern_id"))
    patterns = asked.unionByName(other)
    listed = [(r.pattern_id, r.pattern) for r in patterns.collect()]
    want = sorted((p, i, k) for p, s in listed for i, t in plain.items() for k in range(len(t)) if t.startswith(s, k))
    assert sorted(tuple(r) for r in search.occurrences(frame, patterns).collect()) == want
    ranks = suffix.suffix_ranks(frame).cache()
    for d in (2, 5):
        found = search.grouped_search(frame, patterns, suffix.suffix_array(frame, d, ranks), d)
        assert sorted((r.pattern_id, r.doc_id, r.pos) for r in found.collect()) == want
    everything = sorted(t[k:] for t in plain.values() for k in range(len(t)))
    for r in search.ranges(frame, patterns).collect():
        s = dict(listed)[r.pattern_id]
        assert r.sa_lo == sum(x < s for x in everything) and r.sa_hi - r.sa_lo == sum(x.startswith(s) for x in everything)


def test_golden_scalars(spark):
    row = spark.sql("select '1234123410' enc").select(
        E.packed(F.col("enc")).alias("hex"), E.unpacked(E.packed(F.col("enc")), F.lit(10)).alias("back"), E.decode(F.col("enc")).alias("letters"),
        F.transform(E.meta_symbols(F.col("enc"), 2), E.octal).alias("two"), E.meta_symbols(F.col("enc"), 3).alias("three"),
    ).first()
    assert row.hex == "29c29c20" and row.back == GOLDEN and row.letters == "ACTGACTGA\\0"
    assert row.two == [10, 28, 10, 28, 8] and row.three == ["123", "412", "341", "000"]
    fasta = [("", "0"), (">x\nACgNT\n>y\nG", "12340"), ("AC>drop\nT", "1230"), ("A>no newline", "10"), ("A\x00", "10"), (">only", "0")]
    got = spark.createDataFrame([(a,) for a, _ in fasta], "raw string").select(E.fasta_normalise(F.col("raw")).alias("e")).collect()
    assert [r.e for r in got] == [w for _, w in fasta]
    ints = spark.createDataFrame([(0,), (15,), (16,), (17,)], "v long").select(E.bit_length(F.col("v")).alias("b"), E.align8(F.col("v")).alias("a"), E.div_up(F.col("v"), F.lit(4)).alias("d"))
    assert [tuple(r) for r in ints.collect()] == [(0, 0, 0), (4, 16, 4), (5, 16, 4), (5, 24, 5)]
    checked = spark.createDataFrame([("ACTG",), ("",), ("ACN",), (None,)], "p string").select(E.checked_pattern(F.col("p")).alias("e")).collect()
    assert [r.e for r in checked] == ["1234", "", None, None]
    assert [(E.node_capacity(d, False), E.node_capacity(d, True)) for d in range(1, 9)] == [(238, 270)] * 2 + [(213, 238)] * 3 + [(193, 213)] * 3
    with pytest.raises(ValueError):
        E.check_d(9)


def test_rank_and_select_of_the_golden_sequence(spark):
    values = [1, 2, 4, 4, 10, 3, 3, 2]
    seq = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "doc_id long, idx long, val long")
    asked = spark.createDataFrame([(0, v, p) for v in (0, 1, 2, 3, 4, 10, 12) for p in range(9)], "doc_id long, val long, pos long")
    assert {(r.val, r.pos): r.result for r in R.wavelet_rank(seq, asked, bits=4).collect()} == {(v, p): values[:p].count(v) for v in (0, 1, 2, 3, 4, 10, 12) for p in range(9)}
    chosen = {(r.val, r.pos): r.result for r in R.select_table(seq).collect()}
    assert chosen == {(1, 0): 0, (2, 0): 1, (2, 1): 7, (3, 0): 5, (3, 1): 6, (4, 0): 2, (4, 1): 3, (10, 0): 4}
    first = R.first_in_range(seq, spark.createDataFrame([(0, 2, 4, 0, 8)], "doc_id long, val long, signif int, l long, r long"), bits=4)
    assert first.first().result == 1
    rnd = random.Random(1)
    bits = [(d, i, rnd.randint(0, 1)) for d, n in ((0, 200), (1, 61), (2, 1)) for i in range(n)]
    frame = spark.createDataFrame(bits, "doc_id long, idx long, bit long")
    want = {(d, i): sum(b for e, j, b in bits if e == d and j < i) for d, i, _ in bits}
    assert {(r.doc_id, r.pos): r.rank for r in R.bit_rank(frame).collect()} == want == {(r.doc_id, r.pos): r.rank for r in R.bit_rank_words(frame).collect()}


def test_tree_splits_evenly_with_smaller_nodes_first(spark, texts):
    cases = spark.range(1, 700, 37).selectExpr("id as n").withColumn("m", F.ceil(F.col("n") / 50)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    sizes = {}
    for r in cases.withColumn("node", tree.node_of(F.col("i"), F.col("n"), F.col("m"))).groupBy("n", "m", "node").count().collect():
        sizes.setdefault((r.n, r.m), {})[r.node] = r["count"]
    for (n, m), parts in sizes.items():
        want = sorted([n // m] * (m - n % m) + [n // m + 1] * (n % m))
        assert [parts[i] for i in range(m)] == want
    frame, plain = texts
    array = suffix.suffix_array(frame)
    shape = {(r.doc_id, r.level): r.nodes for r in tree.shape(array).collect()}
    for i, t in plain.items():
        assert [shape[i, level] for level in range(len(tree.level_sizes(len(t))))] == tree.level_sizes(len(t))
    rows = tree.leaf_rows(array, suffix.positions(frame, suffix.KEY), suffix.rank_rounds(frame)[1])
    nodes = tree.trie_nodes(rows).filter("doc_id = 0").collect()
    # $ | A$ ACTGA$.. | CTGA.. | TGA.. | GA..: the prefixes at which neighbours part.
    t, order = GOLDEN, brute_array(GOLDEN, 1)
    want = {}
    for x, y in zip(order, order[1:]):
        n = next(i for i in range(10) if t[x + i : x + i + 1] != t[y + i : y + i + 1])
        want[t[y : y + n]] = want.get(t[y : y + n], 1) + 1
    assert sorted((r.lcp, r.n_children) for r in nodes) == sorted((len(p), c) for p, c in want.items())


def test_search_of_all_pattern_lengths(spark):
    rnd = random.Random(11)
    same = "".join(rnd.choice("1234") for _ in range(150))
    plain = {0: same + "0", 1: "2" + same + "10", 2: "12" * 80 + "0", 3: "".join(rnd.choice("1234") for _ in range(200)) + "0", 4: "10"}
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in plain.items()], "doc_id long, enc string, n long").cache()
    cut = [plain[i][p : p + n] for i, p in ((0, 5), (2, 3), (3, 30)) for n in (1, 3, 8, 11, 12, 16, 21, 22, 32, 64, 65, 80, 120)]
    asked = list(dict.fromkeys([*cut, *(c[:-1] + str(int(c[-1]) % 4 + 1) for c in cut), "12" * 90]))
    patterns = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string").cache()
    want = {(n, i, p) for n, s in enumerate(asked) for i, t in plain.items() for p in range(len(t)) if t.startswith(s, p)}
    got = [tuple(r) for r in search.occurrences(frame, patterns).select("pattern_id", "doc_id", "pos").collect()]
    assert len(got) == len(want) and set(got) == want
    everything = [t[k:] for t in plain.values() for k in range(len(t))]
    got = {r.pattern_id: (r.sa_lo, r.sa_hi) for r in search.ranges(frame, patterns).collect()}
    for n, s in enumerate(asked):
        low = sum(x < s for x in everything)
        assert got[n] == (low, low + sum(x.startswith(s) for x in everything))
    got = [(r.pattern_id, r.doc_id, r.pos) for r in search.grouped_search(frame, patterns, suffix.suffix_array(frame, 8), 8).collect()]
    want = {w for w in want if len(asked[w[0]]) > 8}
    assert len(got) == len(want) and set(got) == want


def test_all_texts_as_one(spark):
    rnd = random.Random(13)
    bodies = ["".join(rnd.choice("1234") for _ in range(n)) for n in (5, 0, 3000, 1, 1, 40, 1019, 2100)] + ["12" * 700, "12" * 700]
    rows = [(n * 7 % 11, b) for n, b in enumerate(bodies)] + [(3, "4"), (3, "1")]
    frame = spark.createDataFrame([(i, b + "0", len(b) + 1) for i, b in rows], "doc_id long, enc string, n long").repartition(3)
    whole = "".join(b for _, b in sorted(rows)) + "0"
    keys = suffix.joined_positions(frame, suffix.KEY).collect()
    assert sorted((r.doc_id, r.pos, r.key) for r in keys) == [(0, p, whole[p : p + suffix.KEY]) for p in range(len(whole))]
    got = suffix.suffix_array(frame, ranks=suffix.suffix_ranks(frame, joined=True)).collect()
    assert [r.pos for r in sorted(got, key=lambda r: r.sa_pos)] == brute_array(whole, 1)
    assert [tuple(r) for r in suffix.joined_positions(frame.filter("false")).collect()] == [(0, 0, "0")]


def test_stored_index_is_built_once_and_reopened(spark, texts, tmp_path):
    from strandex.sources.stored import StoredIndex

    frame, plain = texts
    built = StoredIndex(spark, str(tmp_path / "index"), frame)
    built.suffixes(3)
    again = StoredIndex(spark, str(tmp_path / "index"))
    patterns = search.sample_patterns(again.texts(), 14).select("pattern_id", "doc_id", "pattern").cache()
    listed = [(r.pattern_id, r.pattern) for r in patterns.collect()]
    want = sorted((p, i, k) for p, s in listed for i, t in plain.items() for k in range(len(t)) if t.startswith(s, k))
    assert want and sorted(tuple(r) for r in search.occurrences(again.texts(), patterns, again.keys()).collect()) == want
    found = search.grouped_search(again.texts(), patterns, again.array(3), 3, again.suffixes(3))
    assert sorted((r.pattern_id, r.doc_id, r.pos) for r in found.collect()) == want
    first = {r.pattern_id: (r.doc_id, r.pos) for r in search.first_hits(again.texts(), patterns, again.keys()).collect()}
    for p, s in listed:
        assert first[p] == min((t[k:], i, k) for i, t in plain.items() for k in range(len(t)) if t.startswith(s, k))[1:]
    with pytest.raises(ValueError):
        StoredIndex(spark, str(tmp_path / "nothing")).texts()


def test_long_patterns_in_text_search_and_leaves(spark):
    rnd = random.Random(5)
    body = "".join(rnd.choice("ab") for _ in range(60)) * 4 + "c"
    texts = spark.createDataFrame([(1, body), (2, "xyz"), (3, "")], "doc_id long, text string")
    asked = [(1, 1, body[3:100]), (2, 1, body[3:99] + "z"), (3, 1, body[5:9]), (4, 2, "yz"), (5, 2, "zz")]
    got = {r.pattern_id: (r.match, r.insertion_suffix) for r in search.text_search(texts, spark.createDataFrame(asked, "pattern_id long, doc_id long, pattern string")).collect()}
    for p, i, s in asked:
        t = {1: body, 2: "xyz"}[i]
        ends = [t[k:] for k in range(len(t))]
        assert got[p] == (min((e for e in ends if e.startswith(s)), default=None), min((e for e in ends if e >= s), default=None))


def test_bits_beyond_those_reversed_count_for_nothing(spark):
    values = [0, 1, 5, (1 << 20) - 1, 1 << 20, (1 << 20) + 3, 1_200_000, (1 << 40) + 6]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(E.bits_reversed(F.col("v"), 20).alias("r"))
    assert [r.r for r in got.collect()] == [sum(((v >> i) & 1) << (19 - i) for i in range(20)) for v in values]


@pytest.mark.parametrize("local", [1 << 20, 100])
def test_texts_are_sorted_where_they_are_read(spark, texts, tmp_path, monkeypatch, local):
    """Arrays, sequences and common prefixes of each text without a shuffle; texts of over 100 symbols by rounds in the second case."""
    import os

    from strandex.operators import whole
    from strandex.sources.stored import StoredIndex

    monkeypatch.setattr(whole, "LOCAL", local)
    frame, plain = texts
    index = StoredIndex(spark, str(tmp_path / "index"), frame)
    for d in (1, 2, 3, 8):
        got, before = {}, {}
        for r in index.array(d).collect():
            got.setdefault(r.doc_id, {})[r.sa_pos] = r.pos
        want = {i: brute_array(t, d) for i, t in plain.items()}
        assert {i: [x[p] for p in sorted(x)] for i, x in got.items()} == want
        for r in index.bwt(d).collect():
            before[r.doc_id, r.sa_pos] = r.rev_bwt
        full = {i: t.ljust(-(-len(t) // d) * d, "0") for i, t in plain.items()}
        assert before == {(i, k): int((full[i][p * d - d : p * d] if p else full[i][-d:])[::-1], 8) for i, a in want.items() for k, p in enumerate(a)}
        if local > 1000:
            assert "Exchange" not in index.array(d).unionByName(index.bwt(d).select("doc_id", "sa_pos", "pos"))._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.sa_pos): (r.pos, r.lcp) for r in index.lcp().collect()}
    ends = {i: sorted(t[p:] for p in range(len(t))) for i, t in plain.items()}
    assert got == {(i, k): (len(plain[i]) - len(e), len(os.path.commonprefix([e, x[k - 1]])) if k else 0) for i, x in ends.items() for k, e in enumerate(x)}
    assert (tmp_path / "index/stage=long-ranks").exists() == (local < 1000)


def test_suffixes_of_any_letters_in_a_task():
    import os

    from strandex.operators import whole

    rnd = random.Random(1)
    half = "".join(rnd.choice("1234") for _ in range(900))
    some = ["", "0", "10", "1" * 700 + "0", "12" * 500 + "0", half + half + "0", half + "1" + half + "0", ""]
    for plain in (some, ["abé\n ~z\U0001f600" * 9, "", "zz", "é" * 50], [""], []):
        starts, order, common = whole.sorted_suffixes(plain, prefixes=True)
        for i, t in enumerate(plain):
            want = sorted(range(len(t)), key=lambda p: t[p:])
            assert list(order[starts[i] : starts[i + 1]] - starts[i]) == want
            assert list(common[starts[i] : starts[i + 1]]) == [0][: len(t)] + [len(os.path.commonprefix([t[a:], t[b:]])) for a, b in zip(want, want[1:])]


def test_no_row_of_a_position_is_joined(spark, texts):
    """Ranks by words and dense ranks make their positions above the last join, where no guess of their size can have them broadcast."""
    frame, plain = texts
    bits = R.sequence_of(frame).select("doc_id", "idx", (F.col("val") >= 3).cast("long").alias("bit"))
    for found in (suffix.rank_round(frame), R.bit_rank_words(bits)):
        lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert next(i for i, x in enumerate(lines) if "explode(" in x) < next(i for i, x in enumerate(lines) if "Join " in x)
    some = bits.filter("idx % 7 <> 3")  # a vector need not have all positions
    assert {tuple(r) for r in R.bit_rank_words(some).collect()} == {tuple(r) for r in R.bit_rank(some).collect()}
    long = "".join(random.Random(4).choice("1234") for _ in range(2500)) + "0"
    more = {**plain, 99: long}
    for width in (2, 3):
        want = {}
        for i, t in more.items():
            kinds = sorted({t[p : p + width] for p in range(len(t))})
            at = [kinds.index(t[p : p + width]) for p in range(len(t))]
            want |= {(i, p): (at[p], at[p + width] if p + width < len(t) else -1) for p in range(len(t))}
        got = suffix.rank_round(spark.createDataFrame(list(more.items()), "doc_id long, enc string"), width).collect()
        assert len(got) == len(want) and {(r.doc_id, r.pos): (r.rank0, r.rank1) for r in got} == want


def odd_sequence(spark):
    """Rows of sequences with gaps, repeated ids, rows that come twice and rows without an id, place or value, and those of them that count."""
    rnd = random.Random(5)
    rows = [(1, p, rnd.randint(0, 4)) for p in range(0, 300, 3)] + [(2, p, 9) for p in range(40)] + [(3, 5000, 2), (3, 2, 2), (-4, 0, 1)]
    rows += rows[:50] + [(None, 1, 2), (1, None, 3), (1, 7, None), (None, None, None)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, idx long, val long").repartition(3), sorted(r for r in rows if None not in r)


def in_lists(found):
    """Whether the plan reads the sequence from a table and shuffles lists: the only row of a place comes from one, above the shuffle."""
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    return "regexp_extract_all" not in plan and next(i for i, x in enumerate(lines) if "explode(_at" in x) < next(i for i, x in enumerate(lines) if "RepartitionByExpression" in x)


@pytest.mark.parametrize("slice_size", [4096, 16])
def test_levels_of_a_sequence_from_lists_of_places(spark, texts, monkeypatch, slice_size):
    monkeypatch.setattr(R, "SLICE", slice_size)
    assert in_lists(R.wavelet_bits(R.sequence_of(texts[0])))
    seq, rows = odd_sequence(spark)
    want, seen = [], {}
    for d, _, v in rows:
        for level in range(3):
            node = (d, level, v >> (3 - level))
            want.append((*node, seen.setdefault(node, 0), (v >> (2 - level)) & 1))
            seen[node] += 1
    assert sorted(tuple(r) for r in R.wavelet_bits(seq).collect()) == sorted(want)


def numbered(rows):
    """id, value, place and number among those of the same id and value, of each row."""
    out, seen = [], {}
    for d, p, v in rows:
        out.append((d, v, p, seen.setdefault((d, v), 0)))
        seen[d, v] += 1
    return sorted(out)


@pytest.mark.parametrize("slice_size", [4096, 16])
def test_ranks_of_a_sequence_that_is_made_once(spark, texts, monkeypatch, slice_size):
    monkeypatch.setattr(R, "SLICE", slice_size)
    assert in_lists(R.sequence_rank(R.sequence_of(texts[0])))
    seq, rows = odd_sequence(spark)
    assert sorted((r.doc_id, r.val, r.pos, r.result) for r in R.sequence_rank(seq).collect()) == numbered(rows)


@pytest.mark.parametrize("slice_size", [4096, 16])
def test_select_table_from_lists_of_places(spark, texts, monkeypatch, slice_size):
    monkeypatch.setattr(R, "SLICE", slice_size)
    assert in_lists(R.select_table(R.sequence_of(texts[0])))
    seq, rows = odd_sequence(spark)
    assert sorted((r.doc_id, r.val, r.result, r.pos) for r in R.select_table(seq).collect()) == numbered(rows)
