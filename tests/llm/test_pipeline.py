import re
from collections import Counter

import corpus_pipeline as cp
from strandex.llm import mixing

SF = "/root/testdata/sf0.001"


def test_every_stage_acts_and_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, start = docs.columns, docs.count()
    clean = cp.drop_toxic(spark, docs, SF)
    assert clean.columns == columns and 0.8 * start < clean.count() <= start
    clean = clean.cache()
    single = cp.drop_near_duplicates(spark, clean, SF)
    assert single.columns == columns
    sets = {}
    for r in clean.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i in ids if find(i) == i)
    cut = cp.cut_repeated_passages(spark, single, SF)
    assert cut.columns == columns and cut.count() == single.count()
    seen = {}
    for r in single.orderBy("doc_id").collect():
        w = r.text.split(" ")
        seen[r.doc_id] = r.text
    changed = [r for r in cut.collect() if r.text != seen[r.doc_id]]
    assert all(len(r.text) < len(seen[r.doc_id]) and r.n_chars == len(r.text) for r in changed)
    mixed = cp.mix_sources(spark, cut, SF)
    plan = mixing.schedule(cut).collect()
    taken = mixing.mix_order(mixing.schedule(cut)).collect()
    assert plan and mixed.columns == columns and mixed.count() == len(taken)
    packed = cp.pack(spark, mixed, SF).collect()
    assert sum(r.n_tokens for r in packed) == sum(r.taken for r in taken)
    words = re.compile(mixing.WORD)
    assert all(len(words.findall(r.text)) == r.n_tokens for r in packed)
    # Whatever the mix took is in the pieces: whole texts of one piece, words in order of longer ones.
    held, want = Counter(), Counter(w for r in mixed.collect() for w in words.findall(r.text or ""))
    for r in packed:
        held.update(words.findall(r.text))
    assert held == want
    assert sorted(r.text for r in cp.run(spark, SF).collect()) == sorted(r.text for r in packed)


def test_stages_on_nulls_repeats_ties_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "a"), (3, text, "a"), (2, text, "b"), (None, text, "b"), (None, None, None), (5, None, "a"), (6, "", "a"), (7, "  ", None), (8, "x " * 30000, "a")]
    rows += [(20 + i, " ".join(f"v{i}_{j}" for j in range(30 + i)), "a") for i in range(5)]
    schema = "doc_id long, text string, source string, _id string, row long, `carried.x` string, _score double, n_chars long"
    docs = spark.createDataFrame([(*r, "keep", 1, "c", 0.5, len(r[1] or "")) for r in rows], schema)
    for name, stage in cp.STAGES:
        after = stage(spark, docs, SF)
        if name == "packing":
            assert {r.doc_id for r in after.collect()} >= {2, 8}
            continue
        assert after.columns == docs.columns
        got = after.collect()
        assert all((r._id, r.row, r["carried.x"], r._score) == ("keep", 1, "c", 0.5) for r in got)
        if name == "toxicity":
            assert len(got) == len(rows)
        if name in ("near_duplicates", "repeated_passages"):
            assert sorted(str(r.doc_id) for r in got if r.text and r.text.strip() == text) == ["2"]
            assert sorted(str(r.doc_id) for r in got if not (r.text or "").strip()) == ["5", "6", "7", "None"]
            assert sum(r.text is None for r in got) == 2
        docs = after
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).collect() == []
