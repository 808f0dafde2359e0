import hashlib

import numpy as np
import pytest

from strandex.llm import substrings


def brute(rows, length):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for s in range(len(w) - length + 1):
                k = tuple(w[s : s + length])
                first[k] = min(i, first.get(k, i))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - length + 1) if i is not None else ():
            if first[tuple(w[s : s + length])] < i:
                gone.update(range(s, s + length))
        kept = [x for s, x in enumerate(w) if s not in gone]
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,hot", [(13, 4), (13, 0), (6, 1), (40, 4), (100, 4), (250, 1)])
def test_against_brute_force(make_docs, corpus, length, hot):
    rows = [*corpus, (None, corpus[1][1]), (12, corpus[12][1]), (-5, corpus[45][1])]
    spans = substrings.repeated_spans(make_docs(rows), min_words=length, hot=hot)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.kept_digest(spans).collect())
    assert got == brute(rows, length)


def test_texts_keep_what_is_no_repeat(make_docs):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = make_docs([(1, f"one\n{passage}  tail"), (2, f"  two\t{passage}\nend "), (3, "clean  text "), (4, None)])
    out = {r.doc_id: r for r in substrings.without_repeats(substrings.repeated_spans(docs, min_words=13, carry=("source", "spans"))).collect()}
    assert out[1].text == f"one\n{passage}  tail" and out[1].n_removed == 0
    assert out[2].text == "  two\t\nend " and out[2].n_removed == 20 and out[2].carried.source == "s2" and out[2].carried.spans == "x"
    assert out[3].text == "clean  text " and out[4].text is None


def test_ids_with_two_texts_and_empty_table(make_docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.repeated_spans(make_docs([(1, a), (2, a), (2, b + " more")]), min_words=13).transform(substrings.kept_digest).collect()}
    assert got == {(1, 30, 0), (2, 30, 30), (2, 31, 0)}
    assert substrings.kept_digest(substrings.repeated_spans(make_docs([]), min_words=13)).collect() == []
    with pytest.raises(ValueError):
        substrings.repeated_spans(make_docs([]), min_words=3)


def test_rows_that_share_an_id_are_told_apart_by_their_whole_hash(make_docs):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage), *((5, f"{passage} tail{i}") for i in range(40)), *((5, " ".join(f"c{i}x{j}" for j in range(21))) for i in range(1500))]
    out = substrings.kept_digest(substrings.repeated_spans(make_docs(rows), min_words=13)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(tuple(r) for r in out) == [(1, 20, 0, 1), (5, 21, 0, 1500), (5, 21, 20, 40)]
    word, text = np.array([0, 7, (1 << 30) - 1]), np.array([-1, 2**63 - 1, -(2**63)])
    place, reach = substrings._pack(word, text, np.array([0, 65535, 8]), np.array([0, 1, 0]))
    spark = make_docs([]).sparkSession
    frame = spark.createDataFrame(list(zip(place.tolist(), reach.tolist())), "place long, reach long")
    assert [r[0] for r in frame.select(substrings._text_of(frame.place, frame.reach)).collect()] == text.tolist()
    seeds = [r[0] for r in frame.select(substrings._seed_of(frame.place, frame.reach, frame.place > 0)).collect()]
    first, last, known = substrings._unpack(np.array(seeds))
    assert known.tolist() == (place > 0).tolist() and first.tolist() == [0, 7 - 65535, (1 << 30) - 9] and last.tolist() == [0, 6, (1 << 30) - 1]


def test_each_text_goes_to_one_worker_where_its_spans_are_found(make_docs, corpus):
    docs = make_docs([*corpus, (None, corpus[1][1]), (12, corpus[12][1])])
    spans = substrings.repeated_spans(docs, min_words=13, carry=("source",))
    for outcome, apart in ((substrings.KEPT_DIGEST, substrings.kept_digest), (substrings.WITHOUT_REPEATS, substrings.without_repeats)):
        found = substrings.repeated_spans(docs, min_words=13, carry=("source",), outcome=outcome)
        assert found.schema == apart(spans).schema
        assert sorted(map(repr, found.collect())) == sorted(map(repr, apart(spans).collect()))


def test_query_and_stage_have_no_second_python_pass_over_the_texts(make_docs, monkeypatch):
    import corpus_pipeline
    from strandex.llm import registry

    docs = make_docs([(1, "a b"), (2, "a b")]).select("doc_id", "text", "source")
    docs = docs.selectExpr("*", "1L AS n_chars")
    monkeypatch.setattr(registry, "_read", lambda *_: docs)
    for found in (registry.op2_substring_dedup(docs.sparkSession, ""), corpus_pipeline.cut_repeated_passages(docs.sparkSession, docs, "")):
        # The windows that are asked for, on both sides of their join, and the spans.
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3
