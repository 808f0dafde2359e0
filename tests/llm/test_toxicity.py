import inspect
import math
import random
import re
import zlib

import numpy as np

from strandex.llm import _bytes as B
from strandex.llm import registry, toxicity

BAD = ["grob", "zutt", "mirk"]


def _bags(n, seed=2):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "of", "the", "in"]
    docs, labels = [], []
    for i in range(n):
        sentences = [[rnd.choice(words) for _ in range(rnd.randint(3, 9))] for _ in range(rnd.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            rnd.choice(sentences).insert(1, rnd.choice(BAD))
        docs.append((i, ". ".join(" ".join(s) for s in sentences) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learns_words_and_names_sentences(spark, make_docs):
    docs, labels = _bags(400)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    train = table.filter("doc_id < 300")
    model = toxicity.train_toxicity(make_docs(docs), train)
    rows = {r.doc_id: r for r in toxicity.score_toxicity(make_docs(docs), model).collect()}
    right = [(rows[i].score >= 0.5) == bool(y) for i, y in labels[300:]]
    assert np.mean(right) > 0.95
    for i, text in docs[300:]:
        for s in rows[i].offending:
            assert any(b in text[s.begin : s.end] for b in BAD) and "." not in text[s.begin : s.end]


def _noisy_or(text, model):
    """The score by definition: a sentence at a time, a word at a time."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    shift = 64 - int(math.log2(len(model.weights)))

    def hashed(word):
        return B.run_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))

    clean = 1 - model.leak
    for sentence in re.split(rb"[.!?\n]+", low):
        if not sentence:
            continue
        features = set()
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", sentence):
            features.add(int(hashed(word)[0]) >> shift)
            if len(word) > toxicity.STEM:
                features.add(int(B.mix(hashed(word[: toxicity.STEM]) + B.U64(1))[0]) >> shift)
        z = model.bias + sum(float(model.weights[f]) for f in features)
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_scores_are_noisy_or_of_sentences(spark, make_docs):
    docs, labels = _bags(300)
    model = toxicity.train_toxicity(make_docs(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.weights.any()
    extra = [(901, None), (902, ""), (903, "...!?\n"), (904, "Grob grob GROB! grobian zutt"), (905, "épsilon zutt. mirk\nmirk alphabeta")]
    texts = dict([*docs, *extra])
    for r in toxicity.score_toxicity(make_docs([*docs, *extra]), model).collect():
        assert abs(r.score - _noisy_or(texts[r.doc_id], model)) < 1e-9


def test_driver_gets_less_than_500_mb():
    given = {k: p.default for k, p in inspect.signature(toxicity.train_toxicity).parameters.items()}
    assert 2 * given["max_per_class"] * given["max_bytes"] < 500_000_000


def test_edge_rows_and_no_labels(spark, make_docs):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [(1, None), (2, ""), (3, "x " * 50000), (3, "x " * 50000), (None, "y.")]
    model = toxicity.train_toxicity(make_docs(rows), empty)
    got = toxicity.score_toxicity(make_docs(rows), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and not any(r.offending for r in got)
    assert toxicity.score_toxicity(make_docs([]), model).collect() == []
    kept = toxicity.score_toxicity(make_docs(rows), model, keep=True)
    assert kept.columns[:8] == make_docs(rows).columns and kept.count() == 5
    clash = make_docs(rows).withColumnsRenamed({"kept": "_score", "place": "_offending"})
    assert toxicity.score_toxicity(clash, model, keep=True).columns == [*clash.columns, "_score_", "_offending_"]
    assert toxicity.without_toxic(clash, model).columns == clash.columns and toxicity.without_toxic(clash, model).count() == 5


def test_repeated_and_very_long_rows_train_once_or_not_at_all(spark, make_docs):
    docs, labels = _bags(200)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    plain = toxicity.train_toxicity(make_docs(docs), table)
    many = toxicity.train_toxicity(make_docs([*docs, *[docs[0]] * 50]), table)
    assert (plain.weights == many.weights).all() and plain.bias == many.bias
    assert not toxicity.train_toxicity(make_docs(docs), table, max_bytes=1).weights.any()


def test_query_folds_and_held_out_accuracy(spark):
    got = {r.doc_id: r for r in registry.op3_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.9
