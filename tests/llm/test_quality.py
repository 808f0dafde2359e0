import numpy as np

from strandex.llm import quality, registry


def test_isotonic_is_the_nearest_rising_sequence():
    assert quality.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.0, 2.5, 2.5, 4.0]
    assert quality.isotonic(np.array([5.0, 1.0]), np.array([1.0, 3.0])).tolist() == [2.0, 2.0]
    assert quality.isotonic(np.zeros(0), np.zeros(0)).tolist() == []


def test_partition_sums_equal_a_direct_solution(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(quality.STATISTICS)))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(int)
    stats = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "doc_id long, stats array<double>").repartition(40)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality.train_quality(stats, labels, features=64)
    z = model.lift(x)
    want = np.linalg.solve(z.T @ z + 1e-3 * 600 * np.eye(65) / 65, z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)
    scores = model.score(x)
    assert ((scores >= 0.5) == y).mean() > 0.8 and (np.diff(scores[np.argsort(model.raw(x), kind="stable")]) >= 0).all()


def test_edge_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (2, ""), (3, "a" * 200000), (None, "b c"), (4, "x")]
    stats = quality.document_statistics(make_docs(rows))
    assert stats.count() == 6 and np.isfinite([r.stats for r in stats.collect()]).all()
    model = quality.train_quality(stats, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score_quality(stats, model).collect()} == {0.5}
    assert quality.score_quality(quality.document_statistics(make_docs([])), model).collect() == []


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in registry.op5_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert np.mean([got[i].predicted == y for i, y in labels.items() if got[i].held_out]) > 0.9
