"""Quality by random Fourier features, ridge regression and isotonic calibration.

Each document is described by a vector of statistics of its whole text. Standardised
(means and deviations over all documents) and clipped, the vector is lifted by random
Fourier features, which approximate a Gaussian kernel; each partition sums its part of
the normal equations, the parts are added in a tree, and the ridge solution gives raw
scores. Isotonic regression over a fixed number of score bins turns these into
probabilities; the bins are filled from all training rows, each scored by weights that were
fitted without its fold.

Defined results: a null or empty text has the statistics of an empty text and is scored
like any other; rows without label or doc_id train nothing; repeated rows score alike;
rows that repeat a labelled doc_id train as one; without training rows every score is 0.5; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.llm import _bytes as B
from strandex.llm._store import persist

#: Statistics of a text, in the order of its vector.
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "long_words", "short_words", "upper", "digits", "punctuation", "symbols", "bars",
    "bangs", "spaces", "non_ascii", "distinct_words", "repeated_lines", "word_end_mark", "byte_entropy", "words_per_line", "line_spread",
)


def _mask(chars: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT, _HIGH = _mask(range(65, 91)), _mask(range(48, 58)), _mask(range(128, 256))
_LETTER = _mask([*range(65, 91), *range(97, 123), *range(128, 256)])
_POINT = _mask(map(ord, ".,;:?\"'()-"))
_SYMBOL = _mask(map(ord, "#$%&*+/<=>@[\\]^_`{}~"))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[data])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    at, to, before = B.words(data, offsets)
    rows, length = B.row_of(before), (to - at).astype(float)
    count = np.diff(before).astype(float)
    some = np.maximum(count, 1)
    per_row = lambda x: np.bincount(rows, x, n)
    hashes = B.run_hashes(data, at, to)

    def distinct(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, owner))
        o, v = owner[order], values[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
        return np.bincount(o[new], minlength=n).astype(float)

    l_at, l_to, l_before = B.runs(data != 10, offsets)
    l_rows, lines = B.row_of(l_before), np.diff(l_before).astype(float)
    some_lines = np.maximum(lines, 1)
    l_size = (l_to - l_at).astype(float)
    l_mean = np.bincount(l_rows, l_size, n) / some_lines
    spread = np.sqrt(np.maximum(np.bincount(l_rows, l_size**2, n) / some_lines - l_mean**2, 0))
    entropy = np.zeros(n)
    for i in range(n):
        p = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
        p = p[p > 0] / size[i]
        entropy[i] = -(p * np.log2(p)).sum()
    marked = ~_LETTER[data[to - 1]] & ~_POINT[data[to - 1]] if len(to) else np.zeros(0)
    return np.stack(
        [
            np.log1p(np.diff(offsets)), np.log1p(count), np.log1p(lines), per_row(length) / some, per_row(length > 12) / some, per_row(length <= 3) / some, share(_UPPER),
            share(_DIGIT), share(_POINT), share(_SYMBOL), share(_mask([ord("|")])), share(_mask([ord("!")])), share(B.SPACE), share(_HIGH), distinct(rows, hashes) / some,
            1 - distinct(l_rows, B.run_hashes(data, l_at, l_to)) / some_lines, per_row(marked) / some, entropy, np.log1p(count / some_lines), np.log1p(spread),
        ],
        1,
    )


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and stats, the vector of STATISTICS of the whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.string_buffer(batch.column(1))
            found = [statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in B.slices(offsets)]
            flat = np.concatenate(found).ravel() if found else np.zeros(0)
            where = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(where, pa.array(flat))], ["doc_id", "stats"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class QualityModel:
    """Scaling, random features, ridge weights and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def lift(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -4, 4)
        z = np.cos(x @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([z, np.ones((len(x), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.levels)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to value: pool adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            w = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, len(STATISTICS)))


def train_quality(stats: DataFrame, labels: DataFrame, *, usable: Column | None = None, label_col: str = "quality", features: int = 256, ridge: float = 1e-3, bins: int = 1024, folds: int = 3, seed: int = 7) -> QualityModel:
    """Fit on every usable labelled row; what reaches the driver has the size of the model, not of the data."""
    size = len(STATISTICS)
    moments = stats.select([F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(size)] + [F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(size)]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(size)])
    scale = np.array([moments[f"s{i}"] or 0.0 for i in range(size)])
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / np.sqrt(size), (size, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    given = labels.filter(usable) if usable is not None else labels
    given = given.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).filter("doc_id is not null and label in (0, 1)")
    # One row for each labelled document, so that a repeated document weighs no more than others.
    joined = stats.join(given.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id")
    single = joined.groupBy("doc_id").agg(F.min("stats").alias("stats"), F.max("label").alias("label"))
    rows = persist(single.select("stats", "label", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold")), "quality-train")
    width = features + 1

    def sums(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((folds, width, width + 1))
        for frame in frames:
            x, fold = model.lift(_stack(frame["stats"])), frame["fold"].to_numpy()
            both = np.concatenate([x, frame["label"].to_numpy()[:, None]], 1)
            for f in range(folds):
                total[f] += x[fold == f].T @ both[fold == f]
        yield pd.DataFrame({"part": [int(rng_part())], "sums": [total.tobytes()]})

    def rng_part() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in frame["sums"])
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // 16], "sums": [total.tobytes()]})

    parts = rows.rdd.getNumPartitions()
    level = rows.mapInPandas(sums, "part long, sums binary")
    while parts > 16:  # a tree: 16 blocks at most meet in a task
        level = level.groupBy(F.expr("part div 16").alias("_group")).applyInPandas(add, "part long, sums binary")
        parts = -(-parts // 16)
    by_fold = sum((np.frombuffer(r["sums"]).reshape(folds, width, width + 1) for r in level.collect()), np.zeros((folds, width, width + 1)))

    def solve(total: np.ndarray) -> np.ndarray:
        count = max(1.0, total[-1, width - 1])
        return np.linalg.solve(total[:, :width] + ridge * count * np.eye(width) / width, total[:, width])

    total = by_fold.sum(0)
    if not total[-1, width - 1]:
        return model
    model.weights = solve(total)
    without = np.stack([solve(total - by_fold[f]) for f in range(folds)])

    def binned(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, y, s = np.zeros(bins), np.zeros(bins), np.zeros(bins)
        for frame in frames:
            raw = (model.lift(_stack(frame["stats"])) * without[frame["fold"].to_numpy()]).sum(1)
            at = np.clip(((raw + 0.5) / 2 * bins).astype(int), 0, bins - 1)
            n += np.bincount(at, minlength=bins)
            y += np.bincount(at, frame["label"].to_numpy(), bins)
            s += np.bincount(at, raw, bins)
        i = np.flatnonzero(n)
        yield pd.DataFrame({"bin": i, "n": n[i], "y": y[i], "s": s[i]})

    histogram = rows.mapInPandas(binned, "bin long, n double, y double, s double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("s").alias("s"))
    table = histogram.orderBy("bin").toPandas()
    model.edges = (table["s"] / table["n"]).to_numpy()
    model.levels = np.clip(isotonic((table["y"] / table["n"]).to_numpy(), table["n"].to_numpy()), 0.0, 1.0)
    return model


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, raw score and calibrated score of each row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.raw(x)), pa.array(shared.value.score(x))], ["doc_id", "raw", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, raw double, score double")
