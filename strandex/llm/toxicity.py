"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence s has p(s) = sigmoid(b + sum of the
weights of its word features), and the bag is toxic with

    P = 1 - (1 - leak) * product over s of (1 - p(s))        (noisy-or with a leak)

Only documents have labels; the gradient of the bag likelihood reaches the sentences,
so that the sentences which explain the label can be named afterwards. The leak takes
up labels that no sentence explains.

Training reads a bounded sample (at most `max_per_class` labelled documents of either label,
lowest hashes first, weighted back to the true shares, none of more than `max_bytes`, so that the driver
gets 2 * 3000 * 64 KiB = 375 MiB at the very most); of rows that repeat a doc_id one trains. Scoring is one narrow map over whole texts with a weight table of fixed size.

Defined results: a null or empty text has no sentences and scores the leak; rows without
label or doc_id train nothing; repeated rows score alike; without labels of both kinds the
weights stay 0; an empty table gives no rows; other columns are ignored or, with `keep` and in
`without_toxic`, returned as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.llm import _bytes as B
from strandex.llm._store import column

#: Bytes of a word feature: letters, digits and all of a multi-byte character.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
#: Bytes of a longer word that are a feature of their own.
STEM = 6
#: Bytes that end a sentence.
_STOP = np.zeros(256, bool)
_STOP[[ord(x) for x in ".!?\n"]] = True


@dataclass
class ToxicityModel:
    """Weights by hashed word, the sentences' bias and the bags' leak."""

    weights: np.ndarray
    bias: float
    leak: float


def _features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence bounds, sentences before each row, and the sentence and hash of each feature: words, and the first 6 bytes of longer words."""
    low = B.LOWER[data]
    s_at, s_to, s_before = B.runs(~_STOP[low], offsets)
    w_at, w_to, _ = B.runs(_WORD[low] & ~_STOP[low], offsets)
    sentence = np.searchsorted(s_at, w_at, "right") - 1
    whole, long = B.run_hashes(low, w_at, w_to), w_to - w_at > STEM
    stems = B.mix(B.run_hashes(low, w_at[long], w_at[long] + STEM) + B.U64(1))
    feature = (np.concatenate([whole, stems]) >> B.U64(64 - bits)).astype(np.int64)
    return s_at, s_to, s_before, np.concatenate([sentence, sentence[long]]), feature


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit_bags(texts: pa.Array, labels: np.ndarray, weight: np.ndarray, bits: int, steps: int = 400) -> ToxicityModel:
    """Adam on the bag likelihood over the words whose document frequency differs between the labels."""
    model = ToxicityModel(np.zeros(1 << bits, np.float32), -12.0, 0.0)
    positive = labels == 1
    total = weight.sum()
    if len(labels):
        model.leak = float(np.clip((weight * positive).sum() / total, 1e-4, 0.9))
    if not positive.any() or positive.all():
        return model
    data, offsets = B.string_buffer(texts)
    rows, words, sentence_rows, at = [], [], [], 0
    for lo, hi in B.slices(offsets):
        o = offsets[lo : hi + 1]
        _, _, before, sentence, feature = _features(data[o[0] : o[-1]], o - o[0], bits)
        rows.append(lo + B.row_of(before))
        words.append(np.unique(np.stack([sentence + at, feature], 1), axis=0))
        at += before[-1]
    sentence_rows = np.concatenate(rows)
    pairs = np.concatenate(words)
    in_doc = np.unique(np.stack([sentence_rows[pairs[:, 0]], pairs[:, 1]], 1), axis=0)
    df1 = np.bincount(in_doc[:, 1], positive[in_doc[:, 0]], 1 << bits)
    df0 = np.bincount(in_doc[:, 1], ~positive[in_doc[:, 0]], 1 << bits)
    n1, n0 = positive.sum(), (~positive).sum()
    share = (df1 + df0) / (n1 + n0)
    z = (df1 / n1 - df0 / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    # A word is kept if chance alone gives such a difference to less than one of all words.
    kept = np.flatnonzero((np.abs(z) > 4.2) & (df1 + df0 >= 4))
    if not len(kept):
        return model
    number = np.full(1 << bits, -1)
    number[kept] = np.arange(len(kept))
    pairs = pairs[number[pairs[:, 1]] >= 0]
    s, f = pairs[:, 0], number[pairs[:, 1]]
    y, share_y = positive.astype(float), weight / total
    theta = np.zeros(len(kept) + 2)
    theta[-2], theta[-1] = -7.0, np.log(model.leak / 2 / (1 - model.leak / 2))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n_sentences, n_docs = len(sentence_rows), len(labels)
    for t in range(1, steps + 1):
        score = theta[-2] + np.bincount(s, theta[f], n_sentences)
        p = 1 / (1 + np.exp(-np.clip(score, -60, 60)))
        clean = np.bincount(sentence_rows, _softplus(score), n_docs) + _softplus(theta[-1])  # -log(1 - P)
        ratio = np.where(y > 0, 1 / np.maximum(np.expm1(np.minimum(clean, 60)), 1e-9), -1.0) * share_y
        d_score = -p * ratio[sentence_rows]
        grad = np.concatenate([np.bincount(f, d_score[s], len(kept)), [d_score.sum(), -(ratio.sum()) / (1 + np.exp(-theta[-1]))]])
        grad[:-2] += 1e-4 * theta[:-2]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    model.weights[kept] = theta[:-2]
    model.bias, model.leak = float(theta[-2]), float(1 / (1 + np.exp(-theta[-1])))
    return model


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_per_class: int = 3000,
    max_bytes: int = 1 << 16,
    bits: int = 18,
) -> ToxicityModel:
    """Fit on at most max_per_class labelled documents of either label, of at most max_bytes each.

    usable: a condition on the label rows, as a column over id_col and label_col.
    The sample is chosen on the narrow label table and its ids, bounded by
    2 * max_per_class, are broadcast, so that no text is shuffled.
    """
    chosen = labels.filter(usable) if usable is not None else labels
    chosen = chosen.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label"))
    shares = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sample = None
    for label in (0, 1):
        part = chosen.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(max_per_class)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    # Rows that repeat a doc_id are one before any is collected; which, their texts' hashes decide.
    short = texts.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    single = short.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    table = single.select("label", "id", "text").toArrow()
    table = table.take(pa.array(np.argsort(table["id"].to_numpy(), kind="stable")))  # by id, so that reruns add in the same order
    label = table["label"].to_numpy().astype(int)
    taken = np.maximum(np.bincount(label, minlength=2), 1)
    weight = np.array([shares.get(0, 0) / taken[0], shares.get(1, 0) / taken[1]])[label]
    return fit_bags(table["text"], label, weight, bits)


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_toxic(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, in all their columns, whose score is below the threshold."""
    scored = score_toxicity(docs, model, id_col=id_col, text_col=text_col, keep=True)
    return scored.filter(column(scored.columns[-2]) < threshold).select(*map(column, docs.columns))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, n_sentences and the offending sentences (code points [begin, end), score) of each document.

    keep: give the columns of docs instead, with these beside them under the names
    _score and _offending, to which underscores are added while docs has such a column.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    bits = int(np.log2(len(model.weights)))
    offending = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def score(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        m = shared.value
        data, offsets = B.string_buffer(texts)
        scores, counts, found = [], [], []
        for lo, hi in B.slices(offsets):
            o = offsets[lo : hi + 1] - offsets[lo]
            part = data[offsets[lo] : offsets[hi]]
            s_at, s_to, before, sentence, feature = _features(part, o, bits)
            hit = np.flatnonzero(m.weights[feature])
            if len(hit):  # a word counts once in a sentence
                hit = hit[np.unique(np.stack([sentence[hit], feature[hit]], 1), axis=0, return_index=True)[1]]
            z = m.bias + np.bincount(sentence[hit], m.weights[feature[hit]].astype(float), len(s_at))
            rows = B.row_of(before)
            clean = np.bincount(rows, _softplus(z), hi - lo) - np.log1p(-m.leak)
            scores.append(-np.expm1(-clean))
            counts.append(np.diff(before))
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            bad = np.flatnonzero(p >= threshold)
            of = [[] for _ in range(hi - lo)]
            if len(bad):
                points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                for i in bad:
                    first = points[o[rows[i]]]
                    of[rows[i]].append({"begin": int(points[s_at[i]] - first), "end": int(points[s_to[i]] - first), "score": float(p[i])})
            found += of
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.array(join(scores, float)), pa.array(join(counts, np.int64)), pa.array(found, offending)

    if keep:
        from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

        span = StructType().add("begin", IntegerType()).add("end", IntegerType()).add("score", DoubleType())
        at = docs.columns.index(text_col)
        names = [free_name(docs.columns, c) for c in ("_score", "_offending")]
        schema = StructType(list(docs.schema.fields)).add(names[0], DoubleType()).add(names[1], ArrayType(span))

        def widen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s, _, spans = score(batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, s, spans], schema.fieldNames())

        # mapInArrow looks columns up by name, dots and all.
        return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(widen, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *score(batch.column(1))], ["doc_id", "score", "n_sentences", "offending"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_sentences long, offending array<struct<begin:int,end:int,score:double>>")
