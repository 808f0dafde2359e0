import random

import pytest

from strandex.llm import tokens

sentencepiece = pytest.importorskip("sentencepiece")
vocabularies = pytest.importorskip("public_tokenizers")
MODEL = str(vocabularies.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _texts():
    rnd = random.Random(3)
    alphabet = ["the ", "of ", "é", "中文", "a", " ", "  ", "\n", "\t", "𝄞", "▁", "<s>", "tion", "ing ", "!!!", "0", "\x00"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 600))) for _ in range(120)]


def test_long_texts_splice_to_the_whole_encoding(model):
    counter = tokens.PieceCounter(MODEL, chunk_chars=64, overlap_chars=8)
    for text in _texts():
        assert counter.encode_long(text) == model.encode(text), text


def test_overlap_widens_where_no_boundary_is_stable(model):
    counter = tokens.PieceCounter(MODEL, chunk_chars=50, overlap_chars=4)
    for text in ("a" * 700, "=" * 1000, " " * 500, "ab" * 300 + " the end"):
        assert counter.encode_long(text) == model.encode(text)
    assert counter.widened > 0


def test_counts_of_all_rows(spark, make_docs, corpus, model):
    rows = [*corpus, (1, corpus[1][1]), (None, "no id")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(make_docs(rows), MODEL, limit=100, chunk_chars=200, overlap_chars=16).collect())
    want = sorted((i if i is not None else -1, len((t or "").encode()), n := len(model.encode(t or "")), n > 100) for i, t in rows)
    assert got == want


def test_ids_and_empty_table(make_docs, model):
    (row,) = tokens.count_tokens(make_docs([(1, "the end of it")]), MODEL, with_ids=True).collect()
    assert row.ids == model.encode("the end of it")
    assert tokens.count_tokens(make_docs([]), MODEL).collect() == []
