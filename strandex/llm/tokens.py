"""Token counts with overlap resynchronisation for huge documents.

A document of at most `chunk_chars` code points is encoded at once. A longer one
is cut into overlapping chunks that are encoded apart, and neighbours are spliced
at a boundary inside their overlap that

* both encodings have, and
* is proven stable: no vocabulary piece holds the two characters beside it next
  to each other, so no merge can ever cross it, whatever stands further left or
  right.

Left of such a boundary the left chunk's tokens are those of the whole text, right
of it the right chunk's are. Where an overlap has no such boundary it is doubled,
up to the rest of the document.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are
counted each; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PieceCounter:
    """Encodes texts of any length with one sentencepiece model."""

    def __init__(self, model_path: str, chunk_chars: int = 16384, overlap_chars: int = 256):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.widened = 0
        m, n = self.model, self.model.get_piece_size()
        sizes, pairs = np.zeros(n, np.int64), set()
        for i in range(n):
            if m.is_byte(i):
                sizes[i] = 1
            elif not (m.is_control(i) or m.is_unknown(i)):
                piece = m.id_to_piece(i).replace("▁", " ")
                sizes[i] = len(piece.encode())
                pairs.update(map("".join, zip(piece, piece[1:])))
        self.sizes, self.pairs = sizes, pairs

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def _starts(self, text: str, ids: list[int]) -> np.ndarray:
        """Byte offset at which each token of an encoded text begins."""
        ends = np.cumsum(self.sizes[np.asarray(ids, np.int64)]) - 1  # the added first space is not in the text
        if not len(ids) or ends[-1] != len(text.encode()):  # a literal U+2581: take the library's own offsets
            return np.array([p.begin for p in self.model.encode(text, return_type="proto").pieces], np.int64)
        return np.concatenate([[0], ends[:-1]])

    def _stable(self, text: str, lo: int, hi: int) -> list[int]:
        """Positions in (lo, hi) that no piece of the vocabulary can span."""
        part = text[lo:hi].replace("▁", " ")
        return [lo + i for i in range(1, len(part)) if part[i - 1 : i + 1] not in self.pairs]

    def _splice(self, text: str, left: tuple[int, np.ndarray], right: tuple[int, np.ndarray], hi: int) -> tuple[int, int, int] | None:
        """The last common stable boundary: (character, token of the left, token of the right)."""
        lo = right[0]
        stable = self._stable(text, lo, hi)
        ahead = len(text[left[0] : lo].encode())
        for p in reversed(stable):
            at = len(text[lo:p].encode())
            i, j = np.searchsorted(left[1], ahead + at), np.searchsorted(right[1], at)
            if i < len(left[1]) and j < len(right[1]) and left[1][i] == ahead + at and right[1][j] == at:
                return p, int(i), int(j)
        return None

    def encode_long(self, text: str) -> list[int]:
        """The ids of a whole text, from overlapping chunks."""
        n = len(text)
        if n <= self.chunk:
            return self.encode([text])[0]
        begins = list(range(0, n, self.chunk))
        ends = [min(n, b + self.chunk + self.overlap) for b in begins]
        ids = self.encode([text[b:e] for b, e in zip(begins, ends)])
        starts = [self._starts(text[b:e], x) for b, e, x in zip(begins, ends, ids)]
        out: list[int] = []
        done = 0  # tokens of the present chunk that the chunk before it has given
        for c, b in enumerate(begins):
            end, mine, at = ends[c], ids[c], starts[c]
            while True:
                if end == n:
                    return out + mine[done:]
                nxt = c + 1
                if found := self._splice(text, (b, at), (begins[nxt], starts[nxt]), min(end, ends[nxt])):
                    break
                if end >= ends[nxt]:  # the whole next chunk has none: take all of the rest with this one
                    end = n
                else:
                    end = min(n, begins[nxt] + 2 * (end - begins[nxt]))
                self.widened += 1
                mine = self.encode([text[b:end]])[0]
                at = self._starts(text[b:end], mine)
            _, i, j = found
            out += mine[done:i]
            done = j
        return out


_counters: dict[tuple, PieceCounter] = {}


def _counter(*key) -> PieceCounter:
    if key not in _counters:
        _counters[key] = PieceCounter(*key)
    return _counters[key]


def count_tokens(
    docs: DataFrame,
    model_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    chunk_chars: int = 16384,
    overlap_chars: int = 256,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_chunks and, if asked for, the ids.

    A narrow map without a shuffle: memory is one Arrow batch and one document.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int" + ", ids array<int>" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path, chunk_chars, overlap_chars)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                short = [i for i, x in enumerate(texts) if len(x) <= chunk_chars]
                ids: list[list[int]] = [[]] * len(texts)
                for i, x in zip(short, counter.encode([texts[i] for i in short])):
                    ids[i] = x
                for i in set(range(len(texts))) - set(short):
                    ids[i] = counter.encode_long(texts[i])
                n = np.array([len(x) for x in ids], np.int64)
                columns = [
                    part.column(0),
                    pa.array([len(x.encode()) for x in texts], pa.int64()),
                    pa.array(n),
                    pa.array(n > limit),
                    pa.array([max(1, -(-len(x) // chunk_chars)) for x in texts], pa.int32()),
                ]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "ids"][: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
