"""Token counts of whole texts, huge ones by overlapping chunks that are spliced together.

A chunk is encoded with its offsets. Neighbouring chunks overlap, and are spliced at a position that
starts a token in both and that is stable: no piece of the vocabulary has the characters before and behind it side by
side (with the word mark for a space), so no merge ever crosses the position and what stands on one side can't change the other. Stable positions are
found in one pass over the text. An overlap reaches back to the last one; a chunk without any goes on to the next, so that a stretch without
one is encoded once; and where the two sides don't align, the overlap is widened. The time is linear in the text.

Edge cases: null and empty texts have 0 tokens (the library adds none); repeated rows and repeated
or null doc_ids are rows of their own; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, pieces, table, texts

#: The word mark of the library, a fixed value.
MARK = "▁"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts the tokens of texts. ``chunk`` and ``overlap`` are in bytes."""

    def __init__(self, model: bytes, chunk: int = 32_768, overlap: int = 256):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        pairs = {(a, b) for p in map(self.sp.id_to_piece, range(self.sp.get_piece_size())) for a, b in zip(p, p[1:])}
        #: Characters that stand side by side in some piece, as one number each.
        self.pairs = np.array(sorted({ord(a) << 21 | ord(b) for a, b in pairs}), np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        small = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        for i, ids in zip(small, self.sp.encode([texts[i] for i in small], num_threads=1)):
            out[i] = len(ids)
        for i in set(range(len(texts))) - set(small):
            out[i] = self.long(texts[i])
        return out

    def stable(self, text: str) -> np.ndarray:
        """Byte offsets of the stable positions, ascending."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        code[code == 32] = ord(MARK)
        pair = code[:-1] << 21 | code[1:]
        near = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)]
        return np.cumsum(size)[:-1][near != pair]

    def begins(self, raw: bytes, a: int, b: int) -> np.ndarray:
        """Offsets in the whole text at which the tokens of raw[a:b] begin."""
        return np.array([p.begin for p in self.sp.encode(raw[a:b].decode(), return_type="proto").pieces], np.int64) + a

    @staticmethod
    def whole(raw: bytes, p: int) -> int:
        """p, or the next lower offset at which a character starts."""
        while 0 < p < len(raw) and raw[p] & 0xC0 == 0x80:
            p -= 1
        return p

    def long(self, text: str) -> int:
        if self.sp.normalize(text) != MARK + text.replace(" ", MARK):  # the library changes more than spaces
            return len(self.sp.encode(text))
        raw, stable = text.encode(), self.stable(text)
        total, start, base, end, overlap = 0, 0, 0, self.whole(raw, self.chunk), self.overlap
        left = None
        while end < len(raw):
            low, high = np.searchsorted(stable, start, side="right"), np.searchsorted(stable, end)
            if low == high:  # none since the last splice: go on to the next
                end = self.whole(raw, min(len(raw), int(stable[high]) + overlap)) if high < len(stable) else len(raw)
                left = None
                continue
            left = self.begins(raw, base, end) if left is None else left
            at = self.whole(raw, max(0, int(stable[high - 1]) - overlap))
            upto = self.whole(raw, min(len(raw), end + self.chunk))
            right = self.begins(raw, at, upto)
            both = np.intersect1d(np.intersect1d(left, right), stable[low:high])
            both = both[both > at]
            if not len(both):
                if at == 0:  # both begin with the text: take them together
                    end, left = upto, None
                overlap *= 2
                continue
            p = int(both[-1])
            total += int(np.count_nonzero((left >= start) & (left < p)))
            start, base, end, left, overlap = p, at, upto, right, self.overlap
        left = self.begins(raw, base, len(raw)) if left is None else left
        return total + int(np.count_nonzero(left >= start))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = 32_768, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. The model travels with the tasks; executors need no file."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model, chunk, overlap)
        for b in pieces(batches):
            n = counter.counts(b.column("text").to_pylist())
            sizes = pa.compute.binary_length(b.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
