"""Document fingerprints by consistent weighted sampling.

Terms are shingles of five words, weighted by how often the document has them. For each of ``SLOTS``
slots, a term's hash gives the quantiles of two Gamma(2, 1) variables r and c and a uniform b; with
t = floor(ln(weight) / r + b) the term's key is ln c - r (t - b) - r, and the slot keeps a digest of
the (term, t) with the least key. Two documents agree in a slot with a probability equal to their
generalised Jaccard similarity, up to digest collisions at 2**-15.

Edge cases: null text is empty; fewer than five words are one term; a text without words has a
fingerprint of its own kind, like only to itself; repeated rows and repeated or null doc_ids are rows
of their own (ordered by text where doc_ids are equal, null doc_ids last); an empty table gives no rows;
other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import mix64, pieces, span_hashes, table, texts, word_spans

SLOTS, SHINGLE = 64, 5
LEVELS = 1 << 14
GAMMA: dict[str, np.ndarray] = {}


def gamma_quantiles() -> dict[str, np.ndarray]:
    """Mid-level quantiles of Gamma(2, 1), where P(x) = 1 - (1 + x) exp(-x), by bisection; and their logs."""
    if not GAMMA:
        p = (np.arange(LEVELS) + 0.5) / LEVELS
        low, high = np.zeros(LEVELS), np.full(LEVELS, 60.0)
        for _ in range(70):
            mid = (low + high) / 2
            small = 1 - (1 + mid) * np.exp(-mid) < p
            low, high = np.where(small, mid, low), np.where(small, high, mid)
        GAMMA["r"] = low.astype(np.float32)
        GAMMA["ln"] = np.log(low).astype(np.float32)
        GAMMA["slot"] = mix64(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return GAMMA


def terms(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's word shingles, in order."""
    b = np.frombuffer(raw, np.uint8)
    s, e = word_spans(b)
    if not len(s):
        return np.zeros(0, np.uint64)
    w = span_hashes(b, s, e)
    k = min(shingle, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + w[i : len(w) - k + 1 + i])
    return out


def draws(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of each term (rows) in each slot (columns)."""
    g = gamma_quantiles()
    x = h[:, None] ^ g["slot"][None, :]
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    top = (x >> np.uint64(32)).astype(np.uint32)
    r, lnc = g["r"][top >> np.uint32(18)], g["ln"][(top >> np.uint32(4)) & np.uint32(LEVELS - 1)]
    b = ((x >> np.uint64(12)) & np.uint64(0xFFFFF)).astype(np.uint32).astype(np.float32) * np.float32(2**-20)
    return r, lnc, b


def signatures(h: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each weight array (0: absent) over the distinct, sorted terms h: a 16-bit digest per slot."""
    best = [np.full(SLOTS, np.inf, np.float32) for _ in weights]
    which = [np.zeros(SLOTS, np.int64) for _ in weights]
    for a in range(0, len(h), 2048):
        r, lnc, b = draws(h[a : a + 2048])
        plain = lnc - r * (np.float32(1) - b)  # the key at weight 1
        for k, w in enumerate(weights):
            part = w[a : a + 2048]
            key = plain
            more = np.flatnonzero(part > 1)
            if len(more) or not part.all():
                key = plain.copy()
                if len(more):
                    t = np.floor(np.log(part[more])[:, None] / r[more] + b[more])
                    key[more] = lnc[more] - r[more] * (t - b[more]) - r[more]
                key[part == 0] = np.inf
            at = key.argmin(axis=0)
            low = key[at, np.arange(SLOTS)]
            better = low < best[k]
            best[k], which[k] = np.where(better, low, best[k]), np.where(better, at + a, which[k])
    out = []
    slots = np.arange(SLOTS)
    for k, w in enumerate(weights):
        if not w.any():
            out.append(np.full(SLOTS, 0, np.uint16))
            continue
        i = which[k]
        r, _, b = draws(h[i])
        t = np.floor(np.log(w[i].astype(np.float32)) / r[slots, slots] + b[slots, slots]).astype(np.int64)
        out.append((mix64(h[i] + t.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.uint16) | np.uint16(1))
    return out


def pair_signatures(one: bytes, two: bytes) -> list[np.ndarray]:
    """Signatures of two texts; what they share is drawn once."""
    a, b = terms(one), terms(two)
    h, at, n = np.unique(np.concatenate([a, b]), return_inverse=True, return_counts=True)
    w1 = np.bincount(at[: len(a)], minlength=len(h))
    return signatures(h, [w1, n - w1])


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.count_nonzero(x == y)) / SLOTS


def edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def one_signature(one: bytes) -> np.ndarray:
    h, n = np.unique(terms(one), return_counts=True)
    return signatures(h, [n])[0]


def seated(docs: DataFrame, rows_each: int = 256, most_ranges: int = 100_000) -> DataFrame:
    """doc_id, text, range, extra: rows dealt by ranges of doc_id, each range with the next one's first row (extra).

    Ranges have equal widths, so that none holds more ids than its width; rows without an id are the last range. The ranges
    that have rows are one row each in ``firsts``. The last is followed by the first. An id's range is found in double
    precision, where no id overflows and the order of ids is kept.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    none = F.col("doc_id").isNull()
    rows = texts(docs).withColumn("k", key)
    low, high, n = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long")), F.count("*")).first()
    low, high = (0, 0) if low is None else (low, high)
    width = max(1, -(-(high - low + 1) * max(rows_each, -(-n // most_ranges)) // max(n, 1)))
    place = F.when(none, F.lit(2**40)).otherwise(F.floor((F.col("doc_id").cast("long").cast("double") - F.lit(float(low))) / F.lit(float(width)))).cast("long")
    firsts = docs.select(key.alias("k"), place.alias("range")).groupBy("range").agg(F.min("k").alias("first"))
    every, order = Window.partitionBy(), Window.orderBy("range")
    firsts = firsts.withColumn("before", F.coalesce(F.lag("range").over(order), F.max("range").over(every)))
    firsts = F.broadcast(firsts.withColumnRenamed("range", "f_range"))  # most_ranges rows of three numbers at most
    joined = rows.withColumn("range", place).join(firsts, F.col("range") == F.col("f_range"))
    copies = F.when(F.col("k") == F.col("first"), F.array(F.struct("range", F.lit(False).alias("extra")), F.struct(F.col("before").alias("range"), F.lit(True).alias("extra")))).otherwise(
        F.array(F.struct("range", F.lit(False).alias("extra")))
    )
    out = joined.select("doc_id", "text", "k", F.explode(copies).alias("seat")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "k", "seat.range", "seat.extra")
    return out.repartition("range").sortWithinPartitions("range", "extra", "k", "text").select("doc_id", "text", "range", "extra")


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to that and to the next document."""
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = ready = None  # a row whose next is not here yet; a row whose next has no signature yet
        at = None
        out: list[list] = [[] for _ in fields]

        def finish(signature: np.ndarray) -> None:
            doc_id, text, other, sig, sig_edited = ready
            values = (doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), sig.astype(">u2").tobytes().hex(), sig_edited.astype(">u2").tobytes().hex(), likeness(sig, sig_edited), likeness(sig, signature))
            for column, value in zip(out, values):
                column.append(value)

        for b in pieces(batches):
            for doc_id, text, place, extra in zip(*(b.column(i).to_pylist() for i in range(4))):
                if place != at:
                    waiting = ready = None
                    at = place
                elif waiting is not None:
                    other = edited(waiting[1], text)
                    sig, sig_edited = pair_signatures(waiting[1].encode(), other.encode())
                    if ready is not None:
                        finish(sig)
                    ready = (*waiting, other, sig, sig_edited)
                    waiting = None
                    if extra:
                        finish(one_signature(text.encode()))
                        ready = None
                if not extra:
                    waiting = (doc_id, text)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields)], names=[n for n, _ in fields])
                out = [[] for _ in fields]

    return seated(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))
