"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

Every word has a sparse ternary index vector drawn from its hash; its word vector adds the index
vectors of its neighbours in the training texts, by hashed word. A document is the mean of
its words' vectors, the mean of its words' shape vectors (case, marks, digits, length, whether it
repeats the word before or a recent one) and a few pooled measures. The network is trained with numpy
on a bounded sample of labelled rows; a temperature fitted on rows kept from training calibrates
its probabilities.

The sample bound is ``max_rows`` documents of at most ``max_chars`` characters, those with the
smallest hashes; it limits fitting only. Every document is scored whole.

Edge cases: null and empty texts get the score of an all-zero vector; labels that are null are no
labels; without both labels among the training rows the score is the prior of the one there is (0.5
of none); repeated rows and repeated or null doc_ids are rows of their own, a null one not held out;
an empty table gives no rows. doc_id, lang, source and labels are never inputs of a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, is_space, mix64, pieces, span_hashes, table, texts, word_spans

DIM, BUCKETS, HIDDEN = 48, 1 << 15, 32
SHAPES = 1 << 12


def ternary(n: int, seed: int, dim: int = DIM) -> np.ndarray:
    """Sparse index vectors: about a sixth of the components is +1 or -1."""
    h = mix64(np.arange(n * dim, dtype=np.uint64) + np.uint64(seed << 40)) % np.uint64(12)
    return ((h == 0).astype(np.float32) - (h == 1).astype(np.float32)).reshape(n, dim)


def analysed(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, buckets of their shapes, and measures of the whole text."""
    b = np.frombuffer(raw.lower(), np.uint8)
    cased = np.frombuffer(raw, np.uint8)
    s, e = word_spans(b)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(8, np.float32)
    h = span_hashes(b, s, e)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    sums = lambda m: np.add.reduceat(np.append(m, False).astype(np.int64), np.column_stack([s, e]).ravel())[::2]
    size = e - s
    upper, digit = sums((cased >= 65) & (cased <= 90)), sums((b >= 48) & (b <= 57))
    marks = size - sums(letter) - digit
    tail = np.where(letter[e - 1], 0, b[e - 1] % 64)
    same = np.concatenate([[False], h[1:] == h[:-1]])
    order = np.argsort(h, kind="stable")
    ago = np.full(len(h), 1 << 30)
    again = h[order][1:] == h[order][:-1]
    ago[order[1:][again]] = np.diff(order)[again]
    shape = tail.astype(np.uint64)
    for part, most in ((upper, 3), (digit, 3), (marks, 5), (size // 3, 7), (same, 1), (ago < 64, 1)):
        shape = shape * np.uint64(most + 1) + np.minimum(part, most).astype(np.uint64)
    n = len(s)
    lines = raw.split(b"\n")
    whole = np.array([
        np.log1p(n) / 10, same.mean(), (ago < 64).mean(), len(set(lines)) / len(lines), upper.sum() / len(raw) * 4,
        marks.sum() / len(raw) * 4, digit.sum() / len(raw) * 4, np.count_nonzero(is_space(b)) / len(raw),
    ], np.float32)
    return (h % np.uint64(BUCKETS)).astype(np.int64), (mix64(shape) % np.uint64(SHAPES)).astype(np.int64), whole


def pooled(raw: bytes, vectors: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The document's vector."""
    w, s, whole = analysed(raw)
    out = np.zeros(2 * DIM + len(whole), np.float32)
    if len(w):
        for a in range(0, len(w), 65_536):
            out[:DIM] += vectors[w[a : a + 65_536]].sum(axis=0)
            out[DIM : 2 * DIM] += shapes[s[a : a + 65_536]].sum(axis=0)
        out[: 2 * DIM] /= len(w)
    out[2 * DIM :] = whole
    return out


def word_vectors(texts: list[bytes], window: int = 2) -> np.ndarray:
    """Index vectors plus the weighted sum of the index vectors seen within ``window`` words."""
    index = ternary(BUCKETS, 1)
    seen, times = np.zeros_like(index), np.zeros(BUCKETS, np.float32)
    gap = np.full(window, -1)  # between texts, so that no neighbours cross
    words = np.concatenate([np.concatenate([analysed(raw)[0], gap]) for raw in texts] or [gap])
    for a in range(0, len(words), 200_000):
        part = words[a : a + 200_000 + window]
        for d in range(1, window + 1):
            for at, near in ((part[:-d], part[d:]), (part[d:], part[:-d])):
                both = (at >= 0) & (near >= 0)
                at, near = at[both], near[both]
                if len(at):
                    order = np.argsort(at, kind="stable")
                    names, first = np.unique(at[order], return_index=True)
                    seen[names] += np.add.reduceat(index[near[order]], first)
                    times += np.bincount(at, minlength=BUCKETS)
    return index + seen / np.sqrt(1 + times)[:, None]


class Network:
    """Two layers, trained by Adam on cross-entropy with a little weight decay."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 60, batch: int = 64):
        rng = np.random.default_rng(seed)
        self.temperature, self.prior = 1.0, float(y.mean()) if len(y) else 0.5
        self.w = None
        if len(np.unique(y)) < 2:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        keep = rng.permutation(len(y))
        aside = keep[: max(1, len(y) // 6)]
        keep = keep[len(aside) :]
        w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(max(epochs, min(400, 60_000 // len(keep)))):
            for rows in np.array_split(rng.permutation(keep), max(1, len(keep) // batch)):
                a, hid = z[rows], None
                hid = np.maximum(a @ w[0] + w[1], 0)
                d = (1 / (1 + np.exp(-np.clip(hid @ w[2] + w[3], -30, 30))) - y[rows]) / len(rows)
                back = np.outer(d, w[2]) * (hid > 0)
                grads = [a.T @ back + 2e-4 * w[0], back.sum(0), hid.T @ d + 2e-4 * w[2], d.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w = w
        logits = self.logits(x[aside])
        loss = lambda temp: -np.mean(y[aside] * np.log(self.squash(logits / temp)) + (1 - y[aside]) * np.log(1 - self.squash(logits / temp)))
        self.temperature = float(min(np.geomspace(0.5, 8, 49), key=loss))

    @staticmethod
    def squash(x: np.ndarray) -> np.ndarray:
        return np.clip(1 / (1 + np.exp(-np.clip(x, -30, 30))), 1e-6, 1 - 1e-6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.prior)
        return self.squash(self.logits(x) / self.temperature)


def crc_rest(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def sample(docs: DataFrame, labels: DataFrame, label: str, fit_on, max_rows: int, max_chars: int | None = None) -> DataFrame:
    """text and label of the bounded training sample: the ``max_rows`` ids with the smallest hashes."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fit_on).select("doc_id", F.col(label).cast("double").alias("label"))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    out = texts(docs).join(F.broadcast(rows), "doc_id")  # at most max_rows rows of two numbers
    return out.where(F.length("text") <= max_chars) if max_chars else out


def fitted(raw: list[bytes], y: np.ndarray) -> bytes:
    """The model of these texts and labels, pickled as plain data."""
    vectors, shapes = word_vectors(raw).astype(np.float32), ternary(SHAPES, 2)
    x = np.array([pooled(r, vectors, shapes) for r in raw]) if raw else np.zeros((0, 2 * DIM + 8))
    return pickle.dumps((vectors, shapes, vars(Network(x, y))))


def fit(docs: DataFrame, labels: DataFrame, fit_on=None, max_rows: int = 4000, max_chars: int = 20_000) -> bytes:
    """The model, fitted in one task on the bounded sample, so that the driver holds only its BUCKETS rows."""
    fit_on = F.lit(True) if fit_on is None else fit_on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            rows = pa.Table.from_batches(got).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            raw = [x.encode() for x in rows.column("text").to_pylist()[:max_rows]]
            yield pa.RecordBatch.from_pydict({"model": [fitted(raw, rows.column("label").to_numpy()[: len(raw)])]})

    some = sample(docs, labels, "quality", fit_on, max_rows, max_chars).select("doc_id", "text", "label").repartition(1)
    model = arrow_map(some, run, "model binary").first()
    return bytes(model[0]) if model else fitted([], np.zeros(0))


def unpickled(box) -> tuple[np.ndarray, np.ndarray, Network]:
    vectors, shapes, state = pickle.loads(box.value)
    net = Network.__new__(Network)
    vars(net).update(state)
    return vectors, shapes, net


def quality_scores(docs: DataFrame, labels: DataFrame, fit_on=None, max_rows: int = 4000) -> DataFrame:
    """doc_id and score for every document, by a model fitted where ``fit_on`` holds."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_on, max_rows))  # a fixed size: BUCKETS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, shapes, net = unpickled(model)
        for b in pieces(batches):
            x = np.array([pooled(t.as_py().encode(), vectors, shapes) for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(net.score(x))], names=["doc_id", "score"])

    return arrow_map(texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.coalesce(crc_rest(4) == 2, F.lit(False))
    scored = quality_scores(docs, labels, crc_rest(4) != 2)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train: DataFrame | None = None) -> DataFrame:
    """The documents that the classifier, fitted on ``train`` (docs), does not reject, with the columns they came with."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if train is None else train, labels))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, shapes, net = unpickled(model)
        for b in pieces(batches):
            x = np.array([pooled((t.as_py() or "").encode(), vectors, shapes) for t in b.column("text")])
            yield b.filter(pa.array(net.score(x) >= threshold)).select(columns)

    return docs.mapInArrow(run, docs.schema)
