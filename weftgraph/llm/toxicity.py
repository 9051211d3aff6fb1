"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: case, accents, look-alike letters of other scripts, zero-width characters and
digits or signs that stand for letters. The lexicon is learned from labelled rows: whole words and
word beginnings weighted by smoothed log odds. A document's hits, less those inside an exception
phrase (a lexicon word with its neighbour as only clean training documents have it), are normalised
by its length and turned into a probability by a logistic curve fitted on the training rows.

``max_rows`` bounds the training sample (the ids with the smallest hashes), and the model has 600 terms and 300 exception
phrases at most, the heaviest. Every document is scored whole.

Edge cases: null and empty texts have no hits; null labels are no labels; without both labels among
the training rows the score is 0; repeated rows and repeated or null doc_ids are rows of their own, a
null one not held out; an empty table gives no rows. lang, source, doc_id and labels are no inputs.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, pieces, shipped, table, texts, unpacked
from weftgraph.llm.quality import crc_rest, sample

# Look-alikes: letters of other scripts, and digits and signs, with the Latin letter they pass for.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ß": "ss", "ł": "l", "ø": "o", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "|": "i",
}
HIDDEN = "­​‌‍⁠﻿"
WORD = re.compile(r"[^\W_]+")
BEGINNINGS = range(4, 9)


def folding() -> dict[int, str | None]:
    """Accented and compatibility letters to plain ones by Unicode's own decompositions, then the look-alikes."""
    out: dict[int, str | None] = {}
    for a, b in ((0x80, 0x250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x2500), (0x300, 0x370)):
        for code in range(a, b):
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
            if plain != chr(code):
                out[code] = plain
    for code, plain in list(out.items()):
        out[code] = "".join(LOOKALIKES.get(c, c) for c in plain).replace("l", "i")
    out |= {ord(k): v.replace("l", "i") for k, v in LOOKALIKES.items()}
    out |= {ord(c): None for c in HIDDEN}
    out[ord("l")] = "i"  # l, 1, | and i look alike and fold together
    return out


def folded(text: str, fold: dict[int, str | None]) -> list[str]:
    s = text.lower().translate(fold)
    if "!" in s:
        s = re.sub(r"(?<=\w)!(?=\w)", "i", s)
    return WORD.findall(s)


def features(words: list[str]) -> set[str]:
    """Whole words as " word ", beginnings of longer words as " beginning"."""
    distinct = set(words)
    out = {f" {w} " for w in distinct}
    for k in BEGINNINGS:
        out.update(f" {w[:k]}" for w in distinct if len(w) > k)
    return out


class Lexicon:
    """The automaton, the exception phrases and the curve."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], curve=(0.0, 0.0, -20.0)):
        self.weights, self.exceptions, self.curve = weights, exceptions, np.array(curve)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            a.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), 0.0))
        if len(a):
            a.make_automaton()
        return a

    def hits(self, words: list[str], automaton) -> float:
        """Summed weights; of the terms that start at the same word the heaviest counts, and none inside a phrase."""
        if not len(automaton) or not words:
            return 0.0
        line = " " + " ".join(words) + " "
        best: dict[int, float] = {}
        spans: list[tuple[int, int]] = []
        for end, (size, weight) in automaton.iter(line):
            at = end - size + 1
            if weight:
                best[at] = max(weight, best.get(at, 0.0))
            else:
                spans.append((at, end))
        if spans:
            spans.sort()
            starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))  # how far the spans up to each go
            best = {at: w for at, w in best.items() if not (i := bisect_right(starts, at)) or reach[i - 1] <= at}
        return sum(best.values())

    def inputs(self, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.column_stack([np.log1p(hits), np.log1p(100 * hits / np.maximum(words, 10)), np.ones(len(hits))])

    def fit_curve(self, hits: np.ndarray, words: np.ndarray, y: np.ndarray) -> None:
        x, w = self.inputs(hits, words), np.zeros(3)
        for _ in range(60):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
            w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        self.curve = w

    def score(self, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(hits, words) @ self.curve, -30, 30)))


def counted(train: DataFrame) -> DataFrame:
    """feature, documents of either label that have it. Beginnings and words of each document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = folding()
        both = (Counter(), Counter())
        for b in pieces(batches):
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                both[label > 0.5].update(features(folded(text, fold)))
                if len(both[0]) + len(both[1]) > 1_000_000:
                    yield emit(both)
                    both[0].clear(), both[1].clear()
        yield emit(both)

    def emit(both) -> pa.RecordBatch:
        names = list(both[0] | both[1])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([both[1][n] for n in names], pa.int64()), pa.array([both[0][n] for n in names], pa.int64())], names=["f", "bad", "good"])

    return train.mapInArrow(run, "f string, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def lexicon(train: DataFrame, bad: int, good: int, size: int = 600, least: int = 3) -> dict[str, float]:
    """Terms with smoothed log odds above 1.5 and a clear excess over chance."""
    rate = (F.col("bad") + 0.5) / (bad + 1.0)
    base = (F.col("good") + 0.5) / (good + 1.0)
    odds = F.log(rate / (1 - rate)) - F.log(base / (1 - base))
    expect = (F.col("bad") + F.col("good")) * (bad / (bad + good))
    z = (F.col("bad") - expect) / F.sqrt(expect + 0.5)
    rows = counted(train).where(F.col("bad") >= least).select("f", odds.alias("w"), z.alias("z")).where("w > 1.5 AND z > 4")
    return {r.f: float(r.w) for r in rows.orderBy(F.desc("z"), "f").limit(size).collect()}


def matched(train: DataFrame, model: Lexicon) -> DataFrame:
    """label, hits, words and the phrases around hits, of each training document."""
    box = shipped(train.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, fold = unpacked(box), folding()
        auto = lex.automaton()
        for b in pieces(batches):
            hits, sizes, phrases = [], [], []
            for text in b.column("text").to_pylist():
                words = folded(text, fold)
                hits.append(lex.hits(words, auto))
                sizes.append(len(words))
                found: set[str] = set()
                if hits[-1]:
                    for i, w in enumerate(words):
                        if lex.hits([w], auto):
                            found.update(" " + " ".join(words[a : a + 2]) + " " for a in (i - 1, i) if 0 <= a < len(words) - 1)
                phrases.append(sorted(found))
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(hits, pa.float64()), pa.array(sizes, pa.float64()), pa.array(phrases, pa.list_(pa.string()))], names=["label", "hits", "words", "phrases"])

    return train.mapInArrow(run, "label double, hits double, words double, phrases array<string>")


def fit(docs: DataFrame, labels: DataFrame, fit_on=None, max_rows: int = 12_000, exceptions: int = 300) -> Lexicon:
    train = sample(docs, labels, "toxic", F.lit(True) if fit_on is None else fit_on, max_rows)
    count = {r.label > 0.5: r["count"] for r in train.groupBy("label").count().collect()}
    bad, good = count.get(True, 0), count.get(False, 0)
    if not bad or not good:
        return Lexicon({}, set())
    model = Lexicon(lexicon(train, bad, good), set())
    seen = matched(train, model)
    phrases = (
        seen.select("label", F.explode("phrases").alias("p")).groupBy("p").agg(F.sum("label").alias("bad"), F.count("*").alias("all"))
        .where("bad = 0 AND all >= 5").orderBy(F.desc("all"), "p").limit(exceptions).collect()
    )
    model.exceptions = {r.p for r in phrases}
    rows = matched(train, model).select("label", "hits", "words").toPandas()
    model.fit_curve(rows.hits.to_numpy(), rows.words.to_numpy(), rows.label.to_numpy())
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_on=None, max_rows: int = 12_000) -> DataFrame:
    """doc_id, score, hits (summed weights) of every document."""
    box = shipped(docs.sparkSession, fit(docs, labels, fit_on, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, fold = unpacked(box), folding()
        auto = lex.automaton()
        for b in pieces(batches):
            words = [folded(t, fold) for t in b.column("text").to_pylist()]
            hits = np.array([lex.hits(w, auto) for w in words])
            score = lex.score(hits, np.array([len(w) for w in words], float))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(hits)], names=["doc_id", "score", "hits"])

    return arrow_map(texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, score double, hits double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity_scores(docs, labels, crc_rest(5) != 0)
    return scored.select("doc_id", F.coalesce(crc_rest(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
