"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import resampling


def features(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1))


def brute(docs, target):
    mine, theirs = [(r.doc_id, *features(r.text)) for r in docs], sum((features(r.text)[1] for r in target), Counter())
    every = sum((f for _, _, f in mine), Counter())
    s_all, t_all = sum(every.values()), sum(theirs.values())
    gain = {b: math.floor(1000 * math.log((theirs[b] + 1) * (s_all + 10_000) / ((s + 1) * (t_all + 10_000)))) for b, s in every.items()}
    rows = []
    for i, words, f in mine:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in f.items())
        rows.append((i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    return rows, fit


def test_weights_and_draw_equal_plain_python(spark, odd_rows):
    target = spark.createDataFrame([(1, "The text number 3 of a hot source"), (2, None), (3, "")], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    wide = odd_rows.union(odd_rows.where("doc_id = 7").withColumn("doc_id", F.lit(8)).withColumn("text", F.repeat(F.lit("Some ÉCOLE words in it, and more; "), 2000)))
    rows, fit = brute(wide.collect(), target.collect())
    for share in ((5, 100), (1, 2)):
        got = resampling.resampled(wide, target, share=share).collect()
        assert sorted(map(repr, ((r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got))) == sorted(map(repr, rows))
        drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
        want = fit[: share[0] * len(fit) // share[1]]
        assert [r["rank"] for r in drawn] == list(range(1, len(want) + 1)) and [(r.doc_id, r.score) for r in drawn] == [(w[0], w[3]) for w in want]


def test_no_rows_and_no_target(spark, odd_rows, no_rows):
    assert resampling.resampled(no_rows, odd_rows).count() == 0
    assert resampling.resampled(odd_rows, no_rows).count() == odd_rows.count()


@pytest.mark.parametrize("text,words", [("A-b C9é_z", ["a", "b", "c9é", "z"]), ("", []), ("漢字 🙂x", ["漢字", "🙂x"])])
def test_position_table(spark, text, words):
    rows = resampling.positions(spark.createDataFrame([(text,)], "text string")).collect()
    assert [r.b1 for r in rows if r.b1 is not None] == [zlib.crc32(w.encode()) % 10_000 for w in words]
