"""Tries against sorted arrays, and scores against a model in plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import lm
from weftgraph.llm.elias_fano import Ascending, Children

def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


@pytest.mark.parametrize("top", [3, 1000, 1 << 45])
@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_successor_search(top, n):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    seq = Ascending(Ascending.pack(values))
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, 2 * top, 300).astype(np.uint64), np.array([0], np.uint64)])
    assert (seq.successor(asked) == np.searchsorted(values, asked)).all()
    assert (seq[np.arange(n)] == values).all()


def test_children_are_found_relative_to_their_node(tmp_path):
    rng = np.random.default_rng(1)
    groups = [np.unique(rng.integers(0, 500, rng.integers(1, 60))) for _ in range(200)]
    words = Children.pack(np.array([len(g) for g in groups]), np.concatenate(groups))
    words.tofile(tmp_path / "level")
    level = Children(np.memmap(tmp_path / "level", np.uint64, "r"))
    node, child = rng.integers(-1, 200, 5000), rng.integers(0, 520, 5000)
    start = np.cumsum([0, *map(len, groups)])
    want = [start[i] + list(groups[i]).index(c) if i >= 0 and c in groups[i] else -1 for i, c in zip(node, child)]
    assert level.find(node, child.astype(np.uint64)).tolist() == want


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def brute(rows):
    """doc_id, held_out, tokens, known, N, base, and the score of an interpolated Kneser-Ney model without splits."""
    docs = [(r.doc_id, held_out(r.doc_id), [*words_of(r.text), None]) for r in rows]
    c1, c3 = Counter(), Counter()
    for _, out, t in docs:
        if not out:
            c1.update(t)
            c3.update(zip(["<<", "<<", *t], ["<<", *t], t))
    n, v = sum(c1.values()), len(c1)
    same = defaultdict(list)
    for c in c1.values():
        same[int(lm.class_of(np.array([c]))[0])].append(c)
    p1 = lambda w: ((np.mean(same[int(lm.class_of(np.array([c1[w]]))[0])]) if c1[w] else 0) + 0.1) / (n + 0.1 * (v + 1))
    total, kinds, before, followers, all_before = Counter(), Counter(), Counter(), Counter(), Counter()
    for (a, b, c), k in c3.items():
        total[a, b] += k
        kinds[a, b] += 1
        before[b, c] += 1
        all_before[b] += 1
    for b, _ in before:
        followers[b] += 1

    def p(a, b, c):
        low = p1(c)
        if all_before[b]:
            low = max(before[b, c] - lm.D2, 0) / all_before[b] + lm.D2 * followers[b] / all_before[b] * low
        if total[a, b]:
            low = max(c3[a, b, c] - lm.D3, 0) / total[a, b] + lm.D3 * kinds[a, b] / total[a, b] * low
        return low

    for i, out, t in docs:
        base = sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        yield (i, out, len(t), sum(c1[w] > 0 for w in t), n), base, sum(math.log10(p(*x)) for x in zip(["<<", "<<", *t], ["<<", *t], t))


def test_scores_equal_a_model_in_dictionaries(spark, odd_rows):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = odd_rows.select("doc_id", "text").union(real)
    want = sorted(brute(docs.collect()), key=repr)
    for block, shard in ((4_000_000, 1_000_000), (20_000, 3000)):
        got = sorted((((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens), r.base_score, r.score) for r in lm.scores(docs, held(), block, shard).collect()), key=repr)
        assert [g[0] for g in got] == [w[0] for w in want]
        for (key, base, score), (_, base_, score_) in zip(got, want):
            assert base == pytest.approx(base_, rel=1e-9)
            assert -4.5 * key[2] / lm.STEPS - 1e-6 <= score - score_ <= 1e-6  # rounded down in each node


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_probabilities_add_up_to_one(spark, odd_rows, hot):
    """Also where middle words are split: after each pair, over all words and the unknown one, through the tries of all shards."""
    found, unigrams, shards = lm.tries(odd_rows, held(), shard=200, hot=hot)
    tries = {r.shard: lm.Trie(np.frombuffer(r.trie, np.uint64)) for r in found.collect()}
    requests = lm.requests_of(odd_rows, held(), lm.BLOCK, 200, hot)[0].where("w2 IS NOT NULL").collect()
    w2, w1, w3 = (np.concatenate([f(lm.unpacked(r[c])) for r in requests]) for c, f in (("w2", np.cumsum), ("w1", np.array), ("w3", np.array)))
    plain = w2 & np.uint64((1 << 48) - 1)
    every = np.union1d(w3, np.array([0], np.uint64))
    assert len(every) == unigrams.v + 1
    exponents = dict(zip(plain.tolist(), (w2 >> np.uint64(60)).astype(int).tolist()))
    assert any(exponents.values()) == (hot == 5)
    for a, b in sorted({*zip(w1.tolist(), plain.tolist())})[::3]:
        first, middle = np.full(len(every), a, np.uint64), np.full(len(every), b, np.uint64)
        middle = lm.parts_of(first, middle, every, np.full(len(every), hot * 2 ** exponents[b]), hot)
        homes = lm.home_of(middle, shards)
        total = 0.0
        for h in np.unique(homes).tolist():
            at = homes == h
            g = lm.Grams(middle[at], first[at], every[at])
            codes = tries[h].codes(g, unigrams)[g.of] if h in tries else lm.code(unigrams.of(every[at])).astype(int)
            total += (10.0 ** (-codes / lm.STEPS)).sum()
        assert 0.998 < total <= 1 + 1e-9


def test_splitting_frequent_words_changes_no_score(spark, odd_rows):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = odd_rows.select("doc_id", "text").union(real)
    rows = lambda h: sorted((tuple(r) for r in lm.scores(docs, held(), 100_000, 30_000, h).collect()), key=repr)
    assert rows(1000) == rows(1_000_000)


def test_children_may_be_none():
    level = Children(Children.pack(np.array([0, 2, 0, 0, 1, 0]), np.array([3, 7, 3])))
    node, child = (x.ravel() for x in np.meshgrid(np.arange(-1, 6), np.arange(9), indexing="ij"))
    want = [{(1, 3): 0, (1, 7): 1, (4, 3): 2}.get(k, -1) for k in zip(node.tolist(), child.tolist())]
    assert level.find(node, child.astype(np.uint64)).tolist() == want
    assert (Children(Children.pack(np.zeros(3, int), np.zeros(0, int))).find(np.array([0, 2]), np.zeros(2, np.uint64)) == -1).all()


def test_no_rows_and_no_training(spark, odd_rows, no_rows):
    assert lm.scores(no_rows, held()).count() == 0
    rows = lm.scores(odd_rows.select("doc_id", "text"), F.lit(True)).collect()
    assert len(rows) == odd_rows.count() and all(r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(0, abs=0.01 * r.n_tokens) for r in rows)
