"""Small fixtures against brute force, and the defined edge cases."""

import glob
import hashlib
import os
import random
import re
import struct
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import byte_bpe, fingerprints, line_dedup, mixing, near_copies, quality, queries, simhash, substring_dedup, token_counts, topk, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def raw(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, a repeated id, a clashing extra column."""
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t ", "en", "a", 4), (4, "x" * 70_000, None, "a", 70_000), (5, "one two three\n" * 60, "en", "b", None),
            (5, "one two three\n" * 60, "en", "b", None), (None, "no name here at all", "en", "b", 3), (None, "no name here at all", "en", "b", 3), (6, "same id one", "en", "b", 3), (6, "same id two", "en", "b", 3), (7, "aé漢🙂 " * 9000, "fr", "c", 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("size", F.lit(2.5))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r[x] for x in columns) for r in got.collect()), key=repr) == sorted(want.project(", ".join(columns)).fetchall(), key=repr)


@pytest.mark.parametrize("lines", [1, 2, 3, 5])
def test_lines_against_brute_force(spark, lines):
    rnd = random.Random(lines)
    pool = [f"line number {i} here" for i in range(9)] + ["short one"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for i in range(40)]
    seen, want = set(), {}
    for i, text in rows:
        ls = text.split("\n")
        counted = [j for j, x in enumerate(ls) if len(WORD.findall(x)) >= 3]
        gone = set()
        for q in range(len(counted) - lines + 1):
            run = tuple(ls[j] for j in counted[q : q + lines])
            if run in seen:
                gone |= set(counted[q : q + lines])
            seen.add(run)
        want[i] = sorted(gone)
    got = line_dedup.deduped(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=lines, min_words=10**6).collect()
    assert {r.doc_id: list(r.removed) for r in got} == want


def test_mix_comes_near_targets(spark, docs):
    got = mixing.mix(docs).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert abs(got.groupby("source").target.first().sum() - 1.5 * got["size"].sum()) < 1e-6 * got["size"].sum()


def test_fingerprints_against_brute_force(spark, raw):
    got = {r.doc_id: r for r in queries.queries()["op3_fingerprints"](spark, SF).collect()}
    ids, near = sorted(raw), []
    for i, d in enumerate(ids):
        text, after = raw[d], raw[ids[(i + 1) % len(ids)]]
        n = len(text) // 4
        other = text[: len(text) - n] + after[:n]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(other.encode()).hexdigest()

        def grams(t):
            w = WORD.findall(t)
            return Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)) if w)

        a, b = grams(text), grams(other)
        near.append((got[d].near_edited, sum((a & b).values()) / max(1, sum((a | b).values()))))
    x, y = np.array(near).T
    assert abs((x - y).mean()) < 0.03 and np.sqrt(((x - y) ** 2).mean()) < 0.09


def test_fingerprints_of_extreme_ids(spark):
    ids = [-(2**63), -5, 0, 3, 2**61, 2**62, 2**63 - 2, 2**63 - 1]
    rows = [(d, f"text of {d} " * 9) for d in ids] + [(None, "nameless one"), (None, "nameless two")]
    got = fingerprints.fingerprint_neighbours(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()
    want = {}
    for (d, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        n = len(t) // 4
        want[(d, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest())] = 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)


def test_weighted_terms():
    one, two = " ".join(["a b c d e"] * 30), " ".join(["a b c d e"] * 10)
    x, y = fingerprints.pair_signatures(one.encode(), two.encode())
    a, b = Counter(fingerprints.terms(one.encode()).tolist()), Counter(fingerprints.terms(two.encode()).tolist())
    assert abs(fingerprints.likeness(x, y) - sum((a & b).values()) / sum((a | b).values())) < 0.2


@pytest.mark.parametrize("name,label,rest,left", [("op4_quality", "quality", 4, 2), ("op7_toxicity", "toxic", 5, 0)])
def test_held_out_accuracy(spark, name, label, rest, left):
    import zlib

    sf = "/root/testdata/sf0.1"
    got = queries.queries()[name](spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % rest == left for i in got.doc_id]).all() and got.score.between(0, 1).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both[label]).mean() > 0.97


def test_folding():
    words = toxicity.folded("An 1d10t, ѕtuріd MОRОN ＬＯＳＥＲ id!ot", toxicity.folding())
    assert words == ["an", "idiot", "stupid", "moron", "ioser", "idiot"]


def test_exceptions_and_length():
    lex = toxicity.Lexicon({" trash ": 5.0}, {" trash can "})
    auto = lex.automaton()
    assert lex.hits(["the", "trash", "can"], auto) == 0 and lex.hits(["the", "trash"], auto) == 5


def test_simhash_against_brute_force(spark, raw):
    def bits(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fp = {d: bits(t) for d, t in raw.items()}
    least = {d: d for d in raw}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 3 and least[b] < least[a]:
                    least[a], changed = least[b], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.queries()["op5_simhash"](spark, SF).collect()}
    assert got == {d: (f"{fp[d]:016x}", least[d]) for d in raw}


def test_dense_fingerprints_lose_no_link():
    rng = np.random.default_rng(3)
    x = np.unique(np.array([sum(1 << int(b) for b in rng.choice(36, rng.integers(0, 6), replace=False)) for _ in range(900)], np.uint64))
    near, got = simhash.distances(x, simhash.pivots()), set()
    for i, j in simhash.links_in(x, near, np.arange(len(x)), list(range(36)), 3):
        got |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert got == {(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3) + i + 1}


def test_simhash_refuses_more_bits_than_its_keys_meet(docs):
    with pytest.raises(ValueError):
        simhash.links(docs.select(F.col("doc_id").alias("fp")), simhash.MAX_BITS + 1)


def test_token_counts_equal_the_library():
    import sentencepiece

    with open(token_counts.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rnd = random.Random(2)
    some = ["a" * 3000, " " * 2000, "x y" * 900, " lead", "", "<s> </s> " * 200, "漢字🙂 " * 400] + ["".join(rnd.choice(["a", " ", "  ", "\n", "é", "the", "▁", "0", "漢"]) for _ in range(1500)) for _ in range(30)]
    for chunk, overlap in ((64, 4), (300, 8), (1 << 15, 256)):
        assert token_counts.Counter(model, chunk, overlap).counts(some).tolist() == [len(sp.encode(t)) for t in some]


def test_very_long_texts_take_linear_time():
    import sentencepiece

    with open(token_counts.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    sp, counter, rnd = sentencepiece.SentencePieceProcessor(model_proto=model), token_counts.Counter(model), random.Random(5)
    han = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(700_000))
    for text in (han, "x" * 500_000, "ab" * 200_000 + han[:9000], "▁ a▁" * 50_000):
        began = time.time()
        assert counter.counts([text])[0] == len(sp.encode(text))
        assert time.time() - began < 30
    lexicon = toxicity.Lexicon({" trash ": 1.0, " can ": 0.5, " bin ": 0.25}, {" trash can "})
    began = time.time()
    assert lexicon.hits(["trash", "can"] * 200_000 + ["bin", "trash"], lexicon.automaton()) == 1.25
    assert time.time() - began < 30


def test_lexicon_leaves_out_what_stands_in_any_span():
    lexicon = toxicity.Lexicon({" b": 1.0, " c": 2.0, " d": 4.0, " e": 8.0}, {" a b c d ", " b c ", " x "})
    assert lexicon.hits("a b c d e b x c b c d".split(), lexicon.automaton()) == 8 + 1 + 2 + 4


def test_byte_bpe_folds_short_and_long_pieces_alike(spark):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["x" * 300, "é" * 200, "ab", "q", "ñaïveté" * 50] + ["thequickbrown" * k for k in range(1, 9)]
    df, tables = spark.createDataFrame([(w,) for w in words], "w string"), byte_bpe.literal(spark, **byte_bpe.rank_map(ranks))
    for short in (0, byte_bpe.SHORT, 10_000):
        got = byte_bpe.with_tables(df, tables, "ids", lambda t, short=short: byte_bpe.folded(t, F.col("w"), short)).collect()
        assert all(r.ids == enc._encode_single_piece(r.w.encode()) for r in got)


def test_byte_bpe_binds_one_value_a_merge(spark):
    """What a binding results in is copied: a merge binds its index, and no array of a text's pieces leaves one."""
    assert str(byte_bpe.merged(F.col("t"), F.col("w"), byte_bpe.SHORT)).count("aggregate(") == 3
    kinds = re.findall(r"CAST\(NULL AS ([A-Z]+)", str(byte_bpe.text_codes(F.col("t"), F.col("words"), F.col("text"), "x", "00", 1024)).upper())
    assert kinds[:2] == ["STRUCT"] * 2


def test_byte_bpe_cuts_long_pieces(spark):
    """A piece of a megabyte in seconds, and random bytes of many scripts, as the library has them."""
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})
    rnd = random.Random(9)
    han = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(340_000))
    mixed = ["".join(rnd.choice("aethZéß漢字ж🙂ñ") for _ in range(rnd.randrange(40, 700))) for _ in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([han, *mixed])], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in byte_bpe.tokens_digest(rows, path, public_tokenizers.PATTERN, memo=0).collect()}
    assert time.time() - began < 120
    for i, t in enumerate([han, *mixed]):
        ids = enc.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_byte_bpe_equals_the_library(spark, docs, raw):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})
    some = {**dict(list(raw.items())[:40]), **{-i - 1: t for i, t in enumerate(["", "a" * 900, "don't  I'M \n\n x", "　é🙂 x²½", "<|endoftext|>", "\x00\x85 ab"])}, -99: None}
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.tokens_digest(df, path, public_tokenizers.PATTERN, memo=50).collect()}
    for d, t in some.items():
        ids = enc.encode_ordinary(t or "")
        assert got[d] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


@pytest.mark.parametrize("big", [20_000, 1])
def test_substrings_against_brute_force(spark, monkeypatch, big):
    monkeypatch.setattr(substring_dedup, "BIG", big)
    rnd = random.Random(1)
    base = "".join(rnd.choice("ab \n") for _ in range(3000))
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 400), (4, base), (5, base[50:149]), (6, base[50:150]), (7, "é" * 150)] + [(8 + i, "".join(base[j : j + rnd.randint(20, 160)] for j in rnd.sample(range(2800), 8))) for i in range(30)]
    seen, want = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 99):
            w = b[a : a + 100]
            if w in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(w)
        want[d] = (sum(gone), bytes(c for c, g in zip(b, gone) if not g))
    got = substring_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in got} == want


def test_top_k_ties_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.5, 0.0]), (7, []), (None, [1.0, 1.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(v, v.where("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 32768), (2, 32768), (6, 32768)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
    many = topk.top_k(v, v, k=99, block=2)
    assert many.groupBy("query_id").count().where("count <> 4").count() == 0


def test_top_k_repeated_and_large_vectors(spark):
    top = lambda rows, q, k: [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(rows, q, k=k).orderBy("query_id", "rank").collect()]
    v = topk.integer_vectors(spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [3.0]), (2, [2.0]), (2, [2.0]), (3, [1.0])], "vec_id long, embedding array<float>"))
    assert [x[1:3] for x in top(v, v.where("vec_id = 0"), 4)] == [(1, 1), (2, 2), (3, 2), (4, 3)]
    big = [(0, [3.0e6, 1.0]), (1, [3.0e6, 1.0]), (2, [3.0e6, 2.0]), (3, [-3.0e6, 0.0])]
    v = topk.integer_vectors(spark.createDataFrame(big, "vec_id long, embedding array<double>"))
    whole = {i: [int(256 * x) for x in e] for i, e in big}
    want = sorted(((-sum(a * b for a, b in zip(whole[0], whole[i])), i) for i in (1, 2, 3)))
    assert top(v, v.where("vec_id = 0"), 3) == [(0, r + 1, i, -s) for r, (s, i) in enumerate(want)] and -want[0][0] > 2**53
    odd = [(i, [3.0e6, j / 256]) for i, j in ((0, 1), (1, 1), (2, 2), (3, 3), (4, 4))]  # scores beyond 2**53 that differ by one
    v = topk.integer_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<double>"))
    want = [(0, 1, 4, 768_000_000**2 + 4), (0, 2, 3, 768_000_000**2 + 3), (0, 3, 2, 768_000_000**2 + 2)]
    assert top(v, v.where("vec_id = 0"), 3) == want
    for huge, error in ((1e30, Exception), (1e8, ValueError)):
        w = topk.integer_vectors(spark.createDataFrame([(0, [huge]), (1, [huge])], "vec_id long, embedding array<double>"))
        with pytest.raises(error, match="2\\*\\*62"):
            top(w, w, 1)


def edited(rng, words, n):
    """The words with n of them replaced."""
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**9)}"
    return out


def test_near_copies_against_brute_force(spark):
    """Bases with edited, cut, chained and case-changed copies, and documents that share only a passage."""
    rng, texts = random.Random(4), []
    passage = [f"p{i}" for i in range(40)]
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 150, 600]))]
        texts += [base, edited(rng, base, max(1, len(base) // 60)), edited(rng, base, len(base) // 25), base[: len(base) - len(base) // 10], [w.upper() for w in base], base + passage]
        last = base
        for _ in range(4):
            last = edited(rng, last, max(1, len(base) // 70))
            texts.append(last)
    texts += [[], [], ["one"], ["one"], ["one", "two"]]
    rng.shuffle(texts)
    sets = [{" ".join(w).lower() for w in zip(*[t[i:] for i in range(5)])} or ({" ".join(t).lower()} if t else set()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_groups(docs).collect()}
    wrong = [i for i, r in enumerate(root) if got[i] != r]
    assert len(wrong) <= 0.01 * len(texts)  # a pair at exactly 0.8 is met with probability 0.98
    kept = {r.doc_id for r in near_copies.without_near_copies(docs).collect()}
    assert kept == {i for i, r in got.items() if i == r}


def test_large_buckets_give_all_unequal_pairs_or_the_nearest():
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2, (9, 256), dtype=np.uint8)[rng.integers(0, 9, 700)]
    bits ^= (rng.random(bits.shape) < 0.1).astype(np.uint8)
    fp, n, label = np.packbits(bits, axis=1).view(np.uint64), np.full(700, 50), rng.integers(0, 3, 700)
    apart = near_copies.hamming(fp[:, None], fp[None]).astype(int)
    np.fill_diagonal(apart, 999)
    want = {(i, j) for i in range(700) for j in range(i) if apart[i, j] <= near_copies.MOST and label[i] != label[j]}
    got = {(max(a, b), min(a, b)) for i, j, _ in near_copies.bucket_pairs(fp, n, label, 0.8) for a, b in zip(i.tolist(), j.tolist())}
    assert got == want and want
    got = Counter(a for i, j, d in near_copies.bucket_pairs(fp, n, None, 0.8) for a in i.tolist())
    assert got == {i: min(near_copies.NEAREST, int((apart[i] <= near_copies.MOST).sum())) for i in range(700) if apart[i].min() <= near_copies.MOST}


def near_equal_buckets(rows, size):
    """A chunk of buckets of ``size`` fingerprints each, all near one another within a bucket."""
    rng = np.random.default_rng(4)
    of = np.repeat(np.arange(rows // size), size)
    bits = rng.integers(0, 2, (rows // size, 256), dtype=np.uint8)[of]
    bits[:, :40] ^= (rng.random((rows, 40)) < 0.2).astype(np.uint8)
    fp = np.packbits(bits, axis=1).view(np.int64)
    chunk = {"key": of, "node": np.arange(rows), "n": np.full(rows, 50), "label": rng.integers(0, 3, rows)}
    return chunk | {f: fp[:, i] for i, f in enumerate(near_copies.FP)} | {"long": np.array([bytes(128)] * rows, object)}


def test_pairs_held_at_once_do_not_grow_with_a_chunk(monkeypatch):
    import tracemalloc

    def found(chunk, labelled):
        return {x for b in near_copies.chunk_pairs(chunk, labelled, 0.8) for x in zip(*(b.column(c).to_pylist() for c in "abd"))}

    chunk = near_equal_buckets(2_000, 50)
    got = {labelled: found(chunk, labelled) for labelled in (False, True)}
    fp = np.stack([chunk[f] for f in near_copies.FP], axis=1).view(np.uint64)
    every = [(i, j, int(near_copies.hamming(fp[i], fp[j]))) for i in range(2_000) for j in range(i + 1, i + 50 - i % 50)]
    assert got[True] == {(i, j, d) for i, j, d in every if d <= near_copies.MOST and chunk["label"][i] != chunk["label"][j]}
    least = {}
    for i, j, d in every:
        for x in (i, j):
            least[x] = sorted([*least.get(x, []), d])[: near_copies.NEAREST]
    own = {}
    for i, j, d in got[False]:
        for x in (i, j):
            own[x] = sorted([*own.get(x, []), d])[: near_copies.NEAREST]
    assert own == least
    monkeypatch.setattr(near_copies, "SOME", 100)  # the same pairs from smaller blocks
    assert found(chunk, True) == got[True] and found(chunk, False) == got[False]
    monkeypatch.undo()
    chunk = near_equal_buckets(50_000, 250)
    tracemalloc.start()
    for b in near_copies.chunk_pairs(chunk, False, 0.8):
        assert b.num_rows <= near_copies.NEAREST * 50_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_buckets_above_a_block_lose_no_pair():
    """A tight group of over 4096 fingerprints, of which few bits differ, and loose ones beside it."""
    rng = np.random.default_rng(9)
    m, tight = 5000, 4500
    bits = np.repeat(rng.integers(0, 2, (1, 256), dtype=np.uint8), m, axis=0)
    bits[:tight, :40] ^= (rng.random((tight, 40)) < 0.2).astype(np.uint8)
    bits[tight:] ^= (rng.random((m - tight, 256)) < 0.15).astype(np.uint8)
    fp, n = np.packbits(bits, axis=1).view(np.uint64), np.full(m, 50)
    label = np.where(rng.random(m) < 0.01, np.arange(m), -1)
    want, nearest = set(), {}
    for i in range(m):
        apart = near_copies.hamming(fp[i], fp).astype(int)
        apart[i] = 999
        want |= {(i, int(j)) for j in np.flatnonzero((apart <= near_copies.MOST) & (label != label[i])) if i < j}
        if apart.min() <= near_copies.MOST:
            nearest[i] = int(apart.min())
    got = {(min(a, b), max(a, b)) for i, j, _ in near_copies.bucket_pairs(fp, n, label, 0.8) for a, b in zip(i.tolist(), j.tolist())}
    assert got == want and want
    found, root = {}, np.arange(m)
    for i, j, d in near_copies.bucket_pairs(fp, n, None, 0.8):
        for a, x in zip(i.tolist(), d.tolist()):
            found[a] = min(x, found.get(a, 999))
        root = root[simhash.roots(m, np.concatenate([np.arange(m), i]), np.concatenate([root, j]))]
    assert found == nearest
    assert len(np.unique(root[:tight])) == 1  # within one group, the second round has no pairs to give


OPERATORS = {
    "lines": lambda d, _: line_dedup.without_repeated_lines(d), "mix": lambda d, _: mixing.mix(d), "mixed": lambda d, _: mixing.mixed_documents(d),
    "fingerprints": lambda d, _: fingerprints.fingerprint_neighbours(d), "quality": lambda d, labels: quality.quality_scores(d, labels), "accepted": lambda d, labels: quality.accepted(d, labels),
    "simhash": lambda d, _: simhash.groups(d), "near": lambda d, _: near_copies.without_near_copies(d),
    "counts": lambda d, _: token_counts.token_counts(d, token_counts.tokenizer_path("piece_bpe_32k.model")), "toxicity": lambda d, labels: toxicity.toxicity_scores(d, labels),
    "substrings": lambda d, _: substring_dedup.removed(d),
}
#: Operators that return a row for each input row.
EACH = {"mix", "fingerprints", "quality", "simhash", "counts", "toxicity", "substrings"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_no_rows(name, odd, none, labels):
    got = OPERATORS[name](odd, labels)
    n = len(got.collect())
    assert n == odd.count() if name in EACH else n <= 2 * odd.count()
    if name in ("lines", "mixed", "near", "accepted"):
        assert got.columns == odd.columns
    assert OPERATORS[name](none, labels.limit(0)).count() == 0


def test_odd_rows_of_byte_bpe_and_top_k(spark, odd, none):
    import public_tokenizers
    import tiktoken

    odd = odd.withColumn("text", F.when(F.length("text") == 70_000, F.lit("x" * 3000)).otherwise(F.col("text")))  # one piece takes time in its square
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})
    got = byte_bpe.tokens_digest(odd, path, public_tokenizers.PATTERN, memo=20)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    value = lambda t: (len(ids := enc.encode_ordinary(t)), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    want = Counter((r.doc_id, *value(r.text or "")) for r in odd.collect())
    assert Counter(tuple(r) for r in got.collect()) == want
    assert byte_bpe.tokens_digest(none, path, public_tokenizers.PATTERN, memo=20).count() == 0
    both = byte_bpe.decoded(byte_bpe.encoded(odd.where("text IS NOT NULL"), path, public_tokenizers.PATTERN, memo=20), path).collect()
    assert both and all(list(r.ids) == enc.encode_ordinary(r.text) and bytes(r.bytes) == r.text.encode() for r in both)
    rows = spark.createDataFrame([(0, [1.0], 7, "a"), (0, [1.0], 7, "a"), (None, [1.0], 1, "b"), (1, None, 2, None), (2, [2.0], 3, "c")], "vec_id long, embedding array<float>, score long, rank string")
    v = topk.integer_vectors(rows)
    assert [(r.query_id, r["rank"], r.vec_id) for r in topk.top_k(v, v).orderBy("query_id", "rank").collect()] == [(0, 1, 2), (2, 1, 0), (2, 2, 0)]


def test_token_count_query_equals_the_library(spark, raw):
    import sentencepiece

    with open(token_counts.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        sp = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.queries()["op6_token_counts"](spark, SF).collect()}
    assert got == {d: (len(t.encode()), n := len(sp.encode(t)), n > 4096) for d, t in raw.items()}


def test_copies_are_found_by_their_original_texts(spark):
    """Line dedup leaves later copies as stubs: these go by what they were; ids that are null or ambiguous stay."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    other = [f"v{rng.randrange(900)}" for _ in range(200)]
    whole = [(1, " ".join(base)), (2, " ".join([*base[:199], "x"])), (3, " ".join(other)), (4, " ".join(base)), (5, " ".join(other)), (5, "z"), (None, " ".join(base))]
    left = [(1, " ".join(base)), (2, "x"), (3, " ".join(other)), (4, "stub of four"), (5, "another stub"), (None, "third stub")]
    docs, originals = (spark.createDataFrame(rows, "doc_id long, text string") for rows in (left, whole))
    assert {r.doc_id for r in near_copies.without_near_copies(docs, originals=originals).collect()} == {1, 3, 5, None}
    assert near_copies.without_near_copies(docs).count() == 6


def test_repeated_rows_are_one_group(odd):
    assert near_copies.without_near_copies(odd).where("doc_id = 5").count() == 1


def test_pipeline(spark, raw):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "mixing", "byte_bpe"]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        d = line_dedup.stored(out, name)
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(got) and {r.doc_id for r in got} <= set(raw)
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in d.collect())


def test_byte_bpe_tables_are_written_from_compact_ones():
    """The driver holds little but the tables' text; all pairs that merge are in their slots."""
    import json
    import tracemalloc

    import public_tokenizers

    ranks = byte_bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tracemalloc.start()
    made = {n: byte_bpe.spelled(v) for n, (v, _) in {**byte_bpe.rank_map(ranks), **byte_bpe.byte_tables(ranks)}.items()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25_000_000
    want = {(ranks[t[:i]] * byte_bpe.SHIFT + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
    keys, values = json.loads(made["keys"]), json.loads(made["ranks"])
    assert len(keys) == len(values) == byte_bpe.SLOTS and all(k % byte_bpe.SLOTS == s for s, slot in enumerate(keys) for k in slot)
    assert {p for k, v in zip(keys, values) for p in zip(k, v, strict=True)} == want
    assert byte_bpe.spelled([]) == "[]"


def test_byte_bpe_leaves_the_driver_little(spark):
    """Tables are made in a task, and the map of pieces holds none that folding would give and the sample hasn't."""
    import tracemalloc

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = spark.createDataFrame([(1, " the the cat sat on the mat")], "doc_id long, text string")
    tracemalloc.start()
    byte_bpe.with_codes(rows, path, public_tokenizers.PATTERN, memo=20, memo_docs=10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000
    ranks = byte_bpe.ranks_of(path)
    tables, gap, early = byte_bpe.made_tables(spark, path), byte_bpe.gap_of(ranks), byte_bpe.early_merges(ranks)[1]
    one = lambda t, n: spark.range(1).select(F.to_json(F.struct(t[n].alias("v")))).first()[0]
    plain = byte_bpe.literal(spark, **byte_bpe.rank_map(ranks), **byte_bpe.byte_tables(ranks))
    assert all(one(tables, n) == one(plain, n) for n in ("pairs", "bytes", "first", "joins", "packed", "text"))
    words = byte_bpe.memo_words(rows, path, tables, public_tokenizers.PATTERN, 20, 10, gap, early).collect()
    assert [(r.w, r.p, r.n) for r in words] == [(" the", ranks[b" the"].to_bytes(2, "little").hex(), 3)]
    # a vocabulary whose token "abc" no merge gives: that piece is in the map all the same
    import base64
    import tempfile

    odd = {**{bytes([i]): i for i in range(256)}, b"abc": 256, b"xy": 257}
    with tempfile.NamedTemporaryFile("w", suffix=".tiktoken") as f:
        f.write("".join(f"{base64.b64encode(t).decode()} {i}\n" for t, i in odd.items()))
        f.flush()
        got = byte_bpe.encoded(spark.createDataFrame([(1, "abc"), (2, "abcx"), (3, "xyxy")], "doc_id long, text string"), f.name, r"\S+", memo=0).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {1: [256], 2: [97, 98, 99, 120], 3: [257, 257]}


def test_byte_bpe_makes_the_first_merges_by_replacement(spark):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    made, early = byte_bpe.early_merges(ranks)
    assert 20 < len(made) <= byte_bpe.EARLY and sorted(made, key=ranks.get) == made
    # with "ab" merged, "abc" of a lower rank could follow: the list ends before it
    few = {**{bytes([i]): i for i in range(256)}, b"bc": 256, b"abc": 257, b"ab": 258, b"cd": 259}
    assert byte_bpe.early_merges(few)[0] == [b"bc", b"abc"]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    words = [rnd.choice(["", " "]) + "".join(rnd.choice(["th", "he", "in", "an", "s", "t", "tt", "ing", "é", "the", "aaa", "on", "e", "漢"]) for _ in range(rnd.randrange(1, 30))) for _ in range(400)]
    df, tables = spark.createDataFrame([(w,) for w in words], "w string"), byte_bpe.literal(spark, **byte_bpe.rank_map(ranks))
    for short in (0, byte_bpe.SHORT):
        got = byte_bpe.with_tables(df, tables, "ids", lambda t, short=short: byte_bpe.folded(t, F.col("w"), short, early)).collect()
        assert all(r.ids == enc._encode_single_piece(r.w.encode()) for r in got if r.w.encode() not in ranks)
