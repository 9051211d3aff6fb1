"""Language-model scoring: a trigram model in Elias-Fano tries, one for each shard of the middle words.

A trigram (w1, w2, w3) belongs to its middle word. A shard's trie has its middle words, under each of them the words that follow
it (bigrams) and the words before it (contexts), and under each context its following words, which are coded as their places among
the middle word's followers: so everything that a probability needs is in one shard, and a search in the last level is relative
to the context. Nodes hold quantised logarithms of interpolated Kneser-Ney probabilities; sums of codes are integers, so reruns agree to the last digit.

The way of the data. Documents are cut in blocks of some megabytes. (1) Each block sends its distinct words' hashes with training counts to
word shards, which answer with ids and total counts. Ids name a class of about equal counts, whose mean is the unigram probability.
(2) With these a block has its base scores and sends its trigrams, sorted and packed, to their shards. (3) A shard builds its trie from the
training trigrams, looks every distinct one up, and returns a sum for each document that has any; these meet in the block.
A row that is shuffled is what one block has for one shard; no table of the vocabulary or the model is in one place.

Frequent words. Words are counted in blocks before the shuffle. A middle word with more than ``hot`` training occurrences is
split by classes of the word before and of the word after it, A by A of them (A a power of two, at most ``SPLIT``), which holds for hot pairs too. What its
probabilities rest on is counted over all its parts first: contexts over the classes after, bigrams over the classes before, and the middle word's
own totals. Each part is sent what it needs of these, so a split word has the probabilities that it would have unsplit.

Edge cases: a null or empty text is its end only; a null doc_id counts as held out; repeated rows and doc_ids are documents of
their own; words that training lacks have the unigram probability of an unknown word, and after one the next word has its unigram probability; without training
documents all words are unknown; an empty table gives no rows; other columns play no part. Words are told apart by 64-bit hashes.

``docs`` is read twice and must give the same rows in the same partitions, as files do; where it doesn't, an error says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, mix64, pieces, span_hashes, stored, table, texts, word_spans
from weftgraph.llm.elias_fano import Ascending, Children, codes_at, packed_codes

U = np.uint64
#: Bytes of a block's texts, trigrams of a shard, training occurrences above which a middle word is split, and the most classes on a side.
BLOCK, SHARD, HOT, SPLIT = 3_000_000, 400_000, 400_000, 64
#: Steps of a decade in codes of probabilities; 16 bits reach 16 decades.
STEPS = 4000
#: Discounts of trigrams and bigrams, and what the base adds to each count (fixed by the query contract).
D3, D2, ADD = 0.8, 0.8, 0.1
#: An id is a class of counts, and a number that the class's shards share out. The unknown word is 0.
CLASS_AT = U(40)
UNKNOWN, BEGIN = U(0), U(255) << CLASS_AT
#: The hash of the end of a text, and what is no shard.
END, FAR = U(0), U(1 << 33)


def packed(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, without those that are zero throughout."""
    a = np.ascontiguousarray(a, U)
    planes = a.view(np.uint8).reshape(-1, 8).T
    used = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    body = np.ascontiguousarray(planes[:used]).tobytes()
    return len(a).to_bytes(7, "little") + bytes([used]) + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n, used = int.from_bytes(raw[:7], "little"), raw[7]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :used] = np.frombuffer(pa.decompress(raw[8:], decompressed_size=n * used, codec="zstd"), np.uint8).reshape(used, n).T
    return out.view(U).ravel()


def rises(a: np.ndarray) -> np.ndarray:
    """Differences to the number before, modulo 2**64."""
    return np.diff(a, prepend=U(0))


def class_of(counts: np.ndarray) -> np.ndarray:
    """The class of a count: itself up to 8, then four to an octave."""
    c = np.maximum(counts, 1).astype(np.float64)
    return np.where(counts <= 8, counts, 8 + np.floor(4 * np.log2(c / 8) + 1e-9)).astype(np.int64)


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all documents of a batch, each document's words and its end, and the documents' token counts."""
    raw = [t.lower() for t in batch.column("text").cast(pa.binary()).to_pylist()]  # of bytes, lower() changes A-Z only
    b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in raw])
    a, z = word_spans(b)
    doc = np.searchsorted(ends, a, side="right")
    sizes = np.bincount(doc, minlength=len(raw)) + 1
    out = np.full(len(a) + len(raw), END, U)
    out[np.arange(len(a)) + doc] = np.where((h := span_hashes(b, a, z)) == END, U(1), h)
    return out, sizes


def blocks_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    for i, b in enumerate(pieces(batches, limit=limit)):
        yield first + i, b


def word_requests(rows: DataFrame, shards: int, block: int) -> DataFrame:
    """shard, block, hashes, counts, seen: the distinct words of a block by ranges of their hashes, with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, b in blocks_of(batches, block):
            h, sizes = tokens_of(b)
            own, at = np.unique(h, return_inverse=True)
            learn = np.repeat(~np.asarray(b.column("held_out"), bool), sizes)
            counts, seen = np.bincount(at[learn], minlength=len(own)), np.bincount(at, minlength=len(own))
            shard = ((own >> U(32)) * U(shards)) >> U(32)
            cuts = np.flatnonzero(np.diff(shard, prepend=FAR))
            rows = [(int(shard[i]), name, own[i:j].tobytes(), packed(counts[i:j]), int(seen[i:j].sum())) for i, j in zip(cuts, [*cuts[1:], len(own)])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["shard", "block", "hashes", "counts", "seen"])

    return arrow_map(rows, run, "shard long, block long, hashes binary, counts binary, seen long")


WORDS = "shard long, block long, ids binary, counts binary, class int, bin int, words long, total long, seen long"


def word_answers(requests: DataFrame, shards: int) -> DataFrame:
    """Ids and counts for each block's words, in the order asked; and rows of (class, bin) with their words and occurrences."""
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("class", pa.int32()), ("bin", pa.int32()), ("words", pa.int64()), ("total", pa.int64()), ("seen", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        asked = [np.frombuffer(x, U) for x in t.column("hashes").to_pylist()]
        own, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(at, np.concatenate([unpacked(x) for x in t.column("counts").to_pylist()]), minlength=len(own)).astype(np.int64)
        known = np.flatnonzero(counts)
        rank = np.empty(len(known), U)
        rank[np.argsort(-counts[known], kind="stable")] = np.arange(len(known), dtype=U)  # small numbers for frequent words
        ids = np.full(len(own), UNKNOWN)
        ids[known] = (class_of(counts[known]).astype(U) << CLASS_AT) | (rank * U(shards) + U(shard))
        key = class_of(counts[known]) * SPLIT + bin_of(ids[known])
        sums = np.bincount(key, counts[known]) if len(known) else np.zeros(0)
        words = np.bincount(key) if len(known) else np.zeros(0, np.int64)
        has = np.flatnonzero(words)
        ends = np.cumsum([len(x) for x in asked])
        parts = [(shard, b, packed(ids[at[e - len(x) : e]]), packed(counts[at[e - len(x) : e]]), None, None, None, None, s) for b, x, e, s in zip(t.column("block").to_pylist(), asked, ends.tolist(), t.column("seen").to_pylist())]
        parts += [(shard, None, None, None, int(k) // SPLIT, int(k) % SPLIT, int(words[k]), int(sums[k]), None) for k in has]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parts), schema)], schema=schema)

    return requests.groupBy("shard").applyInArrow(run, WORDS)


def bin_of(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids + U(1)) & U(SPLIT - 1)).astype(np.int64)


class Unigrams:
    """Totals of all words by class, of fixed size, and their unigram probabilities."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.n, self.v = sum(r[3] for r in rows), sum(r[2] for r in rows)
        self.z = self.n + ADD * (self.v + 1)
        words, total = np.zeros(256), np.zeros(256)
        for c, _, w, t in rows:
            words[c] += w
            total[c] += t
        self.p = np.full(256, ADD / self.z)
        has = words > 0
        self.p[has] = (total[has] / words[has] + ADD) / self.z

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.p[(ids >> CLASS_AT).astype(np.int64)]


def code(p: np.ndarray) -> np.ndarray:
    """The quantised logarithm of a probability, rounded so that probabilities don't grow."""
    return np.minimum(np.ceil(-np.log10(np.maximum(p, 1e-300)) * STEPS - 1e-9), 65_535).astype(np.uint16)


def block_states(rows: DataFrame, block: int) -> DataFrame:
    """block, n_words, tokens (places among the block's distinct words), and the documents' ids, sizes and flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, b in blocks_of(batches, block):
            h, sizes = tokens_of(b)
            own, at = np.unique(h, return_inverse=True)
            ids, held = b.column("doc_id").to_pylist(), b.column("held_out").to_pylist()
            row = [name, len(own), int(np.bitwise_xor.reduce(own)) >> 1, packed(at), ids, sizes.tolist(), held]
            yield pa.RecordBatch.from_arrays([pa.array([x], f) for x, f in zip(row, [pa.int64()] * 3 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())])], names=["block", "n_words", "sum", "tokens", "doc_ids", "sizes", "held"])

    return arrow_map(rows, run, "block long, n_words long, sum long, tokens binary, doc_ids array<long>, sizes array<long>, held array<boolean>")


#: A row has either a block's trigrams for a shard, or sums by document: of what needs no shard (with the base columns), or of a shard.
REQUESTS = "shard long, block long, w2 binary, w1 binary, w3 binary, docs binary, sums binary, base binary"
SUMS = "block long, docs binary, sums binary, base binary"


def parts_of(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, counts2: np.ndarray, hot: int) -> np.ndarray:
    """w2 with the classes that split it where it is hot: 4 bits for A's exponent, 6 for each class, above the id's 48."""
    out = w2.copy()
    at = np.flatnonzero(counts2 > hot)
    if len(at):
        e = np.minimum(np.ceil(np.log2(counts2[at] / hot)).astype(np.int64), SPLIT.bit_length() - 1)
        a = (1 << e) - 1
        out[at] |= (e.astype(U) << U(60)) | ((bin_of(w1[at]) & a).astype(U) << U(54)) | ((bin_of(w3[at]) & a).astype(U) << U(48))
    return out


def trigram_requests(states: DataFrame, answers: DataFrame, unigrams: Unigrams, shards: int, hot: int, split: bool = False) -> DataFrame:
    """Rows of ``REQUESTS``. With ``split``, the training trigrams of split middle words only."""
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("w2", "w1", "w3", "docs", "sums", "base"))])

    def run(state: pa.Table, answer: pa.Table) -> pa.Table:
        answer = answer.sort_by("shard")
        ids = np.concatenate([unpacked(x) for x in answer.column("ids").to_pylist()] or [np.zeros(0, U)])
        counts = np.concatenate([unpacked(x) for x in answer.column("counts").to_pylist()] or [np.zeros(0, U)]).astype(np.int64)
        if state.num_rows != 1 or len(ids) != state.column("n_words")[0].as_py():
            raise ValueError("the documents came in other partitions when read again; give them as a written table")
        name = state.column("block")[0].as_py()
        tokens = unpacked(state.column("tokens")[0].as_py()).astype(np.int64)
        sizes = np.asarray(state.column("sizes")[0].values, np.int64)
        held = np.asarray(state.column("held")[0].values, bool)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        log = np.log10((counts + ADD) / unigrams.z)
        base = np.bincount(doc, log[tokens], minlength=len(sizes))
        known = np.bincount(doc, counts[tokens] > 0, minlength=len(sizes)).astype(np.int64)
        w3, begins = ids[tokens], np.cumsum(sizes) - sizes
        w2, c2 = np.roll(w3, 1), np.roll(counts[tokens], 1)
        w2[begins], c2[begins] = BEGIN, counts[0]  # the end's hash is the least, and has as many training occurrences as texts
        w1 = np.roll(w2, 1)
        w1[begins] = BEGIN
        own = np.flatnonzero(w2 == UNKNOWN)  # nothing follows in training
        alone = np.bincount(doc[own], code(unigrams.of(w3[own])), minlength=len(sizes)).astype(U)
        rows = [(0, name, None, None, None, None, packed(alone), base.tobytes() + known.tobytes())]
        at = np.flatnonzero(w2 != UNKNOWN)
        w1, w3, doc, w2 = w1[at], w3[at], doc[at], parts_of(w1[at], w2[at], w3[at], c2[at], hot)
        if split:
            at = np.flatnonzero((w2 >> U(60) > 0) & ~held[doc])
            w1, w2, w3, doc, rows = w1[at], w2[at], w3[at], np.zeros(len(at), np.int64), []
            held = held & False
        shard = home_of(w2, shards)
        order = np.lexsort((w3, w1, w2, shard))
        shard, w1, w2, w3, doc = shard[order], w1[order], w2[order], w3[order], doc[order]
        doc = doc.astype(U) << U(1) | (~held[doc]).astype(U)
        cuts = np.flatnonzero(np.diff(shard, prepend=FAR))
        rows += [(int(shard[i]), name, packed(rises(w2[i:j])), packed(w1[i:j]), packed(w3[i:j]), packed(doc[i:j]), None, None) for i, j in zip(cuts, [*cuts[1:], len(shard)])]
        return table_of(rows, schema)

    return states.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, REQUESTS)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def home_of(w2: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a middle word's part."""
    return ((mix64(w2) >> U(32)) * U(shards)) >> U(32)


class Grams:
    """The distinct trigrams of a shard: dense numbers of words and of the middle word's parts, contexts and bigrams.

    ``whole`` has what split middle words have over all their parts (``whole_of``); its contexts and bigrams are numbered too.
    """

    def __init__(self, w2: np.ndarray, w1: np.ndarray, w3: np.ndarray, whole: list[tuple[np.ndarray, ...]] | None = None):
        self.whole = whole or whole_of(None)
        (pc, c1, *_), (pb, c3, *_), (pm, *_) = self.whole
        k, nc, nb = len(w2), len(pc), len(pb)
        self.u2, i2 = np.unique(np.concatenate([w2, pc, pb, pm]), return_inverse=True)
        self.u1, i1 = np.unique(np.concatenate([w1, c1]), return_inverse=True)
        self.u3, i3 = np.unique(np.concatenate([w3, c3]), return_inverse=True)
        self.n1, self.n3 = len(self.u1), len(self.u3)
        self.contexts, c = np.unique(i2[: k + nc] * self.n1 + i1, return_inverse=True)
        self.tri, self.of = np.unique(c[:k] * self.n3 + i3[:k], return_inverse=True)
        self.context, self.third = self.tri // max(1, self.n3), self.tri % max(1, self.n3)
        self.second = self.contexts // max(1, self.n1)
        self.bigrams, b = np.unique(np.concatenate([self.second[self.context] * self.n3 + self.third, i2[k + nc : k + nc + nb] * self.n3 + i3[k:]]), return_inverse=True)
        self.bigram = b[: len(self.tri)]
        #: Where the rows of ``whole`` are among contexts, bigrams and middles.
        self.at_whole = c[k:], b[len(self.tri) :], i2[k + nc + nb :]


def whole_of(t: pa.Table | None) -> list[tuple[np.ndarray, ...]]:
    """Of split middle words' parts: (part, w1, total, kinds) of contexts, (part, w3, before, 0) of bigrams, (part, 0, all before, after) of middles."""
    out = []
    for kind in range(3):
        rows = [] if t is None else [r for r in t.select(["kind", "part", "ids", "a", "b"]).to_pylist() if r["kind"] == kind]
        columns = [[np.full(int.from_bytes(r["ids"][:7], "little"), np.int64(r["part"]).view(U)) for r in rows], *([unpacked(r[c]) for r in rows] for c in ("ids", "a", "b"))]
        part, ids, one, two = (np.concatenate([np.zeros(0, U), *c]) for c in columns)
        out.append((part, ids, one.astype(np.int64), two.astype(np.int64)))
    return out


#: The class of the word before and of the word after in a middle word's part.
BEFORE_AT, AFTER_AT, CLASS = U(54), U(48), U(63)
WHOLE = "shard long, kind int, part long, ids binary, a binary, b binary"


def merged(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes, bytes]:
    own, at = np.unique(ids, return_inverse=True)
    return packed(own), *(packed(np.bincount(at, v, minlength=len(own)).astype(U)) for v in (a, b))


def wholes(requests: DataFrame, shards: int) -> DataFrame:
    """Rows of ``WHOLE`` for each shard: counts of split middle words over all their parts, for each part that the shard can have.

    ``requests`` are those of split words. A shard's parts give their contexts without the class after and their bigrams without the class
    before; these are added up by word and class, and go to the parts of that class, whether or not training has a trigram there.
    """
    schema = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("ids", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
    signed = lambda x: int(np.uint64(x).view(np.int64))

    def partial(t: pa.Table) -> pa.Table:
        g, counts, _, _ = shard_grams(t)
        seen = counts > 0
        total, kinds = (np.bincount(g.context, v, minlength=len(g.contexts)) for v in (counts, seen))
        before = np.bincount(g.bigram, seen, minlength=len(g.bigrams))
        out = []
        for kind, part, ids, a, b in (
            (0, g.u2[g.second] & ~(CLASS << AFTER_AT), g.u1[g.contexts % g.n1], total, kinds),
            (1, g.u2[g.bigrams // g.n3] & ~(CLASS << BEFORE_AT), g.u3[g.bigrams % g.n3], before, before * 0),
        ):
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=U(0)) | (np.arange(len(part)) == 0))
            for i, j in zip(cuts, [*cuts[1:], len(part)]):
                at = order[i:j]
                out.append((None, kind, signed(part[at[0]]), *merged(ids[at], a[at], b[at])))
        return table_of(out, schema)

    def added(t: pa.Table) -> pa.Table:
        kind, part = t.column("kind")[0].as_py(), t.column("part")[0].as_py()
        ids, a, b = (np.concatenate([unpacked(v) for v in t.column(c).to_pylist()]) for c in ("ids", "a", "b"))
        out = [(None, kind, part, *merged(ids, a, b))]
        if kind == 1:  # and what it adds to its middle word's totals
            middle = signed(np.int64(part).view(U) & ~(CLASS << AFTER_AT))
            out.append((None, 2, middle, packed(np.zeros(1, U)), packed(np.array([a.sum()], U)), packed(np.array([len(np.unique(ids))], U))))
        return table_of(out, schema)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                key = np.int64(r["part"]).view(U)
                classes = np.arange(1 << int(key >> U(60)), dtype=U)
                parts = {0: key | classes << AFTER_AT, 1: key | classes << BEFORE_AT, 2: (key | (classes << BEFORE_AT)[:, None] | classes << AFTER_AT).ravel()}[r["kind"]]
                for lo in range(0, len(parts), 8):
                    some = parts[lo : lo + 8]
                    rows = [(int(h), r["kind"], signed(p), r["ids"], r["a"], r["b"]) for h, p in zip(home_of(some, shards), some)]
                    yield from table_of(rows, schema).to_batches()

    sums = requests.groupBy("shard").applyInArrow(partial, WHOLE).groupBy("kind", "part").applyInArrow(added, WHOLE)
    sums = stored(sums, "sums")
    middles = sums.where("kind = 2").groupBy("kind", "part").applyInArrow(added, WHOLE)
    return stored(arrow_map(sums.where("kind < 2").unionByName(middles), dealt, WHOLE), "wholes")


def build(g: Grams, counts: np.ndarray, unigrams: Unigrams) -> np.ndarray:
    """The trie of the trigrams with training counts, as 64-bit words."""
    seen = counts > 0
    total = np.bincount(g.context, counts, minlength=len(g.contexts))
    kinds = np.bincount(g.context[seen], minlength=len(g.contexts))
    before = np.bincount(g.bigram[seen], minlength=len(g.bigrams))  # distinct words before a bigram
    middle, third = g.bigrams // g.n3, g.bigrams % g.n3
    all_kinds, (contexts, bigrams, middles) = kinds.copy(), g.at_whole
    (_, _, total[contexts], all_kinds[contexts]), (_, _, before[bigrams], _) = g.whole[:2]
    all_before, after = np.bincount(middle, before, minlength=len(g.u2)), np.bincount(middle[before > 0], minlength=len(g.u2))
    here = after.copy()  # followers in this trie
    _, _, all_before[middles], after[middles] = g.whole[2]
    b = np.flatnonzero(before)
    p1 = unigrams.of(g.u3)
    n2, back2 = all_before[middle[b]], D2 * after / np.maximum(all_before, 1)
    p2 = np.maximum(before[b] - D2, 0) / n2 + back2[middle[b]] * p1[third[b]]
    place = np.full(len(g.bigrams), -1)
    place[b] = np.arange(len(b))
    t, c = np.flatnonzero(seen), np.flatnonzero(total)
    back3 = D3 * all_kinds / np.maximum(total, 1)
    ct = g.context[t]
    p3 = np.maximum(counts[t] - D3, 0) / total[ct] + back3[ct] * p2[place[g.bigram[t]]]
    m = np.flatnonzero(all_before)
    first = np.cumsum(here[m]) - here[m]
    spot = np.zeros(len(g.u2), np.int64)
    spot[m] = first
    rank = place[g.bigram[t]] - spot[g.second[ct]]  # among the followers of the middle word
    per_middle = np.bincount(g.second[c], minlength=len(g.u2))[m]
    return np.concatenate([
        Ascending.pack(g.u2[m]), Ascending.pack(g.u1), Ascending.pack(g.u3), packed_codes(code(back2[m])),
        Children.pack(here[m], third[b]), packed_codes(code(p2)), Children.pack(per_middle, g.contexts[c] % g.n1), packed_codes(code(back3[c])),
        Children.pack(kinds[c], rank), packed_codes(code(p3)),
    ])


class Trie:
    """A shard's trie over words in memory or in a mapped file."""

    def __init__(self, words: np.ndarray):
        self.middles = Ascending(words)
        self.w1 = Ascending(words, self.middles.end)
        self.w3 = Ascending(words, self.w1.end)
        self.back2, at = codes_at(words, self.w3.end)
        self.followers = Children(words, at)
        self.p2, at = codes_at(words, self.followers.end)
        self.contexts = Children(words, at)
        self.back3, at = codes_at(words, self.contexts.end)
        self.thirds = Children(words, at)
        self.p3, _ = codes_at(words, self.thirds.end)

    def codes(self, g: Grams, unigrams: Unigrams) -> np.ndarray:
        """Codes of the probabilities of distinct trigrams. Words, bigrams and contexts are looked up once each."""
        middle, second, third = self.middles.find(g.u2), g.bigrams // g.n3, g.bigrams % g.n3
        word1, word3 = self.w1.find(g.u1), self.w3.find(g.u3)
        m2 = middle[second]
        follower = self.followers.find(np.where(word3[third] < 0, -1, m2), word3[third])
        low = code(unigrams.of(g.u3)).astype(np.int64)[third] + (np.where(m2 >= 0, self.back2[m2], 0) if len(self.back2) else 0)
        hit = np.flatnonzero(follower >= 0)
        low[hit] = self.p2[follower[hit]]
        first = word1[g.contexts % g.n1]
        context = self.contexts.find(np.where(first < 0, -1, middle[g.second]), first)
        back = np.where(context >= 0, self.back3[context], 0) if len(self.back3) else np.zeros(len(context), np.int64)
        out = low[g.bigram] + back[g.context]
        both = np.flatnonzero((context[g.context] >= 0) & (follower[g.bigram] >= 0))
        place = np.zeros(len(follower), np.int64)  # among the middle word's followers
        place[hit] = follower[hit] - self.followers.first(m2[hit])
        found = self.thirds.find(context[g.context[both]], place[g.bigram[both]])
        known = np.flatnonzero(found >= 0)
        out[both[known]] = self.p3[found[known]]
        return out


def shard_grams(t: pa.Table, whole: pa.Table | None = None) -> tuple[Grams, np.ndarray, np.ndarray, list[int]]:
    """The trigrams of a shard, the training count of each, and the documents of all occurrences by block."""
    column = lambda c, f=lambda x: x: [f(unpacked(x)) for x in t.column(c).to_pylist()]
    sizes = [int.from_bytes(x[:7], "little") for x in t.column("w2").to_pylist()]
    w2, w1, w3, doc = (np.concatenate([np.zeros(0, U), *column(*c)]) for c in (("w2", np.cumsum), ("w1",), ("w3",), ("docs",)))
    g = Grams(w2, w1, w3, whole_of(whole))
    counts = np.bincount(g.of[(doc & U(1)) == 1], minlength=len(g.tri))
    return g, counts, (doc >> U(1)).astype(np.int64), sizes


def shard_sums(requests: DataFrame, whole: DataFrame, unigrams: Unigrams) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary()), ("base", pa.binary())])

    def run(t: pa.Table, whole: pa.Table) -> pa.Table:
        plain, t = t.filter(pa.compute.is_valid(t.column("base"))), t.filter(pa.compute.is_valid(t.column("w2")))
        out = [(b, None, s, x) for b, s, x in zip(*(plain.column(c).to_pylist() for c in ("block", "sums", "base")))]
        if t.num_rows:
            g, counts, doc, sizes = shard_grams(t, whole)
            trie = Trie(build(g, counts, unigrams))
            found = trie.codes(g, unigrams)[g.of]
            end = 0
            for name, n in zip(t.column("block").to_pylist(), sizes):
                sums = np.bincount(doc[end : end + n], found[end : end + n]).astype(U)
                has = np.flatnonzero(sums)
                out.append((name, packed(rises(has.astype(U))), packed(sums[has]), None))
                end += n
        return table_of(out, schema)

    return requests.groupBy("shard").cogroup(whole.groupBy("shard")).applyInArrow(run, SUMS)


def block_scores(states: DataFrame, sums: DataFrame, train_tokens: int) -> DataFrame:
    """The documents' rows from the sums of all shards."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(state: pa.Table, parts: pa.Table) -> pa.Table:
        sizes = np.asarray(state.column("sizes")[0].values, np.int64)
        n, total = len(sizes), np.zeros(len(sizes), U)
        for docs, sums, base in zip(*(parts.column(c).to_pylist() for c in ("docs", "sums", "base"))):
            if base is not None:
                total += unpacked(sums)
                base_score, known = np.frombuffer(base, np.float64, n), np.frombuffer(base, np.int64, n, 8 * n)
            else:
                total[np.cumsum(unpacked(docs)).astype(np.int64)] += unpacked(sums)
        return pa.Table.from_arrays([state.column("doc_ids")[0].values, state.column("held")[0].values, pa.array(sizes), pa.array(known), pa.array(np.full(n, train_tokens)), pa.array(base_score), pa.array(-(total / STEPS))], schema=schema)

    return states.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def requests_of(docs: DataFrame, held_out, block: int, shard: int, hot: int):
    """The trigram requests of all documents, with the states and totals they rest on, and the counts of split words over their parts."""
    spark = docs.sparkSession
    rows = texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    answers = stored(word_answers(word_requests(rows, n, block), n), "words")
    totals = answers.where("class IS NOT NULL").groupBy("class", "bin").agg(F.sum("words").alias("words"), F.sum("total").alias("total"))
    sums = totals.collect()  # at most 256 by SPLIT rows
    unigrams = Unigrams([tuple(r) for r in sums])
    tokens = answers.agg(F.sum("seen")).first()[0] or 0
    states = block_states(rows, block)
    answers = answers.where("class IS NULL").select("shard", "block", "ids", "counts")
    shards = max(1, -(-tokens // shard))
    whole = spark.createDataFrame([], WHOLE)
    if any(r["class"] >= class_of(np.array([hot + 1]))[0] for r in sums):
        whole = wholes(trigram_requests(states, answers, unigrams, shards, hot, split=True), shards)
    return trigram_requests(states, answers, unigrams, shards, hot), states, unigrams, shards, whole


def scores(docs: DataFrame, held_out, block: int = BLOCK, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from the rows that ``held_out`` (a column) leaves."""
    requests, states, unigrams, _, whole = requests_of(docs, held_out, block, shard, hot)
    return block_scores(states.select("block", "doc_ids", "sizes", "held"), shard_sums(requests, whole, unigrams), unigrams.n)


def tries(docs: DataFrame, held_out, block: int = BLOCK, shard: int = SHARD, hot: int = HOT) -> tuple[DataFrame, Unigrams, int]:
    """The model as a table of shard and trie, to be kept, with its unigrams and number of shards; ``Trie(numpy.frombuffer(trie, 'uint64'))`` or a mapped file of one answers."""
    requests, _, unigrams, shards, whole = requests_of(docs, held_out, block, shard, hot)

    def run(t: pa.Table, whole: pa.Table) -> pa.Table:
        g, counts, _, _ = shard_grams(t, whole)
        return pa.table({"shard": (t if t.num_rows else whole).column("shard").slice(0, 1), "trie": [build(g, counts, unigrams).tobytes()]})

    return requests.where("w2 IS NOT NULL").groupBy("shard").cogroup(whole.groupBy("shard")).applyInArrow(run, "shard long, trie binary"), unigrams, shards


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by what those learn whose crc32(doc_id) isn't divisible by 10."""
    return scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
