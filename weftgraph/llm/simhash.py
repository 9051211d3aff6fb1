"""SimHash near-dedup with pivot distance tables.

Fingerprints of 64 bits by majority vote over the hashes of a document's word shingles. Two
fingerprints are linked at ``MAX_BITS`` or fewer differing bits; groups are connected components.

Finding links: distinct fingerprints are dealt out by 28 of their bits, sixteen ways. Of four blocks
of 16 bits, three differing bits leave one equal; of the other 48 bits, cut into four blocks of 12,
again one is equal, so linked fingerprints meet under some key and none is lost. Among those
that meet, each has a row of Hamming distances to fixed pivot fingerprints; the triangle inequality
discards every pair whose rows differ by more than ``MAX_BITS`` in any coordinate, and the survivors
are verified. A key with many fingerprints is cut by further bits in the same way, so no step
compares all pairs of a large group; links leave a task as stars, one row per fingerprint at most.

Edge cases: null text is empty; a document without words has fingerprint zero, linked like any
other; fewer words than a shingle make one shingle; repeated rows and a repeated or null doc_id are
rows of their own (a null doc_id never names a group unless the group has no other); an empty table
gives no rows. Columns besides doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, mix64, pieces, stored, table, texts

#: Fixed by the query's contract.
SHINGLE, SEED, MAX_BITS = 3, 42, 3
PIVOTS = 24
SMALL = 192


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = raw.lower().split()  # bytes: only A-Z, and the contract's six space bytes
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for a in range(0, n, 1 << 16):
        part = words[a : a + (1 << 16) + shingle - 1]
        line = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = np.concatenate([[0], ends[:-1]]).tolist()
        ends = (ends - 1).tolist()
        h = np.array([digest(line[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            raw = b.column("text").cast(pa.binary())
            fp = np.array([fingerprint(x.as_py(), shingle, seed) for x in raw], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: a fixed pseudo-random sequence."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distances(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def verified(fp: np.ndarray, near: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs that no pivot discards and whose own distance is small enough."""
    for p in range(near.shape[1]):
        keep = np.abs(near[i, p] - near[j, p]) <= most
        i, j = i[keep], j[keep]
        if not len(i):
            return i, j
    keep = np.bitwise_count(fp[i] ^ fp[j]) <= most
    return i[keep], j[keep]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def links_in(fp: np.ndarray, near: np.ndarray, idx: np.ndarray, free: list[int], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the fingerprints at ``idx``, which agree in all bits but ``free``."""
    if len(idx) <= SMALL or len(free) < 2 * (most + 1):
        order = idx[np.argsort(near[idx, 0], kind="stable")]
        first = near[order, 0].astype(np.int64)
        upto = np.searchsorted(first, first + most, side="right")
        for a in range(0, len(order), 256):  # rows whose first coordinate is too far never meet
            rows = np.arange(a, min(a + 256, len(order)))
            width = upto[rows] - rows - 1
            i = np.repeat(rows, width)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
            if len(i):
                yield verified(fp, near, order[i], order[j], most)
        return
    for block in np.array_split(np.array(free), most + 1):
        part = np.zeros(len(idx), np.uint64)
        for k, bit in enumerate(block):
            part |= ((fp[idx] >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        rest = [x for x in free if x not in set(block.tolist())]
        for group in np.split(idx[order], cuts):
            if len(group) > 1:
                yield from links_in(fp, near, group, rest, most)


def key_bits() -> list[list[int]]:
    """The bits of each of the sixteen keys."""
    out = []
    for i in range(4):
        block = list(range(16 * i, 16 * i + 16))
        other = [b for b in range(64) if b not in block]
        out += [block + other[12 * j : 12 * j + 12] for j in range(4)]
    return out


def keyed(fps: DataFrame) -> DataFrame:
    """Sixteen rows for each fingerprint: its key and itself."""
    fp = F.col("fp")
    low48 = lambda i: [F.shiftrightunsigned(fp, 16 * b).bitwiseAND(0xFFFF) for b in range(4) if b != i]
    keys = []
    for i in range(4):
        own = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)
        a, b, c = low48(i)
        rest = a.bitwiseOR(F.shiftleft(b, 16)).bitwiseOR(F.shiftleft(c, 32))
        for j in range(4):
            sub = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            keys.append(F.lit((4 * i + j) << 28).cast("long").bitwiseOR(F.shiftleft(own, 12)).bitwiseOR(sub))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def links(fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Stars (a, b) that join the fingerprints linked within each task. The keys hold for ``MAX_BITS`` at most."""
    if most > MAX_BITS:
        raise ValueError(f"most must be {MAX_BITS} or less, or links are lost")
    refs, bits = pivots(), key_bits()

    def stars(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        near = distances(fp, refs)
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        sizes = np.diff(cuts)
        size = np.repeat(sizes, sizes)
        for lag in range(1, min(SMALL, int(sizes.max(initial=0)))):  # all small keys at once
            at = np.flatnonzero((key[:-lag] == key[lag:]) & (size[:-lag] <= SMALL))
            if not len(at):
                break
            got = verified(fp, near, at, at + lag, most)
            i.append(got[0]), j.append(got[1])
        for k in np.flatnonzero(sizes > SMALL):
            kind = int(key[cuts[k]] >> 28)
            free = [b for b in range(64) if b not in set(bits[kind])]
            idx = np.arange(cuts[k], cuts[k + 1])
            root = np.arange(len(idx))
            for a, b in links_in(fp, near, idx, free, most):
                root = root[roots(len(idx), np.concatenate([np.arange(len(idx)), a - idx[0]]), np.concatenate([root, b - idx[0]]))]
            i.append(idx), j.append(idx[root])
        i, j = np.concatenate(i), np.concatenate(j)
        names, at = np.unique(np.concatenate([fp[i], fp[j]]).view(np.int64), return_inverse=True)
        root = roots(len(names), at[: len(i)], at[len(i) :])
        own = root != np.arange(len(names))
        return pa.RecordBatch.from_arrays([pa.array(names[root[own]]), pa.array(names[own])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for b in batches:
            key, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            held.append((key, fp))
            rows += len(key)
            if rows >= 100_000 and held[0][0][0] != key[-1]:  # all but the last key are whole
                key, fp = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(key, key[-1]))
                yield stars(key[:cut], fp[:cut])
                held, rows = [(key[cut:], fp[cut:])], len(key) - cut
        if held:
            yield stars(*(np.concatenate(x) for x in zip(*held)))

    return keyed(fps).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges: label is the least node of its component.

    Rounds of least neighbouring label and label of label; each round is a written table.
    """
    both = stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("to")).agg(F.min("label").alias("heard"))
        met = labels.join(heard, F.col("node") == F.col("to")).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        up = met.select(F.col("node").alias("up"), F.col("label").alias("above"))
        new = stored(met.join(up, F.col("label") == F.col("up")).select("node", "old", F.least("label", "above").alias("label")), "labels")
        if not new.where("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, most: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id: one row per document, named by the smallest doc_id of its group."""
    marked = stored(fingerprints(docs, shingle, seed), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(links(classes.select("fp"), most))
    linked = classes.join(labels, F.col("fp") == F.col("node"))
    names = linked.groupBy(F.col("label").alias("l")).agg(F.min("least").alias("name"))
    named = linked.join(names, F.col("label") == F.col("l")).select(F.col("fp").alias("n_fp"), "name")
    classes = stored(classes.join(named, F.col("fp") == F.col("n_fp"), "left").select(F.col("fp").alias("c_fp"), F.coalesce("name", "least").alias("component_id")), "groups")
    return marked.join(classes, F.col("fp") == F.col("c_fp")).select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
