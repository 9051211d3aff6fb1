"""Near copies by shingle overlap: SimHash with pivot distance tables, survivors checked on the shingles.

Two texts are linked when their sets of distinct five-word shingles (A-Z lower-cased) have a Jaccard
similarity of ``LIKENESS`` or more; groups are connected components. A pair at 0.8 differs in about a
seventh of its SimHash bits, far more than a few bits' worth of blocks can meet, so fingerprints here
have 256 bits and meet in tables of sampled bits. A table's key has about log2(n) - 4 bits, so that unrelated
texts share a key with 16 others on average at every size, and there are as many tables as a pair at
``LIKENESS`` needs to meet with probability ``MEET``; pairs that are more alike meet more surely.

Fingerprints that meet are put in a table of Hamming distances to pivots. The pivots are members of the
bucket: at this radius, distances to fixed random fingerprints are all alike and discard nothing. Pairs
whose rows differ by more than ``MOST`` in a coordinate are discarded, the others' own distance is taken,
and those within ``MOST`` are checked: ``SURE`` or fewer differing bits need no more, for the rest the
shingle sets are compared. Links leave in two rounds, so that large groups never give all their
pairs: first each fingerprint's ``NEAREST`` in each bucket, then, after the links found have joined
groups, every pair within ``MOST`` whose two sides are still in different groups. In that round, a second
fingerprint of 1024 bits discards, inside the task, pairs that differ in more than ``LONG_MOST`` of its bits: texts a
little less alike than ``LIKENESS`` pass 256 bits in numbers that grow with the square of their group. Buckets are
compared whole at every size, in blocks; one bucket is one task's work, which grows with the square of a group that fills it.

Known limits: a pair at exactly ``LIKENESS`` is met with probability ``MEET`` (times 0.998, its chance to be
within ``MOST``, and 0.999, to be within ``LONG_MOST``), one pair in 40,000 at ``LIKENESS`` may be taken as sure while below, and sets and fingerprints
rest on hashes (32 bits within a pair, 64 between texts).

Edge cases: null text is empty; texts without words are one group; fewer than five words make one shingle;
repeated rows and equal texts are one class; a null doc_id never names a group unless it has no other;
an empty table gives no rows; columns besides doc_id and text play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, mix64, pieces, span_hashes, stored, texts, word_spans
from weftgraph.llm.simhash import components

SHINGLE, LIKENESS, MEET = 5, 0.8, 0.98
LANES = 4
BITS = 64 * LANES
MOST, SURE, NEAREST = 56, 15, 2
#: A pair at 0.8 differs in 155 of 1024 bits, with a standard deviation of 11.5; one at 0.65 in 217.
LONG_LANES, LONG_MOST = 16, 193
PIVOTS, WIDE, ROWS, COLS, FLUSH = 8, 256, 128, 4096, 2_000_000
#: Rows whose small buckets are compared at once.
SOME = 8_192
FP = [f"f{i}" for i in range(LANES)]


def shingles(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's distinct shingles, ascending; none for a text without words."""
    b = np.frombuffer(raw.lower(), np.uint8)
    words = span_hashes(b, *word_spans(b))
    n = max(1, len(words) - shingle + 1)
    if not len(words):
        return words
    h = np.full(n, min(shingle, len(words)), np.uint64)
    for j in range(min(shingle, len(words))):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return np.unique(h)


def wide_fingerprint(h: np.ndarray, width: int = LANES) -> np.ndarray:
    """Bits (64 a lane) by majority over a set of shingle hashes."""
    out = np.zeros(width, np.uint64)
    lanes = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for lane in range(width if len(h) else 0):
        counts = np.zeros(64, np.int64)
        for a in range(0, len(h), 1 << 15):
            bits = np.unpackbits(mix64(h[a : a + (1 << 15)] + lanes[lane]).view(np.uint8).reshape(-1, 8), axis=1)
            for c in range(0, len(bits), 255):
                counts += bits[c : c + 255].sum(axis=0, dtype=np.uint8)
        out[lane] = np.packbits(counts * 2 > len(h)).view(np.uint64)[0]
    return out


def marks(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th (hash of the text), f0..f3, n (distinct shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [shingles(x.as_py(), shingle) for x in b.column("text").cast(pa.binary())]
            fp = np.array([wide_fingerprint(s) for s in sets]).view(np.int64).reshape(-1, LANES)
            cols = [pa.array(np.ascontiguousarray(fp[:, i])) for i in range(LANES)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("th"), *cols, pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "th", *FP, "n"])

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    return arrow_map(rows, run, f"doc_id long, th long, {', '.join(f'{f} long' for f in FP)}, n long")


def table_plan(n: int, likeness: float = LIKENESS) -> tuple[int, int]:
    """Bits of a key and number of tables for n fingerprints."""
    size = max(8, math.ceil(math.log2(max(n, 2))) - 4)
    apart = math.acos(2 * likeness / (1 + likeness)) / math.pi
    return size, math.ceil(math.log(1 - MEET) / math.log(1 - (1 - apart) ** size))


def keyed(classes: DataFrame, size: int, tables: int) -> DataFrame:
    """A row for each class and table: the key, and the class with its columns."""
    rng = np.random.default_rng(5)
    picks = [rng.choice(BITS, size, replace=False) for _ in range(tables)]
    schema = classes.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                fp = np.stack([b.column(f).to_numpy() for f in FP], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1)
                weights = 1 << np.arange(size, dtype=np.int64)
                for t, pick in enumerate(picks):
                    key = mix64((bits[:, pick] @ weights + (t << 48)).astype(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], names=["key", *b.schema.names])

    return arrow_map(classes, run, "key long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def bucket_pairs(fp: np.ndarray, n: np.ndarray, label: np.ndarray | None, likeness: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs of one bucket within ``MOST``: with labels all of unequal labels, else each row's nearest.

    Exact at every size. Blocks of ``ROWS`` rows go against blocks of ``COLS``, so memory does not grow with the
    bucket. In a bucket of more than ``COLS``, each row's nearest before it is given too: it joins a tight group,
    whose members then have one label in the second round.
    """
    m = len(fp)
    refs = fp[np.linspace(0, m - 1, min(m, PIVOTS)).astype(int)]
    near = np.stack([hamming(fp, r) for r in refs], axis=1)
    order = np.argsort(near[:, 0], kind="stable")
    fp, n, near = np.ascontiguousarray(fp[order].T), n[order], np.ascontiguousarray(near[order].T)
    label = None if label is None else label[order]
    first, places = near[0], np.arange(m)
    for a in range(0, m, ROWS):
        b = min(a + ROWS, m)
        lo, hi = np.searchsorted(first, first[a] - MOST), np.searchsorted(first, first[b - 1] + MOST, side="right")
        best: dict[bool, list] = {False: [], True: []}
        for c in range(lo, hi, COLS):
            e = min(c + COLS, hi)
            meet = places[a:b, None] != places[None, c:e] if label is None else (label[a:b, None] != label[None, c:e]) & (places[a:b, None] < places[None, c:e])
            if not meet.any():
                continue
            for p in near:
                meet &= np.abs(p[a:b, None] - p[None, c:e]) <= MOST
            meet &= np.minimum(n[a:b, None], n[None, c:e]) >= likeness * np.maximum(n[a:b, None], n[None, c:e])
            if not meet.any():
                continue
            apart = np.zeros(meet.shape, np.int16)
            for lane in fp:
                apart += np.bitwise_count(lane[a:b, None] ^ lane[None, c:e])
            meet &= apart <= MOST
            if label is not None:
                i, j = np.nonzero(meet)
                yield order[a + i], order[c + j], apart[i, j]
                continue
            apart[~meet] = BITS + 1
            before = np.where(places[None, c:e] < places[a:b, None], apart, np.int16(BITS + 1)) if m > COLS and c < b else None
            for _ in range(NEAREST):
                best[False].append(least(apart, a, c))
            if before is not None:
                best[True].append(least(before, a, c))
        for tree, found in best.items():
            if not found:
                continue
            i, j, d = (np.concatenate(x) for x in zip(*found))
            by = np.lexsort((d, i))
            i, j, d = i[by], j[by], d[by]
            start = np.concatenate([[True], i[1:] != i[:-1]])
            place = np.arange(len(i)) - np.maximum.accumulate(np.where(start, np.arange(len(i)), 0))
            keep = (place < (1 if tree else NEAREST)) & (d <= MOST)
            yield order[i[keep]], order[j[keep]], d[keep]


def least(apart: np.ndarray, a: int, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column (counted from a and c) and value of the least of each row, which is taken out."""
    rows, at = np.arange(len(apart)), apart.argmin(axis=1)
    d = apart[rows, at]
    apart[rows, at] = BITS + 1
    return a + rows, c + at, d


def small_pairs(key: np.ndarray, fp: np.ndarray, n: np.ndarray, label: np.ndarray | None, wide: np.ndarray | None, likeness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) as of ``bucket_pairs``, in all whole buckets of up to ``WIDE`` rows at once; the first member is the pivot.

    With labels, pairs that differ in more than ``LONG_MOST`` bits of the long fingerprints are left out too. What is held at
    once are the pairs of the given rows, up to ``WIDE`` / 2 a row.
    """
    none = np.zeros(0, np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(fp)]])
    sizes = np.diff(cuts)
    size = np.repeat(sizes, sizes)
    near, found = hamming(fp, fp[np.repeat(cuts[:-1], sizes)]), [(none, none, np.zeros(0, np.int16))]
    for lag in range(1, min(WIDE, int(sizes.max(initial=0)))):
        at = np.flatnonzero((key[:-lag] == key[lag:]) & (size[:-lag] <= WIDE))
        if not len(at):
            break
        at = at[np.abs(near[at] - near[at + lag]) <= MOST]
        at = at[np.minimum(n[at], n[at + lag]) >= likeness * np.maximum(n[at], n[at + lag])]
        if label is not None:
            at = at[label[at] != label[at + lag]]
        d = hamming(fp[at], fp[at + lag])
        at, d = at[d <= MOST], d[d <= MOST]
        if label is not None:
            close = hamming(wide[at], wide[at + lag]) <= LONG_MOST
            at, d = at[close], d[close]
        found.append((at, at + lag, d))
    i, j, d = (np.concatenate(x) for x in zip(*found))
    if label is None:  # each row's nearest in its bucket
        i, j, d = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d])
        by = np.lexsort((d, i))
        i, j, d = i[by], j[by], d[by]
        start = np.concatenate([[True], i[1:] != i[:-1]])[: len(i)]
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(start, np.arange(len(i)), 0)) if len(i) else i
        i, j, d = (x[place < NEAREST] for x in (i, j, d))
    return i, j, d


def pair_batch(c: dict[str, np.ndarray], found: list) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    i, j, d = (np.concatenate([none, *x]).astype(np.int64) for x in (zip(*found) if found else (none, none, none)))
    a, b = np.minimum(c["node"][i], c["node"][j]), np.maximum(c["node"][i], c["node"][j])
    a, b, d = np.unique(np.stack([a, b, d]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["a", "b", "d"])


def chunk_pairs(c: dict[str, np.ndarray], labelled: bool, likeness: float) -> Iterator[pa.RecordBatch]:
    """Batches (a, b, d) of the pairs in whole buckets of rows, sorted by key; what is held at once doesn't grow with their number."""
    fp = np.ascontiguousarray(np.stack([c[f] for f in FP], axis=1)).view(np.uint64)
    cuts = np.flatnonzero(np.diff(c["key"])) + 1
    cuts = np.concatenate([[0], cuts, [len(fp)]])
    sizes = np.diff(cuts)
    found, many = [], 0
    wide = np.frombuffer(b"".join(c["long"]), np.uint64).reshape(-1, LONG_LANES) if labelled and len(fp) else None
    starts = np.unique(cuts[np.searchsorted(cuts, np.arange(0, len(fp), SOME))])  # of whole buckets
    for x, y in zip(starts, [*starts[1:], len(fp)]):
        own = slice(x, y)
        i, j, d = small_pairs(c["key"][own], fp[own], c["n"][own], c["label"][own] if labelled else None, wide[own] if labelled else None, likeness)
        found.append((i + x, j + x, d))
        many += len(i)
        if many >= FLUSH:
            yield pair_batch(c, found)
            found, many = [], 0
    for k in np.flatnonzero(sizes > WIDE):
        s = slice(cuts[k], cuts[k + 1])
        for i, j, d in bucket_pairs(fp[s], c["n"][s], c["label"][s] if labelled else None, likeness):
            i, j = i + cuts[k], j + cuts[k]
            if labelled and len(i):
                close = np.concatenate([hamming(wide[i[x : x + 65_536]], wide[j[x : x + 65_536]]) <= LONG_MOST for x in range(0, len(i), 65_536)])
                i, j, d = i[close], j[close], d[close]
            found.append((i, j, d))
            many += len(i)
            if many >= FLUSH:
                yield pair_batch(c, found)
                found, many = [], 0
    yield pair_batch(c, found)


def candidates(classes: DataFrame, plan: tuple[int, int], labelled: bool, likeness: float) -> DataFrame:
    """Distinct (a, b, d), a < b: pairs of nodes that survive the pivots and are within ``MOST``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append({f: np.array(b.column(f).to_pylist(), object) if f == "long" else b.column(f).to_numpy() for f in b.schema.names})
            rows += b.num_rows
            if rows >= 100_000 and held[0]["key"][0] != held[-1]["key"][-1]:  # all but the last key are whole
                c = {f: np.concatenate([h[f] for h in held]) for f in held[0]}
                cut = int(np.flatnonzero(c["key"] == c["key"][-1])[0])
                yield from chunk_pairs({f: x[:cut] for f, x in c.items()}, labelled, likeness)
                held, rows = [{f: x[cut:] for f, x in c.items()}], rows - cut
        if held:
            yield from chunk_pairs({f: np.concatenate([h[f] for h in held]) for f in held[0]}, labelled, likeness)

    return keyed(classes, *plan).repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long, d long").distinct()


def shingle_sets(docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """node, its shingle set as ascending 32-bit hashes in one binary, and its long fingerprint, for the representatives (r_id, r_th, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            hashes = [shingles(x.as_py(), shingle) for x in b.column("text").cast(pa.binary())]
            sets = [np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in hashes]
            wide = [wide_fingerprint(h, LONG_LANES).tobytes() for h in hashes]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary()), pa.array(wide, pa.binary())], names=["node", "s", "long"])

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    met = rows.join(reps, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")))
    return arrow_map(met.select("node", "text"), run, "node long, s binary, long binary").dropDuplicates(["node"])


def checked(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "sa"):
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                x, y = (np.frombuffer(v.as_py(), np.uint32) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= likeness * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    met = pairs.select("a", "b").join(left, F.col("a") == F.col("na")).join(right, F.col("b") == F.col("nb"))
    return arrow_map(met.select("a", "b", "sa", "sb"), run, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, likeness: float = LIKENESS, only: DataFrame | None = None) -> DataFrame:
    """doc_id, th (hash of the text), component_id: one row per document, named by the smallest doc_id of its group.

    ``only`` holds, as ``only_id``, the doc_ids of the documents that take part; the texts themselves are not moved for it.
    """
    marked = marks(docs, shingle).withColumn("node", F.xxhash64(*FP))
    marked = stored(marked if only is None else marked.join(only, F.col("doc_id") == F.col("only_id"), "left_semi"), "marks")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"))).alias("rep")
    classes = stored(marked.groupBy("node").agg(*[F.first(f).alias(f) for f in FP], F.max("n").alias("n"), rep, F.min("doc_id").alias("least")), "classes")
    plan = table_plan(classes.count(), likeness)
    # Texts without words have no bit set; they are one class and link to no other.
    first = stored(candidates(classes.select("node", *FP, "n"), plan, False, likeness), "pairs")
    ends = first.select(F.explode(F.array("a", "b")).alias("e")).distinct()
    some = stored(classes.join(ends, F.col("node") == F.col("e")).select("node", *FP, "n", "rep.r_id", "rep.r_th"), "candidates")
    sets = stored(shingle_sets(docs, some.select("r_id", "r_th", "node"), shingle), "sets")
    sure = F.col("d") <= SURE
    links = stored(first.where(sure).select("a", "b").union(checked(first.where(~sure), sets, likeness)), "links")
    labels = components(links)
    named = some.join(labels.select(F.col("node").alias("l_node"), "label"), F.col("node") == F.col("l_node"), "left")
    named = named.select("node", *FP, "n", F.coalesce("label", "node").alias("label"))
    named = named.join(sets.select(F.col("node").alias("s_node"), "long"), F.col("node") == F.col("s_node")).drop("s_node")
    more = candidates(named, plan, True, likeness).join(first.select("a", "b"), ["a", "b"], "left_anti")
    more = stored(more, "pairs")
    late = stored(more.where(sure).select("a", "b").union(checked(more.where(~sure), sets, likeness)), "links")
    if late.limit(1).count():
        labels = components(links.union(late))
    linked = classes.join(labels.select(F.col("node").alias("l_node"), "label"), F.col("node") == F.col("l_node"))
    names = linked.groupBy(F.col("label").alias("l")).agg(F.min("least").alias("name"))
    named = linked.join(names, F.col("label") == F.col("l")).select(F.col("node").alias("n_node"), "name")
    whole = stored(classes.join(named, F.col("node") == F.col("n_node"), "left").select(F.col("node").alias("c_node"), F.coalesce("name", "least").alias("component_id")), "groups")
    return marked.join(whole, F.col("node") == F.col("c_node")).select("doc_id", "th", "component_id")


def later_copies(docs: DataFrame, shingle: int, likeness: float, only: DataFrame | None = None) -> DataFrame:
    """gone_id, gone_th: the documents that have a copy with a smaller doc_id."""
    gone = near_groups(docs, shingle, likeness, only).where(F.col("doc_id") != F.col("component_id"))
    return stored(gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct(), "gone")


def without_near_copies(docs: DataFrame, shingle: int = SHINGLE, likeness: float = LIKENESS, originals: DataFrame | None = None) -> DataFrame:
    """The document with the smallest doc_id of each group, with the columns it came with.

    Rows with the same doc_id and text count as one, and texts that share the smallest doc_id all stay. A null
    doc_id is no name, so such rows stay beside a named group, and one row is left of those with equal texts.

    ``originals`` (doc_id, text) are the documents as they were before earlier stages cut lines out of them. Of the
    documents that are left after the first comparison, those whose original texts are copies are then reduced to
    the first in the same way. A doc_id that is null, or that ``originals`` hold more than once, takes no part in this.
    """
    gone = later_copies(docs, shingle, likeness)
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    kept = docs.join(gone, (F.col("doc_id").cast("long") == F.col("gone_id")) & (th == F.col("gone_th")), "left_anti")
    if originals is not None:
        left = docs.select(F.col("doc_id").cast("long").alias("only_id"), th.alias("th")).join(gone, (F.col("only_id") == F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left_anti")
        once = originals.groupBy(F.col("doc_id").cast("long").alias("o_id")).agg(F.count("*").alias("n")).where("n = 1")
        only = stored(left.select("only_id").distinct().join(once, F.col("only_id") == F.col("o_id"), "left_semi"), "left")
        also = later_copies(originals, shingle, likeness, only).select(F.col("gone_id").alias("also_id"))
        kept = kept.join(also, F.col("doc_id").cast("long") == F.col("also_id"), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]).select(*docs.columns)
