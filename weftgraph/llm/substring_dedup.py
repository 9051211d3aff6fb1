"""Exact removal of repeated 100-byte strings.

Every string of ``SIZE`` bytes holds an anchor: the ``CORE``-byte string with the least hash of those in it,
so equal strings have equal anchors at equal places. An anchor's context is all bytes of the strings that
hold it. The work goes in three steps, each a stream over sorted rows:

1. Anchors are dealt by their hash. Of those with one context, all but the first lie in copies and their
   whole context is covered. Each batch of texts keeps its first of a context only and covers the others
   at once, so a passage that a third of all texts share is one row for each batch.
2. One occurrence of each context goes on if its anchor has other contexts too: near a passage's
   ends, contexts agree in part. Their bytes are fetched and dealt by anchor, and all their strings of
   ``SIZE`` bytes are compared by hash. An anchor with more than ``BIG`` contexts is dealt by the strings'
   hashes instead, so no task ever holds such a group.
3. Covered spans are collected per document and merged; the rest of the text is hashed.

"Earlier" is by doc_id (null last), then start. Matches never cross documents.

The README says why this is not a merge of Burrows-Wheeler transforms, with figures.

Edge cases: null text is empty; texts under ``SIZE`` bytes lose nothing; a repeated doc_id orders by a hash
of the text and rows that repeat both are one document, each losing what that one loses; an empty table
gives no rows; columns besides doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import mix64, pieces, stored, table

#: The query's contract fixes SIZE.
SIZE, CORE, BIG = 100, 32, 20_000
BASE = 0x9E3779B97F4A7C15
GROWN: dict[str, np.ndarray] = {}


def tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64 up to n, and a code for each byte."""
    if not GROWN or len(GROWN["up"]) <= n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            run = np.full(max(n + 1, 1 << 16), base, np.uint64)
            run[0] = 1
            GROWN[name] = np.cumprod(run)
        GROWN["code"] = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return GROWN["up"], GROWN["down"], GROWN["code"]


def sums(raw: bytes) -> np.ndarray:
    """Prefix sums from which the hash of any span follows."""
    up, _, code = tables(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(code[np.frombuffer(raw, np.uint8)] * up[: len(raw)], out=out[1:])
    return out


def spans(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the spans [a, b)."""
    return mix64((s[b] - s[a]) * tables(len(s))[1][a] + (b - a).astype(np.uint64) * np.uint64(BASE))


def slide(x: np.ndarray, width: int, f: Callable) -> np.ndarray:
    """f over each ``width`` neighbours, by doubling."""
    s = 1
    while 2 * s <= width:
        x, s = f(x[:-s], x[s:]), 2 * s
    return f(x[: len(x) - (width - s)], x[width - s :]) if s < width else x


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, context hash and place of every anchor of a text of SIZE bytes or more."""
    n, width = len(raw), SIZE - CORE + 1
    s = sums(raw)
    at = np.arange(n - CORE + 1)
    h = spans(s, at, at + CORE)
    least = slide(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    p = np.flatnonzero(slide(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    a, b = np.maximum(p - (SIZE - CORE), 0), np.minimum(p + SIZE, n)
    return h[p], spans(s, a, b) ^ mix64((p - a).astype(np.uint64)), p


def merged(k: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans [a, b) of each k."""
    if not len(k):
        return k, a, b
    order = np.lexsort((a, k))
    k, a, b = k[order], a[order], b[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    part = np.cumsum(new) - 1
    lift = part * np.int64(1 << 40)  # so that a running maximum restarts with each k
    reach = np.maximum.accumulate(b + lift) - lift
    start = new.copy()
    start[1:] |= a[1:] > reach[:-1]
    first = np.flatnonzero(start)
    return k[first], a[first], np.maximum.reduceat(b, first)


def batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


FOUND = "h long, c long, k long, p int, b int"


def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First anchors of each context in a batch of texts (b = -1), and spans that the others cover (p to b)."""
    for part in pieces(batches, "text", 4_000_000):
        got = [[], [], [], []]
        for k, raw in zip(part.column("k").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
            if len(raw) >= SIZE:
                h, c, p = anchors(raw)
                for column, x in zip(got, (h, c, np.full(len(p), k, np.int64), p)):
                    column.append(x)
        if not got[0]:
            continue
        h, c, k, p = (np.concatenate(x) for x in got)
        order = np.lexsort((p, k, c))
        h, c, k, p = h[order], c[order], k[order], p[order]
        first = np.concatenate([[True], c[1:] != c[:-1]])
        ck, ca, cb = merged(k[~first], np.maximum(p[~first] - (SIZE - CORE), 0), p[~first] + SIZE)
        names = ["h", "c", "k", "p", "b"]
        yield batch(names, h[first].view(np.int64), c[first].view(np.int64), k[first], p[first].astype(np.int32), np.full(int(first.sum()), -1, np.int32))
        if len(ck):
            spread = mix64(ck.view(np.uint64) + ca.astype(np.uint64)).view(np.int64)
            yield batch(names, spread, np.zeros(len(ck), np.int64), ck, ca.astype(np.int32), cb.astype(np.int32))


def runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Whole runs of equal first columns, about ``rows`` rows at a time."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield t.slice(0, cut).combine_chunks().to_batches()[0]
            t = t.slice(cut).combine_chunks()
            held, n = t.to_batches(), 0 if cut else -t.num_rows  # a run that fills all doubles before the next try
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def compare_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans (h null), and for anchors with several contexts the first occurrence of each (b: whether dealt by strings)."""
    for part in runs(batches, 100_000):
        h, c, k, p, b = (part.column(i).to_numpy() for i in range(5))
        is_span = b >= 0
        sk, sa, sb = k[is_span], p[is_span], b[is_span]
        h, c, k, p = h[~is_span], c[~is_span], k[~is_span], p[~is_span].astype(np.int64)
        if len(h):
            first = np.concatenate([[True], (c[1:] != c[:-1]) | (h[1:] != h[:-1])])
            sk, sa, sb = np.concatenate([sk, k[~first]]), np.concatenate([sa, np.maximum(p[~first] - (SIZE - CORE), 0)]), np.concatenate([sb, p[~first] + SIZE])
            h, k, p = h[first], k[first], p[first]
            names, size = np.unique(h, return_counts=True)
            n = size[np.searchsorted(names, h)]
            on = n > 1
            yield batch(["h", "k", "a", "b"], h[on], k[on], p[on].astype(np.int32), (n[on] > BIG).astype(np.int32))
        if len(sk):
            ck, ca, cb = merged(sk, sa.astype(np.int64), sb.astype(np.int64))
            yield batch(["h", "k", "a", "b"], pa.nulls(len(ck), pa.int64()), ck, ca.astype(np.int32), cb.astype(np.int32))


def earlier(w: np.ndarray, k: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Indices of the strings (hash w, document k, start s) of which there is an earlier one."""
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    among = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if not len(among):
        return among
    among = among[np.lexsort((s[among], k[among], w[among]))]
    w, k, s = w[among], k[among], s[among]
    new = np.concatenate([[True], w[1:] != w[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return among[(k != k[first]) | (s != s[first])]


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts by anchor (kind 0), strings by hash (kind 1), and spans already covered (kind 2)."""
    names = ["key", "kind", "k", "p", "b", "ctx"]
    for part in pieces(batches, "text", 4_000_000):
        key, kk, pp, bb, ctx = [], [], [], [], []
        big = [[], [], []]
        for k, raw, reps in zip(part.column("k").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), part.column("reps").to_pylist()):
            s = None
            for rep in reps:
                p, n = rep["a"], len(raw)
                a, b = max(0, p - (SIZE - CORE)), min(n, p + SIZE)
                if rep["b"]:
                    s = sums(raw) if s is None else s
                    at = np.arange(a, b - SIZE + 1)
                    for column, x in zip(big, (spans(s, at, at + SIZE), np.full(len(at), k, np.int64), at)):
                        column.append(x)
                else:
                    key.append(rep["h"]), kk.append(k), pp.append(p), bb.append(p - a), ctx.append(raw[a:b])
        if key:
            n = len(key)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.zeros(n, np.int32)), pa.array(kk, pa.int64()), pa.array(pp, pa.int32()), pa.array(bb, pa.int32()), pa.array(ctx, pa.binary())], names=names)
        if big[0]:
            w, k, at = (np.concatenate(x) for x in big)
            order = np.lexsort((at, k, w))
            w, k, at = w[order], k[order], at[order]
            first = np.concatenate([[True], w[1:] != w[:-1]])
            of = np.flatnonzero(first)[np.cumsum(first) - 1]
            later = (k != k[of]) | (at != at[of])
            n = int(first.sum())
            yield pa.RecordBatch.from_arrays([pa.array(w[first].view(np.int64)), pa.array(np.ones(n, np.int32)), pa.array(k[first]), pa.array(at[first].astype(np.int32)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.binary())], names=names)
            ck, ca, cb = merged(k[later], at[later], at[later] + SIZE)
            n = len(ck)
            if n:
                spread = mix64(ck.view(np.uint64) + ca.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(np.full(n, 2, np.int32)), pa.array(ck), pa.array(ca.astype(np.int32)), pa.array(cb.astype(np.int32)), pa.nulls(n, pa.binary())], names=names)


def strings_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents and starts of all strings of SIZE bytes in the contexts."""
    k, p, left = (part.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4))
    ctx = part.column(5)
    sizes = np.asarray(pa.compute.binary_length(ctx), np.int64)
    flat = np.frombuffer(b"".join(ctx.to_pylist()), np.uint8)
    wide = 2 * SIZE - CORE
    grid = np.zeros((len(k), wide), np.uint8)  # anchors stand in one column
    row = np.repeat(np.arange(len(k)), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(SIZE - CORE - left, sizes)
    grid[row, col] = flat
    up, down, code = tables(wide)
    s = np.zeros((len(k), wide + 1), np.uint64)
    np.cumsum(code[grid] * up[:wide], axis=1, out=s[:, 1:])
    starts = wide - SIZE + 1
    w = mix64((s[:, SIZE:] - s[:, :starts]) * down[:starts])
    at = np.arange(starts)
    begin = SIZE - CORE - left
    ok = (at[None, :] >= begin[:, None]) & (at[None, :] + SIZE <= (begin + sizes)[:, None])
    i, j = np.nonzero(ok)
    return w[i, j], k[i], p[i] - (SIZE - CORE) + j


def compare_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans."""
    for part in runs(batches, 4096):
        kind = part.column(1).to_numpy()
        out = []
        if (kind == 0).any():
            w, k, s = strings_of(part.filter(pa.array(kind == 0)))
            at = earlier(w, k, s)
            out.append((k[at], s[at], s[at] + SIZE))
        if (kind == 1).any():
            some = part.filter(pa.array(kind == 1))
            w, k, s = some.column(0).to_numpy(), some.column(2).to_numpy(), some.column(3).to_numpy().astype(np.int64)
            at = earlier(w, k, s)
            out.append((k[at], s[at], s[at] + SIZE))
        if (kind == 2).any():
            some = part.filter(pa.array(kind == 2))
            out.append(tuple(some.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4)))
        k, a, b = merged(*(np.concatenate(x) for x in zip(*out)))
        if len(k):
            yield batch(["k", "a", "b"], k, a.astype(np.int32), b.astype(np.int32))


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text and k, which orders documents; where doc_ids repeat (true), k is the place by doc_id and text hash."""
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), k.alias("k"))
    if not rows.groupBy("k").count().where("count > 1").limit(1).count():
        return rows, False
    from weftgraph.llm.line_dedup import ranks

    rows = rows.withColumn("th", F.xxhash64("text"))
    order = ranks(rows.select("k", "th").distinct()).select(F.col("k").alias("rk"), F.col("th").alias("rt"), "rank")
    return rows.join(order, (F.col("k") == F.col("rk")) & (F.col("th") == F.col("rt"))).select("doc_id", "text", F.col("rank").alias("k")), True


def covered(text: DataFrame) -> DataFrame:
    """k, a, b: spans of documents (k, text) whose every byte is in a string that also starts earlier; they may overlap and pass the text's end."""
    found = text.mapInArrow(find, FOUND).repartition("h").sortWithinPartitions("h", "c", "k", "p")
    first = stored(found.mapInArrow(compare_contexts, "h long, k long, a int, b int"), "contexts")
    reps = first.where("h IS NOT NULL").groupBy(F.col("k").alias("rk")).agg(F.collect_list(F.struct("h", "a", "b")).alias("reps"))
    some = text.join(reps, F.col("k") == F.col("rk")).select("k", "text", "reps")
    rest = some.mapInArrow(fetch, "key long, kind int, k long, p int, b int, ctx binary").repartition("key").sortWithinPartitions("key", "kind", "k", "p")
    second = rest.mapInArrow(compare_strings, "k long, a int, b int")
    return stored(first.where("h IS NULL").select("k", "a", "b").union(second), "spans")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed, disjoint, ascending), kept (the remaining bytes)."""
    rows, repeat = keyed(docs)
    text = rows.select("k", "text")
    gone = covered(text.dropDuplicates(["k"]) if repeat else text).groupBy(F.col("k").alias("gk")).agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    joined = rows.join(gone, F.col("k") == F.col("gk"), "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            ids, size, runs_, kept = [], [], [], []
            for doc_id, raw, gone in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), part.column("gone").to_pylist()):
                a = np.array([x["a"] for x in gone or []], np.int64)
                b = np.minimum(np.array([x["b"] for x in gone or []], np.int64), len(raw))
                _, a, b = merged(np.zeros(len(a), np.int64), a, b)
                edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(raw)]
                ids.append(doc_id), size.append(len(raw)), runs_.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
                kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(runs_, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = removed(table(spark, sf_dir, "documents"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return done.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
