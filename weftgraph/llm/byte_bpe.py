"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A text is cut into pieces by the tokenizer's pattern. A piece that is a token as it stands is that
token; any other starts as the tokens of its bytes, and a fold merges, again and again, the
leftmost of the adjacent pairs with the lowest rank, looking ranks up in a literal map. The fold's
state is one array that holds each token with its pair's rank, so that a merge looks up two ranks only.
Ranks are below 2**20. The first merges of the vocabulary, as far as no later merge can come before one of them, are made
in the piece's text by replacement, so that the fold starts from fewer tokens. Long pieces are cut where no token of the vocabulary has the two bytes side by side, since no merge crosses
that; a stretch without such a place takes time in the square of its length, and one of over 2**23 bytes raises.

Frequent distinct pieces are folded once beforehand, and their tokens decoded once, into a second literal map of those
that decode to themselves, beside the vocabulary's pieces that merges wouldn't give; every other piece is folded and decoded where it stands, so the map's size changes the
speed and never the result. It is drawn from ``memo_docs`` documents and holds ``memo`` pieces at most.

Decoding looks up each id's bytes and concatenates them. The lookup tables are made in a task from the vocabulary's file, and the driver holds them only as
the queries' values. Tokens leave a piece as hexadecimal little-endian
numbers, as wide as the vocabulary needs and with zeros between them up to 32 bits, so that a text's tokens
are its pieces' joined.

Edge cases: null and empty texts have no tokens; long pieces are folded like others; repeated rows
and repeated or null doc_ids are rows of their own; an empty table gives no rows; other columns play
no part.
"""

from __future__ import annotations

import base64
import io
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, stored, table, texts

SLOTS = 65_537
SHIFT = 1 << 20
#: A fold's numbers hold rank, place (23 bits) and token (20 bits).
RANK_AT, NO_RANK, LONGEST = 43, (1 << 20) - 1, 1 << 23
#: Merges made by replacement at most, and what a piece then consists of: bytes and these merges' tokens.
EARLY = 40
UNITS = 256 + EARLY
#: Length of the fold's array up to which a merge counts to its place.
SHORT = 64
#: Bytes above which a piece is cut before it is folded, and the mark of a cut, which isn't a Latin-1 letter.
CUT, APART = 128, "\u0100"
#: Size of the map of frequent pieces, and of the sample of documents that it is drawn from.
MEMO, MEMO_DOCS = 300_000, 30_000
#: Unicode's White_Space, the tokenizer library's \s.
SPACE = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def ranks_in(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return ranks_in(f)


def early_merges(ranks: dict[bytes, int]) -> tuple[list[bytes], list[tuple[str, str]]]:
    """Tokens of the vocabulary's first merges, and what to replace by what, in this order; a token stands as the letter 256 and up.

    Replacing all of a pair at once is what merging the lowest rank first does, if no pair with the new token has a rank as
    low, and if the ways to make the token can't overlap. The list ends before the first token of which that isn't so.
    """
    made: list[bytes] = []
    letter, steps = {bytes([i]): chr(i) for i in range(256)}, []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        ways = [(token[:i], token[i:]) for i in range(1, len(token))]
        ways = [w for w in ways if w[0] in letter and w[1] in letter]
        sooner = any(t.startswith(token) and t[len(token) :] in ranks or t.endswith(token) and t[: -len(token)] in ranks for t in made)
        overlap = len(ways) > 1 and any(token.startswith(token[i:]) for i in range(1, len(token)))
        if len(made) == EARLY or sooner or overlap:
            break
        letter[token] = chr(256 + len(made))
        steps += [(letter[a] + letter[b], letter[token]) for a, b in ways]
        made.append(token)
    return made, steps


def java_pattern(pattern: str) -> str:
    """The library's pattern for Java's regular expressions: white space spelled out."""
    pattern = re.sub(r"\[\^\\s", lambda _: f"[^{SPACE}", pattern)
    return pattern.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def bound(value: Column, kind: str, f) -> Column:
    """``f`` of the value, which is computed once; ``kind`` is the result's type.

    A fold over one element: reading an element of a transformed array would work out the array's type for each row.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: f(x))


def with_tables(rows: DataFrame, tables: Column, name: str, f, words: Column | None = None, kept: list[str] | None = None) -> DataFrame:
    """Adds to ``kept`` columns (all) the column ``name``, ``f`` of the lookup tables.

    The tables are subqueries, which a higher-order function may not hold as written, so they are columns first and
    the optimiser moves them into it. It does so only if what ``f`` reads is not also in ``kept``, or is a stored column.
    """
    held = rows.select("*", tables.alias("bpe_tables"), *([words.alias("bpe_words")] if words is not None else []))
    inner = f if words is None else lambda t: F.get(F.transform(F.array(F.col("bpe_words")), lambda w: f(t, w)), F.lit(0))
    return held.select(*(rows.columns if kept is None else kept), F.get(F.transform(F.array(F.col("bpe_tables")), inner), F.lit(0)).alias(name))


def spelled(values: Iterable) -> str:
    """JSON of a list, written element by element: of what makes these, only the text is held."""
    out = io.StringIO()
    for i, v in enumerate(values):
        out.write("," if i else "[")
        out.write(json.dumps(v, separators=(",", ":")))
    return out.getvalue() + "]" if out.tell() else "[]"


def literal(spark: SparkSession, **tables: tuple[object, str]) -> Column:
    """Lookup tables as one value that the query's plan holds as a scalar subquery: read once, not printed in plans."""
    rows = spark.createDataFrame([tuple(spelled(v) for v, _ in tables.values())], [*tables])
    return parsed(rows, {n: kind for n, (_, kind) in tables.items()}).scalar()


def parsed(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The tables' JSON as one struct ``t``."""
    value = {n: F.from_json(F.concat(F.lit('{"v":'), F.col(n), F.lit("}")), f"v {kind}")["v"] for n, kind in kinds.items()}
    if "keys" in value:
        value["pairs"] = F.zip_with(value.pop("keys"), value.pop("ranks"), F.map_from_arrays)
    return rows.select(F.struct(*[v.alias(n) for n, v in value.items()]).alias("t"))


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """The file at the driver as one row; executors needn't have it."""
    with open(path, "rb") as f:
        return spark.createDataFrame([(bytearray(f.read()),)], "file binary")


def made_tables(spark: SparkSession, path: str) -> Column:
    """All lookup tables of the vocabulary's file as ``literal`` gives them, made and written by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                ranks = ranks_in(file.splitlines())
                tables = {**rank_map(ranks), **byte_tables(ranks)}
                yield pa.RecordBatch.from_pydict({n: [spelled(tables[n][0])] for n in KINDS})

    rows = arrow_map(vocabulary_file(spark, path), run, ", ".join(f"{n} string" for n in KINDS))
    return stored(parsed(rows, KINDS), "tables").scalar()


def own_pieces(spark: SparkSession, path: str) -> DataFrame:
    """w, p: the tokens that are text, with their own numbers as ``coded`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                ranks, own = ranks_in(file.splitlines()), {"w": [], "p": []}
                width = 4 - len(gap_of(ranks)) // 2
                for token, rank in ranks.items():
                    try:
                        own["w"].append(token.decode())
                    except UnicodeDecodeError:
                        continue
                    own["p"].append(rank.to_bytes(width, "little").hex())
                yield pa.RecordBatch.from_pydict(own)

    return arrow_map(vocabulary_file(spark, path), run, "w string, p string")


def rank_map(ranks: dict[bytes, int]) -> dict[str, tuple[object, str]]:
    """Literal tables: keys and ranks of all mergeable pairs by slot, the fold's number of a last unit and of each unit before another, at place 0."""
    found, ranked = array("q"), array("q")
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                found.append(a * SHIFT + b)
                ranked.append(rank)
    keys, values = np.frombuffer(found, np.int64), np.frombuffer(ranked, np.int64)
    order = np.argsort(keys % SLOTS, kind="stable")
    ends = np.searchsorted((keys % SLOTS)[order], np.arange(SLOTS + 1))
    by_slot = lambda x: (x[order[a:b]].tolist() for a, b in zip(ends[:-1], ends[1:]))
    own = [ranks[bytes([i])] for i in range(256)]
    units = [*(bytes([i]) for i in range(256)), *early_merges(ranks)[0]]
    own += [ranks[u] for u in units[256:]]
    units += [b""] * (UNITS - len(units))  # none; no letter stands for these
    first = ((ranks.get(a + b, NO_RANK) if a and b else NO_RANK) << RANK_AT | (ranks[a] if a else 0) for a in units for b in units)
    joins = bytearray(65_536)
    for token in ranks:
        for a, b in zip(token, token[1:]):
            joins[a * 256 + b] = 1
    return {n: (v, KINDS[n]) for n, v in zip(KINDS, (by_slot(keys), by_slot(values), [(NO_RANK << RANK_AT) + x for x in own], first, joins))}


def slots_for(pieces: int) -> int:
    """Slots of the map of frequent pieces: a power of two, two to four pieces a slot."""
    return 1 << max(10, pieces.bit_length() - 2)


def slot_of(piece: Column, slots: int) -> Column:
    return F.hash(piece).bitwiseAND(slots - 1)


def word_map(words: DataFrame, size: int) -> Column:
    """A map from pieces to their tokens, in ``size`` slots by the piece's hash, the most frequent first, as one value that the plan holds as a subquery."""
    slots = words.select(slot_of(F.col("w"), size).alias("slot"), F.coalesce(-F.col("n"), F.lit(0)).alias("n"), "w", "p")
    slots = slots.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("n", "w", "p"))).alias("e")).select("slot", F.transform("e", lambda x: F.struct(x["w"].alias("w"), x["p"].alias("p"))).alias("e"))
    every = words.sparkSession.range(size).select(F.col("id").cast("int").alias("slot"))
    full = every.join(slots, "slot", "left").agg(F.sort_array(F.collect_list(F.struct("slot", "e"))).alias("all"))
    return full.select(F.transform("all", lambda s: F.map_from_entries(F.coalesce(s["e"], F.array().cast("array<struct<w:string,p:string>>")))).alias("words")).scalar()


#: The tables' types.
KINDS = {"keys": "array<array<bigint>>", "ranks": "array<array<bigint>>", "bytes": "array<bigint>", "first": "array<bigint>", "joins": "array<int>", "packed": "array<string>", "text": "array<string>"}


def looked_up(tables: Column, a: Column, b: Column) -> Column:
    """Rank of the pair of tokens (a, b); null where they don't merge or one is null."""

    key = a * SHIFT + b
    return F.get(tables["pairs"], (key % SLOTS).cast("int"))[key]


def folded(tables: Column, piece: Column, short: int = SHORT, early: list[tuple[str, str]] = ()) -> Column:
    """Tokens of one piece by ranked merges; ``early`` are the first merges, as ``early_merges`` gives them (none: all are folded).

    A piece of over ``CUT`` bytes is first cut where two bytes meet that stand side by side in no token of the
    vocabulary: no merge ever crosses such a place, so what is on either side is folded alone.
    """
    latin = F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")

    def parts(chars: Column) -> Column:
        apart = lambda x, i: (i > 0) & (F.get(tables["joins"], F.ascii(F.get(chars, i - 1)) * 256 + F.ascii(x)) == 0)
        marked = F.transform(chars, lambda x, i: F.when(apart(x, i), F.concat(F.lit(APART), x)).otherwise(x))
        return F.flatten(F.transform(F.split(F.array_join(marked, ""), APART), lambda p: merged(tables, p, short, early)))

    return F.when(F.octet_length(piece) <= CUT, merged(tables, latin, short, early)).otherwise(bound(F.split(latin, ""), "array<int>", parts))


def merged(tables: Column, latin: Column, short: int, early: list[tuple[str, str]] = ()) -> Column:
    """Tokens of bytes, given as Latin-1 text, by ranked merges.

    The state is one array with a number for each token: the rank of its pair with the next token (``NO_RANK`` for
    none), the place of its first byte, and the token. So the least number is the lowest rank at its first
    place, and no number is there twice, so that it can be removed by its value. Where more than ``short`` are left, slices
    and concat serve, which cost more a call and less a number. Only the index is bound: a bound array is copied.
    """
    for pair, token in early:
        latin = F.replace(latin, F.lit(pair), F.lit(token))
    units = F.transform(F.split(latin, ""), F.ascii)
    token_of = lambda x: x.bitwiseAND(SHIFT - 1)
    placed = lambda x: x.bitwiseAND((1 << RANK_AT) - 1)  # noqa: E731  place and token

    def start(u: Column) -> Column:
        first = F.transform(u, lambda x, i: F.coalesce(F.get(tables["first"], x * UNITS + F.get(u, i + 1)), F.get(tables["bytes"], x)) + F.shiftleft(i.cast("bigint"), 20))
        return F.when(F.size(u) <= LONGEST, first).otherwise(F.raise_error(F.lit(f"a piece has more than {LONGEST} bytes that merges could join")).cast("array<bigint>"))

    def rank_at(left: Column, right: Column) -> Column:  # of a pair of tokens, as a number has it
        return F.shiftleft(F.coalesce(looked_up(tables, left, right), F.lit(NO_RANK).cast("bigint")), RANK_AT)

    def merge(state: Column, _: Column) -> Column:
        def joined(i: Column) -> Column:  # index of the pair's left token
            least, behind = F.get(state, i), F.get(state, i - 1)
            best = F.shiftright(least, RANK_AT)
            new = rank_at(best, token_of(F.get(state, i + 2))) + least.bitwiseAND((1 << RANK_AT) - SHIFT) + best
            last = rank_at(token_of(behind), best) + placed(behind)
            here = F.array_insert(F.array_remove(F.array_remove(state, F.get(state, i + 1)), least), i + 1, new)
            here = F.when(i > 0, F.array_insert(F.array_remove(here, behind), i, last)).otherwise(here)
            ahead = F.when(i > 0, F.concat(F.slice(state, F.lit(1), i - 1), F.array(last))).otherwise(F.array().cast("array<bigint>"))
            merged = F.when(F.size(state) <= short, here).otherwise(F.concat(ahead, F.array(new), F.slice(state, i + 3, F.size(state))))
            return F.when(least < NO_RANK << RANK_AT, merged).otherwise(state)

        return bound((F.array_position(state, F.array_min(state)) - 1).cast("int"), "array<bigint>", joined)

    done = lambda s: F.transform(s, lambda x: token_of(x).cast("int"))
    return bound(units, "array<int>", lambda u: F.aggregate(F.slice(u, F.lit(2), F.size(u)), start(u), merge, done))


def pieces_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def memo_words(rows: DataFrame, path: str, tables: Column, pattern: str, memo: int, memo_docs: int, gap: str, early: list[tuple[str, str]]) -> DataFrame:
    """w, p, n: the most frequent distinct pieces of a sample with their tokens and counts, all of which decode to themselves.

    A piece that is a token is that token; those that merges alone wouldn't give are all among the rows, with n null.
    """
    spark = rows.sparkSession
    words = own_pieces(spark, path).select("w", "p", F.lit(None).cast("long").alias("n"))
    if memo:
        share = min(1.0, memo_docs / max(1, rows.count()))
        some = rows.select("text").sample(False, share, 1) if share < 1 else rows.select("text")
        seen = some.select(F.explode(pieces_of(F.col("text"), pattern)).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.length("w") <= 64)
        if share > 0.5:  # what a text has once gains nothing by being folded beforehand
            seen = seen.where("n > 1")
        words = words.union(seen.orderBy(F.desc("n"), "w").limit(memo).select("w", F.lit(None).cast("string"), "n"))
    words = words.groupBy("w").agg(F.max("p").alias("own"), F.max("n").alias("n")).repartition(max(16, 2 * spark.sparkContext.defaultParallelism))
    both = F.struct(F.col("w").alias("w"), F.col("own").alias("own"), F.col("n").alias("n"))
    value = lambda t: bound(both, f"struct<w:string,own:string,n:bigint,c:{PIECE}>", lambda r: F.struct(r["w"].alias("w"), r["own"].alias("own"), r["n"].alias("n"), coded(t, r["w"], gap, early).alias("c")))
    found = with_tables(words, tables, "v", value, kept=[]).select("v.*")
    return stored(found.where("n IS NOT NULL AND c.d = w OR own != c.p").select("w", F.coalesce("own", "c.p").alias("p"), "n"), "pieces")


#: A piece's tokens, hexadecimal, and what they decode to.
PIECE = "struct<p:string,d:string>"


def byte_tables(ranks: dict[bytes, int]) -> dict[str, tuple[object, str]]:
    """Of each id: its little-endian form, without the zeros that ``gap_of`` puts between ids, and the bytes it stands for, both hexadecimal."""
    size = max(ranks.values()) + 1
    width = 4 - len(gap_of(ranks)) // 2
    pieces = [b""] * size
    for token, rank in ranks.items():
        pieces[rank] = token
    return {"packed": ((i.to_bytes(width, "little").hex() for i in range(size)), "array<string>"), "text": ((p.hex() for p in pieces), "array<string>")}


def gap_of(ranks: dict[bytes, int]) -> str:
    """What fills an id of this vocabulary up to 32 bits, hexadecimal."""
    return "00" * (4 - max(1, (max(ranks.values()).bit_length() + 7) // 8))


def joined_bytes(ids: Column, parts: Column) -> Column:
    """The hexadecimal parts that the ids stand for, as one binary."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(parts, i)), ""))


def coded(t: Column, piece: Column, gap: str, early: list[tuple[str, str]] = ()) -> Column:
    """A piece's tokens by folding, and their bytes by decoding these; a whole piece's bytes are text again."""
    return bound(folded(t, piece, early=early), PIECE, lambda ids: F.struct(
        F.array_join(F.transform(ids, lambda i: F.get(t["packed"], i)), gap).alias("p"), joined_bytes(ids, t["text"]).cast("string").alias("d")
    ))


#: A whole text, its tokens (little-endian, 32 bits each) and what they decode to.
CODED = "struct<text:string,ids:binary,bytes:binary>"


def text_codes(t: Column, words: Column, text: Column, pattern: str, gap: str, slots: int, early: list[tuple[str, str]] = ()) -> Column:
    """The text with its codes, by the lookup tables t and the map of known pieces."""

    def spelled(cut: Column) -> Column:  # each piece with its tokens, and what these decode to
        known = F.transform(cut, lambda w: F.get(words, slot_of(w, slots))[w])
        pairs = lambda k: F.zip_with(cut, k, lambda w, p: F.when(p.isNotNull(), F.struct(p.alias("p"), w.alias("d"))).otherwise(coded(t, w, gap, early)))
        return bound(known, CODED, lambda k: bound(pairs(k), CODED, whole))

    def whole(found: Column) -> Column:
        ids = F.concat(F.array_join(found["p"], gap), F.when(F.size(found) > 0, F.lit(gap)).otherwise(F.lit("")))
        return F.struct(text.alias("text"), F.unhex(ids).alias("ids"), F.array_join(found["d"], "").cast("binary").alias("bytes"))

    return bound(pieces_of(text, pattern), CODED, spelled)  # nested, as what a binding results in is copied


def with_codes(rows: DataFrame, path: str, pattern: str, memo: int, memo_docs: int) -> DataFrame:
    """The columns of ``rows`` but its text, and ``codes`` with the text, ids and bytes."""
    ranks = ranks_of(path)
    gap, (_, early), tables = gap_of(ranks), early_merges(ranks), made_tables(rows.sparkSession, path)
    slots = slots_for(memo)
    words = word_map(memo_words(rows, path, tables, pattern, memo, memo_docs, gap, early), slots)
    codes = lambda t, w: bound(F.col("text"), CODED, lambda x: text_codes(t, w, x, pattern, gap, slots, early))
    return with_tables(rows, tables, "codes", codes, words, [c for c in rows.columns if c != "text"])


def encoded(rows: DataFrame, path: str, pattern: str, memo: int = MEMO, memo_docs: int = MEMO_DOCS) -> DataFrame:
    """Adds ``ids``, the tokens of ``text``."""
    low = lambda h, at: F.conv(F.substring(h, at, 2), 16, 10).cast("int")
    hexes = F.regexp_extract_all(F.hex("codes.ids"), F.lit("([0-9A-F]{8})"), F.lit(1))
    ids = F.transform(hexes, lambda h: low(h, 1) + low(h, 3) * 256 + low(h, 5) * 65_536 + low(h, 7) * 16_777_216)
    own = [F.col("codes.text").alias("text") if c == "text" else F.col(c) for c in rows.columns]
    return with_codes(rows, path, pattern, memo, memo_docs).select(*own, ids.alias("ids"))


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``bytes``, what the tokens in ``ids`` stand for."""
    tables = made_tables(rows.sparkSession, path)
    both = with_tables(rows, tables, "both", lambda t: bound(F.col("ids"), "struct<ids:array<int>,bytes:binary>", lambda ids: F.struct(ids.alias("ids"), joined_bytes(ids, t["text"]).alias("bytes"))), kept=[c for c in rows.columns if c != "ids"])
    return both.select(*[F.col("both.ids").alias("ids") if c == "ids" else F.col(c) for c in rows.columns], "both.bytes")


def tokens_digest(docs: DataFrame, path: str, pattern: str, memo: int = MEMO, memo_docs: int = MEMO_DOCS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    digest = bound(F.col("codes"), "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>", lambda c: F.struct(
        (F.octet_length(c["ids"]) / 4).cast("long").alias("n_tokens"), F.sha2(c["ids"], 256).alias("ids_sha256"), F.sha2(c["bytes"], 256).alias("decoded_sha256"),
    ))
    rows = with_codes(texts(docs), path, pattern, memo, memo_docs)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("d")).select("doc_id", "d.*")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
