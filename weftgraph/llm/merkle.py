"""Merkle manifest of a dataset: a tree for each source, and one over the sources' roots.

Every leaf gets its place in its source by a range sort: the rows' places in the written partitions, and the counts
of the partitions before. Then superblocks are reduced: a block holds the fanout**levels leaves whose places agree
after division, one task collapses a block through that many levels, and the blocks' roots are the leaves of the next
round, until each source has one node. The roots of the sources are reduced in the same way. Proofs come down the other way:
a block's nodes get their siblings inside the block, and behind them those of the block's root.

Every round is a written table; what a task holds is one block, whatever a source's share of the rows. Only the number
of rounds, which follows from the largest source, is worked out by the driver.

Edge cases: a null in a column is ``-`` in its leaf, unlike an empty text (``0:``); rows without a source are a source of their
own, before all others; a null doc_id comes first in its source and isn't tampered with; rows of one doc_id ascend by leaf, and repeated
rows are leaves of their own; an empty table gives no rows; columns other than the five play no part.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import CRC_FOLD, CRC_TABLE, LOWER, UPPER, lowered, numbered, stored, table

#: Fixed by the query contract: the fields of a leaf in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FANOUT = 16


def leaf(**other: Column) -> Column:
    """The hash of a row: each field is its byte count and value, or ``-``. ``other`` gives fields in place of the row's."""
    parts = []
    for name in FIELDS:
        value = other.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def collapsed(hashes: list[str], fanout: int, levels: int) -> list[list[str]]:
    """The nodes of a block level by level, the given ones first."""
    out = [hashes]
    for _ in range(levels):
        last = out[-1]
        out.append([hashlib.sha256("".join(last[i : i + fanout]).encode()).hexdigest() for i in range(0, len(last), fanout)])
    return out


def depth(n: int, fanout: int, most: int) -> int:
    """The levels through which a block of a tree of n nodes is collapsed: to one node, or ``most``."""
    d = 0
    while n > 1 and d < most:
        n, d = -(-n // fanout), d + 1
    return d


@dataclass
class Tree:
    """Levels of superblocks: each a written table of tree, idx, n, h; the last has one row a tree."""

    levels: list[DataFrame]
    fanout: int
    per_block: int

    @property
    def roots(self) -> DataFrame:
        return self.levels[-1].select("tree", F.col("h").alias("top"))


def reduced(nodes: DataFrame, fanout: int = FANOUT, per_block: int = 2, name: str = "merkle") -> Tree:
    """The trees over ``nodes`` (tree, idx, n, h), ``per_block`` levels a round."""
    span = fanout**per_block

    def root(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        n, at = int(block.n.iloc[0]), int(block.idx.iloc[0])
        top = collapsed(block.h.tolist(), fanout, depth(n, fanout, per_block))[-1][0]
        return pd.DataFrame({"tree": [block.tree.iloc[0]], "idx": [at // span], "n": [-(-n // span)], "h": [top]})

    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        blocks = levels[-1].select("tree", "idx", "n", "h").groupBy("tree", F.expr(f"idx div {span}"))
        levels.append(stored(blocks.applyInPandas(root, "tree string, idx long, n long, h string"), name))
        most = -(-most // span)
    return Tree(levels, fanout, per_block)


def siblings(levels: list[list[str]], i: int, fanout: int) -> tuple[list[str], list[str]]:
    """What stands left and right of node i of a block in its run, level by level."""
    left, right = [], []
    for level in levels[:-1]:
        a = i // fanout * fanout
        left.append("".join(level[a:i]))
        right.append("".join(level[i + 1 : a + fanout]))
        i //= fanout
    return left, right


def descended(tree: Tree, above: DataFrame, finish, schema: str, carry: list[str]) -> DataFrame:
    """Proofs from the top down. ``above``: tree, lefts, rights, and columns that every node of the tree hands on.

    ``finish(block, i, lefts, rights, above)`` makes a row of the schema of leaf i; ``carry`` names the handed columns, all strings.
    """
    span, fanout, per_block = tree.fanout**tree.per_block, tree.fanout, tree.per_block
    inner = "tree string, idx long, lefts array<string>, rights array<string>" + "".join(f", {c} string" for c in carry)

    def step(last: bool):
        columns = [x.strip().split(" ")[0] for x in (schema if last else inner).split(",")]

        def down(block: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
            if not len(block):
                return pd.DataFrame([], columns=columns)
            block = block.sort_values("idx")
            levels = collapsed(block.h.tolist(), fanout, depth(int(block.n.iloc[0]), fanout, per_block))
            over = up.iloc[0]
            more = [list(over.lefts), list(over.rights)]
            rows, records = [], block.to_dict("records")
            for i, record in enumerate(records):
                left, right = siblings(levels, i, fanout)
                left, right = left + more[0], right + more[1]
                rows.append(finish(record, left, right, over) if last else (record["tree"], record["idx"], left, right, *(over[c] for c in carry)))
            return pd.DataFrame(rows, columns=columns)

        return down

    up = above.withColumn("idx", F.lit(0).cast("long"))
    if len(tree.levels) == 1:  # every tree is a lone leaf
        pairs = [(tree.levels[0], True)]
    else:
        pairs = [(t, i == len(tree.levels) - 2) for i, t in enumerate(reversed(tree.levels[:-1]))]
    for nodes, last in pairs:
        blocks = nodes.groupBy("tree", F.expr(f"idx div {span}"))
        up = blocks.cogroup(up.groupBy("tree", "idx")).applyInPandas(step(last), schema if last else inner)
    return up


@dataclass
class Manifest:
    """leaves: the rows' hashes and places; sources: subroots; top: the tree over them; root: one row."""

    leaves: Tree
    sources: DataFrame
    top: Tree

    @property
    def root(self) -> DataFrame:
        return self.top.roots.select(F.col("top").alias("root"))


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT, per_block: int = 2) -> Manifest:
    """The Merkle trees of ``docs``. ``tampered``: hashes that stand for rows changed since, kept beside the leaves."""
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("h"),
        (F.lit(None).cast("string") if tampered is None else tampered).alias("changed"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows, "merkle-leaves")  # texts are read once
    leaves = reduced(stored(numbered(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")], "merkle-sorted").drop("row"), "merkle-numbered"), fanout, per_block)
    tops = leaves.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("top").alias("h"))
    sources = stored(numbered(tops, "tree", [F.col("source")], "merkle-sources"), "merkle-subroots")
    return Manifest(leaves, sources, reduced(sources, fanout, per_block))


def proofs(made: Manifest, finish, schema: str) -> DataFrame:
    """A row of the schema for each leaf by ``finish(leaf, lefts, rights, above)``; above has subroot and root."""
    top = made.top.roots.select("tree", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"), F.col("top").alias("root"))
    over = descended(made.top, top, lambda leaf, left, right, up: (leaf["source"], left, right, leaf["h"], up.root), "tree string, lefts array<string>, rights array<string>, subroot string, root string", ["root"])
    return descended(made.leaves, stored(over, "merkle-tops"), finish, schema, ["subroot", "root"])


def folded(value: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for a, b in zip(left, right):
        value = hashlib.sha256(f"{a}{value}{b}".encode()).hexdigest()
    return value


def digest_row(leaf: dict, left: list[str], right: list[str], up) -> tuple:
    path = hashlib.sha256("".join(a + b for a, b in zip(left, right)).encode()).hexdigest()
    root = folded(leaf["changed"] or leaf["h"], left, right)
    return (None if pd.isna(leaf["doc_id"]) else int(leaf["doc_id"]), leaf["h"], up.subroot, up.root, path, root, root == up.root)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(struck, leaf(text=lowered(F.col("text"))))
    return proofs(manifest(docs, changed), digest_row, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def query_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    h = lambda text: f"sha256({' || '.join(field(c) for c in FIELDS[:-1])} || {field(text)})"
    crc = CRC_FOLD.format(codes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")
    return f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT coalesce('=' || source, '') AS tree, doc_id, {h("text")} AS h, CASE WHEN {crc} % 5 = 0 THEN {h(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
low AS (SELECT tree, 0 AS lvl, idx, n, h FROM leaves UNION ALL SELECT tree, min(lvl) + 1, idx // {FANOUT}, (min(n) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, idx // {FANOUT}),
subs AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, idx, n, h FROM subs UNION ALL SELECT min(lvl) + 1, idx // {FANOUT}, (min(n) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY idx // {FANOUT}),
lows AS (SELECT a.tree, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt FROM low a JOIN low b ON a.tree = b.tree AND a.lvl = b.lvl AND a.idx // {FANOUT} = b.idx // {FANOUT} WHERE a.n > 1 GROUP BY ALL),
highs AS (SELECT a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt FROM high a JOIN high b ON a.lvl = b.lvl AND a.idx // {FANOUT} = b.idx // {FANOUT} WHERE a.n > 1 GROUP BY ALL),
up AS (SELECT tree, idx AS leaf, 0 AS step, idx AS at, coalesce(changed, h) AS value, '' AS path FROM leaves
  UNION ALL SELECT u.tree, u.leaf, u.step + 1, u.at // {FANOUT}, sha256(l.lft || u.value || l.rgt), u.path || l.lft || l.rgt FROM up u JOIN lows l ON l.tree = u.tree AND l.lvl = u.step AND l.idx = u.at),
over AS (SELECT u.tree, u.leaf, 0 AS step, s.idx AS at, u.value, u.path, s.h AS subroot FROM (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY tree, leaf ORDER BY step DESC) = 1) u JOIN subs s ON s.tree = u.tree
  UNION ALL SELECT o.tree, o.leaf, o.step + 1, o.at // {FANOUT}, sha256(l.lft || o.value || l.rgt), o.path || l.lft || l.rgt, o.subroot FROM over o JOIN highs l ON l.lvl = o.step AND l.idx = o.at),
ends AS (SELECT * FROM over QUALIFY row_number() OVER (PARTITION BY tree, leaf ORDER BY step DESC) = 1)
SELECT d.doc_id, d.h AS leaf, e.subroot, r.h AS root, sha256(e.path) AS proof_sha256, e.value AS folded_root, e.value = r.h AS verified
FROM leaves d JOIN ends e ON e.tree = d.tree AND e.leaf = d.idx CROSS JOIN (SELECT h FROM high WHERE n = 1) r"""
