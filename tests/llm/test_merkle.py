"""Manifests against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import merkle

SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def hashed(row, text) -> str:
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def paths(nodes: list[str], fanout: int) -> tuple[str, list[str]]:
    """The root, and for each node its siblings from the bottom up as one string."""
    at, out = list(range(len(nodes))), [""] * len(nodes)
    while len(nodes) > 1:
        for i, p in enumerate(at):
            a = p // fanout * fanout
            out[i] += "".join(nodes[a:p] + nodes[p + 1 : a + fanout])
            at[i] = p // fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return (nodes or [""])[0], out


def brute(rows, fanout):
    trees = {}
    for r in rows:
        trees.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, hashed(r, r.text), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: paths([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], fanout) for s in order}
    root, tops = paths([low[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, tops):
        for (_, _, h, r), path in zip(sorted(trees[s], key=lambda x: x[:3]), low[s][1]):
            struck = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
            text = r.text and "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
            same = not struck or text == r.text
            out.append((r.doc_id, h, low[s][0], root, sha(path + top), same))
    return sorted(map(repr, out))


def digests(docs, fanout, per_block):
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(struck, merkle.leaf(text=merkle.lowered(F.col("text"))))
    return merkle.proofs(merkle.manifest(docs, changed, fanout, per_block), merkle.digest_row, SCHEMA)


@pytest.mark.parametrize("fanout,per_block", [(16, 2), (3, 1), (2, 3)])
def test_manifest_equals_a_tree_in_python(odd_rows, fanout, per_block):
    got = digests(odd_rows, fanout, per_block).collect()
    rows = odd_rows.select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert sorted(repr((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified)) for r in got) == brute(rows, fanout)
    assert all((r.folded_root == r.root) == r.verified for r in got) and not all(r.verified for r in got)


def test_lone_leaf_and_no_rows(odd_rows, no_rows):
    one = digests(odd_rows.where("doc_id = 1"), 16, 2).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha("")
    assert digests(no_rows, 16, 2).count() == 0
