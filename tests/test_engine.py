import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftgraph.functions import scalars
from weftgraph.operators import cycles, graph
from weftgraph.plans import catalog, model
from weftgraph.plans.runner import DuplicateNodeError, HaltError, InjectedOutputError, Registry, UnregisteredTypeError, UnsuppliedResourceError, halted, run
from weftgraph.sources.store import ArtifactStore, address

SF = "/root/testdata/sf0.001"


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, "node_id string, citation_count long")


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs or [], "source_id string, target_id string")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = c.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda v: round(v, 7) if isinstance(v, float) else v
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(v) for v in r) for r in want.project(", ".join(columns)).fetchall()), key=repr)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).columns == ["source_id", "target_id", "strength"]


def suppressed(spark, nodes, pairs):
    kept, gone = cycles.clean_cycles(nodes_of(spark, nodes), edges_of(spark, pairs))
    return {tuple(r) for r in kept.collect()}, {(r.source_id, r.target_id): r for r in gone.collect()}


def test_cycles(spark):
    n = [(x, 10) for x in "ABCD"]
    kept, gone = suppressed(spark, n, [("A", "B"), ("B", "A"), ("B", "C"), ("C", "D")])
    assert set(gone) == {("A", "B")} and len(kept) == 3
    kept, gone = suppressed(spark, n, [("A", "B"), ("B", "C"), ("C", "A")])
    assert set(gone) == {("A", "B")} and sorted(gone[("A", "B")].cycle_members) == ["A", "B", "C"]
    kept, gone = suppressed(spark, n, [("A", "B"), ("B", "A"), ("C", "D"), ("D", "C")])
    assert len(gone) == 2 and len(kept) == 2
    kept, gone = suppressed(spark, [("A", 5)], [("A", "A")])
    assert gone[("A", "A")].citation_sum == 10 and gone[("A", "A")].cycle_members == ["A"] and not kept
    with pytest.raises(ValueError):
        suppressed(spark, n, [("A", "Z")])


def test_cycle_clean_leaves_no_cycle(spark):
    rows = catalog.queries()["cycle_clean"](spark, SF).collect()
    plan = model.Plan("x", [model.Node(i, "n") for i in {x for r in rows for x in (r.source_id, r.target_id)}], [model.Edge(r.source_id, r.target_id) for r in rows if not r.suppressed])
    assert len(model.topological(plan)) == len(plan.nodes)


def test_cycle_clean_covers_the_whole_chain(spark):
    c = duckdb.connect()
    li = f"'{SF}/lineitem.parquet'"
    want = c.sql(f"SELECT DISTINCT printf('part:%06d', a.l_partkey), printf('part:%06d', b.l_partkey) FROM {li} a JOIN {li} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1").fetchall()
    rows = catalog.queries()["cycle_clean"](spark, SF).collect()
    assert sorted((r.source_id, r.target_id) for r in rows) == sorted(want)
    assert any(r.suppressed and r.source_id != r.target_id for r in rows)


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_edges_that_close_a_cycle_are_found_by_blocks_and_by_searches(block):
    rng = np.random.default_rng(block)
    s, t = rng.integers(0, 60, 700), rng.integers(0, 60, 700)
    s, t = s[s != t], t[s != t]
    after, want = {i: set() for i in range(60)}, []

    def reaches(a, b):
        seen, todo = {a}, [a]
        while todo:
            todo = [y for y in set().union(*(after[x] for x in todo)) if y not in seen]
            seen.update(todo)
        return b in seen

    for x, y in zip(s.tolist(), t.tolist()):
        want.append(reaches(y, x))
        if not want[-1]:
            after[x].add(y)
    assert cycles._closes(s, t, 60, block).tolist() == cycles._closes(s, t, 60, block, deep=3).tolist() == want


def test_levels_are_looked_at_a_few_times_however_many_edges_join(monkeypatch):
    rng, seen, levels = np.random.default_rng(1), [], cycles._levels
    s, t = rng.integers(0, 300, 6000), rng.integers(0, 300, 6000)
    monkeypatch.setattr(cycles, "_levels", lambda *a: seen.append(1) or levels(*a))
    gone = cycles._closes(s, t, 300, 20)
    assert len(seen) <= 60 and gone[s == t].all()
    assert levels(s[~gone], t[~gone], 300)[1] == len(set(levels(s[~gone], t[~gone], 300)[0])) and 0 < gone.sum() < 3000  # no cycle is left


def test_suppressed_edges_are_the_same_with_rings_and_without(spark):
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "ABCDEF" for i in range(6) for j in range(6) if i != j]
    nodes = nodes_of(spark, [(x, 1) for x in {x for p in pairs for x in p}])
    _, bare = cycles.clean_cycles(nodes, edges_of(spark, pairs), rings=False)
    _, gone = cycles.clean_cycles(nodes, edges_of(spark, pairs))
    assert {(r.source_id, r.target_id) for r in bare.collect()} == {(r.source_id, r.target_id) for r in gone.collect()}
    assert gone.count() == 6 * 15 and gone.where("size(cycle_members) < 2").count() == 0


def test_suppressed_edges_are_the_least_of_a_cycle_that_stays(spark):
    import random

    rng = random.Random(6)
    n, pairs = [(f"n{i:02d}", rng.randrange(50)) for i in range(60)], set()
    while len(pairs) < 400:
        a, b = rng.sample(range(60), 2)
        pairs.add((f"n{a:02d}", f"n{b:02d}"))
    kept, gone = suppressed(spark, n, sorted(pairs))
    count = dict(n)
    assert kept | set(gone) == pairs and not kept & set(gone) and gone
    for (s, t), r in gone.items():
        ring = list(zip(r.cycle_members, [*r.cycle_members[1:], r.cycle_members[0]]))
        assert (s, t) in ring and set(ring) - {(s, t)} <= kept
        assert (s, t) == min(ring, key=lambda e: (count[e[0]] + count[e[1]], *e))


def test_large_components_are_cut_round_by_round(spark):
    import random

    rng = random.Random(8)
    n, pairs = [(f"n{i:02d}", rng.randrange(9)) for i in range(12)], set()
    while len(pairs) < 80:
        a, b = rng.sample(range(12), 2)
        pairs.add((f"n{a:02d}", f"n{b:02d}"))
    kept, gone = cycles.clean_cycles(nodes_of(spark, n), edges_of(spark, sorted(pairs)), most=60)
    kept, gone, count = {(r.source_id, r.target_id) for r in kept.collect()}, {(r.source_id, r.target_id): r.cycle_members for r in gone.collect()}, dict(n)
    assert kept | set(gone) == pairs and not kept & set(gone)
    plan = model.Plan("x", [model.Node(i, "n") for i, _ in n], [model.Edge(a, b) for a, b in kept])
    assert len(model.topological(plan)) == len(n)
    for (s, t), members in gone.items():
        ring = list(zip(members, [*members[1:], members[0]]))
        assert (s, t) in ring and set(ring) <= pairs and len({*members}) == len(members)
        assert (s, t) == min(ring, key=lambda e: (count[e[0]] + count[e[1]], *e))


def test_strong_components(spark):
    pairs = [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("D", "E"), ("E", "D"), ("E", "F"), ("G", "G"), ("H", "A")]
    n = spark.createDataFrame([(x,) for x in "ABCDEFGHI"], "node_id string")
    got = {r.node_id: r.component for r in cycles.strong_components(n, edges_of(spark, pairs)).collect()}
    assert got == dict(zip("ABCDEFGHI", "AAADDFGHI"))


def test_cocitation(spark):
    e = edges_of(spark, [("C", "A"), ("C", "B"), ("D", "A"), ("D", "B"), ("A", "A")])
    assert [tuple(r) for r in graph.cocitation(e).collect()] == [("A", "B", 2)]
    assert graph.cocitation(edges_of(spark, [("C", "A"), ("C", "B")])).count() == 0
    assert graph.cocitation(edges_of(spark, [("E", x) for x in "ABCD"]), min_strength=1).count() == 6
    assert graph.cocitation(e, max_edges=0).count() == 0
    with pytest.raises(ValueError):
        graph.cocitation(e, min_strength=0)


def test_cocitation_of_a_hot_citer_is_dealt_out(spark):
    """One citer with 90 references among small ones: the same pairs, each once a citer."""
    pairs = [("hot", f"n{i:02d}") for i in range(90)] + [(f"c{i}", f"n{(i * 7 + j) % 90:02d}") for i in range(40) for j in range(3)]
    e = edges_of(spark, pairs)
    whole, dealt = ({tuple(r) for r in graph.cocitation(e, min_strength=1, hot=h).collect()} for h in (1000, 10))
    assert dealt == whole and len(whole) == 90 * 89 // 2
    rows = e.selectExpr("source_id AS citer", "target_id AS a").where("citer = 'hot'")
    assert graph.cited_pairs(rows, 10).distinct().count() == graph.cited_pairs(rows, 10).count() == 90 * 89 // 2


def test_depth_and_direction(spark):
    def metrics(nodes, pairs, roots):
        got = graph.depth_metrics(spark.createDataFrame([(x,) for x in nodes], "node_id string"), edges_of(spark, pairs), spark.createDataFrame([(x,) for x in roots], "node_id string"))
        return {r.node_id: (dict(r.hop_depth_per_root), r.traversal_direction) for r in got.collect()}

    got = metrics(["S1", "S2"], [("S2", "S1")], ["S1", "S2"])
    assert got == {"S1": ({"S1": 0, "S2": 1}, "seed"), "S2": ({"S2": 0, "S1": 1}, "seed")}
    got = metrics(["S1", "S2", "S3", "X", "Y"], [("S1", "X"), ("S2", "X"), ("S3", "Y")], ["S1", "S2", "S3"])
    assert got["X"] == ({"S1": 1, "S2": 1}, "backward")
    got = metrics(["S1", "S2", "S3", "X", "Y"], [("S1", "X"), ("X", "S2"), ("S3", "Y")], ["S1", "S2", "S3"])
    assert got["X"][1] == "mixed"
    with pytest.raises(ValueError, match="X"):
        metrics(["S1", "X"], [], ["S1"])


def test_pagerank(spark):
    ring = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "A")]
    n = spark.createDataFrame([(x,) for x in "ABCD"], "node_id string")
    for pairs in (ring, []):
        assert all(abs(r.pagerank - 0.25) < 1e-9 for r in graph.pagerank(n, edges_of(spark, pairs)).collect())
    got = graph.pagerank(n, edges_of(spark, [("A", "B"), ("A", "B")])).collect()
    assert len(got) == 4 and abs(sum(r.pagerank for r in got) - 1) < 1e-9
    with pytest.raises(ValueError):
        graph.pagerank(n, edges_of(spark, ring), damping=2)


def test_communities_label_every_node(spark):
    n = spark.createDataFrame([(x,) for x in "ABCDEF"], "node_id string")
    got = {r.node_id: r.community_id for r in graph.communities(n, edges_of(spark, [("A", "B"), ("B", "C"), ("D", "E")])).collect()}
    assert set(got) == set("ABCDEF") and got["F"] == "F" and got["A"] != got["D"]


def test_enrich_raises_for_missing_metrics(spark):
    n = spark.createDataFrame([("A",), ("B",)], "node_id string")
    with pytest.raises(Exception, match="no metrics for B"):
        graph.enrich(n, spark.createDataFrame([("A", 1)], "node_id string, x int")).collect()


def test_scalars(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("plain",), ("x ```a```",)], "t string")
    assert [r[0] for r in df.select(scalars.without_fence(F.col("t"))).collect()] == ['{"a": 1}', "plain", "x ```a```"]
    m = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "m map<string,array<int>>")
    assert m.select(scalars.abstract_text(F.col("m"))).first()[0] == "a b a"


def line(n=3):
    return model.Plan("p", [model.Node(f"n{i}", "step", {"x": 1}) for i in range(n)], [model.Edge(f"n{i}", f"n{i + 1}") for i in range(n - 1)])


def test_plan_queries():
    p = line(4)
    assert model.topological(p) == ["n0", "n1", "n2", "n3"] and model.longest_chain(p) == ["n0", "n1", "n2", "n3"]
    assert model.downstream(p, "n1") == ["n2", "n3"] and model.upstream(p, "n1") == ["n0"] and model.downstream(p, "z") == []
    p.edges.append(model.Edge("n3", "n0"))
    assert model.longest_chain(p) == [] and "the plan has a cycle" in model.problems(p)
    assert model.problems(model.citation_plan({"llm": None})) == []
    q = model.citation_plan({})
    assert len(q.nodes) == 11 and len(q.edges) == 21


def test_plan_problems():
    p = model.Plan("p", [model.Node("a", "t", output_ports=["o"]), model.Node("b", "t", input_ports=["i", "status"], enabled_when="llm")], [model.Edge("a", "b", from_port="o", to_port="i"), model.Edge("a", "b", from_port="o", to_port="i"), model.Edge("a", "c")])
    got = model.problems(p)
    assert "input b.i is fed 2 times" in got and "edge names missing node: c" in got and "b depends on absent parameter llm" in got and "b uses the reserved port name status" in got


def test_runner(spark):
    r = Registry()
    r.register("step", lambda params, inputs: {"v": sum(i["v"] for i in inputs.values()) + 1})
    assert run(line(), r)["n2"]["v"] == 3
    p = line()
    p.nodes[1].type = "boom"
    r.register("boom", lambda params, inputs: 1 / 0)
    got = run(p, r)
    assert [got[f"n{i}"]["status"] for i in range(3)] == ["SUCCESS", "FAILED", "SKIPPED"]
    with pytest.raises(HaltError):
        halted(p, got)
    p = line()
    p.nodes[1].enabled_when = "off"
    p.nodes[2].input_ports = []
    assert run(p, r)["n1"]["disabled_by"] == "off" and run(p, r)["n2"]["status"] == "SUCCESS"
    with pytest.raises(DuplicateNodeError):
        run(model.Plan("d", [model.Node("a", "step")] * 2, []), r)
    with pytest.raises(UnregisteredTypeError):
        run(model.Plan("d", [model.Node("a", "none")], []), r)
    with pytest.raises(UnsuppliedResourceError):
        run(model.Plan("d", [model.Node("a", "step", resources=["db"])], []), r)
    with pytest.raises(InjectedOutputError):
        run(line(), r, outputs={"n1": {"v": 1}})


def test_lazy_failure_belongs_to_its_node(spark):
    r = Registry()
    r.register("step", lambda params, inputs: {"v": spark.range(1).select(F.raise_error(F.lit("bad")).alias("x").cast("string"))})
    assert run(line(1), r)["n0"]["status"] == "FAILED"


def test_store(spark, tmp_path):
    assert address(["b", "a"], {"x": 1, "llm": None}) == address(["a", "b", "a"], {"x": 1}) != address(["a", "b"], {"x": 2})
    store = ArtifactStore(spark, f"file://{tmp_path}")
    calls = []
    made = lambda: calls.append(1) or {"nodes": spark.range(3)}
    key, tables, hit = store.cached(["a"], {"x": 1}, made)
    assert not hit and tables["nodes"].count() == 3
    assert store.cached(["a"], {"x": 1}, made)[2] and len(calls) == 1


def test_stream(spark, tmp_path):
    from weftgraph.streaming.incremental import append_edges

    src = f"file://{tmp_path}/in"
    edges_of(spark, [("A", "B"), ("A", "B"), ("B", "C")]).write.parquet(src)
    q = append_edges(spark.readStream.schema("source_id string, target_id string").parquet(src), f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    q.awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
