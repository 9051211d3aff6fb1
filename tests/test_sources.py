import json

import pytest
from pyspark.sql import functions as F

from weftgraph.__main__ import answer, main
from weftgraph.functions import handlers
from weftgraph.operators import annotate, graph, traversal
from weftgraph.plans import model, projection
from weftgraph.plans.runner import InjectedOutputError, Registry, run
from weftgraph.sources import ledger, works
from weftgraph.sources.store import ArtifactStore


def work(key, **more):
    return {"id": f"https://x.org/{key}", "ids": {"doi": f"https://doi.org/10.1/{key}"}, "title": key, "publication_year": 2000, "cited_by_count": 3, **more}


def raw(spark, *items):
    return spark.createDataFrame([(json.dumps(i),) for i in items], "json string")


def test_records(spark):
    full = work("W1", authorships=[{"author": {"display_name": "A"}}, {"author": {"display_name": ""}}, {"author": None}], abstract_inverted_index={"b": [1], "a": [0]}, referenced_works=["https://x.org/W2/"], counts_by_year=[{"year": 2001, "cited_by_count": 2}])
    bare = {"id": "https://x.org/W3", "ids": {"arxiv": "https://arxiv.org/abs/1.2"}, "title": None}
    a, b = sorted(works.records(raw(spark, full, bare)).collect(), key=lambda r: r.source_key)
    assert (a.node_id, a.authors, a.abstract, a.references, a.counts_by_year[0].asDict()) == ("doi:https://doi.org/10.1/W1", ["A"], "a b", ["W2"], {"year": 2001, "count": 2})
    assert (b.node_id, b.arxiv_id, b.title, b.citation_count, b.authors, b.abstract) == ("arxiv:1.2", "1.2", "", 0, [], None)
    points = {r.node_id: r.counts_by_year_len for r in works.yearly_points(works.records(raw(spark, full, bare))).collect()}
    assert points == {"doi:https://doi.org/10.1/W1": 1, "arxiv:1.2": 0}
    missing = {r.node_id: r.missing for r in works.missing_fields(works.records(raw(spark, full, bare)), least=1).collect()}
    assert missing == {"arxiv:1.2": ["doi", "title", "year", "authorships", "referenced_works"]}
    assert works.search(works.records(raw(spark, full, bare)), text="w1", year=2000, first_author="a").count() == 1


def test_seeds(spark):
    known = works.records(raw(spark, work("W1"), work("W2")))
    got, failed = works.resolve_seeds(known, [{"doi": "10.1/W2"}, {"title": "x"}, {"doi": "10.1/none"}])
    assert [(r.ord, r.source_key, r.hop_depth, r.root_ids == [r.node_id]) for r in got.collect()] == [(0, "W2", 0, True)]
    assert {r.ord: r.reason for r in failed.collect()} == {1: "unrecognized seed shape", 2: "no results"}
    with pytest.raises(ValueError, match="no seeds"):
        works.resolve_seeds(known, [])
    with pytest.raises(ValueError, match="seed 0.*seed 2"):
        works.resolve_seeds(known, [{"arxiv_id": "1"}, {"doi": "10.1/W2"}, {"arxiv_id": "2"}])
    with pytest.raises(ValueError, match="no seed was found"):
        works.resolve_seeds(known, [{"doi": "10.1/none"}])
    assert works.seed_filter({"doi": "x"}) == "doi:x" and works.seed_filter({"id": 1}) is None


def flaky():
    def fetch(ids):
        if "5" in ids:
            raise OSError("down")
        return [json.dumps({"id": i}) for i in ids]

    return fetch


def told(got):
    """The failures; the batch with id 5 alone has failed, and all other ids have a record."""
    failed = [r.failed for r in got if r.failed]
    assert len(failed) == 1 and "5" in failed[0].ids and failed[0].reason == "down" and failed[0].stage == "depth1"
    assert sorted(json.loads(r.json)["id"] for r in got if r.json) == sorted({str(i) for i in range(10)} - set(failed[0].ids))
    return failed


def test_batched_lookup(spark):
    calls = spark.sparkContext.accumulator(0)
    ids = spark.range(10).select(F.col("id").cast("string").alias("id")).repartition(5)
    got = works.lookup(ids.union(ids), flaky(), "depth1", size=4, calls=calls)
    assert len(told(got.collect())[0].ids) == 4 and got.where("failed IS NULL").count() == 6 and got.where("failed IS NOT NULL").count() == 1
    assert calls.value == 3  # one a batch, however often the result is read


def test_works_data_source(spark):
    spark.dataSource.register(works.works_source(flaky(), [str(i) for i in range(10)], "depth1", size=2))
    df = spark.read.format("works").load()
    assert df.rdd.getNumPartitions() == 5
    assert told(df.collect())[0].ids == ["4", "5"]
    spark.dataSource.register(works.works_source(flaky(), [], "depth1"))
    assert spark.read.format("works").load().count() == 0


def test_atom(spark):
    feed = "<feed><entry><title> T </title><summary>S</summary><author><name>A</name></author><author><name>B</name></author></entry></feed>"
    assert tuple(works.atom_abstracts(spark.createDataFrame([(feed,)], "xml string")).first()) == ("T", "S", "A, B")
    with pytest.raises(Exception, match="no entry"):
        works.atom_abstracts(spark.createDataFrame([("<feed></feed>",)], "xml string")).collect()


def frame(spark, rows):
    return spark.createDataFrame([(n, c, y, [r for r in k]) for n, c, y, k in rows], "node_id string, citation_count long, year int, counts_by_year array<struct<year:int,count:long>>")


def test_traversals(spark):
    every = frame(spark, [("S", 5, 2000, []), ("T", 4, 2001, []), ("A", 9, 1999, []), ("B", 3, 1998, []), ("C", 2, 2003, [(2001, 0), (2002, 12), (2003, 48)]), ("D", 30, 2003, [])])
    e = spark.createDataFrame([("S", "A"), ("S", "T"), ("A", "B"), ("T", "B"), ("C", "S"), ("D", "S"), ("T", "S"), ("X", "S")], "source_id string, target_id string")
    seeds = every.where("node_id IN ('S', 'T')").withColumn("hop_depth", F.lit(0)).withColumn("root_ids", F.array("node_id"))
    papers, edges = traversal.backward_traverse(seeds, every, e, 10, 0.1, 2005)
    assert {r.node_id: (r.hop_depth, r.root_ids) for r in papers.collect()} == {"A": (1, ["S", "T"]), "B": (1, ["S", "T"])}
    assert {(r.source_id, r.target_id, r.citing_paper_year) for r in edges.collect()} == {("S", "A", 2000), ("S", "T", 2000), ("A", "B", 1999), ("T", "B", 2001), ("T", "S", 2001)}
    ahead = lambda **k: traversal.forward_traverse(seeds, every, e, k.pop("n", 10), 0.0, k.pop("alpha", 1.0), k.pop("beta", 0.0), 2005, **k)
    papers, edges, short = ahead()
    assert {r.node_id for r in papers.collect()} == {"C", "D"} and {(r.source_id, r.target_id) for r in edges.collect()} == {("C", "S"), ("D", "S")} and not short.count()
    assert [r.node_id for r in ahead(n=1)[0].collect()] == ["D"]
    assert [r.node_id for r in ahead(n=1, alpha=0.0, beta=1.0)[0].collect()] == ["C"]  # acceleration counts
    papers, _, short = ahead(page=1, sort="cited_by_count:asc")
    assert [r.node_id for r in papers.collect()] == ["C"] and [(r.seed, r.returned, r.total) for r in short.collect()] == [("S", 1, 3)]
    with pytest.raises(ValueError):
        ahead(sort="colour:asc")
    with pytest.raises(NotImplementedError):
        ahead(method="regression")
    back, forth = traversal.backward_traverse(seeds, every, e, 10, 0.1, 2005), ahead()
    other = (forth[0], forth[1].union(spark.createDataFrame([("A", "B", "cites", 1900)], forth[1].schema)))
    nodes, cites, bad = traversal.assemble(seeds, back, other)
    assert {r.node_id: r.hop_depth for r in nodes.collect()} == {"S": 0, "T": 0, "A": 1, "B": 1, "C": 1, "D": 1}
    assert cites.count() == 7 and [(r.source_id, r.citing_paper_year, r.first_citing_paper_year) for r in bad.collect()] == [("A", 1900, 1999)]


def test_annotation(spark):
    nodes = spark.createDataFrame([("S", "Seed", "x"), ("A", "good", " "), ("B", "bad", "y"), ("C", "\t", None), ("D", "shrug", "z"), ("E", "{title}", "outage")], "node_id string, title string, abstract string")
    resolved = nodes.where("node_id = 'S'").withColumn("ord", F.lit(0))

    def ask(prompt):
        if "outage" in prompt:
            raise OSError("down")
        label = "concurrent_work" if "Candidate title: good" in prompt and "(no abstract provided)" in prompt and "- Seed" in prompt else "unclear" if "shrug" in prompt else "nonsense"
        return json.dumps({"relationship_type": label, "semantic_confidence": 0.5})

    got, tally = annotate.annotate(nodes, resolved, ask, "m")
    assert {r.node_id: (r.relationship_type, r.semantic_confidence) for r in got.collect()} == {"S": (None, None), "A": ("concurrent_work", 0.5), "B": ("unclear", 0.0), "C": ("unclear", 0.0), "D": ("unclear", 0.5), "E": ("unclear", 0.0)}
    t = tally.first()
    assert (t.papers_total, t.papers_classified, t.call_count, t.unclear_no_classifiable_text, t.unclear_model_output_invalid, t.unclear_model_unclear) == (5, 2, 4, 1, 2, 1)
    many = spark.createDataFrame([(i, f"t{i:02d}") for i in range(22)], "ord int, title string")
    lines = annotate.seed_context(many).first()[0].split("\n")
    assert len(lines) == 21 and lines[0] == "- t00" and lines[-1] == "- (+2 more seed papers)"
    assert annotate.seed_context(many.limit(0)).first()[0] == annotate.NO_TITLES


def test_result_tables(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C")], "source_id string, target_id string")
    both = traversal.result_edges(e, spark.createDataFrame([("B", "C", 2)], "source_id string, target_id string, strength long"))
    assert sorted(r.type for r in both.collect()) == ["cites", "cites", "co_citation"]
    assert {r.node_id for r in traversal.affected(e).collect()} == {"A", "B", "C"}
    labels = spark.createDataFrame([("A", "1"), ("B", "1")], "node_id string, community_id string")
    assert traversal.community_summary(labels, 2, 5).first()[:3] == (1, True, False)
    ordered = spark.createDataFrame([(0, "A", "Z"), (1, "Y", "Z")], "ord int, source_id string, target_id string")
    got = traversal.ordered_warnings(ordered, labels, ["ord"]).orderBy("first").collect()
    assert [r.node_id for r in got] == ["Z", "Y"]
    t = spark.createDataFrame([("Graph Transformer",)], "t string")
    assert t.select(traversal.keyword_gate(F.col("t"), ["graph", "x"], 0.5).alias("g")).first().g.matched_keywords == ["graph"]
    with pytest.raises(Exception, match="below threshold"):
        t.select(traversal.keyword_gate(F.col("t"), ["y", "x"], 0.5)).collect()
    xy = spark.createDataFrame([("A", 0.0, 0.0), ("B", 1.0, 0.0)], "node_id string, x double, y double")
    assert traversal.nearest(xy, 0.9, 0.0, 0.5).first().node_id == "B" and not traversal.nearest(xy, 5.0, 5.0, 0.5).count()


def test_depth_projection(spark):
    rows = [("S1", {"S1": 0, "S2": 1}, "seed"), ("S2", {"S1": 1, "S2": 0}, "seed"), ("A", {"S1": 1, "S2": 1}, "backward"), ("B", {"S1": 1, "S2": 1}, "forward"), ("C", {"S1": 2}, "mixed")]
    nodes = spark.createDataFrame(rows, "node_id string, hop_depth_per_root map<string,int>, traversal_direction string")
    edges = spark.createDataFrame([("S1", "A", "cites", None), ("S2", "A", "cites", None), ("S1", "B", "cites", None), ("A", "B", "co_citation", 3)], "source_id string, target_id string, type string, strength long")
    out, _, meta = projection.depth_provenance(nodes, edges, "S1", "S2")
    n, m = {r.node_id: r for r in out.collect()}, meta.first()
    assert n["A"].is_cited_by_both and not n["B"].is_cited_by_both and n["B"].lag_caveat and n["S1"].is_seed and n["C"].depth_to_b == 3
    # bands 1, 2 and 5 of one, two and one rows, lean from -1 to 1: three columns of .88/3, rows of .9/4
    assert (n["S1"].x, n["S1"].y, n["S2"].x) == (round(0.06 + 0.44 / 3, 6), 0.1625, round(0.06 + 0.88 * 2.5 / 3, 6))
    assert (n["A"].x, n["A"].y, n["B"].x, n["B"].y, n["C"].y) == (0.5, 0.3875, 0.5, 0.6125, 0.8375)
    assert (m.cites_count, m.co_citation_count, m.strength_min, m.shared_foundation_count, m.lag_caveat_count, m.depth_bands, m.traversal_direction_counts["seed"]) == (3, 1, 3, 1, 2, [1, 2, 5], 2)


def test_plan_projection():
    plan = model.citation_plan({"llm": {"k": 1}})
    out = projection.declared_graph(plan)
    m, n = out["meta"], {x["node_id"]: x for x in out["nodes"]}
    assert (m["node_count"], m["edge_count"], m["rank_count"], m["longest_chain"][0], m["conditional_node_count"]) == (11, 21, max(x["rank"] for x in out["nodes"]) + 1, "resolve", 1)
    assert len({e["id"] for e in out["edges"]}) == 21 and all(e["rank_span"] >= 1 and e["x1"] < e["x2"] for e in out["edges"])
    assert n["resolve"]["y"] == 0.5 and n["resolve"]["downstream_count"] == 10 and n["annotate"]["param_keys"] == ["llm"]
    assert projection.declared_graph(model.citation_plan({})) == out
    with pytest.raises(ValueError):
        projection.declared_graph(model.Plan("e", [], []))
    html = projection.page({"a": "</script>\u2028"}, "a<b")
    assert "</script>\u2028" not in html and "\\u003c/script>\\u2028" in html and "a&lt;b" in html
    text = projection.spliced("x <!--a--> old <!--b--> y", projection.mermaid(model.abstract_plan()), "<!--a-->", "<!--b-->")
    assert "fetch --> claims" in text and "old" not in text and text.endswith(" y")
    with pytest.raises(ValueError):
        projection.spliced("x", "y", "<!--a-->", "<!--b-->")


def test_more_plan_queries():
    p = model.Plan("p", [model.Node(x, "t") for x in "abcd"], [model.Edge("a", "b"), model.Edge("b", "a"), model.Edge("b", "c"), model.Edge("c", "a"), model.Edge("d", "d")])
    assert model.cycles(p) == [["a", "b"], ["a", "b", "c"], ["d"]]
    assert [e.target for e in model.subgraph(p, ["a", "b"]).edges] == ["b", "a"]
    look = model.intent(model.lookdev_plan())
    assert (look["domain"], look["control_gates"], look["critical_path"]) == ("vfx", ["check"], ["load", "shade", "check", "render", "approve"])
    assert "error" in model.intent(p, ["z"]) and model.intent(p, ["a"])["domain"] == "unknown" and model.intent(p)["critical_path"] == []
    c = model.citation_plan({})
    assert model.producer(c, "depth", "nodes") == ("annotate", "nodes")
    with pytest.raises(ValueError):
        model.producer(c, "depth", "colour")
    assert model.Plan.from_dict(c.to_dict()).to_dict() == c.to_dict() and model.integrity(c) == {"valid": True, "errors": []}
    for bad in ([], {"name": "x"}, {"name": "x", "nodes": [{"id": "a"}], "edges": []}):
        with pytest.raises(ValueError):
            model.Plan.from_dict(bad)


def test_check_rules():
    ports = lambda **k: model.Node("b", "t", **k)
    lost = model.Plan("p", [ports(input_ports=["i"])], [model.Edge("a", "b", from_port="o", to_port="i")])
    assert model.problems(lost) == ["edge names missing node: a"]  # not "not fed" as well
    loose = model.Plan("p", [model.Node("a", "t"), ports()], [model.Edge("a", "b", from_port="o", to_port="i")])
    assert model.problems(loose) == []  # neither end declares ports
    control = model.Plan("p", [model.Node("a", "t"), ports(input_ports=[])], [model.Edge("a", "b", "CONTROL")])
    assert len(model.problems(control)) == 1


def test_injected_outputs_of_disabled_nodes_are_not_looked_at():
    r = Registry()
    r.register("t", lambda params, inputs: {"v": 1})
    p = model.Plan("p", [model.Node("a", "t", {"on": 0}, input_ports=None, enabled_when="on")], [])
    assert run(p, r, outputs={"a": {"v": 2}})["a"]["disabled_by"] == "on"
    p.nodes[0].params["on"] = 1
    with pytest.raises(InjectedOutputError):
        run(p, r, outputs={"a": {"v": 2}})


def test_files(spark, tmp_path):
    assert ledger.flatten({"a": {"b": 1, "c": {"d": 2}}}) == {"a.b": 1, "a.c.d": 2} and ledger.unflatten({"a.b": 1, "a.c.d": 2}) == {"a": {"b": 1, "c": {"d": 2}}}
    path = str(tmp_path / "tokens.json")
    ledger.write_tokens(path, {"a.b": "1"})
    assert ledger.write_tokens(path, {"a.c": "2"}) == {"a.b": "1", "a.c": "2"}
    (tmp_path / "c.toml").write_text("[weftgraph]\nx = 2\n")
    assert ledger.config(str(tmp_path / "c.toml"), {"x": 1, "y": 1}) == {"x": 2, "y": 1} and ledger.config("/none", {"x": 1}) == {"x": 1}
    (tmp_path / "r").mkdir()
    with pytest.raises(ValueError):
        ledger.sole_record(str(tmp_path / "r"))
    (tmp_path / "r" / "k.json").write_text("{}")
    (tmp_path / "r" / "k.manifest.json").write_text("{}")
    assert ledger.sole_record(str(tmp_path / "r")) == "k"
    live = ledger.manifest(["weftgraph.plans.citation"], "weftgraph")
    assert "weftgraph.operators.graph" in live["modules"] and not any(".llm" in m for m in live["modules"])
    old = {"modules": {**live["modules"], "weftgraph.operators.graph": {"path": "p", "sha256": "0"}, "gone": {"path": "g", "sha256": "1"}}, "lock": "z", "commit": None}
    diff = ledger.manifest_diff(old, live)
    assert [d["anchor"] for d in diff] == ["gone", "weftgraph.operators.graph", "lock"] and ledger.manifest_diff(live, live) == []
    side, book = str(tmp_path / "s.json"), f"file://{tmp_path}/ledger"
    assert ledger.read_sidecar(side) is None and ledger.read_ledger(spark, book).count() == 0
    ledger.write_sidecar(side, old)
    for _ in range(2):
        assert ledger.observed(spark, book, "k", side, live) is None
    spark.createDataFrame([("torn {",)], "value string").write.mode("append").text(book)
    assert [tuple(r) for r in ledger.read_ledger(spark, book).collect()] == [("k", ledger.diff_hash(diff))]
    (tmp_path / "s.json").write_text("{")
    assert ledger.observed(spark, book, "k", side, live)  # a fault is told, not raised
    a, b = (spark.createDataFrame([(x,) for x in v], "x int") for v in ([1, 1, 2], [1, 3]))
    assert sorted((r.x, r.side) for r in ledger.bundle_diff(a, b).collect()) == [(1, "baseline"), (2, "baseline"), (3, "live")]


def test_handlers_and_commands(tmp_path, capsys):
    path = str(tmp_path / "t.json")
    got = run(handlers.colour_plan(path), handlers.registry())
    assert got["write"]["tokens"] == {"text.main": "#112233", "text.dim": "#abc"} and json.loads((tmp_path / "t.json").read_text()) == {"text": {"main": "#112233", "dim": "#abc"}}
    with pytest.raises(ValueError):
        handlers.color_swatch({"hex": "#12"}, {})
    with pytest.raises(ValueError):
        handlers.evaluator({"keywords": ["x"], "threshold": 1}, {"a": {"response": "y"}})
    assert handlers.compatible(("out", "token_dict"), ("in", "token_role")) and not handlers.compatible(("out", "a"), ("in", "b")) and not handlers.compatible(("in", "a"), ("in", "a"))
    assert handlers.fitted([1], 3, 0) == [1, 0, 0] and handlers.fitted([1, 2], 1) == [1]
    p = handlers.wired(model.Plan("p", [], [model.Edge("a", "b", "DATA", "o", "i")]), model.Edge("c", "b", "DATA", "o", "i"))
    assert [e.source for e in p.edges] == ["c"]
    assert main(["check"]) == 0 and main(["query", "downstream", "clean"]) == 0 and main(["query", "downstream"]) == 1 and main(["validate", "/none"]) == 1
    assert main(["view", "--out", str(tmp_path / "v.html")]) == 0 and main(["workflows"]) == 0 and main(["stats"]) == 0
    assert main(["run", "1.2", "--mock"]) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["summarize"]["status"] == "SUCCESS"
    plan = model.abstract_plan()
    assert answer(plan, {"tool": "update_node", "arguments": {"node_id": "claims", "params": {"model": "m"}}})["params"]["model"] == "m"
    assert answer(plan, {"tool": "summarize_intent", "arguments": {"node_ids": []}})["scope"] == "full" and "error" in answer(plan, {"tool": "get_node", "arguments": {"node_id": "z"}})
    assert answer(plan, {"tool": "execute_graph", "arguments": {"mock": True, "resources": {"model_client": None}}})["summarize"]["status"] == "SUCCESS" and answer(plan, {"tool": "validate_graph"})["valid"]


def test_pagerank_against_a_plain_loop(spark):
    pairs = [("A", "B"), ("B", "C"), ("C", "A"), ("A", "D"), ("E", "D")]
    n = spark.createDataFrame([(x,) for x in "ABCDEF"], "node_id string")
    got = {r.node_id: r.pagerank for r in graph.pagerank(n, spark.createDataFrame(pairs, "source_id string, target_id string"), rounds=7, tolerance=0).collect()}
    x = dict.fromkeys("ABCDEF", 1 / 6)
    for _ in range(7):
        loose = sum(x[v] for v in "DF")
        x = {v: 0.15 / 6 + 0.85 * (sum(x[s] / sum(a == s for a, _ in pairs) for s, t in pairs if t == v) + loose / 6) for v in x}
    assert all(abs(got[v] - x[v]) < 1e-12 for v in x)


def test_writers_of_one_address(spark, tmp_path):
    """A second writer finds the marker and leaves nothing; both read the first one's tables. An empty marker is no bundle."""
    store, other = ArtifactStore(spark, f"file://{tmp_path}"), ArtifactStore(spark, f"file://{tmp_path}")
    key = other.write(["b"], {}, {"nodes": spark.range(1)})
    slow = lambda: other.write(["a"], {}, {"nodes": spark.range(2)}) and {"nodes": spark.range(7)}  # noqa: E731  another writer is done meanwhile
    key, tables, hit = store.cached(["a"], {}, slow)
    assert not hit and tables["nodes"].count() == 2 and other.read(key)[1]["nodes"].count() == 2
    assert len(list((tmp_path / f"address={key}").glob("attempt=*"))) == 1
    with pytest.raises(FileExistsError):
        store.write(["a"], {}, {})
    (tmp_path / "address=x").mkdir()
    (tmp_path / "address=x" / "marker").write_text("")
    assert not store.has("x")
    with pytest.raises(FileNotFoundError):
        store.read("x")


def test_ledger_entries_of_two_writers_are_one(spark, tmp_path):
    book = f"file://{tmp_path}/book"
    entries = spark.createDataFrame([("k", "h", "{}"), ("k", "h", "{}"), ("k", "i", "{}")], ledger.LEDGER)
    assert ledger.append_ledger(spark, book, entries) == 2 and ledger.append_ledger(spark, book, entries) == 0
    spark.read.text(book).write.mode("append").text(book + "2")
    spark.read.text(book).write.mode("append").text(book + "2")
    assert sorted(tuple(r) for r in ledger.read_ledger(spark, book + "2").collect()) == [("k", "h"), ("k", "i")]


def test_cached_run(spark, tmp_path):
    """A miss attaches the baseline; a hit gives this call's seeds and notes drift."""
    store, book = ArtifactStore(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/ledger"
    seeds = lambda *names: spark.createDataFrame([(x,) for x in names], "node_id string")
    none, runs = spark.createDataFrame([], "seed string"), []
    made = lambda: runs.append(1) or {"nodes": spark.range(3), "seeds": seeds("a", "b")}
    live = ledger.manifest(["weftgraph.plans.citation"], "weftgraph")
    (tmp_path / "side").mkdir()
    tables, hit, fault = ledger.cached_run(store, seeds("a", "b"), none, {"x": 1}, made, live, str(tmp_path / "side"), book)
    assert not hit and fault is None and tables["nodes"].count() == 3 and ledger.read_ledger(spark, book).count() == 0
    drifted = live | {"lock": "another"}
    tables, hit, fault = ledger.cached_run(store, seeds("b", "a"), none, {"x": 1}, made, drifted, str(tmp_path / "side"), book)
    assert hit and fault is None and len(runs) == 1
    assert [r.node_id for r in tables["seeds"].collect()] == ["b", "a"] and ledger.read_ledger(spark, book).count() == 1
