import json
import random
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphfold.config import EngineConfig
from graphfold.engine import Engine
from graphfold.errors import Conflict, NotFound, Upstream
from graphfold.functions.text import contains_props
from graphfold.operators import community, extraction, graph, ingest, qa, resolution, retrieval, topk
from graphfold.operators.components import connected_components
from graphfold.operators.index import VectorIndex
from graphfold.plans import written
from graphfold.sources.clients import EchoLanguage, HashEmbeddings, with_completions, with_embeddings
from graphfold.sources.http import HttpEmbeddings, HttpLanguage
from graphfold.sources.store import Field, Store, jdbc, requests
from graphfold.streaming import jobs


def edges_of(spark, pairs):
    return spark.createDataFrame([(f"{a}|{t}|{b}", a, b, t) for a, b, t in pairs], "id string, src string, dst string, type string")


def hops(df):
    return {r["node"]: r["hop"] for r in df.collect()}


def test_walks(spark):
    e = edges_of(spark, [("a", "b", "x"), ("b", "c", "x"), ("d", "a", "y")])
    seed = spark.createDataFrame([("a",)], "node string")
    assert hops(graph.bfs(e, seed, 2)) == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert hops(graph.expand(e, seed, 2, "out").nodes) == {"a": 0, "b": 1, "c": 2}
    assert hops(graph.expand(e, seed, 2, "in").nodes) == {"a": 0, "d": 1}
    assert hops(graph.bfs(e, seed, 0)) == {"a": 0}
    # edges between nodes of the last level are not walked
    tri = edges_of(spark, [("a", "b", "x"), ("a", "c", "x"), ("b", "c", "x")])
    assert {r["id"] for r in graph.expand(tri, seed, 1).edges.collect()} == {"a|x|b", "a|x|c"}
    assert graph.edge_filter(e, []).count() == 3 and graph.edge_filter(e, ["y"]).count() == 1
    with pytest.raises(Exception, match="direction"):
        graph.incident(e, seed, "up")


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_a_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: find(x) for x in linked}


def test_communities(spark):
    nodes = spark.createDataFrame([(x, "t", x.upper()) for x in "abcd"], "id string, type string, name string")
    found = community.components(nodes, edges_of(spark, [("a", "b", "x"), ("b", "c", "x"), ("c", "zz", "x")]))
    assert sorted(r["member_count"] for r in community.sizes(found).collect()) == [1, 3]
    assert [(r["component"], r["label"]) for r in community.sizes(found, 2).collect()] == [("a", "community_1")]
    assert connected_components(edges_of(spark, [])).count() == 0


def test_extraction_replies(spark):
    body = '{"entities": [{"name": " A  B ", "type": "Big-Org", "description": true}, {"name": "C"}, {"name": ""}, 3], "relationships": [{"source": "A B", "target": "C", "type": "Works At"}, {"source": "C", "target": "c"}]}'
    raws = [body, f"```json\n{body}\n```", f"well {body} so", "", "no json", "[1]", '{"entities": {"a": 1}}', '{"entities": {}, "relationships": null}']
    got = extraction.parse(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")).orderBy("i").collect()
    assert [r["status"] for r in got] == ["ok"] * 3 + ["empty", "invalid", "invalid", "invalid", "ok"]
    for r in got[:3]:
        assert [tuple(e) for e in r["entities"]] == [("A B", "big_org", "True"), ("C", "concept", "")]
        assert [tuple(e) for e in r["relationships"]] == [("A B", "C", "works_at", "")]
    assert got[7]["entities"] == [] == got[7]["relationships"]
    with pytest.raises(Exception, match="invalid"):
        extraction.parse(spark.createDataFrame([("x",)], "raw string"), strict=True).collect()


def test_resolution_folds_in_order(spark):
    rows = [(1, 0, 0, "Acme", "Org", "makes things"), (1, 0, 1, "ACME ", "org", "makes"), (2, 0, 0, "acme", "org", "sells"), (2, 0, 1, "Acme", "place", None)]
    m = spark.createDataFrame(rows, "doc_id int, ord int, item int, name string, type string, description string")
    got = {r["type"]: r for r in resolution.resolve(m).collect()}
    assert got["org"]["name"] == "Acme" and got["org"]["aliases"] == ["Acme", "ACME ", "acme"] and got["org"]["description"] == "makes things\nsells"
    old = spark.createDataFrame([("id1", "org", "Acme Inc", "acme", ["AI"], "old")], "id string, type string, name string, normalized_name string, aliases array<string>, description string")
    again = {r["type"]: r for r in resolution.resolve(m, old).collect()}
    assert again["org"]["id"] == "id1" and again["org"]["name"] == "Acme Inc" and again["org"]["aliases"][0] == "AI" and not again["org"]["created"]
    assert again["org"]["description"] == "old\nmakes things\nsells"


def small_graph(spark):
    nodes = spark.createDataFrame([("d1", "document", "Doc"), ("e1", "org", "Acme"), ("e2", "person", "Bob"), ("e3", "person", "Ann"), ("k1", "community", "community_1")], "id string, type string, name string")
    rows = [("d1|mentions|e1", "d1", "e1", "mentions", "c1"), ("e1|has|e2", "e1", "e2", "has", None), ("e2|knows|e3", "e2", "e3", "knows", None)]
    edges = spark.createDataFrame(rows, "id string, src string, dst string, type string, chunk_id string")
    chunk = [("c1", "d1", "document_chunk", "cited", [0.0, 1.0]), ("c2", "d1", "document_chunk", "other", None), ("c3", "e1", "entity_description", "about acme", [1.0, 0.0]), ("c4", "e2", "entity_description", "about bob", [0.6, 0.8]), ("c5", "k1", "community_summary", "sum", [0.8, 0.6]), ("c6", "e1", "note", "more", None)]
    return retrieval.Graph(nodes, edges, spark.createDataFrame(chunk, "id string, node_id string, kind string, text string, embedding array<float>"))


CONFIG = EngineConfig(dim=2)


def test_hybrid_is_not_cut_and_skips_other_chunks_of_seeds(spark):
    r = retrieval.hybrid(small_graph(spark), [1.0, 0.0], CONFIG, 1, None, 1)
    got = [(h["id"], round(h["score"], 3), h["hop"]) for h in r.hits.collect()]
    assert got == [("c3", 1.0, 0), ("c1", 0.5, 1), ("c2", 0.5, 1), ("c4", 0.5, 1)]
    only = retrieval.hybrid(small_graph(spark), [1.0, 0.0], CONFIG, 1, ["org", "person"], 2)
    assert {n["id"] for n in only.nodes.collect()} == {"e1", "e2", "e3"} and "d1|mentions|e1" in {e["id"] for e in only.edges.collect()}


def test_local_phases_and_boost(spark):
    r = retrieval.local(small_graph(spark), "What is Acme?", [0.0, 0.0], CONFIG, 10, 1)
    got = [(h["id"], round(h["score"], 4), h["hop"], h["phase"]) for h in r.hits.collect()]
    assert got == [("c3", 1.05, 0, 0), ("c6", 1.0, 0, 0), ("c4", 0.525, 1, 0), ("c1", 0.5, 1, 1), ("c2", 0.5, 1, 2)]
    # asking for nothing but mentions filters nothing
    walked = retrieval.local(small_graph(spark), "Acme", [0.0, 0.0], CONFIG, 10, 1, ["mentions"])
    assert {"d1|mentions|e1", "e1|has|e2"} <= {e["id"] for e in walked.edges.collect()}
    assert retrieval.local(small_graph(spark), "nobody", [0.0, 1.0], EngineConfig(dim=2, auto_entity_score_threshold=0.99), 3, 0).mode == "hybrid"


def test_modes(spark):
    g = small_graph(spark)
    assert retrieval.resolve_mode(g, "Tell me of Acme", [0.0, 1.0], CONFIG) == "local"
    assert retrieval.resolve_mode(g, "Acme overview", [0.0, 1.0], CONFIG) == "global"
    bare = retrieval.Graph(g.nodes.where("type <> 'community'"), g.edges, g.chunks.where("kind = 'document_chunk'"))
    assert retrieval.resolve_mode(bare, "an overview", [0.0, 1.0], CONFIG) == "hybrid"
    assert retrieval.global_(bare, [0.0, 1.0], CONFIG).mode == "hybrid"
    assert [h["id"] for h in retrieval.global_(g, [1.0, 0.0], CONFIG).hits.collect()] == ["c5"]


def hits(spark, scores, size=10):
    rows = [(f"c{i}", "n", "N", "t", "k", "x" * size, s, 0, 0) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "id string, node_id string, node_name string, node_type string, kind string, text string, score double, hop int, phase int")


def test_packing_and_confidence(spark):
    assert retrieval.confidence(hits(spark, [1.0, 0.0]), 8).collect()[0]["confidence"] == 0.825
    assert retrieval.confidence(hits(spark, []), 8).collect()[0]["confidence"] is None
    assert retrieval.confidence(hits(spark, [1.05, -1.0]), 8).collect()[0]["confidence"] == 0.825
    assert retrieval.packed(hits(spark, [3.0, 2.0, 1.0], 500), 1).count() == 1
    assert retrieval.packed(hits(spark, [3.0, 2.0, 1.0], 176), 100).count() == 2
    assert retrieval.pack_context(hits(spark, []), 100).collect()[0]["context"] == ""


def test_answers(spark):
    def answer(system, user):
        if system == qa.MAP_SYSTEM and "bad" in user:
            raise ValueError("broken map")
        return "NO_INFO" if "dull" in user and system == qa.MAP_SYSTEM else f"{len(user)}"

    g = small_graph(spark)
    calls = []

    def reply(system, user):
        calls.append(system)
        return "ok"

    got = qa.ask(g, "Acme?", [1.0, 0.0], EchoLanguage(reply), CONFIG, "hybrid", 2)
    assert got.answer == "ok" and len(got.sources) == 2 and got.error is None and calls == [qa.ANSWER_SYSTEM]

    def fails(system, user):
        raise ValueError("down")

    part = qa.ask(g, "Acme?", [1.0, 0.0], EchoLanguage(fails), CONFIG, "hybrid")
    assert part.answer == qa.NO_GENERATION and part.error == "down" and part.sources
    none = retrieval.Graph(g.nodes, g.edges, g.chunks.where("false"))
    assert qa.ask(none, "x", [1.0, 0.0], EchoLanguage(fails), CONFIG, "hybrid").answer == qa.NO_CONTEXT
    assert qa.ask(g, "all", [1.0, 0.0], EchoLanguage(answer), CONFIG, "global").mode == "global"
    mapped = qa.map_partials(hits(spark, [3.0, 2.0, 1.0]).withColumn("text", F.element_at(F.array(F.lit("bad"), F.lit("dull"), F.lit("fine")), (4 - F.col("score")).cast("int"))), "q", EchoLanguage(answer), CONFIG)
    row = qa.reduce_prompt(mapped, "q").collect()[0]
    assert row["prompt"].count("[N]") == 1 and row["error"] == "broken map"


REPLY = '{"entities": [{"name": "Acme", "type": "org", "description": "a firm"}, {"name": "Bob", "type": "person"}, {"name": "Ann", "type": "person"}], "relationships": [{"source": "Acme", "target": "Bob", "type": "has"}, {"source": "bob", "target": "Ann"}]}'


def counting(path, reply=None, dim=16):
    """A provider that notes each request in a file, as requests come from worker processes, to which the class is sent."""

    class Counting:
        def __init__(self):
            self.path, self.inner = str(path), HashEmbeddings(dim)

        def note(self, what):
            with open(self.path, "a") as f:
                f.write(what.replace("\n", " ") + "\n")

        def seen(self):
            with open(self.path) as f:
                return f.read().splitlines()

        def complete(self, system, user, temperature=0.0):
            self.note(system)
            return reply(system, user)

        def embed(self, texts):
            for t in texts:
                self.note(t)
            return self.inner.embed(texts)

    return Counting()


def test_engine_ingests_and_reindexes(spark, tmp_path):
    def answer(system, user):
        if system != ingest.EXTRACT_SYSTEM:
            return "a summary"
        return "no json" if "broken" in user else REPLY.replace("a firm", "a large firm") if "second" in user else REPLY

    model, embedder = counting(tmp_path / "model", answer), counting(tmp_path / "embedder")
    engine = Engine(spark, Store(spark, str(tmp_path / "g")), embedder, model, EngineConfig(dim=16))
    docs = spark.createDataFrame([("1", " One ", "First text.\n\nSecond."), ("2", "Two", "Another text about Acme.")], "id string, title string, text string")
    made = engine.ingest(docs)
    assert made.progress == {"chunks": 2, "extractions": 2, "entities": 6, "mentions": 6, "relationships": 2, "description_chunks": 1}
    g = engine.graph()
    assert g.nodes.where("type = 'document'").count() == 2 and g.nodes.where("type = 'community'").count() == 1
    assert g.nodes.where("created_at is null or updated_at is null").count() == 0 and g.chunks.where("embedding is null or created_at is null").count() == 0
    # two extractions and one summary; two chunks, one description and one summary
    assert sorted(model.seen()) == sorted([ingest.EXTRACT_SYSTEM] * 2 + [community.SUMMARY_SYSTEM]) and len(embedder.seen()) == 4
    assert engine.search("Acme", mode="local").hits.count() > 0
    assert engine.store.read("members").count() == 3
    state = lambda: [tuple(r) for r in engine.store.read("documents").select("id", "status", "error").orderBy("id").collect()]
    jobs = lambda: sorted(tuple(r) for r in engine.store.read("jobs").select("document_id", "stage", "status", "entities", "description_chunks").collect())
    assert state() == [("1", "ready", None), ("2", "ready", None)]
    # each job has its own document's progress; what both give counts for the first
    assert [j[:4] for j in jobs()] == [("1", "ready", "completed", 3), ("2", "ready", "completed", 3)] and sorted(j[4] for j in jobs()) == [0, 1]
    before = {t: engine.store.read(t).count() for t in ("nodes", "edges", "chunks")}
    engine.reindex(docs.select("id"))
    assert {t: engine.store.read(t).count() for t in before} == before and len(jobs()) == 4
    # a later document that mentions the same entities adds to them
    later = engine.ingest(spark.createDataFrame([("3", "Three", "The second text.")], docs.schema))
    assert later.progress == {"chunks": 1, "extractions": 1, "entities": 3, "mentions": 3, "relationships": 0, "description_chunks": 0}
    acme = engine.graph().nodes.where("name = 'Acme'").collect()
    assert len(acme) == 1 and acme[0]["description"] == "a firm\na large firm" and acme[0]["aliases"] == ["Acme"]
    assert {r["text"] for r in engine.graph().chunks.where("kind = 'entity_description'").collect()} == {"a firm\na large firm"}
    assert engine.store.read("members").count() == 3 and engine.graph().nodes.where("type = 'community'").count() == 1
    assert [r["mention_count"] for r in engine.list_documents().collect()] == [3, 3, 3]
    # a bad reply fails the job and leaves the graph as it was
    with pytest.raises(Exception, match="invalid"):
        engine.ingest(spark.createDataFrame([("4", "Four", "broken")], docs.schema))
    assert state()[3][1] == "failed" and "invalid" in state()[3][2] and ("4", "extracting", "failed", None, None) in jobs()
    assert engine.graph().nodes.where("type = 'document'").count() == 3
    # among others, it fails alone
    mixed = engine.ingest(spark.createDataFrame([("5", "Five", "broken"), ("6", "Six", "A sixth text.")], docs.schema))
    assert [tuple(r) for r in mixed.failed.collect()] == [("5", "extraction reply is invalid")] and mixed.progress["entities"] == 3
    assert [s[:2] for s in state()[4:]] == [("5", "failed"), ("6", "ready")] and ("6", "ready", "completed", 3, 0) in jobs() and ("5", "extracting", "failed", None, None) in jobs()
    engine.delete("documents", spark.createDataFrame([("4",), ("5",), ("6",)], "id string"))
    acme = acme[0]["id"]
    assert engine.neighbors(acme, "out").nodes.count() == 2
    found = engine.store.read("communities").collect()[0]["id"]
    assert [r["name"] for r in engine.members_of(found).collect()] == ["Acme", "Ann", "Bob"]
    engine.delete("nodes", spark.createDataFrame([(acme,)], "id string"))
    assert engine.store.read("edges").where((F.col("src") == acme) | (F.col("dst") == acme)).count() == 0 and engine.store.read("members").count() == 2
    engine.delete("communities", spark.createDataFrame([(found,)], "id string"))
    engine.delete("documents", spark.createDataFrame([("1",)], "id string"))
    assert engine.store.read("members").count() == 0 and not [j for j in jobs() if j[0] == "1"]
    assert engine.health()["ok"]


def test_chunks_are_checked_before_they_are_embedded(spark, tmp_path):
    embedder = counting(tmp_path / "embedder")
    engine = Engine(spark, Store(spark, str(tmp_path / "g")), embedder, EchoLanguage(), EngineConfig(dim=16))
    engine.create_nodes(spark.createDataFrame([("a", "t", "A")], "id string, type string, name string"))
    embedder.note("start")
    with pytest.raises(NotFound):
        engine.create_chunks(spark.createDataFrame([("z", "lost")], "node_id string, text string"))
    engine.create_chunks(spark.createDataFrame([("a", "found")], "node_id string, text string"))
    assert embedder.seen() == ["start", "found"]
    chunks = engine.store.read("chunks")
    engine.store.write(chunks.withColumn("embedding", F.lit(None).cast("array<float>")), "chunks")
    assert engine.reembed().where("embedding is not null").count() == 1


def test_each_map_is_asked_once(spark, tmp_path):
    model = counting(tmp_path / "model", lambda system, user: "fine")
    mapped = qa.map_partials(hits(spark, [3.0, 2.0, 1.0]), "q", model, CONFIG)
    assert qa.reduce_prompt(mapped, "q").collect()[0]["prompt"].count("fine") == 3 and mapped.count() == 3
    assert model.seen() == [qa.MAP_SYSTEM] * 3


def test_seeds_look_at_the_name(spark):
    rows = [("1", "org", "NYC Council", ["The Council"], "new york city council"), ("2", "org", "Long Name Of A Firm", [], "lnf"), ("3", "org", "ab", [], None)]
    nodes = spark.createDataFrame(rows, "id string, type string, name string, aliases array<string>, normalized_name string")
    seeds = lambda q: {r["node_id"]: (r["score"], r["match"]) for r in retrieval.seeds_by_name(nodes, q).collect()}
    assert seeds("who runs the new york city council today") == {}
    assert seeds("about the long name of a firm here") == {"2": (0.9, "exact")}
    assert seeds("LNF") == {"2": (1.0, "exact")} and seeds("the council") == {"1": (0.95, "alias")} and seeds("cab") == {}


def test_seeds_of_many_queries_are_those_of_each(spark):
    rows = [("1", "org", "NYC Council", ["The Council"], "new york city council"), ("2", "org", "Long Name Of A Firm", [], "lnf"), ("3", "org", "ab", [], None), ("4", "document", "lnf", [], None), ("5", "org", "lnf", None, ""), ("6", "org", None, [], None), ("7", "org", "Firm", ["lnf"], None)]
    nodes = spark.createDataFrame(rows, "id string, type string, name string, aliases array<string>, normalized_name string")
    texts = ["who runs the new york city council today", "about the long name of a firm here", "LNF", "the council", "cab", "", None, "  ", "firm firm"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = {tuple(r) for r in retrieval.seeds_for_queries(nodes, queries).collect()}
    assert got == {(i, *r) for i, t in enumerate(texts) if t is not None for r in map(tuple, retrieval.seeds_by_name(nodes, t).collect())}
    plan = retrieval.seeds_for_queries(nodes, queries)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_runs_of_queries_hold_no_texts(spark, monkeypatch):
    nodes = spark.createDataFrame([(str(i), "org", n) for i, n in enumerate(["ab", "Ohm", "Ünal é", "Firm of Doe", "customer#000000123", "a name of thirty characters, so"])], "id string, type string, name string")
    noise = " ".join(f"w{i}" for i in range(400))
    texts = [f"{noise} ohm", f"ünal é {noise}", f"about firm of doex {noise}", f"customer#000000123x {noise}", f"{noise} xa name of thirty characters, so on", "oh firm", f"customer#000000124x {noise}"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    written = {}
    plain = retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, name: written.setdefault(name, plain(df, name)))
    got = {tuple(r) for r in retrieval.seeds_for_queries(nodes, queries).collect()}
    assert got == {(i, *r) for i, t in enumerate(texts) for r in map(tuple, retrieval.seeds_by_name(nodes, t).collect())} and len(got) == 5
    # a query's runs are those that names have, each a number: its text does not come with every run
    assert "text" not in written["query_runs"].columns and written["query_runs"].count() < 60


def test_descriptions_fold_in_order(spark, monkeypatch):
    monkeypatch.setattr(resolution, "LONG", 64)
    rng = random.Random(3)
    told = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 14))) + rng.choice(["", "é", "\n"]) for _ in range(400)]
    folded, want = resolution.Folded(), ""
    for d in told:
        folded.add(d)
        want = want if not d or d in want else f"{want}\n{d}" if want else d
    assert folded.text.decode() == want and folded.runs is not None
    # very many descriptions of one entity: none are held but the text they make
    rows = spark.range(100_000).select(F.lit("d").alias("doc_id"), F.lit(0).alias("ord"), F.col("id").alias("item"), F.lit("Acme").alias("name"), F.lit("org").alias("type"), F.concat(F.lit("a firm seen as number "), (F.col("id") % 60_000).cast("string"), F.lit(".")).alias("description"))
    lines = resolution.resolve(rows).collect()[0]["description"].split("\n")
    assert lines == [f"a firm seen as number {i}." for i in range(60_000)]


def test_hops_of_a_stored_graph_read_few_edges(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=32)
    store.write(edges_of(spark, [(f"n{i}", f"n{i + 1}", "x") for i in range(600)]), "edges")
    near = graph.Adjacency(store.read("edges"), lambda n: store.near("edges", n), lambda n: store.near("edges_in", n))
    seed = spark.createDataFrame([("n300",), ("n301",)], "node string")
    touched = graph.incident(near, seed)
    assert sorted(r["id"] for r in touched.collect()) == ["n299|x|n300", "n300|x|n301", "n301|x|n302"]
    assert len(touched.inputFiles()) <= 4 < len(store.read("edges").inputFiles())
    for direction in graph.DIRECTIONS:
        a, b = (graph.expand(e, seed, 3, direction) for e in (near, store.read("edges")))
        assert hops(a.nodes) == hops(b.nodes) and {r["id"] for r in a.edges.collect()} == {r["id"] for r in b.edges.collect()}
    many = graph.expand_many(store.read("edges"), spark.createDataFrame([(1, "n300"), (2, "n0"), (2, "n1")], "query int, node string"), 3).collect()
    for q, seeds in ((1, ["n300"]), (2, ["n0", "n1"])):
        assert {r["node"]: r["hop"] for r in many if r["query"] == q} == hops(graph.bfs(store.read("edges"), spark.createDataFrame([(n,) for n in seeds], "node string"), 3))


def test_top_k_shuffles_no_embeddings(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i}", "org" if i % 2 else "person", f"N{i}") for i in range(20)], "id string, type string, name string")
    chunks = spark.createDataFrame([(f"c{i:02d}", f"n{i}", "document_chunk", f"text {i}", [1.0, i / 10]) for i in range(24)], "id string, node_id string, kind string, text string, embedding array<float>")
    g = retrieval.Graph(nodes, spark.createDataFrame([], "id string, src string, dst string, type string"), chunks)
    # the nodes of c20 to c23 are gone
    assert [r["id"] for r in retrieval.nearest(g, [0.0, 1.0], 3)[1]] == ["c19", "c18", "c17"]
    assert [r["id"] for r in retrieval.nearest(g, [0.0, 1.0], 3, nodes.where("type = 'person'"))[1]] == ["c18", "c16", "c14"]
    assert len(retrieval.nearest(g, [0.0, 1.0], 50)[1]) == 20 and retrieval.nearest(g, [0.0, 1.0], 3, nodes.where("false"))[1] == []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = topk.scores(chunks.select("id", "node_id", "embedding"), [0.0, 1.0]).join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and all("embedding" not in line for line in plan.splitlines() if "Exchange" in line)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_database_tables_are_read_in_ranges(spark):
    url = "jdbc:derby:memory:graphfold;create=true"
    rows = spark.range(100).select(F.col("id").cast("int").alias("K"), F.concat(F.lit("v"), "id").alias("V"))
    rows.write.format("jdbc").options(url=url, dbtable="T", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    got = jdbc(spark, url, "T", "K", (0, 100, 4), driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 4 and sorted(got.collect()) == sorted(rows.collect())


def test_requests_are_checked_field_by_field(spark):
    fields = [Field("id", "long", least=1, most=9), Field("name"), Field("score", "double", True), Field("tags", "array<string>", True, 1, 2), Field("on", "boolean", True)]
    lines = ['{"id": 3, "name": "x", "score": 1, "tags": ["a"], "on": false}', '{"id": "3", "name": 7}', '{"id": 30, "name": "", "tags": [], "on": 1}', '{"name": null, "tags": ["a", 1], "score": "1"}', "[1]", None, "", '{"id": true, "name": "x", "score": null}']
    got = requests(spark.createDataFrame([(x,) for x in lines], "value string"), fields).collect()
    assert tuple(got[0]) == (3, "x", 1.0, ["a"], False, [], None)
    assert [r["reasons"] for r in got[1:]] == [
        ["id is not a long", "name is not a string"], ["id is out of range", "tags is out of range", "on is not a boolean"], ["id is missing", "name is missing", "score is not a double", "tags is not a array<string>"],
        ["the body is not an object"], ["the body is not an object"], ["the body is not an object"], ["id is not a long"],
    ]
    assert all(r["rejected"] is not None and r["id"] is None for r in got[1:])


@pytest.fixture
def provider():
    """A server on this machine that replies out of order, and refuses the first request of each text once."""
    seen = []

    class Reply(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            again = body in [b for _, b, _ in seen]
            seen.append((self.path, body, (self.client_address, self.headers["Authorization"])))
            status, said = 200, {}
            if self.path.endswith("/embeddings"):
                texts = body["input"]
                status = 503 if "busy" in texts and not again else 400 if "bad" in texts else 200
                said = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(texts)))]}
                if "short" in texts:
                    said["data"].pop()
            else:
                user = body["messages"][1]["content"]
                said = {"choices": [{"message": {"content": None if user == "nothing" else user.upper()}}]} if user != "none" else {"choices": []}
            out = json.dumps(said).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Reply)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/", seen
    server.shutdown()


def test_providers_over_http(spark, provider):
    base, seen = provider
    embedder, model = HttpEmbeddings(base, "m", "secret"), HttpLanguage(base, "m", per_second=200)
    config = EngineConfig(dim=2, embedding_batch_size=3, retry_base=0.01)
    assert embedder.embed(["a", "bbb", "cc"]) == [[1.0, 1.0], [3.0, 1.0], [2.0, 1.0]] and embedder.embed([]) == []
    assert seen[0][0] == "/v1/embeddings" and seen[0][2][1] == "Bearer secret"
    embedder.embed(["d"])
    assert seen[0][2][0] == seen[1][2][0]  # the connection stays open
    with pytest.raises(Upstream):
        embedder.embed(["short", "x"])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "busy", "four", "bad", "x"])], "i int, text string").coalesce(1)
    got = {r["text"]: r for r in with_embeddings(df, embedder, config, strict=False).collect()}
    assert got["busy"]["embedding"] == [4.0, 1.0] and got["x"]["embedding"] == [1.0, 1.0] and got["x"]["embedding_error"] is None
    assert got["bad"]["embedding"] is None and "400" in got["bad"]["embedding_error"]
    said = {r["prompt"]: (r["reply"], r["reply_error"]) for r in with_completions(spark.createDataFrame([("hi",), ("nothing",), ("none",)], "prompt string"), model, config, "s", concurrency=2).collect()}
    assert said["hi"] == ("HI", None) and said["nothing"] == ("", None) and said["none"][0] is None and "choices" in said["none"][1]
    assert [b["temperature"] for p, b, _ in seen if p.endswith("completions")] == [0.0] * 3
    slow = HttpLanguage(base, "m", per_second=20)
    began = time.monotonic()
    assert [slow.complete("s", str(i)) for i in range(5)] == list("01234") and time.monotonic() - began >= 0.19
    with pytest.raises(ConnectionError):
        HttpLanguage("http://127.0.0.1:9", "m", timeout=2).complete("s", "u")


def test_index_finds_most_of_the_nearest(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(f"c{i:04d}", f"n{i % 50}", "document_chunk", (centres[i % 40] + rng.normal(scale=0.3, size=16)).tolist()) for i in range(4000)]
    rows += [("zero", "n0", "document_chunk", [0.0] * 16), ("short", "n0", "document_chunk", [1.0]), ("none", "n0", "document_chunk", None)]
    chunks = spark.createDataFrame([(*r[:3], "text", r[3]) for r in rows], "id string, node_id string, kind string, text string, embedding array<float>")
    index = VectorIndex.build(chunks, str(tmp_path / "i"), cells=64)
    assert index.held.sum() == 4000
    probes = spark.createDataFrame([(i, rows[7 * i][3]) for i in range(60)], "query_id int, vector array<double>")
    assert index.calibrate(probes, 10, 0.95) < 32
    hit = total = 0
    for i in range(1000, 1010):
        q = rows[i][3]
        exact = {r["id"] for r in topk.knn(chunks, q, 10).collect()}
        near = index.near(q)
        hit, total = hit + len(exact & {r["id"] for r in topk.knn(near, q, 10).collect()}), total + 10
        assert index.share(q) < 0.5
    assert hit >= 0.9 * total
    assert " IN (" in index.near(rows[0][3])._jdf.queryExecution().executedPlan().toString()  # among partitions
    # a search through it, with all cells: as without
    nodes = spark.createDataFrame([(f"n{i}", "org", f"N{i}") for i in range(50)], "id string, type string, name string")
    g = retrieval.Graph(nodes, edges_of(spark, [("n0", "n1", "x")]), chunks)
    index.breadth = 64
    best = [[r["id"] for r in retrieval.nearest(x, rows[5][3], 7)[1]] for x in (g, retrieval.Graph(g.nodes, g.edges, g.chunks, index=index))]
    assert best[0] == best[1]
    late = chunks.withColumn("updated_at", F.when(F.col("id") == "c0005", F.current_timestamp()).otherwise(F.lit("2000-01-01").cast("timestamp")))
    assert sum(r["id"] == "c0005" for r in index.near(rows[5][3], late).collect()) == 1


def test_writes_of_threads_leave_the_setting(spark):
    before = spark.conf.get(written.CLEANUP)
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(lambda n: written.materialize(spark.range(n), "t").count(), range(1, 9))) == list(range(1, 9))
    assert spark.conf.get(written.CLEANUP) == before


def letters(spark, ids):
    return spark.createDataFrame([(i, "new") for i in ids], "id string, v string")


def test_upserts_write_few_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=32)
    store.write(spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("v")), "t")
    before = store.manifest()["tables"]["t"]["files"]
    assert len(before) == 32
    rows = letters(spark, [str(i) for i in range(5)] + [f"x{i}" for i in range(5)])
    t = store.begin()
    t.change("t", rows, lambda old: ingest.upserted(old, rows))
    assert t.commit() == 2
    after = store.manifest()["tables"]["t"]["files"]
    assert 0 < sum(after[b] != before[b] for b in before) <= 10
    assert store.read("t").count() == 2005 and store.read("t").where("v = 'new'").count() == 10 and store.read("t", 1).where("v = 'new'").count() == 0
    assert sorted(r["id"] for r in store.lookup("t", ["x1", "77", "none"]).collect()) == ["77", "x1"]
    one = store.lookup("t", ["77"])
    assert len({f.split("__bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1 and "EqualTo(id,77)" in one._jdf.queryExecution().executedPlan().toString()


def test_stale_writers_conflict(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write(letters(spark, ["a"]), "t")
    one, two, other = (store.begin() for _ in range(3))
    add = lambda i: lambda old: old.unionByName(letters(spark, [i]))
    one.change("t", letters(spark, ["b"]), add("b"))
    two.change("t", letters(spark, ["c"]), add("c"))
    other.put("u", letters(spark, ["z"]))
    assert one.commit() == 2
    with pytest.raises(Conflict):
        two.commit()
    assert other.commit() == 3  # another table: it goes on top
    assert sorted(r["id"] for r in store.read("t").collect()) == ["a", "b"] and store.read("u").count() == 1
    # what no commit holds goes, once nobody may still be writing it
    assert not store.vacuum() and len(store.vacuum(1, 0)) >= 1 and store.versions() == [3]
    assert store.read("t").count() == 2
    store.rebucket("t", 3)
    assert store.manifest()["tables"]["t"]["buckets"] == 3 and store.read("t").count() == 2
    with pytest.raises(NotFound):
        store.read("nothing")


def test_edges_are_kept_by_both_ends(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=16)
    store.write(edges_of(spark, [(f"s{i % 50}", f"d{i}", "x") for i in range(400)]), "edges")
    gone = spark.createDataFrame([("s1",)], "src string")
    t = store.begin()
    t.change("edges", gone.union(spark.createDataFrame([("new",)], "src string")), lambda old: old.where("src <> 's1'").unionByName(edges_of(spark, [("new", "d0", "y")])))
    t.commit()
    out, into = store.read("edges"), store.read("edges_in")
    assert out.count() == into.count() == 393 and out.exceptAll(into).count() == 0
    near = lambda name, *nodes: sorted(r["id"] for r in store.near(name, spark.createDataFrame([(n,) for n in nodes], "node string")).collect())
    assert near("edges_in", "d0", "d1") == ["new|y|d0", "s0|x|d0"] and near("edges", "new", "s1") == ["new|y|d0"]


def test_batches_are_submitted_once(spark, tmp_path):
    engine = Engine(spark, Store(spark, str(tmp_path / "g")), HashEmbeddings(16), EchoLanguage(lambda s, u: '{"entities": [{"name": "Acme", "type": "org"}], "relationships": []}'), EngineConfig(dim=16))
    docs = spark.createDataFrame([("1", "One", "Acme.")], "id string, title string, text string")
    assert engine.ingest(docs, ("feed", 4)).progress["entities"] == 1
    before = engine.store.versions()
    assert engine.ingest(docs, ("feed", 4)) is None and engine.ingest(docs, ("feed", 3)) is None and engine.store.versions() == before
    # a driver that was lost between submitting and the end: the batch comes again and runs what is left
    engine.submit(docs, ("feed", 5))
    assert engine.ingest(docs, ("feed", 5)).progress["mentions"] == 0 and engine.store.read("jobs").where("status = 'completed'").count() == 2


def test_a_hop_reads_the_edges_once(spark, tmp_path):
    path = str(tmp_path / "edges")
    edges_of(spark, [("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("c", "d", "x")]).write.parquet(path)
    edges = spark.read.parquet(path)
    plan = graph.incident(edges, spark.createDataFrame([("a",), ("b",)], "node string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert sorted(r["id"] for r in graph.incident(edges, spark.createDataFrame([("a",), ("b",)], "node string")).collect()) == ["a|x|b", "b|x|c", "c|x|a"]
    assert hops(graph.bfs(edges, spark.createDataFrame([("a",)], "node string"), 3)) == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_nearest_for_many_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = random.Random(2)
    rows = [(f"c{i}", [rng.random() - 0.5 for _ in range(4)]) for i in range(60)] + [("zero", [0.0] * 4), ("short", [1.0]), ("none", None), ("c0b", None)]
    rows += [("twin", rows[0][1])]
    chunks = spark.createDataFrame(rows, "id string, embedding array<float>")
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(8)], "query_id int, vector array<float>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    good = [(i, v) for i, v in rows if v and len(v) == 4 and any(v)]
    got = topk.knn_batch(chunks, queries, 5).collect()
    assert len(got) == 40
    for q in range(8):
        want = sorted((-round(cos(v, rows[q][1]), 5), i) for i, v in good)[:5]
        assert [(r["id"], round(r["score"], 5)) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in want]
    one = topk.knn(chunks, rows[0][1], 3).collect()
    assert [r["id"] for r in one][:2] == ["c0", "twin"] and "embedding" not in one[0].asDict()


def test_community_numbers_follow_the_ranges(spark):
    rows = [(f"n{i}", f"k{i % 37:02d}") for i in range(500)]
    got = community.sizes(spark.createDataFrame(rows, "id string, component string"), 2).collect()
    want = sorted(((-sum(c == k for _, c in rows), k) for k in {c for _, c in rows}))
    assert sorted(((-r["member_count"], r["component"]), int(r["label"].split("_")[1])) for r in got) == [(w, i) for i, w in enumerate(want, 1)]


def test_documents_arrive_as_a_stream(spark, tmp_path):
    engine = Engine(spark, Store(spark, str(tmp_path / "g")), HashEmbeddings(16), EchoLanguage(lambda s, u: '{"entities": [{"name": "Acme", "type": "org"}], "relationships": []}'), EngineConfig(dim=16))
    (tmp_path / "in").mkdir()
    lines = ['{"id": "1", "title": "One", "text": "Acme."}', '{"id": "1", "title": "One", "text": "Acme."}', '{"id": "2", "title": "Two", "text": "More of Acme."}']
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    run = lambda: jobs.ingest_stream(jobs.documents_stream(spark, str(tmp_path / "in")), str(tmp_path / "state"), lambda df, batch: engine.ingest(df.select("id", "title", "text"), ("documents", batch))).awaitTermination(120)
    assert run()
    assert engine.store.read("documents").where("status = 'ready'").count() == 2 and engine.graph().nodes.where("type = 'org'").count() == 1
    (tmp_path / "in" / "b.json").write_text('{"id": "3", "title": "Three", "text": "Acme again."}')
    assert run()
    assert engine.store.read("jobs").where("status = 'completed'").count() == 3 and engine.graph().edges.count() == 3


def test_props_are_matched_by_type(spark):
    rows = [(1, '{"a": "x", "n": 2, "b": true}'), (2, '{"a": "y", "n": 2}'), (3, '{"a": "x", "n": "2"}'), (4, None), (5, "no json"), (6, '{"a": ["x"]}')]
    df = spark.createDataFrame(rows, "i int, props string")
    has = lambda wanted: [r["i"] for r in df.where(contains_props(F.col("props"), wanted)).orderBy("i").collect()]
    assert has({"a": "x"}) == [1, 3] and has({"n": 2}) == [1, 2] and has({"a": "x", "n": 2}) == [1] and has({"b": True}) == [1] and has({}) == [1, 2, 3, 4, 5, 6]
    assert has({"b": 1}) == [] and has({"a": ["x"]}) == [6] and has({"a": []}) == [6] and has({"n": 2.0}) == [1, 2] and has({"z": None}) == []
    deep = spark.createDataFrame([(1, '{"a": {"b.c": [1, {"d": null, "e": 1.5}]}}'), (2, '{"a": {"b.c": [1.5]}}'), (3, '{"a": 1}'), (4, '{"a": true, "it\'s": 1}')], "i int, props string")
    has = lambda wanted: [r["i"] for r in deep.where(contains_props(F.col("props"), wanted)).orderBy("i").collect()]
    assert has({"a": {"b.c": [{"e": 1.5}]}}) == [1] and has({"a": {"b.c": [{"d": None}, 1]}}) == [1] and has({"a": {"b.c": [1.5]}}) == [2] and has({"a": 1}) == [3] and has({"a": True}) == [4] and has({"it's": 1}) == [4] and has({"a": {}}) == [1, 2]


def test_answers_settle_no_more_hits_than_they_read(spark, monkeypatch):
    nodes = spark.createDataFrame([("hub", "org", "hub"), *((f"n{i}", "org", f"n{i}") for i in range(60))], "id string, type string, name string")
    edges = edges_of(spark, [("hub", f"n{i}", "near") for i in range(60)])
    chunks = [("c", "hub", "document_chunk", "the hub", [1.0, 0.0])] + [(f"c{i:02}", f"n{i}", "document_chunk", f"text {i}", [0.0, 1.0]) for i in range(60)]
    g = retrieval.Graph(nodes, edges, spark.createDataFrame(chunks, "id string, node_id string, kind string, text string, embedding array<float>"))
    config, settled = EngineConfig(dim=2, context_token_budget=100, retrieval_top_k=2), []
    plain = qa.settle
    monkeypatch.setattr(qa, "settle", lambda df: settled.append(plain(df)) or settled[-1])
    got = qa.ask(g, "why", [1.0, 0.0], EchoLanguage(), config, "hybrid", 1, hops=1)
    assert settled[0].count() <= retrieval.most_packed(100) == 26
    whole = retrieval.hybrid(g, [1.0, 0.0], config, 1, None, 1).hits
    context = retrieval.pack_context(whole, 100).collect()[0]["context"]
    assert got.answer == EchoLanguage().complete("", f"Context:\n{context}\n\nQuestion: why\n\nAnswer:", 0.2)
    assert got.sources == retrieval.sources(whole, 1).collect() and got.confidence == retrieval.confidence(whole, 2).collect()[0]["confidence"]


def test_tables_of_the_fixture_are_written_when_read(spark, tmp_path, monkeypatch):
    from graphfold import queries
    from graphfold.sources import fixture

    monkeypatch.setattr(fixture, "_BUILT", {})
    done, plain = [], fixture.materialize
    monkeypatch.setattr(fixture, "materialize", lambda df, name: done.append(name) or plain(df, name))
    assert queries.knn_batch_top5(spark, "/root/testdata/sf0.001").count() == 50 and done == ["g_chunks"]
    assert queries.mode_resolved(spark, "/root/testdata/sf0.001").count() == 3 and done == ["g_chunks", "g_nodes"]


def test_replies_are_parsed_once(spark, monkeypatch):
    from graphfold import queries

    asked, plain = [], extraction.parse
    monkeypatch.setattr(extraction, "parse", lambda *a, **k: asked.append(plain(*a, **k)) or asked[-1])
    for name in ("ingest_totals", "description_chunks"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
        assert "try_parse_json" not in plan and "parse_json" not in plan
    assert len(asked) == 2


def test_ends_of_relations_are_found_in_two_shuffles(spark):
    rows = [("d1", 0, 0, "A", "x"), ("d1", 0, 1, "B", "x"), ("d1", 1, 0, "a", "y"), ("d1", 1, 1, "C", "x"), ("d2", 0, 0, "B", "z"), ("d2", 0, 1, "b", "x")]
    mentions = spark.createDataFrame([(*r, "") for r in rows], "doc_id string, ord int, item int, name string, type string, description string")
    nodes = resolution.resolve(mentions, describe=False).select("id", "type", "normalized_name")
    rel = [("d1", 0, 0, "a", "b"), ("d1", 1, 0, "A", "B"), ("d1", 1, 1, "c", "a"), ("d1", 1, 2, "c", "gone"), ("d2", 0, 0, "b", "B"), ("d2", 5, 0, "B", "A"), ("d1", 0, 1, "a", "c"), (None, 0, 0, "a", "b")]
    relations = spark.createDataFrame([(*r, "next", "") for r in rel], "doc_id string, ord int, item int, source string, target string, type string, description string")
    e = resolution.relation_edges(relations, mentions, nodes)
    label = {r["id"]: f"{r['type']}:{r['normalized_name']}" for r in nodes.collect()}
    assert {(label[r["src"]], label[r["dst"]]) for r in e.collect()} == {("x:a", "x:b"), ("y:a", "x:b"), ("x:c", "y:a"), ("x:a", "x:c")}
    assert e._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 0


def test_few_rows_meet_large_tables_without_shuffling_them(spark, tmp_path):
    rows = spark.range(400_000).selectExpr("concat('e', id) AS id", "concat('n', id % 977) AS src", "concat('n', id % 991) AS dst", "'near' AS type")
    rows.write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    few = graph.settle(edges.where("id IN ('e1', 'e2')").select(F.col("src").alias("node")))
    assert few.count() == 2 and graph.settle(edges.where("false")).collect() == [] and graph.settle(edges.limit(3)).schema == edges.schema
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        touched = graph.incident(edges, few)
        plan = touched._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        want = edges.where("src IN ('n1', 'n2') OR dst IN ('n1', 'n2')")
        assert sorted(touched.collect()) == sorted(want.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_automatic_search_finds_its_entities_once(spark, monkeypatch):
    g, calls, plain = small_graph(spark), [], retrieval.entity_seeds
    monkeypatch.setattr(retrieval, "entity_seeds", lambda *a, **b: calls.append(a) or plain(*a, **b))
    found = retrieval.search(g, "What is Acme?", [0.0, 0.0], CONFIG, "auto", 10, hops=1)
    assert found.mode == "local" and len(calls) == 1
    assert [(h["id"], h["node_name"], h["text"], h["phase"]) for h in found.hits.collect()] == [("c3", "Acme", "about acme", 0), ("c6", "Acme", "more", 0), ("c4", "Bob", "about bob", 0), ("c1", "Doc", "cited", 1), ("c2", "Doc", "other", 2)]
    assert {n["id"] for n in found.nodes.collect()} == {"d1", "e1", "e2"}
    # the texts of hits are looked up: what ranks them reads none
    read, looked = [], retrieval._looked_up
    monkeypatch.setattr(retrieval, "_looked_up", lambda g, rows: read.append(len(rows)) or looked(g, rows))
    assert [h["id"] for h in retrieval.local(g, "What is Acme?", [0.0, 0.0], CONFIG, 2, 1).hits.collect()] == ["c3", "c6"] and read == [0, 2]


def test_scores_meet_nodes_in_a_join_only_where_few_fit(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i:02}", "rare" if i < 2 else "org", f"N{i}") for i in range(40)], "id string, type string, name string")
    chunks = spark.createDataFrame([(f"c{i:02}", f"n{i:02}", "document_chunk", f"text {i}", [1.0, i / 10]) for i in range(40)], "id string, node_id string, kind string, text string, embedding array<float>")
    g, joins, plain = retrieval.Graph(nodes, spark.createDataFrame([], "id string, src string, dst string, type string"), chunks), [], retrieval.scores
    monkeypatch.setattr(retrieval, "scores", lambda *a: joins.append(a) or plain(*a))
    assert [r["id"] for r in retrieval.nearest(g, [0.0, 1.0], 3, nodes.where("type = 'org'"))[1]] == ["c39", "c38", "c37"] and not joins
    assert [r["id"] for r in retrieval.nearest(g, [0.0, 1.0], 3, nodes.where("type = 'rare'"))[1]] == ["c01", "c00"] and len(joins) == 1
