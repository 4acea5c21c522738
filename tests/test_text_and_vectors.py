import math

import pytest
from pyspark.sql import functions as F

from graphfold.config import EngineConfig
from graphfold.errors import Conflict, EmbeddingDimension, Invalid, NotFound, Upstream
from graphfold.functions import text as X
from graphfold.functions import vectors as V
from graphfold.operators import chunking, tables
from graphfold.operators.topk import knn
from graphfold.sources import clients


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_names_and_types(spark):
    assert one(spark, X.normalize_name(F.lit("  Dr.   Smith "))) == "dr. smith"
    assert one(spark, X.normalize_name(F.lit("A\xa0\x1cB"))) == "a b"
    assert one(spark, X.normalize_type(F.lit("Health-Org"))) == "health_org"
    assert one(spark, X.normalize_type(F.lit("  "))) == "concept"
    assert one(spark, X.clean_type(F.lit("A b-c!"))) == "a_b_c"
    assert one(spark, X.clean_name(F.lit(None).cast("string"))) == ""


def test_phrases_and_themes(spark):
    got = one(spark, X.phrases(F.lit("Dr. Smith at Boston General")))
    assert {"boston", "general", "boston general", "dr. smith at boston general"} <= set(got)
    assert one(spark, X.phrases(F.lit(" "))) == []
    assert one(spark, X.thematic(F.lit("Give me an OVERVIEW"))) and one(spark, X.thematic(F.lit("the overall picture")))
    assert not one(spark, X.thematic(F.lit("Who leads oncology at Boston?")))
    assert [one(spark, X.informative(F.lit(t))) for t in (" no_info ", "", "NO_INFO.", "x")] == [False, False, True, True]


def test_fit_embedding(spark):
    fit = lambda v, d: one(spark, V.fit_embedding(F.lit(v), d))
    assert fit([0.0, 1.0, 0.0], 3) == [0.0, 1.0, 0.0]
    assert fit([3.0, 4.0, 0.0, 9.0], 2) == pytest.approx([0.6, 0.8])
    assert fit([2.0, 0.0], 2) == [2.0, 0.0]
    assert fit([0.0, 0.0, 5.0], 2) == [0.0, 0.0]
    with pytest.raises(Exception, match="embedding needs 3"):
        fit([1.0, 2.0], 3)
    assert clients.fit([3, 4, 0, 9], 2) == pytest.approx([0.6, 0.8])
    with pytest.raises(EmbeddingDimension):
        clients.fit([1], 2)


def test_cosine_of_zero_vectors_is_left_out(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [2.0, 0.0]), ("e", [-1.0, 0.0])], "id string, embedding array<float>")
    got = knn(rows, [3.0, 0.0], 10).collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [("a", 1.0), ("d", 1.0), ("e", -1.0)]


def test_batches_and_retries():
    class Counting:
        calls = []

        def embed(self, texts):
            self.calls.append(list(texts))
            return [[1.0, 2.0, 3.0]] * len(texts)

    c = Counting()
    assert len(clients.embed_texts(c, ["a", "b", "c"], EngineConfig(dim=2, embedding_batch_size=2))) == 3
    assert c.calls == [["a", "b"], ["c"]]
    left = [2]

    def flaky():
        if left[0]:
            left[0] -= 1
            raise TimeoutError("slow")
        return "ok"

    waits = []
    assert clients.with_retries(flaky, 2, sleep=waits.append) == "ok" and waits == [0.25, 0.5]
    with pytest.raises(Upstream):
        clients.with_retries(lambda: (_ for _ in ()).throw(ConnectionError("down")), 1, sleep=waits.append)
    with pytest.raises(Upstream):
        clients.with_retries(lambda: (_ for _ in ()).throw(ValueError("bad")), 5, sleep=lambda s: pytest.fail("no retry"))


def test_settings_are_checked():
    with pytest.raises(Invalid):
        EngineConfig(expand_hops=6)
    with pytest.raises(Invalid):
        EngineConfig(community_min_size=1)


def test_chunks():
    assert chunking.split_text("") == [] == chunking.split_text("   \n\n  ")
    assert [c[2] for c in chunking.split_text("Hello world.", 100, 10)] == ["Hello world."]
    text = "Para one.\n\nPara two.\n\nPara three."
    got = chunking.split_text(text, 40, 5)
    assert got[0][2].startswith("Para one.") and got[-1][2].endswith("Para three.") and all(a <= b for a, b, _ in got)
    long = chunking.split_text("x" * 2500, 1000, 100)
    assert len(long) >= 3 and all(len(c[2]) <= 1102 for c in long)
    with pytest.raises(Invalid):
        chunking.split_text("x", 10, 10)
    # a blank line of CR LF ends a paragraph, a single line end does not
    assert [c[2] for c in chunking.split_text("a\nb\r\n\r\nc", 3, 0)] == ["a\nb", "c"]


def test_overlap_reaches_into_the_finished_chunk():
    got = [c[2] for c in chunking.split_text("aaaa\n\nbb\n\ncccc", 4, 3)]
    assert got == ["aaaa", "aaa\n\nbb", "\nbb\n\ncccc"]


def test_hard_split_matches_windows(spark):
    df = spark.createDataFrame([(i, "ab" * i) for i in (0, 1, 5, 50, 61)], "id int, text string")
    got = df.select("id", F.explode(chunking.hard_split(F.col("text"), 20, 5)).alias("w")).select("id", "w.*").collect()
    for i in (1, 5, 50, 61):
        mine = [(r["char_start"], r["char_end"], r["text"]) for r in got if r["id"] == i]
        assert mine == list(chunking.windows(0, "ab" * i, 20, 5))
    assert not [r for r in got if r["id"] == 0]


def test_table_errors(spark):
    nodes = spark.createDataFrame([("a", "t", "A"), ("b", "t", "B")], "id string, type string, name string")
    edges = spark.createDataFrame([("1", "a", "b", "x")], "id string, src string, dst string, type string")
    new = lambda *r: spark.createDataFrame([r], "src string, dst string, type string")
    with pytest.raises(Invalid):
        tables.insert_edges(nodes, edges, new("a", "a", "x"))
    with pytest.raises(NotFound):
        tables.insert_edges(nodes, edges, new("a", "z", "x"))
    with pytest.raises(Conflict):
        tables.insert_edges(nodes, edges, new("a", "b", "x"))
    assert tables.insert_edges(nodes, edges, new("b", "a", "x")).count() == 2
    with pytest.raises(Invalid):
        tables.insert_nodes(nodes, spark.createDataFrame([("c", " ", "C")], nodes.schema))
    with pytest.raises(NotFound):
        tables.insert_chunks(nodes, spark.createDataFrame([], "id string, node_id string, text string"), spark.createDataFrame([("a", "x"), ("z", "y")], "node_id string, text string"))
    patched = {r["id"]: r["name"] for r in tables.update(nodes, spark.createDataFrame([("a", "AA"), ("b", None)], "id string, name string")).collect()}
    assert patched == {"a": "AA", "b": "B"}
    assert math.isclose(one(spark, V.norm(F.lit([3.0, 4.0]))), 5.0)
