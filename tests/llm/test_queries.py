"""The registered queries, whole: against DuckDB's SQL, the tokenizers library, and each other."""

import hashlib

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from graphfold.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(x) for x in columns]
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_bpe_query_matches_the_library(spark):
    library = Tokenizer.from_file(bpe.vocabulary())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op3_bpe_round_trip"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_base_columns_agree(spark):
    base = {tuple(r) for r in queries.QUERIES["base_secrets"](spark, SF).collect()}
    whole = queries.QUERIES["op7_secret_scan"](spark, SF)
    assert {tuple(r) for r in whole.drop("spans").collect()} == base
    rules = {r["page_id"]: r for r in queries.QUERIES["url_rules"](spark, SF).collect()}
    for r in queries.QUERIES["op2_url_filter"](spark, SF).collect():
        rule = rules[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (rule["host"], rule["path"], rule["rule"])
        assert r["verdict"] == rule["verdict"] if rule["rule"] else r["verdict"] in ("allow", "block")


def test_every_operator_has_one_query():
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


def test_pipeline_over_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Stage after stage, written and read again, on rows with nulls, repeats and clashing names, and on none."""
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        rows = corpus_pipeline.run(spark, at).collect()
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in odd_docs.collect()}
        assert not (name == "none" and rows)
