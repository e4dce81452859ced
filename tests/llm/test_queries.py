"""Registered corpus queries against their SQL, and planted cases in the tables given."""

import duckdb
import pytest

from tickertide.llm import queries

TABLES = ("documents", "embeddings", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want, got = con.sql(queries.CHECKS[name]).df(), queries.QUERIES[name](spark, folder).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    want, got = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (want, got))
    assert want.equals(got)


def test_every_query_gives_each_document_once(spark, folder):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect())
    for name in ("op2_sharding", "op3_language_id", "op6_ngram_jaccard", "op8_sentencepiece", "op9_toxicity"):
        assert sorted(r.doc_id for r in queries.QUERIES[name](spark, folder).select("doc_id").collect()) == ids, name
