"""BM25 recall over all documents."""

import math

import pytest

import __spark_entry__
from folioweave.operators.recall import query_terms, ranked


def test_every_document_is_scored(spark):
    texts = {7: "old pump, old pump", 3: "Old PUMP old pump", 5: "the valve", 9: None, 1: "", 2: "pump of the école"}
    split = {i: query_terms_in_order(t) for i, t in texts.items()}
    n, average = len(texts), sum(map(len, split.values())) / len(texts)
    want = {}
    for i, ts in split.items():
        for w in ("old", "pump", "école"):
            if w in ts:
                d, f = sum(w in x for x in split.values()), ts.count(w)
                want[i] = want.get(i, 0) + math.log(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ts) / average))
    got = [(r["rank"], r["doc_id"], r["score"]) for r in ranked(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "Old pump école?").collect()]
    assert got == [(k + 1, i, pytest.approx(s, abs=0.001)) for k, (i, s) in enumerate(sorted(want.items(), key=lambda x: (-x[1], x[0])))]


def query_terms_in_order(text):
    return [w for x in (text or "").replace(",", " ").split() for w in query_terms(x)]


def test_no_terms_no_hits(spark):
    assert ranked(spark.createDataFrame([(1, "pump")], "doc_id long, text string"), "? a").count() == 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))


def test_as_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = duckdb.sql(__spark_entry__.oracle_sql()["recall_bm25_topk"]).fetchall()
    assert [tuple(r) for r in __spark_entry__.queries()["recall_bm25_topk"](spark, folder).collect()] == want
