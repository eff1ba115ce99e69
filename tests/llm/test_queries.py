"""The registered queries and the pipeline over whole given tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from llm.queries import oracle_sql, queries  # noqa: E402
from tests.llm.brute import jaccard_components, lower  # noqa: E402
from tests.llm.test_substring_dedup import brute  # noqa: E402
from tests.oracle_check import compare  # noqa: E402

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op3_embedding_neardup": {"vec_id", "n_links", "component_id", "kept"},
    "op5_ngram_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op7_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_mixing_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op11_importance_resampling": {"doc_id", "n_features", "weight", "score", "rank"},
    "op12_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op13_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
                          "shapley"},
}
WHOLE = {"op1": "documents", "op3": "embeddings", "op5": "documents", "op6": "pages", "op7": "documents", "op8": "documents",
         "op9": "documents", "op10": "documents", "op11": "documents", "op12": "pages"}


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_returns_a_row_for_each_row(spark, name):
    df = queries()[name](spark, FOLDER)
    assert COLUMNS.get(name, set()) <= set(df.columns)
    rows = df.collect()
    if table := WHOLE.get(name.split("_")[0]):
        assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{FOLDER}/{table}.parquet'").fetchall()[0][0]


def test_op5_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op5_ngram_jaccard_join"](spark, FOLDER).collect()}
    assert got == jaccard_components(rows, 3, 90)


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], FOLDER).write.parquet(f"{tmp_path}/{k}")
        tables.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    first, named, apart, cut, clean, mixed = [{r.doc_id: r for r in t.collect()} for t in tables]
    assert len(named) > 0.9 * len(first) and named.items() <= first.items()
    want = jaccard_components([(i, r.text) for i, r in named.items()], 5, 80)
    assert set(apart) == {i for i, (_, c) in want.items() if c == i}
    left = {i: x for i, x in brute([(i, r.text) for i, r in apart.items()]).items() if x[2] == 0 or x[0].split()}
    assert {i: r.text for i, r in cut.items()} == {i: x[0] for i, x in left.items()}
    items = [lower(t) for _, t in duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    exact = {i for i, r in cut.items() if any(" ".join(t.split()) in " ".join(lower(r.text).split()) for t in items)}
    assert not exact & set(clean) and len(cut) - len(clean) <= len(exact) + 2
    assert set(mixed) == set(clean) and all(r.taken <= 2 * r.size for r in mixed.values())
    assert sum(r.taken for r in mixed.values()) > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert compare(queries()[name](spark, FOLDER), con, oracle_sql()[name]) is None


def test_entry_registers_all_of_them():
    import __spark_entry__ as entry

    assert {*queries(), "pipeline"} <= set(entry.queries()) and set(oracle_sql()) <= set(entry.oracle_sql())
