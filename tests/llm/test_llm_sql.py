"""The queries that SQL can state give DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from casewise.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        path = f"{FOLDER}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path}/*.parquet'" if os.path.isdir(path) else f"create view {t} as select * from '{path}'")
    df = queries.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    found = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(tuple(r[columns.index(n)] for n in names) for r in found.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_contract_columns(spark):
    want = {
        "op1_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
        "op2_histogram_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"},
        "op7_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    }
    for name, columns in want.items():
        assert columns == set(queries.queries()[name](spark, FOLDER).columns)
