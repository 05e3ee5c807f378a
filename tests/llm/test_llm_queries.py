"""The registered queries on the driver's smallest tables: those with SQL against DuckDB, the others by their columns and rows."""

import math
import os

import duckdb
import pytest

from gradeloom.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

# The columns that the contracts ask for, and how a query's rows relate to its table's.
COLUMNS = {
    "op1_minhash_near_dedup": ("documents", {"doc_id", "n_shingles", "component_id", "kept"}),
    "op2_soft_membership_mixing": ("documents", {"doc_id", "rate", "copies"}),
    "op3_sum_of_squares_packing": (None, {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}),
    "op4_lookup_table_sharding": ("documents", {"doc_id", "shard"}),
    "op5_nn_descent": ("embeddings", {"vec_id", "n_links", "component_id", "kept"}),
    "op6_license_scan": ("documents", {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}),
    "op7_url_rules": ("pages", {"page_id", "host", "path", "rule", "verdict"}),
    "op8_quality_rules": ("documents", {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}),
    "op9_nb_svm_quality": ("documents", {"doc_id", "held_out", "score", "predicted"}),
    "op10_toxicity_grammar": ("documents", {"doc_id", "held_out", "score", "predicted"}),
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: (None if math.isnan(x) else round(x, 6)) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    table, columns = COLUMNS[name]
    assert columns <= set(df.columns)
    if table:
        assert len(got) == duck.sql(f"select count(*) from {table}").fetchall()[0][0]
    if name in queries.ORACLE_SQL:
        want = duck.sql(queries.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert plain(got, df.columns) == plain(want.fetchall(), want.columns)
