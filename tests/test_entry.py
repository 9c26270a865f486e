import duckdb
import pytest

import __spark_entry__ as entry
from sangam.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(cols, values):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    key = lambda v: round(float(v), 5) if isinstance(v, float) else v
    return sorted([tuple(key(r[i]) for i in at) for r in values], key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_query_has_a_name_and_sql_is_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["fertility_entropy_by_doc", "switch_points_by_doc", "transition_counts", "monolingual_runs", "reconstruct", "language_aware", "phonetic_normalization", "switch_encoding", "lang_tagging", "term_label_mi"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "uploads", "pipeline_output", "lexicon", "embeddings", "review_labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(catalogue.oracle_sql()[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got == want
