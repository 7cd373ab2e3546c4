"""Registered queries against their SQL on the smallest data."""

import os

import pytest

import catalog

FOLDER = "/root/testdata/sf0.001"
SAMPLE = """weekly_entity_score lookup_list concat_text_parts number_rows_spread quantile_bin chunk_tokens
clean_post corr_spearman event_study_before_after neighbor_overlap distant_supervision shift_indicators
regional_exposure bow_tf_idf""".split()


def test_every_oracle_has_a_query():
    queries, oracles = catalog.load()
    assert len(queries) > 150 and set(oracles) <= set(queries)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    queries, oracles = catalog.load()
    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    df = queries[name](spark, FOLDER)
    cols = sorted(df.columns)
    cur = db.execute(oracles[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    want = sorted((tuple(row[at[c]] for c in cols) for row in cur.fetchall()), key=repr)
    assert sorted((tuple(row[c] for c in cols) for row in df.collect()), key=repr) == want
