import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = ["q05_bm25_postfilter", "q13_interleave", "q15_citation", "q17_evidence_budget", "q26_result_kind", "q31_request_validation", "q32_image_validation", "q35_rate_limit", "q37_job_ttl_state", "q41_standard_id", "q42_cjk_bigrams", "q43_header_split"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert got == want


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["qid", "pos", "chunk_id", "candidate_source", "seed_rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_predicates_stay_above_the_index_cut(spark):
    plan = entry.queries()["q02_dense_postfilter"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 2 and "WindowGroupLimit" in plan
