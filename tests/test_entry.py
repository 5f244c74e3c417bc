import __spark_entry__ as E
from compare import compare
from conftest import SMALL


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.columns == ["server_id", "seq", "policy_no", "policy_name", "db_name", "message"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_cheap_queries_match_duckdb(spark):
    q, o = E.queries(), E.oracle_sql()
    for name in ["select_list", "for_each_writable", "pol_19", "pol_25", "activity_snapshot", "xe_events",
                 "policy_eligibility", "file_plan", "dq_fk"]:
        ok, msg = compare(q[name](spark, SMALL), SMALL, o[name])
        assert ok, (name, msg)
