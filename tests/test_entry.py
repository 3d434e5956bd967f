"""Driver contract: entry, queries and oracle_sql."""

import __spark_entry__ as E


def test_oracles_belong_to_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
    for sql in o.values():
        assert "round(" not in sql.replace("round(TRY_CAST", "") or "::DOUBLE" in sql


def test_entry_runs(spark):
    df = E.entry(spark)
    cols = df.columns
    assert cols[:2] == ["run", "generation"] and "perplexity" in cols
    assert df.count() > 0
