"""The registered queries and their SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
SAMPLE = ["flagship_daily_features", "a01_rollup_daily", "a03_missing_summary", "w06_dry_spell", "w09_time_rolling",
          "w19_filled_increments", "j05_nearest_cell", "a19_metrics", "a13_lag_rank_correlation", "m01_holdout",
          "m12_monthly_ridge", "m20_quantile_mapping"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
              "conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def split_row(row):
    """Exact cells and numeric cells of a row; floats are compared with a tolerance."""
    exact = tuple(repr(v) for v in row if not isinstance(v, float))
    return exact, tuple(v for v in row if isinstance(v, float))


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.oracle_sql()) >= 120


def test_every_oracle_is_valid_sql(con):
    for name, text in contract.oracle_sql().items():
        con.execute(f"EXPLAIN {text}")


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 150 and {"station", "date", "total_rm7", "consec_dry", "doy_sin"} <= set(df.columns)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    got = contract.queries()[name](spark, SF).toArrow()
    want = con.sql(contract.oracle_sql()[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = [sorted(split_row(r.values()) for r in t.select(names).to_pylist()) for t in (got, want)]
    assert [r[0] for r in rows[0]] == [r[0] for r in rows[1]]
    for (_, ours), (_, theirs) in zip(*rows):
        assert ours == pytest.approx(theirs, rel=1e-5, abs=1e-5, nan_ok=True)
