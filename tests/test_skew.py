"""One supplier, customer, user and host hold a third of all rows; results must not change their meaning."""

import shutil

import __spark_entry__ as entry
import duckdb
import pytest
from compare import TABLES, compare, connect

HOT = {
    "lineitem": "CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey END AS l_suppkey",
    "orders": "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey",
    "events": "CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id",
    "pages": "CASE WHEN page_id % 3 = 0 THEN 'http://one.example.com/' || page_id ELSE url END AS url",
}
NAMES = ("seasonal_merged", "season_to_date_risk", "gap_vs_state", "dup_rows", "wells_median", "impute_train_median",
         "drift_baseline", "quintile_calibration", "snapshot_diff_alerts", "text_top_results", "id_resolve", "zonal_mean")


@pytest.fixture(scope="module")
def skewed(tmp_path_factory, sf_dir):
    folder = tmp_path_factory.mktemp("skewed")
    for t in TABLES:
        if t in HOT:
            duckdb.sql(
                f"COPY (SELECT * REPLACE ({HOT[t]}) FROM read_parquet('{sf_dir}/{t}.parquet')) TO '{folder}/{t}.parquet'"
            )
        else:
            shutil.copy(f"{sf_dir}/{t}.parquet", folder)
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_hot_key(spark, skewed, name):
    ok, text = compare(spark, connect(skewed), skewed, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text
