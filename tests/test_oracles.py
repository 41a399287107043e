"""Every registered query with an oracle gives the oracle's rows; the others run and give rows."""

from pathlib import Path

import compare
import pytest

from tabwright.catalog import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"
# Full training runs; covered by the workflow test and the driver.
SLOW = {"champion", "confusion_by_model", "model_params", "model_svc_multi", "search_lr", "leaderboard"}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_matches_oracle(spark, oracle, name):
    found = compare.spark_rows(all_queries()[name](spark, FOLDER))
    assert compare.difference(found, compare.oracle_rows(oracle, all_oracles()[name])) is None


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles()) - SLOW))
def test_runs(spark, name):
    assert all_queries()[name](spark, FOLDER).count() > 0


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())
