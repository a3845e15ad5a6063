"""Every query with SQL, against DuckDB on the smallest tables."""

import pytest

from tests.compare import compare, duck
from workload import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
# written for larger tables: a cut date column, deep neighbourhoods
FITTED = {"f18_suggest_targets", "f17_data_warnings", "f16_quality_flags", "f1_column_profile_text"}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in FITTED])
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SMALL, QUERIES[name], ORACLES[name])
    assert ok, note


def test_only_scores_of_texts_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"k1_train_on_texts"}


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
