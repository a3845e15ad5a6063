"""Physical plans: what reaches the scan, what is cut before a shuffle, and what never appears."""

import contextlib
import io

import pytest

from tablekit.operators import clean, filters, sample
from tablekit.sources.tables import read_parquet
from workload import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def orders(spark):
    return read_parquet(spark, f"{SMALL}/orders.parquet", has_nan=False)


def test_filters_and_columns_reach_the_scan(orders):
    text = plan(filters.keep_where_compare(orders, "o_totalprice", ">", 1000).select("o_orderkey"))
    assert "GreaterThan(o_totalprice,1000.0)" in text
    assert "struct<o_orderkey:bigint,o_totalprice:double>" in text
    text = plan(filters.filter_conditions(orders, [("and", "o_custkey", "==", "7"), ("or", "o_totalprice", "<", 9)]))
    assert "Or(EqualTo(o_custkey,7),LessThan(o_totalprice,9.0))" in text


def test_keep_first_is_cut_before_the_shuffle(orders):
    text = plan(clean.drop_duplicates_by(orders, ["o_custkey"], ["o_orderkey"]))
    assert text.count("WindowGroupLimit") >= 2


def test_top_rows_are_not_sorted_globally(orders):
    assert "TakeOrderedAndProject" in plan(sample.top_n(orders, "o_totalprice", ["o_orderkey"]))


@pytest.mark.parametrize(
    "name",
    ["i3_pie", "i9_density", "g7_cluster_zscores", "o1_frequent_itemsets", "p4_bootstrap_sum", "f5_value_counts", "j7_class_weights"],
)
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
