"""Value tables by digest against those with the values."""

import datetime

from pyspark.sql import functions as F

from tablekit.functions import frequency


def _table(spark):
    at = datetime.datetime(2024, 1, 2)
    rows = [(1, 1.5, "a b c", at), (1, None, "a b c", None), (2, 1.5, "", at), (None, 2.5, "  ", at), (3, 0.0, None, at), (3, 0.0, "word " * 3000, at)]
    return spark.createDataFrame(rows * 3, "n int, d double, s string, t timestamp")


def test_summary(spark):
    df = _table(spark)
    got = frequency.frequency_summary(df, df.columns)
    assert [got[c]["unique"] for c in "ndst"] == [3, 3, 4, 1]
    text = got["s"]
    assert (text["filled"], text["unique_nonblank"], text["words"]) == (9, 2, 3 * (3 + 3 + 3000))
    assert got["n"]["filled"] == 0 and got["t"]["repeated"] == 1
    full = frequency.value_frequency(df, df.columns).groupBy("column_name").agg(F.sort_array(F.collect_list("count")).alias("n"))
    short = frequency.value_digests(df, df.columns).groupBy("column_name").agg(F.sort_array(F.collect_list("count")).alias("n"))
    assert sorted(full.collect()) == sorted(short.collect())
    assert frequency.frequency_summary(df.limit(0), df.columns) == {}


def test_texts_stay_out_of_the_shuffle(spark):
    df = _table(spark)
    plan = frequency.value_digests(df, df.columns)._jdf.queryExecution().sparkPlan().toString()
    keys = [line for line in plan.splitlines() if "HashAggregate(keys=[" in line]
    assert len(keys) == 2 and all("_h#" in k and "_s#" not in k.split("functions=")[0] for k in keys[:1])
    assert "_s#" in frequency.value_frequency(df, df.columns)._jdf.queryExecution().sparkPlan().toString()
