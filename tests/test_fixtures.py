"""Small literal tables with known answers."""

import math

import json

import pytest
from pyspark.sql import functions as F

from tablekit.operators import chart, clean, edits, filters, profile, relate, sample, whatif
from tablekit.plans import cleaning
from tablekit.sources import tables


def col_of(df, name, key=None):
    rows = df.orderBy(key).collect() if key else df.collect()
    return [r[name] for r in rows]


@pytest.fixture()
def price(spark):
    return spark.createDataFrame([(1, 10, 2), (2, 20, 3), (3, 30, 4)], "id long, price long, quantity long")


def test_empty_column_then_formula(price):
    got = edits.add_empty_column(price, "revenue")
    assert col_of(got, "revenue") == [None] * 3
    assert col_of(edits.fill_column(got, "revenue", "price * quantity"), "revenue", "id") == [20, 60, 120]
    with pytest.raises(ValueError):
        edits.add_empty_column(price, "price")
    with pytest.raises(ValueError):
        edits.derive(price, "price", "quantity")


def test_formula_missing_and_power(spark):
    df = spark.createDataFrame([(1, 10.0, 2), (2, None, 3), (3, 30.0, 4)], "id long, price double, quantity long")
    assert col_of(edits.derive(df, "r", "price * quantity"), "r", "id") == [20, None, 120]
    assert col_of(edits.derive(df, "r", "power(quantity, 2)"), "r", "id") == [4, 9, 16]
    margin = spark.createDataFrame([(1, 100, 60), (2, 200, 80), (3, 300, 100)], "id long, price long, cost long")
    got = col_of(edits.derive(margin, "m", "try_divide(price - cost, price) * 100"), "m", "id")
    assert got == pytest.approx([40, 60, 66.6667], abs=0.01)
    assert col_of(edits.derive(df, "z", edits.modulo(F.lit(7), F.lit(-3))), "z")[0] == -2
    assert col_of(edits.derive(df, "z", edits.divide(F.lit(7), F.lit(0))), "z") == [None] * 3


def test_row_aggregates(spark):
    df = spark.createDataFrame([(1, 4, 7), (2, 5, 8), (3, 6, None)], "a long, b long, c long")

    def run(op):
        return col_of(edits.row_aggregate(df, "r", op), "r", "a")

    assert run("sum") == [12, 15, 9]
    assert run("mean") == [4, 5, 4.5]
    assert run("product") == [28, 80, 18]
    assert run("median") == [4, 5, 4.5]
    assert run("std") == pytest.approx([3, 3, math.sqrt(4.5)])
    empty = spark.createDataFrame([(None, None)], "a double, b double")
    assert [edits.row_aggregate(empty, "r", op).first()["r"] for op in edits.ROW_OPS] == [0, None, None, None, 1, None, None]


def test_rounding(spark):
    df = spark.createDataFrame([(1, 1.12345678, "x"), (2, None, "y"), (3, 3.50000001, "z")], "id long, p double, n string")
    assert col_of(edits.round_columns(df, ["p"], 2), "p", "id") == [1.12, None, 3.5]
    assert col_of(edits.round_columns(df, None, 2), "n", "id") == ["x", "y", "z"]
    ints = spark.createDataFrame([(1.4,), (2.6,), (3.5,), (2.5,)], "c double")
    assert sorted(col_of(edits.round_columns(ints, ["c"], 0), "c")) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        edits.round_columns(ints, ["c"], 16)


def test_split_first_word(spark):
    df = spark.createDataFrame([(1, "Mr James"), (2, " Dr Ada  Lovelace "), (3, None), (4, "Prince"), (5, "  ")], "id long, n string")
    got = edits.split_first_word(df, "n", "t", "r").orderBy("id").collect()
    assert [(x["t"], x["r"]) for x in got] == [("Mr", "James"), ("Dr", "Ada  Lovelace"), (None, None), ("Prince", ""), (None, None)]


def test_rows_and_duplicates(spark):
    df = spark.createDataFrame([(1, "paid"), (2, " Cancelled"), (3, None), (4, "paid")], "id long, status string")
    assert col_of(filters.drop_where_eq(df, "status", "cancelled"), "id", "id") == [1, 3, 4]
    assert col_of(filters.keep_where_eq(df, "status", "PAID"), "id", "id") == [1, 4]
    assert filters.keep_where_eq(df, "status", "none", unchanged_if_empty=True).count() == 4
    dup = spark.createDataFrame([("A", 1), ("A", 1), ("B", 2)], "name string, value long")
    assert clean.drop_duplicates(dup).count() == 2
    assert clean.duplicate_count(dup).first()["duplicate_rows"] == 1
    with pytest.raises(ValueError):
        filters.filter_expr(dup, "value > 9", allow_empty=False)
    with pytest.raises(ValueError):
        filters.drop_missing(dup, "nope")


def test_fill_and_outliers(spark):
    df = spark.createDataFrame([(1, 10.0, None), (2, None, "b"), (3, 30.0, "a")], "id long, income double, s string")
    assert col_of(clean.fill_missing(df, "income", "median"), "income", "id") == [10, 20, 30]
    assert col_of(clean.fill_missing(df, "s", "mode"), "s", "id") == ["a", "b", "a"]
    none = spark.createDataFrame([(None,)], "s string")
    assert clean.fill_missing(none, "s", "mode").first()["s"] == "Unknown"
    out = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 500]] + [(None,)], "x double")
    assert clean.drop_outliers(out, "x").count() == 5
    assert clean.clip_outliers(out).filter("x is null").count() == 1
    flat = spark.createDataFrame([(5.0,)] * 4 + [(9.0,)], "x double")
    assert clean.drop_outliers(flat, "x").count() == 5


def test_cleaning_recommendation(spark):
    rows = [("Alice", 30.0, "NY", "x", "10"), ("Alice", None, None, "x", "20"), ("Bob", 40.0, "LA", "x", "30")]
    df = spark.createDataFrame(rows, "Name string, Age double, City string, Flag string, Amount string")
    issues = cleaning.recommend_cleaning(df)
    keys = {r["issue"] for r in issues.collect()}
    assert {"duplicates", "constant_columns", "mixed_types", "missing_numeric", "missing_categorical", "column_names"} == keys
    options = cleaning.recommended_options(issues)
    assert options["fill_missing_numeric"] == "median" and options["fill_missing_categorical"] == "mode"
    got, _ = cleaning.clean(df, options)
    assert set(got.columns) == {"name", "age", "city", "amount"}
    assert dict(got.dtypes)["amount"] == "double"
    assert got.filter("age is null or city is null").count() == 0


def test_correlation_and_groups(spark):
    df = spark.createDataFrame([(1, 10, 8), (2, 20, 15), (3, 30, 22), (4, 40, 30)], "sales long, revenue long, cost long")
    top = relate.top_correlations(df).first()
    assert (top["column_a"], top["column_b"], top["strength"]) == ("sales", "revenue", "strong")
    gas = spark.createDataFrame([(4.0, "E10"), (5.0, "SP98"), (6.0, "E10")], "consume double, gas string")
    assert profile.scalar_stat(gas, "consume", "mean").first()["value"] == 5
    assert [tuple(r) for r in relate.group_means(gas, "consume", "gas").collect()] == [("E10", 5.0, 2), ("SP98", 5.0, 1)]


def test_target_hint(spark):
    rows = [(1, 30, 0, "no"), (2, 45, 1, "no"), (3, 20, 4, "yes"), (4, 75, 0, "no"), (5, 50, 2, "yes"), (6, 35, 3, "yes")]
    df = spark.createDataFrame(rows, "customer_id long, monthly_spend long, support_calls long, churned string")
    best = profile.suggest_targets(df).first()
    assert (best["column_name"], best["problem_type"]) == ("churned", "classification")
    assert profile.learning_mode(df) == "supervised"


def test_histogram_range_and_width(spark):
    score = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5, 100]], "score long")
    got = chart.chart_histogram(score, "score", x_min=2, x_max=5)
    assert got.agg(F.sum("count")).first()[0] == 4
    with pytest.raises(ValueError):
        chart.chart_histogram(score, "score", x_min=5, x_max=2)
    wide = spark.createDataFrame([(v,) for v in [0, 5, 19, 20, 21, 39, 40]], "score long")
    got = chart.chart_histogram(wide, "score", x_min=0, x_max=60, bin_width=20)
    assert col_of(got, "count", "bin") == [3, 3, 1]
    for bad in ({"bin_width": 0}, {"bin_width": 0.001}):
        with pytest.raises(ValueError):
            chart.chart_histogram(wide, "score", **bad)
    same = profile.histogram(spark.createDataFrame([(7,)] * 3, "v long"), ["v"]).collect()
    assert [tuple(r) for r in same] == [("v", 0, 6.5, 7.5, 3)]


def test_bars(spark):
    city = spark.createDataFrame([(c,) for c in "AABCD"], "city string")
    assert col_of(chart.chart_bar(city, "city", 2), "label") == ["A", "B"]
    many = spark.createDataFrame([(f"City {i}",) for i in range(20)], "city string")
    assert chart.chart_bar(many, "city").count() == 20
    pie = {r["label"]: r["count"] for r in chart.chart_pie(many, "city").collect()}
    assert pie["Other"] == 10 and len(pie) == 11


def test_many_bars_and_rows(spark):
    many = spark.range(2500).selectExpr("id", "concat('c', id) AS city")
    assert chart.chart_bar(many, "city", 2000).count() == 2000
    assert sample.top_n(many, "id", ["id"], 100).count() == 100
    wide = spark.range(30).selectExpr("id", *[f"double(id % {i + 2}) AS c{i}" for i in range(61)])
    assert profile.correlation_matrix(wide).count() == 62 * 62
    with pytest.raises(ValueError):
        sample.stratified_sample(many, "city", ["id"])


def test_quality_flags(spark):
    rows = [(10, 2, 20, "a"), (20, 3, 60, None), (20, 3, 60, None)]
    df = spark.createDataFrame(rows, "price long, quantity long, revenue long, notes string")
    got = {r["issue"]: (r["found"], r["columns"]) for r in profile.quality_flags(df).collect()}
    assert got["Duplicate rows"][0] == 1
    assert got["High missingness"] == (1, "notes") and got["Constant columns"] == (1, "notes")


def test_whatif(spark):
    rows = [(i, float(10 + i * 7 % 90), None) for i in range(50)]
    df = spark.createDataFrame([(i, u, 3 * u + (i % 5) - 2) for i, u, _ in rows], "id long, units double, revenue double")
    up = whatif.scenario(df, "units", "revenue", "percent", 10.0).first()
    down = whatif.scenario(df, "units", "revenue", "percent", -20.0).first()
    assert up["delta"] > 0 > down["delta"]
    trials = whatif.bootstrap(df, "units", "revenue", ["id"], trials=200)
    s = whatif.bootstrap_summary(trials).first()
    assert s["p05"] <= s["median"] <= s["p95"] and abs(s["delta"] / up["delta"] - 1) < 0.05
    again = whatif.bootstrap_summary(whatif.bootstrap(df, "units", "revenue", ["id"], trials=200)).first()
    assert again == s
    # the resampling spread of a mean is close to its standard error
    means = whatif.bootstrap(df, "units", "revenue", ["id"], "fixed", 0.0, aggregate="mean", trials=1000)
    sd = means.agg(F.stddev("result")).first()[0]
    se = df.agg(F.stddev("revenue") / math.sqrt(50)).first()[0]
    assert abs(sd / se - 1) < 0.15
    assert whatif.bootstrap_histogram(trials).agg(F.sum("count")).first()[0] == 200
    const = df.withColumn("c", F.lit(5.0))
    assert whatif.scenario(const, "c", "revenue").first()["beta"] == 0
    zero = df.withColumn("z", F.lit(0.0))
    assert whatif.scenario(zero, "units", "z").first()["pct_delta"] is None
    assert whatif.driver_slope(df, "units", "units").first()["beta"] == 1
    for bad in (lambda: whatif.scenario(df.limit(2), "units", "revenue"), lambda: whatif.scenario(df, "nope", "revenue")):
        with pytest.raises(ValueError):
            bad()


def test_sources(spark, tmp_path):
    head = "PRODUCT_NAME{0}price{0}in_stock\n"
    for name, sep in (("a", ","), ("b", ";"), ("c", "\t")):
        path = tmp_path / f"{name}.csv"
        path.write_text(head.format(sep) + f"Lamp{sep}3.5{sep}1\nDesk{sep}{sep}0\n")
        got = tables.read_csv(spark, str(path))
        assert got.columns == ["PRODUCT_NAME", "price", "in_stock"] and got.count() == 2
    (tmp_path / "r.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    assert tables.read_json(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "g.json").write_text(
        '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":"u"},"geometry":{"type":"Point","coordinates":[1,2]}},'
        '{"type":"Feature","properties":{"n":"v"},"geometry":null}]}'
    )
    got = tables.read_geojson(spark, str(tmp_path / "g.json")).orderBy("_feature_index").collect()
    assert [(r["n"], r["_feature_index"], r["_geometry_type"]) for r in got] == [("u", 0, "Point"), ("v", 1, "Unknown")]
    shapes = [
        {"type": "Point", "coordinates": [1.5, 2]},
        {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1.25], [0, 0]]]},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [3, 4]}, {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}]},
        None,
    ]
    props = [{"n": "u", "k": 1}, {"n": "v", "k": 2.5, "deep": {"a": [1]}}, None, {"n": 7, "odd name": True}]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in zip(props, shapes)]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "l.json").write_text(json.dumps(doc) + "\n")
    for name, multi_line in (("m", True), ("l", False)):
        got = tables.read_geojson(spark, str(tmp_path / f"{name}.json"), multi_line).orderBy("_feature_index").collect()
        assert [json.loads(r["_geometry"]) if r["_geometry"] else None for r in got] == shapes
        assert [(r["n"], r["k"], r["odd name"]) for r in got] == [("u", 1.0, None), ("v", 2.5, None), (None,) * 3, ("7", None, True)]
        assert got[1]["deep"]["a"] == [1]
    (tmp_path / "none.json").write_text('{"type":"FeatureCollection","features":[]}')
    with pytest.raises(Exception):
        tables.read_geojson(spark, str(tmp_path / "none.json"))
    tables.write_table(spark.range(3), str(tmp_path / "out"), "csv")
    assert tables.read_csv(spark, str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        tables.write_table(spark.range(3), str(tmp_path / "x"), "xls")
    with pytest.raises(ValueError):
        tables.check_limits(spark.range(10), max_rows=9)
    assert tables.check_select(" WITH a AS (SELECT 1) SELECT * FROM a; ").endswith("FROM a")
    for bad in ("DELETE FROM t", "SELECT 1; DROP TABLE t", "selection"):
        with pytest.raises(ValueError):
            tables.check_select(bad)


def test_coordinates_and_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a")], "Latitude double, lng double, name string")
    assert chart.detect_coordinates(df) == {"lat": "Latitude", "lon": "lng"}
    assert edits.standard_names([" A b", "a-b", "A_B"]) == ["a_b", "a_b_2", "a_b_3"]
    messy = spark.createDataFrame([(1.0, 2.0)], ["a.b", "c d"])
    assert edits.rename_column(messy, "a.b", "x").columns == ["x", "c d"]
    assert profile.column_profile(messy).count() == 2


def test_conversion(spark):
    df = spark.createDataFrame([(1, "12"), (2, "1.5"), (3, "12d"), (4, None)], "id long, v string")
    with pytest.raises(ValueError):
        edits.convert_type(df, "v", "integer")
    assert col_of(edits.convert_type(df, "v", "float"), "v", "id") == [12, 1.5, None, None]
    assert edits.introduced_missing(df, edits.convert_type(df, "v", "float"), "v") == 1
    euro = spark.createDataFrame([(1, "1.234,56"), (2, "7,5"), (3, None)], "id long, v string")
    assert col_of(edits.fix_decimal_comma(euro), "v", "id") == [1234.56, 7.5, None]


def test_csv_keeps_every_cell(spark, tmp_path):
    text = 'a,b,c\n1,2,3\n4,5\n7,8,9,10\n"x\ny",1,"say ""no"""\n'
    (tmp_path / "in.csv").write_text(text)
    got = tables.read_csv(spark, str(tmp_path / "in.csv"))
    rows = [tuple(r) for r in got.collect()]
    assert rows == [("1", 2, "3"), ("4", 5, None), ("x\ny", 1, 'say "no"')] and got.count() == 3
    df = spark.createDataFrame([(1, ' a "b"\n, c '), (3, None), (4, "\\")], "id long, t string")
    tables.write_table(df, str(tmp_path / "out"), "csv")
    back = tables.read_csv(spark, str(tmp_path / "out"), schema=df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_whole_numbers_keep_their_digits(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, str(big), 1.5)], "n long, t string, d double")
    assert edits.convert_type(df, "t", "integer").first()["t"] == big
    assert edits.convert_type(df, "n", "integer").first()["n"] == big
    rounded = edits.round_columns(df, ["n", "t", "d"], 0).first()
    assert (rounded["n"], rounded["t"], rounded["d"]) == (big, big, 2)
    assert dict(edits.round_columns(df, ["n"], 2).dtypes)["n"] == "bigint"
    rows = [(i, i % 5, float(i)) for i in range(10)]
    times = spark.createDataFrame(rows, "i long, s long, v double").selectExpr("v", "timestamp_seconds(0) AS t", f"{big - 5} + i AS k")
    ends = relate.trend_ends(times, "v", "t", "k").first()
    assert (ends["first_mean"], ends["last_mean"]) == (0.5, 8.5)


def test_shared_folders(spark):
    from tablekit.functions import storage

    class Settings(dict):
        def get(self, key, *default):
            return dict.get(self, key, *default)

    class Fake:
        def __init__(self, conf, master):
            self.conf, self.sparkContext, self.master = Settings(conf), self, master

    named = Fake({"spark.checkpoint.dir": "hdfs://x/c/"}, "yarn")
    assert storage.shared_base(named) == "hdfs://x/c"
    assert storage.shared_base(Fake({"spark.sql.warehouse.dir": "file:/w"}, "local[8]")) == "file:/w"
    assert storage.shared_base(Fake({"spark.sql.warehouse.dir": "hdfs://w"}, "yarn")) == "hdfs://w"
    with pytest.raises(ValueError):
        storage.shared_base(Fake({"spark.sql.warehouse.dir": "file:/w"}, "yarn"))
