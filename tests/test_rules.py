"""Boundaries of the typing, quality and repair rules on small tables."""

import pytest
from pyspark.sql import Row

from tabwright.operators import balance, quality, repair
from tabwright.operators import feature_types as ft
from tabwright.operators.cleaning import normalize_missing


@pytest.mark.parametrize(
    ("kind", "n_rows", "n_unique", "n_missing", "low", "high", "expected"),
    [
        ("bool", 100, 2, 0, None, None, ft.BINARY),
        ("bool", 100, 2, 1, None, None, ft.TEXT),
        ("text", 100, 95, 0, None, None, ft.ID_LIKE),
        ("text", 100, 94, 0, None, None, ft.TEXT),
        ("text", 100, 2, 0, None, None, ft.TEXT),
        ("int", 100, 2, 0, 0, 1, ft.BINARY),
        ("int", 100, 3, 0, 0, 90, ft.ENCODED),
        ("int", 100, 95, 0, 0, 99, ft.ID_LIKE),
        ("int", 1000, 10, 0, 0, 900, ft.ENCODED),
        ("int", 1000, 11, 0, 0, 50, ft.DISCRETE),
        ("int", 1000, 11, 0, 0, 51, ft.CONTINUOUS),
        ("int", 1000, 20, 0, 0, 19, ft.DISCRETE),
        ("int", 1000, 21, 0, 0, 20, ft.CONTINUOUS),
        ("int", 1000, 11, 1, 0, 50, ft.ENCODED),  # gaps make it a float column
        ("int", 1000, 16, 1, 0, 50, ft.CONTINUOUS),
        ("float", 100, 15, 0, 0, 1, ft.ENCODED),
        ("float", 100, 16, 0, 0, 1, ft.CONTINUOUS),
        ("float", 100, 100, 0, 0, 1, ft.CONTINUOUS),  # never an id
        ("int", 10, 0, 10, None, None, ft.ENCODED),
        ("other", 100, 2, 0, None, None, ft.BINARY),
        ("other", 100, 50, 0, None, None, ft.UNKNOWN),
    ],
)
def test_type_rules(kind, n_rows, n_unique, n_missing, low, high, expected):
    assert ft.classify(kind, n_rows, n_unique, n_missing, low, high)[0] == expected


def test_datetime_only_on_request(spark):
    days = spark.createDataFrame([Row(day=f"2024-01-{i % 5 + 1:02d}") for i in range(40)])
    assert ft.infer_types(days)["day"].type == ft.TEXT
    assert ft.infer_types(days, detect_datetime=True)["day"].type == ft.DATETIME


def test_nan_is_missing(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,)], "x double")
    assert ft.infer_types(rows)["x"].n_missing == 2


@pytest.mark.parametrize(("n_missing", "severity"), [(10, "low"), (11, "medium"), (50, "medium"), (51, "high")])
def test_missing_severity(n_missing, severity):
    types = {"c": ft.ColumnType("c", ft.CONTINUOUS, 100, 40, n_missing)}
    assert quality.detect_missing(types)[0]["severity"] == severity


@pytest.mark.parametrize(("top", "found"), [(98, None), (99, quality.NEAR_CONSTANT), (100, quality.CONSTANT)])
def test_constant_share(spark, top, found):
    rows = spark.createDataFrame([("a" if i < top else f"b{i}",) for i in range(100)], "c string")
    issues = quality.detect_constants(rows, ft.infer_types(rows))
    assert [i["type"] for i in issues] == ([found] if found else [])


@pytest.mark.parametrize(("large", "severity"), [(30, None), (31, "medium"), (100, "medium"), (101, "high")])
def test_imbalance(spark, large, severity):
    rows = spark.createDataFrame([("a",)] * large + [("b",)] * 10 + [(None,)] * 5, "t string")
    assert [i["severity"] for i in quality.detect_imbalance(rows, "t")] == ([severity] if severity else [])


def test_no_spread_means_no_outliers(spark):
    rows = spark.createDataFrame([(float(i) if i < 25 else 5.0,) for i in range(200)], "x double")
    types = ft.infer_types(rows)
    assert types["x"].type == ft.CONTINUOUS
    assert quality.detect_outliers(rows, types) == []


def test_cardinality():
    def issue(n_unique, n_rows):
        return quality.detect_cardinality({"c": ft.ColumnType("c", ft.TEXT, n_rows, n_unique, 0)})

    assert issue(50, 1000) == []
    assert issue(51, 1000)[0]["severity"] == "medium"
    assert issue(101, 1000)[0]["severity"] == "high"
    assert issue(21, 100)[0]["severity"] == "medium"


def test_markers(spark):
    rows = spark.createDataFrame([(" ? ",), ("N/A",), ("\tNone\n",), ("",), (" x y ",), (None,)], "c string")
    assert [r.c for r in normalize_missing(rows).collect()] == [None, None, None, None, "x y", None]


def _numeric(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    return rows, {"x": ft.ColumnType("x", ft.CONTINUOUS, len(values), 20, 0)}


def test_impute_median_interpolates(spark):
    rows, types = _numeric(spark, [1.0, 2.0, None])
    out, log = repair.impute(rows, {"x": "median"}, types)
    assert sorted(r.x for r in out.collect()) == [1.0, 1.5, 2.0]
    assert log[0]["values_imputed"] == 1


def test_median_of_a_category_becomes_mode(spark):
    rows = spark.createDataFrame([(1,), (3,), (3,), (2,), (2,), (None,)], "x int")
    types = {"x": ft.ColumnType("x", ft.ENCODED, 6, 3, 1)}
    out, log = repair.impute(rows, {"x": "median"}, types)
    assert sorted(r.x for r in out.collect()) == [1, 2, 2, 2, 3, 3]  # smallest of the most frequent
    assert log[0]["detail_action"] == "mode"


def test_text_without_values(spark):
    rows = spark.createDataFrame([(None,), (None,)], "c string")
    types = {"c": ft.ColumnType("c", ft.TEXT, 2, 0, 2)}
    assert {r.c for r in repair.impute(rows, {"c": "mode"}, types)[0].collect()} == {"Unknown"}


def test_constant_keeps_colons_and_checks_numbers(spark):
    rows = spark.createDataFrame([(None,)], "c string")
    types = {"c": ft.ColumnType("c", ft.TEXT, 1, 0, 1)}
    assert repair.impute(rows, {"c": "constant:a:b"}, types)[0].first().c == "a:b"
    numbers, types = _numeric(spark, [1.0, None])
    with pytest.raises(ValueError, match="not a number"):
        repair.impute(numbers, {"x": "constant:many"}, types)


def test_outlier_steps_see_what_is_left(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (100.0, 100.0), (None, 5.0), (2.0, 100.0)], "x double, y double")
    types = {c: ft.ColumnType(c, ft.CONTINUOUS, 4, 3, 0) for c in ("x", "y")}
    out, log = repair.handle_outliers(rows, {"x": quality.REMOVE, "y": quality.CAP}, types, {"x": (0, 10), "y": (0, 50)})
    assert sorted((r.x, r.y) for r in out.collect()) == [(1.0, 1.0), (2.0, 50.0)]
    assert (log[0]["rows_removed"], log[0]["rows_remaining"], log[1]["capped_above"]) == (2, 2, 1)


def test_equal_classes_are_left_alone(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "t string, x int")
    assert balance.undersample(rows, "t").count() == 2
    assert balance.oversample(rows, "t").count() == 2


def test_decisions_override_defaults():
    issues = [
        quality._issue(issue_id="missing_a", type=quality.MISSING, column="a", feature_type=ft.TEXT, severity="low"),
        quality._issue(issue_id="high_cardinality_a", type=quality.CARDINALITY, column="a", feature_type=ft.TEXT, severity="low"),
    ]
    resolved = repair.resolve_decisions(issues, {"missing_a": "drop rows", "high_cardinality_a": "drop_feature"})
    assert [r["choice"] for r in resolved] == ["drop rows", "ignored"]
