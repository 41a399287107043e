"""Rows survive splits, folds and resampling as they are, whatever their types; nothing is dropped without a word."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabwright.functions.columns import measured_text
from tabwright.operators import balance, evaluate, models, prepare, profile, repair, split
from tabwright.plans import workflow

SCHEMA = "label string, at timestamp, wall timestamp_ntz, amount decimal(38, 4), nested struct<a: int, b: array<timestamp>>, raw binary, named map<string, int>, big bigint, x double"


@pytest.fixture(scope="module")
def rows(spark):
    start = datetime(2024, 1, 1)
    made = []
    for i in range(400):
        at = start + timedelta(microseconds=i // 2)
        nested = None if i % 7 == 0 else (i % 3, [at, None] if i % 2 else [None, at])
        made.append((
            "ab"[i % 4 == 0], at, at, Decimal("12345678901234567890.0000") + Decimal(i // 3) / 10000, nested, bytes([i % 5, 0]),
            None if i % 11 == 0 else {"k": i % 2, "j": i % 3}, (1 << 53) + i // 5, None if i % 13 == 0 else i / 7,
        ))
    return spark.createDataFrame(made + made[:40], SCHEMA).repartition(3).cache()


def bag(frame):
    return sorted(repr(r) for r in frame.collect())


def test_no_row_changes_in_a_split_without_keys(rows):
    parts = split.stratified_split(rows, "label")
    assert bag(parts.drop("split")) == bag(rows)
    folds = split.stratified_folds(rows, "label", 5)
    assert bag(folds.drop("fold")) == bag(rows)


def test_resampling_draws_given_rows(rows):
    given = set(bag(rows))
    under, over = bag(balance.undersample(rows, "label")), bag(balance.oversample(rows, "label"))
    assert set(under) <= given and set(over) == given
    assert len(set(under)) > 0.8 * len(under) and len(over) == 2 * rows.filter("label = 'a'").count()


def test_keys_tell_values_and_parts_apart(spark):
    pairs = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "\\N"), ("\\N", None), ("", None), (None, "")], "p string, q string")
    key = F.concat(*[measured_text(F.col(c), pairs.schema[c].dataType) for c in pairs.columns])
    assert pairs.select(key).distinct().count() == 6


def test_decimals_count_in_full(spark):
    big = spark.range(1000).selectExpr("CAST(CAST('12345678901234567890' AS DECIMAL(24, 4)) + CAST(id AS DECIMAL(10, 0)) * 0.0001BD AS DECIMAL(38, 4)) AS d", "id % 3 AS k")
    assert profile.distinct_stats(big, ["d"])["d"] == (1000, 1)
    assert profile.duplicate_rows(big).first()["duplicates"] == 0
    assert profile.modes(big.union(big.filter("k = 2").limit(1)), ["d"])["d"].as_tuple().exponent == -4


@pytest.mark.parametrize("data_type", ["decimal(10, 2)", "float", "double", "bigint", "string"])
def test_targets_of_all_types_get_codes(spark, data_type):
    table = spark.range(120).select((F.col("id") % 12).cast(data_type).alias("t"))
    coded = prepare.encode_target(table, "t", prepare.target_codes(table, "t")).distinct().collect()
    order = sorted(coded, key=lambda r: str(r.t) if data_type == "string" else float(r.t))
    assert [r.label for r in order] == list(range(12))


def test_capping_keeps_type_and_values(spark):
    table = spark.range(100).selectExpr("9007199254740993 + id AS v", "CAST(id AS DECIMAL(10, 1)) AS d")
    capped, _ = repair.handle_outliers(table, {"v": repair.CAP, "d": repair.CAP}, {}, {"v": (0.0, 9e18), "d": (2.5, 90.0)})
    assert capped.schema == table.schema
    assert sorted(r.v for r in capped.collect()) == [9007199254740993 + i for i in range(100)]
    assert min(r.d for r in capped.collect()) == Decimal("2.5")


def test_missing_predictions_are_refused(spark):
    found = spark.createDataFrame([(1.0, 1.0), (0.0, None)], "label double, prediction double")
    with pytest.raises(Exception, match="prediction is missing"):
        evaluate.confusion_matrix(found).collect()


def test_classes_unseen_in_training_are_refused(spark):
    table = spark.range(200).selectExpr("id / 7.0 AS x", "CAST(id % 2 AS STRING) AS t")
    other = spark.range(20).selectExpr("id / 3.0 AS x", "'new' AS t")
    with pytest.raises(ValueError, match="20 test rows"):
        workflow.train(workflow.transform_presplit(table, other, "t"), names=(models.BAYES,))
    gaps = table.union(spark.createDataFrame([(1.0, None)], "x double, t string"))
    result = workflow.transform_presplit(gaps, table, "t")
    assert result.train.count() == 200 and result.log[0]["rows_removed"] == 1


def test_parameters_do_not_depend_on_size(spark):
    for n in (500, 25_000):
        table = spark.range(n).selectExpr("CAST(id % 2 AS DOUBLE) AS label", "CAST(id % 7 AS DOUBLE) AS x")
        rows = models.training_table(prepare.assemble(prepare.fit(table, ["x"], []), table, keep=["label", "x"]))
        assert models.train(models.TREE, rows).params == {"impurity": "gini", "maxDepth": 5}


def test_saved_models_score_alike(spark, tmp_path):
    table = spark.range(300).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS x", "CAST(id % 3 AS STRING) AS c", "IF(id % 10 > 4, 'y', 'n') AS t")
    result = workflow.transform(table, "t", config=workflow.Config(keys=("id",)))
    report = workflow.train(result)
    result.save(f"{tmp_path}/prep")
    again = workflow.Transformed.load(spark, f"{tmp_path}/prep")
    assert again.types == result.types and again.target == "t" and again.log == result.log
    for name, fitted in report.fitted.items():
        fitted.save(f"{tmp_path}/{fitted.name}")
        loaded = models.Fitted.load(spark, f"{tmp_path}/{name}")
        columns = [*result.plain_features, "prediction", "score"]
        assert bag(workflow.score(again, loaded, table).select(columns)) == bag(workflow.score(result, fitted, table).select(columns)), name


@pytest.mark.parametrize("task", [workflow.NUMBER, workflow.NO_TARGET])
def test_presplit_tables_with_other_targets(spark, task):
    table = spark.range(60).selectExpr("CAST(id % 20 AS DOUBLE) / 3 AS x", "CAST(id % 3 AS STRING) AS c", "IF(id = 7, NULL, id * 1.5D) AS t", "CAST(NULL AS DOUBLE) AS gone")
    result = workflow.transform_presplit(table, table, "t", task=task)
    rows = result.prepared(result.train)
    assert rows.count() == (59 if task == workflow.NUMBER else 60)
    assert ("label" in rows.columns) == (task == workflow.NUMBER)
    assert [e["column"] for e in result.log if e["action"] == workflow.STAGE_EMPTY] == ["gone"]
    if task == workflow.NUMBER:
        assert rows.agg(F.max("label")).first()[0] == 88.5


def test_correlations_with_gaps_in_one_pass(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.normal(size=(200, 5)) + 1e6
    values[rng.random((200, 5)) < 0.2] = np.nan
    values[:, 4] = 3.0
    table = spark.createDataFrame([tuple(float(v) for v in r) for r in values], "a double, b double, c double, d double, e double").repartition(4)
    found = {(r.a, r.b): r.correlation for r in profile.correlation_matrix(table).collect()}
    assert len(found) == 25
    for i, p in enumerate("abcde"):
        for j, q in enumerate("abcde"):
            both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
            if "e" in p + q:
                assert found[p, q] is None
            else:
                assert abs(found[p, q] - np.corrcoef(values[both, i], values[both, j])[0, 1]) < 1e-4


def test_a_hot_row_is_copied_by_many_tasks(spark, monkeypatch):
    from tabwright.functions import ordering

    monkeypatch.setattr(ordering, "COPIES_PER_TASK_ROW", 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = spark.range(50).select("id", F.when(F.col("id") == 0, 1000).otherwise(5).cast("bigint").alias("n"))
        copied = ordering.replicate(many, "n")
        sizes = [r["count"] for r in copied.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1245 and max(sizes) < 700
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize(("dtype", "values", "low", "high", "expected"), [
    ("tinyint", [-128, -1, 0, 120, 127, None], -138.5, 180.0, [-128, -1, 0, 120, 127, None]),
    ("tinyint", [-128, 0, 11, 127, None], 10.5, 99.5, [11, 11, 11, 99, None]),
    ("tinyint", [-128, 127], 300.0, 400.0, [127, 127]),
    ("tinyint", [-128, 127], -400.0, -300.0, [-128, -128]),
    ("int", [-(2**31), 2_000_000_000], -5e9, 5e9, [-(2**31), 2_000_000_000]),
    ("int", [-(2**31), 7], float("-inf"), float("inf"), [-(2**31), 7]),
    ("bigint", [2**53 - 1, 2**53, 2**53 + 1, 2**63 - 1], -1.0, 2.0**53, [2**53 - 1, 2**53, 2**53, 2**53]),
    ("bigint", [2**53, 2**53 + 1, -(2**63)], 2.0**53, 1e30, [2**53, 2**53 + 1, 2**53]),
    ("decimal(5,2)", ["1.00", "600.01", "999.99"], -1668.375, 1668.375, ["1.00", "600.01", "999.99"]),
    ("decimal(5,2)", ["12.34", "12.35", "600.00", "600.01", None], 12.345, 600.008, ["12.35", "12.35", "600.00", "600.00", None]),
    ("decimal(38,4)", ["9007199254740993.0001"], 0.0, 2.0**53, ["9007199254740992.0000"]),
    ("double", [1.5, -3.25, None], -3.0, 1.25, [1.25, -3.0, None]),
])
def test_bounds_are_compared_in_the_type(spark, dtype, values, low, high, expected):
    rows = spark.createDataFrame([(i, None if v is None else str(v)) for i, v in enumerate(values)], "i int, v string")
    rows = rows.select("i", rows.v.cast(dtype).alias("v"))
    capped, log = repair.handle_outliers(rows, {"v": repair.CAP}, {}, {"v": (low, high)})
    assert capped.schema["v"].dataType == rows.schema["v"].dataType
    got = [r.v for r in capped.orderBy("i").collect()]
    assert [None if v is None else str(v) if isinstance(e, str) else v for v, e in zip(got, expected, strict=True)] == expected
    beyond = [v is not None and not low <= Decimal(str(v)) <= high for v in values]
    assert log[0]["capped_below"] + log[0]["capped_above"] == sum(beyond)
    left, log = repair.handle_outliers(rows, {"v": repair.REMOVE}, {}, {"v": (low, high)})
    assert [r.i for r in left.orderBy("i").collect()] == [i for i, v in enumerate(values) if v is not None and not beyond[i]]
    assert log[0]["rows_removed"] == len(values) - left.count()
