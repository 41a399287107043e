"""End-to-end runs on a small table made by rule, and the written forms of tables and fits."""

import random
import time

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabwright.operators import models, prepare
from tabwright.operators.cleaning import MISSING_MARKERS, normalize_missing, stripped
from tabwright.operators.repair import log_frame
from tabwright.plans import workflow
from tabwright.sources import tables


@pytest.fixture(scope="module")
def people(spark):
    """500 rows: a signal in ``age`` and ``plan``, gaps, markers, outliers, a constant, an id; classes 4:1."""
    draw = random.Random(11)
    rows = []
    for i in range(500):
        yes = i % 5 == 0
        age = draw.gauss(60 if yes else 30, 5)
        plan = draw.choice(["gold", "gold", "basic"] if yes else ["basic", "basic", " ? "])
        rows.append((i, age if i % 20 else None, plan, draw.randint(0, 3), 10.0 ** draw.uniform(0, 4), 1, "yes" if yes else "no"))
    return spark.createDataFrame(rows, "id bigint, age double, plan string, visits int, spent double, one int, churn string")


@pytest.fixture(scope="module")
def result(people):
    return workflow.transform(people, "churn", config=workflow.Config(keys=("id",)))


def test_transform(spark, people, result):
    assert result.train.count() == 400 and result.test.count() == 100
    assert {"id", "one"}.isdisjoint(result.train.columns)
    assert {e["action"] for e in result.log} >= {"missing_value_imputation", "outlier_handling", "constant_feature_removal", "column_grouping"}
    assert log_frame(spark, result.log).filter("action = 'missing_value_imputation'").count() == 1
    weights = {r.label: r.weight for r in result.weights.collect()}
    assert weights == {0: pytest.approx(400 / (2 * 320)), 1: pytest.approx(400 / (2 * 80))}
    ready = result.prepared(result.test)
    assert ready.filter("label IS NULL").count() == 0
    assert ready.first().features.size == len(prepare.feature_names(result.prep))


def test_only_changed_columns_are_typed_again(spark, monkeypatch):
    rows = [(i, float(i % 97), ["red", "blue"][i % 2], [" ? ", "x ", "y"][i % 3], ["no", "yes"][i % 4 == 0]) for i in range(300)]
    table = spark.createDataFrame(rows, "id bigint, size double, _Mark_0 string, code string, churn string")
    typed, infer = [], workflow.infer_types

    def noted(df, *args, **named):
        typed.append(df.columns)
        return infer(df, *args, **named)

    monkeypatch.setattr(workflow, "infer_types", noted)
    found = workflow.transform(table, "churn")
    assert typed == [table.columns, ["code"]]
    expected = infer(normalize_missing(table), "churn")
    assert list(found.types) == list(expected) and found.types == expected
    assert found.types["code"].n_missing == 100
    typed.clear()
    gaps = table.withColumn("churn", F.expr("CASE WHEN id % 10 = 0 THEN ' N/A' ELSE churn END"))
    found = workflow.transform(gaps, "churn")
    assert typed == [table.columns, table.columns] and found.types["size"].n_rows == 270
    assert workflow.transform(table, "churn", config=workflow.Config(clean_first=True)).types == expected


def test_models_beat_the_majority(spark, result):
    report = workflow.train(result, names=[n for n in models.MODEL_ORDER if n != models.SVM])
    board = report.leaderboard(spark).collect()
    assert [r.f1_score for r in board] == sorted((r.f1_score for r in board), reverse=True)
    assert board[0].model == report.champion and board[0].accuracy > 0.9
    assert report.champion_frame(spark).first().rank == 1
    assert next(r for r in board if r.model == models.ONE_RULE).roc_auc is None
    assert report.confusion_frame(spark).groupBy("model").agg(F.sum("n").alias("n")).filter("n <> 100").count() == 0
    assert {r.param for r in report.params_frame(spark).filter("model = 'Decision Tree'").collect()} >= {"maxDepth", "impurity"}


def test_svm_of_three_classes(spark):
    rows = [(float(i % 3), [float(i % 3 == j) + (i % 7) / 50 for j in range(3)]) for i in range(90)]
    from pyspark.ml.functions import array_to_vector

    table = spark.createDataFrame(rows, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    fitted = models.train(models.SVM, models.training_table(table))
    assert fitted.predict(table).filter("label = prediction").count() == 90


def test_classes_of_an_svm_are_fitted_at_a_time_with_the_same_result(spark):
    from pyspark.ml.functions import array_to_vector

    rows = [(float(i % 3), [float(i % 3 == j) + (i % 7) / 50 for j in range(3)]) for i in range(90)]
    frame = spark.createDataFrame(rows, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    table = models.training_table(frame)
    together = models.estimator(models.SVM, {"C": 1.0}, table)
    assert together.getParallelism() >= 3
    alone = together.copy().setParallelism(1)
    for a, b in zip(together.fit(table.rows).models, alone.fit(table.rows).models, strict=True):
        assert a.coefficients.toArray() == pytest.approx(b.coefficients.toArray(), rel=1e-6)


def test_score_new_rows(people, result):
    table = models.training_table(result.prepared(result.train), result.plain_features)
    fitted = models.train(models.TREE, table)
    scored = workflow.score(result, fitted, people.drop("churn").limit(50))
    assert scored.count() == 50 and scored.filter("prediction IS NULL").count() == 0


@pytest.mark.parametrize("action", ["undersampling", "oversampling"])
def test_resampling(people, action):
    out = workflow.transform(people, "churn", decisions={"class_imbalance": action}, config=workflow.Config(keys=("id",)))
    sizes = {r.churn: r["count"] for r in out.train.unionByName(out.test).groupBy("churn").count().collect()}
    assert set(sizes.values()) == {100 if action == "undersampling" else 400}
    assert out.weights is None


def test_split_first_keeps_the_test_part_untouched(people):
    config = workflow.Config(keys=("id",), split_first=True, encoding=prepare.ORDINAL, scaling=prepare.MINMAX)
    out = workflow.transform(people, "churn", config=config)
    assert out.test.filter("age IS NULL").count() > 0
    assert out.prepared(out.test).count() == 100


def test_rows_without_target_are_dropped_and_logged(spark, people):
    holes = people.withColumn("churn", F.when(F.col("id") % 50 != 0, F.col("churn")))
    out = workflow.transform(holes, "churn")
    assert out.train.count() + out.test.count() == 490
    assert out.log[0]["action"] == workflow.STAGE_TARGET and out.log[0]["rows_removed"] == 10


def test_unknown_target(people):
    with pytest.raises(ValueError, match="nothing"):
        workflow.transform(people, "nothing")


def test_fit_round_trip(spark, result, tmp_path):
    result.prep.save(str(tmp_path / "prep"))
    loaded = prepare.FittedPrep.load(spark, str(tmp_path / "prep"))
    before = prepare.assemble(result.prep, result.test, ["spent"]).orderBy("spent").collect()
    assert prepare.assemble(loaded, result.test, ["spent"]).orderBy("spent").collect() == before


def test_model_round_trip(result, tmp_path):
    table = models.training_table(result.prepared(result.train), result.plain_features)
    fitted = models.train(models.TREE, table)
    path = str(tmp_path / "model")
    PipelineModel([fitted.model]).write().overwrite().save(path)
    test = result.prepared(result.test)
    again = PipelineModel.load(path).transform(test)
    assert [r.prediction for r in again.collect()] == [r.prediction for r in fitted.model.transform(test).collect()]


def test_csv_and_split_tables(spark, people, tmp_path):
    path = tables.write_csv(people, str(tmp_path / "people.csv"))
    assert tables.read_table(spark, path).dtypes == people.withColumn("id", F.col("id").cast("int")).dtypes
    written = workflow.ingest(people, str(tmp_path / "in"), 0.3)
    parts = spark.read.parquet(written["split"])
    assert parts.count() == 500 and 110 < parts.filter("split = 'test'").count() < 190
    assert tables.union_presplit(people.limit(3), people.limit(2)).count() == 5


def test_unknown_categories_are_all_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "c string")
    new = spark.createDataFrame([("a",), ("z",)], "c string")
    vectors = [r.features.toArray() for r in prepare.assemble(prepare.fit(train, [], ["c"]), new).collect()]
    assert sorted(v.astype(bool).sum() for v in vectors) == [0, 1]
    ordinal = prepare.with_codes(prepare.fit(train, [], ["c"], encoding=prepare.ORDINAL), new)
    assert {r.c: r.code_c for r in ordinal.collect()} == {"a": 0, "z": -1}


def test_search_is_repeatable(spark, result):
    table = models.training_table(result.prepared(result.train), result.plain_features)
    grid = {"impurity": ["gini"], "maxDepth": [1, 3]}
    best, tried = models.search(models.TREE, table, grid, "random")
    assert best["maxDepth"] in (1, 3) and len(tried) == 2
    assert models.search(models.TREE, table, grid, "random")[1] == tried


def test_a_text_column_is_cleaned_and_grouped_a_few_times_only(spark):
    """Balancing, splitting and fitting read what was written; cleaning goes by the ends of a text."""
    seen = spark.sparkContext.accumulator(0)

    def noted(text):
        seen.add(1)
        return text

    rows = 400
    df = spark.range(rows).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("target"), F.concat(F.lit(" text "), F.col("id") % 120).alias("raw"))
    df = df.withColumn("text", F.udf(noted, "string")("raw")).drop("raw")
    result = workflow.transform(df, "target", config=workflow.Config(keys=("id",), cardinality="group_rare_categories"))
    assert result.train.count() + result.test.count() == rows
    assert result.train.unionByName(result.test).filter("text = 'Other'").count() > 0
    assert seen.value <= 8 * rows


def test_white_space_inside_a_text_is_not_tried_as_its_end(spark):
    started = time.monotonic()
    text = "a" + " " * 200_000 + "b"
    row = normalize_missing(spark.createDataFrame([(text + " \n",)], "x string")).first()
    assert row["x"] == text
    assert time.monotonic() - started < 15


def test_texts_are_stripped_as_by_the_expression(spark):
    edges = ["", " ", "\t\n", "\x0b\f\r ", "\u00a0", "\x85", " \x85", "\u2028", "\r\n\u2029", " \u2028 "]
    texts = [a + x + b for a in edges for b in edges for x in ("", "x", "N/A", "x \u00e9\n y", "\u212a" * 7)] + [None, "MISSING ", "missing" * 5]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    by_expression = F.regexp_replace("x", r"^\s+|\s+$", "")
    assert df.filter(~F.expr("x").isNull() & (stripped(F.col("x")) != by_expression)).count() == 0
    wanted = df.select(F.when(~F.lower(by_expression).isin(*MISSING_MARKERS), by_expression).alias("x"))
    assert [r.x for r in normalize_missing(df).collect()] == [r.x for r in wanted.collect()]


# ---- the search of a run -----------------------------------------------------------------------------------------


def vectors(spark, rows, *names):
    """``label``, ``features`` of two numbers and further plain columns."""
    from pyspark.ml.functions import array_to_vector

    kinds = ", ".join(f"{n} double" for n in names)
    frame = spark.createDataFrame(rows, f"label double, x array<double>{', ' if kinds else ''}{kinds}")
    return frame.withColumn("features", array_to_vector("x")).drop("x")


def noisy(n, *more):
    draw = random.Random(3)
    points = [(draw.gauss(0, 1), draw.gauss(0, 1)) for _ in range(n)]
    return [(float(a - b + draw.gauss(0, 0.7) > 0), [a, b], *more) for a, b in points]


def test_a_run_scores_every_grid_on_its_folds_before_the_fit(spark, monkeypatch):
    """Also grids of one setting, as all that are given: the step was skipped for them."""
    fits, plain = [], models.fit
    monkeypatch.setattr(models, "fit", lambda name, *more: fits.append(name) or plain(name, *more))
    names = [n for n in models.MODEL_ORDER if n not in (models.FOREST, models.SVM)]
    rows = vectors(spark, [(*r, float(i % 3)) for i, r in enumerate(noisy(150))], "c")
    table = models.training_table(rows, ["c"])
    report = models.train_all(table, rows, names=names)
    for name in names:
        grid = models.SEARCH_GRIDS[name]
        tried = report.fitted[name].tried
        assert [p for p, _ in tried] == (models.combinations(grid) if grid else [])
        assert fits.count(name) == (6 if grid else 1)
        assert all(0.6 < score <= 1.0 for _, score in tried)
    assert report.champion_frame(spark).first().n_models == 5
    assert all(not f.tried for f in models.train_all(table, rows, "none", (models.TREE,)).fitted.values())


def test_scores_of_a_search_are_those_of_the_cross_validator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    table = models.training_table(vectors(spark, noisy(200)))
    grids = {models.TREE: {"maxDepth": [1, 5]}, models.LOGISTIC: {"C": [0.001, 1.0]}}
    folds = models.search_folds(table)
    assert folds.numbers == [0, 1, 2, 3, 4] and folds.rows.count() == 200
    part = models.replace(table, n_rows=160)
    for name, grid in grids.items():
        best, tried = models.search(name, table, grid, folds=folds)
        for params, score in tried:
            cv = CrossValidator(
                estimator=models.estimator(name, params, part, 5000), estimatorParamMaps=[{}],
                evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=5, foldCol="_fold",
            )
            assert score == pytest.approx(cv.fit(folds.rows).avgMetrics[0])
        assert best == max(tried, key=lambda t: t[1])[0]


def test_linear_models_of_a_search_converge_too(spark, monkeypatch):
    table = models.training_table(vectors(spark, noisy(200)))
    seen, plain = [], models.converged
    monkeypatch.setattr(models, "converged", lambda model: seen.append(plain(model)) or seen[-1])
    wanted = models.search(models.LOGISTIC, table, {"C": [1.0]})
    monkeypatch.setitem(models.FIRST_ITERATIONS, models.LOGISTIC, 1)
    assert models.search(models.LOGISTIC, table, {"C": [1.0]}) == wanted
    assert seen == [True] * 10


@pytest.mark.parametrize("classes", [2, 3])
def test_a_search_where_a_class_has_one_row(spark, classes):
    """One of the two folds is fitted without that class."""
    rows = [(float(i % (classes - 1)), [i % (classes - 1) + i / 100, 1.0 * (i % 5)]) for i in range(40)]
    table = models.training_table(vectors(spark, [*rows, (classes - 1.0, [9.0, 9.0])]))
    folds = models.search_folds(table)
    assert len(folds.numbers) == 2
    for name in (models.TREE, models.LOGISTIC, models.SVM):
        _, tried = models.search(name, table, models.SEARCH_GRIDS[name], folds=folds)
        assert 0.5 < tried[0][1] < 1.0, name


def test_a_table_of_one_row_per_class_is_fitted_without_scores(spark):
    table = models.training_table(vectors(spark, [(0.0, [0.0, 1.0]), (1.0, [1.0, 0.0])]))
    fitted = models.train(models.TREE, table)
    assert fitted.params == {"impurity": "gini", "maxDepth": 5} and fitted.tried[0][1] != fitted.tried[0][1]


def test_features_named_like_the_columns_of_the_folding(spark):
    names = ("fold", "part", "Fold2")
    table = models.training_table(vectors(spark, noisy(60, 7.0, 8.0, 9.0), *names), names)
    folds = models.search_folds(table)
    assert folds.rows.filter("fold = 7 AND part = 8 AND Fold2 = 9").count() == 60
    assert models.search(models.TREE, table, {"maxDepth": [2]}, folds=folds)[1][0][1] > 0.6


def test_scores_of_a_search_are_saved_with_the_model(spark, tmp_path):
    fitted = models.train(models.TREE, models.training_table(vectors(spark, noisy(60))))
    fitted.save(f"{tmp_path}/tree")
    assert fitted.tried and models.Fitted.load(spark, f"{tmp_path}/tree").tried == fitted.tried
