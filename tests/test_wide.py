"""Many classes, many categories, models that need many iterations, and runs that are kept."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabwright.operators import bayes, evaluate, models, prepare, quality, repair
from tabwright.operators import feature_types as ft
from tabwright.plans import workflow


# ---- confusion and Bayes -----------------------------------------------------------------------------------------


def test_metrics_of_a_hundred_thousand_classes(spark):
    rows = spark.range(200_000).select((F.col("id") % 100_000).cast("double").alias("label"), F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("id") % 100_000).cast("double").alias("prediction"))
    counts = evaluate.confusion_counts(rows)
    assert counts.count() == 75_000 + 25_000
    found = evaluate.metrics(counts).first()
    # Each class has two rows; those divisible by four are called class 0.
    assert found.accuracy == pytest.approx(0.75 + 0.00001) and found.recall == pytest.approx(0.75 + 0.00001)
    assert found.precision == pytest.approx(0.75 + 2 / 50_000 * 0.00001, abs=1e-6)


def test_zeros_only_on_request(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (1.0, 1.0)], "label double, prediction double")
    sparse = {tuple(r) for r in evaluate.confusion_counts(rows).collect()}
    full = {tuple(r) for r in evaluate.confusion_matrix(rows).collect()}
    assert sparse == {(0, 0, 1), (1, 2, 1), (1, 1, 1)}
    assert full == sparse | {(a, b, 0) for a in range(3) for b in range(3) if (a, b) not in {(0, 0), (1, 2), (1, 1)}}
    assert evaluate.metrics(evaluate.confusion_counts(rows)).first() == evaluate.metrics(evaluate.confusion_matrix(rows)).first()
    assert evaluate.confusion_matrix(rows.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [10**6, 2000])
def test_bayes_in_groups_of_classes(spark, limit):
    draw = np.random.default_rng(2)
    y = draw.integers(0, 25, 600)
    x = draw.normal(size=(600, 3)) + y[:, None] * [0.5, 0.0, -0.3]
    x[::50, 1] = np.nan
    rows = spark.createDataFrame([(float(c), *map(float, v)) for c, v in zip(y, x, strict=True)], "y double, a double, b double, c double")
    rows = rows.withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    fitted = bayes.fit_gaussian(rows, ["a", "b", "c"], "y")
    variance = np.nanvar(x, axis=0).max() * bayes.SMOOTHING
    for r in fitted.collect():
        own = x[y == r.label]
        assert r.n == len(own) and r.prior == pytest.approx(len(own) / 600)
        assert r.means == pytest.approx(list(np.nanmean(own, axis=0))) and r.variances == pytest.approx(list(np.nanvar(own, axis=0) + variance))
    new = rows.filter("b IS NOT NULL").limit(50)
    got = [(r.a, r.prediction) for r in bayes.predict_gaussian(new, ["a", "b", "c"], fitted, broadcast_bytes=limit).collect()]
    params = {r.label: (r.prior, np.array(r.means), np.array(r.variances)) for r in fitted.collect()}
    for r in new.collect():
        v = np.array([r.a, r.b, r.c])
        score = {c: np.log(p) - (0.5 * np.log(2 * np.pi * s) + (v - m) ** 2 / (2 * s)).sum() for c, (p, m, s) in params.items()}
        assert dict(got)[r.a] == max(score, key=lambda c: (score[c], -c))
    wide = bayes.predict_gaussian(new, ["a", "b", "c"], fitted)._jdf.queryExecution().toString()
    assert len(wide) < 20_000  # not a term per class and feature


# ---- columns with many categories --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def notes(spark):
    """600 rows: a long text that is often the same, a code with many values, a number, two classes."""
    rows = []
    for i in range(600):
        text = f"note {i % 7} " + "long " * 30 if i % 3 else f"own note {i // 2} " + "words " * 30
        rows.append((i, text, f"c{i % 120:03d}", float(i % 50), "yes" if i % 5 == 0 else "no"))
    return spark.createDataFrame(rows, "id bigint, text string, code string, x double, churn string")


def test_cardinality_is_left_alone_unless_asked(notes):
    issues = quality.detect_all(notes, "churn")
    wide = {i["column"] for i in issues if i["type"] == quality.CARDINALITY}
    assert wide == {"text", "code"}
    assert {r["choice"] for r in repair.resolve_decisions(issues, {"high_cardinality_code": "drop_feature"}) if r["column"] in wide} == {"ignored"}
    resolved = repair.resolve_decisions(issues, {"high_cardinality_code": "drop_feature"}, repair.GROUP_RARE)
    assert {r["column"]: r["choice"] for r in resolved if r["column"] in wide} == {"text": repair.GROUP_RARE, "code": repair.DROP_WIDE}
    with pytest.raises(ValueError, match="no way"):
        repair.resolve_decisions(issues, {}, "shorten")


def test_rare_categories_are_grouped_and_logged(notes):
    types = ft.infer_types(notes, "churn")
    out, log = repair.handle_cardinality(notes, {"text": repair.GROUP_RARE, "code": repair.DROP_WIDE}, types, top=7)
    values = [r.text for r in out.select("text").collect()]
    assert len(set(values)) == 8 and values.count("Other") == 200
    assert "code" not in out.columns and out.count() == 600
    assert [(e["column"], e["detail_action"], e["values_imputed"]) for e in log] == [("text", repair.GROUP_RARE, 200), ("code", repair.DROP_WIDE, None)]


@pytest.mark.parametrize("split_first", [False, True])
def test_new_texts_belong_to_the_rare_ones(spark, notes, split_first):
    config = workflow.Config(keys=("id",), cardinality=repair.GROUP_RARE, split_first=split_first)
    result = workflow.transform(notes, "churn", decisions={"high_cardinality_code": "drop_feature"}, config=config)
    assert "code" not in result.train.columns and result.prep.sizes["text"] <= repair.KEPT_CATEGORIES + 1
    assert {e["action"] for e in result.log} >= {repair.STAGE_CARDINALITY}
    fitted = models.train(models.TREE, models.training_table(result.prepared(result.train), result.plain_features))
    new = notes.limit(2).drop("churn").withColumn("text", F.lit("never seen before"))
    code = result.prep.others["text"][0]
    assert {r.code_text for r in prepare.with_codes(result.prep, new.withColumn("x", F.lit(1.0)), ["text"]).collect()} == {code}
    assert workflow.score(result, fitted, new).filter("prediction IS NULL").count() == 0


def test_vectors_of_slots_are_those_of_the_encoders(spark):
    train = spark.createDataFrame([("b", 1, 1.0), ("a", 10, 2.0), ("a", 2, None), ("c", 2, 9.0)], "t string, k int, x double")
    prep = prepare.fit(train, ["x"], ["t", "k"])
    names = {r.slot: r.feature for r in prepare.feature_table(spark, prep).collect()}
    assert [names[i] for i in range(7)] == ["x", "t=a", "t=b", "t=c", "k=1", "k=2", "k=10"] == prepare.feature_names(prep)
    new = spark.createDataFrame([("a", 10, 2.0), ("z", 2, None)], "t string, k int, x double")
    rows = prepare.assemble(prep, new, ["t"]).select("t", vector_to_array("features").alias("v"), "features").collect()
    scale = {1: 1 / np.sqrt(0.25), 5: 1 / np.sqrt(0.25), 6: 1 / np.sqrt(3 / 16)}
    values = {r.t: r.v for r in rows}
    assert values["a"] == pytest.approx([-1.5 / np.sqrt(10.25), scale[1], 0, 0, 0, 0, scale[6]])
    assert values["z"] == pytest.approx([-1.5 / np.sqrt(10.25), 0, 0, 0, 0, scale[5], 0])
    assert all(r.features.size == 7 for r in rows)


def test_vectors_may_be_wide_without_a_number_per_slot(spark):
    train = spark.range(30_000).select(F.concat(F.lit("v"), "id").alias("t"))
    vectors = prepare.assemble(prepare.fit(train, [], ["t"]), train.limit(5)).collect()
    assert all(r.features.size == 30_000 and len(r.features.indices) == 1 for r in vectors)


# ---- models that need many iterations ----------------------------------------------------------------------------


def test_linear_models_are_fitted_until_they_converge(spark, monkeypatch):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + draw.normal(size=300) > 0).astype(float)
    table = spark.createDataFrame([(float(c), v.tolist()) for c, v in zip(y, x, strict=True)], "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    monkeypatch.setitem(models.FIRST_ITERATIONS, models.LOGISTIC, 2)
    fitted = models.fit(models.LOGISTIC, models.training_table(table))
    assert models.converged(fitted.model) and fitted.model.getMaxIter() > 2
    monkeypatch.setattr(models, "MOST_ITERATIONS", 2)
    with pytest.raises(RuntimeError, match="has not converged"):
        models.fit(models.LOGISTIC, models.training_table(table))


# ---- runs that are kept ------------------------------------------------------------------------------------------


def test_a_run_is_saved_whole_and_again(spark, notes, tmp_path):
    names = (models.TREE, models.ONE_RULE)
    result, report = workflow.run(notes, "churn", config=workflow.Config(keys=("id",), cardinality=repair.GROUP_RARE), names=names)
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    workflow.save_run(first, result, report)
    workflow.save_run(second, *workflow.load_run(spark, first))
    again, told = workflow.load_run(spark, second)
    assert told.leaderboard(spark).collect() == report.leaderboard(spark).collect() and told.champion == report.champion
    assert sorted(told.confusion_frame(spark).collect()) == sorted(report.confusion_frame(spark).collect())
    assert sorted(again.weights.collect()) == sorted(result.weights.collect()) and again.log == result.log
    new = notes.drop("churn")
    for name in names:
        before = sorted((r.x, r.prediction) for r in workflow.score(result, report.fitted[name], new).collect())
        assert sorted((r.x, r.prediction) for r in workflow.score(again, told.fitted[name], new).collect()) == before
