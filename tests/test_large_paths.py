"""The ways taken for large tables, forced on small ones, against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.functions.lookup import lookup, repeated, salted, split_keys
from tabwright.functions.ordering import number_rows, replicate, running_sum
from tabwright.functions.quantiles import exact_quantiles
from tabwright.operators import balance, evaluate, knn, oner, split


def _skewed(n=3000):
    draw = random.Random(7)
    return [(draw.choice([5.0, draw.gauss(0, 1), draw.expovariate(0.01)]), draw.randint(0, 9) if i % 4 else None) for i in range(n)]


@pytest.mark.parametrize("bracket_rows", [1, 50, 10**6])
def test_quantiles_by_brackets(spark, bracket_rows):
    values = _skewed()
    rows = spark.createDataFrame(values, "x double, y int")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = exact_quantiles(rows, ["x", "y"], probs, direct_rows=0, bracket_rows=bracket_rows)
    assert found["x"] == pytest.approx(list(np.quantile([v[0] for v in values], probs)))
    assert found["y"] == pytest.approx(list(np.quantile([v[1] for v in values if v[1] is not None], probs)))
    assert exact_quantiles(rows, ["x", "y"], probs) == {c: pytest.approx(q) for c, q in found.items()}


def test_quantiles_of_nothing(spark):
    rows = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(rows, ["x"], [0.5], direct_rows=0) == {"x": [None]}
    assert exact_quantiles(rows, ["x"], [0.5]) == {"x": [None]}


@pytest.mark.parametrize("limit", [3, 10**6])
def test_running_sum(spark, limit):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    out = running_sum(rows, [F.desc("id")], {"total": F.col("v")}, limit)
    total, expected = 0, {}
    for i in reversed(range(1000)):
        total += i % 7
        expected[i] = total
    assert {r.id: r.total for r in out.collect()} == expected


def test_number_rows_over_partitions(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("x"))
    assert all(r.x == r.place for r in number_rows(rows, [F.col("x")], "place", 5).collect())


def test_replicate_in_chunks(spark, monkeypatch):
    monkeypatch.setattr("tabwright.functions.ordering.COPIES_PER_TASK_ROW", 10)
    rows = spark.createDataFrame([("a", 1), ("b", 0), ("c", 10), ("d", 57)], "k string, n bigint")
    counts = {r.k: r["count"] for r in replicate(rows, "n").groupBy("k").count().collect()}
    assert counts == {"a": 1, "c": 10, "d": 57}


@pytest.mark.parametrize("limit", [0, 10**9])
def test_lookup_with_hot_keys(spark, limit):
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 != 0, F.col("id") % 50)
    rows = spark.range(2000).select(key.alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 7").withColumn("v", F.col("k") * 10)
    out = lookup(rows, table, ["k"], "n", limit).collect()
    assert len(out) == 2000
    assert all(r.v == (None if r.k is None or r.k == 7 else r.k * 10) for r in out)


@pytest.mark.parametrize("most", [10**6, 2])
def test_no_task_gets_more_than_its_part_of_a_key(spark, most):
    """One key holds 60 % of the rows, a hundred have 100 each, the rest one each; some rows have none. AQE is off."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kind = F.when(F.col("id") % 10 < 6, F.lit("hot")).when(F.col("id") % 10 < 8, F.concat(F.lit("k"), F.col("id") % 100)).when(F.col("id") % 10 == 8, F.col("id").cast("string"))
        rows = spark.range(0, 20_000, 1, 16).select(kind.alias("k"), "id")
        table = rows.filter("k IS NOT NULL AND k <> 'k6'").groupBy("k").agg(F.count("*").alias("n"))
        parts = split_keys(rows, ["k"], 100, most)
        bound = 100 if most > 2 else 256  # 21 keys are over 100, one over 256: only that one may be split
        tasks = salted(rows, ["k"], parts).groupBy("k", "_part").count().filter("k IS NOT NULL")
        assert tasks.agg(F.max("count")).first()[0] <= 1.5 * bound
        assert parts.count() <= max(most, 21)
        joined = salted(rows, ["k"], parts).join(repeated(table, ["k"], parts), ["k", "_part"], "left")
        assert joined.count() == 20_000
        out = lookup(rows, table.withColumn("v", F.col("n") * 2), ["k"], "n", broadcast_bytes=0, key_rows=100)
        counts = {r.k: r.n for r in table.collect()}
        assert all(r.v == (2 * counts[r.k] if r.k in counts else None) for r in out.collect()) and out.count() == 20_000
        in_task = out.filter("k = 'hot'").groupBy(F.spark_partition_id()).count()
        assert in_task.agg(F.max("count")).first()[0] < 12_000 / 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lookup_of_keys_of_another_type(spark):
    rows = spark.range(2000).select((F.col("id") % 2).cast("double").alias("k"), "id")
    table = spark.createDataFrame([(0, 5, "a"), (1, 5, "b")], "k int, n bigint, v string")
    out = lookup(rows, table, ["k"], "n", broadcast_bytes=0, key_rows=100)
    assert {(r.k, r.v) for r in out.collect()} == {(0.0, "a"), (1.0, "b")} and out.count() == 2000


def test_split_with_copies_keeps_all_rows(spark):
    rows = spark.createDataFrame([("a", "same")] * 90 + [("a", f"x{i}") for i in range(10)] + [("b", "same")] * 5 + [("c", "one")], "t string, v string")
    out = split.stratified_split(rows, "t", 0.3)
    assert sorted((r.t, r.v) for r in out.collect()) == sorted((r.t, r.v) for r in rows.collect())
    tests = {r.t: r["count"] for r in out.filter("split = 'test'").groupBy("t").count().collect()}
    assert tests == {"a": 30, "b": 2}


def test_split_of_very_many_classes(spark, monkeypatch):
    monkeypatch.setattr(split, "fits_broadcast", lambda table: False)
    monkeypatch.setattr("tabwright.functions.ordering.fits_broadcast", lambda table: False)
    rows = spark.range(1000).select((F.col("id") % 50).alias("t"), "id")
    out = split.stratified_split(rows, "t", 0.25, keys=["id"])
    assert {r["count"] for r in out.filter("split = 'test'").groupBy("t").count().collect()} == {5}
    assert out.count() == 1000


def test_split_refuses_keys_that_repeat(spark):
    rows = spark.createDataFrame([("a", 1)] * 10, "t string, k int")
    with pytest.raises(ValueError, match="do not tell all rows apart"):
        split.stratified_split(rows, "t", 0.3, keys=["k"])


def test_rows_without_class_stay_in_train(spark):
    rows = spark.createDataFrame([(None, i) for i in range(5)] + [("a", i) for i in range(10)], "t string, k int")
    out = split.stratified_split(rows, "t", 0.2)
    assert out.filter("t IS NULL AND split = 'test'").count() == 0
    assert out.count() == 15


def test_folds_with_copies(spark):
    rows = spark.createDataFrame([("a", 1)] * 13 + [("b", 1)] * 2, "t string, v int")
    sizes = sorted((r.t, r.fold, r["count"]) for r in split.stratified_folds(rows, "t", 3).groupBy("t", "fold").count().collect())
    assert sizes == [("a", 0, 5), ("a", 1, 4), ("a", 2, 4), ("b", 0, 1), ("b", 1, 1)]


def test_oversampling_draws_copies_like_rows(spark, monkeypatch):
    rows = spark.createDataFrame([("small", "x")] * 6 + [("small", "y")] * 2 + [("big", "z")] * 500, "t string, v string")
    plain = sorted(tuple(r) for r in balance.oversample(rows, "t").collect())
    monkeypatch.setattr(balance, "POSITIONS_PER_TASK", 3)  # stretches cross position buckets
    assert sorted(tuple(r) for r in balance.oversample(rows, "t").collect()) == plain
    assert sum(t == "small" for t, _ in plain) == 500
    assert 0.15 < sum(v == "y" for _, v in plain) / 500 < 0.35


def test_undersampling_counts(spark):
    rows = spark.createDataFrame([("a", 1)] * 50 + [("b", 2)] * 7 + [("c", 3)] * 20, "t string, v int")
    counts = {r.t: r["count"] for r in balance.undersample(rows, "t").groupBy("t").count().collect()}
    assert counts == {"a": 7, "b": 7}


@pytest.mark.parametrize("limit", [2, 10**6])
def test_curves(spark, limit):
    draw = random.Random(3)
    pairs = [(draw.randint(0, 1), round(draw.random(), 2)) for _ in range(400)]
    rows = spark.createDataFrame(pairs, "label int, score double")
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    area = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(rows, single_task_rows=limit).first()[0] == pytest.approx(area)
    curve = evaluate.roc_curve(rows, single_task_rows=limit)
    assert evaluate.curve_area(curve, single_task_rows=limit).first()[0] == pytest.approx(area)
    assert curve.filter("fpr = 1 AND tpr = 1").count() == 1


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_neighbours_against_brute_force(spark, block_rows):
    draw = np.random.default_rng(5)
    points = np.round(draw.normal(size=(80, 3)), 1)
    points[20:50] = points[20]  # a hot point
    labels = draw.integers(0, 3, 80).astype(float)
    queries = np.vstack([np.round(draw.normal(size=(25, 3)), 1), points[20], points[20]])
    train = spark.createDataFrame([(p.tolist(), float(y)) for p, y in zip(points, labels, strict=True)], "features array<double>, label double")
    test = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "id int, features array<double>")
    found = {r.id: r.prediction for r in knn.predict_knn(train, test, k=5, block_rows=block_rows).collect()}
    for i, q in enumerate(queries):
        nearest = sorted(zip(((points - q) ** 2).sum(1), labels, strict=True))[:5]
        votes = [y for _, y in nearest]
        assert found[i] == min(set(votes), key=lambda y: (-votes.count(y), y))
    assert len(found) == len(queries)


def test_one_rule(spark):
    rows = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 0), ("b", 1.0, 1), ("b", 2.0, 1), ("c", 1.0, 1), ("c", 2.0, 0)], "f string, g double, label int")
    rule = oner.fit_one_rule(rows, ["g", "f"], "label")
    assert rule.feature == "f" and rule.default == 0.0
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "f string")
    assert {r.f: r.prediction for r in rule.predict(new).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0, "d": 0.0, None: 0.0}


@pytest.mark.parametrize(("shell_rows", "block_rows", "k"), [(5, 3, 5), (20, 4096, 1), (1000, 4096, 90), (5, 4096, 200)])
def test_pivot_index_against_brute_force(spark, shell_rows, block_rows, k):
    draw = np.random.default_rng(k)
    centres = draw.normal(scale=20, size=(6, 3))
    points = np.round(centres[draw.integers(0, 6, 150)] + draw.normal(size=(150, 3)), 1)
    points[:30] = points[0]
    labels = draw.integers(0, 3, 150).astype(float)
    queries = np.vstack([np.round(centres[draw.integers(0, 6, 30)] + draw.normal(size=(30, 3)), 1), points[0], [1e3, 1e3, 1e3]])
    train = spark.createDataFrame([(p.tolist(), float(y)) for p, y in zip(points, labels, strict=True)], "features array<double>, label double")
    test = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "id int, features array<double>")
    found = {r.id: (r.prediction, r.score) for r in knn.predict_knn(train, test, k=k, shell_rows=shell_rows, block_rows=block_rows).collect()}
    for i, q in enumerate(queries):
        votes = [y for _, y in sorted(zip(((points - q) ** 2).sum(1), labels, strict=True))[:k]]
        assert found[i] == (min(set(votes), key=lambda y: (-votes.count(y), y)), pytest.approx(votes.count(1.0) / len(votes)))
    assert len(found) == len(queries)


def test_a_query_looks_into_few_shells(spark):
    """Ten times the points, in ten times the shells: about as many shells and candidates per query."""
    draw = np.random.default_rng(8)
    centres = draw.normal(scale=50, size=(20, 2))

    def made(n):
        return centres[draw.integers(0, 20, n)] + draw.normal(size=(n, 2))

    queries = made(200)
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "qid bigint, x array<double>").cache()
    seen, candidates, shells = [], [], []
    for n in (2_000, 20_000):
        points = made(n)
        table = spark.createDataFrame([(p.tolist(), 0.0, 1) for p in points], "x array<double>, label double, copies bigint").cache()
        index, _ = knn.indexed(table, n, 40)
        kth = np.sort(((queries[:, None] - points[None]) ** 2).sum(2), axis=1)[:, 4]
        first = knn.visits_of(asked, index, 5).withColumn("within", F.element_at(F.array(*[F.lit(float(d)) for d in kth]), F.col("qid").cast("int") + 1))
        seen.append(knn.further_visits(first, index).count() / len(queries))
        candidates.append(knn.nearest_points(table, asked, 5, shell_rows=40).count() / len(queries))
        shells.append(len(index.cell))
    assert shells[1] > 7 * shells[0]
    assert seen[1] < 2 * seen[0] + 2 and candidates[1] < 3 * candidates[0], (seen, candidates, shells)
    assert seen[1] < 0.02 * shells[1]
