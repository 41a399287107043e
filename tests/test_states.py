"""Column states: merged over any number of partitions they give counts, moments, distinct values and smallest texts."""

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import feature_types as ft
from tabwright.operators import profile, quality, states


def test_estimates_from_few_to_many():
    draw = np.random.default_rng(1)
    for n in (0, 1, 10, 3_000, 12_000, 40_000, 300_000):
        registers = np.zeros(states.REGISTERS, np.uint8)
        for part in np.array_split(draw.integers(-(2**63), 2**63 - 1, n), 3):
            states.registered(registers, part)
        assert abs(states.estimated(registers) - n) <= max(0.5, states.SURE * states.ERROR * n)


@pytest.mark.parametrize("partitions", [1, 7])
def test_states_of_a_table(spark, monkeypatch, partitions):
    monkeypatch.setattr(states, "FAN_IN", 2)
    draw = random.Random(4)
    made = [
        (draw.choice([None, i % 5]), draw.choice([None, float("nan"), draw.gauss(3, 2), 0.0, -0.0]), Decimal(i % 7) / 10, draw.choice(["b", "", "é", "z" * 99, None, "a"]), i % 3 == 0, i)
        for i in range(5000)
    ]
    rows = spark.createDataFrame(made, "w int, x double, d decimal(10, 1), t string, b boolean, id bigint").repartition(partitions)
    found = states.column_states(rows, examples=["t"], wanted=3)
    x = [r[1] for r in made if r[1] is not None and not math.isnan(r[1])]
    assert (found["x"].present, found["x"].n, found["x"].missing) == (len(x), 5000, 5000 - len(x))
    assert found["x"].moments["mean"] == pytest.approx(np.mean(x)) and found["x"].moments["std"] == pytest.approx(np.std(x, ddof=1))
    assert (found["x"].moments["min"], found["x"].moments["max"]) == (min(x), max(x))
    texts = [r[3] for r in made if r[3] is not None]
    assert found["t"].smallest == ["", "a", "b"] and (found["t"].n_values, found["t"].exact) == (5, True)
    assert found["t"].top_count == max(texts.count(t) for t in set(texts)) and found["t"].least_count == min(texts.count(t) for t in set(texts))
    assert found["w"].n_values == 5 and found["d"].n_values == 7 and found["b"].n_values == 2
    fewest, most = found["id"].bounds()
    assert not found["id"].exact and fewest <= 5000 <= most
    tops = states.top_values(rows, {c: found[c].top_hash for c in ("w", "d", "t", "b")})
    for place, c in ((0, "w"), (2, "d"), (3, "t"), (4, "b")):
        values = [r[place] for r in made if r[place] is not None]
        assert values.count(tops[c]) == found[c].top_count


def test_states_of_no_rows_and_of_missing_values(spark):
    empty = spark.createDataFrame([], "a int, t string")
    found = states.column_states(empty, examples=["t"])
    assert (found["a"].n, found["t"].n_values, found["t"].smallest) == (0, 0, [])
    gaps = spark.createDataFrame([(None, None)] * 3, "a int, t string")
    found = states.column_states(gaps, examples=["t"])
    assert (found["a"].n, found["a"].present, found["a"].n_values, found["a"].moments["mean"]) == (3, 0, 0, None)
    assert ft.infer_types(empty)["t"].n_rows == 0


def many_valued(spark):
    """Columns with more values than a state counts: near-unique, half unique, near-constant with many rare values."""
    rows = spark.range(0, 30_000, 1, 3)
    return rows.select(
        "id", F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("h"), F.floor(F.col("id") / 3)).alias("half"), (F.col("id") / 7.0).alias("x"),
        F.when(F.col("id") % 8 == 0, F.col("id").cast("string")).otherwise(F.lit("same")).alias("rare"),
        F.floor(F.col("id") * F.lit(0.95) + F.lit(0.5)).alias("edge"), (F.col("id") % 3).cast("int").alias("target"),
    )


def test_estimates_decide_only_what_is_sure(spark):
    rows = many_valued(spark)
    exact, sure = ft.infer_types(rows, "target", exact=True), ft.infer_types(rows, "target")
    assert {c: t.type for c, t in exact.items()} == {c: t.type for c, t in sure.items()}
    assert all(t.counted for t in exact.values()) and exact["edge"].n_unique == rows.select("edge").distinct().count()
    assert not sure["x"].counted and not sure["key"].counted
    assert sure["half"].counted and sure["half"].n_unique == 10_000  # its number is reported
    assert sure["edge"].counted  # on the edge between types
    assert {i["issue_id"]: i["unique_values"] for i in quality.detect_cardinality(sure)} == {"high_cardinality_half": 10_000, "high_cardinality_rare": 3751}


def test_a_value_beside_many_rare_ones_is_found(spark):
    rows = spark.range(400_000).select(F.when(F.col("id") % 150 == 0, F.col("id")).otherwise(F.lit(-1)).alias("v"), F.lit("c").alias("k"))
    types = ft.infer_types(rows)
    found = {i["column"]: (i["top_value"], i["unique_values"]) for i in quality.detect_constants(rows, types)}
    assert found == {"v": ("-1", 2668), "k": ("c", 1)}


def test_issues_read_the_table_four_times(spark):
    """Documents with gaps, outliers and constant columns: states, quartiles, outliers, names of constants."""
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    n = 3000
    rows = spark.range(n).selectExpr("id", "CASE WHEN id % 9 = 0 THEN NULL ELSE id % 1000 END AS v", "IF(id % 500 = 0, 10000, id % 40) AS far", "'c' AS k", "IF(id % 5 = 0, 'x', 'y') AS target", "concat('t', id) AS text")
    rows = rows.mapInArrow(counting, rows.schema)
    issues = quality.detect_all(rows, "target")
    assert {i["type"] for i in issues} >= {quality.MISSING, quality.CONSTANT, quality.IMBALANCE, quality.OUTLIERS}
    assert read.value <= 4 * n


def test_the_profile_is_the_same_from_states(spark):
    rows = many_valued(spark).limit(2000).cache()
    known = states.column_states(rows)
    assert profile.basic_stats(rows, known).collect() == profile.basic_stats(rows).collect()
    assert profile.missing_by_column(rows, known).collect() == profile.missing_by_column(rows).collect()
    assert profile.summary_stats(rows, states=known).collect() == profile.summary_stats(rows).collect()
    assert sorted(profile.correlation_matrix(rows, states=known).collect()) == sorted(profile.correlation_matrix(rows).collect())


def test_long_texts_are_spread_as_digests(spark, monkeypatch):
    seen = []
    spread = ft.spread_small
    monkeypatch.setattr(ft, "spread_small", lambda df, n_rows: seen.append(df) or spread(df, n_rows))
    monkeypatch.setattr(states, "EXACT_VALUES", 50)
    texts = [(None if i % 10 == 0 else "é" * 3000 + str(i % 100) if i % 2 else str(i % 30),) for i in range(400)]
    rows = spark.createDataFrame(texts, "note string")
    note = ft.infer_types(rows, exact=True)["note"]
    present = [t for (t,) in texts if t is not None]
    assert (note.type, note.n_unique, note.n_missing) == (ft.TEXT, len(set(present)), 40)
    assert note.top_count == max(present.count(t) for t in present)
    assert max(r.n or 0 for r in seen[0].select(F.octet_length("note").alias("n")).collect()) < 100
