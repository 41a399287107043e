"""One-rule classifier: the label that is most frequent per value of the single best feature.

Ties go to the smallest label and then to the first feature; values not seen in training get the majority label.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import nan_to_null, quoted, slot_of, typed_key
from tabwright.functions.lookup import lookup
from tabwright.session import cut_lineage


def feature_errors(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``place, feature, errors``: training rows that the best rule on each feature gets wrong."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    rows = nan_to_null(df.select(quoted(label).alias("_label"), *[quoted(c) for c in features]))
    counted = None
    for slot in ("as_long", "as_double", "as_text"):
        own = {c: i for i, c in enumerate(features) if slot_of(fields[c]) == slot}
        if not own:
            continue
        keys = [typed_key(c, fields[c], digest=True).alias(str(i)) for c, i in own.items()]
        stacked = rows.select("_label", *keys).unpivot(["_label"], [str(i) for i in own.values()], "place", "value")
        part = stacked.groupBy("place", "value", "_label").agg(F.count("*").alias("n"))
        per_value = part.groupBy("place", "value").agg((F.sum("n") - F.max("n")).alias("errors"))
        per_value = per_value.select(F.col("place").cast("int").alias("place"), "errors")
        counted = per_value if counted is None else counted.unionByName(per_value)
    names = F.array(*[F.lit(c) for c in features])
    return counted.groupBy("place").agg(F.sum("errors").alias("errors")).select(
        "place", names[F.col("place")].alias("feature"), "errors"
    )


@dataclass
class OneRule:
    """A fitted rule: ``rules`` is ``value, prediction, n`` for ``feature``."""

    feature: str
    rules: DataFrame
    default: float

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        rules = self.rules.select(F.col("value").alias("_value"), F.col("prediction").alias(name), "n")
        matched = lookup(df.withColumn("_value", quoted(self.feature)), rules, ["_value"], "n").drop("_value")
        return matched.withColumn(name, F.coalesce(F.col(name), F.lit(self.default)))


def fit_one_rule(df: DataFrame, features: Sequence[str], label: str) -> OneRule:
    best = feature_errors(df, features, label).orderBy("errors", "place").first()["feature"]
    counted = (
        nan_to_null(df.select(quoted(best).alias("value"), quoted(label).cast("double").alias("label")))
        .groupBy("value", "label")
        .agg(F.count("*").alias("n"))
    )
    # The largest count wins, then the smallest label.
    rules = counted.groupBy("value").agg(
        F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("top"), F.sum("n").alias("n")
    )
    rules = cut_lineage(rules.select("value", (-F.col("top.minus")).alias("prediction"), "n"))
    majority = counted.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").first()
    return OneRule(best, rules, majority["label"])
