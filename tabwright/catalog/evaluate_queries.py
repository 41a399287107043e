"""Registered queries: evaluation on a fixed score over all line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog import inputs
from tabwright.catalog.profile_queries import with_source
from tabwright.operators import evaluate


def rounded(table, digits=6):
    return table.select(*[F.round(c, digits).alias(c) for c in table.columns])


def flag_confusion(spark, folder):
    return evaluate.confusion_matrix(inputs.scored(spark, folder), "flag_label", "flag_prediction")


QUERIES = {
    "confusion_matrix": flag_confusion,
    "metrics_binary": lambda s, d: rounded(evaluate.metrics(evaluate.confusion_matrix(inputs.scored(s, d)))),
    "metrics_multi": lambda s, d: rounded(evaluate.metrics(flag_confusion(s, d))),
    "roc_auc": lambda s, d: rounded(evaluate.roc_auc(inputs.scored(s, d))),
    "roc_curve": lambda s, d: rounded(evaluate.roc_curve(inputs.scored(s, d))),
    "roc_curve_auc": lambda s, d: rounded(evaluate.curve_area(evaluate.roc_curve(inputs.scored(s, d)))),
    "pr_curve": lambda s, d: rounded(evaluate.pr_curve(inputs.scored(s, d))),
    "average_precision": lambda s, d: rounded(evaluate.average_precision(inputs.scored(s, d))),
}

GRID = (
    "SELECT a.v::DOUBLE AS actual, b.v::DOUBLE AS predicted, (SELECT count(*) FROM s WHERE {label} = a.v AND {prediction} = b.v) AS n "
    "FROM (SELECT {label} AS v FROM s UNION SELECT {prediction} FROM s) a, (SELECT {label} AS v FROM s UNION SELECT {prediction} FROM s) b"
)
POINTS = (
    "SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n "
    "FROM (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY score)"
)


def scored_sql(body: str) -> str:
    return with_source("s", inputs.SCORED_SQL, body)


ORACLES = {
    "confusion_matrix": scored_sql(GRID.format(label="flag_label", prediction="flag_prediction")),
    "metrics_binary": scored_sql(
        "SELECT round(acc, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1_score FROM (SELECT avg((label = prediction)::INT) AS acc, "
        "count(*) FILTER (label = 1 AND prediction = 1) / count(*) FILTER (prediction = 1)::DOUBLE AS p, count(*) FILTER (label = 1 AND prediction = 1) / count(*) FILTER (label = 1)::DOUBLE AS r FROM s)"
    ),
    "metrics_multi": scored_sql(
        "SELECT round(sum(tp) / sum(n), 6) AS accuracy, round(sum(p * n) / sum(n), 6) AS precision, round(sum(r * n) / sum(n), 6) AS recall, "
        "round(sum(2 * p * r / (p + r) * n) / sum(n), 6) AS f1_score FROM (SELECT v, count(*) FILTER (flag_label = v AND flag_prediction = v)::DOUBLE AS tp, count(*) FILTER (flag_label = v) AS n, "
        "tp / count(*) FILTER (flag_prediction = v) AS p, tp / n AS r FROM s, (SELECT DISTINCT flag_label AS v FROM s) GROUP BY v)"
    ),
    "roc_auc": scored_sql(f"SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / any_value(p::DOUBLE * n), 6) AS roc_auc FROM ({POINTS})"),
    "roc_curve": scored_sql(
        f"SELECT round(score, 6) AS threshold, round(fp / n::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr FROM ({POINTS}) UNION ALL SELECT NULL, 0, 0"
    ),
    "roc_curve_auc": scored_sql(f"SELECT round(sum(neg * (tp + tp - pos) / 2.0::DOUBLE / n / p), 6) AS auc FROM ({POINTS})"),
    "pr_curve": scored_sql(
        f"SELECT round(score, 6) AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / p::DOUBLE, 6) AS recall FROM ({POINTS}) UNION ALL SELECT NULL, 1, 0"
    ),
    "average_precision": scored_sql(f"SELECT round(sum(pos / p::DOUBLE * tp / (tp + fp)), 6) AS average_precision FROM ({POINTS})"),
}
