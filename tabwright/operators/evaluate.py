"""Evaluation of predictions: confusion matrix, classification metrics, ROC and precision-recall curves and areas.

Curves are grouped by score first, so equal scores become one point, and then use running totals over the distinct
scores. The areas are sums over the same totals and need no look at the neighbouring row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import quoted
from tabwright.functions.ordering import SINGLE_TASK_ROWS, number_rows, running_sum
from tabwright.session import cut_lineage


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``actual, predicted, n`` for the pairs of labels that occur together. A missing value is an error."""

    def given(column: str) -> Column:
        return F.coalesce(quoted(column).cast("double"), F.raise_error(F.lit(f"{column} is missing in a row to evaluate")))

    pairs = df.select(given(label).alias("actual"), given(prediction).alias("predicted"))
    return pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def with_zeros(counts: DataFrame) -> DataFrame:
    """The counts with a row for every pair of labels that occur: the square of their number.

    Labels are numbered, and each row of the matrix is spread over these numbers.
    """
    counts = cut_lineage(counts)
    seen = counts.select(F.explode(F.array("actual", "predicted")).alias("c")).distinct()
    numbered = number_rows(seen, [F.col("c")], "place")
    k = numbered.count()
    rows = numbered.select(F.col("c").alias("actual"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(k, 1) - 1).cast("bigint"))).alias("place"))
    grid = rows.join(numbered.withColumnRenamed("c", "predicted"), "place")
    found = grid.join(counts, ["actual", "predicted"], "left")
    return found.select("actual", "predicted", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``actual, predicted, n`` for every pair of labels that occur, zeros included; metrics need only `confusion_counts`."""
    return with_zeros(confusion_counts(df, label, prediction))


def metrics(confusion: DataFrame) -> DataFrame:
    """``accuracy, precision, recall, f1_score`` from a confusion matrix, with or without its zeros.

    With two actual classes the metrics are those of class 1; otherwise means weighted by class size. 0/0 counts as 0.
    """
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("actual").alias("c"), hit.alias("tp"), F.col("n").alias("support"), none.alias("called")),
        F.struct(F.col("predicted").alias("c"), none.alias("tp"), none.alias("support"), F.col("n").alias("called")),
    )
    per_class = confusion.select(F.inline(sides)).groupBy("c").agg(*[F.sum(x).alias(x) for x in ("tp", "support", "called")])

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    per_class = per_class.withColumns({"p": ratio(F.col("tp"), F.col("called")), "r": ratio(F.col("tp"), F.col("support"))})
    per_class = per_class.withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    binary = F.count_if(F.col("support") > 0) == 2

    def pick(x: str) -> Column:
        weighted = ratio(F.sum(F.col(x) * F.col("support")), F.sum("support"))
        return F.when(binary, F.coalesce(F.max(F.when(F.col("c") == 1, F.col(x))), F.lit(0.0))).otherwise(weighted)

    return per_class.agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        pick("p").alias("precision"),
        pick("r").alias("recall"),
        pick("f").alias("f1_score"),
    )


def score_totals(df: DataFrame, label: str, score: str, single_task_rows: int = SINGLE_TASK_ROWS) -> tuple[DataFrame, int, int]:
    """Per distinct score, from the highest down: positives and negatives there and so far; and both totals."""
    positive = (quoted(label).cast("double") == 1).cast("bigint")
    points = df.groupBy(quoted(score).cast("double").alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )
    totals = points.agg(F.sum("pos"), F.sum("neg")).first()
    running = running_sum(points, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, single_task_rows)
    return running, totals[0] or 0, totals[1] or 0


def _share(part: Column, whole: int) -> Column:
    return F.try_divide(part, F.lit(whole).cast("double"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """``threshold, fpr, tpr`` per distinct score, and the start (0, 0) with no threshold."""
    running, positives, negatives = score_totals(df, label, score, single_task_rows)
    start = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    points = running.select(
        F.col("score").alias("threshold"), _share(F.col("fp"), negatives).alias("fpr"), _share(F.col("tp"), positives).alias("tpr")
    )
    return start.unionByName(points)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """``roc_auc``: area under the ROC curve by trapezoids, which is the rank statistic with ties shared."""
    running, positives, negatives = score_totals(df, label, score, single_task_rows)
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2))
    return running.agg(F.try_divide(area, F.lit(float(positives) * float(negatives))).alias("roc_auc"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """``threshold, precision, recall`` per distinct score, and the end (1, 0) with no threshold."""
    running, positives, _ = score_totals(df, label, score, single_task_rows)
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    points = running.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _share(F.col("tp"), positives).alias("recall"),
    )
    return points.unionByName(end)


def average_precision(df: DataFrame, label: str = "label", score: str = "score", single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """``average_precision``: precision at each score weighted by the recall gained there."""
    running, positives, _ = score_totals(df, label, score, single_task_rows)
    gained = F.sum(F.col("pos") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    return running.agg(_share(gained, positives).alias("average_precision"))


def curve_area(curve: DataFrame, x: str = "fpr", y: str = "tpr", single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """``auc``: trapezoid area under the points of a rising curve, in order of x and then y.

    Points are numbered and joined with the one before, so a long curve is not ordered in one task.
    """
    points = number_rows(curve.select(F.col(x).alias("x"), F.col(y).alias("y")), [F.col("x"), F.col("y")], "place", single_task_rows)
    points = cut_lineage(points)
    previous = points.select((F.col("place") + 1).alias("place"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    step = (F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0")) / 2
    return points.join(previous, "place").agg(F.sum(step).alias("auc"))
