"""Seven classifiers, hyperparameter search, leaderboard and champion; k-means search by silhouette."""

from __future__ import annotations

import itertools
import json
import math
import random
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, classification
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    NaiveBayes,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tabwright.operators.balance import with_class_weights
from tabwright.operators.evaluate import confusion_counts, metrics, roc_auc, with_zeros
from tabwright.operators.knn import predict_knn
from tabwright.operators.oner import OneRule, fit_one_rule
from tabwright.operators.split import fold_count, stratified_folds
from tabwright.session import cut_lineage, gather_small

# Model names in their fixed order, search settings and default parameters, the same for tables of any size.
FOREST = "Random Forest"
TREE = "Decision Tree"
LOGISTIC = "Logistic Regression"
SVM = "Support Vector Machine"
NEIGHBOURS = "K-Nearest Neighbors"
BAYES = "Naive Bayes"
ONE_RULE = "OneR Classifier"
MODEL_ORDER = (FOREST, TREE, LOGISTIC, SVM, NEIGHBOURS, BAYES, ONE_RULE)
RANDOM_TRIES = 20
SEED = 42
SEARCH_GRIDS = {
    FOREST: {"numTrees": [16], "maxDepth": [5]},
    TREE: {"impurity": ["gini"], "maxDepth": [5]},
    LOGISTIC: {"C": [1.0]},
    SVM: {"C": [1.0]},
    NEIGHBOURS: {"k": [5]},
    BAYES: {},
    ONE_RULE: {},
}
WEIGHTED = (FOREST, TREE, LOGISTIC, SVM)
MOST_BINS = 256
TREE_BATCH_MEMORY_MB = 1024
#: A linear model that hasn't converged is fitted again with four times the iterations, up to this many.
FIRST_ITERATIONS = {LOGISTIC: 500, SVM: 100}
MOST_ITERATIONS = 200_000
#: The loss of the SVM has kinks, and steps get small long before they stop: it has converged when the loss falls by less than this share.
SVM_TOLERANCE = 1e-4

#: Classes of a one-vs-rest model that are fitted at a time: a step is a short job, and each fit holds a copy of the rows.
CLASSES_AT_A_TIME = 8

LEADERBOARD_SCHEMA = (
    "model string, accuracy double, precision double, recall double, f1_score double, roc_auc double, training_time double"
)


@dataclass
class Fitted:
    """A fitted model of any family: ``predict`` adds ``prediction`` and, where there is one, ``score``.

    ``tried`` has the settings of the search with their cross-validated accuracy.
    """

    name: str
    params: dict
    model: object = None
    train: DataFrame | None = None
    seconds: float = 0.0
    tried: list[tuple[dict, float]] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        if self.name == NEIGHBOURS:
            return predict_knn(self.train, df, k=self.params["k"])
        if isinstance(self.model, OneRule):
            return self.model.predict(df).withColumn("score", F.lit(None).cast("double"))
        out = self.model.transform(df)
        if "probability" in out.columns:
            score = _slot(out, "probability")
        elif "rawPrediction" in out.columns:
            score = _slot(out, "rawPrediction")
        else:
            score = F.lit(None).cast("double")
        return out.withColumn("score", score).drop("probability", "rawPrediction")


    def save(self, path: str) -> None:
        """Name, parameters and the model: MLlib's own form, a rule's table, or the training rows of the neighbours."""
        state = dict(name=self.name, params=self.params, seconds=self.seconds, kind=type(self.model).__name__, tried=self.tried)
        if self.name == NEIGHBOURS:
            spark = self.train.sparkSession
            self.train.write.mode("overwrite").parquet(f"{path}/rows")
        elif isinstance(self.model, OneRule):
            spark = self.model.rules.sparkSession
            self.model.rules.write.mode("overwrite").parquet(f"{path}/rules")
            state |= dict(feature=self.model.feature, default=self.model.default)
        else:
            spark = SparkSession.active()
            self.model.write().overwrite().save(f"{path}/model")
        write_state(spark, f"{path}/state", state)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        state = read_state(spark, f"{path}/state")
        tried = [(params, score) for params, score in state.get("tried", [])]
        fitted = Fitted(state["name"], state["params"], seconds=state["seconds"], tried=tried)
        if fitted.name == NEIGHBOURS:
            fitted.train = spark.read.parquet(f"{path}/rows")
        elif state["kind"] == OneRule.__name__:
            fitted.model = OneRule(state["feature"], spark.read.parquet(f"{path}/rules"), state["default"])
        else:
            fitted.model = getattr(classification, state["kind"]).load(f"{path}/model")
        return fitted


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    spark.createDataFrame([(json.dumps(state, default=str),)], "state string").coalesce(1).write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.json(path).first()["state"])


def _slot(df: DataFrame, column: str) -> Column:
    return F.try_element_at(vector_to_array(column), F.lit(2))


@dataclass
class TrainingTable:
    """Assembled rows (``features``, ``label``, plain feature columns) with the totals that the fits need."""

    rows: DataFrame
    n_rows: int
    n_classes: int
    smallest_class: int
    rule_features: list[str] = field(default_factory=list)
    weighted: bool = False
    keys: list[str] | None = None


def training_table(
    rows: DataFrame, rule_features: Sequence[str] = (), weighted: bool = False, keys: Sequence[str] | None = None
) -> TrainingTable:
    """``weighted`` adds balanced class weights as the column ``weight``.

    The assembled rows are written once; fits read them many times and would repeat lookups and encoding otherwise.
    """
    rows = cut_lineage(rows)
    row = rows.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*"), F.min("n")).first()
    if weighted:
        rows = with_class_weights(rows, "label")
    return TrainingTable(rows, row[0], row[1], row[2], list(rule_features), weighted, list(keys) if keys else None)


def estimator(name: str, params: Mapping, table: TrainingTable, iterations: int | None = None) -> Estimator:
    """The MLlib estimator of a model. A penalty strength C over summed losses is 1 / (C * rows) over mean losses."""
    iterations = iterations or FIRST_ITERATIONS.get(name)
    weight = {"weightCol": "weight"} if table.weighted and name in WEIGHTED else {}
    if name == FOREST:
        return RandomForestClassifier(
            numTrees=params["numTrees"], maxDepth=params["maxDepth"], maxBins=MOST_BINS, seed=SEED,
            maxMemoryInMB=TREE_BATCH_MEMORY_MB, **weight,
        )
    if name == TREE:
        return DecisionTreeClassifier(
            impurity=params.get("impurity", "gini"), maxDepth=params["maxDepth"], maxBins=MOST_BINS, seed=SEED,
            maxMemoryInMB=TREE_BATCH_MEMORY_MB, **weight,
        )
    penalty = 1.0 / (params.get("C", 1.0) * max(1, table.n_rows))
    if name == LOGISTIC:
        return LogisticRegression(regParam=penalty, elasticNetParam=0.0, maxIter=iterations, standardization=False, **weight)
    if name == SVM:
        svm = LinearSVC(regParam=penalty, maxIter=iterations, tol=SVM_TOLERANCE, standardization=False, **weight)
        return svm if table.n_classes <= 2 else OneVsRest(classifier=svm, parallelism=CLASSES_AT_A_TIME, **weight)
    if name == BAYES:
        return NaiveBayes(modelType="gaussian")
    raise ValueError(f"no estimator for {name}")


def combinations(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


@dataclass
class Folds:
    """Training rows with their ``_fold``, and the folds that have rows and leave some to train on."""

    rows: DataFrame
    numbers: list[int]


def search_folds(table: TrainingTable) -> Folds:
    """Stratified and repeatable folds of the training rows: written once, and cached until the caller lets them go."""
    columns = table.rows.columns
    named = {c: f"_column_{i}" for i, c in enumerate(columns)}  # a feature may have a name that the folding uses
    keys = [named[c] for c in table.keys] if table.keys else None
    dealt = stratified_folds(table.rows.toDF(*named.values()), named["label"], fold_count(table.smallest_class), SEED, keys)
    folds = cut_lineage(dealt.select(*named.values(), F.col("fold").cast("int")).toDF(*columns, "_fold"))
    sizes = folds.groupBy("_fold").agg(F.max("label").alias("last")).collect()
    # Fits know the classes from here, also those that only the held rows have.
    classes = max([2, *(int(r.last) + 1 for r in sizes)])
    rows = folds.withMetadata("label", {"ml_attr": {"type": "nominal", "num_vals": classes}})
    return Folds(gather_small(rows, table.n_rows).persist(), sorted(r["_fold"] for r in sizes) if len(sizes) > 1 else [])


def search(
    name: str,
    table: TrainingTable,
    grid: Mapping[str, Sequence],
    how: str = "grid",
    parallelism: int = 2,
    folds: Folds | None = None,
) -> tuple[dict, list[tuple[dict, float]]]:
    """Best parameters by cross-validated accuracy, and every setting tried with its score.

    ``random`` tries a seeded sample of at most twenty settings of the grid. ``folds`` are those of ``table`` where several
    searches share them; ``parallelism`` is the number of fits at a time. A table of one row per class can't be cut: the
    scores are NaN then, and the first setting is taken.
    """
    tried = combinations(grid)
    if how == "random" and len(tried) > RANDOM_TRIES:
        tried = random.Random(SEED).sample(tried, RANDOM_TRIES)
    held = folds or search_folds(table)
    k = fold_count(table.smallest_class)
    part = replace(table, n_rows=round(table.n_rows * (k - 1) / k))  # what a fold trains on; sets the penalty
    own_thread = inheritable_thread_target(table.rows.sparkSession)
    score = own_thread(lambda pair: _held_accuracy(name, part, pair[0], held.rows, pair[1]))
    pool = ThreadPool(parallelism)
    try:
        found = pool.map(score, list(itertools.product(tried, held.numbers)), chunksize=1)
    finally:
        pool.close()
        pool.join()
        if folds is None:
            held.rows.unpersist()
    n = len(held.numbers)
    scores = [sum(found[i * n : (i + 1) * n]) / n if n else math.nan for i in range(len(tried))]
    best = max(range(len(tried)), key=lambda i: scores[i])
    return tried[best], list(zip(tried, scores, strict=True))


def _held_accuracy(name: str, part: TrainingTable, params: Mapping, rows: DataFrame, held: int) -> float:
    """Accuracy on the rows of one fold of a model that is fitted on the other folds.

    Linear models may take all iterations at once: one that converges earlier is the same, and no fit is begun anew.
    """
    fitted = fit(name, replace(part, rows=rows.filter(F.col("_fold") != held)), params, MOST_ITERATIONS)
    right = F.coalesce(F.col("label") == F.col("prediction"), F.lit(False))
    return fitted.predict(rows.filter(F.col("_fold") == held)).agg(F.avg(right.cast("double"))).first()[0]


def fit(name: str, table: TrainingTable, params: Mapping | None = None, iterations: int | None = None) -> Fitted:
    params = dict(params if params is not None else combinations(SEARCH_GRIDS[name])[0])
    if name == NEIGHBOURS:
        return Fitted(name, params, train=table.rows)
    if name == ONE_RULE:
        if not table.rule_features:
            raise ValueError("one-rule needs the plain feature columns")
        return Fitted(name, params, fit_one_rule(table.rows, table.rule_features, "label"))
    rows, iterations = gather_small(table.rows, table.n_rows), iterations or FIRST_ITERATIONS.get(name)
    while True:
        model = estimator(name, params, table, iterations).fit(rows)
        if converged(model):
            return Fitted(name, params, model)
        iterations *= 4
        if iterations > MOST_ITERATIONS:
            raise RuntimeError(f"{name} has not converged after {iterations // 4} iterations")


def converged(model: object) -> bool:
    """Whether a linear model ended before its last allowed iteration; other models are always done."""
    parts = model.models if isinstance(model, OneVsRestModel) else [model]
    for part in parts:
        if isinstance(part, (LinearSVCModel, LogisticRegressionModel)):
            summary = part.summary() if callable(part.summary) else part.summary
            if summary.totalIterations >= part.getMaxIter():
                return False
    return True


def train(
    name: str, table: TrainingTable, how: str = "grid", grids: Mapping | None = None, folds: Folds | None = None
) -> Fitted:
    """Search the grid by cross-validation, also where it has one setting only, then fit on all training rows.

    Models without a grid are fitted as they are; ``how="none"`` takes the first setting.
    """
    started = time.monotonic()
    grid = (grids or SEARCH_GRIDS).get(name, {})
    params, tried = search(name, table, grid, how, folds=folds) if grid and how != "none" else (combinations(grid)[0], [])
    fitted = fit(name, table, params)
    fitted.seconds, fitted.tried = time.monotonic() - started, tried
    return fitted


def evaluate(fitted: Fitted, test: DataFrame) -> tuple[dict, DataFrame]:
    """Metrics of one model on prepared test rows, and the counts of its confusion matrix."""
    scored = fitted.predict(test).select("label", "prediction", "score").persist()
    try:
        counts = cut_lineage(confusion_counts(scored))
        found = metrics(counts).first().asDict()
        binary = counts.select("actual").distinct().limit(3).count() == 2
        has_score = binary and scored.filter("score IS NOT NULL").limit(1).count() > 0
        found["roc_auc"] = roc_auc(scored).first()[0] if has_score else None
    finally:
        scored.unpersist()
    return found, counts


@dataclass
class TrainingReport:
    """Fitted models with their metrics, and the pairs of labels that each confuses (zeros left out)."""

    fitted: dict[str, Fitted]
    metrics: dict[str, dict]
    confusion: dict[str, DataFrame]

    def leaderboard(self, spark) -> DataFrame:
        """One row per model, best F1 first."""
        rows = [
            (name, m["accuracy"], m["precision"], m["recall"], m["f1_score"], m["roc_auc"], self.fitted[name].seconds)
            for name, m in self.metrics.items()
        ]
        rows.sort(key=lambda r: -r[4])
        return spark.createDataFrame(rows, LEADERBOARD_SCHEMA)

    @property
    def champion(self) -> str:
        """Highest F1; the first in model order on ties."""
        return max(self.metrics, key=lambda name: self.metrics[name]["f1_score"])

    def champion_frame(self, spark) -> DataFrame:
        scores = sorted((m["f1_score"] for m in self.metrics.values()), reverse=True)
        best = self.metrics[self.champion]
        rank = scores.index(best["f1_score"]) + 1
        row = (self.champion, rank, len(scores), best["accuracy"], best["precision"], best["recall"], best["f1_score"], best["roc_auc"])
        return spark.createDataFrame(
            [row],
            "model string, rank int, n_models int, accuracy double, precision double, recall double, f1_score double, roc_auc double",
        )

    def confusion_frame(self, spark, zeros: bool = True) -> DataFrame:
        """``model, actual, predicted, n``; with ``zeros`` all pairs of the labels a model meets."""
        out = spark.createDataFrame([], "model string, actual double, predicted double, n bigint")
        for name, counts in self.confusion.items():
            out = out.union((with_zeros(counts) if zeros else counts).select(F.lit(name).alias("model"), "actual", "predicted", "n"))
        return out

    def save(self, path: str) -> None:
        """Every fitted model, the metrics, the confusion counts, and the leaderboard as a table to read."""
        spark = SparkSession.active()
        for place, (_, fitted) in enumerate(self.fitted.items()):
            fitted.save(f"{path}/model-{place}")
        write_state(spark, f"{path}/state", dict(models=list(self.fitted), metrics=self.metrics))
        self.confusion_frame(spark, zeros=False).write.mode("overwrite").parquet(f"{path}/confusion")
        self.leaderboard(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/leaderboard")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TrainingReport:
        state = read_state(spark, f"{path}/state")
        counts = spark.read.parquet(f"{path}/confusion")
        fitted = {name: Fitted.load(spark, f"{path}/model-{place}") for place, name in enumerate(state["models"])}
        confusion = {name: counts.filter(F.col("model") == name).drop("model") for name in fitted}
        return TrainingReport(fitted, {name: state["metrics"][name] for name in fitted}, confusion)

    def params_frame(self, spark) -> DataFrame:
        rows = [(name, key, str(value)) for name, f in self.fitted.items() for key, value in model_params(f).items()]
        return spark.createDataFrame(rows, "model string, param string, value string")


def model_params(fitted: Fitted) -> dict:
    """Parameters a model was really fitted with."""
    if hasattr(fitted.model, "extractParamMap"):
        return {p.name: v for p, v in fitted.model.extractParamMap().items() if p.name not in ("classifier", "models")}
    return dict(fitted.params) or {"rule": getattr(fitted.model, "feature", "")}


def train_all(
    table: TrainingTable,
    test: DataFrame,
    how: str = "grid",
    names: Sequence[str] = MODEL_ORDER,
    grids: Mapping | None = None,
) -> TrainingReport:
    """Search, fit and evaluate the models one after another on the same cached rows and the same folds."""
    rows, held = gather_small(table.rows, table.n_rows).persist(), gather_small(test, test.count()).persist()
    cached = TrainingTable(rows, table.n_rows, table.n_classes, table.smallest_class, table.rule_features, table.weighted, table.keys)
    report = TrainingReport({}, {}, {})
    searched = how != "none" and any((grids or SEARCH_GRIDS).get(name) for name in names)
    folds = None
    try:
        folds = search_folds(cached) if searched else None
        for name in names:
            fitted = train(name, cached, how, grids, folds)
            report.fitted[name] = fitted
            report.metrics[name], report.confusion[name] = evaluate(fitted, held)
    finally:
        rows.unpersist()
        held.unpersist()
        if folds is not None:
            folds.rows.unpersist()
    return report


def feature_importance(fitted: Fitted, names: DataFrame, top: int = 10) -> DataFrame:
    """``feature, importance`` of the most important features of a tree model; ``names`` is ``slot, feature``."""
    found = fitted.model.featureImportances  # an entry per slot that a tree splits on
    pairs = [(int(i), float(v)) for i, v in zip(found.indices, found.values, strict=True)]
    table = names.sparkSession.createDataFrame(pairs, "slot int, importance double")
    return names.join(F.broadcast(table), "slot").orderBy(F.desc("importance"), "feature").limit(top).select("feature", "importance")


def cluster_search(rows: DataFrame, ks: Sequence[int], features: str = "features", seed: int = SEED) -> DataFrame:
    """``k, clusters, silhouette, best`` for k-means over the given numbers of clusters; one cluster is no answer."""
    evaluator = ClusteringEvaluator(featuresCol=features)
    found = []
    cached = rows.persist()
    try:
        for k in ks:
            model = KMeans(k=k, seed=seed, featuresCol=features).fit(cached)
            clustered = model.transform(cached)
            n = clustered.select("prediction").distinct().count()
            if n > 1:
                found.append((k, n, evaluator.evaluate(clustered)))
    finally:
        cached.unpersist()
    best = max(found, key=lambda r: r[2])[0] if found else None
    spark = rows.sparkSession
    return spark.createDataFrame([(*r, r[0] == best) for r in found], "k int, clusters int, silhouette double, best boolean")
