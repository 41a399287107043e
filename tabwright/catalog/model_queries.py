"""Registered queries: classifiers, search, leaderboard, clustering."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabwright.catalog import inputs
from tabwright.catalog.profile_queries import union_all, with_source
from tabwright.operators import bayes, knn, models, oner, prepare
from tabwright.plans import workflow
from tabwright.session import own_folder

LABEL = "CASE WHEN l_extendedprice > 53000 THEN 1 ELSE 0 END"
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUMERIC = ["l_quantity", "l_step"]
CATEGORICAL = ["l_returnflag", "l_linestatus", "l_linenumber"]
BAYES_FEATURES = ["l_quantity", "l_discount", "l_step", "l_suppkey"]
RULE_FEATURES = ["l_discount", "l_returnflag", "l_linenumber", "l_quantity"]


def labelled(spark, folder):
    train, test = (f(spark, folder).withColumn("label", F.expr(LABEL).cast("double")) for f in (inputs.train_lines, inputs.test_lines))
    return train, test


def prepared(spark, folder):
    """Line items prepared for a two-class label; whole table."""
    train, test = labelled(spark, folder)
    prep = prepare.fit(train, NUMERIC, CATEGORICAL)
    plain = [*NUMERIC, *CATEGORICAL]
    table = models.training_table(prepare.assemble(prep, train, ["label", *plain]), plain, weighted=True)
    return prep, table, prepare.assemble(prep, test, ["label", *plain])


def one_model(name):
    """Confusion counts of one classifier on the test part; a fit of its one setting, without a search."""

    def query(spark, folder):
        _, table, test = prepared(spark, folder)
        fitted = models.train(name, table, how="none")
        scored = fitted.predict(test)
        return scored.groupBy("label", "prediction").agg(F.count("*").alias("n"))

    return query


def multi_svm(spark, folder):
    """One-vs-rest on ten classes of embeddings."""
    train, test = embeddings(spark, folder)
    to_vector = F.expr("transform(embedding, x -> cast(x as double))")
    frames = [f.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(to_vector).alias("features")) for f in (train, test)]
    fitted = models.train(models.SVM, models.training_table(frames[0]), how="none")
    return fitted.predict(frames[1]).select("vec_id", "label", "prediction")


def embeddings(spark, folder):
    table = inputs.table(spark, folder, "embeddings")
    return table.filter("vec_id % 5 <> 0"), table.filter("vec_id % 5 = 0")


def knn_predict(spark, folder):
    train, test = embeddings(spark, folder)
    out = knn.predict_knn(train, test, "embedding", "label", 5)
    return out.select("vec_id", F.col("prediction").cast("int").alias("prediction"))


def gnb_params(spark, folder):
    train, _ = labelled(spark, folder)
    table = bayes.params_frame(BAYES_FEATURES, bayes.fit_gaussian(train, BAYES_FEATURES, "label"))
    return table.select("label", "feature", *[F.round(c, 5).alias(c) for c in ("prior", "mean", "variance")])


def gnb_predict(spark, folder):
    train, test = labelled(spark, folder)
    out = bayes.predict_gaussian(test, BAYES_FEATURES, bayes.fit_gaussian(train, BAYES_FEATURES, "label"))
    return out.select(*ROW, "prediction")


def oner_errors(spark, folder):
    return oner.feature_errors(labelled(spark, folder)[0], RULE_FEATURES, "label")


def oner_rules(spark, folder):
    rule = oner.fit_one_rule(labelled(spark, folder)[0], RULE_FEATURES, "label")
    return rule.rules.select(F.lit(rule.feature).alias("feature"), F.col("value").cast("double").alias("value"), "prediction", "n")


def oner_predict(spark, folder):
    train, test = labelled(spark, folder)
    rule = oner.fit_one_rule(train.filter("l_quantity <> 13"), RULE_FEATURES, "label")
    return rule.predict(test).select(*ROW, "prediction")


#: Texts with many different values keep the most frequent ones as categories.
WITH_TEXT = workflow.Config(cardinality="group_rare_categories")


def labelled_docs(spark, folder):
    return inputs.docs(spark, folder).filter("quality IS NOT NULL").drop("toxic")


def search_lr(spark, folder):
    """Cross-validated accuracy of two penalties on the labelled documents."""
    result = workflow.transform(labelled_docs(spark, folder), "quality", config=WITH_TEXT)
    table = models.training_table(result.prepared(result.train), result.plain_features)
    _, tried = models.search(models.LOGISTIC, table, {"C": [0.01, 1.0]}, parallelism=4)
    return spark.createDataFrame([(p["C"], round(v, 4)) for p, v in tried], "c double, accuracy double")


def docs_report(spark, folder, names=models.MODEL_ORDER):
    """Full run on the labelled documents: from the raw table to fitted models."""
    return workflow.run(labelled_docs(spark, folder), "quality", config=WITH_TEXT, names=names)


def leaderboard(spark, folder):
    return docs_report(spark, folder)[1].leaderboard(spark)


def champion(spark, folder):
    return docs_report(spark, folder)[1].champion_frame(spark)


def confusion_by_model(spark, folder):
    return docs_report(spark, folder)[1].confusion_frame(spark)


def model_params(spark, folder):
    return docs_report(spark, folder, (models.TREE, models.LOGISTIC, models.ONE_RULE))[1].params_frame(spark)


def feature_importance(spark, folder):
    prep, table, _ = prepared(spark, folder)
    fitted = models.train(models.FOREST, table, how="none")
    return models.feature_importance(fitted, prepare.feature_table(spark, prep))


def score_table(spark, folder):
    result, report = docs_report(spark, folder, (models.TREE,))
    return scored_docs(spark, folder, result, report)


def scored_docs(spark, folder, result, report):
    unlabelled = inputs.docs(spark, folder).filter("quality IS NULL").drop("toxic", "quality")
    scored = workflow.score(result, report.fitted[models.TREE], unlabelled)
    return scored.select("lang", "source", "prediction", "score")


def score_saved(spark, folder):
    """As ``score_table``, by a run that was saved, loaded, saved again and loaded."""
    first, second = own_folder(spark, "run"), own_folder(spark, "run")
    workflow.save_run(first, *docs_report(spark, folder, (models.TREE,)))
    workflow.save_run(second, *workflow.load_run(spark, first))
    return scored_docs(spark, folder, *workflow.load_run(spark, second))


def cluster_search(spark, folder):
    table = inputs.table(spark, folder, "embeddings")
    return models.cluster_search(table.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), [2, 5, 10])


QUERIES = {
    "knn_predict": knn_predict,
    "gnb_params": gnb_params,
    "gnb_predict": gnb_predict,
    "oner_errors": oner_errors,
    "oner_rules": oner_rules,
    "oner_predict": oner_predict,
    "model_rf": one_model(models.FOREST),
    "model_dt": one_model(models.TREE),
    "model_lr": one_model(models.LOGISTIC),
    "model_svc": one_model(models.SVM),
    "model_svc_multi": multi_svm,
    "model_nb": one_model(models.BAYES),
    "search_lr": search_lr,
    "leaderboard": leaderboard,
    "champion": champion,
    "confusion_by_model": confusion_by_model,
    "model_params": model_params,
    "feature_importance": feature_importance,
    "score_table": score_table,
    "score_saved": score_saved,
    "cluster_search": cluster_search,
}

TRAIN = f"{inputs.LINE_SQL}), tr AS (SELECT *, {LABEL} AS label FROM t WHERE {inputs.IS_TRAIN}), te AS (SELECT * FROM t WHERE {inputs.IS_TEST}"
ROWS = ", ".join(ROW)


def lines_sql(body: str) -> str:
    return with_source("t", TRAIN, body)


EXTRA = "(SELECT 1e-9::DOUBLE * greatest(" + ", ".join(f"var_pop({c})" for c in BAYES_FEATURES) + ") FROM tr)"
BAYES_LONG = union_all([
    f"SELECT label, '{c}' AS feature, count(*) / (SELECT count(*) FROM tr)::DOUBLE AS prior, avg({c}::DOUBLE) AS mean, var_pop({c}::DOUBLE) + {EXTRA} AS variance FROM tr GROUP BY label"
    for c in BAYES_FEATURES
])
BAYES_WIDE = "SELECT label, ln(count(*) / (SELECT count(*) FROM tr)::DOUBLE) AS lp, " + ", ".join(
    f"avg({c}::DOUBLE) AS m_{c}, var_pop({c}::DOUBLE) + {EXTRA} AS v_{c}" for c in BAYES_FEATURES
) + " FROM tr GROUP BY label"
LIKELIHOOD = "lp " + " ".join(f"- 0.5::DOUBLE * ln(2 * pi() * v_{c}) - ({c} - m_{c}) * ({c} - m_{c}) / (2 * v_{c})" for c in BAYES_FEATURES)


def rule_sql(source: str, feature: str) -> str:
    return (
        f"SELECT {feature} AS value, arg_max(label, k - label * 0.1::DOUBLE) AS prediction, sum(k)::BIGINT AS n FROM (SELECT {feature}, label, count(*) AS k FROM {source} GROUP BY ALL) GROUP BY {feature}"
    )


ERRORS = union_all([
    f"SELECT {i} AS place, '{c}' AS feature, sum(e)::BIGINT AS errors FROM (SELECT sum(k) - max(k) AS e FROM (SELECT {c} AS v, label, count(*) AS k FROM tr GROUP BY ALL) GROUP BY v)"
    for i, c in enumerate(RULE_FEATURES)
])

ORACLES = {
    "knn_predict": """WITH near AS (SELECT q.vec_id, p.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), p.label) AS r
        FROM embeddings q, embeddings p WHERE q.vec_id % 5 = 0 AND p.vec_id % 5 <> 0)
        SELECT vec_id, label::INT AS prediction FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, label) AS place FROM near WHERE r <= 5 GROUP BY vec_id, label) WHERE place = 1""",
    "gnb_params": lines_sql(f"SELECT label::DOUBLE AS label, feature, round(prior, 5) AS prior, round(mean, 5) AS mean, round(variance, 5) AS variance FROM ({BAYES_LONG})"),
    "gnb_predict": lines_sql(
        f"SELECT {ROWS}, prediction FROM (SELECT {ROWS}, label::DOUBLE AS prediction, row_number() OVER (PARTITION BY rid ORDER BY {LIKELIHOOD} DESC, label) AS r "
        f"FROM (SELECT *, row_number() OVER () AS rid FROM te), ({BAYES_WIDE})) WHERE r = 1"
    ),
    "oner_errors": lines_sql(ERRORS),
    "oner_rules": lines_sql(f"SELECT 'l_quantity' AS feature, value::DOUBLE AS value, prediction::DOUBLE AS prediction, n FROM ({rule_sql('tr', 'l_quantity')}) WHERE (SELECT feature FROM ({ERRORS}) ORDER BY errors, place LIMIT 1) = 'l_quantity'"),
    "oner_predict": lines_sql(
        f"SELECT {ROWS}, coalesce(prediction, (SELECT label FROM tr WHERE l_quantity <> 13 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1))::DOUBLE AS prediction "
        f"FROM te LEFT JOIN ({rule_sql('(SELECT * FROM tr WHERE l_quantity <> 13)', 'l_quantity')}) ON value = l_quantity"
    ),
}
