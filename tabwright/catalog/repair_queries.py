"""Registered queries: decisions, repairs, rebalancing, splits, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog import inputs
from tabwright.catalog.profile_queries import union_all, with_source
from tabwright.catalog.quality_queries import DOCS_ISSUES, TARGET, docs_sql, docs_types
from tabwright.operators import balance, quality, repair, split
from tabwright.operators.feature_types import infer_types

DECISIONS = {"missing_source_gap": "drop rows", "outliers_n_chars": "remove", "constant_near": "keep feature", "class_imbalance": "oversampling"}
LOG_DECISIONS = {"missing_quality": "constant:-1", "missing_n_gap": "mean", "outliers_n_chars": "cap (IQR)", "outliers_n_gap": "no action", "constant_near": "keep feature"}


def gaps(spark, folder):
    """Line items: the columns with gaps."""
    return inputs.lines(spark, folder).select("l_orderkey", "l_gap", "l_line_gap", "l_status_gap")


def imputed(config):
    def query(spark, folder):
        rows = gaps(spark, folder)
        out, _ = repair.impute(rows, config, infer_types(rows))
        return out.withColumn("l_gap", F.round("l_gap", 4))

    return query


def resolve_decisions(spark, folder):
    docs, types = docs_types(spark, folder)
    return repair.decisions_frame(spark, repair.resolve_decisions(quality.detect_all(docs, TARGET, types), DECISIONS))


def outliers(action):
    def query(spark, folder):
        events = inputs.table(spark, folder, "events").selectExpr(
            "event_id", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value"
        )
        out, _ = repair.handle_outliers(events, {"value": action}, infer_types(events))
        return out.withColumn("value", F.round("value", 4))

    return query


def drop_constant(spark, folder):
    docs, types = docs_types(spark, folder)
    flagged = {i["column"]: repair.DROP_FEATURE for i in quality.detect_constants(docs, types)}
    return repair.drop_constants(docs, flagged, types)[0].drop("text")


def docs_plain(spark, folder):
    return inputs.table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")


def stratified(spark, folder):
    orders = inputs.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_split(orders, "o_orderstatus", 0.2, 42, ["o_orderkey"])


def stratified_copies(spark, folder):
    """A split of a table full of equal rows, as counts."""
    parts = split.stratified_split(inputs.repeats(spark, folder), "event_type", 0.25, 42)
    return parts.groupBy("event_type", "split").agg(F.count("*").alias("n"))


def folds(spark, folder):
    orders = inputs.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_folds(orders, "o_orderstatus", 5, 42, ["o_orderkey"]).withColumn("fold", F.col("fold").cast("int"))


def random_hash(spark, folder):
    orders = inputs.table(spark, folder, "orders").select("o_orderkey")
    return split.random_split(orders, 0.2, 42, ["o_orderkey"])


def random_exact(spark, folder):
    orders = inputs.table(spark, folder, "orders").select("o_orderkey")
    return split.exact_split(orders, 0.2, 42, ["o_orderkey"])


def prep(spark, folder):
    docs, types = docs_types(spark, folder)
    resolved = repair.resolve_decisions(quality.detect_all(docs, TARGET, types), LOG_DECISIONS)
    fixed, log = repair.repair(docs, resolved, types)
    fixed, entries = balance.balance(fixed, TARGET, "undersampling", 42, ["doc_id"])
    return docs, fixed, log + entries


def prep_log(spark, folder):
    table = repair.log_frame(spark, prep(spark, folder)[2]).drop("feature_type")
    rounded = F.round(F.col("fill_value").try_cast("double"), 3).cast("string")
    return table.withColumns({"fill_value": F.coalesce(rounded, "fill_value"), "lower": F.round("lower", 4), "upper": F.round("upper", 4)})


def prep_summary(spark, folder):
    return repair.prep_summary(*prep(spark, folder))


def class_weights(spark, folder):
    table = balance.class_weights(inputs.table(spark, folder, "documents"), TARGET)
    return table.withColumn("weight", F.round("weight", 6))


QUERIES = {
    "resolve_decisions": resolve_decisions,
    "impute_median": imputed({"l_gap": "median"}),
    "impute_mean": imputed({"l_gap": "mean"}),
    "impute_mode": imputed({"l_line_gap": "median", "l_status_gap": "mode"}),
    "impute_constant": imputed({"l_gap": "constant:-1.5", "l_status_gap": "constant:x:y"}),
    "impute_drop_rows": imputed({"l_gap": "drop_rows", "l_status_gap": "drop rows"}),
    "outlier_cap": outliers(quality.CAP),
    "outlier_remove": outliers(quality.REMOVE),
    "drop_constant": drop_constant,
    "group_rare": lambda s, d: repair.group_rare(docs_plain(s, d), "source", top=5),
    "group_rare_share": lambda s, d: repair.group_rare(inputs.table(s, d, "part").select("p_partkey", "p_type"), "p_type", min_share=0.15),
    "undersample": lambda s, d: balance.undersample(docs_plain(s, d), "lang", 42, ["doc_id"]),
    "oversample": lambda s, d: balance.oversample(docs_plain(s, d), "lang", 42, ["doc_id"]),
    "class_weights": class_weights,
    "stratified_split": stratified,
    "stratified_split_copies": stratified_copies,
    "stratified_folds": folds,
    "random_split_hash": random_hash,
    "random_split_exact": random_exact,
    "prep_log": prep_log,
    "prep_summary": prep_summary,
}

GAPS = "SELECT l_orderkey, l_gap, l_line_gap, l_status_gap FROM t"


def gaps_sql(body: str) -> str:
    return with_source("t", f"{inputs.LINE_SQL}), g AS ({GAPS}", body)


EVENTS = "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value FROM events"
FENCES = "SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e)"
DOCS_PLAIN = "SELECT doc_id, lang, source, n_chars FROM documents"
SMALLEST = "(SELECT lang FROM documents GROUP BY lang ORDER BY count(*), lang LIMIT 1)"
LARGEST = "(SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)"
LOW = "(SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))"
HIGH = "(SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))"


def split_sql(source: str, key: str, group: str, share: float) -> str:
    quota = f"CASE WHEN n < 2 THEN 0 ELSE greatest(1, least(round(n * {share}::DOUBLE), n - 1)) END"
    return (
        f"SELECT * EXCLUDE (r, n), CASE WHEN r <= {quota} THEN 'test' ELSE 'train' END AS split FROM (SELECT *, "
        f"row_number() OVER (PARTITION BY {group} ORDER BY md5(concat('42|', {key}))) AS r, count(*) OVER (PARTITION BY {group}) AS n FROM ({source}))"
    )


DOC_FENCES = "(SELECT round(q1 - 1.5 * (q3 - q1), 4) AS lo, round(q3 + 1.5 * (q3 - q1), 4) AS hi FROM (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM t))"

def filled_log(column: str, how: str, value: str) -> str:
    return (
        f"SELECT 1 AS step, 'missing_value_imputation' AS action, '{column}' AS \"column\", '{how}' AS detail_action, {value} AS fill_value, "
        f"count(*) - count({column}) AS values_imputed, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, NULL::BIGINT AS capped_below, NULL::BIGINT AS capped_above, "
        "NULL::BIGINT AS rows_removed, NULL::BIGINT AS rows_remaining FROM t"
    )


def mode_sql(source: str, column: str) -> str:
    return f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"


ORACLES = {
    "resolve_decisions": docs_sql(f"""SELECT issue_id, type, "column", lower, upper, CASE WHEN type = 'High Cardinality' THEN 'ignored'
        WHEN issue_id = 'missing_source_gap' THEN 'drop rows' WHEN issue_id = 'outliers_n_chars' THEN 'remove' WHEN issue_id = 'constant_near' THEN 'keep feature'
        WHEN issue_id = 'class_imbalance' THEN 'oversampling'
        WHEN type = 'Missing Values' THEN CASE WHEN feature_type IN ('continuous_numeric', 'discrete_numeric') THEN 'median' ELSE 'mode' END
        WHEN type = 'Outliers' THEN 'cap (IQR)' ELSE 'drop feature' END AS choice FROM ({DOCS_ISSUES})"""),
    "impute_median": gaps_sql("SELECT l_orderkey, round(coalesce(l_gap, (SELECT quantile_cont(l_gap, 0.5) FROM g)), 4) AS l_gap, l_line_gap, l_status_gap FROM g"),
    "impute_mean": gaps_sql("SELECT l_orderkey, round(coalesce(l_gap, (SELECT avg(l_gap) FROM g)), 4) AS l_gap, l_line_gap, l_status_gap FROM g"),
    "impute_mode": gaps_sql(f"SELECT l_orderkey, round(l_gap, 4) AS l_gap, coalesce(l_line_gap, {mode_sql('g', 'l_line_gap')}) AS l_line_gap, coalesce(l_status_gap, {mode_sql('g', 'l_status_gap')}) AS l_status_gap FROM g"),
    "impute_constant": gaps_sql("SELECT l_orderkey, round(coalesce(l_gap, -1.5), 4) AS l_gap, l_line_gap, coalesce(l_status_gap, 'x:y') AS l_status_gap FROM g"),
    "impute_drop_rows": gaps_sql("SELECT l_orderkey, round(l_gap, 4) AS l_gap, l_line_gap, l_status_gap FROM g WHERE l_gap IS NOT NULL AND l_status_gap IS NOT NULL"),
    "outlier_cap": with_source("e", EVENTS, f"SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 4) AS value FROM e, ({FENCES})"),
    "outlier_remove": with_source("e", EVENTS, f"SELECT event_id, round(value, 4) AS value FROM e, ({FENCES}) WHERE value BETWEEN lo AND hi"),
    "drop_constant": with_source("t", inputs.DOCS_SQL, "SELECT * EXCLUDE (text, konst, near) FROM t"),
    "group_rare": f"SELECT doc_id, lang, CASE WHEN source IN (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 5) THEN source ELSE 'Other' END AS source, n_chars FROM documents",
    "group_rare_share": "SELECT p_partkey, CASE WHEN p_type IN (SELECT p_type FROM part GROUP BY p_type HAVING count(*) >= 0.15::DOUBLE * (SELECT count(*) FROM part)) THEN p_type ELSE 'Other' END AS p_type FROM part",
    "undersample": f"""{DOCS_PLAIN} WHERE lang = {SMALLEST} UNION ALL SELECT * EXCLUDE (r) FROM (SELECT doc_id, lang, source, n_chars,
        row_number() OVER (ORDER BY md5(concat('42|', doc_id))) AS r FROM documents WHERE lang = {LARGEST}) WHERE r <= {LOW}""",
    "oversample": f"""{DOCS_PLAIN} WHERE lang IN ({SMALLEST}, {LARGEST}) UNION ALL SELECT doc_id, lang, source, n_chars FROM
        (SELECT *, row_number() OVER (ORDER BY md5(concat('42|', doc_id))) - 1 AS p FROM documents WHERE lang = {SMALLEST}) m
        JOIN (SELECT ('0x' || substr(md5(concat('42|draw|', i)), 1, 15))::BIGINT % {LOW} AS p FROM (SELECT unnest(range({HIGH} - {LOW})) AS i)) h USING (p)""",
    "class_weights": "SELECT lang AS label, count(*) AS n, round((SELECT count(*) FROM documents)::DOUBLE / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 6) AS weight FROM documents GROUP BY lang",
    "stratified_split": split_sql("SELECT o_orderkey, o_orderstatus FROM orders", "o_orderkey", "o_orderstatus", 0.2),
    "stratified_split_copies": union_all([
        f"SELECT event_type, '{part}' AS split, ({n})::BIGINT AS n FROM (SELECT event_type, count(*) AS c FROM events GROUP BY event_type)"
        for part, n in (("test", "greatest(1, least(round(c * 0.25::DOUBLE), c - 1))"), ("train", "c - greatest(1, least(round(c * 0.25::DOUBLE), c - 1))"))
    ]),
    "stratified_folds": "SELECT o_orderkey, o_orderstatus, (ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY md5(concat('42|', o_orderkey))) - 1)::INT AS fold FROM orders",
    "random_split_hash": "SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(concat('42|', o_orderkey)), 1, 15))::BIGINT < 230584300921369408 THEN 'test' ELSE 'train' END AS split FROM orders",
    "random_split_exact": split_sql("SELECT o_orderkey FROM orders", "o_orderkey", "1", 0.2),
    "prep_log": with_source(
        "t", inputs.DOCS_SQL,
        union_all([
            filled_log("quality", "constant", "'-1.0'"),
            filled_log("toxic", "mode", mode_sql("t", "toxic") + "::DOUBLE::VARCHAR"),
            filled_log("n_gap", "mean", "(SELECT round(avg(n_gap), 3)::VARCHAR FROM t)"),
            filled_log("source_gap", "mode", mode_sql("t", "source_gap")),
            f"SELECT 2, 'outlier_handling', 'n_chars', 'cap (IQR)', NULL, NULL::BIGINT, any_value(lo), any_value(hi), count(*) FILTER (n_chars < lo), count(*) FILTER (n_chars > hi), NULL::BIGINT, NULL::BIGINT FROM t, {DOC_FENCES}",
            "SELECT 3, 'constant_feature_removal', 'konst', 'drop', NULL, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT",
            f"SELECT 4, 'class_imbalance_handling', 'lang', 'undersampling', NULL, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::BIGINT, count(*) - 2 * {LOW}, 2 * {LOW} FROM t",
        ]),
    ),
    "prep_summary": f"SELECT count(*) AS rows_original, 2 * {LOW} AS rows_final, count(*) - 2 * {LOW} AS rows_removed, 11 AS columns_original, 10 AS columns_final, 1 AS columns_removed, 4 AS steps FROM documents",
}
