"""Registered queries: imputers, scalers, encoders, target codes, full preparation.

Fitted on four fifths of the line items, applied to the rest; results in long form so that both sides agree on names.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.catalog import inputs
from tabwright.catalog.profile_queries import union_all, with_source
from tabwright.catalog.quality_queries import TARGET
from tabwright.operators import prepare
from tabwright.operators.repair import prep_summary
from tabwright.plans import workflow

NUMERIC = ["l_gap", "l_extendedprice", "flat"]
CATEGORICAL = ["l_status_gap", "l_line_gap", "l_returnflag"]
KEYS = ["l_orderkey", "l_linenumber"]


def parts(spark, folder):
    train = inputs.train_lines(spark, folder).withColumn("flat", F.lit(7.0)).filter("l_line_gap IS NULL OR l_line_gap <> 7")
    test = inputs.test_lines(spark, folder).withColumn("flat", F.when(F.col("l_linenumber") > 3, 7.0).otherwise(9.0))
    # Whole numbers without gaps in the test part, with categories that training has not seen.
    return train, test.withColumn("l_line_gap", F.col("l_linenumber"))


PARTS_SQL = (
    f"{inputs.LINE_SQL}), tr AS (SELECT *, 7.0::DOUBLE AS flat FROM t WHERE {inputs.IS_TRAIN} AND (l_line_gap IS NULL OR l_line_gap <> 7)), "
    f"te AS (SELECT * REPLACE (l_linenumber AS l_line_gap), CASE WHEN l_linenumber > 3 THEN 7.0::DOUBLE ELSE 9.0::DOUBLE END AS flat FROM t WHERE {inputs.IS_TEST}"
)


def fit_impute(spark, folder):
    train, _ = parts(spark, folder)
    fills, top = prepare.fit_fills(train, NUMERIC, CATEGORICAL)
    rows = [(c, str(round(v, 4))) for c, v in fills.items()] + [(c, str(v)) for c, v in top.items()]
    return spark.createDataFrame(rows, "column string, fill string")


def fit_impute_mean(spark, folder):
    train, _ = parts(spark, folder)
    fills, _ = prepare.fit_fills(train, NUMERIC, [], "mean")
    return spark.createDataFrame(list(fills.items()), "column string, fill double").withColumn("fill", F.round("fill", 4))


def scaled(scaling):
    def query(spark, folder):
        train, test = parts(spark, folder)
        fitted = prepare.fit(train, NUMERIC, [], scaling=scaling)
        out = prepare.scaled_columns(fitted, test)
        return out.select(*KEYS, "l_partkey", *[F.round(f"scaled_{c}", 4).alias(c) for c in NUMERIC])

    return query


def onehot(scaled_values):
    def query(spark, folder):
        train, test = parts(spark, folder)
        fitted = prepare.fit(train, [], CATEGORICAL)
        out = prepare.onehot_long(fitted, test, [*KEYS, "l_partkey"], scaled_values)
        return out.withColumn("value", F.round("value", 4))

    return query


def encode_ordinal(spark, folder):
    train, test = parts(spark, folder)
    fitted = prepare.fit(train, [], CATEGORICAL, encoding=prepare.ORDINAL)
    out = prepare.with_codes(fitted, test)
    return out.select(*KEYS, "l_partkey", *[F.col(f"code_{c}").alias(c) for c in CATEGORICAL])


def encode_target(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "lang")
    out = prepare.encode_target(docs, "lang", prepare.target_codes(docs.filter("doc_id % 5 <> 0"), "lang"))
    return out.select("doc_id", "lang", F.col("label").cast("int").alias("label"))


def integer_target(spark, folder):
    return inputs.table(spark, folder, "events").select("event_id", prepare.integer_target("value").alias("label"))


def assemble_features(spark, folder):
    train, test = parts(spark, folder)
    fitted = prepare.fit(train, NUMERIC, CATEGORICAL)
    return prepare.assemble(fitted, test, KEYS)


def assembled_slots(spark, folder):
    """The non-zero slots of the assembled vectors."""
    train, test = parts(spark, folder)
    vectors = prepare.assemble(prepare.fit(train, NUMERIC, CATEGORICAL), test, [*KEYS, "l_partkey"])
    long = vectors.select(*KEYS, "l_partkey", F.posexplode(vector_to_array("features")).alias("slot", "value")).filter("value <> 0")
    return long.withColumn("value", F.round("value", 4))


def feature_slots(spark, folder):
    train, _ = parts(spark, folder)
    return prepare.feature_table(spark, prepare.fit(train, NUMERIC, CATEGORICAL))


def transformed(spark, folder, **settings):
    docs = inputs.docs(spark, folder)
    return docs, workflow.transform(docs, TARGET, config=workflow.Config(keys=("doc_id",), cardinality="group_rare_categories", **settings))


def transform_full(spark, folder):
    _, result = transformed(spark, folder)
    both = result.prepared(result.train).withColumn("split", F.lit("train")).unionByName(
        result.prepared(result.test).withColumn("split", F.lit("test"))
    )
    return both.groupBy("split", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))


def transform_values(spark, folder):
    """Sums of repaired columns, and grouped texts, per class: numbers filled and capped, categories filled, rare texts as one."""
    _, result = transformed(spark, folder)
    whole = result.train.unionByName(result.test)
    other = F.count_if(F.col("text") == "Other") if "text" in whole.columns else F.lit(0).cast("bigint")
    numbers = [F.sum(F.col(c).cast("double")).alias(c) for c in ("n_chars", "n_gap", "quality", "toxic")]
    return whole.groupBy("lang").agg(F.count("*").alias("n"), *numbers, F.count("source_gap").alias("sources"), other.alias("other_texts"))


def transform_summary(spark, folder):
    docs, result = transformed(spark, folder)
    whole = result.train.unionByName(result.test)
    return prep_summary(docs, whole, result.log).drop("steps")


def transform_presplit(spark, folder):
    """Both parts of the orders, prepared; dates have no type of feature and stay out."""
    orders = inputs.table(spark, folder, "orders")
    result = workflow.transform_presplit(orders.filter("o_orderkey % 5 <> 0"), orders.filter("o_orderkey % 5 = 0"), "o_orderstatus")
    parts = [result.prepared(part).select(F.lit(name).alias("split"), "label", "features") for name, part in (("train", result.train), ("test", result.test))]
    return parts[0].unionByName(parts[1])


QUERIES = {
    "fit_impute": fit_impute,
    "fit_impute_mean": fit_impute_mean,
    "scale_standard": scaled(prepare.STANDARD),
    "scale_minmax": scaled(prepare.MINMAX),
    "encode_onehot": onehot(False),
    "scale_onehot": onehot(True),
    "encode_ordinal": encode_ordinal,
    "encode_target": encode_target,
    "integer_target": integer_target,
    "assemble_features": assemble_features,
    "assembled_slots": assembled_slots,
    "feature_slots": feature_slots,
    "transform_full": transform_full,
    "transform_values": transform_values,
    "transform_summary": transform_summary,
    "transform_presplit": transform_presplit,
}


def parts_sql(body: str) -> str:
    return with_source("t", PARTS_SQL, body)


def mode_of(c: str) -> str:
    return f"(SELECT {c} FROM tr WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def median_of(c: str) -> str:
    return f"(SELECT quantile_cont({c}, 0.5) FROM tr)"


def filled(c: str) -> str:
    return f"coalesce({c}, {median_of(c)})"


def scaled_sql(centre: str, scale: str) -> str:
    stats = ", ".join(
        f"{centre.format(filled(c))} AS m_{c}, CASE WHEN max({filled(c)}) > min({filled(c)}) THEN {scale.format(filled(c))} ELSE 1 END AS s_{c}" for c in NUMERIC
    )
    columns = ", ".join(f"round((coalesce({c}, {median_of(c)}) - m_{c}) / s_{c}, 4) AS {c}" for c in NUMERIC)
    return parts_sql(f"SELECT l_orderkey, l_linenumber, l_partkey, {columns} FROM te, (SELECT {stats} FROM tr)")


def onehot_sql(value: str) -> str:
    pieces = [
        f"SELECT l_orderkey, l_linenumber, l_partkey, concat('{c}=', v) AS feature, round({value}, 4) AS value "
        f"FROM (SELECT *, coalesce({c}, {mode_of(c)}) AS v FROM te) JOIN (SELECT coalesce({c}, {mode_of(c)}) AS v, count(*) / (SELECT count(*) FROM tr)::DOUBLE AS p FROM tr GROUP BY 1) USING (v)"
        for c in CATEGORICAL
    ]
    return parts_sql(union_all(pieces))


def slots_sql() -> str:
    """Categories with their slots: columns in order, categories sorted within each."""
    return union_all([
        f"SELECT {i} AS place, '{c}' AS col, v::VARCHAR AS v, p, row_number() OVER (ORDER BY v) - 1 AS code FROM "
        f"(SELECT coalesce({c}, {mode_of(c)}) AS v, count(*) / (SELECT count(*) FROM tr)::DOUBLE AS p FROM tr GROUP BY 1)"
        for i, c in enumerate(CATEGORICAL)
    ])


def slots_body(value: str) -> str:
    return (
        f"SELECT col, v, {len(NUMERIC)} + code + coalesce((SELECT sum(n) FROM (SELECT place, count(*) AS n FROM s GROUP BY place) b WHERE b.place < s.place), 0) AS slot, "
        f"{value} AS value FROM s"
    )


def assembled_sql() -> str:
    scaled = [
        f"SELECT l_orderkey, l_linenumber, l_partkey, {i} AS slot, (coalesce({c}, {median_of(c)}) - m) / s AS value FROM te, "
        f"(SELECT avg({filled(c)}) AS m, CASE WHEN max({filled(c)}) > min({filled(c)}) THEN stddev_pop({filled(c)}) ELSE 1 END AS s FROM tr)"
        for i, c in enumerate(NUMERIC)
    ]
    hot = [
        f"SELECT l_orderkey, l_linenumber, l_partkey, slot, value FROM te JOIN h ON col = '{c}' AND v = coalesce({c}, {mode_of(c)})::VARCHAR" for c in CATEGORICAL
    ]
    scale = "CASE WHEN p < 1 THEN 1 / sqrt(p * (1 - p)) ELSE 1.0 END"
    return parts_sql(
        f"SELECT l_orderkey, l_linenumber, l_partkey, slot::INT AS slot, round(value, 4) AS value FROM ("
        f"WITH s AS ({slots_sql()}), h AS ({slots_body(scale)}) {union_all(scaled + hot)}) WHERE value <> 0"
    )


ORDINAL_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"coalesce(c_{c}, -1)::INT AS {c}" for c in CATEGORICAL
) + " FROM (SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"coalesce({c}, {mode_of(c)}) AS {c}" for c in CATEGORICAL) + " FROM te) " + " ".join(
    f"LEFT JOIN (SELECT v AS {c}, row_number() OVER (ORDER BY v) - 1 AS c_{c} FROM (SELECT DISTINCT coalesce({c}, {mode_of(c)}) AS v FROM tr)) USING ({c})" for c in CATEGORICAL
)

STRIPPED = r"nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '')"
#: 1 if the texts are not nearly all different: then they are no ids, and the rare ones are grouped.
TEXT_STAYS = f"(count(DISTINCT {STRIPPED}) < 0.95::DOUBLE * count(*))::INT"

FULL_SQL = (
    "SELECT lang, c, greatest(1, least(round(c * 0.2::DOUBLE), c - 1)) AS k, row_number() OVER (ORDER BY lang) - 1 AS label FROM (SELECT lang, count(*) AS c FROM documents GROUP BY lang)"
)

def fences_of(c: str) -> str:
    q1, q3 = (f"quantile_cont({c}, {q})" for q in (0.25, 0.75))
    return f"round({q1} - 1.5 * ({q3} - {q1}), 4) AS lo_{c}, round({q3} + 1.5 * ({q3} - {q1}), 4) AS hi_{c}"


def most_frequent(c: str) -> str:
    return f"(SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


#: Whole numbers are capped at whole numbers; a fractional median makes a column fractional.
VALUES_SQL = with_source(
    "t", inputs.DOCS_SQL,
    f"""SELECT lang, count(*) AS n, sum(least(greatest(n_chars, ceil(lo_n_chars)), floor(hi_n_chars)))::DOUBLE AS n_chars,
      sum(CASE WHEN m = floor(m) THEN least(greatest(coalesce(n_gap, m), ceil(lo_n_gap)), floor(hi_n_gap)) ELSE least(greatest(coalesce(n_gap, m), lo_n_gap), hi_n_gap) END)::DOUBLE AS n_gap,
      sum(coalesce(quality, {most_frequent('quality')}))::DOUBLE AS quality, sum(coalesce(toxic, {most_frequent('toxic')}))::DOUBLE AS toxic, count(*) AS sources,
      count(*) FILTER (stays = 1 AND txt IS NOT NULL AND k NOT IN (
        SELECT k FROM (SELECT CASE WHEN length(x) <= 64 THEN x ELSE concat('sha256:', sha256(x)) END AS k, count(*) AS c
          FROM (SELECT {STRIPPED} AS x FROM t) WHERE x IS NOT NULL GROUP BY k ORDER BY c DESC, k LIMIT 49))) AS other_texts
    FROM (SELECT *, CASE WHEN length(txt) <= 64 THEN txt ELSE concat('sha256:', sha256(txt)) END AS k FROM (SELECT *, {STRIPPED} AS txt FROM t)),
      (SELECT {fences_of('n_chars')}, {fences_of('n_gap')}, quantile_cont(n_gap, 0.5) AS m, {TEXT_STAYS} AS stays FROM t) GROUP BY lang""",
)

ORACLES = {
    "transform_values": VALUES_SQL,
    "assembled_slots": assembled_sql(),
    "feature_slots": parts_sql(
        f"SELECT * FROM (WITH s AS ({slots_sql()}) SELECT slot::INT AS slot, concat(col, '=', v) AS feature FROM ({slots_body('p')}) UNION ALL "
        + union_all([f"SELECT {i}, '{c}'" for i, c in enumerate(NUMERIC)]) + ")"
    ),
    "fit_impute": parts_sql(union_all(
        [f"SELECT '{c}' AS \"column\", round({median_of(c)}, 4)::VARCHAR AS fill" for c in NUMERIC] + [f"SELECT '{c}', {mode_of(c)}::VARCHAR" for c in CATEGORICAL]
    )),
    "fit_impute_mean": parts_sql(union_all([f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS fill FROM tr" for c in NUMERIC])),
    "scale_standard": scaled_sql("avg({0})", "stddev_pop({0})"),
    "scale_minmax": scaled_sql("min({0})", "max({0}) - min({0})"),
    "encode_onehot": onehot_sql("1.0::DOUBLE"),
    "scale_onehot": onehot_sql("CASE WHEN p < 1 THEN 1 / sqrt(p * (1 - p)) ELSE 1.0 END"),
    "encode_ordinal": parts_sql(ORDINAL_SQL),
    "encode_target": "SELECT doc_id, lang, label::INT AS label FROM documents LEFT JOIN (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS label FROM (SELECT DISTINCT lang FROM documents WHERE doc_id % 5 <> 0)) USING (lang)",
    "integer_target": "SELECT event_id, trunc(value)::INT AS label FROM events",
    "transform_full": f"SELECT 'test' AS split, label::INT AS label, k::BIGINT AS n FROM ({FULL_SQL}) UNION ALL SELECT 'train', label::INT, (c - k)::BIGINT FROM ({FULL_SQL})",
    "transform_summary": f"SELECT count(*) AS rows_original, count(*) AS rows_final, 0 AS rows_removed, 11 AS columns_original, 7 + {TEXT_STAYS} AS columns_final, 4 - {TEXT_STAYS} AS columns_removed FROM documents",
}
