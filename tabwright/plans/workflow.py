"""End-to-end plans: ingest, detect, repair, split, prepare, train."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import nan_to_null, number, quoted
from tabwright.operators import models, prepare
from tabwright.operators.balance import balance, class_weights
from tabwright.operators.cleaning import changes, normalize_missing
from tabwright.operators.feature_types import ColumnType, FeatureTypes, column_groups, drop_unusable, infer_types
from tabwright.operators.quality import CARDINALITY, Issue, detect_all
from tabwright.operators.repair import GROUP_RARE, choices, grouping_entries, imbalance_choice, log_entry, repair, resolve_decisions
from tabwright.operators.split import TEST, TRAIN, random_split, stratified_split
from tabwright.operators.states import column_states
from tabwright.session import cut_lineage
from tabwright.sources.tables import write_split

STAGE_TARGET = "missing_target"
STAGE_EMPTY = "empty_column"
CLASSES, NUMBER, NO_TARGET = "classes", "number", "none"


@dataclass
class Config:
    """Settings of the preparation. The defaults repair and resample before the split; ``split_first`` does not.

    ``cardinality`` says what becomes of columns with many categories that nobody decided on: ``group_rare_categories``,
    ``drop_feature`` or ``keep_as_is``. Without it such columns are only reported.
    """

    test_size: float = 0.2
    seed: int = 42
    imputation: str = "median"
    scaling: str = prepare.STANDARD
    encoding: str = prepare.ONEHOT
    imbalance_action: str | None = None
    cardinality: str | None = None
    clean_first: bool = False
    split_first: bool = False
    keys: tuple[str, ...] | None = None


def empty_columns(columns: Sequence[str], prep: prepare.FittedPrep) -> list[dict]:
    """Log entries of the columns that the preparation left out, as they have no value in training."""
    used = {n.column for n in prep.numeric} | set(prep.categorical)
    return [log_entry(STAGE_EMPTY, c, detail_action="drop_column") for c in columns if c not in used]


@dataclass
class Transformed:
    train: DataFrame | None
    test: DataFrame | None
    target: str | None
    prep: prepare.FittedPrep
    codes: DataFrame | None
    types: FeatureTypes
    log: list[dict]
    weights: DataFrame | None
    task: str = CLASSES

    def prepared(self, df: DataFrame) -> DataFrame:
        """``label``, ``features`` and the plain feature columns of the given rows.

        The label is the code of the class or the number itself; tables without a target have none.
        """
        if self.task == NO_TARGET:
            return prepare.assemble(self.prep, df, keep=self.plain_features)
        if self.task == NUMBER:
            labelled = df.withColumn("label", number(self.target))
        else:
            labelled = prepare.encode_target(df, self.target, self.codes)
        return prepare.assemble(self.prep, labelled, keep=["label", *self.plain_features])

    def save(self, path: str) -> None:
        """What scoring new rows needs, the class weights and the log; the tables themselves are not part of it.

        A loaded preparation can be saved again, to another path.
        """
        self.prep.save(f"{path}/prep")
        for name, table in (("codes", self.codes), ("weights", self.weights)):
            if table is not None:
                table.write.mode("overwrite").parquet(f"{path}/{name}")
        types = {c: asdict(t) for c, t in self.types.items()}
        state = dict(target=self.target, task=self.task, types=types, log=self.log, weighted=self.weights is not None)
        models.write_state(SparkSession.active(), f"{path}/state", state)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Transformed:
        """A preparation that prepares and scores new rows; it has no tables of its own."""
        state = models.read_state(spark, f"{path}/state")
        codes = spark.read.parquet(f"{path}/codes") if state["task"] == CLASSES else None
        types = {c: ColumnType(**t) for c, t in state["types"].items()}
        prep = prepare.FittedPrep.load(spark, f"{path}/prep")
        weights = spark.read.parquet(f"{path}/weights") if state["weighted"] else None
        return Transformed(None, None, state["target"], prep, codes, types, state["log"], weights, state["task"])

    @property
    def plain_features(self) -> list[str]:
        return [n.column for n in self.prep.numeric] + list(self.prep.categorical)


def ingest(df: DataFrame, path: str, test_size: float = 0.2, seed: int = 42) -> dict[str, str]:
    """Write the raw table and a plain random split of it."""
    raw = f"{path}/raw"
    df.write.mode("overwrite").parquet(raw)
    split = write_split(random_split(df, test_size, seed), f"{path}/split")
    return {"raw": raw, "split": split}


def looked_at(df: DataFrame, target: str, marks: Mapping[str, Column]) -> tuple[FeatureTypes, dict[str, int], list[Issue]]:
    """Types and issues of a table, and in how many rows the mark of a column is set, all from one pass for the states."""
    prefix = "_mark_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    names = {f"{prefix}{i}": c for i, c in enumerate(marks)}
    states = column_states(df.select("*", *[marks[c].alias(name) for name, c in names.items()]))
    own = {c: states[c] for c in df.columns}
    types = infer_types(df, target, states=own)
    return types, {c: states[name].present for name, c in names.items()}, detect_all(df, target, types, own)


def transform(
    df: DataFrame,
    target: str,
    issues: Sequence[Issue] | None = None,
    decisions: Mapping[str, str] | None = None,
    config: Config | None = None,
) -> Transformed:
    """Clean, type, repair, balance, split stratified and fit the preparation on the training part."""
    config = config or Config()
    if target not in df.columns:
        raise ValueError(f"target column {target} is not in the table")
    df = nan_to_null(df)
    cleaned = normalize_missing(df)
    known, changed = None, {}
    if issues is None:
        seen = cleaned if config.clean_first else df
        known, changed, issues = looked_at(seen, target, {} if config.clean_first else changes(df))
    log: list[dict] = []
    unlabelled = cleaned.filter(quoted(target).isNull()).count()
    if unlabelled:
        cleaned = cleaned.filter(quoted(target).isNotNull())
        log.append(log_entry(STAGE_TARGET, target, detail_action="drop_rows", rows_removed=unlabelled))
    if known is None or unlabelled:
        types = infer_types(cleaned, target)
    else:  # the rows are those that issues were looked for in: only columns that cleaning changed are typed again
        again = [c for c in known if changed.get(c)]
        types = known | (infer_types(cleaned.select(*[quoted(c) for c in again])) if again else {})
    usable = drop_unusable(cleaned, types)
    kept = {c: t for c, t in types.items() if c in usable.columns}
    resolved = [r for r in resolve_decisions(issues, decisions, config.cardinality) if r["column"] in usable.columns]
    action = config.imbalance_action or imbalance_choice(resolved)
    # Rows are told apart by the keys only while no copies were drawn and the key columns are still there.
    keys = list(config.keys) if config.keys and set(config.keys) <= set(usable.columns) else None
    if config.split_first:
        parts = cut_lineage(stratified_split(usable, target, config.test_size, config.seed, keys))
        train, test = (parts.filter(F.col("split") == s).drop("split") for s in (TRAIN, TEST))
        train, entries = repair(train, resolved, kept)
        log += entries
        train, entries = balance(train, target, action, config.seed, keys)
        # Columns grouped in training are text there; values of the test part that it lacks are unknown categories.
        test = test.select(*[quoted(f.name).cast(f.dataType) if isinstance(f.dataType, T.StringType) else quoted(f.name) for f in train.schema.fields])
    else:
        repaired, entries = repair(usable, resolved, kept)
        log += entries
        # Written once: balancing and splitting count the rows several times, each time with texts cleaned and grouped anew.
        repaired, entries = balance(cut_lineage(repaired), target, action, config.seed, keys)
        copies = action == "oversampling"
        # Written once: every fit below reads the split table instead of repairing and splitting again.
        parts = cut_lineage(stratified_split(repaired, target, config.test_size, config.seed, None if copies else keys))
        train, test = (parts.filter(F.col("split") == s).drop("split") for s in (TRAIN, TEST))
    log += entries + grouping_entries(types)
    groups = column_groups(kept)
    numeric = [c for c in groups["numeric"] if c in train.columns]
    categorical = [c for c in groups["categorical"] if c in train.columns]
    grouped = [c for c, choice in choices(resolved, CARDINALITY).items() if choice == GROUP_RARE]
    prep = prepare.fit(train, numeric, categorical, config.imputation, config.scaling, config.encoding, grouped)
    log += empty_columns(numeric + categorical, prep)
    codes = prepare.target_codes(train, target)
    weights = None
    if action == "class_weights":
        weights = class_weights(prepare.encode_target(train, target, codes), "label")
    return Transformed(train, test, target, prep, codes, types, log, weights)


def transform_presplit(
    train: DataFrame, test: DataFrame, target: str | None, config: Config | None = None, task: str = CLASSES
) -> Transformed:
    """Preparation for tables that come split: types from both together, fit on the training table, no repair.

    ``task`` says what the target is: classes, a number (regression), or none (clustering; ``target`` is not used). Rows
    without a target are dropped from either table, with a log entry.
    """
    config = config or Config()
    if task == NO_TARGET:
        target = None
    train, test = normalize_missing(nan_to_null(train)), normalize_missing(nan_to_null(test))
    log: list[dict] = []
    unlabelled = sum(t.filter(quoted(target).isNull()).count() for t in (train, test)) if target else 0
    if unlabelled:
        train, test = (t.filter(quoted(target).isNotNull()) for t in (train, test))
        log.append(log_entry(STAGE_TARGET, target, detail_action="drop_rows", rows_removed=unlabelled))
    types = infer_types(train.unionByName(test), target)
    groups = column_groups(types)
    prep = prepare.fit(
        train, groups["numeric"], groups["categorical"], config.imputation, config.scaling, config.encoding
    )
    log += empty_columns([*groups["numeric"], *groups["categorical"]], prep)
    codes = prepare.target_codes(train, target) if task == CLASSES else None
    return Transformed(train, test, target, prep, codes, types, log, None, task)


def train(result: Transformed, how: str = "grid", names: Sequence[str] = models.MODEL_ORDER) -> models.TrainingReport:
    """Fit and compare the models on a transformed table. A test row of a class that training lacks is an error."""
    table = models.training_table(
        result.prepared(result.train), result.plain_features, weighted=result.weights is not None
    )
    held = result.prepared(result.test)
    unseen = held.filter("label IS NULL").count()
    if unseen:
        raise ValueError(f"{unseen} test rows have a class that the training table lacks")
    return models.train_all(table, held, how, names)


def run(
    df: DataFrame,
    target: str,
    decisions: Mapping[str, str] | None = None,
    config: Config | None = None,
    how: str = "grid",
    names: Sequence[str] = models.MODEL_ORDER,
) -> tuple[Transformed, models.TrainingReport]:
    """Everything from a raw table to a leaderboard."""
    result = transform(df, target, None, decisions, config)
    return result, train(result, how, names)


def save_run(path: str, result: Transformed, report: models.TrainingReport) -> None:
    """A whole run: the preparation and the report with all its models."""
    result.save(f"{path}/preparation")
    report.save(f"{path}/report")


def load_run(spark: SparkSession, path: str) -> tuple[Transformed, models.TrainingReport]:
    """A saved run, ready to score new rows, to show its tables and to be saved again."""
    return Transformed.load(spark, f"{path}/preparation"), models.TrainingReport.load(spark, f"{path}/report")


def score(result: Transformed, fitted: models.Fitted, df: DataFrame) -> DataFrame:
    """New rows (no target needed) with ``prediction`` and ``score``."""
    plain = result.plain_features
    rows = prepare.assemble(result.prep, normalize_missing(nan_to_null(df)), keep=plain)
    return fitted.predict(rows)
