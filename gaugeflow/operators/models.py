"""Training, scoring and promotion of models."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.columns import finite, with_row
from gaugeflow.functions.running import exact_quantiles
from gaugeflow.operators.alerts import align
from gaugeflow.operators.evalmetrics import ranking_metrics, regression_metrics, threshold_metrics, time_split3
from gaugeflow.schema import TASKS, Task, numeric_columns
from gaugeflow.session import discard, spill
from gaugeflow.sources.files import replace_table

#: Rounds, depth, rate and subsampling of the boosted trees.
ROUNDS, RATE, SUBSAMPLE = 300, 0.05, 0.9
#: Early stopping: the training ends when so many rounds have not lowered the loss on the validation rows.
PATIENCE = 30
#: Bounds of the rows a forest is fitted on: rows per tree and trees.
FOREST_ROWS, FOREST_TREES = 256, 200
#: The fields of the raw-sensor forest with the normal operation it is fitted on.
RAW_SENSORS: dict[str, tuple[str, float, float]] = {
    "lat": ("uniform", -90, 90),
    "lon": ("uniform", -180, 180),
    "speed": ("uniform", 0, 80),
    "accel_x": ("normal", 0, 0.5),
    "accel_y": ("normal", 0, 0.5),
    "accel_z": ("normal", 9.8, 0.3),
    "vibration": ("uniform", 0, 2),
    "battery_soh": ("uniform", 70, 100),
    "motor_temp": ("uniform", 20, 90),
    "cpu_usage": ("uniform", 0, 80),
}
RAW_ROWS, RAW_TREES = 5_000, 100


def _stages(booster: GBTClassifier | GBTRegressor, features: list[str]) -> Pipeline:
    filled = [f"{c}__f" for c in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"), booster])


def classifier(features: list[str], label: str, weight: str | None = "weight", rounds: int = ROUNDS, seed: int = 11) -> Pipeline:
    """Median imputation and gradient-boosted trees for a boolean label."""
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=5, stepSize=RATE, subsamplingRate=SUBSAMPLE, featureSubsetStrategy=str(SUBSAMPLE), seed=seed)
    return _stages(gbt.setWeightCol(weight) if weight else gbt, features)


def regressor(features: list[str], target: str, rounds: int = ROUNDS, seed: int = 11) -> Pipeline:
    """Median imputation and gradient-boosted trees for a number."""
    return _stages(GBTRegressor(labelCol=target, featuresCol="features", maxIter=rounds, maxDepth=3, stepSize=RATE, subsamplingRate=SUBSAMPLE, seed=seed), features)


@dataclass
class IsolationForest:
    """Median imputation, scaling and isolation trees over a bounded sample; a tree is arrays (feature, cut, left, right, path)."""

    features: list[str]
    medians: list[float]
    trees: list[dict] = field(default_factory=list)
    rows: int = FOREST_ROWS
    means: list[float] = field(default_factory=list)
    scales: list[float] = field(default_factory=list)

    @staticmethod
    def fit(sample: pd.DataFrame, features: list[str], trees: int = FOREST_TREES, rows: int = FOREST_ROWS, seed: int = 11, medians: list[float] | None = None) -> IsolationForest:
        """Trees on random subsets of ``rows`` rows, to the depth at which the average path ends; without ``medians`` those of the sample."""
        rng = np.random.default_rng(seed)
        x = sample[features].to_numpy(dtype=float)
        x[~np.isfinite(x)] = np.nan
        if medians is None:
            medians = np.nan_to_num(np.nanmedian(x, axis=0)).tolist() if len(x) else [0.0] * len(features)
        x = np.where(np.isnan(x), np.array(medians), x)
        spread = x.std(axis=0) if len(x) else np.ones(len(features))
        out = IsolationForest(features, medians, rows=min(rows, max(2, len(x))), means=(x.mean(axis=0) if len(x) else np.zeros(len(features))).tolist(), scales=np.where(spread > 0, spread, 1.0).tolist())
        if not len(x):
            return out
        x = (x - np.array(out.means)) / np.array(out.scales)
        depth = math.ceil(math.log2(max(2, out.rows)))
        for _ in range(trees):
            pick = x[rng.choice(len(x), size=out.rows, replace=len(x) < out.rows)]
            out.trees.append(_isolate(pick, depth, rng))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): towards 1 for rows that are isolated early."""
        x = (np.where(np.isfinite(x), x, np.array(self.medians)) - np.array(self.means)) / np.array(self.scales)
        total = np.zeros(len(x))
        for t in self.trees:
            total += _path(t, x)
        return 2.0 ** (-total / (max(1, len(self.trees)) * _expected(self.rows)))


def _expected(n: float) -> float:
    """Average path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _isolate(x: np.ndarray, depth: int, rng: np.random.Generator) -> dict:
    nodes: list[tuple[int, float, int, int, float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, -1, -1, level + _expected(len(rows))))
        lo, hi = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_to = np.flatnonzero(hi > lo)
        if level >= depth or len(rows) < 2 or not len(open_to):
            return me
        f = int(rng.choice(open_to))
        cut = float(rng.uniform(lo[f], hi[f]))
        below = rows[:, f] < cut
        left, right = grow(rows[below], level + 1), grow(rows[~below], level + 1)
        nodes[me] = (f, cut, left, right, 0.0)
        return me

    grow(x, 0)
    cols = list(zip(*nodes, strict=True))
    return {"f": np.array(cols[0]), "c": np.array(cols[1]), "l": np.array(cols[2]), "r": np.array(cols[3]), "p": np.array(cols[4])}


def _path(tree: dict, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=int)
    while True:
        f = tree["f"][at]
        inner = f >= 0
        if not inner.any():
            return tree["p"][at]
        below = x[np.arange(len(x)), np.maximum(f, 0)] < tree["c"][at]
        at = np.where(inner, np.where(below, tree["l"][at], tree["r"][at]), at)


def bounded_sample(df: DataFrame, columns: list[str], rows: int = 20_000, key: str | None = None) -> pd.DataFrame:
    """At most ``rows`` rows for fitting, chosen by the hash of ``key``, a unique column; sorted within executors, never all collected.

    Without a key the values are hashed, and equal rows are in the sample all or not at all.
    """
    return df.select(*columns, F.xxhash64(*([key] if key else columns)).alias("_h")).orderBy("_h").limit(rows).drop("_h").toPandas()


def medians(df: DataFrame, columns: list[str]) -> list[float]:
    """Exact medians of the finite values of all rows, 0 for a column without any."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    found = {r["feature"]: r["quantiles"][0] for r in exact_quantiles(cells.where(finite("value")), ("feature",), "value", (0.5,)).collect()}
    return [found.get(c, 0.0) for c in columns]


def score_forest(df: DataFrame, forest: IsolationForest, output: str = "anomaly_score") -> DataFrame:
    """Add the forest's score; features that the frame lacks count as their median. Runs on Arrow batches."""
    aligned = align(df, forest.features, keep=tuple(c for c in df.columns if c not in forest.features))

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.scores(x.to_numpy(dtype=float)))

    return df.withColumn(output, score(F.struct(*[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in aligned.columns if c in forest.features])))


def zscore(df: DataFrame, statistics: dict[str, tuple[float, float]], output: str = "anomaly_score") -> DataFrame:
    """A plain scorer in native expressions: the largest absolute z over the features, squashed to [0, 1)."""
    zs = [F.coalesce(F.abs((F.col(c) - m) / (s or 1.0)), F.lit(0.0)) for c, (m, s) in statistics.items() if c in df.columns]
    z = F.greatest(F.lit(0.0), F.lit(0.0), *zs)
    return df.withColumn(output, 1 - F.exp(-z / 3))


def batch_score(scored: DataFrame, task: Task, model: str, alias: str) -> DataFrame:
    """(machine_id, event_timestamp, <score>, model, alias)."""
    return scored.select("machine_id", "event_timestamp", F.col(task.output).cast("double").alias(task.output), F.lit(model).alias("model"), F.lit(alias).alias("alias"))


@dataclass
class Model:
    """A fitted model of a task: score() adds the task's output column, whatever the kind of model."""

    task: Task
    features: list[str]
    fitted: PipelineModel | IsolationForest
    rounds: int = 0

    def score(self, df: DataFrame) -> DataFrame:
        """The frame with the probability of the label, the anomaly score or the prediction; absent features count as NULL."""
        if self.task.kind == "anomaly":
            return score_forest(df, self.fitted)
        lacking = {c: F.lit(None).cast("double") for c in self.features if c not in df.columns}
        marked = df.withColumns({**lacking, "_row": F.struct(*df.columns)})
        done = self.fitted.transform(_numbers(marked, self.features))
        value = vector_to_array("probability")[1] if self.task.kind == "probability" else F.col("prediction")
        return done.select("_row.*", value.cast("double").alias(self.task.output))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model to a folder, replacing what was there."""
        meta = {"task": self.task.name, "features": self.features, "rounds": self.rounds}
        if isinstance(self.fitted, IsolationForest):
            meta["forest"] = {**{k: v for k, v in asdict(self.fitted).items() if k != "trees"}, "trees": [{k: v.tolist() for k, v in t.items()} for t in self.fitted.trees]}
        else:
            self.fitted.write().overwrite().save(path + "/pipeline")
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        """The model of a folder."""
        meta = json.loads(spark.read.text(path + "/meta").first()["value"])
        forest = meta.get("forest")
        if forest:
            trees = [{k: np.array(v) for k, v in t.items()} for t in forest.pop("trees")]
            fitted = IsolationForest(**forest, trees=trees)
        else:
            fitted = PipelineModel.load(path + "/pipeline")
        return Model(TASKS[meta["task"]], meta["features"], fitted, meta["rounds"])


def _numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """The features as doubles, NULL for NaN: both are missing values to the imputation."""
    return df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in names})


def labelled(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    """The features with the target as ``_y``, of the rows that have one."""
    return _numbers(df.where(F.col(target).isNotNull()), names).select(*names, F.col(target).cast("double").alias("_y"))


#: The column each kind of task learns.
TARGETS = {"probability": "label_failure_within_horizon", "regression": "battery_soh_mean_5m"}


def train(task_name: str, features: DataFrame, label: str | None = None, rounds: int = ROUNDS, validation: DataFrame | None = None) -> Model:
    """A model for a task of the registry; rows without label don't train. With ``validation`` rows it stops early."""
    task = TASKS[task_name]
    names = numeric_columns(features, drop_prefix=task.leak_prefix)
    if task.kind == "anomaly":
        key = "feature_id" if "feature_id" in features.columns else None
        return Model(task, names, IsolationForest.fit(bounded_sample(features, names, key=key), names, medians=medians(features, names)))
    target = label or TARGETS[task.kind]
    names = [c for c in names if c != target]

    rows = labelled(features, target, names)
    # A column without any value can't be imputed.
    seen = rows.agg(F.avg("_y").alias("_share"), *[F.count(c).alias(c) for c in names]).first().asDict()
    share = seen.pop("_share")
    if share is None:
        raise ValueError("no labelled rows")
    names = [c for c in names if seen[c]]
    weight = F.when(F.col("_y") == 1, F.lit(max(1.0, (1 - share) / share) if share else 1.0)).otherwise(F.lit(1.0))
    pipeline = (classifier if task.kind == "probability" else regressor)(names, "_y", rounds=rounds)
    *steps, booster = pipeline.getStages()
    ready = Pipeline(stages=steps).fit(rows)
    # The booster reads its rows once a round: they are written once.
    prepared = lambda df, name: spill(ready.transform(df).select("features", "_y", weight.alias("weight")), name)
    fitted = fit_early(booster, prepared(rows, "training"), None if validation is None else prepared(labelled(validation, target, names), "validation"))
    return Model(task, names, PipelineModel([*ready.stages, fitted]), fitted.getNumTrees)


def fit_early(booster: GBTClassifier | GBTRegressor, rows: DataFrame, held: DataFrame | None, patience: int = PATIENCE) -> GBTClassificationModel | GBTRegressionModel:
    """The booster with the number of rounds that does best on the held rows, or with all of them if there are none.

    Rounds are doubled until ``patience`` of them have brought no lower loss on the held rows, or the booster's own number
    is reached. Trees depend on seed and place alone, so the final model is the beginning of the last. Both tables are
    deleted at the end.
    """
    most = booster.getMaxIter()
    judged = held is not None and not held.isEmpty()
    rounds = min(most, patience + 2) if judged else most
    while True:
        fitted = booster.copy({booster.maxIter: rounds}).fit(rows)
        if not judged:
            break
        loss = fitted.evaluateEachIteration(held) if isinstance(booster, GBTClassifier) else fitted.evaluateEachIteration(held, "squared")
        best = int(np.argmin(loss)) + 1
        if rounds >= most or best + patience <= rounds:
            fitted = fitted if best == rounds else booster.copy({booster.maxIter: best}).fit(rows)
            break
        rounds = min(most, 2 * rounds)
    for gone in (rows, held):
        if gone is not None:
            discard(gone)
    return fitted


def evaluate(task_name: str, features: DataFrame, test_share: float = 0.2, validation_share: float = 0.1, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """(model, one row of metrics): trained on the oldest rows, stopped by the next, measured on the newest.

    Only the classifier stops early. The anomaly forest knows no labels when it trains; its score is measured against them
    (score_auc).
    """
    task = TASKS[task_name]
    older, validation, test = time_split3(features, test_share, validation_share)
    model = train(task_name, older, rounds=rounds, validation=validation if task.kind == "probability" else None)
    label = TARGETS["regression" if task.kind == "regression" else "probability"]
    scored = spill(model.score(test.where(F.col(label).isNotNull())).select(F.col(label).cast("double").alias("_y"), F.col(task.output).alias("_s")), "scored")
    if task.kind == "regression":
        return model, regression_metrics(scored, "_y", "_s")
    ranking = ranking_metrics(scored, "_y", "_s")
    return model, ranking.withColumnRenamed("roc_auc", "score_auc") if task.kind == "anomaly" else with_row(ranking, threshold_metrics(scored, "_y", "_s"))


def raw_sensor_forest(rows: int = RAW_ROWS, trees: int = RAW_TREES, seed: int = 42) -> Model:
    """The forest over raw sensors, fitted on synthetic readings of normal operation."""
    rng = np.random.default_rng(seed)
    sample = pd.DataFrame({c: getattr(rng, kind)(a, b, rows) for c, (kind, a, b) in RAW_SENSORS.items()})
    return Model(TASKS["anomaly_detection"], list(RAW_SENSORS), IsolationForest.fit(sample, list(RAW_SENSORS), trees, seed=seed))


def score_to_table(model: Model, features: DataFrame, folder: str, name: str, alias: str) -> DataFrame:
    """Score a feature table and replace the stored predictions of the task, <folder>/<task>."""
    target = f"{folder}/{model.task.name}"
    replace_table(batch_score(model.score(features), model.task, name, alias), target)
    return features.sparkSession.read.parquet(target)


@dataclass
class Outcome:
    """What a run of the pipeline came to."""

    task: str
    metrics: dict[str, float]
    rounds: int
    version: int | None = None
    promoted: bool = False


def run_pipeline(task_name: str, features: DataFrame, registry: Registry | None = None, folder: str | None = None, promote: bool = True, rounds: int = ROUNDS) -> Outcome:
    """Train and measure a task's model; with a registry, save it as a new version and promote it if it earns that."""
    model, measured = evaluate(task_name, features, rounds=rounds)
    metrics = {k: float(v) for k, v in measured.first().asDict().items() if v is not None}
    out = Outcome(task_name, metrics, model.rounds)
    if registry is not None:
        version, out.promoted = registry.register(task_name, metrics.get(TASKS[task_name].metric, float("nan")), promote)
        out.version = version.version
        if folder:
            model.save(features.sparkSession, f"{folder}/{task_name}/{version.version}")
    return out


@dataclass
class Version:
    """A registered model version."""

    task: str
    version: int
    value: float
    aliases: list[str] = field(default_factory=list)


def promotes(task: Task, candidate: float, incumbent: float | None) -> bool:
    """Whether a candidate's metric is finite, clears the gate and strictly beats the incumbent's; an infinite gate is none."""
    if not math.isfinite(candidate):
        return False
    if math.isfinite(task.gate) and (candidate < task.gate if task.higher_is_better else candidate > task.gate):
        return False
    if incumbent is None or not math.isfinite(incumbent):
        return True
    return candidate > incumbent if task.higher_is_better else candidate < incumbent


class Registry:
    """Model versions in a JSON file: every version is staged, the champion alias moves only by promotes()."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)
        self.versions = [Version(**v) for v in json.loads(self.path.read_text())] if self.path.exists() else []

    def champion(self, task: str) -> Version | None:
        return next((v for v in self.versions if v.task == task and "champion" in v.aliases), None)

    def register(self, task_name: str, value: float, promote: bool = True) -> tuple[Version, bool]:
        """(the new version, whether it became champion); without ``promote`` it is only staged."""
        old = self.champion(task_name)
        new = Version(task_name, 1 + max([v.version for v in self.versions if v.task == task_name], default=0), value, ["staging"])
        for v in self.versions:
            if v.task == task_name and "staging" in v.aliases:
                v.aliases.remove("staging")
        won = promote and promotes(TASKS[task_name], value, old.value if old else None)
        if won:
            if old:
                old.aliases.remove("champion")
            new.aliases.append("champion")
        self.versions.append(new)
        self.path.write_text(json.dumps([asdict(v) for v in self.versions]))
        return new, won
