"""Classifiers, calibration and meta-labels on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.boosting import Boosted, BoostParams, fit_boosted
from barloom.operators.scan import positions

CLASSES = ("p_long", "p_short", "p_neutral")


def _inputs(features: Sequence[str]) -> list:
    filled = [f"{f}_in" for f in features]
    return [
        Imputer(inputCols=list(features), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="raw_in"),
        StandardScaler(inputCol="raw_in", outputCol="model_in", withMean=True),
    ]


def fit_classifier(
    train: DataFrame,
    features: Sequence[str],
    label: str = "label",
    kind: str = "forest",
    seed: int = 42,
    held: DataFrame | None = None,
    boost: BoostParams = BoostParams(),
) -> PipelineModel | Boosted:
    """Three classes with probabilities: a forest, a multinomial logistic regression, or boosted trees.

    Boosted trees end with the round that is best on `held`, rows that are not learned from; the other kinds don't look at them.
    """
    if kind == "boosted":
        rows = train.withColumn("is_valid", F.lit(False))
        if held is not None:
            rows = rows.unionByName(held.withColumn("is_valid", F.lit(True)))
        return fit_boosted(rows, features, label, "is_valid", len(CLASSES), boost)
    if kind == "forest":
        model = RandomForestClassifier(labelCol=label, featuresCol="model_in", numTrees=50, maxDepth=8, minInstancesPerNode=20, seed=seed)
    else:
        model = LogisticRegression(labelCol=label, featuresCol="model_in", family="multinomial", regParam=0.01)
    return Pipeline(stages=[*_inputs(features), model]).fit(train)


def _probabilities(model: PipelineModel | Boosted) -> Column:
    return F.col("probability") if isinstance(model, Boosted) else vector_to_array("probability")


def predict(model: PipelineModel | Boosted, rows: DataFrame) -> DataFrame:
    p = _probabilities(model)
    made = model.transform(rows)
    return made.select(*rows.columns, *[F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)).alias(c) for i, c in enumerate(CLASSES)])


def importance(model: PipelineModel | Boosted, features: Sequence[str], k: int) -> list[tuple[str, float]]:
    """The k features of highest importance."""
    if isinstance(model, Boosted):
        return model.importance(k)
    gains = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, gains.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]


def fit_return(train: DataFrame, features: Sequence[str], target: str) -> PipelineModel:
    """Regression of returns with a Huber loss."""
    model = LinearRegression(labelCol=target, featuresCol="model_in", loss="huber", maxIter=100)
    return Pipeline(stages=[*_inputs(features), model]).fit(train)


def fit_platt(rows: DataFrame, label: str = "label") -> dict[str, tuple[float, float] | None]:
    """Per class the slope and offset of a logistic regression of "is this class" on its probability.

    None where the class is absent or universal. The ridge is that of a unit prior: one over the number of rows.
    """
    n = rows.count()
    out: dict[str, tuple[float, float] | None] = {}
    for i, c in enumerate(CLASSES):
        part = VectorAssembler(inputCols=[c], outputCol="platt_in").transform(rows.withColumn("platt_y", (F.col(label) == i).cast("double")))
        share = part.agg(F.avg("platt_y")).first()[0]
        if not share or share == 1.0:
            out[c] = None
            continue
        m = LogisticRegression(labelCol="platt_y", featuresCol="platt_in", regParam=1.0 / n, standardization=False).fit(part)
        out[c] = (float(m.coefficients[0]), float(m.intercept))
    return out


def apply_platt(rows: DataFrame, fitted: dict[str, tuple[float, float] | None]) -> DataFrame:
    """Calibrated probabilities, each row's sum one again."""

    def one(c: str) -> Column:
        ab = fitted[c]
        return F.col(c) if ab is None else 1 / (1 + F.exp(-(ab[0] * F.col(c) + ab[1])))

    made = rows.withColumns({f"{c}_cal": one(c) for c in CLASSES})
    total = sum((F.col(f"{c}_cal") for c in CLASSES[1:]), F.col(f"{CLASSES[0]}_cal"))
    made = made.withColumn("cal_sum", F.when(total == 0, 1.0).otherwise(total))
    return made.withColumns({c: F.col(f"{c}_cal") / F.col("cal_sum") for c in CLASSES}).drop("cal_sum", *[f"{c}_cal" for c in CLASSES])


def time_split(rows: DataFrame, ts: str, tie: str, share: float = 0.8, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """rows with is_train: the first int(n * share) of each key in time."""
    placed = positions(rows, keys, [F.col(ts), F.col(tie)], "_place")
    key = F.struct(*keys, F.lit(0))
    counts = placed.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    made = placed.join(counts, key.eqNullSafe(F.col("_key")), "left")
    return made.select(*rows.columns, (F.col("_place") <= F.floor(F.col("_rows") * share)).alias("is_train"))


#: Boosted trees of the meta-label: smaller than those of the signals themselves.
META = BoostParams(rounds=500, patience=30, leaves=15, depth=5, min_rows=20)


def meta_label(
    signals: DataFrame,
    features: Sequence[str],
    fold: int,
    first_fold: int = 4,
    min_rows: int = 30,
    seed: int = 42,
    ts: str = "bar_close_ts",
    tie: str = "bar_id",
    boost: BoostParams = META,
) -> DataFrame:
    """Of one fold's signals: meta_proba, the chance that a signal wins, learned from earlier folds; 1 while there is too little.

    The last fifth of the earlier signals in time is not learned from: boosting ends with the round that is best on it.
    """
    train, here = signals.where(F.col("fold_id") < fold), signals.where(F.col("fold_id") == fold)
    classes = train.agg(F.count(F.lit(1)), F.countDistinct("win")).first()
    if fold < first_fold or classes[0] < min_rows or classes[1] < 2:
        return here.withColumn("meta_proba", F.lit(1.0))
    placed = time_split(train, ts, tie, 0.8, keys=()).withColumn("is_valid", ~F.col("is_train"))
    model = fit_boosted(placed, features, "win", "is_valid", 2, replace(boost, seed=seed))
    return model.transform(here).select(*here.columns, F.get(F.col("probability"), F.lit(1)).alias("meta_proba"))


def sequences(rows: DataFrame, features: Sequence[str], length: int = 96, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """rows with `window`: their last `length` feature vectors; rows with a short history, a null, or no label are left out."""
    w = Window.partitionBy(*keys).orderBy("bar_close_ts", "bar_id").rowsBetween(-(length - 1), 0)
    vector = F.array(*[F.col(f).cast("float") for f in features])
    made = rows.withColumn("window", F.collect_list(vector).over(w))
    whole = (F.size("window") == length) & ~F.exists("window", lambda v: F.exists(v, lambda x: x.isNull()))
    return made.where(whole & (F.col("label") != -1))


def standardised(rows: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features less the training rows' mean, over their population deviation (at least 1e-8)."""
    stats = train.agg(
        *[F.avg(f).alias(f"{f}_mean") for f in features],
        *[F.greatest(F.stddev_pop(f), F.lit(1e-8)).alias(f"{f}_dev") for f in features],
    )
    # one row
    made = rows.join(F.broadcast(stats), F.lit(True))
    return made.select(
        *[c for c in rows.columns if c not in features],
        *[((F.col(f) - F.col(f"{f}_mean")) / F.col(f"{f}_dev")).alias(f) for f in features],
    )
