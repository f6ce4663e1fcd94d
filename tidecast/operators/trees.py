"""Boosted trees and forests on the feature table, with Spark ML."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.config import QTY, STEP, BoostParams, ForecastConfig, lag_names, quoted, step_lag_names, target_name
from tidecast.operators.metrics import prediction_name
from tidecast.operators.recursion import recursive_forecast, series_state
from tidecast.staging import stage

CALENDAR = ["year", "month", "day", "week_of_year", "day_of_week"]
HOLIDAYS = ["is_national_holiday", "is_state_holiday"]
# Fixed value: trees without a depth limit stop at what Spark allows.
MAX_DEPTH = 30


def tree_features(cfg: ForecastConfig) -> list[str]:
    """Feature columns of the template table that trees train on."""
    return [STEP, *lag_names(cfg.lags), *step_lag_names(cfg.lags), *CALENDAR, *HOLIDAYS, "is_holiday", "year_freq"]


def vector_of(features: list[str]) -> Column:
    return array_to_vector(F.array(*[F.col(quoted(c)).cast("double") for c in features]))


def assembled(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """Adds the vector ``features``, and ``label`` if asked."""
    columns = {"features": vector_of(features)}
    if label:
        columns["label"] = F.col(quoted(label)).cast("double")
    return df.withColumns(columns)


def boosted_regressor(params: BoostParams, **kw) -> GBTRegressor:
    """``colsample`` is drawn per node here; depth is limited to 30 by Spark."""
    return GBTRegressor(
        featuresCol="features", labelCol="label", predictionCol="prediction",
        maxIter=params.n_estimators, stepSize=params.eta, maxDepth=params.max_depth,
        subsamplingRate=params.subsample, featureSubsetStrategy=str(params.colsample), seed=params.seed, **kw)


def _training(frame: DataFrame, features: list[str], label: str) -> DataFrame:
    return assembled(frame, features, label).select("features", "label")


def fit_boosted(frame: DataFrame, features: list[str], params: BoostParams, label: str = QTY):
    # The trainer makes one pass per tree level, so its input is kept.
    data = _training(frame, features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return boosted_regressor(params).fit(data)
    finally:
        data.unpersist()


class Continued:
    """A boosted model that goes on: trees fitted to what the model of the round before left of longer histories.

    Each added tree is fitted to the residual of all trees before it and counts ``eta`` times, which is
    what one more round of boosting does; nothing that was learned is learned again. The rows keep the
    model's value in a column, so a round evaluates its new trees only.
    """

    def __init__(self, first: GBTRegressionModel, params: BoostParams):
        self.first, self.params = first, params
        self.added: list[DecisionTreeRegressionModel] = []

    def predict(self, rows: DataFrame, name: str = "prediction", after: int | None = None) -> DataFrame:
        """Adds the value of the model to rows with ``features``; with ``after`` only that of the trees added after so many, without the first model."""
        out, total = rows, F.lit(0.0)
        if after is None:
            out = self.first.copy({self.first.predictionCol: "__first"}).transform(out)
            total = total + F.col("__first")
        names = []
        for k, tree in enumerate(self.added[after or 0:]):
            names.append(f"__tree{k}")
            out = tree.copy({tree.predictionCol: names[-1]}).transform(out)
            total = total + self.params.eta * F.col(names[-1])
        return out.withColumn(name, total).drop("__first", *names)

    def go_on(self, rows: DataFrame, trees: int) -> DataFrame:
        """Fits so many trees to ``rows`` (features, label, fitted), one after the other; returns the rows with their new value, staged."""
        p = self.params
        for _ in range(trees):
            residual = rows.withColumn("label", F.col("label") - F.col("fitted"))
            seed = p.seed + 1 + len(self.added)
            drawn = residual if p.subsample >= 1 else residual.sample(p.subsample, seed)
            self.added.append(DecisionTreeRegressor(maxDepth=min(p.max_depth, MAX_DEPTH), seed=seed).fit(drawn.select("features", "label")))
            more = self.predict(rows, "__more", len(self.added) - 1)
            rows = stage(more.withColumn("fitted", F.col("fitted") + F.col("__more")).drop("__more"), "boosted")
        return rows


def recursive_boosted(frame: DataFrame, demand: DataFrame, frequency: DataFrame, cfg: ForecastConfig,
                      params: BoostParams | None = None, refit: bool | str = False, model: GBTRegressionModel | None = None,
                      step_first: int = 0, refit_trees: int = 5) -> DataFrame:
    """(series, horizon, date, yhat) for the days after ``demand`` ends.

    ``frame`` are the training rows of the template table, ``frequency`` the year frequencies
    they were encoded with. ``refit`` trains again each round on the history plus the forecasts
    made so far; ``refit="warm"`` goes on from the model of the round before with ``refit_trees`` more trees
    fitted to its residuals; without it one model, given or fitted here, serves all rounds.
    """
    params, features = params or cfg.boost, tree_features(cfg)
    history = frame.select(*[F.col(quoted(c)) for c in features], QTY)
    year_freq, vector = known_frequency(frequency), vector_of(features)
    going: Continued | None = None
    seen: DataFrame | None = None  # rows with features, label and the value of the model so far

    def predict(rows: DataFrame, step: int) -> DataFrame:
        nonlocal history, model
        rows = rows.withColumn("year_freq", year_freq)
        if model is None or refit is True:
            model = fit_boosted(history, features, params)
        predicted = model.transform(rows.withColumn("features", vector)).drop("features")
        if refit:
            predicted = stage(predicted, "round")
            appended = predicted.withColumn(QTY, F.col("prediction")).select(
                *[F.col(quoted(c)) for c in history.columns])
            history = append_rows(history, appended)
        return predicted

    def predict_warm(rows: DataFrame, step: int) -> DataFrame:
        nonlocal going, seen
        if going is None:
            first = model or fit_boosted(history, features, params)
            going = Continued(first, params)
            seen = stage(going.predict(_training(history, features, QTY), "fitted"), "boosted")
        else:
            seen = going.go_on(seen, refit_trees)
        ready = going.predict(rows.withColumn("year_freq", year_freq).withColumn("features", vector))
        ready = stage(ready, "round")
        # A forecast is the quantity of its day from now on, which the model hits exactly.
        seen = seen.unionByName(ready.select("features", F.col("prediction").alias("label"), F.col("prediction").alias("fitted")))
        return ready.drop("features")

    return recursive_forecast(series_state(demand, cfg, step_first), predict_warm if refit == "warm" else predict, cfg)


def known_frequency(frequency: DataFrame) -> Column:
    """The learned frequencies as an expression on ``year``: a handful of calendar years, read once,
    so that no round of a forecast needs a join. A year never seen gives 0. The expression is one map
    lookup; the calendar bounds its size."""
    pairs = frequency.agg(F.map_from_entries(F.collect_list(F.struct("year", F.col("year_freq").cast("bigint")))).alias("m"))
    known = {int(y): int(n) for y, n in (pairs.first()["m"] or {}).items()}
    if not known:
        return F.lit(0).cast("bigint")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col("year")), F.lit(0)).cast("bigint")


def append_rows(history: DataFrame, rows: DataFrame) -> DataFrame:
    """History with the newly forecast rows; the quantity becomes fractional."""
    return history.withColumn(QTY, F.col(QTY).cast("double")).unionByName(rows)


def fit_per_horizon(frame: DataFrame, features: list[str], params: BoostParams, horizons: int = 14,
                    parallelism: int = 4) -> dict:
    """One independent boosted model per target day, several fits in flight at a time."""
    label = [target_name(h) for h in range(1, horizons + 1)]
    wide = assembled(frame, features).select("features", *[F.col(quoted(c)) for c in label])
    wide = wide.persist(StorageLevel.MEMORY_AND_DISK)

    def fit(h: int):
        data = wide.select("features", F.col(quoted(target_name(h))).cast("double").alias("label"))
        return boosted_regressor(params).fit(data)

    try:
        wide.count()
        with ThreadPoolExecutor(parallelism) as pool:
            return dict(zip(range(1, horizons + 1), pool.map(fit, range(1, horizons + 1))))
    finally:
        wide.unpersist()


def score_per_horizon(frame: DataFrame, features: list[str], models: dict) -> DataFrame:
    scored = assembled(frame, features)
    for h, model in models.items():
        scored = model.copy({model.predictionCol: prediction_name(h)}).transform(scored)
    return scored.drop("features")


def forest_pipeline(numeric: list[str], categorical: list[str], trees: int = 100, depth: int = MAX_DEPTH,
                    seed: int = 42, bootstrap: bool = True) -> Pipeline:
    """One-hot encoded categories beside untouched numbers, into a random forest.

    A category not seen in training falls into the indexer's extra slot, which the encoder
    drops: it becomes all zeros. Categories are gathered by the indexer, so they must be few
    (centers, flags), never a product id.
    """
    indexer = StringIndexer(inputCols=categorical, outputCols=[f"{c}_idx" for c in categorical],
                            handleInvalid="keep", stringOrderType="alphabetAsc")
    encoder = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical],
                            outputCols=[f"{c}_hot" for c in categorical], dropLast=True)
    assembler = VectorAssembler(inputCols=[*numeric, *[f"{c}_hot" for c in categorical]], outputCol="features")
    forest = RandomForestRegressor(featuresCol="features", labelCol="label", predictionCol="prediction",
                                   numTrees=trees, maxDepth=depth, seed=seed, bootstrap=bootstrap)
    return Pipeline(stages=[indexer, encoder, assembler, forest])


def plain_names(frame: DataFrame) -> DataFrame:
    """Feature names without '-' and '+', as ML stages want them: qty_d1, day_step_d1, y_d1."""
    return frame.withColumnsRenamed({
        c: c.replace("_D-", "_d").replace("_D+", "_d") for c in frame.columns if "_D-" in c or "_D+" in c})


def pooled_forest(train: DataFrame, score: DataFrame, categorical: list[str], numeric: list[str],
                  trees: int = 100, depth: int = MAX_DEPTH, seed: int = 42, bootstrap: bool = True) -> tuple[PipelineModel, DataFrame]:
    """Fits on all series together and scores another frame; both with plain names."""
    prepared = train.withColumns({"label": F.col(QTY).cast("double"),
                                  **{c: F.col(c).cast("string") for c in categorical}})
    prepared = prepared.select("label", *numeric, *categorical).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = forest_pipeline(numeric, categorical, trees, depth, seed, bootstrap).fit(prepared)
    finally:
        prepared.unpersist()
    scored = model.transform(score.withColumns({c: F.col(c).cast("string") for c in categorical}))
    return model, scored


def feature_importance(frame: DataFrame, features: list[str], trees: int = 250, depth: int = MAX_DEPTH,
                       seed: int = 0) -> DataFrame:
    """(feature, importance) of a forest, most important first. The vector is as long as the list."""
    data = _training(frame, features, QTY).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    finally:
        data.unpersist()
    rows = [(c, float(v)) for c, v in zip(features, model.featureImportances.toArray())]
    return frame.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")
