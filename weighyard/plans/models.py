"""Day models on MLlib: two forest regressors and a forest classifier on scaled features."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weighyard.functions.layers import replace
from weighyard.operators.training import FEATURES, label_columns, ml_features, training_records, training_table
from weighyard.plans.joins import settle
from weighyard.session import path_exists
from weighyard.sources.training_log import append_training_log, read_training_log

TREES = 50
SEED = 42
MIN_DAYS = 10
SCALER = "scaler"
#: The log of committed runs in the folder of a training job.
HISTORY = "training_history"
# name -> label, prediction column, class of the saved model
FORESTS = {
    "tons": ("label_tons", "predicted_tons", RandomForestRegressionModel),
    "fresh": ("label_fresh", "predicted_fresh", RandomForestRegressionModel),
    "good": ("label_good", "predicted_good", RandomForestClassificationModel),
}


class NotEnoughDays(ValueError):
    """Fewer days with a baseline than training needs."""


def _forest(name, trees, depth):
    label, prediction, _ = FORESTS[name]
    common = dict(featuresCol="scaled", labelCol=label, predictionCol=prediction,
                  numTrees=trees, seed=SEED, maxDepth=depth)
    if name == "good":
        return RandomForestClassifier(
            probabilityCol="good_probability", rawPredictionCol="good_votes", **common)
    # A regression tree looks at every feature at each split.
    return RandomForestRegressor(featureSubsetStrategy="all", **common)


def _fit(rows, days, trees, depth, min_days):
    if days < min_days:
        raise NotEnoughDays(f"{days} days with a baseline, {min_days} needed")
    scaler = Pipeline(stages=[
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
    ]).fit(rows)
    scaled = scaler.transform(rows)
    return {SCALER: scaler, **{name: _forest(name, trees, depth).fit(scaled) for name in FORESTS}}


def fit_models(table, trees=TREES, depth=10, min_days=MIN_DAYS):
    """Fit scaler and models on a training table; too few days raise NotEnoughDays.

    The table is one row per day and is settled once, so that each tree level reads the
    stored rows instead of going back to the tickets.
    """
    rows = settle(table)
    return _fit(rows, rows.count(), trees, depth, min_days)


def save_models(models, folder):
    for name, model in models.items():
        model.write().overwrite().save(f"{folder.rstrip('/')}/{name}")


def load_models(folder):
    """Saved models, or, from the folder of `train_job`, those of its last committed run."""
    folder, spark = folder.rstrip("/"), SparkSession.active()
    if path_exists(spark, f"{folder}/{HISTORY}"):
        return committed_models(spark, folder)
    return {SCALER: PipelineModel.load(f"{folder}/{SCALER}"),
            **{name: kind.load(f"{folder}/{name}") for name, (_, _, kind) in FORESTS.items()}}


def predict(models, days):
    """Day records with predicted_tons, predicted_fresh and p_good (probability of a good day)."""
    rows = models[SCALER].transform(ml_features(days))
    for name in FORESTS:
        rows = models[name].transform(rows)
    chances = vector_to_array("good_probability")
    good = F.when(F.size(chances) > 1, chances[1]).otherwise(0.5)
    return rows.withColumn("p_good", good).drop("features", "scaled", "good_votes", "good_probability")


def predict_outlook(models, days):
    """Predictions under a fixed context of 12 even hours."""
    return predict(models, replace(days, {"active_hours": "12", "peak_tons": "tons / 12"}))


def run_name(start, end, leak_free=False):
    """The default name of a run: runs over the same range with the same kind of features replace one another."""
    return f"{start}_{end}{'_leak-free' if leak_free else ''}".replace("-", "")


def train_job(tickets, start, end, folder, trained_at=None, trees=TREES, depth=10, leak_free=False, run_id=None):
    """Tickets of a range -> records -> saved models -> a log line. Returns the models.

    The run is a commit: models are staged under <folder>/runs/<run_id>, and the log line, written last,
    makes them count. A run that breaks off leaves no line; repeated, it replaces its models and its line.
    """
    spark, folder = tickets.sparkSession, folder.rstrip("/")
    run_id = run_id or run_name(start, end, leak_free)
    records = settle(training_records(tickets, start, end))
    used = records.agg(F.count(F.lit(1)).alias("days"), F.sum("tickets").alias("tickets")).first()
    models = _fit(training_table(records, leak_free), used["days"], trees, depth, MIN_DAYS)
    staged = f"{folder}/runs/{run_id}"
    save_models(models, staged)
    when = trained_at or spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).first()[0]
    append_training_log(spark, f"{folder}/{HISTORY}", when, start, end,
                        used["days"], used["tickets"], "valid tickets, all columns", staged, run_id=run_id)
    return models


def committed_models(spark, folder, run_id=None):
    """The models of a committed run; by default those of the run trained last (ties: greatest run id)."""
    log = read_training_log(spark, f"{folder.rstrip('/')}/{HISTORY}")
    chosen = (log if run_id is None else log.where(F.col("run_id") == run_id)).orderBy(
        F.desc("trained_at"), F.desc("run_id")).first()
    if chosen is None:
        raise LookupError(f"no committed run {run_id or ''} in {folder}")
    return load_models(chosen["model_path"])


# --- facts about fitted models ----------------------------------------------------------

def scaler_stats(models, spark):
    """(feature, mean, std) as the scaler holds them: one row per feature."""
    scaler = models[SCALER].stages[-1]
    rows = [(name, float(mean), float(std)) for name, mean, std in zip(FEATURES, scaler.mean, scaler.std)]
    return spark.createDataFrame(rows, "feature string, mean double, std double")


#: Model -> label, its prediction, and what the prediction is measured against: the label's mean or, for the class, its rate.
JUDGED = {"tons": ("label_tons", "predicted_tons"), "fresh": ("label_fresh", "predicted_fresh"), "good": ("label_good", "p_good")}


def model_facts(models, days, reloaded=None):
    """One row per model over scored days: label range, squared error against that of the mean, and prediction range.

    Forests average labels, so no prediction leaves the label range. With `reloaded` models the
    predictions of both must be the same on every day.
    """
    rows = settle(label_columns(predict(models, days)))
    again = None if reloaded is None else predict(reloaded, days).select(
        "report_date", *[F.col(p).alias(f"again_{p}") for _, p in JUDGED.values()])
    rows = rows if again is None else settle(rows.join(again, "report_date"))
    facts = []
    for name, (label, prediction) in JUDGED.items():
        same = f"bool_and({prediction} = again_{prediction})" if again is not None else "CAST(NULL AS BOOLEAN)"
        facts.append(rows.selectExpr(*[
            f"'{name}' AS model", "count(1) AS days", f"min({label}) AS label_min", f"max({label}) AS label_max",
            f"avg({label}) AS label_mean", f"var_pop({label}) AS mean_error",
            f"avg(pow({prediction} - {label}, 2)) AS model_error",
            f"min({prediction}) >= min({label}) - 1e-9D AND max({prediction}) <= max({label}) + 1e-9D AS inside",
            f"{same} AS same_after_reload"]))
    out = facts[0]
    for more in facts[1:]:
        out = out.union(more)
    return out.selectExpr("*", "model_error < mean_error AS better_than_mean")
