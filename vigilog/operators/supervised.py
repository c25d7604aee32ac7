"""Supervised detection with Spark ML: an anomaly classifier and, for the anomalies, a
classifier of the attack type."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilog.operators.features import finite
from vigilog.operators.quantile import order_statistic
from vigilog.session import stored

MODELS = ("random_forest", "gradient_boosting")
SEED = 42


def labelled_frame(samples: DataFrame, features: list[str]) -> DataFrame:
    """``id``, the features, Label (1 for anomalies) and AttackType."""
    return samples.select(
        "id",
        *[finite(F.col(f)).alias(f) for f in features],
        F.when(F.col("label") == "anomaly", 1).otherwise(0).alias("Label"),
        F.col("attack_type").alias("AttackType"),
    )


def hash_order(column: str = "id") -> Column:
    """A fixed random number below 2^52 for each row, exact as a double."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 13), 16, 10).cast("double")


def stratified_split(df: DataFrame, label: str = "Label", train: float = 0.8) -> DataFrame:
    """Column ``is_train``: in each class the share ``train`` of the rows that come first
    by hash. The limits are order statistics, so no class is sorted in one task."""
    ordered = df.withColumn("_order", hash_order())
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    limit = F.lit(-1.0)
    for row in sizes:
        wanted = int(row["n"] * train)
        if wanted:
            cut = order_statistic(ordered.filter(F.col(label) == row[label]), "_order", wanted - 1)
            limit = F.when(F.col(label) == row[label], cut).otherwise(limit)
    return ordered.withColumn("is_train", F.col("_order") <= limit).drop("_order")


def classifier(model: str, label: str, features: str, weight: str | None = None, classes: int = 2, suffix: str = ""):
    """The classifier of a model name; boosting of several classes is one-against-rest."""
    if model == "random_forest":
        forest = RandomForestClassifier(
            numTrees=100, maxDepth=10, minInstancesPerNode=2, seed=SEED, labelCol=label, featuresCol=features,
            predictionCol="prediction" + suffix, probabilityCol="probability" + suffix, rawPredictionCol="raw" + suffix,
        )
        return forest.setWeightCol(weight) if weight else forest
    if model == "gradient_boosting":
        boosting = GBTClassifier(
            maxIter=100, stepSize=0.1, maxDepth=5, minInstancesPerNode=2, seed=SEED, labelCol=label, featuresCol=features,
            predictionCol="prediction" + suffix,
        )
        if classes > 2:
            return OneVsRest(
                classifier=boosting, labelCol=label, featuresCol=features, predictionCol="prediction" + suffix,
                rawPredictionCol="raw" + suffix,
            )
        return boosting.setProbabilityCol("probability" + suffix).setRawPredictionCol("raw" + suffix)
    raise ValueError(f"unknown model type: {model}")


# A training partition should hold at least this many rows, and more while there is one for every core, up to the second number.
PARTITION_ROWS = 20_000
MOST_ROWS = 200_000


def balanced(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weights that give every class the same total.

    Boosting runs several jobs per round, so small data is packed into few partitions, and larger
    data into one per core: more would only add tasks to each of a thousand short stages.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}
    rows = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, rows / (len(counts) * n)).otherwise(weight)
    parts = max(1, min(rows // PARTITION_ROWS, max(df.sparkSession.sparkContext.defaultParallelism, rows // MOST_ROWS)))
    packed = df.coalesce(parts) if parts < df.rdd.getNumPartitions() else df
    return packed.withColumn(name, weight)


def assembled(features: list[str]) -> list:
    return [
        VectorAssembler(inputCols=features, outputCol="assembled"),
        StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True),
    ]


@dataclass
class SupervisedDetector:
    model: str
    features: list[str]
    anomaly: PipelineModel
    attack: PipelineModel | None

    def predict(self, df: DataFrame) -> DataFrame:
        """Anomaly, AnomalyProbability, AttackType, AttackConfidence and Confidence."""
        rows = df.withColumns({f: finite(F.col(f)) for f in self.features})
        scored = self.anomaly.transform(rows)
        scored = scored.withColumns(
            {"Anomaly": F.col("prediction").cast("int"), "AnomalyProbability": vector_to_array("probability")[1]}
        )
        if self.attack is None:
            kind, sure = F.lit("normal"), F.lit(0.0)
        else:
            scored = self.attack.transform(scored)
            found = F.col("Anomaly") == 1
            kind = F.when(found, F.col("attack_name")).otherwise("normal")
            sure = F.when(found, attack_confidence(scored.columns)).otherwise(0.0)
        scored = scored.withColumns({"AttackType": kind, "AttackConfidence": sure})
        return scored.withColumn(
            "Confidence", confidence_level(F.col("AnomalyProbability"), F.col("AttackConfidence"))
        ).select(*[c for c in df.columns if c not in RESULTS], *RESULTS)

    def attack_types(self, df: DataFrame) -> DataFrame:
        """Column ``AttackType``: the attack classifier's answer for every row, whatever the
        anomaly classifier says of it; null where no attack was seen in training."""
        if self.attack is None:
            return df.withColumn("AttackType", F.lit(None).cast("string"))
        rows = df.withColumns({f: finite(F.col(f)) for f in self.features})
        scaled = self.anomaly.stages[1].transform(self.anomaly.stages[0].transform(rows))
        return self.attack.transform(scaled).select(*[c for c in df.columns if c != "AttackType"], F.col("attack_name").alias("AttackType"))

    def importances(self) -> list[tuple[str, float]]:
        """Features by importance, largest first."""
        weights = self.anomaly.stages[-1].featureImportances.toArray()
        return sorted(zip(self.features, weights.tolist()), key=lambda x: (-x[1], x[0]))

    def save(self, spark: SparkSession, path: str) -> None:
        self.anomaly.write().overwrite().save(path + "/anomaly")
        if self.attack is not None:
            self.attack.write().overwrite().save(path + "/attack")
        settings = json.dumps({"model": self.model, "features": self.features, "attack": self.attack is not None})
        spark.createDataFrame([(settings,)], "settings string").coalesce(1).write.mode("overwrite").parquet(path + "/settings")


RESULTS = ["Anomaly", "AnomalyProbability", "AttackType", "AttackConfidence", "Confidence"]


def load_supervised(spark: SparkSession, path: str) -> SupervisedDetector:
    settings = json.loads(spark.read.parquet(path + "/settings").first()["settings"])
    attack = PipelineModel.load(path + "/attack") if settings["attack"] else None
    return SupervisedDetector(settings["model"], settings["features"], PipelineModel.load(path + "/anomaly"), attack)


def attack_confidence(columns: list[str]) -> Column:
    """The largest class probability; one-against-rest has raw margins, squashed to (0, 1)."""
    if "probability_attack" in columns:
        return F.array_max(vector_to_array("probability_attack"))
    if "raw_attack" in columns:
        return 1 / (1 + F.exp(-F.array_max(vector_to_array("raw_attack"))))
    return F.lit(1.0)


def confidence_level(probability: Column, attack: Column) -> Column:
    return F.when((probability > 0.8) & (attack > 0.7), 3).when((probability > 0.6) & (attack > 0.5), 2).otherwise(1)


def fit_anomaly_classifier(train: DataFrame, features: list[str], model: str) -> PipelineModel:
    rows = balanced(train, "Label")
    return fit_last(Pipeline(stages=assembled(features)).fit(rows), rows, model)


def fit_last(scaling: PipelineModel, rows: DataFrame, model: str) -> PipelineModel:
    """The anomaly classifier after stages that are fitted on the same balanced rows."""
    last = classifier(model, "Label", "features", "weight").fit(scaling.transform(rows))
    return PipelineModel(stages=[*scaling.stages, last])


def fit_supervised(train: DataFrame, features: list[str], model: str = "random_forest") -> SupervisedDetector:
    """Fit on ``labelled_frame`` rows. A class of attack that was not seen in training is
    kept as an own index by the indexer instead of failing.

    Both classifiers need the scaled features only, not each other. They are fitted at the same
    time, since the short stages of one alone keep few cores busy.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model type: {model}")
    rows = balanced(train, "Label")
    scaling = Pipeline(stages=assembled(features)).fit(rows)
    with ThreadPoolExecutor(1) as pool:
        anomaly = pool.submit(inheritable_thread_target(train.sparkSession)(fit_last), scaling, rows, model)
        attack = fit_attack_classifier(train.filter("Label = 1"), scaling, model)
        return SupervisedDetector(model, features, anomaly.result(), attack)


def fit_attack_classifier(attacks: DataFrame, scaling: PipelineModel, model: str) -> PipelineModel | None:
    """The classifier of the attack type on the true anomalies; none without any."""
    kinds = [r[0] for r in attacks.select("AttackType").distinct().orderBy("AttackType").collect()]
    if not kinds:
        return None
    indexer = StringIndexer(
        inputCol="AttackType", outputCol="attack_index", handleInvalid="keep", stringOrderType="alphabetAsc"
    ).fit(attacks)
    parts = indexer.transform(scaling.transform(attacks))
    attack_model = classifier(model, "attack_index", "features", "weight_attack", len(kinds), "_attack").fit(
        balanced(parts, "attack_index", "weight_attack")
    ) if len(kinds) > 1 else None
    if attack_model is None:
        return single_class(kinds[0], attacks)
    names = IndexToString(inputCol="prediction_attack", outputCol="attack_name", labels=indexer.labels + ["unknown"])
    return PipelineModel(stages=[attack_model, names])


def single_class(kind: str, rows: DataFrame) -> PipelineModel:
    """A pipeline that names the only known attack type."""
    from pyspark.ml.feature import SQLTransformer

    quoted = kind.replace("'", "''")
    named = SQLTransformer(statement=f"SELECT *, '{quoted}' AS attack_name FROM __THIS__")
    return Pipeline(stages=[named]).fit(rows)


def hybrid_predict(df: DataFrame, supervised: SupervisedDetector | None, unsupervised) -> DataFrame:
    """The supervised verdict where a classifier is fitted, else the unsupervised one."""
    if supervised is not None:
        return supervised.predict(df)
    return unsupervised.predict(df)


def confusion(predictions: DataFrame, label: str = "Label", prediction: str = "Anomaly") -> DataFrame:
    return predictions.groupBy(F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    classes = counts.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("true"), F.lit(0).cast("long").alias("called")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("true"), F.col("n").alias("called")),
    ))).groupBy("class").agg(F.sum("hit").alias("hit"), F.sum("true").alias("support"), F.sum("called").alias("called"))
    precision, recall = F.try_divide("hit", "called"), F.try_divide("hit", "support")
    zero = F.lit(0.0)
    return classes.select(
        "class", F.coalesce(precision, zero).alias("precision"), F.coalesce(recall, zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("called") + F.col("support")), zero).alias("f1"), "support", "hit",
    )


def overall_metrics(counts: DataFrame, positive: str = "1") -> DataFrame:
    """Accuracy, F1 of the positive class and F1 weighted by support."""
    report = class_report(counts)
    total = F.sum("support")
    return report.agg(
        F.try_divide(F.sum("hit"), total).alias("accuracy"),
        F.coalesce(F.max(F.when(F.col("class") == positive, F.col("f1"))), F.lit(0.0)).alias("f1_score"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), total).alias("f1_weighted"),
        total.alias("n_samples"),
    )


def stratified_folds(df: DataFrame, folds: int, label: str = "Label") -> DataFrame:
    """Column ``fold``: each class is cut by hash order into parts whose sizes differ by one
    at most. The cuts are order statistics, so no class is sorted in one task."""
    ordered = df.withColumn("_order", hash_order())
    fold = F.lit(0)
    for row in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect():
        own = ordered.filter(F.col(label) == row[label])
        for k in range(1, folds):
            last = row["n"] * k // folds  # rows before the k-th cut
            if last:
                above = (F.col(label) == row[label]) & (F.col("_order") > order_statistic(own, "_order", last - 1))
            else:
                above = F.col(label) == row[label]
            fold = fold + above.cast("int")
    return ordered.withColumn("fold", fold).drop("_order")


def cross_validation(df: DataFrame, features: list[str], model: str = "random_forest", folds: int = 5) -> list[float]:
    """F1 of the positive class for each stratified fold of the rows, the training part."""
    rows = df.count()
    folds = min(folds, rows // 2)
    if rows <= 10 or folds < 2:
        return []
    placed = stored(stratified_folds(df, folds))
    scores = []
    for fold in range(folds):
        anomaly = fit_anomaly_classifier(placed.filter(F.col("fold") != fold), features, model)
        detector = SupervisedDetector(model, features, anomaly, None)
        held = detector.predict(placed.filter(F.col("fold") == fold))
        scores.append(overall_metrics(confusion(held)).first()["f1_score"])
    return scores


def cross_validation_summary(spark: SparkSession, scores: list[float]) -> DataFrame:
    rows = spark.createDataFrame([(float(s),) for s in scores], "f1 double")
    return rows.agg(F.avg("f1").alias("binary_cv_mean"), F.stddev_pop("f1").alias("binary_cv_std"), F.count("f1").alias("folds"))


def train_from_samples(samples: DataFrame, features: list[str], model: str = "random_forest", train: float = 0.8):
    """Split, fit and evaluate: the detector, its predictions of the test rows, metrics."""
    frame = stored(stratified_split(labelled_frame(samples, features)))
    detector = fit_supervised(frame.filter("is_train"), features, model)
    tested = stored(detector.predict(frame.filter("not is_train").withColumnRenamed("AttackType", "TrueAttackType")))
    return detector, tested, overall_metrics(confusion(tested))


def attack_report(detector: SupervisedDetector, tested: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of the attack types over the true anomalies of the
    test rows (``Label`` and ``TrueAttackType``), found by the anomaly classifier or not."""
    true = tested.filter("Label = 1")
    return class_report(confusion(detector.attack_types(true), "TrueAttackType", "AttackType"))


def train_from_dataset(spark: SparkSession, path: str, dataset: str, features: list[str], model: str = "random_forest"):
    """From a stored labelled dataset (see ``sources.results``): the detector, its predictions
    of the test part, and one row of metrics of both classifiers and of the cross-validation
    inside the training part."""
    from vigilog.sources.results import load_samples

    samples = load_samples(spark, path, dataset)
    detector, tested, metrics = train_from_samples(samples, features, model)
    attacks = attack_report(detector, tested)
    total = F.sum("support")
    weighted = attacks.agg(
        F.try_divide(F.sum("hit"), total).alias("attack_accuracy"), F.try_divide(F.sum(F.col("f1") * F.col("support")), total).alias("attack_f1_weighted"), total.alias("attack_samples")
    )
    train = stratified_split(labelled_frame(samples, features)).filter("is_train").drop("is_train")
    folds = cross_validation_summary(spark, cross_validation(train, features, model))
    found = weighted.first().asDict() | folds.first().asDict()
    return detector, tested, metrics.select("*", *[F.lit(v).alias(k) for k, v in found.items()])
