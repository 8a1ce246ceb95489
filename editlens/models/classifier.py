"""The revert classifier: gradient-boosted trees of Spark ML on assembled features."""

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.operators.aggregates import class_weights
from editlens.operators.joins import unpivot_scores
from editlens.operators.revisions import fill_missing_features
from editlens.operators.sampling import split_by_day, split_stratified
from editlens.operators.slices import eval_metric_set
from editlens.session import materialize

BALANCED = "is_balanced"
#: Feature values that a task of the training holds at most, and the least that are worth a task.
MOST_VALUES, LEAST_VALUES = 4_000_000, 200_000


@dataclass(frozen=True)
class TrainingSettings:
    """Size of the model. All rounds are trained; `stop_share` of the training rows decides after which their loss is least.

    `bins` is a least number; a category with more values gets as many as it needs.
    """

    rounds: int = 100
    step: float = 0.1
    depth: int = 6
    bins: int = 128
    test_share: float = 0.1
    stop_share: float = 0.1
    seed: int = S.SEED
    balance_classes: bool = True
    keys: Sequence[str] = field(default_factory=lambda: tuple(S.KEYS))


def _index_name(name: str) -> str:
    return f"__i_{name}"


def _indexer(features: Sequence[str], categorical: Sequence[str]) -> list[StringIndexer]:
    """The stage that numbers categories, none without any; unseen categories get a number of their own."""
    cats = [c for c in features if c in categorical]
    return [StringIndexer(inputCols=cats, outputCols=[_index_name(c) for c in cats], handleInvalid="keep")] if cats else []


def _assembler(features: Sequence[str], categorical: Sequence[str]) -> VectorAssembler:
    inputs = [_index_name(c) if c in categorical else c for c in features]
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")


def assembler_stages(features: Sequence[str], categorical: Sequence[str]) -> list:
    """Stages that turn feature columns into one vector."""
    return [*_indexer(features, categorical), _assembler(features, categorical)]


def assemble_features(
    df: DataFrame, features: Sequence[str], categorical: Sequence[str] = tuple(S.CATEGORICAL_FEATURES)
) -> DataFrame:
    """Adds the feature vector, missing values as −1."""
    filled = fill_missing_features(df, features)
    return Pipeline(stages=assembler_stages(features, categorical)).fit(filled).transform(filled)


def _weighted(df: DataFrame, label: str, balance: bool) -> DataFrame:
    """Adds the class weight of each row as the training part alone gives it; two classes, so it is an expression."""
    if not balance:
        return df.withColumn("__weight", F.lit(1.0))
    weight = F.lit(1.0)
    for row in class_weights(df.where(~F.col("__held_out")), label).collect():  # one row per class
        weight = F.when(F.col(label) == row[label], row["weight"]).otherwise(weight)
    return df.withColumn("__weight", weight)


def _bins(indexers: Sequence[StringIndexerModel], features: Sequence[str], least: int) -> int:
    """Enough bins for the category with the most values, the one for unseen values included."""
    sizes = [len(v) + 1 for stage in indexers for c, v in zip(stage.getInputCols(), stage.labelsArray) if c in features]
    return max([least, *sizes])


def _training_rows(
    df: DataFrame, features: Sequence[str], label: str, settings: TrainingSettings, part: str | None
) -> tuple[DataFrame, int]:
    """Filled features of the training rows with `__label`, `__held_out` (decides when to stop) and `__weight`, and their number.

    Training passes over its rows many times, so they are written once, and read from there.
    """
    names = [f"`{c}`" for c in features]
    keys = [c for c in settings.keys if c not in features]
    mine = df if part is None else df.where(F.col(part) == "train").drop(part)
    wanted = mine.where(F.col(label).isNotNull()).select(*names, *keys, F.col(label).cast("int").alias("__label"))
    written = materialize(fill_missing_features(wanted, features).repartition(*settings.keys), "training")
    rows = split_stratified(written, settings.stop_share, "__label", settings.keys, settings.seed)
    used = rows.select(*names, "__label", (F.col("part") == "test").alias("__held_out"))
    return _weighted(used, "__label", settings.balance_classes), written.count()


def _tasks(rows: DataFrame, n_rows: int, width: int) -> int:
    """How many tasks so many rows are worth; below two, rows stay where they are."""
    values = n_rows * width
    return max(-(-values // MOST_VALUES), min(rows.sparkSession.sparkContext.defaultParallelism, values // LEAST_VALUES))


def _spread(rows: DataFrame, n_rows: int, width: int) -> DataFrame:
    """The rows dealt to tasks by their number: a file holds many of them in few bytes, and would be one task's work.

    What trees hold of a row grows with its features. Few rows stay where they are. Rows are dealt by their place, as they come
    from files in a fixed order; keys may repeat, and dealing in turn would sort them.
    """
    tasks = _tasks(rows, n_rows, width)
    if tasks < 2:
        return rows
    return rows.withColumn("__place", F.monotonically_increasing_id()).repartition(tasks, "__place").drop("__place")


def _first_rounds(trees: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model after n rounds, which Spark has no call for."""
    jvm = SparkContext._active_spark_context._jvm
    kept = JavaWrapper._new_java_array([t._java_obj for t in trees.trees[:n]], jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel)
    weights = JavaWrapper._new_java_array(trees.treeWeights[:n], jvm.double)
    name = "org.apache.spark.ml.classification.GBTClassificationModel"
    cut = JavaWrapper._new_java_obj(name, trees.uid, kept, weights, trees.numFeatures, trees.numClasses)
    return trees._copyValues(GBTClassificationModel(cut))


def _fit_trees(assembled: DataFrame, bins: int, settings: TrainingSettings) -> GBTClassificationModel:
    """Trains all rounds and keeps those up to the least loss of the held-out rows.

    Spark's own validation ends training at the first round that gains less than a set share, on noisy labels after a few.
    """
    trees = GBTClassifier(
        labelCol="__label", featuresCol="features", weightCol="__weight",
        maxIter=settings.rounds, stepSize=settings.step, maxDepth=settings.depth, maxBins=bins, seed=settings.seed,
    ).fit(assembled.where(~F.col("__held_out")))
    losses = list(trees.evaluateEachIteration(assembled.where(F.col("__held_out"))))
    best = losses.index(min(losses)) + 1
    return trees if best == len(losses) else _first_rounds(trees, best)


def train_classifier(
    df: DataFrame,
    features: Sequence[str],
    categorical: Sequence[str] = tuple(S.CATEGORICAL_FEATURES),
    label: str = S.LABEL,
    settings: TrainingSettings = TrainingSettings(),
    part: str | None = None,
) -> PipelineModel:
    """Fits class-weighted boosted trees on the rows whose `part` is train (all rows without `part`).

    A stratified share of those rows decides when to stop; weights come from the others. Test rows are not seen at all.
    """
    rows, n_rows = _training_rows(df, features, label, settings, part)
    stages = Pipeline(stages=assembler_stages(features, categorical)).fit(rows).stages
    bins = _bins([s for s in stages if isinstance(s, StringIndexerModel)], features, settings.bins)
    return PipelineModel([*stages, _fit_trees(PipelineModel(stages).transform(_spread(rows, n_rows, len(features))), bins, settings)])


def train_and_test(
    df: DataFrame,
    features: Sequence[str],
    categorical: Sequence[str] = tuple(S.CATEGORICAL_FEATURES),
    label: str = S.LABEL,
    settings: TrainingSettings = TrainingSettings(),
) -> tuple[PipelineModel, DataFrame]:
    """A model of a stratified train part, and the scored rows of the test part, which it has not seen."""
    labelled = df.where(F.col(label).isNotNull()).withColumn("__class", F.col(label).cast("int"))
    split = split_stratified(labelled, settings.test_share, "__class", settings.keys, settings.seed).drop("__class")
    model = train_classifier(split, features, categorical, label, settings, part="part")
    return model, predict_scores(model, split.where(F.col("part") == "test").drop("part"), features)


def predict_scores(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds `predict_score`, the probability of a revert; all other columns stay as they are."""
    packed = df.select(F.struct("*").alias("__row"), *[f"`{c}`" for c in features])
    scored = model.transform(fill_missing_features(packed, features))
    return scored.select("__row.*", vector_to_array("probability")[1].alias("predict_score"))


def feature_importance(model: PipelineModel, features: Sequence[str], top: int = 30) -> DataFrame:
    """The most important features of a model, largest first."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(features, values)]
    table = SparkSession.active().createDataFrame(rows, "feature_name string, feature_importance double")
    return table.orderBy(F.desc("feature_importance"), F.asc("feature_name")).limit(top)


def save_model(model: PipelineModel, path: str) -> None:
    """Writes a model."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Reads a model back."""
    return PipelineModel.load(path)


def feature_set_ablation(
    train: DataFrame,
    test: DataFrame,
    feature_sets: dict[str, Sequence[str]],
    categorical: Sequence[str] = tuple(S.CATEGORICAL_FEATURES),
    label: str = S.LABEL,
    settings: TrainingSettings = TrainingSettings(),
) -> DataFrame:
    """One model per named feature set; its metrics on full and balanced test rows, in total and per wiki.

    Rows are split, weighted and indexed once for all sets; the test rows get a score per set and are evaluated together.
    Sets whose rows leave cores idle are trained side by side.
    """
    every = list(dict.fromkeys(c for features in feature_sets.values() for c in features))
    rows, n_rows = _training_rows(train, every, label, settings, None)
    index = PipelineModel([stage.fit(rows) for stage in _indexer(every, categorical)])
    rows = materialize(index.transform(rows), "indexed")
    kept = F.struct(*[c for c in dict.fromkeys([label, BALANCED, S.WIKI])])
    scored = index.transform(fill_missing_features(test.select(kept.alias("__row"), *[f"`{c}`" for c in every]), every))

    def fit(features: Sequence[str]) -> tuple[VectorAssembler, GBTClassificationModel]:
        assembler = _assembler(features, categorical)
        spread = _spread(rows.select("__label", "__held_out", "__weight", *[f"`{c}`" for c in assembler.getInputCols()]), n_rows, len(features))
        return assembler, _fit_trees(assembler.transform(spread), _bins(index.stages, features, settings.bins), settings)

    spark = rows.sparkSession
    at_once = max(1, spark.sparkContext.defaultParallelism // max(1, _tasks(rows, n_rows, max(map(len, feature_sets.values())))))
    with ThreadPoolExecutor(at_once) as pool:
        fitted = [pool.submit(inheritable_thread_target(spark)(fit), features) for features in feature_sets.values()]
        models = [x.result() for x in fitted]
    names = {}
    for i, (name, (assembler, trees)) in enumerate(zip(feature_sets, models)):
        scored = trees.transform(assembler.transform(scored)).withColumn(f"__s_{i}", vector_to_array("probability")[1])
        scored = scored.drop("features", "rawPrediction", "probability", "prediction")
        names[f"__s_{i}"] = name
    long = unpivot_scores(scored.select("__row.*", *names), [label, BALANCED, S.WIKI], names).withColumnRenamed("model", "feature_set")
    return eval_metric_set(long, label, "score", BALANCED, ["feature_set"])


def meta_model(
    df: DataFrame,
    features: Sequence[str],
    base_scores: Sequence[str],
    extra: Sequence[str] = (),
    categorical: Sequence[str] = tuple(S.CATEGORICAL_FEATURES),
    label: str = S.LABEL,
    settings: TrainingSettings = TrainingSettings(),
    train_days: tuple[int, int] = (1, 5),
    test_days: tuple[int, int] = (6, 7),
) -> DataFrame:
    """Stacks base model scores (and extra features) as inputs of a new model: trained on some days, scored on others.

    Returns the test rows with `meta_pred` beside the base scores.
    """
    split = split_by_day(df, train_days, test_days)
    inputs = [*features, *base_scores, *[c for c in extra if c not in features]]
    model = train_classifier(split, inputs, categorical, label, settings, part="part")
    scored = predict_scores(model, split.where(F.col("part") == "test"), inputs)
    return scored.withColumnRenamed("predict_score", "meta_pred")
