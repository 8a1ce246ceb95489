"""Default text models: hashed words with inverse document frequencies and a linear model, all Spark ML.

They take the place of a large language model; any other scorer can be plugged in with `score_fragments`.
"""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.operators.metrics import binary_metrics, rmse
from editlens.operators.sampling import split_random, split_stratified
from editlens.session import materialize

WORD_GAPS = r"[^\p{L}\p{N}]+"


def _word_stages(column: str, width: int) -> list:
    return [
        RegexTokenizer(inputCol=column, outputCol=f"__w_{column}", pattern=WORD_GAPS, minTokenLength=1),
        HashingTF(inputCol=f"__w_{column}", outputCol=f"__t_{column}", numFeatures=width),
        IDF(inputCol=f"__t_{column}", outputCol=f"__v_{column}"),
    ]


def _prepared(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})


def train_text_scorer(
    rows: DataFrame, pair: bool = False, regression: bool = False, width: int = 1 << 18, rounds: int = 20,
) -> PipelineModel:
    """Fits one text model. Input columns: `text` (and `text_pair`), `label`. Regression for titles.

    Training passes over its rows many times, so they are written once, evenly spread, and read from there.
    """
    columns = ["text", "text_pair"] if pair else ["text"]
    stages = [s for c in columns for s in _word_stages(c, width)]
    stages.append(VectorAssembler(inputCols=[f"__v_{c}" for c in columns], outputCol="features"))
    if regression:
        stages.append(LinearRegression(labelCol="label", maxIter=rounds, regParam=0.1))
    else:
        stages.append(LogisticRegression(labelCol="label", maxIter=rounds, regParam=0.01))
    spread = _prepared(rows, columns).select(*columns, "label").repartition(*columns)
    return Pipeline(stages=stages).fit(materialize(spread, "texts"))


def score_texts(model: PipelineModel, fragments: DataFrame, pair: bool = False) -> DataFrame:
    """Raw scores `s_0`, `s_1` per fragment (only `s_0` for a regression), without leaving the JVM."""
    columns = ["text", "text_pair"] if pair else ["text"]
    keep = [c for c in fragments.columns]
    scored = model.transform(_prepared(fragments, columns))
    if "rawPrediction" not in scored.columns:
        return scored.select(*keep, F.col("prediction").alias("s_0"))
    raw = vector_to_array("rawPrediction")
    return scored.select(*keep, raw[0].alias("s_0"), raw[1].alias("s_1"))


def hold_out_quality(
    rows: DataFrame, keys: list[str], pair: bool = False, regression: bool = False, share: float = 0.05,
    width: int = 1 << 18, rounds: int = 20, seed: int = S.SEED,
) -> tuple[PipelineModel, DataFrame]:
    """Trains on most rows and measures on the rest: accuracy and F1, or the root mean squared error."""
    if regression:
        split = split_random(rows, share, keys, seed)
    else:
        split = split_stratified(rows, share, "label", keys, seed)
    model = train_text_scorer(split.where("part = 'train'"), pair, regression, width, rounds)
    tested = score_texts(model, split.where("part = 'test'"), pair)
    if regression:
        return model, rmse(tested, "label", "s_0")
    larger = tested.withColumn("score", (F.col("s_1") > F.col("s_0")).cast("double"))
    return model, binary_metrics(larger, [], "label").select("n", "accuracy", "f1")
