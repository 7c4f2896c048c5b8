"""Three-head models (fault yes/no, fault type, severity): boosted trees, random forests, one network."""

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType

from ..session import durable
from ..settings import BOOST_COLUMNS, BOOST_DEPTH, BOOST_RATE, BOOST_ROWS, BOOST_TREES, FOREST_TREES, LOSS_WEIGHTS
from . import boosting
from .boosting import BoostedTrees
from .joins import attach
from .monitor import postprocess
from .splits import class_weights

LABELS = ("y_fault", "y_type", "y_sev")


def feature_columns(features: DataFrame, ids=("flight_id", "w")) -> list[str]:
    return [c for c in features.columns if c not in (*ids, *LABELS, "is_test")]


def _assembler(columns) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features")


def _assembled(train: DataFrame, assembler) -> DataFrame:
    """Every head and iteration reads the assembled rows, so they are computed once."""
    labels = [F.col(c).cast("double").alias(c) for c in LABELS]
    return durable(assembler.transform(train).select("features", *labels))


def _outputs(head: str) -> dict[str, str]:
    return {"predictionCol": f"p_{head}", "rawPredictionCol": f"raw_{head}"}


def fit_boosted(train, columns, trees=BOOST_TREES, depth=BOOST_DEPTH, rate=BOOST_RATE, rows=BOOST_ROWS,
                share=BOOST_COLUMNS, seed=42, ids=("flight_id", "w")) -> BoostedTrees:
    """Boosted trees for the three heads, grown side by side on binned columns."""
    return boosting.fit(train, columns, ids, trees, depth, rate, rows, share, seed)


def fit_forest(train, columns, trees=FOREST_TREES, depth=30, seed=42) -> PipelineModel:
    """Random forests for the three heads, the classifiers with balanced class weights.

    Trees grow until their leaves are pure, or to depth 30, the deepest that MLlib takes.
    """
    assembler = _assembler(columns)
    data = _assembled(train, assembler)

    def weighted(label: str) -> DataFrame:
        weights = class_weights(data, label).select(label, "weight")
        # One weight per class; the classifier itself accepts at most 100 classes.
        return attach(data, weights, label, bound=100)

    common = {"featuresCol": "features", "numTrees": trees, "maxDepth": depth, "seed": seed}
    fault = RandomForestClassifier(
        labelCol="y_fault", probabilityCol="prob_fault", weightCol="weight", **_outputs("fault"), **common
    ).fit(weighted("y_fault"))
    kind = RandomForestClassifier(
        labelCol="y_type", probabilityCol="prob_type", weightCol="weight", **_outputs("type"), **common
    ).fit(weighted("y_type"))
    severity = RandomForestRegressor(labelCol="y_sev", predictionCol="p_sev", **common).fit(data)
    return PipelineModel([assembler, fault, kind, severity])


def inputs(model) -> list[str]:
    """The feature columns of a model, in training order."""
    return list(model.columns) if isinstance(model, BoostedTrees) else model.stages[0].getInputCols()


def _as_array(frame: DataFrame, column: str):
    return F.col(column) if isinstance(frame.schema[column].dataType, ArrayType) else vector_to_array(column)


def predict(model, features: DataFrame, keep=("flight_id", "w")) -> DataFrame:
    """(keep, fault_prob, fault_type, severity_continuous) and the derived label, level and type name."""
    scored = model.transform(features)
    scored = scored.select(
        *keep,
        F.get(_as_array(scored, "prob_fault"), F.lit(1)).alias("fault_prob"),
        F.col("p_type").cast("int").alias("fault_type"),
        F.col("p_sev").alias("severity_continuous"),
    )
    return postprocess(scored)


def save(model, path: str) -> None:
    if isinstance(model, BoostedTrees):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load(path: str):
    """The model and its feature columns in training order."""
    spark = SparkSession.active()
    try:
        spark.read.text(f"{path}/metadata").schema  # what a stored pipeline has
        model = PipelineModel.load(path)
    except AnalysisException:
        model = BoostedTrees.load(spark, path)
    return model, inputs(model)


def training_history(model: BoostedTrees, train: DataFrame, validation: DataFrame, run: str, factors=LOSS_WEIGHTS) -> DataFrame:
    """(run, epoch, train_loss, val_loss): the weighted sum of the three heads' losses after each boosting round."""

    def weighted(frame, name):
        total = sum((F.col(f"loss_{h}") * F.lit(w) for h, w in factors.items()), F.lit(0.0))
        return boosting.staged_losses(model, frame).select("epoch", total.alias(name))

    log = weighted(train, "train_loss").join(weighted(validation, "val_loss"), "epoch")
    return log.select(F.lit(run).alias("run"), "epoch", "train_loss", "val_loss")


def best_run(log: DataFrame) -> DataFrame:
    """One row: the run and epoch with the lowest validation loss."""
    best = F.min(F.struct("val_loss", "run", "epoch", "train_loss")).alias("b")
    return log.agg(best).select("b.run", "b.epoch", "b.train_loss", "b.val_loss")


def best_epochs(log: DataFrame) -> DataFrame:
    """The best epoch of every run and whether that run wins."""
    best = F.min(F.struct("val_loss", "epoch")).alias("b")
    runs = log.groupBy("run").agg(best).select("run", "b.epoch", "b.val_loss")
    winner = runs.agg(F.min(F.struct("val_loss", "run"))).scalar()
    return runs.withColumn("is_best", (winner["run"] == F.col("run")).cast("int"))


def principal_components(vectors: DataFrame, ids, vec="vec", k=2) -> tuple[DataFrame, list[float]]:
    """(ids, pc1, ...) of centred vectors and the share of variance of each component.

    The sign of a component is fixed so that its largest loading is positive.
    """
    data = durable(vectors.select(*ids, array_to_vector(vec).alias("raw")))
    centring = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(data)
    centred = centring.transform(data)
    model = PCA(k=k, inputCol="centred", outputCol="pc").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if column[abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]
    projected = model.transform(centred).withColumn("pc", vector_to_array("pc"))
    components = [(F.get("pc", F.lit(i)) * F.lit(s)).alias(f"pc{i + 1}") for i, s in enumerate(signs)]
    return projected.select(*ids, *components), [float(v) for v in model.explainedVariance]
