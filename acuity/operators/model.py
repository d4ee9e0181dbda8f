"""The mortality model: training, storage, scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acuity import schemas
from acuity.functions import scalars as S
from acuity.operators import forest as trees
from acuity.operators import risk
from acuity.operators.clean import drop_missing
from acuity.operators.skew import HOT_ROWS
from acuity.schemas import STAY, TARGET
from acuity.sources.storage import is_stored, stage

_IMPORTANCE = T.StructType(
    [T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())]
)
_SCALE = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("deviation", T.DoubleType()),
    ]
)


@dataclass
class RiskModel:
    """A fitted model and the numbers learnt with it."""

    stages: PipelineModel
    features: list[str]
    medians: dict[str, float]
    scale: dict[str, tuple[float, float]]


@dataclass
class Training:
    model: RiskModel
    summary: DataFrame
    auc: DataFrame
    report: DataFrame


def _inputs(features: Sequence[str], fill: dict[str, float]) -> SQLTransformer:
    """Stored stage that fills missing inputs and makes all of them plain numbers."""
    filled = ", ".join(
        f"CAST(coalesce(`{c}`, CAST('{fill.get(c, 0.0)!r}' AS DOUBLE)) AS DOUBLE) AS `_in_{c}`"
        for c in features
    )
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


def train(
    table: DataFrame,
    *,
    features: Sequence[str] = schemas.FEATURES,
    seed: int = 42,
    medians_from: str = "train",
    hot_rows: int = HOT_ROWS,
    **forest,
) -> Training:
    """Fit a balanced random forest on 80 % of the stays and evaluate it on the others.

    Medians come from the training rows (``medians_from="train"``) or the whole table
    (``"whole"``). ``forest`` overrides forest settings.
    """
    table = drop_missing(table, [TARGET]).withColumn(TARGET, F.col(TARGET).cast("int"))
    columns = [STAY, TARGET, "gender", "unittype"]
    encoded = {"gender_enc", "unittype_enc"}
    available = [c for c in features if c in table.columns or c in encoded]
    kept = stage(table.select(*columns, *[c for c in available if c not in encoded]), "inputs")
    split = stage(risk.stratified_split(kept, seed=seed, hot_rows=hot_rows), "split")
    train_rows, test_rows = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))

    codes = risk.fit_unit_codes(train_rows)
    base = train_rows if medians_from == "train" else split
    fill = risk.median_values(risk.encode(base, codes), available)
    inputs = _inputs(available, fill)
    # The codes enter as numbers, not as categories.
    assemble = VectorAssembler(inputCols=[f"_in_{c}" for c in available], outputCol="_features")
    settings = dict(
        numTrees=100, maxDepth=8, minInstancesPerNode=10, seed=seed,
        # each row keeps its place in every tree, so that no pass walks the trees from their roots again
        featureSubsetStrategy="sqrt", cacheNodeIds=True,
    ) | forest
    classifier = RandomForestClassifier(
        featuresCol="_features", labelCol=TARGET, weightCol="_weight",
        rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
        **settings,
    )
    before = PipelineModel(stages=[codes, inputs, assemble])
    prepared = before.transform(_ready(train_rows, available))
    fitted = classifier.fit(
        prepared.withColumn("_weight", risk.weight_column(train_rows)).select(
            "_features", TARGET, "_weight"
        )
    )
    scale = risk.scale_of(
        prepared.select(*[F.col(f"_in_{c}").alias(c) for c in available]), available
    )
    model = RiskModel(
        PipelineModel(stages=[codes, inputs, assemble, fitted]), available, fill, scale
    )
    scored = stage(score(test_rows, model, digits=None), "scored")
    return Training(
        model,
        risk.dataset_summary(split),
        risk.roc_auc(scored, "risk_score", hot_rows=hot_rows),
        risk.class_report(scored),
    )


def _ready(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Columns the stored stages expect; missing features are null."""
    encoded = {"gender_enc", "unittype_enc"}
    need = {c: T.DoubleType() for c in features if c not in encoded}
    need |= {"gender": T.StringType(), "unittype": T.StringType()}
    df = df.withColumns(
        {c: F.lit(None).cast(kind) for c, kind in need.items() if c not in df.columns}
    )
    return risk.with_unit(df).withColumn("gender_enc", S.male_flag(F.col("gender")))


def score(
    df: DataFrame, model: RiskModel, *, missing: str = "median", digits: int | None = 4
) -> DataFrame:
    """Add ``risk_score``, ``risk_label`` and ``prediction`` to every row.

    Missing features take the medians of the training, or 0 with ``missing="zero"``.
    """
    ready = _ready(df, model.features)
    if missing == "zero":
        ready = ready.fillna(0.0, [c for c in model.features if c in ready.columns])
    probability = vector_to_array("_probability")[1]
    shown = probability if digits is None else F.round(probability, digits)
    return model.stages.transform(ready).select(
        *df.columns,
        shown.alias("risk_score"),
        S.risk_label(probability).alias("risk_label"),
        F.col("_prediction").cast("int").alias("prediction"),
    )


def importances(spark: SparkSession, model: RiskModel) -> DataFrame:
    """Importance of every feature, one row per feature, highest first."""
    values = model.stages.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(model.features, values)]
    return spark.createDataFrame(rows, _IMPORTANCE).orderBy(F.desc("importance"), "feature")


def filled_inputs(df: DataFrame, model: RiskModel) -> DataFrame:
    """``df`` with what the trees see: a column ``_in_<feature>`` per feature, nothing missing."""
    codes, inputs = model.stages.stages[:2]
    return inputs.transform(codes.transform(_ready(df, model.features))).select(
        *df.columns, *[f"_in_{c}" for c in model.features]
    )


def score_by_nodes(df: DataFrame, model: RiskModel, nodes: DataFrame) -> DataFrame:
    """:func:`score` without the fitted classifier: its node table as one column expression."""
    score = trees.score_column(nodes, {c: f"_in_{c}" for c in model.features})
    return filled_inputs(df, model).select(*df.columns, score.alias("risk_score"))


def top_features(spark: SparkSession, model: RiskModel, n: int = schemas.TOP_FEATURES
                 ) -> DataFrame:
    return importances(spark, model).limit(n)


def save(spark: SparkSession, model: RiskModel, path: str) -> None:
    """Store the stages, the forest's nodes, and a row per feature with its median, mean and deviation."""
    model.stages.write().overwrite().save(f"{path}/stages")
    nodes = trees.stored_nodes(spark, f"{path}/stages", model.features)
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    rows = [(c, model.medians.get(c), *model.scale[c]) for c in model.features]
    spark.createDataFrame(rows, _SCALE).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/features"
    )


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The node table of a stored model."""
    return spark.read.parquet(f"{path}/nodes")


def load(spark: SparkSession, path: str) -> RiskModel:
    stages = PipelineModel.load(f"{path}/stages")
    rows = {r["feature"]: r for r in spark.read.parquet(f"{path}/features").collect()}
    features = [c.removeprefix("_in_") for c in stages.stages[2].getInputCols()]
    return RiskModel(
        stages,
        features,
        {c: rows[c]["median"] for c in features if rows[c]["median"] is not None},
        {c: (rows[c]["mean"], rows[c]["deviation"]) for c in features},
    )


def is_trained(spark: SparkSession, path: str) -> bool:
    """Whether a model is stored; the feature table is written last."""
    return is_stored(spark, f"{path}/features")
