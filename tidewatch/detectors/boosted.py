"""Supervised detector: boosted trees, class-weighted. They are grown by ``boosting`` and kept as a model of MLlib."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.detectors.base import Detector
from tidewatch.detectors.boosting import boost, library_model
from tidewatch.detectors.trees import TreeTable
from tidewatch.operators.calibrate import threshold_max_f1
from tidewatch.operators.features import require_columns
from tidewatch.operators.profile import class_weights
from tidewatch.session import remove_at_exit, shared_folder


class BoostedTrees(Detector):
    kind = "boosted"

    def __init__(self, features: list[str], trees: int = 300, depth: int = 6, rate: float = 0.05,
                 row_share: float = 0.8, column_share: float = 0.8, seed: int = 42):
        super().__init__(features)
        self.trees, self.depth, self.rate, self.seed = trees, depth, rate, seed
        self.row_share, self.column_share = row_share, column_share
        self.model: GBTClassificationModel | None = None
        self.nodes: pd.DataFrame | None = None

    def _vector(self):
        return array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features]))

    def fit(self, train: DataFrame, label: str, validation: DataFrame | None = None,
            min_recall: float = 0.75) -> BoostedTrees:
        """Train; with validation rows also search the threshold of best F1 above the recall floor.

        Splits of a tree do not change under scaling, so the features are taken as they are.
        """
        require_columns(train, self.features)
        weight = float(class_weights(train, label).first()["anomaly_weight"] or 1.0)
        learner = GBTClassifier(
            maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, subsamplingRate=self.row_share,
            featureSubsetStrategy=str(self.column_share), weightCol="weight", seed=self.seed,
        )
        made, limits = boost(train.where(F.col(label).cast("double").isNotNull()), self.features, label, weight, self.trees, self.depth, self.rate,
                             self.row_share, self.column_share, self.seed)
        self.model = library_model(train.sparkSession, learner, made, limits, self.rate)
        self.nodes = None
        if validation is not None:
            self.threshold = threshold_max_f1(self.score(validation), "score", label, min_recall).first()["threshold"]
        return self

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Probability of an anomaly."""
        own = self.model.copy().setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction")
        out = own.transform(df.withColumn("_features", self._vector()))
        return out.withColumn(name, F.get(vector_to_array("_probability"), 1)).drop(
            "_features", "_probability", "_raw", "_prediction"
        )

    def feature_importance(self, df: DataFrame, top: int | None = None) -> DataFrame:
        """Gain importance per feature, largest first."""
        rows = list(zip(self.features, self.model.featureImportances.toArray().tolist()))
        table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
        ordered = table.orderBy(F.desc("importance"), "feature")
        return ordered if top is None else ordered.limit(top)

    def node_table(self) -> pd.DataFrame:
        """Rows (tree, node, feature, split, left, right, value, cover, gain): at most trees * 2 ** (depth + 1), read off the saved model once."""
        if self.nodes is None:
            spark = SparkSession.getActiveSession()
            path = f"{shared_folder(spark)}/boosted-{uuid.uuid4().hex}"
            self.model.write().save(path)
            remove_at_exit(spark, path)
            n = F.col("nodeData")
            inner = n["leftChild"] >= 0
            self.nodes = spark.read.parquet(f"{path}/data").select(
                F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(inner, n["split"]["featureIndex"]).otherwise(-1).alias("feature"),
                F.when(inner, F.get(n["split"]["leftCategoriesOrThreshold"], 0)).otherwise(0.0).alias("split"), n["leftChild"].alias("left"),
                n["rightChild"].alias("right"), n["prediction"].alias("value"), F.get(n["impurityStats"], 0).alias("cover"),
                F.when(inner, n["gain"]).otherwise(0.0).alias("gain"),
            ).toPandas()
        return self.nodes

    def tree_table(self) -> TreeTable:
        """The trees on raw features; their raw output is the margin, half the log-odds of the score."""
        return TreeTable.of(self.node_table(), np.array(self.model.treeWeights))

    def tree_input(self) -> list[Column]:
        return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in self.features]

    def on_arrays(self):
        table = self.tree_table()
        return lambda x: 1.0 / (1.0 + np.exp(-2.0 * table.raw(x)))
