"""Readers and writers: JSON lines, CSV, Parquet tables, and saved detectors."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.detectors.base import Detector
from tidewatch.detectors.boosted import BoostedTrees
from tidewatch.detectors.iforest import IsolationForest
from tidewatch.detectors.mlp import MlpReconstruction
from tidewatch.detectors.pca import PcaReconstruction
from tidewatch.detectors.text import LogTextDetector
from tidewatch.detectors.zscore import ZScoreDetector
from tidewatch.operators.calibrate import FusionConfig
from tidewatch.operators.scaling import Standardizer


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, corrupt: str | None = None) -> DataFrame:
    """One object per line, typed as declared. ``corrupt`` names a column that keeps unreadable lines."""
    reader = spark.read
    if corrupt:
        schema = T.StructType(schema.fields + [T.StructField(corrupt, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """Alert store: Parquet by modality and day, so queries for either read only their folders."""
    write_table(alerts.withColumn("date", F.to_date("timestamp")), path, ["modality", "date"], mode)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("date")


def _write_json_row(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json_row(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def save_detector(spark: SparkSession, detector: Detector, path: str) -> None:
    """Parameters, features, threshold, bounds and clip; a forest's nodes and MLlib models go beside them."""
    _write_json_row(spark, {"kind": detector.kind, **detector.meta()}, f"{path}/meta")
    if isinstance(detector, IsolationForest):
        spark.createDataFrame(detector.nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    elif isinstance(detector, (BoostedTrees, LogTextDetector)):
        detector.model.write().overwrite().save(f"{path}/model")


def load_detector(spark: SparkSession, path: str) -> Detector:
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassificationModel

    meta = _read_json_row(spark, f"{path}/meta")
    kind, features = meta["kind"], meta["features"]
    if kind == "zscore":
        detector = ZScoreDetector(features)
    elif kind == "pca":
        detector = PcaReconstruction(features, meta["k"])
        detector.components = np.array(meta["components"])
    elif kind == "mlp":
        detector = MlpReconstruction(features, meta["hidden"], meta["epochs"], meta["rate"], meta["seed"])
        detector.params, detector.losses, detector.checks = np.array(meta["params"]), meta["losses"], meta.get("checks", [])
    elif kind == "iforest":
        detector = IsolationForest(features, meta["trees"], meta["sample"], meta["seed"])
        detector.used = meta["used"]
        detector.nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"], ignore_index=True)
    elif kind == "boosted":
        detector = BoostedTrees(features)
        detector.model = GBTClassificationModel.load(f"{path}/model")
    elif kind == "text":
        detector = LogTextDetector()
        detector.model = PipelineModel.load(f"{path}/model")
    else:
        raise ValueError(f"unknown detector kind: {kind}")
    if "scaler" in meta and kind != "iforest":
        detector.scaler = Standardizer(**meta["scaler"])
    detector.restore(meta)
    return detector


def save_fusion(spark: SparkSession, config: FusionConfig, path: str) -> None:
    _write_json_row(spark, asdict(config), path)


def load_fusion(spark: SparkSession, path: str) -> FusionConfig:
    return FusionConfig(**_read_json_row(spark, path))
