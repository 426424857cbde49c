"""End-to-end plans: records to features, scores, fused score, decision and alerts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.detectors.base import Detector
from tidewatch.detectors.boosted import BoostedTrees
from tidewatch.detectors.iforest import IsolationForest
from tidewatch.detectors.text import LogTextDetector
from tidewatch.detectors.zscore import ZScoreDetector
from tidewatch.operators.alerts import build_alerts, decide
from tidewatch.operators.explain import additive_attribution, sorted_attribution
from tidewatch.operators.features import add_network_features
from tidewatch.operators.fuse import route_fusion
from tidewatch.operators.knowledge import attach_attack_knowledge
from tidewatch.operators.shapley import EXACT_FEATURES, shapley, tree_shapley
from tidewatch.schemas import DERIVED_FLOW_FEATURES, MODALITIES, RAW_FLOW_FEATURES


@dataclass
class Pipeline:
    """A fitted plan for one modality. It is lazy and keeps no state, so it serves tables and streams alike.

    ``detectors`` maps score columns (``sup_score``, ``ae_score``, ``if_score`` for flows, ``score`` else)
    to fitted detectors; the threshold belongs to the fused score they give.
    """

    modality: str
    key: str
    detectors: Mapping[str, Detector]
    threshold: float
    mode: str = "model"
    time: str = "ts"
    features: list[str] = field(default_factory=list)
    explain: bool = False
    background: DataFrame | None = None

    def __post_init__(self):
        if self.modality not in MODALITIES:
            raise ValueError(f"unknown modality: {self.modality}")

    def scored(self, df: DataFrame) -> DataFrame:
        """Every record with its scores, ``fused_score`` and ``is_alert``."""
        rows = add_network_features(df) if self.modality == "network" else df
        for name, detector in self.detectors.items():
            rows = detector.score(rows, name)
        rec, iso = self.detectors.get("ae_score"), self.detectors.get("if_score")
        fused = route_fusion(
            rows, self.modality,
            reconstruction_threshold=rec.threshold if rec else None,
            isolation_threshold=iso.threshold if iso else None,
        )
        return decide(fused, "fused_score", self.threshold, self.mode)

    def records(self, df: DataFrame) -> DataFrame:
        """Every record with its decision and the severity its alert would have."""
        known = attach_attack_knowledge(self.scored(df))
        return known.withColumn("severity", F.when(F.col("is_alert"), F.col("severity")))

    def explained(self, raised: DataFrame, name: str = "_attribution") -> DataFrame:
        """Add an attribution by the detector that decides: exact for sums of squares, trees and text, else by ``background``.

        A detector of another kind without a background table is answered with the features of largest absolute value.
        """
        scorer = next((self.detectors[c] for c in ("score", "sup_score", "if_score", "ae_score") if c in self.detectors), None)
        if isinstance(scorer, ZScoreDetector):
            return additive_attribution(raised, scorer.scaler, name=name)
        if isinstance(scorer, (BoostedTrees, IsolationForest)):
            return tree_shapley(raised, scorer, name)
        if isinstance(scorer, LogTextDetector):
            return scorer.term_attribution(raised, name)
        if scorer is not None and self.background is not None:
            method = "exact" if len(scorer.features) <= EXACT_FEATURES else "sampled"
            return shapley(raised, scorer.features, scorer.on_arrays(), self.background, method, name=name)
        features = [c for c in (scorer.features if scorer else self.features) if c in raised.columns]
        return raised.withColumn(name, sorted_attribution({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}))

    def alerts(self, df: DataFrame) -> DataFrame:
        """Alerts only. Attribution runs after the decision, on the few rows that need it; flows and logs have one on request (``explain``)."""
        raised = self.scored(df).where("is_alert")
        attribution = None
        if self.explain or self.modality == "metric":
            raised, attribution = self.explained(raised), "_attribution"
        shown = self.features
        if attribution and self.modality == "network":
            # What an explanation may name must be among the values that can be shown.
            shown = [*dict.fromkeys([*self.features, *RAW_FLOW_FEATURES])]
        hidden = [*self.detectors, "is_alert", *(DERIVED_FLOW_FEATURES if self.modality == "network" else [])]
        return build_alerts(
            raised.drop(*hidden), self.modality, self.key, features=shown,
            attribution=attribution, time=self.time,
        )
