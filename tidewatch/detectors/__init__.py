"""Detectors: ``fit`` learns a small model, ``score`` adds a score column (higher is more anomalous)."""
