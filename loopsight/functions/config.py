"""Thresholds of the detectors, as one immutable set of job parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    warning: int = 10
    critical: int = 20
    history: int = 30
    error_warning: int = 3
    error_critical: int = 5
    edit_warning: int = 5
    edit_critical: int = 8
    same_region: float = 0.3
    similar: float = 0.90
    decide: float = 0.7
    samples: int = 1
    debounce_ms: int = 60_000
    low_confidence: bool = False
    orphan_ms: int = 5_000
    iou: float = 0.5
    anchor_k: int = 5
    min_support: int = 15
    penalty: float = 0.5
    folds: int = 5


DEFAULTS = Thresholds()
# Kinds of verdicts in their order of precedence.
KINDS = ["thrashing", "false_success", "none"]
