"""The knobs of the gate."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # fixed values: the defaults
    presence_delta: float = 0.2
    error_rate_delta: float = 0.1
    metric_rel_delta: float = 0.25
    iqr_factor: float = 1.5
    min_support: int = 3
    coverage_floor: float = 0.7
    z: float = 1.645
    annotation_rate_delta: float = 0.1
    paired_alpha: float = 0.05
    paired_min_tasks: int = 5
    paired_test: str = "sign"
    audit_iqr: float = 3.0
    audit_rel: float = 0.5
    fail_on_notable: bool = False

    def __post_init__(self):
        for name in ("presence_delta", "error_rate_delta", "coverage_floor", "annotation_rate_delta"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        for name in ("metric_rel_delta", "iqr_factor", "audit_iqr", "audit_rel"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.min_support < 1 or self.paired_min_tasks < 1:
            raise ValueError("supports must be 1 at least")
        if not 0 < self.paired_alpha < 1 or self.z <= 0:
            raise ValueError("paired_alpha must lie in (0, 1) and z above 0")
        if self.paired_test not in ("sign", "wilcoxon"):
            raise ValueError("paired_test is sign or wilcoxon")


DEFAULT = Thresholds()
