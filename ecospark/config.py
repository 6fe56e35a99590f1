"""Validated parameters of a modelling run."""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass

from .vocabulary import DIVERSITY

# Allowed range of every numeric parameter.
RANGES = {
    "test_size": (0.05, 0.5),
    "learning_rate": (0.001, 1.0),
    "max_depth": (1, 15),
    "n_estimators": (100, 3000),
    "colsample": (0.0, 1.0),
    "subsample": (0.0, 1.0),
    "reg_alpha": (0.0, 5.0),
    "reg_lambda": (0.0, 5.0),
    "min_child_weight": (1, 20),
    "gamma": (0.0, 1.0),
}
KINDS = ("wide", "long", "dated")
RESPONSES = (*DIVERSITY, "log_LCBD")


@dataclass(frozen=True)
class RunConfig:
    """One modelling run: which survey kind, which response, which tree settings."""

    kind: str = "long"
    response: str = "shannon"
    corrected: bool = True
    harmonise: bool = True
    run_smooth: bool = False
    test_size: float = 0.2
    learning_rate: float = 0.01
    max_depth: int = 4
    n_estimators: int = 1000
    colsample: float = 0.8
    subsample: float = 0.8
    reg_alpha: float = 0.5
    reg_lambda: float = 3.0
    min_child_weight: int = 10
    gamma: float = 0.3
    seed: int = 42

    def __post_init__(self) -> None:
        for name, (lo, hi) in RANGES.items():
            value = getattr(self, name)
            if not lo <= value <= hi:
                raise ValueError(f"{name}={value} is outside [{lo}, {hi}]")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        if self.response not in RESPONSES:
            raise ValueError(f"response must be one of {RESPONSES}")
        if self.corrected and self.kind == "wide":
            raise ValueError("the wide survey has no corrected diversity columns")
        if self.response == "log_LCBD" and self.kind != "long":
            raise ValueError("log_LCBD exists in the long survey only")

    @property
    def target(self) -> str:
        return f"{self.response}_corr" if self.corrected else self.response

    def tree_params(self, rows: int) -> dict:
        """The settings as gradient-boosted-tree parameters of Spark ML, for ``rows`` training rows.

        ``gamma`` is the least fall of half the summed squared error by a split; Spark's least
        gain is the fall of the variance per row of the node. Taken over all rows, that is
        2 gamma / rows; deeper nodes, with fewer rows, are split a little more readily.
        """
        if self.reg_alpha or self.reg_lambda:
            warnings.warn("Spark ML trees have no L1/L2 leaf penalty; ignored", stacklevel=2)
        return {
            "stepSize": self.learning_rate,
            "maxDepth": self.max_depth,
            "maxIter": self.n_estimators,
            "featureSubsetStrategy": str(self.colsample) if 0 < self.colsample < 1 else "all",
            "subsamplingRate": max(self.subsample, 1e-6),
            "minInstancesPerNode": self.min_child_weight,
            "minInfoGain": 2 * self.gamma / max(rows, 1),
            "seed": self.seed,
        }

    def as_row(self) -> dict:
        """The parameters as one flat record, to publish beside the results."""
        return asdict(self)
