"""What a table means: which column is the key, a feature or the target, and how scores are read."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureSpec:
    """Column roles of one mixed-type table with a 0/1 target.

    ``features`` fixes the feature order. ``domains`` holds the accepted values of
    categorical columns and ``ranges`` the inclusive bounds of numeric ones; both are
    only needed for checking records.
    """

    key: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    binary: tuple[str, ...]
    target: str
    order: tuple[str, ...] = ()
    domains: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self):
        roles = self.numeric + self.categorical + self.binary
        if len(set(roles)) != len(roles):
            raise ValueError("a feature may have one role only")
        if self.order and sorted(self.order) != sorted(roles):
            raise ValueError("order must list every feature once")

    @property
    def features(self) -> tuple[str, ...]:
        return self.order or self.numeric + self.categorical + self.binary

    @property
    def nominal(self) -> tuple[str, ...]:
        """Columns that are matched rather than interpolated when rows are synthesised."""
        return self.categorical + self.binary


@dataclass(frozen=True)
class ScoringSettings:
    """How a probability becomes a decision, a band and a response."""

    threshold: float = 0.5
    moderate_from: float = 0.30
    high_from: float = 0.50
    decimals: int = 4
    disclaimer: str = "This is an educational risk screening prediction and not a medical diagnosis."


# Column roles, accepted values and bounds of the screening table.
SCREENING_SPEC = FeatureSpec(
    key="id",
    numeric=("age",),
    categorical=("gender", "ever_married", "work_type", "Residence_type", "smoking_status"),
    binary=("hypertension", "heart_disease"),
    target="stroke",
    order=(
        "age", "gender", "hypertension", "heart_disease",
        "ever_married", "work_type", "Residence_type", "smoking_status",
    ),
    domains={
        "gender": ("Male", "Female", "Other"),
        "ever_married": ("Yes", "No"),
        "work_type": ("Private", "Self-employed", "Govt_job", "children", "Never_worked"),
        "Residence_type": ("Urban", "Rural"),
        "smoking_status": ("formerly smoked", "never smoked", "smokes", "Unknown"),
    },
    ranges={"age": (0, 120)},
)
