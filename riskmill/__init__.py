"""riskmill: tabular risk modelling on imbalanced, mixed-type data, as Spark jobs."""

from riskmill.spec import FeatureSpec, ScoringSettings

__all__ = ["FeatureSpec", "ScoringSettings"]
