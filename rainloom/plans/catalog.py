"""All registered queries."""

from rainloom.plans import q_features, q_models, q_prepare, q_quality, q_scoring, q_stream  # noqa: F401
from rainloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
