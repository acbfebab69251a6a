"""Loads every query module so that the registry is complete."""

from . import q_baskets, q_basics, q_drift, q_features, q_forecast, q_lifecycle, q_models, q_scalars, q_streaming  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
