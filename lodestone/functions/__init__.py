"""Scalar and aggregate functions of the dialect; both registries are open to users."""

from .aggregate import AGGREGATES
from .scalar import SCALARS, register

__all__ = ["AGGREGATES", "SCALARS", "register"]
