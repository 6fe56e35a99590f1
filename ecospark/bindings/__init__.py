"""Every registered query and its oracle."""

from . import beta, cleaning, composition, diversity, models, products, spatial  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
