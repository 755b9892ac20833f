"""Names of the site-analytics queries, with their oracles."""

from tarn.plans import embedding, extension, features, forecast, places, report, search, shapes, upkeep  # noqa: F401
from tarn.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
