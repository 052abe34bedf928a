"""All registered queries; importing the modules fills the registry."""

from canopyflow.workload import (  # noqa: F401
    flow_queries,
    image_queries,
    parcel_queries,
    pixel_queries,
    series_queries,
    smoothing_queries,
    usage_queries,
)
from canopyflow.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
