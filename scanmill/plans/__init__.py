"""Composed jobs and the queries the driver runs."""

from importlib import import_module
from importlib.util import find_spec

_MODULES = ("warp_queries", "grid_queries", "cost_queries", "metric_queries", "job_queries", "sample_queries", "raster_queries")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in _MODULES:
        if find_spec(f"{__name__}.{name}"):
            import_module(f"{__name__}.{name}")
