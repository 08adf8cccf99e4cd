"""Named datasets: where they lie, how they are read and how they are judged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

REGISTRY_SCHEMA = "name string, root string, mask_mode string, resolution string, outlier_px int"


@dataclass(frozen=True)
class Dataset:
    """One entry of the registry."""

    name: str
    root: str | None = None
    mask_mode: str | None = None
    resolution: str | None = None
    outlier_px: int | None = None


# Mask mode and outlier threshold of each evaluation set, named as the listings name it.
EVALUATION = (
    Dataset("kitti", None, "all", None, 3),
    Dataset("middlebury", None, "noc", "H", 2),
    Dataset("eth3d", None, "noc", None, 1),
)


def registry(spark: SparkSession, datasets) -> DataFrame:
    """The registry as a small table to join with."""
    rows = [(d.name, d.root, d.mask_mode, d.resolution, d.outlier_px) for d in datasets]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def evaluation_registry(spark: SparkSession) -> DataFrame:
    return registry(spark, EVALUATION)
