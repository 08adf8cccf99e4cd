"""Camera settings that lie beside depth files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.paths import dirname
from scanmill.operators.lookup import lookup_join
from scanmill.session import ship_package

SETTINGS_FILE = "_camera_settings.json"  # fixed value: name of the settings file
CAMERA_SCHEMA = "camera_settings array<struct<intrinsic_settings: struct<fx: double>>>"


def _read_settings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        texts = []
        for folder in batch["dir"]:
            store, base = fs.FileSystem.from_uri(folder)
            try:
                with store.open_input_stream(f"{base}/{SETTINGS_FILE}") as handle:
                    texts.append(handle.read().decode("utf-8"))
            except (OSError, UnicodeDecodeError):  # one missing or broken file must not end the job
                texts.append(None)
        yield pd.DataFrame({"dir": batch["dir"], "text": texts})


def focal_length(text: Column) -> Column:
    """``fx`` of the first camera in a settings document."""
    first = F.get(F.from_json(text, CAMERA_SCHEMA)["camera_settings"], F.lit(0))
    return first["intrinsic_settings"]["fx"]


def read_cameras(depth_files: DataFrame, path: str = "path") -> DataFrame:
    """cameras(dir, fx): the settings file of every directory that holds depth files.

    Names that start with an underscore are hidden to Spark's file index, so the
    directories are derived from the depth files and opened inside tasks. A
    directory whose file is missing or cannot be read has a null ``fx``.
    """
    dirs = depth_files.select(dirname(F.col(path)).alias("dir")).distinct()
    ship_package(depth_files.sparkSession)
    texts = dirs.mapInPandas(_read_settings, "dir string, text string")
    return texts.select("dir", focal_length(F.col("text")).alias("fx"))


def with_camera(lines: DataFrame, cameras: DataFrame, path: str = "path") -> DataFrame:
    """Attach ``fx`` by the directory of each file; broadcast when the table is small."""
    placed = lines.withColumn("dir", dirname(F.col(path)))
    return lookup_join(placed, cameras, ["dir"]).drop("dir")
