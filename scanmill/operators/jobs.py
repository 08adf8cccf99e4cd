"""Run a user's per-item function over a table of files, and count what came of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.functions.paths import basename, status_prefix
from scanmill.session import ship_package

STATUS_SCHEMA = "filename string, status string"
SUCCESS = "SUCCESS"
SYSTEM_ERROR = "System_Error"


def map_items(
    items: DataFrame,
    load: Callable[[], Any],
    apply: Callable[[Any, dict], str | None],
    name: str = "path",
    with_message: bool = True,
    skipped: str | None = "FAILED: not processed",
) -> DataFrame:
    """job_status(filename, status) of ``apply(model, row)`` over all rows.

    ``load`` runs once per partition. A row that raises becomes ``FAILED: msg``
    (or bare ``FAILED``) and the job goes on. When ``load`` fails, the partition
    yields one ``System_Error`` row; its rows are then reported as ``skipped``
    so that counts add up (None leaves them out).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, broken = None, None
        loaded = False
        for batch in batches:
            names, states = [], []
            if not loaded:
                loaded = True
                try:
                    model = load()
                except Exception as exc:
                    broken = exc
                    names.append(SYSTEM_ERROR)
                    states.append(str(exc))
            for row in batch.to_dict("records"):
                label = str(row[name]).rsplit("/", 1)[-1]
                if broken is not None:
                    if skipped is not None:
                        names.append(label)
                        states.append(skipped)
                    continue
                try:
                    states.append(apply(model, row) or SUCCESS)
                except Exception as exc:
                    states.append(f"FAILED: {exc}" if with_message else "FAILED")
                names.append(label)
            yield pd.DataFrame({"filename": names, "status": states})

    ship_package(items.sparkSession)
    return items.mapInPandas(run, STATUS_SCHEMA)


def with_retry(
    apply: Callable[[Any, dict, int], Any], max_scale: int, retry_on: tuple[type[BaseException], ...] = (MemoryError,)
) -> Callable[[Any, dict], tuple[Any, int]]:
    """Repeat ``apply(model, row, scale)`` at a coarser scale while memory runs out.

    ``retry_on`` names what counts as that, as devices raise errors of their own. Returns the result with the scale that worked.
    """

    def run(model: Any, row: dict) -> tuple[Any, int]:
        for scale in range(1, max_scale + 1):
            try:
                return apply(model, row, scale), scale
            except retry_on:
                if scale == max_scale:
                    raise
        raise AssertionError("unreachable")

    return run


def map_with_scale(
    items: DataFrame,
    load: Callable[[], Any],
    apply: Callable[[Any, dict, int], str | None],
    name: str = "path",
    *,
    max_scale: int,
    retry_on: tuple[type[BaseException], ...] = (MemoryError,),
) -> DataFrame:
    """Like :func:`map_items` with retries; also reports the ``scale`` that worked.

    A ``load`` that fails is the status of every item of the task.
    """
    attempt = with_retry(apply, max_scale, retry_on)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, loaded, broken = None, False, None
        for batch in batches:
            if not loaded:
                loaded = True
                try:
                    model = load()
                except Exception as exc:
                    broken = exc
            out = []
            for row in batch.to_dict("records"):
                label = str(row[name]).rsplit("/", 1)[-1]
                try:
                    if broken is not None:
                        raise broken
                    status, scale = attempt(model, row)
                    out.append((label, status or SUCCESS, scale))
                except Exception as exc:
                    out.append((label, f"FAILED: {exc}", None))
            frame = pd.DataFrame(out, columns=["filename", "status", "scale"])
            yield frame.astype({"scale": "Int32"})

    ship_package(items.sparkSession)
    return items.mapInPandas(run, STATUS_SCHEMA + ", scale int")


def spread_items(items: DataFrame, n: int) -> DataFrame:
    """Cut the work into ``n`` tasks; a listing alone does not say how long an item takes."""
    return items.repartition(n)


def status_counts(status: DataFrame, prefix: bool = True) -> DataFrame:
    """Items per status; ``prefix`` counts all failures together, whatever their message."""
    key = status_prefix(F.col("status")) if prefix else F.col("status")
    return status.groupBy(key.alias("status")).agg(F.count(F.lit(1)).alias("count"))


def report(summary: DataFrame) -> None:
    """Print the counts. One row per status, so this is small."""
    summary.orderBy("status").show(truncate=False)


def result_lines(status: DataFrame, device: str = "cpu") -> DataFrame:
    """Text to keep for each processed item."""
    done = status.filter(F.col("status") == SUCCESS)
    return done.select(basename(F.col("filename")).alias("filename"), F.lit(f"Processed on {device}").alias("value"))
