"""A work queue on tables: tasks land in a folder, results are appended beside them.

Nothing is updated in place. A task is waiting while no result names it as its
parent, so a crashed or failed task is waiting again by itself. The streaming
worker takes each landed file once; what failed is retried by the batch form.

Results lie in ``data/run=/batch=/attempt=`` folders, a new one for every attempt, and count only once ``commits`` names their folder
for the (run, batch). An attempt that is cut off is never read, a replayed batch replaces its own results and no others, and a
run is known by the stream's own id, so that a new checkpoint starts a new run even at the path of an old one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scanmill.operators.lookup import lookup_join
from scanmill.session import ship_package

TASK_SCHEMA = "task_id long, filename string, content binary, uploaded_at timestamp"
RESULT_SCHEMA = "result_id string, parent_id long, filename string, type string, content binary"
OUTCOME_SCHEMA = f"{RESULT_SCHEMA}, error string"
COMMIT_SCHEMA = "run string, batch long, folder string, results long, failures long"
RESULT_TYPE = "disparity_map"  # fixed value: type of a published result


def submit(spark: SparkSession, folder: str, files: DataFrame) -> None:
    """Append files(path, content) to the task folder.

    The task id is a hash of path and content, so submitting a file again after a
    failed write does not make a second task.
    """
    files.select(
        F.xxhash64("path", "content").alias("task_id"),
        F.substring_index("path", "/", -1).alias("filename"),
        "content",
        F.current_timestamp().alias("uploaded_at"),
    ).write.mode("append").parquet(folder)


def read_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """All tasks once each. Where contents are not selected they are not read or shuffled."""
    return spark.read.schema(TASK_SCHEMA).parquet(folder).dropDuplicates(["task_id"])


def _read_below(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows below a folder; none where it is empty or missing."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_commits(spark: SparkSession, out: str) -> DataFrame:
    """What counts: ``run, batch, folder, results, failures``, one row per batch."""
    return _read_below(spark, f"{out}/commits", COMMIT_SCHEMA)


def _read_outcomes(spark: SparkSession, out: str) -> DataFrame:
    try:
        found = spark.read.schema(OUTCOME_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{out}/data")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], OUTCOME_SCHEMA)
    place = F.regexp_extract(F.col("_metadata.file_path"), "(run=[^/]*/batch=[^/]*/attempt=[^/]*)/[^/]*$", 1)
    placed = found.withColumn("folder", F.url_decode(place))
    return lookup_join(placed, read_commits(spark, out).select("folder"), ["folder"], how="left_semi").drop("folder")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """All committed results; tasks worked off by two runs have one result, as the id decides."""
    return _read_outcomes(spark, folder).where("error IS NULL").drop("error").dropDuplicates(["result_id"])


def read_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Why tasks were left waiting: ``parent_id, filename, error`` of each committed attempt."""
    return _read_outcomes(spark, folder).where("error IS NOT NULL").select("parent_id", "filename", "error")


def pending(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks no result names as parent."""
    done = results.select(F.col("parent_id").alias("task_id"))
    return tasks.join(done, "task_id", "left_anti")


def task_status(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Each task with ``done`` or ``waiting``."""
    done = results.select(F.col("parent_id").alias("task_id")).distinct().withColumn("__done", F.lit(True))
    joined = tasks.join(done, "task_id", "left")
    state = F.when(F.col("__done"), "done").otherwise("waiting")
    return joined.withColumn("status", state).drop("__done")


def link_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Results with the task they came from."""
    parents = tasks.select(F.col("task_id").alias("parent_id"), F.col("filename").alias("task_filename"))
    return results.join(parents, "parent_id")


def next_task(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """The waiting task that was uploaded first, or no row when the queue is empty."""
    return first_match(pending(tasks, results), ["uploaded_at", "task_id"])


def first_match(df: DataFrame, order_by: list[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(1)


def outcomes(tasks: DataFrame, load: Callable[[], Any], apply: Callable[[Any, bytes], bytes | None]) -> DataFrame:
    """One row per task: its result, or the ``error`` for which it stays waiting. Where ``load`` fails, all tasks of the partition do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, loaded, broken = None, False, None
        for batch in batches:
            if not loaded:
                loaded = True
                try:
                    model = load()
                except Exception as exc:
                    broken = f"load: {exc or type(exc).__name__}"
            rows = []
            for task_id, filename, content in zip(batch["task_id"], batch["filename"], batch["content"]):
                made, error = None, broken
                if broken is None:
                    try:
                        made = apply(model, content)
                        error = None if made is not None else "no result"
                    except Exception as exc:
                        error = str(exc) or type(exc).__name__
                rows.append((f"result-{task_id}", task_id, f"result_{filename}", RESULT_TYPE, made, error))
            yield pd.DataFrame(rows, columns=["result_id", "parent_id", "filename", "type", "content", "error"])

    ship_package(tasks.sparkSession)
    return tasks.select("task_id", "filename", "content").mapInPandas(run, OUTCOME_SCHEMA)


def process(tasks: DataFrame, load: Callable[[], Any], apply: Callable[[Any, bytes], bytes | None]) -> DataFrame:
    """Results of the tasks for which ``apply`` gave one; the others stay waiting."""
    return outcomes(tasks, load, apply).where("error IS NULL").drop("error")


def publish(found: DataFrame, out: str, run: str, batch: int) -> None:
    """Write the outcomes of one batch into a folder of their own, then make that folder the one that counts for (run, batch)."""
    spark = found.sparkSession
    folder = f"run={run}/batch={batch}/attempt={uuid.uuid4().hex}"
    found.write.parquet(f"{out}/data/{folder}")
    written = spark.read.schema(OUTCOME_SCHEMA).parquet(f"{out}/data/{folder}")
    row = written.agg(
        F.lit(run).alias("run"), F.lit(batch).cast("long").alias("batch"), F.lit(folder).alias("folder"),
        F.count_if(F.col("error").isNull()).alias("results"), F.count("error").alias("failures"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/run={run}/batch={batch}")


def task_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Newly landed tasks; the checkpoint hands each file to one batch."""
    return (
        spark.readStream.schema(TASK_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def drain(
    tasks: DataFrame,
    out: str,
    checkpoint: str,
    load: Callable[[], Any],
    apply: Callable[[Any, bytes], bytes | None],
) -> StreamingQuery:
    """Work off everything that waits, then stop. Each batch is published as one commit of the stream's run."""

    def work_off(batch: DataFrame, batch_id: int) -> None:
        # the id lies in the checkpoint: it outlives restarts, and another checkpoint has another
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        publish(outcomes(batch, load, apply), out, run or hashlib.sha256(checkpoint.encode()).hexdigest(), batch_id)

    return (
        tasks.writeStream.foreachBatch(work_off)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def retry_pending(
    tasks: DataFrame,
    results: DataFrame,
    out: str,
    run_id: str,
    load: Callable[[], Any],
    apply: Callable[[Any, bytes], bytes | None],
) -> None:
    """Batch run over tasks that still wait, into a folder of its own.

    What waits is found on ids alone; contents are only read for those ids, and
    are not shuffled while the list of ids fits a broadcast.
    """
    waiting = pending(tasks.select("task_id"), results).distinct()
    todo = lookup_join(tasks, waiting, ["task_id"], how="left_semi")
    publish(outcomes(todo, load, apply), out, f"retry-{run_id}", 0)
