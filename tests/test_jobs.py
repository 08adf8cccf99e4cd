import numpy as np
import pytest
from pyspark.sql import functions as F

from scanmill.operators import jobs, lookup, ordinal
from scanmill.streaming import queue


def files(spark, n, parts=3):
    return spark.range(n).select(F.concat(F.lit("/in/"), F.col("id").cast("string"), F.lit(".jpg")).alias("path"), "id").repartition(parts)


def user_functions():
    """Made inside a function, so they travel to the workers by value: test modules are not importable there."""

    def fail_odd(_, row):
        if row["id"] % 2:
            raise ValueError(f"a:b {row['id']}")

    def broken():
        raise RuntimeError("no model")

    def flaky(_, content):
        if content == b"bad":
            raise ValueError("cannot")
        return content + b"!"

    return fail_odd, broken, flaky


fail_odd, broken, flaky = user_functions()


def test_failures_are_captured_per_item(spark):
    status = jobs.map_items(files(spark, 10), lambda: None, fail_odd)
    got = {r["filename"]: r["status"] for r in status.collect()}
    assert got["2.jpg"] == "SUCCESS" and got["3.jpg"] == "FAILED: a:b 3"
    counts = {r["status"]: r["count"] for r in jobs.status_counts(status).collect()}
    assert counts == {"SUCCESS": 5, "FAILED": 5}
    bare = jobs.map_items(files(spark, 4), lambda: None, fail_odd, with_message=False)
    assert {r["status"] for r in jobs.status_counts(bare, prefix=False).collect()} == {"SUCCESS", "FAILED"}


def test_load_failure_is_one_row_per_partition_and_counts_add_up(spark):
    status = jobs.map_items(files(spark, 12, 3), broken, fail_odd)
    rows = status.collect()
    errors = [r for r in rows if r["filename"] == jobs.SYSTEM_ERROR]
    assert 1 <= len(errors) <= 3 and errors[0]["status"] == "no model"
    assert len(rows) - len(errors) == 12
    plain = jobs.map_items(files(spark, 12, 3), broken, fail_odd, skipped=None)
    assert all(r["filename"] == jobs.SYSTEM_ERROR for r in plain.collect())


def test_retry_reports_scale(spark):
    def apply(_, row, scale):
        if scale <= row["id"]:
            raise MemoryError("big")

    got = {r["filename"]: (r["status"], r["scale"]) for r in jobs.map_with_scale(files(spark, 4), lambda: None, apply, max_scale=3).collect()}
    assert got["0.jpg"] == ("SUCCESS", 1) and got["2.jpg"] == ("SUCCESS", 3) and got["3.jpg"] == ("FAILED: big", None)


def test_spread_items(spark):
    assert jobs.spread_items(files(spark, 20, 1), 4).rdd.getNumPartitions() == 4


# --- ordinals ---------------------------------------------------------------------------------


def listing(spark, n=3000):
    # one dataset holds most rows, one group key is null
    d = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 9, F.lit(None)).otherwise("cold")
    return spark.range(n).select(d.alias("dataset"), F.md5(F.col("id").cast("string")).alias("path")).repartition(7)


def test_ordinals_by_group_with_a_hot_group(spark):
    rows = ordinal.with_ordinal(listing(spark), ["path"], ["dataset"]).collect()
    assert len(rows) == 3000
    for name in ("hot", "cold", None):
        mine = sorted((r for r in rows if r["dataset"] == name), key=lambda r: r["path"])
        assert [r["ordinal"] for r in mine] == list(range(len(mine)))


def test_ordinals_over_all(spark):
    rows = sorted(ordinal.with_ordinal(listing(spark), ["path"]).collect(), key=lambda r: r["path"])
    assert [r["ordinal"] for r in rows] == list(range(3000))


def test_hot_group_is_cut_into_ranges(spark):
    ranges = listing(spark).repartitionByRange(8, "dataset", "path").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranges) < 1000


@pytest.mark.parametrize("n, k", [(1, 5), (4, 10), (1500, 500), (977, 500)])
def test_even_sample_is_truncated_linspace(spark, n, k):
    got = ordinal.even_sample(spark.range(n), ["id"], k).collect()
    assert sorted(r["ordinal"] for r in got) == sorted(set(np.linspace(0, n - 1, k, dtype=int)))


def test_pairs_are_cut_or_refused(spark):
    rows = [("d", "left", p) for p in "cab"] + [("d", "right", p) for p in "yx"]
    assets = spark.createDataFrame(rows, "dataset string, role string, path string")
    got = ordinal.pair_by_position(assets, ["left", "right"]).orderBy("ordinal").collect()
    assert [(r["left_path"], r["right_path"]) for r in got] == [("a", "x"), ("b", "y")]
    assert ordinal.check_aligned(assets, ["left", "right"]).count() == 1
    with pytest.raises(ValueError):
        ordinal.pair_by_position(assets, ["left", "right"], strict=True)


def test_shuffle_is_a_permutation_that_depends_on_epoch(spark):
    order = lambda parts, epoch: [r["id"] for r in ordinal.shuffle(spark.range(100).repartition(parts), ["id"], 5, epoch).collect()]
    assert order(1, 0) == order(8, 0) != order(8, 1)
    assert sorted(order(3, 2)) == list(range(100))


def test_batches(spark):
    sizes = lambda **k: sorted(r["count"] for r in ordinal.assign_batches(spark.range(10), ["id"], **k).groupBy("batch_id").count().collect())
    assert sizes(total_batch=4) == [4, 4]
    assert sizes(total_batch=4, drop_last=False) == [2, 4, 4]
    assert sizes(per_worker=2, workers=2) == [4, 4]
    with pytest.raises(ValueError):
        ordinal.assign_batches(spark.range(3), ["id"])


# --- lookups ----------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, how):
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 50)
    big = spark.range(2000).withColumn("k", key)
    small = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small_side = lookup.lookup_join(big, small, ["k"], how)
    salted = lookup.lookup_join(big, small, ["k"], how, max_bytes=0)
    assert "BroadcastHashJoin" in small_side._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in salted._jdf.queryExecution().analyzed().toString()
    assert small_side.columns == salted.columns
    assert sorted(map(str, small_side.collect())) == sorted(map(str, salted.collect()))


def test_broadcast_limit(spark):
    assert lookup._bytes("10MB") == 10 * 2**20 and lookup._bytes("512") == 512 and lookup._bytes("-1") == -1


# --- queue ------------------------------------------------------------------------------------


def test_queue_from_submit_to_retry(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("tasks", "results", "check"))
    rows = [("/in/a.jpg", b"good"), ("/in/b.jpg", b"bad"), ("/in/c.jpg", b"fine")]
    land = spark.createDataFrame(rows, "path string, content binary")
    queue.submit(spark, folder, land)
    queue.submit(spark, folder, land.limit(1))  # sending a file twice is no second task
    tasks = queue.read_tasks(spark, folder)
    assert tasks.count() == 3
    assert queue.read_results(spark, out).count() == 0
    assert queue.next_task(tasks, queue.read_results(spark, out)).first()["filename"] in {"a.jpg", "b.jpg", "c.jpg"}

    run = lambda: queue.drain(queue.task_stream(spark, folder, 1), out, check, lambda: None, flaky).awaitTermination()
    run()
    results = queue.read_results(spark, out)
    assert {(r["filename"], bytes(r["content"])) for r in results.collect()} == {("result_a.jpg", b"good!"), ("result_c.jpg", b"fine!")}
    status = {r["filename"]: r["status"] for r in queue.task_status(tasks, results).collect()}
    assert status == {"a.jpg": "done", "b.jpg": "waiting", "c.jpg": "done"}
    assert {r["task_filename"] for r in queue.link_results(tasks, results).collect()} == {"a.jpg", "c.jpg"}

    run()  # nothing new: an empty queue ends at once
    assert queue.read_results(spark, out).count() == 2
    queue.retry_pending(tasks, queue.read_results(spark, out), out, "1", lambda: None, lambda m, c: c)
    results = queue.read_results(spark, out)
    assert queue.pending(tasks, results).count() == 0
    assert queue.next_task(tasks, results).count() == 0


def content_of(spark, out):
    return sorted((r["filename"], bytes(r["content"])) for r in queue.read_results(spark, out).collect())


def test_a_new_checkpoint_adds_to_earlier_runs_and_a_replay_replaces_its_batch(spark, tmp_path):
    folder, out = str(tmp_path / "tasks"), str(tmp_path / "results")
    drain = lambda check, apply: queue.drain(queue.task_stream(spark, folder), out, str(tmp_path / check), lambda: None, apply).awaitTermination()
    queue.submit(spark, folder, spark.createDataFrame([("/in/a.jpg", b"a")], "path string, content binary"))
    drain("one", lambda m, c: c + b"1" if c == b"a" else None)
    queue.submit(spark, folder, spark.createDataFrame([("/in/b.jpg", b"b")], "path string, content binary"))
    drain("two", lambda m, c: c + b"2" if c == b"b" else None)  # also starts with batch 0
    assert content_of(spark, out) == [("result_a.jpg", b"a1"), ("result_b.jpg", b"b2")]
    commits = {(r["run"], r["batch"]): r for r in queue.read_commits(spark, out).collect()}
    assert len(commits) == 2 and {b for _, b in commits} == {0}
    assert sorted((r["results"], r["failures"]) for r in commits.values()) == [(1, 0), (1, 1)]
    assert {(r["filename"], r["error"]) for r in queue.read_failures(spark, out).collect()} == {("result_a.jpg", "no result")}

    # the batch of the first run is worked off once more, as after a lost driver: its own results are replaced, the others stay
    run = next(r for (r, _), row in commits.items() if row["failures"] == 0)
    tasks = queue.read_tasks(spark, folder).where("filename = 'a.jpg'")
    queue.publish(queue.outcomes(tasks, lambda: None, lambda m, c: c + b"3"), out, run, 0)
    assert content_of(spark, out) == [("result_a.jpg", b"a3"), ("result_b.jpg", b"b2")]
    # an attempt that was written but not committed is not read
    queue.outcomes(tasks, lambda: None, lambda m, c: b"x").write.parquet(f"{out}/data/run={run}/batch=5/attempt=y")
    assert content_of(spark, out) == [("result_a.jpg", b"a3"), ("result_b.jpg", b"b2")]


def test_a_failing_load_leaves_tasks_waiting(spark, tmp_path):
    folder, out = str(tmp_path / "tasks"), str(tmp_path / "results")
    queue.submit(spark, folder, spark.createDataFrame([("/in/a.jpg", b"a"), ("/in/b.jpg", b"b")], "path string, content binary"))

    def load():
        raise RuntimeError("no such weights")

    queue.drain(queue.task_stream(spark, folder), out, str(tmp_path / "c"), load, lambda m, c: c).awaitTermination()
    tasks, results = queue.read_tasks(spark, folder), queue.read_results(spark, out)
    assert queue.pending(tasks, results).count() == 2
    assert {r["error"] for r in queue.read_failures(spark, out).collect()} == {"load: no such weights"}
