"""Queries on listings, batches, jobs and the work queue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scanmill.functions import paths
from scanmill.functions.scalar import falling_things, json_field
from scanmill.operators import jobs, ordinal
from scanmill.operators.lookup import lookup_join
from scanmill.plans.registry import query, r6, r6_sql
from scanmill.plans.views import table
from scanmill.session import ensure_checkpoint_dir
from scanmill.streaming import queue

# --- statuses ---------------------------------------------------------------------------------

_STATUS = "CASE WHEN event_type = 'error' THEN 'FAILED: code:' || (event_id % 3) ELSE 'SUCCESS' END"


def _statuses(spark, sf_dir):
    failed = F.concat(F.lit("FAILED: code:"), F.pmod("event_id", F.lit(3)).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("filename"),
        F.when(F.col("event_type") == "error", failed).otherwise("SUCCESS").alias("status"),
    )


@query(
    "status_counts_prefix",
    f"SELECT split_part({_STATUS}, ':', 1) AS status, count(*) AS count FROM events GROUP BY 1",
)
def counts_prefix(spark, sf_dir):
    return jobs.status_counts(_statuses(spark, sf_dir))


@query("status_counts_full", f"SELECT {_STATUS} AS status, count(*) AS count FROM events GROUP BY 1")
def counts_full(spark, sf_dir):
    return jobs.status_counts(_statuses(spark, sf_dir), prefix=False)


@query(
    "mapper_load_once",
    "SELECT CAST(event_id AS VARCHAR) AS filename, CASE WHEN event_type = 'error' THEN 'FAILED: bad input' ELSE 'SUCCESS' END AS status FROM events",
)
def mapper(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("/in/"), F.col("event_id").cast("string")).alias("path"), "event_type"
    )

    def apply(bad, row):
        if row["event_type"] in bad:
            raise ValueError("bad input")

    return jobs.map_items(events, lambda: {"error"}, apply)


@query(
    "mapper_with_retry",
    """SELECT CAST(event_id AS VARCHAR) AS filename, CASE WHEN s IS NULL THEN 'FAILED: too large' ELSE 'SUCCESS' END AS status, CAST(s AS INTEGER) AS scale
    FROM (SELECT event_id, list_filter(range(1, 5), lambda k: value / k <= 10)[1] AS s FROM events)""",
)
def mapper_retry(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), "value")

    def apply(_, row, scale):
        if row["value"] / scale > 10:
            raise MemoryError("too large")

    return jobs.map_with_scale(events, lambda: None, apply, max_scale=4)


@query(
    "result_lines",
    "SELECT CAST(event_id AS VARCHAR) AS filename, 'Processed on cpu' AS value FROM events WHERE event_type <> 'error'",
)
def result_lines(spark, sf_dir):
    return jobs.result_lines(_statuses(spark, sf_dir))


# --- listings ---------------------------------------------------------------------------------


@query("first_n_assets", "SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 20")
def first_assets(spark, sf_dir):
    """The first files of a listing: the limit is the feature."""
    return ordinal.first_n(table(spark, sf_dir, "pages").select("page_id", "url"), 20, ["url", "page_id"])


@query("listing_ordinals", "SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS ordinal FROM pages")
def ordinals(spark, sf_dir):
    return ordinal.with_ordinal(table(spark, sf_dir, "pages").select("page_id", "url"), ["url", "page_id"]).drop("url")


@query(
    "even_sample",
    """WITH o AS (SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS ordinal, count(*) OVER () AS n FROM pages),
    k AS (SELECT i, CASE WHEN i = 39 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 39.0::DOUBLE)) AS BIGINT) END AS ordinal
      FROM (SELECT count(*) AS n FROM pages) CROSS JOIN (SELECT unnest(range(40)) AS i))
    SELECT page_id, ordinal FROM o WHERE ordinal IN (SELECT ordinal FROM k)""",
)
def even(spark, sf_dir):
    listing = table(spark, sf_dir, "pages").select("page_id", "url")
    return ordinal.even_sample(listing, ["url", "page_id"], 40).select("page_id", "ordinal")


@query(
    "strided_shard",
    """SELECT page_id, ordinal FROM (SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS ordinal FROM pages) WHERE ordinal % 4 = 1""",
)
def shard(spark, sf_dir):
    listing = table(spark, sf_dir, "pages").select("page_id", "url")
    return ordinal.shard(listing, 1, 4, ["url", "page_id"]).select("page_id", "ordinal")


@query(
    "batches_drop_last",
    """SELECT doc_id, o // 7 AS batch_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS o, count(*) OVER () AS n FROM documents)
    WHERE o // 7 < n // 7""",
)
def batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ordinal.assign_batches(docs, ["n_chars", "doc_id"], total_batch=7).select("doc_id", "batch_id")


@query(
    "batches_per_worker",
    "SELECT doc_id, o // 12 AS batch_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS o FROM documents)",
)
def batches_all(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    out = ordinal.assign_batches(docs, ["n_chars", "doc_id"], per_worker=3, workers=4, drop_last=False)
    return out.select("doc_id", "batch_id")


@query(
    "seeded_shuffle",
    """SELECT count(*) AS docs, count(*) AS positions, CAST(0 AS BIGINT) AS first_position, count(*) - 1 AS last_position,
      CAST(sum(doc_id) AS BIGINT) AS id_sum, true AS moved FROM documents""",
)
def shuffled(spark, sf_dir):
    """A hash order has no counterpart in SQL, but it must be a permutation and must move rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id").withColumn("key", ordinal.shuffle_key(7, 1, "doc_id"))
    placed = ordinal.with_ordinal(docs, ["key", "doc_id"])
    return placed.agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_distinct("ordinal").alias("positions"),
        F.min("ordinal").alias("first_position"),
        F.max("ordinal").alias("last_position"),
        F.sum("doc_id").alias("id_sum"),
        F.coalesce(F.bool_or(F.col("doc_id") != F.col("ordinal")), F.lit(False)).alias("moved"),
    )


_ASSETS = """a AS (SELECT source AS dataset, CASE doc_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'disp' END AS role,
  lang || '/' || doc_id AS path, doc_id FROM documents)"""


def _assets(spark, sf_dir):
    role = F.get(F.array(F.lit("left"), F.lit("right"), F.lit("disp")), F.pmod("doc_id", F.lit(3)).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("dataset"), role.alias("role"),
        F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"),
    )


@query(
    "pair_listings",
    f"""WITH {_ASSETS}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset, role ORDER BY path) - 1 AS ordinal FROM a)
    SELECT l.dataset, l.ordinal, l.path AS left_path, r.path AS right_path, d.path AS disp_path
    FROM o l JOIN o r ON r.dataset = l.dataset AND r.ordinal = l.ordinal AND r.role = 'right'
    JOIN o d ON d.dataset = l.dataset AND d.ordinal = l.ordinal AND d.role = 'disp' WHERE l.role = 'left'""",
)
def pairs(spark, sf_dir):
    return ordinal.pair_by_position(_assets(spark, sf_dir), ["left", "right", "disp"])


@query(
    "pair_by_key",
    """SELECT u.conv_id AS dataset, u.turn // 2 AS pair_key, min(u.role || u.turn) AS user_path, min(b.role || b.turn) AS assistant_path
    FROM conversations u JOIN conversations b ON b.conv_id = u.conv_id AND b.turn // 2 = u.turn // 2 AND b.role = 'assistant'
    WHERE u.role = 'user' GROUP BY u.conv_id, u.turn // 2""",
)
def keyed(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("dataset"), "role", F.concat("role", F.col("turn").cast("string")).alias("path"), "turn"
    )
    return ordinal.pair_by_key(turns, ["user", "assistant"], F.expr("turn div 2"))


@query(
    "listing_violations",
    f"""WITH {_ASSETS}, n AS (SELECT dataset, count(*) FILTER (role = 'left') AS n_left, count(*) FILTER (role = 'right') AS n_right,
      count(*) FILTER (role = 'disp') AS n_disp FROM a GROUP BY dataset)
    SELECT * FROM n WHERE n_left <> n_right OR n_left <> n_disp""",
)
def violations(spark, sf_dir):
    return ordinal.check_aligned(_assets(spark, sf_dir), ["left", "right", "disp"])


@query(
    "dataset_counts",
    "SELECT dataset, count(*) AS samples FROM (SELECT 'documents' AS dataset FROM documents UNION ALL SELECT 'pages' FROM pages UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY dataset",
)
def dataset_counts(spark, sf_dir):
    named = [table(spark, sf_dir, n).select(F.lit(n).alias("dataset")) for n in ("documents", "pages", "benchmark")]
    return ordinal.count_by_dataset(ordinal.concat_datasets(*named))


@query(
    "appended_listings",
    "SELECT 0 AS part, min(page_id) AS first_id, count(*) AS n FROM pages UNION ALL SELECT 1, min(item_id), count(*) FROM benchmark",
)
def appended(spark, sf_dir):
    both = ordinal.append_listings(
        table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")),
        table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")),
    )
    return both.groupBy("part").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


_LEFT = "replace(url, '.example.', '/left/')"


@query(
    "derived_paths",
    rf"""SELECT page_id,
      regexp_replace(replace({_LEFT}, '/left/', '/disparity/'), '^((?:.*/)?\.*[^./][^/]*)\.[^./]*$', '\1') || '.npy' AS derived,
      replace(url, 'example', 'sample') AS swapped, regexp_extract(url, '[^/]*$') AS base,
      split_part(regexp_extract(url, '[^/]*$'), '.', 1) AS stem, regexp_replace(url, '/[^/]*$', '') AS dir,
      '/root/' || regexp_extract(url, '[^/]*$') AS joined
    FROM pages""",
)
def derived(spark, sf_dir):
    url = F.col("url")
    left = paths.swap_path(url, ".example.", "/left/")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        paths.derived_path(left, "disparity", "npy").alias("derived"),
        paths.swap_path(url, "example", "sample").alias("swapped"),
        paths.basename(url).alias("base"),
        paths.stem(url).alias("stem"),
        paths.dirname(url).alias("dir"),
        paths.join_path("/root", paths.basename(url)).alias("joined"),
    )


@query(
    "sidecar_lookup",
    f"""WITH c AS (SELECT user_id, max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS fx FROM events GROUP BY user_id)
    SELECT e.event_id, fx, {r6_sql('fx * 6 * 100 / (e.value + 1)')} AS disp FROM events e JOIN c USING (user_id)""",
)
def sidecar(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cameras = events.groupBy("user_id").agg(F.max(json_field(F.col("props"), "$.k").cast("double")).alias("fx"))
    raw = lookup_join(events.select("event_id", "user_id", "value"), cameras, ["user_id"])
    disp, _ = falling_things(F.col("value") + 1, F.col("fx"))
    return raw.select("event_id", "fx", r6(disp).alias("disp"))


# --- queue ------------------------------------------------------------------------------------


def _tasks(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("task_id"),
        F.concat("event_type", F.lit("_"), F.col("event_id").cast("string")).alias("filename"),
        F.encode("event_type", "UTF-8").alias("content"),
        F.col("ts").cast("timestamp").alias("uploaded_at"),
    )


def _results(spark, sf_dir):
    done = _tasks(spark, sf_dir).filter("filename NOT LIKE 'error%'")
    return done.select(
        F.concat(F.lit("result-"), F.col("task_id").cast("string")).alias("result_id"),
        F.col("task_id").alias("parent_id"),
        F.concat(F.lit("result_"), "filename").alias("filename"),
        F.lit(queue.RESULT_TYPE).alias("type"),
        "content",
    )


@query("queue_pending", "SELECT event_id AS task_id FROM events WHERE event_type = 'error'")
def pending(spark, sf_dir):
    return queue.pending(_tasks(spark, sf_dir), _results(spark, sf_dir)).select("task_id")


@query(
    "queue_status",
    "SELECT event_id AS task_id, CASE WHEN event_type = 'error' THEN 'waiting' ELSE 'done' END AS status FROM events",
)
def status(spark, sf_dir):
    return queue.task_status(_tasks(spark, sf_dir), _results(spark, sf_dir)).select("task_id", "status")


@query(
    "queue_results",
    "SELECT event_id AS parent_id, 'result_' || event_type || '_' || event_id AS filename, event_type || '_' || event_id AS task_filename FROM events WHERE event_type <> 'error'",
)
def results(spark, sf_dir):
    linked = queue.link_results(_tasks(spark, sf_dir), _results(spark, sf_dir))
    return linked.select("parent_id", "filename", "task_filename")


@query(
    "queue_next",
    "SELECT event_id AS task_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 1",
)
def next_task(spark, sf_dir):
    """The first waiting task: the limit is the feature."""
    return queue.next_task(_tasks(spark, sf_dir), _results(spark, sf_dir)).select("task_id")


@query(
    "queue_stream",
    "SELECT event_id AS parent_id, 'result_' || event_type || '_' || event_id AS filename, 'disparity_map' AS type FROM events WHERE event_type <> 'error'",
)
def stream(spark, sf_dir):
    """Land all tasks, let the streaming worker drain them, and read what it published."""
    base = f"{ensure_checkpoint_dir(spark)}/queue-{uuid.uuid4().hex}"
    _tasks(spark, sf_dir).write.parquet(f"{base}/tasks")

    def apply(_, content):
        if content == b"error":
            raise ValueError("cannot process")
        return content

    queue.drain(
        queue.task_stream(spark, f"{base}/tasks"), f"{base}/results", f"{base}/progress", lambda: None, apply
    ).awaitTermination()
    return queue.read_results(spark, f"{base}/results").select("parent_id", "filename", "type")
