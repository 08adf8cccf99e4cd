"""Queries on depth, disparity and warping."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.operators.depth import (
    adaptive_disparity,
    confidence,
    cut_edges,
    forward_interpolate,
    minmax,
    nearest_fill,
    normalize_depth,
)
from scanmill.operators.grid import to_pixels
from scanmill.operators.warp import backward_warp, forward_warp, inpaint_mask, non_occlusion, shifted, warped_real_mask
from scanmill.plans.registry import query, r6, r6_sql
from scanmill.plans.views import HT, PAIR, PX, SHIFT, quarter_disparity, raster, stereo_pairs

RANGE = "rg AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY image_id)"
NORM = """nm AS (SELECT image_id, y, x, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) END AS n
  FROM px JOIN rg USING (image_id))"""
U1, U2 = "(image_id * 37 % 100) / 100.0", "(image_id * 61 % 100) / 100.0"


def _u1():
    return F.pmod(F.col("image_id") * 37, F.lit(100)) / 100.0


def _u2():
    return F.pmod(F.col("image_id") * 61, F.lit(100)) / 100.0


def _pixels(lines, cols, names):
    px = to_pixels(lines, cols, names)
    return px.drop("ch")


@query("image_range", f"WITH {PX} SELECT image_id, {r6_sql('min(v)')} AS lo, {r6_sql('max(v)')} AS hi FROM px GROUP BY image_id")
def image_range(spark, sf_dir):
    return minmax(raster(spark, sf_dir)).select("image_id", r6(F.col("vals_min")).alias("lo"), r6(F.col("vals_max")).alias("hi"))


@query("depth_normalize", f"WITH {PX}, {RANGE}, {NORM} SELECT image_id, y, x, {r6_sql('n')} AS v FROM nm")
def depth_normalize(spark, sf_dir):
    px = _pixels(normalize_depth(raster(spark, sf_dir)), ["vals"], ["v"])
    return px.withColumn("v", r6(F.col("v")))


@query(
    "flip_confidence",
    f"""WITH {PX}, fl AS (
      SELECT a.image_id, a.y, a.x, a.v AS a, b.v * (1 + 0.01::DOUBLE * b.x) AS b
      FROM px a JOIN px b ON a.image_id = b.image_id AND a.y = b.y AND b.x = 63 - a.x),
    r AS (SELECT image_id, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM fl GROUP BY image_id),
    c AS (SELECT image_id, y, x, 1 - abs((a - la) / (ha - la) - (b - lb) / (hb - lb)) AS c FROM fl JOIN r USING (image_id)),
    q AS (SELECT image_id, min(c) AS lc, max(c) AS hc FROM c GROUP BY image_id)
    SELECT image_id, y, x, {r6_sql('(c - lc) / (hc - lc)')} AS conf FROM c JOIN q USING (image_id)""",
)
def flip_confidence(spark, sf_dir):
    lines = raster(spark, sf_dir).withColumn("depth", F.col("vals")).withColumn(
        "depth_flipped", F.transform("vals", lambda v, x: v * (1 + 0.01 * x))
    )
    px = _pixels(confidence(lines), ["conf"], ["conf"])
    return px.withColumn("conf", r6(F.col("conf")))


@query(
    "adaptive_disparity",
    f"""WITH {PX}, {RANGE}, {NORM}, dr AS (SELECT DISTINCT image_id, {U1} AS u1, {U2} AS u2 FROM px),
    k AS (SELECT image_id,
      CASE WHEN u1 < 0.1 THEN 0.0 WHEN u1 > 0.9 THEN 0.15 ELSE 0.05 END * 64.0::DOUBLE AS lo,
      CASE WHEN u1 < 0.1 THEN 0.05 WHEN u1 > 0.9 THEN 0.2 ELSE 0.15 END * 64.0::DOUBLE AS hi, u2 FROM dr)
    SELECT image_id, y, x, {r6_sql('n * (lo + u2 * (hi - lo))')} AS disp FROM nm JOIN k USING (image_id)""",
)
def adaptive(spark, sf_dir):
    lines = normalize_depth(raster(spark, sf_dir))
    px = _pixels(adaptive_disparity(lines, u1=_u1(), u2=_u2()), ["disp"], ["disp"])
    return px.withColumn("disp", r6(F.col("disp")))


@query(
    "cut_edges",
    f"""WITH {PX}, {HT},
    dl AS MATERIALIZED (SELECT a.image_id, a.y, a.x, max(b.v * 40) AS v FROM px a JOIN px b
      ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
      WHERE abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY a.image_id, a.y, a.x),
    nb AS MATERIALIZED (SELECT a.image_id, a.y, a.x, dy, dx, greatest(0, least(h - 1, a.y + dy)) AS ny, greatest(0, least(63, a.x + dx)) AS nx
      FROM dl a JOIN ht USING (image_id) CROSS JOIN (SELECT unnest([-1,0,1]) AS dy) CROSS JOIN (SELECT unnest([-1,0,1]) AS dx)),
    st AS (SELECT nb.image_id, nb.y, nb.x, dy, dx, b.v FROM nb JOIN dl b ON b.image_id = nb.image_id AND b.y = nb.ny AND b.x = nb.nx),
    mg AS (SELECT image_id, y, x, sqrt((pow(sum(dx * (2 - abs(dy)) * v) / 4, 2) + pow(sum(dy * (2 - abs(dx)) * v) / 4, 2)) / 2) AS m
      FROM st GROUP BY ALL)
    SELECT d.image_id, d.y, d.x, m > 3 AS hole, {r6_sql('CASE WHEN m > 3 THEN 0 ELSE v END')} AS v
    FROM dl d JOIN mg USING (image_id, y, x)""",
)
def edges(spark, sf_dir):
    lines = raster(spark, sf_dir).withColumn("vals", F.transform("vals", lambda v: v * 40))
    px = _pixels(cut_edges(lines), ["vals", "hole"], ["v", "hole"])
    return px.withColumn("v", r6(F.col("v")))


@query(
    "nearest_fill",
    f"""WITH {PX}, ho AS (SELECT * FROM px WHERE v < 0.12), kn AS (SELECT * FROM px WHERE NOT v < 0.12),
    best AS (SELECT h.image_id, h.y, h.x,
        arg_min(k.v, (CAST((h.y - k.y) * (h.y - k.y) + (h.x - k.x) * (h.x - k.x) AS BIGINT) * 64 + k.y) * 64 + k.x) AS v
      FROM ho h JOIN kn k USING (image_id) GROUP BY ALL)
    SELECT image_id, y, x, {r6_sql('v')} AS v FROM best UNION ALL SELECT image_id, y, x, {r6_sql('v')} AS v FROM kn""",
)
def fill(spark, sf_dir):
    lines = raster(spark, sf_dir).withColumn("hole", F.transform("vals", lambda v: v < 0.12))
    px = _pixels(nearest_fill(lines), ["vals"], ["v"])
    return px.withColumn("v", r6(F.col("v")))


NOCC = """hit AS (
  SELECT a.image_id, a.y, a.x,
    bool_or(floor(b.s) = floor(a.s) OR ceil(b.s) = floor(a.s)) AS dn,
    bool_or(floor(b.s) = ceil(a.s) OR ceil(b.s) = ceil(a.s)) AS up
  FROM sh a JOIN sh b ON a.image_id = b.image_id AND a.y = b.y AND b.x >= a.x + 2 GROUP BY ALL),
nocc AS (
  SELECT image_id, y, x, v, d, s, s > 0 AND (NOT coalesce(dn, false) OR NOT coalesce(up, false)) AS keep
  FROM sh LEFT JOIN hit USING (image_id, y, x))"""


def _splat_sql(strict: bool) -> str:
    moved = (
        "SELECT image_id, y, x, v, s AS p FROM nocc WHERE keep"
        if strict
        else "SELECT image_id, y, x, v, CASE WHEN keep THEN s ELSE -64.0 END AS p FROM nocc"
    )
    return f"""{PX}, {SHIFT}, {NOCC}, mv AS ({moved}),
    c AS (SELECT image_id, y, x, v, p, greatest(0, least(63, ceil(p))) AS tu, greatest(0, least(63, floor(p))) AS td FROM mv),
    up AS (SELECT image_id, y, tu AS t, tu - p AS wu, v AS vu FROM c
      QUALIFY row_number() OVER (PARTITION BY image_id, y, tu ORDER BY tu - p, x DESC) = 1),
    dn AS (SELECT image_id, y, td AS t, 1 - (tu - p) AS wd, v AS vd FROM c
      QUALIFY row_number() OVER (PARTITION BY image_id, y, td ORDER BY 1 - (tu - p), x DESC) = 1),
    pl AS (SELECT g.image_id, g.y, g.x, coalesce(wu, 10000) AS wu, coalesce(wd, 10000) AS wd,
        coalesce(vu, 0) AS vu, coalesce(vd, 0) AS vd, wu IS NULL AND wd IS NULL AS hole
      FROM px g LEFT JOIN up ON up.image_id = g.image_id AND up.y = g.y AND up.t = g.x
      LEFT JOIN dn ON dn.image_id = g.image_id AND dn.y = g.y AND dn.t = g.x)"""


_COLOR = r6_sql("CASE WHEN hole THEN 0 ELSE vu * (wd / (wu + wd + 1e-7)) + vd * (wu / (wu + wd + 1e-7)) END")


@query("non_occlusion", f"WITH {PX}, {SHIFT}, {NOCC} SELECT image_id, y, x, keep FROM nocc")
def nocc(spark, sf_dir):
    lines = raster(spark, sf_dir).withColumn("keep", non_occlusion(shifted(quarter_disparity())))
    return _pixels(lines, ["keep"], ["keep"])


def _warped(spark, sf_dir, compat):
    lines = raster(spark, sf_dir).withColumn("disp", quarter_disparity())
    px = _pixels(forward_warp(lines, compat), ["vals", "mask_inpaint"], ["v", "hole"])
    return px.withColumn("v", r6(F.col("v")))


@query("forward_warp", f"WITH {_splat_sql(False)} SELECT image_id, y, x, {_COLOR} AS v, hole FROM pl")
def warp_reference(spark, sf_dir):
    return _warped(spark, sf_dir, "reference")


@query("forward_warp_strict", f"WITH {_splat_sql(True)} SELECT image_id, y, x, {_COLOR} AS v, hole FROM pl")
def warp_strict(spark, sf_dir):
    return _warped(spark, sf_dir, "strict")


@query(
    "inpaint_mask",
    f"WITH {_splat_sql(False)} SELECT image_id, CAST(sum(CASE WHEN hole THEN 1 ELSE 0 END) AS BIGINT) AS holes FROM pl GROUP BY image_id",
)
def holes(spark, sf_dir):
    lines = raster(spark, sf_dir).withColumn("disp", quarter_disparity())
    masks = inpaint_mask(lines)
    per_line = F.size(F.filter("mask_inpaint", lambda m: m)).cast("long")
    return masks.groupBy("image_id").agg(F.sum(per_line).alias("holes"))


@query(
    "backward_warp",
    f"""WITH {PX}, {PAIR}, p AS (SELECT image_id, y, x, greatest(0.0::DOUBLE, least(63.0::DOUBLE, x - (l + 0.6) * 10)) AS q FROM pr),
    t AS (SELECT p.*, a.r AS r0, b.r AS r1 FROM p
      LEFT JOIN pr a ON a.image_id = p.image_id AND a.y = p.y AND a.x = floor(q)
      LEFT JOIN pr b ON b.image_id = p.image_id AND b.y = p.y AND b.x = floor(q) + 1)
    SELECT image_id, y, x, {r6_sql('r0 * (1 - (q - floor(q))) + coalesce(r1, 0) * (q - floor(q))')} AS v FROM t""",
)
def warp_back(spark, sf_dir):
    pairs = stereo_pairs(spark, sf_dir).withColumn("disp", F.transform("left", lambda v: (v + 0.6) * 10))
    px = _pixels(pairs.withColumn("v", backward_warp(F.col("right"), F.col("disp"))), ["v"], ["v"])
    return px.withColumn("v", r6(F.col("v")))


@query(
    "backward_warp_zeros",
    f"""WITH {PX}, {PAIR}, p AS (SELECT image_id, y, x, x - (l * 30) AS q FROM pr),
    t AS (SELECT p.*, a.r AS r0, b.r AS r1 FROM p
      LEFT JOIN pr a ON a.image_id = p.image_id AND a.y = p.y AND a.x = floor(q)
      LEFT JOIN pr b ON b.image_id = p.image_id AND b.y = p.y AND b.x = floor(q) + 1)
    SELECT image_id, y, x, {r6_sql('coalesce(r0, 0) * (1 - (q - floor(q))) + coalesce(r1, 0) * (q - floor(q))')} AS v FROM t""",
)
def warp_back_zeros(spark, sf_dir):
    pairs = stereo_pairs(spark, sf_dir).withColumn("disp", F.transform("left", lambda v: v * 30))
    px = _pixels(pairs.withColumn("v", backward_warp(F.col("right"), F.col("disp"), "zeros")), ["v"], ["v"])
    return px.withColumn("v", r6(F.col("v")))


@query(
    "warped_validity",
    f"""WITH {_splat_sql(False)}
    SELECT a.image_id, a.y, a.x, coalesce(NOT b.hole, false) AS real
    FROM sh a LEFT JOIN pl b ON b.image_id = a.image_id AND b.y = a.y AND b.x = round_even(a.s, 0)""",
)
def validity(spark, sf_dir):
    lines = forward_warp(raster(spark, sf_dir).withColumn("disp", quarter_disparity()))
    real = warped_real_mask(F.col("mask_inpaint"), F.col("disp"))
    return _pixels(lines.withColumn("real", real), ["real"], ["real"])


@query(
    "kept_pixels",
    f"""WITH {PX}, {RANGE}, {NORM}, dr AS (SELECT DISTINCT image_id, {U1} AS u1, {U2} AS u2 FROM px),
    k AS (SELECT image_id,
      CASE WHEN u1 < 0.1 THEN 0.0 WHEN u1 > 0.9 THEN 0.15 ELSE 0.05 END * 64.0::DOUBLE AS lo,
      CASE WHEN u1 < 0.1 THEN 0.05 WHEN u1 > 0.9 THEN 0.2 ELSE 0.15 END * 64.0::DOUBLE AS hi, u2 FROM dr),
    sh AS (SELECT image_id, y, x, n AS v, n AS d, x - n * (lo + u2 * (hi - lo)) AS s FROM nm JOIN k USING (image_id)),
    {NOCC}
    SELECT image_id, CAST(sum(CASE WHEN keep THEN 1 ELSE 0 END) AS BIGINT) AS kept, count(*) AS pixels
    FROM nocc GROUP BY image_id""",
)
def kept_pixels(spark, sf_dir):
    """Per image: how many pixels stay visible from the other view."""
    lines = adaptive_disparity(normalize_depth(raster(spark, sf_dir)), u1=_u1(), u2=_u2())
    kept = lines.select("image_id", non_occlusion(shifted(F.col("disp"))).alias("keep"))
    return kept.groupBy("image_id").agg(
        F.sum(F.size(F.filter("keep", lambda k: k)).cast("long")).alias("kept"),
        F.sum(F.size("keep").cast("long")).alias("pixels"),
    )


@query("forward_interpolate", f"""
WITH fl AS (
  SELECT vec_id // 64 AS image_id, CAST(vec_id % 64 AS INTEGER) AS y, x,
         floor((CAST(embedding[x + 1] AS DOUBLE) + 0.6) * 40) / 4 - 6 AS dx,
         (floor((CAST(embedding[x + 33] AS DOUBLE) + 0.6) * 40) / 4 - 6) * 2 AS dy
  FROM embeddings, (SELECT CAST(unnest(range(32)) AS INTEGER) AS x)),
{HT},
mv AS (
  SELECT image_id, y, x, x + dx AS px, y + dy AS py, dx, dy FROM fl JOIN ht USING (image_id)
  WHERE x + dx > 0 AND x + dx < 32 AND y + dy > 0 AND y + dy < h),
best AS (
  SELECT f.image_id, f.y, f.x, min(((m.px - f.x) * (m.px - f.x) + (m.py - f.y) * (m.py - f.y)) * 16 * 4096 + m.y * 64 + m.x) AS place
  FROM fl f JOIN mv m USING (image_id) GROUP BY ALL)
SELECT b.image_id, b.y, b.x, {r6_sql('m.dx')} AS dx, {r6_sql('m.dy')} AS dy
FROM best b JOIN mv m ON m.image_id = b.image_id AND m.y * 64 + m.x = CAST(b.place AS BIGINT) % 4096
""")
def nearest_moved(spark, sf_dir):
    """A line of 64 values read as the flow of 32 pixels, in quarter pixels, so that many moved pixels are equally near."""
    step = lambda part, scale: F.transform(part, lambda v: (F.floor((v + 0.6) * 40) / 4 - 6) * scale)
    flow = raster(spark, sf_dir).select(
        "image_id", "y", "h", F.lit(32).alias("w"), step(F.slice("vals", 1, 32), 1).alias("dx"), step(F.slice("vals", 33, 32), 2).alias("dy"))
    found = forward_interpolate(flow)
    cells = F.posexplode(F.arrays_zip("dx", "dy")).alias("x", "c")
    return found.select("image_id", "y", cells).select("image_id", "y", "x", r6(F.col("c.dx")).alias("dx"), r6(F.col("c.dy")).alias("dy"))
