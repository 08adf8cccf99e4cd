"""Queries on correlation and cost volumes. A line of 64 values is read as 8 pixels of 8 channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.operators import cost
from scanmill.plans.registry import query, r6, r6_sql
from scanmill.plans.views import FEAT, HT, PAIR, PX, feature_pairs, raster

_BASE = f"WITH {PX}, {PAIR}, {FEAT}"
_CORR = f"""{_BASE}, co AS (SELECT a.image_id, a.y, a.x, b.x AS x2, list_dot_product(a.l, b.r) / sqrt(8.0::DOUBLE) AS c
  FROM ft a JOIN ft b ON a.image_id = b.image_id AND a.y = b.y)"""
_BAND = f"""{_BASE}, dd AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS d),
  bd AS (SELECT a.image_id, a.y, a.x, d, a.l, b.r FROM ft a CROSS JOIN dd
    LEFT JOIN ft b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x - d)"""


@query("row_correlation", f"{_CORR} SELECT image_id, y, x, x2, {r6_sql('c')} AS c FROM co")
def row_correlation(spark, sf_dir):
    lines = cost.row_correlation(feature_pairs(spark, sf_dir), plan="line")
    rows = lines.select("image_id", "y", F.posexplode_outer("corr").alias("x", "row"))
    return rows.select("image_id", "y", "x", F.posexplode_outer("row").alias("x2", "c")).withColumn("c", r6(F.col("c")))


@query("row_correlation_by_pixel", f"{_CORR} SELECT image_id, y, x, x2, {r6_sql('c * sqrt(8.0::DOUBLE)')} AS c FROM co")
def row_correlation_by_pixel(spark, sf_dir):
    px = cost.row_correlation(feature_pairs(spark, sf_dir), scale=False, plan="pixel")
    return px.select("image_id", "y", "x", F.posexplode_outer("corr").alias("x2", "c")).withColumn("c", r6(F.col("c")))


@query(
    "correlation_pyramid",
    f"{_CORR} SELECT image_id, y, x, CAST(x2 // 2 AS INTEGER) AS k, {r6_sql('avg(c)')} AS c FROM co GROUP BY image_id, y, x, x2 // 2",
)
def pyramid(spark, sf_dir):
    pyr = cost.pyramid(cost.row_correlation(feature_pairs(spark, sf_dir), plan="pixel"), 2)
    return pyr.select("image_id", "y", "x", F.posexplode_outer("corr_l1").alias("k", "c")).withColumn("c", r6(F.col("c")))


_COORD = "x + (y % 5) * 0.3::DOUBLE - 0.7::DOUBLE"
_TAPS = f"""lv AS (SELECT image_id, y, x, 0 AS lvl, x2 AS j, c FROM co UNION ALL
    SELECT image_id, y, x, 1 AS lvl, x2 // 2 AS j, avg(c) AS c FROM co GROUP BY image_id, y, x, x2 // 2),
  q AS (SELECT image_id, y, x, lvl, k, ({_COORD}) / pow(2, lvl) + k AS p FROM ft
    CROSS JOIN (SELECT unnest([0, 1]) AS lvl) CROSS JOIN (SELECT unnest(range(-2, 3)) AS k)),
  tp AS (SELECT q.image_id, q.y, q.x, CAST(q.lvl * 5 + q.k + 2 AS INTEGER) AS k,
      coalesce(a.c, 0) * (1 - (p - floor(p))) + coalesce(b.c, 0) * (p - floor(p)) AS c,
      p > 0 AND p < (8 // CAST(pow(2, q.lvl) AS INTEGER)) - 1 AS inside FROM q
    LEFT JOIN lv a ON a.image_id = q.image_id AND a.y = q.y AND a.x = q.x AND a.lvl = q.lvl AND a.j = floor(p)
    LEFT JOIN lv b ON b.image_id = q.image_id AND b.y = q.y AND b.x = q.x AND b.lvl = q.lvl AND b.j = floor(p) + 1)"""


def _coords():
    return F.col("x") + F.pmod("y", F.lit(5)) * 0.3 - 0.7


@query("correlation_lookup", f"{_CORR}, {_TAPS} SELECT image_id, y, x, k, {r6_sql('c')} AS c, inside FROM tp")
def lookup(spark, sf_dir):
    pyr = cost.pyramid(cost.row_correlation(feature_pairs(spark, sf_dir), plan="pixel"), 2)
    found = cost.lookup(pyr, _coords(), radius=2, levels=2, flag="inside")
    cells = F.arrays_zip(F.col("taps").alias("c"), F.col("inside").alias("inside"))
    px = found.select("image_id", "y", "x", F.posexplode_outer(cells).alias("k", "e"))
    return px.select("image_id", "y", "x", "k", r6(F.col("e.c")).alias("c"), F.col("e.inside").alias("inside"))


@query("feature_lookup", f"{_CORR}, {_TAPS} SELECT image_id, y, x, k, {r6_sql('c')} AS c FROM tp")
def feature_lookup(spark, sf_dir):
    lines = feature_pairs(spark, sf_dir).withColumn(
        "coords", F.transform("left", lambda l, x: x + F.pmod("y", F.lit(5)) * 0.3 - 0.7)
    )
    px = cost.lookup_features(lines, "coords", radius=2, levels=2)
    return px.select("image_id", "y", "x", F.posexplode_outer("taps").alias("k", "c")).withColumn("c", r6(F.col("c")))


@query(
    "combined_lookup",
    # all joins are on equal whole numbers, and every step that is used twice is materialised
    f"""WITH {PX}, {PAIR}, {FEAT.replace('ft AS (', 'ft AS MATERIALIZED (', 1)},
    co AS MATERIALIZED (SELECT a.image_id, a.y, a.x, b.x AS x2, list_dot_product(a.l, b.r) AS c FROM ft a JOIN ft b ON a.image_id = b.image_id AND a.y = b.y),
    ge AS MATERIALIZED (SELECT a.image_id, a.y, a.x, a.d, g, list_dot_product(a.l[g * 4 + 1:g * 4 + 4], b.r[g * 4 + 1:g * 4 + 4]) / 4 AS c
      FROM (SELECT image_id, y, x, l, CAST(unnest(range(4)) AS INTEGER) AS d FROM ft) a
      JOIN ft b ON a.image_id = b.image_id AND a.y = b.y AND b.x = a.x - a.d CROSS JOIN (SELECT unnest([0, 1]) AS g)),
    lv AS MATERIALIZED (SELECT image_id, y, x, 0 AS lvl, 2 AS part, x2::BIGINT AS j, c FROM co
      UNION ALL SELECT image_id, y, x, 1, 2, x2 // 2, avg(c) FROM co GROUP BY image_id, y, x, x2 // 2
      UNION ALL SELECT image_id, y, x, 0, g, d, c FROM ge
      UNION ALL SELECT image_id, y, x, 1, g, d // 2, sum(c) / 2 FROM ge GROUP BY image_id, y, x, g, d // 2),
    taps AS (SELECT image_id, y, x, lvl, part, k, CASE WHEN part = 2 THEN x / pow(2, lvl) - (1 + (y % 3) * 0.4::DOUBLE) / pow(2, lvl) ELSE (1 + (y % 3) * 0.4::DOUBLE) / pow(2, lvl) END + k AS p
      FROM ft CROSS JOIN (SELECT unnest([0, 1]) AS lvl) CROSS JOIN (SELECT unnest([0, 1, 2]) AS part) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k)),
    ends AS (SELECT image_id, y, x, lvl, part, k, floor(p)::BIGINT + s AS j, CASE s WHEN 0 THEN 1 - (p - floor(p)) ELSE p - floor(p) END AS share
      FROM taps CROSS JOIN (SELECT unnest([0, 1]) AS s))
    SELECT e.image_id, e.y, e.x, CAST(e.lvl * 9 + e.part * 3 + e.k + 1 AS INTEGER) AS k, {r6_sql('sum(coalesce(lv.c, 0) * share)')} AS c
    FROM ends e LEFT JOIN lv ON lv.image_id = e.image_id AND lv.y = e.y AND lv.x = e.x AND lv.lvl = e.lvl AND lv.part = e.part AND lv.j = e.j
    GROUP BY e.image_id, e.y, e.x, e.lvl, e.part, e.k""",
)
def combined(spark, sf_dir):
    """Both the group volume around the disparity and the correlation around x - disparity."""
    pairs = feature_pairs(spark, sf_dir)
    zeros = F.array_repeat(F.lit(0.0), 2)
    # volume and correlation of a pixel come from the same line, so one pass makes both
    volume = lambda l, x: F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda d: F.when(d <= x, cost.group_mean_product(l, F.get("right", x - d), 2)).otherwise(zeros),
    )
    cells = F.transform("left", lambda l, x: F.struct(
        F.transform("right", lambda r: cost.corr(l, r)).alias("corr"), cost.groups_first(volume(l, x), 2).alias("geo")))
    both = pairs.select("image_id", "y", F.posexplode_outer(cells).alias("x", "c")).select("image_id", "y", "x", "c.corr", "c.geo")
    pyr = cost.group_pyramid(cost.pyramid(both, 2), 2)
    found = cost.combined_lookup(pyr, 1 + F.pmod("y", F.lit(3)) * 0.4, F.col("x"), radius=1, levels=2)
    return found.select("image_id", "y", "x", F.posexplode_outer("taps").alias("k", "c")).withColumn("c", r6(F.col("c")))


def _volume_rows(volume):
    return volume.select("image_id", "y", "x", F.posexplode_outer("cost").alias("d", "cost"))


@query(
    "gwc_volume",
    f"""{_BAND} SELECT image_id, y, x, d, CAST(g AS INTEGER) AS g, {r6_sql('coalesce(list_dot_product(l[g * 4 + 1:g * 4 + 4], r[g * 4 + 1:g * 4 + 4]) / 4, 0)')} AS cost
    FROM bd CROSS JOIN (SELECT unnest([0, 1]) AS g)""",
)
def gwc(spark, sf_dir):
    rows = _volume_rows(cost.gwc_volume(feature_pairs(spark, sf_dir), 4, 2))
    return rows.select("image_id", "y", "x", "d", F.posexplode_outer("cost").alias("g", "cost")).withColumn("cost", r6(F.col("cost")))


@query(
    "norm_volume",
    f"""{_BAND} SELECT image_id, y, x, d, {r6_sql('coalesce(list_dot_product(l, r) / ((sqrt(list_dot_product(l, l)) + 1e-5) * (sqrt(list_dot_product(r, r)) + 1e-5)) / 8, 0)')} AS cost FROM bd""",
)
def norm(spark, sf_dir):
    return _volume_rows(cost.norm_volume(feature_pairs(spark, sf_dir), 4)).withColumn("cost", r6(F.col("cost")))


@query("corr_volume", f"{_BAND} SELECT image_id, y, x, d, {r6_sql('coalesce(list_dot_product(l, r), 0)')} AS cost FROM bd")
def corr(spark, sf_dir):
    return _volume_rows(cost.corr_volume(feature_pairs(spark, sf_dir), 4)).withColumn("cost", r6(F.col("cost")))


@query(
    "concat_volume",
    f"""{_BAND} SELECT image_id, y, x, d, CAST(k - 1 AS INTEGER) AS k,
      {r6_sql('CASE WHEN k <= 8 THEN l[k] ELSE coalesce(r[k - 8], 0) END')} AS v FROM bd CROSS JOIN (SELECT unnest(range(1, 17)) AS k)""",
)
def concat(spark, sf_dir):
    rows = _volume_rows(cost.concat_volume(feature_pairs(spark, sf_dir), 4))
    return rows.select("image_id", "y", "x", "d", F.posexplode_outer("cost").alias("k", "v")).withColumn("v", r6(F.col("v")))


@query(
    "band_pairs",
    f"{_BAND} SELECT image_id, y, d, count(*) AS pairs, {r6_sql('sum(list_dot_product(l, r))')} AS total FROM bd WHERE r IS NOT NULL GROUP BY image_id, y, d",
)
def band(spark, sf_dir):
    pairs = cost.band_pairs(feature_pairs(spark, sf_dir), 4)
    return pairs.groupBy("image_id", "y", "d").agg(
        F.count(F.lit(1)).alias("pairs"), r6(F.sum(cost.corr(F.col("l"), F.col("r")))).alias("total")
    )


@query(
    "soft_argmin",
    f"""{_BAND}, e AS (SELECT image_id, y, x, d, exp(coalesce(list_dot_product(l, r), 0)) AS e FROM bd)
    SELECT image_id, y, x, {r6_sql('sum(d * e) / sum(e)')} AS disp FROM e GROUP BY image_id, y, x""",
)
def argmin(spark, sf_dir):
    volume = cost.corr_volume(feature_pairs(spark, sf_dir), 4)
    return volume.select("image_id", "y", "x", r6(cost.soft_argmin(F.col("cost"))).alias("disp"))


def _weight(x, y, k):
    return (k + F.pmod(x, F.lit(3)) + F.pmod(y, F.lit(2)) + 1) / 45.0


def _upsample_sql(weight: str) -> str:
    return f"""WITH {PX}, {HT}, ys AS (SELECT image_id, h, CAST(unnest(range(2 * h)) AS INTEGER) AS y FROM ht),
    g AS (SELECT image_id, h, y, CAST(unnest(range(128)) AS INTEGER) AS x FROM ys),
    w AS (SELECT g.*, k, (k + x % 3 + y % 2 + 1) / 45.0::DOUBLE AS wt FROM g CROSS JOIN (SELECT unnest(range(9)) AS k)),
    n AS (SELECT w.*, exp(wt) / sum(exp(wt)) OVER (PARTITION BY image_id, y, x) AS soft FROM w)
    SELECT n.image_id, n.y, n.x, {r6_sql(f'sum({weight} * 2 * coalesce(v, 0))')} AS v FROM n
    LEFT JOIN px ON px.image_id = n.image_id AND px.y = n.y // 2 + k // 3 - 1 AND px.x = n.x // 2 + k % 3 - 1
    GROUP BY n.image_id, n.y, n.x"""


def _upsampled(spark, sf_dir, normalise):
    low = raster(spark, sf_dir)
    rows = low.select("image_id", "w", F.explode_outer(F.sequence(F.col("y") * 2, F.col("y") * 2 + 1)).alias("y"))
    wts = F.transform(
        F.sequence(F.lit(0), F.col("w") * 2 - 1),
        lambda x: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: _weight(x, F.col("y"), k)),
    )
    weights = rows.select("image_id", "y", wts.alias("wts"))
    up = cost.convex_upsample(low, weights, 2, scale=2.0, normalise=normalise)
    px = up.select("image_id", "y", F.posexplode_outer("vals").alias("x", "v"))
    return px.withColumn("v", r6(F.col("v")))


@query("convex_upsample", _upsample_sql("wt"))
def upsample(spark, sf_dir):
    return _upsampled(spark, sf_dir, False)


@query("convex_upsample_softmax", _upsample_sql("soft"))
def upsample_softmax(spark, sf_dir):
    return _upsampled(spark, sf_dir, True)
