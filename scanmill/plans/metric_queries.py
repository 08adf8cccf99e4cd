"""Queries on error statistics and losses. Image k predicts, image k+1 is the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.operators import metrics
from scanmill.operators.grid import to_pixels
from scanmill.plans.registry import query, r6, r6_sql
from scanmill.plans.views import PAIR, PX, stereo_pairs, table
from scanmill.sources.registry import evaluation_registry

_E = """er AS (SELECT image_id, y, x, abs((l + 0.6) * 10 - (r + 0.6) * 10) AS e, (r + 0.6) * 10 AS g FROM pr WHERE r > -0.4)"""
_RATES = ", ".join(
    [f"{r6_sql('avg(e)')} AS epe"]
    + [f"{r6_sql(f'avg(CASE WHEN e < {k} THEN 1.0::DOUBLE ELSE 0 END)')} AS px{k}" for k in (1, 3, 5)]
)


def _scored(spark, sf_dir):
    return stereo_pairs(spark, sf_dir).select(
        "image_id", "ch", "y", "h", "w", "left", "right",
        F.transform("left", lambda v: (v + 0.6) * 10).alias("pred"),
        F.transform("right", lambda v: (v + 0.6) * 10).alias("gt"),
        F.transform("right", lambda v: v > -0.4).alias("valid"),
    )


def _rounded(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


@query("epe_metrics", f"WITH {PX}, {PAIR}, {_E} SELECT image_id, {_RATES} FROM er GROUP BY image_id")
def epe(spark, sf_dir):
    return _rounded(metrics.epe_metrics(_scored(spark, sf_dir), by=["image_id"]), "epe", "px1", "px3", "px5")


@query("epe_metrics_overall", f"WITH {PX}, {PAIR}, {_E} SELECT {_RATES} FROM er")
def epe_overall(spark, sf_dir):
    return _rounded(metrics.epe_metrics(_scored(spark, sf_dir)), "epe", "px1", "px3", "px5")


@query(
    "bad_pixel_rate",
    f"""WITH {PX}, {PAIR}, {_E}, reg AS (SELECT * FROM (VALUES (0, 'KITTI', 3), (1, 'Middlebury', 2), (2, 'ETH3D', 1)) t(k, dataset, outlier)),
    im AS (SELECT dataset, image_id, avg(e) AS epe, avg(CASE WHEN e > outlier THEN 1.0::DOUBLE ELSE 0 END) AS bad
      FROM er JOIN reg ON k = image_id % 3 GROUP BY dataset, image_id)
    SELECT dataset, {r6_sql('avg(epe)')} AS epe, {r6_sql('100 * avg(bad)')} AS bad_px, count(*) AS images FROM im GROUP BY dataset""",
)
def bad_pixels(spark, sf_dir):
    names = F.array(F.lit("KITTI"), F.lit("Middlebury"), F.lit("ETH3D"))
    lines = _scored(spark, sf_dir).withColumn("dataset", F.get(names, F.pmod("image_id", F.lit(3)).cast("int")))
    return _rounded(metrics.evaluate(lines, evaluation_registry(spark)), "epe", "bad_px")


@query("mae", f"WITH {PX}, {PAIR}, {_E} SELECT image_id, {r6_sql('avg(e)')} AS mae FROM er GROUP BY image_id")
def mae(spark, sf_dir):
    return _rounded(metrics.mae(_scored(spark, sf_dir), by=["image_id"]), "mae")


@query(
    "d1_all",
    f"""WITH {PX}, {PAIR}, {_E} SELECT image_id, {r6_sql('100 * avg(CASE WHEN e > 3 AND e > 0.05::DOUBLE * abs(g) THEN 1.0::DOUBLE ELSE 0 END)')} AS d1_all
    FROM er GROUP BY image_id""",
)
def d1(spark, sf_dir):
    return _rounded(metrics.d1_all(_scored(spark, sf_dir), by=["image_id"]), "d1_all")


@query(
    "masked_mean",
    f"""SELECT l_returnflag, l_linestatus, {r6_sql('avg(CASE WHEN l_quantity >= 25 THEN l_extendedprice / 1000 END)')} AS mean
    FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def masked(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    out = metrics.masked_mean(
        items, F.col("l_extendedprice") / 1000, F.col("l_quantity") >= 25, ["l_returnflag", "l_linestatus"]
    )
    return _rounded(out, "mean")


@query(
    "cross_shard_mean",
    f"""SELECT CAST(o_custkey % 10 AS BIGINT) AS step, o_orderpriority AS name, {r6_sql('avg(o_totalprice / 1000)')} AS value
    FROM orders GROUP BY o_custkey % 10, o_orderpriority""",
)
def shards(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.pmod("o_custkey", F.lit(10)).alias("step"),
        F.col("o_orderpriority").alias("name"),
        (F.col("o_totalprice") / 1000).alias("value"),
    )
    return _rounded(metrics.cross_shard_mean(orders), "value")


_ITERS = "it AS (SELECT unnest([0, 1, 2]) AS i)"
_GAMMA = "pow(pow(0.9::DOUBLE, 15 / 2.0::DOUBLE), 2 - i)"


@query(
    "sequence_loss",
    f"""WITH {PX}, {PAIR}, {_ITERS}, m AS (SELECT i, avg(abs((l + 0.6) * 10 * (1 + 0.1::DOUBLE * (2 - i)) - (r + 0.6) * 10)) AS m
      FROM pr CROSS JOIN it WHERE r > -0.4 GROUP BY i)
    SELECT {r6_sql(f'sum({_GAMMA} * m)')} AS loss FROM m""",
)
def sequence(spark, sf_dir):
    lines = _scored(spark, sf_dir).withColumn("iter", F.explode_outer(F.sequence(F.lit(0), F.lit(2))))
    flow = lines.withColumn("pred", F.transform("pred", lambda v: -v * (1 + 0.1 * (2 - F.col("iter")))))
    return _rounded(metrics.sequence_loss(flow, 3), "loss")


@query(
    "sequence_loss_gaps",
    f"""WITH {PX}, {PAIR}, {_ITERS}, m AS (SELECT image_id, i,
        avg(CASE WHEN r > -0.4 AND NOT (i = 1 AND image_id % 2 = 0) THEN abs((l + 0.6) * 10 * (1 + 0.1::DOUBLE * (2 - i)) - (r + 0.6) * 10) END) AS m
      FROM pr CROSS JOIN it GROUP BY image_id, i)
    SELECT image_id, CASE WHEN count(m) = 3 THEN {r6_sql(f'sum({_GAMMA} * m)')} END AS loss FROM m GROUP BY image_id""",
)
def sequence_gaps(spark, sf_dir):
    """Per image; the second prediction of every other image has no valid pixel, so its loss is null."""
    lines = _scored(spark, sf_dir).withColumn("iter", F.explode_outer(F.sequence(F.lit(0), F.lit(2))))
    flow = lines.withColumn("pred", F.transform("pred", lambda v: -v * (1 + 0.1 * (2 - F.col("iter")))))
    gap = (F.col("iter") == 1) & (F.pmod("image_id", F.lit(2)) == 0)
    holed = flow.withColumn("valid", F.when(gap, F.transform("valid", lambda v: F.lit(False))).otherwise(F.col("valid")))
    return _rounded(metrics.sequence_loss(holed, 3, by=["image_id"]), "loss")


def _mirror(i: str, n: str) -> str:
    return f"CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN 2 * ({n} - 1) - ({i}) ELSE {i} END"


def _ssim_sql(src: str, keys: str) -> str:
    """CTEs that turn ``src(keys, y, x, a, b)`` into ``ss(keys, y, x, a, b, ssim)``."""
    on = lambda p, q: " AND ".join(f"{p}.{k} = {q}.{k}" for k in keys.split(", "))
    pk = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""hs AS (SELECT image_id, CAST(max(y) + 1 AS INTEGER) AS h FROM {src} GROUP BY image_id),
    vy AS MATERIALIZED (SELECT {pk}, p.y, p.x, p.a, p.b, sum(q.a) AS sa, sum(q.b) AS sb, sum(q.a * q.a) AS saa, sum(q.b * q.b) AS sbb, sum(q.a * q.b) AS sab
      FROM {src} p JOIN hs USING (image_id) CROSS JOIN (SELECT unnest(range(-3, 4)) AS k)
      JOIN {src} q ON {on('p', 'q')} AND q.x = p.x AND q.y = {_mirror('p.y + k', 'h')} GROUP BY {pk}, p.y, p.x, p.a, p.b),
    vx AS MATERIALIZED (SELECT {pk}, p.y, p.x, p.a, p.b, sum(q.sa) / 49 AS ma, sum(q.sb) / 49 AS mb, sum(q.saa) / 49 AS maa, sum(q.sbb) / 49 AS mbb, sum(q.sab) / 49 AS mab
      FROM vy p CROSS JOIN (SELECT unnest(range(-3, 4)) AS k)
      JOIN vy q ON {on('p', 'q')} AND q.y = p.y AND q.x = {_mirror('p.x + k', '64')} GROUP BY {pk}, p.y, p.x, p.a, p.b),
    ss AS (SELECT {keys}, y, x, a, b, greatest(0, least(1, (1 - ((2 * ma * mb + 0.0001::DOUBLE) * (2 * (mab - ma * mb) + 0.0009::DOUBLE))
      / ((ma * ma + mb * mb + 0.0001::DOUBLE) * (maa - ma * ma + mbb - mb * mb + 0.0009::DOUBLE))) / 2)) AS ssim FROM vx)"""


@query(
    "ssim_distance",
    f"WITH {PX}, {PAIR}, ab AS (SELECT image_id, y, x, l AS a, r AS b FROM pr), {_ssim_sql('ab', 'image_id')} SELECT image_id, y, x, {r6_sql('ssim')} AS ssim FROM ss",
)
def ssim(spark, sf_dir):
    px = to_pixels(metrics.ssim_distance(stereo_pairs(spark, sf_dir), "left", "right"), ["ssim"], ["ssim"])
    return _rounded(px.drop("ch"), "ssim")


@query(
    "photometric",
    f"""WITH {PX}, {PAIR}, ab AS (SELECT image_id, 0 AS ch, y, x, l AS a, r AS b FROM pr UNION ALL SELECT image_id, 1 AS ch, y, x, l * 0.5, r * r FROM pr),
    {_ssim_sql('ab', 'image_id, ch')}
    SELECT image_id, y, x, {r6_sql('avg(0.85::DOUBLE * ssim + 0.15::DOUBLE * abs(a - b))')} AS photo FROM ss GROUP BY image_id, y, x""",
)
def photometric(spark, sf_dir):
    pairs = stereo_pairs(spark, sf_dir)
    both = F.array(
        F.struct(F.lit(0).alias("ch"), F.col("left").alias("a"), F.col("right").alias("b")),
        F.struct(
            F.lit(1).alias("ch"),
            F.transform("left", lambda v: v * 0.5).alias("a"),
            F.transform("right", lambda v: v * v).alias("b"),
        ),
    )
    views = pairs.select("image_id", "y", "h", "w", F.explode_outer(both).alias("c")).select(
        "image_id", "c.ch", "y", "h", "w", "c.a", "c.b"
    )
    scored = metrics.photometric(views, "a", "b")
    px = scored.select("image_id", "y", F.posexplode_outer("photo").alias("x", "photo"))
    return _rounded(px, "photo")


# --- confidence-weighted losses ---------------------------------------------------------------

_MAPS = """mp AS (SELECT image_id, y, x, (r + 0.6) * 10 AS g, (l + 0.6) / 1.2::DOUBLE AS c, l < 0.2 AS nocc, r > 0.3 AS inp, r > -0.4 AS valid FROM pr),
  rl AS (SELECT m.*, coalesce(NOT n.inp, false) AS real FROM mp m LEFT JOIN mp n ON n.image_id = m.image_id AND n.y = m.y AND n.x = round_even(m.x - m.g, 0)),
  pd AS (SELECT image_id, y, x, i, (l + 0.6) * 10 * (1 + 0.1::DOUBLE * (2 - i)) AS p FROM pr CROSS JOIN it),
  wp AS (SELECT pd.image_id, pd.i, pd.y, pd.x, greatest(0.0::DOUBLE, least(63.0::DOUBLE, pd.x - p)) AS q FROM pd),
  ab AS MATERIALIZED (SELECT wp.image_id, wp.i, wp.y, wp.x, o.l AS a, s.r * (1 - (q - floor(q))) + coalesce(t.r, 0) * (q - floor(q)) AS b FROM wp
    JOIN pr o ON o.image_id = wp.image_id AND o.y = wp.y AND o.x = wp.x
    LEFT JOIN pr s ON s.image_id = wp.image_id AND s.y = wp.y AND s.x = floor(q)
    LEFT JOIN pr t ON t.image_id = wp.image_id AND t.y = wp.y AND t.x = floor(q) + 1)"""
_TERMS = f"""{_ssim_sql('ab', 'image_id, i')},
  tm AS (SELECT ss.i, avg(CASE WHEN valid THEN {{err}} * c END) AS d, avg(CASE WHEN nocc AND real THEN (0.85::DOUBLE * ssim + 0.15::DOUBLE * abs(a - b)) * (1 - c) END) AS p
    FROM ss JOIN rl USING (image_id, y, x) JOIN pd ON pd.image_id = ss.image_id AND pd.i = ss.i AND pd.y = ss.y AND pd.x = ss.x GROUP BY ss.i)"""
_ABS = _TERMS.format(err="abs(pd.p - g)")
_SMOOTH = _TERMS.format(err="(CASE WHEN abs(pd.p - g) < 1 THEN 0.5 * (pd.p - g) * (pd.p - g) ELSE abs(pd.p - g) - 0.5 END)")


def _loss_inputs(spark, sf_dir):
    pairs = stereo_pairs(spark, sf_dir)
    views = pairs.select("image_id", "ch", "y", "h", "w", "left", "right")
    maps = pairs.select(
        "image_id", "y",
        F.transform("right", lambda v: (v + 0.6) * 10).alias("gt"),
        F.transform("left", lambda v: (v + 0.6) / 1.2).alias("conf"),
        F.transform("left", lambda v: v < 0.2).alias("mask_nocc"),
        F.transform("right", lambda v: v > 0.3).alias("mask_inpaint"),
        F.transform("right", lambda v: v > -0.4).alias("valid"),
    )
    preds = pairs.select("image_id", "y", "left", F.explode_outer(F.sequence(F.lit(0), F.lit(2))).alias("iter")).select(
        "iter", "image_id", "y",
        F.transform("left", lambda v: (v + 0.6) * 10 * (1 + 0.1 * (2 - F.col("iter")))).alias("disp"),
    )
    return preds, maps, views


@query(
    "confidence_loss_flow",
    f"WITH {PX}, {PAIR}, {_ITERS}, {_MAPS}, {_ABS} SELECT {r6_sql(f'sum({_GAMMA} * (d + 0.1::DOUBLE * p))')} AS loss FROM tm",
)
def loss_flow(spark, sf_dir):
    preds, maps, views = _loss_inputs(spark, sf_dir)
    flow = preds.withColumn("disp", F.transform("disp", lambda v: -v))
    return _rounded(metrics.confidence_loss_flow(flow, maps, views, 3), "loss")


@query(
    "confidence_loss_disp",
    f"""SELECT {r6_sql('a.part + b.part')} AS loss FROM
    (WITH {PX}, {PAIR}, {_ITERS}, {_MAPS}, {_ABS} SELECT sum({_GAMMA} * (d + 0.1::DOUBLE * p)) AS part FROM tm) a,
    (WITH {PX}, {PAIR}, {_ITERS}, {_MAPS}, {_SMOOTH} SELECT d + 0.1::DOUBLE * p AS part FROM tm WHERE i = 0) b""",
)
def loss_disp(spark, sf_dir):
    preds, maps, views = _loss_inputs(spark, sf_dir)
    init = preds.filter("iter = 0").drop("iter")
    return _rounded(metrics.confidence_loss_disp(init, preds, maps, views, 3), "loss")
