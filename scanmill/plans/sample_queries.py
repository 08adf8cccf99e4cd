"""Queries on dataset readers, augmentation, sinks and the composed stereo jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.functions import scalar
from scanmill.operators import augment
from scanmill.operators.grid import to_pixels
from scanmill.plans import pseudo_stereo as ps
from scanmill.plans.grid_queries import _resize_sql
from scanmill.plans.registry import query, r6, r6_sql
from scanmill.plans.views import HT, PX, quarter_disparity, raster, table
from scanmill.sources import sinks

# --- readers ----------------------------------------------------------------------------------


@query(
    "disparity_readers",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS p, l_partkey % 256 AS m FROM lineitem)
    SELECT l_orderkey, l_linenumber,
      {r6_sql('80 / q')} AS tartanair, p / 32 AS crestereo, {r6_sql('768.2::DOUBLE * 6 * 100 / q')} AS falling_things,
      {r6_sql('CASE WHEN CAST(CAST(p / 100 AS FLOAT) AS DOUBLE) < 655 THEN 0.532725::DOUBLE * 725.0087::DOUBLE / CAST(CAST(p / 100 AS FLOAT) AS DOUBLE) ELSE 0 END')} AS vkitti2,
      CAST(CAST(p / 100 AS FLOAT) AS DOUBLE) < 655 AS vkitti2_valid,
      p / 256 AS kitti, m > 0 AS mask_all, m = 255 AS mask_noc, q < 1024 AS default_valid, q - 25 > 0 AS training_valid,
      q >= 10 AND p < 40000 AS loss_valid, {r6_sql('CASE WHEN abs(q / 25 - 1) < 1 THEN 0.5 * (q / 25 - 1) * (q / 25 - 1) ELSE abs(q / 25 - 1) - 0.5 END')} AS smooth_l1
    FROM r""",
)
def readers(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    q, p, m = F.col("l_quantity"), F.col("l_extendedprice"), F.pmod("l_partkey", F.lit(256))
    vk, vk_valid = scalar.vkitti2(p)
    mode = lambda name: scalar.masked_ground_truth(q, m, F.lit(name))[1]
    return items.select(
        "l_orderkey", "l_linenumber",
        r6(scalar.tartanair(q)[0]).alias("tartanair"),
        scalar.crestereo(p)[0].alias("crestereo"),
        r6(scalar.falling_things(q, F.lit(768.2))[0]).alias("falling_things"),
        r6(vk).alias("vkitti2"), vk_valid.alias("vkitti2_valid"),
        scalar.kitti(p)[0].alias("kitti"),
        mode("all").alias("mask_all"), mode("noc").alias("mask_noc"),
        scalar.default_valid(F.lit(None).cast("boolean"), q).alias("default_valid"),
        scalar.training_valid(q - 25).alias("training_valid"),
        scalar.loss_valid(q / 20, p, 40000).alias("loss_valid"),
        r6(scalar.smooth_l1(q / 25 - 1)).alias("smooth_l1"),
    )


# --- augmentation -----------------------------------------------------------------------------


@query(
    "sparse_rescale",
    f"""WITH {PX}, {HT}, s AS (SELECT image_id, CAST(round_even(y * 0.6::DOUBLE, 0) AS INTEGER) AS ty, CAST(round_even(x * 0.7::DOUBLE, 0) AS INTEGER) AS tx,
      (v + 0.6) * 10 * 0.7::DOUBLE AS v, y * 64 + x AS o, round_even(h * 0.6::DOUBLE, 0) AS th FROM px JOIN ht USING (image_id) WHERE v > 0)
    SELECT image_id, ty AS y, tx AS x, {r6_sql('arg_max(v, o)')} AS v FROM s
    WHERE tx > 0 AND tx < round_even(64 * 0.7::DOUBLE, 0) AND ty > 0 AND ty < th GROUP BY image_id, ty, tx""",
)
def sparse(spark, sf_dir):
    return _sparse_lines(spark, sf_dir, augment.rescale_sparse_points).withColumn("v", r6(F.col("v")))


def _sparse_lines(spark, sf_dir, fn):
    lines = raster(spark, sf_dir).withColumns(
        {
            "disp": F.transform("vals", lambda v: (v + 0.6) * 10),
            "valid": F.transform("vals", lambda v: v > 0),
        }
    )
    return fn(lines, F.lit(0.7), F.lit(0.6))


@query(
    "sparse_rescale_lines",
    f"""WITH {PX}, {HT}, s AS (SELECT image_id, CAST(round_even(y * 0.6::DOUBLE, 0) AS INTEGER) AS ty, CAST(round_even(x * 0.7::DOUBLE, 0) AS INTEGER) AS tx,
      round_even(h * 0.6::DOUBLE, 0) AS th FROM px JOIN ht USING (image_id) WHERE v > 0),
    n AS (SELECT image_id, ty, count(DISTINCT tx) AS n FROM s WHERE tx > 0 AND tx < 45 AND ty > 0 AND ty < th GROUP BY image_id, ty),
    g AS (SELECT image_id, CAST(unnest(range(CAST(round_even(h * 0.6::DOUBLE, 0) AS BIGINT))) AS INTEGER) AS y FROM ht)
    SELECT g.image_id, g.y, CAST(45 AS INTEGER) AS w, CAST(coalesce(n, 0) AS INTEGER) AS hits FROM g LEFT JOIN n ON n.image_id = g.image_id AND n.ty = g.y""",
)
def sparse_lines(spark, sf_dir):
    lines = _sparse_lines(spark, sf_dir, augment.rescale_sparse)
    return lines.select("image_id", "y", "w", F.size(F.filter("valid", lambda m: m)).alias("hits"))


@query(
    "scatter_last",
    f"SELECT user_id, event_type, {r6_sql('arg_max(value, event_id)')} AS v FROM events GROUP BY user_id, event_type",
)
def scatter(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("value").alias("v"))
    return augment.scatter_last(points, ["user_id", "event_type"], F.col("event_id")).withColumn("v", r6(F.col("v")))


_RECTS = """rc AS (SELECT image_id, k, CAST((image_id * 7 + k * 11) % 64 AS INTEGER) AS x0, CAST((image_id * 5 + k * 13) % 40 AS INTEGER) AS y0,
  CAST(8 + k * 3 AS INTEGER) AS dx, CAST(5 + k * 2 AS INTEGER) AS dy
  FROM (SELECT DISTINCT image_id FROM px) CROSS JOIN (SELECT unnest([0, 1]) AS k))"""


@query("mean_color", f"WITH {PX} SELECT image_id, {r6_sql('avg(v)')} AS mean_color FROM px GROUP BY image_id")
def mean_color(spark, sf_dir):
    return augment.mean_color(raster(spark, sf_dir)).select("image_id", r6(F.col("mean_color")).alias("mean_color"))


@query(
    "erase",
    f"""WITH {PX}, {_RECTS}, mc AS (SELECT image_id, avg(v) AS m FROM px GROUP BY image_id)
    SELECT px.image_id, y, x, {r6_sql('''CASE WHEN EXISTS (SELECT 1 FROM rc WHERE rc.image_id = px.image_id AND x >= x0 AND x < x0 + dx AND y >= y0 AND y < y0 + dy)
      THEN m ELSE v END''')} AS v FROM px JOIN mc USING (image_id)""",
)
def erase(spark, sf_dir):
    lines = raster(spark, sf_dir)
    images = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 64").alias("image_id")).distinct()
    rects = images.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "image_id",
        F.pmod(F.col("image_id") * 7 + F.col("k") * 11, F.lit(64)).cast("int").alias("x0"),
        F.pmod(F.col("image_id") * 5 + F.col("k") * 13, F.lit(40)).cast("int").alias("y0"),
        (8 + F.col("k") * 3).alias("dx"),
        (5 + F.col("k") * 2).alias("dy"),
    )
    return to_pixels(augment.erase(lines, rects)).drop("ch").withColumn("v", r6(F.col("v")))


@query(
    "rescale_dense",
    _resize_sql("CAST(round_even(h * 0.8::DOUBLE, 0) AS BIGINT)", "83", "bilinear", "centers")
    .replace("(CAST(round_even(h * 0.8::DOUBLE, 0) AS BIGINT) / h::DOUBLE)", "0.8::DOUBLE")
    .replace("(83 / 64::DOUBLE)", "1.3::DOUBLE"),
)
def rescale(spark, sf_dir):
    out = augment.rescale_dense(raster(spark, sf_dir), F.lit(1.3), F.lit(0.8))
    return to_pixels(out).drop("ch").withColumn("v", r6(F.col("v")))


_GRAY = "(0.299::DOUBLE * {0} + 0.587::DOUBLE * {1} + 0.114::DOUBLE * {2})"


def _clip255(expr: str) -> str:
    return f"greatest(0, least(255, {expr}))"


def _mix(expr: str, base: str, factor: str) -> str:
    return _clip255(f"{factor}::DOUBLE * {expr} + (1 - {factor}::DOUBLE) * {base}")


@query(
    "color_jitter",
    f"""WITH {PX}, c AS (SELECT image_id, y, x, {_clip255('floor((v + 0.6) * 200) * 1.2::DOUBLE')} AS r, {_clip255('floor((0.6 - v) * 180) * 1.2::DOUBLE')} AS g,
      {_clip255('floor(abs(v) * 300) * 1.2::DOUBLE')} AS b FROM px),
    m AS (SELECT image_id, round_even(sum({_GRAY.format('r', 'g', 'b')}) / count(*), 0) AS m FROM c GROUP BY image_id),
    k AS (SELECT image_id, y, x, {_mix('r', 'm', '0.7')} AS r, {_mix('g', 'm', '0.7')} AS g, {_mix('b', 'm', '0.7')} AS b FROM c JOIN m USING (image_id)),
    s AS (SELECT image_id, y, x, {_mix('r', _GRAY.format('r', 'g', 'b'), '1.3')} AS r, {_mix('g', _GRAY.format('r', 'g', 'b'), '1.3')} AS g,
      {_mix('b', _GRAY.format('r', 'g', 'b'), '1.3')} AS b FROM k)
    SELECT image_id, {r6_sql('avg(r)')} AS r, {r6_sql('avg(g)')} AS g, {r6_sql('avg(b)')} AS b FROM s GROUP BY image_id""",
)
def jitter(spark, sf_dir):
    """Given factors and no hue shift; the mean before rounding hides single-step differences."""
    px = raster(spark, sf_dir).select(
        "image_id", F.lit("left").alias("view"), "y", "h", "w",
        F.transform("vals", lambda v: F.floor((v + 0.6) * 200).cast("double")).alias("r"),
        F.transform("vals", lambda v: F.floor((0.6 - v) * 180).cast("double")).alias("g"),
        F.transform("vals", lambda v: F.floor(F.abs(v) * 300).cast("double")).alias("b"),
    )
    factors = {
        "brightness": F.lit(1.2), "contrast": F.lit(0.7), "saturation": F.lit(1.3), "hue": F.lit(0.0), "stacked": F.lit(False),
    }
    done = augment.color_jitter(px, factors, whole=False)
    sums = done.select(
        "image_id", F.size("r").alias("n"),
        *[F.aggregate(c, F.lit(0.0), lambda a, v: a + v).alias(c) for c in ("r", "g", "b")],
    )
    return sums.groupBy("image_id").agg(*[r6(F.sum(c) / F.sum("n")).alias(c) for c in ("r", "g", "b")])


@query(
    "augment_chain",
    """SELECT raster, image_id, CAST(12 * channels AS BIGINT) AS lines, 12 AS h, 40 AS w, CAST(480 * channels AS BIGINT) AS pixels
    FROM (SELECT DISTINCT vec_id // 64 AS image_id FROM embeddings) CROSS JOIN (VALUES ('left', 3), ('right', 3), ('disp', 1)) t(raster, channels)""",
)
def chain(spark, sf_dir):
    """The whole chain with hash draws. SQL cannot repeat those, but it states what must come out whole."""
    gray = raster(spark, sf_dir).withColumn("vals", F.transform("vals", lambda v: (v + 0.6) * 200))
    rgb = gray.withColumn("ch", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    images = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 64").alias("image_id")).agg(
        F.count(F.lit(1)).cast("int").alias("h"), F.max(F.size("embedding")).alias("w")
    )
    params = augment.AugmentParams(crop_height=12, crop_width=40, erase_bound=(4, 8))
    out = augment.augment({"left": rgb, "right": rgb, "disp": gray}, images, params, seed=3)
    sized = None
    for name, df in out.items():
        part = df.select(F.lit(name).alias("raster"), "image_id", "h", "w", F.size("vals").alias("n"))
        sized = part if sized is None else sized.unionByName(part)
    return sized.groupBy("raster", "image_id").agg(
        F.count(F.lit(1)).alias("lines"), F.min("h").alias("h"), F.min("w").alias("w"), F.sum("n").alias("pixels")
    )


# --- sinks ------------------------------------------------------------------------------------


@query(
    "render_disparity",
    f"""WITH {PX}, rg AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY image_id),
    i AS (SELECT image_id, y, x, CAST(least(floor((v - lo) / (hi - lo) * 256), 255) AS INTEGER) AS i FROM px JOIN rg USING (image_id))
    SELECT image_id, y, x, i AS r, CAST(255 - i AS INTEGER) AS g, CAST(i * 7 % 256 AS INTEGER) AS b FROM i""",
)
def render(spark, sf_dir):
    palette = spark.range(256).select(
        F.col("id").cast("int").alias("idx"), F.col("id").cast("int").alias("r"),
        (255 - F.col("id")).cast("int").alias("g"), F.pmod(F.col("id") * 7, F.lit(256)).cast("int").alias("b"),
    )
    out = sinks.render_disparity(raster(spark, sf_dir), palette)
    return to_pixels(out, ["r", "g", "b"], ["r", "g", "b"]).drop("ch")


@query(
    "byte_products",
    f"""WITH {PX} SELECT image_id, y, x, CAST(round_even((v + 1) * 127.5::DOUBLE, 0) AS INTEGER) AS v FROM px""",
)
def byte_products(spark, sf_dir):
    lines = sinks.to_bytes(raster(spark, sf_dir).withColumn("left_path", F.lit("/in/left/a.png")))
    return to_pixels(sinks.products(lines, "right")).drop("ch")


# --- composed jobs ----------------------------------------------------------------------------


def _u(k: int):
    return F.pmod(F.col("image_id") * k, F.lit(100)) / 100.0


_NEAREST = """arg_min(k.v, (CAST((h.y - k.y) * (h.y - k.y) + (h.x - k.x) * (h.x - k.x) AS BIGINT) * 64 + k.y) * 64 + k.x)"""


@query(
    "pseudo_stereo",
    f"""WITH {PX}, {HT},
    fl AS (SELECT a.image_id, a.y, a.x, a.v AS a, b.v * (1 + 0.01::DOUBLE * b.x) AS b
      FROM px a JOIN px b ON a.image_id = b.image_id AND a.y = b.y AND b.x = 63 - a.x),
    r AS (SELECT image_id, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM fl GROUP BY image_id),
    c AS MATERIALIZED (SELECT image_id, y, x, (a - la) / (ha - la) AS n, 1 - abs((a - la) / (ha - la) - (b - lb) / (hb - lb)) AS c FROM fl JOIN r USING (image_id)),
    q AS (SELECT image_id, min(c) AS lc, max(c) AS hc FROM c GROUP BY image_id),
    dr AS (SELECT DISTINCT image_id, (image_id * 37 % 100) / 100.0 AS u1, (image_id * 61 % 100) / 100.0 AS u2 FROM px),
    k AS (SELECT image_id, CASE WHEN u1 < 0.1 THEN 0.0 WHEN u1 > 0.9 THEN 0.15 ELSE 0.05 END * 64.0::DOUBLE AS lo,
      CASE WHEN u1 < 0.1 THEN 0.05 WHEN u1 > 0.9 THEN 0.2 ELSE 0.15 END * 64.0::DOUBLE AS hi, u2 FROM dr),
    d0 AS MATERIALIZED (SELECT image_id, y, x, n * (lo + u2 * (hi - lo)) AS v FROM c JOIN k USING (image_id)),
    dl AS MATERIALIZED (SELECT a.image_id, a.y, a.x, max(b.v) AS v FROM d0 a JOIN d0 b
      ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
      WHERE abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY a.image_id, a.y, a.x),
    nb AS MATERIALIZED (SELECT a.image_id, a.y, a.x, dy, dx, greatest(0, least(h - 1, a.y + dy)) AS ny, greatest(0, least(63, a.x + dx)) AS nx
      FROM dl a JOIN ht USING (image_id) CROSS JOIN (SELECT unnest([-1,0,1]) AS dy) CROSS JOIN (SELECT unnest([-1,0,1]) AS dx)),
    st AS (SELECT nb.image_id, nb.y, nb.x, dy, dx, b.v FROM nb JOIN dl b ON b.image_id = nb.image_id AND b.y = nb.ny AND b.x = nb.nx),
    mg AS MATERIALIZED (SELECT image_id, y, x, sqrt((pow(sum(dx * (2 - abs(dy)) * v) / 4, 2) + pow(sum(dy * (2 - abs(dx)) * v) / 4, 2)) / 2) > 3 AS hole
      FROM st GROUP BY image_id, y, x),
    kn AS (SELECT dl.* FROM dl JOIN mg USING (image_id, y, x) WHERE NOT hole), ho AS (SELECT image_id, y, x FROM mg WHERE hole),
    df AS MATERIALIZED (SELECT h.image_id, h.y, h.x, {_NEAREST} AS v FROM ho h JOIN kn k USING (image_id) GROUP BY h.image_id, h.y, h.x
      UNION ALL SELECT image_id, y, x, v FROM kn),
    sh AS MATERIALIZED (SELECT px.image_id, px.y, px.x, px.v, df.v AS d, px.x - df.v AS s FROM px JOIN df USING (image_id, y, x)),
    hit AS (SELECT a.image_id, a.y, a.x, bool_or(floor(b.s) = floor(a.s) OR ceil(b.s) = floor(a.s)) AS dn,
        bool_or(floor(b.s) = ceil(a.s) OR ceil(b.s) = ceil(a.s)) AS up
      FROM sh a JOIN sh b ON a.image_id = b.image_id AND a.y = b.y AND b.x >= a.x + 2 GROUP BY a.image_id, a.y, a.x),
    nocc AS MATERIALIZED (SELECT image_id, y, x, v, s, s > 0 AND (NOT coalesce(dn, false) OR NOT coalesce(up, false)) AS keep FROM sh LEFT JOIN hit USING (image_id, y, x)),
    mv AS (SELECT image_id, y, x, v, CASE WHEN keep THEN s ELSE -64.0 END AS p FROM nocc),
    t AS (SELECT image_id, y, x, v, p, greatest(0, least(63, ceil(p))) AS tu, greatest(0, least(63, floor(p))) AS td FROM mv),
    up AS (SELECT image_id, y, tu AS t, tu - p AS wu, v AS vu FROM t QUALIFY row_number() OVER (PARTITION BY image_id, y, tu ORDER BY tu - p, x DESC) = 1),
    dn AS (SELECT image_id, y, td AS t, 1 - (tu - p) AS wd, v AS vd FROM t QUALIFY row_number() OVER (PARTITION BY image_id, y, td ORDER BY 1 - (tu - p), x DESC) = 1),
    pl AS (SELECT g.image_id, g.y, g.x, coalesce(wu, 10000) AS wu, coalesce(wd, 10000) AS wd, coalesce(vu, 0) AS vu, coalesce(vd, 0) AS vd, wu IS NULL AND wd IS NULL AS hole
      FROM px g LEFT JOIN up ON up.image_id = g.image_id AND up.y = g.y AND up.t = g.x LEFT JOIN dn ON dn.image_id = g.image_id AND dn.y = g.y AND dn.t = g.x)
    SELECT pl.image_id, pl.y, pl.x, {r6_sql('CASE WHEN pl.hole THEN -1 ELSE vu * (wd / (wu + wd + 1e-7)) + vd * (wu / (wu + wd + 1e-7)) END')} AS v,
      pl.hole AS mask_inpaint, nocc.keep AS mask_nocc, {r6_sql('df.v')} AS disp, {r6_sql('(c.c - lc) / (hc - lc)')} AS conf
    FROM pl JOIN nocc USING (image_id, y, x) JOIN df USING (image_id, y, x) JOIN c USING (image_id, y, x) JOIN q USING (image_id)""",
)
def stereo(spark, sf_dir):
    """Depth to filled right view; the stand-in predictor paints holes with -1."""
    image = raster(spark, sf_dir)
    depth = image.withColumnRenamed("vals", "depth").withColumn(
        "depth_flipped", F.transform("depth", lambda v, x: v * (1 + 0.01 * x))
    )
    paint = lambda df: df.withColumn("pred", F.transform("vals", lambda v: F.lit(-1.0)))
    out = ps.pseudo_stereo(image, depth, _u(37), _u(61), predict=paint)
    names = ["vals", "mask_inpaint", "mask_nocc", "disp", "conf"]
    px = to_pixels(out, names, ["v", *names[1:]]).drop("ch")
    return px.withColumns({c: r6(F.col(c)) for c in ("v", "disp", "conf")})


def _taps_sql(name: str, src: str, n: str, cubic: bool) -> str:
    """Target position, source position and weight along one axis, pixel centres mapped onto each other."""
    if cubic:
        near = "((-0.75 + 2) * {d} - (-0.75 + 3)) * {d} * {d} + 1"
        far = "((-0.75 * {d} - 5 * -0.75) * {d} + 8 * -0.75) * {d} - 4 * -0.75"
        ks = "-1, 0, 1, 2"
        wt = (
            f"CASE k WHEN -1 THEN {far.format(d='(f + 1)')} WHEN 0 THEN {near.format(d='f')} "
            f"WHEN 1 THEN {near.format(d='(1 - f)')} ELSE {far.format(d='(2 - f)')} END"
        )
    else:
        ks, wt = "0, 1", "CASE k WHEN 0 THEN 1 - f ELSE f END"
    return f"""{name} AS MATERIALIZED (SELECT image_id, t, greatest(0, least({n} - 1, floor(s) + k)) AS p, {wt} AS wt
      FROM (SELECT *, s - floor(s) AS f FROM {src}) CROSS JOIN (SELECT unnest([{ks}]) AS k))"""


_SCALED = f"""{PX}, {HT}, sc AS (SELECT image_id, h, greatest(least(h, 64) // 25, 1) AS k FROM ht),
    gy AS (SELECT image_id, h, k, unnest(range(h // k)) AS t FROM sc), gx AS (SELECT image_id, k, unnest(range(64 // k)) AS t FROM sc),
    sy AS (SELECT image_id, h, t, (t + 0.5::DOUBLE) / ((h // k) / h::DOUBLE) - 0.5::DOUBLE AS s FROM gy),
    sx AS (SELECT image_id, t, (t + 0.5::DOUBLE) / ((64 // k) / 64::DOUBLE) - 0.5::DOUBLE AS s FROM gx),
    {_taps_sql('cy', 'sy', 'h', True)}, {_taps_sql('cx', 'sx', '64', True)},
    {_taps_sql('ly', 'sy', 'h', False)}, {_taps_sql('lx', 'sx', '64', False)},
    ix AS MATERIALIZED (SELECT px.image_id, px.y, cx.t AS x, sum(wt * (v + 0.6) * 200) AS v FROM px JOIN cx ON cx.image_id = px.image_id AND cx.p = px.x GROUP BY px.image_id, px.y, cx.t),
    im AS (SELECT cy.image_id, cy.t AS y, x, greatest(0, least(255, sum(wt * v))) AS v FROM ix JOIN cy ON cy.image_id = ix.image_id AND cy.p = ix.y GROUP BY cy.image_id, cy.t, x),
    dx AS MATERIALIZED (SELECT px.image_id, px.y, lx.t AS x, sum(wt * floor((v + 0.6) * 40) / 4) AS v FROM px JOIN lx ON lx.image_id = px.image_id AND lx.p = px.x GROUP BY px.image_id, px.y, lx.t),
    dm AS (SELECT ly.image_id, ly.t AS y, x, sum(wt * v) AS v FROM dx JOIN ly ON ly.image_id = dx.image_id AND ly.p = dx.y GROUP BY ly.image_id, ly.t, x),
    sh AS MATERIALIZED (SELECT im.image_id, im.y, im.x, im.v, k, 64 // k AS w, im.x - dm.v / k AS s FROM im JOIN dm USING (image_id, y, x) JOIN sc USING (image_id)),
    hit AS (SELECT a.image_id, a.y, a.x, bool_or(floor(b.s) = floor(a.s) OR ceil(b.s) = floor(a.s)) AS dn,
        bool_or(floor(b.s) = ceil(a.s) OR ceil(b.s) = ceil(a.s)) AS up
      FROM sh a JOIN sh b ON a.image_id = b.image_id AND a.y = b.y AND b.x >= a.x + 2 GROUP BY a.image_id, a.y, a.x),
    mv AS (SELECT image_id, y, x, v, w, CASE WHEN s > 0 AND (NOT coalesce(dn, false) OR NOT coalesce(up, false)) THEN s ELSE -w END AS p
      FROM sh LEFT JOIN hit USING (image_id, y, x)),
    t AS (SELECT image_id, y, x, v, p, greatest(0, least(w - 1, ceil(p))) AS tu, greatest(0, least(w - 1, floor(p))) AS td FROM mv),
    up AS (SELECT image_id, y, tu AS t, tu - p AS wu, v AS vu FROM t QUALIFY row_number() OVER (PARTITION BY image_id, y, tu ORDER BY tu - p, x DESC) = 1),
    dn AS (SELECT image_id, y, td AS t, 1 - (tu - p) AS wd, v AS vd FROM t QUALIFY row_number() OVER (PARTITION BY image_id, y, td ORDER BY 1 - (tu - p), x DESC) = 1),
    pl AS (SELECT g.image_id, g.k, g.y, g.x, coalesce(wu, 10000) AS wu, coalesce(wd, 10000) AS wd, coalesce(vu, 0) AS vu, coalesce(vd, 0) AS vd, wu IS NULL AND wd IS NULL AS hole
      FROM sh g LEFT JOIN up ON up.image_id = g.image_id AND up.y = g.y AND up.t = g.x LEFT JOIN dn ON dn.image_id = g.image_id AND dn.y = g.y AND dn.t = g.x)"""


@query(
    "warp_samples",
    f"""WITH {_SCALED} SELECT image_id, CAST(k AS INTEGER) AS scale, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, hole,
      {r6_sql('CASE WHEN hole THEN 0 ELSE vu * (wd / (wu + wd + 1e-7)) + vd * (wu / (wu + wd + 1e-7)) END')} AS v FROM pl""",
)
def warp_samples(spark, sf_dir):
    """Image and disparity reduced where the short side allows it, then warped."""
    image = raster(spark, sf_dir).withColumn("vals", F.transform("vals", lambda v: (v + 0.6) * 200))
    disp = raster(spark, sf_dir).withColumn("vals", quarter_disparity())
    out = ps.warp_samples(image, disp, limit=25)
    cells = F.arrays_zip(F.col("vals").alias("v"), F.col("mask_inpaint").alias("hole"))
    px = out.select("image_id", "scale", "y", F.posexplode_outer(cells).alias("x", "c"))
    return px.select("image_id", "scale", "y", "x", F.col("c.hole").alias("hole"), r6(F.col("c.v")).alias("v"))


@query(
    "fill_samples",
    f"""WITH {PX}, pr AS (SELECT image_id, y, count(*) AS n FROM px GROUP BY image_id, y)
    SELECT image_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(n) AS BIGINT) AS pixels FROM pr GROUP BY image_id""",
)
def fill_samples(spark, sf_dir):
    lines = raster(spark, sf_dir)
    truth = lines.withColumn("disp", quarter_disparity()).drop("vals")
    out = ps.fill_samples(lines, lines, truth)
    return out.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.size("warped_right").cast("long")).alias("pixels")
    )
