"""Queries on stencils, padding, tiles, cropping and resizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.functions.scalar import (
    composite,
    downscale_factor,
    hide_masked,
    pad_amounts,
    signed_scale,
    signed_unscale,
    standardise,
    target_size,
    unit_scale,
)
from scanmill.operators import grid, stencil
from scanmill.operators.ordinal import with_ordinal
from scanmill.plans.registry import query, r6, r6_sql
from scanmill.plans.views import HT, PX, raster, table


def _out(lines, value="vals", name="v"):
    px = grid.to_pixels(lines, [value], [name]).drop("ch")
    return px.withColumn(name, r6(F.col(name)))


# --- stencils ---------------------------------------------------------------------------------

OFFS = "CROSS JOIN (SELECT unnest(range(-{r}, {r} + 1)) AS dy) CROSS JOIN (SELECT unnest(range(-{r}, {r} + 1)) AS dx)"


def _mirror(i: str, n: str) -> str:
    return f"CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN 2 * ({n} - 1) - ({i}) ELSE {i} END"


@query(
    "dilate3",
    f"""WITH {PX} SELECT a.image_id, a.y, a.x, {r6_sql('max(b.v)')} AS v FROM px a JOIN px b
    ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
    WHERE abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY a.image_id, a.y, a.x""",
)
def dilate3(spark, sf_dir):
    return _out(stencil.dilate(raster(spark, sf_dir)))


@query(
    "sobel_edges",
    f"""WITH {PX}, {HT},
    nb AS MATERIALIZED (SELECT a.image_id, a.y, a.x, dy, dx, greatest(0, least(h - 1, a.y + dy)) AS ny, greatest(0, least(63, a.x + dx)) AS nx
      FROM px a JOIN ht USING (image_id) {OFFS.format(r=1)}),
    st AS (SELECT nb.image_id, nb.y, nb.x, dy, dx, b.v FROM nb JOIN px b ON b.image_id = nb.image_id AND b.y = nb.ny AND b.x = nb.nx)
    SELECT image_id, y, x,
      {r6_sql('sqrt((pow(sum(dx * (2 - abs(dy)) * v) / 4, 2) + pow(sum(dy * (2 - abs(dx)) * v) / 4, 2)) / 2)')} AS magnitude
    FROM st GROUP BY image_id, y, x""",
)
def sobel_edges(spark, sf_dir):
    return _out(stencil.sobel(raster(spark, sf_dir)), "magnitude", "magnitude")


@query(
    "mean7",
    f"""WITH {PX}, {HT},
    ry AS (SELECT p.image_id, p.y, p.x, sum(q.v) AS v FROM px p JOIN ht USING (image_id)
      CROSS JOIN (SELECT unnest(range(-3, 4)) AS k)
      JOIN px q ON q.image_id = p.image_id AND q.x = p.x AND q.y = {_mirror('p.y + k', 'h')} GROUP BY p.image_id, p.y, p.x)
    SELECT p.image_id, p.y, p.x, {r6_sql('sum(q.v) / 49')} AS v FROM ry p CROSS JOIN (SELECT unnest(range(-3, 4)) AS k)
      JOIN ry q ON q.image_id = p.image_id AND q.y = p.y AND q.x = {_mirror('p.x + k', '64')} GROUP BY p.image_id, p.y, p.x""",
)
def mean7(spark, sf_dir):
    return _out(stencil.box_mean(raster(spark, sf_dir)))


@query(
    "gauss_blur",
    f"""WITH {PX}, k AS (SELECT dy, dx, exp(-(dx * dx + dy * dy) / 2.0::DOUBLE) AS g FROM (SELECT unnest(range(-2, 3)) AS dy) CROSS JOIN (SELECT unnest(range(-2, 3)) AS dx)),
    n AS (SELECT dy, dx, g / (SELECT sum(g) FROM k) AS g FROM k),
    s AS (SELECT b.image_id, b.y - dy AS y, b.x - dx AS x, b.v * g AS p FROM px b CROSS JOIN n)
    SELECT px.image_id, px.y, px.x, {r6_sql('sum(p)')} AS v FROM px JOIN s ON s.image_id = px.image_id AND s.y = px.y AND s.x = px.x
    GROUP BY px.image_id, px.y, px.x""",
)
def blur(spark, sf_dir):
    return _out(stencil.gauss_blur(raster(spark, sf_dir)))


def _pool_sql(k: int, s: int, p: int) -> str:
    return f"""WITH {PX}, {HT},
    o AS (SELECT image_id, CAST(unnest(range((h + {2 * p} - {k}) // {s} + 1)) AS INTEGER) AS y FROM ht),
    g AS (SELECT image_id, y, CAST(unnest(range((64 + {2 * p} - {k}) // {s} + 1)) AS INTEGER) AS x FROM o)
    SELECT g.image_id, g.y, g.x, {r6_sql(f'sum(q.v) / {k * k}')} AS v FROM g JOIN px q ON q.image_id = g.image_id
      AND q.y BETWEEN g.y * {s} - {p} AND g.y * {s} - {p} + {k - 1} AND q.x BETWEEN g.x * {s} - {p} AND g.x * {s} - {p} + {k - 1}
    GROUP BY g.image_id, g.y, g.x"""


@query("avg_pool", _pool_sql(3, 2, 1))
def pool2(spark, sf_dir):
    return _out(stencil.avg_pool(raster(spark, sf_dir), 3, 2, 1))


@query("avg_pool_wide", _pool_sql(5, 4, 1))
def pool4(spark, sf_dir):
    return _out(stencil.avg_pool(raster(spark, sf_dir), 5, 4, 1))


@query(
    "avg_pool_pairs",
    f"""WITH {PX} SELECT image_id, y, CAST(x // 2 AS INTEGER) AS x, {r6_sql('avg(v)')} AS v FROM px GROUP BY image_id, y, x // 2""",
)
def pool_pairs(spark, sf_dir):
    return _out(stencil.avg_pool_x(raster(spark, sf_dir)))


@query(
    "refinement_running_sum",
    f"""WITH u AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS iter, value FROM events)
    SELECT user_id, CAST(iter AS INTEGER) AS iter,
      {r6_sql('10.0::DOUBLE + sum(value) OVER (PARTITION BY user_id ORDER BY iter)')} AS disp FROM u""",
)
def running(spark, sf_dir):
    """Updates from events: the user stands for the pixel, the event order for the iteration."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("delta"))
    placed = with_ordinal(ev, ["event_id"], ["user_id"])
    updates = placed.select("user_id", (F.col("ordinal") + 1).cast("int").alias("iter"), "delta")
    start = ev.select("user_id").distinct().withColumn("disp", F.lit(10.0))
    out = stencil.refine(start, updates, ["user_id"])
    return out.select("user_id", "iter", r6(F.col("disp")).alias("disp"))


@query(
    "refinement_final",
    f"SELECT user_id, {r6_sql('10.0::DOUBLE + sum(value)')} AS disp FROM events GROUP BY user_id",
)
def final(spark, sf_dir):
    preds = running(spark, sf_dir)
    return stencil.final_prediction(preds, ["user_id"])


# --- padding, tiles, cropping -----------------------------------------------------------------

_PAD14 = f"""WITH {PX}, {HT},
  pa AS (SELECT image_id, h, (14 - h % 14) % 14 AS ph, (14 - 64 % 14) % 14 AS pw FROM ht),
  rows AS (SELECT image_id, h, ph, pw, unnest(range(h + ph)) AS ty FROM pa),
  g AS (SELECT image_id, h, ph, pw, ty, unnest(range(64 + pw)) AS tx FROM rows)
  SELECT g.image_id, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, {r6_sql('v')} AS v FROM g JOIN px
    ON px.image_id = g.image_id AND px.y = greatest(0, least(h - 1, ty - {{top}})) AND px.x = greatest(0, least(63, tx - pw // 2))"""


@query("pad_replicate", _PAD14.format(top="ph // 2"))
def pad14(spark, sf_dir):
    return _out(grid.pad(raster(spark, sf_dir), 14))


@query("pad_bottom_only", _PAD14.format(top="0"))
def pad14_bottom(spark, sf_dir):
    return _out(grid.pad(raster(spark, sf_dir), 14, mode="top0"))


@query("pad_unpad", f"WITH {PX} SELECT image_id, y, x, {r6_sql('v')} AS v FROM px")
def pad_unpad(spark, sf_dir):
    lines = raster(spark, sf_dir)
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    height = F.least(F.lit(64), F.lit(last) + 1 - F.col("image_id") * 64).cast("int")
    return _out(grid.unpad(grid.pad(lines, 14), height, F.lit(64), 14))


@query(
    "tile_split",
    f"""WITH {PX} SELECT image_id, CAST((y // 4) * 16 + x // 4 AS INTEGER) AS token,
      CAST((y % 4) * 4 + x % 4 AS INTEGER) AS k, {r6_sql('v')} AS v FROM px""",
)
def tiles(spark, sf_dir):
    cut = grid.split_tiles(raster(spark, sf_dir), 4, border="keep")
    return cut.select("image_id", "token", F.posexplode_outer("vals").alias("k", "v")).withColumn("v", r6(F.col("v")))


@query("tile_round_trip", f"WITH {PX} SELECT image_id, y, x, {r6_sql('v')} AS v FROM px")
def tile_trip(spark, sf_dir):
    return _out(grid.join_tiles(grid.split_tiles(raster(spark, sf_dir), 4, border="keep"), 4))


@query(
    "crop",
    f"""WITH {PX} SELECT image_id, CAST(y - image_id % 4 AS INTEGER) AS y, CAST(x - image_id % 7 AS INTEGER) AS x, {r6_sql('v')} AS v
    FROM px WHERE y >= image_id % 4 AND y < image_id % 4 + 12 AND x >= image_id % 7 AND x < image_id % 7 + 40""",
)
def crop(spark, sf_dir):
    y0, x0 = F.pmod("image_id", F.lit(4)), F.pmod("image_id", F.lit(7))
    return _out(grid.crop(raster(spark, sf_dir), y0, x0, 12, 40))


@query(
    "flips",
    f"""WITH {PX}, {HT} SELECT image_id, CAST(h - 1 - y AS INTEGER) AS y, CAST(63 - x AS INTEGER) AS x, {r6_sql('v')} AS v FROM px JOIN ht USING (image_id)""",
)
def flips(spark, sf_dir):
    return _out(grid.flip_y(grid.flip_x(raster(spark, sf_dir))))


@query("coords_grid", f"WITH {PX} SELECT image_id, y, x FROM px")
def coords(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    heads = emb.groupBy(F.expr("vec_id div 64").alias("image_id")).agg(
        F.count(F.lit(1)).cast("int").alias("h"), F.max(F.size("embedding")).alias("w")
    )
    return grid.coords_grid(heads)


@query("lines_round_trip", f"WITH {PX} SELECT image_id, y, x, {r6_sql('v')} AS v FROM px")
def line_trip(spark, sf_dir):
    return _out(grid.to_lines(grid.to_pixels(raster(spark, sf_dir))))


@query("image_heights", f"WITH {HT} SELECT image_id, h FROM ht")
def image_heights(spark, sf_dir):
    return grid.heights(raster(spark, sf_dir))


# --- channels and values ----------------------------------------------------------------------


def _channels(spark, sf_dir):
    """Four channels per image: the raster, and three scaled copies of it."""
    lines = raster(spark, sf_dir).drop("ch")
    copies = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda c: F.struct(c.alias("ch"), F.transform("vals", lambda v: (v + 0.6) * 100 + c * 10).alias("vals")),
    )
    wide = lines.select("image_id", "y", "h", "w", F.explode_outer(copies).alias("c"))
    return wide.select("image_id", "c.ch", "y", "h", "w", "c.vals")


CHANNELS = f"{PX}, chs AS (SELECT image_id, c AS ch, y, x, (v + 0.6) * 100 + c * 10 AS v FROM px CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS c))"
_MEANS = "list_value(0.485::DOUBLE, 0.456::DOUBLE, 0.406::DOUBLE)[ch + 1]"
_STDS = "list_value(0.229::DOUBLE, 0.224::DOUBLE, 0.225::DOUBLE)[ch + 1]"


@query(
    "channel_standardise",
    f"WITH {CHANNELS} SELECT image_id, ch, y, x, {r6_sql(f'(v / 255.0::DOUBLE - {_MEANS}) / {_STDS}')} AS v FROM chs WHERE ch < 3",
)
def channel_standardise(spark, sf_dir):
    lines = grid.first_channels(_channels(spark, sf_dir))
    out = lines.withColumn("vals", F.transform("vals", lambda v: standardise(v, F.col("ch"))))
    px = grid.to_pixels(out)
    return px.withColumn("v", r6(F.col("v")))


@query(
    "channel_layout",
    f"""WITH {CHANNELS}, rv AS (SELECT image_id, y, x, CAST(2 - ch AS INTEGER) AS ch, v FROM chs WHERE ch < 3)
    SELECT image_id, y, x, {r6_sql('max(CASE WHEN ch = 0 THEN v END)')} AS r, {r6_sql('max(CASE WHEN ch = 1 THEN v END)')} AS g,
      {r6_sql('max(CASE WHEN ch = 2 THEN v END)')} AS b FROM rv GROUP BY image_id, y, x""",
)
def channel_layout(spark, sf_dir):
    """Drop the fourth channel, reverse the order, and lay channels side by side."""
    lines = grid.reverse_channels(grid.first_channels(_channels(spark, sf_dir)))
    wide = grid.channels_to_columns(lines).withColumn("ch", F.lit(0))
    px = grid.to_pixels(wide, ["r", "g", "b"], ["r", "g", "b"]).drop("ch")
    return px.withColumns({c: r6(F.col(c)) for c in ("r", "g", "b")})


@query(
    "value_scaling",
    f"""WITH {PX}, s AS (SELECT image_id, y, x, (v + 0.6) * 200 AS v, v > 0.1 AS m FROM px)
    SELECT image_id, y, x, {r6_sql('v / 255.0::DOUBLE')} AS unit, {r6_sql('v / 127.5::DOUBLE - 1')} AS signed,
      {r6_sql('round_even((v / 127.5::DOUBLE - 1 + 1) * 127.5::DOUBLE, 0)')} AS restored,
      {r6_sql('CASE WHEN m THEN 0 ELSE v END')} AS hidden, {r6_sql('CASE WHEN m THEN -v ELSE v END')} AS mixed FROM s""",
)
def value_scaling(spark, sf_dir):
    lines = raster(spark, sf_dir).withColumn("vals", F.transform("vals", lambda v: (v + 0.6) * 200))
    px = grid.to_pixels(lines).drop("ch")
    mask = F.when(F.col("v") > (F.lit(0.1) + 0.6) * 200, 1.0).otherwise(0.0)
    v = F.col("v")
    return px.select(
        "image_id", "y", "x",
        r6(unit_scale(v)).alias("unit"), r6(signed_scale(v)).alias("signed"),
        r6(signed_unscale(signed_scale(v))).alias("restored"),
        r6(hide_masked(v, mask)).alias("hidden"), r6(composite(-v, v, mask)).alias("mixed"),
    )


@query(
    "target_sizes",
    """WITH s AS (SELECT p_partkey, 320 + p_size * 37 AS w, 240 + (p_partkey % 50) * 29 AS h FROM part),
    k AS (SELECT *, 518.0::DOUBLE / w AS sw, 518.0::DOUBLE / h AS sh FROM s),
    t AS (SELECT *, CASE WHEN sw > sh THEN sw ELSE sh END AS lo, CASE WHEN sw < sh THEN sw ELSE sh END AS up,
      CASE WHEN abs(1 - sw) < abs(1 - sh) THEN sw ELSE sh END AS mi FROM k)
    SELECT p_partkey,
      CAST(CASE WHEN round_even(lo * w / 14, 0) * 14 < 518 THEN ceil(lo * w / 14) * 14 ELSE round_even(lo * w / 14, 0) * 14 END AS INTEGER) AS lower_w,
      CAST(CASE WHEN round_even(lo * h / 14, 0) * 14 < 518 THEN ceil(lo * h / 14) * 14 ELSE round_even(lo * h / 14, 0) * 14 END AS INTEGER) AS lower_h,
      CAST(CASE WHEN round_even(up * w / 14, 0) * 14 > 518 THEN floor(up * w / 14) * 14 ELSE round_even(up * w / 14, 0) * 14 END AS INTEGER) AS upper_w,
      CAST(CASE WHEN round_even(up * h / 14, 0) * 14 > 518 THEN floor(up * h / 14) * 14 ELSE round_even(up * h / 14, 0) * 14 END AS INTEGER) AS upper_h,
      CAST(round_even(mi * w / 14, 0) * 14 AS INTEGER) AS minimal_w, CAST(round_even(mi * h / 14, 0) * 14 AS INTEGER) AS minimal_h
    FROM t""",
)
def target_sizes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    w, h = 320 + F.col("p_size") * 37, 240 + F.pmod("p_partkey", F.lit(50)) * 29
    cols = []
    for short, method in (("lower", "lower_bound"), ("upper", "upper_bound"), ("minimal", "minimal")):
        tw, th = target_size(w, h, 518, 518, method, 14, keep_aspect=True)
        cols += [tw.alias(f"{short}_w"), th.alias(f"{short}_h")]
    return part.select("p_partkey", *cols)


@query(
    "pad_amounts",
    """WITH s AS (SELECT p_partkey, CAST(320 + p_size * 37 AS INTEGER) AS w, CAST(240 + (p_partkey % 50) * 29 AS INTEGER) AS h FROM part),
    a AS (SELECT p_partkey, w, h, (32 - w % 32) % 32 AS pw, (32 - h % 32) % 32 AS ph FROM s)
    SELECT p_partkey, CAST(pw // 2 AS INTEGER) AS "left", CAST(pw - pw // 2 AS INTEGER) AS "right",
      CAST(ph // 2 AS INTEGER) AS top, CAST(ph - ph // 2 AS INTEGER) AS bottom,
      CAST(greatest(least(w, h) * 5 // 1000, 1) AS INTEGER) AS scale FROM a""",
)
def pads(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    w, h = (320 + F.col("p_size") * 37).cast("int"), (240 + F.pmod("p_partkey", F.lit(50)) * 29).cast("int")
    p = pad_amounts(w, h, 32)
    return part.select("p_partkey", *[c.alias(n) for n, c in p.items()], downscale_factor(h * 5, w * 5).alias("scale"))


# --- resizing ---------------------------------------------------------------------------------


def _resize_sql(oh: str, ow: str, mode: str, rule: str) -> str:
    """Target grid joined with its taps, weights written out."""

    def src(t, n, o):
        if rule == "corners":
            return f"CASE WHEN {o} > 1 THEN {t} * ({n} - 1) / ({o} - 1)::DOUBLE ELSE 0 END"
        return f"({t} + 0.5::DOUBLE) / ({o} / {n}::DOUBLE) - 0.5::DOUBLE"

    if mode == "bilinear":
        ks, wt = "0, 1", "CASE k WHEN 0 THEN 1 - f ELSE f END"
    else:
        ks = "-1, 0, 1, 2"
        near = "((-0.75 + 2) * {d} - (-0.75 + 3)) * {d} * {d} + 1"
        far = "((-0.75 * {d} - 5 * -0.75) * {d} + 8 * -0.75) * {d} - 4 * -0.75"
        wt = (
            f"CASE k WHEN -1 THEN {far.format(d='(f + 1)')} WHEN 0 THEN {near.format(d='f')} "
            f"WHEN 1 THEN {near.format(d='(1 - f)')} ELSE {far.format(d='(2 - f)')} END"
        )
    return f"""WITH {PX}, {HT},
    ty AS (SELECT image_id, h, unnest(range({oh})) AS t FROM ht),
    sy AS (SELECT image_id, h, t, {src('t', 'h', oh)} AS s FROM ty),
    wy AS (SELECT image_id, t, greatest(0, least(h - 1, floor(s) + k)) AS y, {wt} AS wt FROM
      (SELECT *, s - floor(s) AS f FROM sy) CROSS JOIN (SELECT unnest([{ks}]) AS k)),
    sx AS (SELECT t, {src('t', '64', ow)} AS s FROM (SELECT unnest(range({ow})) AS t)),
    wx AS (SELECT t, greatest(0, least(63, floor(s) + k)) AS x, {wt} AS wt FROM
      (SELECT *, s - floor(s) AS f FROM sx) CROSS JOIN (SELECT unnest([{ks}]) AS k)),
    hx AS (SELECT image_id, y, wx.t AS tx, sum(wt * v) AS v FROM px JOIN wx ON wx.x = px.x GROUP BY image_id, y, wx.t)
    SELECT wy.image_id, CAST(wy.t AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, {r6_sql('sum(wt * v)')} AS v
    FROM wy JOIN hx ON hx.image_id = wy.image_id AND hx.y = wy.y GROUP BY wy.image_id, wy.t, tx"""


@query("resize_bilinear", _resize_sql("40", "100", "bilinear", "corners"))
def bilinear(spark, sf_dir):
    return _out(grid.resize(raster(spark, sf_dir), 40, 100))


@query("resize_bilinear_centers", _resize_sql("90", "31", "bilinear", "centers"))
def bilinear_centers(spark, sf_dir):
    return _out(grid.resize(raster(spark, sf_dir), 90, 31, rule="centers"))


@query("resize_bicubic", _resize_sql("48", "90", "bicubic", "corners"))
def bicubic(spark, sf_dir):
    return _out(grid.resize(raster(spark, sf_dir), 48, 90, mode="bicubic"))


@query("resize_bicubic_centers", _resize_sql("33", "50", "bicubic", "centers"))
def bicubic_centers(spark, sf_dir):
    return _out(grid.resize(raster(spark, sf_dir), 33, 50, mode="bicubic", rule="centers"))


@query(
    "resize_nearest",
    f"""WITH {PX}, {HT}, ty AS (SELECT image_id, h, unnest(range(45)) AS t FROM ht),
    g AS (SELECT image_id, h, t, unnest(range(100)) AS u FROM ty)
    SELECT g.image_id, CAST(t AS INTEGER) AS y, CAST(u AS INTEGER) AS x, {r6_sql('v')} AS v FROM g JOIN px ON px.image_id = g.image_id
      AND px.y = least(h - 1, floor(t / (45 / h::DOUBLE))) AND px.x = least(63, floor(u / (100 / 64.0::DOUBLE)))""",
)
def nearest(spark, sf_dir):
    return _out(grid.resize(raster(spark, sf_dir), 45, 100, mode="nearest"))


@query(
    "resize_disparity",
    _resize_sql("32", "32", "bilinear", "corners").replace("sum(wt * v), 6", "sum(wt * v) * 0.5, 6"),
)
def disparity(spark, sf_dir):
    return _out(grid.resize_disparity(raster(spark, sf_dir), 32, 32))


