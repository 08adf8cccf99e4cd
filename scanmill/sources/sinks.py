"""Where products, metrics and reports are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.arrays import let
from scanmill.functions.paths import derived_path
from scanmill.functions.scalar import signed_unscale
from scanmill.operators.depth import minmax
from scanmill.operators.lookup import lookup_join

PALETTE_SIZE = 256
# Folder and extension of each product of a left image.
PRODUCTS = {
    "disparity": "npy",
    "confidence": "npy",
    "right": "png",
    "mask_nocc": "png",
    "mask_inpaint": "png",
}


def products(lines: DataFrame, kind: str, left_path: str = "left_path") -> DataFrame:
    """Rows of one product with the path the product is known by."""
    return lines.withColumns(
        {"kind": F.lit(kind), "out_path": derived_path(F.col(left_path), kind, PRODUCTS[kind])}
    )


def to_bytes(lines: DataFrame, signed: bool = True, col: str = "vals") -> DataFrame:
    """Values -1..1 (or masks 0..1) as whole numbers 0..255, rounded half to even."""
    scale = (lambda v: signed_unscale(v)) if signed else (lambda v: F.rint(v.cast("double") * 255))
    return lines.withColumn(col, F.transform(col, lambda v: scale(v).cast("int")))


def write_maps(df: DataFrame, out: str, mode: str = "append") -> None:
    """Store product lines by dataset and kind.

    Lines are clustered by image before writing, so an image's lines sit together
    and Parquet can skip by ``image_id``; the image and line hash keeps one large
    image from becoming one task.
    """
    spread = df.repartition(F.col("dataset"), F.col("kind"), F.col("image_id"), (F.col("y") / 256).cast("int"))
    spread.sortWithinPartitions("dataset", "kind", "image_id", "ch", "y").write.mode(mode).partitionBy(
        "dataset", "kind"
    ).parquet(out)


def write_result_files(results: DataFrame, out: str) -> None:
    """One text file per item, below ``filename=<item>``."""
    results.select("filename", "value").write.mode("append").partitionBy("filename").text(out)


def render_disparity(lines: DataFrame, palette: DataFrame, col: str = "vals") -> DataFrame:
    """Min-max scale each image and look its values up in a 256-entry palette.

    ``palette(idx, r, g, b)`` has one row per index 0..255, so it is small enough
    to become a constant of the plan: lines are coloured without a join and
    without exploding them. A constant image takes the first entry.
    """
    rows = palette.limit(PALETTE_SIZE + 1).collect()
    entries = {r["idx"]: r for r in rows}
    if len(rows) != PALETTE_SIZE or set(entries) != set(range(PALETTE_SIZE)):
        raise ValueError(f"a palette has the entries 0 to {PALETTE_SIZE - 1} once each")
    table = {
        c: F.expr("array(" + ",".join(str(entries[i][c]) for i in range(PALETTE_SIZE)) + ")") for c in ("r", "g", "b")
    }
    ranged = lookup_join(lines, minmax(lines, [col]), ["image_id"])
    span = F.col(f"{col}_max") - F.col(f"{col}_min")

    def index(v: Column) -> Column:
        scaled = F.when(span > 0, (v - F.col(f"{col}_min")) / span).otherwise(0.0)
        return F.least(F.floor(scaled * PALETTE_SIZE), F.lit(PALETTE_SIZE - 1)).cast("int")

    indexed = ranged.withColumn("__i", F.transform(col, index))

    def paint(c: str) -> Column:
        return let(table[c], lambda t: F.transform("__i", lambda i: F.get(t, i)))

    return indexed.select(*[c for c in lines.columns if c != col], *[paint(c).alias(c) for c in ("r", "g", "b")])


def log_metrics(metrics: DataFrame, step: int, out: str) -> None:
    """Append (step, name, value) rows; ``metrics`` has one column per metric."""
    names = [f.name for f in metrics.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer")]
    keys = [f.name for f in metrics.schema.fields if f.dataType.typeName() == "string"]
    points = F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).cast("double").alias("v")) for n in names])
    label = F.concat_ws("/", *[F.col(k) for k in keys], F.col("p.n"))
    metrics.select(*keys, F.explode(points).alias("p")).select(
        F.lit(step).cast("long").alias("step"), label.alias("name"), F.col("p.v").alias("value")
    ).write.mode("append").parquet(out)


def write_dataset(lines: DataFrame, out: str, seed: int, **parameters) -> None:
    """Product lines plus a one-row JSON summary: counts per kind, parameters and seed."""
    write_maps(lines, f"{out}/data", mode="overwrite")
    stored = lines.sparkSession.read.parquet(f"{out}/data")
    counts = stored.groupBy("dataset", "kind").agg(
        F.count_distinct("image_id").alias("images"), F.count(F.lit(1)).alias("lines")
    )
    # one row per dataset and kind
    summary = counts.agg(F.sort_array(F.collect_list(F.struct("dataset", "kind", "images", "lines"))).alias("contents"))
    settings = {k: F.lit(v) for k, v in sorted(parameters.items())}
    if settings:
        summary = summary.withColumn("parameters", F.struct(*[v.alias(k) for k, v in settings.items()]))
    summary.withColumn("seed", F.lit(seed)).coalesce(1).write.mode("overwrite").json(f"{out}/meta")
