"""Positions in a sorted listing, and what is built on them.

A position is never taken with one window over a whole dataset: the listing is
range-partitioned by (group, sort key), rows are numbered inside their range,
and only one row per (range, group) is summed up to find where each range
starts. A dataset that holds most of all files is thus spread over many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanmill.operators.lookup import lookup_join
from scanmill.session import pin

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def with_ordinal(
    df: DataFrame,
    order_by: Sequence[str],
    group_by: Sequence[str] = (),
    name: str = "ordinal",
) -> DataFrame:
    """Add the zero-based position of each row among its group, in ``order_by`` order."""
    keys = list(group_by)
    by = keys + list(order_by)
    numbered = pin(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("__id", F.monotonically_increasing_id())
    )
    placed = numbered.withColumn(
        "__range", F.shiftrightunsigned("__id", _POSITION_BITS).cast("int")
    ).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))

    spans = placed.groupBy("__range", *keys).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    # one row per range and group: a group's window holds at most as many rows as there are ranges
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("__range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = spans.select(
        "__range",
        *keys,
        "__first",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
    )
    joined = lookup_join(placed, starts, ["__range", *keys], null_safe=True)
    return joined.withColumn(
        name, (F.col("__before") + F.col("__at") - F.col("__first")).cast("long")
    ).drop("__id", "__range", "__at", "__first", "__before")


def shard(df: DataFrame, k: int, n: int, order_by: Sequence[str]) -> DataFrame:
    """Items k, k+n, k+2n, ... of the sorted listing."""
    return with_ordinal(df, order_by).filter(F.pmod(F.col("ordinal"), F.lit(n)) == k)


def even_sample(df: DataFrame, order_by: Sequence[str], k: int = 500) -> DataFrame:
    """Keep ``k`` evenly spaced positions, truncated to whole numbers, ends included."""
    placed = with_ordinal(df, order_by)
    n = placed.count()
    step = (n - 1) / (k - 1) if k > 1 else 0.0
    if step <= 0:
        return placed.filter(F.col("ordinal") == 0)

    def pick(i: Column) -> Column:
        """Position of pick ``i``."""
        return F.when(i >= k - 1, n - 1).otherwise(F.floor(i * F.lit(step)).cast("long"))

    # a row stays iff one of the picks around its place in the sample is its own position
    near = F.floor(F.col("ordinal") / F.lit(step)).cast("long")
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        i = near + d
        hit = hit | ((i >= 0) & (i <= k - 1) & (pick(i) == F.col("ordinal")))
    return placed.filter(hit)


def keep_ordinals(placed: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows whose position is in ``picks(ordinal)``."""
    return placed.join(picks, "ordinal", "left_semi")


def shuffle_key(seed: int, epoch: int, *ids: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(epoch), *ids)


def shuffle(df: DataFrame, ids: Sequence[str], seed: int, epoch: int = 0) -> DataFrame:
    """A new order per (seed, epoch) that does not depend on partitioning."""
    return (
        df.withColumn("__shuffle", shuffle_key(seed, epoch, *ids))
        .orderBy("__shuffle", *ids)
        .drop("__shuffle")
    )


def assign_batches(
    df: DataFrame,
    order_by: Sequence[str],
    total_batch: int | None = None,
    per_worker: int | None = None,
    workers: int = 1,
    drop_last: bool = True,
) -> DataFrame:
    """Cut the ordered rows into batches; ``drop_last`` removes a short final batch."""
    size = per_worker * workers if per_worker else total_batch
    if not size or size < 1:
        raise ValueError("give a total or a per-worker batch size")
    placed = with_ordinal(df, order_by)
    batched = placed.withColumn("batch_id", F.floor(F.col("ordinal") / size).cast("long"))
    if drop_last:
        batched = batched.filter(F.col("batch_id") < placed.count() // size)
    return batched


def check_aligned(assets: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Datasets whose listings differ in length, with the length of each."""
    counts = [
        F.sum(F.when(F.col("role") == r, 1).otherwise(0)).cast("long").alias(f"n_{r}") for r in roles
    ]
    lengths = assets.groupBy("dataset").agg(*counts)
    sizes = [F.col(f"n_{r}") for r in roles]
    return lengths.filter(F.greatest(*sizes) != F.least(*sizes))


def pair_by_position(
    assets: DataFrame,
    roles: Sequence[str],
    strict: bool = False,
    order_by: Sequence[str] = ("path",),
) -> DataFrame:
    """Zip the sorted listings of each dataset: one row per position, one path column per role.

    ``strict`` fails when lengths differ; otherwise the longer listings are cut.
    """
    if strict:
        bad = check_aligned(assets, roles).first()
        if bad is not None:
            raise ValueError(f"listings differ in length: {bad.asDict()}")
    wanted = assets.filter(F.col("role").isin(*roles))
    placed = with_ordinal(wanted, order_by, ["dataset", "role"])
    paired = placed.groupBy("dataset", "ordinal").agg(
        *[F.max(F.when(F.col("role") == r, F.col("path"))).alias(f"{r}_path") for r in roles]
    )
    complete = F.lit(True)
    for r in roles:
        complete = complete & F.col(f"{r}_path").isNotNull()
    return paired.filter(complete)


def pair_by_key(assets: DataFrame, roles: Sequence[str], key: Column) -> DataFrame:
    """Pair listings by a key derived from the path instead of by position.

    Two paths of one role with the same key fail the job; keys that a role lacks are
    left out, and :func:`unpaired_keys` names them.
    """
    def only(role: str) -> Column:
        path = F.when(F.col("role") == role, F.col("path"))
        what = F.concat(F.lit(f"two {role} paths with one key: "), F.min(path), F.lit(" and "), F.max(path))
        return F.when(F.count(path) > 1, F.raise_error(what).cast("string")).otherwise(F.min(path))

    keyed = assets.filter(F.col("role").isin(*roles)).withColumn("pair_key", key)
    paired = keyed.groupBy("dataset", "pair_key").agg(*[only(r).alias(f"{r}_path") for r in roles])
    return paired.dropna(subset=[f"{r}_path" for r in roles])


def unpaired_keys(assets: DataFrame, roles: Sequence[str], key: Column) -> DataFrame:
    """Keys that not every role has, with the number of paths of each role."""
    keyed = assets.filter(F.col("role").isin(*roles)).withColumn("pair_key", key)
    counts = [F.count(F.when(F.col("role") == r, 1)).alias(f"n_{r}") for r in roles]
    lacking = F.least(*[F.col(f"n_{r}") for r in roles]) if len(roles) > 1 else F.col(f"n_{roles[0]}")
    return keyed.groupBy("dataset", "pair_key").agg(*counts).filter(lacking == 0)


def first_n(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def append_listings(*parts: DataFrame) -> DataFrame:
    """Bag union that remembers which part a row came from, for ordering."""
    marked = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    out = marked[0]
    for p in marked[1:]:
        out = out.unionByName(p)
    return out


def concat_datasets(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_datasets(df: DataFrame, names: Sequence[str]) -> dict[str, DataFrame]:
    """One lazy view per named dataset, for loaders that are kept apart."""
    return {n: df.filter(F.col("dataset") == n) for n in names}


def count_by_dataset(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset").agg(F.count(F.lit(1)).alias("samples"))
