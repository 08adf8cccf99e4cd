"""Joins of a large table with one that is usually small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.session import pin_and_measure

_UNITS = {"b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20, "g": 2**30, "gb": 2**30}


def _bytes(text: str) -> int:
    text = text.strip().lower()
    digits = text.rstrip("bkmg")
    return int(float(digits) * _UNITS.get(text[len(digits):] or "b", 1))


def broadcast_limit(df: DataFrame) -> int:
    return _bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10MB"))


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
    salts: int = 16,
    max_bytes: int | None = None,
) -> DataFrame:
    """Join ``big`` to ``small`` without shuffling ``big`` when ``small`` provably fits.

    ``small`` is written once to the checkpoint folder and measured by the same
    job. Up to ``max_bytes`` (default: the session's broadcast threshold) it is
    broadcast. Beyond that both sides are shuffled on the key plus a salt, so a
    key that holds a large share of ``big`` is spread over ``salts`` tasks.
    ``how`` is inner, left, left_semi or left_anti.
    """
    on = list(on)
    pinned, _, size = pin_and_measure(small)
    limit = broadcast_limit(big) if max_bytes is None else max_bytes
    renamed = pinned.withColumnsRenamed({c: f"__r_{c}" for c in on})

    def condition(left: DataFrame, right: DataFrame):
        match = F.lit(True)
        for c in on:
            l, r = left[c], right[f"__r_{c}"]
            match = match & (l.eqNullSafe(r) if null_safe else l == r)
        return match

    drop = [f"__r_{c}" for c in on] if how in ("inner", "left") else []
    if size <= limit:
        return big.join(F.broadcast(renamed), condition(big, renamed), how).drop(*drop)

    nested = ("array", "struct", "map", "variant", "binary")
    plain = [f.name for f in big.schema.fields if f.dataType.typeName() not in nested]
    # hashing long arrays is only worth it where nothing else tells rows of a key apart
    spread = plain if set(plain) - set(on) else [f.name for f in big.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = renamed.withColumn("__r_salt", F.explode_outer(F.sequence(F.lit(0), F.lit(salts - 1))))
    match = (salted["__salt"] == copies["__r_salt"]) & condition(salted, copies)
    return salted.join(copies, match, how).drop("__salt", "__r_salt", *drop)
