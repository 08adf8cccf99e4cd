"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Each source serves its documents in an order shuffled by hash, up to ``limit`` times over. An occurrence's virtual finish time is
the words its source has served by then, over the source's target. All occurrences are sorted by that time and cut where the words
reach the budget, which is the size of the whole table: at virtual time 1. Documents that are being served then are taken up to that
point, so every source ends within a word of its target, and the words taken are the budget to the word.

The sorts never run in one task: the shuffle order of a source is cut by the leading bits of the hash, and the queue by ranges of
virtual time that hold about as many words each; a range needs only the sum of the ranges before it.

Rows and ties: a null text has no words and is never taken, nor is a source without words. Null sources are one source, the last.
A null id draws as the empty text does. Rows that repeat an id are documents of their own. Equal draws are served by id, then
size; equal finish times by source, then pass, then draw. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanmill.operators.lookup import lookup_join
from scanmill.operators.ordinal import with_ordinal

from .common import stored, text_or_empty

#: bits of a draw
DRAW_BITS = 60
#: rows of one slot of the shuffle order, about
SLOT_ROWS = 8192
#: words of one range of the queue, about
RANGE_WORDS = 1 << 16
_BLOCK_BITS = 10
WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`, in memory of the text's own order: every word becomes one letter."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.length(F.regexp_replace(marks, r"[\x20\x09-\x0D]+", "")).cast("long")


def draw(doc_id: Column) -> Column:
    """Place of a document in its source's shuffled order, a number of :data:`DRAW_BITS` bits."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("long")


def running_total(rows: DataFrame, group: Sequence[str], slot: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and with each row among its group, in the order of ``slot``, then ``order``.

    A window holds one slot of one group. What lies before a slot is summed over slots of a block and over blocks.
    """
    by = list(group)
    sums = rows.groupBy(*by, slot).agg(F.sum(value).alias("__sum"))
    sums = stored(sums.withColumn("__block", F.shiftright(slot, _BLOCK_BITS)), "mix-sums")
    blocks = sums.groupBy(*by, "__block").agg(F.sum("__sum").alias("__all"))
    over_blocks = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__earlier", F.coalesce(F.sum("__all").over(over_blocks), F.lit(0))).drop("__all")
    over_slots = Window.partitionBy(*by, "__block").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(blocks, [*by, "__block"]).select(
        *by, slot, (F.col("__earlier") + F.coalesce(F.sum("__sum").over(over_slots), F.lit(0))).alias("__before"))
    inside = Window.partitionBy(*by, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("__inside", F.sum(value).over(inside)).join(starts, [*by, slot])
        .withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")
    )


def fair_targets(sources: DataFrame, limit: int = 3) -> DataFrame:
    """Add ``target`` to ``rank, source_size, weight``: shares of all words by weight, no more than ``limit`` times the
    source, and what is above that shared again among the others until none is above. A round is one aggregate.

    ``quota`` is the target in whole words: shares are rounded at their ends, one behind the other by rank, so none is lost."""
    size, weight = F.col("source_size").cast(WIDE), F.col("weight").cast(WIDE)
    slots = F.expr("rank div 4096")
    total = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    left, share = int(total["words"] or 0), int(total["weights"] or 0)
    while True:
        above = F.coalesce(limit * size * F.lit(share).cast(WIDE) < weight * F.lit(left).cast(WIDE), F.lit(False))
        seen = sources.agg(
            F.sum(F.when(above, limit * F.col("source_size")).otherwise(0)).alias("full"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open")).first()
        now = int(total["words"] or 0) - int(seen["full"] or 0), int(seen["open"] or 0)
        if now == (left, share):
            break
        left, share = now
    shared = F.col("weight").cast("double") * F.lit(left).cast("double") / F.lit(max(share, 1)).cast("double")
    placed = sources.withColumns({
        "target": F.when(above, (limit * F.col("source_size")).cast("double")).otherwise(shared),
        "__full": above, "__open": F.when(above, 0).otherwise(F.col("weight")).cast("long"), "__slot": slots})
    placed = running_total(placed, [], "__slot", ["rank"], "__open", "__upto")
    mark = lambda end: F.expr(f"cast({end} as {WIDE}) * cast({left} as {WIDE}) div cast({max(share, 1)} as {WIDE})")
    quota = F.when(F.col("__full"), limit * F.col("source_size")).otherwise(mark("__upto") - mark("(__upto - __open)"))
    return placed.withColumn("quota", quota.cast("long")).drop("__full", "__open", "__slot", "__upto")


def queue(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), limit: int = 3,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Documents with ``size, rank, source_size, target, served`` (words of the source up to and with the document), and the
    queue of their occurrences with ``pass, finish, start`` (words of the queue before it) and ``words`` (those the mix takes).
    """
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(text_or_empty(text_col)).alias("size"), draw(F.col(id_col)).alias("draw")), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = sources.withColumn("last", F.col("source").isNull())
    sources = with_ordinal(stored(sources, "mix-sources"), ["last", "source"], name="rank")
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(fair_targets(sources.withColumn("weight", pick), limit), "mix-targets")
    seen = sources.agg(F.sum("rows").alias("rows"), F.sum("source_size").alias("words")).first()
    n, budget = int(seen["rows"] or 0), int(seen["words"] or 0)

    bits = max(0, (n // SLOT_ROWS).bit_length())
    facts = sources.select("source", "rank", "source_size", "target", "quota")
    placed = lookup_join(rows, facts, ["source"], null_safe=True).withColumn("slot", F.shiftright("draw", DRAW_BITS - bits))
    placed = running_total(placed, ["rank"], "slot", ["draw", "doc_id", "size"], "size", "served")
    placed = stored(placed.drop("slot"), "mix-served")

    done = F.col("pass") * F.col("source_size") + F.col("served")
    ranges = max(1, budget // RANGE_WORDS)
    served = placed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
    # what the cut leaves of an occurrence; at virtual time 1 a source has served its target
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - (done - F.col("size")))).cast("long")
    served = served.withColumns({"finish": done.cast("double") / F.col("target"), "words": words})
    served = served.withColumn("range", F.floor(F.col("finish") * F.lit(float(ranges))))
    queued = running_total(served, [], "range", ["finish", "rank", "pass", "draw", "served"], "words", "end")
    return placed, queued.withColumn("start", (F.col("end") - F.col("words")).cast("long")).drop("range", "end")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), limit: int = 3, **columns: str) -> DataFrame:
    """The mix in its order: ``doc_id, source, pass, start, words``; ``words`` is less than the document only at the cut."""
    _, queued = queue(docs, weights, limit, **columns)
    return queued.where("words > 0").select("doc_id", "source", "pass", "start", "words").orderBy("start")


def mix_report(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), limit: int = 3, **columns: str) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and ``first_start``, the words of the mix before it is
    first taken (null if it never is)."""
    placed, queued = queue(docs, weights, limit, **columns)
    facts = ["doc_id", "size", "source_size", "target"]
    # documents with words differ in the words served up to them, whatever their ids
    found = queued.groupBy("rank", "served", *facts).agg(
        F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("start"))).alias("first_start"))
    without = placed.where("size = 0").select(
        *facts, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_start"))
    return found.select(*facts, "taken", "first_start").unionByName(without)
