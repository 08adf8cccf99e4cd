"""A Merkle manifest of a table: a leaf a row, a tree a source, a tree over the sources, and a proof for every row.

The levels are built from below, one grouping each, and stored as node rows that name their parent and hold their children's
digests. A recursive query then climbs from the leaves: a step joins the rows under way with their parent's node row, appends the siblings
found there and folds the digests of the leaves under test. The leaves of one run have all siblings above the run in common, so they
climb in one row, each with its own fold; what travels is a sixteenth of the proofs, and digests travel as bytes.

H is the lowercase hex SHA-256 of its inputs one after the other, digests as hex text. A value goes in as its UTF-8 byte count, ``:``
and the value, a null as ``-``.

Rows and ties: sources ascend bytewise, null first. Leaves ascend by id, null first, equal ids by digest, so rows that repeat are leaves of
their own with interchangeable places. A row with a null id is never tampered with. A lone leaf is its source's subroot, the subroot of
a lone source the root; the proof of a leaf without siblings anywhere is H of nothing. An empty table gives an empty result; columns
beyond the five are ignored, whatever their names. A missing one of the five is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.operators.lookup import lookup_join
from scanmill.operators.ordinal import with_ordinal

from .common import fold_ascii, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: nodes of a run, and bytes of a digest
FAN = 16
WIDTH = 32
#: tree number of the tree over the sources; the sources' trees count from 0
TOP = -1
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def framed(value: Column) -> Column:
    """A value with its length in front, so that no two rows are the same bytes."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[framed(v) for v in values]), 256))


def as_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def tampered_rows(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """``doc_id, tree, idx, n, digest, altered``: place among the ``n`` leaves of its source's tree, digest as it is and as tampered."""
    names = dict(zip(FIELDS, fields))
    value = {k: F.col(f"`{c}`") for k, c in names.items()}
    plain = leaf_digest(*value.values())
    lowered = value | {"text": fold_ascii(value["text"].cast("string"))}
    rows = stored(docs.select(
        value["doc_id"].alias("doc_id"), value["source"].cast("string").alias("source"), plain.alias("digest"),
        F.when(tampered_rows(value["doc_id"]), leaf_digest(*lowered.values())).alias("changed"),
    ).select("doc_id", "source", "digest", F.coalesce("changed", "digest").alias("altered")), "merkle-leaves")
    counts = stored(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "merkle-sources")
    sources = with_ordinal(counts, ["source"], name="tree")
    placed = with_ordinal(rows, ["doc_id", "digest"], ["source"], name="idx")
    return lookup_join(placed, sources, ["source"], null_safe=True).drop("source")


def _levels(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Inner levels over ``nodes(tree, idx, digest, n)`` and the one node that is left of each tree. ``most``: nodes of the largest."""
    built, tops = [], [nodes.where("n = 1").select("tree", "digest")]
    level = 0
    while most > 1:
        level, most = level + 1, -(-most // FAN)
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {FAN}").alias("run")).agg(
            F.unhex(F.array_join(F.transform(run, lambda s: F.hex(s["digest"])), "")).alias("kids"), F.first("n").alias("n"))
        runs = runs.select(
            "tree", F.lit(level).alias("level"), F.col("run").alias("idx"), F.unhex(F.sha2(as_text(F.col("kids")), 256)).alias("digest"),
            "kids",
            F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"))
        nodes = stored(runs, f"merkle-level-{level}")
        built.append(nodes)
        tops.append(nodes.where("n = 1").select("tree", "digest"))
    subroots = tops[0]
    for part in tops[1:]:
        subroots = subroots.unionByName(part)
    return built, subroots


def _link(nodes: DataFrame, sources: int) -> DataFrame:
    """Add the parent ``up_tree, up_level, up_idx`` and the ``place`` among its children; all null at the root."""
    inner, crown = F.col("n") > 1, (F.col("tree") != TOP) & F.lit(sources > 1)

    def pick(below, above):
        return F.when(inner, below).when(crown, above)

    return nodes.withColumns({
        "up_tree": pick(F.col("tree"), F.lit(TOP)).cast("long"),
        "up_level": pick(F.col("level") + 1, F.lit(1)).cast("int"),
        "up_idx": pick(F.expr(f"idx div {FAN}"), F.expr(f"tree div {FAN}")).cast("long"),
        "place": pick(F.col("idx") % FAN, F.col("tree") % FAN).cast("int"),
    })


def build(docs: DataFrame, fields: Sequence[str] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(leaves, inner nodes), stored, each row with its parent. A node's ``kids`` are its children's digests one after the other."""
    rows = stored(leaves(docs, fields), "merkle-placed")
    seen = rows.agg(F.max("n").alias("most"), (F.max("tree") + 1).alias("sources")).first()
    most, sources = int(seen["most"] or 0), int(seen["sources"] or 0)
    built, subroots = _levels(rows.select("tree", "idx", "digest", "n"), most)
    crown = stored(subroots, "merkle-subroots").select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(sources).cast("long").alias("n"))
    above, _ = _levels(crown, sources)
    spark = docs.sparkSession
    inner = spark.createDataFrame([], "tree long, level int, idx long, digest binary, kids binary, n long")
    for part in built + above:
        inner = inner.unionByName(part)
    nodes = stored(_link(inner, sources), "merkle-nodes")
    return _link(rows.withColumn("level", F.lit(0)), sources), nodes


_FOLD = f"""transform({{members}}, m -> named_struct('doc_id', m.doc_id, 'place', m.place, 'folded', unhex(sha2(lower(hex(concat(
  substring({{kids}}, 1, {WIDTH} * {{place}}), m.folded, substring({{kids}}, {WIDTH} * ({{place}} + 1) + 1)))), 256))))"""

_CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT up_tree, up_level, up_idx, place, kids, above, members, subroot, root FROM {{start}}
  UNION ALL
  SELECT n.up_tree, n.up_level, n.up_idx, n.place, c.kids,
         concat(c.above, substring(n.kids, 1, {WIDTH} * c.place), substring(n.kids, {WIDTH} * (c.place + 1) + 1)),
         {_FOLD.format(members="c.members", kids="n.kids", place="c.place")},
         coalesce(c.subroot, CASE WHEN n.tree <> {TOP} AND n.n = 1 THEN n.digest END),
         CASE WHEN n.up_level IS NULL THEN n.digest END
  FROM climb c JOIN {{nodes}} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_idx = n.idx)
SELECT kids, above, members, subroot, root FROM climb WHERE up_level IS NULL
"""


def climb(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a run of leaves, arrived at the root: ``kids, above`` (siblings above the run), ``members, subroot, root``."""
    spark = rows.sparkSession
    parent = nodes.select(
        F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), "kids", F.col("digest").alias("made"),
        F.col("n").alias("made_n"), F.col("up_tree").alias("next_tree"), F.col("up_level").alias("next_level"),
        F.col("up_idx").alias("next_idx"), F.col("place").alias("next_place"))
    alone = rows.where("up_level IS NULL").select(
        F.lit(None).cast("long").alias("up_tree"), F.lit(None).cast("int").alias("up_level"), F.lit(None).cast("long").alias("up_idx"),
        F.lit(None).cast("int").alias("place"), F.col("digest").alias("kids"), F.lit(b"").alias("above"),
        F.array(F.struct("doc_id", F.lit(0).alias("place"), F.col("altered").alias("folded"))).alias("members"),
        F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    runs = rows.where("up_level IS NOT NULL").groupBy("up_tree", "up_level", "up_idx").agg(
        F.collect_list(F.struct("doc_id", "place", F.col("altered").alias("folded"))).alias("members"))
    first = runs.join(parent, ["up_tree", "up_level", "up_idx"])
    first = first.select(
        F.col("next_tree").alias("up_tree"), F.col("next_level").alias("up_level"), F.col("next_idx").alias("up_idx"),
        F.col("next_place").alias("place"), "kids", F.lit(b"").alias("above"), F.expr(_FOLD.format(members="members", kids="kids", place="m.place")).alias("members"),
        F.when((F.col("up_tree") != TOP) & (F.col("made_n") == 1), F.col("made")).alias("subroot"),
        F.when(F.col("next_level").isNull(), F.col("made")).alias("root"))
    start = stored(first.unionByName(alone), "merkle-start")
    before = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")  # all rows climb, however many there are
    try:
        return stored(spark.sql(_CLIMB, start=start, nodes=nodes), "merkle-climbed")
    finally:
        if before is None:
            spark.conf.unset(_ROW_LIMIT)
        else:
            spark.conf.set(_ROW_LIMIT, before)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    rows = climb(*build(docs, fields)).withColumn("m", F.explode("members"))
    rows = rows.select("kids", "above", "subroot", "root", F.col("m.doc_id"), F.col("m.place"), F.col("m.folded").alias("folded_root"))
    leaf = F.expr(f"substring(kids, {WIDTH} * place + 1, {WIDTH})")
    left, right = F.expr(f"substring(kids, 1, {WIDTH} * place)"), F.expr(f"substring(kids, {WIDTH} * (place + 1) + 1)")
    return rows.select(
        "doc_id", as_text(leaf).alias("leaf"), as_text(F.coalesce("subroot", leaf)).alias("subroot"), as_text(F.col("root")).alias("root"),
        F.sha2(as_text(F.concat(left, right, "above")), 256).alias("proof_sha256"),
        as_text(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))
