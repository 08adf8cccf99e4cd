"""Repeated lines, sentences or paragraphs: units are normalised and hashed, digests grouped over all documents, the earliest stays.

A unit is a line (or a paragraph: text between blank lines) of at least ``min_words`` words. With ``sentence``, lines are units and
so are the sentences inside them, of at least ``SENTENCE_WORDS`` words, so that passages are reached that repeat from mid-line to
mid-line. Normalised: words only, lower case, one space between them. Of units with one 128-bit digest the occurrence with the
smallest (doc_id, text, start) stays; every other one is removed with the white space behind it. An earlier occurrence is kept or
went for one earlier still, so nothing is lost altogether. Offsets are code points of the original text.

Rows and ties: null and empty texts have no units. Rows that repeat both id and text are one occurrence and get the same result.
A row without an id ranks behind all others. Empty tables give empty results; other columns pass through untouched, whatever
their names, but for ``removed_spans`` and ``kept_text``, in whose place :func:`mark_units` puts its own. They are ignored in
:func:`repeated_units`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, slices, stored

UNITS = "id long, sha binary, start int, stop int, digest binary"
_WORD = re.compile(r"\w+")
_VISIBLE = re.compile(r"\S")
#: what a unit is; the second pattern takes quadratic time on blanks, so :data:`_SPLIT` finds the same units by other means
_UNIT = {"line": re.compile(r"[^\n]+\n?"), "paragraph": re.compile(r"(?:[^\n]*\S[^\n]*(?:\n|$))+\s*")}
#: white space behind the end of a sentence; it looks back, so a long run of marks or blanks takes linear time
_END = re.compile(r"(?:(?<=[.!?…])|(?<=[.!?…][\"'»”’)\]]))\s+")
#: a sentence of fewer words inside a line is often alike by chance
SENTENCE_WORDS = 8
LAST = (1 << 63) - 1


def _lines(text: str) -> Iterator[tuple[int, int]]:
    for found in _UNIT["line"].finditer(text):
        yield found.span()


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of lines that are not blank, each with the white space behind it; every character is looked at a fixed number of times."""
    at = 0
    while first := _VISIBLE.search(text, at):
        start = stop = max(at, text.rfind("\n", at, first.start()) + 1)
        while stop < len(text):
            end = text.find("\n", stop) + 1 or len(text)
            if text[stop:end].isspace():
                break
            stop = end
        behind = _VISIBLE.search(text, stop)
        at = behind.start() if behind else len(text)
        yield start, at


_SPLIT = {"line": _lines, "paragraph": _paragraphs}


def _sentences(text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """The sentences of one line, each with the white space behind it; together they are the line."""
    for found in _END.finditer(text, start, stop):
        yield start, found.end()
        start = found.end()
    if start < stop:
        yield start, stop


def _words(text: str, unit: str, min_words: int) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and normalised words of every unit of the text."""
    if unit != "sentence":
        for start, stop in _SPLIT[unit](text):
            words = _WORD.findall(text[start:stop].lower())
            if len(words) >= min_words:
                yield start, stop, words
        return
    for start, stop in _lines(text):
        parts = [(a, b, _WORD.findall(text[a:b].lower())) for a, b in _sentences(text, start, stop)]
        line = [word for _, _, words in parts for word in words]
        if len(line) >= min_words:
            yield start, stop, line
        for part in parts:
            # a sentence with all words of its line is that line
            if max(SENTENCE_WORDS, min_words) <= len(part[2]) < len(line):
                yield part


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({
        "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "__sha": F.unhex(F.md5(text)), "__text": text})


def _occurrences(docs: DataFrame, unit: str, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """Units that occur at two places or more: ``id, sha, start, stop, stays``. A digest is reduced in every task before it is
    shuffled; on the way back a digest that fills a third of all units is split by AQE, as its other side is one row."""
    ready(docs.sparkSession)
    if unit != "sentence" and unit not in _SPLIT:
        raise ValueError(f"unknown unit: {unit}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            ids, shas, starts, stops, digests = [], [], [], [], []
            for doc_id, sha, text in zip(*(rows.column(c).to_pylist() for c in ("id", "sha", "text"))):
                for start, stop, words in _words(text, unit, min_words):
                    ids.append(doc_id)
                    shas.append(sha)
                    starts.append(start)
                    stops.append(stop)
                    digests.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(shas, pa.binary()), pa.array(starts, pa.int32()),
                 pa.array(stops, pa.int32()), pa.array(digests, pa.binary())],
                names=["id", "sha", "start", "stop", "digest"])

    rows = _keyed(docs, id_col, text_col).select(F.col("__id").alias("id"), F.col("__sha").alias("sha"), F.col("__text").alias("text"))
    units = stored(rows.mapInArrow(cut, UNITS), "units")
    place = F.struct("id", "sha", "start")
    first = units.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    # stored, so that both sides of the join are plain shuffles, which AQE splits where a digest is hot
    first = stored(first.select("digest", "first"), "first-units")
    return units.join(first, "digest").select("id", "sha", "start", "stop", (place == F.col("first")).alias("stays"))


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Units to remove: ``id, sha, start, stop``."""
    return _occurrences(docs, unit, min_words, id_col, text_col).where("not stays").select("id", "sha", "start", "stop").distinct()


def _spans(units: DataFrame) -> DataFrame:
    """One row per document: its spans to remove in order, those that touch or overlap as one span, and how many characters lie in
    units that occur again, removed or not."""
    place = Window.partitionBy("id", "sha").orderBy("start", "stop")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    gone = ~F.col("stays")
    units = units.withColumns({"reach": F.max("stop").over(before), "gone_to": F.max(F.when(gone, F.col("stop"))).over(before)})
    begins = F.when(gone & (F.col("gone_to").isNull() | (F.col("gone_to") < F.col("start"))), 1).otherwise(0)
    units = units.withColumn("span", F.sum(begins).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("reach", F.lit(0))))
    spans = units.groupBy("id", "sha", "span").agg(
        F.min(F.when(gone, F.col("start"))).alias("start"), F.max(F.when(gone, F.col("stop"))).alias("stop"), F.sum(fresh).alias("fresh"))
    found = F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "stop"))))
    return spans.groupBy(F.col("id").alias("__id"), F.col("sha").alias("__sha")).agg(
        found.alias("__found"), F.sum("fresh").alias("__repeated"))


def _marked(docs: DataFrame, unit: str, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """All documents with their columns, ``__spans`` and ``__kept``."""
    repeats = _spans(_occurrences(docs, unit, min_words, id_col, text_col))
    rows = _keyed(docs, id_col, text_col).join(repeats, ["__id", "__sha"], "left")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    rows = rows.withColumn("__spans", F.coalesce("__found", none))
    text = F.col("__text")
    # what lies between the spans, and behind the last one
    parts = F.transform("__spans", lambda x, k: F.substring(
        text, F.when(k == 0, 1).otherwise(F.get(F.col("__spans"), k - 1)["stop"] + 1).cast("int"),
        (x["start"] - F.when(k == 0, 0).otherwise(F.get(F.col("__spans"), k - 1)["stop"])).cast("int")))
    rest = F.substring(text, (F.element_at("__spans", -1)["stop"] + 1).cast("int"), F.length(text))
    kept = F.when(F.size("__spans") == 0, text).otherwise(F.concat(F.array_join(parts, ""), rest))
    return rows.withColumn("__kept", kept).drop("__id", "__sha", "__text", "__found")


def mark_units(docs: DataFrame, unit: str = "line", min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with their columns and ``removed_spans`` ([start, stop), in order) and ``kept_text``."""
    own = {"__spans": "removed_spans", "__kept": "kept_text"}
    return _marked(docs, unit, min_words, id_col, text_col).drop("__repeated", *own.values()).withColumnsRenamed(own)


def drop_units(docs: DataFrame, unit: str = "line", min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated units taken out of their text; all other columns as they are."""
    out = _marked(docs, unit, min_words, id_col, text_col)
    changed = F.when(F.size("__spans") > 0, F.col("__kept")).otherwise(F.col(text_col))
    return out.withColumn(text_col, changed).select(docs.columns)


def unit_report(docs: DataFrame, unit: str = "sentence", min_words: int = 5) -> DataFrame:
    """Per document: ``doc_id, n_removed, n_repeated, n_spans, n_chars, removed_spans, kept_sha256, kept_text``. ``n_removed`` counts
    the characters that go, ``n_repeated`` those in units that occur again anywhere, the earliest occurrence included; ``n_chars``
    is the size before."""
    out = _marked(docs.select("doc_id", "text"), unit, min_words, "doc_id", "text")
    removed = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, x: a + (x["stop"] - x["start"]))
    return out.select(
        "doc_id", removed.alias("n_removed"), F.coalesce("__repeated", F.lit(0)).cast("long").alias("n_repeated"),
        F.size("__spans").cast("long").alias("n_spans"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.col("__spans").alias("removed_spans"), F.sha2("__kept", 256).alias("kept_sha256"), F.col("__kept").alias("kept_text"))
