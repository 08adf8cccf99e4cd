"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Features are hashed byte trigrams of the whole lower-cased text (everything but letters is one space), as shares of the text
divided by the square root of their mean share. The machines are fitted on a bounded sample of labelled documents: up to about
``per_language`` documents of each language, drawn by a hash of the id; scoring reads every text in full.

Rows and ties: a null text, or one without a letter, is ``und`` with score 0. Equal votes go to the larger summed margin, then to
the code that sorts first. With one learned language every text with a letter gets it; with none, all are ``und``. Rows
that repeat an id are scored each on its own. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import LETTER, Bytes
from .common import held_out, ready, slices
from .linear import Rows, fit

BITS = 16
HAS_LETTER = re.compile(r"[^\W\d_]")
# fixed values: families of language codes; a code outside them is a family of its own
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi".split(),
    "romance": "an ast ca es fr gl it la lmo oc pt ro scn".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu se".split(),
    "indic": "bn gu hi mr ne pa sa ur".split(),
    "turkic": "az kk ky tr tt uz".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family(code: str) -> str:
    return FAMILY_OF.get(code.lower().split("-")[0].split("_")[0], code)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in a row, and each text's first one and their number. Number 0 means none."""
    b = Bytes(texts, lower=True)
    data = np.where(LETTER[b.data], b.data, np.uint8(32)).astype(np.uint32)
    code = np.zeros(len(data), dtype=np.uint32)
    if len(data) > 2:
        value = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        code[:-2] = (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        code[:-2][value == 0x202020] = 0
    ends = b.starts + b.sizes  # a trigram that reaches over the end of its text is none
    for back in (0, 1, 2):
        code[np.maximum(ends - back, b.starts)] = 0
    return code, b.starts, np.maximum(b.sizes - 2, 0)


def sample_rows(docs: DataFrame, per_language: int) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """Labels and trigram counts of the sample: at most about ``per_language`` rows of each label reach the driver."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            code, starts, _ = trigrams(rows.column("text"))
            feature, times = [], []
            for a, z in zip(starts, np.append(starts[1:], len(code))):
                f, n = np.unique(code[a:z], return_counts=True)
                feature.append(f[f > 0].astype(np.int32))
                times.append(n[f > 0].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [rows.column("lang"), pa.array([f.tobytes() for f in feature], pa.binary()), pa.array([t.tobytes() for t in times], pa.binary())],
                names=["lang", "feature", "times"])

    rows = picked.mapInArrow(count, "lang string, feature binary, times binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["feature"], r["times"]))
    rows = [r for r in rows if len(r["feature"])]
    read = lambda name: [np.frombuffer(r[name], dtype=np.int32) for r in rows]
    return [r["lang"] for r in rows], read("feature"), read("times")


class Model:
    """Pairwise machines between families and, within each, between languages; columns of one weight table."""

    def __init__(self, langs: list[str], features: list[np.ndarray], times: list[np.ndarray], steps: int = 60):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(family(lang), []).append(lang)
        size = 1 << BITS
        shares = [t / t.sum() for t in times]
        mean = np.zeros(size)
        for f, s in zip(features, shares):
            mean[f] += s
        scale = 1 / np.sqrt(mean / max(len(langs), 1) + 1e-6)
        label, tribe = np.array(langs), np.array([family(x) for x in langs])
        self.pairs: list[tuple[str, str]] = []
        table, bias = [], []
        groups = [(tribe, sorted(self.families))] + [(label, members) for members in self.families.values()]
        for of, names in groups:
            for a, z in combinations(names, 2):
                rows = np.flatnonzero((of == a) | (of == z))
                target = np.where(of[rows] == a, 1.0, -1.0)
                weight = np.where(target > 0, 0.5 / max((target > 0).sum(), 1), 0.5 / max((target < 0).sum(), 1))
                x = Rows([features[r] for r in rows], [shares[r] * scale[features[r]] for r in rows])
                w, b = fit(x, target, weight, size, "hinge", penalty=1e-3, steps=steps, rate=0.5)
                self.pairs.append((a, z))
                table.append(w * scale)
                bias.append(b)
        self.weights = np.array(table, dtype=np.float64).reshape(len(self.pairs), size)
        self.weights[:, 0] = 0
        self.bias = np.array(bias)

    def margins(self, code: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.pairs), len(starts)))
        for k in range(len(self.pairs)):
            out[k] = np.add.reduceat(self.weights[k][code], starts) / np.maximum(counts, 1) + self.bias[k]
        return out

    def _vote(self, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner among ``names`` and its smallest margin against them, per text."""
        n = margins.shape[1]
        won, total = np.zeros((len(names), n)), np.zeros((len(names), n))
        weakest = np.full((len(names), n), 4.0)
        for k, (a, z) in enumerate(self.pairs):
            if a in names and z in names:
                i, j = names.index(a), names.index(z)
                won[i] += margins[k] >= 0
                won[j] += margins[k] < 0
                for at, m in ((i, margins[k]), (j, -margins[k])):
                    total[at] += m
                    weakest[at] = np.minimum(weakest[at], m)
        best = np.argmax(won * 1e6 + total, axis=0)
        return best, weakest[best, np.arange(n)]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        code, starts, counts = trigrams(texts)
        if not self.families or not len(starts):
            return ["und"] * len(texts), np.zeros(len(texts))
        margins = self.margins(code, starts, counts)
        tribes = sorted(self.families)
        first, sure = self._vote(tribes, margins)
        langs, scores = np.empty(len(starts), dtype=object), np.zeros(len(starts))
        for k, tribe in enumerate(tribes):
            members = self.families[tribe]
            inside, second = self._vote(members, margins)
            here = first == k
            langs[here] = np.array(members, dtype=object)[inside[here]]
            scores[here] = 1 / ((1 + np.exp(-2 * sure[here])) * (1 + np.exp(-2 * second[here])))
        return list(langs), scores


def learn(docs: DataFrame, per_language: int = 400) -> Model:
    return Model(*sample_rows(docs, per_language))


def identify(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per document; the model is a table of fixed size, sent with the task."""
    ready(docs.sparkSession)
    model = learn(docs, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            langs, scores = shared.value.predict(rows.column("text"))
            for k, text in enumerate(rows.column("text").to_pylist()):
                if text is None or not HAS_LETTER.search(text):
                    langs[k], scores[k] = "und", 0.0
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
