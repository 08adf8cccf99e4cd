"""Toxicity by weak supervision: voters, a generative label model over their votes, a linear classifier on its posteriors.

Voters are lexicons and patterns: a public list of insults; words, short stems, long stems and stems that come up twice, mined from
labelled documents; several clues at once; address of the reader; shouting. Every voter fires or not on a whole text. The label
model is fitted by expectation maximisation to the votes of all documents outside the held-out fold (counted per vote pattern, at
most 2**voters rows), with the labelled sample's votes as cases of known class. Voters whose votes hang together more than the
classes explain are one joint voter in the second fit, so that agreement between copies of one clue isn't counted twice. A
logistic classifier over the mined features is then trained on the posteriors of the sample.

Sample: up to about ``per_class`` toxic and three times as many other labelled documents outside the held-out fold, drawn by a hash
of the id; only their distinct feature numbers reach the driver. Scoring reads every text in full; lang, source, doc_id and labels are no inputs.

Rows and ties: null and empty texts have no features and get the score of the bias, as a text without any clue. Rows that repeat
an id are scored each on its own; a document with several labels counts once per label row. Without any labelled document the
public list alone votes. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .bytehash import LETTER, Bytes
from .common import held_out, ready, slices
from .linear import Rows, fit

HASH = 19
#: kinds of features: whole word, stem of each size, stem of each size that comes up twice
STEMS = (5, 6, 7, 8)
KINDS = 1 + 2 * len(STEMS)
SIZE = KINDS << HASH
TWICE = len(STEMS) << HASH  # from a stem's number to that of its second coming
MINED, LISTED, MINED_TWICE = 1, 2, 4
# fixed values: common insults of English, all lower case
INSULTS = (
    "arsehole asshole bastard bimbo bitch bonehead clown coward creep cretin cunt deadbeat degenerate despicable dickhead dimwit"
    " dipshit disgrace disgusting dolt douchebag dumbass dunce filth fool freak fucker garbage halfwit idiot idiots ignoramus imbecile"
    " jackass jerk lazy liar loser losers lowlife lunatic maggot moron morons motherfucker nitwit nutjob parasite pathetic pig prick"
    " retard retarded scum scumbag shithead simpleton slut stupid sucker swine thug trash twat twit useless vermin whore worthless").split()
ADDRESS = re.compile(r"\b(?:you|you're|u r|your|du bist|ihr seid|tu es|vous êtes|eres|sois)\b[^.!?\n]{0,20}\b(?:" + "|".join(INSULTS) + r")\b", re.I)
SHOUT = re.compile(r"!{3,}|\b[A-Z]{4,}(?:\s+[A-Z]{4,}){3,}")
VOTERS = ["insults", "words", "short stems", "long stems", "repeated stems", "several clues", "address", "shouting"]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words and stems of all texts, and the text each is of (repeats included)."""
    b = Bytes(texts, lower=True)
    start, end, doc = b.words(LETTER)
    numbers, owners = [], []
    shift = np.uint64(64 - HASH)
    for kind, size in enumerate((0, *STEMS)):
        pick = slice(None) if not size else end - start >= size
        s = start[pick]
        hashed = b.hash(s, end if not size else s + size) >> shift
        numbers.append(hashed.astype(np.int64) + (kind << HASH))
        owners.append(doc[pick])
    return np.concatenate(numbers), np.concatenate(owners)


def distinct(number: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, with those of stems that come up twice, in order of the text."""
    pair, times = np.unique(owner * SIZE + number, return_counts=True)
    stem = (pair % SIZE) >> HASH
    pair = np.sort(np.concatenate([pair, pair[(times > 1) & (stem > 0)] + TWICE]))
    return pair // SIZE, pair % SIZE


def number_of(word: str) -> int:
    return int(features(pa.array([word]))[0][0])


def pattern_bits(text: str | None, insulted: bool) -> int:
    """Votes of the patterns of characters."""
    if not text:
        return 0
    return (1 << 6) * bool(insulted and ADDRESS.search(text)) | (1 << 7) * bool(SHOUT.search(text))


class Lexicons:
    """Feature numbers that fire the lexicon voters."""

    def __init__(self, mined: np.ndarray):
        self.mined = mined
        self.flag = np.zeros(SIZE, dtype=np.uint8)
        self.flag[mined] = MINED
        twice = mined[mined >> HASH > len(STEMS)]
        self.flag[twice - TWICE] |= MINED_TWICE
        self.listed = np.array([number_of(word) for word in INSULTS])
        self.flag[self.listed] |= LISTED

    def __reduce__(self):
        """Only the mined numbers travel: the table of all features would pass the driver's memory several times over."""
        return Lexicons, (self.mined,)

    def clues(self, number: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs that are clues."""
        hit = np.flatnonzero(self.flag[number])
        owner, number = distinct(number[hit], owner[hit])
        clue = (self.flag[number] & (MINED | LISTED)) > 0
        return owner[clue], number[clue]

    def bits(self, owner: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
        """Votes of the lexicons on each text, from its distinct clues."""
        out = np.zeros(n, dtype=np.int64)
        mined, kind = (self.flag[number] & MINED) > 0, number >> HASH
        out[owner[(self.flag[number] & LISTED) > 0]] |= 1
        for bit, kinds in ((1, (0, 0)), (2, (1, 2)), (3, (3, 4)), (4, (5, 8))):
            out[owner[mined & (kind >= kinds[0]) & (kind <= kinds[1])]] |= 1 << bit
        out[np.bincount(owner[mined], minlength=n) >= 4] |= 1 << 5
        return out

    def votes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vote pattern of each text as bits, and its clues as pairs of text and feature."""
        owner, number = self.clues(*features(texts))
        bits = self.bits(owner, number, len(texts))
        for k, text in enumerate(texts.to_pylist()):
            bits[k] |= pattern_bits(text, bool(bits[k] & 1))
        return bits, owner, number


def mine(rows: list[np.ndarray], toxic: np.ndarray, share: float, least: float = 0.7, most: int = 8192) -> np.ndarray:
    """Features whose odds of a toxic text are surely above three (log odds less 1.64 standard errors), and whose share of toxic
    texts, at ``share`` of toxic texts overall, is at least ``least``; the ``most`` surest. One kind of features is counted at a
    time, as this runs in the driver."""
    if not toxic.any() or toxic.all():
        return np.zeros(0, dtype=np.int64)
    found, surest = [], []
    edges = [np.searchsorted(r, np.arange(KINDS + 1) << HASH) for r in rows]  # a text's numbers are distinct and ascend
    for kind in range(KINDS):
        pos, neg = np.zeros(1 << HASH, dtype=np.int32), np.zeros(1 << HASH, dtype=np.int32)
        for r, edge, t in zip(rows, edges, toxic):
            (pos if t else neg)[r[edge[kind] : edge[kind + 1]] - (kind << HASH)] += 1
        p, q = (pos + 0.5) / (toxic.sum() + 1), (neg + 0.5) / ((1 - toxic).sum() + 1)
        sure = np.log(p / q) - 1.64 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        hit = np.flatnonzero((sure > np.log(3)) & (share * p >= least * (share * p + (1 - share) * q)))
        found.append(hit + (kind << HASH))
        surest.append(sure[hit])
    return np.concatenate(found)[np.argsort(-np.concatenate(surest), kind="stable")[:most]]


class LabelModel:
    """Two classes; voters independent within a class, save for cliques, whose joint votes have their own shares.

    ``counts`` are texts per vote pattern; ``known`` (toxic, clean) adds texts per pattern whose class is known.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float, known=None, voters: int = len(VOTERS), steps: int = 100):
        self.prior, self.cliques = prior, [[v] for v in range(voters)]
        self.known = known or (np.zeros(len(patterns)), np.zeros(len(patterns)))
        fires = (patterns[:, None] >> np.arange(voters)) & 1
        start = 0.02 + 0.9 * (fires[:, :5].sum(axis=1) > 0)
        if known:
            # cases of known class tell which voters copy each other; a fit that takes them for independent would not
            posterior, (toxic, clean) = start, known
        else:
            posterior = self._fit(patterns, counts, start, steps)
            toxic, clean = counts * posterior, counts * (1 - posterior)
        self.cliques = self._correlated(fires, toxic, clean)
        self.posterior = self._fit(patterns, counts, posterior, steps)
        self.of = dict(zip(patterns.tolist(), self.posterior.tolist()))

    def _key(self, patterns: np.ndarray, clique: list[int]) -> np.ndarray:
        return sum(((patterns >> v) & 1) << k for k, v in enumerate(clique))

    def _fit(self, patterns, counts, posterior, steps):
        keys = [self._key(patterns, c) for c in self.cliques]
        prior = self.prior
        for _ in range(steps):
            toxic, clean = counts * posterior + self.known[0], counts * (1 - posterior) + self.known[1]
            score = np.full(len(patterns), np.log(prior / (1 - prior)))
            self.shares = []
            for clique, key in zip(self.cliques, keys):
                size = 1 << len(clique)
                p = (np.bincount(key, toxic, size) + 0.5 / size) / (toxic.sum() + 0.5)
                q = (np.bincount(key, clean, size) + 0.5 / size) / (clean.sum() + 0.5)
                self.shares.append((p, q))
                score += np.log(p[key]) - np.log(q[key])
            posterior = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            total = counts.sum() + self.known[0].sum() + self.known[1].sum()
            prior = float(np.clip(((counts * posterior).sum() + self.known[0].sum()) / max(total, 1), 1e-4, 0.5))
        self.prior = prior
        return posterior

    @staticmethod
    def _correlated(fires, toxic, clean, least: float = 0.15, most: int = 4) -> list[list[int]]:
        """Join voters whose votes correlate within the classes, the strongest first, up to ``most`` in a clique."""
        voters = fires.shape[1]
        links = []
        for a in range(voters):
            for b in range(a + 1, voters):
                value = 0.0
                for share in (toxic, clean):
                    total = max(share.sum(), 1e-9)
                    p, q = (share @ fires[:, a]) / total, (share @ fires[:, b]) / total
                    spread = np.sqrt(max(p * (1 - p) * q * (1 - q), 1e-12))
                    both = (share @ (fires[:, a] * fires[:, b])) / total
                    value = max(value, abs(both - p * q) / spread)
                links.append((value, a, b))
        clique = {v: [v] for v in range(voters)}
        for value, a, b in sorted(links, reverse=True):
            if value >= least and clique[a] is not clique[b] and len(clique[a]) + len(clique[b]) <= most:
                joint = clique[a] + clique[b]
                for v in joint:
                    clique[v] = joint
        return [c for v, c in clique.items() if c[0] == v]

    def accuracies(self) -> dict[tuple[str, ...], tuple[float, float]]:
        """Share of toxic and of clean documents on which any voter of each clique fires."""
        return {tuple(VOTERS[v] for v in c): (1 - p[0], 1 - q[0]) for c, (p, q) in zip(self.cliques, self.shares)}


class Classifier:
    """``numbers``: all features that can be clues, in order; ``weights``: theirs."""

    def __init__(self, lexicons: Lexicons, numbers: np.ndarray, weights: np.ndarray, bias: float, labels: LabelModel | None):
        self.lexicons, self.numbers, self.weights, self.bias, self.labels = lexicons, numbers, weights.astype(np.float32), bias, labels

    def score(self, texts: pa.Array) -> np.ndarray:
        _, owner, number = self.lexicons.votes(texts)
        total = np.bincount(owner, weights=self.weights[np.searchsorted(self.numbers, number)], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int):
    """Distinct feature numbers, texts' vote inputs and labels of the sample; shares of the classes over all labelled rows."""
    marks = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(sum(counts.values()), 1)
    draw = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / max(counts.get(1, 0), 1))).otherwise(
        min(1.0, 3 * per_class / max(total - counts.get(1, 0), 1)))
    picked = marks.where(draw < share)
    texts = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = Lexicons(np.zeros(0, dtype=np.int64))
        for rows in slices(batches):
            owner, number = distinct(*features(rows.column("text")))
            ends = np.searchsorted(owner, np.arange(rows.num_rows + 1))
            number = number.astype(np.int32)
            bits = [b & 0b11000000 for b in listed.votes(rows.column("text"))[0].tolist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("toxic"), pa.array([number[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:])], pa.binary()), pa.array(bits, pa.int64())],
                names=["toxic", "numbers", "bits"])

    # the sample is of bounded size, so its ids may be sent to the documents instead of the texts to the ids
    rows = texts.join(F.broadcast(picked), "__id").select("toxic", "text").mapInArrow(collect, "toxic int, numbers binary, bits long").collect()
    rows.sort(key=lambda r: (r["toxic"], r["numbers"]))
    return ([np.frombuffer(r["numbers"], dtype=np.int32) for r in rows], np.array([int(r["toxic"] == 1) for r in rows], dtype=np.int64),
            np.array([r["bits"] for r in rows], dtype=np.int64), counts.get(1, 0) / total)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Classifier:
    ready(docs.sparkSession)
    rows, toxic, extra, share = _sample(docs, labels, per_class)
    share = float(np.clip(share or 0.05, 1e-3, 0.5))
    lexicons = Lexicons(mine(rows, toxic, share))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            pattern, n = np.unique(lexicons.votes(part.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int64()), pa.array(n, pa.int64())], names=["pattern", "n"])

    texts = docs.where(~held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text"))
    votes = texts.mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    votes = sorted((r["pattern"], r["n"]) for r in votes)  # at most one row per vote pattern
    numbers = np.unique(np.concatenate([lexicons.mined, lexicons.listed]))
    weights, bias = np.zeros(len(numbers)), float(np.log(share / (1 - share)))
    model, both = None, bool(toxic.any()) and not toxic.all()
    clues = [r[(lexicons.flag[r] & (MINED | LISTED)) > 0].astype(np.int64) for r in rows]
    if votes and both:
        # the sample stands for all labelled texts: each class weighs what its share says
        weight = np.where(toxic == 1, share / toxic.sum(), (1 - share) / (1 - toxic).sum())
        owner = np.repeat(np.arange(len(clues)), [len(c) for c in clues])
        pattern = lexicons.bits(owner, np.concatenate(clues), len(clues)) | extra
        patterns = np.unique(np.concatenate([pattern, [v[0] for v in votes]]))
        counts = np.zeros(len(patterns))
        counts[np.searchsorted(patterns, [v[0] for v in votes])] = [v[1] for v in votes]
        at = np.searchsorted(patterns, pattern)
        known = tuple(np.bincount(at, weight * len(rows) * (toxic == y), len(patterns)) for y in (1, 0))
        model = LabelModel(patterns, counts, share, known)
        target = model.posterior[at]
        used = np.unique(np.concatenate(clues))
        x = Rows([np.searchsorted(used, c) for c in clues], [np.ones(len(c)) for c in clues])
        w, bias = fit(x, target, weight, max(len(used), 1), "logistic", penalty=1e-4, steps=300, rate=1.0)
        weights[np.searchsorted(numbers, used)] = w[: len(used)]
    # a listed insult the sample never held speaks as the average clue does
    listed = np.searchsorted(numbers, lexicons.listed)
    seen = weights[listed][weights[listed] > 0]
    weights[listed[weights[listed] == 0]] = float(seen.mean()) if len(seen) else 3.0 - bias
    return Classifier(lexicons, numbers, weights, bias, model)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 1500) -> DataFrame:
    """All documents with their columns and ``toxic_score``, ``toxic_predicted``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, per_class))
    schema = StructType([*docs.schema.fields, StructField("toxic_score", DoubleType()), StructField("toxic_predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            got = model.value.score(rows.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32), pa.int32())],
                names=[*rows.schema.names, "toxic_score", "toxic_predicted"])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    rows = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, threshold)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    plain = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = score(plain.select("doc_id", F.col("text").cast("string").alias("text"), "__row"), labels, threshold)
    return rows.where("toxic_predicted = 0").select("__row.*")
