"""Mixing against a queue worked off in plain Python, and its edge cases."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from scanmill.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, rank int, target long, slot int, `pass` int, served int"


def size_of(text):
    return len(re.findall("[^\x20\x09-\x0D]+", text or ""))


def targets_of(sizes, weights, limit):
    """Shares by weight; what is above a source's limit is shared among the others, until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(limit * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        above = {s for s in names if s not in full and limit * sizes[s] * share < weight[s] * left}
        if not above:
            return {s: float(limit * sizes[s]) if s in full else weight[s] * left / max(share, 1) for s in names}
        full |= above


def mixed(rows, weights, limit):
    """One word after the other: every source serves its documents in turn, and the budget is spent at virtual time 1."""
    by_source = defaultdict(list)
    for doc_id, text, source in rows:
        key = int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)
        by_source[source].append((key, -1 if doc_id is None else doc_id, size_of(text)))
    sizes = {s: sum(d[2] for d in found) for s, found in by_source.items()}
    target = targets_of(sizes, weights, limit)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    out = []
    for s in names:
        turn = [(doc_id, size) for _, doc_id, size in sorted(by_source[s])]
        taken = [[0 for _ in turn], [0 for _ in turn]]
        for k, left in enumerate((math.floor(target[s] + 1e-9), math.ceil(target[s] - 1e-9))):
            for place, size in [(p, d[1]) for _ in range(limit) for p, d in enumerate(turn)]:
                taken[k][place] += min(size, left)
                left -= min(size, left)
        out.append((s, [(doc_id, size, sizes[s], target[s]) for doc_id, size in turn], taken))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(3)


def report(spark, rows, **how):
    got = mixing.mix_report(table(spark, rows), **how).collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:5]) for r in got)


def some_rows(seed, n=400):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40]))) + rng.choice(["", " \n\t "]),
             rng.choice(["hot", "hot", "hot", "é", "b", "tiny" if i < 12 else "b", None])) for i in range(n)]
    rows += [(None, "a b", "b"), (None, None, None), (5000, "\x0b", "empty"), (5001, None, "empty"), (7, "again and", "hot"),
             (7, "again and", "hot"), (6000, "long " * 30000, "z"), (6001, "no-break space is one\x1cword", "z")]
    return rows


@pytest.mark.parametrize("weights,limit,slot,width", [((1, 2, 3), 3, 8192, 1 << 16), ((1, 2, 3), 3, 4, 64), ((5, 1), 2, 16, 999)])
def test_same_as_a_queue_worked_off(spark, monkeypatch, weights, limit, slot, width):
    monkeypatch.setattr(mixing, "SLOT_ROWS", slot)
    monkeypatch.setattr(mixing, "RANGE_WORDS", width)
    rows = some_rows(weights[0])
    got = report(spark, rows, weights=weights, limit=limit)
    want = mixed(rows, weights, limit)
    assert [g[:4] for g in got] == sorted(f for _, facts, _ in want for f in facts)
    by_target = defaultdict(list)
    for g in got:
        by_target[g[2], g[3]].append(g)
    for _, facts, taken in want:
        own = sorted(by_target[facts[0][2:]])
        if facts[0][2] == 0:  # sources without words, of which there may be several
            assert all(g[4] == 0 for g in own)
            continue
        # a target of broken words is met from above or from below
        assert own in [sorted((*f, t) for f, t in zip(facts, taken[k])) for k in (0, 1)]
    assert sum(r[4] for r in got) == sum(r[1] for r in got)  # the budget is met to the word
    assert all(r[4] <= limit * r[1] for r in got)


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 60), f"s{min(i % 9, 5)}") for i in range(3000)]
    got = report(spark, rows)
    per_source = defaultdict(int)
    for r in got:
        per_source[r[3], r[2]] += r[4]
    assert all(abs(words - target) < 1 for (target, _), words in per_source.items())
    assert got == report(spark, rows[::-1])


def test_the_mix_is_in_order_without_gaps(spark):
    rows = some_rows(4)
    got = mixing.mix(table(spark, rows)).collect()
    firsts = {}
    for r in got:
        firsts.setdefault(r["doc_id"], r["start"])
    listed = mixing.mix_report(table(spark, rows)).groupBy("doc_id").min("first_start").collect()
    assert {r[0]: r[1] for r in listed if r[1] is not None} == firsts
    end = 0
    for r in got:
        assert r["start"] == end
        end += r["words"]
    assert end == sum(size_of(t) for _, t, _ in rows)


def test_empty_tables_and_tables_without_words(spark):
    assert report(spark, []) == []
    assert report(spark, [(1, None, "a"), (2, " ", None)]) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mix(table(spark, [])).count() == 0
