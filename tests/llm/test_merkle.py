"""The Merkle manifest against trees built in plain Python, and its edge cases."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from scanmill.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, tree int, level int, idx long, kids string, place int, n int, digest string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def climbed(levels, idx, folded, proof):
    for level in levels[:-1]:
        run = level[idx // 16 * 16 : idx // 16 * 16 + 16]
        place = idx % 16
        proof += run[:place] + run[place + 1 :]
        folded = h(*run[:place], folded, *run[place + 1 :])
        idx //= 16
    return folded, proof


def manifest_of(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_of([d[2] for d in sorted(trees[s], key=lambda d: d[:3])]) for s in names}
    top = levels_of([built[s][-1][0] for s in names]) if names else []
    out = []
    for rank, s in enumerate(names):
        for idx, (_, _, digest, r) in enumerate(sorted(trees[s], key=lambda d: d[:3])):
            low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded, proof = climbed(built[s], idx, leaf(*r[:4], low) if hit else digest, [])
            folded, proof = climbed(top, rank, folded, proof)
            out.append((r[0], digest, built[s][-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0]))
    return out


def report(spark, rows):
    table = spark.createDataFrame([(*r, 1, 2, 3, "x", 4, 5, "y") for r in rows], SCHEMA).repartition(3)
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in merkle.manifest(table).collect())


def expected(rows):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in manifest_of(rows))


def some(rng, i, source):
    return (i, source, rng.choice(["en", None, ""]), rng.choice([None, 5, -1]), rng.choice([None, "", "Upper Ä", "low", f"T{i}"]))


@pytest.mark.parametrize("sources", [1, 3, 40, 300])
def test_same_as_trees_in_memory(spark, sources):
    rng = random.Random(sources)
    names = [None, "", "é", "z", "Z", "-", "\U0001f600", "￿", *[f"s{k}" for k in range(sources)]][:sources]
    rows = [some(rng, i, s) for i, s in enumerate(names)]
    rows += [some(rng, 1000 + i, names[0]) for i in range(16 * 16 + 1 - 1)]  # 257 leaves: three levels, a last run of one
    rows += [some(rng, 3000 + i, rng.choice(names)) for i in range(150)]
    rows += [(None, names[0], None, None, "Null Id"), (7, names[-1], "en", 1, "Again"), (7, names[-1], "en", 1, "Again")]
    got = report(spark, rows)
    assert got == expected(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_a_run_exactly_full(spark):
    rows = [(i, "s", "en", 1, "Text") for i in range(256)] + [(300 + i, "t", "en", 1, "Text") for i in range(16)]
    assert report(spark, rows) == expected(rows)


def test_lone_rows_and_empty_tables(spark):
    one = [(5, None, None, None, None)]
    got = report(spark, one)
    assert got == expected(one) and got[0][1] == got[0][2] == got[0][3] == got[0][5] and got[0][4] == h()
    assert report(spark, []) == []
    long = [(1, "s", "en", 3, "A long text " * 200_000), (2, "t", "en", 3, "x")]
    assert report(spark, long) == expected(long)


def test_nothing_is_left_in_the_session(spark):
    report(spark, [(1, "s", "en", 1, "x"), (2, "s", "en", 1, "x")])
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"
