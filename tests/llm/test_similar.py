"""N-gram classes, suffix dedup, unit dedup and decontamination against brute force over small tables."""

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanmill.llm import decontaminate, ngram_join, suffix_dedup, unit_dedup

SCHEMA = "doc_id long, text string, lang string, node int, id string, tokens int"


def words(rng, n, vocabulary):
    return [rng.choice(vocabulary) for _ in range(n)]


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(600)]
    texts = [None, "", " \t ", "one", "One", "one two three", "ONE two\x0bthree", "one two three four", "a b c d e", "É b c d e", "é b c d e"]
    for _ in range(12):  # near copies at all distances, with a chain of edits
        base = words(rng, rng.randint(20, 300), vocabulary)
        for _ in range(rng.randint(2, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy
    passage = " ".join(words(rng, 60, vocabulary))
    big = words(rng, 80, vocabulary)
    for k in range(160):  # a passage many share, and a large group of near copies
        texts.append(" ".join(words(rng, rng.randint(5, 120), vocabulary)) + " " + passage)
        texts.append(" ".join(big[:-1] + [f"end{k}"]))
    texts += [" ".join(words(rng, rng.randint(0, 40), vocabulary)) for _ in range(120)] + ["a " * 5000, "a " * 4000]
    rows = [(i, t, "en", 1, "x", 2) for i, t in enumerate(texts)]
    rows += [(None, texts[20], None, 1, "x", 2), (7000, texts[20], None, 1, "x", 2), (7000, texts[20], None, 1, "x", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def shingle_set(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


@pytest.mark.parametrize("leaf", [128, 2])
def test_classes_are_those_of_all_pairs(near, leaf):
    rows = [(r["doc_id"], shingle_set(r["text"])) for r in near.collect() if r["doc_id"] is not None]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(rows):
        for j, t in rows[:a]:
            if s and t and 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)):
                shared = len(s & t)
                if 100 * shared >= 80 * (len(s) + len(t) - shared):
                    a1, b1 = find(i), find(j)
                    root[max(a1, b1)] = min(a1, b1)
    got = ngram_join.jaccard_classes(near, leaf_size=leaf, queries_per_task=3 if leaf == 2 else 512).collect()
    assert len(got) == near.count()
    sizes = {i: len(s) for i, s in rows}
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (sizes[r["doc_id"]], find(r["doc_id"])), r


def test_one_of_each_class_stays(near):
    left = [r["doc_id"] for r in ngram_join.drop_similar(near).select("doc_id").collect()]
    assert None in left and 11 in left and 7000 not in left
    assert ngram_join.drop_similar(near).columns == near.columns


def test_hot_list_does_not_change_classes(near):
    full = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_classes(near).collect()}
    none = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_classes(near, hot_tokens=1).collect()}
    assert full == none


def brute_spans(texts, length):
    data = [(t or "").encode() for t in texts]
    where = defaultdict(list)
    for d, x in enumerate(data):
        for p in range(len(x) - length + 1):
            where[x[p : p + length]].append((d, p))
    cover = [np.zeros(len(x), dtype=bool) for x in data]
    for places in where.values():
        if len(places) > 1:
            for d, p in places:
                cover[d][p : p + length] = True
    return data, cover


def suffix_rows(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choices("abcde é", k=n))
    texts = [None, "", "short", make(39), "z" * 300, "ab" * 200, "abcabcabc" * 20]
    passages = [make(rng.randint(30, 200)) for _ in range(8)]
    for _ in range(60):
        text = make(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(passages)
            a = rng.randint(0, 20)
            text += part[a : len(part) - rng.randint(0, 20)] + make(rng.randint(0, 60))
        texts.append(text)
    texts += [texts[10]] * 30 + [passages[0] + make(70) for _ in range(200)] + [make(60) + passages[1] + make(60) for _ in range(100)]
    return texts


@pytest.mark.parametrize("bucket", [4000, 3])
def test_suffix_spans(spark, bucket):
    texts = suffix_rows(bucket)
    docs = spark.createDataFrame([(i, t, "en", 1, "x", 2) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    docs = docs.union(docs.where("doc_id = 40")).withColumnRenamed("node", "first")
    # with small sizes nearly every anchor is hot and cut into many buckets
    sizes = {"bucket_runs": 3, "hot_runs": 2, "block": 5} if bucket == 3 else {}
    got = sorted(suffix_dedup.dedup(docs, length=40, chunk=13, **sizes).collect(), key=lambda r: r["doc_id"])
    ids = sorted([*range(len(texts)), 40])
    data, cover = brute_spans([texts[i] for i in ids], 40)
    assert len(got) == len(ids)
    for r, i, x, c in zip(got, ids, data, cover):
        kept = bytes(np.frombuffer(x, np.uint8)[~c])
        edges = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        assert (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) == (i, len(x), int(c.sum()), edges)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest() and bytes(r["kept"]) == kept


def test_sliding_argmin_is_leftmost():
    rng = np.random.default_rng(0)
    for width in (1, 3, 8):
        values = rng.integers(0, 6, 50).astype(np.uint64) << np.uint64(50)
        got = suffix_dedup.sliding_argmin(values, width)
        assert got.tolist() == [k + int(np.argmin(values[k : k + width])) for k in range(51 - width)]


def test_multikey_order():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 3, 200).astype(np.uint64) for _ in range(5)]
    order, tied = suffix_dedup.multikey_order(words)
    rows = list(zip(*[w[order].tolist() for w in words]))
    assert rows == sorted(zip(*[w.tolist() for w in words]))
    assert tied.tolist() == [k > 0 and rows[k] == rows[k - 1] for k in range(200)]


def unit_rows():
    line = "The quick brown fox jumps over the lazy dog again and again"
    return [
        (5, f"{line}\nown text five\n{line.upper()}!\ntail", 0), (3, f"Intro\n{line}\n", 1), (9, line, 0), (7, None, 0), (8, "", 0),
        (1, "one\ntwo\none\ntwo", 0), (None, line, 0), (9, line, 0), (10, "ü" * 50 + f"\n  {line.replace(' ', '   ')}  \nend", 0)]


def test_units_keep_the_first_occurrence(spark):
    docs = spark.createDataFrame(unit_rows(), "doc_id long, text string, start int").repartition(3)
    rows = sorted(unit_dedup.mark_units(docs, min_words=5).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(rows) == len(unit_rows())
    got = {r["doc_id"]: r for r in rows}
    assert got[3]["kept_text"] == unit_rows()[1][1] and got[3]["removed_spans"] == []
    assert got[5]["kept_text"] == "own text five\ntail"
    assert [tuple(s) for s in got[5]["removed_spans"]] == [(0, 60), (74, 135)]
    assert got[9]["kept_text"] == "" and got[7]["kept_text"] == "" and got[None]["kept_text"] == ""
    assert got[1]["kept_text"] == "one\ntwo\none\ntwo"
    assert got[10]["kept_text"] == "ü" * 50 + "\nend"
    left = unit_dedup.drop_units(docs, min_words=5)
    assert left.columns == docs.columns and left.where("doc_id = 7 and text is null").count() == 1


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_units_match_plain_python(spark, unit):
    rng = random.Random(5)
    pool = [" ".join(rng.choices(["ab", "cd", "ef", "gh!", "É"], k=rng.randint(1, 9))) for _ in range(40)]
    texts = ["".join(rng.choice(pool) + rng.choice(["\n", "\n\n", "\n \n"]) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        kept, at = "", 0
        for m in unit_dedup._UNIT[unit].finditer(t):
            found = re.findall(r"\w+", m.group().lower())
            key = " ".join(found)
            if len(found) >= 3 and key in seen:
                kept += t[at : m.start()]
                at = m.end()
            if len(found) >= 3:
                seen.add(key)
        want[i] = kept + t[at:]
    assert {r["doc_id"]: r["kept_text"] for r in unit_dedup.mark_units(docs, unit, 3).collect()} == want


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 8))) for _ in range(1500)]
    items = [(i, ". ".join(" ".join(words(rng, rng.randint(8, 16), vocabulary)) for _ in range(3)) + ".") for i in range(30)]
    rows, planted = [], set()
    for d in range(150):
        body = words(rng, rng.randint(0, 400), vocabulary)
        if d % 5 == 0:
            item = rng.randrange(30)
            copied = items[item][1].upper().split() if d % 10 else items[item][1].split()
            if d % 15 == 0:  # a paraphrase: one word in six replaced
                copied = [rng.choice(vocabulary) if k % 6 == 5 else w for k, w in enumerate(copied)]
            at = rng.randint(0, len(body))
            body = body[:at] + copied + body[at:]
            planted.add((d, item))
        rows.append((d, " ".join(body)))
    rows += [(900, None), (901, ""), (902, items[4][1]), (902, items[4][1]), (903, "x " * 50_000 + items[5][1])]
    planted |= {(902, 4), (903, 5)}
    items += [(30, None), (31, ""), (4, items[4][1])]
    return (spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as item_id").repartition(4),
            spark.createDataFrame(items, "item_id long, text string"), planted)


@pytest.mark.parametrize("block", [2000, 7])
def test_leaks_are_found_and_no_others(bench, block):
    docs, items, planted = bench
    got = decontaminate.leaks(docs, items, block_items=block).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted
    left = {r["doc_id"] for r in decontaminate.drop_leaks(docs, items).collect()}
    assert left == {r["doc_id"] for r in docs.select("doc_id").collect()} - {d for d, _ in planted}


def test_latent_cosine_is_the_full_one_at_full_rank(bench):
    docs, items, _ = bench
    idf = decontaminate.inverse_frequency(docs)
    terms, basis = decontaminate.randomised_basis(items.where("text is not null and text <> ''"), idf, 64)
    texts = [r["text"] for r in items.collect()]
    row, term, weight = decontaminate._tfidf(pa.array(texts, pa.string()), idf)
    for k in range(len(texts)):
        here = row == k
        place = (basis[np.searchsorted(terms, term[here])] * weight[here][:, None]).sum(axis=0)
        assert np.isclose(np.linalg.norm(place), np.linalg.norm(weight[here]))


def test_short_and_wrapped_lines_go_at_the_production_value(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    short, passage = words(rng, 9, vocabulary), words(rng, 60, vocabulary)
    wrapped = "\n".join(" ".join(passage[k : k + 12]) for k in range(0, 60, 12))
    texts = []
    for d in range(30):
        own = [" ".join(words(rng, rng.randint(1, 40), vocabulary)) for _ in range(rng.randint(0, 6))] + [" ".join(short), "see also"]
        texts.append("\n".join(own + [wrapped] * (d % 3 == 0) + [" ".join(words(rng, 7, vocabulary))]))
    seen, want = set(), {}
    for d, text in enumerate(texts):
        kept = []
        for line in text.splitlines(keepends=True):
            key = " ".join(line.split())
            if len(key.split()) < 5 or key not in seen:
                kept.append(line)
            seen.add(key)
        want[d] = hashlib.sha256("".join(kept).encode()).hexdigest()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["kept_sha256"] for r in unit_dedup.unit_report(docs).collect()} == want


def test_copies_of_thousands_of_items_are_found(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8))) for _ in range(4000)]
    items = [words(rng, rng.choice([6, 24, 90]), vocabulary) for _ in range(2500)] + [words(rng, 9000, vocabulary)]
    rows = [[*words(rng, 40, vocabulary), *items[k], *words(rng, 40, vocabulary)] for k in range(0, 2500, 5)] + [items[-1]]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(rows)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    inside = {(d, k) for d, w in enumerate(rows) for k, i in enumerate(items) if " ".join(i) in " ".join(w)}
    assert len(inside) >= 501 and inside <= got


def test_a_large_group_of_copies_of_an_item_is_found(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8))) for _ in range(2000)]
    item = " ".join(words(rng, 30, vocabulary))
    rows = [(d, item if d < 1100 else " ".join(words(rng, 60, vocabulary))) for d in range(3300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == set(range(1100))


def test_empty_tables(spark, near, bench):
    none, items = near.limit(0), bench[1]
    assert ngram_join.jaccard_classes(none).count() == 0
    assert suffix_dedup.dedup(none).count() == 0
    assert unit_dedup.mark_units(none).count() == 0
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(bench[0], items.limit(0)).count() == 0


def test_frequent_tokens_reach_the_driver_as_arrays(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[k // 26**j % 26] for j in range(4)) for k in range(150_000)]
    docs = spark.createDataFrame([(k, " ".join(words[100 * k : 100 * k + 100])) for k in range(1500)] * 3, "doc_id long, text string")
    # three documents hold each token, and no two sets are equal
    marked = docs.select(F.monotonically_increasing_id().alias("doc_id"), F.concat("text", F.lit(" x"), F.monotonically_increasing_id()).alias("text"))
    tracemalloc.start()
    hot, rank = ngram_join.frequent_tokens(marked, 5, 5000, 100_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hot) == 100_000 and sorted(rank.tolist()) == list(range(1, 100_001)) and (np.diff(hot.astype(object)) > 0).all()
    assert peak < 12 << 20
    assert len(ngram_join.frequent_tokens(docs.limit(0), 5, 5, 10)[0]) == 0


def test_frequent_tokens_come_from_a_tenth_of_the_documents(spark):
    rows = [(k, f"own {k} text {k * 7} words {k * 13}" + (" a line that is shared" if k % 10 == 0 else "")) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot, rank = ngram_join.frequent_tokens(docs, 5, 5, 1000)
    shared = ngram_join.token_sets(pa.array(["a line that is shared"]), 5)[0]
    assert np.isin(shared, hot).all() and len(hot) == len(rank)


def test_maybe_among_keeps_all_wanted_and_few_others(spark):
    rows = spark.range(-500, 50_000).selectExpr("id AS doc_id", "'x' AS text").unionByName(
        spark.createDataFrame([(None, "x"), (3, "twice")], "doc_id long, text string"))
    nodes = spark.range(-500, 50_000, 7).selectExpr("id AS node")
    got = [r["doc_id"] for r in ngram_join.maybe_among(rows, nodes).collect()]
    wanted = list(range(-500, 50_000, 7))
    assert set(wanted) <= set(got) and None not in got and len(got) < len(wanted) * 1.1
    assert ngram_join.maybe_among(rows, nodes.where("node < -1000")).count() == 0


def test_benchmark_words_are_numbered_once_and_places_summed_in_pieces():
    texts = ["what is the capital of france paris is it", "name two rivers of spain the ebro and the tagus", None]
    idf = np.linspace(0.5, 2.0, 1 << decontaminate.BITS)
    terms = np.unique(decontaminate.word_terms(pa.array(texts, pa.string()))[1])
    basis = np.linalg.qr(np.random.default_rng(4).normal(size=(len(terms), 3)))[0]
    it = decontaminate.Items([{"item_id": k, "text": t} for k, t in enumerate(texts)], idf, terms, basis)
    rng = random.Random(6)
    text = " ".join(rng.choices(["the", "of", "capital", "ebro", "other", "words", "paris"], k=32 * (3 * decontaminate.GATHERED + 5)))
    hashed, term, doc = decontaminate.word_terms(pa.array([text, "none of it", "x y"]))
    number = it.number(hashed)
    assert all((it.vocabulary[n] == h) if n < len(it.vocabulary) else (h not in it.vocabulary) for n, h in zip(number[:500], hashed))
    for want, of in zip(it.words, it.numbers):
        assert np.array_equal(it.vocabulary[of], want)
    block, first, blocks = decontaminate.blocks_of(doc, 3)
    want = np.zeros((int(blocks.sum()), 3), dtype=np.float32)
    for b, t in zip(block, term):
        if t in terms:
            want[b] += it.latent[np.searchsorted(terms, t)]
    assert np.allclose(it.places(term, block, len(want)), want, atol=1e-4)
    bare = decontaminate.Items([{"item_id": 1, "text": None}], idf, terms[:0], basis[:0])
    assert bare.number(hashed).tolist() == [0] * len(hashed)
