"""Units of text: long blanks, long lines, clashing columns, what remains in the reports."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest

from scanmill.llm import suffix_dedup, unit_dedup


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_units_are_those_of_the_patterns(unit):
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices(["a", "b c", "\n", "\n\n", " ", "\t", "\r", "\x0b", " ", "\x85"], k=rng.randint(0, 14)))
        assert list(unit_dedup._SPLIT[unit](text)) == [m.span() for m in unit_dedup._UNIT[unit].finditer(text)], repr(text)


def test_a_megabyte_of_blanks_takes_no_time():
    start = time.process_time()
    assert list(unit_dedup._paragraphs(" " * 1_000_000)) == []
    text = "a\n" + " \n" * 300_000 + "b " * 300_000
    assert [text[s:e].strip() for s, e in unit_dedup._paragraphs(text)] == ["a", ("b " * 300_000).strip()]
    assert time.process_time() - start < 2


def test_columns_may_have_any_name(spark):
    line = "one line of more than five words"
    docs = spark.createDataFrame(
        [(1, f"{line}\nx", 1, 2, "k", "d"), (2, f"{line}\ny", 3, 4, "l", "e")],
        "doc_id long, text string, spans int, removed_spans int, kept_text string, digest string")
    marked = {r["doc_id"]: r for r in unit_dedup.mark_units(docs).collect()}
    assert marked[2]["kept_text"] == "y" and marked[2]["spans"] == 3 and [tuple(s) for s in marked[2]["removed_spans"]] == [(0, 33)]
    left = unit_dedup.drop_units(docs)
    assert left.columns == docs.columns
    assert sorted(tuple(r) for r in left.collect()) == [(1, f"{line}\nx", 1, 2, "k", "d"), (2, "y", 3, 4, "l", "e")]


def test_a_very_long_line(spark):
    line = "word " * 400_000
    docs = spark.createDataFrame([(1, line), (2, f"{line}\nown")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in unit_dedup.unit_report(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["kept_text"] == "own" and got[2]["n_removed"] == len(line) + 1


def test_reports_hold_what_remains(spark):
    shared = "passage that both documents hold " * 20
    docs = spark.createDataFrame([(1, "aé " + shared), (2, "b" + shared + "é"), (3, None)], "doc_id long, text string")
    for r in suffix_dedup.report(docs).collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
        assert len(r["kept"].encode()) == r["n_bytes"] - r["n_removed"]
    for r in unit_dedup.unit_report(docs).collect():
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_sentences_make_up_their_line_in_linear_time():
    rng = random.Random(4)
    for _ in range(2000):
        line = "".join(rng.choices(["a", "b c", ".", "!", "?", '"', ")", " ", "\t"], k=rng.randint(1, 14))) + rng.choice(["", "\n"])
        text = "x. y.\n" + line
        assert "".join(text[a:b] for a, b in unit_dedup._sentences(text, 6, len(text))) == line
    start = time.process_time()
    for text in ("." * 500_000, " " * 500_000, ". " * 250_000, '."' * 250_000):
        assert sum(b - a for a, b in unit_dedup._sentences(text, 0, len(text))) == len(text)
    assert time.process_time() - start < 2


def test_passages_from_mid_line_to_mid_line_go(spark):
    rng = random.Random(9)

    def sentence(n):
        return " ".join(f"w{rng.randrange(5000)}" for _ in range(n)) + "."

    texts = []
    for k in range(30):
        sentences = [sentence(rng.randint(9, 14)) for _ in range(5)]
        for _ in range(2):
            own = [sentence(rng.randint(3, 12)) for _ in range(4)]
            # over 50 words, cut inside the first and the last sentence, in the middle of a line
            passage = " ".join([" ".join(sentences[0].split()[2:]), *sentences[1:4], " ".join(sentences[4].split()[:6])])
            texts.append(f"{own[0]}\n{own[1]} {passage} {own[2]}\n{own[3]}")
    texts += [f"{sentence(9)} {sentence(9)}" for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in unit_dedup.unit_report(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        planted = i < 60
        assert (got[i]["n_repeated"] > 0) == planted and (got[i]["n_removed"] > 0) == (planted and i % 2 == 1)
        # nothing is lost altogether: what is cut out here stands in the earlier document
        for span in got[i]["removed_spans"]:
            assert t[span["start"] : span["stop"]].strip() in got[i - 1]["kept_text"]


def test_sentences_match_plain_python(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choices(["ab", "cd", "ef", "É"], k=rng.randint(1, 11))) + rng.choice([".", "!", "?\"", ","]) for _ in range(60)]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\n\n"]) for _ in range(rng.randint(0, 25))) for _ in range(80)]
    rows = [*enumerate(texts), (0, texts[0]), (90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    places = {}
    for i, t in enumerate(texts):
        for m in re.finditer(r"[^\n]+\n?", t):
            line, a = re.findall(r"\w+", m.group().lower()), m.start()
            if len(line) >= 5:
                places.setdefault(" ".join(line), []).append((i, a, m.end()))
            for part in re.split(r"(?<=[.!?])(?=\s)|(?<=[.!?]\")(?=\s)", m.group()):
                # white space stands before a part here, behind it in the module
                lead = len(part) - len(part.lstrip()) if a > m.start() else 0
                a, b = a + lead, a + len(part)
                b += len(re.match(r"\s*", t[b : m.end()]).group())
                found = re.findall(r"\w+", part.lower())
                if 8 <= len(found) < len(line):
                    places.setdefault(" ".join(found), []).append((i, a, b))
                a = a + len(part) - lead
    gone, again = {i: set() for i in range(80)}, {i: set() for i in range(80)}
    for found in places.values():
        first = min(found)
        for i, a, b in found if len(found) > 1 else []:
            again[i] |= set(range(a, b))
            if (i, a, b) != first:
                gone[i] |= set(range(a, b))
    got = unit_dedup.unit_report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        if i >= 80:
            assert (r["n_removed"], r["n_repeated"], r["n_spans"], r["n_chars"], r["kept_text"]) == (0, 0, 0, 0, "")
            continue
        assert r["kept_text"] == "".join(c for k, c in enumerate(texts[i]) if k not in gone[i])
        assert (r["n_removed"], r["n_repeated"], r["n_chars"]) == (len(gone[i]), len(again[i]), len(texts[i]))
        assert r["n_spans"] == sum(k - 1 not in gone[i] for k in gone[i])


def test_passages_below_the_removed_length_are_counted(spark):
    rng = random.Random(7)
    word = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = " ".join(f"p{k}" for k in range(60))
    assert len(passage) < 400
    own = " ".join(word(80))
    rows = [
        (1, " ".join(word(70)) + f"\n{passage.replace(' ', '  ')}\t" + " ".join(word(5))), (2, passage), (3, own), (4, "the " * 200),
        (5, " ".join(f"p{k}" for k in range(50))), (6, None), (7, ""), (None, own.replace("w", "v")), (None, own.replace("w", "v")),
        (8, passage.upper()), (9, own[: len(own) // 2])]
    got = suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {r["doc_id"]: (r["n_repeated"], r["n_removed"] > 0) for r in got}
    assert len(got) == len(rows)
    # by contract nothing under 400 bytes goes; a document that repeats only itself shares nothing
    assert found[1] == found[2] == (10, False) and found[4] == (0, True)
    assert found[None] == (30, True) and all(found[k] == (0, False) for k in (3, 5, 6, 7, 8, 9))


def test_passages_match_plain_python(spark):
    rng = random.Random(8)
    parts = [[rng.choice("abc") for _ in range(rng.randint(4, 15))] for _ in range(12)]
    texts = [[w for _ in range(rng.randint(0, 4)) for w in rng.choice([*parts, [str(rng.random())] * 3])] for _ in range(150)]
    texts += [texts[5]] * 20 + [parts[0] + [str(k)] for k in range(40)]
    rows = [(k // 2, " ".join(t)) for k, t in enumerate(texts)] + [(0, " ".join(texts[0]))] * 2
    texts += [texts[0]] * 2
    strings = [[tuple(t[k : k + 7]) for k in range(len(t) - 6)] for t in texts]
    held = Counter(s for some in strings for s in set(some))
    want = sorted((row[0], row[1], sum(held[s] > 1 for s in some)) for row, some in zip(rows, strings))
    docs = suffix_dedup._keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    for chunk in (2, 7):
        counts = suffix_dedup.passages(docs, words=7, chunk=chunk).distinct()
        got = docs.join(counts, ["id", "sha"], "left").select("id", "text", "n").collect()
        assert sorted((r["id"], r["text"], r["n"] or 0) for r in got) == want
