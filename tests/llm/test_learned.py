"""Language, toxicity and page text on small tables: held-out accuracy, rules for odd rows, hand-checked pages."""

import pickle
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanmill.llm import html_text, langid, memory, toxicity
from scanmill.llm.common import held_out

SOUNDS = {"en": ["th", "ing", "er", "wh"], "de": ["sch", "ung", "ch", "ä"], "fr": ["eau", "oi", "é", "que"], "es": ["ción", "ll", "ar", "ñ"]}
TOXIC = {"en": ["idiot", "moron", "scum"], "de": ["klofeung", "klofech"], "fr": ["zoubeau", "zoubé"], "es": ["pingar", "pingó"]}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        lang = rng.choice(list(SOUNDS))
        body = text_of(rng, lang, rng.randint(3, 120)).split()
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * rng.randint(1, 4)):
            body.insert(rng.randint(0, len(body)), rng.choice(TOXIC[lang]) + rng.choice(["", ".", "!"]))
        rows.append((i, " ".join(body).title() if i % 9 == 0 else " ".join(body), lang if i % 11 else None, f"s{i % 3}", 1.0))
        if i % 4:
            labels.append((i, 1, toxic))
    rows += [(9000, None, "en", "x", 1.0), (9001, "", None, "x", 1.0), (9002, "123 !? 456", "de", "x", 1.0), (None, "the thing", "en", "x", 1.0),
             (9003, "thing " * 40_000, None, "x", 1.0), (9004, "twice thing", None, "x", 1.0), (9004, "twice thing", None, "x", 1.0)]
    labels += [(9000, 0, 1), (None, 1, 1), (3, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(4)
    return frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in rows}


def test_fold(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_language_of_documents_never_seen(docs):
    frame, _, known = docs
    got = langid.identify(frame).collect()
    assert len(got) == frame.count()
    unseen = [r for r in got if r["held_out"] and r["doc_id"] in known and known[r["doc_id"]][2] and (r["doc_id"] or 0) < 9000]
    assert len(unseen) > 200
    assert np.mean([r["lang_pred"] == known[r["doc_id"]][2] for r in unseen]) > 0.98
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert odd[9000] == odd[9001] == odd[9002] == ("und", 0.0)
    assert odd[9003][0] == "en" and all(0 <= r["score"] <= 1 for r in got)


def test_language_does_not_depend_on_neighbours(docs):
    frame, _, known = docs
    model = langid.learn(frame)
    texts = [known[i][1] for i in range(40)]
    together, alone = model.predict(pa.array(texts)), [model.predict(pa.array([t])) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert np.allclose(together[1], [a[1][0] for a in alone])


def test_without_labels_nothing_is_known(spark):
    frame = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(frame).collect()} == {"und"}
    assert langid.identify(frame.limit(0)).count() == 0


def test_families_come_first():
    assert langid.family("de") == langid.family("en-GB") == "germanic" and langid.family("fr") == "romance"
    assert langid.family("xx") == "xx"


def test_toxic_documents_never_seen(docs):
    frame, labels, known = docs
    got = toxicity.report(frame, labels).collect()
    assert len(got) == frame.count()
    truth = {i: any(w in (r[1] or "").lower() for ws in TOXIC.values() for w in ws) for i, r in known.items() if i is not None}
    unseen = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    hits = [truth[r["doc_id"]] for r in unseen if r["predicted"]]
    assert np.mean(hits) > 0.95
    assert np.mean([r["predicted"] for r in unseen if truth[r["doc_id"]]]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    odd = {r["doc_id"]: r["score"] for r in got}
    assert odd[9000] == odd[9001] < 0.3


def test_clean_documents_stay(docs):
    frame, labels, known = docs
    left = toxicity.drop_toxic(frame, labels)
    assert left.columns == frame.columns
    ids = {r["doc_id"] for r in left.select("doc_id").collect()}
    assert {9000, 9001, 9002, 9003, 9004, None} <= ids


def test_toxicity_without_labels(spark, docs):
    frame, labels, _ = docs
    some = frame.limit(0).union(spark.createDataFrame([(1, "you idiot", "", "", 1.0), (2, "a fine day", "", "", 1.0)], frame.schema))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.report(some, labels.limit(0)).collect()}
    assert got == {1: 1, 2: 0}
    assert toxicity.report(frame.limit(0), labels).count() == 0


def test_mining_keeps_the_driver_small():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, toxicity.SIZE, 400)).astype(np.int32) for _ in range(300)]
    toxic = (np.arange(300) % 3 == 0).astype(np.int64)
    clues = np.array([3, (2 << toxicity.HASH) - 1, 2 << toxicity.HASH, toxicity.SIZE - 1], dtype=np.int32)
    rows = [np.union1d(r, clues[: 1 + k % 5]) if t else r for k, (r, t) in enumerate(zip(rows, toxic))]
    # the formulas over all features at once
    pos, neg = (np.bincount(np.concatenate([r for r, t in zip(rows, toxic) if t == y]), minlength=toxicity.SIZE) for y in (1, 0))
    p, q = (pos + 0.5) / 101, (neg + 0.5) / 201
    sure = np.log(p / q) - 1.64 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    found = np.flatnonzero((sure > np.log(3)) & (0.2 * p >= 0.7 * (0.2 * p + 0.8 * q)))
    tracemalloc.start()
    mined = toxicity.mine(rows, toxic, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert mined.tolist() == found[np.argsort(-sure[found], kind="stable")[:8192]].tolist() and set(clues.tolist()) <= set(mined.tolist())
    assert peak < 64 << 20
    memory._held.clear()
    tracemalloc.start()
    lexicons = toxicity.Lexicons(mined)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    sent = pickle.dumps(lexicons)
    assert len(sent) < 1 << 18 and np.array_equal(pickle.loads(sent).flag, lexicons.flag)


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(4)
    toxic = rng.random(20_000) < 0.2
    fires = [np.where(toxic, rng.random(20_000) < p, rng.random(20_000) < q) for p, q in ((0.8, 0.02), (0.7, 0.05), (0.6, 0.01))]
    fires.append(np.where(rng.random(20_000) < 0.95, fires[1], ~fires[1]))  # nearly a copy of the second voter
    pattern = sum(f.astype(int) << k for k, f in enumerate(fires))
    patterns, counts = np.unique(pattern, return_counts=True)
    some = np.arange(20_000) < 2_000  # their class is known, as in the operator
    at = np.searchsorted(patterns, pattern)
    known = tuple(np.bincount(at[some & (toxic == y)], minlength=len(patterns)).astype(float) for y in (True, False))
    model = toxicity.LabelModel(patterns, counts.astype(float), 0.2, known, voters=4)
    assert [1, 3] in [sorted(c) for c in model.cliques]
    assert abs(model.prior - 0.2) < 0.02
    share = dict(zip(map(tuple, model.cliques), model.shares))[(0,)]
    assert abs(share[0][1] - 0.8) < 0.04 and abs(share[1][1] - 0.02) < 0.02


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li>
<a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One
two<br>three<br><p>Four &lt;5&gt;<aside>by the way</aside><div class="comments"><p>first!</p></div><form>mail</form></article>
<footer>&copy; x</footer>"""


@pytest.mark.parametrize("html, want", [
    (PAGE.format(), "A & B\n\nOne two three\n\nFour <5>"),
    (None, ""), ("", ""), ("plain &eacute; text", "plain é text"),
    ("<nav>menu<article><p>in</p></article>", "in"),
    ("<main><header><h1>Head</h1></header><p>a</p><ul><li>x<li>y</ul></main><p>out</p>", "Head\n\na\n\nx\n\ny"),
    ("<article><p>a</p><script>x</article></script><p>b</p></article>", "a\n\nb"),
    ("<article><p>a<p hidden>b</p><p style='display:none'>c</p><p>d</p></article>", "a\n\nd"),
    ("<article><div class='cookie-notice'>c</div><div class='adapter'>d</div></article>", "d"),
    ("<article>1 < 2 && 3 <4</article>", "1 < 2 && 3 <4"),
])
def test_page(html, want):
    lines = html_text.PageLines().read(html) if html else []
    main = [t for p, t in lines if p == html_text.MAIN] or [t for p, t in lines if p == html_text.OPEN]
    assert "\n\n".join(main) == want


def test_common_subsequence_is_longest():
    rng = random.Random(0)
    for _ in range(100):
        a, b = rng.choices(range(5), k=rng.randint(0, 12)), rng.choices(range(5), k=rng.randint(0, 12))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html_text.common_subsequence(a, b)
        assert len(got) == best[-1][-1] and got == sorted(set(got))
        it = iter(b)
        assert all(a[k] in it for k in got)


def test_shared_lines_of_neighbours_go(spark):
    frame = lambda k, own: f"<div>Site name</div><div>{own}</div><div>Terms and {k}</div><div>Contact</div>"
    rows = [(k, f"http://A.example/p/{k:03d}?q={k}", frame("x", f"Story {k}")) for k in range(60)]
    rows += [(100, "http://a.example/p/059b", frame("x", "Story 59")), (101, "http://b.example/only", frame("x", "Alone"))]
    rows += [(102, "http://c.example/1", PAGE.format()), (103, "http://c.example/2", PAGE.format())]
    rows += [(104, None, "<p>no address</p>"), (105, "::", None), (106, "http://d.example/", "")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, range int").repartition(5)
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["text"] == f"Story {k}" for k in range(59))
    assert got[100]["text"].startswith("Site name")  # all of it stands on page 59 as well: a copy
    assert got[101]["text"] == "Site name\n\nAlone\n\nTerms and x\n\nContact"
    assert got[102]["text"] == got[103]["text"] == "A & B\n\nOne two three\n\nFour <5>"
    assert got[104]["text"] == "no address" and got[105]["text"] == got[106]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.extract(pages.limit(0)).count() == 0


def test_shared_lines_go_inside_containers_too(spark):
    page = lambda own: f"<nav>Menu</nav><main><p>Subscribe to our letter</p><p>{own}</p><p>All rights reserved</p></main>"
    rows = [(k, f"http://a.example/p/{k}", page(f"A story of number {k} alone")) for k in range(5)]
    rows += [(5, "http://a.example/p/2b", page("A story of number 2 alone"))]  # the article of page 2 under another URL
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {k: f"A story of number {2 if k == 5 else k} alone" for k in range(6)}


def test_pages_of_much_template_are_no_copies(spark):
    chrome = "".join(f"<div>Site line {k}</div>" for k in range(10))
    rows = [(k, f"http://a.example/{k}", f"{chrome}<div>First of {k}</div><div>Second of {k}</div>") for k in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {k: f"First of {k}\n\nSecond of {k}" for k in range(4)}


@pytest.mark.parametrize("cells", [4, 30, 1 << 28])
def test_common_subsequence_of_halved_tables(monkeypatch, cells):
    monkeypatch.setattr(html_text, "_CELLS", cells)
    test_common_subsequence_is_longest()
    assert html_text.common_subsequence([1] * 300, [1] * 200 + [2]) and len(html_text.common_subsequence([1] * 300, [1] * 200)) == 200


def test_lines_that_repeat_cost_no_more():
    assert len(html_text.common_subsequence([7] * 20_000, [7] * 20_000)) == 20_000  # hours if every match were looked at


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_ranges_may_end_anywhere(spark, ranges):
    """Pages meet both neighbours wherever a range ends; ranges of one page and empty ones included."""
    rng = random.Random(ranges)
    rows = []
    for k in range(30):
        own = [rng.randrange(50, 10_000) for _ in range(rng.randint(0, 4))] if k % 5 else [99, 98]
        lines = [1, 2, *own, 3] if k % 7 else [1, 2, 3]
        rows.append((k, "ab"[k // 17], f"/{k // 4}/{k:02d}", [1] * len(lines), lines))
    pages = spark.createDataFrame(rows, "row long, host string, path string, words array<int>, digests array<long>")
    ordered = pages.repartitionByRange(ranges, F.col("host"), F.col("path")).sortWithinPartitions("host", "path")
    got = {r["row"]: r["gone"] for r in html_text.shared_lines(ordered, 0.95).collect()}
    as_page = [dict(zip(("row", "host", "path", "words", "digests"), r)) for r in rows]
    for k, page in enumerate(as_page):
        found = []
        if k and as_page[k - 1]["host"] == page["host"]:
            near, _, gone = html_text.verdicts(as_page[k - 1], page, 0.95)
            found.append((-near, 0, gone))
        if k + 1 < len(as_page) and as_page[k + 1]["host"] == page["host"]:
            near, gone, _ = html_text.verdicts(page, as_page[k + 1], 0.95)
            found.append((-near, 1, gone))
        found = sorted((f for f in found if f[2] is not None), key=lambda f: f[:2])
        assert got.get(k, []) == (found[0][2] if found else [])
