"""Tokenizer alignment against whole texts and all pairs of tokens, and its edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from scanmill.llm import align
from scanmill.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, digest int, chunk string, n_a int, pair long, `count` int, copies int"


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    letters = align.byte_letters()
    bytes_a = {i: bytes(letters[c] for c in e) for e, i in a.get_vocab().items() if i != 50256}
    bytes_a[50256] = b"<|endoftext|>"

    def tokens(text):
        """[(id, start, end)] of A and of B from the whole text, or None."""
        want, out = b" " + text.encode(), []
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        for found in ([(i, bytes_a[i]) for i in a.encode(" " + text, add_special_tokens=False).ids],
                      [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]):
            at, placed = 0, []
            for i, raw in found:
                placed.append((i, at, at + len(raw)))
                at += len(raw)
            if b"".join(raw for _, raw in found) != want:
                return None
            out.append(placed)
        return out

    return tokens


def measured(models, rows):
    """The contract word by word: all pairs of tokens whose bytes overlap."""
    links, count = [], Counter()
    for _, text in rows:
        found = models(text) if text else None
        links.append(None if not found else (found, [
            (i, j) for i, s, e in found[0] for j, t, f in found[1] if s < f and t < e]))
        count.update(links[-1][1] if links[-1] else [])
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for (doc_id, _), got in zip(rows, links):
        if got is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        (a, b), pairs = got
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, last = [], 0
        for end in common:
            groups.append("|".join(",".join(str(i) for i, _, e in side if last < e <= end) for side in (a, b)))
            last = end
        out.append((doc_id, len(a), len(b), len(groups), len(pairs), sum(count[p] == best[p[1]] for p in pairs),
                    sum(count[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def report(spark, rows, **how):
    table = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], SCHEMA).repartition(3)
    return sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in align.report(table, **how).collect())


AWKWARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n a", "a\n b", "a \n  b \t c", "\x85 x\x85 y", "x\x1c y\x1f z", "naïve ﬁ café ",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "日本語のテキスト です", "👩‍👩‍👧 emoji 🇩🇪", "1234567 3.14", "don't we'LL I'm", "a▁b ▁ c", "nul\x00 x",
    "\u180e a\u180e b", "\u200b a\u200b b\ufeff c", "a\u00a0 b\u3000 c", "x" * 3000, "ab " * 3000, "\r\n\r\n  if x:\n        y = 1\n", "e\u0301 \u0301 a",
]


@pytest.mark.parametrize("chunk", [align.CHUNK_BYTES, 40])
def test_same_as_all_pairs_of_whole_texts(spark, models, chunk):
    rng = random.Random(chunk)
    words = [w for t in AWKWARD if t and len(t) < 60 for w in t.split(" ")] + ["the", "The", "tokenizers", "über", "don't", ""]
    texts = [*AWKWARD, *[rng.choice([" ", " ", "  ", "\n"]).join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(150)]]
    texts += ["one hot text of many copies"] * 100 + [texts[40]] * 3
    rows = list(enumerate(texts)) + [(None, "a null id"), (7, "an id again"), (7, "an id again")]
    assert report(spark, rows, chunk_bytes=chunk) == sorted((-1 if r[0] is None else r[0], *r[1:]) for r in measured(models, rows))


def test_parts_give_what_whole_texts_give(spark, models):
    """Every text of the smallest driver table, cut and remembered, against the libraries on whole texts."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"]]
    aligner = align._aligner(tokenizer_path(align.TOKENIZER_A), tokenizer_path(align.TOKENIZER_B))
    for text, got in zip(texts, aligner.texts(texts)):
        found = models(text)
        assert (got is None) == (found is None)
        if found:
            groups = [g.split("|") for g in got[4].split(";")]
            assert [i for g in groups for i in g[0].split(",")] == [str(i) for i, _, _ in found[0]]
            assert [i for g in groups for i in g[1].split(",")] == [str(i) for i, _, _ in found[1]]


def test_groups_are_kept_on_request(spark):
    docs = spark.createDataFrame([(1, "unbelievable tokenization"), (2, "unbelievable tokenization")], "doc_id long, text string")
    rows = align.encoded(docs, keep_groups=True).where("digest IS NOT NULL").collect()
    assert len(rows) == 1
    assert hashlib.sha256(rows[0]["groups"].encode()).hexdigest() == rows[0]["groups_sha256"]


def test_empty_table(spark):
    assert report(spark, []) == []
    assert report(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
