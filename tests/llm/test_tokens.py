"""Token files, packing and exact groups against plain Python over small tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanmill.llm import exact_dedup, packing, token_frames
from scanmill.llm.common import shared_folder
from scanmill.llm.tokens import WordEncoder, encoder, tokenizer_path

ODD = [
    None, "", " ", "Hello  World!\n it's 1234 don't", "ÄÖÜ straßé ﬁ İ", "a\x1cb c\x85d <|endoftext|> x<|startoftext|>y",
    "Hello  World!\n it's 1234 don't", "日本語 テキスト 😀😀", "word " * 30_000, "x" * 5_000, "THE\tEND", "the end",
]
SCHEMA = "doc_id long, text string, lang string, shard int, ids string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(400)]
    rows = [(i, t, None, 7, "x", 1) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 900))), "en", 1, "y", 2) for i in range(200)]
    rows += [(500 + i, "Copied Text", "en", 1, "y", 2) for i in range(150)]
    rows += [(None, "no id", None, None, None, None), (900, "twice", None, 1, "z", 1), (900, "twice", None, 1, "z", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain_ids(text, end):
    return WordEncoder(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_files_hold_what_the_tokenizer_gives(spark, docs):
    got = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in token_frames.token_digests(docs).collect()}
    rows = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in docs.collect())
    start = 0
    assert len(got) == len(rows)
    tokenizer = WordEncoder(tokenizer_path()).tokenizer
    for doc_id, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert got[(None if doc_id == -1 else doc_id, start)] == (len(ids), crc(ids))
        start += len(ids)


def test_only_wanted_documents_are_read(spark, docs):
    folder = shared_folder(spark, "token-test")
    shards = token_frames.write_tokens(docs, folder, tokenizer_path(), 2)
    wanted = spark.createDataFrame([(3,), (120,), (99_999,), (900,), (None,)], "doc_id long")
    got = token_frames.read_tokens(spark, shards, 2, wanted).collect()
    assert sorted(r["doc_id"] for r in got) == [3, 120, 900, 900]
    row = next(r for r in got if r["doc_id"] == 3)
    assert list(np.frombuffer(row["ids"], "<u2")) == plain_ids(ODD[3], 2)


def test_damage_is_noticed(spark, docs):
    folder = shared_folder(spark, "token-test")
    path = token_frames.write_tokens(docs, folder, tokenizer_path(), 2).orderBy("shard").first()["path"]
    files, place = token_frames._filesystem(path)
    with files.open_input_file(place) as f:
        content = bytearray(f.read())
    reader = token_frames.FrameReader(path)
    content[int(reader.offsets[1]) + 12] ^= 0xFF
    with files.open_output_stream(place, compression=None) as f:
        f.write(bytes(content))
    with pytest.raises(Exception):
        token_frames.FrameReader(path).frame(1)
    assert token_frames.FrameReader(path).frame(0)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert token_frames.token_digests(none).count() == 0
    assert packing.pack(none).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact(none).count() == 0


@pytest.mark.parametrize("shard_docs", [16, 512])
def test_packing_covers_every_id_once(docs, shard_docs):
    rows = packing.pack(docs, shard_docs=shard_docs).collect()
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append(r["text"])
    sequences, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        spans[r["doc_id"]].append(r)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert set(spans) == set(want)
    for doc_id, texts in want.items():
        if len(texts) > 1:
            continue  # repeated ids: pieces of either row
        ids, at = plain_ids(texts[0], 1), 0
        for r in sorted(spans[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    assert sum(r["length"] for r in spans[900]) == 2 * len(plain_ids("twice", 1))


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 60, rng.integers(1, 80)).astype("<u2") for _ in range(40)]
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=60)
    idf, mean = np.log1p((40 - df + 0.5) / (df + 0.5)), np.mean([len(t) for t in texts])
    index = packing.Shard(texts, idf, mean)
    for seed in range(40):
        scores = np.zeros(40)
        for k, t in enumerate(texts):
            for term in index.query[seed]:
                tf = (t == term).sum()
                scores[k] += idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        scores[seed] = 0
        assert np.allclose(scores[index.neighbours(seed)], np.sort(scores[scores > 0])[::-1])


def norm(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("digest", [exact_dedup.md5_128, lambda t: F.substring(F.md5(t), 1, 1)])
def test_exact_groups_even_when_digests_collide(docs, digest):
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r["text"])].append(r["doc_id"])
    want = sorted(
        (str(r["doc_id"]), str(max((i for i in g if i is not None), default=None)), len(g), hashlib.sha256(norm(r["text"]).encode()).hexdigest())
        for r in rows for g in [groups[norm(r["text"])]])
    got = exact_dedup.exact_groups(docs, "largest", digest=digest).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_one_document_of_a_group_stays(docs):
    left = exact_dedup.drop_exact(docs).collect()
    texts = [norm(r["text"]) for r in left]
    assert len(texts) == len(set(texts)) and set(texts) == {norm(r["text"]) for r in docs.collect()}
    assert next(r["doc_id"] for r in left if r["text"] == "Copied Text") == 500


def test_words_are_cut_as_the_tokenizer_cuts_them():
    words = WordEncoder(tokenizer_path())
    assert words.cuts
    chars = [chr(c) for c in range(0x21, 0x180)] + ["́", "Σ", "İ", " ", "\x85", "\xad"]
    rng = random.Random(5)
    texts = chars + [a + c + b for c in chars for a in "a'1." for b in ("b", "'S", "2", "!!")]
    texts += ["".join(rng.choices(pool, k=rng.randint(1, 12))) for pool in (chars, "'sSTREVEmldD1.,\xb5\xdf\xc9 <|") for _ in range(4000)]
    texts += ["<|endoftext|>", "0", "a0b", "don't WE'LL", "x" * 5000]
    want = words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for _ in range(2):  # asked for, then remembered
        for text, ids, w in zip(texts, words.encode(texts, 2), want):
            assert np.frombuffer(ids, dtype=words.dtype).tolist() == [*w.ids, 2], text


def test_a_users_memory_of_words_is_its_own():
    few, many = WordEncoder(tokenizer_path(), memory=3), WordEncoder(tokenizer_path(), memory=10_000)
    texts = [f"alpha{k} beta{k} gamma{k}" for k in range(2000)]
    assert [few.encode([t], 1) for t in texts] == [many.encode([t], 1) for t in texts]
    assert len(few.known) <= 3 + 3 and len(many.known) == 6001
    assert encoder(tokenizer_path(), 7_000_000).memory == 7_000_000 and encoder(tokenizer_path()).memory == 7_000_000
    assert packing.WORDS > WordEncoder(tokenizer_path()).memory


def test_document_frequency_counts_an_id_once_a_document(spark):
    rng = np.random.default_rng(9)
    texts = [rng.integers(0, 50, n).astype("<u2") for n in (1, 7, 400, 9000, 3)]
    docs = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "ids binary")
    df, mean, count = packing.document_frequency(docs, 60, np.dtype("<u2"))
    assert df.tolist() == [sum(k in t for t in texts) for k in range(60)]
    assert count == 5 and mean == sum(map(len, texts)) / 5
