"""Byte-level BPE against the library, and against merging by the letter."""

import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from kgframe.llm import byte_bpe

sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(byte_bpe.default_path(), byte_bpe.default_pattern(), keep=500)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=bpe.ranks, special_tokens={})


def same(bpe, library, texts):
    for text, (ids, back) in zip(texts, bpe.encode(texts)):
        assert ids == ",".join(map(str, library.encode_ordinary(text))), text[:80]
        assert back == text.encode()


def test_whole_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = byte_bpe.op11_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))


def test_every_code_point(bpe, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    same(bpe, library, texts)


def test_mixtures(bpe, library):
    draw = random.Random(11)
    parts = ["a", "aa", "ab", "ba", " ", "  ", "\n", "\r\n", "'s", "é", "中", "\x00", "1", "99", "!", "...", "ation", " ", "𝐀", "<|endoftext|>"]
    same(bpe, library, ["".join(draw.choice(parts) for _ in range(draw.choice([1, 3, 10, 200]))) for _ in range(3000)])


def test_merging_by_the_letter(bpe):
    """The lowest rank first, the leftmost of equals, with overlapping pairs of one rank."""

    def slow(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            found = [(bpe.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in bpe.ranks]
            if not found:
                return [bpe.ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    draw = random.Random(5)
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 40))).encode() for letters in ("a", "ab", "aab ", "etaoin", "éà", "0123") for _ in range(150)]
    assert bpe.merge(words) == [slow(w) for w in words]
    assert bpe.merge([]) == []


def test_long_pre_tokens(bpe, library):
    draw = random.Random(3)
    same(bpe, library, ["a" * 300_000, "".join(draw.choice("abcdefgh") for _ in range(300_000)), "", "é" * 200_001, " " * 100_000 + "x"])


def test_queue():
    q = byte_bpe.RankQueue(50_000)
    for rank, at in ((49_999, 1), (3, 9), (3, 2), (300, 0), (0, 5)):
        q.put(rank, at)
    assert [q.pop() for _ in range(2)] == [(0, [5]), (3, [2, 9])]
    q.put(1, 7)
    assert [q.pop() for _ in range(4)] == [(1, [7]), (300, [0]), (49_999, [1]), None]


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "Hello", None), (3, "Hello", "z"), (3, "Hello", "z")], "doc_id long, text string, ids string")
    coded = byte_bpe.encode_documents(docs, byte_bpe.default_path(), byte_bpe.default_pattern(), ids=True)
    rows = coded.collect()
    assert [(r.doc_id, r.n_tokens) for r in rows][:2] == [(1, 0), (2, 0)] and {r.ids_sha256 for r in rows[:2]} == {sha(b"")}
    assert len(rows) == 5 and len({r.ids_sha256 for r in rows[2:]}) == 1
    back = byte_bpe.decode_ids(coded, byte_bpe.default_path(), byte_bpe.default_pattern()).collect()
    assert [bytes(r.decoded) for r in back] == [b"", b"", b"Hello", b"Hello", b"Hello"]
    assert byte_bpe.encode_documents(docs.where(F.lit(False)), byte_bpe.default_path(), byte_bpe.default_pattern()).count() == 0
