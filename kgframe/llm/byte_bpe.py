"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All unknown pre-tokens of some texts lie side by side in one linked list of byte positions, which no merge crosses.
A pair of neighbours waits in the bucket of its merge rank; a bitmap over the ranks, with a second one over its words,
gives the lowest rank that has a bucket by find-first-set; entries whose pair has changed meanwhile are skipped. So a
pre-token of any length takes time that grows with its length, but for sorting buckets.

The ranks are read from a file (``path``) that every executor must be able to open.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kgframe.llm.bpe import NEWER_SIGNS
from kgframe.llm.common import slices, table

#: Ranks in one word of the lower bitmap.
WORD_BITS = 8
#: More positions than this are held in arrays of machine integers.
LARGE = 1 << 18
#: Bytes of text that are encoded together.
SLICE = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class RankQueue:
    """Positions by rank. The lowest rank is found by two find-first-sets."""

    def __init__(self, ranks: int):
        self.none = ranks
        self.top = 0
        self.words = [0] * ((ranks >> WORD_BITS) + 1)
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [at]
            high = rank >> WORD_BITS
            self.words[high] |= 1 << (rank & ((1 << WORD_BITS) - 1))
            self.top |= 1 << high
        else:
            bucket.append(at)

    def fill(self, ranks: np.ndarray) -> None:
        """Put every position whose rank is one of the queue's."""
        at = np.flatnonzero(ranks < self.none)
        at = at[np.argsort(ranks[at], kind="stable")]
        found, begins = np.unique(ranks[at], return_index=True)
        ends = np.append(begins[1:], len(at)).tolist()
        positions = at.tolist()
        for rank, a, z in zip(found.tolist(), begins.tolist(), ends):
            self.put(rank, positions[a])
            self.buckets[rank] = positions[a:z]

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank with its positions, leftmost first; the bucket is then gone."""
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        word = self.words[high]
        low = word & -word
        self.words[high] = word = word ^ low
        if not word:
            self.top &= self.top - 1
        rank = high << WORD_BITS | (low.bit_length() - 1)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


def code_points(pattern: str) -> str:
    """The code points up to U+FFFF that a one-character pattern of the regular-expression library matches, as ranges of a class."""
    one = regex.compile(pattern, regex.V1)
    hits = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and one.match(chr(c))]
    firsts = [c for k, c in enumerate(hits) if not k or hits[k - 1] != c - 1]
    lasts = [c for k, c in enumerate(hits) if k + 1 == len(hits) or hits[k + 1] != c + 1]
    return "".join(f"\\u{a:04x}-\\u{z:04x}" for a, z in zip(firsts, lasts))


def plain_classes(pattern: str, letters: str, numbers: str, spaces: str) -> str:
    """A pattern with its classes of letters, numbers and white space written out, inside sets and outside."""
    kinds = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": spaces}
    out = re.sub(r"\[\^[^]]*\]", lambda m: re.sub(r"\\p\{[LN]\}|\\s", lambda k: kinds[k[0]], m[0]), pattern)
    out = re.sub(r"\\p\{[LN]\}|\\s", lambda k: f"[{kinds[k[0]]}]", out)
    return out.replace(r"\S", f"[^{spaces}]")


class ByteBpe:
    """Byte-level BPE by the ranks of a file.

    What is encoded is kept in two generations of about ``keep`` pre-tokens each: what the younger one lacks is taken
    over from the older, which goes when the younger is full. So memory is bounded and frequent pre-tokens stay.
    """

    def __init__(self, path: str, pattern: str, keep: int = 250_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.none = max(self.bytes) + 1
        near = pattern
        newer = "".join(f"{chr(a)}-{chr(z)}" for a, z in NEWER_SIGNS)  # no letters or numbers to the tokenizer
        for k in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(k, f"[{k}--[{newer}]]")
        self.any_words = regex.compile(pattern, regex.V1).findall
        self.far = re.compile("[\U00010000-\U0010ffff]").search
        # classes of near code points, written out, are matched by the standard library in a third of the time
        letters, numbers, spaces = (code_points(k) for k in (f"[\\p{{L}}--[{newer}]]", f"[\\p{{N}}--[{newer}]]", r"\s"))
        self.near_words = re.compile(plain_classes(near, letters, numbers, spaces)).findall
        starts = np.full(1 << 16, self.none, np.int64)  # the ranks of pairs of bytes
        for t, i in self.ranks.items():
            if len(t) == 2:
                starts[t[0] << 8 | t[1]] = i
        self.starts = starts
        self.keep = keep
        self.known: dict[str, tuple[str, bytes]] = {}  # of each pre-token its ids, joined by commas, and what they decode to
        self.old_known: dict[str, tuple[str, bytes]] = {}

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return (self.near_words if text.isascii() or not self.far(text) else self.any_words)(text)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece (not empty): always the pair of lowest rank, the leftmost of equals."""
        data = b"".join(pieces)
        n, get, none = len(data), self.ranks.get, self.none
        stop = bytearray(n + 1)  # where pieces begin and end
        at = 0
        for p in pieces:
            stop[at] = 1
            at += len(p)
        stop[n] = 1
        make = list if n <= LARGE else (lambda x: array("q", x))
        after, before = make(range(1, n + 2)), make(range(-1, n))
        flat = np.frombuffer(data, np.uint8).astype(np.int64)
        first = np.full(n + 1, none, np.int64)
        first[: max(0, n - 1)] = self.starts[flat[:-1] << 8 | flat[1:]]
        first[:n][np.frombuffer(stop, np.uint8)[1:] > 0] = none
        pair = make(first.tolist())
        queue = RankQueue(none)
        queue.fill(first)
        put = queue.put
        while (found := queue.pop()) is not None:
            rank, bucket = found
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                end = after[j]
                after[i], before[end], pair[j] = end, i, none
                lower = False
                r = none if stop[end] else get(data[i : after[end]], none)
                pair[i] = r
                if r != none:
                    put(r, i)
                    lower = r <= rank
                if not stop[i]:
                    h = before[i]
                    r = get(data[h:end], none)
                    pair[h] = r
                    if r != none:
                        put(r, h)
                        lower = lower or r <= rank
                if lower:  # a pair that comes before the rest of this bucket
                    for later in bucket[k + 1 :]:
                        put(rank, later)
                    break
        out, at = [], 0
        for p in pieces:
            end, ids = at + len(p), []
            while at < end:
                to = after[at]
                ids.append(self.ranks[data[at:to]])
                at = to
            out.append(ids)
        return out

    def learn(self, words: list[str]) -> None:
        """Encode pre-tokens; one that is a token by itself needs no merging. Decode them and keep both."""
        raw = [w.encode() for w in words]
        whole = list(map(self.ranks.get, raw))
        merged = iter(self.merge([b for b, i in zip(raw, whole) if i is None]))
        for w, i in zip(words, whole):
            ids = next(merged) if i is None else [i]
            self.known[w] = (",".join(map(str, ids)), self.decode(ids))

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids joined by commas, and the bytes that they decode to."""
        cyclic = gc.isenabled()
        gc.disable()  # nothing here makes cycles
        try:
            if len(self.known) > self.keep:
                self.old_known, self.known = self.known, {}
            known, old = self.known, self.old_known
            split = [self.split(t) for t in texts]
            new = set(chain.from_iterable(split)).difference(known)
            known.update({w: old[w] for w in new if w in old})
            if new := new.difference(known):
                self.learn(list(new))
            out = []
            for words in split:
                pairs = list(map(known.__getitem__, words))
                out.append((",".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])))
            return out
        finally:
            if cyclic:
                gc.enable()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` if asked.

    Null and empty texts give no tokens and the digests of nothing. Repeated rows and null ids are kept as they are;
    other columns are left out. One pass without a shuffle; a text is never cut.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for b in slices(batches, text_col, SLICE):
            coded = bpe.encode([t or "" for t in b.column(text_col).to_pylist()])
            columns = [
                b.column(id_col),
                pa.array([i.count(",") + 1 if i else 0 for i, _ in coded], pa.int64()),
                pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _ in coded], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for _, d in coded], pa.string()),
            ]
            if ids:
                columns.append(pa.array([list(map(int, i.split(","))) if i else [] for i, _ in coded], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_ids(coded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes that the ids of each row stand for (part of a text may be no valid UTF-8); null ids give null."""
    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for b in batches:
            out = [None if x is None else bpe.decode(x) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return coded.mapInArrow(run, schema)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded with the public byte-level vocabulary of many languages."""
    return encode_documents(table(spark, sf_dir, "documents"), default_path(), default_pattern())
