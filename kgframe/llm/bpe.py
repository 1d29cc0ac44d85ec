"""BPE encoding and decoding by speculation: greedy longest match proposes the tokens of a word, every adjacent
pair is checked for compatibility, and only words with a failing pair are merged exactly.

A sequence of tokens is what BPE gives for a word exactly when every adjacent pair is what BPE gives for the two
joined, and every single token is what BPE gives for its own letters. Pairs recur, so their verdicts are kept.

The vocabulary is read from a tokenizer file (``path``), which every executor must be able to open.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from kgframe.llm.common import slices, table


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Capitals that are newer than Python's tables, whose small letters the tokenizer knows: first, last, first small letter.
NEWER_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
# Letters and numbers of the regular expressions that the tokenizer's pattern takes for other signs: first, last.
NEWER_SIGNS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
]
#: Words of more bytes are merged one at a time.
LONG = 64
#: Words that meet in one matrix of exact merging.
TOGETHER = 4096


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others follow from U+0100."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """A tokenizer with word ends, as read from its file.

    What is encoded is kept in two generations of about ``keep`` words each: what the younger one lacks is taken over
    from the older, which goes when the younger is full. So memory is bounded (some 70 MB with the vocabulary) and
    frequent words stay.
    """

    def __init__(self, path: str, keep: int = 60_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        codes = merges[:, 0] << 32 | merges[:, 1]
        self.ranks = np.argsort(codes, kind="stable")
        self.codes, self.merged, self.none = codes[self.ranks], merges[:, 2], len(merges)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.inner: dict[bytes, int] = {}  # tokens inside a word, by their bytes
        self.final: dict[bytes, int] = {}  # tokens at the end of one
        self.bytes: dict[int, bytes] = {}
        self.lengths: dict[bytes, tuple[int, ...]] = {}  # of the tokens that begin with three bytes, longest first
        lengths: dict[bytes, set[int]] = {}
        for t, i in vocab.items():
            raw = bytes(byte_of[c] for c in t.removesuffix(end))
            if raw:
                (self.final if t.endswith(end) else self.inner)[raw] = i
                self.bytes[i] = raw
                if len(raw) > 2:
                    lengths.setdefault(raw[:3], set()).add(len(raw))
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in lengths.items()}
        self.ends = set(self.final.values())
        self.first = [self.inner[bytes([b])] for b in range(256)]
        self.last = [self.final[bytes([b])] for b in range(256)]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        newer = "".join(f"{chr(a)}-{chr(z)}" for a, z in NEWER_SIGNS)
        self.newer = re.compile(f"[{newer}]")
        self.far_sign = re.compile(f"[{chr(NEWER_SIGNS[0][0])}-\U0010ffff]").search
        known = {c: rf"[\p{{{c}}}--[{newer}]]" for c in "LN"}
        self.known_words = regex.compile(pattern.replace(r"\p{L}", known["L"]).replace(r"\p{N}", known["N"]), regex.V1)
        self.small = {c: small + c - a for a, z, small in NEWER_CAPITALS for c in range(a, z + 1)}
        self.far = re.compile(f"[{chr(min(self.small))}-\U0010ffff]").search  # one range is searched fast
        self.apart = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")")
        self.space, self.control = re.compile(r"[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), re.compile(r"[\x1c-\x1f]")
        self.fits: dict[int, bool] = {}  # verdicts on pairs, and on single tokens
        self.keep = keep
        self.known: dict[str, tuple[str, str]] = {}  # of each word its ids and its tokens
        self.coded: dict[str, tuple[str, str]] = {}  # the same of each run without white space
        self.old_known: dict[str, tuple[str, str]] = {}
        self.old_coded: dict[str, tuple[str, str]] = {}
        self.exact = 0

    # --- exact merging ---
    def symbols(self, word: bytes, ended: bool = True) -> list[int]:
        """The tokens of a word's single bytes."""
        return [*map(self.first.__getitem__, word[:-1]), (self.last if ended else self.first)[word[-1]]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens; ``none`` where they don't merge. Negative tokens never do."""
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), self.none - 1)
        return np.where((self.codes[at] == code) & (right >= 0), self.ranks[at], self.none)

    def merge(self, words: list[list[int]]) -> list[list[int]]:
        """Exact merging of words given as symbols: always the pair of lowest rank, the leftmost of equals.

        Words of about one length are the rows of a matrix; each round merges one pair of every row that has one.
        """
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        while order and len(words[order[-1]]) > LONG:
            k = order.pop()
            out[k] = self.merge_long(words[k])
        for begin in range(0, len(order), TOGETHER):
            live = np.array(order[begin : begin + TOGETHER])
            size = np.array([len(words[k]) for k in live])
            rows = np.full((len(live), max(2, size[-1])), -1, np.int64)
            rows[np.arange(rows.shape[1]) < size[:, None]] = [t for k in live for t in words[k]]
            ranks = self.rank(rows[:, :-1], rows[:, 1:])
            while len(live):
                at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(live), np.int64)
                low = ranks[np.arange(len(live)), at] if ranks.shape[1] else np.full(len(live), self.none)
                done = low >= self.none
                if done.any():
                    left = (rows[done] >= 0).sum(axis=1).tolist()
                    for k, row, n in zip(live[done].tolist(), rows[done].tolist(), left):
                        out[k] = row[:n]
                    rows, ranks, live, at, low = rows[~done], ranks[~done], live[~done], at[~done], low[~done]
                    if not len(live):
                        break
                each = np.arange(len(live))
                rows[each, at] = self.merged[low]
                stay = np.ones(rows.shape, bool)
                stay[each, at + 1] = False
                rows = rows[stay].reshape(len(live), -1)
                stay = np.ones(ranks.shape, bool)
                stay[each, at] = False
                ranks = ranks[stay].reshape(len(live), -1)
                for shift in (-1, 0):  # the pairs on both sides of what was merged
                    k = each[(at + shift >= 0) & (at + shift < ranks.shape[1])]
                    i = at[k] + shift
                    ranks[k, i] = self.rank(rows[k, i], rows[k, i + 1])
        return out

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same of one long word in n log n steps: a heap holds the pairs there are."""
        parts, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        flat = np.array(parts)
        ranks = self.rank(flat[:-1], flat[1:])
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(ranks.tolist()) if r < self.none]
        heapq.heapify(heap)
        one: dict[tuple[int, int], int] = {}
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or (parts[i], parts[j]) != (a, b):
                continue
            parts[i], parts[j] = int(self.merged[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n:
                    pair = parts[x], parts[y]
                    if (rank := one.get(pair)) is None:
                        rank = one[pair] = int(self.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if rank < self.none:
                        heapq.heappush(heap, (rank, x, *pair))
        return [p for p in parts if p >= 0]

    # --- speculation ---
    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left; tokens with a word end match at the end only."""
        out, i, n, inner, final, lengths = [], 0, len(word), self.inner, self.final, self.lengths
        while i < n:
            for k in lengths.get(word[i : i + 3], (2, 1)):
                j = i + k
                if j < n:
                    t = inner.get(word[i:j])
                elif j == n:
                    t = final.get(word[i:j])
                else:
                    continue
                if t is not None:
                    break
            out.append(t)
            i = j
        return out

    def verdicts(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is what BPE gives for the two joined; a single token has the code -1 - token."""
        fits = self.fits
        todo = [c for c in codes.tolist() if c not in fits]
        wanted = [[c >> 32, c & 0xFFFFFFFF] if c >= 0 else [-1 - c] for c in todo]
        joined = [[s for t in ts for s in self.symbols(self.bytes[t], t in self.ends)] for ts in wanted]
        fits.update({c: got == want for c, got, want in zip(todo, self.merge(joined), wanted)})
        return np.fromiter(map(fits.__getitem__, codes.tolist()), bool, len(codes))

    def learn(self, words: list[str]) -> None:
        """Encode words and keep the outcome."""
        raw = [w.encode() for w in words]
        tokens = [self.propose(x) for x in raw]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for ts in tokens for t in ts), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        singles, where = np.unique(-1 - flat, return_inverse=True)
        good = self.verdicts(singles)[where]
        inside = np.ones(max(0, len(flat) - 1), bool)
        inside[ends[:-1] - 1] = False
        at = np.flatnonzero(inside)
        pairs, where = np.unique(flat[at] << 32 | flat[at + 1], return_inverse=True)
        good[at] &= self.verdicts(pairs)[where]
        failing = np.unique(np.searchsorted(ends, np.flatnonzero(~good), side="right")).tolist()
        for k, exact in zip(failing, self.merge([self.symbols(raw[k]) for k in failing])):
            tokens[k] = exact
        self.exact += len(failing)
        for w, ts in zip(words, tokens):
            self.known[w] = (" ".join(map(str, ts)), " ".join(map(self.token.__getitem__, ts)))

    # --- texts ---
    def runs(self, text: str) -> list[str]:
        """The runs without white space of a text, normalised. No word crosses runs. Special tokens come with a space
        before them, so that no run is taken for one (case counts in special tokens)."""
        out: list[str] = []
        for part in self.apart.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(f" {part}")
                continue
            flat = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            if not flat.isascii() and self.far(flat):
                flat = flat.translate(self.small)
            # str.split() also parts at four control characters that count as signs here
            out += filter(None, self.space.split(flat)) if self.control.search(flat) else flat.split()
        return out

    def words_of(self, run: str) -> list[str]:
        """The words of a run without white space."""
        if run.isascii() or not self.far_sign(run):
            return [run] if run.isalpha() else self.words.findall(run)
        return (self.known_words if self.newer.search(run) else self.words).findall(run)

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids and its decoded form, both as strings joined by one space."""
        cyclic = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and searching the kept words for some takes a fifth of the time
        try:
            return self._encode(texts)
        finally:
            if cyclic:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[tuple[str, str]]:
        if len(self.known) > self.keep:
            self.old_known, self.known = self.known, {}
        if len(self.coded) > self.keep:
            self.old_coded, self.coded = self.coded, {}
        if len(self.fits) > 8 * self.keep:
            self.fits.clear()
        known, coded = self.known, self.coded
        coded.update({f" {t}": (str(i), t) for t, i in self.special.items()})
        texts_runs = [self.runs(t) for t in texts]
        new = set().union(*texts_runs).difference(coded)
        coded.update({r: self.old_coded[r] for r in new if r in self.old_coded})
        fresh = {r: self.words_of(r) for r in new.difference(coded)}
        words = {w for ws in fresh.values() for w in ws}.difference(known)
        known.update({w: self.old_known[w] for w in words if w in self.old_known})
        if words := words.difference(known):
            self.learn(list(words))
        for r, ws in fresh.items():
            coded[r] = known[ws[0]] if len(ws) == 1 else (" ".join([known[w][0] for w in ws]), " ".join([known[w][1] for w in ws]))
        out = []
        for runs in texts_runs:
            pairs = list(map(coded.__getitem__, runs))
            out.append((" ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])))
        return out

    def decode(self, ids: list[int]) -> str:
        """As the tokenizer's own decode: tokens joined by one space, special tokens kept."""
        return " ".join(self.token[i] for i in ids)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` if asked.

    Null and empty texts give no tokens and the digests of the empty string. Repeated rows and null ids are kept
    as they are; other columns are left out. One pass without a shuffle; a text is never cut.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in slices(batches, text_col):
            coded = bpe.encode([t or "" for t in b.column(text_col).to_pylist()])
            columns = [
                b.column(id_col),
                pa.array([i.count(" ") + 1 if i else 0 for i, _ in coded], pa.int64()),
                pa.array([sha(i) for i, _ in coded], pa.string()),
                pa.array([sha(d) for _, d in coded], pa.string()),
            ]
            if ids:
                columns.append(pa.array([list(map(int, i.split())) for i, _ in coded], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def encoded_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """One row for each document: ``n_tokens`` of its whole text (0 for a null or empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in slices(batches, text_col):
            coded = bpe.encode([t or "" for t in b.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([i.count(" ") + 1 if i else 0 for i, _ in coded], pa.int64())], ["n_tokens"])

    return docs.select(text_col).mapInArrow(run, "n_tokens long")


def decode_ids(coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the text that the ids of each row stand for; null ids give null."""
    from pyspark.sql import types as T

    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            out = [None if x is None else bpe.decode(x) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    return coded.mapInArrow(run, schema)


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded with the public word-end vocabulary."""
    return encode_documents(table(spark, sf_dir, "documents"), default_path())
