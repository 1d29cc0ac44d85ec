"""Sets of hashed word shingles of whole texts, vectorised over slices of an Arrow batch."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5
#: Bytes of a text that are cut into words at once.
WINDOW = 1 << 20
_PRIME = 0x9E3779B97F4A7C15
_SMALL = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_PLACE = mix(np.arange(1001, 1001 + WORDS, dtype=np.uint64)) | np.uint64(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The xxh3 hashes of all words' bytes, and where each text's words end. Words lie between ASCII white space; A-Z is lower-cased.

    A long text is cut into windows at white space, so that what is held besides the hashes is bounded by the window
    and the longest word.
    """
    parts, ends, n = [], [], 0
    for text in texts:
        at = 0
        while at < len(text):
            cut = _SPACE.search(text, at + WINDOW) if len(text) - at > WINDOW else None
            end = cut.start() if cut else len(text)
            words = text[at:end].translate(_SMALL).split()
            parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
            n += len(words)
            at = end
        ends.append(n)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(ends, np.int64)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles; a text of fewer words has one, one without words none."""
    if not texts:
        return []
    w, ends = word_hashes(texts)
    n = len(w)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(words, n)):
        rolled[: n - j] += w[j:] * _PLACE[j]
    rolled = mix(rolled + np.uint64(words))
    out, first = [], 0
    for last in ends.tolist():
        k = last - first
        if k >= words:
            h = np.sort(rolled[first : last - words + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif k:
            out.append(mix((w[first:last] * _PLACE[:k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(k)))
        else:
            out.append(np.zeros(0, np.uint64))
        first = last
    return out


def set_digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set, the same for equal sets."""
    first = [mix(s ^ np.uint64(_PRIME)).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets]
    second = [np.bitwise_xor.reduce(mix(s + np.uint64(_PRIME)) | np.uint64(1)) if len(s) else np.uint64(0) for s in sets]
    return mix(np.array(first, np.uint64)), mix(np.array(second, np.uint64) + np.array(first, np.uint64))


def set_names(sets: list[np.ndarray], clashing: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name for each set, and a digest that tells sets of one name apart. Names that are known to clash (sorted)
    are replaced by ones that follow from both digests."""
    first, second = set_digests(sets)
    names = (first >> np.uint64(64 - bits)).view(np.int64)
    if len(clashing):
        at = np.minimum(np.searchsorted(clashing, names), len(clashing) - 1)
        names = np.where(clashing[at] == names, mix(first ^ mix(second)).view(np.int64), names)
    return names, second.view(np.int64)


def batch_texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
