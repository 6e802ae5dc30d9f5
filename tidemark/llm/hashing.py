"""Vectorised 64-bit hashing of words and word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser (splitmix64) over an array of unsigned 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pieces(text: str, size: int) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, each cut behind a white space character; longer where there is none."""
    at = 0
    while at < len(text):
        to = min(len(text), at + size)
        while to < len(text) and to > at and not text[to - 1].isspace():
            to -= 1
        if to == at:  # no white space in the piece: it goes on to the next
            to = at + size
            while to < len(text) and not text[to - 1].isspace():
                to += 1
        yield text[at:to]
        at = to


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is this rule.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_multipliers(size: int) -> np.ndarray:
    """``size`` odd multipliers, the same in every process."""
    return np.array([xxhash.xxh3_64_intdigest(b"window", seed=k) | 1 for k in range(size)], np.uint64)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` consecutive hashes; none if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, m in enumerate(window_multipliers(size)):
        out += hashes[k : k + n] * m
    return mix64(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``size``-word shingles.

    With fewer words the whole sequence counts as one shingle; without words the
    set is empty.
    """
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\x20".join(words), seed=len(words))], np.uint64)
    return np.unique(window_hashes(word_hashes(words), size))
