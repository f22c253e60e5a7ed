"""Words and hashes of texts."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np

WORD = re.compile(r"\w+")
#: Marks inside words, dropped so that "don’t" stays one word.
INNER = re.compile(r"(?<=\w)['’ʼ](?=\w)")
COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def folded(text: str) -> str:
    """Lower case; where a text is not plain ASCII also without accents and of compatible form."""
    if text.isascii():
        return text.lower()
    return COMBINING.sub("", unicodedata.normalize("NFKD", text.casefold()))


def words(text: str) -> list[str]:
    text = folded(text)
    if "'" in text or "\u2019" in text or "\u02bc" in text:
        text = INNER.sub("", text)
    return WORD.findall(text)


def word_hashes(tokens: list[str], cache: dict[str, int]) -> np.ndarray:
    """64-bit hash of each word; ``cache`` is emptied when it grows too large."""
    if len(cache) > 400_000:
        cache.clear()
    out = np.empty(len(tokens), dtype=np.uint64)
    for i, w in enumerate(tokens):
        h = cache.get(w)
        if h is None:
            b = w.encode("utf-8", "surrogatepass")
            h = cache[w] = (zlib.crc32(b) << 32) | zlib.crc32(b, 0x5BD1E995)
        out[i] = h
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = hashes[:n].copy()
    for i in range(1, k):
        h = mixed(h * MIX + hashes[i : i + n])
    return h


class Lexicon(dict):
    """Place of each word in ``hashes`` and ``classes``; emptied between batches when it grows too large."""

    def __init__(self, classify):
        super().__init__()
        self.classify, self.hashes, self.classes = classify, [], []

    def __missing__(self, word: str) -> int:
        b = word.encode("utf-8", "surrogatepass")
        at = self[word] = len(self.hashes)
        self.hashes.append((zlib.crc32(b) << 32) | zlib.crc32(b, 0x5BD1E995))
        self.classes.append(self.classify(word))
        return at

    def look_up(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and class of every word of all texts, and where each text ends."""
        if len(self) > 400_000:
            self.clear()
            self.hashes.clear()
            self.classes.clear()
        places = np.array([self[w] for t in texts for w in t], dtype=np.int64)
        ends = np.cumsum([len(t) for t in texts])
        if not len(places):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), ends
        return mixed(np.array(self.hashes, dtype=np.uint64))[places], np.array(self.classes, dtype=np.uint64)[places], ends
