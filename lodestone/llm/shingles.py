"""Word shingles of whole texts as 64-bit hashes, computed on arrays for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once; a longer text is hashed by itself.
PIECE = 1 << 19
ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _LETTER.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64."""
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


#: Bytes whose prefix sums are held at once.
BLOCK = 1 << 16
_UP, _DOWN = _powers(int(ODD), BLOCK + 1), _powers(pow(int(ODD), -1, 1 << 64), BLOCK + 1)


def _words(texts: list[bytes], exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length in bytes of every word, the number of words before each text and the end, and each word's place in the texts joined by a byte.

    Without ``exact``, A-Z are lower-cased. A word's hash is a sum over its letters, each times a power of its place. The sums before all
    borders of words come from blocks of the joined texts, so a long text takes about 12 bytes for each of its own.
    """
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    letter = _LETTER if exact else _FOLDED
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    del space
    before = np.empty(len(edges), np.uint64)
    shift = np.empty(len(edges), np.uint64)
    carry, up, down = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)
    borders = np.searchsorted(edges, np.arange(0, len(raw) + BLOCK, BLOCK))
    for k, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):
        block = raw[k * BLOCK : (k + 1) * BLOCK]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(letter[block] * _UP[: len(block)], out=sums[1:])
        at = edges[a:b] - k * BLOCK
        before[a:b] = carry + up * sums[at]
        shift[a:b] = down * _DOWN[at]
        carry, up, down = carry + up * sums[-1:], up * _UP[BLOCK:], down * _DOWN[BLOCK:]
    starts = edges[0::2]
    lengths = (edges[1::2] - starts).astype(np.uint64)
    hashes = mix((before[1::2] - before[0::2]) * shift[0::2] + lengths)
    text_starts = 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, lengths, np.searchsorted(starts, text_starts), starts - 1


def shingles(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text, its different shingles as sorted int64, A-Z lower-cased.

    The upper eight bits hold 255 less the shingle's length in bytes, so that long shingles, which
    are rare, sort first. A text with fewer than ``width`` words, but some, has one shingle.
    """
    for at, stop in pieces(texts):
        hashes, lengths, cuts, _ = _words(texts[at:stop])
        n = max(len(hashes) - width + 1, 0)
        keys = _key(*_join(hashes, lengths, n, width))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(keys[a : b - width + 1])
            elif b > a:
                yield _key(*_join(hashes[a:b], lengths[a:b], 1, b - a))
            else:
                yield np.empty(0, np.int64)


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of every word, upper and lower case apart."""
    return _words([text], exact=True)[0]


class Words:
    """The words of several texts: ``hashes`` (A-Z lower-cased) and ``lengths``; ``starts`` and ``stops`` in the texts joined by a byte, ``text`` of each, and each text's place in ``places``."""

    def __init__(self, texts: list[bytes]) -> None:
        self.hashes, self.lengths, self.cuts, self.starts = _words(texts)
        self.stops = self.starts + self.lengths.astype(np.int64)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.cuts))
        self.places = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.lines = np.flatnonzero(np.frombuffer(b"\n".join(texts), np.uint8) == 10)

    def runs(self, width: int) -> np.ndarray:
        """Hash of each run of ``width`` words, whatever texts they are in."""
        return _join(self.hashes, self.lengths, max(len(self.hashes) - width + 1, 0), width)[0]

    def sets(self, at: np.ndarray, to: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """As :func:`shingles` gives them for the words from ``at`` to ``to``, one word or more each: all of them, and where each set starts."""
        n = np.maximum(to - at - width + 1, 1)
        keys = _key(*_join(self.hashes, self.lengths, max(len(self.hashes) - width + 1, 0), width))
        of = np.repeat(np.arange(len(n)), n)
        flat = np.empty(len(of), np.int64)
        whole = (to - at >= width)[of]
        flat[whole] = keys[(np.arange(len(of)) + (at - (np.cumsum(n) - n))[of])[whole]]
        size = to - at
        for k in np.unique(size[size < width]).tolist():
            short = np.flatnonzero(size == k)
            flat[of.searchsorted(short)] = _key(*_join(self.hashes, self.lengths, len(self.hashes) - k + 1, k))[at[short]]
        order = np.argsort(flat)
        # Small numbers are sorted by radix.
        order = order[np.argsort(of.astype(np.uint16 if len(n) < 1 << 16 else np.int64)[order], kind="stable")]
        flat, of = flat[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
        return flat[new], np.searchsorted(of[new], np.arange(len(n)))


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """First and last (not included) of the texts to hash at once, of PIECE bytes at most or one."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= PIECE):
            size += len(texts[stop])
            stop += 1
        yield at, stop
        at = stop


def _join(hashes: np.ndarray, lengths: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and length of the first ``n`` runs of ``width`` words."""
    joined, long = np.full(n, width, np.uint64), np.zeros(n, np.uint64)
    for i in range(width):
        joined = joined * ODD + hashes[i : i + n] * _PLACE[i % len(_PLACE)]
        long += lengths[i : i + n]
    return mix(joined), long


def _key(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    short = np.uint64(255) - np.minimum(lengths, np.uint64(255))
    keys = (short << np.uint64(56)) | (hashes >> np.uint64(8))
    return (keys ^ np.uint64(1 << 63)).view(np.int64)
