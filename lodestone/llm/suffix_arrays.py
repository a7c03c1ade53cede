"""Suffix arrays on numpy: Larsson-Sadakane refinement, and Kasai's common prefixes up to a given depth."""

from __future__ import annotations

import numpy as np

#: Bytes that one comparison takes.
WORD = 8
#: Suffixes that follow each other in a lane of :func:`common_prefixes`.
LANE = 16


def words_of(text: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each position as one number, first byte highest; zeros after the end, and ``more`` of them."""
    wide = np.concatenate([text, np.zeros(WORD + more, np.uint8)]).astype(np.uint64)
    two = (wide[:-1] << np.uint64(8)) | wide[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``text`` in order, and each one's place.

    Suffixes are sorted by their first eight bytes; then, as Larsson and Sadakane do, those
    that are not alone in their group are sorted by the group of the suffix as many bytes on as
    are sorted already, which doubles that number each time. Suffixes that are alone are left.
    """
    n = len(text)
    keys = words_of(text, 0)[:n]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # A group's number is the place of its first suffix.
    group = np.empty(n, np.int64)
    group[order] = heads
    done = WORD
    alone = new & np.r_[new[1:], True]
    unsorted = np.flatnonzero(~alone)
    while len(unsorted):
        at = order[unsorted]
        # Of suffixes that end before that, the shorter comes first.
        on = at + done
        key = (group[at] << 32) | np.where(on < n, group[np.minimum(on, n - 1)] + n + 1, n - at)
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[unsorted] = at
        new = np.r_[True, key[1:] != key[:-1]]
        heads = unsorted[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        group[at] = heads
        unsorted = unsorted[~(new & np.r_[new[1:], True])]
        done *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(text: np.ndarray, order: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """For each place, the bytes (up to ``depth``) that its suffix has in common with the one before it.

    Kasai's rule: the suffix one byte on has at most one byte less in common. Texts are cut into
    lanes, each going through its suffixes in the text's order; all lanes take a step at once.
    """
    n = len(text)
    words = words_of(text, depth)
    common = np.zeros(n, np.int64)
    held = np.zeros(-(-n // LANE), np.int64)
    for step in range(LANE):
        at = np.arange(step, n, LANE)
        held = np.maximum(held[: len(at)] - 1, 0)
        before = place[at] - 1
        other = order[np.maximum(before, 0)]
        held[before < 0] = 0
        go = np.flatnonzero((before >= 0) & (held < depth))
        while len(go):
            unlike = words[at[go] + held[go]] ^ words[other[go] + held[go]]
            same = np.zeros(len(go), np.int64)
            for k in range(WORD):
                same += unlike < np.uint64(1 << 8 * k)
            held[go] += same
            go = go[(same == WORD) & (held[go] < depth)]
        # Bytes after the end of the text don't count.
        held = np.minimum(held, np.minimum(depth, n - np.maximum(at, other)))
        common[place[at]] = held
    return common


def equal_windows(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of their suffixes, and the number of the group of equal ``depth`` bytes that each is in."""
    order, place = suffix_array(text)
    number = np.cumsum(common_prefixes(text, order, place, depth) < depth) - 1
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    kept = wanted[order]
    return order[kept], number[kept]
