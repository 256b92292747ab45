"""Repeats of a fixed length in a text, by threshold-bounded interval expansion on its Burrows-Wheeler transform.

Suffixes are sorted by their first characters, up to the power of two that reaches the length. From the transform, common
prefixes of neighbours in that order are then derived by increasing value: an interval of suffixes that share a prefix is
extended backward by each character before it, all intervals of one depth together; where an image's right end has no value
yet, it gets the depth, and the image waits for the next depth. No depth beyond the length is visited: neighbours without a
value by then share a prefix of at least the length.
"""

from __future__ import annotations

import numpy as np

#: Characters that the first sort compares at once; the expansion starts at this depth.
FIRST = 8


def sorted_suffixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes of the circular text in order of their first `length` or more characters, their first FIRST characters as numbers)."""
    n = len(text)
    head = np.zeros(n, np.uint64)
    ring = np.concatenate([text, np.resize(text, FIRST)]).astype(np.uint64)
    for k in range(FIRST):
        head = head << np.uint64(8) | ring[k : k + n]
    order = np.argsort(head)
    first = head[order]
    rank = np.empty(n, np.int64)
    new = np.empty(n, bool)
    new[0], new[1:] = False, first[1:] != first[:-1]
    rank[order] = np.cumsum(new)
    h = FIRST
    while h < length and int(rank.max()) < n - 1:
        key = rank << 32 | np.roll(rank, -(h % n))
        order = np.argsort(key)
        key = key[order]
        new[1:] = key[1:] != key[:-1]
        rank[order] = np.cumsum(new)
        h *= 2
    return order, first


def common_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, common prefix with the suffix before it: its length if less than `length`, else -1)."""
    n = len(text)
    order, first = sorted_suffixes(text, length)
    lcp = np.full(n + 1, -1, np.int32)
    lcp[0] = lcp[n] = 0
    differ = first[1:] ^ first[:-1]
    for k in range(min(FIRST, length)):
        lcp[1:n][(lcp[1:n] < 0) & (differ >> np.uint64(8 * (FIRST - 1 - k)) != 0)] = k
    if length <= FIRST:
        return order, lcp[:n]
    bwt = text[order - 1]
    by_char = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # where a suffix goes when the character before it is put in front
    step[by_char] = np.arange(n)
    # intervals of depth FIRST whose right end has got FIRST - 1
    edges = np.flatnonzero(lcp[: n + 1] >= 0)
    at = np.flatnonzero(lcp[edges] == FIRST - 1)
    at = at[(at > 0) & (edges[at] < n)]
    left, right = edges[at - 1], edges[at]
    for depth in range(FIRST, length):
        if not len(left):
            break
        size = right - left
        interval = np.repeat(np.arange(len(left)), size)
        place = left[interval] + np.arange(len(interval)) - np.repeat(np.cumsum(size) - size, size)
        image = step[place]
        by_image = np.argsort(image)
        image, owner, char = image[by_image], interval[by_image], bwt[place[by_image]]
        ends = np.ones(len(image), bool)
        ends[:-1] = (owner[1:] != owner[:-1]) | (char[1:] != char[:-1])
        starts = np.ones(len(image), bool)
        starts[1:] = ends[:-1]
        left, right = image[starts], image[ends] + 1
        free = lcp[right] < 0
        left, right = left[free], right[free]
        lcp[right] = depth
    return order, lcp[:n]


def repeated(payloads: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """Of each payload, the starts of strings of `length` that occur twice or more, an occurrence counting its payload's weight."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.frombuffer(b"\xff".join(payloads) + b"\xff", np.uint8)  # a byte that UTF-8 text never has
    order, lcp = common_prefixes(text, length)
    classes = np.cumsum(lcp >= 0)
    of = np.empty(len(text), np.int64)
    of[order] = classes
    whose = np.repeat(np.arange(len(payloads)), sizes + 1)
    inside = np.arange(len(text)) - first[whose] + length <= sizes[whose]
    total = np.bincount(of[inside], weights[whose[inside]], int(classes[-1]) + 1)
    twice = inside & (total[of] >= 2)
    return [np.flatnonzero(twice[a : a + n]) for a, n in zip(first[:-1].tolist(), sizes.tolist(), strict=True)]
