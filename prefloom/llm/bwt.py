"""Repeated substrings of a block of strings, by interval expansion on a Burrows-Wheeler transform.

Small numeric helper of :mod:`prefloom.llm.suffixes`; a block is a few megabytes at most.
"""

from __future__ import annotations

import numpy as np

PACKED = 7  # symbols of 9 bits in the first sort key
WIDE = 96  # intervals from this width on are split by symbol with binary searches


def suffix_order(symbols: np.ndarray, to_end: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols or more.

    Symbol 0 ends a string. Every end counts as a symbol of its own, in order of place, so a
    suffix that reaches one within the compared part is told apart from all others. ``to_end``
    is the distance to the string's end.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(PACKED, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(PACKED):
        key = (key << 9) | np.where(to_end >= i, padded[i:n + i], 0)
    order = np.argsort(key, kind="stable")
    key, ends = key[order], to_end[order] < PACKED
    start = np.ones(n, bool)
    start[1:] = (key[1:] != key[:-1]) | ends[1:]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, slots, 0))
    k = PACKED
    while k < depth:
        alone = start & np.append(start[1:], True)
        slots, sub = slots[~alone], order[slots[~alone]]
        if not len(slots):
            break
        key = (rank[sub] << 32) | rank[sub + k]
        by = np.argsort(key, kind="stable")
        key, sub = key[by], sub[by]
        order[slots] = sub
        start = np.ones(len(slots), bool)
        start[1:] = (key[1:] != key[:-1]) | (to_end[sub[1:]] < 2 * k)
        rank[sub] = np.maximum.accumulate(np.where(start, slots, 0))
        k *= 2
    return order


def repeated(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which places start a substring of ``length`` that starts elsewhere too.

    Intervals of suffixes that share a prefix are extended backward, breadth first, from
    the empty prefix. An extension by a symbol whose right border is not set yet sets the common
    prefix there to the current value; values come in increasing order, so the first is right. The
    search stops at ``length``: borders never set have common prefixes of that length or more.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    total = int(sizes.sum()) + len(strings)
    symbols = np.zeros(total, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    body = np.ones(total, bool)
    body[ends] = False
    symbols[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    to_end = np.repeat(ends, sizes + 1) - np.arange(total)
    order = suffix_order(symbols, to_end, length + 1)

    last = symbols[order - 1]
    by = np.argsort(last, kind="stable")
    first = np.zeros(258, np.int64)
    first[1:] = np.cumsum(np.bincount(symbols, minlength=257))
    step = np.empty(total, np.int64)
    step[by] = np.arange(total)
    places = {c: by[first[c]:first[c + 1]] for c in range(1, 257) if first[c + 1] > first[c]}

    known = np.zeros(total + 1, bool)
    known[[0, total]] = True
    lows = np.array([*range(len(strings)), *(first[c] for c in places)], np.int64)
    highs = np.array([*range(len(strings)), *(first[c + 1] - 1 for c in places)], np.int64)
    known[highs + 1] = True
    for _ in range(1, length):
        if not len(lows):
            break
        width = highs - lows + 1
        new_lows, new_highs = [], []
        single = width == 1
        at = lows[single]
        at = step[at[last[at] > 0]]
        new_lows.append(at)
        new_highs.append(at)
        narrow = ~single & (width < WIDE)
        if narrow.any():
            low, w = lows[narrow], width[narrow]
            owner = np.repeat(np.arange(len(low)), w)
            at = np.arange(int(w.sum())) + np.repeat(low - (np.cumsum(w) - w), w)
            key = owner * 512 + last[at]
            sort = np.argsort(key, kind="stable")
            key, at = key[sort], at[sort]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            use = key[edge[:-1]] % 512 > 0
            new_lows.append(step[at[edge[:-1][use]]])
            new_highs.append(step[at[edge[1:][use] - 1]])
        wide = width >= WIDE
        if wide.any():
            low, high = lows[wide], highs[wide] + 1
            for c, where in places.items():
                a, b = np.searchsorted(where, low), np.searchsorted(where, high)
                use = b > a
                new_lows.append(first[c] + a[use])
                new_highs.append(first[c] + b[use] - 1)
        lows, highs = np.concatenate(new_lows), np.concatenate(new_highs)
        fresh = ~known[highs + 1]
        lows, highs = lows[fresh], highs[fresh]
        known[highs + 1] = True
    again = np.empty(total, bool)
    again[order] = ~known[:-1] | ~known[1:]
    return [again[e - s:e] for s, e in zip(sizes, ends)]
