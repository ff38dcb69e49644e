"""Suffix arrays by induced sorting, vectorised over buckets.

``suffix_array`` is the textbook scheme: classify suffixes (S or L), sort the leftmost-smaller (LMS) substrings by
inducing, name them, solve the reduced string recursively, and induce the whole order from that of the
LMS suffixes. Inducing walks the buckets of the alphabet; what a bucket induces is computed for all of its entries
at once, in waves where a bucket feeds itself. A reduced string has far more symbols than a bucket walk
is good for, so the recursion's levels below the first rank by doubling instead, which gives the same order.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type. ``t`` ends in a sentinel smaller than all else."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    step[-1] = 1
    # a run of equal symbols has the type of its last one
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _append(sa: np.ndarray, heads: np.ndarray, symbols: np.ndarray, entries: np.ndarray, direction: int) -> None:
    """Put entries, in order, at their buckets' ends (direction 1) or, in reverse, at their fronts (-1)."""
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=len(heads))
    first = np.cumsum(counts) - counts
    ranked = symbols[order]
    place = np.arange(len(order)) - first[ranked]
    if direction > 0:
        sa[heads[ranked] + place] = entries[order]
        heads += counts
    else:
        sa[heads[ranked] - 1 - place] = entries[order]
        heads -= counts


def induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, n_symbols: int) -> np.ndarray:
    """The suffix order induced from LMS suffixes given in order (or their substrings' order)."""
    n = len(t)
    counts = np.bincount(t, minlength=n_symbols)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int64)
    # LMS suffixes at their buckets' ends, in the given order
    tails = ends.copy()
    _append(sa, tails, t[lms[::-1]], lms[::-1], -1)
    lms_from = tails.copy()
    heads = starts.copy()
    used = np.flatnonzero(counts).tolist()

    def feed(block: np.ndarray, want_s: bool, pointers: np.ndarray, direction: int) -> None:
        before = block - 1
        before = before[(before >= 0)]
        before = before[s_type[before] == want_s]
        if len(before):
            _append(sa, pointers, t[before], before, direction)

    for c in used:
        at = starts[c]
        while at < heads[c]:
            upto = heads[c]
            feed(sa[at:upto], False, heads, 1)
            at = upto
        feed(sa[lms_from[c] : ends[c]], False, heads, 1)
    l_upto = heads
    # S-type suffixes are placed anew from the right; the LMS entries are overwritten in their true places
    tails = ends.copy()
    for c in reversed(used):
        at = ends[c]
        while at > tails[c]:
            upto = tails[c]
            feed(sa[upto:at][::-1], True, tails, -1)
            at = upto
        feed(sa[starts[c] : l_upto[c]][::-1], True, tails, -1)
    # the sentinel, which nothing induces
    sa[0] = n - 1
    return sa


def _name(t: np.ndarray, ordered: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers of the LMS substrings in order: equal ones share one. ``lengths`` belongs to ``ordered``."""
    new = np.ones(len(ordered), bool)
    if len(ordered) > 1:
        a, b, la = ordered[1:], ordered[:-1], lengths[1:]
        same_length = np.flatnonzero(la == lengths[:-1])
        if len(same_length):
            a, b, la = a[same_length], b[same_length], la[same_length]
            first = np.cumsum(la) - la
            offset = np.arange(int(la.sum())) - np.repeat(first, la)
            equal = t[np.repeat(a, la) + offset] == t[np.repeat(b, la) + offset]
            new[1:][same_length] = ~np.logical_and.reduceat(equal, first)
    return np.cumsum(new) - 1


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of small non-negative integers by rank doubling."""
    n = len(names)
    rank, width = names.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = rank[width:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2
        if n == 0 or new[-1] == n - 1 or width >= n:
            return order


def suffix_array(t: np.ndarray, n_symbols: int) -> np.ndarray:
    """Order of all suffixes of ``t``, whose last symbol is 0 and occurs only there."""
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    s_type = classify(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms)
    rough = induce(t, s_type, lms, n_symbols)
    ordered = rough[is_lms[rough]]
    length_of = np.ones(n, np.int64)
    length_of[lms[:-1]] = np.diff(lms) + 1
    names = _name(t, ordered, length_of[ordered])
    if names[-1] < len(ordered) - 1:
        number = np.empty(n, np.int64)
        number[ordered] = names
        ordered = lms[doubled(number[lms])]
    return induce(t, s_type, ordered, n_symbols)


def repeats(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` bytes within segments, grouped by content.

    ``data`` holds the segments [starts[i], starts[i] + lengths[i]) with a gap of at least one byte after each.
    Returns (positions, group): window positions in suffix order and the number of each one's group.
    The permuted common prefixes are tested in text order against each suffix's predecessor: equal in
    ``length`` bytes or not, eight bytes at a time."""
    n = len(data)
    t = data.astype(np.uint16) + 2
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lengths, -1)
    t[np.cumsum(inside[:-1]) == 0] = 1
    t = np.append(t, np.uint16(0))
    opens = np.zeros(n + 1, np.int32)
    fits = lengths >= length
    np.add.at(opens, starts[fits], 1)
    np.add.at(opens, (starts + lengths - length + 1)[fits], -1)
    window = np.append(np.cumsum(opens[:-1]) > 0, False)
    order = suffix_array(t, 258)
    order = order[window[order]]
    if not len(order):
        return order, order
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    padded = data.tobytes() + bytes(8)
    words = np.ndarray((n + 1,), "<u8", buffer=padded, strides=(1,))
    alike = np.zeros(n + 1, bool)
    for j in sorted({*range(0, length - 7, 8), max(length - 8, 0)}):
        at = at[words[at + j] == words[before[at] + j]]
    alike[at] = True
    return order, np.cumsum(~alike[order]) - 1
