"""Suffix arrays of byte strings by induced sorting, in numpy, and their permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Largest symbol for which suffixes are induced, a bucket for each; strings of names beyond that are sorted by doubling.
SYMBOLS = 1024


def _smaller(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (S); the last one, a sentinel of its own, is."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    if not len(differs):
        return np.ones(n, bool)
    at = differs[np.minimum(np.searchsorted(differs, np.arange(n - 1)), len(differs) - 1)]
    return np.r_[t[at] < t[at + 1], True]


def _append(sa: np.ndarray, ends: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Puts suffixes, in order, at the ends of their symbols' buckets, which grow up or down."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")  # sorted by digits
    symbols = symbols[order]
    first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
    size = np.diff(np.r_[first, len(symbols)])
    within = np.arange(len(symbols)) - np.repeat(first, size)
    own = symbols[first]
    sa[np.repeat(ends[own], size) + step * within] = suffixes[order]
    ends[own] += step * size


def _induced(t: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array, given the leftmost smaller suffixes in order: first the larger ones from the left, then the smaller ones from the right."""
    starts, stops = np.r_[0, np.cumsum(sizes)[:-1]], np.cumsum(sizes)
    sa = np.full(len(t), -1, np.int32)
    tails = stops - 1
    _append(sa, tails, t[leftmost[::-1]], leftmost[::-1], -1)
    used = np.flatnonzero(sizes)
    heads = starts.copy()
    for c in used:
        fresh = sa[starts[c] : heads[c]]
        while len(fresh):  # suffixes that begin with a run of the symbol
            before = fresh[fresh > 0] - 1
            before = before[(t[before] == c) & ~smaller[before]]
            sa[heads[c] : heads[c] + len(before)] = before
            heads[c] += len(before)
            fresh = before
        scan = np.r_[sa[starts[c] : heads[c]], sa[tails[c] + 1 : stops[c]]]
        before = scan[scan > 0] - 1
        before = before[t[before] > c]
        if len(before):
            _append(sa, heads, t[before], before, 1)
    tails = stops - 1
    for c in used[::-1]:
        if c == t[-1]:  # the sentinel alone
            sa[starts[c]] = len(t) - 1
            continue
        fresh = sa[tails[c] + 1 : stops[c]][::-1]
        while len(fresh):
            before = fresh[fresh > 0] - 1
            before = before[(t[before] == c) & smaller[before]]
            sa[tails[c] - len(before) + 1 : tails[c] + 1] = before[::-1]
            tails[c] -= len(before)
            fresh = before
        scan = np.r_[sa[tails[c] + 1 : stops[c]][::-1], sa[starts[c] : heads[c]][::-1]]
        before = scan[scan > 0] - 1
        before = before[t[before] < c]
        if len(before):
            _append(sa, tails, t[before], before, -1)
    return sa


def _doubled(t: np.ndarray) -> np.ndarray:
    """The suffix array of a string of many symbols: groups of equal prefixes are split by the ranks behind the prefix, which doubles."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    first = np.flatnonzero(np.r_[True, t[order][1:] != t[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    done, width = order.copy(), 1
    sizes = np.diff(np.r_[first, n])
    open_ = order[np.repeat(sizes > 1, sizes)]
    while len(open_):
        behind = np.where(open_ + width < n, rank[np.minimum(open_ + width, n - 1)], -1)
        by = np.lexsort((behind, rank[open_]))
        open_, behind = open_[by], behind[by]
        group = rank[open_]
        old = np.r_[True, group[1:] != group[:-1]]
        new = np.flatnonzero(old | np.r_[True, behind[1:] != behind[:-1]])
        sizes = np.diff(np.r_[new, len(open_)])
        start = np.flatnonzero(old)
        into = np.arange(len(open_)) - np.repeat(start, np.diff(np.r_[start, len(open_)]))
        done[group + into] = open_
        rank[open_] = np.repeat((group + into)[new], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        width *= 2
    return done


def lanes_of(t: np.ndarray) -> np.ndarray:
    """Eight bytes from every place on, as one number."""
    return np.ndarray((len(t),), "<u8", np.r_[t, np.zeros(8, np.uint8)].tobytes(), strides=(1,))


def common(t: np.ndarray, lanes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Lengths of the common prefixes of suffixes of a byte string; ``most`` ends the comparison."""
    n, length = len(t), np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        differ = lanes[x] ^ lanes[y]
        equal = differ == 0
        lowest = differ[~equal] & (~differ[~equal] + np.uint64(1))
        length[live[~equal]] += np.log2(lowest.astype(np.float64)).astype(np.int64) // 8
        length[live[equal]] += 8
        live = live[equal]
        if most is not None:
            live = live[length[live] < most[live]]
    bound = n - np.maximum(a, b)
    return np.minimum(length, bound if most is None else np.minimum(bound, most))


def suffix_array(t: np.ndarray, lanes: np.ndarray | None = None) -> np.ndarray:
    """The order of all suffixes of ``t``, whose last symbol is less than every other.

    Suffixes are classified as smaller or larger than the next one.  The
    substrings between leftmost smaller ones are sorted by inducing, named by
    rank, and the string of names is sorted the same way if some are equal; the
    order of its suffixes then induces that of all.
    """
    if len(t) < 3:
        return np.arange(len(t))[::-1].astype(np.int64)
    if int(t.max()) > SYMBOLS:
        return _doubled(t)
    smaller = _smaller(t)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sizes = np.bincount(t, minlength=int(t.max()) + 1)
    sa = _induced(t, smaller, leftmost, sizes)
    is_leftmost = np.zeros(len(t), bool)
    is_leftmost[leftmost] = True
    ranked = sa[is_leftmost[sa]].astype(np.int64)
    length = np.zeros(len(t), np.int64)
    length[leftmost] = np.diff(np.r_[leftmost, len(t) - 1]) + 1
    a, b = ranked[:-1], ranked[1:]
    same = length[a] == length[b]
    if t.dtype == np.uint8:
        lanes = lanes_of(t) if lanes is None else lanes
        same[same] = common(t, lanes, a[same], b[same], length[a[same]]) >= length[a[same]]
    else:
        live, k = np.flatnonzero(same), 0
        while len(live):
            live = live[length[a[live]] > k]
            equal = t[a[live] + k] == t[b[live] + k]
            same[live[~equal]] = False
            live, k = live[equal], k + 1
    names = np.cumsum(np.r_[0, ~same])
    if names[-1] + 1 < len(ranked):
        name_at = np.zeros(len(t), np.int64)
        name_at[ranked] = names
        ranked = leftmost[suffix_array(name_at[leftmost])]
    return _induced(t, smaller, ranked, sizes).astype(np.int64)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, lanes: np.ndarray | None = None) -> np.ndarray:
    """For each place of a byte string how much its suffix has in common with the one before it in the suffix array.

    Where the symbol before both is the same, that is one less than at the place
    before; only the others are compared.
    """
    lanes = lanes_of(t) if lanes is None else lanes
    before = np.full(len(t), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(len(t))
    carried = (before > 0) & (place > 0)
    carried[1:] &= t[:-1] == t[before[1:] - 1]
    # the one before must be the one before this, moved on
    carried[1:] &= before[:-1] >= 0
    compared = np.flatnonzero(~carried & (before >= 0))
    out = np.zeros(len(t), np.int64)
    out[compared] = common(t, lanes, compared, before[compared])
    last = np.maximum.accumulate(np.where(~carried, place, -1))
    return np.where(carried, np.maximum(out[last] - (place - last), 0), out)
