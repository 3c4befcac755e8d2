"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Suffixes are S (smaller than their right neighbour) or L. The leftmost S of each stretch (LMS) are sorted by
their substrings, which are named; where names repeat, the string of names is sorted by recursion. Two sweeps
over the buckets then induce the order of all L and all S suffixes. A sweep takes all entries up to the first
one that is still to come in one step; where that is few entries at a time, as in periodic texts, it goes entry
by entry.
"""

from __future__ import annotations

import numpy as np

#: A step over fewer entries than FEW goes entry by entry, for ALONE entries.
FEW, ALONE = 48, 512
#: Signs that are compared side by side before the rest of a pair is compared as a whole.
SIDE = 64


def classify(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; t ends with a unique smallest sign."""
    n = len(t)
    differs = np.flatnonzero(np.append(t[:-1] != t[1:], True))  # where a sign differs from its right neighbour
    up = np.append(t[differs[:-1]] < t[differs[:-1] + 1], True)
    return np.repeat(up, np.diff(differs, prepend=-1))[:n]


def lms_places(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(s[1:] & ~s[:-1]) + 1


def _push(out: np.ndarray, room: np.ndarray, signs: np.ndarray, suffixes: np.ndarray) -> None:
    """Put suffixes, in order, into their signs' buckets at `room`, which moves on."""
    order = np.argsort(signs, kind="stable")
    c = signs[order]
    new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    size = np.diff(new, append=len(c))
    c = c[new]
    out[np.repeat(room[c] - new, size) + np.arange(len(order))] = suffixes[order]
    room[c] += size


def _sweep(out: np.ndarray, room: np.ndarray, t: np.ndarray, take: np.ndarray) -> None:
    """Go through `out` from its start; each entry i puts i - 1, if `take` has it, into the bucket of its sign. Entries to come are -1."""
    n, k, most = len(out), 0, 256
    entry, free, sign, wanted = memoryview(out), memoryview(room), memoryview(t), memoryview(take)
    while k < n:
        part = out[k : k + most]
        hole = part < 0
        m = int(hole.argmax())
        if not m and not hole[0]:
            m = len(part)
        if m < FEW:
            stop = min(n, k + ALONE)
            while k < stop:
                i = entry[k] - 1
                if i >= 0 and wanted[i]:
                    c = sign[i]
                    entry[free[c]] = i
                    free[c] += 1
                k += 1
            continue
        p = part[:m]
        p = p[p > 0] - 1
        p = p[take[p]]
        if len(p):
            _push(out, room, t[p], p)
        k += m
        most = min(max(256, 2 * m), 1 << 17)


def induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes, from the LMS suffixes in `lms` order."""
    n, larger = len(t), ~s
    n_large = np.bincount(t[larger], minlength=len(sizes))
    n_lms = np.bincount(t[lms], minlength=len(sizes))
    # of each bucket the L suffixes, and behind them its LMS suffixes, which are known
    ends = np.cumsum(n_large + n_lms)
    first = np.full(int(ends[-1]), -1, np.int32)
    _push(first, ends - n_lms, t[lms], lms.astype(np.int32))
    room = ends - n_lms - n_large
    _sweep(first, room, t, larger)
    # of each bucket its L suffixes, and behind them all S suffixes; from the last to the first
    back, ends = np.full(n, -1, np.int32), np.cumsum(sizes)
    is_large = np.zeros(len(first), bool)
    starts = np.cumsum(n_large + n_lms) - n_large - n_lms
    has = np.flatnonzero(n_large)
    nth = np.arange(int(n_large.sum())) - np.repeat((np.cumsum(n_large) - n_large)[has], n_large[has])
    at = np.repeat(starts[has], n_large[has]) + nth
    is_large[at] = True
    back[n - 1 - (np.repeat((ends - sizes)[has], n_large[has]) + nth)] = first[is_large]
    back[n - 1] = n - 1
    _sweep(back, n - ends, t, s)
    return back[::-1]


def _same(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of `size` signs from a and from b are equal."""
    same, open_, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(open_) and k < SIDE:
        open_ = open_[k < size[open_]]
        ok = t[a[open_] + k] == t[b[open_] + k]
        same[open_[~ok]] = False
        open_, k = open_[ok], k + 1
    for i in open_.tolist():
        same[i] = np.array_equal(t[a[i] + k : a[i] + size[i]], t[b[i] + k : b[i] + size[i]])
    return same


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of t: non-negative signs, of which the last is a unique smallest 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    t = np.ascontiguousarray(t.astype(np.uint16 if t.max() < 1 << 16 else np.int32))  # numpy sorts 16 bits by radix
    s = classify(t)
    lms = lms_places(s)
    sizes = np.bincount(t)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = induce(t, s, lms, sizes)
    order = order[is_lms[order]]
    # names: equal neighbours in this order get one name
    length = np.zeros(n, np.int32)
    length[lms] = np.append(lms[1:], n - 1) - lms + 1
    a, b = order[:-1], order[1:]
    alike = np.flatnonzero(length[a] == length[b])
    same = np.zeros(len(a), bool)
    same[alike] = _same(t, a[alike], b[alike], length[a[alike]])
    names = np.zeros(n, np.int32)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    reduced = names[lms]
    order = lms[suffix_array(reduced)] if len(lms) and reduced.max() + 1 < len(lms) else order.astype(np.int64)
    return induce(t, s, order, sizes).astype(np.int64)


def _common(t: np.ndarray, a: int, b: int) -> int:
    """Length of the common prefix of two suffixes, in strides that double."""
    k, stride, n = 0, 256, len(t) - max(a, b)
    while k < n:
        x, y = t[a + k : a + min(k + stride, n)], t[b + k : b + min(k + stride, n)]
        differs = x != y
        at = int(differs.argmax())
        if differs[at]:
            return k + at
        k, stride = k + len(x), stride * 2
    return n


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the place of the suffix before its own in order (-1: none), and their common prefix's length.

    Only where the signs to the left of the two differ is a prefix compared; elsewhere it is one shorter than
    its left neighbour's.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    ok = before >= 0
    plain = np.ones(n, bool)
    i = np.flatnonzero(ok[1:]) + 1
    plain[i] = (before[i] == 0) | (t[i - 1] != t[np.maximum(before[i] - 1, 0)]) | ~ok[i - 1]
    size = np.zeros(n, np.int64)
    open_, k = np.flatnonzero(plain & ok), 0
    while len(open_) and k < SIDE:
        a, b = open_ + k, before[open_] + k
        inside = (a < n) & (b < n)
        open_, a, b = open_[inside], a[inside], b[inside]
        open_ = open_[t[a] == t[b]]
        size[open_] += 1
        k += 1
    for i in open_.tolist():
        size[i] = k + _common(t, i + k, int(before[i]) + k)
    last = np.maximum.accumulate(np.where(plain, np.arange(n), 0))
    size = np.where(plain, size, size[last] - (np.arange(n) - last))
    return before, np.maximum(size, 0)
