"""Suffix arrays by induced sorting and permuted longest common prefixes, in whole-array steps.

The scans that induce suffixes run over ranges of buckets: a range ends before the first
bucket that one of its own suffixes would be induced into, so all suffixes of a range are
final when it is read and one vector step places everything it induces. A bucket that feeds
itself (equal neighbours) is worked off in rounds. The problem reduced to leftmost-smaller
substrings is sorted by the same procedure, recursively.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the end counts as the smallest symbol."""
    n = len(text)
    smaller = np.zeros(n, bool)
    if n > 1:
        differs = text[:-1] != text[1:]
        where = np.where(differs, np.arange(n - 1), n - 1)
        nxt = np.minimum.accumulate(where[::-1])[::-1]
        less = np.append(text[:-1] < text[1:], False)
        smaller[:-1] = less[nxt]
    return smaller


def suffix_array(text: np.ndarray, size: int | None = None) -> np.ndarray:
    """Start positions of the suffixes of ``text`` (integers from 0 to ``size`` - 1) in ascending order."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    size = int(text.max()) + 1 if size is None else size
    text = np.ascontiguousarray(text, np.uint16 if size <= 65536 else np.int32)  # short symbols sort by radix
    small = classify(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if len(lms) < 2:
        return _induce(text, size, small, lms)
    sa = _induce(text, size, small, lms[np.argsort(text[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    del sa
    length = np.zeros(n, np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = n + 1  # ends with the text; equal to no other
    new = _differs(text, order, length)
    names = np.zeros(n, np.int32)
    names[order] = np.cumsum(new, dtype=np.int32) - 1
    reduced = names[lms]
    count = int(reduced.max()) + 1
    if count < len(lms):
        ranked = suffix_array(reduced, count)
    else:
        ranked = np.empty(len(lms), np.int32)
        ranked[reduced] = np.arange(len(lms), dtype=np.int32)
    return _induce(text, size, small, lms[ranked])


def _differs(text: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each substring of ``order`` differs from the one before it."""
    new = np.ones(len(order), bool)
    pair = np.flatnonzero(length[order[1:]] == length[order[:-1]]) + 1
    a, b, left, k = order[pair], order[pair - 1], length[order[pair]], 0
    while len(pair):
        same = text[a + k] == text[b + k]
        pair, a, b, left = pair[same], a[same], b[same], left[same]
        k += 1
        over = left == k
        if over.any():
            new[pair[over]] = False
            go = ~over
            pair, a, b, left = pair[go], a[go], b[go], left[go]
    return new


def _place(sa: np.ndarray, at: np.ndarray, targets: np.ndarray, values: np.ndarray, step: int) -> None:
    """Put ``values`` into their buckets one after another from ``at`` on, which moves by ``step``."""
    n = len(values)
    if n <= 6:
        for t, v in zip(targets.tolist(), values.tolist(), strict=True):
            i = at[t]
            sa[i] = v
            at[t] = i + step
        return
    order = targets.argsort(kind="stable")
    t = targets[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(t[1:], t[:-1], out=new[1:])
    head = new.nonzero()[0]
    slots = at[t[head]]
    if len(head) == n:
        sa[slots] = values[order]
        at[t] = slots + step
        return
    count = np.empty(len(head), np.int64)
    np.subtract(head[1:], head[:-1], out=count[:-1])
    count[-1] = n - head[-1]
    sa[np.repeat(slots - step * head, count) + step * np.arange(n)] = values[order]
    at[t[head]] = slots + step * count


def _induce(text: np.ndarray, size: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix order induced from leftmost-smaller suffixes given in order."""
    n = len(text)
    ends = np.cumsum(np.bincount(text, minlength=size)).astype(np.int64)
    begins = np.append(0, ends[:-1])
    sa = np.full(n, -1, np.int32)
    tail = ends - np.bincount(text[lms], minlength=size) if len(lms) else ends.copy()
    seeds = tail.copy()
    if len(lms):
        _place(sa, seeds, text[lms], lms, 1)
    # larger suffixes, from left to right
    head = begins.copy()
    last = text[n - 1]
    sa[head[last]] = n - 1
    head[last] += 1
    c, width = 0, 1
    while c < size:
        top = min(size, c + width)
        got = sa[begins[c] : ends[top - 1]]
        j = got[got > 0] - 1
        j = j[~small[j]]
        t = text[j]
        least = int(t.min()) if len(t) else size
        if least >= top:
            if len(j):
                _place(sa, head, t, j, 1)
            c, width = top, width * 2
        elif least > c:
            keep = text[j + 1] < least
            if keep.any():
                _place(sa, head, t[keep], j[keep], 1)
            width = max(1, (least - c) * 2)
            c = least
        else:
            done = begins[c]
            while done < head[c]:
                j = sa[done : head[c]]
                done = int(head[c])
                j = j[j > 0] - 1
                j = j[~small[j]]
                if len(j):
                    _place(sa, head, text[j], j, 1)
            j = sa[tail[c] : ends[c]]
            j = j[j > 0] - 1
            j = j[~small[j]]
            if len(j):
                _place(sa, head, text[j], j, 1)
            c, width = c + 1, 1
    # smaller suffixes, from right to left; the seeds are found again
    slots = np.arange(n)
    seeded = np.zeros(n, bool)
    if len(lms):
        cnt = ends - tail
        some = np.flatnonzero(cnt)
        seeded[np.repeat(tail[some] - np.append(0, np.cumsum(cnt[some])[:-1]), cnt[some]) + np.arange(len(lms))] = True
    sa[seeded] = -1
    del slots, seeded
    back = ends - 1
    c, width = size, 1
    while c > 0:
        low = max(0, c - width)
        got = sa[begins[low] : ends[c - 1]][::-1]
        j = got[got > 0] - 1
        j = j[small[j]]
        t = text[j]
        most = int(t.max()) if len(t) else -1
        if most < low:
            if len(j):
                _place(sa, back, t, j, -1)
            c, width = low, width * 2
        elif most < c - 1:
            keep = text[j + 1] > most
            if keep.any():
                _place(sa, back, t[keep], j[keep], -1)
            width = max(1, (c - 1 - most) * 2)
            c = most + 1
        else:
            b = c - 1
            done = int(ends[b]) - 1
            while done > back[b]:
                j = sa[back[b] + 1 : done + 1][::-1]
                done = int(back[b])
                j = j[j > 0] - 1
                j = j[small[j]]
                if len(j):
                    _place(sa, back, text[j], j, -1)
            j = sa[begins[b] : head[b]][::-1]
            j = j[j > 0] - 1
            j = j[small[j]]
            if len(j):
                _place(sa, back, text[j], j, -1)
            c, width = b, 1
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the prefix each suffix shares with the one before it in ``sa``, by text position.

    Only where the two preceding symbols differ is it compared; from there on it falls by one
    with every position."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32)
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    here = np.arange(n, dtype=np.int32)
    start = (here == 0) | (before <= 0)
    start[1:] |= text[:-1] != text[np.maximum(before[1:], 1) - 1]
    at = np.flatnonzero(start)
    value = np.zeros(n, np.int64)
    i, p, k = at[before[at] >= 0], before[at][before[at] >= 0].astype(np.int64), 0
    while len(i):
        ok = np.maximum(i, p) + k < n
        same = np.zeros(len(i), bool)
        same[ok] = text[i[ok] + k] == text[p[ok] + k]
        value[i[~same]] = k
        i, p = i[same], p[same]
        k += 1
    run = np.cumsum(start) - 1
    return (value[at][run] - (here - at[run])).astype(np.int32)
