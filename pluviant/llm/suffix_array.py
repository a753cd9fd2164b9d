"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

The passes that induce an order run over runs of the array at a time. A run may be taken at once as long as nothing it
induces falls into the run itself; it is cut where that would happen, so the order is the same as one entry at a time.
"""

from __future__ import annotations

import numpy as np

#: Longest run of entries induced at once.
RUN = 1 << 16
#: Reduced strings of at most this many symbols end the recursion (17 bits: two ranks and a place fit in 64).
BASE = 1 << 17


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last one counts as smaller."""
    n = len(s)
    at = np.arange(n)
    at[:-1][s[:-1] == s[1:]] = n
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place whose symbol differs from its successor's
    out = np.ones(n, bool)
    out[:-1] = (at[:-1] >= n - 1) | (s[at[:-1]] < s[np.minimum(at[:-1] + 1, n - 1)])
    return out


def _stable_order(c: np.ndarray) -> np.ndarray:
    """Order of at most RUN symbols, equal ones as they stand: by radix if they are short, else by symbol and place."""
    if c.dtype.itemsize <= 2:
        return np.argsort(c, kind="stable")
    return np.sort(c.astype(np.int64) << 16 | np.arange(len(c))) & 0xFFFF


def _induce(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, free: np.ndarray, up: bool) -> None:
    """Put before each entry's suffix the one that begins one symbol earlier, if it is wanted, at its symbol's next free
    place: ascending from bucket heads (up), or descending from the last places of buckets."""
    n, run, done = len(sa), 1024, 0
    while done < n:
        stop = min(n, done + run)
        v = sa[done:stop] if up else sa[n - stop : n - done][::-1]
        k = np.flatnonzero(v > 0)
        j = v[k] - 1
        m = wanted[j]
        k, j = k[m], j[m]
        cut = stop
        if len(j):
            c = s[j]
            to = free[c] if up else n - 1 - free[c]
            first = int(to.min())
            if first < stop:
                cut = first
                m = k < cut - done
                j, c = j[m], c[m]
            if len(j) == 1:
                sa[free[c[0]]] = j[0]
                free[c[0]] += 1 if up else -1
            elif len(j):
                order = _stable_order(c)
                c, j = c[order], j[order]
                head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                count = np.diff(np.append(head, len(c)))
                own = c[head]
                start = free[own]
                at = np.arange(len(c))
                sa[np.repeat(start - head, count) + at if up else np.repeat(start + head, count) - at] = j
                free[own] = start + count if up else start - count
        run = min(RUN, run * 2) if cut == stop else max(64, 2 * (cut - done))
        done = cut


def _sorted_by(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The order induced by `seeds`, leftmost-smaller suffixes in the order that they have inside buckets."""
    n = len(s)
    sa = np.full(n, -1, np.int32)
    ends = np.cumsum(counts)
    c = s[seeds]
    order = np.argsort(c, kind="stable")
    c = c[order]
    head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    size = np.diff(np.append(head, len(c)))
    sa[np.repeat(ends[c[head]] - size, size) + np.arange(len(c)) - np.repeat(head, size)] = seeds[order]
    _induce(sa, s, ~smaller, ends - counts, True)
    sa[1:][(sa[1:] >= 0) & smaller[sa[1:]]] = -1
    _induce(sa, s, smaller, ends - 1, False)
    sa[0] = n - 1
    return sa


def ordered_names(s: np.ndarray) -> np.ndarray:
    """The recursion's end: suffixes of a short reduced string, by ranks of 1, 2, 4, ... symbols. Only suffixes whose rank
    others share are compared again; a rank is the first place that those who share it may take."""
    n = len(s)
    bits = n.bit_length()
    low = (1 << bits) - 1
    rank = np.zeros(n + 1, np.int64)
    key = np.sort(s.astype(np.int64) << bits | np.arange(n))
    live, old, reach = key & low, key >> bits, 1
    first = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
    rank[live] = np.repeat(first, np.diff(np.append(first, n)))
    size = np.diff(np.append(first, n))
    live = live[np.repeat(size, size) > 1]
    while len(live):
        # Beyond the end lies the least suffix of all; places there are never compared, since the last symbol is unique.
        key = np.sort((rank[live] << bits | rank[np.minimum(live + reach, n)]) << bits | live)
        live, pair = key & low, key >> bits
        head = pair >> bits
        at = np.arange(len(live))
        start = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        start = np.repeat(start, np.diff(np.append(start, len(live))))
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        size = np.diff(np.append(first, len(live)))
        rank[live] = head + np.repeat(at[first], size) - start
        live = live[np.repeat(size, size) > 1]
        reach *= 2
    sa = np.empty(n, np.int32)
    sa[rank[:n]] = np.arange(n, dtype=np.int32)
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of `s` in order. Its last symbol must be 0 and the only 0."""
    s = s if s.dtype == np.uint16 else np.asarray(s, np.int32)
    n = len(s)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    smaller = suffix_types(s)
    counts = np.bincount(s)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    sa = _sorted_by(s, smaller, leftmost, counts)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    sub = sa[is_leftmost[sa]]
    nth = np.empty(n, np.int32)
    nth[leftmost] = np.arange(len(leftmost), dtype=np.int32)
    length = np.append(np.diff(leftmost), 0).astype(np.int32)[nth[sub]]
    same = (length[1:] == length[:-1]) & (length[1:] > 0)
    live = np.flatnonzero(same)
    for d in range(65):
        if not len(live):
            break
        live = live[length[live] >= d]
        differ = s[sub[live] + d] != s[sub[live + 1] + d]
        same[live[differ]] = False
        live = live[~differ]
    for k in live:
        a, b, m = sub[k], sub[k + 1], length[k] + 1
        same[k] = np.array_equal(s[a : a + m], s[b : b + m])
    name = np.concatenate([[0], np.cumsum(~same)]).astype(np.int32)
    if name[-1] + 1 < len(sub):
        reduced = np.empty(len(sub), np.int32 if name[-1] >= 1 << 16 else np.uint16)
        reduced[nth[sub]] = name
        sub = leftmost[ordered_names(reduced) if len(reduced) <= BASE else suffix_array(reduced)]
    return _sorted_by(s, smaller, sub, counts)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of `s`, in text order, the symbols that its suffix shares with the one before it in the array.

    The value of a place is one less than the place's before unless the symbols before the two suffixes differ, so only
    those places are compared.
    """
    n = len(s)
    s = np.concatenate([np.asarray(s, np.uint16), np.zeros(4, np.uint16)])
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.flatnonzero(before >= 0)
    at = at[(at == 0) | (before[at] == 0) | (s[at - 1] != s[before[at] - 1])]
    four = np.ndarray((n,), np.uint64, s, 0, (2,))
    share = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for _ in range(64):
        a, b = at[live] + share[live], before[at[live]] + share[live]
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        live = live[four[a] == four[b]]
        if not len(live):
            break
        share[live] += 4
    for k in live:
        while True:
            a, b = at[k] + share[k], before[at[k]] + share[k]
            m = min(4096, n - max(a, b))
            if m <= 0:
                break
            differ = s[a : a + m] != s[b : b + m]
            if differ.any():
                share[k] += int(differ.argmax())
                break
            share[k] += m
    # The places compared four at a time end up to three symbols later.
    for _ in range(3):
        a, b = at + share, before[at] + share
        ok = (a < n) & (b < n)
        ok[ok] = s[a[ok]] == s[b[ok]]
        if not ok.any():
            break
        share[ok] += 1
    lcp = np.zeros(n, np.int64)
    known = np.full(n, -1, np.int64)
    known[at] = at
    last = np.maximum.accumulate(known)
    full = np.zeros(n, np.int64)
    full[at] = share
    ok = last >= 0
    lcp[ok] = np.maximum(full[last[ok]] - (np.arange(n)[ok] - last[ok]), 0)
    lcp[sa[0]] = 0
    return lcp
