"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are S (smaller than the next) or L. The leftmost S of each run, LMS for short, are put in
order by sorting the substrings between them, by induction, and recursively where equal ones leave
it open; then all L and after them all S suffixes are induced from them in one scan each. Over
bytes a scan goes bucket by bucket, with all that a bucket already holds at once; over the names of
a deeper level, where buckets are small, it goes suffix by suffix.
"""

from __future__ import annotations

import numpy as np

#: Buckets below this many suffixes on average are scanned suffix by suffix.
BUCKET = 64


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an array of small non-negative integers in ascending order."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    text = np.append(data.astype(np.int64) + 1, 0)
    return _sorted(text)[1:]


def _kinds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is S, and the places of the LMS suffixes."""
    n = len(text)
    change = np.append(np.flatnonzero(text[:-1] != text[1:]), n - 1)
    there = change[np.searchsorted(change, np.arange(n))]
    small = text[there] < text[np.minimum(there + 1, n - 1)]
    small[-1] = True
    return small, np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _sorted(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text that ends with its only 0."""
    n = len(text)
    small, lms = _kinds(text)
    sizes = np.bincount(text)
    induce = _induce_buckets if n >= BUCKET * np.count_nonzero(sizes) else _induce_one_by_one
    if len(lms) > 1:
        array = induce(text, small, sizes, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = array[is_lms[array]]
        names = _names(text, lms, order)
        if names[-1] + 1 < len(lms):
            place = np.empty(n, np.int64)
            place[order] = names
            order = lms[_sorted(place[lms])]
        lms = order
    return induce(text, small, sizes, lms)


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the LMS substrings in their order, the same for equal ones."""
    length = np.zeros(len(text), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        equal = text[a[open_] + k] == text[b[open_] + k]
        same[open_[~equal]] = False
        open_ = open_[equal]
        k += 1
        open_ = open_[length[a[open_]] > k]
    return np.append(0, np.cumsum(~same))


def _induce_buckets(text: np.ndarray, small: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, from the LMS suffixes in their order (or LMS substrings, from them in any order)."""
    n = len(text)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    array = np.full(n, -1, np.int64)
    order = np.argsort(text[lms], kind="stable")
    chars = text[lms][order]
    counts = np.bincount(chars, minlength=len(sizes))
    first = ends - counts
    array[first[chars] + np.arange(len(lms)) - (np.cumsum(counts) - counts)[chars]] = lms[order]

    heads = starts.copy()

    def ahead(batch: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[~small[before]]
        if len(before):
            c = text[before]
            by = np.argsort(c, kind="stable")
            c = c[by]
            new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            run = np.diff(np.append(new, len(c)))
            array[heads[c] + np.arange(len(c)) - np.repeat(new, run)] = before[by]
            heads[c[new]] += run

    used = np.flatnonzero(sizes)
    for c in used:
        at = starts[c]
        while at < heads[c]:
            to = heads[c]
            ahead(array[at:to])
            at = to
        if counts[c]:
            ahead(array[first[c] : ends[c]])

    tails = ends.copy()

    def behind(batch: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[small[before]]
        if len(before):
            c = text[before]
            by = np.argsort(c, kind="stable")
            c = c[by]
            new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            run = np.diff(np.append(new, len(c)))
            array[tails[c] - 1 - np.arange(len(c)) + np.repeat(new, run)] = before[by]
            tails[c[new]] -= run

    for c in used[::-1]:
        at = ends[c]
        while at > tails[c]:
            to = tails[c]
            behind(array[to:at][::-1])
            at = to
        if heads[c] > starts[c]:
            behind(array[starts[c] : heads[c]][::-1])
    array[0] = n - 1
    return array


def _induce_one_by_one(text: np.ndarray, small: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As ``_induce_buckets``, in plain scans over lists."""
    n = len(text)
    ends = np.cumsum(sizes)
    t = text.tolist()
    array = [-1] * n
    tails = ends.tolist()
    for p in lms.tolist()[::-1]:
        tails[t[p]] -= 1
        array[tails[t[p]]] = p
    # for each place the byte before it if that suffix is L (S), else -1; the last entry serves free slots
    before = np.append(-1, text[:-1])
    kind = np.append(False, small[:-1])
    heads = (ends - sizes).tolist()
    large = [*np.where(kind, -1, before).tolist(), -1]
    for p in array:
        c = large[p]
        if c >= 0:
            array[heads[c]] = p - 1
            heads[c] += 1
    tails = ends.tolist()
    less = [*np.where(kind, before, -1).tolist(), -1]
    for p in reversed(array):
        c = less[p]
        if c >= 0:
            tails[c] -= 1
            array[tails[c]] = p - 1
    array[0] = n - 1
    return np.array(array, np.int64)


def permuted_prefixes(data: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a byte text the common prefix of its suffix with the one before it in order, and that one (-1: none).

    Where the bytes before both are equal, the prefix is one less than that of the place before;
    only the others are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    padded = np.concatenate([data.astype(np.uint64), np.zeros(8, np.uint64)])
    eight = np.zeros(n + 1, np.uint64)
    for k in range(8):
        eight[:n] |= padded[k : k + n] << np.uint64(8 * k)
    place = np.arange(n)
    own = before >= 0
    derived = own & (place > 0) & (before > 0)
    derived[derived] = data[place[derived] - 1] == data[before[derived] - 1]
    at = np.flatnonzero(own & ~derived)
    length = np.zeros(n, np.int64)
    a, b = at.copy(), before[at]
    open_ = np.arange(len(at))
    found = np.zeros(len(at), np.int64)
    while len(open_):
        x = eight[np.minimum(a[open_], n)] ^ eight[np.minimum(b[open_], n)]
        room = n - np.maximum(a[open_], b[open_])
        low = x & (~x + np.uint64(1))
        step = np.where(x == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
        step = np.minimum(step, np.maximum(room, 0))
        found[open_] += step
        a[open_] += step
        b[open_] += step
        open_ = open_[(step == 8)]
    length[at] = found
    source = np.maximum.accumulate(np.where(derived, 0, place))
    length = np.where(derived, np.maximum(length[source] - (place - source), 0), length)
    return length, before
