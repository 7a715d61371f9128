"""Suffix arrays by induced sorting, and permuted common prefixes, vectorised by buckets.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost S ones (LMS) part the text into
substrings; these are sorted by inducing, named, and the string of names is sorted recursively. From the sorted LMS suffixes
one pass over the buckets induces all L suffixes, another one back all S suffixes. A bucket is taken at once, so the passes are
linear; strings of names with so many letters that buckets hold a few entries only are sorted by doubling their ranks instead.
"""

from __future__ import annotations

import numpy as np

#: Entries that a bucket has to hold on average for a string of names to be sorted by recursion.
LEAST_BUCKET = 32


def smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its right neighbour; the last one, of a letter that is nowhere else, is."""
    n = len(text)
    up = np.ones(n, dtype=bool)
    apart = text[:-1] != text[1:]
    where = np.where(apart, np.arange(n - 1), n - 1)
    up[:-1] = text[:-1] < text[1:]
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    return up[np.append(nearest, n - 1)] if n > 1 else up


def _grouped(letters: np.ndarray):
    """A stable order by letter; each letter, its first place in that order, its count."""
    order = np.argsort(letters, kind="stable")
    found = letters[order]
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    return order, found[first], first, np.diff(np.append(first, len(found)))


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, if the LMS suffixes are given in order; by LMS substrings if these are given in any order."""
    n = len(text)
    out = np.full(n, -1, dtype=np.int32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    order, letters, first, counts = _grouped(text[lms])
    out[np.repeat(ends[letters] - counts, counts) + np.arange(len(lms)) - np.repeat(first, counts)] = lms[order]
    of_lms = np.zeros(len(sizes), dtype=np.int64)
    of_lms[letters] = counts
    head, tail = starts.copy(), ends.copy()

    def push(found: np.ndarray, want: bool) -> None:
        j = found[found > 0] - 1
        j = j[small[j] == want]
        if not len(j):
            return
        order, letters, first, counts = _grouped(text[j])
        within = np.arange(len(j)) - np.repeat(first, counts)
        if want:
            out[np.repeat(tail[letters], counts) - 1 - within] = j[order]
            tail[letters] -= counts
        else:
            out[np.repeat(head[letters], counts) + within] = j[order]
            head[letters] += counts

    used = np.flatnonzero(sizes).tolist()
    for c in used:
        done = int(starts[c])
        while done < head[c]:
            done, part = int(head[c]), out[done : head[c]]
            push(part, False)
        if of_lms[c]:
            push(out[ends[c] - of_lms[c] : ends[c]], False)
    tail[text[-1]] -= 1
    out[tail[text[-1]]] = n - 1
    for c in reversed(used):
        done = int(ends[c])
        while done > tail[c]:
            done, part = int(tail[c]), out[tail[c] : done][::-1]
            push(part, True)
        if head[c] > starts[c]:
            push(out[starts[c] : head[c]][::-1], True)
    return out


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Letters that the suffixes at a[i] and b[i] share, up to most[i]."""
    out = np.zeros(len(a), dtype=np.int64)
    at, k = np.flatnonzero(most > 0), 0
    while len(at):
        at = at[text[a[at] + k] == text[b[at] + k]]
        k += 1
        out[at] = k
        at = at[most[at] > k]
    return out


def doubled(names: np.ndarray) -> np.ndarray:
    """The suffix array of a string whose last letter is nowhere else, by ranks of twice the length each time."""
    rank, n, k = names.astype(np.int64), len(names), 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key)
        found = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.append(0, found[1:] != found[:-1]))
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """text: letters from 0 on, the last of which is 0 and nowhere else."""
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    sizes = np.bincount(text)
    if len(sizes) <= 1 << 16:
        text = text.astype(np.uint16)  # which sorts by digits
    small = smaller(text)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    found = induce(text, small, lms, sizes)
    found = found[is_lms[found]]
    length = np.empty(n, dtype=np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = found[:-1], found[1:]
    same = length[a] == length[b]
    same[same] = common(text, a[same], b[same], length[a[same]]) == length[a[same]]
    name = np.empty(n, dtype=np.int64)
    name[found] = np.cumsum(np.append(0, ~same))
    names = name[lms]
    letters = int(names.max()) + 1
    if letters == len(lms):
        order = np.argsort(names)
    elif letters * LEAST_BUCKET <= len(lms):
        order = suffix_array(names)
    else:
        order = doubled(names)
    return induce(text, small, lms[order], sizes)


def permuted_common(text: np.ndarray, order: np.ndarray, ends: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """For each place i, in the order of the text, the letters that its suffix shares with the one before it in the array.

    ends: up to where to compare. Where the letters before both places are equal the value is one less than that of the place
    before; only the others, and the `fresh` ones, are compared.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int32)
    before[order[1:]] = order[:-1]
    own = fresh.copy()
    own[0] = True
    i = np.arange(1, n)
    p = before[1:]
    own[1:] |= (p <= 0) | (text[i - 1] != text[np.maximum(p - 1, 0)])
    at = np.flatnonzero(own)
    value = np.zeros(n, dtype=np.int32)
    known = at[before[at] >= 0]
    value[known] = common(text, known, before[known], np.minimum(ends[known] - known, n - before[known]))
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return np.maximum(value[last] - (np.arange(n) - last), 0)
