"""Gray-order hierarchical index over bit fingerprints.

Fingerprints are sorted by Gray rank, so neighbours share most bits. Each run of FAN neighbours becomes a node that keeps
the bits that all of them share (a mask and a pattern); runs of nodes become upper nodes. A search goes down from the top and
adds up the differences on the bits that each level newly fixes; once they exceed the limit, the whole group is pruned. At
the leaves the sum is the exact distance.
"""

from __future__ import annotations

import numpy as np

FAN = 16
#: Words of fingerprints that a search compares at once, about.
_FRONT = 1 << 18


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Rank of each code (n x words, most significant word first) in the Gray sequence, as words that sort alike."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    odd = np.zeros(len(codes), dtype=bool)
    for k in range(codes.shape[1]):
        out[odd, k] = ~out[odd, k]
        odd = (out[:, k] & np.uint64(1)).astype(bool)
    return out


def gray_order(codes: np.ndarray) -> np.ndarray:
    rank = gray_rank(codes)
    return np.lexsort(tuple(rank[:, k] for k in range(codes.shape[1] - 1, -1, -1)))


def distance(a: np.ndarray) -> np.ndarray:
    """Bits set in each row."""
    count = np.bitwise_count(a)
    if a.shape[-1] == 1:
        return count[..., 0].astype(np.int16)
    return (count.astype(np.float32) @ np.ones(a.shape[-1], dtype=np.float32)).astype(np.int16)


class GrayIndex:
    def __init__(self, codes: np.ndarray, fan: int = FAN):
        """codes: distinct or not, n x words of uint64, in Gray order. fan: children of a node."""
        self.codes, self.fan = codes, fan
        full = np.full_like(codes, ~np.uint64(0))
        masks, patterns = [full], [codes]
        low = high = codes
        while len(low) > fan:
            at = np.arange(0, len(low), fan)
            low, high = np.bitwise_and.reduceat(low, at, axis=0), np.bitwise_or.reduceat(high, at, axis=0)
            masks.append(~(low ^ high))
            patterns.append(low)
        self.levels = []
        for k, (mask, pattern) in enumerate(zip(masks, patterns, strict=True)):
            if k + 1 < len(masks):  # bits that the upper node has are not counted again
                mask = mask & ~np.repeat(masks[k + 1], fan, axis=0)[: len(mask)]
            self.levels.append((mask, pattern & mask))

    def search(self, queries: np.ndarray, most: int):
        """Yields (query rows, code rows) at a distance of at most `most`, in blocks of bounded size."""
        step = max(1, _FRONT // max(self.codes.size, 1))
        for lo in range(0, len(queries), step):
            q = queries[lo : lo + step]
            mask, pattern = self.levels[-1]
            acc = distance((q[:, None] & mask) ^ pattern)
            qi, node = np.nonzero(acc <= most)
            acc = acc[qi, node]
            for mask, pattern in self.levels[-2::-1]:
                child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                qi, acc = np.repeat(qi, self.fan), np.repeat(acc, self.fan)
                real = child < len(mask)  # the last node may have fewer children
                if not real.all():
                    qi, child, acc = qi[real], child[real], acc[real]
                acc += distance((q[qi] & mask[child]) ^ pattern[child])
                near = np.flatnonzero(acc <= most)
                qi, node, acc = qi[near], child[near], acc[near]
            yield qi + lo, node
