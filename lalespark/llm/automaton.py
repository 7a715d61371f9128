"""A suffix automaton over words, for several texts."""

from __future__ import annotations


class SuffixAutomaton:
    """Holds all substrings of the texts added so far. States are numbers; 0 is the empty string."""

    __slots__ = ("length", "link", "next")

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _copy(self, p: int, c, q: int) -> int:
        """Splits state q so that the string that ends p and c has a state of its own."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, p: int, c) -> int:
        nexts, link, length = self.next, self.link, self.length
        q = nexts[p].get(c)
        if q is not None:  # another text has it already
            return q if length[q] == length[p] + 1 else self._copy(p, c, q)
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._copy(p, c, q)
        return cur

    def add(self, words) -> None:
        p = 0
        for w in words:
            p = self._extend(p, w)

    def statistics(self, words):
        """For each word the length of the longest string that ends there and is in the texts."""
        nexts, link, length = self.next, self.link, self.length
        v = n = 0
        for w in words:
            while v and w not in nexts[v]:
                v = link[v]
                n = length[v]
            q = nexts[v].get(w)
            if q is not None:
                v = q
                n += 1
            yield n
