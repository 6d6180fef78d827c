"""Generalised suffix automaton over integer or byte symbols (Blumer et al.; online construction)."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """State 0 is the root. Sequences are added one after another, each from the root, so no substring
    crosses two of them. first[s] is the tag of the first sequence position that ended in s."""

    __slots__ = ("next", "link", "length", "first")

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first: list = [None]

    def _state(self, length: int, edges: dict, link: int, tag) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(tag)
        return len(self.next) - 1

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link = self.next, self.link
        r = self._state(self.length[p] + 1, dict(nxt[q]), link[q], self.first[q])
        link[q] = r
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = r
            p = link[p]
        return r

    def extend(self, last: int, c, tag=None) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state(length[last] + 1, {}, 0, tag)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def add(self, symbols: Sequence, tags: Sequence | None = None) -> list[int]:
        """Adds a sequence; returns the state after each symbol."""
        last, out = 0, []
        for i, c in enumerate(symbols):
            last = self.extend(last, c, tags[i] if tags is not None else None)
            out.append(last)
        return out

    def match(self, symbols: Sequence) -> tuple[list[int], list[int]]:
        """Matching statistics: after each symbol, the state and length of the longest suffix that occurs."""
        nxt, link, length = self.next, self.link, self.length
        s = n = 0
        states, sizes = [], []
        for c in symbols:
            t = nxt[s].get(c)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = nxt[s].get(c)
            if t is None:
                n = 0
            else:
                s = t
                n += 1
            states.append(s)
            sizes.append(n)
        return states, sizes

    def windows(self, symbols: Sequence, size: int) -> list[int]:
        """The state that holds each window of `size` symbols, in order, or -1 where a window doesn't occur.

        Matching statistics as in `match`, but a match is cut back to `size` symbols as soon as it is longer.
        """
        nxt, link, length = self.next, self.link, self.length
        s = n = 0
        out = []
        for k, c in enumerate(symbols):
            t = nxt[s].get(c)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = nxt[s].get(c)
            if t is None:
                n = 0
            else:
                s = t
                n += 1
                while n > size and length[link[s]] >= size:
                    s = link[s]
                if n > size:
                    n = size
            if k >= size - 1:
                out.append(s if n == size else -1)
        return out
