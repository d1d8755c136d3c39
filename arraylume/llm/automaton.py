"""Generalised suffix automaton over sequences of integer tokens."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """Recognises every substring of the sequences added to it.

    ``add`` extends the automaton by one sequence (generalised construction: the
    cursor goes back to the root). ``owners`` then gives, for each state, the ids
    of the sequences in which the state's substrings occur.
    """

    __slots__ = ("next", "link", "length", "sequences")

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.sequences: list[tuple[int, list[int]]] = []

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """A copy of q for the shorter substrings that p reaches by token."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def add(self, owner: int, tokens: Sequence[int]) -> None:
        last = 0
        for token in tokens:
            q = self.next[last].get(token)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and token not in self.next[p]:
                self.next[p][token] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][token]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
            last = new
        self.sequences.append((owner, list(tokens)))

    def owners(self) -> list[set[int]]:
        found: list[set[int]] = [set() for _ in self.length]
        for owner, tokens in self.sequences:
            state = 0
            for token in tokens:
                state = self.next[state][token]
                up = state
                while up > 0 and owner not in found[up]:
                    found[up].add(owner)
                    up = self.link[up]
        return found

    def state_of(self, tokens: Sequence[int]) -> int:
        """State of a substring; -1 when it does not occur."""
        state = 0
        for token in tokens:
            state = self.next[state].get(token, -1)
            if state < 0:
                return -1
        return state

    def matches(self, tokens: Iterable[int]):
        """Matching statistics: per token the state and length of the longest
        suffix read so far that occurs in some sequence."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for token in tokens:
            to = nxt[state].get(token)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(token)
            if to is None:
                size = 0
            else:
                state = to
                size += 1
            yield state, size
