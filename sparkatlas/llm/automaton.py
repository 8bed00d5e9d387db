"""Generalised suffix automaton over sequences of numbers."""

from __future__ import annotations

from collections.abc import Iterator


class SuffixAutomaton:
    """All substrings of the inserted sequences; a state is a set of substrings with the same ends."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def insert(self, seq: list[int]) -> list[int]:
        """Add a sequence; returns the state of each of its prefixes."""
        last, states = 0, []
        for c in seq:
            last = self._extend(last, c)
            states.append(last)
        return states

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the matches through p, which are shorter than q's."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # known from an earlier sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        made = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return made

    def stream(self, seq: list[int]) -> Iterator[tuple[int, int]]:
        """(state, longest match) after each number of seq."""
        state = matched = 0
        steps, link, length = self.next, self.link, self.length
        for c in seq:
            to = steps[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = steps[state].get(c)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            yield state, matched

    def suffix(self, state: int, size: int) -> int:
        """The state of the last size numbers of a match of at least that length."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state
