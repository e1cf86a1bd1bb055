"""Longest common substrings."""

from __future__ import annotations


def common_bytes(p: bytes, q: bytes) -> bytes:
    """The longest common substring, the first in ``p``, by a suffix automaton of ``q``: linear in both."""
    steps, link, length, last = [{}], [-1], [0], 0
    for c in q:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in steps[at]:
            steps[at][c] = new
            at = link[at]
        if at >= 0:
            to = steps[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(steps)
                steps.append(dict(steps[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and steps[at].get(c) == to:
                    steps[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    state = size = best = end = 0
    for i, c in enumerate(p, 1):
        while state and c not in steps[state]:
            state = link[state]
            size = length[state]
        if c in steps[state]:
            state, size = steps[state][c], size + 1
        else:
            size = 0
        if size > best:
            best, end = size, i
    return p[end - best : end]
