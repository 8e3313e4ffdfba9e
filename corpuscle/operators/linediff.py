"""Line diff of two texts in near-linear time, with the alignment of repeatedly taking the longest common run of lines.

Of the longest runs the one that begins first in the old text counts, and there the first place in the new text; then what lies
before and behind it is aligned in the same way. The runs of one length in a stretch are taken in one pass from left to right: none of that
length is left before the first of them. The greatest length is found by bisection over hashes of runs.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Stretches with at most so many pairs of lines are aligned directly.
DIRECT = 4_096

_P = 0x9E3779B97F4A7C15


class _Runs:
    """Hashes of the runs of any length in a sequence of line numbers."""

    def __init__(self, lines: np.ndarray, powers: np.ndarray):
        self.powers = powers
        self.sums = np.zeros(len(lines) + 1, dtype=np.uint64)
        np.cumsum((lines.astype(np.uint64) + np.uint64(1)) * powers[: len(lines)], out=self.sums[1:])

    def of(self, low: int, high: int, n: int) -> np.ndarray:
        """Hashes of the runs of n lines that lie in [low, high), in order."""
        at = np.arange(low, high - n + 1)
        return (self.sums[at + n] - self.sums[at]) * self.powers[::-1][at]


def _inverse_free_powers(n: int) -> np.ndarray:
    out = np.full(n, _P, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def matching_blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, lines) of the aligned runs, in order."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(line, len(number)) for line in side], dtype=np.int64) for side in (a, b))
    powers = _inverse_free_powers(max(len(a), len(b)) + 1)
    p, q = _Runs(x, powers), _Runs(y, powers)
    out, todo = [], [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while todo:
        a1, a2, b1, b2, most = todo.pop()
        most = min(most, a2 - a1, b2 - b1)
        if most <= 0:
            continue
        if (a2 - a1) * (b2 - b1) <= DIRECT:
            direct = SequenceMatcher(None, a[a1:a2], b[b1:b2], autojunk=False).get_matching_blocks()
            out += [(a1 + i, b1 + j, n) for i, j, n in direct if n]
            continue
        low, high = 0, most  # a common run of low lines exists, none of more than high
        guess = min(most, 16)
        while low < high:
            n = min(high, max(low + 1, guess))
            if np.isin(p.of(a1, a2, n), q.of(b1, b2, n)).any():
                low, guess = n, 4 * n
            else:
                high, guess = n - 1, (low + n) // 2
        if not low:
            continue
        here, there = p.of(a1, a2, low), q.of(b1, b2, low)
        order = np.argsort(there, kind="stable")
        there = there[order]
        first, last = np.searchsorted(there, here), np.searchsorted(there, here, "right")
        i, j = a1, b1
        for at in np.flatnonzero(first < last).tolist():
            if a1 + at < i:
                continue
            k = first[at] + np.searchsorted(order[first[at] : last[at]], j - b1)
            if k == last[at]:
                continue
            s, t = a1 + at, b1 + int(order[k])
            todo.append((i, s, j, t, low - 1))
            out.append((s, t, low))
            i, j = s + low, t + low
        todo.append((i, a2, j, b2, low - 1))
    out.sort()
    merged: list[tuple[int, int, int]] = []
    for s, t, n in out:
        if merged and merged[-1][0] + merged[-1][2] == s and merged[-1][1] + merged[-1][2] == t:
            merged[-1] = (merged[-1][0], merged[-1][1], merged[-1][2] + n)
        else:
            merged.append((s, t, n))
    return merged


def diff_lines(old: str | None, new: str | None) -> list[tuple[str, str]]:
    """(kind, line) of the new text against the old one: context, removed, added; null is empty text.

    Where lines are replaced the removed ones come first. The lines that aren't added are the old text's, those that aren't removed the new one's.
    """
    a, b = (old or "").splitlines(), (new or "").splitlines()
    out, i, j = [], 0, 0
    for s, t, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        out += [("removed", x) for x in a[i:s]] + [("added", x) for x in b[j:t]] + [("context", x) for x in a[s : s + n]]
        i, j = s + n, t + n
    return out
