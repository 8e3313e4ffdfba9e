"""Terms ``[0-9A-Za-z]`` and everything beyond ASCII, lower-cased in ASCII only, found in UTF-8 bytes a run at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from corpuscle.llm.common import BLOCK_BYTES, mix, powers, prefix_hash

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_APART = bytes(b for b in range(256) if not _TERM[b])


class Lexemes:
    """The terms of a list of byte strings: ``s``/``e`` spans in ``data``, ``off`` the number of the first term by string."""

    def __init__(self, parts: list[bytes]):
        self.data = np.frombuffer(b" ".join(parts).translate(_LOWER), dtype=np.uint8)
        inside = np.zeros(len(self.data) + 2, dtype=bool)
        inside[1:-1] = _TERM[self.data]
        self.s = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        self.e = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        base = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=base[1:])
        self.off = np.searchsorted(self.s, base)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each term."""
        h, (_, inverse) = prefix_hash(self.data), powers(len(self.data))
        return mix((h[self.e] - h[self.s]) * inverse[self.s])


def _stretches(raw: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """A long text cut between terms; each stretch but the first begins with the last term of the one before."""
    at, carry = 0, b""
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and _TERM[raw[end - 1]] and _TERM[raw[end]]:
            end += 1
        part = carry + b" " + raw[at:end] if carry else raw[at:end]
        yield part, bool(carry)
        tail = part.rstrip(_APART)
        cut = len(tail)
        while cut and _TERM[tail[cut - 1]]:
            cut -= 1
        at, carry = end, tail[cut:]


def runs(texts: list[bytes | None], size: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, Lexemes]]:
    """(owner, lap, lexemes) of texts (null: empty) in runs of about ``size`` bytes.

    owner: the text's place in the list for each string of the run; lap: whether the string's first term is the last one of the
    string before, because a text longer than ``size`` is cut. So memory is bounded by ``size`` and the longest term.
    """
    parts, owner, lap, held = [], [], [], 0
    for i, text in enumerate(texts):
        for part, again in _stretches(text, size) if text else ():
            parts.append(part)
            owner.append(i)
            lap.append(again)
            held += len(part)
            if held >= size:
                yield np.array(owner), np.array(lap), Lexemes(parts)
                parts, owner, lap, held = [], [], [], 0
    if parts:
        yield np.array(owner), np.array(lap), Lexemes(parts)
