"""Edit distances of sequences of any length over any number of symbols, bit by bit in whole numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bits of columns that are kept for one traceback; longer pairs are halved first.
KEPT = 1 << 24


def _bits(number: int, n: int) -> np.ndarray:
    """The lowest n bits of a number as 0 and 1."""
    return np.unpackbits(np.frombuffer(number.to_bytes((n + 7) // 8, "little"), dtype=np.uint8), bitorder="little")[:n].astype(np.int64)


class Columns:
    """Myers' columns of the distance table of a (down) and b (across), in the form of Hyyrö: bit i of up
    and down says that the entry at row i + 1 is one over or one under that at row i."""

    def __init__(self, a: Sequence, b: Sequence, keep: bool = False):
        self.n, full = len(a), (1 << len(a)) - 1
        at: dict = {}
        for i, x in enumerate(a):
            at[x] = at.get(x, 0) | 1 << i
        up, down = full, 0
        self.kept = [(up, down)]
        for x in b:
            eq = at.get(x, 0)
            across = eq | down
            flat = (((eq & up) + up) ^ up) | eq
            right, left = (down | ~(flat | up)) & full, flat & up
            right, left = (right << 1 | 1) & full, left << 1 & full
            up, down = (left | ~(across | right)) & full, right & across
            if keep:
                self.kept.append((up, down))
        self.up, self.down, self.width = up, down, len(b)

    def last(self) -> np.ndarray:
        """The table's last column, rows 0 to n."""
        return np.concatenate([[0], np.cumsum(_bits(self.up, self.n) - _bits(self.down, self.n))]) + self.width


def distance(a: Sequence, b: Sequence) -> int:
    return int(Columns(a, b).last()[-1])


def _traced(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """Edits of a best way through the whole table, from its end: first along the diagonal."""
    kept = Columns(a, b, keep=True).kept
    i, j, changed, gone, new = len(a), len(b), 0, 0, 0
    while i and j:
        up, down = kept[j]
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif up >> (i - 1) & 1:  # one more than the entry above
            i, gone = i - 1, gone + 1
        elif not kept[j - 1][1] >> (i - 1) & 1:  # neither above nor, so, to the left: the diagonal
            i, j, changed = i - 1, j - 1, changed + 1
        else:  # the entry to the left is one under that above it, and so one under this one
            j, new = j - 1, new + 1
    return changed, new + j, gone + i


def counted(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """(substitutions, insertions, deletions) of a shortest way from a to b, their sum being the distance.

    Equal ends are cut off, and pairs whose columns are too many to keep are cut where the best way
    crosses the middle of b (Hirschberg), so that memory stays linear in the lengths.
    """
    out, todo = np.zeros(3, dtype=np.int64), [(a, b)]
    while todo:
        a, b = todo.pop()
        n = min(len(a), len(b))
        lo = 0
        while lo < n and a[lo] == b[lo]:
            lo += 1
        hi = 0
        while hi < n - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
            hi += 1
        a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
        if not len(a) or not len(b):
            out += (0, len(b), len(a))
        elif len(b) == 1 or len(a) * len(b) <= KEPT:
            out += _traced(a, b)
        else:
            half = len(b) // 2
            there, back = Columns(a, b[:half]).last(), Columns(a[::-1], b[half:][::-1]).last()[::-1]
            cut = int((there + back).argmin())
            todo += [(a[:cut], b[:half]), (a[cut:], b[half:])]
    return int(out[0]), int(out[1]), int(out[2])
