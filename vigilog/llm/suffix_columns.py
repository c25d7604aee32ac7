"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

All strings of a collection are aligned at one place. They are read from the right, one
symbol of every string in each round: the suffixes that begin in a column are those of the
column to its right with one symbol in front, so a stable sort of the previous order by the
new symbols gives the new order, and the common prefix of two neighbours is one more than
the least common prefix between their places in the previous order. What stands to the left of the
sorted suffixes is the column's part of the transform, and the next round's input.

Columns lie one after another in a temporary file that is read once from front to back, so
beside the file only a few numbers per string are held. Several collections are sorted at
once; they never meet, as the collection is the first key of every order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np


def column_orders(rows: np.ndarray, groups: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each column from the last to the first: (column, order, common prefixes).

    ``rows`` are aligned strings as symbols, 0 where a string has none (a 0 equals nothing).
    ``order`` sorts the suffixes that begin in the column, within ``groups`` (ascending);
    ``common[i]`` is how far suffix ``order[i]`` agrees with ``order[i - 1]``, at most ``most``.
    """
    count, width = rows.shape
    with tempfile.TemporaryFile() as columns:
        for j in range(width - 1, -1, -1):
            np.ascontiguousarray(rows[:, j]).tofile(columns)
        columns.seek(0)
        order = np.arange(count)
        common = np.zeros(count, np.int16)
        edge = np.zeros(count, bool)
        edge[0:1] = True
        edge[1:] = groups[1:] != groups[:-1]
        base = groups.astype(np.int64) * 65536
        for j in range(width - 1, -1, -1):
            transform = np.fromfile(columns, rows.dtype, count)[order]  # the symbols before the suffixes sorted so far
            place = np.argsort(base[order] + transform, kind="stable")
            symbols, owners = transform[place], groups[order][place]
            same = np.zeros(count, bool)
            same[1:] = (symbols[1:] == symbols[:-1]) & (owners[1:] == owners[:-1]) & (symbols[1:] != 0)
            grown = np.zeros(count, np.int16)
            at = np.flatnonzero(same)
            if len(at):
                cuts = np.empty(2 * len(at), np.int64)
                cuts[0::2], cuts[1::2] = place[at - 1] + 1, place[at] + 1
                least = np.minimum.reduceat(np.append(common, np.int16(0)), cuts)[0::2]
                grown[at] = np.minimum(least + 1, most)
            order, common = order[place], grown
            yield j, order, common


def repeated(rows: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """Which windows of ``length`` symbols, one beginning in each column, another row of the group has at the same columns."""
    windows = rows.shape[1] - length + 1
    out = np.zeros((rows.shape[0], windows), bool)
    for j, order, common in column_orders(rows, groups, length):
        if j < windows:
            long = common >= length
            out[order[long], j] = True
            out[order[np.flatnonzero(long) - 1], j] = True
    return out
