"""Sorting of suffixes by refinement of groups, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Groups:
    """Items in an order that gets finer with each round; only items that still share a group are sorted.

    ``order`` lists the items, ``rank`` the place of the first item of each one's group in it.
    """

    def __init__(self, n: int):
        self.order = np.arange(n)
        self.rank = np.zeros(n, np.int64)
        self.open = np.arange(n) if n > 1 else np.zeros(0, np.int64)

    def refine(self, key: Callable[[np.ndarray], np.ndarray]) -> None:
        """Sort the items of every group by ``key``, whole numbers below 2**63; equal keys stay one group."""
        if not len(self.open):
            return
        items = self.order[self.open]
        group, k = self.rank[items], key(items)
        top = int(k.max()) + 1
        if int(group[-1]) < 2 ** 63 // top:              # both in one number
            k = group * top + k
            by = np.argsort(k)
            k = k[by]
            new = np.append(True, k[1:] != k[:-1])
        else:
            by = np.lexsort((k, group))
            group, k = group[by], k[by]
            new = np.append(True, (k[1:] != k[:-1]) | (group[1:] != group[:-1]))
        items = items[by]
        self.order[self.open] = items
        self.rank[items] = self.open[new][np.cumsum(new) - 1]
        self.open = self.open[~(new & np.append(new[1:], True))]
