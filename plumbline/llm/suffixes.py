"""Linear suffix sorting by grouping, without recursive renaming.

A suffix begins with its longest Lyndon prefix and goes on with the next smaller
suffix. The first phase sorts the suffixes into groups of equal Lyndon prefix: it
takes the groups in descending order, finds for each member the nearest earlier
suffix of a lower group (pointers that skip what is not lower), and lengthens
that suffix's prefix, which moves it to a new group above the rest of its own.
The second phase orders each group: a sorted suffix places the suffixes that go
on with it, which stand in different groups, at the front of what is free there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence


def _first_groups(symbols: Sequence[int]):
    """Group (its first place) and size by the first symbol, and the members by group."""
    by_symbol: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(symbols):
        by_symbol[s].append(i)
    group, members, size, at = [0] * len(symbols), {}, {}, 0
    for s in sorted(by_symbol):
        own = by_symbol[s]
        members[at], size[at] = own, len(own)
        for i in own:
            group[i] = at
        at += len(own)
    return group, members, size


def _lyndon_groups(symbols: Sequence[int]) -> tuple[list[int], list[int]]:
    """The final group of each suffix and the length of its Lyndon prefix."""
    n = len(symbols)
    group, members, size = _first_groups(symbols)
    length = dict.fromkeys(size, 1)
    group_ending = {g + k - 1: g for g, k in size.items()}
    before = list(range(-1, n - 1))
    final = [1] * n
    top = n - 1
    while top >= 0:
        now = group_ending[top]
        top = now - 1
        own = [i for i in members.pop(now) if group[i] == now]
        own.sort()
        count: dict[int, int] = {}
        grown = length[now]
        for i in own:
            final[i] = grown
            p = before[i]
            while p >= 0 and group[p] >= now:
                p = before[p]
            before[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        by_group: dict[int, dict[int, list[int]]] = {}
        for p, k in count.items():
            by_group.setdefault(group[p], {}).setdefault(k, []).append(p)
        for g, levels in by_group.items():
            was, end = length[g], g + size[g]
            for k in sorted(levels, reverse=True):
                moved = levels[k]
                begin = end - len(moved)
                size[begin], length[begin] = len(moved), was + k * grown
                group_ending[end - 1] = begin
                if begin != g:
                    members[begin] = moved
                    for p in moved:
                        group[p] = begin
                end = begin
            if end > g:
                size[g] = end - g
                group_ending[end - 1] = g
    return group, final


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The suffixes' first places in ascending order; an ended suffix is the smaller one."""
    n = len(symbols)
    if not n:
        return []
    group, length = _lyndon_groups(symbols)
    followers: list[list[int]] = [[] for _ in range(n + 1)]
    for i in range(n):
        followers[i + length[i]].append(i)
    free = list(range(n))
    out = [0] * n
    for i in followers[n]:
        g = group[i]
        out[free[g]] = i
        free[g] += 1
    for at in range(n):
        for i in followers[out[at]]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
    return out
