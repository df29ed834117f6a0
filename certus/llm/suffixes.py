"""Suffix sorting by grouping suffixes on their Lyndon prefixes, in linear time.

First all suffixes are grouped by their first symbol. Groups are processed in
descending order. A processed suffix hands its group's word to the previous
smaller suffix, found through pointers that skip what has been processed; of a
group's suffixes, those that got the word leave it for a new, greater group,
and those that got it more often for a still greater one. At the end a group
holds the suffixes with one Lyndon prefix. The order within the groups then
follows by emitting them: every suffix that has its place fixes the places of
those whose Lyndon prefix ends just before it. Nothing is renamed or solved
recursively.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_order(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of symbols, ascending; an end that compares lowest is understood."""
    n = len(symbols) + 1
    by: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        own = by.get(c)
        if own is None:
            by[c] = own = []
        own.append(i)
    # group 0 is the end alone; groups are numbered as they come and linked in order
    member, group = [[n - 1]], [0] * n
    for c in sorted(by):
        for i in by[c]:
            group[i] = len(member)
        member.append(by[c])
    below, above = list(range(-1, len(member) - 1)), list(range(1, len(member) + 1))
    previous, skip, done = [-1] * n, [-1] * n, bytearray(n)
    descending, g = [], len(member) - 1
    while g > 0:
        own = [i for i in member[g] if group[i] == g]
        member[g] = own
        descending.append(g)
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = skip[p]
            q = i - 1
            while q > p:  # what has been passed is passed at once from now on
                skip[q], q = p, skip[q]
            previous[i] = skip[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        split: dict[int, dict[int, list[int]]] = {}
        for p, k in times.items():
            split.setdefault(group[p], {}).setdefault(k, []).append(p)
        for old, more in split.items():
            low, high = old, above[old]
            for k in sorted(more):
                new = len(member)
                for p in more[k]:
                    group[p] = new
                member.append(more[k])
                below.append(low)
                above.append(high)
                above[low] = low = new
            below[high] = low
        g = below[g]
    start, at = [0] * len(member), 1
    for g in reversed(descending):
        start[g] = at
        at += len(member[g])
    order, placed = [n - 1] * n, bytearray(n)
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = 1
            g = group[s]
            order[start[g]] = s
            start[g] += 1
            s = previous[s]
    return order[1:]
