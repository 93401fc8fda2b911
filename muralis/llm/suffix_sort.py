"""Suffix arrays by linear grouping construction, for many texts at once.

First, suffixes are grouped by their longest Lyndon prefix. Groups are taken in descending order; each member points to
the previous smaller suffix, and the suffixes pointed to leave their groups for new ones just above, by how many members
point to them. Then suffixes are written out in ascending order: each one, when written, settles the next free place in
the groups of the suffixes whose Lyndon prefix ends where it starts. Names are never replaced and nothing recurs.

The texts ("lanes") advance in lockstep: each step takes one group of every lane and works on whole arrays.
"""

from __future__ import annotations

import numpy as np


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] values, then those of start[1], and so on."""
    total = int(count.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(count) - count), count)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal keys."""
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return first, np.diff(np.concatenate((first, [len(sorted_keys)])))


def lyndon_groups(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the place at which its group begins in the suffix array, and the previous smaller suffix (or a
    position before the lane). ``starts`` are the lanes' starts in ``text``."""
    n = len(text)
    ends = np.append(starts[1:], n)
    base_of = np.repeat(starts, ends - starts)
    key = base_of * (int(text.max()) + 1) + text
    sa = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    first, count = _runs(key[sa])
    group, size = np.empty(n, np.int64), np.zeros(n, np.int64)
    group[sa] = np.repeat(first, count)
    size[first] = count
    prev, hit = np.full(n, -1, np.int64), np.zeros(n, bool)
    top, live = ends.copy(), np.flatnonzero(ends > starts)
    while len(live):
        g = group[sa[top[live] - 1]]
        count = size[g]
        top[live] = g
        members, own, base = sa[_spans(g, count)], np.repeat(g, count), np.repeat(starts[live], count)
        p = members - 1
        todo = np.flatnonzero((p >= base) & (group[p] > own))
        while len(todo):
            p[todo] = prev[p[todo]]
            q = p[todo]
            todo = todo[(q >= base[todo]) & (group[q] > own[todo])]
        prev[members] = p
        todo = np.flatnonzero((p >= base) & (group[p] == own))
        while len(todo):  # past members of the same group, by doubling
            p[todo] = prev[p[todo]]
            prev[members[todo]] = p[todo]
            q = p[todo]
            todo = todo[(q >= base[todo]) & (group[q] == own[todo])]
        parents = np.sort(p[p >= base])
        if len(parents):
            first, times = _runs(parents)
            parents = parents[first]
            rank = group[parents] * (int(times.max()) + 1) + times
            order = np.argsort(rank, kind="stable")
            parents, rank = parents[order], rank[order]
            old = group[parents]
            first, hits = _runs(old)
            old_start, old_size = old[first], size[old[first]]
            tail = old_start + old_size - hits
            slots, tails = _spans(tail, hits), np.repeat(tail, hits)
            hit[parents] = True
            holders = sa[slots]
            moved = holders[~hit[holders]]
            hit[parents] = False
            free = place[parents]
            free = free[free < tails]
            sa[free], place[moved] = moved, free
            sa[slots], place[parents] = parents, slots
            size[old_start] = old_size - hits
            first, count = _runs(rank)
            size[slots[first]] = count
            group[parents] = np.repeat(slots[first], count)
        live = live[g > starts[live]]
    return group, prev


def suffix_arrays(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix arrays of all lanes, one after the other, as positions in ``text``. A suffix ends with its lane; a proper
    prefix sorts before what it is a prefix of."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.append(starts[1:], n)
    group, prev = lyndon_groups(text, starts)
    sa, fill, done = np.empty(n, np.int64), np.arange(n), np.zeros(n, bool)

    def settle(at: np.ndarray, base: np.ndarray) -> None:
        """Place the suffixes whose next smaller one is ``at``, given in ascending order within each lane."""
        current = at - 1
        todo = np.flatnonzero(current >= base)
        todo = todo[~done[current[todo]]]
        found, by = [], []
        while len(todo):
            found.append(current[todo])
            by.append(todo)
            current[todo] = prev[current[todo]]
            todo = todo[current[todo] >= base[todo]]
            todo = todo[~done[current[todo]]]
        if not found:
            return
        items, order = np.concatenate(found), np.concatenate(by)
        g = group[items]
        order = np.argsort(g * len(at) + order, kind="stable")
        items, g = items[order], g[order]
        first, count = _runs(g)
        sa[_spans(fill[g[first]], count)] = items
        fill[g[first]] += count
        done[items] = True

    settle(ends.copy(), starts)
    at, live = starts.copy(), np.flatnonzero(ends > starts)
    while len(live):
        here = at[live]
        until = fill[group[sa[here]]]
        at[live] = until
        count = until - here
        settle(sa[_spans(here, count)], np.repeat(starts[live], count))
        live = live[at[live] < ends[live]]
    return sa
