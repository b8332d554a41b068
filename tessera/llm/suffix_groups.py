"""Suffix arrays by linear grouping, of many texts at once.

First phase: suffixes stand in groups by what is known of their Lyndon prefix, at first one letter. Groups are processed from the largest
down. The previous-smaller pointer of a member is the nearest place before it whose group is smaller; each place that k members of the group
point to has its prefix extended by k copies of the group's, and so moves up, behind those of its old group that are pointed to less often.
In the end, groups are the suffixes with equal Lyndon prefixes, in order. Second phase: a suffix is its Lyndon prefix and then the next
smaller suffix, so a group is emitted in the order of its members' next smaller suffixes; members whose next smaller suffix is in the
group itself come after those that leave it earlier. Nothing is renamed and no smaller problem is solved.

The texts do not interact. One step processes the largest open group of every text, as array operations over all their members.
"""

from __future__ import annotations

import numpy as np


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0].. size[0] numbers, then start[1].. and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def suffix_arrays(letters: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array of each text, one after another, as places in `letters`; Lyndon prefix lengths).

    letters: texts one after another, each ending in a letter smaller than all its others; begin: first place of each text.
    """
    n = len(letters)
    sizes = np.diff(np.append(begin, n))
    text = np.repeat(np.arange(len(begin)), sizes)
    key = text * (int(letters.max()) + 1 if n else 1) + letters
    sa = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[sa], prepend=-1))
    group = np.empty(n, np.int64)  # the first slot of a suffix's group
    group[sa] = np.repeat(new, np.diff(np.append(new, n)))
    slot = np.empty(n, np.int64)
    slot[sa] = np.arange(n)
    group_end = np.zeros(n + 1, np.int64)
    group_end[new] = np.append(new[1:], n)
    length = np.ones(n, np.int64)
    previous = np.full(n, -1, np.int64)
    is_first = np.zeros(n, bool)
    is_first[begin] = True
    marked = np.zeros(n, bool)
    open_to, low = begin + sizes, begin.copy()  # open slots of each text end here
    while len(open_to):
        top = group[sa[open_to - 1]]
        size = open_to - top
        own = sa[ragged(top, size)]
        level = np.repeat(top, size)
        p = np.where(is_first[own], -1, own - 1)
        # past larger groups, which have their pointers
        go = np.flatnonzero((p >= 0) & (group[p] > level))
        while len(go):
            p[go] = previous[p[go]]
            go = go[(p[go] >= 0) & (group[p[go]] > level[go])]
        # past members of the same group, by their own pointers
        previous[own] = p
        go = np.flatnonzero((p >= 0) & (group[p] == level))
        while len(go):
            p[go] = previous[p[go]]
            previous[own[go]] = p[go]
            go = go[(p[go] >= 0) & (group[p[go]] == level[go])]
        seen = p >= 0
        if seen.any():
            up, first, count = np.unique(p[seen], return_index=True, return_counts=True)
            length[up] += count * length[own[seen][first]]
            old = group[up]
            order = np.lexsort((count, old))
            up, old, count = up[order], old[order], count[order]
            edge = np.flatnonzero(np.diff(old, prepend=-1))
            many = np.diff(np.append(edge, len(old)))
            end = group_end[old[edge]]
            target = ragged(end - many, many)
            # what stands in the target slots and stays takes the slots that are left
            marked[up] = True
            there = sa[target]
            stays = there[~marked[there]]
            if len(stays):
                vacant = slot[up]
                vacant = vacant[vacant < np.repeat(end - many, many)]
                sa[vacant], slot[stays] = stays, vacant
            marked[up] = False
            sa[target], slot[up] = up, target
            group_end[old[edge]] = end - many  # a group of which all moved is overwritten just below
            run = np.flatnonzero(np.diff(old, prepend=-1) | np.diff(count, prepend=-1))
            run_size = np.diff(np.append(run, len(old)))
            group[up] = np.repeat(target[run], run_size)
            group_end[target[run]] = target[run] + run_size
        open_to = top
        left = open_to > low
        open_to, low = open_to[left], low[left]
    return emit(sa, group, length, begin, n), length


def emit(sa: np.ndarray, group: np.ndarray, length: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Order the members of the groups; every round emits the groups whose next smaller suffixes are all in place."""
    sa = sa.copy()
    rank = np.full(n + 1, -1, np.int64)
    rank[n] = 0
    first = np.flatnonzero(np.diff(group[sa], prepend=-1))
    size = np.diff(np.append(first, n))
    rank[sa[first[size == 1]]] = first[size == 1]
    first, size = first[size > 1], size[size > 1]
    while len(first):
        own = sa[ragged(first, size)]
        g = np.repeat(np.arange(len(first)), size)
        nxt = np.minimum(own + length[own], n)
        inside = np.zeros(len(own), np.int64)  # repeats of the prefix before the group is left
        same = np.flatnonzero((nxt < n) & (group[np.minimum(nxt, n - 1)] == group[own]))
        while len(same):
            inside[same] += 1
            nxt[same] = nxt[same] + length[nxt[same]]
            same = same[(nxt[same] < n) & (group[np.minimum(nxt[same], n - 1)] == group[own[same]])]
        waits = np.bincount(g, rank[nxt] < 0, len(first)) > 0
        if waits.all():
            raise ValueError("a text does not end in its smallest letter")
        ready = ~waits[g]
        own, g, nxt, inside = own[ready], g[ready], nxt[ready], inside[ready]
        # suffixes that leave the group after as many repeats go by where they then are
        order = np.lexsort((rank[nxt], inside, g))
        slots = ragged(first[~waits], size[~waits])
        sa[slots] = own[order]
        rank[own[order]] = slots
        first, size = first[waits], size[waits]
    return sa
