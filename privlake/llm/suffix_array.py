"""Suffix array by linear grouping: Lyndon-prefix groups in descending order, then each group's order, with no recursion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(s: Sequence[int]) -> list[int]:
    """Starts of the suffixes of `s` in order. The last symbol must be its only smallest one.

    First phase: suffixes start in groups by their first symbol. Groups are taken from the highest to the lowest. A member's pointer
    leads to the nearest earlier suffix of a lower group; suffixes that pointers of one group lead to move up, those with more pointers
    further, to new groups right behind their old ones. At the end, a group holds the suffixes with one longest Lyndon prefix. Second phase:
    from the lowest suffix on, the suffix before each placed one, and along its pointers all that are not placed yet, take the next place of
    their groups.
    """
    n = len(s)
    values = np.asarray(s)
    by = np.argsort(values, kind="stable")
    ordered = values[by]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.flatnonzero(new)
    begins = np.repeat(first, np.diff(np.append(first, n)))
    group_array = np.empty(n, np.int64)
    group_array[by] = begins
    place_array = np.empty(n, np.int64)
    place_array[by] = np.arange(n)
    group, place, members = group_array.tolist(), place_array.tolist(), by.tolist()
    size = [0] * n
    for b, m in zip(first.tolist(), np.diff(np.append(first, n)).tolist(), strict=True):
        size[b] = m
    unknown = -2
    lower = [unknown] * n

    end = n
    while end:
        begin = group[members[end - 1]]
        if end - begin == 1:
            # most groups: one pointer, which lifts one suffix
            i = members[begin]
            p = i - 1
            while p >= 0 and group[p] >= begin:
                p = lower[p]
            lower[i] = p
            end = begin
            if p >= 0:
                g = group[p]
                many = size[g]
                if many > 1:
                    tail, at = g + many - 1, place[p]
                    q = members[tail]
                    members[at], place[q] = q, at
                    members[tail], place[p] = p, tail
                    group[p] = tail
                    size[g], size[tail] = many - 1, 1
            continue
        counts: dict[int, int] = {}
        for i in members[begin:end]:
            # a member may lead past others of its group whose pointers are not known yet: those come first
            waiting = [(i, i - 1)] if lower[i] == unknown else []
            while waiting:
                i, j = waiting.pop()
                while j >= 0 and group[j] >= begin and lower[j] != unknown:
                    j = lower[j]
                if j >= 0 and group[j] >= begin:
                    waiting.append((i, j))
                    waiting.append((j, j - 1))
                    continue
                lower[i] = j
                if j >= 0:
                    counts[j] = counts.get(j, 0) + 1
        end = begin
        if not counts:
            continue
        levels: dict[int, list[int]] = {}
        for p, c in counts.items():
            levels.setdefault(c, []).append(p)
        for level in sorted(levels, reverse=True):  # m pointers have at most sqrt(2 m) different counts
            moved: dict[int, list[int]] = {}
            for p in levels[level]:
                moved.setdefault(group[p], []).append(p)
            for g, who in moved.items():
                all_, many = size[g], len(who)
                if many == all_:
                    continue
                tail = g + all_
                for p in who:
                    tail -= 1
                    q, at = members[tail], place[p]
                    members[at], place[q] = q, at
                    members[tail], place[p] = p, tail
                    group[p] = g + all_ - many
                size[g], size[g + all_ - many] = all_ - many, many

    out, free, placed = [0] * n, list(range(n)), [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            at = free[g]
            out[at] = j
            free[g] = at + 1
            placed[j] = True
            j = lower[j]
    return out
