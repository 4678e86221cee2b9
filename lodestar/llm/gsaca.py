"""Linear grouping construction of a suffix array.

Suffixes are grouped by their longest Lyndon prefix. Groups are taken in descending order: the previous-smaller pointer
of each suffix of a group names the suffix whose Lyndon prefix the group's word extends, and those suffixes leave their
group for a new one right above it. A second walk in ascending order then emits each group's suffixes in the order of
what follows their Lyndon prefixes. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order; a suffix that is a prefix of another comes first."""
    n = len(text)
    if n < 2:
        return list(range(n))
    sa = sorted(range(n), key=text.__getitem__)
    rank, size, at = [0] * n, [0] * n, [0] * n
    start = 0
    for i, s in enumerate(sa):
        if i and text[s] != text[sa[i - 1]]:
            start = i
        rank[s] = start
        size[start] += 1
        at[s] = i
    prev, jump = [-1] * n, [-1] * n
    count = [0] * n
    end = n - 1
    while end >= 0:
        low = rank[sa[end]]
        # A text's end is smaller than any symbol, so that pointers may run off the front only.
        if low == end:
            s = sa[end]
            p = s - 1
            while p >= 0 and rank[p] >= low:
                p = jump[p]
            prev[s] = jump[s] = p
            if p >= 0:
                # One suffix: it leaves its group for a new one on top of it.
                g = rank[p]
                k = size[g] - 1
                if k:
                    e = g + k
                    o, i = sa[e], at[p]
                    sa[i], at[o], sa[e], at[p] = o, i, p, e
                    size[g], size[e], rank[p] = k, 1, e
            end -= 1
            continue
        by_count: dict[int, list[int]] = {}
        seen: list[int] = []
        for s in sorted(sa[low : end + 1]):
            p = s - 1
            while p >= 0 and rank[p] >= low:
                p = jump[p]
            q = s - 1
            while q > p:
                q, jump[q] = jump[q], p
            prev[s] = jump[s] = p
            if p >= 0:
                if not count[p]:
                    seen.append(p)
                count[p] += 1
        for p in seen:
            by_count.setdefault(count[p], []).append(p)
            count[p] = 0
        for c in sorted(by_count, reverse=True):
            for p in by_count[c]:
                g = rank[p]
                k = size[g] = size[g] - 1
                e = g + k
                o, i = sa[e], at[p]
                sa[i], at[o], sa[e], at[p] = o, i, p, e
            # What has left a group lies behind it; sizes of new groups count up from 0 once all starts are known.
            top = [rank[p] + size[rank[p]] for p in by_count[c]]
            for p, e in zip(by_count[c], top, strict=True):
                rank[p] = e
                size[e] += 1
        end = low - 1
    return _emit(n, sa, rank, prev)


def _emit(n: int, sa: list[int], rank: list[int], prev: list[int]) -> list[int]:
    """Ascending walk: each placed suffix places those whose Lyndon prefix ends where it begins."""
    out, free, done = [-1] * n, list(range(n)), [False] * n
    s = n - 1  # what follows the last suffixes is the empty one
    while s >= 0 and not done[s]:
        g = rank[s]
        out[free[g]] = s
        free[g] += 1
        done[s] = True
        s = prev[s]
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = rank[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = prev[s]
    return out
