"""Linear suffix sorting by grouping: suffixes are put into groups by their Lyndon prefixes, the groups are
refined in descending order with the help of previous smaller suffixes, and then each group's order is given out in one
ascending pass. There is no recursion and no renaming."""

from __future__ import annotations


def suffix_array(seq: list[int]) -> list[int]:
    """The order of all suffixes of a sequence of numbers; a suffix that begins another comes before it."""
    n = len(seq)
    if n == 0:
        return []
    order = sorted(range(n), key=seq.__getitem__)
    place = [0] * n  # where a suffix stands in `order`
    group = [0] * n  # where its group begins
    for r, i in enumerate(order):
        place[i] = r
        group[i] = group[order[r - 1]] if r and seq[order[r - 1]] == seq[i] else r
    end = {}  # begin of a group -> its last place
    for r, i in enumerate(order):
        end[group[i]] = r
    before = [-1] * n  # previous suffix of a lower group, as seen when the suffix's own group was settled
    jump = list(range(-1, n - 1))  # the same, shortened where known
    top = n - 1
    while top >= 0:
        begin = group[order[top]]
        times: dict[int, int] = {}
        for i in sorted(order[begin: top + 1]):
            j = i - 1
            while j >= 0 and group[j] >= begin:
                j = jump[j]
            before[i] = jump[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            levels: dict[int, list[int]] = {}
            for j, m in times.items():
                levels.setdefault(m, []).append(j)
            for m in sorted(levels, reverse=True):
                moved: dict[int, int] = {}
                for j in levels[m]:  # to the end of its group
                    b = group[j]
                    k = moved.get(b, 0)
                    last = end[b] - k
                    other, here = order[last], place[j]
                    order[last], order[here] = j, other
                    place[j], place[other] = last, here
                    moved[b] = k + 1
                for b, k in moved.items():
                    first = end[b] - k + 1
                    if first > b:
                        end[first] = end[b]
                        end[b] = first - 1
                        for r in range(first, first + k):
                            group[order[r]] = first
        top = begin - 1
    out = [-1] * n
    free = {b: b for b in end}
    placed = bytearray(n)
    for r in range(-1, n):
        j = (out[r] if r >= 0 else n) - 1
        while j >= 0 and not placed[j]:
            b = group[j]
            out[free[b]] = j
            free[b] += 1
            placed[j] = 1
            j = before[j]
    return out
