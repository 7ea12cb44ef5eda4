"""Linear suffix sorting by grouping (Lyndon prefixes), for lists of small whole numbers.

Suffixes start in groups by their first symbol.  Groups are taken in descending order.  All positions
of the group taken are removed from the list of open positions, in ascending order; the open position
then left of one is its previous smaller suffix, and the one right of it, before it is removed, its
next smaller one.  A group's common prefix is final when it is taken, and it continues the prefix of
the previous smaller suffixes: these leave their groups for new ones just above, by how many times
the prefix was appended.  Afterwards two suffixes of a group are ordered as their next smaller
suffixes are, so going through the array from the front and placing, for every suffix met, those whose
next smaller suffix it is, fills all groups in order.  Nothing is renamed and nothing recurs.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of all suffixes of text in ascending order; a suffix that is a prefix of another comes first."""
    n = len(text)
    if not n:
        return []
    symbols = sorted(set(text))
    rank = {s: g for g, s in enumerate(symbols)}
    group = [rank[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    above[-1] = -1
    # Open positions are a list linked both ways; position -1 is the last entry of left and right.
    left, right = list(range(-1, n)), list(range(1, n + 2))
    following = [n] * n
    taken: list[int] = []
    sizes: list[int] = []
    g = len(symbols) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        members[g] = []
        if mine:
            mine.sort()
            times: dict[int, int] = {}
            for i in mine:
                before, after = left[i], right[i]
                following[i] = after
                right[before] = after
                left[after] = before
                if before >= 0:
                    times[before] = times.get(before, 0) + 1
            taken += mine
            sizes.append(len(mine))
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                moved.setdefault((-k, group[p]), []).append(p)
            for k, home in sorted(moved):
                new = len(members)
                part = moved[k, home]
                members.append(part)
                for p in part:
                    group[p] = new
                up = above[home]
                below.append(home)
                above.append(up)
                above[home] = new
                if up >= 0:
                    below[up] = new
        g = below[g]
    # Free slots: groups were taken from the largest to the smallest.
    slot, at = [0] * n, n
    place, free = 0, []
    for number, size in enumerate(sizes):
        at -= size
        free.append(at)
        for i in taken[place:place + size]:
            slot[i] = number
        place += size
    first, other = [-1] * (n + 1), [-1] * n
    for i, j in enumerate(following):
        other[i] = first[j]
        first[j] = i
    order = [0] * n
    j = first[n]
    while j >= 0:
        order[free[slot[j]]] = j
        free[slot[j]] += 1
        j = other[j]
    for x in range(n):
        j = first[order[x]]
        while j >= 0:
            order[free[slot[j]]] = j
            free[slot[j]] += 1
            j = other[j]
    return order
