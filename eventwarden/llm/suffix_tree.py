"""Suffix trees of number sequences, and common extensions of two places in constant time.

The tree grows by Ukkonen's rules. An Euler tour of it lists string depths; the longest common extension of
two suffixes is the smallest depth on the tour between their leaves, which block minima and a sparse table
over the blocks answer for all pairs of places at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16


class SuffixTree:
    """Tree of ``letters`` (numbers from 1) and an end sign 0, which is smaller than all letters."""

    def __init__(self, letters: list[int]):
        self.letters = s = [*letters, 0]
        self.width = size = max(s) + 1
        far = len(s)
        child: dict[int, int] = {}
        begin, end, link, suffix = [0], [0], [0], [-1]
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = node * size + s[edge]
                after = child.get(key)
                if after is None:
                    child[key] = len(begin)
                    begin.append(i)
                    end.append(far)
                    link.append(0)
                    suffix.append(i - waiting + 1)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    start = begin[after]
                    span = end[after] - start
                    if length >= span:
                        edge += span
                        length -= span
                        node = after
                        continue
                    if s[start + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(begin)
                    child[key] = middle
                    begin += (start, i)
                    end += (start + length, far)
                    link += (0, 0)
                    suffix += (-1, i - waiting + 1)
                    begin[after] = start + length
                    child[middle * size + c] = middle + 1
                    child[middle * size + s[start + length]] = after
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.begin, self.end, self.suffix = begin, end, suffix
        keys = np.fromiter(child.keys(), np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)
        parents = keys[order] // size
        self.below = nodes[order].tolist()
        self.first = np.searchsorted(parents, np.arange(len(begin) + 1)).tolist()

    def tour(self) -> tuple[list[int], list[int], list[int]]:
        """String depths along the Euler tour, each suffix's place on it, and the suffixes in order."""
        below, first, begin, end, suffix = self.below, self.first, self.begin, self.end, self.suffix
        depths, places, ordered = [0], [0] * len(self.letters), []
        stack = [(0, 0, first[0])]
        while stack:
            node, depth, spot = stack.pop()
            if spot == first[node + 1]:
                if stack:
                    depths.append(stack[-1][1])
                continue
            stack.append((node, depth, spot + 1))
            after = below[spot]
            own = suffix[after]
            if own >= 0:
                places[own] = len(depths)
                ordered.append(own)
                depths.append(end[after] - own)
                depths.append(depth)
            else:
                deeper = depth + end[after] - begin[after]
                depths.append(deeper)
                stack.append((after, deeper, first[after]))
        return depths, places, ordered

    def downwards(self) -> list[int]:
        """The suffixes in the order in which larger letters come first, and still the end sign before all."""
        below, first, suffix, letters, begin = self.below, self.first, self.suffix, self.letters, self.begin
        ordered, stack = [], [0]
        while stack:
            node = stack.pop()
            if suffix[node] >= 0:
                ordered.append(suffix[node])
                continue
            low, high = first[node], first[node + 1]
            # The last one pushed is visited first.
            if letters[begin[below[low]]] == 0:
                stack += below[low + 1:high]
                stack.append(below[low])
            else:
                stack += below[low:high]
        return ordered


class Extensions:
    """Longest common extensions to the right of any two places of a sequence."""

    def __init__(self, depths: list[int], places: list[int]):
        self.places = np.array(places, dtype=np.int64)
        count = -(-len(depths) // BLOCK)
        self.depths = np.full(count * BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        self.depths[:len(depths)] = depths
        blocks = self.depths.reshape(count, BLOCK)
        self.from_left = np.minimum.accumulate(blocks, axis=1).ravel()
        self.to_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        width = 1
        while 2 * width <= count:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def between(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The smallest depth on the tour from ``left`` to ``right``, both included."""
        low, high = left // BLOCK, right // BLOCK
        out = np.minimum(self.to_right[left], self.from_left[right])
        inner = np.flatnonzero(high - low > 1)
        if len(inner):
            a, b = low[inner] + 1, high[inner]
            level = np.frexp((b - a).astype(float))[1] - 1
            for k in np.unique(level):
                own = level == k
                row = self.table[k]
                spot = inner[own]
                out[spot] = np.minimum(out[spot], np.minimum(row[a[own]], row[b[own] - (1 << int(k))]))
        same = np.flatnonzero(low == high)
        if len(same):
            a, b = left[same], right[same]
            best = self.depths[a]
            for k in range(1, BLOCK):
                best = np.minimum(best, self.depths[np.minimum(a + k, b)])
            out[same] = best
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that agree from places i and j on; the places must differ. The end counts as a place."""
        a, b = self.places[i], self.places[j]
        return self.between(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def next_smaller(ordered: list[int]) -> np.ndarray:
    """For every suffix, the next one to the right that comes earlier in ``ordered``; the last place for none.

    From a place to its next smaller suffix reaches the longest Lyndon word that begins there.
    """
    count = len(ordered)
    rank = [0] * count
    for n, place in enumerate(ordered):
        rank[place] = n
    found = [count - 1] * count
    stack: list[int] = []
    for place in range(count - 1, -1, -1):
        own = rank[place]
        while stack and rank[stack[-1]] > own:
            stack.pop()
        found[place] = stack[-1] if stack else count - 1
        stack.append(place)
    return np.array(found[:-1], dtype=np.int64)
