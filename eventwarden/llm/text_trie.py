"""A compressed trie of whole texts; every text ends at a node that holds the smallest id inserted with it."""

from __future__ import annotations

from collections.abc import Iterator


def common(a: bytes, at: int, b: bytes, start: int, limit: int) -> int:
    """How many bytes of ``a`` from ``at`` and of ``b`` from ``start`` agree, ``limit`` at most."""
    same, step = 0, 32
    while same < limit:
        step = min(step, limit - same)
        x, y = a[at + same:at + same + step], b[start + same:start + same + step]
        if x == y:
            same += step
            step *= 4
            continue
        while len(x) > 1:
            half = len(x) // 2
            if x[:half] == y[:half]:
                same += half
                x, y = x[half:], y[half:]
            else:
                x, y = x[:half], y[:half]
        return same
    return limit


class Trie:
    """Edges carry stretches of inserted texts, so a text costs at most two nodes, however long it is."""

    def __init__(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.source: list[bytes] = [b""]
        self.begin, self.end = [0], [0]
        self.least: list[int | None] = [None]

    def __len__(self) -> int:
        return len(self.least)

    def _node(self, source: bytes, begin: int, end: int) -> int:
        self.children.append({})
        self.source.append(source)
        self.begin.append(begin)
        self.end.append(end)
        self.least.append(None)
        return len(self.least) - 1

    def insert(self, text: bytes, id: int) -> int:
        """Insert a text; returns the node at which it ends."""
        node, at, size = 0, 0, len(text)
        while at < size:
            below = self.children[node]
            after = below.get(text[at])
            if after is None:
                below[text[at]] = after = self._node(text, at, size)
                at = size
            else:
                source, begin = self.source[after], self.begin[after]
                length = self.end[after] - begin
                same = common(text, at, source, begin, min(length, size - at))
                if same < length:
                    middle = self._node(source, begin, begin + same)
                    below[text[at]] = middle
                    self.begin[after] = begin + same
                    self.children[middle][source[begin + same]] = after
                    after = middle
                at += same
            node = after
        least = self.least[node]
        if least is None or id < least:
            self.least[node] = id
        return node

    def ordered(self) -> Iterator[tuple[bytes, int, int]]:
        """(text, its smallest id, bytes it shares with the text before it) of all texts in byte order."""
        stack = [(0, 0, 0)]
        path = bytearray()
        shared = 0
        while stack:
            node, depth, above = stack.pop()
            shared = min(shared, above)
            del path[above:]
            path += self.source[node][self.begin[node]:self.end[node]]
            if self.least[node] is not None:
                yield bytes(path), self.least[node], shared
                shared = depth
            for _, child in sorted(self.children[node].items(), reverse=True):
                stack.append((child, depth + self.end[child] - self.begin[child], depth))
