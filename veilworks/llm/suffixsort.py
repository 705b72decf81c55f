"""Deep-shallow sorting of byte strings.

Strings are sorted by multikey quicksort to a shallow depth; those that still agree there share a long prefix and are
put in order by a blind trie, whose nodes know only where their strings part, so that each insertion compares one pair.
"""

from __future__ import annotations

SHALLOW = 24


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be `start` at least."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


class BlindTrie:
    """A node is [depth, {byte: node or list of places}, a place below it]."""

    def __init__(self, strings: list[bytes], start: int):
        self.strings, self.start, self.root = strings, start, None

    def add(self, place: int) -> None:
        s = self.strings[place]
        if self.root is None:
            self.root = [place]
            return
        node = self.root
        while isinstance(node, tuple):  # blindly down to any string
            depth, children, below = node
            node = children.get(_at(s, depth), [below])
        other = self.strings[node[0]]
        shared = common(s, other, self.start)
        if shared == len(s) == len(other):
            same, parent, key = self.root, None, None
            while isinstance(same, tuple):
                parent, key = same, _at(s, same[0])
                same = parent[1][key]
            same.append(place)
            return
        node, parent, key = self.root, None, None
        while isinstance(node, tuple) and node[0] < shared:
            parent, key = node, _at(s, node[0])
            node = parent[1][key]
        if isinstance(node, tuple) and node[0] == shared:
            node[1][_at(s, shared)] = [place]
            return
        split = (shared, {_at(other, shared): node, _at(s, shared): [place]}, place)
        if parent is None:
            self.root = split
        else:
            parent[1][key] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
            elif node is not None:
                out.extend(node)
        return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Places of the strings in sorted order."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        places, depth = stack.pop()
        if len(places) < 2:
            out.extend(places)
            continue
        if depth >= shallow:
            trie = BlindTrie(strings, depth)
            for p in places:
                trie.add(p)
            out.extend(trie.order())
            continue
        pivot = _at(strings[places[len(places) // 2]], depth)
        less, equal, more = [], [], []
        for p in places:
            c = _at(strings[p], depth)
            (less if c < pivot else more if c > pivot else equal).append(p)
        stack.append((more, depth))
        if pivot < 0:  # all ended here
            stack.extend(([p], shallow) for p in reversed(equal))
        else:
            stack.append((equal, depth + 1))
        stack.append((less, depth))
    return out


def neighbours(strings: list[bytes], order: list[int]) -> list[int]:
    """Common prefix of each string in sorted order with the one before it; 0 for the first."""
    return [0] + [common(strings[order[i - 1]], strings[order[i]]) for i in range(1, len(order))]
