"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

WORD = 8
#: Bytes that multikey quicksort looks at, in words of 8; longer common prefixes are ordered by blind tries.
SHALLOW = 48


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


class BlindTrie:
    """A compacted trie that keeps only branching depths and branching bytes; strings are compared once each."""

    def __init__(self, strings: list[bytes], ids: list[int]):
        self.strings = strings
        self.root: list = [0, {}]  # inner: [depth, {byte: node}]; leaf: [ids]
        for i in ids:
            self.insert(i)

    def insert(self, i: int) -> None:
        s = self.strings[i]
        node = self.root
        while len(node) == 2:  # blind descent to some leaf
            depth, children = node
            if not children:
                children[s[depth] if depth < len(s) else -1] = [[i]]
                return
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = self.strings[node[0][0]]
        same = common_prefix(s, other)
        if same == len(s) == len(other):
            node[0].append(i)
            return
        parent, node = None, self.root
        while len(node) == 2 and node[0] < same:
            parent, node = node, node[1][s[node[0]]]
        mine = s[same] if same < len(s) else -1
        if len(node) == 2 and node[0] == same:
            node[1][mine] = [[i]]
            return
        split = [same, {other[same] if same < len(other) else -1: node, mine: [[i]]}]
        if parent is None:
            self.root = split
        else:
            parent[1][s[parent[0]]] = split

    def walk(self) -> tuple[list[int], list[int]]:
        """Sorted ids, and the common prefix of each with the one before (0 for the first)."""
        order: list[int] = []
        lcp: list[int] = []
        stack: list = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if len(node) == 1:
                size = len(self.strings[node[0][0]])
                lcp += [shared, *[size] * (len(node[0]) - 1)]
                order += node[0]
                continue
            depth, children = node
            for k, byte in enumerate(sorted(children, reverse=True)):
                stack.append((children[byte], depth if k < len(children) - 1 else shared))
        return order, lcp


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows sorted by group and then string; the common prefix of each with the one before, -1 at a group's start."""
    n = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    flat = np.frombuffer(b"".join([s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings]), np.uint8).reshape(n, SHALLOW)
    words = flat.view(">u8").astype(np.uint64)
    last = words.shape[1]
    order = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.diff(group[order], prepend=group[order[0]] - 1 if n else 0))
    end = np.append(start[1:], n)
    depth = np.zeros(len(start), np.int64)
    deep: list[tuple[int, int]] = []
    while True:
        big = end - start > 1
        done = depth == last
        deep += zip(start[big & done].tolist(), end[big & done].tolist())
        live = big & ~done
        start, end, depth = start[live], end[live], depth[live]
        if not len(start):
            break
        sizes = end - start
        seg = np.repeat(np.arange(len(start)), sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - start, sizes)
        rows = order[place]
        key = words[rows, depth[seg]]
        middle = words[order[start + sizes // 2], depth]  # a pivot for every segment, then three parts at once
        part = seg * 3 + 1 + (key > middle[seg]).astype(np.int64) - (key < middle[seg])
        sort = np.argsort(part, kind="stable")
        order[place] = rows[sort]
        part = part[sort]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        starts, ends = place[cut], np.append(place[cut[1:] - 1] + 1, place[-1] + 1)
        depth = depth[part[cut] // 3] + (part[cut] % 3 == 1)
        start, end = starts, ends
    lcp = np.zeros(n, np.int64)
    if n:
        a, b = order[1:], order[:-1]
        differ = flat[a] != flat[b]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), SHALLOW)
        lcp[1:] = np.minimum(lcp[1:], np.minimum(lengths[a], lengths[b]))
    for s, e in deep:
        ids, shared = BlindTrie(strings, order[s:e].tolist()).walk()
        order[s:e] = ids
        lcp[s + 1 : e] = shared[1:]
    for s, e in deep:  # neighbours of a reordered group changed
        for i in (s, e):
            if 0 < i < n:
                lcp[i] = common_prefix(strings[order[i]], strings[order[i - 1]])
    if n:
        lcp[np.diff(group[order], prepend=group[order[0]] - 1) != 0] = -1
    return order, lcp
