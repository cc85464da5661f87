"""Signature trees over token sets: every pair of sets above a Jaccard threshold, one link per joined component.

A leaf node holds sets of neighbouring sizes; an inner node holds nodes. Each node carries the OR of its members'
token bitmaps, the range of their sizes, and the most tokens any member loses to shared bits (its slack). Two members
of two nodes can share at most

    popcount(OR & OR) + the smaller slack

tokens, and must share 4/9 of their added sizes (at a threshold of 0.8) and 0.8 of the larger. Node pairs that cannot
reach that are left out together with everything below them, as are node pairs whose members already share a component.
What remains is compared exactly (:class:`Links`), or only told apart by the same bound (:class:`Marks`), which needs the
bitmaps alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAF = 64
FANOUT = 4
LEAST_BITS, MOST_BITS = 128, 16384


class Forest:
    """Union-find with the smallest label as root."""

    def __init__(self, labels: list[int]):
        self.parent = {x: x for x in labels}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


class Node:
    __slots__ = ("first", "last", "children", "any", "least", "most", "slack", "settled")

    def __init__(self, first, last, children, any_, least, most, slack):
        self.first, self.last, self.children, self.any = first, last, children, any_
        self.least, self.most, self.slack, self.settled = least, most, slack, False


def needed(a, b, num: int, den: int):
    """Fewest shared tokens of two sets of these sizes: den * shared >= num * (a + b - shared)."""
    return -((-num * (a + b)) // (num + den))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shared values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def width(size: int) -> int:
    """Bits of a set's bitmap: at least four per token, up to a bound."""
    bits = LEAST_BITS
    while bits < min(4 * size, MOST_BITS):
        bits *= 2
    return bits


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    marks = np.zeros((len(sets), bits), dtype=bool)
    marks[np.repeat(np.arange(len(sets)), [len(s) for s in sets]),
          (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks, axis=1, bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap the same set has at a smaller width: halves laid over each other."""
    while len(bitmap) * 64 > bits:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] | bitmap[half:]
    return bitmap


class Tree:
    """Members in the order of the leaves, and the dual traversal over node pairs that bounds leave open."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        # similar sets side by side: by size band, then by the lowest bits of the bitmap
        self.order = np.lexsort((maps[:, 0], np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.25))))
        self.sizes, self.maps = sizes[self.order], maps[self.order]
        self.slacks = self.sizes - np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)
        self.root = self._built()

    def _built(self) -> Node:
        n = len(self.sizes)
        level = []
        for first in range(0, n, LEAF):
            last = min(first + LEAF, n)
            part = slice(first, last)
            level.append(Node(first, last, None, np.bitwise_or.reduce(self.maps[part], axis=0),
                              int(self.sizes[part].min()), int(self.sizes[part].max()), int(self.slacks[part].max())))
        while len(level) > 1:
            level = [self._parent(level[i:i + FANOUT]) for i in range(0, len(level), FANOUT)]
        return level[0]

    @staticmethod
    def _parent(children: list[Node]) -> Node:
        return Node(children[0].first, children[-1].last, children,
                    np.bitwise_or.reduce(np.stack([c.any for c in children]), axis=0),
                    min(c.least for c in children), max(c.most for c in children), max(c.slack for c in children))

    def _apart(self, a: Node, b: Node) -> bool:
        """No member of one can reach the threshold with a member of the other."""
        num, den = self.num, self.den
        if a.most * den < num * b.least or b.most * den < num * a.least:
            return True
        reach = min(int(np.bitwise_count(a.any & b.any).sum()) + min(a.slack, b.slack), a.most, b.most)
        return reach < max(needed(a.least, b.least, num, den), -(-num * max(a.least, b.least) // den))

    def open_pairs(self, a: Node, b: Node, wanted: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Member pairs of two leaves that sizes and bitmaps leave open, and how far above need their bound lies."""
        num, den = self.num, self.den
        left, right = np.arange(a.first, a.last), np.arange(b.first, b.last)
        sizes_a, sizes_b = self.sizes[left][:, None], self.sizes[right][None, :]
        open_ = (sizes_a * den >= num * sizes_b) & (sizes_b * den >= num * sizes_a) & wanted(left, right)
        if a is b:
            open_ &= left[:, None] < right[None, :]
        i, j = np.nonzero(open_)
        i, j = left[i], right[j]
        both = np.bitwise_count(self.maps[i] & self.maps[j]).sum(axis=1, dtype=np.int64)
        both += np.minimum(self.slacks[i], self.slacks[j])
        spare = both - needed(self.sizes[i], self.sizes[j], num, den)
        keep = spare >= 0
        return i[keep], j[keep], spare[keep]

    def walk(self, settled: Callable[[Node, Node], bool], leaves: Callable[[Node, Node], None]) -> None:
        pending = [(self.root, self.root)]
        while pending:
            a, b = pending.pop()
            if settled(a, b) or (a is not b and self._apart(a, b)):
                continue
            if a.children is None and b.children is None:
                leaves(a, b)
            elif a is b:
                # own pairs last in, so first out: members join before nodes meet
                pending += [(x, y) for i, x in enumerate(a.children) for y in a.children[i + 1:]]
                pending += [(x, x) for x in a.children]
            elif b.children is None or (a.children is not None and a.last - a.first >= b.last - b.first):
                pending += [(x, b) for x in a.children]
            else:
                pending += [(a, y) for y in b.children]


class Links:
    """Joins the labels of sets that reach the threshold, compared exactly."""

    def __init__(self, sets: list[np.ndarray], labels: list[int], num: int, den: int):
        sizes = np.array([len(s) for s in sets])
        self.tree = Tree(sizes, bitmaps(sets, width(int(sizes.max()))), num, den)
        self.sets = [sets[i] for i in self.tree.order]
        self.labels = [labels[i] for i in self.tree.order]
        self.forest = Forest(self.labels)

    def _joined(self, a: Node, b: Node) -> bool:
        """All members of both nodes are in one component; once true of a node, true for ever."""
        for node in (a, b):
            if not node.settled:
                first = self.forest.root(self.labels[node.first])
                if any(self.forest.root(x) != first for x in self.labels[node.first + 1:node.last]):
                    return False
                node.settled = True
        return self.forest.root(self.labels[a.first]) == self.forest.root(self.labels[b.first])

    def _compare(self, a: Node, b: Node) -> None:
        root, labels, tree = self.forest.root, self.labels, self.tree
        names = lambda part: np.array([root(labels[i]) for i in part])
        i, j, spare = tree.open_pairs(a, b, lambda x, y: names(x)[:, None] != names(y)[None, :])
        for k in np.argsort(-spare, kind="stable"):
            x, y = int(i[k]), int(j[k])
            if root(labels[x]) != root(labels[y]) and overlap(self.sets[x], self.sets[y]) >= needed(
                    tree.sizes[x], tree.sizes[y], tree.num, tree.den):
                self.forest.join(labels[x], labels[y])

    def joined(self) -> dict[int, int]:
        """Each label's smallest joined label."""
        self.tree.walk(self._joined, self._compare)
        return {x: self.forest.root(x) for x in self.forest.parent}


def by_width(maps: list[np.ndarray]):
    """Sets that can be alike have bitmaps of the same width or the next one: (width, positions) of those."""
    widths = np.array([len(m) * 64 for m in maps])
    for bits in np.unique(widths):
        part = np.flatnonzero((widths == bits) | (widths == 2 * bits))
        if len(part) > 1:
            yield int(bits), part


class Marks:
    """Marks the sets that may reach the threshold with another one, by their bitmaps alone."""

    def __init__(self, sizes: np.ndarray, maps: list[np.ndarray], num: int, den: int):
        self.sizes, self.maps, self.num, self.den = sizes, maps, num, den
        self.marked = np.zeros(len(sizes), dtype=bool)

    def found(self) -> np.ndarray:
        for bits, part in by_width(self.maps):
            self._among(part, bits)
        return self.marked

    def _among(self, part: np.ndarray, bits: int) -> None:
        tree = Tree(self.sizes[part], np.stack([folded(self.maps[i], bits) for i in part]), self.num, self.den)
        marked = self.marked[part][tree.order]

        def settled(a: Node, b: Node) -> bool:
            for node in (a, b):
                node.settled = node.settled or bool(marked[node.first:node.last].all())
            return a.settled and b.settled

        def leaves(a: Node, b: Node) -> None:
            i, j, _ = tree.open_pairs(a, b, lambda x, y: ~(marked[x][:, None] & marked[y][None, :]))
            marked[i] = marked[j] = True

        tree.walk(settled, leaves)
        self.marked[part[tree.order]] |= marked


def across(sizes: np.ndarray, maps: list[np.ndarray], labels: np.ndarray, ranks: np.ndarray, num: int, den: int):
    """Where differently labelled sets that bitmaps leave open have to meet: positions and anchor labels.

    Of a pair, the set whose label ranks higher (then is smaller) stays at its own label; the other one visits it.
    """
    places, anchors = [], []
    for bits, part in by_width(maps):
        tree = Tree(sizes[part], np.stack([folded(maps[i], bits) for i in part]), num, den)
        place = part[tree.order]
        label, rank = labels[place], ranks[place]

        def settled(a: Node, b: Node, label=label) -> bool:
            first = label[a.first]
            return bool((label[a.first:a.last] == first).all() and (label[b.first:b.last] == first).all())

        def leaves(a: Node, b: Node, tree=tree, place=place, label=label, rank=rank) -> None:
            i, j, _ = tree.open_pairs(a, b, lambda x, y: label[x][:, None] != label[y][None, :])
            first = (rank[i] > rank[j]) | (rank[i] == rank[j]) & (label[i] < label[j])
            anchor = np.where(first, label[i], label[j])
            meet = np.unique(np.stack([np.concatenate([place[i], place[j]]), np.concatenate([anchor, anchor])]), axis=1)
            places.append(meet[0])
            anchors.append(meet[1])

        tree.walk(settled, leaves)
    if not places:
        return np.zeros((2, 0), dtype=np.int64)
    return np.unique(np.stack([np.concatenate(places), np.concatenate(anchors)]), axis=1)
