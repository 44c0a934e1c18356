"""A prefix tree of ordered token sets, walked by many probes at once.

The tokens that only one set holds take no part; the others are ordered by how many sets hold them, most first, so that
near copies share long paths. A node stands for the tokens of its edge; what lies below it is bounded by the smallest
and largest set, and by the most tokens that still follow.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the matrix of tokens and probes.
MATRIX = 32 << 20


class Node:
    __slots__ = ("children", "edge", "ends", "label", "least", "longest", "most")

    def __init__(self, edge: np.ndarray, ends: np.ndarray, sizes: np.ndarray, longest: int) -> None:
        self.edge, self.ends, self.children = edge, ends, []
        self.least, self.most, self.longest = int(sizes.min()), int(sizes.max()), longest
        self.label = -1  #: of all sets below, if they are one group


def overlap_needed(sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    return -(-percent * (sizes + size) // (100 + percent))


class Trie:
    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        """sets: distinct tokens each. Two link if their intersection is at least percent % of their union."""
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(tokens), np.int64)
        rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
        self.width = int((counts > 1).sum())  # the shared tokens have the first ranks
        ranks, of = rank[which], np.repeat(np.arange(len(sets)), self.sizes)
        shared = ranks < self.width
        self.keys = np.sort(of[shared] * max(1, self.width) + ranks[shared])  # by set, then rank
        self.ends = np.searchsorted(self.keys, (np.arange(len(sets)) + 1) * max(1, self.width))
        self.labels = np.arange(len(sets))
        self.nodes: list[Node] = []
        if self.width:
            self._build()

    def _path(self, i: int) -> np.ndarray:
        return self.keys[(self.ends[i - 1] if i else 0) : self.ends[i]] - i * self.width

    def _build(self) -> None:
        paths = [self._path(i) for i in range(len(self.sizes))]
        order = np.array(sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes()))
        todo = [(0, len(order), 0, None)]
        while todo:
            lo, hi, depth, above = todo.pop()
            first, last = paths[order[lo]], paths[order[hi - 1]]
            common = min(len(first), len(last))
            apart = np.flatnonzero(first[depth:common] != last[depth:common])
            upto = depth + int(apart[0]) if len(apart) else common
            own = lo
            while own < hi and len(paths[order[own]]) == upto:
                own += 1
            below = order[lo:hi]
            node = Node(first[depth:upto], order[lo:own], self.sizes[below], max(len(paths[i]) for i in below) - depth)
            self.nodes.append(node)
            if above is not None:
                above.children.append(node)
            while own < hi:  # a child for each next token
                token, end = paths[order[own]][upto], own + 1
                while end < hi and paths[order[end]][upto] == token:
                    end += 1
                todo.append((own, end, upto, node))
                own = end

    def groups(self) -> np.ndarray:
        """A label for each set, equal within what links connect. Sets that are known to be of one group are not
        compared again."""
        if self.width:
            step = max(16, MATRIX // self.width)
            for i in range(0, len(self.sizes), step):
                for node in reversed(self.nodes):
                    found = {*self.labels[node.ends].tolist(), *(c.label for c in node.children)}
                    node.label = found.pop() if len(found) == 1 else -1
                self._walk(np.arange(i, min(i + step, len(self.sizes))))
        return self.labels

    def _walk(self, probes: np.ndarray) -> None:
        """Depth first; what the probes have in common with a path is counted once for all sets that share it."""
        begun = self.ends[probes[0] - 1] if probes[0] else 0
        keys = self.keys[begun : self.ends[probes[-1]]]
        has = np.zeros((self.width, len(probes)), np.uint8)
        has[keys % self.width, keys // self.width - probes[0]] = 1
        sizes = self.sizes[probes]
        todo = [(self.nodes[0], np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while todo:
            node, active, count = todo.pop()
            n = sizes[active]
            may = (self.percent * n <= 100 * node.most) & (self.percent * node.least <= 100 * n)
            if node.label >= 0:
                may &= self.labels[probes[active]] != node.label
            if len(node.edge):
                left = self.ends[probes[active]] - np.searchsorted(self.keys, probes[active] * self.width + node.edge[0])
                may &= count + np.minimum(left, node.longest) >= overlap_needed(n, node.least, self.percent)
            active, count = active[may], count[may]
            if not len(active):
                continue
            if len(node.edge):
                met = has[node.edge] if len(active) == len(probes) else has[np.ix_(node.edge, active)]
                count = count + met.sum(0, dtype=np.int64)
            for s in node.ends:
                hits = probes[active[count >= overlap_needed(sizes[active], self.sizes[s], self.percent)]]
                self._unite(np.append(hits, s))
            todo += [(child, active, count) for child in node.children]

    def _unite(self, sets: np.ndarray) -> None:
        found = np.unique(self.labels[sets])
        for label in found[1:]:
            self.labels[self.labels == label] = found[0]
