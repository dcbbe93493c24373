"""BK-trees of bit fingerprints, many small ones at a time.

A child hangs at the integer Hamming distance of its subtree's points to the parent. A query that is d away from a node
needs only the children at d - radius to d + radius. Trees are grown, and queries sent down, level by level for all
trees of a block at once; a large tree is searched outward from one point at a time, so that the points of one
component are found once and not in pairs.
"""

from __future__ import annotations

import numpy as np

#: Trees up to this size send all their points down at once.
SMALL = 256
#: Words that queries meet at most in one go, so that memory doesn't grow with trees or their number. One query meets no
#: more than its tree.
MEETINGS = 1 << 20


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance by row of unsigned 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """One tree for each group of points. points: rows x lanes; group: tree of each point, from 0 without gaps."""

    def __init__(self, points: np.ndarray, group: np.ndarray):
        self.points = points
        far = 64 * points.shape[1] + 1
        sizes = np.bincount(group)
        order = np.argsort(group, kind="stable")
        group = group[order]
        pivots, parents, edges = [], [], []
        base, parent_of_group, edge_of_group = 0, np.full(int(group[-1]) + 1 if len(group) else 0, -1), None
        while len(order):
            first = np.concatenate(([True], group[1:] != group[:-1]))
            pivot = order[first]
            pivots.append(pivot)
            parents.append(parent_of_group)
            edges.append(np.zeros(len(pivot), np.int64) if edge_of_group is None else edge_of_group)
            order, group = order[~first], group[~first]
            d = distances(points[order], points[pivot[group]])
            code = group * far + d
            sort = np.argsort(code, kind="stable")
            order, code = order[sort], code[sort]
            fresh = np.concatenate(([True], code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
            parent_of_group, edge_of_group = base + code[fresh] // far, code[fresh] % far
            group = np.cumsum(fresh) - 1
            base += len(pivot)
        self.roots = len(pivots[0]) if pivots else 0
        self.pivot = np.concatenate(pivots) if pivots else np.zeros(0, np.int64)
        parent = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        # nodes are in order of their parents, so a node's children are a run
        self.edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        nodes = np.arange(len(self.pivot))
        self.first_child = np.searchsorted(parent[self.roots :], nodes, "left") + self.roots
        self.n_children = np.searchsorted(parent[self.roots :], nodes, "right") + self.roots - self.first_child
        self.sizes = sizes

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) for all points within the radius of points[query] in the tree of its root."""
        turn = np.cumsum(self.sizes[roots] * self.points.shape[1]) // MEETINGS
        cuts = np.flatnonzero(turn[1:] != turn[:-1]) + 1
        turns = [self._descend(q, r, radius) for q, r in zip(np.split(queries, cuts), np.split(roots, cuts))]
        return tuple(np.concatenate(x) for x in zip(*turns))

    def _descend(self, q: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        found_q, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(q):
            d = distances(self.points[q], self.points[self.pivot[node]])
            near = d <= radius
            found_q.append(q[near])
            found_p.append(self.pivot[node[near]])
            n = self.n_children[node]
            child = np.repeat(self.first_child[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, d = np.repeat(q, n), np.repeat(d, n)
            follow = np.abs(self.edge[child] - d) <= radius
            q, node = q[follow], child[follow]
        return np.concatenate(found_q), np.concatenate(found_p)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable over the links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(label, before):
            return label


def _outward(points: np.ndarray, radius: int) -> np.ndarray:
    """Labels of one large tree's points: each found point leaves the search, so a dense group costs its size, not its pairs."""
    n = len(points)
    label = np.full(n, -1)
    tree, members = None, np.arange(n)
    frontier = np.zeros(0, np.int64)
    while len(members):
        if tree is None or 2 * len(members) < len(tree_of):
            tree_of = members
            tree = Forest(points[tree_of], np.zeros(len(tree_of), np.int64))
        if not len(frontier):
            if len(members) <= SMALL:
                inner = Forest(points[members], np.zeros(len(members), np.int64))
                every = np.arange(len(members))
                a, b = inner.within(every, np.zeros_like(every), radius)
                label[members] = members[_labels(len(members), a, b)]
                break
            frontier = members[:1]
            label[frontier] = frontier
        at_once = max(1, MEETINGS // (len(tree_of) * points.shape[1]))
        batch, frontier = frontier[:at_once], frontier[at_once:]
        # queries may have left the tree: they go down it as points beside it
        tree.points = np.concatenate([points[tree_of], points[batch]])
        q = len(tree_of) + np.arange(len(batch))
        a, b = tree.within(q, np.zeros_like(q), radius)
        hit = tree_of[b]
        new = hit[label[hit] < 0]
        label[new] = label[batch[0]]
        frontier = np.concatenate([frontier, np.unique(new)])
        members = members[label[members] < 0]
    return label


def spanning_links(points: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of point indices that connect, within each group, exactly the points which chains of distances up to
    the radius connect: one link for each point but one of a component."""
    out_a, out_b = [], []
    sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    small = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= SMALL))
    if len(small):
        _, own = np.unique(group[small], return_inverse=True)
        forest = Forest(points[small], own)
        every = np.arange(len(small))
        a, b = forest.within(every, own, radius)
        label = _labels(len(small), a, b)
        child = np.flatnonzero(label != every)
        out_a.append(small[label[child]])
        out_b.append(small[child])
    for g in np.flatnonzero(sizes > SMALL):
        mine = np.flatnonzero(group == g)
        label = _outward(points[mine], radius)
        child = np.flatnonzero(label != np.arange(len(mine)))
        out_a.append(mine[label[child]])
        out_b.append(mine[child])
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
