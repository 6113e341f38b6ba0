"""Cover trees of unit vectors and the dual traversal of two groves of them.

A node has a centre, all its points lie within its radius, and its children have the halved
radius; the first child keeps the centre, so the levels are nested. Radii are those reached,
which are at most those allowed. Radii of a tree are chords, sqrt(2 - 2 cos); a grove, several
trees whose nodes are numbered through, has them as angles. The triangle inequality holds for both.

Products are taken in single precision first; what lies nearer to a limit than their rounding
is decided in double precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

#: Rounding of distances that the bounds allow for; pairs so near to the limit are compared themselves.
SLACK = 1e-6
#: Nodes of one root, in the order of their reach, compared at once with nodes of the other grove.
ROWS = 64
#: Products taken at once.
TILE = 1 << 20
#: Components of which products are taken first. With the lengths of what is left they bound a cosine from above.
HEAD = 15
#: Two nodes of at most so many pairs of points are compared point by point.
FLAT = 1 << 14
#: Pairs that are listed; of more, a spanning forest is found without listing them.
LISTED = 1 << 12
#: Edges kept before they become a forest.
EDGES = 1 << 20
#: Points whose distances among each other are taken at once when a tree grows.
GRAM = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def angle(length: np.ndarray) -> np.ndarray:
    """The angle of a chord."""
    return 2.0 * np.arcsin(np.minimum(1.0, np.asarray(length) / 2.0))


def rounding(dim: int) -> float:
    """At least the error of a product of unit vectors in single precision."""
    return 2e-6 + 1.2e-7 * dim


def shorter(units: np.ndarray) -> np.ndarray:
    """Vectors of fewer components whose products are at least those of ``units``."""
    dim = units.shape[1]
    if dim <= 2 * HEAD:
        return units
    some = np.arange(HEAD) * dim // HEAD
    rest = np.delete(units, some, axis=1)
    return np.concatenate([units[:, some], np.sqrt(np.einsum("ij,ij->i", rest, rest))[:, None]], axis=1)


class CoverTree:
    """Nodes are numbered so that children of one node follow one another; the points of a
    node are ``points[start:stop]``."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.units = units = unit(vectors.astype(np.float64))
        points = np.arange(len(units))
        centre, start, stop = [int(np.argmax(units @ units.mean(axis=0)))], [0], [len(units)]
        radius, first, last = [], [], []
        node = 0
        while node < len(centre):
            s, e, c = start[node], stop[node], centre[node]
            first.append(len(centre))
            if e - s == 1:
                radius.append(0.0)
            else:
                own = points[s:e]
                far = chord(units[own] @ units[c])
                far[own == c] = 0.0
                radius.append(float(far.max()))
                half = radius[node] / 2 if radius[node] > SLACK else -1.0
                near = (far <= half) | (own == c)
                at = s
                for c, members in self._groups(own[near], c, own[~near], half):
                    points[at : at + len(members)] = members
                    centre.append(c)
                    start.append(at)
                    at += len(members)
                    stop.append(at)
            last.append(len(centre))
            node += 1
        self.points, self.centre, self.radius = points, np.array(centre), np.array(radius)
        self.start, self.stop, self.first, self.last = (np.array(x) for x in (start, stop, first, last))

    def _groups(self, near: np.ndarray, c: int, rest: np.ndarray, half: float) -> Iterable[tuple[int, Sequence[int]]]:
        """Centres and members of the children, ``near`` being those of the first."""
        yield c, near
        units = self.units
        while len(rest) > GRAM:
            c = int(rest[0])
            near = chord(units[rest] @ units[c]) <= half
            near[0] = True
            yield c, rest[near]
            rest = rest[~near]
        own = units[rest]
        close = chord(own @ own.T) <= half
        np.fill_diagonal(close, True)
        alone = close.sum(axis=1) == 1
        for c in rest[alone].tolist():
            yield c, [c]
        left = ~alone
        for k in np.flatnonzero(left):
            if left[k]:
                members = np.flatnonzero(close[k] & left)
                left[members] = False
                yield int(rest[k]), rest[members]


class Grove:
    """The trees of a block.

    Points are numbered in the order of the trees' nodes, so those of a node are
    ``start .. stop``. The frontier of a tree are its highest nodes that are single points or
    tight, that is within a quarter of the limit; single points come first, and both are
    sorted by reach, the largest angle of their points with the centre of the root.
    """

    def __init__(self, trees: Sequence[CoverTree], cosine: float) -> None:
        tight = float(np.arccos(cosine)) / 4
        sizes = np.cumsum([0, *(len(t.points) for t in trees)])
        nodes = np.cumsum([0, *(len(t.centre) for t in trees)])
        rank = [np.argsort(t.points) for t in trees]
        self.order = [t.points for t in trees]
        self.vectors = np.concatenate([t.vectors[t.points] for t in trees])
        self.centre = np.concatenate([r[t.centre] + s for t, r, s in zip(trees, rank, sizes, strict=False)])
        self.radius = angle(np.concatenate([t.radius for t in trees]))
        self.radius[self.radius > 0] += SLACK
        self.start, self.stop = (np.concatenate([getattr(t, x) + s for t, s in zip(trees, sizes, strict=False)]) for x in ("start", "stop"))
        self.first, self.last = (np.concatenate([getattr(t, x) + n for t, n in zip(trees, nodes, strict=False)]) for x in ("first", "last"))
        self.root = nodes[:-1]
        frontier, reach, at = [], [], []
        for t, n in zip(trees, nodes, strict=False):
            small = angle(t.radius) <= tight
            small |= t.stop - t.start == 1
            # Parents come before their children, so one pass finds the highest small nodes.
            parent = np.zeros(len(small), dtype=np.int64)
            inner = np.flatnonzero(t.last > t.first)
            parent[1:] = np.repeat(inner, (t.last - t.first)[inner])
            own = np.flatnonzero(small & ~small[parent]) if not small[0] else np.array([0])
            single = t.stop[own] - t.start[own] == 1
            far = angle(chord(t.units[t.centre[own]] @ t.units[t.centre[0]])) + SLACK + angle(t.radius[own])
            sort = np.lexsort([far, ~single])
            frontier.append(own[sort] + n)
            reach.append(far[sort])
            at.append((len(own), int(single.sum())))
        ends = np.cumsum([0, *(n for n, _ in at)])
        self.frontier, self.reach = np.concatenate(frontier), np.concatenate(reach)
        #: Of each root: where its single points begin, where its tight nodes begin, and where they end.
        self.at = np.stack([ends[:-1], ends[:-1] + [m for _, m in at], ends[1:]], axis=1)
        self.ready()

    def ready(self) -> Grove:
        """What follows from the rest."""
        self.units = np.empty(self.vectors.shape, dtype=np.float32)
        for k in range(0, len(self.units), 1 << 13):
            self.units[k : k + (1 << 13)] = unit(self.vectors[k : k + (1 << 13)].astype(np.float64))
        self.tops = self.units[self.centre[self.frontier]]
        self.short = shorter(self.tops)
        self.rooted = np.repeat(np.arange(len(self.root)), self.at[:, 2] - self.at[:, 0])
        self.single = self.stop[self.frontier] - self.start[self.frontier] == 1
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("units", "tops", "short", "rooted", "single", "order")}

    def outline(self) -> tuple[np.ndarray, np.ndarray]:
        """Centres and radii of the roots."""
        return self.units[self.centre[self.root]], self.radius[self.root]

    def below(self, node: int) -> np.ndarray:
        a, b = self.first[node], self.last[node]
        return np.arange(a, b) if a < b else np.array([node])


def within_reach(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cosine: float) -> np.ndarray:
    """Which roots of one outline can hold links with which of the other."""
    reach = np.arccos(cosine) + SLACK + a[1][:, None] + b[1][None, :]
    return a[0] @ b[0].T >= np.cos(np.minimum(np.pi, reach)) - rounding(a[0].shape[1])


def forest(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n edges that connect what the edges (x, y) over n nodes connect."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    ends = np.flatnonzero(label != np.arange(n))
    return ends, label[ends]


def spanning(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the rows and, numbered after them, the columns that ``mask`` connects."""
    n, m = mask.shape
    ends = roots = np.zeros(0, dtype=np.int64)
    rest = mask
    while True:
        rows, columns = np.flatnonzero(rest.any(axis=1)), np.flatnonzero(rest.any(axis=0))
        if not len(rows):
            return ends, roots
        x = np.concatenate([ends, rows, columns + n])
        y = np.concatenate([roots, rest[rows].argmax(axis=1) + n, rest[:, columns].argmax(axis=0)])
        ends, roots = forest(x, y, n + m)
        label = np.arange(n + m)
        label[ends] = roots
        rest = mask & (label[:n, None] != label[None, n:])


class Links:
    """Links between the points of two groves, or within one if ``a is b``."""

    def __init__(self, a: Grove, b: Grove, mult_a: np.ndarray, mult_b: np.ndarray, cosine: float) -> None:
        self.a, self.b, self.mult_a, self.mult_b, self.cosine = a, b, mult_a, mult_b, cosine
        self.same, self.limit, self.error = a is b, float(np.arccos(cosine)), rounding(a.vectors.shape[1])
        na, nb = len(a.vectors), len(b.vectors)
        self.deg_a, self.deg_b = np.zeros(na, dtype=np.int64), np.zeros(nb, dtype=np.int64)
        self.range_a, self.range_b = np.zeros(na + 1, dtype=np.int64), np.zeros(nb + 1, dtype=np.int64)
        self.cum_a, self.cum_b = np.concatenate([[0], np.cumsum(mult_a)]), np.concatenate([[0], np.cumsum(mult_b)])
        self.shift, self.total = (0, na) if self.same else (na, na + nb)
        self.x: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        self.y: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        self.held = 0
        #: What the edges joined so far connect.
        self.label = np.arange(self.total)
        #: Sums of multiplicities are exact in this type.
        self.counts = np.float32 if max(self.cum_a[-1], self.cum_b[-1]) < 1 << 24 else np.float64
        self.stack: list[tuple[int, int]] = []

    def edges(self, x: np.ndarray, y: np.ndarray, join: bool = False) -> None:
        self.x.append(x)
        self.y.append(y)
        self.held += len(x)
        if join or self.held > EDGES + 2 * self.total:
            x, y = forest(np.concatenate(self.x), np.concatenate(self.y), self.total)
            self.x, self.y, self.held = [x], [y], len(x)
            self.label = np.arange(self.total)
            self.label[x] = y

    def whole(self, i: int, j: int) -> None:
        """Every point of node i is linked with every point of node j."""
        a, b = self.a, self.b
        for deg, tree, node, cum, other, of in (
            (self.range_a, a, i, self.cum_b, b, j), (self.range_b, b, j, self.cum_a, a, i)
        ):
            weight = cum[other.stop[of]] - cum[other.start[of]]
            deg[tree.start[node]] += weight
            deg[tree.stop[node]] -= weight
        p, q = np.arange(a.start[i], a.stop[i]), np.arange(b.start[j], b.stop[j]) + self.shift
        self.edges(np.concatenate([p, np.full(len(q), p[0])]), np.concatenate([np.full(len(p), q[0]), q]))

    def exact(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether points, one by one, are linked."""
        out = np.zeros(len(p), dtype=bool)
        for k in range(0, len(p), 1 << 14):
            v, w = self.a.vectors[p[k : k + (1 << 14)]].astype(np.float64), self.b.vectors[q[k : k + (1 << 14)]].astype(np.float64)
            value = np.einsum("ij,ij->i", unit(v), unit(w))
            for t in np.flatnonzero(np.abs(value - self.cosine) < 1e-9):
                value[t] = np.dot(v[t], w[t]) / (np.sqrt(np.dot(v[t], v[t])) * np.sqrt(np.dot(w[t], w[t])))
            out[k : k + (1 << 14)] = value >= self.cosine
        return out

    def listed(self, p: np.ndarray, q: np.ndarray, cos: np.ndarray | None = None) -> None:
        """Links of points of a with points of b, one by one."""
        if cos is None:
            cos = np.empty(len(p), dtype=np.float32)
            for k in range(0, len(p), 1 << 14):
                cos[k : k + (1 << 14)] = np.einsum("ij,ij->i", self.a.units[p[k : k + (1 << 14)]], self.b.units[q[k : k + (1 << 14)]])
        good = cos >= self.cosine - self.error
        unsure = np.flatnonzero(good & (cos <= self.cosine + self.error))
        if len(unsure):
            good[unsure] = self.exact(p[unsure], q[unsure])
        p, q = p[good], q[good]
        if len(p):
            np.add.at(self.deg_a, p, self.mult_b[q])
            np.add.at(self.deg_b, q, self.mult_a[p])
            self.edges(p, q + self.shift)

    def points(self, p: np.ndarray, q: np.ndarray, cos: np.ndarray, later: np.ndarray | None = None) -> None:
        """Links of the points p of a with the points q of b; ``later`` says which pairs count."""
        mask = cos >= self.cosine - self.error
        if later is not None:
            mask &= later
        count = np.count_nonzero(mask)
        if not count:
            return
        if count <= LISTED:
            r, c = np.divmod(np.flatnonzero(mask), mask.shape[1])
            self.listed(p[r], q[c], cos[r, c])
            return
        at = np.flatnonzero(mask & (cos <= self.cosine + self.error))
        if len(at):
            r, c = np.divmod(at, mask.shape[1])
            mask[r, c] = self.exact(p[r], q[c])
        rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        if not len(rows):
            return
        mask, p, q = mask[np.ix_(rows, columns)], p[rows], q[columns]
        ones = mask.astype(self.counts)
        self.deg_a[p] += (ones @ self.mult_b[q].astype(self.counts)).astype(np.int64)
        self.deg_b[q] += (self.mult_a[p].astype(self.counts) @ ones).astype(np.int64)
        number = np.concatenate([p, q + self.shift])
        if (self.label[number] != self.label[number[0]]).any():
            x, y = spanning(mask)
            self.edges(number[x], number[y], join=True)

    def meet(self, i: np.ndarray, j: np.ndarray, later: np.ndarray | None = None) -> None:
        """Nodes i of a against nodes j of b; ``later`` says which pairs count."""
        a, b = self.a, self.b
        cos = a.units[a.centre[i]] @ b.units[b.centre[j]].T
        ri, rj = a.radius[i], b.radius[j]
        open_ = cos >= np.cos(min(np.pi, self.limit + SLACK + ri.max() + rj.max())) - self.error
        if later is not None:
            open_ &= later
        r, c = np.nonzero(open_)
        if not len(r):
            return
        reach = ri[r] + rj[c]
        keep = cos[r, c] >= np.cos(np.minimum(np.pi, self.limit + SLACK + reach)) - self.error
        i, j, reach = i[r[keep]], j[c[keep]], reach[keep]
        own = (i == j) if self.same else np.zeros(len(i), dtype=bool)
        away = np.empty(len(i))
        for k in range(0, len(i), 1 << 14):
            v, w = a.vectors[a.centre[i[k : k + (1 << 14)]]], b.vectors[b.centre[j[k : k + (1 << 14)]]]
            away[k : k + (1 << 14)] = angle(chord(np.einsum("ij,ij->i", unit(v.astype(np.float64)), unit(w.astype(np.float64)))))
        sure = ~own & (away + reach <= self.limit - SLACK)
        for m, n in zip(i[sure].tolist(), j[sure].tolist(), strict=True):
            self.whole(m, n)
        left = ~sure & (away - reach <= self.limit + SLACK)
        single = left & (a.stop[i] - a.start[i] == 1) & (b.stop[j] - b.start[j] == 1)
        self.listed(a.start[i[single & ~own]], b.start[j[single & ~own]])
        left &= ~single
        self.stack.extend(zip(i[left].tolist(), j[left].tolist(), strict=True))
        self.descend()

    def descend(self) -> None:
        a, b = self.a, self.b
        stack, self.stack = self.stack, []
        for i, j in stack:
            own = self.same and i == j
            p, q = np.arange(a.start[i], a.stop[i]), np.arange(b.start[j], b.stop[j])
            if len(p) * len(q) <= FLAT:
                self.points(p, q, a.units[p] @ b.units[q].T, p[:, None] < q[None, :] if own else None)
                continue
            below_a, below_b = a.below(i), b.below(j)
            step = max(1, TILE // len(below_b))
            for k in range(0, len(below_a), step):
                part = below_a[k : k + step]
                self.meet(part, below_b, part[:, None] <= below_b[None, :] if own else None)

    def traverse(self) -> None:
        """The frontiers of both groves: nodes of b that reach a root of a meet its nodes.

        A node meets only what lies, seen from its root's centre, no further out than its own
        reach and the limit.
        """
        a, b = self.a, self.b
        near = within_reach(a.outline(), b.outline(), self.cosine)
        roots, known = np.flatnonzero(near.any(axis=1)), near.any(axis=0)[b.rooted]
        tops = a.units[a.centre[a.root]]
        for kind in (True, False):
            part = np.flatnonzero(known & (b.single == kind))
            if not len(part):
                continue
            nodes, units, short = b.frontier[part], b.tops[part], b.short[part]
            points, most = b.start[nodes], float(b.radius[nodes].max())
            step, room = max(1, TILE // len(part)), np.empty(ROWS * len(part), dtype=np.float32)
            for k in range(0, len(roots), step):
                seen = tops[roots[k : k + step]] @ units.T
                for root, cos in zip(roots[k : k + step], seen, strict=True):
                    s, t, e = a.at[root]
                    # Within one grove each pair of nodes meets once, at the one that comes first.
                    low = int(np.searchsorted(part, s)) if self.same else 0
                    found = low + np.flatnonzero(cos[low:] >= self._least(max(a.reach[max(s, t - 1)], a.reach[e - 1]) + most))
                    if not len(found):
                        continue
                    found = found[np.argsort(-cos[found])]
                    away, own, place = -cos[found], short.take(found, axis=0), part[found]
                    for lo, hi, single in ((s, t, kind), (t, e, False)):
                        for f in range(lo, hi, ROWS):
                            g = min(f + ROWS, hi)
                            n = int(np.searchsorted(away, -self._least(a.reach[g - 1] + most), side="right"))
                            if not n:
                                continue
                            later = None
                            if self.same and place[:n].min() <= g:
                                later = np.arange(f, g)[:, None] < place[None, :n] + (not single)
                            if single:
                                bound = np.matmul(a.short[f:g], own[:n].T, out=room[: (g - f) * n].reshape(g - f, n)) >= self.cosine - self.error
                                if later is not None:
                                    bound &= later
                                count = np.count_nonzero(bound)
                                if count > bound.size >> 5:
                                    products = a.tops[f:g] @ units.take(found[:n], axis=0).T
                                    self.points(a.start[a.frontier[f:g]], points[found[:n]], products, later)
                                elif count:
                                    r, c = np.divmod(np.flatnonzero(bound), n)
                                    self.listed(a.start[a.frontier[f + r]], points[found[c]])
                            else:
                                self.meet(a.frontier[f:g], nodes[found[:n]], later)

    def _least(self, reach: float) -> np.float32:
        """The least cosine with the centre of a root that what is linked within its reach can have."""
        return np.float32(np.cos(min(np.pi, self.limit + SLACK + reach)) - self.error)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        self.traverse()
        deg_a, deg_b = self.deg_a + np.cumsum(self.range_a)[:-1], self.deg_b + np.cumsum(self.range_b)[:-1]
        x, y = forest(np.concatenate(self.x), np.concatenate(self.y), self.total)
        return deg_a + deg_b if self.same else deg_a, deg_b, x, y


def grove_links(a: Grove, b: Grove, mult_a: np.ndarray, mult_b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between the points of two groves, or within one if ``a is b``.

    Returns for the points of a, and of b, the summed multiplicity of the points they are
    linked with, and edges (x, y) that connect the same points as all links; points of b are
    numbered after those of a unless the groves are one.
    """
    return Links(a, b, mult_a, mult_b, cosine).result()


def linked(a: CoverTree, b: CoverTree, mult_a: np.ndarray, mult_b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``grove_links`` of two trees, or within one if ``a is b``; points have their numbers in the trees."""
    left = Grove([a], cosine)
    right = left if a is b else Grove([b], cosine)
    number = a.points if a is b else np.concatenate([a.points, b.points + len(a.points)])
    found_a, found_b, x, y = grove_links(left, right, mult_a[a.points], mult_b[b.points], cosine)
    deg_a, deg_b = np.empty_like(found_a), np.empty_like(found_b)
    deg_a[a.points], deg_b[b.points] = found_a, found_b
    return deg_a, deg_b, number[x], number[y]
