"""Tree ensembles on histograms: gradient boosting with second-order steps, and random forests.

Both fit on the bins of all rows, either in numpy on one matrix or, where that is too large for the driver, on blocks that
stay on the executors (blocks.py), of which each level takes the sums. They are flat arrays afterwards, so scoring is a loop
over depths in an Arrow batch, wherever the rows are. Features are cut at BINS quantiles of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bins of a feature, trees whose steps are added to rows before these are stored anew, trees of a forest that grow at once.
BINS, HELD, TOGETHER = 256, 8, 10


@dataclass(frozen=True)
class Tree:
    """An inner node sends a row to `left` if its feature is at most the cut; leaves have feature -1. cover: the weight of its rows."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The leaf values of the rows of x."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            go = np.where(x[rows, np.maximum(f, 0)] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, go, at)

    def leaves(self) -> list[dict]:
        """Each leaf with the interval of every feature on its path and the share of rows that the splits on it let through."""
        out, stack = [], [(0, {})]
        while stack:
            node, path = stack.pop()
            f = int(self.feature[node])
            if f < 0:
                names = sorted(path)
                out.append({"value": float(self.value[node]), "feature": names, "low": [path[k][0] for k in names], "high": [path[k][1] for k in names], "zero": [path[k][2] for k in names]})
                continue
            a, b, z = path.get(f, (-np.inf, np.inf, 1.0))
            cut, whole = float(self.cut[node]), float(self.cover[node])
            for child, low, high in ((int(self.left[node]), a, min(b, cut)), (int(self.right[node]), max(a, cut), b)):
                stack.append((child, path | {f: (low, high, z * float(self.cover[child]) / whole)}))
        return out


def cuts_of(column: np.ndarray) -> np.ndarray:
    """The cuts of one feature: between its values if they are few, else quantiles."""
    known = np.unique(column)
    return (known[:-1] + known[1:]) / 2 if known.size <= BINS else np.unique(np.quantile(column, np.arange(1, BINS) / BINS))


def bins_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each value, one row for each feature; bin b holds the values up to cut b."""
    return np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T)]).astype(np.uint8) if cuts else np.zeros((0, len(x)), np.uint8)


def fixed(values: np.ndarray, total: float) -> np.ndarray:
    """values, of absolute sum `total` at most, as multiples of a unit so small that 50 bits hold their sum: the order of adding doesn't matter."""
    unit = 2.0 ** (np.ceil(np.log2(max(total, 1.0))) - 50)
    return np.round(values / unit) * unit


class Growing:
    """A tree while it grows, level by level, from sums over the rows of each node by bin.

    A row has two parts of sums by which a set of rows is judged: gain(sums), larger for a purer set and -inf for one that
    is too small, and value(sums) for a leaf. tried(n) names the features that n nodes try (n, tries); if it is left out, all
    try all, and of two siblings only the lighter one is summed, as the other has the rest of its parent's sums.
    """

    def __init__(self, cuts: list[np.ndarray], gain, value, tried=None):
        self.cuts, self.gain, self.value = cuts, gain, value
        self.tries = tried or (lambda n: np.tile(np.arange(len(cuts)), (n, 1)))
        self.nodes, self.level, self.tried = [[-1, -1, -1, -1, 0.0, 0.0]], [0], self.tries(1)
        self.rest, self.asked, self.parents = tried is None, np.array([0]), None

    def shape(self) -> Shape:
        """What a row needs to find its node, and its place in the histograms."""
        feature, last, left, right = np.array([n[:4] for n in self.nodes], np.int64).T
        place = np.full(len(self.nodes), -1)
        place[np.array(self.level, int)[self.asked]] = np.arange(len(self.asked))
        return Shape(feature, last, left, right, place, self.tried[self.asked] if self.level else None)

    def split(self, sums: np.ndarray) -> None:
        """The next level, from the sums of this one (nodes asked for, tries, BINS, 2)."""
        if self.parents is not None:
            some, sums = sums, np.empty((len(self.level), *sums.shape[1:]))
            sums[self.asked], sums[self.asked ^ 1] = some, self.parents - some
        if self.level == [0] and sums.shape[1]:
            self.nodes[0][4:] = sums[0, 0].sum(0).tolist()
        whole = np.array([self.nodes[k][4:] for k in self.level]).reshape(-1, 1, 1, 2)
        below, parents = [], []
        if sums.shape[1]:
            a, b = (sums[..., i].cumsum(2)[..., :-1] for i in (0, 1))
            with np.errstate(invalid="ignore"):
                more = self.gain(a, b) + self.gain(whole[..., 0] - a, whole[..., 1] - b) - self.gain(whole[..., 0], whole[..., 1])
            most = np.array([len(c) for c in self.cuts])[self.tried]
            more = np.where((np.arange(BINS - 1) < most[..., None]) & ~np.isnan(more), more, -np.inf)
            best = more.reshape(len(more), -1).argmax(1)
            for j, (s, k) in enumerate(zip(*divmod(best, BINS - 1))):
                if more[j, s, k] > 1e-9:
                    left, (g, h) = len(self.nodes), whole[j, 0, 0]
                    self.nodes[self.level[j]][:4] = [int(self.tried[j, s]), int(k), left, left + 1]
                    self.nodes += [[-1, -1, -1, -1, float(a[j, s, k]), float(b[j, s, k])], [-1, -1, -1, -1, float(g - a[j, s, k]), float(h - b[j, s, k])]]
                    below += [left, left + 1]
                    parents.append(j)
        self.level, self.tried, self.asked = below, self.tries(len(below)) if below else None, np.arange(len(below))
        if self.rest:
            self.parents, self.asked = sums[parents], np.array([i + (self.nodes[below[i]][5] > self.nodes[below[i + 1]][5]) for i in range(0, len(below), 2)], int)

    def values(self) -> np.ndarray:
        g, h = np.array([n[4:] for n in self.nodes]).T
        return np.asarray(self.value(g, h), float)

    def tree(self) -> Tree:
        feature, last, left, right = np.array([n[:4] for n in self.nodes], int).T
        cut = np.array([self.cuts[f][k] if f >= 0 else 0.0 for f, k in zip(feature, last)], float)
        return Tree(feature, cut, left, right, self.values(), np.array([n[5] for n in self.nodes], float))


@dataclass(frozen=True)
class Shape:
    """A tree on bins: an inner node sends a row to `left` up to bin `last`. place: where a node's sums stand, or -1; tried: features for each place."""

    feature: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    place: np.ndarray
    tried: np.ndarray | None

    def down(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The nodes of the rows one level further."""
        f = self.feature[at]
        go = bins.ravel()[np.maximum(f, 0) * len(at) + np.arange(len(at))] <= self.last[at]
        return np.where(f < 0, at, np.where(go, self.left[at], self.right[at]))

    def find(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row."""
        at = np.zeros(bins.shape[1], np.int64)
        while (self.feature[at] >= 0).any():
            at = self.down(bins, at)
        return at

    def histograms(self, bins: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Sums of first and second by node of the level, feature tried and bin."""
        n, tries = self.tried.shape
        own = self.place[at]
        if (own < 0).any():
            rows = np.flatnonzero(own >= 0)
            own, bins, first, second = own[rows], bins[:, rows], first[rows], second[rows]
        out, base, every = np.empty((n, tries, BINS, 2)), own * BINS, np.arange(len(own))
        for s in range(tries):
            f = self.tried[:, s]
            key = base + (bins[f[0]] if (f == f[0]).all() else bins[f[own], every])
            out[:, s, :, 0] = np.bincount(key, first, n * BINS).reshape(n, BINS)
            out[:, s, :, 1] = np.bincount(key, second, n * BINS).reshape(n, BINS)
        return out


def grow(tree: Growing, bins: np.ndarray, first: np.ndarray, second: np.ndarray, depth: int) -> np.ndarray:
    """Grows the tree on one matrix of bins; each row's leaf."""
    tree.nodes[0][4:] = [float(first.sum()), float(second.sum())]
    at = np.zeros(bins.shape[1], np.int64)
    for _ in range(depth):
        if not tree.level:
            break
        tree.split(tree.shape().histograms(bins, at, first, second))
        at = tree.shape().down(bins, at) if len(bins) else at
    return at


@dataclass
class GBTClassifier:
    """Boosted trees for a 0/1 label: Newton steps on the log loss, with a ridge penalty of 1 and at least 1 of second derivatives a leaf."""

    maxIter: int = 100
    maxDepth: int = 5
    stepSize: float = 0.1

    def _growing(self, cuts: list[np.ndarray]) -> Growing:
        rate = self.stepSize
        return Growing(cuts, lambda g, h: np.where(h >= 1, g * g / (h + 1.0), -np.inf), lambda g, h: -rate * g / (h + 1.0))

    def fit(self, bins: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, times: np.ndarray | None = None) -> list[Tree]:
        """times: how many training rows a column of bins stands for (1 each if left out); weight is that of one of them."""
        times = np.ones(bins.shape[1], np.int64) if times is None else times
        margin, trees, total = np.zeros(bins.shape[1]), [], float((weight * times).sum())
        for _ in range(self.maxIter):
            tree = self._growing(cuts)
            leaf = grow(tree, bins, *slopes(y, weight, times, margin, total), self.maxDepth)
            trees.append(tree.tree())
            margin += tree.values()[leaf]
        return trees

    def fit_blocks(self, blocks, cuts: list[np.ndarray], positive: float) -> list[Tree]:
        """fit() on blocks on the executors, positives of weight `positive`: the same trees."""
        total, trees, held = blocks.negatives + positive * blocks.positives, [], []
        for _ in range(self.maxIter):
            tree = self._growing(cuts)
            for _ in range(self.maxDepth):
                if not tree.level:
                    break
                shape, last = tree.shape(), list(held)
                tree.split(blocks.total(lambda b: shape.histograms(b.bins, shape.find(b.bins), *slopes(b.y, b.weight(positive), b.times, b.moved(last), total))))
            trees.append(tree.tree())
            held.append((tree.shape(), tree.values()))
            if len(held) == HELD:
                blocks, held = blocks.advanced(held), []
        blocks.dropped()
        return trees


def slopes(y: np.ndarray, weight: np.ndarray, times: np.ndarray, margin: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss, times the weights, added up over the rows that an entry stands for."""
    p = 1 / (1 + np.exp(-margin))
    return fixed(weight * (p - y), total) * times, fixed(weight * p * (1 - p), total) * times


@dataclass
class RandomForestClassifier:
    """Trees on bootstrap samples, judged by the Gini impurity, with as many features a split as the root of their number."""

    numTrees: int = 100
    maxDepth: int = 5
    seed: int = 42

    def _growing(self, cuts: list[np.ndarray], rng: np.random.Generator) -> Growing:
        width = len(cuts)
        some = max(1, int(np.sqrt(width)))
        gain = lambda a, w: np.where(w > 0, (a * a + (w - a) ** 2) / np.maximum(w, 1e-300), -np.inf)
        return Growing(cuts, gain, lambda a, w: a / np.maximum(w, 1e-300), lambda n: np.sort(rng.random((n, width)).argsort(1)[:, :some], axis=1))

    def fit(self, bins: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, times: np.ndarray | None = None) -> list[Tree]:
        """times and weight as in boosting."""
        times = np.ones(bins.shape[1], np.int64) if times is None else times
        rng, n, trees = np.random.default_rng(self.seed), int(times.sum()), []
        total = float(n * weight.max(initial=1.0))
        for _ in range(self.numTrees):
            drawn = fixed(weight, total) * drawn_of(rng, n, times)
            tree = self._growing(cuts, rng)
            grow(tree, bins, drawn * y, drawn, self.maxDepth)
            trees.append(tree.tree())
        return trees

    def fit_blocks(self, blocks, cuts: list[np.ndarray], positive: float) -> list[Tree]:
        """fit() on blocks on the executors. A bootstrap sample is dealt over the blocks first, then drawn in each: the same distribution."""
        n, sizes, trees = blocks.negatives + blocks.positives, blocks.sizes, []
        total = float(n * max(positive, 1.0))
        for start in range(0, self.numTrees, TOGETHER):
            own = range(start, min(start + TOGETHER, self.numTrees))
            growing = [self._growing(cuts, np.random.default_rng([self.seed, t])) for t in own]
            dealt = [np.random.default_rng([self.seed, t, 0]).multinomial(n, sizes / n) for t in own]
            for _ in range(self.maxDepth):
                live = [i for i, g in enumerate(growing) if g.level]
                if not live:
                    break
                shapes, seeds, shares = [growing[i].shape() for i in live], [[self.seed, own[i], 1] for i in live], [dealt[i] for i in live]

                def sums(b) -> list[np.ndarray]:
                    out, one = [], b.weight(positive)
                    for shape, seed, share in zip(shapes, seeds, shares):
                        drawn = fixed(one, total) * drawn_of(np.random.default_rng([*seed, b.at]), int(share[b.at]), b.times)
                        out.append(shape.histograms(b.bins, shape.find(b.bins), drawn * b.y, drawn).ravel())
                    return np.concatenate(out)

                found, place = blocks.total(sums), 0
                for i, shape in zip(live, shapes):
                    size = shape.tried.size * BINS * 2
                    growing[i].split(found[place : place + size].reshape(*shape.tried.shape, BINS, 2))
                    place += size
            trees += [g.tree() for g in growing]
        blocks.dropped()
        return trees


def drawn_of(rng: np.random.Generator, n: int, times: np.ndarray) -> np.ndarray:
    """How often each entry is drawn in n draws with replacement, an entry standing for times[i] rows."""
    rows = int(times.sum())
    if rows > 4 * len(times):
        return rng.multinomial(n, times / rows)
    return np.bincount(np.repeat(np.arange(len(times)), times)[rng.integers(0, rows, n)] if rows else [], minlength=len(times)).astype(np.int64)
