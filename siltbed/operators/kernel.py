"""NumPy kernels on points that fit a task: weighted seeding and Lloyd, coresets, bucket sketches.

Nothing here knows Spark. Points are a matrix ``x`` and a weight vector ``w``; randomness comes
from a generator keyed by a tuple of counters, so a repeated task draws the same numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from siltbed.operators.cost import distances


def generator(*counters: int) -> np.random.Generator:
    """Independent streams for different counters, equal ones for equal counters."""
    return np.random.default_rng([c & 0xFFFFFFFF for c in counters])


def draw(weights: np.ndarray, u: float) -> int:
    """The first index whose running weight reaches ``u`` times the total; uniform without a positive total."""
    running = np.cumsum(weights)
    total = running[-1]
    if not total > 0:
        return min(int(u * len(weights)), len(weights) - 1)
    return min(int(np.searchsorted(running, u * total, side="left")), int(np.flatnonzero(weights)[-1]))


def sse(x: np.ndarray, w: np.ndarray, centers: np.ndarray) -> float:
    return float(w @ distances(x, centers).min(axis=1)) if len(x) else 0.0


def seed(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """min(k, rows) k-means++ seeds; the first in proportion to weight."""
    if not len(x):
        raise ValueError("no points")
    if k < 1:
        raise ValueError("k must be positive")
    chosen = [draw(w, rng.random())]
    near = distances(x, x[chosen])[:, 0]
    while len(chosen) < min(k, len(x)):
        chosen.append(draw(w * near, rng.random()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen].copy()


def lloyd(x: np.ndarray, w: np.ndarray, start: np.ndarray, max_iter: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, float, int]:
    """(centres, cost, iterations); see :func:`siltbed.operators.lloyd.lloyd` for the rules."""
    centers, before, done = np.array(start, np.float64), np.inf, 0
    for done in range(1, max_iter + 1):
        d2 = distances(x, centers)
        cid = d2.argmin(axis=1)
        now = float(w @ d2[np.arange(len(x)), cid])
        mass = np.bincount(cid, weights=w, minlength=len(centers))
        sums = np.stack([np.bincount(cid, weights=w * x[:, j], minlength=len(centers)) for j in range(x.shape[1])], axis=1)
        held = mass > 0
        centers[held] = sums[held] / mass[held, None]
        if now > before * (1 + 1e-9):
            raise ArithmeticError("the cost rose")
        if before - now <= tol * max(before if np.isfinite(before) else 0.0, 1e-300):
            break
        before = now
    return centers, sse(x, w, centers), done


def fit(x: np.ndarray, w: np.ndarray, k: int, restarts: int = 5, max_iter: int = 100, tol: float = 1e-6, key: tuple[int, ...] = (42,)) -> tuple[np.ndarray, float, int]:
    """The best of ``restarts`` runs from one generator; of equally good ones the first."""
    if restarts < 1:
        raise ValueError("restarts must be positive")
    rng, best = generator(*key), None
    for _ in range(restarts):
        run = lloyd(x, w, seed(x, w, k, rng), max_iter, tol)
        if best is None or run[1] < best[1]:
            best = run
    return best


class Costs:
    """The costs of up to ``m`` cells under a tree of sums: a change or a draw takes O(log m) steps."""

    def __init__(self, m: int):
        self.size = 1 << max(0, m - 1).bit_length()
        self.sums = [0.0] * (2 * self.size)

    def set(self, cell: int, cost: float) -> None:
        i, sums = cell + self.size, self.sums
        sums[i] = float(cost)
        while i > 1:
            i //= 2
            sums[i] = sums[2 * i] + sums[2 * i + 1]

    @property
    def total(self) -> float:
        return self.sums[1]

    def draw(self, u: float) -> int:
        """The cell at the share ``u`` of the total; never one without cost, if any has some."""
        i, need, sums = 1, u * self.sums[1], self.sums
        while i < self.size:
            left, right = sums[2 * i], sums[2 * i + 1]
            if need < left or not right > 0:
                i = 2 * i
            else:
                i, need = 2 * i + 1, need - left
        return i - self.size


@dataclass
class Partition:
    """Cells of points: the row that represents each, its rows, their mass and cost."""

    reps: list[int]
    rows: list[np.ndarray]
    mass: np.ndarray
    cost: np.ndarray


def partition(x: np.ndarray, w: np.ndarray, m: int, rng) -> Partition:
    """Refines one cell of all points into at most ``m``; ``rng.random()`` gives the uniforms.

    A cell is drawn in proportion to its cost, a point of it to its share of that cost, and the
    cell splits between its representative and that point, ties staying. Cells lie side by side in
    one permutation. Few distinct points end the refinement early.
    """
    order, reps = np.arange(len(x)), [draw(w, rng.random())]
    near = distances(x, x[reps])[:, 0]
    first, last = [0], [len(x)]
    costs = Costs(m)
    costs.set(0, w @ near)
    while len(reps) < m and costs.total > 0:
        cell, v = costs.draw(rng.random()), rng.random()
        a, b = first[cell], last[cell]
        rows = order[a:b].copy()  # the split below rewrites this part of the permutation
        held, weight = near[rows], w[rows]
        share = np.cumsum(weight * held)
        if not share[-1] > 0:
            costs.set(cell, 0.0)
            continue
        new = int(rows[min(int(share.searchsorted(v * share[-1])), b - a - 1)])
        gap = x[rows] - x[new]
        to_new = np.einsum("ij,ij->i", gap, gap)
        moves = to_new < held
        if not moves.any():  # the point equals its representative, but for rounding
            near[new] = 0.0
            costs.set(cell, weight @ near[rows])
            continue
        stay = ~moves
        n = int(stay.sum())
        order[a : a + n], order[a + n : b] = rows[stay], rows[moves]
        near[rows[moves]] = to_new[moves]
        last[cell] = a + n
        first.append(a + n)
        last.append(b)
        costs.set(cell, weight[stay] @ held[stay])
        costs.set(len(reps), weight[moves] @ to_new[moves])
        reps.append(new)
    cells = [order[a:b] for a, b in zip(first, last, strict=True)]
    return Partition(reps, cells, np.array([w[c].sum() for c in cells]), np.array([w[c] @ near[c] for c in cells]))


def coreset(x: np.ndarray, w: np.ndarray, m: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """At most ``m`` of the points, each with the mass of its cell of the :func:`partition`.

    Inputs of at most ``m`` points come back as they are.
    """
    if m < 1:
        raise ValueError("m must be positive")
    if len(x) <= m:
        return x, w
    cells = partition(x, w, m, rng)
    return x[cells.reps].copy(), cells.mass


class Sketch:
    """Merge-and-reduce buckets: a mergeable summary of any number of points in O(m log n) memory.

    Bucket 0 takes points as they come; once it holds ``m``, it moves on, and where it meets a full
    bucket both are reduced to one on the next level. Buckets may hold fewer than ``m`` points
    after a reduction of few distinct ones. Reading a sketch changes nothing.
    """

    def __init__(self, m: int, *key: int):
        if m < 1:
            raise ValueError("m must be positive")
        self.m, self.key = m, key or (42,)
        self.levels: list[tuple[np.ndarray, np.ndarray] | None] = [None]
        self.mass, self.reductions, self.merged = 0.0, 0, False

    def _reduce(self, parts: list[tuple[np.ndarray, np.ndarray]], stage: int) -> tuple[np.ndarray, np.ndarray]:
        x, w = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return coreset(x, w, self.m, generator(*self.key, stage, self.reductions))

    def insert(self, x: np.ndarray, w: np.ndarray | None = None) -> Sketch:
        """Takes points in order; refused after a merge, whose levels mean something else."""
        if self.merged:
            raise RuntimeError("a merged sketch takes no more points")
        x = np.asarray(x, np.float64).reshape(len(x), -1)
        w = np.ones(len(x)) if w is None else np.asarray(w, np.float64)
        self.mass += float(w.sum())
        at = 0
        while at < len(x):
            held = self.levels[0]
            take = min(self.m - (len(held[0]) if held else 0), len(x) - at)
            part = (x[at : at + take], w[at : at + take])
            at += take
            self.levels[0] = part if held is None else (np.concatenate((held[0], part[0])), np.concatenate((held[1], part[1])))
            if len(self.levels[0][0]) >= self.m:
                self._carry()
        return self

    def _carry(self) -> None:
        moving, self.levels[0], level = self.levels[0], None, 1
        while True:
            if level == len(self.levels):
                self.levels.append(None)
            if self.levels[level] is None:
                self.levels[level] = moving
                return
            self.reductions += 1
            moving, self.levels[level] = self._reduce([moving, self.levels[level]], 1), None
            level += 1

    def union(self) -> tuple[np.ndarray, np.ndarray]:
        """All buckets' points, unreduced."""
        held = [b for b in self.levels if b is not None]
        if not held:
            return np.zeros((0, 0)), np.zeros(0)
        return np.concatenate([b[0] for b in held]), np.concatenate([b[1] for b in held])

    def extract(self) -> tuple[np.ndarray, np.ndarray]:
        """The union, reduced to at most ``m`` points."""
        x, w = self.union()
        return coreset(x, w, self.m, generator(*self.key, 2, self.reductions)) if len(x) else (x, w)

    def merge(self, other: Sketch) -> Sketch:
        """A new sketch of both; the operands stay as they are."""
        if self.m != other.m:
            raise ValueError("only sketches of one size merge")
        out = Sketch(self.m, *self.key, *other.key, 3)
        out.mass, out.merged = self.mass + other.mass, True
        parts = [p for p in (self.union(), other.union()) if len(p[0])]
        out.levels = [None, out._reduce(parts, 3) if parts else None]
        return out

    def sizes(self) -> list[int]:
        return [0 if b is None else len(b[0]) for b in self.levels]

    def check(self) -> bool:
        """No bucket is over-full, the first one never full, and no mass is lost."""
        sizes = self.sizes()
        held = sum(float(b[1].sum()) for b in self.levels if b is not None)
        return sizes[0] < self.m and max(sizes) <= self.m and abs(held - self.mass) <= 1e-6 * max(1.0, self.mass)

    def __repr__(self) -> str:
        return f"Sketch(m={self.m}, mass={self.mass:g}, sizes={self.sizes()})"


def bucket_of(rank: int, n: int, m: int) -> int:
    """The bucket that holds the item of 0-based ``rank`` after ``n`` unit inserts."""
    b, q = rank // m, n // m
    return 0 if b == q else (b ^ q).bit_length()


def level_count(n: int, m: int) -> int:
    return 1 + (n // m).bit_length()


def union_size(n: int, m: int) -> int:
    return n % m + m * (n // m).bit_count()
