"""Average and Ward clustering: chains of nearest neighbours for a group in one task, and rounds over tables for groups of any size.

Rounds: a group's clusters are rows (grp, cluster, size, mean). Every cluster finds
its nearest one, and all pairs that are each other's nearest merge at once. Both
linkages are reducible (a merge is no nearer to a third cluster than the nearer of
its parts was), so these are the merges the sequential algorithm makes, with the
same heights, in another order; and a cluster whose nearest one hasn't merged keeps
it, so a round compares only the others. The mean of 1 - a.b over two clusters is 1
less the product of their means, and Ward's height follows from means and sizes: a
round reads vectors, and no distances are kept.

A group's clusters are cut into tiles; two tiles meet in a task by matrix
products of some rows at a time, and the nearest of a cluster over all tiles is a
partial aggregation. Tiles meet in passes, each of which sends a cluster a few times
only, and a round's tables go when the next one has its own: disk holds a few copies
of the clusters, whatever the tiles and rounds. Equal vectors fall together before the rounds, by hashes. A cut
at a height needs no merges above it: only near vectors come that far. Once a group has no more than
``ENDED`` clusters left (``LOCAL`` within a cut), one task ends it, in the same rounds over arrays. No task holds a larger group.

A vector that 32-bit numbers hold exactly is kept as such (short), any other one as mean.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.functions.vectors import normalised
from lumenflow.operators.components import connected_components
from lumenflow.plans.tables import drop

#: Distances of a group are held as one matrix up to this size; beyond it they are worked out from the clusters' means.
MATRIX_BYTES = 1 << 25
#: Items of a group that one task clusters.
LOCAL = 16384
#: Distinct vectors, or clusters, of a group that one task ends: 64 MB of 64 components.
ENDED = 1 << 17
#: Groups that are dealt to a partition each, about.
SPREAD = 128
#: Clusters that chains end when rounds in one task have come so far; near clusters that each is given there.
FEW, LIST = 512, 16
#: Rows and columns of the distances that a task works out at once in a scan.
SCAN = 512, 1024
#: Clusters of a tile, about: a row is sent once for each tile of its group.
TILE = 32768
#: Rows of a tile whose distances a task holds at once.
ROWS = 256
#: Clusters of each of two tiles whose distances are worked out at once, so that they stay in a core's cache.
BLOCK = 512

Keep = Callable[[DataFrame, str], DataFrame]
Vectors = Callable[[DataFrame], DataFrame]


class _Matrix:
    """Distances of all clusters as one matrix, updated in place by a rule of the linkage."""

    def __init__(self, distance: np.ndarray, update):
        self.d, self.update, self.size = distance, update, np.ones(len(distance))
        np.fill_diagonal(self.d, np.inf)

    def row(self, x: int) -> np.ndarray:
        return self.d[x]

    def join(self, a: int, b: int) -> None:
        new = self.update(self.d[a], self.d[b], self.d[a, b], self.size[a], self.size[b], self.size)
        self.d[a], self.d[:, a] = new, new
        self.d[a, a] = np.inf
        self.d[b], self.d[:, b] = np.inf, np.inf
        self.size[a] += self.size[b]


class _Means:
    """Distances from the clusters' means and sizes alone: memory in proportion to the vectors, for groups of any size."""

    def __init__(self, vectors: np.ndarray, linkage: str, size: np.ndarray | None = None):
        self.average, self.n = linkage == "average", len(vectors)
        self.size = np.ones(self.n) if size is None else size.copy()
        self.gone = np.zeros(self.n, dtype=bool)
        self._hold(np.arange(self.n), vectors.copy())

    def _hold(self, slots: np.ndarray, mean: np.ndarray) -> None:
        self.slots, self.mean, self.square = slots, mean, (mean**2).sum(axis=1)
        self.place = np.zeros(self.n, dtype=int)
        self.place[slots] = np.arange(len(slots))

    def row(self, x: int) -> np.ndarray:
        p, size = self.place[x], self.size[self.slots]
        product = self.mean @ self.mean[p]
        if self.average:
            d = np.clip(1 - product, 0, 2)
        else:
            d = np.sqrt(2 * size * self.size[x] / (size + self.size[x]) * np.maximum(self.square + self.square[p] - 2 * product, 0))
        out = np.full(self.n, np.inf)
        out[self.slots] = d
        out[self.gone] = np.inf
        out[x] = np.inf
        return out

    def join(self, a: int, b: int) -> None:
        n, p, q = self.size[a] + self.size[b], self.place[a], self.place[b]
        self.mean[p] = (self.size[a] * self.mean[p] + self.size[b] * self.mean[q]) / n
        self.square[p] = (self.mean[p] ** 2).sum()
        self.size[a], self.gone[b] = n, True
        stay = ~self.gone[self.slots]
        if 2 * stay.sum() < len(stay):  # the means of merged clusters go
            self._hold(self.slots[stay], self.mean[stay])


class _Lists:
    """Each cluster's nearest one in rounds: all pairs that are each other's nearest merge at once (see above).

    A scan leaves a cluster ``LIST`` near ones and a bound: what holds none of
    them is no nearer than that. Merges of nearest pairs bring nothing nearer, so
    the bound stays true, and a cluster scans again only when no listed one is
    under it. Scans screen with 32-bit numbers, with a bound on their error;
    distances that decide have 64 bits and are the same from both sides.
    """

    def __init__(self, vectors: np.ndarray, linkage: str, size: np.ndarray):
        self.ward, self.n, dims = linkage == "ward", len(vectors), vectors.shape[1]
        self.mean, self.size = (vectors - vectors.mean(axis=0) if self.ward else vectors.copy()), size.astype(float)
        self.alive, self.root = np.ones(self.n, dtype=bool), np.arange(self.n)
        self.list, self.low = np.empty((self.n, 0), dtype=int), np.empty(self.n)
        self.nearest, self.order = np.zeros(self.n, dtype=int), np.full(self.n, np.inf)
        self.slack = (dims + 16) * np.finfo(np.float32).eps

    def height(self, order: np.ndarray) -> np.ndarray:
        return np.sqrt(2 * np.maximum(order, 0)) if self.ward else np.clip(1 + order, 0, 2)

    def exact(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Numbers that order the distances of ``rows`` to their own row of ``others``; inf to themselves and to repeated ones."""
        out = np.empty(others.shape)
        for s in range(0, len(rows), 2048):
            r, o = rows[s : s + 2048], others[s : s + 2048]
            a, b = self.mean[r][:, None, :], self.mean[o]
            if self.ward:
                b -= a
                out[s : s + 2048] = np.einsum("ijk,ijk->ij", b, b) / (1 / self.size[r][:, None] + 1 / self.size[o])
            else:
                b *= a
                out[s : s + 2048] = -b.sum(axis=2)
        out[others == rows[:, None]] = np.inf
        out[:, 1:][others[:, 1:] == others[:, :-1]] = np.inf
        return out

    def listed(self, rows: np.ndarray, others: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Sets the lists of ``rows`` from ``others``, clusters with no other one under ``low``; the rows whose nearest one isn't certain."""
        others = np.sort(others, axis=1)
        order = self.exact(rows, others)
        k = self.list.shape[1]
        if others.shape[1] > k:
            first = np.argsort(order, axis=1, kind="stable")[:, : k + 1]
            low = np.minimum(low, np.take_along_axis(order, first[:, k:], axis=1)[:, 0])
            others, order = (np.take_along_axis(x, first[:, :k], axis=1) for x in (others, order))
        best = order.min(axis=1)
        near = np.where(order == best[:, None], others, self.n).min(axis=1)
        self.list[rows], self.low[rows], self.nearest[rows], self.order[rows] = others, low, near, best
        return rows[~(best < low)]

    def scan(self, rows: np.ndarray) -> None:
        """Lists and nearest clusters of ``rows`` from all clusters."""
        every = np.random.default_rng(0).permutation(np.flatnonzero(self.alive))  # so that few come below a bound once it is found
        square = (self.mean**2).sum(axis=1)
        k, m = self.list.shape[1], self.mean.astype(np.float32)
        right = m[every].T
        if self.ward:
            flat = square.astype(np.float32)
            right = np.vstack([right, np.ones(len(every), dtype=np.float32), flat[every]])
            part = (1 / self.size).astype(np.float32)
        right = np.ascontiguousarray(right)
        far = np.sqrt(square[every].max())
        for s in range(0, len(rows), SCAN[0]):
            own = rows[s : s + SCAN[0]]
            left = -m[own] if not self.ward else np.hstack([-2 * m[own], flat[own, None], np.ones((len(own), 1), dtype=np.float32)])
            value, at = np.full((len(own), k), np.float32(np.inf)), np.broadcast_to(own[:, None], (len(own), k)).copy()
            for t in range(0, len(every), SCAN[1]):
                d = left @ right[:, t : t + SCAN[1]]
                names = every[t : t + SCAN[1]]
                if self.ward:
                    d /= part[own, None] + part[names]
                if not t:
                    near = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, : k + 1]
                    found, column = np.repeat(np.arange(len(own)), near.shape[1]), near.ravel()
                else:
                    found, column = np.nonzero(d < value.max(axis=1)[:, None])
                other = names[column] != own[found]
                found, column = found[other], column[other]
                if not len(found):
                    continue
                n = np.bincount(found, minlength=len(own))
                place = k + np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
                value = np.hstack([value, np.full((len(own), n.max()), np.float32(np.inf))])
                at = np.hstack([at, np.broadcast_to(own[:, None], (len(own), n.max()))])
                value[found, place], at[found, place] = d[found, column], names[column]
                best = np.argpartition(value, k - 1, axis=1)[:, :k]
                value, at = np.take_along_axis(value, best, axis=1), np.take_along_axis(at, best, axis=1)
            last = value.max(axis=1).astype(float)
            if self.ward:
                error = self.slack * (self.size[own] * (np.sqrt(square[own]) + far) ** 2 + np.where(np.isfinite(last), np.abs(last), 0))
            else:
                error = self.slack * np.sqrt(square[own]) * far
            low = np.where(np.isfinite(last), last - error, np.inf)
            for x in self.listed(own, at, low):  # more equal ones than a list holds: its nearest one alone
                others = np.sort(every)
                order = self.exact(np.array([x]), others[None, :])[0]
                self.nearest[x], self.order[x], self.low[x] = others[order.argmin()], order.min(), -np.inf

    def merges(self, least: int) -> list[tuple[int, int, float]]:
        """Merges (slot kept, slot gone, height) until ``least`` clusters are left or fewer."""
        out, todo, left = [], np.arange(self.n), self.n
        self.list = np.empty((self.n, min(LIST, max(1, self.n - 1))), dtype=int)
        while left > max(1, least):
            self.scan(todo)
            while True:
                own = np.flatnonzero(self.alive)
                a = own[(self.nearest[self.nearest[own]] == own) & (own < self.nearest[own])]
                if not len(a):  # what was found before may tie with new clusters: all scan anew
                    todo = own
                    break
                b = self.nearest[a]
                out += zip(a.tolist(), b.tolist(), self.height(self.order[a]).tolist())
                total = self.size[a] + self.size[b]
                self.mean[a] = (self.size[a] / total)[:, None] * self.mean[a] + (self.size[b] / total)[:, None] * self.mean[b]
                self.size[a], self.alive[b], self.root[b] = total, False, a
                left -= len(a)
                merged = np.zeros(self.n, dtype=bool)
                merged[a] = merged[b] = True
                self.root = self.root[self.root]
                lost = own[~merged[own] & merged[self.nearest[own]]]
                todo = [self.listed(lost, self.root[self.list[lost]], self.low[lost]), self.listed(a, self.root[np.hstack([self.list[a], self.list[b]])], np.minimum(self.low[a], self.low[b]))]
                todo = np.concatenate(todo)
                if len(todo) or left <= max(1, least):
                    break
        return out


def _agglomerated(mean: np.ndarray, size: np.ndarray, linkage: str, matrix_bytes: int) -> list[tuple[int, int, float]]:
    """Merges (slot kept, slot gone, height) of sized clusters, by height."""
    n, before = len(mean), []
    rest = np.arange(n)
    if 8 * n**2 > matrix_bytes:
        _, first, same = np.unique(np.ascontiguousarray(mean).view(f"V{mean.shape[1] * mean.itemsize}").ravel(), return_index=True, return_inverse=True)
        first = first[same] if linkage == "ward" else np.where((mean**2).sum(axis=1) > 1 - 1e-12, first[same], rest)  # lists hold few equal ones
        before = [(int(first[i]), int(i), 0.0) for i in np.flatnonzero(first != rest)]
        rest = np.flatnonzero(first == rest)
        rounds = _Lists(mean[rest], linkage, np.bincount(first, size, n)[rest])
        before += [(int(rest[a]), int(rest[b]), h) for a, b, h in rounds.merges(FEW)]
        rest = rest[rounds.alive]
        mean, size = rounds.mean[rounds.alive], rounds.size[rounds.alive]
        clusters = _Means(mean, linkage, size)
    else:
        distance, update = RULES[linkage]
        clusters = _Matrix(distance(mean, mean, size, size), update)
        clusters.size = size.astype(float)
    return sorted(before + [(int(rest[a]), int(rest[b]), h) for a, b, h in _merges(clusters, len(rest))], key=lambda m: m[2])


def _merges(clusters: _Matrix | _Means, n: int) -> list[tuple[int, int, float]]:
    """Agglomerates by nearest-neighbour chains: (slot kept, slot gone, height), by height."""
    alive, chain, out = np.ones(n, dtype=bool), [], []
    while len(out) < n - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            row = clusters.row(chain[-1])
            y = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
                break
            chain.append(y)
        a, b = sorted((chain[-1], y))
        chain = chain[:-2]
        out.append((a, b, float(row[y])))
        clusters.join(a, b)
        alive[b] = False
    return sorted(out, key=lambda m: m[2])


def _labels(n: int, merges: list[tuple[int, int, float]]) -> np.ndarray:
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, _ in merges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    first: dict[int, int] = {}
    return np.array([first.setdefault(root(i), len(first)) for i in range(n)])


def average_linkage(vectors: np.ndarray, matrix_bytes: int = MATRIX_BYTES) -> list[tuple[int, int, float]]:
    """Average-linkage merges over 1 - cosine, by height. The mean of 1 - a.b over two clusters is 1 less the product of their means."""
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-8)
    return _agglomerated(x, np.ones(len(x)), "average", matrix_bytes)


def ward_linkage(vectors: np.ndarray, matrix_bytes: int = MATRIX_BYTES) -> list[tuple[int, int, float]]:
    """Ward merges over Euclidean distance, by height."""
    return _agglomerated(vectors, np.ones(len(vectors)), "ward", matrix_bytes)


def _hooked(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` with the components of pairs (x, y) joined, each known by its least number."""
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        x, y = x[low < high], y[low < high]
        if not len(x):
            return root
        np.minimum.at(root, high[low < high], low[low < high])
        while (root[root] != root).any():
            root = root[root]


def _near_linkage(vectors: np.ndarray, most: float) -> list[tuple[int, int, float]]:
    """The merges of ``average_linkage`` up to the height ``most`` (under 1), by height: only components of vectors that near are clustered."""
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-8)
    _, first, same = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_index=True, return_inverse=True)
    first = np.where((x**2).sum(axis=1) > 0.5, first[same], np.arange(len(x)))  # of each item the first one of its vector; without a length it is near none
    out = [(int(first[i]), int(i), 0.0) for i in np.flatnonzero(first != np.arange(len(x)))]
    slots, size = np.unique(first, return_counts=True)
    x, short = x[slots], x[slots].astype(np.float32)
    root = np.arange(len(x))
    for s in range(0, len(x), ROWS):
        for t in range(s, len(x), SCAN[1]):
            a, b = np.nonzero(short[s : s + ROWS] @ short[t : t + SCAN[1]].T >= 1 - most - 1e-4)
            root = _hooked(root, a + s, b + t)
    own = np.argsort(root, kind="stable")
    for part in np.split(own, np.flatnonzero(np.diff(root[own])) + 1) if len(own) else []:
        if len(part) > 1:
            out += [(int(slots[part[a]]), int(slots[part[b]]), h) for a, b, h in _agglomerated(x[part], size[part], "average", MATRIX_BYTES) if h <= most]
    return sorted(out, key=lambda m: m[2])


def cut_groups(vectors: np.ndarray, distance: float = 0.2, share: float = 0.35, raise_cap: float = 0.15) -> np.ndarray:
    """Groups at the first of the distances ``distance``, + 0.05, … + ``raise_cap`` that leaves at most max(1, share * n) of them, else at the last."""
    cuts = np.round(distance + 0.05 * np.arange(round(raise_cap / 0.05) + 1), 2)
    merges = _near_linkage(vectors, cuts[-1]) if cuts[-1] < 1 and vectors.shape[1] else average_linkage(vectors)
    done = np.searchsorted([height for *_, height in merges], cuts, side="right")  # merges under each cut
    few = np.flatnonzero(len(vectors) - done <= max(1, len(vectors) * share))
    return _labels(len(vectors), merges[: done[few[0] if len(few) else -1]])


def _average_update(da, db, _, na, nb, __):
    return (na * da + nb * db) / (na + nb)


def _ward_update(da, db, dab, na, nb, size):
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.maximum(((na + size) * da**2 + (nb + size) * db**2 - size * dab**2) / (na + nb + size), 0))


def _average_distance(a, b, _, __):
    return np.clip(1 - a @ b.T, 0, 2)


def _ward_distance(a, b, na, nb):
    square = np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0)
    return np.sqrt(2 * na[:, None] * nb[None, :] / (na[:, None] + nb[None, :]) * square)


#: Of each linkage: distances of two lists of clusters (means, sizes), and how they follow from those before a merge.
RULES = {"average": (_average_distance, _average_update), "ward": (_ward_distance, _ward_update)}


def _tiles(clusters: DataFrame, tile: int) -> DataFrame:
    """(grp, _o, _c): numbers of tiles of a group's open and closed clusters."""
    return clusters.groupBy("grp").agg(*[F.ceil(F.count_if(c) / tile).cast("int").alias(k) for k, c in (("_o", F.col("open")), ("_c", ~F.col("open")))])


def _passes(tiles: DataFrame) -> int:
    """Passes that ``_cells`` needs for all cells of the groups."""
    return tiles.agg(F.max(F.greatest(F.floor(F.col("_o") / 2) + 1, F.when(F.col("_o") > 0, F.ceil(F.col("_c") / 2))))).first()[0] or 0


def _cells(clusters: DataFrame, tile: int, only: int | None = None, tiles: DataFrame | None = None) -> DataFrame:
    """The clusters (grp, cluster, size, open, and their vectors) dealt to the cells (grp, i, j, across, second) where two tiles meet.

    Open and closed clusters have tiles of their own, by hash: open tiles meet each
    other once, and every closed one (across). A row comes once for each tile that its own meets.
    ``only`` takes the cells of one pass: open tiles that are so far apart (around), and two tiles further on for
    closed ones. So a pass sends an open row four times at most, and closed ones as often as there are open rows, or twice.
    """
    n = _tiles(clusters, tile) if tiles is None else tiles
    dealt = clusters.join(F.broadcast(n), "grp").withColumn("_t", F.pmod(F.xxhash64("cluster"), F.greatest(F.when(F.col("open"), F.col("_o")).otherwise(F.col("_c")), F.lit(1))).cast("int"))  # n: a row for a large group
    cell = lambda i, j, across, second: F.struct(i.alias("i"), j.alias("j"), F.lit(across).alias("across"), second.alias("second"))
    met = lambda k, to: F.when(F.col(k) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(k) - 1, F.lit(0))), to))
    t, no, yes = F.col("_t"), F.lit(False), F.lit(True)
    own, far = met("_o", lambda p: cell(F.least(t, p), F.greatest(t, p), False, p < t)), met("_c", lambda p: cell(t, p, True, no))
    all_ = F.when(~F.col("open"), met("_o", lambda p: cell(p, t, True, yes))).when(F.col("_c") > 0, F.concat(own, far)).otherwise(own)
    if only is not None:
        apart = lambda x: F.least(x["j"] - x["i"], F.col("_o") - x["j"] + x["i"])
        of = lambda x: F.when(x["across"], F.floor(F.pmod(x["j"] - x["i"], F.greatest(F.col("_c"), F.lit(1))) / 2)).otherwise(apart(x))
        all_ = F.filter(all_, lambda x: of(x) == only)
    return dealt.withColumn("_x", F.explode(all_)).select("grp", "_x.*", "cluster", "size", *[c for c in ("mean", "short") if c in clusters.columns])


def _stacked(pdf: pd.DataFrame) -> np.ndarray:
    """The rows' vectors as 64-bit numbers."""
    if not len(pdf):
        return np.empty((0, 0))
    if "short" not in pdf:
        return np.stack(pdf["mean"].to_numpy())
    short = pdf["short"].notna().to_numpy()
    out = np.empty((len(pdf), len(pdf["short" if short[0] else "mean"].iloc[0])))
    for held, name in ((short, "short"), (~short, "mean")):
        if held.any():
            out[held] = np.stack(pdf[name].to_numpy()[held])
    return out


def _sides(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, sizes, means) of a cell's first and second tile, by number."""
    pdf = pdf.sort_values("cluster")
    return [(p["cluster"].to_numpy(), p["size"].to_numpy(dtype=float), _stacked(p)) for p in (pdf[~pdf["second"]], pdf[pdf["second"]])]


def _compared(linkage: str, a: tuple, b: tuple):
    """Of ranges of ``a`` and of ``b``: numbers that order their distances; and distances of such numbers."""
    (_, na, ma), (_, nb, mb) = a, b
    if linkage == "average":
        right = -mb.T
        return lambda s, e, t=0, u=None: ma[s:e] @ right[:, t:u], lambda x: np.clip(1 + x, 0, 2)
    one = np.ones((len(ma), 1)), np.ones((len(mb), 1))
    left, right = np.hstack([-2 * ma, (ma**2).sum(axis=1, keepdims=True), one[0]]), np.hstack([mb, one[1], (mb**2).sum(axis=1, keepdims=True)]).T
    pa, pb = 1 / na[:, None], 1 / nb

    def order(s: int, e: int, t: int = 0, u: int | None = None) -> np.ndarray:
        d = left[s:e] @ right[:, t:u]
        d /= pa[s:e] + pb[t:u]
        return d

    return order, lambda x: np.sqrt(2 * np.maximum(x, 0))


def _nearest(clusters: DataFrame, linkage: str, tile: int, keep: Keep) -> DataFrame:
    """(grp, cluster, nearest, height) of the open clusters (grp, cluster, size, open, and vectors); of equals the smallest number."""

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grp, i, j, across = key
        a, b = _sides(pdf)
        del pdf
        alone = i == j and not across
        b = a if alone else b
        n, m = len(a[0]), len(b[0])
        best, at = np.full(n, np.inf), np.zeros(n, dtype=int)
        back, of = (best, at) if alone else (np.full(m, np.inf), np.zeros(m, dtype=int))
        if n and m:
            order, height = _compared(linkage, a, b)
            for s in range(0, n, BLOCK):
                for t in range(s if alone else 0, m, BLOCK):
                    d = order(s, min(s + BLOCK, n), t, min(t + BLOCK, m))
                    if alone and s == t:
                        np.fill_diagonal(d, np.inf)
                    less = np.flatnonzero(d.min(axis=1) < best[s : s + BLOCK])
                    near = d[less].argmin(axis=1)
                    best[s + less], at[s + less] = d[less, near], t + near
                    if not across and not (alone and s == t):
                        less = np.flatnonzero(d.min(axis=0) < back[t : t + BLOCK])
                        near = d[:, less].argmin(axis=0)
                        back[t + less], of[t + less] = d[near, less], s + near
        out = []
        for own, near, low, other in [(a[0], at, best, b[0])] + ([] if alone or across else [(b[0], of, back, a[0])]):
            found = np.isfinite(low)
            out.append(pd.DataFrame({"grp": grp, "cluster": own[found], "nearest": other[near[found]] if len(other) else own[found], "height": height(low[found]) if n and m else low[found]}))
        return pd.concat(out)

    def least(found: DataFrame) -> DataFrame:
        best = found.groupBy("grp", "cluster").agg(F.min(F.struct("height", "nearest")).alias("b"))
        return best.select("grp", "cluster", "b.nearest", "b.height")

    def one(cells: DataFrame) -> DataFrame:
        return least(cells.groupBy("grp", "i", "j", "across").applyInPandas(meet, "grp string, cluster long, nearest long, height double"))

    tiles = keep(_tiles(clusters, tile), "tiles")  # a row for a large group
    passes = _passes(tiles)
    found = [one(_cells(clusters, tile, k, tiles)) for k in range(passes)] or [one(_cells(clusters, tile, 0, tiles))]
    out = keep(found[0] if len(found) == 1 else least(reduce(DataFrame.unionByName, parts := [keep(f, "pass") for f in found])), "nearest")
    drop(tiles, *(parts if len(found) > 1 else []))
    return out


def _linked(vectors: DataFrame, most: float, tile: int) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of a space's vectors (space, v, mean; of length 1) up to ``most`` apart by 1 - a.b.

    A cell gives a spanning forest of its pairs, so rows never exceed its vectors.
    """

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _sides(pdf)
        alone = key[1] == key[2]
        b = a if alone else b
        names, off = (a[0], 0) if alone else (np.concatenate([a[0], b[0]]), len(a[0]))
        root = np.arange(len(names))
        if len(a[0]) and len(b[0]):
            order, _ = _compared("average", a, b)
            for s in range(0, len(a[0]), ROWS):
                x, y = np.nonzero(order(s, s + ROWS) <= most - 1 + 1e-9)
                root = _hooked(root, x + s, y + off)
        other = root != np.arange(len(root))
        return pd.DataFrame({"u": names[other], "v": names[root[other]]})

    rows = vectors.select(F.col("space").alias("grp"), F.col("v").alias("cluster"), F.lit(1).alias("size"), F.lit(True).alias("open"), "mean")
    return _cells(rows, tile).groupBy("grp", "i", "j").applyInPandas(meet, "u long, v long")


def _ended(clusters: DataFrame, linkage: str, groups: int) -> DataFrame:
    """Merges (grp, a, b, height) of ``groups`` groups of few clusters, each in one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        grp, names, size, mean = pdf["grp"].iloc[0], pdf["cluster"].to_numpy(), pdf["size"].to_numpy(dtype=float), _stacked(pdf)
        del pdf
        merges = _agglomerated(mean, size, linkage, MATRIX_BYTES)
        return pd.DataFrame({"grp": grp, "a": [names[a] for a, _, _ in merges], "b": [names[b] for _, b, _ in merges], "height": [h for *_, h in merges]}).astype({"a": "int64", "b": "int64", "height": float})

    if groups <= SPREAD:  # few bytes, much work: partitions of a given number aren't joined
        clusters = clusters.repartition(8 * max(1, groups), "grp")
    return clusters.groupBy("grp").applyInPandas(one, "grp string, a long, b long, height double")


def _whole() -> Column:
    return F.coalesce("mean", F.col("short").cast("array<double>"))


def _joined(clusters: DataFrame, touched: DataFrame, keep: Keep) -> tuple[DataFrame, list[DataFrame]]:
    """The clusters after a round, and the tables that hold them: b's photos and mean go to a; merged ones, and those whose nearest one merged (into is null), are open."""
    marked = clusters.drop("open").join(touched.withColumn("open", F.lit(True)), ["grp", "cluster"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    marked = keep(marked, "clusters")
    moved = marked.filter("into is not null").groupBy("grp", "into").agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("size", _whole().alias("mean")))).alias("_p"))  # two
    share = lambda k: F.transform(F.get("_p", k)["mean"], lambda x: x * (F.get("_p", k)["size"] / F.col("size")))
    mean = F.zip_with(share(0), share(1), lambda x, y: x + y)
    moved = keep(moved.select("grp", F.col("into").alias("cluster"), "size", F.lit(None).cast("array<float>").alias("short"), mean.alias("mean"), F.lit(True).alias("open")), "moved")
    columns = ["grp", "cluster", "size", "short", "mean", "open"]
    return marked.filter("into is null").select(columns).unionByName(moved), [marked, moved]


def _keyed(items: DataFrame, vector: Column) -> DataFrame:
    """(grp, item, some, h, k): whether the vector has a length, and two hashes of 64 bits that stand for it, so equal vectors are found without moving any."""
    return items.select("grp", "item", vector.alias("_v")).select("grp", "item", F.exists("_v", lambda x: x != 0).alias("some"), F.xxhash64("_v").alias("h"), F.xxhash64(F.lit("again"), "_v").alias("k"))


def _direction(linkage: str) -> Column:
    vector = F.col("vector").cast("array<double>")
    return normalised(vector) if linkage == "average" else vector


def _kept(clusters: DataFrame, vector: Column, keep: Keep) -> DataFrame:
    """Clusters (grp, cluster, size and what ``vector`` reads) as a table of (grp, cluster, size, short, mean)."""
    rows = clusters.withColumn("_v", vector).withColumn("short", F.when(~F.exists("_v", lambda x: x.cast("float").cast("double") != x), F.col("_v").cast("array<float>")))
    return keep(rows.select("grp", "cluster", "size", "short", F.when(F.col("short").isNull(), F.col("_v")).alias("mean")), "clusters")


def _distinct(items: DataFrame, keep: Keep, linkage: str, vectors: Vectors | None) -> tuple[DataFrame, DataFrame]:
    """(grp, item, cluster): the first item of an equal vector; and those firsts as clusters."""
    add = vectors or (lambda rows: rows.join(items.select("item", "vector"), "item"))
    vector = _direction(linkage)
    rows = keep(_keyed(vectors(items) if vectors else items, vector), "items")
    same = keep(rows.groupBy("grp", "h", "k").agg(F.min("item").alias("cluster"), F.count(F.lit(1)).alias("size")), "same")
    first = keep(rows.join(same.drop("size"), ["grp", "h", "k"]).select("grp", "item", "cluster"), "first")
    drop(rows)
    clusters = _kept(add(same.select("grp", F.col("cluster").alias("item"), "size")).withColumnRenamed("item", "cluster"), vector, keep)
    drop(same)
    return first, clusters


def _copies(first: DataFrame) -> DataFrame:
    """Merges (grp, a, b, height) of equal vectors."""
    return first.filter("item <> cluster").select("grp", F.col("cluster").alias("a"), F.col("item").alias("b"), F.lit(0.0).alias("height"))


def linkage_merges(items: DataFrame, keep: Keep, linkage: str = "average", local: int = LOCAL, tile: int = TILE) -> DataFrame:
    """Merges (grp, a, b, height) of all groups of ``items`` (grp string, item long, vector): b joins a.

    Clusters are known by their least item. A group of n items has n - 1 merges;
    those under a height leave the clusters that the sequential algorithm leaves.
    ``items`` are read twice, and each occurs once over all groups.
    ``keep(df, label)`` makes a round's tables durable. Under average linkage
    (1 - cosine) vectors are normalised. Rounds go on while a group has more than
    ``local`` clusters. Of equal distances the smallest numbers merge; a group of
    one item, and an empty table, give no merges.
    """
    first, clusters = _distinct(items, keep, linkage, None)
    return _copies(first).unionByName(_rounds(clusters, keep, linkage, local, tile))


def _rounds(clusters: DataFrame, keep: Keep, linkage: str, local: int, tile: int, most: float | None = None) -> DataFrame:
    """Merges (grp, a, b, height) of clusters (grp, cluster, size, short, mean), a table that goes; with ``most`` all up to that height, and perhaps some above.

    A cluster without another one up to ``most`` never gets one, and leaves.
    """
    merges, near, nears, tables, clusters = [], None, [], [clusters], clusters.withColumn("open", F.lit(True))
    while True:
        large = clusters.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        few, many = large.agg(F.count_if(F.col("n") <= local), F.count_if(F.col("n") > local)).first()
        if few or not many:
            large = keep(large.filter(F.col("n") > local).select("grp"), "large")  # a row for so many clusters at least
            merges.append(keep(_ended(clusters.join(F.broadcast(large), "grp", "left_anti"), linkage, few), "merges"))
            clusters = clusters.join(F.broadcast(large), "grp", "left_semi")
            near = near if near is None else near.join(F.broadcast(large), "grp", "left_semi")
            tables.append(large)  # goes with the clusters, after near
        if not many:
            drop(*tables, *nears)
            return reduce(DataFrame.unionByName, merges)
        new = _nearest(clusters, linkage, tile, keep)
        found = new if most is None else new.filter(F.col("height") <= most)
        near = found if near is None else keep(found.unionByName(near), "nearest")
        drop(*nears, *([] if near is found else [new]))
        nears = [new if near is found else near]
        if most is not None:
            before, clusters = tables, keep(clusters.join(near.select("grp", "cluster"), ["grp", "cluster"], "left_semi"), "clusters")
            drop(*before)
            tables = [clusters]
        back = near.select("grp", F.col("cluster").alias("nearest"), F.col("nearest").alias("cluster"))
        mutual = near.filter("cluster < nearest").join(back, ["grp", "cluster", "nearest"])
        mutual = keep(mutual.select("grp", F.col("cluster").alias("a"), F.col("nearest").alias("b"), "height"), "merges")
        if mutual.isEmpty():  # distances kept from before may tie with new ones: all are compared anew
            drop(mutual, *nears)
            clusters, near, nears = clusters.withColumn("open", F.lit(True)), None, []
            continue
        merges.append(mutual)
        merged = mutual.select("grp", F.explode(F.array("a", "b")).alias("cluster"), F.col("a").alias("into"))
        lost = near.join(merged.select("grp", F.col("cluster").alias("nearest")), ["grp", "nearest"], "left_semi").join(merged, ["grp", "cluster"], "left_anti")
        touched = keep(merged.unionByName(lost.select("grp", "cluster", F.lit(None).cast("long").alias("into"))), "touched")
        before, (clusters, tables) = tables, _joined(clusters, touched, keep)
        drop(*before)
        nears.append(touched)
        near = near.join(touched, ["grp", "cluster"], "left_anti").select("grp", "cluster", "nearest", "height")


def _parts(items: DataFrame, edges: DataFrame, keep: Keep) -> DataFrame:
    """(grp, item, part): components of the merges that stay, by their least item."""
    found = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), keep).withColumnRenamed("node", "item")
    return items.select("grp", "item").join(found, "item", "left").select("grp", "item", F.coalesce("component", "item").alias("part"))


def _near_merges(items: DataFrame, keep: Keep, most: float, local: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Average merges (grp, a, b, height) up to ``most`` (under 1) of distinct vectors, and (grp, item, cluster): the first item of an equal vector.

    Clusters of average linkage under a height lie within the components of all
    pairs under it, so components are found first and clustered apart. A vector
    that several groups share is compared once for all of them, if that is less
    work than to compare within groups. A vector without a length is near nothing.
    """
    vector = _direction("average")
    rows = keep(_keyed(items, vector), "items")
    same = keep(rows.filter("some").groupBy("grp", "h", "k").agg(F.min("item").alias("cluster"), F.count(F.lit(1)).alias("size")), "same")
    within = same.groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    shared = same.select("h", "k").distinct().count() ** 2 <= within
    same = same.withColumn("space", F.lit("") if shared else F.col("grp"))
    named = keep(same.groupBy("space", "h", "k").agg(F.min("cluster").alias("v")), "named")
    vectors = keep(items.select(F.col("item").alias("v"), vector.alias("mean")).join(named.select("space", "v"), "v"), "vectors")
    linked = keep(_linked(vectors, most, tile), "linked")
    found = keep(connected_components(linked, keep), "found")
    drop(linked)
    member = same.join(named, ["space", "h", "k"]).join(found.withColumnRenamed("node", "v"), "v")
    member = keep(member.select("grp", F.concat_ws(":", "grp", F.col("component").cast("string")).alias("part"), "cluster", "size", "v"), "members")
    several = member.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("part")
    clusters = member.join(several, "part").join(vectors, "v").select(F.col("part").alias("grp"), "cluster", "size", "mean")
    merges = _rounds(_kept(clusters, F.col("mean"), keep), keep, "average", local, tile, most + 1e-9).filter(F.col("height") <= most)
    drop(vectors)
    merges = merges.select("a", "b", "height").join(member.select("grp", F.col("cluster").alias("a")), "a")
    first = rows.join(same.select("grp", "h", "k", "cluster"), ["grp", "h", "k"], "left")
    return merges.select("grp", "a", "b", "height"), first.select("grp", "item", F.coalesce("cluster", "item").alias("cluster"))


def average_parts(items: DataFrame, keep: Keep, distance: float = 0.2, share: float = 0.35, raise_cap: float = 0.15, local: int = LOCAL, tile: int = TILE) -> DataFrame:
    """(grp, item, part) as ``cut_groups`` divides each group; items are numbers that occur once over all groups, and are read twice."""
    cuts = [round(distance + 0.05 * k, 2) for k in range(round(raise_cap / 0.05) + 1)]
    if cuts[-1] < 1:
        merges, first = _near_merges(items, keep, cuts[-1], local, tile)
        first = keep(first, "first")
    else:
        merges, first = linkage_merges(items, keep, "average", local, tile), items.select("grp", "item", F.col("item").alias("cluster"))
    merges = keep(merges, "merges")
    under = merges.groupBy("grp").agg(*[F.count_if(F.col("height") <= c).alias(f"m{k}") for k, c in enumerate(cuts)])
    n = first.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("item") == F.col("cluster")).alias("d")).join(under, "grp", "left")
    few = lambda k: F.col("d") - F.coalesce(f"m{k}", F.lit(0)) <= F.greatest(F.lit(1.0), F.col("n") * share)
    cut = F.coalesce(*[F.when(few(k), c) for k, c in enumerate(cuts)], F.lit(cuts[-1]))
    kept = merges.join(n.select("grp", cut.alias("cut")), "grp").filter("height <= cut")
    parts = _parts(first.filter("item = cluster").select("grp", "item"), kept, keep).select(F.col("item").alias("cluster"), "part")
    return first.join(parts, "cluster").select("grp", "item", "part")


def ward_parts(items: DataFrame, keep: Keep, k: int, local: int = ENDED, tile: int = TILE, vectors: Vectors | None = None) -> DataFrame:
    """(grp, item, part): each group in min(k, n) parts, by undoing its k - 1 highest Ward merges.

    ``vectors`` adds a vector to rows with an item where ``items`` have none; then no step before needs to move any.
    """
    first, clusters = _distinct(items, keep, "ward", vectors)
    merges = keep(_rounds(clusters, keep, "ward", local, tile), "merges")
    high = merges.unionByName(_copies(first)).withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("height"), F.desc("b")))).filter(F.col("_r") < k)
    high = keep(high.select("grp", "a", "b"), "high")  # k rows for each group
    own = first.filter("item = cluster").select("grp", "item")
    parts = _parts(own, merges.join(high, ["grp", "a", "b"], "left_anti"), keep).select(F.col("item").alias("cluster"), "part")
    apart = high.select(F.col("b").alias("item"), F.lit(True).alias("_apart"))  # of copies, only where a group has fewer than k vectors
    found = first.join(parts, "cluster").join(apart, "item", "left")
    return found.select("grp", "item", F.when(F.col("_apart") & (F.col("item") != F.col("cluster")), F.col("item")).otherwise(F.col("part")).alias("part"))
