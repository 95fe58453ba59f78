"""Usable vectors, copies folded, and spatial cells with an exact bound for routing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import pin

SAMPLE = 8192  # vectors the cells are fitted on, whatever the size of the table
MOST_CELLS = 512
MANY_CELLS = 16_384  # of a table that asks for more (``fit_cells``, grow)
ROWS_A_CELL = 1024
SAMPLED = 8  # sampled vectors a cell then
MOST_SHARDS = 65_536  # centres that travel to the tasks (16 MB at 64 lanes)
FITTED = 16_384  # sampled vectors of one cell on which its own centres are fitted


def matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Binary column of ``dim`` float32 each to an array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.empty((0, dim), np.float32)
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.float32).reshape(-1, dim)


def binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, dtype=np.float32)
    n, width = len(x), x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(x.tobytes())])


def _usable(it: Iterator[pa.RecordBatch], dim: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for b in it:
        e = b.column("vector")
        size = pc.fill_null(pc.list_value_length(e), -1).to_numpy(zero_copy_only=False)
        b = b.filter(pa.array(size == dim))
        e = b.column("vector")
        if not b.num_rows:
            continue
        x = pc.fill_null(e.flatten().cast(pa.float32()), np.float32("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
        ok = np.isfinite(x).all(1)
        rest = b.select(keep).filter(pa.array(ok))
        yield pa.RecordBatch.from_arrays([*rest.columns, binary(x[ok] + np.float32(0))], names=[*keep, "vec"])


def usable(rows: DataFrame, vector: str, dim: int, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and vec (binary, float32) of the rows whose vector has exactly ``dim`` finite, non-null elements."""
    df = rows.where(F.col(vector).isNotNull()).select(*keep, F.col(vector).alias("vector"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    return df.mapInArrow(partial(_usable, dim=dim, keep=keep), f"{kinds}, vec binary")


def fold_copies(vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(reps: rep, vec; members: key, rep). Equal vectors under several keys are kept once, under the smallest key.

    Equality goes by a 128-bit hash of the bytes, so no group of copies is gathered anywhere.
    """
    h = vectors.where(F.col(key).isNotNull()).select(key, "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    best = h.groupBy("h1", "h2").agg(F.min(F.struct(F.col(key).alias("rep"), "vec")).alias("m"))
    reps = pin(best.select("h1", "h2", F.col("m.rep").alias("rep"), F.col("m.vec").alias("vec")), shuffles=False)
    members = h.select(key, "h1", "h2").distinct().join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select(key, "rep")
    out = reps.select("rep", "vec")
    out._vecloom_path = reps._vecloom_path  # ``drop`` of it deletes both
    return out, members


def fold_groups(vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(reps: rep, vec; groups: key, rep): as ``fold_copies``, but groups names only keys that share their vector with
    another key, so that nothing else has to be joined."""
    h = vectors.where(F.col(key).isNotNull()).select(key, "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    best = h.groupBy("h1", "h2").agg(F.min(F.struct(F.col(key).alias("rep"), "vec")).alias("m"), F.max(key).alias("last"))
    reps = pin(best.select("h1", "h2", F.col("m.rep").alias("rep"), F.col("m.vec").alias("vec"), "last"))
    several = reps.where("last > rep").select("h1", "h2", "rep")
    groups = pin(h.select(key, "h1", "h2").join(several, ["h1", "h2"]).select(key, "rep").distinct())
    return reps.select("rep", "vec"), groups


class Cells:
    """Voronoi cells of centres fitted on a bounded sample. ``far`` gives the least distance a cell's points can have."""

    def __init__(self, centres: np.ndarray):
        self.c = np.ascontiguousarray(centres, dtype=np.float32)
        self.gap = None  # between all centres, if they are few
        if len(self.c) <= MOST_CELLS:
            c = self.c.astype(np.float64)
            self.gap = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 0)).astype(np.float32)
            np.fill_diagonal(self.gap, np.inf)
        self.mid = self.c.mean(0)

    def to(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row to each centre."""
        x, c = x - self.mid, self.c - self.mid
        return np.maximum(np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", c, c)[None] - 2 * (x @ c.T), 0)

    def home(self, x: np.ndarray) -> np.ndarray:
        step = self._step()
        return np.concatenate([self.to(x[p : p + step]).argmin(1) for p in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)

    def _step(self) -> int:
        """Rows whose distances to all centres are held at once: 2^22 distances."""
        return max(64, (1 << 22) // len(self.c))

    def _gaps(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distance between the centres of each pair (i, j), infinite for one and the same."""
        if self.gap is not None:
            return self.gap[i, j]
        parts = [((self.c[i[p : p + 65536]] - self.c[j[p : p + 65536]]) ** 2).sum(1) for p in range(0, len(i), 65536)]
        return np.where(i == j, np.inf, np.sqrt(np.concatenate(parts))) if parts else np.empty(0, np.float32)

    def near(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that can hold a point within ``reach`` (not squared) of a row: where ``far`` is not beyond it.

        The gap of two centres is at most the sum of a row's distances to them, so that only cells whose centre is at most
        2 ``reach`` farther away than the nearest one need the plane between them.
        """
        rows, cells = [], []
        step = self._step()
        for p in range(0, len(x), step):
            d = self.to(x[p : p + step])
            h = d.argmin(1)
            least = d[np.arange(len(d)), h]
            slack = 1e-3 * (1 + np.sqrt(least))
            r, j = np.nonzero(d <= ((np.sqrt(least) + 2 * (reach + slack)) * 1.001 + 1e-3)[:, None] ** 2)
            f = (d[r, j] - least[r]) / (2 * self._gaps(h[r], j))
            ok = (h[r] == j) | (f - slack[r] <= reach)
            rows.append(p + r[ok]), cells.append(j[ok])
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))

    def far(self, x: np.ndarray) -> np.ndarray:
        """Lower bound of the distance (not squared) from each row to any point whose home is another cell: its distance
        to the plane halfway between its own centre and the other one. 0 for its own cell. Slightly low, to allow for rounding."""
        d = self.to(x)
        h = d.argmin(1)
        every = np.arange(len(self.c))
        gap = self.gap[h] if self.gap is not None else self._gaps(np.repeat(h, len(every)), np.tile(every, len(x))).reshape(len(x), -1)
        f = (d - d[np.arange(len(x)), h][:, None]) / (2 * gap)
        f[np.arange(len(x)), h] = 0
        return np.maximum(f - 1e-3 * (1 + np.sqrt(d.min(1)))[:, None], 0)


class Shards:
    """Leaves of two levels of cells: a cell with more vectors than a shard should hold has centres of its own.

    ``home`` names the leaf of a vector, ``far`` bounds from below its distance to any point of each leaf: by the plane
    between cells and, within a cell, by the plane between the leaf's centre and the nearest one there.
    """

    def __init__(self, cells: Cells, within: dict[int, np.ndarray]):
        self.cells, self.within = cells, {c: Cells(z) for c, z in within.items() if len(z) > 1}
        many = np.array([len(self.within[c].c) if c in self.within else 1 for c in range(len(cells.c))])
        self.first = np.concatenate([[0], np.cumsum(many)])
        self.top = np.repeat(np.arange(len(many)), many)
        self.n = int(self.first[-1])

    def home(self, x: np.ndarray) -> np.ndarray:
        top = self.cells.home(x)
        leaf = self.first[top]
        for c, z in self.within.items():
            k = np.flatnonzero(top == c)
            if len(k):
                leaf[k] += z.home(x[k])
        return leaf

    def near(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that can hold a point within ``reach`` (not squared) of a row."""
        r, c = self.cells.near(x, reach)
        single = ~np.isin(c, list(self.within)) if self.within else np.ones(len(c), bool)
        rows, leaves = [r[single]], [self.first[c[single]]]
        for k, z in self.within.items():
            own = r[c == k]
            if len(own):
                i, j = z.near(x[own], reach)
                rows.append(own[i])
                leaves.append(self.first[k] + j)
        return np.concatenate(rows), np.concatenate(leaves)

    def far(self, x: np.ndarray) -> np.ndarray:
        f = self.cells.far(x)[:, self.top]
        for c, z in self.within.items():
            part = f[:, self.first[c] : self.first[c + 1]]
            np.maximum(part, z.far(x), out=part)
        return f


def fit_cells(reps: DataFrame, n: int, dim: int, rows_per_cell: int = 8192, grow: bool = False) -> Cells:
    """Cells from a sample of about ``SAMPLE`` vectors, chosen by a hash of their key.

    Centres are picked farthest-first; of 2 to ``MOST_CELLS`` centres that number is used after which the farthest
    sample point comes nearest most abruptly (the clusters are then covered), else n / ``rows_per_cell``. With ``grow``
    a table of more clusters than that has them covered too: up to a centre for every ``ROWS_A_CELL`` vectors.
    """
    most = max(MOST_CELLS, min(MANY_CELLS, n // ROWS_A_CELL)) if grow else MOST_CELLS
    share = int(min(1.0, max(SAMPLE, SAMPLED * most if most > MOST_CELLS else 0) / max(n, 1)) * (1 << 30))
    rows = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < share).orderBy("rep").select("vec").collect()
    if not rows:
        return Cells(np.zeros((1, dim), np.float32))
    x = np.frombuffer(b"".join(bytes(r[0]) for r in rows), np.float32).reshape(-1, dim)
    if most > MOST_CELLS:
        return Cells(_many_centres(x, most, -(-n // rows_per_cell)))
    x = x.astype(np.float64)
    most = min(most, len(x))
    pick, near, radius = [0], ((x - x[0]) ** 2).sum(1), []
    while len(pick) < most:
        j = int(near.argmax())
        radius.append(near[j])
        if near[j] <= 0:
            break
        pick.append(j)
        near = np.minimum(near, ((x - x[j]) ** 2).sum(1))
    k = _covering(len(pick), np.asarray([*radius, near.max()]), -(-n // rows_per_cell))
    c = x[pick[:k]]
    for _ in range(3):
        d = (x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T
        h = d.argmin(1)
        for j in range(len(c)):
            if (h == j).any():
                c[j] = x[h == j].mean(0)
    return Cells(c)


def _covering(picked: int, radius: np.ndarray, otherwise: int) -> int:
    """After how many of the centres picked the farthest point comes nearest most abruptly; squared radii by centre."""
    r = np.sqrt(np.maximum(radius, 1e-12))
    k = max(1, min(picked, otherwise))
    if len(r) > 3:
        drop = r[:-1] / r[1:]
        best = int(drop[1:].argmax()) + 1
        if drop[best] > 1.4:
            k = min(picked, max(best + 1, 2))
    return k


def _many_centres(x: np.ndarray, most: int, otherwise: int) -> np.ndarray:
    """As ``fit_cells`` does it, for thousands of centres: a product for each pick, and means over blocks of rows."""
    shift = x.mean(0)
    y = np.ascontiguousarray(x - shift)
    own = np.einsum("ij,ij->i", y, y)
    to = lambda j: np.maximum(own + own[j] - 2 * (y @ y[j]), 0)
    most = min(most, len(y))
    pick, near, radius = [0], to(0), []
    while len(pick) < most:
        j = int(near.argmax())
        radius.append(near[j])
        if near[j] <= 1e-6 * own[j]:  # rounding
            break
        pick.append(j)
        np.minimum(near, to(j), out=near)
    k = _covering(len(pick), np.asarray([*radius, near.max()], np.float64), otherwise)
    c = y[pick[: k + 1]].copy()  # the pick that brings the farthest point near is one of them
    for _ in range(3):
        h = Cells(c).home(y)
        count = np.bincount(h, minlength=len(c))
        for lane in range(y.shape[1]):
            c[:, lane] = np.where(count > 0, np.bincount(h, y[:, lane], len(c)) / np.maximum(count, 1), c[:, lane])
    return c + shift


def _assign(it: Iterator[pa.RecordBatch], cells: Cells, dim: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        x = matrix(b.column("vec"), dim)
        h = cells.home(x).astype(np.int32) if len(x) else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h, pa.int32())], names=[*b.schema.names, "cell"])


def in_cells(df: DataFrame, cells: Cells, dim: int) -> DataFrame:
    """``df`` (with a column vec) and the cell of each row."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(partial(_assign, cells=cells, dim=dim), f"{kinds}, cell int")


def _centres(table: pa.Table, dim: int, n: dict[int, int]) -> pa.Table:
    """Centres within one cell from its sample: the first by key, moved to their means three times."""
    table = table.sort_by("h")
    cell = table["cell"][0].as_py()
    x = matrix(table["vec"], dim).astype(np.float64)
    c = x[: n[cell]].copy()
    for _ in range(3):
        z = Cells(c)
        h = np.concatenate([z.home(x[a : a + 1024].astype(np.float32)) for a in range(0, len(x), 1024)])
        count = np.bincount(h, minlength=len(c))
        for lane in range(dim):
            s = np.bincount(h, x[:, lane], len(c))
            c[:, lane] = np.where(count > 0, s / np.maximum(count, 1), c[:, lane])
    return pa.table({"cell": pa.array(np.full(len(c), cell, np.int32)), "vec": binary(c)})


def fit_shards(reps: DataFrame, dim: int, room: int, cells: Cells | None = None) -> Shards:
    """Cells of ``reps`` (rep, vec), and in each that holds more than ``room`` vectors centres of its own, two for every
    ``room`` of them, fitted on at most ``FITTED`` vectors of the cell (or as many as it has centres). All of them
    together are at most ``MOST_SHARDS``; beyond that ``room`` grows with the table."""
    n = reps.count()
    cells = cells or fit_cells(reps, n, dim)
    placed = in_cells(reps, cells, dim)
    held = {r[0]: r[1] for r in placed.groupBy("cell").count().collect()}  # one row per cell, at most MOST_CELLS
    room = max(room, -(-n // (MOST_SHARDS // 2)))
    want = {c: -(-2 * m // room) for c, m in held.items() if m > room}
    if not want:
        return Shards(cells, {})
    take = {c: max(k, min(held[c], FITTED)) for c, k in want.items()}
    share = F.create_map(*[F.lit(z) for c, t in take.items() for z in (int(c), int(min(1.0, t / held[c]) * (1 << 30)))])
    h = F.xxhash64(F.lit(5), "rep")
    part = placed.where(F.pmod(h, F.lit(1 << 30)) < F.element_at(share, F.col("cell"))).select("cell", "vec", h.alias("h"))
    within: dict[int, list] = {}
    for r in part.groupBy("cell").applyInArrow(lambda t: _centres(t, dim, want), "cell int, vec binary").collect():
        within.setdefault(r[0], []).append(np.frombuffer(r[1], np.float32))
    return Shards(cells, {c: np.stack(z) for c, z in within.items()})
