"""NumPy kernels on blocks of vectors and edges, for use inside Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows_of(col: pa.ChunkedArray) -> np.ndarray:
    """An array column of equal lengths as a matrix of doubles."""
    c = col.combine_chunks()
    if isinstance(c, pa.ChunkedArray):
        c = c.chunk(0) if c.num_chunks else pa.array([], c.type)
    if not len(c):
        return np.empty((0, 0))
    return np.asarray(c.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(c), -1)


def sq_dists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, exact to rounding of the double sum (differences are taken, not products expanded)."""
    out = np.empty((len(a), len(b)))
    for i in range(len(a)):
        d = b - a[i]
        out[i] = np.einsum("ij,ij->i", d, d)
    return out


def prim(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of points: (lo id, hi id, weight). Ties go by (weight, lo id, hi id)."""
    n = len(x)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    best, frm = np.full(n, np.inf), np.zeros(n, np.int64)
    out = np.zeros(n, bool)
    cur, edges = 0, []
    for _ in range(n - 1):
        out[cur] = True
        d = x - x[cur]
        w = np.einsum("ij,ij->i", d, d)
        lo, hi = np.minimum(ids, ids[cur]), np.maximum(ids, ids[cur])
        flo, fhi = np.minimum(ids, ids[frm]), np.maximum(ids, ids[frm])
        less = (w < best) | ((w == best) & ((lo < flo) | ((lo == flo) & (hi < fhi))))
        less &= ~out
        best[less], frm[less] = w[less], cur
        open_ = np.where(out, np.inf, best)
        m = open_.min()
        c = np.flatnonzero(open_ == m)
        if len(c) > 1:
            c = c[np.lexsort((np.maximum(ids[c], ids[frm[c]]), np.minimum(ids[c], ids[frm[c]])))]
        cur = int(c[0])
        edges.append((ids[frm[cur]], ids[cur], m))
    a, b, w = (np.array(z) for z in zip(*edges))
    return np.minimum(a, b), np.maximum(a, b), w


def kruskal(lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the edges of the minimum spanning forest, ties by (weight, lo, hi); all rounds are vectorised."""
    if not len(w):
        return np.empty(0, np.int64)
    order = np.lexsort((hi, lo, w))
    nodes, pos = np.unique(np.concatenate([lo[order], hi[order]]), return_inverse=True)
    i, j = pos[: len(w)], pos[len(w) :]
    lab, keep, idx = np.arange(len(nodes)), np.zeros(len(w), bool), np.arange(len(w))
    while True:
        a, b = lab[i[idx]], lab[j[idx]]
        cross = a != b
        idx, a, b = idx[cross], a[cross], b[cross]
        if not len(idx):
            return order[keep]
        best = np.full(len(nodes), len(w))
        np.minimum.at(best, a, idx)
        np.minimum.at(best, b, idx)
        own = np.flatnonzero(best < len(w))
        e = best[own]
        keep[e] = True
        ea, eb = lab[i[e]], lab[j[e]]
        up = np.arange(len(nodes))
        up[own] = np.where(ea == own, eb, ea)
        pair = (up[up[own]] == own) & (own < up[own])
        up[own[pair]] = own[pair]
        while (up[up] != up).any():
            up = up[up]
        lab = up[lab]


def labels(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the nodes of an edge list."""
    nodes, pos = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    i, j = pos[: len(lo)], pos[len(lo) :]
    lab = np.arange(len(nodes))
    while True:
        m = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], m)
        np.minimum.at(new, lab[j], m)
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        while (new[new] != new).any():
            new = new[new]
        if (new == lab).all():
            return nodes, nodes[lab]
        lab = new
