"""A robust-pruned directed graph over one shard of vectors, in NumPy, with many searches in lock-step."""

from __future__ import annotations

import numpy as np


def beam_search(x: np.ndarray, nbr: np.ndarray, entry: np.ndarray, q: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the ``width`` nearest rows of ``x`` met by a beam search: (positions, squared L2).

    Unfilled places hold len(x) and infinity. All searches advance together: a step takes each query's ``expand``
    nearest unvisited beam entries and merges their neighbours into its beam.
    """
    n, b, r = len(x), len(q), nbr.shape[1]
    xn = np.einsum("ij,ij->i", x, x)
    seen = np.zeros((b, n + 1), dtype=bool)
    seen[:, n] = True
    e = entry[: max(1, min(len(entry), n))]
    d0 = xn[e][None] - 2 * (q @ x[e].T)
    o = np.argsort(d0, 1, kind="stable")[:, :width]
    ids = np.full((b, width), n, dtype=np.int64)
    d = np.full((b, width), np.inf, dtype=np.float32)
    ids[:, : o.shape[1]] = e[o]
    d[:, : o.shape[1]] = np.take_along_axis(d0, o, 1)
    seen[:, e] = True
    flat, turn = seen.ravel(), np.empty(b * (n + 1), dtype=np.int32)
    done = ids == n
    act = np.arange(b)
    place = np.zeros(b, dtype=np.int64)
    while len(act):
        todo = ~done[act]
        pick = todo & (np.cumsum(todo, 1) <= expand)
        live = pick.any(1)
        act, pick = act[live], pick[live]
        if not len(act):
            break
        row, col = np.nonzero(pick)
        at = act[row]
        done[at, col] = True
        to = nbr[ids[at, col]].ravel()
        who = np.repeat(at, r)
        key = who * (n + 1) + to
        new = np.flatnonzero(~flat[key])
        if not len(new):
            continue
        key = key[new]
        turn[key] = np.arange(len(key), dtype=np.int32)
        new = new[turn[key] == np.arange(len(key))]  # a point that several neighbours lead to counts once
        who, to = who[new], to[new]
        seen[who, to] = True
        dist = xn[to] - 2 * np.einsum("ij,ij->i", x[to], q[who])
        count = np.bincount(who, minlength=b)
        start = np.cumsum(count) - count
        place[act] = np.arange(len(act))
        most = int(count.max())
        md = np.full((len(act), width + most), np.inf, dtype=np.float32)
        mi = np.full((len(act), width + most), n, dtype=np.int64)
        mx = np.ones((len(act), width + most), dtype=bool)
        md[:, :width], mi[:, :width], mx[:, :width] = d[act], ids[act], done[act]
        pos = width + np.arange(len(who)) - start[who]
        md[place[who], pos], mi[place[who], pos], mx[place[who], pos] = dist, to, False
        o = np.argpartition(md, width - 1, 1)[:, :width]
        o = np.take_along_axis(o, np.argsort(np.take_along_axis(md, o, 1), 1), 1)
        d[act], ids[act], done[act] = np.take_along_axis(md, o, 1), np.take_along_axis(mi, o, 1), np.take_along_axis(mx, o, 1)
    return ids, d + np.einsum("ij,ij->i", q, q)[:, None].astype(np.float32)


def robust_prune(x: np.ndarray, cand: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Keep of each row's candidates up to ``degree`` diverse ones: nearest first, each chosen one removes those that
    are nearer to it, by the factor ``alpha``, than to the row's own point. len(x) marks empty places."""
    n, rows = len(x), np.arange(len(cand))
    c = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])[cand]
    nn = np.einsum("ijk,ijk->ij", c, c)
    between = nn[:, :, None] + nn[:, None, :] - 2 * (c @ c.transpose(0, 2, 1))
    left = np.where(cand < n, dist, np.inf)
    out = np.full((len(cand), degree), n, dtype=np.int64)
    for k in range(degree):
        j = left.argmin(1)
        ok = np.isfinite(left[rows, j])
        if not ok.any():
            break
        out[ok, k] = cand[rows, j][ok]
        gone = alpha * between[rows, j] <= dist
        gone[~ok] = False
        left[gone] = np.inf
        left[rows, j] = np.inf
    return out


def build(x: np.ndarray, degree: int = 32, width: int = 48, alpha: float = 1.2, seed: int = 7, entries: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours with len(x) as padding, entry points). Points enter in random batches that double in size: a greedy
    search over the graph so far proposes neighbours, robust pruning keeps diverse ones, reverse edges are pruned too.
    A sixteenth of the points serve as entries: finding the nearest of them is one small matrix product."""
    n = len(x)
    x = np.ascontiguousarray(x, dtype=np.float32)
    order = np.random.default_rng(seed).permutation(n)
    nbr = np.full((n + 1, degree), n, dtype=np.int64)
    if n <= 1:
        return nbr[:n], np.arange(n)
    first = order[: min(n, 4 * degree)]
    xf = x[first]
    g = np.einsum("ij,ij->i", xf, xf)
    full = g[:, None] + g[None] - 2 * xf @ xf.T
    np.fill_diagonal(full, np.inf)
    m = min(len(first) - 1, width)
    near = np.argpartition(full, m - 1, 1)[:, :m]
    nbr[first] = robust_prune(x, first[near], np.take_along_axis(full, near, 1), degree, alpha)
    entry = order[: entries or max(16, n // 16)]
    done = len(first)
    while done < n:
        batch = order[done : min(n, done * 2, done + 1024)]
        cand, dist = beam_search(x, nbr, order[: min(done, len(entry))], x[batch], width)
        own = robust_prune(x, cand, dist, degree, alpha)
        nbr[batch] = own
        src, k = np.nonzero(own < n)
        to, frm = own[src, k], batch[src]
        back = ((x[to] - x[frm]) ** 2).sum(1)
        o = np.lexsort((back, to))
        to, frm, back = to[o], frm[o], back[o]
        node, start, count = np.unique(to, return_index=True, return_counts=True)
        pos = np.arange(len(to)) - np.repeat(start, count)
        near = pos < degree
        both = np.full((len(node), 2 * degree), n, dtype=np.int64)
        both[:, :degree] = nbr[node]
        both[np.repeat(np.arange(len(node)), count)[near], degree + pos[near]] = frm[near]
        used = (both < n).sum(1)
        fits = used <= degree
        nbr[node[fits]] = np.sort(both[fits], 1)[:, :degree]
        over = np.nonzero(~fits)[0]
        for a in range(0, len(over), 1024):
            part = over[a : a + 1024]
            c = both[part]
            xc = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])[c]
            dc = ((xc - x[node[part]][:, None]) ** 2).sum(2)
            nbr[node[part]] = robust_prune(x, c, dc, degree, alpha)
        done += len(batch)
    nbr = _lift(x, nbr[:n], degree * 2 // 3, degree // 4)
    return nbr, _reach_all(nbr, entry)


def _lift(x: np.ndarray, nbr: np.ndarray, room: int, least: int) -> np.ndarray:
    """Add to nodes that few edges lead to an edge from each of their ``least`` nearest neighbours (at most ``room`` more
    per node, the shortest first): pruning of reverse edges may have cut all near ways to a point."""
    n = len(x)
    led = np.bincount(nbr[nbr < n], minlength=n)
    out = np.hstack([nbr, np.full((n, room), n, dtype=np.int64)])
    poor = np.flatnonzero(led < 2 * least)
    if not len(poor):
        return out
    to, frm, dist = [], [], []
    wide = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    for a in range(0, len(poor), 1024):
        p = poor[a : a + 1024]
        c = nbr[p]
        d = np.where(c < n, ((wide[c] - x[p][:, None]) ** 2).sum(2), np.inf)
        o = np.argsort(d, 1, kind="stable")[:, :least]
        d, c = np.take_along_axis(d, o, 1), np.take_along_axis(c, o, 1)
        r, k = np.nonzero(np.isfinite(d))
        to.append(p[r]), frm.append(c[r, k]), dist.append(d[r, k])
    t, f, d = np.concatenate(to), np.concatenate(frm), np.concatenate(dist)
    new = ~(nbr[f] == t[:, None]).any(1)
    t, f, d = t[new], f[new], d[new]
    o = np.lexsort((t, d, f))
    t, f = t[o], f[o]
    pos = np.arange(len(f)) - np.searchsorted(f, f)
    ok = pos < room
    out[f[ok], nbr.shape[1] + pos[ok]] = t[ok]
    return out


def _reach_all(nbr: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Entry points from which every node can be reached: the given ones and one for each part they miss."""
    n = len(nbr)
    met = np.zeros(n + 1, dtype=bool)
    met[n] = True
    out, wave, low = list(entry), entry, 0
    met[entry] = True
    while True:
        while len(wave):
            to = np.unique(nbr[wave])
            wave = to[~met[to]]
            met[wave] = True
        rest = np.flatnonzero(~met[low:n])
        if not len(rest):
            return np.asarray(out)
        low += rest[0]
        out.append(low)
        met[low] = True
        wave = np.array([low])


def search(x: np.ndarray, nbr: np.ndarray, entry: np.ndarray, q: np.ndarray, k: int, width: int, places: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest found for each query; the beam is at least ``k`` wide. ``places`` bounds the marks held at once."""
    n = len(x)
    w = max(width, k)
    ids, ds = np.full((len(q), k), n, dtype=np.int64), np.full((len(q), k), np.inf, dtype=np.float32)
    block = max(64, min(1024, places // (n + 1)))
    for a in range(0, len(q), block):
        i, d = beam_search(x, nbr, entry, q[a : a + block], w, expand=max(4, w // 8))
        ids[a : a + block], ds[a : a + block] = i[:, :k], d[:, :k]
    return ids, ds
