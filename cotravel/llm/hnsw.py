"""Hierarchical navigable small-world graphs in numpy: batched insertion and lock-step beam search."""

from __future__ import annotations

import numpy as np

M = 16  # neighbours a node picks in upper layers; twice as many in the lowest
BUILD_BEAM = 64
BLOCK = 1024


def neighbours(m: int, layer: int) -> int:
    return 2 * m if layer == 0 else m


def beam(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Best ``ef`` nodes (ids, similarities, best first; -1 where fewer were reached) of each query, from its entries.

    All queries advance together: each expands its ``step`` best unexpanded nodes until its beam has none."""
    n, rows = len(q), np.arange(len(q))
    ef = max(ef, entry.shape[1], step)
    ids, sim, done = np.full((n, ef), -1, np.int32), np.full((n, ef), -np.inf, np.float32), np.ones((n, ef), bool)
    seen = np.zeros((n, len(graph)), bool)
    e = entry.shape[1]
    ids[:, :e], sim[:, :e] = entry, np.einsum("qed,qd->qe", x[entry], q)
    done[:, :e] = False
    for k in range(1, e):  # an entry given twice counts once
        twice = (entry[:, :k] == entry[:, k : k + 1]).any(axis=1)
        ids[twice, k], sim[twice, k], done[twice, k] = -1, -np.inf, True
    seen[rows[:, None], entry] = True
    live = rows
    while len(live):
        key = np.where(done[live], -np.inf, sim[live])
        pick = np.argpartition(-key, step - 1, axis=1)[:, :step]
        ok = np.take_along_axis(key, pick, axis=1) > -np.inf
        some = ok.any(axis=1)
        live, pick, ok = live[some], pick[some], ok[some]
        if not len(live):
            break
        done[live[:, None], pick] = True
        nb = np.where(ok[:, :, None], graph[ids[live[:, None], pick]], -1).reshape(len(live), -1)
        nb.sort(axis=1)
        fresh = nb >= 0
        fresh[:, 1:] &= nb[:, 1:] != nb[:, :-1]
        fresh &= ~seen[live[:, None], nb]
        r, c = np.nonzero(fresh)
        new = nb[r, c]
        seen[live[r], new] = True
        s = np.full(nb.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("fd,fd->f", x[new], q[live[r]])
        width = int(fresh.sum(axis=1).max(initial=0))
        if width == 0:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        s, nb = np.take_along_axis(s, order, axis=1), np.take_along_axis(nb, order, axis=1)
        all_s, all_i = np.concatenate([sim[live], s], axis=1), np.concatenate([ids[live], nb], axis=1)
        all_d = np.concatenate([done[live], ~np.isfinite(s)], axis=1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        sim[live], ids[live], done[live] = (np.take_along_axis(a, top, axis=1) for a in (all_s, all_i, all_d))
    order = np.argsort(-sim, axis=1, kind="stable")
    ids, sim = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sim, order, axis=1)
    ids[~np.isfinite(sim)] = -1
    return ids, sim


def diverse(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Pick up to ``m`` of each row's candidates (best first, -1 none): those nearer to the row's node than to any
    already picked, then the best of the rest. Keeps links out of tight clusters."""
    ok = cand >= 0
    v = x[np.maximum(cand, 0)]
    near = np.matmul(v, v.transpose(0, 2, 1))
    picked, count = np.zeros(cand.shape, bool), np.zeros(len(cand), np.int64)
    for j in range(cand.shape[1]):
        clash = (near[:, j, :j] >= sim[:, j : j + 1]) & picked[:, :j]
        take = ok[:, j] & (count < m) & ~clash.any(axis=1)
        picked[:, j] = take
        count += take
    rank = np.argsort(np.where(picked, 0, np.where(ok, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1]), axis=1)[:, :m]
    out = np.take_along_axis(cand, rank, axis=1)
    if out.shape[1] < m:
        out = np.concatenate([out, np.full((len(out), m - out.shape[1]), -1, out.dtype)], axis=1)
    return out


def _best(ids: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sim, order, axis=1)


class Index:
    """Nodes are the rows of ``x`` (unit vectors in random order); layer l holds the first sizes[l] of them."""

    def __init__(self, x: np.ndarray, graphs: list[np.ndarray] | None = None, m: int = M) -> None:
        self.x, self.sizes = x, [len(x)]
        while self.sizes[-1] > 4 * m:
            self.sizes.append(max(1, self.sizes[-1] // m))
        self.graphs: list[np.ndarray] = graphs or []
        if graphs is None:
            self.graphs = [np.full((n, neighbours(m, k)), -1, np.int32) for k, n in enumerate(self.sizes)]
            for layer in reversed(range(len(self.sizes))):
                self._build(layer, neighbours(m, layer))

    def _build(self, layer: int, m: int) -> None:
        n, graph = self.sizes[layer], self.graphs[layer]
        above = self.sizes[layer + 1] if layer + 1 < len(self.sizes) else 0
        at = 0
        while at < n:
            end = min(n, max(BLOCK, above)) if at == 0 else min(n, at + min(BLOCK, at))
            for a in range(at, end, 256):
                b = min(end, a + 256)
                q = self.x[a:b]
                # members of the block so far (at the start: all of the first block), compared directly
                lo, hi = (0, end) if at == 0 else (at, b)
                own = q @ self.x[lo:hi].T
                own[np.arange(b - a), np.arange(a - lo, b - lo)] = -np.inf
                k = min(BUILD_BEAM, hi - lo)
                top = np.argpartition(-own, k - 1, axis=1)[:, :k]
                ids, sim = (lo + top).astype(np.int32), np.take_along_axis(own, top, axis=1)
                if at:
                    more, s = beam(self.x, graph[:at], q, self.entries(q, layer, 2), BUILD_BEAM)
                    ids, sim = np.concatenate([ids, more], axis=1), np.concatenate([sim, s], axis=1)
                ids = np.where(np.isfinite(sim), ids, -1)
                ids, sim = _best(ids, sim)
                picked = diverse(self.x, ids[:, : 2 * BUILD_BEAM], sim[:, : 2 * BUILD_BEAM], m)
                graph[a:b] = picked
            self._reverse(graph, at, end, m)
            at = end

    def _reverse(self, graph: np.ndarray, a: int, b: int, m: int) -> None:
        """Add the links back from the neighbours of nodes a..b, thinning lists that overflow."""
        u = np.repeat(np.arange(a, b, dtype=np.int32), m)
        v = graph[a:b].ravel()
        u, v = u[v >= 0], v[v >= 0]
        s = np.einsum("fd,fd->f", self.x[u], self.x[v])
        order = np.lexsort((-s, v))
        u, v, s = u[order], v[order], s[order]
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        rank = np.arange(len(v)) - np.repeat(first, np.diff(np.r_[first, len(v)]))
        keep = rank < 2 * m
        u, v, rank = u[keep], v[keep], rank[keep]
        nodes, row = np.unique(v, return_inverse=True)
        for k in range(0, len(nodes), 2048):
            part = nodes[k : k + 2048]
            sel = (row >= k) & (row < k + len(part))
            new = np.full((len(part), int(rank[sel].max(initial=0)) + 1), -1, np.int32)
            new[row[sel] - k, rank[sel]] = u[sel]
            new[(new[:, :, None] == graph[part][:, None, :]).any(axis=2)] = -1
            cand = np.concatenate([graph[part], new], axis=1)
            sim = np.where(cand >= 0, np.einsum("pcd,pd->pc", self.x[np.maximum(cand, 0)], self.x[part]), -np.inf)
            cand, sim = _best(cand, sim)
            graph[part] = np.where(((cand >= 0).sum(axis=1) > m)[:, None], diverse(self.x, cand, sim, m), cand[:, :m])

    def entries(self, q: np.ndarray, layer: int, e: int) -> np.ndarray:
        """Entry nodes for ``layer``: the best of the top layer, refined on the way down."""
        top = len(self.sizes) - 1
        n = self.sizes[top]
        if layer == top:
            return np.tile(np.arange(min(e, n)), (len(q), 1))
        s = q @ self.x[:n].T
        at = np.argsort(-s, axis=1)[:, : min(e, n)]
        for k in range(top - 1, layer, -1):
            ids, _ = beam(self.x, self.graphs[k], q, at, 8)
            at = np.where(ids[:, : at.shape[1]] >= 0, ids[:, : at.shape[1]], ids[:, :1])
        return at

    def search(self, q: np.ndarray, ef: int, step: int | None = None, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        ids, sims = [], []
        for k in range(0, len(q), block):
            part = q[k : k + block]
            i, s = beam(self.x, self.graphs[0], part, self.entries(part, 0, 4), ef, step or max(8, ef // 8))
            ids.append(i)
            sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)
