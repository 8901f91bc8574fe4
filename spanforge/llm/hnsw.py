"""A hierarchical navigable small-world graph over one shard's vectors, searched in blocks of queries.

Nearness is the inner product less an optional bias for each node (half the squared norm makes it
Euclidean). All queries of a block take their steps together, so that numpy does the work of a step.
"""

import numpy as np

M = 16
EF_BUILD = 64
EXPAND = 4
BLOCK_CELLS = 1 << 23


class Graph:
    """levels[k]: neighbours of each node on level k, -1 for none; the nodes above level 0 are the first of ``order``."""

    def __init__(self, vectors: np.ndarray, bias: np.ndarray | None = None, m: int = M, ef_build: int = EF_BUILD, seed: int = 7):
        n = len(vectors)
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.bias = np.zeros(n, np.float32) if bias is None else bias.astype(np.float32)
        self.m, self.ef_build = m, ef_build
        draw = np.random.default_rng(seed).random(n)
        height = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(int) if n else np.zeros(0, int)
        self.order = np.argsort(-height, kind="stable").astype(np.int32)
        self.height = height
        self.levels = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(int(height.max(initial=0)) + 1)]
        done = 0
        while done < n:
            batch = self.order[done : done + max(1, min(done, 1024))]
            self._insert(batch, self.order[:done])
            done += len(batch)

    @classmethod
    def load(cls, vectors, bias, height, levels) -> "Graph":
        g = cls.__new__(cls)
        g.x, g.bias, g.height, g.levels, g.m, g.ef_build = np.ascontiguousarray(vectors, np.float32), bias, height, levels, M, EF_BUILD
        g.order = np.argsort(-height, kind="stable").astype(np.int32)
        return g

    def _near(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Nearness of each query [Q, d] to its own row of ids [Q, m]; -inf where an id is -1."""
        s = np.einsum("qmd,qd->qm", self.x[ids], q, optimize=False) - self.bias[ids]
        s[ids < 0] = -np.inf
        return s

    def _pick(self, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the row's node than to any picked before; then the nearest of the rest."""
        rows, c = ids.shape
        at = np.argsort(-near, axis=1, kind="stable")
        ids, near = np.take_along_axis(ids, at, 1), np.take_along_axis(near, at, 1)
        same = np.zeros_like(ids, bool)
        taken, count = np.full((rows, most), -1, np.int32), np.zeros(rows, int)
        for k in range(c):
            one = ids[:, k]
            between = self._near(self.x[one], taken)
            dup = ((taken == one[:, None]) & (one >= 0)[:, None]).any(axis=1)
            ok = (one >= 0) & (count < most) & ~dup & (between.max(axis=1, initial=-np.inf) < near[:, k])
            r = np.flatnonzero(ok)
            taken[r, count[r]] = one[r]
            count[r] += 1
            same[:, k] = ok | dup
        for k in range(c):
            one = ids[:, k]
            fill = (one >= 0) & (count < most) & ~same[:, k]
            if fill.any():
                fill &= ~(taken == one[:, None]).any(axis=1)
                r = np.flatnonzero(fill)
                taken[r, count[r]] = one[r]
                count[r] += 1
        return taken

    def _insert(self, batch: np.ndarray, there: np.ndarray) -> None:
        q = self.x[batch]
        among = q @ q.T - self.bias[batch][None, :]
        np.fill_diagonal(among, -np.inf)
        entry = np.full((len(batch), 1), self.order[0], np.int32)
        for level in range(len(self.levels) - 1, -1, -1):
            ef = self.ef_build
            if len(there):
                found, near = self._beam(q, entry, ef if level <= int(self.height[batch].max()) else 1, level)
                entry = found[:, :8]
            else:
                found, near = np.full((len(batch), 1), -1, np.int32), np.full((len(batch), 1), -np.inf, np.float32)
            here = np.flatnonzero(self.height[batch] >= level)
            if not len(here):
                continue
            mates = among[np.ix_(here, here)]
            top = min(len(here), self.m)
            cols = np.argpartition(-mates, top - 1, axis=1)[:, :top]
            mate_near = np.take_along_axis(mates, cols, 1)
            mate_ids = np.where(np.isfinite(mate_near), batch[here][cols], -1).astype(np.int32)
            ids, sims = np.concatenate([found[here], mate_ids], 1), np.concatenate([near[here], mate_near], 1)
            picked = self._pick(ids, sims, self.m)
            links = self.levels[level]
            links[batch[here], : self.m] = picked
            self._reverse(batch[here], picked, links)

    def _reverse(self, nodes: np.ndarray, picked: np.ndarray, links: np.ndarray) -> None:
        src, dst = np.repeat(nodes, picked.shape[1]), picked.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        at = np.argsort(dst, kind="stable")
        src, dst = src[at], dst[at]
        to, first, n = np.unique(dst, return_index=True, return_counts=True)
        width = links.shape[1]
        new = np.full((len(to), int(n.max())), -1, np.int32)
        new[np.repeat(np.arange(len(to)), n), np.arange(len(dst)) - np.repeat(first, n)] = src
        both = np.concatenate([links[to], new], 1)
        fits = (both >= 0).sum(1) <= width
        if fits.any():
            rows = both[fits]
            keep = np.argsort(rows < 0, axis=1, kind="stable")[:, :width]
            links[to[fits]] = np.take_along_axis(rows, keep, 1)
        over = np.flatnonzero(~fits)
        for k in range(0, len(over), 1024):
            o = over[k : k + 1024]
            links[to[o]] = self._pick(both[o], self._near(self.x[to[o]], both[o]), width)

    def _beam(self, q: np.ndarray, entry: np.ndarray, ef: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and nearness [Q, ef], nearest first, -1 where fewer were found."""
        rows, links = len(q), self.levels[level]
        seen = np.zeros((rows, len(self.x) + 1), bool)
        r = np.arange(rows)[:, None]
        ids, near = np.full((rows, ef), -1, np.int32), np.full((rows, ef), -np.inf, np.float32)
        first = entry[:, : min(ef, entry.shape[1])]
        ids[:, : first.shape[1]], near[:, : first.shape[1]] = first, self._near(q, first)
        seen[r, first] = True
        open_ = ids >= 0
        while True:
            score = np.where(open_, near, -np.inf)
            width = min(EXPAND, ef)
            best = np.argpartition(-score, width - 1, axis=1)[:, :width]
            good = np.take_along_axis(score, best, 1) > -np.inf
            act = np.flatnonzero(good.any(1))
            if not len(act):
                break
            best, good = best[act], good[act]
            open_[act[:, None], best] = False
            nb = np.where(good[:, :, None], links[ids[act[:, None], best]], -1).reshape(len(act), -1)
            nb.sort(axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            nb[seen[act[:, None], nb]] = -1
            seen[act[:, None], nb] = True
            seen[:, -1] = False
            s = self._near(q[act], nb)
            all_ids, all_near = np.concatenate([ids[act], nb], 1), np.concatenate([near[act], s], 1)
            all_open = np.concatenate([open_[act], nb >= 0], 1)
            top = np.argpartition(-all_near, ef - 1, axis=1)[:, :ef]
            ids[act], near[act], open_[act] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_near, top, 1), np.take_along_axis(all_open, top, 1)
        at = np.argsort(-near, axis=1, kind="stable")
        ids, near = np.take_along_axis(ids, at, 1), np.take_along_axis(near, at, 1)
        ids[~np.isfinite(near)] = -1
        return ids, near

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nearest found for each query, nearest first."""
        q, n = np.ascontiguousarray(q, np.float32), len(self.x)
        if not n or not len(q):
            return np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), -np.inf, np.float32)
        out = []
        step = max(1, BLOCK_CELLS // (n + 1))
        for k in range(0, len(q), step):
            part = q[k : k + step]
            entry = np.full((len(part), 1), self.order[0], np.int32)
            for level in range(len(self.levels) - 1, 0, -1):
                entry = self._beam(part, entry, 4, level)[0]
                entry[entry < 0] = self.order[0]
            # entries may repeat after the fill; a repeated one is held once
            entry.sort(axis=1)
            entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
            entry = -np.sort(-entry, axis=1)
            out.append(self._beam(part, entry, ef, 0))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
