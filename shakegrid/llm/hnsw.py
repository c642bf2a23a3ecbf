"""A hierarchical navigable small-world graph over unit vectors, in numpy; many queries walk it in lockstep."""

from __future__ import annotations

import numpy as np

M, BUILD_BEAM, FIRST, BATCH, TOGETHER = 16, 64, 64, 512, 4


def draw_levels(n: int, seed: int) -> np.ndarray:
    """Highest level of each point; one in M reaches the next."""
    return np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(M)).astype(np.int64)


class Graph:
    """``links[l]``: up to M (2 M on level 0) neighbours of each point on level l, -1 where there are fewer."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        level = draw_levels(n, seed)
        self.links = [np.full((n, 2 * M if k == 0 else M), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        order = np.argsort(-level, kind="stable")  # upper points first, so that each level has an entry from the start
        self.entry, done = int(order[0]) if n else -1, 0
        self.reach = level
        while done < n:
            new = order[done : done + (FIRST if not done else min(BATCH, done))]
            self._insert(new, first=not done)
            done += len(new)

    # ---- walking

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """Nearest points that greedy walks find on the levels above ``to``."""
        at = np.full(len(q), self.entry)
        best = q @ self.x[self.entry]
        for k in range(len(self.links) - 1, to, -1):
            moving = np.arange(len(q))
            while len(moving):
                near = self.links[k][at[moving]]
                sims = np.einsum("nk,nmk->nm", q[moving], self.x[near])
                sims[near < 0] = -2
                pick = sims.argmax(axis=1)
                got = sims[np.arange(len(moving)), pick]
                up = got > best[moving]
                moving, pick, got, near = moving[up], pick[up], got[up], near[up]
                at[moving], best[moving] = near[np.arange(len(moving)), pick], got
        return at

    def beam(self, q: np.ndarray, width: int, level: int = 0, enter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(points, similarities) of the beam of each query, best first; -1 and -2 where it is not full."""
        n, rows = len(q), np.arange(len(q))
        enter = self.descend(q, level) if enter is None else enter
        ids, sims = np.full((n, width), -1, np.int64), np.full((n, width), -2, np.float32)
        ids[:, 0], sims[:, 0] = enter, np.einsum("nk,nk->n", q, self.x[enter])
        opened = np.zeros((n, width), bool)
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last column stands for "none"
        seen[:, -1] = True
        seen[rows, enter] = True
        links, few = self.links[level], min(TOGETHER, width)
        while len(rows):
            waiting = np.where(opened[rows] | (ids[rows] < 0), -3, sims[rows])
            pick = np.argpartition(-waiting, few - 1, axis=1)[:, :few] if few < width else np.tile(np.arange(width), (len(rows), 1))
            value = np.take_along_axis(waiting, pick, axis=1)
            live = value.max(axis=1) > -3
            rows, pick, value = rows[live], pick[live], value[live]
            if not len(rows):
                break
            fresh = []
            for e in range(few):
                ok = value[:, e] > -3
                opened[rows[ok], pick[ok, e]] = True
                near = np.where(ok[:, None], links[ids[rows, pick[:, e]]], -1)
                near = np.where(seen[rows[:, None], near], -1, near)
                seen[rows[:, None], near] = True
                fresh.append(near)
            near = np.concatenate(fresh, axis=1)
            keep = (near >= 0).any(axis=0)
            near = near[:, keep]
            if not near.shape[1]:
                continue
            s = np.einsum("nk,nmk->nm", q[rows], self.x[near]).astype(np.float32)
            s[near < 0] = -2
            all_ids, all_sims = np.concatenate([ids[rows], near], axis=1), np.concatenate([sims[rows], s], axis=1)
            all_opened = np.concatenate([opened[rows], np.zeros(near.shape, bool)], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[rows], sims[rows], opened[rows] = (np.take_along_axis(a, best, axis=1) for a in (all_ids, all_sims, all_opened))
            ids[rows] = np.where(sims[rows] > -2, ids[rows], -1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    # ---- building

    def _insert(self, new: np.ndarray, first: bool) -> None:
        q = self.x[new]
        for k in range(len(self.links)):
            own = np.flatnonzero(self.reach[new] >= k)
            if not len(own):
                continue
            among = q[own] @ q[own].T
            np.fill_diagonal(among, -2)
            take = min(len(own) - 1, BUILD_BEAM)
            ids, sims = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), np.float32)
            if take > 0:
                best = np.argpartition(-among, take - 1, axis=1)[:, :take]
                ids, sims = new[own][best], np.take_along_axis(among, best, axis=1)
            if not first:
                more, more_sims = self.beam(q[own], BUILD_BEAM, k)
                ids, sims = np.concatenate([ids, more], axis=1), np.concatenate([sims, more_sims], axis=1)
            if ids.shape[1]:
                self._connect(k, new[own], ids, sims)

    def _connect(self, k: int, points: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        chosen = self._diverse(ids, sims, M)
        self.links[k][points, : chosen.shape[1]] = chosen
        # each chosen neighbour gets the point as one of its own
        a, b = np.repeat(points, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        ends, start, count = np.unique(b, return_index=True, return_counts=True)
        for lo in range(0, len(ends), 2048):
            e, s, c = ends[lo : lo + 2048], start[lo : lo + 2048], np.minimum(count[lo : lo + 2048], BATCH)
            add = np.full((len(e), int(c.max())), -1, np.int64)
            cell = np.arange(add.shape[1]) < c[:, None]
            add[cell] = np.concatenate([a[i : i + j] for i, j in zip(s, c)])
            old = self.links[k][e]
            add[(add[:, :, None] == old[:, None, :]).any(axis=2)] = -1
            both = np.concatenate([old, add], axis=1)
            fits = (both >= 0).sum(axis=1) <= old.shape[1]
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, : old.shape[1]]
            self.links[k][e[fits]] = packed[fits]
            full = np.flatnonzero(~fits)
            if len(full):
                s_ = np.einsum("nk,nmk->nm", self.x[e[full]], self.x[both[full]])
                s_[both[full] < 0] = -2
                picked = self._diverse(both[full], s_, old.shape[1])
                self.links[k][e[full]] = -1
                self.links[k][e[full][:, None], np.arange(picked.shape[1])] = picked

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` candidates, nearest first: those nearer to the point than to one taken, then the others."""
        width = min(ids.shape[1], max(BUILD_BEAM, 2 * most))
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        out = np.full((len(ids), min(most, width)), -1, np.int64)
        for lo in range(0, len(ids), 256):
            i, s = ids[lo : lo + 256], sims[lo : lo + 256]
            v = self.x[i]
            near = np.einsum("nik,njk->nij", v, v)
            taken, n = np.zeros(i.shape, bool), np.zeros(len(i), int)
            closest = np.full(i.shape, -2, np.float32)
            for c in range(width):
                ok = (s[:, c] > -2) & (s[:, c] > closest[:, c]) & (n < out.shape[1])
                taken[:, c] = ok
                n += ok
                closest = np.where(ok[:, None], np.maximum(closest, near[:, :, c]), closest)
            rank = np.where(taken, 0, 1) + np.where(s > -2, 0, 2)
            best = np.argsort(rank, axis=1, kind="stable")[:, : out.shape[1]]
            got = np.take_along_axis(i, best, axis=1)
            out[lo : lo + 256] = np.where(np.take_along_axis(s, best, axis=1) > -2, got, -1)
        return out
