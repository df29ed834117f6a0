"""A hierarchical navigable small-world graph over unit vectors, in numpy.

Many searches advance together: in every step each of them expands the best
entry of its beam that isn't expanded yet. Vectors are added in batches; a
batch's neighbours are looked for in the graph so far and within the batch,
and kept by the diversity rule: a candidate stays unless it is nearer to one
that has been kept than to the new vector.
"""

from __future__ import annotations

import numpy as np

DEGREE, BUILD_BEAM, BATCH = 12, 48, 512


class SmallWorld:
    """links[0] holds 2 * degree neighbours of every vector, higher levels degree of few; -1: none."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 11):
        self.x, self.degree, self.beam = np.ascontiguousarray(x, np.float32), degree, beam
        n, rng = len(x), np.random.default_rng(seed)
        self.level = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(degree)).astype(int), 6)
        order = rng.permutation(n)
        top = int(self.level.max(initial=0))
        self.links = [np.full((n, degree * (2 if k == 0 else 1)), -1, np.int32) for k in range(top + 1)]
        self.entry, self.entry_level, done = -1, -1, 0
        while done < n:
            batch = order[done : done + min(BATCH, max(64, done))]
            self._add(batch)
            done += len(batch)
        self._connect()

    def _connect(self) -> None:
        """Sees to it that every vector can be reached from the entry at the lowest level."""
        n = len(self.x)
        seen, front = np.zeros(n, bool), np.array([self.entry] if n else [], np.int64)
        while n:
            while len(front):
                seen[front] = True
                front = np.unique(self.links[0][front])
                front = front[front >= 0]
                front = front[~seen[front]]
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return
            # the most similar one that can be reached links to the first lost one
            known = np.flatnonzero(seen)
            to = int(known[np.argmax(self.x[known] @ self.x[lost[0]])])
            free = np.flatnonzero(self.links[0][to] < 0)
            if not len(free):
                free = [self.links[0].shape[1]]
                self.links[0] = np.hstack([self.links[0], np.full((n, 1), -1, np.int32)])
            self.links[0][to, free[0]] = lost[0]
            front = lost[:1]

    def _add(self, batch: np.ndarray) -> None:
        have = self.entry >= 0
        q = self.x[batch]
        near = q @ q.T
        np.fill_diagonal(near, -np.inf)
        at = np.full(len(batch), self.entry)
        for level in range(max(int(self.level[batch].max()), self.entry_level), -1, -1):
            own = np.flatnonzero(self.level[batch] >= level)
            found, score = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), np.float32)
            if have and level <= self.entry_level:
                ids, sims = self._search(q, at, level, self.beam if len(own) else 1)
                found, score = ids[own], sims[own]
                at = np.where(ids[:, 0] >= 0, ids[:, 0], at)
            if len(own) and level < len(self.links):
                inner = near[np.ix_(own, own)]
                k = min(self.beam // 2, len(own))
                mates = np.argpartition(-inner, k - 1, axis=1)[:, :k]
                some = np.take_along_axis(inner, mates, 1)
                found = np.hstack([found, np.where(np.isfinite(some), batch[own][mates], -1)])
                score = np.hstack([score, some])
                width = self.links[level].shape[1]
                kept = self._diverse(q[own], found, score, width)
                self.links[level][batch[own]] = kept
                self._answer(batch[own], kept, level)
        best = batch[np.argmax(self.level[batch])]
        if self.level[best] > self.entry_level:
            self.entry, self.entry_level = int(best), int(self.level[best])

    def _diverse(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray, width: int) -> np.ndarray:
        """The kept candidates of each row, most similar first; discarded ones fill what is left."""
        score = np.where(ids >= 0, score, -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")
        ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
        kept = np.zeros(ids.shape, bool)
        count = np.zeros(len(ids), int)
        v = self.x[np.maximum(ids, 0)]
        among = v @ v.transpose(0, 2, 1)
        for c in range(ids.shape[1]):
            nearer = (kept & (among[:, c, :] > score[:, c, None])).any(1)
            kept[:, c] = np.isfinite(score[:, c]) & ~nearer & (count < width)
            count += kept[:, c]
        rank = np.where(kept, 0, np.where(np.isfinite(score), 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(np.where(np.isfinite(score), ids, -1), order, 1)
        if out.shape[1] < width:
            out = np.hstack([out, np.full((len(out), width - out.shape[1]), -1)])
        return out.astype(np.int32)

    def _answer(self, new: np.ndarray, kept: np.ndarray, level: int) -> None:
        """Links back to the new vectors; full neighbour lists are chosen anew."""
        links, width = self.links[level], kept.shape[1]
        source, target = np.repeat(new, width), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        most = int(min(count.max(initial=0), 2 * width))
        extra = np.full((len(nodes), most), -1)
        place = np.arange(len(target)) - np.repeat(start, count)
        ok = place < most
        extra[np.repeat(np.arange(len(nodes)), count)[ok], place[ok]] = source[ok]
        for i in range(0, len(nodes), 2048):
            own = nodes[i : i + 2048]
            some = extra[i : i + 2048]
            some = np.where((some[:, :, None] == links[own][:, None, :]).any(2), -1, some)
            ids = np.hstack([links[own], some])
            score = np.einsum("ij,ikj->ik", self.x[own], self.x[np.maximum(ids, 0)])
            links[own] = self._diverse(self.x[own], ids, score, width)

    def _search(self, q: np.ndarray, at: np.ndarray, level: int, beam: int, also: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and similarities of each query's beam, best first, from the given entries and, if not -1, one more."""
        n, links = len(self.x), self.links[level]
        rows = np.arange(len(q))
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -np.inf, np.float32)
        ids[:, 0], sims[:, 0] = at, np.einsum("ij,ij->i", q, self.x[at])
        opened = np.zeros((len(q), beam), bool)
        seen = np.zeros((len(q), n), bool)
        seen[rows, at] = True
        if also >= 0 and beam > 1:
            more = np.flatnonzero(at != also)
            ids[more, 1], sims[more, 1], seen[more, also] = also, q[more] @ self.x[also], True
        active = rows
        while len(active):
            waiting = np.where(opened[active] | (ids[active] < 0), -np.inf, sims[active])
            best = waiting.argmax(1)
            go = np.isfinite(waiting[np.arange(len(active)), best])
            active, best = active[go], best[go]
            if not len(active):
                break
            opened[active, best] = True
            next_ids = links[ids[active, best]].astype(np.int64)
            fresh = (next_ids >= 0) & ~seen[active[:, None], np.maximum(next_ids, 0)]
            r, c = np.nonzero(fresh)
            seen[active[r], next_ids[r, c]] = True
            s = np.full(next_ids.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", q[active[r]], self.x[next_ids[r, c]])
            all_s = np.hstack([sims[active], s])
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[active] = np.take_along_axis(all_s, top, 1)
            ids[active] = np.where(np.isfinite(sims[active]), np.take_along_axis(np.hstack([ids[active], next_ids]), top, 1), -1)
            opened[active] = np.take_along_axis(np.hstack([opened[active], np.zeros(next_ids.shape, bool)]), top, 1)
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and similarities of the beam at the lowest level."""
        q = np.ascontiguousarray(q, np.float32)
        at = np.full(len(q), self.entry)
        for level in range(self.entry_level, 0, -1):
            at = self._search(q, at, level, 1)[0][:, 0]
        return self._search(q, at, 0, beam, self.entry)

    def dear(self, beam: int) -> bool:
        """Whether a beam costs more than all vectors: it takes as many steps as it is wide, and each sorts all of it."""
        return beam * beam > 2 * len(self.x)

    def compared(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """What near() says, from a comparison of the queries with all vectors."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i in range(0, len(q), 1024):
            r, c = np.nonzero(np.asarray(q[i : i + 1024], np.float32) @ self.x.T >= least)
            out.append((r + i, c))
        return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])

    def near(self, q: np.ndarray, least: float, beam: int = 32, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Query rows and ids of what is found at least that similar.

        Every query goes through the graph. One whose beam is full of such ids
        is searched again with a beam twice as wide; one that fills a beam as
        dear as a look at the whole graph is compared with all of it.
        """
        out, n = [], len(self.x)
        todo = np.arange(len(q)) if n else np.zeros(0, np.int64)
        while len(todo):
            again, beam = [], min(beam, n)
            step = max(1, min(block, (1 << 21) // beam))
            for i in range(0, len(todo), step):
                rows = todo[i : i + step]
                ids, sims = self.search(q[rows], beam)
                good = (sims >= least) & (ids >= 0)
                full = good.all(1) & (beam < n)
                again.append(rows[full])
                r, c = np.nonzero(good & ~full[:, None])
                out.append((rows[r], ids[r, c]))
            todo = np.concatenate(again)
            if self.dear(2 * beam):
                r, c = self.compared(q[todo], least)
                out.append((todo[r], c))
                break
            beam *= 2
        return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(2))
