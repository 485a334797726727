"""A robust-pruned directed graph over one shard of unit vectors, and beam search on it.

Numpy on one bounded shard inside a task; Spark cuts the shards and routes the queries
(neighbours.py). Searches run many queries in step: each expands its best few unexpanded
candidates at a time, so that a step is one gather and one batched product.
"""

from __future__ import annotations

import numpy as np

NONE = np.float32(-9)  # below any cosine: no such candidate
BLOCK = 256  # queries in step: few enough for their state to stay in the cache
SEEDS = 12  # entries from which a query begins
ENTRIES = 16  # one node in so many is an entry


def prune(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's candidates (ids, -1 for none, with their cosines to the row's node) the edges to keep.

    The nearest is kept and every candidate dropped that is ``alpha`` times nearer to it than to
    the node; so on with the next, up to ``degree``. Distances are squared, hence alpha squared.
    """
    rows = np.arange(len(cand))
    near = x[np.maximum(cand, 0)]
    between = np.matmul(near, near.transpose(0, 2, 1))
    score = np.where(cand >= 0, sims, NONE).astype(np.float32)
    ids, kept = np.full((len(cand), degree), -1, np.int32), np.full((len(cand), degree), NONE, np.float32)
    far = 1 - sims
    for r in range(degree):
        j = score.argmax(1)
        s = score[rows, j]
        some = s > NONE
        if not some.any():
            break
        ids[some, r], kept[some, r] = cand[rows, j][some], s[some]
        score[alpha * alpha * (1 - between[rows, j]) <= far] = NONE
        score[rows, j] = NONE
    return ids, kept


def search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, width: int = 3, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the ``beam`` best nodes met and their cosines, in no order. A query begins at the ``SEEDS``
    entries nearest to it and, where ``own`` names one (else -1), at that node. Each step expands its ``width``
    best nodes that weren't yet; it ends when none of its best is left to expand."""
    n, b = len(x), len(queries)
    ids, sims = np.full((b, beam), -1, np.int32), np.full((b, beam), NONE, np.float32)
    done = np.ones((b, beam), bool)
    met = np.zeros((b, n + 1), np.uint16)
    met[:, n] = 1
    every = np.arange(b)[:, None]
    first = queries @ x[entries].T
    k = min(beam - (own is not None), len(entries), SEEDS)
    at = np.argpartition(-first, k - 1, axis=1)[:, :k]
    ids[:, :k], sims[:, :k], done[:, :k] = entries[at], first[every, at], False
    met[every, entries[at]] = 1
    if own is not None:
        rows = np.flatnonzero(own >= 0)
        rows = rows[met[rows, own[rows]] == 0]
        mine = own[rows]
        met[rows, mine] = 1
        ids[rows, -1], sims[rows, -1], done[rows, -1] = mine, np.einsum("bd,bd->b", queries[rows], x[mine]), False
    active = np.arange(b)
    width = min(width, beam)
    while len(active):
        open_ = np.where(done[active], NONE, sims[active])
        pick = np.argpartition(-open_, width - 1, axis=1)[:, :width] if width > 1 else open_.argmax(1)[:, None]
        live = np.take_along_axis(open_, pick, 1) > NONE
        go = live.any(1)
        active, pick, live = active[go], pick[go], live[go]
        if not len(active):
            break
        rows = active[:, None]
        done[rows, pick] = True
        nodes = edges[np.where(live, ids[rows, pick], 0)]
        nodes = np.where(live[:, :, None] & (nodes >= 0), nodes, n).reshape(len(active), -1)
        r, c = np.nonzero(met[rows, nodes] == 0)
        if not len(r):
            continue
        # a node that two expanded ones point to counts once: the place written last stands
        new, mark = nodes[r, c], (c + 1).astype(np.uint16)
        met[active[r], new] = mark
        last = met[active[r], new] == mark
        r, new = r[last], new[last]
        count = np.bincount(r, minlength=len(active))
        slot = beam + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        size = (len(active), beam + count.max())
        all_ids, all_sims, all_done = np.full(size, -1, np.int32), np.full(size, NONE, np.float32), np.ones(size, bool)
        all_ids[:, :beam], all_sims[:, :beam], all_done[:, :beam] = ids[active], sims[active], done[active]
        all_ids[r, slot], all_sims[r, slot], all_done[r, slot] = new, np.einsum("nd,nd->n", x[new], queries[active[r]]), False
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_sims, all_done))
    return ids, sims


class Graph:
    """``x``: unit vectors, a row each. Nodes are inserted in batches of at most the size there is."""

    def __init__(self, x: np.ndarray, degree: int = 24, beam: int = 28, alpha: float = 1.2, batch: int = 1024, core: int = 256, seed: int = 0):
        n = len(x)
        self.order = np.random.default_rng(seed).permutation(n)
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.x = x = np.ascontiguousarray(x[self.order])
        self.entries = np.arange(min(n, max(16, n // ENTRIES)))
        edges, sims = np.full((n, degree), -1, np.int32), np.full((n, degree), NONE, np.float32)
        c = min(core, n)
        if c > 1:  # the core is searched whole
            s = x[:c] @ x[:c].T
            np.fill_diagonal(s, NONE)
            k = min(beam, c - 1)
            near = np.argpartition(-s, k - 1, axis=1)[:, :k].astype(np.int32)
            edges[:c], sims[:c] = prune(x, near, np.take_along_axis(s, near, 1), degree, alpha)
        at = c
        while at < n:
            new = np.arange(at, min(n, at + min(batch, at)))
            found = [search(x[:at], edges[:at], x[new[a : a + BLOCK]], self.entries[:at], beam) for a in range(0, len(new), BLOCK)]
            cand, cos = (np.concatenate(v) for v in zip(*found))
            edges[new], sims[new] = prune(x, cand, cos, degree, alpha)
            self._link_back(edges, sims, new, degree, alpha)
            at += len(new)
        self.edges = self._reachable(edges)

    def _link_back(self, edges: np.ndarray, sims: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
        """The new nodes as candidates of the nodes they point to: appended where they fit, else pruned together."""
        r, c = np.nonzero(edges[new] >= 0)
        to, frm, cos = edges[new][r, c], new[r], sims[new][r, c]
        o = np.lexsort((-cos, to))
        to, frm, cos = to[o], frm[o], cos[o]
        nodes, start, count = np.unique(to, return_index=True, return_counts=True)
        row = np.repeat(np.arange(len(nodes)), count)
        rank = np.arange(len(to)) - start[row]
        held = (edges[nodes] >= 0).sum(1)
        fits = held + count <= degree
        m = fits[row]
        edges[to[m], (held[row] + rank)[m]], sims[to[m], (held[row] + rank)[m]] = frm[m], cos[m]
        full = np.flatnonzero(~fits)
        if len(full):
            m = ~fits[row] & (rank < degree)  # the nearest; no node keeps more
            back = np.full(len(nodes), -1)
            back[full] = np.arange(len(full))
            ids, s = np.full((len(full), degree), -1, np.int32), np.full((len(full), degree), NONE, np.float32)
            ids[back[row[m]], rank[m]], s[back[row[m]], rank[m]] = frm[m], cos[m]
            u = nodes[full]
            edges[u], sims[u] = prune(self.x, np.concatenate([edges[u], ids], 1), np.concatenate([sims[u], s], 1), degree, alpha)

    def _reachable(self, edges: np.ndarray, room: int = 4) -> np.ndarray:
        """Further edges so that every node can be reached from the entries: each lost node hangs on
        its nearest reachable neighbour with room left, or on an entry."""
        n = len(edges)
        extra, used = np.full((n, room), -1, np.int32), np.zeros(n, np.int64)
        seen = np.zeros(n, bool)
        seen[self.entries] = True
        front = self.entries
        while True:
            while len(front):
                front = np.unique(np.concatenate([edges[front], extra[front]], 1))
                front = front[front >= 0]
                front = front[~seen[front]]
                seen[front] = True
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return np.concatenate([edges, extra], 1) if used.any() else edges
            near = np.maximum(edges[lost], 0)
            able = (edges[lost] >= 0) & seen[near] & (used[near] < extra.shape[1])
            cos = np.where(able, np.einsum("ld,lrd->lr", self.x[lost], self.x[near]), NONE)
            some = able.any(1)
            if some.any():
                j = cos.argmax(1)
                lost, hold = lost[some], near[np.arange(len(near)), j][some]
            else:
                lost, hold = lost[:1], self.entries[np.argmin(used[self.entries])][None]
                if used[hold[0]] >= extra.shape[1]:
                    extra = np.concatenate([extra, np.full((n, room), -1, np.int32)], 1)
            o = np.argsort(hold, kind="stable")
            hold, lost = hold[o], lost[o]
            _, start, count = np.unique(hold, return_index=True, return_counts=True)
            slot = used[hold] + np.arange(len(hold)) - np.repeat(start, count)
            fit = slot < extra.shape[1]
            extra[hold[fit], slot[fit]] = lost[fit]
            np.add.at(used, hold[fit], 1)
            front = lost[fit]
            seen[front] = True

    def nearest(self, queries: np.ndarray, k: int, beam: int, own: np.ndarray | None = None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest nodes of each query (numbers as given to the graph, -1 for none) and their cosines,
        best first; ``own`` is each query's own node, or -1, and left out."""
        beam = max(beam, k) + (own is not None)
        ids, sims = [], []
        for a in range(0, len(queries), block):
            mine = None
            if own is not None:
                mine = np.where(own[a : a + block] >= 0, self.place[np.maximum(own[a : a + block], 0)], -1)
            i, s = search(self.x, self.edges, queries[a : a + block], self.entries, beam, own=mine)
            if mine is not None:
                s[i == mine[:, None]] = NONE
            o = np.argsort(-s, axis=1, kind="stable")[:, :k]
            i, s = np.take_along_axis(i, o, 1), np.take_along_axis(s, o, 1)
            ids.append(np.where((i >= 0) & (s > NONE), self.order[np.maximum(i, 0)], -1))
            sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)
