"""A hierarchical navigable small-world graph over one shard of unit vectors, in numpy.

Nodes are inserted, and queries searched, many at a time in lockstep: each step of a beam
search expands the best open node of every query at once.
"""

from __future__ import annotations

import numpy as np

FAR = np.float32(-2.0)


def _reach(found: np.ndarray, sims: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The `size` best columns of each row, best first."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, :size]
    return np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)


class Graph:
    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 48, batch: int = 256, seed: int = 2):
        """vectors: unit float32 rows. links: neighbours a node keeps above the ground layer;
        twice as many on it. beam: width of the search for an inserted node's neighbours."""
        self.vectors, self.links, self.beam, self.batch = vectors, links, beam, batch
        n = len(vectors)
        height = -np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(links)
        self.level = np.minimum(height.astype(int), 12)
        self.order = np.argsort(-self.level, kind="stable")  # high nodes first: each batch finds the layers above it built
        self.layers = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        done = 0
        while done < n:
            size = min(batch, max(8, done // 2), n - done)
            self._insert(self.order[done : done + size], done)
            done += size

    def placed(self) -> list[bytes]:
        """Each node's place among the inserted and its links, from the ground layer up: what
        restored() needs beside the vectors."""
        place = np.empty(len(self.order), np.int32)
        place[self.order] = np.arange(len(self.order))
        return [np.concatenate([place[n : n + 1], *(layer[n] for layer in self.layers[: self.level[n] + 1])]).tobytes() for n in range(len(place))]

    @classmethod
    def restored(cls, vectors: np.ndarray, placed: list[bytes], links: int = 12) -> Graph:
        """The graph of which placed() gave these; vectors in the same order as they."""
        graph = cls.__new__(cls)
        graph.vectors, graph.links = vectors, links
        rows = [np.frombuffer(p, np.int32) for p in placed]
        graph.level = np.array([(len(r) - 1) // links - 2 for r in rows], int)
        graph.order = np.argsort([r[0] for r in rows], kind="stable") if rows else np.empty(0, int)
        graph.layers = []
        for k in range(int(graph.level.max(initial=0)) + 1):
            wide, begin = (2 * links, 1) if k == 0 else (links, 1 + links * (k + 1))
            layer = np.full((len(rows), wide), -1, np.int32)
            here = np.flatnonzero(graph.level >= k)
            if len(here):
                layer[here] = np.stack([rows[n][begin : begin + wide] for n in here])
            graph.layers.append(layer)
        return graph

    def _search(self, queries: np.ndarray, found: np.ndarray, sims: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search from the given entries; -1 where a beam isn't full."""
        links = self.layers[layer]
        rows = np.arange(len(queries))
        found, sims = _reach(found, sims, width)
        pad = width - found.shape[1]
        if pad > 0:
            found = np.pad(found, ((0, 0), (0, pad)), constant_values=-1)
            sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=FAR)
        opened = found < 0
        seen = np.zeros((len(queries), len(self.vectors) + 1), bool)  # the last column is for -1
        seen[rows[:, None], found] = True
        active = rows
        while len(active):
            open_sims = np.where(opened[active], FAR, sims[active])
            best = open_sims.argmax(1)
            alive = open_sims[np.arange(len(active)), best] > FAR
            active, best = active[alive], best[alive]
            if not len(active):
                break
            opened[active, best] = True
            near = links[found[active, best]]
            new = ~seen[active[:, None], near] & (near >= 0)
            seen[active[:, None], near] = True
            near = np.where(new, near, -1)
            reached = np.einsum("qd,qkd->qk", queries[active], self.vectors[near], optimize=False)
            reached = np.where(new, reached, FAR)
            worst = sims[active].min(1)
            hit = (reached > worst[:, None]).any(1)
            rows_hit = active[hit]
            if len(rows_hit):
                all_found = np.concatenate([found[rows_hit], near[hit]], 1)
                all_sims = np.concatenate([sims[rows_hit], reached[hit]], 1)
                all_open = np.concatenate([opened[rows_hit], ~new[hit]], 1)
                order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
                found[rows_hit] = np.take_along_axis(all_found, order, 1)
                sims[rows_hit] = np.take_along_axis(all_sims, order, 1)
                opened[rows_hit] = np.take_along_axis(all_open, order, 1)
        return found, sims

    def _descend(self, queries: np.ndarray, down_to: int) -> tuple[np.ndarray, np.ndarray]:
        """From the top node by a narrow beam to the entries of layer `down_to`."""
        top = self.order[0]
        found = np.full((len(queries), 1), top, np.int32)
        sims = (queries @ self.vectors[top])[:, None].astype(np.float32)
        for layer in range(len(self.layers) - 1, down_to, -1):
            found, sims = self._search(queries, found, sims, layer, 3)
        return found, sims

    def _choose(self, found: np.ndarray, sims: np.ndarray, size: int) -> np.ndarray:
        """Of each row's candidates (best first), those nearer to the row's node than to any
        chosen before, then the best of the others, up to `size`."""
        rows, wide = found.shape
        chosen = np.zeros((rows, wide), bool)
        vectors = self.vectors[found]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        closest = np.full((rows, wide), FAR)
        count = np.zeros(rows, int)
        for k in range(wide):
            take = (found[:, k] >= 0) & (sims[:, k] > closest[:, k]) & (count < size)
            chosen[:, k] = take
            count += take
            closest = np.where(take[:, None], np.maximum(closest, between[:, k]), closest)
        rank = np.where(found < 0, 3 * wide, np.where(chosen, 0, wide)) + np.arange(wide)
        order = np.argsort(rank, axis=1, kind="stable")[:, :size]
        out = np.take_along_axis(found, order, 1)
        return np.pad(out, ((0, 0), (0, max(0, size - wide))), constant_values=-1)

    def _insert(self, nodes: np.ndarray, before: int) -> None:
        queries = self.vectors[nodes]
        # what of the batch itself is near: the graph doesn't hold it yet
        own = queries @ queries.T
        np.fill_diagonal(own, FAR)
        made = []
        for layer in range(int(self.level[nodes].max()), -1, -1):
            here = np.flatnonzero(self.level[nodes] >= layer)
            if before:
                found, sims = self._descend(queries[here], layer)
                found, sims = self._search(queries[here], found, sims, layer, self.beam)
            else:
                found, sims = np.full((len(here), 1), -1, np.int32), np.full((len(here), 1), FAR)
            mates, mate_sims = _reach(np.broadcast_to(nodes[here].astype(np.int32), (len(here), len(here))), own[np.ix_(here, here)], self.beam)
            mates = np.where(mate_sims > FAR, mates, -1)
            found, sims = _reach(np.concatenate([found, mates], 1), np.concatenate([sims, mate_sims], 1), self.beam)
            made.append((layer, nodes[here], self._choose(found, sims, self.links)))
        # linked only now: every layer was searched as it was before the batch
        for layer, own_nodes, chosen in made:
            self.layers[layer][own_nodes, : self.links] = chosen
            self._link_back(layer, own_nodes, chosen)

    def _link_back(self, layer: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        links = self.layers[layer]
        size = links.shape[1]
        source = np.repeat(nodes, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        sims = np.einsum("ed,ed->e", self.vectors[source], self.vectors[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        touched, first, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, counts)
        more = np.full((len(touched), min(size, int(counts.max(initial=1)))), -1, np.int32)
        keep = place < more.shape[1]
        more[np.repeat(np.arange(len(touched)), counts)[keep], place[keep]] = source[keep]
        for start in range(0, len(touched), 512):
            part = touched[start : start + 512]
            old = links[part]
            new = more[start : start + 512]
            new = np.where((new[:, :, None] == old[:, None, :]).any(2), -1, new)
            both = np.concatenate([old, new], 1)
            near = np.where(both >= 0, np.einsum("nd,nkd->nk", self.vectors[part], self.vectors[both], optimize=False), FAR)
            both, near = _reach(both, near, both.shape[1])
            full = both[:, size] >= 0 if both.shape[1] > size else np.zeros(len(part), bool)
            links[part] = both[:, :size]
            if full.any():
                links[part[full]] = self._choose(both[full], near[full], size)

    def search(self, queries: np.ndarray, width: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines), best first, of each query's beam of `width`; -1 fills short beams."""
        if not len(self.vectors) or not len(queries):
            return np.full((len(queries), 1), -1, np.int32), np.full((len(queries), 1), FAR)
        block = max(8, min(block, (1 << 25) // len(self.vectors)))
        out = []
        for start in range(0, len(queries), block):
            part = queries[start : start + block]
            out.append(self._search(part, *self._descend(part, 0), 0, width))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
