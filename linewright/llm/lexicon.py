"""A minimal acyclic transducer from words to lists of ids, kept in one file of arrays.

Words come in byte order, so that a state is complete once no later word can pass through it;
complete states with equal ends and edges become one, which shares all common suffixes. Ids
stand on the edges as early as the words that use an edge agree on them. The file is mapped
into memory, so that only what lookups touch is there. Many words are looked up in lockstep, a
byte of each at a time.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

import numpy as np

Ids = tuple[int, ...]
#: Numbers before the arrays. An edge's key is its state * 256 + its byte.
HEADER = 4


class _State:
    __slots__ = ("edges", "ends")

    def __init__(self):
        self.edges: dict[int, list] = {}  # byte -> [state, ids]
        self.ends: Ids | None = None  # ids that a word ending here still lacks


def build(words: Iterable[tuple[bytes, Ids]]) -> list[tuple]:
    """The states of a transducer for distinct non-empty words in byte order, the root last: (ends, ((byte, state, ids), ...))."""
    states: dict[tuple, int] = {}
    path, last = [_State()], b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            path[-1].edges[last[len(path) - 1]][0] = number(state)

    def number(state: _State) -> int:
        return states.setdefault((state.ends, tuple((b, to, ids) for b, (to, ids) in state.edges.items())), len(states))

    for word, ids in words:
        if word <= last:
            raise ValueError("words must be distinct, not empty, and in byte order")
        same = next((k for k, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        settle(same)
        for k in range(same):
            edge, state = path[k].edges[word[k]], path[k + 1]
            agreed = next((j for j, (a, b) in enumerate(zip(edge[1], ids, strict=False)) if a != b), min(len(edge[1]), len(ids)))
            later, edge[1], ids = edge[1][agreed:], edge[1][:agreed], ids[agreed:]
            if later:
                # what not all words of this edge share moves on to the next edges
                for further in state.edges.values():
                    further[1] = later + further[1]
                state.ends = later + state.ends if state.ends is not None else None
        for byte in word[same:]:
            path[-1].edges[byte] = [-1, ()]
            path.append(_State())
        path[same].edges[word[same]][1] = ids
        path[-1].ends = ()
        last = word
    settle(0)
    # the root is new unless there is no word at all
    root = number(path[0])
    rows = list(states)
    assert root == len(rows) - 1
    return rows


def compiled(words: Iterable[tuple[bytes, Ids]]) -> bytes:
    """The file of a transducer for words: sizes, edges' keys and ends, places of ids, ends, ids."""
    rows = build(words)
    keys = np.array([s << 8 | b for s, (_, edges) in enumerate(rows) for b, _, _ in edges], np.int64)
    goes = np.array([to for _, edges in rows for _, to, _ in edges], np.int64)
    # ids of edges, then those of ends; -1 marks a state that ends no word
    ids = [e[2] for _, edges in rows for e in edges] + [ends or () for ends, _ in rows]
    place = np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)])
    final = np.array([ends is not None for ends, _ in rows], np.int64)
    flat = np.array([x for i in ids for x in i], np.int64)
    parts = (np.array([len(keys), len(rows), len(flat), 0], np.int64), keys, goes, place, final, flat)
    return b"".join(part.astype("<i8").tobytes() for part in parts)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k], ..., starts[k] + sizes[k] - 1 of all k, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Lexicon:
    """A compiled file, mapped into memory from a nameless file of this process: it needs no
    folder that others see, and is gone with the process."""

    def __init__(self, raw: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(raw)
            file.flush()
            whole = np.memmap(file, "<i8", "r")
        edges, states, ids = whole[:3].tolist()
        at = HEADER
        parts = []
        for size in (edges, edges, edges + states + 1, states, ids):
            parts.append(whole[at : at + size])
            at += size
        self.keys, self.goes, self.place, self.final, self.ids = parts
        self.edges, self.root = edges, states - 1

    def find(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words raw[start : start + size]: which are there, how many ids each has (0 if not
        there), and the ids of all, one word after another."""
        n, longest = len(sizes), int(sizes.max(initial=0))
        order = np.argsort(-sizes, kind="stable")
        longer = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # words that have a byte t
        state, there = np.full(n, self.root, np.int64), np.ones(n, bool)
        used = np.zeros((longest + 1, n), np.int64)  # whose ids come at each step: edges, at the end states
        for t in range(longest):
            lanes = order[: longer[t]]
            lanes = lanes[there[lanes]]
            key = state[lanes] << 8 | raw[starts[lanes] + t]
            at = np.minimum(np.searchsorted(self.keys, key), max(self.edges - 1, 0))
            known = self.keys[at] == key if self.edges else np.zeros(len(lanes), bool)
            there[lanes[~known]] = False
            lanes, at = lanes[known], at[known]
            state[lanes] = self.goes[at]
            used[t, lanes] = at
        there &= (self.final[state] == 1) & (sizes > 0)
        used[sizes, np.arange(n)] = self.edges + state
        mine = used.T[there]
        mine = mine[np.arange(longest + 1) <= sizes[there][:, None]]  # word by word
        begin = self.place[mine]
        size = self.place[mine + 1] - begin
        owner = np.repeat(np.flatnonzero(there), sizes[there] + 1)
        return there, np.bincount(owner, weights=size, minlength=n).astype(np.int64), self.ids[ranges(begin, size)]
