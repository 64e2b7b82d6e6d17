"""Weighted acyclic automata over words: counts of short word sequences.

A :class:`Counts` holds sequences of 1 to ``DEPTH`` words with their counts as
a sorted tree, one set of arrays per length; a count of 0 marks a mere prefix.
:func:`pack` merges equal states from the ends backwards, the register of the
incremental construction from sorted input, into the minimal automaton, and
writes its states and arcs as bytes; :class:`Automaton` reads them.  Everything
works on whole arrays, and states are merged only after their arcs have been
compared, never by a hash alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

DEPTH = 3
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def collapse(keys: np.ndarray, weights: np.ndarray, how=np.add) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the number of each key among them, and the sums
    (or maxima) of their weights."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return ranked[at], number, how.reduceat(weights[order], at) if len(at) else weights[:0]


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (n[0] of them), first[1], ..."""
    before = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(first - before, n)


@dataclass
class Level:
    parent: np.ndarray  # number in the level above, rising
    label: np.ndarray  # number of the last word, rising below one parent
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.label)

    def part(self, lo: int, hi: int) -> Level:
        return Level(self.parent[lo:hi], self.label[lo:hi], self.weight[lo:hi])


_EMPTY = np.zeros(0, np.int64)


class Counts:
    """``words`` in byte order and ``levels[k]``: the sequences of k+1 words."""

    def __init__(self, words: list[bytes], levels: list[Level]):
        self.words, self.levels = words, levels

    def __len__(self) -> int:
        return sum(map(len, self.levels))

    @staticmethod
    def of(words: list[bytes], rows: list[tuple[list[np.ndarray], np.ndarray]], how=np.add) -> Counts:
        """From label columns and weights for each length; prefixes that are
        not given get a count of 0."""
        columns = [[], [], []]
        for k, (labels, weight) in enumerate(rows):
            for d in range(k + 1):
                columns[d].append((labels[: d + 1], weight if d == k else np.zeros(len(weight), np.int64)))
        levels, numbers = [], {}
        for d in range(DEPTH):
            labels = [np.concatenate([x[0][d] for x in columns[d]] or [_EMPTY])]
            parent = np.concatenate([numbers[d - 1, i + 1] for i in range(len(columns[d]))] or [_EMPTY]) if d else np.zeros(len(labels[0]), np.int64)
            keys, number, weight = collapse((parent << 32) | labels[0], np.concatenate([x[1] for x in columns[d]] or [_EMPTY]), how)
            levels.append(Level(keys >> 32, keys & 0xFFFFFFFF, weight))
            ends = np.cumsum([len(x[1]) for x in columns[d]])
            for i, part in enumerate(np.split(number, ends[:-1]) if len(ends) else []):
                numbers[d, i] = part
        return Counts(words, levels)

    @staticmethod
    def count(words: list[bytes], ids: np.ndarray, piece: np.ndarray) -> Counts:
        """All sequences of up to ``DEPTH`` words that stay inside one piece;
        ``ids`` number the sorted ``words``."""
        keys, number, weight = collapse(ids, np.ones(len(ids), np.int64))
        levels = [Level(np.zeros(len(keys), np.int64), keys, weight)]
        at = np.arange(len(ids))
        for d in range(1, DEPTH):
            inside = at + d < len(ids)
            at, number = at[inside], number[inside]
            inside = piece[at] == piece[at + d]
            at, number = at[inside], number[inside]
            keys, number, weight = collapse((number << 32) | ids[at + d], np.ones(len(at), np.int64))
            levels.append(Level(keys >> 32, keys & 0xFFFFFFFF, weight))
        return Counts(words, levels)

    @staticmethod
    def union(parts: list[Counts], how=np.add) -> Counts:
        """The union of several; counts of equal sequences are summed."""
        if len(parts) == 1:
            return parts[0]
        words = sorted({w for p in parts for w in p.words})
        rank = {w: i for i, w in enumerate(words)}
        maps = [np.fromiter((rank[w] for w in p.words), np.int64, len(p.words)) for p in parts]
        levels, numbers = [], [np.zeros(1, np.int64)] * len(parts)
        for d in range(DEPTH):
            keys = [(n[p.levels[d].parent] << 32) | m[p.levels[d].label] for p, m, n in zip(parts, maps, numbers, strict=True)]
            merged, number, weight = collapse(np.concatenate(keys), np.concatenate([p.levels[d].weight for p in parts]), how)
            levels.append(Level(merged >> 32, merged & 0xFFFFFFFF, weight))
            numbers = np.split(number, np.cumsum([len(k) for k in keys])[:-1])
        return Counts(words, levels)

    def children(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of the nodes of level ``d``."""
        if d + 1 == DEPTH:
            return np.zeros(len(self.levels[d]), np.int64), np.zeros(len(self.levels[d]), np.int64)
        edge = np.searchsorted(self.levels[d + 1].parent, np.arange(len(self.levels[d]) + 1))
        return edge[:-1], np.diff(edge)

    def narrowed(self, levels: list[Level]) -> Counts:
        """With other levels, and only the words that these use."""
        used = np.unique(np.concatenate([x.label for x in levels]))
        levels = [Level(x.parent, np.searchsorted(used, x.label), x.weight) for x in levels]
        return Counts([self.words[i] for i in used], levels)

    def at_least(self, least: int) -> Counts:
        """The sequences that occur ``least`` times, and their prefixes."""
        kept: list[np.ndarray] = []
        below = np.zeros(0, bool)
        for d in reversed(range(DEPTH)):
            level = self.levels[d]
            keep = level.weight >= least
            if d + 1 < DEPTH:
                keep[self.levels[d + 1].parent[below]] = True
            kept.insert(0, keep)
            below = keep
        levels, number = [], np.zeros(1, np.int64)
        for level, keep in zip(self.levels, kept, strict=True):
            weight = level.weight[keep]
            levels.append(Level(number[level.parent[keep]], level.label[keep], np.where(weight >= least, weight, 0)))
            number = np.cumsum(keep) - 1
        return self.narrowed(levels)

    def _before(self, border: tuple[bytes, ...], first: list[np.ndarray]) -> list[int]:
        """How many nodes of each level come before ``border`` (prefixes do)."""
        a, b, c = border
        one, two, three = self.levels
        i = int(np.searchsorted(one.label, bisect_right(self.words, a)))
        if not i or self.words[one.label[i - 1]] != a:
            j = int(first[0][i])
            return [i, j, int(first[1][j])]
        lo, hi = int(first[0][i - 1]), int(first[0][i])
        j = lo + int(np.searchsorted(two.label[lo:hi], bisect_right(self.words, b)))
        if j == lo or self.words[two.label[j - 1]] != b:
            return [i, j, int(first[1][j])]
        lo, hi = int(first[1][j - 1]), int(first[1][j])
        return [i, j, lo + int(np.searchsorted(three.label[lo:hi], bisect_left(self.words, c)))]

    def cut(self, borders: list[tuple[bytes, ...]]) -> Iterable[tuple[int, Counts]]:
        """(number of borders at or below, part) for the parts between sorted borders."""
        first = []
        for d in range(DEPTH - 1):
            start, n = self.children(d)
            first.append(np.concatenate((start, [len(self.levels[d + 1])])))
        ends = [self._before(b, first) for b in borders] + [[len(x) for x in self.levels]]
        low = [0] * DEPTH
        for k, high in enumerate(ends):
            if high != low:
                start = list(low)
                for d in reversed(range(1, DEPTH)):  # prefixes that belong to the part before
                    if start[d] < high[d]:
                        start[d - 1] = min(start[d - 1], int(self.levels[d].parent[start[d]]))
                levels = []
                for d, level in enumerate(self.levels):
                    part = level.part(start[d], high[d])
                    weight = part.weight.copy()
                    weight[: max(0, low[d] - start[d])] = 0
                    levels.append(Level(part.parent - (start[d - 1] if d else 0), part.label, weight))
                yield k, self.narrowed(levels)
            low = high

    def text(self, d: int, at: np.ndarray) -> list[bytes]:
        """The sequences of some nodes of level ``d``, joined by a space."""
        columns = []
        for k in reversed(range(d + 1)):
            columns.insert(0, [self.words[i] for i in self.levels[k].label[at]])
            at = self.levels[k].parent[at]
        return [b" ".join(x) for x in zip(*columns, strict=True)]


def _same_states(weight: np.ndarray, n: np.ndarray, label: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each state the first one that equals it; arcs lie end to end."""
    first = np.cumsum(n) - n
    mark = (label.astype(np.uint64) * _K1) ^ (target.astype(np.uint64) * _K2)
    mark = (mark ^ (mark >> np.uint64(31))) * _K3
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mark, dtype=np.uint64)))
    mark = (total[first + n] - total[first]) ^ (weight.astype(np.uint64) * _K3)
    order = np.argsort(mark, kind="stable")
    fresh = np.concatenate(([True], mark[order][1:] != mark[order][:-1]))
    same = np.empty(len(n), np.int64)
    same[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    equal = (n == n[same]) & (weight == weight[same])
    ours = np.flatnonzero(equal)
    a, b = spread(first[ours], n[ours]), spread(first[same[ours]], n[ours])
    wrong = (label[a] != label[b]) | (target[a] != target[b])
    equal[np.repeat(ours, n[ours])[wrong]] = False
    return np.where(equal, same, np.arange(len(n)))


def pack(counts: Counts) -> bytes:
    """The minimal automaton of ``counts`` as bytes."""
    state = [np.zeros(len(x), np.int64) for x in counts.levels]
    fanout = [counts.children(d) for d in range(DEPTH)]
    height = [np.zeros(len(x), np.int64) for x in counts.levels]
    for d in reversed(range(DEPTH - 1)):
        n = fanout[d][1]
        some = np.flatnonzero(n)
        if len(some):
            height[d][some] = 1 + np.maximum.reduceat(height[d + 1], fanout[d][0][some])
    weights, arcs, labels, targets, states = [], [], [], [], 0
    for h in range(DEPTH):
        where = [np.flatnonzero(x == h) for x in height]
        weight = np.concatenate([counts.levels[d].weight[where[d]] for d in range(DEPTH)])
        if not len(weight):
            continue
        if h == 0:
            values, number = np.unique(weight, return_inverse=True)
            weights.append(values)
            arcs.append(np.zeros(len(values), np.int64))
        else:
            below = [spread(fanout[d][0][where[d]], fanout[d][1][where[d]]) for d in range(DEPTH - 1)]
            n = np.concatenate([fanout[d][1][where[d]] for d in range(DEPTH)])
            label = np.concatenate([counts.levels[d + 1].label[b] for d, b in enumerate(below)])
            target = np.concatenate([state[d + 1][b] for d, b in enumerate(below)])
            same = _same_states(weight, n, label, target)
            own = same == np.arange(len(same))
            number = (np.cumsum(own) - 1)[same]
            kept = spread((np.cumsum(n) - n)[own], n[own])
            weights.append(weight[own])
            arcs.append(n[own])
            labels.append(label[kept])
            targets.append(target[kept])
        number = number + states
        states += len(weights[-1])
        for d, part in enumerate(np.split(number, np.cumsum([len(x) for x in where])[:-1])):
            state[d][where[d]] = part
    root = counts.levels[0]
    weights.append(np.zeros(1, np.int64))
    arcs.append(np.array([len(root)]))
    labels.append(root.label)
    targets.append(state[0])
    return _write([b"\n".join(counts.words)], [np.concatenate(x) for x in (weights, arcs, labels, targets)])


def _write(texts: list[bytes], arrays: list[np.ndarray]) -> bytes:
    small = [x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)) for x in arrays]
    head = np.array([len(texts[0])] + [y for x in small for y in (x.dtype.itemsize, len(x))], np.int64).tobytes()
    body = head + texts[0] + b"".join(x.tobytes() for x in small)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


class Automaton:
    """States (``weight``, arcs ``first``..) with their arcs (``label``,
    ``target``); the last state is the root."""

    def __init__(self, raw: bytes):
        body = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
        head = np.frombuffer(body, np.int64, 9)
        at = 72 + int(head[0])
        self.words = body[72:at].split(b"\n") if head[0] else []
        arrays = []
        for size, n in head[1:].reshape(-1, 2):
            arrays.append(np.frombuffer(body, f"<u{size}", n, at).astype(np.int64))
            at += int(size * n)
        self.weight, n, self.label, self.target = arrays
        self.first = np.concatenate(([0], np.cumsum(n)))
        self.arc_key = (np.repeat(np.arange(len(n)), n) << 32) | self.label

    def counts(self) -> Counts:
        """All sequences again, as sorted levels."""
        levels, state = [], np.array([len(self.weight) - 1])
        for _ in range(DEPTH):
            n = self.first[state + 1] - self.first[state]
            arc = spread(self.first[state], n)
            levels.append(Level(np.repeat(np.arange(len(state)), n), self.label[arc], self.weight[self.target[arc]]))
            state = self.target[arc]
        return Counts(self.words, levels)

    def compose(self, wanted: Counts) -> tuple[list[np.ndarray], np.ndarray]:
        """Walk ``wanted`` and this automaton together: the count here of every
        node of ``wanted`` (0 if absent), and the numbers that the two-word
        nodes have in ``counts().levels[1]`` (-1 if absent)."""
        here = {w: i for i, w in enumerate(self.words)}
        label = np.fromiter((here.get(w, -1) for w in wanted.words), np.int64, len(wanted.words))
        state, out, pair = np.array([len(self.weight) - 1]), [], _EMPTY
        root = len(self.weight) - 1
        fanout = np.diff(self.first)
        before = np.cumsum(fanout[self.target[self.first[root] :]]) - fanout[self.target[self.first[root] :]]
        top = _EMPTY
        for d, level in enumerate(wanted.levels):
            source, word = state[level.parent], label[level.label]
            known = (source >= 0) & (word >= 0)
            key = (np.where(known, source, 0) << 32) | np.where(known, word, 0)
            arc = np.minimum(np.searchsorted(self.arc_key, key), max(len(self.arc_key) - 1, 0))
            known &= self.arc_key[arc] == key if len(self.arc_key) else False
            state = np.where(known, self.target[arc] if len(self.arc_key) else -1, -1)
            out.append(np.where(known, self.weight[state], 0))
            if d == 0:
                top = arc - self.first[root]
            elif d == 1:
                parent = level.parent
                pair = np.where(known, before[np.where(known, top[parent], 0)] + arc - self.first[np.where(known, source, 0)], -1) if len(before) else np.full(len(level), -1)
        return out, pair
