"""Double-array tries over words, in numpy: built from many phrases at once, walked from many positions at once.

A state is a slot. A word's code c leads from state s to ``base[s] + c`` if ``check`` of that slot names s. The
states of the first level are those of the phrases' groups (here: languages), which are slots from 0 on.
"""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa

from linkspark.llm import wordhash as W

CHUNK = 1 << 19  # bytes of phrases that are looked at together
ROUNDS = 40  # tries at random places before the table grows


def _zstd():
    import zstandard
    return zstandard


class Trie:
    def __init__(self, groups: list[str], alphabet: np.ndarray, base: np.ndarray, check: np.ndarray) -> None:
        self.groups, self.alphabet, self.base, self.check = groups, alphabet, base, check
        self.roots = {g: i for i, g in enumerate(groups)}

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, groups=np.frombuffer(json.dumps(self.groups).encode(), np.uint8), alphabet=self.alphabet,
                 base=self.base, check=self.check)
        return _zstd().ZstdCompressor(level=1).compress(out.getvalue())

    @classmethod
    def from_bytes(cls, data: bytes) -> Trie:
        own = np.load(io.BytesIO(_zstd().ZstdDecompressor().decompress(data)))
        return cls(json.loads(own["groups"].tobytes()), own["alphabet"], own["base"], own["check"])

    def codes(self, prints: np.ndarray) -> np.ndarray:
        """Codes of words by their fingerprints; -1 for words of no phrase."""
        if not len(self.alphabet):
            return np.full(len(prints), -1, np.int32)
        at = np.searchsorted(self.alphabet, prints)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == prints, at, -1).astype(np.int32)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next state of each pair; -1 where there is none."""
        base = self.base[states]
        ahead = base + codes
        known = (base >= 0) & (codes >= 0)
        ahead[~known] = 0
        return np.where(known & (self.check[ahead] == states), ahead, -1)


def _spots(size: int, width: int, n: int, rng) -> np.ndarray:
    return rng.integers(0, size - width + 1, n, dtype=np.int64)


class _Table:
    """Slots while phrases are laid in."""

    def __init__(self, size: int, width: int) -> None:
        self.width, self.rng = max(width, 1), np.random.default_rng(3)
        self.used = np.zeros(size + self.width, bool)

    def grow(self, by: int) -> int:
        old = len(self.used)
        self.used = np.concatenate([self.used, np.zeros(by, bool)])
        return old

    def place(self, firsts: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """A base for each parent (children ``codes[first:first + count]``) so that no two children share a slot."""
        bases = np.full(len(firsts), -1, np.int64)
        for p in np.flatnonzero(counts > 64)[np.argsort(-counts[counts > 64], kind="stable")].tolist():
            own = codes[firsts[p]:firsts[p] + counts[p]]
            for spot in [*_spots(len(self.used), self.width, ROUNDS, self.rng).tolist(), None]:
                if spot is None:
                    spot = self.grow(self.width)
                if not self.used[spot + own].any():
                    break
            self.used[spot + own] = True
            bases[p] = spot
        for low, high in ((8, 64), (1, 8), (0, 1)):
            waiting, rounds = np.flatnonzero((counts > low) & (counts <= high)), 0
            while len(waiting):
                if rounds == ROUNDS:
                    self.grow(len(self.used) // 2)
                    rounds = 0
                rounds += 1
                spots = _spots(len(self.used), self.width, len(waiting), self.rng)
                n = counts[waiting]
                begins = np.cumsum(n) - n
                parent = np.repeat(np.arange(len(waiting)), n)
                slots = spots[parent] + codes[np.repeat(firsts[waiting] - begins, n) + np.arange(n.sum())]
                by = np.lexsort((parent, slots))  # of several that want one slot the first has it
                mine = np.ones(len(slots), bool)
                mine[by[1:]] = slots[by[1:]] != slots[by[:-1]]
                good = np.logical_and.reduceat(mine & ~self.used[slots], begins)
                self.used[slots[good[parent]]] = True
                bases[waiting[good]] = spots[good]
                waiting = waiting[~good]
        return bases


def build(groups: pa.Array, phrases: pa.Array) -> tuple[Trie, np.ndarray]:
    """The trie of (group, phrase) pairs, words of a phrase apart by white space, and each phrase's state.

    A phrase without words has the state of its group.
    """
    told = groups.dictionary_encode()
    names = sorted(told.dictionary.to_pylist())
    number = {g: i for i, g in enumerate(names)}
    at = np.array([number[g] for g in told.dictionary.to_pylist()], np.int64)[told.indices.to_numpy()] if len(told) else np.zeros(0, np.int64)
    prints, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in W.chunks(phrases, CHUNK):
        _, _, own, counts = W.words(data, offsets)
        prints.append(own)
        sizes.append(np.diff(counts))
    alphabet, codes = np.unique(np.concatenate(prints), return_inverse=True)
    width, sizes = max(len(alphabet), 1), np.concatenate(sizes)
    counts = np.concatenate([[0], np.cumsum(sizes)])
    levels, nodes, depth = [], len(names), 0
    while (longer := np.flatnonzero(sizes > depth)).size:
        pairs, which = np.unique(at[longer] * width + codes[counts[:-1][longer] + depth], return_inverse=True)
        levels.append((pairs // width, pairs % width, nodes))
        at[longer] = nodes + which
        nodes += len(pairs)
        depth += 1

    slot = np.full(nodes, -1, np.int64)
    slot[:len(names)] = np.arange(len(names))
    table = _Table(len(names) + 3 * nodes, width)
    table.used[:len(names)] = True
    placed = []
    for parents, own, first in levels:
        starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        n = np.diff(np.append(starts, len(parents)))
        bases = table.place(starts, n, own)
        slot[first:first + len(own)] = np.repeat(bases, n) + own
        placed.append((slot[parents[starts]], bases, slot[parents], slot[first:first + len(own)]))
    base, check = np.full(len(table.used), -1, np.int32), np.full(len(table.used), -1, np.int32)
    for owners, bases, parents, children in placed:
        base[owners] = bases
        check[children] = parents
    return Trie(names, alphabet, base, check), slot[at]
