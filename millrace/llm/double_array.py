"""Double-array tries over sequences of words, searched for all positions of a text at once.

A word is a number and a number is ``width`` bytes, so a node has at most 256 children and a step is
one byte. A node is a slot of two arrays: the child for byte ``c`` of the node in slot ``s`` is slot
``base[s] + c`` if ``check`` of that slot is ``s``. All sequences of a trie have one length, so the last
step lands on a leaf, which holds the number of its sequence.

A trie is made in numpy: nodes are runs of equal prefixes of the sorted sequences, nodes with many
children are laid first, at drawn offsets where all their slots are free, all nodes with equally many
children in one go; the nodes with one child, which are most, fill the holes.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np

RADIX = 256

@dataclass
class Trie:
    """``words`` numbers the words; ``base``, ``check`` and ``leaf`` are indexed by slot; slot 0 is the root."""

    words: dict[bytes, int]
    width: int
    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray
    sequences: int

    def parts(self) -> tuple:
        """The fields, for a broadcast: plain values need no package on the workers."""
        return self.words, self.width, self.base, self.check, self.leaf, self.sequences

    def numbers(self, words) -> np.ndarray:
        """The number of each word, -1 for one that no sequence has."""
        words = list(words)
        return np.fromiter(map(self.words.get, words, repeat(-1)), np.int32, len(words))

    def step(self, states: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states go on with their word, and the states these reach."""
        at = np.flatnonzero(numbers >= 0)
        states, numbers = states[at], numbers[at]
        for k in range(self.width):
            to = self.base[states] + ((numbers >> 8 * k) & (RADIX - 1))
            fits = self.check[to] == states
            at, states, numbers = at[fits], to[fits], numbers[fits]
        return at, states

    def found(self, first: int, numbers: np.ndarray, length: int) -> np.ndarray:
        """For each position the sequence (of ``first`` and the next ``length`` words) that starts there, or -1."""
        result = np.full(len(numbers), -1, np.int32)
        at, states = self.step(np.zeros(1, np.int32), np.array([first], np.int32))
        if not len(at):
            return result
        at = np.arange(max(0, len(numbers) - length + 1))
        states = np.full(len(at), states[0], np.int32)
        for k in range(length):
            on, states = self.step(states, numbers[at + k])
            at = at[on]
        result[at] = self.leaf[states]
        return result


def _bytes_of(numbers: np.ndarray, width: int) -> np.ndarray:
    """``(n, m)`` word numbers to ``(n, m * width)`` bytes, lowest first."""
    shifts = 8 * np.arange(width)
    return ((numbers[:, :, None] >> shifts) & (RADIX - 1)).reshape(len(numbers), -1).astype(np.uint8)


def build(sequences: list[list[bytes]]) -> Trie:
    """The trie of distinct sequences of one length; the sequence at position ``k`` has number ``k``."""
    words: dict[bytes, int] = {}
    if not sequences:
        empty = np.full(2 * RADIX, -1, np.int32)
        return Trie(words, 1, np.zeros(2 * RADIX, np.int32), empty, empty.copy(), 0)
    numbers = np.array([[words.setdefault(w, len(words)) for w in s] for s in sequences], np.int64)
    width = (len(words).bit_length() + 7) // 8
    path = _bytes_of(numbers, width)
    order = np.lexsort(path.T[::-1])
    path = path[order]

    # Nodes of each depth: node number of every row's prefix, and for each node its parent and byte.
    new = np.zeros(len(path), bool)
    new[0] = True
    of_row, nodes = np.zeros(len(path), np.int64), 1
    parents, bytes_ = [], []
    for depth in range(path.shape[1]):
        new[1:] |= path[1:, depth] != path[:-1, depth]
        firsts = np.flatnonzero(new)
        parents.append(of_row[firsts])
        bytes_.append(path[firsts, depth])
        of_row = nodes + np.cumsum(new) - 1
        nodes += len(firsts)
    leaves = of_row  # every row ends in a node of its own
    parent, byte = np.concatenate(parents), np.concatenate(bytes_).astype(np.int64)
    # Children of a node are neighbours: they were made in order of their rows.
    starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
    owners, many = parent[starts], np.diff(np.r_[starts, len(parent)])

    base = np.zeros(nodes, np.int64)
    used = np.zeros(2 * nodes + 4 * RADIX, bool)
    used[:RADIX] = True
    draw = np.random.default_rng(nodes)
    for count in np.unique(many[many > 1])[::-1]:
        of = np.flatnonzero(many == count)
        children = byte[starts[of][:, None] + np.arange(count)]
        tries = 0
        while len(of):
            tries += 1
            if not tries % 32:
                used = np.concatenate([used, np.zeros(len(used) // 4, bool)])
            offset = draw.integers(RADIX, len(used) - RADIX, len(of))
            slots = offset[:, None] + children
            fits = ~used[slots].any(axis=1)
            at, slots = np.flatnonzero(fits), slots[fits]
            # Of nodes that want one slot the first gets it; the others are laid in a later round.
            _, first = np.unique(slots, return_index=True)
            alone = np.zeros(slots.size, bool)
            alone[first] = True
            alone = alone.reshape(slots.shape).all(axis=1)
            used[slots[alone]] = True
            base[owners[of[at[alone]]]] = offset[at[alone]]
            left = np.ones(len(of), bool)
            left[at[alone]] = False
            of, children = of[left], children[left]
    single = np.flatnonzero(many == 1)
    free = np.flatnonzero(~used)
    if len(free) < len(single):
        free = np.concatenate([free, np.arange(len(used), len(used) + len(single) - len(free))])
    base[owners[single]] = free[: len(single)] - byte[starts[single]]

    slot = np.zeros(nodes, np.int64)
    slot[1:] = base[parent] + byte
    size = int(max(slot.max(), base.max())) + RADIX + 1
    slots = np.zeros(size, np.int32)
    slots[slot] = base
    check = np.full(size, -1, np.int32)
    check[slot[1:]] = slot[parent]
    leaf = np.full(size, -1, np.int32)
    leaf[slot[leaves]] = order
    return Trie(words, width, slots, check, leaf, len(sequences))
