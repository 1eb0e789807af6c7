"""Deep-shallow sorting of suffixes: multikey quicksort to a shallow depth, blind tries for what is still tied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SYMBOL = 8  # bytes that the shallow phase compares at once
SHALLOW = 32


def symbols(text: np.ndarray) -> np.ndarray:
    """At every position the next 8 bytes as one big-endian number, zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(SYMBOL, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(SYMBOL):
        out = (out << np.uint64(8)) | padded[i : i + len(text)]
    return out


def shallow_sort(
    keys: np.ndarray, positions: np.ndarray, depth: int = SHALLOW
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The positions ordered by their first ``depth`` bytes, and the slices of the order that are still tied.

    Multikey quicksort with symbols of 8 bytes: a set tied so far is sorted by its next symbol alone, and each set of
    equal symbols moves on to the next one. All sets of a level are sorted in one vector operation.
    """
    order = np.array(positions, dtype=np.int64)
    group = np.zeros(len(order), np.int64)
    active = np.arange(len(order))
    for offset in range(0, depth, SYMBOL):
        if not len(active):
            break
        key = keys[order[active] + offset]
        by = np.lexsort((key, group[active]))
        order[active] = order[active[by]]
        key, sets = key[by], group[active][by]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (sets[1:] != sets[:-1])]
        # a set is named by the place where it starts
        named = active[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        group[active] = named
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
    if not len(active):
        return order, []
    starts = np.flatnonzero(np.r_[True, group[active][1:] != group[active][:-1]])
    ends = np.append(starts[1:], len(active))
    return order, [(int(active[s]), int(active[e - 1]) + 1) for s, e in zip(starts, ends, strict=True)]


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix of two strings of equal length."""
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (differ.bit_length() + 7) // 8


class BlindTrie:
    """A trie of strings of one length that keeps only its branching bytes.

    An inner node is (depth, {byte: child}), a leaf the list of positions of equal strings. To insert, one walks down
    by the branching bytes alone to any leaf, compares the string with that leaf's once, and thereby knows where the
    string leaves the path.
    """

    def __init__(self) -> None:
        self.root: list | None = None
        self.text: dict[int, bytes] = {}

    def insert(self, string: bytes, position: int) -> None:
        if self.root is None:
            self.root = [position]
            self.text[id(self.root)] = string
            return
        path, node, parents = [], self.root, []
        while isinstance(node, tuple):
            depth, children = node
            parents.append(node)
            path.append(string[depth])
            node = children.get(string[depth]) or next(iter(children.values()))
        other = self.text[id(node)]
        if other == string:
            node.append(position)
            return
        shared = common_prefix(other, string)
        leaf = [position]
        self.text[id(leaf)] = string
        # the first node on the path that branches at or below the shared prefix
        place = next((i for i, p in enumerate(parents) if p[0] >= shared), len(parents))
        if place < len(parents) and parents[place][0] == shared:
            parents[place][1][string[shared]] = leaf
            return
        below = parents[place] if place < len(parents) else node
        joint = (shared, {other[shared]: below, string[shared]: leaf})
        if place:
            parents[place - 1][1][path[place - 1]] = joint
        else:
            self.root = joint

    def leaves(self) -> Iterator[list[int]]:
        """The sets of equal strings, in the strings' order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                yield node


def sort_suffixes(
    text: bytes, positions: np.ndarray, length: int, shallow: int = SHALLOW
) -> tuple[np.ndarray, np.ndarray]:
    """The positions in the order of their suffixes' first ``length`` bytes, and whether each equals the one before.

    Every suffix must have ``length`` bytes. Equal suffixes keep any order.
    """
    letters = np.frombuffer(text, np.uint8)
    depth = min(shallow, length) // SYMBOL * SYMBOL
    order, tied = shallow_sort(symbols(letters), positions, depth)
    same = np.zeros(len(order), bool)
    for start, end in tied if depth < length else []:
        members = order[start:end].tolist()
        if end - start == 2:  # a trie of two is one comparison
            a, b = (text[p + depth : p + length] for p in members)
            if a == b:
                same[start + 1] = True
            elif b < a:
                order[start], order[start + 1] = members[1], members[0]
            continue
        trie = BlindTrie()
        for p in members:
            trie.insert(text[p + depth : p + length], p)
        at = start
        for leaf in trie.leaves():
            order[at : at + len(leaf)] = leaf
            same[at + 1 : at + len(leaf)] = True
            at += len(leaf)
    if depth == length:
        for start, end in tied:
            same[start + 1 : end] = True
    return order, same
