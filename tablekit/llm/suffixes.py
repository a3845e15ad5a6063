"""Deep-shallow sorting of suffixes: their order, and how many bytes each shares with the one before.

Shallow: multikey quicksort on words of eight bytes. All groups of suffixes that are alike so far are split
at once into smaller, equal and greater than a pivot of their own; the equal ones go on with the next eight
bytes, down to ``shallow`` bytes. Deep: what is still alike then is put into a blind trie for each group. A blind
trie keeps branching depths and single bytes only: a suffix goes down comparing nothing but the bytes at
branches, is compared once with the suffix it ends at, and is hung in where the two differ. Walking the trie
gives the order and the shared bytes.

A suffix ends at its ``end``; a shorter one stands before those it begins. Equal suffixes stand side by side.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Eight bytes of each suffix from its depth on as a number, zeros beyond the end (``data`` is padded)."""
    at = start + depth
    left = np.clip(end - at, 0, WORD)
    view = np.lib.stride_tricks.sliding_window_view(data, WORD)
    got = np.ascontiguousarray(view[np.minimum(at, len(view) - 1)]).view(">u8").ravel().astype(np.uint64)
    cut = ((WORD - left) * 8).astype(np.uint64)
    return np.where(left == 0, np.uint64(0), got >> np.minimum(cut, np.uint64(63)) << np.minimum(cut, np.uint64(63)))


def _shared(x: bytes, y: bytes) -> int:
    """How many bytes two strings begin with in common."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Nodes are [depth, children by byte]; leaves are lists of equal suffixes. Bytes are numbered from 1; 0 is
    the end of a suffix."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts = texts
        self.root: list | None = None

    def byte(self, i: int, depth: int) -> int:
        t = self.texts[i]
        return t[depth] + 1 if depth < len(t) else 0

    def add(self, i: int) -> None:
        if self.root is None:
            self.root = [-1, [i]]
            return
        # down to a leaf, wherever no branch has the byte by any
        node = self.root
        while node[0] >= 0:
            below = node[1]
            node = below.get(self.byte(i, node[0])) or next(iter(below.values()))
        same = _shared(self.texts[i], self.texts[node[1][0]])
        if same == len(self.texts[i]) == len(self.texts[node[1][0]]):
            node[1].append(i)
            return
        # again, to the place where they part
        above, node = None, self.root
        while 0 <= node[0] < same:
            above, node = node, node[1][self.byte(i, node[0])]
        leaf = [-1, [i]]
        if node[0] == same:
            node[1][self.byte(i, same)] = leaf
            return
        some = node
        while some[0] >= 0:
            some = next(iter(some[1].values()))
        branch = [same, {self.byte(some[1][0], same): node, self.byte(i, same): leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][self.byte(i, above[0])] = branch

    def walk(self) -> list[tuple[int, int]]:
        """(suffix, bytes shared with the one before; 0 for the first) in order."""
        out: list[tuple[int, int]] = []
        stack: list[tuple[list, int]] = [(self.root, 0)] if self.root else []
        while stack:
            node, same = stack.pop()
            if node[0] < 0:
                first, *rest = node[1]
                out.append((first, same))
                out += [(i, len(self.texts[i])) for i in rest]
                continue
            keys = sorted(node[1], reverse=True)
            stack += [(node[1][k], node[0]) for k in keys[:-1]]
            stack.append((node[1][keys[-1]], same))
        return out


def deep_shallow(data: np.ndarray, start: np.ndarray, end: np.ndarray, shallow: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[start:end], and the bytes each shares with the one before in order."""
    n = len(start)
    order, shared = np.arange(n), np.zeros(n, np.int64)
    if n < 2:
        return order, shared
    start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
    padded = np.r_[data, np.zeros(WORD, np.uint8)]
    # groups: ranges of the order that are alike in ``depth`` bytes
    lo, hi, depth = np.zeros(1, np.int64), np.full(1, n, np.int64), np.zeros(1, np.int64)
    deep: list[tuple[int, int]] = []
    while len(lo):
        size = hi - lo
        group = np.repeat(np.arange(len(lo)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[group]
        mine = order[place]
        key = _words(padded, start[mine], end[mine], depth[group])
        first = np.cumsum(size) - size
        # the pivot: the middle of the first, the middle and the last
        pivot = np.sort(np.stack([key[first], key[first + size // 2], key[first + size - 1]]), axis=0)[1]
        side = 1 + (key > pivot[group]).astype(np.int64) - (key < pivot[group]).astype(np.int64)
        by = np.argsort(3 * group + side, kind="stable")
        order[place] = mine[by]
        count = np.bincount(3 * group + side, minlength=3 * len(lo)).reshape(-1, 3)
        less, same, more = count.T
        mid_lo, mid_hi = lo + less, lo + less + same
        d2 = depth + WORD
        done = d2 >= shallow
        for a, b in zip(mid_lo[done & (same > 1)].tolist(), mid_hi[done & (same > 1)].tolist()):
            deep.append((a, b))
        go = ~done & (same > 1)
        lo, hi, depth = (
            np.concatenate([lo[less > 1], mid_lo[go], mid_hi[more > 1]]),
            np.concatenate([mid_lo[less > 1], mid_hi[go], hi[more > 1]]),
            np.concatenate([depth[less > 1], d2[go], depth[more > 1]]),
        )
    raw = data.tobytes()
    inside = np.zeros(n, bool)
    for a, b in deep:
        some = order[a:b].tolist()
        trie = BlindTrie([raw[start[i] : end[i]] for i in some])
        for k in range(len(some)):
            trie.add(k)
        walked = trie.walk()
        order[a:b] = [some[k] for k, _ in walked]
        shared[a + 1 : b] = [s for _, s in walked[1:]]
        inside[a + 1 : b] = True
    # neighbours that the shallow part told apart share less than ``shallow`` bytes
    at = np.flatnonzero(~inside)[1:]
    x, y = order[at - 1], order[at]
    most = np.minimum(end[x] - start[x], end[y] - start[y])
    open_, same = np.ones(len(at), bool), np.zeros(len(at), np.int64)
    for d in range(0, shallow + WORD, WORD):
        i = np.flatnonzero(open_)
        if not len(i):
            break
        offset = np.full(len(i), d)
        differ = _words(padded, start[x[i]], end[x[i]], offset) ^ _words(padded, start[y[i]], end[y[i]], offset)
        equal = differ == 0
        bytes_ = np.zeros(len(i), np.int64)
        for b in range(WORD):
            bytes_ += (differ >> np.uint64(8 * (WORD - 1 - b))) == 0
        same[i] += bytes_
        open_[i] = equal
    shared[at] = np.minimum(same, most)
    return order, shared
