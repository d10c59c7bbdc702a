"""Tandem repeats of a sequence by the linear method of Gusfield and Stoye.

1. The sequence is cut into its LZ blocks (each the longest piece that also
   begins earlier, or one new symbol). The leftmost place of every square is
   found at a block's border, or by steps to the right from one that is.
2. These squares are looked up in the suffix tree.
3. From each, suffix-link walks complete the vocabulary: a square ``a x a x``
   leads to ``x a x a`` if that continues in the tree.
4. Every leaf below a vocabulary item is an occurrence. Those of one period
   that begin side by side merge into a run; runs whose root is itself a
   repetition are left out, as a shorter period covers them.

Symbols are non-negative integers. Names of all pieces of 1, 2, 4, ... symbols
(equal pieces, equal names) give longest common extensions to both sides for
whole arrays of places at once, and the suffix order.
"""

from __future__ import annotations

import numpy as np


class Names:
    """Names of the pieces of 2**k symbols at each place; pieces that reach past the end have names of their own."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        level = np.unique(s, return_inverse=True)[1].reshape(-1).astype(np.int64)
        self.levels, width = [level], 1
        while width < n and level.max() + 1 < n:
            second = np.full(n, -1, np.int64)
            second[: n - width] = level[width:]
            # what ends here sorts before all that goes on, and by itself
            level = np.unique(level * (n + 1) + second + 1, return_inverse=True)[1].reshape(-1).astype(np.int64)
            self.levels.append(level)
            width *= 2
        self.n, self.rank = n, level

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common part that begins at ``i`` and ``j``; a place past the end has none."""
        i, j = i.copy(), j.copy()
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            ok = np.flatnonzero((i + (1 << k) <= self.n) & (j + (1 << k) <= self.n))
            ok = ok[level[i[ok]] == level[j[ok]]]
            for x in (i, j, got):
                x[ok] += 1 << k
        return got

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common part that ends at ``i`` and ``j``; a place before the first has none."""
        i, j = i.copy(), j.copy()
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, w = self.levels[k], 1 << k
            ok = np.flatnonzero((i + 1 >= w) & (j + 1 >= w))
            ok = ok[level[i[ok] - w + 1] == level[j[ok] - w + 1]]
            i[ok] -= w
            j[ok] -= w
            got[ok] += w
        return got


def lz_blocks(names: Names, order: np.ndarray, lcp: np.ndarray) -> list[int]:
    """Where the LZ blocks begin, and the end; from each suffix's nearest neighbours in the suffix order that begin earlier."""
    n, rank = names.n, names.rank.tolist()
    up, down = list(range(-1, n - 1)), list(range(1, n + 1))
    at, left, right = order.tolist(), [-1] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        a, b = up[r], down[r]
        if a >= 0:
            left[i] = at[a]
            down[a] = b
        if b < n:
            right[i] = at[b]
            up[b] = a
    here = np.arange(n)
    longest = np.zeros(n, np.int64)
    for side in (np.array(left), np.array(right)):
        has = np.flatnonzero(side >= 0)
        longest[has] = np.maximum(longest[has], names.forward(here[has], side[has]))
    step, out, i = np.maximum(longest, 1).tolist(), [], 0
    while i < n:
        out.append(i)
        i += step[i]
    return [*out, n]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``counts[i]`` of each."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def leftmost_squares(names: Names, blocks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of squares at the blocks' borders, from which steps to the right reach the leftmost place of every square."""
    b = np.array(blocks, np.int64)
    h, h1, h2 = b[:-1], b[1:], np.append(b[2:], b[-1])
    out_s, out_k = [], []
    # the centre in the block, the right end at or past the next one's begin
    size = h1 - h
    k, end = _spread(np.ones(len(h), np.int64), size), np.repeat(h1, size)
    q = end - k
    forward, backward = names.forward(end, q), names.backward(end - 1, q - 1)
    ok = (forward + backward >= k) & (forward > 0)
    out_s.append(np.maximum(q - backward, q - k + 1)[ok])
    out_k.append(k[ok])
    # the left half begins before the block, the centre in it, the right end in it or in the next one
    size = h2 - h
    k, begin, stop = _spread(np.ones(len(h), np.int64), size), np.repeat(h, size), np.repeat(h1, size)
    q = begin + k
    forward, backward = names.forward(begin, q), names.backward(begin - 1, q - 1)
    start = np.maximum(begin - backward, begin - k + 1)
    ok = (forward + backward >= k) & (forward > 0) & (backward > 0) & (start + k <= stop)
    out_s.append(start[ok])
    out_k.append(k[ok])
    return np.concatenate(out_s), np.concatenate(out_k)


class SuffixTree:
    """The suffix tree from suffix order and common prefixes: inner nodes with depth, range of leaves, parent, suffix link and children by first symbol."""

    def __init__(self, s: np.ndarray, names: Names, order: np.ndarray, lcp: np.ndarray):
        n = self.n = len(s)
        self.s, self.at, self.rank = s.tolist(), order.tolist(), names.rank.tolist()
        # leaves are 0 .. n-1 by rank, inner nodes from n on
        depth, low, high, parent = [n - i for i in self.at], list(range(n)), list(range(n)), [-1] * n
        near = [*lcp.tolist(), -1]
        stack: list[int] = []  # inner nodes under way
        for r in range(n):
            child, common = r, near[r]
            while stack and depth[stack[-1]] > common:
                v = stack.pop()
                if parent[child] < 0:
                    parent[child] = v
                high[v] = r
                child = v
            if common >= 0 and (not stack or depth[stack[-1]] < common):
                stack.append(len(depth))
                depth.append(common)
                low.append(low[child])
                high.append(-1)
                parent.append(-1)
            if stack and parent[child] < 0:
                parent[child] = stack[-1]
        self.depth, self.low, self.high, self.parent = depth, low, high, parent
        if len(depth) == n or min(depth[n:]) > 0:  # a root for what shares nothing
            root = len(depth)
            depth.append(0)
            low.append(0)
            high.append(n - 1)
            parent.append(-1)
            for v in range(root):
                if parent[v] < 0:
                    parent[v] = root
        self.root = next(v for v in range(len(depth) - 1, n - 1, -1) if depth[v] == 0)
        self.child = {}
        s_, at = self.s, self.at
        for v, p in enumerate(parent):
            if p >= 0 and at[low[v]] + depth[p] < n:
                self.child[p, s_[at[low[v]] + depth[p]]] = v
        self.link: dict[int, int] = {}

    def locate(self, i: int, size: int, near: int | None = None) -> int:
        """The node at or just below the place of the ``size`` symbols at ``i``, going down from a node above it."""
        v, s, depth = self.root if near is None else near, self.s, self.depth
        while depth[v] < size:
            v = self.child[v, s[i + depth[v]]]
        return v

    def linked(self, v: int) -> int:
        """The suffix link of an inner node: the node of its label without the first symbol."""
        if v == self.root:
            return v
        if v not in self.link:
            # links of the nodes above are needed first
            path = [v]
            while (p := self.parent[path[-1]]) != self.root and p not in self.link:
                path.append(p)
            for u in reversed(path):
                p = self.parent[u]
                start = self.root if p == self.root else self.link[p]
                self.link[u] = self.locate(self.at[self.low[u]] + 1, self.depth[u] - 1, start)
        return self.link[v]


def vocabulary(tree: SuffixTree, names: Names, starts: np.ndarray, halves: np.ndarray) -> list[tuple[int, int, int]]:
    """All squares, each once: the node at or below it, an occurrence and the half length."""
    # squares that begin together lie on one path up from a leaf: the deepest first
    seen: set[tuple[int, int]] = set()
    out: list[tuple[int, int, int]] = []
    depth, parent, s, at, low, n = tree.depth, tree.parent, tree.s, tree.at, tree.low, tree.n
    found: list[tuple[int, int, int]] = []
    last, v = -1, 0
    for j in np.lexsort((-halves, starts)).tolist():
        i, k = int(starts[j]), int(halves[j])
        if i != last:
            last, v = i, tree.rank[i]
        while (p := parent[v]) >= 0 and depth[p] >= 2 * k:
            v = p
        if (v, k) not in seen:
            seen.add((v, k))
            found.append((v, i, k))
    for v, i, k in found:
        out.append((v, i, k))
        while True:
            # walk: without the first symbol by the suffix link of the node above, then that symbol again
            p = parent[v]
            u = tree.locate(i + 1, 2 * k - 1, tree.linked(p) if p >= 0 and p != tree.root else tree.root)
            first = s[i]
            if depth[u] == 2 * k - 1:
                w = tree.child.get((u, first))
                if w is None:
                    break
            elif s[at[low[u]] + 2 * k - 1] == first:
                w = u
            else:
                break
            v, i = w, at[low[w]]
            if (v, k) in seen:
                break
            seen.add((v, k))
            out.append((v, i, k))
    return out


def tandem_runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of ``s`` of two periods and more: start, length and smallest period, by start, then period."""
    none = np.empty(0, np.int64)
    if len(s) < 2:
        return none, none, none
    names = Names(np.asarray(s))
    order = np.empty(names.n, np.int64)
    order[names.rank] = np.arange(names.n)
    if names.rank.max() + 1 < names.n:
        raise AssertionError("suffixes are not all different")
    lcp = names.forward(order[:-1], order[1:])
    starts, halves = leftmost_squares(names, lz_blocks(names, order, lcp))
    if not len(starts):
        return none, none, none
    tree = SuffixTree(np.asarray(s), names, order, lcp)
    words = vocabulary(tree, names, starts, halves)
    i, k = (np.array([w[x] for w in words], np.int64) for x in (1, 2))
    low, high = (np.array([side[w[0]] for w in words], np.int64) for side in (tree.low, tree.high))
    keep = ~_repetition(names, i, k)
    k, low, count = k[keep], low[keep], (high - low + 1)[keep]
    return merged(order[_spread(low, count)], np.repeat(k, count))


def _repetition(names: Names, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the half of a square is itself several copies of a shorter piece: of its length over one of its prime factors."""
    least = _least_factors(int(k.max()))
    out, js, rest = np.zeros(len(k), bool), np.flatnonzero(k > 1), k[k > 1]
    while len(js):
        prime = least[rest]
        d = k[js] // prime
        out[js] |= names.forward(i[js], i[js] + d) >= k[js] - d
        while (more := rest % prime == 0).any():
            rest = np.where(more, rest // prime, rest)
        js, rest = js[rest > 1], rest[rest > 1]
    return out


def _least_factors(n: int) -> np.ndarray:
    """The least prime factor of each number up to ``n``."""
    out = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            multiples = out[p * p :: p]
            multiples[multiples == np.arange(p * p, n + 1, p)] = p
    return out


def merged(at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs from all places of squares (each of a place and a period once)."""
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    start, q = at[first], period[first]
    length = at[last] - start + 2 * q
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]
