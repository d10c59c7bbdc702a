"""Probabilistic automata by state merging: the formats of credentials, inferred from examples.

The examples of a format make a prefix tree with counts. States are merged,
from the root outwards, where two are statistically compatible: the shares of
each next symbol and of the end do not differ by more than the Hoeffding bound
allows, in the states and recursively in those that merging would join
(ALERGIA). What is left is a deterministic automaton that gives every string a
likelihood; strings of other shapes get little.

Shares are smoothed, so that no string is impossible; a symbol that no example
has in a state leads where it leads most often elsewhere.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np

#: Symbols: the printable ASCII characters, and one for all others.
SYMBOLS = 95
#: Confidence of the Hoeffding bound, and pseudo-counts of a symbol that a state has not seen.
ALPHA, SMOOTH = 1e-4, 0.02


def symbols(text: str) -> np.ndarray:
    """Numbers of the characters."""
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8).astype(np.int64) - 33
    return np.where((raw >= 0) & (raw < SYMBOLS - 1), raw, SYMBOLS - 1)


class PrefixTree:
    """Counts of arrivals, of ends and of next symbols, for each prefix of the examples."""

    def __init__(self, examples: Iterable[tuple[np.ndarray, int]]):
        self.arrive, self.end, self.next = [0], [0], [{}]
        for text, n in examples:
            q = 0
            self.arrive[0] += n
            for c in text.tolist():
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.arrive.append(0)
                    self.end.append(0)
                    self.next.append({})
                q = self.next[q][c]
                self.arrive[q] += n
            self.end[q] += n


class Automaton:
    """A probabilistic automaton: next state and logarithm of probability by state and symbol, and of the end by state."""

    def __init__(self, step: np.ndarray, chance: np.ndarray, end: np.ndarray):
        self.step, self.chance, self.end = step, chance, end

    @property
    def states(self) -> int:
        return len(self.end)

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """Logarithm of each text's probability; all texts advance together, the longest go on alone."""
        if not texts:
            return np.empty(0)
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        flat = symbols("".join(texts))
        at = (np.cumsum(sizes) - sizes)[order]
        state, out = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        ends = -sizes[order]
        for j in range(int(sizes.max())):
            n = int(np.searchsorted(ends, -j))  # texts of more than j characters come first
            c = flat[at[:n] + j]
            out[:n] += self.chance[state[:n], c]
            state[:n] = self.step[state[:n], c]
        out += self.end[state]
        back = np.empty(len(texts))
        back[order] = out
        return back


def infer(examples: Iterable[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of a format from its examples."""
    counts = Counter(examples)
    tree = PrefixTree((symbols(t), n) for t, n in sorted(counts.items()))
    arrive, end, nxt = tree.arrive, tree.end, tree.next
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, na: int, b: int, nb: int) -> bool:
        return na > 0 and nb > 0 and abs(a / na - b / nb) > bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if differ(end[p], arrive[p], end[q], arrive[q]):
                return False
            for c in nxt[p].keys() | nxt[q].keys():
                a, b = nxt[p].get(c), nxt[q].get(c)
                if differ(arrive[a] if a is not None else 0, arrive[p], arrive[b] if b is not None else 0, arrive[q]):
                    return False
                if a is not None and b is not None and a != b:
                    todo.append((a, b))
        return True

    # arcs are counted apart from arrivals once states merge
    arcs = [{c: arrive[t] for c, t in m.items()} for m in nxt]

    def fold(p: int, q: int) -> None:
        """Add the tree below ``q`` to ``p``."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            arrive[p] += arrive[q]
            end[p] += end[q]
            for c, b in nxt[q].items():
                arcs[p][c] = arcs[p].get(c, 0) + arcs[q][c]
                if c in nxt[p]:
                    todo.append((nxt[p][c], b))
                else:
                    nxt[p][c] = b

    red, known = [0], {0}
    while True:
        blue = sorted({(-arrive[t], p, c, t) for p in red for c, t in nxt[p].items() if t not in known})
        if not blue:
            break
        _, p, c, q = blue[0]
        for r in red:
            if compatible(r, q):
                nxt[p][c] = r
                fold(r, q)
                break
        else:
            red.append(q)
            known.add(q)
    number = {q: i for i, q in enumerate(red)}
    # where each symbol leads most often; one of no example leads to the root
    usual = np.zeros((len(red), SYMBOLS), np.int64)
    for q in red:
        for c, t in nxt[q].items():
            usual[number[t], c] += arcs[q][c]
    step = np.tile(usual.argmax(axis=0), (len(red), 1))
    chance, ends = np.zeros((len(red), SYMBOLS)), np.zeros(len(red))
    for q, i in number.items():
        seen = np.array([arcs[q].get(c, 0) for c in range(SYMBOLS)], float)
        total = seen.sum() + end[q] + SMOOTH * (SYMBOLS + 1)
        chance[i] = np.log((seen + SMOOTH) / total)
        ends[i] = math.log((end[q] + SMOOTH) / total)
        for c, t in nxt[q].items():
            step[i, c] = number[t]
    return Automaton(step, chance, ends)
