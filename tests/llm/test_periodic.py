"""Periodic runs against a plain search, over random, planted and very regular texts."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np

from gridloom.llm.periodic import periodic_runs, repeated_tail, run_digests, runs_of
from gridloom.llm.tandem import tandem_runs


def plain(s, least=2):
    """All runs by comparing each word with the one q places on."""
    n, out, seen = len(s), [], []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            # a shorter period that covers the stretch is its smallest
            if j - i >= q and not any(a <= i and j + q <= a + m for a, m, p in seen if q % p == 0):
                seen.append((i, j - i + q, q))
            i = j
    return sorted((r for r in seen if r[1] >= max(least, 2 * r[2])), key=lambda r: (r[0], r[2]))


def sequences(rng, n, longest=60):
    for _ in range(n):
        size, letters = rng.randint(0, longest), rng.choice([1, 2, 2, 3, 4, 8, 50])
        s = [rng.randrange(letters) for _ in range(size)]
        for _ in range(rng.randint(0, 3)):
            if size > 3:
                a, p, k = rng.randrange(size), rng.randint(1, size // 2), rng.randint(2, size)
                s = [s[i] if not a <= i < a + k else s[min(size - 1, a + (i - a) % p)] for i in range(size)]
        yield s


def test_all_runs():
    for s in sequences(random.Random(1), 2500):
        assert [tuple(map(int, r)) for r in zip(*tandem_runs(np.array(s, np.int64)))] == plain(s)


def test_parts_hold_all_long_runs():
    rng = random.Random(2)
    docs = list(sequences(rng, 300, 120))
    for least in (12, 5):
        for a in range(0, 300, 20):
            part = docs[a : a + 20]
            words = np.array([w for d in part for w in d], np.int64)
            of = np.repeat(np.arange(20), [len(d) for d in part])
            got = sorted((int(s), int(n), int(q)) for s, n, q in zip(*runs_of(words, of, least)))
            want, at = [], 0
            for d in part:
                want += [(s + at, n, q) for s, n, q in plain(d, least)]
                at += len(d)
            assert got == sorted(want)


def test_regular_texts():
    fib = [0, 1]
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    fib = b
    thue = [bin(i).count("1") % 2 for i in range(256)]
    squares_free = [0]
    for _ in range(5):
        squares_free = [y for x in squares_free for y in ((0, 1, 2), (0, 2), (1,))[x]]
    for s in (fib, thue, squares_free, [1] * 300, [1, 2] * 150, ([1] * 7 + [2]) * 20):
        assert [tuple(map(int, r)) for r in zip(*tandem_runs(np.array(s, np.int64)))] == plain(s)
    assert not len(tandem_runs(np.array(squares_free))[0])


def expected(doc_id, text, planted):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(ws)
    if planted and doc_id is not None and n:
        h = crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = plain(ws, 12)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_query_against_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for i, s in enumerate(sequences(rng, 400, 90)):
        docs.append((i, "".join(("Wört", "w", "W", "x1", " y")[w % 5] + str(w // 5) + rng.choice([" ", "\n", "\t \x0b"]) for w in s)))
    docs += [(500, None), (501, ""), (502, " \r\n"), (None, "a b " * 10), (3, docs[3][1]), (503, "la " * 30_000), (504, "x" * 100_000), (505, " ".join(str(i) for i in range(3000)) + " ja" * 12)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, runs int")
    for edit in (None, repeated_tail):
        got = sorted((tuple(r) for r in run_digests(periodic_runs(df, edit=edit)).collect()), key=str)
        if edit:
            assert sum(g[1] > 0 for g in got) > 60
        # the plain search takes too long for one word 30 000 times
        (one,) = (g for g in got if g[0] == 503)
        assert (*one[1:5], one[7]) == (1, 0, 30_000, 1, hashlib.sha256(b"la").hexdigest())
        assert [g for g in got if g[0] != 503] == sorted((expected(i, t, edit) for i, t in docs if i != 503), key=str)
    assert periodic_runs(df.where("1=0")).collect() == []
