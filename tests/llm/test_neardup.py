"""Near-dedup against brute force over all pairs."""

import random
from collections import defaultdict

from pyspark.sql import types as T

from gridloom.llm.neardup import near_dedup, near_duplicates

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_shingles", T.StringType())])


def shingle_set(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    both[j] += 1
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def planted(seed, groups, noise):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    vocab = [word() for _ in range(400)]
    rows = []
    for size in groups:
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 160))]
        for _ in range(size):
            ws = list(base)
            for _ in range(rng.randint(0, max(1, len(ws) // 25))):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            rows.append(" ".join(ws))
    rows += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 90))) for _ in range(noise)]
    common = " ".join(rng.choice(vocab) for _ in range(60))
    rows += [common + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(10, 40))) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = planted(5, [2, 3, 40, 120, 9, 9, 2, 2], 80)
    got = near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "One two", "a"), (5, "one  TWO", "a"), (6, "one two three", "a"), (None, "one two", "a"), (7, "x " * 60_000, "a"), (8, "x " * 70_000, "a"), (9, "É b c d e", "a"), (10, "é b c d e", "a")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[i].n_shingles for i in (1, 2, 3, 4, 6, 7)] == [0, 0, 0, 1, 1, 1]
    assert [by[i].component_id for i in range(1, 11)] == [1, 2, 3, 4, 4, 6, 7, 7, 9, 10]
    assert by[None].component_id is None and by[None].kept
    kept = near_dedup(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n_shingles"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 9, 10]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(none).collect() == []
    assert near_dedup(none).collect() == []


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f", ""), (1, "a b c d e f", ""), (2, "a b c d e f", "")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1)]


def test_short_texts_at_the_threshold(spark):
    """Three of four shingles in common, in buckets whose least documents are no near copies."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    rows, pairs = [], []
    for _ in range(20):
        common = [word() for _ in range(7)]
        for _ in range(150):
            rows.append(" ".join([*common, word(), word(), word()]))
        pairs.append((len(rows), len(rows) + 1))
        rows += [" ".join(common), " ".join([*common, word()])]
    rows = list(enumerate(rows))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()} and all(got[a] == got[b] for a, b in pairs)
