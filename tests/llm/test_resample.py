"""Importance resampling against a plain computation; trees, rounds and key ranges of the merge."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

from gridloom.llm import tournament
from gridloom.llm.resample import _drawn, draw_documents, resample
from gridloom.llm.tournament import Sizes


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return ws, [crc32(f.encode()) % 10000 for f in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]]


def brute(docs, target, percent=25, least=20, seed=7):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(grams(x)[1])
    for _, x in target:
        t.update(grams(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000))))
    rows = []
    for place, (i, x) in enumerate(docs):
        ws, fs = grams(x)
        w = sum(map(gain, fs)) // len(fs) if fs else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(fs), w, score, place, len(ws)))
    able = sorted((r for r in rows if r[3] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[4]))
    rank = {r[4]: k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r[:4], rank.get(r[4])) for r in rows]


def corpus(rng, n):
    words = ["Alpha", "bêta", "g4mma", "d-e", "x", "omega", "Ünd", "q_r", "Ωmega", "naïve", " ", "z9"]
    return [(i * 7 % 1009, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]


ODD = [(None, "a b c " * 20), (2000, None), (2001, ""), (2002, "!!! \t"), (2003, "Wort " * 5000), (2004, "ab" * 700_000 + " tail"), (0, "same again " * 20), (0, "same again " * 20)]


def test_against_brute_force(spark):
    rng = random.Random(1)
    docs, target = corpus(rng, 700) + ODD, [(1, "alpha BÊTA g4mma " * 9), (2, None), (None, "omega")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, rank int").repartition(5)
    tf = spark.createDataFrame(target, "item_id long, text string")
    want = brute(docs, target)
    # places of rows with one id are as they come: which of two equal rows is first is not told
    show = lambda rows: sorted(rows, key=str)
    assert show(tuple(r) for r in resample(df, tf).collect()) == show(want)
    # the same by many short runs, key ranges and rounds
    few = resample(df, tf, sizes=Sizes(3, 4, 16, 10))
    assert few.columns == ["doc_id", "n_features", "weight", "score", "rank"] and show(tuple(r) for r in few.collect()) == show(want)


def test_documents_of_the_draw(spark):
    rng = random.Random(2)
    docs, target = corpus(rng, 120), [(1, "omega omega")]
    df = spark.createDataFrame([(*d, str(d[0])) for d in docs], "doc_id long, text string, score string")
    tf = spark.createDataFrame(target, "item_id long, text string")
    drawn = draw_documents(df, tf, percent=40)
    assert drawn.columns == df.columns
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(i for i, *_, k in brute(docs, target, 40) if k)
    assert resample(df.where("1=0"), tf).collect() == [] and draw_documents(df.where("1=0"), tf).collect() == []
    none = {tuple(r) for r in resample(df, tf.where("1=0"), percent=0).collect()}
    assert none == set(brute(docs, [], 0))


def test_tree_merges_and_reads_no_more_than_it_gives():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randint(0, 20), i, j) for j in range(rng.randint(0, 30))) for i in range(k)]
        assert list(tournament.merge([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    read = Counter()

    def counted(i):
        for x in range(1000):
            read[i] += 1
            yield (x, i)

    got = [row for _, row in zip(range(10), tournament.merge([counted(i) for i in range(4)]))]
    assert len(got) == 10 and sum(read.values()) <= 14


def test_frequent_score_is_cut_by_ids(spark):
    rows = [(i, (i * 17) % 90, 30, 40, 100, 500 if i % 3 else 499) for i in range(90)]
    table = spark.createDataFrame(rows, "row long, doc_id long, n_words long, n_features long, weight long, score long").repartition(4)
    got = [(r.rank, r.score, r.doc_id, r.row) for r in _drawn(table, 80, 20, Sizes(2, 3, 5, 8)).orderBy("rank").collect()]
    want = sorted(((-s, d, i) for i, d, *_, s in rows))[:72]
    assert got == [(k, -s, d, i) for k, (s, d, i) in enumerate(want, 1)]
