"""Substring dedup: planted passages go, clean documents stay."""

import random

from gridloom.llm.substring import LEAST, LEAST_WORDS, MOST, gear_cuts, substring_dedup


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(3)
    a = text(rng, 600).encode()
    cuts = gear_cuts(a)
    assert cuts[-1] == len(a) and all(0 < y - x <= MOST for x, y in zip([0, *cuts], cuts))
    assert all(y - x >= LEAST for x, y in zip([0, *cuts], cuts[:-1]))
    pieces = lambda t: {t[x:y] for x, y in zip([0, *gear_cuts(t)], gear_cuts(t))}
    b = a[:700] + b"one inserted thing " + a[700:]
    assert len(pieces(a) - pieces(b)) <= 12
    assert gear_cuts(b"") == [] and gear_cuts(b"x") == [1]


def test_passages_are_removed_once(spark):
    rng = random.Random(4)
    passages = [text(rng, 51) for _ in range(40)]
    clean = [text(rng, 150) for _ in range(60)]
    docs, where = [(i, t, "en") for i, t in enumerate(clean)], {}
    for k, p in enumerate(passages):
        for _ in range(3):
            i = len(docs)
            docs.append((i, text(rng, rng.randint(20, 90)) + " " + p + " " + text(rng, 40), "en"))
            where.setdefault(k, []).append(i)
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(docs, "doc_id long, text string, removed_words string")).collect()}
    assert all(out[i].text == t and not out[i].removed for i, t in enumerate(clean))
    for k, ids in where.items():
        assert out[ids[0]].removed_chars == 0
        for i in ids[1:]:
            assert [s.owner for s in out[i].removed] == [ids[0]]
            assert passages[k] not in out[i].text
            gone = docs[i][1].encode()[out[i].removed[0].start : out[i].removed[0].end].decode()
            assert gone.strip() in passages[k]
            assert set(out[i].text.split()) <= set(docs[i][1].split())


def test_passages_go_to_their_ends(spark):
    rng = random.Random(6)
    docs, where = [], []
    for k in range(600):
        p = text(rng, 51 if k % 2 else 60)
        for _ in range(2):
            docs.append((len(docs), text(rng, rng.randint(20, 60)) + " " + p + " " + text(rng, 30)))
        where.append((len(docs) - 1, p))
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, p in where:
        (s,) = out[i].removed
        gone = docs[i][1].encode()[s.start : s.end].decode()
        # a short word beside it may be the same by chance
        assert p in gone and len(gone) < len(p) + 12 and s.owner == i - 1 and not out[i - 1].removed


def test_odd_rows(spark):
    long = "word another thing entirely " * 30_000
    rows = [(1, None), (2, ""), (None, long), (3, long), (4, long), (4, long), (5, "né " * 50), (6, "short one")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.text for r in got}
    assert by[1] is None and by[2] == "" and by[None] == long and by[6] == "short one"
    # what a text repeats without end stays there about once
    assert long.startswith(by[3]) or set(by[3].split()) == {"word", "another", "thing", "entirely"}
    assert 20 < len(by[3]) < 400 and len(by[4]) < 200 and by[5].startswith("né né ")
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_passages_within_one_document(spark):
    rng = random.Random(7)
    p, between, tail = text(rng, 80), text(rng, 50), text(rng, 30)
    docs = [(1, f"{p} {between} {p} {tail} {p}", 5, 6), (2, text(rng, 60) + " " + p, 5, 6), (3, text(rng, 100), 5, 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, removed_chars long, Removed long")
    out = {r.doc_id: r for r in substring_dedup(df).collect()}
    assert out[1].text.split() == f"{p} {between} {tail}".split() and [s.owner for s in out[1].removed] == [1, 1]
    assert p not in out[2].text and [s.owner for s in out[2].removed] == [1] and out[3].text == docs[2][1]
    # of columns with the names of the results, the results stay
    assert substring_dedup(df).columns == ["doc_id", "text", "removed_chars", "removed"] and out[3].removed_chars == 0
    assert substring_dedup(df, detail=False).columns == df.columns


def brute_repeats(texts, least):
    """Places of each text whose run of ``least`` words stands earlier, in another text or in the same."""
    seen, out = {}, []
    for i, t in enumerate(texts):
        ws, marks = t.split(), set()
        for j in range(len(ws) - least + 1):
            key = tuple(ws[j : j + least])
            if key in seen and seen[key] != (i, j):
                marks |= set(range(j, j + least))
            seen.setdefault(key, (i, j))
        out.append(marks)
    return out


def test_against_brute_force(spark):
    """What goes is what repeats: all runs of 60 words and more, and nothing that no run of LEAST_WORDS covers."""
    rng = random.Random(8)
    parts = [text(rng, n) for n in (25, 60, 61, 90, 200, 15) for _ in range(4)]
    texts = [" ".join(x for _ in range(rng.randint(1, 4)) for x in (text(rng, rng.randint(5, 60)), rng.choice(parts))) for _ in range(120)]
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    must, may = brute_repeats(texts, 60), brute_repeats(texts, LEAST_WORDS)
    for i, t in enumerate(texts):
        raw, gone, at = t.encode(), set(), 0
        for j, w in enumerate(t.split()):
            if any(s.start <= at and at + len(w) <= s.end for s in out[i].removed):
                gone.add(j)
            at += len(w) + 1
        assert must[i] <= gone, (i, sorted(must[i] - gone))
        # a removed run may reach a word or two further, where texts agree by chance
        assert len(gone - may[i]) <= 2 * len(out[i].removed), (i, sorted(gone - may[i]))
        assert len(raw) == len(out[i].text.encode()) + sum(s.end - s.start for s in out[i].removed)
