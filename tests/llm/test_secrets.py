"""Secrets: base patterns against a plain scan, inferred formats, odd rows."""

import hashlib
import math
import random
import re

import numpy as np

from gridloom.llm import grammar, secrets
from gridloom.llm.secrets import find_secrets, span_digests

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def scan(text):
    """The base spans, by patterns written out for the test."""
    out = []
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(f"(?:{key})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 15))) for _ in range(n))


def corpus(rng, n=400):
    docs = []
    for i in range(n):
        t = prose(rng, rng.randint(0, 60))
        if i % 3 == 0:
            t += " AKIA" + "".join(rng.choice(ALNUM) for _ in range(16)) + " " + prose(rng, 3)
        if i % 3 == 1:
            t += "é Token = \"" + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '" x'
        if i % 3 == 2:
            t += " passwd:" + "".join(rng.choice("0123456789abcdef") for _ in range(18))
        docs.append((i, t))
    return docs


def test_base_spans_against_a_plain_scan():
    rng = random.Random(1)
    bits = ["password", "PassWD", "secret", "api_key", "APIKEY", "tokEn", "toKen", "ſecret", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "AKIAAKIA", "abcdef0123", "ABCDEFGH12", "x+/_.=-", "é", "\t", "0123456789abcdef", "\U0001f600"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [(a, k, b) for a, b, k, _ in secrets.base_spans(t)] == scan(t)


def test_inferred_automaton():
    rng = random.Random(2)
    keys = ["AKIA" + "".join(rng.choice(ALNUM) for _ in range(16)) for _ in range(600)]
    a = grammar.infer(keys)
    # the fixed start is spelt out, and some ten thousand prefixes become few states
    assert 5 <= a.states < 120
    own = a.likelihoods(["AKIA" + "".join(rng.choice(ALNUM) for _ in range(16)) for _ in range(200)])
    strange = a.likelihoods(["XKIA" + "".join(rng.choice(ALNUM.lower()) for _ in range(16)) for _ in range(200)])
    assert own.min() > strange.max()
    # all strings of two symbols and fewer have not more than all probability; a string at a time gives the same
    few = grammar.infer(["a", "b", "ab", "ab"])
    total = sum(math.exp(x) for x in few.likelihoods(["", *map(chr, range(33, 127)), *(chr(i) + chr(j) for i in range(33, 127) for j in range(33, 127))]))
    assert 0.5 < total <= 1 + 1e-9
    many = ["x" * 5, "abc", "", "zz"]
    assert np.allclose(few.likelihoods(many), [few.likelihoods([t])[0] for t in many])


def test_query_columns_and_added_spans(spark):
    rng = random.Random(3)
    docs = corpus(rng)
    hidden = "".join(rng.choice("0123456789abcdef") for _ in range(15))  # one short of a base match
    docs += [(1000, "look: " + hidden + " there"), (1001, None), (1002, ""), (None, "token=abcdefghijkl"), (0, docs[0][1]), (1003, prose(rng, 60_000) + docs[1][1]), (1004, "deadbeef" * 50_000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, spans string, base int")
    got = span_digests(find_secrets(df)).collect()
    assert len(got) == len(docs)
    left = sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.base_sha256))
    want = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, digest(d[1])))
    clean = 0
    for r, (i, t) in zip(left, want, strict=True):
        spans = scan(t or "")
        assert (r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (i, *(sum(k == j for _, k, _ in spans) for j in range(3)), digest(t))
        own = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        shown = r.spans.split(",") if r.spans else []
        assert [s for s in shown if s in own] == own
        clean += shown == own
    assert next(r.spans for r in got if r.doc_id == 1000) in ("assign:6:21", "hex:6:21")
    assert clean == len(docs) - 1
    assert find_secrets(df.where("1=0")).collect() == []


def digest(text):
    return hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in scan(text or "")).encode()).hexdigest()


def test_held_out_formats():
    rng = random.Random(4)
    train = corpus(rng, 900)
    by = {k: [] for k in range(4)}
    for _, t in train:
        spans = secrets.base_spans(t)
        for *_, k, s in spans:
            by[k].append(s)
        by[3] += [w for _, w in secrets.candidates(t, spans)]
    f = secrets.Formats.fit({k: sorted(set(v))[: secrets.SAMPLE] for k, v in by.items()})
    good = ["AKIA" + "".join(rng.choice(ALNUM) for _ in range(14)) for _ in range(100)] + ["".join(rng.choice("0123456789abcdef") for _ in range(15)) for _ in range(100)]
    words = [w for w in prose(rng, 5000).split() if len(w) >= 12]
    assert (f.scores(good)[1] >= secrets.MARGIN).mean() > 0.9 and (f.scores(words)[1] >= secrets.MARGIN).mean() < 0.001


def test_sample_is_bounded_and_the_same_for_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SAMPLE", 50)
    docs = corpus(random.Random(5))
    found = lambda n: spark.createDataFrame(docs, "doc_id long, text string").repartition(n).mapInArrow(secrets._find, f"doc_id long, base {secrets._BASE_DDL}, secrets array<string>, starts array<long>, words array<string>")
    one, other = secrets.examples(found(1)), secrets.examples(found(7))
    assert one == other and all(0 < len(v) <= 50 for v in one.values()) and len(one[3]) > 20
