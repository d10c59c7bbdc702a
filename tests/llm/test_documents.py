"""Operators on documents: decontamination, fingerprints, language, the pipeline."""

import hashlib
import math
import random
import struct
from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from gridloom.llm import decontam
from gridloom.llm.common import shared_path
from gridloom.llm.decontam import containment, decontaminate
from gridloom.llm.imatch import LEAST_IDF, MOST_IDF, TIERS, fingerprints, with_next
from gridloom.llm.langid import fit, identify, identify_pages, keep_identified, page_texts, train, trigrams
from gridloom.llm.queries import op10_language_id
from tests.llm.test_neardup import shingle_set


def text(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_containment_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, text(rng, n)) for i, n in enumerate([1, 3, 4, 5, 6, 9, 17, 33, 70, 140, 300])] + [(90, None), (91, " "), (None, "a b c d e f")]
    docs = []
    for k in range(160):
        i, t = items[k % 11]
        ws = t.split()
        drop = rng.randint(0, max(0, len(ws) // 3))
        ws = ws[drop:] if k % 3 else ws
        docs.append((k, text(rng, rng.randint(0, 300)) + "\n" + " ".join(ws).upper() + "\t" + text(rng, rng.randint(0, 30)), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (502, items[2][1], "x"), (None, items[9][1], "x"), (503, text(rng, 60_000) + " " + items[8][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_common, r.n_item) for r in containment(df, it).collect()}
    want = {}
    for d, t, _ in docs:
        for i, u in items:
            if d is None or i is None:
                continue
            a, b = shingle_set(t), shingle_set(u)
            if b and 4 * len(a & b) >= 3 * len(b):
                want[d, i] = (len(a & b), len(b))
    assert got == want and (503, 8) in got
    # the same where the items are too many to be broadcast
    monkeypatch.setattr(decontam, "MOST_HASHES", 0)
    assert {(r.doc_id, r.item_id): (r.n_common, r.n_item) for r in containment(df, it).collect()} == want
    kept = decontaminate(df, it)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _, _ in docs} - {d for d, _ in want}
    assert containment(df, it.where("1=0")).collect() == [] == containment(df.where("1=0"), it).collect()


def test_fingerprints(spark):
    rng = random.Random(9)
    vocab = text(rng, 400).split()
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [(i * 7 - 20, make(rng.randint(0, 150)), "x") for i in range(300)] + [(5000, None, "x"), (5001, "é" * 9, "x"), (5002, docs_0 := make(60), "x"), (5003, docs_0, "x"), (9000, make(30_000), "x")]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(docs, "doc_id long, text string, codes string")).collect()}
    order = sorted((i, t or "") for i, t, _ in docs)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1 and len(got[i].fingerprint) == 4 * 51
    assert got[5002].fingerprint == got[5003].fingerprint and got[5002].near_next == 1
    mean = lambda f: sum(f(r) for r in got.values()) / len(got)
    assert mean(lambda r: r.near_edited) > 3 * mean(lambda r: r.near_next)
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (one,) = fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def brute_codes(texts, lexicon_of):
    """The 51 codes of each text by the definition: lexicon by inverse document frequency, sorted terms, independent subsets."""
    long = lambda x: x - (1 << 64) if x >> 63 else x
    of_long = lambda x, seed=42: xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
    of_int = lambda x, seed: xxhash.xxh64_intdigest(struct.pack("<i", x), seed)
    terms = lambda t: {long(xxhash.xxh64_intdigest(w.encode(), 42)) for w in t.lower().replace("\t", " ").split(" ") if w}
    df = Counter(h for t in lexicon_of for h in terms(t))
    lexicon = {h for h, n in df.items() if LEAST_IDF <= math.log(len(lexicon_of) / n) <= MOST_IDF}
    out = []
    for t in texts:
        mine, codes = sorted(terms(t) & lexicon), []
        for bits, count in TIERS:
            for j in range(count):
                word, at = divmod(j, 60 // bits)
                salted = [of_int(100 * bits + word * (60 // bits), of_long(h)) >> 4 for h in mine]
                picked = [f for f in salted if f >> bits * at & (1 << bits) - 1 == 0]
                code = 42
                for f in picked:
                    code = xxhash.xxh64_intdigest(struct.pack("<Q", f), code)
                codes.append(1 + long(code) % 65535 if picked else 0)
        if not mine:
            codes = [1 + long(of_int(j, xxhash.xxh64_intdigest(t.encode(), 42))) % 65535 for j in range(51)]
        out.append(codes)
    return out


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(21)
    vocab = text(rng, 300).split()
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(120)] + ["", "solo", "é ü solo\tword"]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    following = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following)]
    own, changed = brute_codes(texts, texts), brute_codes(edited, texts)
    hexed = lambda codes: "".join(f"{c:04X}" for c in codes)

    def like(a, b):
        both = [(x, y) for x, y in zip(a, b) if x or y]
        return 1.0 if a == b else sum(x == y for x, y in both) / len(both) if both else 0.0

    for i in range(len(texts)):
        assert got[i].fingerprint == hexed(own[i]) and got[i].edited_fingerprint == hexed(changed[i]), i
        assert got[i].near_edited == like(own[i], changed[i]) and got[i].near_next == like(own[i], own[(i + 1) % len(texts)])
    # the subsets are independent: no two of them pick the same terms
    h = [int(x) for x in np.random.default_rng(3).integers(-(2**63), 2**63, 3000)]
    picks = [frozenset(x for x in h if xxhash.xxh64_intdigest(struct.pack("<i", 100 * b), xxhash.xxh64_intdigest(struct.pack("<q", x), 42)) >> 4 + b * j & (1 << b) - 1 == 0) for b, n in ((4, 15), (6, 10)) for j in range(n)]
    assert len(set(picks)) == 25 and not any(a <= b for a in picks for b in picks if a is not b)


def test_next_document_where_ids_repeat(spark):
    """A third of the rows without id, a third with one id, and buckets of a few rows."""
    rng = random.Random(22)
    ids = [None] * 60 + [500] * 60 + rng.sample(range(1000), 60)
    rows = [(i, f"t{k}" if k % 7 else None) for k, i in enumerate(ids)] + [(500, "same")] * 5 + [(-(2**63), "least"), (2**63 - 1, "most"), (2**63 - 2, "almost")]
    hashed = lambda t: 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(t.encode(), 42) >> 63 else 0)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1]), r[1] or ""))
    want = Counter((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order))
    for each in (4, 5000):
        got = with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], rows_each=each).collect()
        assert Counter((r.doc_id, r.text, r.next_text) for r in got) == want, each


def test_language(spark):
    rng = random.Random(10)
    letters = {"en": "abcdefgh", "de": "ijklmnöp", "fr": "qrstuvéw"}
    docs = [(i, text(rng, rng.randint(1, 80), letters[lang]), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de", "fr"] * 80)]
    odd = [(900, None, "en", "s0"), (901, "", None, None), (902, "123 !!", "en", "s0"), (903, docs[1][1], None, None), (904, docs[2][1], "en", "s1"), (905, docs[1][1] * 500, "xx", "s9")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string").withColumnRenamed("lang", "lang")
    got = {r.doc_id: r for r in identify(df).collect()}
    assert sum(got[i].language == lang for i, _, lang, _ in docs) >= 0.99 * len(docs) and len(got) == len(docs) + len(odd)
    assert [got[i].language for i in (900, 901, 902, 903, 904, 905)] == ["und", "und", "und", "de", "fr", "de"]
    assert {r.doc_id for r in keep_identified(df).collect()} == set(got) - {900, 901, 902}
    assert identify(df.where("1=0")).collect() == [] and {r.language for r in identify(df.where("lang is null")).collect()} == {"und"}
    # held out: fitted on one half, tried on the other
    model = fit([(lang, t.encode()) for i, t, lang, _ in docs if i % 2])
    held = [(lang, model.text_terms(t.encode())[0]) for i, t, lang, _ in docs if not i % 2]
    assert sum(model.languages[int(x.argmax())] == lang for lang, x in held) > 0.98 * len(held)
    assert len(trigrams(b"...")) == 0 and len(trigrams("né".encode())) == 3


def test_other_text_is_rejected(spark):
    rng = random.Random(12)
    stems = {lang: [text(rng, 1) for _ in range(60)] for lang in ("en", "de", "fr", "es")}
    make = lambda lang, n: " ".join(rng.choice(stems[lang]) + rng.choice(stems[lang]) for _ in range(n))
    known = [(i, make(lang, rng.randint(3, 120)), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 60)]
    scripts = [[chr(c) for c in (*range(97, 123), *[32] * 5)], [chr(c) for c in (*range(0x430, 0x450), *[32] * 5)], [chr(c) for c in range(0x4E00, 0x9FFF)]]
    noise = ["".join(rng.choice(s) for _ in range(n)) for s in scripts for n in (40, 200, 2000) for _ in range(6)]
    # noise and an unmodelled language, undeclared and under a wrong label
    other = [(1000 + i, t, lang, "s") for i, (t, lang) in enumerate((t, lang) for t in [*noise, *(make("es", 40) for _ in range(20))] for lang in (None, "en"))]
    df = spark.createDataFrame(known + other, "doc_id long, text string, lang string, source string")
    model = fit([(lang, t.encode()) for _, t, lang, _ in known])
    got = {r.doc_id: r for r in identify(df, model=model).collect()}
    assert [got[i].language for i, _, lang, _ in known] == [lang for _, _, lang, _ in known]
    assert not any(got[i].kept or got[i].language != "und" for i, *_ in other)
    # a trigram that no language has seen favours none
    unseen = fit([("en", b"abcd " * 50 + b"%d" % i) for i in range(9)] + [("de", b"xyz")] * 1 + [("de", b"xyzz" + b"z" * i) for i in range(9)])
    terms, _ = unseen.text_terms("ñññ".encode())
    assert abs(float(terms[0] - terms[1])) < 1e-3


def test_pages_by_suffix_and_host(spark):
    rng = random.Random(14)
    letters = {"en": "abcdefgh", "de": "ijklmnöp"}
    make = lambda lang, n: text(rng, n, letters[lang])
    page = lambda lang, t: f"<html{lang and f' lang={lang}-x'}><body><article><p>{t}.</p></article></body></html>"
    urls = lambda lang: f"http://h{rng.randint(0, 5)}.{'site.' if lang == 'de' else ''}{lang if rng.random() < 0.9 else 'org'}:80/p"
    langs = ["en", "de", "de"] * 40
    rows = [(i, urls(x), page(x, make(x, 25))) for i, x in enumerate(langs)]
    # half of each language: suffix and host decide
    mixed = make("en", 1)[:3].ljust(3, "a") + " " + make("de", 1)[:3].ljust(3, "i")
    rows += [(500 + i, u, page("", mixed)) for i, u in enumerate(["http://new.en/", "https://new.de", None, "http://10.0.0.1/x", "http://h1.org/"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r for r in page_texts(df).collect()}
    assert [(texts[i].host, texts[i].suffix) for i in range(500, 505)] == [("new.en", "en"), ("new.de", "de"), (None, None), ("10.0.0.1", None), ("h1.org", "org")]
    assert [texts[i].declared for i in range(len(langs))] == langs and texts[500].declared is None and texts[500].text.startswith(mixed)
    got = {r.page_id: r for r in identify_pages(df).collect()}
    model = fit([(r.declared, r.text.encode()) for r in texts.values()])
    # brute force over the rows
    terms = {}
    for i, r in texts.items():
        x, _ = model.with_other(r.text.encode(), r.declared)
        terms[i] = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for i, r in texts.items():
        sums = lambda keep: sum((terms[j] for j, q in texts.items() if keep(q)), np.zeros(3))  # noqa: B023, E731
        prior = (sums(lambda q: True) + 1) / (len(texts) + 3)
        if r.suffix:
            s = sums(lambda q: q.suffix == r.suffix)  # noqa: B023
            prior = (s + 10 * prior) / (s.sum() + 10)
        if r.host:
            s = sums(lambda q: q.host == r.host)  # noqa: B023
            prior = (s + 10 * prior) / (s.sum() + 10)
        want = terms[i] * prior
        assert abs(got[i].posterior - want.max() / want.sum()) < 1e-6
        assert got[i].language == ["de", "en", "und"][int(want.argmax())]
    spark.createDataFrame([(1, "abc", "en", "s")] * 5, "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(f"{(folder := shared_path(spark, 't-li'))}/documents.parquet")
    df.write.parquet(f"{folder}/pages.parquet")
    every = op10_language_id(spark, folder).collect()
    assert sum(r.doc_id == 1 and r.page_id is None for r in every) == 5 and sorted(r.page_id for r in every if r.doc_id is None) == sorted(texts)


def test_rare_language_is_known_at_any_size(spark):
    rng = random.Random(13)
    letters = {"en": "abcdefgh", "de": "ijklmnöp", "fr": "qrstuvéw"}
    langs = ["en", "de"] * 1500 + ["fr"] * 6 + ["xx"] * 2
    df = spark.createDataFrame([(i, text(rng, 12, letters.get(x, "yz")), x) for i, x in enumerate(langs)], "doc_id long, text string, lang string")
    model = train(df, "doc_id", "text", "lang", sample=60)
    assert model.languages == ["de", "en", "fr"]
    fresh_rows = [(x, text(rng, 20, letters[x])) for x in letters for _ in range(20)]
    assert all(model.languages[int(model.text_terms(t.encode())[0].argmax())] == x for x, t in fresh_rows)
    # the sample's table of declarations is in proportion to all rows
    assert model.declared[1, 1] > model.declared[2, 2] > model.declared[1, 2]


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    item, passage = text(rng, 30), text(rng, 60)
    base = [text(rng, 120) for _ in range(30)]
    docs = [(i, t, "en", "s") for i, t in enumerate(base)]
    near = base[0].split()
    near[50] = "changed"
    docs += [(100, base[1], "en", "s"), (101, " ".join(near), "en", "s"), (102, text(rng, 50) + " " + item + " " + text(rng, 20), "en", "s"), (103, passage + " " + text(rng, 90), "en", "s"), (104, text(rng, 70) + " " + passage + " " + text(rng, 40), "en", "s"), (105, "12 34", "en", "s"), (106, None, "en", "s")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(range(30)) | {103, 104}
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = {r.doc_id: r for r in df.collect()}
    assert passage in rows[103].text and passage not in rows[104].text and rows[104].n_chars == len(rows[104].text)
    assert all(rows[i].text == base[i] for i in range(30))
    assert len({r.sequence_id for r in out}) <= 40


def test_pipeline_with_odd_rows_and_columns(spark, tmp_path):
    rng = random.Random(31)
    item = text(rng, 12)
    base = [text(rng, 40) for _ in range(12)]
    rows = [(i, t, "en") for i, t in enumerate(base)]
    rows += [(None, base[0], "en"), (None, None, None), (20, None, "en"), (21, "", None), (22, base[3], "en"), (5, base[5], "en"), (23, text(rng, 9) + " " + item.upper(), "en"), (24, text(rng, 30_000), "en")]
    names = ["key", "terms", "bands", "removed", "_key", "_id", "codes", "item_id", "a", "_gridloom_path"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = [(i, t, lang, None, None if t is None else len(t), *names) for i, t, lang in rows]
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, base[1]), (2, None), (3, " ")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.dtypes == spark.read.parquet(f"{tmp_path}/documents.parquet").dtypes
    left = df.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == sorted([(False, i) for i in (*range(12), 5, 24)] + [(True, 0)] * 2)
    assert all([r[n] for n in names] == names for r in left)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {None, *range(12), 24} and sum(r.start == 0 for r in packed) == len(left)
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
