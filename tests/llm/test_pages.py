"""Operators on pages: archives, main text, URL filters."""

import hashlib
import zlib

from gridloom.llm.common import shared_path
from gridloom.llm.files import write_file
from gridloom.llm.html_pages import labelled_pages
from gridloom.llm.html_text import extract, features, trained
from gridloom.llm.html_tree import parse
from gridloom.llm import urls as urls_module
from gridloom.llm.urls import RULES, filter_urls, judge
from gridloom.llm.warc import Gap, Record, archive, make_record, read_warc, salvage, write_warc

SCHEMA = "page_id long, url string, html string, payload_bytes string"


def record(i, body, refers=None):
    return make_record(i, f"http://h/{i}", body, hashlib.sha256(body).hexdigest(), refers)


def test_salvage_goes_on_after_damage():
    bodies = [b"one " * 40, b"two " * 50, b"three" * 60, b"four" * 40]
    parts = [record(i, b) for i, b in enumerate(bodies)]
    clean = b"".join(parts)
    assert [x.payload() for x in salvage(clean)] == bodies
    a, b = len(parts[0]), len(parts[0]) + len(parts[1])
    broken = bytearray(clean)
    broken[a + 60] ^= 0xFF
    got = list(salvage(bytes(broken)))
    assert [x.payload() for x in got if isinstance(x, Record)] == [bodies[0], bodies[2], bodies[3]]
    (gap,) = [x for x in got if isinstance(x, Gap)]
    assert (gap.start, gap.end) == (a, b)
    for cut in (clean[:-9], clean[:a] + b"junk\x1f\x8b\x08 WARC/1.1\r\n" + clean[a:], b"x" + clean, clean[5:]):
        got = list(salvage(cut))
        assert sum(isinstance(x, Gap) for x in got) == 1 and sum(isinstance(x, Record) for x in got) >= 3
    plain = b"".join(zlib.decompress(p, 31) for p in parts)
    assert [x.payload() for x in salvage(plain)] == bodies
    hurt = bytearray(plain)
    hurt[plain.index(b"two two")] ^= 1
    got = list(salvage(bytes(hurt)))
    assert [x.payload() for x in got if isinstance(x, Record)] == [bodies[0], bodies[2], bodies[3]]
    assert list(salvage(b"")) == [] and [type(x) for x in salvage(b"nothing here")] == [Gap]


def test_salvage_of_adjacent_damage_and_within_a_member():
    bodies = [bytes([97 + i]) * 400 + b"%d" % i * 30 for i in range(5)]
    plain = [zlib.decompress(record(i, b), 31) for i, b in enumerate(bodies)]

    def packed(content):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packer.compress(content) + packer.flush()

    ids = lambda data: [bodies.index(x.payload()) for x in salvage(data) if isinstance(x, Record)]
    # two members with a bad check sum, one after the other; the second holds a whole record
    parts = [bytearray(record(i, b)) for i, b in enumerate(bodies)]
    parts[1][60] ^= 0xFF
    parts[2][-6] ^= 0xFF
    assert ids(b"".join(parts)) == [0, 2, 3, 4]
    # a member of several records, of which the first, one in the middle or the last is bad
    for bad in (0, 2, 4):
        hurt = [bytearray(x) for x in plain]
        hurt[bad][-30] ^= 1
        data = packed(b"".join(hurt)) + record(0, bodies[0])
        assert ids(data) == [i for i in range(5) if i != bad] + [0]
        (gap,) = [x for x in salvage(data) if isinstance(x, Gap)]
        assert "digest differs" in gap.reason and gap.start == 0
    # and one that is also cut short
    hurt = [bytearray(x) for x in plain]
    hurt[1][-30] ^= 1
    assert ids(packed(b"".join(hurt))[:-4]) == [0, 2, 3, 4]


def test_archives(spark):
    same = "<p>" + "again " * 30
    rows = [(3, "http://a/é b\r\n", same, "x"), (1, None, None, "x"), (2, "u", "", "x"), (9, "u", same, "x"), (5, "u", same, "x"), (6, "u", "short", "x"), (7, "u", "short", "x"), (8, "u", "é" * 50, "x"), (10, "u", "é" * 50, "x"), (None, "u", same, "x")]
    got = archive(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[3].url == rows[0][1]
    for i, _, html, _ in rows:
        body = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert {i: by[i].refers_to for i in by} == {3: None, 1: None, 2: None, 9: 3, 5: 3, 6: None, 7: None, 8: None, 10: 8, None: 3}
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in got)
    assert archive(spark.createDataFrame([], SCHEMA)).collect() == []


def test_exact_urls(spark):
    urls = ["http://a/é", "x y", "http://a/%0A%10%C3%A9", "", " lead and trail ", "tab\there", "日本語?q=%", "http://a/" + "long-" * 420_000, "http://plain/ok?a=b&c=%20#f", None, "\x00\x7f"]
    df = spark.createDataFrame([(i, u, "<p>x") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert {r.page_id: r.url for r in archive(df).collect()} == dict(enumerate(urls))


def test_damaged_archive_is_logged(spark):
    folder = shared_path(spark, "t-warc")
    write_warc(spark.createDataFrame([(1, "u", "a" * 300, "")], SCHEMA), folder).collect()
    write_file(folder, "bad.warc.gz", b"garbage" + record(2, b"later " * 30))
    rows = read_warc(spark, folder).collect()
    assert sorted(r.page_id for r in rows if r.gap is None) == [1, 2]
    (gap,) = [r for r in rows if r.gap is not None]
    assert (gap.start, gap.end) == (0, 7) and gap.path.endswith("bad.warc.gz")


def test_model_holds_on_unseen_pages():
    model, right, total = trained(), 0, 0
    for page, labels in labelled_pages(150, seed=4242):
        nodes = parse(page)
        marginal, joint = model.messages(nodes, *features(nodes))
        found = [m > 0.5 for m, x in zip(marginal, nodes) if x.tag == "#text"]
        assert len(found) == len(labels) and all(abs(sum(j) - 1) < 1e-9 for j in joint[1:])
        right += sum(a == bool(b) for a, b in zip(found, labels))
        total += len(labels)
    assert right / total > 0.95


#: Pages written by hand, and what a reader would keep of each.
PAGES = {
"blog": ("""<!doctype html><html lang=en><head><meta charset=utf-8><title>On kettles</title><style>.x{color:red}</style></head><body>
<header class="site-header"><a href="/">My blog</a><nav><a href="/about">About</a><a href="/archive">Archive</a><a href="/feed">Feed</a></nav></header>
<main><article class="post"><h1>On kettles</h1><p class="byline">A kettle is a small thing, but it starts every morning in this house.</p>
<p>Mine is made of steel and holds a litre and a half. It whistles when it boils, which the cat does not like at all.</p>
<h2>What to look for</h2><ul><li>A lid that stays on when you pour.</li><li>A handle that stays cool on the stove.</li></ul>
<p>Buy one that you can open with one hand &mdash; the other one will be holding a cup.</p></article>
<section id="comments"><h3>3 comments</h3><div class="comment"><p>Great post, I have the same kettle at home!</p></div></section></main>
<aside class="sidebar"><h4>Related posts</h4><ul><li><a href="/p/1">On spoons</a></li><li><a href="/p/2">On cups</a></li></ul></aside>
<footer><p>&copy; 2024 My blog. All rights reserved.</p></footer></body></html>""",
"On kettles\nA kettle is a small thing, but it starts every morning in this house.\nMine is made of steel and holds a litre and a half. It whistles when it boils, which the cat does not like at all.\nWhat to look for\nA lid that stays on when you pour.\nA handle that stays cool on the stove.\nBuy one that you can open with one hand — the other one will be holding a cup."),
"divs": ("""<html><body><div id="top"><div class="menu"><a href=/1>Home</a> | <a href=/2>News</a> | <a href=/3>Sport</a></div></div>
<div id="wrap"><div class="content"><h1>River bridge opens again</h1><div>The old bridge over the river was opened again on Monday after two years of work.</div>
<div>Some 400 people came to walk across it, and the mayor cut a ribbon in the rain.</div><div>The work cost less than planned, the council said, and the lamps will follow in spring.</div></div>
<div class="ad-banner"><a href="http://ads.example/x">Cheap flights! Book now!</a></div></div>
<div class="newsletter"><form><label>Sign up for our newsletter</label><input name=mail><button>Subscribe</button></form></div>
<div id="footer">Contact | Imprint | Privacy</div></body></html>""",
"River bridge opens again\nThe old bridge over the river was opened again on Monday after two years of work.\nSome 400 people came to walk across it, and the mayor cut a ribbon in the rain.\nThe work cost less than planned, the council said, and the lamps will follow in spring."),
"cookies": ("""<body><div class="cookie-banner" role="dialog"><p>We use cookies to improve your experience on our site. <button>Accept</button></p></div>
<nav class="nav"><ul><li><a href="/de">Start</a></li><li><a href="/de/b">Kontakt</a></li></ul></nav>
<article><h1>Brot backen</h1><p>Für ein gutes Brot braucht man Mehl, Wasser, Salz und vor allem sehr viel Zeit.</p><p>Der Teig ruht &uuml;ber Nacht im K&#252;hlschrank und wird am Morgen bei gro&szlig;er Hitze gebacken.</p></article>
<footer>Impressum</footer><script>if (a < b) { document.write("<p>Hello there</p>") }</script></body>""",
"Brot backen\nFür ein gutes Brot braucht man Mehl, Wasser, Salz und vor allem sehr viel Zeit.\nDer Teig ruht über Nacht im Kühlschrank und wird am Morgen bei großer Hitze gebacken."),
"empty": ("<html><body><nav><a href='/a'>Home</a><a href='/b'>Login</a></nav><footer><a href='/c'>Imprint</a></footer></body></html>", ""),
}


def test_pages_written_by_hand():
    for name, (html, want) in PAGES.items():
        assert trained().text(html) == want, name


def test_messages_are_exact():
    """Marginals of a small tree by enumeration."""
    import itertools
    import math

    model = trained()
    nodes = parse("<div class='ad'>x y z<p>one two three four</div><article><p>text here.<p>more</article>")
    feats, edges = features(nodes)
    marginal, _ = model.messages(nodes, feats, edges)
    total, ones = 0.0, [0.0] * len(nodes)
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        s = sum(y * sum(model.unary.get(f, 0.0) for f in fs) for y, fs in zip(labels, feats))
        s += sum(model.pair[edges[i]][2 * labels[nodes[i].parent] + labels[i]] for i in range(1, len(nodes)))
        w = math.exp(s)
        total += w
        for i, y in enumerate(labels):
            ones[i] += w * y
    assert all(abs(a - b / total) < 1e-6 for a, b in zip(marginal, ones))


def test_main_text(spark):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</div><article><h1>A &amp; B</h1><p>First\n  part<br>goes <b>on</b> here and there.<p>Second &lt;part&gt; of it all.</article><div class="comments"><p>I do not like it at all.</p></div><footer>&copy; me</footer></body></html>'
    rows = [(1, "u", page, ""), (2, None, None, ""), (3, "u", "", ""), (4, "u", "<div>" * 20_000 + "deep", ""), (5, "u", "<p" + "'" * 3000, ""), (6, "u", "<article><p>" + "long text here. " * 100_000, "")]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1].text == "A & B\nFirst part goes on here and there.\nSecond <part> of it all." and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" == got[3].text and got[6].n_chars == 1_599_999 and len(got) == 6
    assert extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_urls(spark):
    urls = ["http://a.net/x", "https://WWW.Example.NET/en/1", "http://net", "http://example.com/de/", "http://xexample.com/de/", "ftp://q.org/fr/?a://b", "nothing", None, "", "http://bad.com/p/?utm_source=z#f", "https://m.bad.com/p", "http://bad.com/p?q=1", "http://good.com/p", "http://good.com/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("http://www.bad.com/p",), ("x://z.com",), (None,)], "url string")
    got = {r.page_id: r for r in judge(pages, listed, RULES).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["net/", "example.net/en/", None, "example.com/de/", None, "org/fr/", *[None] * 8]
    assert [got[i].verdict for i in range(len(urls))] == ["block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "block", "block", "allow", "allow", "allow"]
    assert (got[1].host, got[1].path, got[5].path, got[6].host, got[7].path) == ("www.example.net", "/en/1", "/fr/", "", "")
    assert filter_urls(pages, listed, RULES).count() == len(urls) - 4
    many = spark.range(3000).selectExpr("concat('http://h', id, '.com/') url")
    hits = judge(spark.range(6000).selectExpr("id page_id", "concat('https://www.h', id, '.com') url"), many, [])
    assert hits.where("listed").count() == 3000 and hits.where("listed and page_id >= 3000").count() == 0
    # a filter of two bits a key lets many others pass; the exact join stops them, however the filter is sent
    for most in (urls_module.MOST_BLOCKS, 0):
        few = judge(spark.range(6000).selectExpr("id page_id", "concat('https://www.h', id, '.com') url"), many, [], bits_per_key=2, most_blocks=most)
        got = few.groupBy("listed", "maybe").count().collect()
        count = {(r.listed, r.maybe): r["count"] for r in got}
        assert count[True, True] == 3000 and count[False, True] > 100 and count[False, True] + count[False, False] == 3000
    clash = spark.createDataFrame([(1, "http://bad.com/p", "c", "b", "w")], "page_id long, url string, canon string, block string, w0 string")
    assert filter_urls(clash, listed, RULES).collect() == [] and filter_urls(clash, listed.where("1=0"), []).columns == clash.columns
    assert judge(pages.where("1=0"), listed.where("1=0"), RULES).collect() == []
