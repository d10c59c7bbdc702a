"""Labelled pages that the extraction model is trained on.

Pages are made from layout parts in random order and markup: each part is
written with the names that web templates commonly give it. A text block of
the article is labelled 1, any other 0.
"""

from __future__ import annotations

import random

# Names that web templates give to the parts of a page.
NAMES = {
    "menu": "nav navbar navigation menu main-menu site-nav topnav nav-links menubar breadcrumb breadcrumbs pagination pager tabs toc skip-links",
    "header": "header site-header page-header masthead topbar top-bar branding logo site-title tagline head-bar",
    "footer": "footer site-footer page-footer colophon bottom-bar copyright legal foot footer-links credits",
    "side": "sidebar side-bar aside widget widgets widget-area right-column left-column rail secondary related related-posts recommended more-stories trending popular tag-cloud also-read",
    "notice": "cookie cookie-banner cookie-notice consent gdpr notice alert banner popup modal overlay toast privacy-notice announcement paywall message",
    "ad": "ad ads advert advertisement ad-slot ad-box adsense sponsor sponsored promo promotion promoted banner-ad commercial",
    "form": "form search search-form login signup newsletter subscribe subscription contact-form register poll",
    "comment": "comments comment comment-list comment-body commentlist discussion disqus replies reply responses reader-comments user-comments respond",
    "share": "share social share-buttons social-links sharing follow toolbar byline-tools print",
    "article": "article post entry story article-body post-content entry-content story-body content main main-content post-body article-content news-text body-text hentry page-content blog-post",
}
KINDS = {k: v.split() for k, v in NAMES.items()}
_TAGS = {
    "menu": ["nav", "nav", "ul", "div", "div", "ol"],
    "header": ["header", "header", "div", "section"],
    "footer": ["footer", "footer", "div", "section"],
    "side": ["aside", "aside", "div", "section", "ul"],
    "notice": ["div", "div", "section", "aside", "p", "dialog"],
    "ad": ["div", "div", "aside", "section", "p", "ins"],
    "form": ["form", "form", "div", "section"],
    "comment": ["div", "section", "ol", "ul", "div"],
    "share": ["div", "ul", "div"],
}


class Maker:
    """One random page with labels."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []
        self.vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def words(self, a: int, b: int, stop: bool = True) -> str:
        n = self.rng.randint(a, b)
        s = " ".join(self.rng.choice(self.vocab) for _ in range(n)).capitalize()
        return s + ("." if stop else "")

    def text(self, s: str, label: int) -> None:
        """Write a text block of its own."""
        self.out.append(s)
        self.labels.append(label)

    def open(self, kind: str) -> str:
        rng, tag = self.rng, self.rng.choice(_TAGS[kind])
        how = rng.random()
        name = rng.choice(KINDS[kind])
        bare = tag in ("nav", "header", "footer", "aside", "form") and how < 0.5
        attr = "" if bare else f' id="{name}"' if how > 0.8 else f' class="{name}{rng.choice(["", " wide", " box clearfix"])}"'
        self.out.append(f"<{tag}{attr}>")
        return tag

    def links(self, n: int) -> None:
        rng = self.rng
        listed = rng.random() < 0.8
        self.out.append("<ul>" if listed else "")
        for _ in range(n):
            self.out.append("<li>" if listed else "<div>")
            w = self.words(1, 4, rng.random() < 0.2)
            self.text(f'<a href="/{w[:5]}">{w}</a>', 0)
            self.out.append("</li>" if listed else "</div>")
        self.out.append("</ul>" if listed else "")

    def part(self, kind: str) -> None:
        """One part of a page that is not the article."""
        rng = self.rng
        tag = self.open(kind)
        if tag in ("ul", "ol"):
            for _ in range(rng.randint(1, 6)):
                self.out.append("<li>")
                w = self.words(1, 5, False) if kind != "comment" else self.words(5, 60)
                self.text(f'<a href="#">{w}</a>' if kind in ("menu", "side", "share") else w, 0)
                self.out.append("</li>")
        elif kind in ("menu", "share") or (kind in ("side", "footer", "header") and rng.random() < 0.5):
            if kind == "side" and rng.random() < 0.6:
                self.out.append("<h3>")
                self.text(self.words(1, 4, False), 0)
                self.out.append("</h3>")
            self.links(rng.randint(1, 7))
        elif kind == "form":
            if rng.random() < 0.7:
                self.out.append("<label>")
                self.text(self.words(1, 8), 0)
                self.out.append("</label>")
            self.out.append('<input type="text"><button>')
            self.text(self.words(1, 2, False), 0)
            self.out.append("</button>")
        elif kind == "comment":
            for _ in range(rng.randint(1, 5)):
                inner = rng.choice(["div", "div", "article", "li", "li", "p", "p", "section"])
                self.out.append(f"<{inner}{rng.choice(['', ' class=\"comment\"', ' class=\"reply\"'])}>")
                self.text(self.words(3, 70), 0)
                if inner not in ("p",) and rng.random() < 0.5:
                    self.out.append("<p>")
                    self.text(self.words(3, 60), 0)
                    self.out.append("</p>")
                self.out.append(f"</{inner}>")
        else:
            for _ in range(rng.randint(1, 3)):
                inner = rng.choice(["", "p", "div", "p"]) if tag != "p" else ""
                self.out.append(f"<{inner}>" if inner else "")
                self.text(self.words(1, 60 if kind in ("notice", "side", "ad") else 20, rng.random() < 0.8), 0)
                self.out.append(f"</{inner}>" if inner else "")
                if not inner:
                    break
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        rng = self.rng
        wrap = []
        if rng.random() < 0.5:
            wrap.append(rng.choice(["main", "div", "section"]))
            self.out.append(f"<{wrap[-1]}{rng.choice(['', ' id=\"content\"', ' class=\"container\"', ' class=\"main-content\"'])}>")
        tag = rng.choice(["article", "article", "div", "section", "div"])
        wrap.append(tag)
        bare = tag == "article" and rng.random() < 0.6
        self.out.append(f"<{tag}>" if bare else f'<{tag} {rng.choice(["class", "class", "id"])}="{rng.choice(KINDS["article"])}">')
        if rng.random() < 0.9:
            header = rng.random() < 0.25
            self.out.append("<header>" if header else "")
            self.out.append("<h1>")
            self.text(self.words(1, 12, rng.random() < 0.3), 1)
            self.out.append("</h1>")
            self.out.append("</header>" if header else "")
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9, 14, 14, rng.randint(20, 120)])):
            kind = rng.random()
            if kind < 0.75:
                inner = rng.choice(["p", "p", "p", "p", "div"])
                s = self.words(1, rng.choice([4, 30, 150]), rng.random() < 0.65)
                if rng.random() < 0.2:
                    s = f'<b>{s}<br>' if rng.random() < 0.5 else s + f' <a href="/x">{self.words(1, 4, False)}</a> ' + self.words(2, 20)
                self.out.append(f"<{inner}>")
                self.text(s, 1)
                self.out.append(f"</{inner}>" if rng.random() < 0.8 or inner != "p" else "")
            elif kind < 0.82:
                self.out.append("<h2>")
                self.text(self.words(1, 8, False), 1)
                self.out.append("</h2>")
            elif kind < 0.88:
                self.out.append("<ul>")
                for _ in range(rng.randint(1, 5)):
                    self.out.append("<li>")
                    self.text(self.words(1, 20, rng.random() < 0.5), 1)
                    self.out.append("</li>")
                self.out.append("</ul>")
            elif kind < 0.91:
                self.out.append("<blockquote>")
                self.text(self.words(4, 50), 1)
                self.out.append("</blockquote>")
            elif kind < 0.93:
                self.out.append("<table><tr><td>")
                self.text(self.words(1, 6, False), 1)
                self.out.append("</td><td>")
                self.text(self.words(1, 6, False), 1)
                self.out.append("</td></tr></table>")
            else:
                self.part(rng.choice(["ad", "ad", "share", "form", "side", "notice", "menu"]))
        if rng.random() < 0.25:
            self.part(rng.choice(["comment", "share", "side", "footer"]))
        for tag in reversed(wrap):
            self.out.append(f"</{tag}>")

    def page(self) -> tuple[str, list[int]]:
        rng = self.rng
        before = [k for k, p in (("notice", 0.3), ("header", 0.5), ("menu", 0.75), ("form", 0.25), ("ad", 0.4), ("menu", 0.2), ("side", 0.2)) if rng.random() < p]
        after = [k for k, p in (("ad", 0.2), ("comment", 0.45), ("share", 0.2), ("side", 0.4), ("form", 0.2), ("footer", 0.8), ("notice", 0.15)) if rng.random() < p]
        if rng.random() < 0.5:
            rng.shuffle(before)
            rng.shuffle(after)
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>")
        box = rng.random() < 0.3
        self.out.append('<div class="wrapper">' if box else "")
        for k in before:
            self.part(k)
        self.article()
        for k in after:
            self.part(k)
        self.out.append("</div>" if box else "")
        if rng.random() < 0.9:
            self.out.append("</body></html>")
        return "".join(self.out), self.labels


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[int]]]:
    """``n`` pages, each with a label for each text block in page order."""
    return [Maker(random.Random(f"{seed}-{i}")).page() for i in range(n)]
