"""Main text of pages by a tree-structured graphical model (operator 4).

Each node of a page's tree (block elements and text blocks) has a label,
content or not. A node's own potential is log-linear in features of its tag,
names, length, links and place; a potential for each kind of edge joins parent
and child. Sum-product messages go up from the leaves and down from the root,
which is exact on a tree, and give each node's content marginal. Text blocks
with a marginal above one half make up the main text.

Weights maximise the likelihood of labelled pages (``html_pages``): the
gradient is the features as labelled less the features as the messages expect
them. Training happens once per session, on the driver.

Text: character references decoded, white space of a block one blank, blocks
in page order joined by one newline. Nothing is capped. Rows: null or empty
html has an empty text. Repeated rows each get their text.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small
from .html_pages import KINDS, labelled_pages
from .html_tree import Node, attributes, parse

#: Pages, passes and step of the training.
PAGES, PASSES, STEP = 400, 10, 0.1

_KIND_OF = {name: kind for kind, names in KINDS.items() for name in names}
_WORD = re.compile(r"[a-z]+")
_CONTENT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th blockquote pre dd dt figcaption label button legend summary caption".split())


@functools.lru_cache(20_000)
def _name_features(tag: str, attrs: str) -> tuple[str, ...]:
    """Features of an element alone."""
    out = ["tag=" + tag]
    if attrs:
        a = attributes(attrs)
        kinds = set()
        for key in ("class", "id", "role", "aria-label", "itemprop"):
            for token in a.get(key, "").lower().split():
                if token in _KIND_OF:
                    kinds.add("is=" + _KIND_OF[token])
                kinds.update("has=" + _KIND_OF[w] for w in _WORD.findall(token) if w in _KIND_OF)
        out += sorted(kinds)
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
            out.append("hidden")
    return tuple(out)


def features(nodes: list[Node]) -> tuple[list[tuple[str, ...]], list[str]]:
    """Features of each node, and the kind of its edge to the parent."""
    n = len(nodes)
    chars, links, heads, paragraphs = [x.chars for x in nodes], [x.link_chars for x in nodes], [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        links[p] += links[i]
        heads[p] |= nodes[i].tag == "h1" or (nodes[i].tag == "header" and heads[i])
        paragraphs[p] += nodes[i].tag == "p"
    feats, edges = [], []
    for i, node in enumerate(nodes):
        if node.tag == "#text":
            above = nodes[node.parent].tag
            words = node.text.count(" ") + 1
            share = node.link_chars / node.chars
            feats.append((
                "text", f"in={above if above in _CONTENT_TAGS else 'box'}", f"words={0 if words < 4 else 1 if words < 12 else 2}",
                f"links={0 if share == 0 else 1 if share < 0.5 else 2}", *(("mark",) if node.text[0] in "©®" else ()),
            ))
            edges.append("leaf")
        else:
            mine = _name_features(node.tag, node.attrs)
            if node.tag not in _CONTENT_TAGS:
                share = chars[i] / max(1, chars[0])
                mine = (*mine, f"share={0 if share < 0.1 else 1 if share < 0.4 else 2}", f"linked={0 if not links[i] else 1 if 2 * links[i] < chars[i] else 2}", f"head={heads[i]}", f"ps={min(3, paragraphs[i])}", f"{node.tag}&head={heads[i]}")
            feats.append(mine)
            edges.append("list" if node.tag in ("li", "td", "tr", "tbody", "dd", "dt") else "block" if node.tag in _CONTENT_TAGS else "box")
    return feats, edges


class TreeModel:
    """Weights of features (log odds of content) and of edges by (parent, child) labels."""

    def __init__(self):
        self.unary: dict[str, float] = {}
        self.pair = {k: [0.5, -0.5, -0.5, 0.5] for k in ("leaf", "list", "block", "box")}

    def messages(self, nodes: list[Node], feats: list, edges: list[str]) -> tuple[list[float], list[tuple[float, ...]]]:
        """Content marginal of each node, and of each edge to the parent the four joint ones."""
        get, n = self.unary.get, len(nodes)
        table = {k: [math.exp(x) for x in w] for k, w in self.pair.items()}
        b0, b1 = [1.0] * n, [0.0] * n
        for i, f in enumerate(feats):
            s = 0.0
            for x in f:
                s += get(x, 0.0)
            b1[i] = math.exp(max(-30.0, min(30.0, s)))
        up0, up1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            t00, t01, t10, t11 = table[edges[i]]
            x0, x1 = b0[i], b1[i]
            z = x0 + x1
            x0, x1 = x0 / z, x1 / z
            b0[i], b1[i] = x0, x1
            m0, m1 = t00 * x0 + t01 * x1, t10 * x0 + t11 * x1
            z = m0 + m1
            m0, m1 = m0 / z, m1 / z
            up0[i], up1[i] = m0, m1
            p = nodes[i].parent
            # rescaled, so that thousands of children don't underflow
            y0, y1 = b0[p] * m0, b1[p] * m1
            z = y0 + y1
            b0[p], b1[p] = y0 / z, y1 / z
        z = b0[0] + b1[0]
        full = [(b0[0] / z, b1[0] / z)] * n
        joint: list[tuple[float, ...]] = [()] * n
        for i in range(1, n):
            t00, t01, t10, t11 = table[edges[i]]
            f0, f1 = full[nodes[i].parent]
            c0, c1 = f0 / up0[i], f1 / up1[i]
            j = (c0 * t00 * b0[i], c0 * t01 * b1[i], c1 * t10 * b0[i], c1 * t11 * b1[i])
            z = sum(j)
            joint[i] = (j[0] / z, j[1] / z, j[2] / z, j[3] / z)
            full[i] = (joint[i][0] + joint[i][2], joint[i][1] + joint[i][3])
        return [f[1] for f in full], joint

    def fit(self, pages: list[tuple[str, list[int]]], passes: int = PASSES, step: float = STEP) -> TreeModel:
        """Gradient ascent on the labelled pages' likelihood, a page at a time."""
        ready = []
        for page, labels in pages:
            nodes = parse(page)
            leaves = [i for i, x in enumerate(nodes) if x.tag == "#text"]
            if len(leaves) != len(labels):
                continue
            truth = [0] * len(nodes)
            for i, y in zip(leaves, labels, strict=True):
                truth[i] = y
            for i in range(len(nodes) - 1, 0, -1):
                truth[nodes[i].parent] |= truth[i]
            ready.append((nodes, *features(nodes), truth))
        total: dict[str, float] = {}
        pair_total = {k: [0.0] * 4 for k in self.pair}
        for k in range(passes):
            rate = step / (1 + 0.3 * k)
            for nodes, feats, edges, truth in ready:
                marginal, joint = self.messages(nodes, feats, edges)
                for i in range(len(nodes)):
                    d = rate * (truth[i] - marginal[i])
                    if abs(d) > 1e-4:
                        for f in feats[i]:
                            self.unary[f] = self.unary.get(f, 0.0) * (1 - 1e-4) + d
                    if i:
                        w, at = self.pair[edges[i]], 2 * truth[nodes[i].parent] + truth[i]
                        for q in range(4):
                            w[q] += 0.2 * rate * ((q == at) - joint[i][q])
            if 2 * k >= passes:
                # the mean over the later passes is steadier than the last step
                for f, x in self.unary.items():
                    total[f] = total.get(f, 0.0) + x / (passes - (passes + 1) // 2)
                for e, w in self.pair.items():
                    pair_total[e] = [x + y / (passes - (passes + 1) // 2) for x, y in zip(pair_total[e], w, strict=True)]
        if passes > 1:
            self.unary, self.pair = total, pair_total
        return self

    def text(self, page: str | None) -> str:
        """Main text of a page."""
        nodes = parse(page)
        if len(nodes) < 2:
            return ""
        marginal, _ = self.messages(nodes, *features(nodes))
        return "\n".join(x.text for x, m in zip(nodes, marginal, strict=True) if x.tag == "#text" and m > 0.5)


@functools.cache
def trained() -> TreeModel:
    """The model fitted on the labelled pages."""
    return TreeModel().fit(labelled_pages(PAGES))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", model: TreeModel | None = None) -> DataFrame:
    """``pages`` -> ``page_id, url, text, n_chars``, a row for each row."""
    model = model or trained()
    key_type = pages.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            texts = [model.text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return pages.select(key, F.col(url).cast("string").alias(url), F.col(html).cast("string")).mapInArrow(run, f"`{key}` {key_type}, `{url}` string, text string, n_chars long")
