"""Main text of web pages by a tree-shaped graphical model over the DOM.

Every block element of a page and every run of text in it is a node that is content or not.  A node's
own potential comes from what it looks like (tag, names in class and id, amount of text and links,
place); a potential on every edge says how parents and children go together.  Messages
go up from the leaves and down from the root, and their products give the exact probability of content at
every node.  Both kinds of potential are trained, by the gradient of the likelihood, on
labelled pages.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import batches, picked

SAMPLE_PAGES = 60
EPOCHS = 120
RATE = 0.3
SHRINK = 1e-4
CUTOFF = 0.5
MAX_LABELLED_BYTES = 200_000

# Fixed values of HTML: elements that have no content, hold no markup, or begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
SILENT = frozenset("head script style title textarea noscript template iframe svg math select button object canvas audio video datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul "
    "caption".split()
)
IN_HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag on the left ends open elements on the right, up to the nearest of those after the bar.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
ENDS_P = BLOCK - {"html", "body", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}

TAG = re.compile(r"""<(?:!--(.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    """A block element, or with ``text`` a run of text directly in one."""

    tag: str
    parent: int
    names: tuple[str, ...] = ()
    text: str | None = None
    words: int = 0
    linked: int = 0
    marked: bool | None = None
    children: list[int] = field(default_factory=list)


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; silent elements leave nothing.  Broken markup is read as far as it goes."""
    nodes = [Node("html", -1)]
    open_: list[tuple[str, int, bool]] = [("html", 0, False)]  # tag, its block node, whether in a link
    silent = 0  # depth in the stack below which nothing is text
    pieces: list[str] = []
    linked_words = 0

    def end_run() -> None:
        nonlocal linked_words
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                owner = open_[-1][1]
                nodes.append(Node("#text", owner, text=text, words=text.count(" ") + 1, linked=linked_words))
                nodes[owner].children.append(len(nodes) - 1)
        linked_words = 0

    def add_text(raw: str) -> None:
        nonlocal linked_words
        if silent or not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if open_[-1][2]:
            linked_words += len(text.split())

    def close(depth: int) -> None:
        nonlocal silent
        if any(tag in BLOCK for tag, _, _ in open_[depth:]):
            end_run()
        del open_[depth:]
        if silent and len(open_) <= silent:
            silent = 0

    def close_implied(ends: set[str], limits: set[str]) -> None:
        for depth in range(len(open_) - 1, 0, -1):
            if open_[depth][0] in limits:
                break
            if open_[depth][0] in ends:
                close(depth)

    at = 0
    while True:
        found = TAG.search(page, at)
        add_text(page[at : found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        name = found[3] or found[6]
        if not name:
            continue
        name, closing, rest = name.lower(), found[2] or found[5], found[4] or found[7] or ""
        if closing:
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth][0] == name:
                    close(depth)
                    break
            continue
        if name == "br" or name == "hr":
            if name == "hr":
                end_run()
            else:
                add_text(" ")
            continue
        if name in VOID or name == "html":
            continue
        if open_[-1][0] == "head" and name not in IN_HEAD:
            close(len(open_) - 1)
        if name in ENDS_P:
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth][0] == "p":
                    close(depth)
                    break
                if open_[depth][0] in BLOCK:
                    break
        if name in IMPLIED:
            close_implied(*IMPLIED[name])
        if name in HEADINGS and open_[-1][0] in HEADINGS:
            close(len(open_) - 1)
        if name in RAW:
            # Nothing in it is markup; its text is shown nowhere in the main text.
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            stop = page.find(">", end.start()) if end else -1
            at = stop + 1 if stop >= 0 else len(page)
            continue
        if rest.endswith("/") and name not in BLOCK:
            continue
        owner, in_link = open_[-1][1], open_[-1][2]
        if name in BLOCK:
            end_run()
            if not silent:
                names, marked = _names(rest)
                nodes.append(Node(name, owner, names, marked=marked))
                nodes[owner].children.append(len(nodes) - 1)
                owner = len(nodes) - 1
        open_.append((name, owner, in_link or name == "a"))
        if name in SILENT and not silent:
            silent = len(open_) - 1
    end_run()
    for k in range(len(nodes) - 1, 0, -1):
        nodes[nodes[k].parent].words += nodes[k].words
        nodes[nodes[k].parent].linked += nodes[k].linked
    return nodes


def _names(rest: str) -> tuple[tuple[str, ...], bool | None]:
    """Words of class, id and role, and the label of a labelled page (data-main="1" or "0")."""
    if "=" not in rest:
        return (), None
    found = []
    for match in ATTRIBUTE.finditer(rest):
        value = match[2] or match[3] or match[4] or ""
        found += [part.lower() for part in NAME_PART.findall(value) if len(part) > 1]
    label = re.search(r'data-main="([01])"', rest)
    return tuple(dict.fromkeys(found)), None if label is None else label[1] == "1"


# ---- the model --------------------------------------------------------------------------


def features(nodes: list[Node], plain_tags: bool = False) -> list[list[str]]:
    """What each node looks like.  With ``plain_tags`` elements that name their own role count as div."""
    total = max(1, nodes[0].words)
    before = 0
    out = []
    for node in nodes:
        tag = "div" if plain_tags and node.tag in ROLE_TAGS else node.tag
        size = min(8, node.words.bit_length())
        links = 0 if not node.linked else 1 + min(2, 3 * node.linked // max(1, node.words))
        kind = "text" if node.text is not None else "block"
        own = [f"{kind}", f"tag {tag}", f"{kind} size {size}", f"{kind} links {links}", f"{kind} place {min(3, 4 * before // total)}"]
        own += [f"name {name}" for name in node.names]
        if node.text is not None:
            ends = sum(node.text.count(mark) for mark in ".!?")
            own.append(f"sentences {min(3, ends)}")
            if "©" in node.text:
                own.append("copyright")
            parent = nodes[node.parent]
            own.append(f"in {'div' if plain_tags and parent.tag in ROLE_TAGS else parent.tag}")
            before += node.words
        out.append(own)
    return out


ROLE_TAGS = frozenset("article main nav aside footer header section form".split())


@dataclass
class Model:
    """Weights of a node's looks for content, and of an edge by kind and by the labels of parent and child."""

    looks: dict[str, float] = field(default_factory=dict)
    edges: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 2)))

    def marginals(self, nodes: list[Node], looks: list[list[str]]) -> tuple[list[float], list[tuple[float, float, float, float]], float]:
        """Probability of content at each node, of the four label pairs at each edge, and the log of the sum over all labellings."""
        weight = self.looks.get
        own = [sum(weight(f, 0.0) for f in fs) for fs in looks]
        edges = self.edges.tolist()
        count = len(nodes)
        # Upward: below0/1 is the log of all labellings of a subtree given its top label.
        below0, below1 = [0.0] * count, own[:]
        up0, up1 = [0.0] * count, [0.0] * count
        for k in range(count - 1, 0, -1):
            (e00, e01), (e10, e11) = edges[nodes[k].text is not None]
            b0, b1 = below0[k], below1[k]
            up0[k] = _log_add(b0 + e00, b1 + e01)
            up1[k] = _log_add(b0 + e10, b1 + e11)
            parent = nodes[k].parent
            below0[parent] += up0[k]
            below1[parent] += up1[k]
        whole = _log_add(below0[0], below1[0])
        # Downward: above0/1 is the log of everything outside the subtree given its top label.
        above0, above1 = [0.0] * count, [0.0] * count
        chance = [0.0] * count
        chance[0] = math.exp(below1[0] - whole)
        pairs = [(0.0, 0.0, 0.0, 0.0)] * count
        for k in range(1, count):
            parent = nodes[k].parent
            (e00, e01), (e10, e11) = edges[nodes[k].text is not None]
            out0 = above0[parent] + below0[parent] - up0[k]
            out1 = above1[parent] + below1[parent] - up1[k]
            above0[k] = _log_add(out0 + e00, out1 + e10)
            above1[k] = _log_add(out0 + e01, out1 + e11)
            chance[k] = math.exp(min(0.0, above1[k] + below1[k] - whole))
            b0, b1 = below0[k], below1[k]
            pairs[k] = (
                math.exp(out0 + e00 + b0 - whole), math.exp(out0 + e01 + b1 - whole),
                math.exp(out1 + e10 + b0 - whole), math.exp(out1 + e11 + b1 - whole),
            )
        return chance, pairs, whole

    def text(self, page: str, cutoff: float = CUTOFF) -> str:
        """Runs of text that are probably content, joined by empty lines."""
        nodes = parse(page)
        if len(nodes) == 1:
            return ""
        chance, _, _ = self.marginals(nodes, features(nodes))
        return "\n\n".join(n.text for n, p in zip(nodes, chance, strict=True) if n.text is not None and p > cutoff)


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


# ---- labelled pages ---------------------------------------------------------------------

BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement banner sponsor promo comment comments reply replies respond nav menu navbar breadcrumb footer header "
    "sidebar aside widget cookie consent notice share social related recommended newsletter subscribe signup login form search pagination "
    "toolbar copyright".split()
)
BOILERPLATE_TAGS = frozenset("nav aside footer form menu dialog search".split())


def labels(nodes: list[Node]) -> list[int] | None:
    """Content or not for every node of a page that tells it itself, else None.

    A labelled page carries data-main marks, which hold for what is inside.  Of other pages those
    with exactly one ``article`` or one ``main`` element with text count as labelled: inside is
    content but for elements whose tag or names say otherwise, outside is none.
    """
    marked = any(n.marked is not None for n in nodes)
    roots: list[int] = []
    for tag in ("article", "main"):
        found = [k for k, n in enumerate(nodes) if n.tag == tag]
        if len(found) == 1 and nodes[found[0]].words and not roots:
            roots = found
    if not marked and not roots:
        return None
    out = [0] * len(nodes)
    for k, node in enumerate(nodes):
        inherited = out[node.parent] if k else 0
        if marked:
            out[k] = inherited if node.marked is None else int(node.marked)
        elif k in roots:
            out[k] = 1
        elif inherited:
            out[k] = int(node.tag not in BOILERPLATE_TAGS and not BOILERPLATE_NAMES & set(node.names))
    return out


def example_pages() -> list[str]:
    """Labelled pages of common shapes: the layout varies, the sentences are filler."""
    line = "The quiet harbour opened early and the boats left before the wind had turned to the north."
    more = "Nobody had expected the long road to be clear, yet it was, and the carts moved on without a stop."
    title = "<h1>Boats leave early</h1>"
    body = f"<p>{line} {more}</p><p>{more}</p><h2>Later</h2><p>{line}</p><ul><li>{line}</li><li>{more}</li></ul><blockquote>{more}</blockquote>"
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "About us", "Contact"))
    related = "".join(f'<li><a href="/{k}">{line[: 30 + 9 * k]}</a></li>' for k in range(4))
    comment = f'<div class="comment"><span class="author">Reader</span><p>{more} I do not agree with any of it.</p></div>'
    form = '<form><label>Name</label><input name="n"><label>Your message to the editors</label><p>All fields are needed.</p></form>'
    foot = "<p>&copy; Harbour Press. All rights reserved.</p><a href='/t'>Terms</a> <a href='/p'>Privacy</a>"
    cookie = f"We use cookies to make this site work. {more[:40]} <a href='/c'>Settings</a>"
    ad = "Buy two lamps, get one free. Offer ends on Sunday."
    pages = [
        f"<nav><ul>{links}</ul></nav><div class='ad'>{ad}</div><article data-main='1'>{title}{body}</article><footer>{foot}</footer>",
        f"<header><div class='logo'>Harbour</div><ul class='menu'>{links}</ul></header><div id='content'><div class='post-content' data-main='1'>{title}{body}</div>"
        f"<div class='related'><h3>Related</h3><ul>{related}</ul></div></div><div class='sidebar'><h3>Latest</h3><ul>{related}</ul><p>{ad}</p></div><div id='footer'>{foot}</div>",
        f"<div class='cookie-notice'>{cookie}</div><main><article data-main='1'>{title}{body}<aside data-main='0'><p>{ad}</p></aside><p>{line}</p></article>"
        f"<section id='comments'><h3>Comments</h3>{comment}{comment}{form}</section></main><footer>{foot}</footer>",
        f"<div id='nav'>{links}</div><table><tr><td class='left'><ul>{related}</ul></td><td class='entry' data-main='1'>{title}{body}</td><td class='ads'><p>{ad}</p></td></tr></table><div class='copyright'>{foot}</div>",
        f"<div class='topbar'>{ad}</div><div class='breadcrumbs'><a href='/'>Home</a> &gt; <a href='/n'>News</a></div><div class='story'><div data-main='1'>{title}{body}</div>"
        f"<div class='share'><a href='/f'>Share</a> <a href='/m'>Mail</a></div><div class='newsletter'><h4>Newsletter</h4><p>Get our letter every week.</p>{form}</div></div><div class='footer'>{foot}</div>",
        f"<header><h2>Harbour Press</h2><nav><ul>{links}</ul></nav></header><main data-main='1'>{title}{body}</main><aside><h3>Most read</h3><ul>{related}</ul></aside><footer>{foot}</footer>",
        f"<div class='banner consent'>{cookie}</div><section class='article-body' data-main='1'><header>{title}<p>{line}</p></header>{body}<footer data-main='0'>Filed under <a href='/n'>news</a></footer></section>"
        f"<ol class='commentlist'><li><p>{more}</p></li><li><p>{line} So it goes.</p></li></ol><div class='pagination'><a href='/2'>Next</a></div>",
        f"<ul>{links}</ul><div data-main='1'>{title}{body}{body}</div><div>{foot}</div>",
        f"<div role='navigation'><ul>{links}</ul></div><div role='main'><div data-main='1'>{title}<div><p>{line} {line}</p><div class='advert' data-main='0'>{ad}</div><p>{more}</p></div></div></div><div role='contentinfo'>{foot}</div>",
        f"<div class='notice'><p>This page was changed. {ad}</p></div><div class='login'>{form}</div><ul>{related}</ul>",
    ]
    return [f"<!DOCTYPE html><html><head><title>Boats</title></head><body>{p}</body></html>".replace("data-main='1'", 'data-main="1"').replace("data-main='0'", 'data-main="0"') for p in pages]


def trained(pages: list[str], epochs: int = EPOCHS, rate: float = RATE, shrink: float = SHRINK) -> Model:
    """Potentials from labelled pages and the examples (one without marks has no content).

    Each page counts twice, once with the tags that name a role read as div, so that the model
    also learns what content looks like where no tag says it.  The gradient of the log likelihood is
    what was seen less what the marginals expect; steps are scaled by past gradients.
    """
    examples = example_pages()
    data = []
    for number, page in enumerate([*examples, *pages]):
        nodes = parse(page)
        truth = labels(nodes)
        if truth is None and number < len(examples):
            truth = [0] * len(nodes)
        if truth is not None:
            # The few examples weigh as much as all other pages together.
            weight = max(1.0, len(pages) / len(examples)) if number < len(examples) else 1.0
            data += [(nodes, features(nodes, plain), truth, weight / len(nodes)) for plain in (False, True)]
    model = Model()
    past: dict[str, float] = {}
    past_edges = np.full((2, 2, 2), 1e-6)
    for _ in range(epochs):
        slope: dict[str, float] = {}
        slope_edges = np.zeros((2, 2, 2))
        for nodes, looks, truth, scale in data:
            chance, pairs, _ = model.marginals(nodes, looks)
            for k, node in enumerate(nodes):
                miss = (truth[k] - chance[k]) * scale
                for name in looks[k]:
                    slope[name] = slope.get(name, 0.0) + miss
                if k:
                    kind = int(node.text is not None)
                    slope_edges[kind] -= np.reshape(pairs[k], (2, 2)) * scale
                    slope_edges[kind, truth[node.parent], truth[k]] += scale
        for name, value in slope.items():
            value -= shrink * model.looks.get(name, 0.0)
            past[name] = past.get(name, 1e-6) + value * value
            model.looks[name] = model.looks.get(name, 0.0) + rate * value / math.sqrt(past[name])
        slope_edges -= shrink * model.edges
        past_edges += slope_edges**2
        model.edges += rate * slope_edges / np.sqrt(past_edges)
    return model


def labelled_sample(pages: DataFrame, size: int = SAMPLE_PAGES) -> list[str]:
    """At most ``size`` whole pages that are not over MAX_LABELLED_BYTES, chosen by a hash of id and content.

    The bound holds for training only; every page is extracted.  A first cut of the hash leaves about
    four times ``size`` pages of the whole table, so tasks send few pages however many they are.
    """
    total = pages.count()
    if not total:
        return []
    place = F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 40))
    few = pages.withColumn("place", place).where(F.col("place") < F.lit(int((1 << 40) * min(1.0, 4 * size / total))))
    fit = few.where(F.octet_length("html").between(1, MAX_LABELLED_BYTES))
    rows = fit.orderBy("place", "html").select("html").limit(size).collect()
    return [r["html"] for r in rows]


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page's whole html.

    A null or empty page, and one without content, has an empty text.  Repeated rows and ids
    stay as they are, an empty table gives no rows, other columns are ignored.
    """
    given = picked(pages, page_id=id, url=url, html=html)
    given = given.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # A few thousand weights: as many as there are looks in the sampled pages.
    shared = given.sparkSession.sparkContext.broadcast(trained(labelled_sample(given.select("page_id", "html"), sample)))

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        model = shared.value
        columns = (part.column(c).to_pylist() for c in ("page_id", "url", "html"))
        for page, address, source in zip(*columns, strict=True):
            text = model.text(source)
            yield page, address, text, len(text)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kinds = [part.schema.field(c).type for c in ("page_id", "url")]
            schema = pa.schema([("page_id", kinds[0]), ("url", kinds[1]), ("text", pa.string()), ("n_chars", pa.int64())])
            yield from batches(rows(part), schema)

    types = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(work, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")
