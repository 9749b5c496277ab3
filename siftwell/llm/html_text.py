"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element has a hidden label, content or not.  A node's potential is log-linear in features of its tag, its class
and id words, and above all its text: how long it is, how much of it is linked, how many sentences and paragraphs stand in
it, what share of the page it is and how alike its neighbours are.  A parent-child potential couples the labels along
each edge.  The graph is a tree, so one sum-product pass up and one down give exact marginals; text whose element is
content with probability above one half is kept.

Weights are fitted by exact likelihood on labelled pages (the attribute y gives a subtree's label): the small ones in
LABELLED, MADE pages of made-up words by made_page(), with telling, made-up or no names, and up to TRAIN_PAGES pages
of the table of at most TRAIN_CHARS characters (those of smallest id hash; documented bounds) whose own article or main
element labels what is certain about them; labels that it leaves open are summed over.  Extraction reads every page whole, in one pass without a shuffle.

Null pages are empty, as are pages without content: the text is the empty string.  Broken markup is read
as browsers do in the main: unclosed paragraphs and list items end with the next one, stray end tags are
passed over, a page may stop anywhere, a quote that is not closed ends with its tag.  Repeated rows are read each; an
empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.runtime import hash_sample

TRAIN_PAGES = 60
TRAIN_CHARS = 200_000
MADE = 180
# a tag ends at the first '>' outside quotes; where quotes do not close before the next tag, at the first '>'
_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(script|style|noscript|template|svg|iframe|textarea)\b[^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+|[^>]*+)>", re.S | re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "iframe", "textarea")}
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LABEL = re.compile(r"\by=([01])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("button caption option legend summary td th tr tbody thead tfoot title head body html".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
_GROUPS = [
    ("article", "main"), ("section",), ("div",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "li", "dl", "dt", "dd", "menu"), ("a",), ("nav",), ("header",), ("footer",), ("aside",),
    ("form", "input", "button", "select", "option", "label", "fieldset", "legend", "textarea"), ("table", "tr", "td", "th", "tbody"), ("figure", "figcaption", "img"), ("blockquote", "pre"), ("html", "body"), ("head", "title"), ("dialog", "details"),
]
_GROUP = {t: i for i, g in enumerate(_GROUPS) for t in g}
_WORDS = [  # kinds of class, id and role words
    re.compile(r"(?<![a-z])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|taboola|outbrain)(?![a-z])"),
    re.compile(r"(?<![a-z])(?:nav\w*|menu\w*|breadcrumbs?|toc|pagination|pager|toolbar|topbar|skip)(?![a-z])"),
    re.compile(r"(?<![a-z])(?:header|masthead|footer|foot|copyright|legal|colophon|contentinfo|site-?info)(?![a-z])"),
    re.compile(r"(?<![a-z])(?:side|sidebar|aside|widget|related|recommend\w*|trending|popular|more|teaser|tags?|complementary)(?![a-z])"),
    re.compile(r"(?<![a-z])(?:comments?|commentlist|repl(?:y|ies)|respond|disqus|discussion|reader\w*)(?![a-z])"),
    re.compile(r"(?<![a-z])(?:cookies?|consent|gdpr|notices?|alert\w*|popup|modal|overlay|warning|message)(?![a-z])"),
    re.compile(r"(?<![a-z])(?:share|social|follow|newsletter|subscri\w*|sign-?up|log-?in|search|form|contact|donate)(?![a-z])"),
    re.compile(r"(?<![a-z])(?:article\w*|content|main|post|entry|story|body|text|prose)(?![a-z])"),
]
N_FEATURES = 1 + len(_GROUPS) + 1 + len(_WORDS) + 39
_OFF = frozenset("nav header footer aside form button select dialog head".split())
_ON = frozenset(["article", "main"])


@dataclass
class Node:
    tag: str
    parent: int
    names: str = ""
    label: int | None = None
    own: int = 0  #: characters of its own text
    marks: int = 0  #: sentence marks in it
    total: int = 0  #: with descendants
    linked: int = 0
    sentences: int = 0  #: sentence marks with descendants
    paragraphs: int = 0  #: p elements of some length below
    controls: int = 0  #: form controls below
    links: int = 0  #: links below
    prose: int = 0  #: characters of own texts with a sentence in them, outside links, with descendants
    titled: bool = False  #: a first-level heading below
    children: list[int] = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """Elements in page order (a parent stands before its children), and text runs as (element, block, text)."""
    nodes, texts, stack, block = [Node("#page", -1)], [], [0], 0

    def close(depth: int) -> None:
        nonlocal block
        if any(nodes[i].tag in _BLOCK for i in stack[depth:]):
            block += 1
        del stack[depth:]

    def add_text(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            texts.append((stack[-1], block, text))
            n = nodes[stack[-1]]
            n.own += len(text.strip())
            n.marks += text.count(".") + text.count(",") + text.count("!") + text.count("?")

    at, found, last = 0, {}, page.rfind(">") + 1  # what comes after it holds no tag
    while m := _TAG.search(page, at, last):
        add_text(page[at : m.start()])
        at = m.end()
        if at == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = len(page)
        if m[1]:  # raw text: on to its end tag, looked for once more only where the last one found lies behind
            t = m[1].lower()
            if found.get(t, 0) is not None and found.get(t, -1) < at:
                e = _RAW_END[t].search(page, at)
                found[t] = e.end() if e else None
            at = found[t] if found[t] is not None else len(page)
            continue
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            for d in range(len(stack) - 1, 0, -1):
                if nodes[stack[d]].tag == tag:
                    close(d)
                    break
            continue
        if tag == "br":
            texts.append((stack[-1], block, " "))
            continue
        if tag in _CLOSES_P or tag in _ENDS:
            ends, stops = _ENDS.get(tag, ("p",)), _STOPS.get(tag, ("table", "button", "object"))
            if tag in _CLOSES_P:
                ends = (*ends, "p")
            for d in range(len(stack) - 1, 0, -1):
                t = nodes[stack[d]].tag
                if t in ends:
                    close(d)
                    break
                if t in stops or (t in _BLOCK and tag not in _ENDS):
                    break
        rest = m[4] or ""
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)).lower() if "=" in rest else ""
        label = _LABEL.search(rest)
        if tag in _BLOCK:
            block += 1
        if tag in _VOID:
            continue
        nodes.append(Node(tag, stack[-1], names, int(label[1]) if label else None))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        if not rest.endswith("/") or tag in _BLOCK:
            stack.append(len(nodes) - 1)
    tail = page[at:]
    cut = tail.rfind("<")
    add_text(tail[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!]", tail[cut:]) and ">" not in tail[cut:] else tail)
    return nodes, texts


def node_features(nodes: list[Node]) -> np.ndarray:
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        n.total += n.own
        n.sentences += n.marks
        if n.tag == "a":
            n.linked = n.total
            n.links += 1
        n.controls += n.tag in _CONTROLS
        n.prose = 0 if n.tag == "a" else n.prose + (n.own if n.own > 40 and n.marks else 0)
        n.titled = n.titled or n.tag == "h1"
        n.paragraphs += n.tag == "p" and n.total > 60
        if i:
            p = nodes[n.parent]
            p.total += n.total
            p.linked += n.linked
            p.sentences += n.sentences
            p.paragraphs += n.paragraphs
            p.controls += n.controls
            p.links += n.links
            p.prose += n.prose
            p.titled = p.titled or n.titled
    whole = max(nodes[0].total, 1)
    alike, record = _alike(nodes), _records(nodes)
    leads = _leads(nodes, record)
    all_prose = max(nodes[0].prose, 1)
    told = 0  # prose before the element
    x = np.zeros((len(nodes), N_FEATURES))
    x[:, 0] = 1
    words = 1 + len(_GROUPS) + 1
    base = words + len(_WORDS)
    kinds: dict[str, list[int]] = {"": []}
    state: list[tuple] = []
    seen = 0
    for i, n in enumerate(nodes):
        x[i, 1 + _GROUP.get(n.tag, len(_GROUPS))] = 1
        if n.names not in kinds:
            kinds[n.names] = [k for k, w in enumerate(_WORDS) if w.search(n.names)]
        found = kinds[n.names]
        for k in found:
            x[i, words + k] = 1
        off = n.tag in _OFF or any(k < 7 for k in found)
        on = not off and (n.tag in _ON or bool(found))
        # what stands above: inside a content element, inside something else, and which of them is nearer
        near, inside, outside = state[n.parent] if i else (0, 0, 0)
        near = -1 if off else 1 if on else near
        inside, outside = inside or on, outside or off
        state.append((near, inside, outside))
        x[i, base + 7], x[i, base + 8], x[i, base + 9], x[i, base + 10] = near > 0, near < 0, inside and not outside, outside
        total, own = n.total, n.own
        x[i, base] = math.log1p(own) / 5
        x[i, base + 1] = math.log1p(total) / 5
        x[i, base + 2] = n.linked / total if total else 0
        x[i, base + 3] = min(10 * n.marks / own, 2) if own else 0
        x[i, base + 4] = own > 80
        x[i, base + 5] = 0 < own < 25
        x[i, base + 6] = total == 0
        share = total / whole
        above = nodes[n.parent].total if i else whole
        x[i, base + 11] = share
        x[i, base + 12] = total / above if above else 0
        x[i, base + 13] = min(n.paragraphs, 6) / 6
        x[i, base + 14] = min(10 * n.sentences / total, 2) if total else 0
        x[i, base + 15] = min(n.controls, 3) / 3
        x[i, base + 16] = min(n.links / (1 + total / 50), 2)
        x[i, base + 17] = alike[i]
        x[i, base + 18] = alike[i] and total < 400
        x[i, base + 19] = seen / whole
        x[i, base + 20] = seen / whole > 0.85
        x[i, base + 21] = total > 250 and n.linked < 0.2 * total and n.paragraphs > 1
        x[i, base + 22] = outside and total > 60 and n.linked < 0.2 * total and n.sentences > 0
        x[i, base + 23] = inside and off
        x[i, base + 24] = inside and off and (n.linked > 0.4 * total or n.controls > 0)
        x[i, base + 25] = inside and off and total > 60 and n.linked < 0.1 * total and n.sentences > 1
        part = n.prose / all_prose
        k = base + 26
        x[i, k] = part
        x[i, k + 1] = part > 0.6
        x[i, k + 2] = n.prose / nodes[n.parent].prose if i and nodes[n.parent].prose else 0
        x[i, k + 3] = record[i]
        x[i, k + 4] = record[i] and told > 0.5 * all_prose
        x[i, k + 5] = n.tag == "header" and n.titled and i > 0 and nodes[n.parent].prose > 0 and nodes[n.parent].tag not in ("body", "html", "#page")
        x[i, k + 6] = n.own > 80 and n.marks > 1
        x[i, k + 7] = whole < 300
        x[i, k + 8] = share > 0.95
        x[i, k + 9] = n.prose > 0 and n.linked < 0.2 * total and share > 0.4
        x[i, k + 10] = told == 0 and n.prose == 0
        x[i, k + 11] = told >= 0.999 * all_prose and n.prose == 0
        x[i, k + 12] = leads[i]
        told += n.own if n.tag != "a" and n.own > 40 and n.marks else 0
        seen += n.own
    return x


_CONTROLS = frozenset("input button select textarea".split())


def _alike(nodes: list[Node]) -> list[bool]:
    """Elements (not paragraphs) that two neighbours or more are like in tag and names, as comments and teasers are."""
    out = [False] * len(nodes)
    for p in nodes:
        if len(p.children) > 2:
            count: dict[tuple[str, str], int] = {}
            for c in p.children:
                k = (nodes[c].tag, nodes[c].names)
                count[k] = count.get(k, 0) + 1
            for c in p.children:
                out[c] = count[nodes[c].tag, nodes[c].names] > 2 and nodes[c].tag in ("div", "li", "article", "section")
    for i in range(1, len(nodes)):
        out[i] = out[i] or out[nodes[i].parent]
    return out


def _records(nodes: list[Node]) -> list[bool]:
    """Elements that a neighbour is like in tag and children, a short first child (a name, a date) among several; and all in them."""
    out = [False] * len(nodes)
    for p in nodes:
        if len(p.children) > 1:
            shapes: dict[tuple, list[int]] = {}
            for c in p.children:
                kids = nodes[c].children
                if len(kids) > 1 and nodes[kids[0]].total < 40 and nodes[kids[0]].tag not in ("h1", "h2") and nodes[c].prose:
                    shapes.setdefault((nodes[c].tag, nodes[kids[0]].tag, nodes[kids[1]].tag), []).append(c)
            for found in shapes.values():
                if len(found) > 1:
                    for c in found:
                        out[c] = True
    for i in range(1, len(nodes)):
        out[i] = out[i] or out[nodes[i].parent]
    return out


def _leads(nodes: list[Node], record: list[bool]) -> list[bool]:
    """Headings whose next neighbour with text, other headings apart, has a text of its own in it that is no record."""
    out = [False] * len(nodes)
    for p in nodes:
        follows = False
        for c in reversed(p.children):
            n = nodes[c]
            if n.tag in _HEADINGS:
                out[c] = follows
            elif n.total:
                follows = not record[c] and n.linked < 0.5 * n.total and n.tag not in _OFF
    return out


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def marginals(unary: np.ndarray, nodes: list[Node], pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of every node, and the expected label pairs (parent, child) summed over edges: sum-product up and down."""
    (t00, t01), (t10, t11) = np.exp(pair).tolist()
    n = len(nodes)
    odds = np.exp(np.clip(unary, -30, 30)).tolist()
    up0, up1 = [1.0] * n, odds
    m0, m1 = [1.0] * n, [1.0] * n  # message of a node to its parent
    for i in range(n - 1, 0, -1):
        s = up0[i] + up1[i]
        a, b = up0[i] / s, up1[i] / s
        up0[i], up1[i] = a, b
        x, y = t00 * a + t01 * b, t10 * a + t11 * b
        s = x + y
        m0[i], m1[i] = x / s, y / s
        p = nodes[i].parent
        up0[p] *= x / s
        up1[p] *= y / s
        s = up0[p] + up1[p]
        up0[p] /= s
        up1[p] /= s
    down0, down1 = [1.0] * n, [1.0] * n
    prob = [0.0] * n
    prob[0] = up1[0] / (up0[0] + up1[0])
    pairs = [0.0] * 4
    for i in range(1, n):
        p = nodes[i].parent
        q0, q1 = up0[p] * down0[p] / m0[i], up1[p] * down1[p] / m1[i]
        e = (q0 * t00 * up0[i], q0 * t01 * up1[i], q1 * t10 * up0[i], q1 * t11 * up1[i])
        s = e[0] + e[1] + e[2] + e[3]
        for k in range(4):
            pairs[k] += e[k] / s
        prob[i] = (e[1] + e[3]) / s
        x, y = q0 * t00 + q1 * t10, q0 * t01 + q1 * t11
        down0[i], down1[i] = x / (x + y), y / (x + y)
    return np.array(prob), np.array(pairs).reshape(2, 2)


@dataclass
class Model:
    weight: np.ndarray
    pair: np.ndarray

    def extract(self, page: str) -> str:
        nodes, texts = parse(page)
        prob, _ = marginals(node_features(nodes) @ self.weight, nodes, self.pair)
        blocks, last = [], None
        for node, block, text in texts:
            if prob[node] > 0.5:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        return " ".join(x for b in blocks if (x := " ".join("".join(b).split())))


def _inherit(nodes: list[Node]) -> np.ndarray:
    y = np.zeros(len(nodes), int)
    for i, n in enumerate(nodes):
        y[i] = n.label if n.label is not None else (y[n.parent] if i else 0)
    return y


def landmark_labels(nodes: list[Node]) -> np.ndarray | None:
    """Labels of a page with one article, or else one main element: 1 for its prose and headings, 0 for what stands outside or in an
    element for menus and forms or is called an advert, -1 (unknown, summed over in the fit) for the rest of it.  Other names do not count.  None
    for other pages.  nodes have their features taken."""
    tops = [i for i, n in enumerate(nodes) if n.tag == "article"] or [i for i, n in enumerate(nodes) if n.tag == "main"]
    if len(tops) != 1:
        return None
    top, y = tops[0], np.zeros(len(nodes), int)
    inside, off = [False] * len(nodes), [False] * len(nodes)
    for i, n in enumerate(nodes):
        inside[i] = i == top or (i > 0 and inside[n.parent])
        off[i] = n.tag in _OFF or (i > 0 and off[n.parent] and n.parent != top)
        if inside[i]:
            sure = n.tag in ("p", "h1", "h2", "h3", "blockquote", "li") and n.total > 0 and n.linked < 0.3 * n.total
            y[i] = 0 if n.tag in ("nav", "form", "button", "select") or _WORDS[0].search(n.names) else 1 if i == top or (sure and not off[i]) else -1
    return y


#: telling names of made pages; half of the elements have a made-up name or none instead
_NAME_POOLS = {
    "content": ["content", "article-body", "post-content", "story", "entry", "main-text"],
    "neutral": ["wrap", "col-8", "x1", "c-2", "block", "inner", "row", "grid-b", "page", "left", ""],
    "part": ["lead", "notice-board", "section", "related-work", "intro", "note", "popular-view", "chapter", ""],
    "remarks": ["comments", "responses", "thread", "discussion", ""],
    "menu": ["menu", "nav", "topbar", "links", ""],
    "side": ["sidebar", "widget", "related", "right", "extras", ""],
    "foot": ["footer", "bottom", "legal", ""],
    "ad": ["ad", "advert", "promo", "sponsored", "banner", ""],
    "notice": ["cookie", "consent", "notice", "overlay", ""],
}


def made_page(seed: int) -> str:
    """A labelled page of made-up words: an article amid menus, notices, adverts, sidebars, forms, footers and remarks, whose
    elements carry telling names, neutral ones or none."""
    r = random.Random(seed)
    part = ["an", "ter", "lo", "mi", "sho", "ve", "ri", "ka", "un", "do", "est", "pa", "ne", "so"]
    word = lambda: "".join(r.choice(part) for _ in range(r.randint(1, 4)))
    words = lambda n: " ".join(word() for _ in range(n))
    sentence = lambda: words(r.randint(3, 16)).capitalize() + r.choice([".", ".", ".", ", " + words(4) + ".", "!", "?"])
    prose = lambda n: " ".join(sentence() for _ in range(n))
    bare = r.random() < 0.35  # no telling names on this page
    broken = r.random() < 0.2  # paragraphs are parted by line breaks
    coined = lambda: r.choice(["", f' class="{word()}-{word()}"', f' class="{word()}{r.randint(1, 30)}"', f' id="{word()}"'])
    if seed % 3 == 1:  # little or plain markup
        prose_of = lambda n: r.choice(["<p>{}</p>", "<p>{}</p>", "{}<br><br>"]).format(prose(r.randint(1, 3))) * 1 + "".join(f"<p>{prose(r.randint(1, 3))}</p>" for _ in range(n - 1))
        lines = lambda n: "<br><br>".join(prose(r.randint(1, 4)) for _ in range(n))
        menu = r.choice(["", f'<div{coined()}><a href="/">{words(1)}</a> <a href="/b">{words(2)}</a> <a href="/c">{words(1)}</a></div>', f"<nav><ul>{''.join(f'<li><a href=/{word()}>{word()}</a></li>' for _ in range(r.randint(2, 7)))}</ul></nav>"])
        end = r.choice(["", f"<div{coined()}>{words(2).capitalize()} {r.randint(1990, 2030)}</div>", f"<p{coined()}>&copy; {words(3)}</p>", f"<footer>&copy; {word()}.example.net &middot; {prose(r.randint(1, 2))}</footer>", f'<div{coined()}><a href="/i">{words(1).capitalize()}</a></div>'])
        main = r.choice([
            lambda: f"<div{coined()} y=1>{prose_of(r.randint(1, 3))}</div>", lambda: f"<article{coined()} y=1><p>{words(r.randint(1, 4)).capitalize()}.</p></article>", lambda: f"<article{coined()} y=1>{r.choice(['', f'<h1>{sentence()}</h1>', f'<h1>{words(4).capitalize()}</h1>'])}<p>{r.choice(['', '<b>'])}{r.choice([words(2) + '.', sentence(), sentence()])}{r.choice(['', '<br>'])}</article>", lambda: f"<div{coined()} y=1>{lines(r.randint(1, 4))}</div>",
            lambda: f"<article{coined()} y=1><header><h1>{words(r.randint(1, 6)).capitalize()}</h1></header>{prose_of(r.randint(1, 4))}</article>", lambda: f"<div{coined()} y=1><h1>{words(3).capitalize()}</h1>{lines(r.randint(2, 5))}</div>",
            lambda: f"<main{coined()} y=1><div><header><h1>{words(4).capitalize()}</h1><p>{words(4).capitalize()}</p></header><div{coined()}>{prose_of(r.randint(1, 3))}</div></div></main>",
        ])()
        if r.random() < 0.15:  # text in the page's body itself
            return f"<body y=1>{menu.replace('>', ' y=0>', 1)}{r.choice(['', f'<h1>{words(3).capitalize()}</h1>'])}{r.choice([lines(r.randint(1, 4)), prose_of(r.randint(1, 3))])}{end.replace('>', ' y=0>', 1)}</body>"
        between = r.choice(["", "", f'<div class="{r.choice(["ad", word()])}">{prose(r.randint(1, 2))}</div>'])
        return f"<body>{menu}{between}{main}{end}</body>"
    if seed % 6 == 5:  # a few paragraphs in a plain element, and next to nothing else
        text = "".join(f"<p>{prose(r.randint(1, 4))}</p>" for _ in range(r.randint(1, 4)))
        menu = r.choice([f'<div class=menu><a href="/">{words(1)}</a></div>', f'<div><a href="/">{words(1)}</a> <a href="/b">{words(2)}</a></div>', ""])
        return f'<body>{menu}<div class="{r.choice(_NAME_POOLS["neutral"])}" y=1>{text}</div>{r.choice(["<div>{}</div>", "<p>{}</p>", "<footer>{}</footer>"]).format(words(r.randint(1, 4)).capitalize())}</body>'

    def tag(name: str, pool: str, inner: str, y: int | None = None, key: str = "class") -> str:
        c = r.choice(_NAME_POOLS["neutral"] if bare or r.random() < 0.2 else _NAME_POOLS[pool])
        if r.random() < 0.4:
            c = r.choice(["", f"{word()}-{word()}", f"{word()}{r.randint(1, 30)}"])
        return f"<{name}" + (f' {key}="{c}"' if c else "") + (f" y={y}" if y is not None else "") + f">{inner}</{name}>"

    links = lambda n: "".join(r.choice(["<li>{}</li>", "{} ", "{} | "]).format(f'<a href="/{word()}">{words(r.randint(1, 3)).capitalize()}</a>') for _ in range(n))
    html_tag = lambda plain, landmark: plain if bare or r.random() < 0.5 else landmark
    menu = tag(html_tag("div", "nav"), "menu", f"<ul>{links(r.randint(2, 8))}</ul>" if r.random() < 0.6 else links(r.randint(2, 8)))
    head = tag(html_tag("div", "header"), "menu", r.choice([f"<a href=/>{words(2)}</a>", f"<h1>{words(2).capitalize()}</h1><p>{words(4)}</p>", words(2)]) + (menu if r.random() < 0.5 else ""))
    advert = lambda: tag("div", "ad", r.choice([f"<p>{prose(1)}</p>", prose(1), f'<a href="/{word()}">{prose(1)}</a>', f"{words(3)}! <a href=/b>{words(2)}</a>"]), 0)
    share = lambda: tag("div", "side", links(r.randint(2, 4)), 0)
    form = lambda: tag("form", "side", f"<p>{prose(1)}</p><label>{words(1)}</label><input><button>{words(1)}</button>", 0)
    teasers = lambda: tag(html_tag("div", "aside"), "side", f"<h3>{words(2).capitalize()}</h3><ul>" + "".join(f'<li><a href="/{word()}">{words(r.randint(3, 9)).capitalize()}</a></li>' for _ in range(r.randint(2, 6))) + "</ul>", 0)

    def body() -> str:
        out = [r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>"]).format(words(r.choice([1, 1, 2, 3, 4, 5, 6, 7])).capitalize())] if r.random() < 0.8 else []
        if broken:
            return "".join(out) + r.choice(["<br><br>", "<br>"]).join(prose(r.randint(1, 4)) for _ in range(r.randint(2, 7)))
        for _ in range(r.randint(1, 8)):
            k = r.random()
            if k < 0.14:
                inner = r.choice([words(1).capitalize(), words(2) + ".", f"<b>{words(3).capitalize()}.</b>", sentence()])
                out.append(f"<p>{inner}</p>" if r.random() < 0.7 else tag("p", "part", inner))
            elif k < 0.6:
                inner = prose(r.randint(1, 5)) + (f' <a href="/{word()}">{words(2)}</a> {sentence()}' if r.random() < 0.2 else "")
                out.append(f"<p>{inner}</p>" if bare or r.random() < 0.85 else tag("p", "part", inner))
            elif k < 0.68:
                out.append(f"<h2>{words(r.randint(1, 5)).capitalize()}</h2><p>{prose(2)}</p>")
            elif k < 0.74:
                out.append("<ul>" + "".join(f"<li>{sentence() if r.random() < 0.5 else words(4)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.79:
                out.append(r.choice([f"<blockquote>{prose(2)}</blockquote>", f"<table><tr><td>{words(1)}</td><td>{words(4)}</td></tr></table>", f"<figure><figcaption>{sentence()}</figcaption></figure>", f"<pre>{words(6)}</pre>"]))
            elif k < 0.88:
                out.append(tag(r.choice(["div", "section"]), "part", f"<p>{prose(r.randint(1, 4))}</p>" * r.randint(1, 2)))
            else:
                named = lambda: f'<div class="{r.choice(["ad", "advert", "promo", "sponsored", "banner"])}" y=0>{r.choice([words(2) + "!", words(3), prose(1)])}</div>'
                out.append(r.choice([advert, share, form, teasers, advert, named, named])())
        return "".join(out)

    def remarks() -> str:
        kind, name = r.choice(["div", "li", "article"]), "" if bare else r.choice(["comment", "reply", "item", "x", word(), f"{word()}-{word()}"])
        one = lambda: f'<{kind} class="{name}">' + r.choice(["<b>{}</b>", '<a href="/u">{}</a>', "<span>{}</span>"]).format(words(1).capitalize()) + f"<p>{prose(r.randint(1, 3))}</p>" + r.choice(["", f"<a href=#r>{words(1)}</a>"]) + f"</{kind}>"
        return tag("section" if r.random() < 0.6 else "div", "remarks", (f"<h2>{words(1).capitalize()}</h2>" if r.random() < 0.7 else "") + "".join(one() for _ in range(r.randint(1 if not bare else 2, 7))), 0, r.choice(["class", "id"]))

    content = tag(html_tag("div", r.choice(["article", "article", "main", "section"])), "content", body(), 1)
    side = tag(html_tag("div", "aside"), "side", r.choice([teasers, lambda: f"<h3>{words(2)}</h3><p>{prose(1)}</p>", share])())
    foot = tag(html_tag("div", "footer"), "foot", r.choice([f"&copy; {words(3)}. {words(4).capitalize()}.", f"<p>{prose(1)}</p>{links(3)}", links(4)]))
    notice = tag("div", "notice", r.choice([f"<p>{prose(2)}</p><button>{words(1)}</button>", prose(1) + f" <a href=/p>{words(1)}</a>"]))
    middle = content + (remarks() if r.random() < 0.5 else "")
    if r.random() < 0.5:
        middle = tag("div", "neutral", middle)
    rows = [notice if r.random() < 0.4 else "", head, menu if r.random() < 0.6 else "", advert() if r.random() < 0.3 else "", middle, side if r.random() < 0.5 else "", form() if r.random() < 0.2 else "", foot]
    return f"<html><head><title>{words(4)}</title></head><body>{''.join(rows)}</body></html>"


def fit(pages: list[str], steps: int = 220, rate: float = 0.1, decay: float = 0.0005, made: int = MADE) -> Model:
    """Gradient ascent on the likelihood of the labelled pages; pages: further pages with landmarks."""
    train = []
    for page, weight in [*((p, 2.0) for p in LABELLED), *((made_page(i), 1.0) for i in range(made))]:
        nodes, _ = parse(page)
        train.append((node_features(nodes), nodes, _inherit(nodes), weight))
    for page in pages:
        nodes, _ = parse(page)
        x, y = node_features(nodes), landmark_labels(nodes)
        if y is not None:
            train.append((x, nodes, y, 1.0))
    train = [(x, nodes, y, w / math.sqrt(len(nodes))) for x, nodes, y, w in train]  # small pages count too
    total = sum(w * len(nodes) for _, nodes, _, w in train)
    w, pair = np.zeros(N_FEATURES), np.zeros((2, 2))
    m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for t in range(1, steps + 1):
        gw, gp = -decay * w, -decay * pair
        for x, nodes, y, weight in train:
            prob, pairs = marginals(x @ w, nodes, pair)
            if (y < 0).any():  # what the known labels make of the unknown ones
                want, seen = marginals(np.where(y < 0, x @ w, 30.0 * (2 * y - 1)), nodes, pair)
            else:
                parents = np.array([n.parent for n in nodes[1:]], int)
                want, seen = y, np.bincount(2 * y[parents] + y[1:], minlength=4).reshape(2, 2) if len(parents) else np.zeros((2, 2))
            gw = gw + weight * (x.T @ (want - prob)) / total
            gp = gp + weight * (seen - pairs) / total
        g = np.append(gw, gp.ravel())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, pair = w + step[:-4], pair + step[-4:].reshape(2, 2)
    return Model(w, pair)


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    short = pages.where(F.col("page_id").isNotNull() & (F.length("html") <= TRAIN_CHARS))
    ids = [r["page_id"] for r in hash_sample(short.select("page_id"), "page_id", train_pages).collect()]
    sample = short.where(F.col("page_id").isin(ids)).select("page_id", "html").groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect()  # train_pages rows of TRAIN_CHARS characters at most
    model = pages.sparkSession.sparkContext.broadcast(fit([r["html"] for r in sample]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [model.value.extract(p.as_py() or "") for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


_P = "The council met on Tuesday evening to discuss the new bridge, which has been planned for years, and agreed on a date."
_Q = "Work is to start in spring. Residents asked about noise, traffic and cost, and the mayor promised a full report."
#: Labelled pages: y=1 marks a subtree as content, y=0 as not; children inherit.
LABELLED = [
    f'<html><head><title>Bridge</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><div class="ad">Buy now, cheap and fast.</div><article y=1><h1>New bridge</h1><p>{_P}</p><p>{_Q}</p><p>Short one.</p><ul><li>First point of the plan</li><li>Second point</li></ul></article><footer>&copy; Site. All rights reserved.</footer></body></html>',
    f'<body><header><h1>The Daily</h1><p>News since 1901</p></header><main y=1><h1>Bridge plan</h1><p>{_Q}</p><aside y=0><h3>Related</h3><ul><li><a href="/a">Another story about roads</a></li></ul></aside><p>{_P}</p><form y=0><label>Mail</label><button>Send</button></form></main><footer><p>Contact us by mail or phone, any day of the week.</p></footer></body>',
    f'<body><div id="header"><a href="/">Home</a> <a href="/b">Blog</a></div><div id="content" y=1><h2>Plans</h2><p>{_P}</p><p>{_Q}</p><div class="ad" y=0><p>Great offers today, see them all now.</p></div><p>{_P}</p></div><div id="sidebar"><h3>Popular</h3><p>Ten roads you must see, and why they matter to all of us.</p></div><div id="footer">Imprint</div></body>',
    f'<body><div class="cookie-notice"><p>We use cookies to improve our site, and to measure visits. By staying you agree.</p><button>OK</button></div><article class="post" y=1><h1>Bridge</h1><p>{_P} {_Q}</p><blockquote>{_Q}</blockquote></article><section class="comments" id="comments"><h2>Comments</h2><div class="comment"><p>I like the plan, and I hope that it works out well for everyone in town.</p></div><div class="comment"><p>{_Q}</p></div></section></body>',
    f'<body><nav class="menu"><a href="/1">One</a><a href="/2">Two</a></nav><div class="wrap"><div class="story-body" y=1><h1>Bridge</h1><p>{_P}</p><table><tr><td>Cost</td><td>Two million, in all.</td></tr></table><p>{_Q}</p><figure><figcaption>The old bridge in winter, seen from the north.</figcaption></figure></div><div class="related"><h3>More</h3><a href="/x">{_P}</a><a href="/y">{_Q}</a></div></div><div class="newsletter"><p>Sign up for our newsletter, free of charge, every week.</p><form><input></form></div></body>',
    f'<body><article y=1><header y=0><a href="/">Section</a></header><h1>Bridge</h1><p>{_P}<p>{_Q}<p>Done.<footer y=0>Filed under roads, towns.</footer></article><article class="comment"><p>{_P}</p></article><div role="contentinfo">Terms, privacy and more.</div></body>',
    f'<body><div class="banner"><p>{_Q}</p></div><main><div class="breadcrumbs"><a href="/">Home</a> / Here</div><div class="entry-content" y=1><p>{_P}</p><p>Yes.</p><p>{_Q}</p></div><div class="share"><a href="#">Share</a></div></main><aside><p>{_P}</p></aside></body>',
    f'<body><div class="alert"><p>Notice: this site will be down on Sunday, from two to four.</p></div><section class="article" y=1><h1>Bridge</h1><h2>What comes</h2><p>{_Q}</p><p><b>{_P}</b></p><ol><li>{_P}</li></ol></section><section class="sponsored"><p>{_P}</p></section><footer><nav><a href="/">Top</a></nav></footer></body>',
    "<article y=1><p>Closed on Monday.</p></article>",
    '<body><article y=1><p>No boats today.</p></article></body>',
    f'<body><nav><ul><li><a href="/a">Towns</a></li><li><a href="/b">Roads</a></li></ul></nav><div class="ad">Buy now.</div><article y=1><h1>Bridge</h1><p>Bridge plan.</p><p><b>Bridge plan.<br><p>Bridge plan.</p><p>{_Q}</p></article><footer>&copy; town.example.net &middot; {_P}</footer></body>',
    f'<body><nav><ul><li><a href="/a">Towns</a></li><li><a href="/b">Roads</a></li></ul></nav><div class="ad">Buy now, and save. Ask us.</div><article y=1><h1>So</h1><p>So.</p><p>{_P} {_Q}</p><p>{_Q} {_P}</p></article><footer>&copy; town.example.net</footer></body>',
]
