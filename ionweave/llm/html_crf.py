"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks (text between block-level tags) with their ancestor tags and class
words. Features of a block are its ancestors, the share of the page's text that its element or its
container has, and simple facts on its own text; the field has two labels, main and other, is trained on labelled
pages by gradient steps on the conditional likelihood, and is decoded by Viterbi. The labelled pages are composed
here from the usual parts of articles, blogs, shops and forums, with the label of each part (no labelled pages are among the
tables, and no page of the corpus is used). Class words there are often missing, unknown or misleading, so that tags and
text statistics can overrule them.

Null and empty pages have no text. Whole pages are read in linear time, nothing is capped. Character references are
decoded, white space in a block becomes one space, blocks are joined by one line end. Rows are read one by one, also rows of equal
id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import slices

MAIN, OTHER = 1, 0
SLICE, SLICE_BYTES = 2000, 8_000_000
#: Labelled pages that a feature must be on to count.
OFTEN = 4
#: Tags that start and end blocks, that have no content, and whose content is no text (fixed values).
BLOCK = set("address article aside blockquote body button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Open tags that a tag ends where authors leave out the end tag.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head", "title"}}
ENDS |= {t: {"p"} for t in "article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
_ATTRIBUTES = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|annotation|annotation-xml)\b{_ATTRIBUTES}.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})|<[!?][^>]*>", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_UNCLOSED = re.compile(r"<[a-zA-Z/!?].*\Z", re.S)


class Node:
    """An element on the way to a block, sharing its ancestors; ``features`` are those of the whole way, ``named`` those of class words, with their elements."""

    __slots__ = ("features", "named", "parent", "score", "tag")

    def __init__(self, parent: Node | None, tag: str, words: list[str] = (), known: dict | None = None):
        self.parent, self.tag, self.score = parent, tag, None
        above = parent.features if parent else frozenset({"bias"})
        new = {f for f in (f"in:{tag}", *(f for w in words for f in _named(w))) if f not in above and (known is None or f in known)}
        self.features = above | new if new else above
        inherited = parent.named if parent else ()
        self.named = (*inherited, *((f, self) for f in sorted(new) if f.startswith(("cls:", "part:")))) if new else inherited

    def child(self, label: str) -> Node:
        """A child from its tag and class names, like ``div.ad`` or ``div.site-footer``."""
        tag, *words = label.split(".")
        return Node(self, tag, words)


def _named(name: str) -> list[str]:
    """Features of a class name: a single word by itself, or the words of a compound."""
    words = _WORDS.findall(name)
    return [f"cls:{w}" for w in words] if len(words) == 1 else [f"part:{w}" for w in words]


@dataclass
class Block:
    node: Node
    text: str
    linked: int = 0  # characters inside links
    share: int = 0  # how much of the page's text its element or its container has, in steps
    named: tuple[str, ...] = ()  # class words of its ancestors, with whether that ancestor has much of the page's text


def shared(got: list[Block]) -> list[Block]:
    """The blocks with their ``share`` and ``named`` set."""
    own, around, inside, total = Counter(), Counter(), Counter(), 0
    for b in got:
        total += len(b.text)
        own[id(b.node)] += len(b.text)
        around[id(b.node.parent)] += len(b.text)
        for node in {id(node) for _, node in b.node.named}:
            inside[node] += len(b.text)
    for b in got:
        b.named = tuple(f"{f}:{inside[id(node)] >= 0.3 * total}" for f, node in b.node.named)
        part = max(own[id(b.node)], around[id(b.node.parent)]) / max(total, 1)
        b.share = sum(part >= mark for mark in (0.04, 0.12, 0.3, 0.5, 0.8))
    return got


def blocks(page: str, known: dict | None = None) -> list[Block]:
    """The leaf blocks of a page with text, in order; only ``known`` ancestor features are kept, if given."""
    out, parts, linked, at = [], [], 0, 0
    top = Node(None, "", known=known)
    stack, opened = [("", top)], Counter()

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1][1], text, linked))
            parts, linked = [], 0

    def read(chunk: str) -> None:
        nonlocal linked
        if chunk:
            parts.append(chunk)
            if opened["a"]:
                linked += len(chunk)

    def close() -> None:
        opened[stack.pop()[0]] -= 1

    end, hidden = page.rfind(">") + 1, False  # no tag ends after it
    for m in _TOKEN.finditer(page, 0, end):
        read(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if not name:
            hidden = at == end and _open_ended(m)
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        if m.group(2):
            if opened[name]:
                while stack[-1][0] != name:
                    close()
                close()
            continue
        if name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        if ends := ENDS.get(name):
            while len(stack) > 1 and (stack[-1][0] in ends or (stack[-1][0] not in BLOCK and any(opened[t] for t in ends))):
                close()
        node = stack[-1][1]
        if name in BLOCK:
            node = Node(node, name, " ".join("".join(x) for x in _NAMED.findall(m.group(4))).lower().split(), known)
        stack.append((name, node))
        opened[name] += 1
    if not hidden:
        read(page[at:end])
        read(_UNCLOSED.sub("", page[end:]))
    flush()
    return shared(out)


def _open_ended(m: re.Match) -> bool:
    """Whether a comment or an element without text lacks its end, so that the rest of the page is in it."""
    if m.group(1):
        return not re.search(rf"</{m.group(1)}\s*>\Z", m.group(), re.I)
    return m.group().startswith("<!--") and not m.group().endswith("-->")


def _path_features(node: Node) -> list[str]:
    return [*node.features, f"own:{node.tag}"]


_SIGNS = {"copyright": re.compile("©|copyright|all rights reserved", re.I), "cookie": re.compile("cookie|consent|subscribe|newsletter|sign up|log in", re.I), "reply": re.compile("reply|comment|posted by|said on", re.I), "share": re.compile("share|tweet|read more|advert|sponsor", re.I)}


def _text_features(b: Block) -> list[str]:
    n = len(b.text)
    out = [f"len:{min(5, n.bit_length() // 2)}", f"share:{b.share}", f"share:{b.share}:{n > 40}", f"share:{b.share}:{b.linked > n // 2}", f"links:{3 if b.linked >= 0.7 * n else 2 if b.linked >= 0.3 * n else 1 if b.linked else 0}"]
    out += b.named  # a class word says more of a small part than of one that has most of the text
    out.append("stop" if b.text[-1] in ".!?…”\"»" else "nostop")
    if n < 200:
        out += [k for k, r in _SIGNS.items() if r.search(b.text)]
    return out


@dataclass
class Field:
    """Weights: features that raise label main, and transitions between labels."""

    weights: dict[str, float]
    move: np.ndarray  # 2 x 2 log potentials
    start: np.ndarray

    def emission(self, b: Block) -> float:
        """Log potential of main over other."""
        if b.node.score is None:
            b.node.score = sum(self.weights.get(f, 0.0) for f in _path_features(b.node))
        return b.node.score + sum(self.weights.get(f, 0.0) for f in _text_features(b))

    def decode(self, emissions: list[float]) -> list[int]:
        """The likeliest labels (Viterbi); other wins ties."""
        if not emissions:
            return []
        (a, b), (c, d) = self.move.tolist()
        lo, hi, back = self.start[0], self.start[1] + emissions[0], []
        for e in emissions[1:]:
            from_lo, from_hi = (0 if lo + a >= hi + c else 1), (0 if lo + b >= hi + d else 1)
            back.append((from_lo, from_hi))
            lo, hi = max(lo + a, hi + c), max(lo + b, hi + d) + e
        path = [MAIN if hi > lo else OTHER]
        for p in reversed(back):
            path.append(p[path[-1]])
        return path[::-1]

    def extract(self, page: str | None) -> str:
        got = blocks(page or "", self.weights)
        return "\n".join(b.text for b, k in zip(got, self.decode([self.emission(b) for b in got])) if k == MAIN)


def _marginals(e: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Unary and pairwise marginals by the forward-backward recursions."""
    n = len(e)
    u = np.stack([np.zeros(n), e], axis=1)
    f, g = np.zeros((n, 2)), np.zeros((n, 2))
    f[0] = start + u[0]
    for k in range(1, n):
        f[k] = np.logaddexp(f[k - 1, 0] + move[0], f[k - 1, 1] + move[1]) + u[k]
    for k in range(n - 2, -1, -1):
        x = u[k + 1] + g[k + 1]
        g[k] = np.logaddexp(move[:, 0] + x[0], move[:, 1] + x[1])
    z = np.logaddexp(f[-1, 0], f[-1, 1])
    pair = np.exp(f[:-1, :, None] + move + (u[1:] + g[1:])[:, None, :] - z) if n > 1 else np.zeros((0, 2, 2))
    return np.exp(f + g - z), pair


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 10, rate: float = 0.3, decay: float = 4e-3) -> Field:
    """Fit the field to labelled pages by AdaGrad on the penalised conditional likelihood."""
    named = [([[*sorted(_path_features(b.node)), *_text_features(b)] for b in bs], ys) for bs, ys in pages if bs]
    seen = Counter(f for rows, _ in named for f in {f for fs in rows for f in fs})
    names = {f: k for k, f in enumerate(f for f, n in seen.items() if n >= OFTEN)}
    data = [([np.array([names[f] for f in fs if f in names], int) for fs in rows], np.array(ys)) for rows, ys in named]
    w, sq = np.zeros(len(names)), np.full(len(names), 1e-2)
    move, start, msq, ssq = np.zeros((2, 2)), np.zeros(2), np.full((2, 2), 1e-2), np.full(2, 1e-2)
    order = np.random.default_rng(3)
    for _ in range(rounds):
        for k in order.permutation(len(data)):
            feats, y = data[k]
            unary, pair = _marginals(np.array([w[f].sum() for f in feats]), move, start)
            grad = np.zeros(len(names))
            for f, err in zip(feats, (y == MAIN) - unary[:, 1]):
                grad[f] += err
            touched = np.unique(np.concatenate(feats))
            grad = grad[touched] - decay * w[touched]
            sq[touched] += grad**2
            w[touched] += rate * grad / np.sqrt(sq[touched])
            gm = -pair.sum(axis=0)
            np.add.at(gm, (y[:-1], y[1:]), 1)
            gs = np.eye(2)[y[0]] - unary[0]
            msq += (gm - decay * move) ** 2
            ssq += (gs - decay * start) ** 2
            move += rate * (gm - decay * move) / np.sqrt(msq)
            start += rate * (gs - decay * start) / np.sqrt(ssq)
    return Field({n: float(w[i]) for n, i in names.items()}, move, start)


# --- labelled pages -------------------------------------------------------------------------
# Class words seen on parts of pages, by what the part is (fixed values).
WRAPS_MAIN = "article;main;article.post;div.content;div.article.body;div.post.content;div.entry.content;section.story;div.main;main.article;div.text;article.entry;div.page.content;body".split(";")
PARTS_OTHER = {
    "nav": "nav;div.nav;div.menu;ul.menu;nav.breadcrumb;div.breadcrumbs;div.navbar;div.pagination;nav.toc;menu".split(";"),
    "header": "header;div.header;div.site.header;div.masthead;div.topbar;div.banner;div.logo;header.site".split(";"),
    "footer": "footer;div.footer;div.site.footer;div.copyright;div.legal;footer.site;div.imprint".split(";"),
    "side": "aside;div.sidebar;div.widget;aside.related;div.related;div.recommended;div.popular;section.related;div.side;div.tags;div.toplist".split(";"),
    "notice": "div.cookie;div.notice;div.cookie.banner;div.consent;div.gdpr;div.alert;div.popup;div.modal;div.overlay;section.notice;div.warning;dialog".split(";"),
    "ad": "div.ad;div.ads;div.advert;div.advertisement;div.sponsored;div.promo;aside.ad;section.ad;div.sponsor;div.banner.ad".split(";"),
    "form": "form;form.search;form.newsletter;div.subscribe;form.login;div.newsletter;div.search;fieldset;div.signup".split(";"),
    "comments": "div.comments;section.comments;div.comment;ol.comments;ul.comments;div.comment.list;section.responses;div.replies;div.disqus;div.reader.comments".split(";"),
    "share": "div.share;div.social;ul.social;div.sharing;div.byline.share;div.meta;div.author".split(";"),
}
SAYINGS = {
    "footer": ["© example.org", "Copyright 2020 all rights reserved", "© host.example.net · contact terms privacy"],
    "notice": ["We use cookies to make this site work.", "Accept all cookies", "By reading on you consent.", "Please note the new terms of service."],
    "form": ["Search", "Subscribe to our newsletter", "Log in", "Your name", "Sign up"],
    "comments": ["Posted by reader", "Reply", "3 comments", "I think so too, thanks for this."],
    "share": ["Share", "Tweet", "Share this on"],
    "ad": ["Advertisement", "Sponsored: buy now", "Read more"],
}


#: Class words on some of the pages that say nothing or mislead (chance by wrapper of main text: unknown words, a word of another part).
UNKNOWN, MISLEADING = 0.45, 0.35
PLAIN_WORDS = "free less safe open wide off no".split()


def labelled_pages(n: int = 600, seed: int = 17) -> list[tuple[list[Block], list[int]]]:
    """Composed pages with the label of every block."""
    rng = np.random.default_rng(seed)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "un", "er", "al")]
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    name = lambda: f"{word()}{word()}{word()}"  # a class name that says nothing
    wrong = sorted({w for ps in PARTS_OTHER.values() for p in ps for w in p.split(".")[1:]})

    def prose(lo: int, hi: int) -> str:
        ws = [word() for _ in range(int(rng.integers(lo, hi)))]
        return (" ".join(ws)).capitalize() + ("." if rng.random() < 0.8 else "")

    def row(node: Node, inner: tuple, text: str, linked: int, label: int) -> tuple[Block, int]:
        for t in inner:
            node = node.child(t)
        return Block(node, text, linked), label

    def other(kind: str, above: Node) -> Iterator[tuple[Block, int]]:
        named = pick(PARTS_OTHER[kind])
        tag = named.split(".")[0]
        plain = tag not in ("div", "section", "ul", "ol") and rng.random() < 0.3
        words = named.split(".")[1:]
        names = ["-".join(words)] if len(words) > 1 and rng.random() < 0.6 else [f"{words[0]}-{name()}"] if words and rng.random() < 0.3 else words
        base = above.child(tag if plain else ".".join([tag, *names, *([name()] if rng.random() < 0.3 else [])]))
        inner = {"nav": [("ul", "li"), ("li",), ()], "comments": [("p",), ("div.comment", "p"), ("li", "p"), ()], "side": [("ul", "li"), ("h3",), ("p",), ()], "header": [("h1",), ("h2",), ("p",), ("div",), ()]}.get(kind, [("p",), (), ("div",), ("label",) if kind == "form" else ()])
        listed = base.child("ul")
        for _ in range(int(rng.integers(1, 6 if kind in ("nav", "side", "comments") else 3))):
            text = pick(SAYINGS[kind]) if kind in SAYINGS and rng.random() < 0.5 else prose(1, 4) if kind == "nav" else prose(2, 40)
            linked = len(text) if kind == "nav" or (kind in ("side", "share", "ad") and rng.random() < 0.5) else 0
            way = pick(inner)
            yield row(listed, way[1:], text, linked, OTHER) if way[:1] == ("ul",) else row(base, way, text, linked, OTHER)

    def main(above: Node, few: bool) -> Iterator[tuple[Block, int]]:
        if rng.random() < 0.85:
            yield row(above, (pick(["h1", "h1", "h2", "h1.title"]),), prose(2, 14), 0, MAIN)
        leaf = pick(["p", "p", "div"])
        for _ in range(int(rng.integers(1, 4 if few else 14))):
            kind = rng.random()
            path = (leaf,) if kind < 0.6 else () if kind < 0.66 else ("h2",) if kind < 0.72 else ("blockquote", "p") if kind < 0.78 else ("ul", "li") if kind < 0.86 else ("table", "tr", "td") if kind < 0.9 else ("pre",) if kind < 0.92 else ("figure", "figcaption") if kind < 0.94 else ("div", "p") if kind < 0.97 else ("section", "p")
            text = prose(1, 5) if rng.random() < 0.25 else prose(5, 90)
            if rng.random() < 0.08:
                text = prose(2, 9) + " " + pick(["comment", "cookie", "share", "©", "reply"]) + " " + prose(2, 9)
            yield row(above, path, text, len(text) // 2 if rng.random() < 0.06 else 0, MAIN)

    out = []
    for _ in range(n):
        html = Node(None, "").child("html")
        root, rows = html.child("body"), [row(html, ("head", "title"), prose(2, 10), 0, OTHER)]
        if rng.random() < 0.15:
            rows = []
        for kind in ("notice", "header", "nav", "ad"):
            if rng.random() < (0.8 if kind == "nav" else 0.5):
                rows += other(kind, root if rng.random() < 0.7 or kind != "nav" else root.child("header"))
        wrap, above = pick(WRAPS_MAIN), root
        if wrap != "body":
            if rng.random() < 0.3:
                above = above.child(pick(["div.wrap", f"div.{name()}", "div"]))
            if rng.random() < 0.2:
                above = above.child("main")
            if rng.random() < UNKNOWN:  # tags alone, or words that nobody lists
                wrap = pick([wrap.split(".")[0], pick(["div", "section"]), f"{pick(['div', 'section', wrap.split('.')[0]])}.{name()}.{name()}"])
            if rng.random() < MISLEADING:
                wrap += "." + pick([pick(wrong), f"{pick(wrong)}-{name()}", f"{name()}-{pick(wrong)}", f"{pick(wrong)}-{pick(PLAIN_WORDS)}"])
            above = above.child(wrap)
        body = list(main(above, rng.random() < 0.2))
        for kind in ("ad", "share", "notice", "comments", "side", "form", "nav", "header", "footer"):
            if rng.random() < 0.3:
                at = 0 if kind == "header" else len(body) if kind in ("comments", "footer") else int(rng.integers(1, len(body) + 1))
                body[at:at] = other(kind, above)
        rows += body
        for kind in ("share", "side", "comments", "ad", "form", "nav", "footer"):
            if rng.random() < (0.8 if kind == "footer" else 0.35):
                rows += other(kind, root)
        out.append((shared([b for b, _ in rows]), [y for _, y in rows]))
    return out


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every page."""
    model = field or train(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, SLICE, SLICE_BYTES):
            texts = [model.extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
