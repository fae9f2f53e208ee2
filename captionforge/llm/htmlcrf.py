"""Operator 5: main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: the text between two block-level tags, with the tags it stands in. A block's features
are its ancestors' names and the words of their class, id and role attributes, and its text's length, link share,
sentence marks and cue words, with those of its neighbours. The field is trained on labelled pages, which are made by
rule from the layouts below, and decoded by Viterbi in padded batches over many pages.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .crf import CRF

# Tag names by how they are treated.
RAW = frozenset("script style template noscript iframe object svg math head title textarea".split())  # noqa: SIM905
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr acronym".split())  # noqa: SIM905
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())  # noqa: SIM905
#: A start tag that ends an open element of the same kind.
CLOSES = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "option": ("option",), **{t: ("p",) for t in "h1 h2 h3 h4 h5 h6 div section article aside nav header footer main form ul ol dl table blockquote pre figure hr address fieldset".split()},
}

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(/?)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|data-y|aria-label|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Block:
    """A leaf block: its text, the tags it stands in (outermost first), attribute words and characters inside links."""

    __slots__ = ("text", "tags", "names", "linked", "label")

    def __init__(self, text: str, tags: tuple[str, ...], names: frozenset[str], linked: int, label: str):
        self.text, self.tags, self.names, self.linked, self.label = text, tags, names, linked, label


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page, in its order, with references decoded and white space turned to single spaces."""
    if not html:
        return []
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], str]] = []  # open block-level elements: name, attribute words, label
    text: list[str] = []
    links, linked = 0, 0

    def close() -> None:
        nonlocal text, linked
        if text:
            t = _SPACE.sub(" ", unescape("".join(text))).strip()
            if t:
                names = frozenset().union(*(s[1] for s in stack)) if stack else frozenset()
                out.append(Block(t, tuple(s[0] for s in stack), names, linked, next((s[2] for s in reversed(stack) if s[2]), "")))
        text, linked = [], 0

    at, n = 0, len(html)
    lower = None
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text.append(html[at:lt])
            linked += (lt - at) if links else 0
        if lt == n:
            break
        m = _PIECE.match(html, lt)
        if m is None:  # a bare < is text
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name not in INLINE and name not in VOID:
                close()
                links = 0
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            continue
        if name in RAW and not m[4]:
            if name not in INLINE:
                close()
            lower = lower if lower is not None else html.lower()
            end = lower.find(f"</{name}", at)
            if name == "head":  # may stand unclosed; body ends it as well
                body = lower.find("<body", at)
                end = min([x for x in (end, body) if x >= 0], default=at if end < 0 else end)
                at = end
                continue
            at = n if end < 0 else end
            continue
        if name == "br":
            text.append(" ")
        elif name == "a":
            links += 1
        elif name in VOID:
            if name == "hr":
                close()
        elif name not in INLINE:
            close()
            links = 0
            for c in CLOSES.get(name, ()):
                if stack and stack[-1][0] == c:
                    stack.pop()
            words, label = [], ""
            for a in _ATTR.finditer(m[3] or ""):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "data-y":
                    label = value
                elif a[1].lower() == "hidden":
                    words.append("hidden")
                else:
                    words += _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            if not m[4]:
                stack.append((name, frozenset(words), label))
    close()
    return out


# --- features ------------------------------------------------------------------------------------------------------

#: Words of class, id and role attributes that say something of a block, by what they say.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs topbar toolbar tabs pagination pager skip toc",
    "head": "header masthead banner logo branding site hero",
    "foot": "footer foot colophon copyright legal imprint bottom",
    "side": "sidebar side aside widget widgets rail related recommended recommendations popular trending more complementary",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall promo toast announcement privacy",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored banner dfp adsense adbox promoted",
    "form": "form search login signup register input button",
    "comment": "comment comments respond reply replies discussion disqus thread reader reviews",
    "share": "share sharing social tags tag follow author-bio byline meta tools",
    "content": "content article post entry story body main text page articlebody maincontent hentry",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
SECTIONS = frozenset("nav header footer aside form article main section figure figcaption table ul ol dl blockquote pre button select fieldset dialog menu details address".split())  # noqa: SIM905
#: Words of a block's text that are common in what surrounds an article.
CUES = frozenset("cookie cookies subscribe newsletter copyright rights reserved login register advertisement sponsored share comments reply privacy terms menu home search ©".split())  # noqa: SIM905


def features(bs: list[Block]) -> list[list[str]]:
    own = []
    for b in bs:
        f = ["bias", f"tag={b.tags[-1] if b.tags else '-'}"]
        f += [f"in={t}" for t in set(b.tags) & SECTIONS]
        f += [f"hint={h}" for h in {_HINT[w] for w in b.names if w in _HINT}]
        n = len(b.text)
        f.append(f"size={min(6, n.bit_length() // 2)}")
        f.append(f"links={min(3, 4 * b.linked // max(n, 1))}")
        words = b.text.split(" ")
        f.append("sentence" if b.text[-1] in ".!?:\"'”»。" else "open")
        cues = sum(w.strip(".,:;!?") in CUES for w in b.text.lower().split(" "))
        if cues:  # what they are among the words of the whole block
            f.append(f"cues={'few' if 16 * cues <= len(words) else 'some' if 4 * cues <= len(words) else 'many'}")
        f.append(f"words={min(4, len(words).bit_length())}")
        own.append(f)
    out = []
    for i, f in enumerate(own):
        e = list(f)
        for j, side in ((i - 1, "before"), (i + 1, "after")):
            if 0 <= j < len(own):
                e += [f"{side}:{x}" for x in own[j] if x.startswith(("tag=", "in=", "hint=", "links="))]
            else:
                e.append(f"{side}:none")
        out.append(e)
    return out


# --- labelled pages ------------------------------------------------------------------------------------------------

PAGES, SEED = 400, 17


def labelled(pages: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages made by rule; data-y="1" marks the article, data-y="0" what is not, also inside it."""
    r = random.Random(seed)
    syllables = "the an er on ti re la de es ch ver ein sch mo lo ka ri nu ta qu ou st é ción ment and of to".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 3)))

    def words(a: int, b: int) -> str:
        style = r.random()
        w = [word() for _ in range(r.randint(a, b))]
        if style < 0.08:
            w = [x.upper() + "!!" for x in w]
        elif style < 0.15:
            w = [x + r.choice(["***", "%%%", "###", "&amp;&amp;"]) for x in w]
        elif style < 0.2:
            return " | ".join(w)
        return " ".join(w).capitalize()

    def sentence() -> str:
        cue = r.choice(sorted(CUES)) + " " if r.random() < 0.04 else ""
        return words(1, r.choice([2, 3, 14, 14])) + f" {cue}" * bool(cue) + r.choice(".....?!")

    prose = lambda: " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    pick = r.choice

    def wrap(choices: list[str], inner: str, y: str) -> str:
        tag = pick(choices)
        return f"<{tag} data-y={y}>{inner}</{tag.split()[0]}>"

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 9)))
        return wrap(["nav", 'div class="nav"', 'div id="menu"', 'ul class="navbar"', 'div class="breadcrumbs"', 'div role="navigation"'], f"<ul>{items}</ul>" if r.random() < 0.7 else " ".join(link() for _ in range(5)), "0")

    def advert() -> str:
        return wrap(['div class="ad"', 'div class="advert"', 'aside class="ads"', 'div id="sponsored"', 'section class="promo"', 'div class="ad-box"', 'div class="advertisement banner"'], prose() if r.random() < 0.6 else f"<p>{sentence()}</p>{link()}", "0")

    def notice() -> str:
        said = pick(["We use cookies. ", "Subscribe to our newsletter. ", "This site uses cookies to improve. ", ""]) + sentence()
        return wrap(['div class="cookie-notice"', 'div id="consent"', 'section class="newsletter"', 'div class="alert"', 'div class="modal"', 'dialog'], f"<p>{said}</p><button>OK</button>" if r.random() < 0.6 else said, "0")

    def head() -> str:
        inner = pick([f"<h2>{words(1, 3)}</h2>", f"<p>{words(2, 6)}</p>", f'<div class="logo">{words(1, 2)}</div>', f"<h1>{words(1, 3)}</h1>"]) + (menu() if r.random() < 0.5 else "")
        return wrap(["header", 'div id="header"', 'div class="masthead"', 'header class="site-header"'], inner, "0")

    def foot() -> str:
        inner = pick([f"&copy; {word()}.example.com &middot; {prose()}", f"<p>Copyright {r.randint(1990, 2030)} {words(1, 4)}. All rights reserved.</p>", f"<p>{prose()}</p><ul><li>{link()}</li><li>{link()}</li></ul>", prose()])
        return wrap(["footer", 'div id="footer"', 'div class="footer"', 'footer class="site-footer"'], inner, "0")

    def side() -> str:
        inner = f"<h3>{words(1, 3)}</h3>" + pick([f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(4))}</ul>", f"<p>{prose()}</p>", "".join(f"<p>{link()} {sentence()}</p>" for _ in range(3))])
        return wrap(["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'section class="related"', 'aside class="related"'], inner, "0")

    def form() -> str:
        return f'<form data-y=0 action="/s"><label>{words(1, 3)}</label><input name="q"><p>{sentence()}</p><button>{word()}</button><select><option>{word()}<option>{word()}</select></form>'

    def comments() -> str:
        each = "".join(pick([f'<div class="comment"><p>{prose()}</p></div>', f"<li><b>{word()}</b><p>{prose()}</p></li>", f'<article class="comment"><p>{prose()}</p></article>']) for _ in range(r.randint(1, 4)))
        return wrap(['section id="comments"', 'div class="comments"', 'ol class="comment-list"', 'div id="respond"', 'div class="reader-comments"'], f"<h3>{words(1, 3)}</h3>{each}" if r.random() < 0.6 else each, "0")

    def share() -> str:
        return wrap(['div class="share"', 'ul class="social"', 'div class="tags"'], " ".join(link() for _ in range(3)), "0")

    def body() -> str:
        out = [f"<h1>{words(2, 10)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            x = r.random()
            p = f"{prose()} {link()} {prose()}" if r.random() < 0.2 else prose()
            if x < 0.1:
                out.append(f"<p><b>{p}<br><p>{prose()}</p>")
            elif x < 0.18:
                out.append(f"<h2>{words(1, 6)}</h2><p>{p}</p>")
            elif x < 0.24:
                out.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>")
            elif x < 0.28:
                out.append(f"<blockquote><p>{p}</p></blockquote>")
            elif x < 0.31:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{word()}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.34:
                out.append(f"<pre>{p}</pre>")
            elif x < 0.38:
                out.append(f"<div>{p}</div>")
            elif x < 0.41:
                out.append(f"<figure><img src='x.png'><figcaption>{sentence()}</figcaption></figure>")
            else:
                out.append(f"<p>{p}" + ("</p>" if r.random() < 0.9 else ""))
        for extra, rate in ((advert, 0.25), (share, 0.2), (side, 0.1), (notice, 0.1), (form, 0.05)):
            if r.random() < rate:
                out.insert(r.randint(0, len(out)), "</p>" + extra())
        return "".join(out)

    pages_ = []
    for _ in range(pages):
        around = [head] if r.random() < 0.4 else []
        before = [f for f, rate in ((menu, 0.75), (notice, 0.3), (advert, 0.5), (form, 0.15), (side, 0.1)) if r.random() < rate]
        after = [f for f, rate in ((side, 0.35), (comments, 0.4), (advert, 0.25), (form, 0.15), (notice, 0.2)) if r.random() < rate]
        r.shuffle(after)
        holder = pick(["article", "article", "article", "main", 'div class="content"', 'div id="main-content"', 'div class="post"', 'div class="entry-content"', 'section class="article-body"', 'div class="story"', "main><article"])
        tags = holder.split(">")
        inside = body() + (comments() if r.random() < 0.1 else "")
        article = f"<{tags[0]} data-y=1>" + "".join(f"<{t} data-y=1>" for t in tags[1:]) + inside + "".join(f"</{t.split()[0]}>" for t in reversed(tags))
        parts = [f() for f in around + before] + [article] + [f() for f in after] + ([foot()] if r.random() < 0.85 else [])
        top = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{words(2, 5)}</title><style>p{{margin:0}}</style></head><body>"
        pages_.append(top + ("<div id=wrapper>" if r.random() < 0.3 else "") + "<!-- x -->".join(parts) + ("</body></html>" if r.random() < 0.8 else ""))
    return pages_


@lru_cache(maxsize=1)
def field() -> CRF:
    """Trained once per Python process, from the labelled pages alone (a few seconds)."""
    parsed = [blocks(p) for p in labelled()]
    return CRF(["out", "text"]).fit([features(b) for b in parsed], [[int(x.label == "1") for x in b] for b in parsed], rounds=60, rate=0.2, l2=0.05)


def extract(pages: list[str | None]) -> list[str]:
    """The main text of each page: the blocks that the field labels as text, joined by line feeds."""
    crf = field()
    parsed = [blocks(p) for p in pages]
    known: dict[str, np.ndarray] = _SCORES
    ems = []
    for bs in parsed:
        rows = []
        for f in features(bs):
            s = np.zeros(2)
            for x in f:
                w = known.get(x)
                if w is None:
                    if len(known) > 100_000:
                        known.clear()
                    w = known[x] = crf.score([x])
                s = s + w
            rows.append(s)
        ems.append(np.array(rows).reshape(-1, 2))
    return ["\n".join(b.text for b, y in zip(bs, path, strict=False) if y) for bs, path in zip(parsed, crf.viterbi(ems), strict=True)]


_SCORES: dict[str, np.ndarray] = {}


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html; other columns are ignored).

    A null or empty page, or one without an article, has an empty text. Repeated rows give repeated results; an empty
    table gives an empty one. Pages are parsed one by one, so memory is bounded by the longest page of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            html = b.column("html")
            for at in range(0, b.num_rows, 256):
                texts += extract(html.slice(at, 256).to_pylist())
            cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(read(spark, sf_dir, "pages"))
