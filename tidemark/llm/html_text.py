"""Main text of web pages by a linear-chain CRF over DOM leaf blocks.

A tolerant tokenizer turns a page into *leaf blocks*: runs of text between block-level tags,
each with its open ancestors (with their class and id words). Scripts, styles, comments and
other text that is never shown make no blocks. Every block gets binary features of its
ancestor tags and of its text; a linear-chain conditional random field with the two labels
keep and drop scores the sequence of a page's blocks, and Viterbi decodes it.

The field is trained here by gradient ascent on the exact conditional likelihood, on
``labelled_pages()``: pages generated from a fixed seed with known labels, in the layouts,
class names and boilerplate kinds that the web has, inside articles as well as around them.
Nothing is learned from the table.

Defined edge cases: a null or empty html gives the empty text; unclosed and stray tags are
closed or ignored as browsers do; a page without any kept block gives the empty text;
nothing is capped, features read whole texts; repeated rows give repeated results, a null
page_id stays null; only page_id, url and html are read. The text of formulas (math) is text.
"""

from __future__ import annotations

import html as html_module
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML: elements without content, elements whose text is never shown, block-level elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object textarea title select option".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an opening block-level tag closes when they are open: a paragraph by any block, others by their like.
CLOSED_BY_LIKE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
#: Ends of raw elements, searched in the page itself: a lower-cased copy may be longer than the page.
_RAW_END = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}
#: A name with its value in quotes or without; a quote opens a value only where one begins.
_ATTRIBUTE = re.compile(r"([^\s=>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DISPLAY_NONE = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
#: What a name begins with that speaks of the page's layout (with-sidebar, has-footer), not of the element's own use.
_LAYOUT = frozenset(("with", "has", "no", "without", "show", "is"))
#: The word that stands for an element that is not shown; no class name has it.
HIDDEN = "@hidden"
_PARTS = re.compile(r"[a-zA-Z][a-z]*|[A-Z]+")


def unescape(raw: str) -> str:
    """Character references decoded; the frequent ampersand is taken out first, for speed."""
    if "&" not in raw:
        return raw
    return "&".join([html_module.unescape(x) if "&" in x else x for x in raw.split("&amp;")])


Element = tuple[str, frozenset[str]]


class Block:
    """A leaf block: its open elements (outermost first) with the words of their names, its text."""

    __slots__ = ("link_chars", "path", "text")

    def __init__(self, path: tuple[Element, ...], text: str, link_chars: int):
        self.path, self.text, self.link_chars = path, text, link_chars


def names_of(attrs: str) -> frozenset[str]:
    """The words of an element's class, id and role, in lower case, and HIDDEN if it is not shown: by the attribute, the style, or a class of that name."""
    found: list[str] = []
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = [x.lower() for x in _PARTS.findall(token)]
                if parts == ["hidden"]:
                    found.append(HIDDEN)
                elif parts and parts[0] not in _LAYOUT:
                    found += parts
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _DISPLAY_NONE.search(value)):
            found.append(HIDDEN)
    return frozenset(found)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    out: list[Block] = []
    stack: list[Element] = []
    held: list[str] = []
    link_chars = 0
    shown: tuple[Element, ...] = ()

    def flush() -> None:
        nonlocal link_chars
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(shown, text, link_chars))
            held.clear()
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars, shown
        text = unescape(raw)
        if not held:
            if not text.strip():
                return
            shown = tuple(stack)
        held.append(text)
        if any(t == "a" for t, _ in stack):
            link_chars += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in BLOCK or not any(t in BLOCK for t, _ in stack[k + 1 :]):
                        del stack[k:]
                    break
            continue
        attrs = m[3] or ""
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if attrs.rstrip().endswith("/") and tag in ("svg", "iframe"):
                continue
            if end is None:
                at = n if tag in ("script", "style", "title", "textarea") else at
                continue
            close = page.find(">", end.end())
            at = n if close < 0 else close + 1
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag in ("br", "wbr", "img") and held:
                held.append(" " if tag != "wbr" else "")
            continue
        if tag in BLOCK:
            flush()
            # A block closes an open paragraph, and an item its like within the same list.
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t == "p":
                    del stack[k:]
                    break
                if t in BLOCK and t not in ("p",):
                    break
            limits = CLOSED_BY_LIKE.get(tag)
            if limits:
                like = {tag, "dt", "dd"} if tag in ("dt", "dd") else {tag, "td", "th"} if tag in ("td", "th") else {tag}
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in limits:
                        break
                    if stack[k][0] in like:
                        del stack[k:]
                        break
        elif tag == "a":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "a":
                    del stack[k]
                    break
        names: frozenset[str] = frozenset()
        if attrs:
            names = names_of(attrs)
        stack.append((tag, names))
    flush()
    return out


#: Words in class, id or role attributes that tell the use of an element, by kind.
NAME_KINDS = {
    "menu": "nav menu navbar breadcrumb breadcrumbs toc pagination pager tabs toolbar",
    "edge": "header footer masthead foot head bottom copyright legal colophon banner",
    "side": "sidebar side aside widget related recommended popular trending more rail secondary",
    "advert": "ad ads advert adverts advertisement promo sponsor sponsored banner campaign",
    "notice": "cookie cookies consent notice gdpr popup modal alert subscribe newsletter signup overlay",
    "comments": "comment comments reply replies discussion disqus respond reader",
    "social": "share sharing social follow tags meta byline author",
    "body": "article content post entry main story body text prose page",
    "hidden": HIDDEN,
}
_KIND = {w: k for k, words in NAME_KINDS.items() for w in words.split()}
_TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "div", "ul", "ol", "li", "p", "h1", "h2", "h3", "h4", "table", "td", "blockquote", "pre", "figure", "figcaption", "button", "label", "address", "dialog", "menu", "dl")
_HINTS = re.compile(r"©|\(c\)|copyright|all rights|cookie|privacy|subscribe|newsletter|sign up|log ?in|share (?:this|on)|advert|sponsored", re.I)


#: Elements that say what they are for by themselves: the article, or what is around it.
_BODY, _AROUND = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "form", "dialog", "menu"))


def _feature_names() -> list[str]:
    names = ["bias", "first", "last"]
    names += [f"in:{t}" for t in _TAGS] + [f"leaf:{t}" for t in _TAGS]
    names += [f"name:{k}" for k in NAME_KINDS]
    names += [f"near:{t}" for t in (*sorted(_BODY), *sorted(_AROUND), "nothing")] + [f"near name:{k}" for k in NAME_KINDS]
    names += [f"inner:{k}" for k in ("body", "around", "around in body", "nothing")] + ["heading of the article's header"]
    names += [f"words:{k}" for k in range(6)] + [f"links:{k}" for k in range(4)]
    names += ["stop", "comma", "hint:short", "hint:long", "digits", "depth:low", "depth:high"]
    return names


FEATURES = {name: k for k, name in enumerate(_feature_names())}


def _path_features(path: tuple[Element, ...]) -> list[int]:
    """Features of a block's ancestors."""
    # Names on html and body speak of the page.
    path = tuple(x for x in path if x[0] not in ("html", "body"))
    tags = {t for t, _ in path}
    kinds = [{_KIND[w] for w in names if w in _KIND} for _, names in path]
    found = ["bias", *(f"in:{t}" for t in tags if f"in:{t}" in FEATURES), *(f"name:{k}" for k in set().union(*kinds))]
    leaf = next((t for t, _ in reversed(path) if t in BLOCK), "")
    if f"leaf:{leaf}" in FEATURES:
        found.append(f"leaf:{leaf}")
    near = next((i for i in range(len(path) - 1, -1, -1) if kinds[i] or path[i][0] in _BODY or path[i][0] in _AROUND), None)
    if near is None:
        found.append("near:nothing")
    else:
        found += [f"near name:{k}" for k in kinds[near]] + [f"near:{path[near][0]}"] * (f"near:{path[near][0]}" in FEATURES)
    # What the innermost element that says it is for: in one element, a name of what is around articles counts more.
    uses = ["around" if t in _AROUND or k - {"body"} else "body" if t in _BODY or k else "" for (t, _), k in zip(path, kinds, strict=True)]
    inner = next((u for u in reversed(uses) if u), "nothing")
    found.append("inner:" + ("around in body" if inner == "around" and "body" in uses else inner))
    if near is not None and path[near][0] == "header" and "article" in tags and leaf in ("h1", "h2"):
        found.append("heading of the article's header")
    found.append("depth:low" if len(path) < 4 else "depth:high")
    return [FEATURES[f] for f in found]


def features_of(blocks: list[Block]) -> list[list[int]]:
    """Indices of the features that hold, for each block."""
    out = []
    context: dict[tuple, list[int]] = {}
    for i, b in enumerate(blocks):
        known = context.get(b.path)
        if known is None:
            known = context[b.path] = _path_features(b.path)
        f = known.copy()
        words = b.text.count(" ") + 1
        f.append(FEATURES[f"words:{0 if words < 2 else 1 if words < 5 else 2 if words < 10 else 3 if words < 20 else 4 if words < 60 else 5}"])
        share = b.link_chars / max(1, len(b.text))
        f.append(FEATURES[f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}"])
        if b.text[-1] in ".!?:\"”":
            f.append(FEATURES["stop"])
        if "," in b.text:
            f.append(FEATURES["comma"])
        if _HINTS.search(b.text):
            f.append(FEATURES["hint:short" if words < 60 else "hint:long"])
        if sum(map(b.text.count, "0123456789")) * 4 > len(b.text):
            f.append(FEATURES["digits"])
        if i == 0:
            f.append(FEATURES["first"])
        if i == len(blocks) - 1:
            f.append(FEATURES["last"])
        out.append(f)
    return out


class LinearChainCRF:
    """Two labels (0 drop, 1 keep); emission weights by feature and label, transition weights."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def scores(self, features: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[f].sum(0) for f in features])

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The most probable labels. Plain floats: two labels are too few for numpy."""
        (aa, ab), (ba, bb) = self.move.tolist()
        rows = scores.tolist()
        if not rows:
            return []
        x, y = rows[0]
        back: list[tuple[int, int]] = []
        for a, b in rows[1:]:
            from_x = x + aa >= y + ba, x + ab >= y + bb
            x, y = (x + aa if from_x[0] else y + ba) + a, (x + ab if from_x[1] else y + bb) + b
            back.append((0 if from_x[0] else 1, 0 if from_x[1] else 1))
        label = 0 if x >= y else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def gradient(self, features: list[list[int]], labels: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of one page and its derivatives, by forward-backward."""
        s = self.scores(features)
        n = len(s)
        fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
        fore[0] = s[0]
        for i in range(1, n):
            fore[i] = np.logaddexp.reduce(fore[i - 1][:, None] + self.move, axis=0) + s[i]
        for i in range(n - 2, -1, -1):
            aft[i] = np.logaddexp.reduce(self.move + s[i + 1] + aft[i + 1], axis=1)
        z = np.logaddexp.reduce(fore[-1])
        p = np.exp(fore + aft - z)
        emit, move = np.zeros_like(self.emit), np.zeros_like(self.move)
        value = -z
        for i, (f, label) in enumerate(zip(features, labels, strict=True)):
            value += s[i, label]
            emit[f, label] += 1
            emit[f] -= p[i]
            if i:
                value += self.move[labels[i - 1], label]
                move[labels[i - 1], label] += 1
                move -= np.exp(fore[i - 1][:, None] + self.move + s[i] + aft[i] - z)
        return value, emit, move


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 25, rate: float = 0.5, ridge: float = 0.02) -> LinearChainCRF:
    """Adagrad on the penalised conditional likelihood, pages in a fixed shuffled order."""
    crf = LinearChainCRF(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
    seen_emit, seen_move = np.full_like(crf.emit, 1e-6), np.full_like(crf.move, 1e-6)
    order = random.Random(11)
    pages = [p for p in pages if p[0]]
    for _ in range(rounds):
        order.shuffle(pages)
        for start in range(0, len(pages), 32):
            part = pages[start : start + 32]
            emit, move = -ridge * crf.emit, -ridge * crf.move
            for f, y in part:
                _, e, m = crf.gradient(f, y)
                emit += e / len(part)
                move += m / len(part)
            seen_emit += emit**2
            seen_move += move**2
            crf.emit += rate * emit / np.sqrt(seen_emit)
            crf.move += rate * move / np.sqrt(seen_move)
    return crf


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Generated pages with a label for each leaf block. No word of them is a feature by itself."""
    rng = random.Random(seed)

    def words(a: int, b: int) -> str:
        out = ["".join(rng.choice("aeioulnrstdmbk") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(a, b))]
        for k in range(len(out)):
            if rng.random() < 0.08:
                out[k] += rng.choice(",.")
        text = " ".join(out)
        style = rng.random()
        if style < 0.12:
            text = text.upper()
        elif style < 0.2:
            text = " ".join(x + rng.choice(["!!", "***", "%", "&amp;"]) for x in out)
        return text.capitalize() + rng.choice([".", ".", ".", "", "?"])

    def pick(*names: str) -> str:
        return f' class="{rng.choice(names)}"' if rng.random() < 0.85 else f' id="{rng.choice(names)}"'

    pages = []
    for _ in range(n):
        parts: list[str] = []
        labels: list[int] = []

        def put(markup: str, label: int, count: int = 1, parts=parts, labels=labels) -> None:
            parts.append(markup)
            labels.extend([label] * count)

        def links(k: int) -> str:
            return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

        def boiler(k: int) -> None:
            kind = rng.choice(["ad", "ad", "side", "notice", "menu", "form", "share", "crumbs", "plain aside", "dialog", "remarks"])
            if kind == "ad":
                put(f"<div{pick('ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo-box')}>{words(3, 40)}</div>", 0)
            elif kind == "side":
                k = rng.randint(1, 5)
                tag = rng.choice(["aside", "div"])
                put(f"<{tag}{pick('sidebar', 'side-bar', 'related', 'widget', 'popular-posts')}><h3>{words(1, 4)}</h3><ul>{links(k)}</ul><p>{words(5, 40)}</p></{tag}>", 0, k + 2)
            elif kind == "notice":
                put(f"<div{pick('cookie-notice', 'cookie', 'consent-popup', 'newsletter', 'notice')}><p>{words(5, 40)}</p></div>", 0)
            elif kind == "menu":
                k = rng.randint(2, 7)
                put(f"<{'nav' if rng.random() < 0.7 else 'div' + pick('menu', 'navbar')}><ul>{links(k)}</ul></nav></div>", 0, k)
            elif kind == "plain aside":
                if rng.random() < 0.5:
                    put(f"<aside>{words(1, 30)}</aside>", 0)
                else:
                    put(f"<aside><h4>{words(1, 4)}</h4><p>{words(4, 60)}</p></aside>", 0, 2)
            elif kind == "dialog":
                put(rng.choice([f"<dialog open><p>{words(3, 30)}</p></dialog>", f'<div role="alert">{words(3, 30)}</div>']), 0)
            elif kind == "remarks":
                k = rng.randint(1, 4)
                tag = rng.choice(["section", "div", "ol"])
                item = "li" if tag == "ol" else rng.choice(["p", "div"])
                put(f"<{tag}{pick('comments', 'comment-list', 'reader-comments', 'replies', 'discussion')}>" + "".join(f"<{item}>{words(1, 90)}</{item}>" for _ in range(k)) + f"</{tag}>", 0, k)
            elif kind == "form":
                put(f"<form action=/s><label>{words(1, 4)}</label> <input name=q><button>{words(1, 2)}</button></form>", 0)
            elif kind == "share":
                put(f"<div{pick('share', 'social-share', 'share-buttons')}><a href=#>{words(1, 2)}</a> <a href=#>{words(1, 2)}</a></div>", 0)
            else:
                put(f"<div{pick('breadcrumbs', 'breadcrumb')}><a href=/>{words(1, 2)}</a> &gt; <a href=/x>{words(1, 2)}</a></div>", 0)

        parts.append("<!DOCTYPE html><html><head><title>x</title></head><body" + rng.choice(["", "", ' class="ads-on page sidebar-left"', ' id="top"']) + ">")
        if rng.random() < 0.6:
            put(f"<header{pick('masthead', 'site-header', 'top')}><p>{words(1, 8)}</p></header>", 0)
        if rng.random() < 0.8:
            k = rng.randint(2, 8)
            put(f"<nav><ul>{links(k)}</ul></nav>", 0, k)
        for k in range(rng.randint(0, 3)):
            boiler(k)
        opened, closed = rng.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{pick('content', 'post-content', 'entry', 'article-body', 'main-text')}>", "</div>"), ('<div id="main"><section>', "</section></div>"), ("<div>", "</div>")])
        parts.append(opened)
        start = rng.random()
        if start < 0.7:
            put(f"<h1>{words(1, 12)}</h1>", 1)
        elif start < 0.85 and "<article>" in opened:
            put(f"<header><h1>{words(1, 12)}</h1>", 1)
            put(f"<p{pick('byline', 'author', 'meta')}>{words(1, 5)}</p></header>", 0)
        busy = rng.choice([0.0, 0.1, 0.35])
        for k in range(rng.randint(1, 12)):
            if rng.random() < busy:
                boiler(k)
            kind = rng.random()
            if kind < 0.62:
                put(f"<p>{words(1, 120)}</p>", 1)
            elif kind < 0.7:
                put(f"<p><b>{words(1, 60)}<br>", 1)
            elif kind < 0.76:
                put(f"<h2>{words(1, 8)}</h2>", 1)
            elif kind < 0.82:
                put(f"<ul><li>{words(2, 20)}</li><li>{words(2, 20)}</li></ul>", 1, 2)
            elif kind < 0.86:
                put(f"<blockquote>{words(4, 40)}</blockquote>", 1)
            elif kind < 0.89:
                put(f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", 1, 2)
            elif kind < 0.92:
                put(f"<p>{words(4, 30)} <a href=/y>{words(1, 4)}</a> {words(4, 30)}</p>", 1)
            elif kind < 0.95:
                put(f"<figure><img src=x><figcaption>{words(2, 20)}</figcaption></figure>", 1)
            elif kind < 0.97:
                put(f"<pre>{words(2, 30)}</pre>", 1)
            else:
                boiler(k)
        if rng.random() < 0.1 and "<article>" in opened:
            put(f"<footer>{words(1, 12)}</footer>", 0)
        if rng.random() < 0.15:
            put(f"<div{pick('comments', 'comment-list')}><p>{words(3, 40)}</p><p>{words(3, 40)}</p></div>", 0, 2)
        parts.append(closed)
        if rng.random() < 0.4:
            put(f"<{rng.choice(['section', 'div'])}{pick('comments', 'comment-list', 'reader-comments')}><h3>{words(1, 3)}</h3><p>{words(3, 60)}</p><p>{words(3, 60)}</p></div></section>", 0, 3)
        for k in range(rng.randint(0, 2)):
            boiler(k)
        if rng.random() < 0.9:
            put(f"<footer>&copy; {words(1, 30)}</footer>", 0)
        parts.append("</body></html>" if rng.random() < 0.9 else "")
        pages.append(("".join(parts), labels))
    return pages


@cache
def trained() -> LinearChainCRF:
    """The field, trained once in each process that asks for it (the driver does, and ships it)."""
    rows = []
    for page, labels in labelled_pages():
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            rows.append((features_of(blocks), labels))
    return train(rows)


def main_text(page: str, crf: LinearChainCRF) -> str:
    """Kept blocks of a page, joined by two line ends."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    labels = crf.viterbi(crf.scores(features_of(blocks)))
    return "\n\n".join([b.text for b, keep in zip(blocks, labels, strict=True) if keep])


def _extract(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shipped.value
        for batch in batches:
            texts = [main_text(x or "", crf) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, crf: LinearChainCRF | None = None) -> DataFrame:
    """The contract's columns for each row of pages."""
    shipped = pages.sparkSession.sparkContext.broadcast(crf or trained())
    return pages.select("page_id", "url", "html").mapInArrow(_extract(shipped), "page_id long, url string, text string, n_chars long")
