"""Main text of web pages (op13): a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read once, tag by tag. Its leaf blocks are the runs of text between tags that begin or end blocks; scripts, styles, comments and the like have
none. A block is described by its ancestors (their tags, and the words of their class, id and role), by its own tag and by its text: length, links,
marks that end sentences, digits, signs. All these are features of one bit. The field has two labels, main text and the rest; a block's score for a label is the
sum of its features' weights, and neighbours' labels by the learned moves. It is trained on the driver by gradient ascent on a table of made-up
labelled pages (:func:`labelled_pages`, of fixed size), and decoded by Viterbi over all pages of a batch at once, in numpy.

Defined results: null and empty pages, and pages without blocks, have empty text; repeated rows are extracted one by one; a page that breaks off counts as
far as it goes, a tag without an end takes the rest with it; a line break is white space inside its block; other columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, trim

#: Tags that don't break the text around them.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags whose contents are no text, and tags that have no contents.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video title select textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that an opening tag closes if they are open nearer than the tags after them.
_ENDS = {
    "p": (frozenset({"p"}), frozenset("article aside body button div footer form header main nav section table td th li dd blockquote".split())),
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "p"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Feature slots: hashed names of ancestors, then text features.
SLOTS = 1 << 12
_TEXT_AT = SLOTS
WIDTH = SLOTS + 96


def _slot(name: str) -> int:
    return crc32(name.encode()) % SLOTS


@lru_cache(1 << 14)
def _named(tag: str, attributes: str) -> frozenset[int]:
    """The features that an open tag gives to all blocks inside it."""
    out = {_slot("in " + tag)}
    for m in _NAMES.finditer(attributes):
        for part in _PARTS.findall(m.group(1) or m.group(2) or m.group(3) or "")[:20]:
            out.add(_slot("named " + part.lower()))
    return frozenset(out)


@lru_cache(1 << 14)
def _own(tag: str) -> int:
    return _slot("own " + tag)


class Block:
    """A leaf block: its text, its features, whether it lies in an element that carries the label of training pages."""

    __slots__ = ("features", "labelled", "text")

    def __init__(self, text: str, features: list[int], labelled: bool):
        self.text, self.features, self.labelled = text, features, labelled


_EDGES = (1, 2, 3, 5, 8, 12, 20, 40, 80, 160)


def _level(n: int) -> int:
    return sum(n >= e for e in _EDGES)


def text_features(text: str, linked: int) -> list[int]:
    n = len(text)
    words = text.count(" ") + 1
    marks = text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?…\"”")
    out = [_level(words), 11 + min(10, 10 * linked // n), 22 + min(marks, 5), 28 + (text[-1] in ".!?…\"”"), 30 + min(text.count(","), 4)]
    digits = sum(map(text.count, "0123456789"))
    out.append(36 + min(4, 10 * digits // n))
    if "©" in text or "(c)" in text.lower():
        out.append(42)
    if "|" in text or "·" in text or "»" in text:
        out.append(43)
    out.append(44 + text[0].isupper())
    if text.isupper():
        out.append(46)
    return [_TEXT_AT + x for x in out]


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order; time grows with its length alone."""
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset[int], bool]] = [("", frozenset(), False)]
    links, pieces, linked = 0, [], 0
    pattern, at, size = _TAG, 0, len(page)
    seen: frozenset[int] = frozenset()
    labelled, own = False, ""

    def close() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(text, [*seen, _own(own), *text_features(text, min(linked, len(text)))], labelled))
        pieces, linked = [], 0

    def add(start: int, end: int) -> None:
        nonlocal linked, seen, labelled, own
        piece = page[start:end]
        if "&" in piece:
            piece = unescape(piece)
        if not pieces:
            if piece.isspace():
                return
            own, seen, labelled = next((t for t, _, _ in reversed(stack) if t not in INLINE), ""), stack[-1][1], stack[-1][2]
        pieces.append(piece)
        if links:
            linked += len(piece)

    def pop(to: int) -> None:
        nonlocal links
        for tag, _, _ in stack[to:]:
            links -= tag == "a"
        del stack[to:]

    while at < size:
        opened = page.find("<", at)
        if opened < 0:
            add(at, size)
            break
        if opened > at:
            add(at, opened)
        at = opened
        sign = page[at + 1 : at + 2]
        if sign in ("!", "?"):
            end = page.find("-->", at + 4) if page.startswith("<!--", at) else page.find(">", at)
            at = size if end < 0 else end + (3 if page.startswith("<!--", at) else 1)
            continue
        m = pattern.match(page, at)
        if not m and pattern is _TAG and re.match(r"</?[a-zA-Z]", page[at : at + 3]):
            pattern = _PLAIN_TAG  # a quote that nothing closes: from here on quotes don't count
            m = pattern.match(page, at)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[at : at + 3]):
                break  # a tag without an end
            add(at, at + 1)
            at += 1
            continue
        at = m.end()
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if tag == "br":
            if pieces:
                pieces.append(" ")
            continue
        if closing:
            if tag not in INLINE:
                close()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break  # an inline end tag reaches no further than its block
            continue
        if tag in SILENT and not attributes.endswith("/"):
            close() if tag in ("select", "textarea", "iframe", "video") else None
            end = re.compile(rf"</{tag}\b", re.IGNORECASE).search(page, at)
            if not end:
                break
            at = end.start()
            m = _PLAIN_TAG.match(page, at)
            at = m.end() if m else size
            continue
        if tag not in INLINE:
            close()
        if tag in VOID or attributes.endswith("/"):
            continue
        ends, walls = _ENDS.get(tag, (None, None))
        if ends is None and tag in _CLOSES_P:
            ends, walls = _ENDS["p"]
        if ends:
            cut = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in walls:
                    break
                if stack[i][0] in ends:
                    cut = i
            if cut:
                pop(cut)
        above = stack[-1]
        stack.append((tag, above[1] if tag in INLINE else above[1] | _named(tag, attributes), above[2] or "data-main" in attributes))
        links += tag == "a"
    close()
    return blocks


# ---- labelled pages ------------------------------------------------------------------------------

_LETTERS = "aeiou lnrst dmcpghbfvwkyzj äéñöüç"


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_LETTERS.replace(" ", "")[: rng.choice((10, 10, 20, 31))]) for _ in range(rng.randint(1, 11)))


def _sentence(rng: random.Random, least: int, most: int, end: str = ".") -> str:
    sign = rng.choice(("", "", "", "", "&amp;", "%", "***", "###", " 12", " 2019"))
    words = [_word(rng) + (rng.choice((",", sign, "")) if rng.random() < 0.2 else "") for _ in range(rng.randint(least, most))]
    return " ".join([words[0].capitalize(), *words[1:]]) + end


def _paragraph(rng: random.Random) -> str:
    style = rng.random()
    if style < 0.2:
        return _sentence(rng, 1, 4, rng.choice((".", "", ":", ". $$$")))
    if style > 0.85:  # lists and lines that look like a menu, a notice or a footer, as stories hold them too
        many = " | ".join(_word(rng) for _ in range(rng.randint(2, 16)))
        return rng.choice((many, many, f"&copy; {_sentence(rng, 2, 14)}", f"Copyright {rng.randint(1990, 2025)} {_sentence(rng, 1, 9)}", f"{rng.randint(10**6, 10**9)} {_word(rng)}@{_word(rng)}.com", _sentence(rng, 1, 6, "").upper(), _sentence(rng, 1, 9, " &middot; " + _word(rng))))
    text = " ".join(_sentence(rng, 2, 18) for _ in range(rng.randint(1, 7)))
    return f"<b>{text}" if style < 0.3 else text.replace(" ", f' <a href="/{_word(rng)}">{_word(rng)}</a> ', 1) if style < 0.45 else text


def _menu(rng: random.Random) -> str:
    links = [f'<a href="/{_word(rng)}">{_word(rng)}</a>' for _ in range(rng.randint(2, 9))]
    return rng.choice(("<ul>{}</ul>".format("".join(f"<li>{x}</li>" for x in links)), " | ".join(links), "".join(f"<span>{x}</span>" for x in links), "<ol>{}</ol>".format("".join(f"<li>{x}" for x in links))))


def _boxed(rng: random.Random, tags: str, names: str, body: str) -> str:
    tag = rng.choice(tags.split())
    name = rng.choice(("", "{}", "site-{}", "{} box", "{}-wrap", "main-{}", "page{}"))
    attribute = f' {rng.choice(("class", "class", "id", "role"))}="{name.format(rng.choice(names.split()))}"' if name or tag == "div" else ""
    if tag in ("div", "section", "dialog", "ins", "ul") and not name:  # these say nothing without a name
        attribute = f' class="{rng.choice(names.split())}"'
    return f"<{tag}{attribute}>{body}</{tag}>"


def _rest(rng: random.Random, kind: str) -> str:
    """A part of a page that isn't main text."""
    say = lambda n=8: _sentence(rng, 2, n)
    if kind == "menu":
        return _boxed(rng, "nav nav nav div", "nav menu navbar navigation breadcrumb breadcrumbs topbar toc pagination pager", _menu(rng))
    if kind == "header":
        return _boxed(rng, "header header div", "header masthead banner logo top branding", f"<{(h := rng.choice(('h1', 'p', 'div', 'h2')))}>{say(5)}</{h}>" + rng.choice(("", _menu(rng), f"<p>{say(9)}</p>")))
    if kind == "footer":
        return _boxed(rng, "footer footer footer div", "footer copyright legal colophon contentinfo bottom", rng.choice(("&copy; ", "&copy; 2021 ", "", "Copyright ")) + f"{_word(rng)}.example.com {rng.choice(('&middot; ', '| ', '- '))}" + " ".join(say(14) for _ in range(rng.randint(1, 3))) + rng.choice(("", _menu(rng))))
    if kind == "sidebar":
        return _boxed(rng, "aside aside div section", "sidebar side widget related rail recommended trending complementary popular", f"<h3>{say(4)}</h3>" + rng.choice((_menu(rng), f"<p>{say(16)} {say(12)}</p>", f"<p>{say(20)}</p><p>{say(25)}</p>")))
    if kind == "notice":
        return _boxed(rng, "div div section aside dialog", "cookie consent notice banner gdpr alert message popup modal disclaimer privacy newsletter subscribe", f"<p>{say(16)} {say(12)}</p>" + rng.choice(("", "<button>OK</button>", f'<a href="#">{_word(rng)}</a>')))
    if kind == "advert":
        return _boxed(rng, "div div div aside ins", "ad ads advert advertisement sponsor sponsored promo adsbox banner promotion", rng.choice((say(16), f"<p>{say(14)}</p>", f'<a href="http://{_word(rng)}.com">{say(6)}</a>', f"{say(18)} {say(9)}")))
    if kind == "form":
        fields = "".join(f"<label>{_word(rng)}</label><input name=q>" for _ in range(rng.randint(1, 4)))
        return _boxed(rng, "form form", "search login signup contact subscribe", f"<p>{say(12)}</p>{fields}<select><option>{_word(rng)}<option>{_word(rng)}</select><button>{_word(rng)}</button>")
    one = lambda: f'<{(t := rng.choice(("li", "div", "article")))} class="{rng.choice(("comment", "comment", "reply", "comment-body"))}"><{(h := rng.choice(("h4", "span", "p")))}>{_word(rng)}</{h}><p>{_paragraph(rng)}</p></{t}>'
    return _boxed(rng, "section div div ul", "comments comment-list discussion responses replies disqus", rng.choice(("", f"<h3>{say(3)}</h3>")) + "".join(one() for _ in range(rng.randint(1, 6))))


def _story(rng: random.Random) -> str:
    """The main text, in one of the usual layouts."""
    title = _sentence(rng, 1, 14, "")
    paragraphs = [_paragraph(rng) for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14)))]
    broken = rng.random() < 0.3
    body = "".join(rng.choice((f"<p>{t}</p>",) * 6 + (f"<p>{t}<br>", f"<h2>{_sentence(rng, 1, 7, '')}</h2><p>{t}</p>", f"<blockquote>{t}</blockquote>", f"<p>{t}")) if broken or rng.random() < 0.4 else f"<p>{t}</p>" for t in paragraphs)
    if rng.random() < 0.25:
        body += "<{0}>{1}</{0}>".format(rng.choice(("ul", "ol")), "".join(f"<li>{_sentence(rng, 2, 12)}</li>" for _ in range(rng.randint(2, 6))))
    if rng.random() < 0.1:
        body += f"<table><tr><th>{_word(rng)}<th>{_word(rng)}<tr><td>{rng.randint(1, 99)}<td>{_sentence(rng, 1, 5)}</table>"
    if rng.random() < 0.15:
        body += f"<figure><img src=x><figcaption>{_sentence(rng, 2, 12)}</figcaption></figure>"
    return rng.choice(("", f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<h2>{title}</h2>")) + body


KINDS = ("menu", "header", "footer", "sidebar", "notice", "advert", "form", "comments")


def labelled_pages(n: int = 800, seed: int = 11) -> list[str]:
    """``n`` made-up pages whose main text lies in elements with the attribute ``data-main``."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        shell, names = rng.choice((("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="article-body"'), ("div", ' class="post-content entry"'), ("section", ' class="story text"'), ("div", ' role="main"')))
        story = f"<{shell}{names} data-main>{_story(rng)}</{shell}>"
        if shell in ("main", "article") and rng.random() < 0.2:  # something else between two parts of the story
            story = f"<{shell}{names}><div data-main>{_story(rng)}</div>{_rest(rng, rng.choice(('advert', 'notice', 'sidebar', 'form')))}<div data-main>{_story(rng)}</div></{shell}>"
        before = [_rest(rng, k) for k in ("notice", "header", "menu", "form", "advert", "sidebar") if rng.random() < (0.7 if k == "menu" else 0.3)]
        after = [_rest(rng, k) for k in ("advert", "sidebar", "comments", "form", "notice", "menu", "footer") if rng.random() < (0.75 if k == "footer" else 0.3)]
        if rng.random() < 0.3:
            rng.shuffle(before)
        middle = "".join([*before, story, *after])
        if rng.random() < 0.25:
            middle = f'<div class="{rng.choice(("page", "wrapper", "container", "layout"))}">{middle}</div>'
        end = "</body></html>" if rng.random() < 0.85 else ""
        out.append(f"<!DOCTYPE html><html><head><title>{_sentence(rng, 1, 9, '')}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{middle}{end}")
    return out


# ---- the field -----------------------------------------------------------------------------------


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))


def _emissions(weights: np.ndarray, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Scores of both labels for each block; block i has features[starts[i] : starts[i + 1]], at least one."""
    return np.add.reduceat(weights[features], starts, axis=0)


def train(pages: list[list[Block]], steps: int = 120, rate: float = 0.15, penalty: float = 1e-4, text_penalty: float = 3e-2) -> dict[str, np.ndarray]:
    """Maximum likelihood with a square penalty, by Adam over all pages; weights of text features cost more than those of ancestors."""
    cost = np.full((WIDTH, 1), penalty)
    cost[_TEXT_AT:] = text_penalty
    pages = [p for p in pages if p]
    n, longest = len(pages), max(map(len, pages))
    flat = [b for p in pages for b in p]
    features = np.concatenate([np.array(b.features) for b in flat])
    sizes = np.array([len(b.features) for b in flat])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    row = np.repeat(np.arange(n), [len(p) for p in pages])
    col = np.concatenate([np.arange(len(p)) for p in pages])
    mask = np.zeros((n, longest), bool)
    mask[row, col] = True
    gold = np.zeros((n, longest), np.int64)
    gold[row, col] = [b.labelled for b in flat]
    goal = np.eye(2)[gold] * mask[:, :, None]
    both = mask[:, 1:] & mask[:, :-1]
    goal_moves = np.einsum("nti,ntj,nt->ij", goal[:, :-1], goal[:, 1:], both)
    state = {"w": np.zeros((WIDTH, 2)), "move": np.zeros((2, 2))}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in state.items()}
    for step in range(1, steps + 1):
        e = np.zeros((n, longest, 2))
        e[row, col] = _emissions(state["w"], features, starts)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = _lse(forward[:, t - 1, :, None] + state["move"], 1) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _lse(state["move"] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = _lse(forward[:, -1], 1)[:, None, None]
        p = np.exp(np.minimum(forward + backward - z, 0)) * mask[:, :, None]
        pair = np.exp(np.minimum(forward[:, :-1, :, None] + state["move"] + (e + backward)[:, 1:, None, :] - z[..., None], 0)) * both[:, :, None, None]
        off = (goal - p)[row, col]
        lost = np.stack([np.bincount(features, np.repeat(off[:, k], sizes), WIDTH) for k in (0, 1)], axis=1)
        for k, g in (("w", lost / n - cost * state["w"]), ("move", (goal_moves - pair.sum((0, 1))) / n - penalty * state["move"])):
            m = moments[k]
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            state[k] = state[k] + rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in state.items()}


def viterbi(model: dict[str, np.ndarray], pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block is main text; a step takes the t-th block of all pages that have one."""
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: -len(pages[i]))
    out = [np.zeros(0, bool)] * len(pages)
    if not order:
        return out
    flat = [b.features for i in order for b in pages[i]]
    e = _emissions(model["w"], np.concatenate(flat), np.r_[0, np.cumsum([len(f) for f in flat])[:-1]])
    sizes = np.array([len(pages[i]) for i in order])
    heads = np.r_[0, np.cumsum(sizes)[:-1]]
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    back, last = np.zeros((len(flat), 2), np.int8), np.zeros(len(order), np.int64)
    score = e[heads]
    for t in range(1, len(live)):
        ended = slice(live[t], live[t - 1])
        last[ended] = score[ended].argmax(axis=1)
        at = heads[: live[t]] + t
        options = score[: live[t], :, None] + model["move"]
        back[at] = options.argmax(axis=1)
        score = options.max(axis=1) + e[at]
    last[: len(score)] = score.argmax(axis=1)
    label = np.zeros(len(flat), bool)
    for t in range(len(live) - 1, -1, -1):
        at = heads[: live[t]] + t
        label[at] = last[: live[t]]
        last[: live[t]] = back[at, last[: live[t]]]
    for i, head, size in zip(order, heads.tolist(), sizes.tolist(), strict=True):
        out[i] = label[head : head + size]
    return out


@lru_cache(1)
def trained() -> dict[str, np.ndarray]:
    return train([leaf_blocks(p) for p in labelled_pages()])


#: Characters of pages that one decoding takes together.
CHARS_AT_ONCE = 1_000_000


def extract(model: dict[str, np.ndarray], pages: list[str]) -> list[str]:
    """The main text of each page."""
    out, group, size = [], [], 0

    def decode():
        for blocks, label in zip(group, viterbi(model, group), strict=True):
            out.append("\n".join(b.text for b, main in zip(blocks, label, strict=True) if main))
        group.clear()

    for page in pages:
        group.append(leaf_blocks(page))
        size += len(page)
        if size >= CHARS_AT_ONCE:
            decode()
            size = 0
    decode()
    return out


def main_text(html: Column, spark, model: dict[str, np.ndarray] | None = None) -> Column:
    """The main text of pages as a column; null gives the empty text."""
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(model or trained())  # weights by slot: of fixed size

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        out = pd.Series(extract(shipped.value, pages.tolist()), dtype=object)
        trim()
        return out

    return run(F.coalesce(html, F.lit("")))


def extracted(pages: DataFrame, html_col: str = "html", model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``pages`` without ``html_col``, with ``text`` and ``n_chars`` (of old columns of these names the new ones take the place)."""
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    return pages.select(*kept, main_text(F.col(html_col), pages.sparkSession, model).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
l AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(h, '</?(p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM a),
t AS (SELECT page_id, url, replace(regexp_replace(regexp_replace(array_to_string(b, chr(10)), '&quot;', '"', 'g'), '&(lt|gt);', '<', 'g'), '&amp;', '&') AS text FROM l)
SELECT page_id, url, regexp_replace(text, '&amp', '&', 'g') AS text, length(regexp_replace(text, '&amp', '&', 'g')) AS n_chars FROM t"""
