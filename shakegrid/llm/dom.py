"""A tolerant reading of HTML into block elements, and labelled pages to learn from."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>",
    re.S,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noscript noembed noframes xmp template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "li main menu nav ol p pre section summary table ul".split()
)
#: A start tag ends an open element of these names, up to the nearest of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


class Page:
    """Block elements in page order (``parent`` before child, 0 is the page) and pieces of text with their element.

    Labels are read from data-y attributes only where ``labelled`` says that the page is a training page.
    """

    __slots__ = ("tag", "names", "parent", "depth", "label", "pieces", "chars", "linked")

    def __init__(self, source: str | None, labelled: bool = False):
        self.tag, self.names, self.parent, self.depth, self.label = ["#page"], [()], [-1], [0], [1]
        self.pieces: list[tuple[int, str]] = []
        self.chars, self.linked = [0], [0]
        self._read(source or "", labelled)

    def _read(self, source: str, labelled: bool) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]  # inline elements have the node of the block around them
        run: list[str] = []
        links, at, p_open = 0, 0, 0
        opened: dict[str, int] = {}

        def flush() -> None:
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    self.pieces.append((stack[-1][1], text))
                run.clear()

        def say(text: str) -> None:
            run.append(text)
            n = len(text) - text.count(" ")
            node = stack[-1][1]
            self.chars[node] += n
            if links:
                self.linked[node] += n

        def pop() -> None:
            nonlocal links, p_open
            name, node = stack.pop()
            links -= name == "a"
            p_open -= name == "p"
            opened[name] -= 1

        while m := TOKEN.search(source, at):
            if m.start() > at:
                say(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if name == "br":
                flush()
                continue
            if closing:
                if opened.get(name):
                    if name not in INLINE:
                        flush()
                    while stack[-1][0] != name:
                        if stack[-1][0] not in INLINE:
                            flush()
                        pop()
                    pop()
                continue
            if name in RAW:
                end = RAW_END[name].search(source, at)
                at = end.end() if end else len(source)
                continue
            if name in INLINE:
                stack.append((name, stack[-1][1]))
                opened[name] = opened.get(name, 0) + 1
                links += name == "a"
                continue
            flush()
            if name in VOID:
                continue
            if p_open and name in CLOSES_P:
                while stack[-1][0] != "p":
                    pop()
                pop()
            if name in ENDS and any(opened.get(n) for n in ENDS[name][0]):
                shut, stop = ENDS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in shut:
                        while len(stack) > k:
                            pop()
                        if name in ("tr",):
                            continue
                        break
                    if stack[k][0] in stop:
                        break
            names, label = [], None
            if "=" in attributes:
                for key, *value in NAMED.findall(attributes):
                    if key.lower() == "data-y":
                        label = int("".join(value)) if labelled else None
                    else:
                        names += WORD.findall("".join(value).lower())
            up = stack[-1][1]
            self.tag.append(name)
            self.names.append(tuple(dict.fromkeys(names)))
            self.parent.append(up)
            self.depth.append(self.depth[up] + 1)
            self.label.append(self.label[up] if label is None else label)
            self.chars.append(0)
            self.linked.append(0)
            stack.append((name, len(self.tag) - 1))
            opened[name] = opened.get(name, 0) + 1
            p_open += name == "p"
        if at < len(source):
            say(source[at:])
        flush()


# ---- labelled pages ----------------------------------------------------------------------------

# A vocabulary of our own for training pages: names that authors of pages give to the parts of a page.
PARTS = {
    "menu": "nav navbar menu navigation topnav breadcrumb breadcrumbs pagination links sitemap",
    "header": "header masthead top branding logo banner siteheader",
    "footer": "footer bottom copyright colophon legal sitefooter",
    "side": "sidebar side aside widget related recommended popular trending tags share social author",
    "notice": "notice cookie consent alert gdpr popup modal overlay message warning privacy",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense",
    "form": "form newsletter subscribe signup login search contact",
    "comments": "comments comment reply replies discussion respond thread disqus",
}
CONTENT = "content article post entry main story text body maincontent articlebody page"
SYLLABLES = "an be co de en fi ga he in jo ka le mi no or pa qu re sa te un va wi xo ya ze".split()


def _words(rng: np.random.Generator, n: int, title: bool = False) -> str:
    ws = ["".join(rng.choice(SYLLABLES, rng.integers(1, 5))) for _ in range(n)]
    for i in range(n - 1):
        if not title and rng.random() < 0.12:
            ws[i] += rng.choice([",", ".", ".", ";"])
    return " ".join(ws).capitalize() + ("" if title else ".")


def _named(rng: np.random.Generator, names: str, often: float) -> str:
    if rng.random() > often:
        return ""
    got = rng.choice(names.split(), rng.integers(1, 3), replace=False)
    return f' {rng.choice(["class", "class", "id"])}="{rng.choice([" ", "-", "_"]).join(got)}"'


def _part(rng: np.random.Generator, kind: str, often: float) -> str:
    """A part of a page that is none of its article."""
    own = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "notice": "div", "advert": "div", "comments": "section"}[kind]
    semantic = rng.random() < 0.6
    tag = own if semantic and kind != "form" or kind == "form" else rng.choice(["div", "div", "section", "ul" if kind == "menu" else "div"])
    names = _named(rng, PARTS[kind], often if semantic and own not in ("div", "section") else max(often, 0.9))
    link = lambda n: f'<a href="/{rng.integers(9999)}">{_words(rng, n, True)}</a>'
    if kind == "menu" or kind == "side" and rng.random() < 0.5:
        items = "".join(f"<li>{link(rng.integers(1, 4))}{'</li>' if rng.random() < 0.8 else ''}" for _ in range(rng.integers(3, 9)))
        inner = items if tag == "ul" else f"<ul>{items}</ul>"
    elif kind == "comments":
        one = lambda: f"<{'div' if tag != 'ul' else 'li'}{_named(rng, PARTS[kind], 0.7)}><p>{_words(rng, rng.integers(3, 40))}</p></div>"
        inner = (f"<h3>{_words(rng, 2, True)}</h3>" if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.integers(1, 6)))
    elif kind == "form":
        inner = f"<label>{_words(rng, 2, True)}</label><input name=q><p>{_words(rng, rng.integers(2, 12))}</p><button>{_words(rng, 1, True)}</button>"
    else:
        inner = rng.choice([f"<p>{_words(rng, rng.integers(2, 25))}</p>", _words(rng, rng.integers(2, 25)), f"<h2>{_words(rng, 3, True)}</h2><p>{_words(rng, rng.integers(2, 20))} {link(2)}</p>"])
    return f'<{tag}{names} data-y="0">{inner}</{tag}>'


def _article(rng: np.random.Generator, often: float) -> str:
    blocks = [f"<h1>{_words(rng, rng.integers(2, 12), True)}</h1>"] if rng.random() < 0.85 else []
    lengths = rng.choice(np.array([1, 3, 8, 20, 60, 150, 600]), rng.integers(1, 8))  # an article may hold short paragraphs only
    for _ in range(rng.integers(1, 25)):
        n, r = int(rng.choice(lengths)) + int(rng.integers(0, 8)), rng.random()
        if r < 0.7:
            inner = _words(rng, n)
            if rng.random() < 0.3:
                inner = f'{inner} <a href="/x">{_words(rng, rng.integers(1, 5), True)}</a> {_words(rng, rng.integers(1, 9))}'
            blocks.append(f"<p>{'<b>' if rng.random() < 0.2 else ''}{inner}{rng.choice(['</p>', '</p>', '<br>', ''])}")
        elif r < 0.8:
            h = f"h{rng.integers(2, 5)}"
            blocks.append(f"<{h}>{_words(rng, rng.integers(1, 8), True)}</{h}><p>{_words(rng, n)}")
        elif r < 0.87:
            blocks.append("<ul>" + "".join(f"<li>{_words(rng, rng.integers(1, 15))}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
        elif r < 0.92:
            blocks.append(f"<blockquote>{_words(rng, n)}</blockquote>")
        elif r < 0.95:
            blocks.append("<table>" + "".join(f"<tr><td>{_words(rng, 2)}</td><td>{_words(rng, 3)}</td></tr>" for _ in range(3)) + "</table>")
        elif r < 0.97:
            blocks.append(f"<div>{_words(rng, n)}</div>")
        else:
            blocks.append(_part(rng, rng.choice(["advert", "side", "form", "notice", "menu", "advert"]), often))
    if rng.random() < 0.15:
        blocks.append(_part(rng, rng.choice(["comments", "side", "footer"]), max(often, 0.9)))
    return "".join(blocks)


def labelled_pages(n: int, seed: int) -> Iterator[str]:
    """Pages in many layouts; an attribute data-y marks where the article (1) and other parts (0) begin."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        often = rng.choice([0.2, 0.6, 1.0])
        kind = rng.choice(["article", "main", "div", "div", "bare"], p=[0.4, 0.15, 0.2, 0.15, 0.1])
        body = _article(rng, often)
        if kind == "article" and rng.random() < 0.3:
            core = f'<main data-y="1"><article{_named(rng, CONTENT, often)} data-y="1">{body}</article></main>'
        elif kind == "bare":
            core = f'<div data-y="1">{body}</div>' if rng.random() < 0.7 else f'<section data-y="1">{body}</section>'
        else:
            names = _named(rng, CONTENT, often if kind != "div" else max(often, 0.85))
            core = f'<{kind}{names} data-y="1">{body}</{kind}>'
        before = [_part(rng, k, often) for k in ("header", "menu", "notice", "advert", "form", "side") if rng.random() < 0.45]
        after = [_part(rng, k, often) for k in ("comments", "side", "advert", "form", "notice", "menu", "footer") if rng.random() < 0.4]
        rng.shuffle(before)
        inner = "".join(before) + core + "".join(after)
        if rng.random() < 0.4:
            inner = f'<div{_named(rng, "wrapper container page site layout outer row", 0.7)} data-y="0">{inner}</div>'
        yield f'<!DOCTYPE html><html data-y="0"><head><title>x</title></head><body>{inner}</body></html>'
    for _ in range(n // 30):
        yield f"{_words(rng, int(rng.integers(1, 200)))}"
