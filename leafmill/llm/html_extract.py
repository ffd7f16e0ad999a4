"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks. A block's features are its words and link density, those of
its neighbours, what its open elements say (article, an element for navigation or forms, a container or the block
itself named like navigation or adverts, heading, list item), and whether it reads like a sentence or a legal line. A
small tree, grown from the blocks of the labelled pages below, keeps or drops each block.

Null and empty pages give an empty text; pages may be cut off anywhere or leave elements open. Rows are
judged one by one, whole pages only; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: elements whose text is no text of the page
_RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|select|textarea|button|title|xmp|noembed|noframes"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that hold text itself; others are containers.
_LEAF = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dd", "dt", "pre", "blockquote", "figcaption", "caption", "summary", "legend"))
_FRAME = frozenset(("nav", "aside", "form", "menu", "dialog"))
_NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|social|share|sharing|related|recommend\w*|side-?bar|nav\w*|menu|breadcrumbs?|pagination|pager|foot(?:er)?|site-?header|masthead|comments?|replies|reply|respond|disqus|widget|toolbar|login|signup|search|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"))
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{_RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|aria-label|hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: A block that is a legal line, and one that ends like a sentence.
_LEGAL = re.compile(r"^(?:©|\(c\)|copyright\b)|\ball rights reserved\b|^(?:terms|privacy|imprint|impressum)\b[^.]*$", re.I)
_SENTENCE = re.compile(r"[.!?…:;][\"'”’»)\]]*$")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "in_frame", "in_named", "named", "heading", "item", "sentence", "legal")


def _framed(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is one of navigation, forms, asides, headers and footers, by its name or role, or hidden."""
    if name in _FRAME or name == "footer" or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body", "main", "article"):
        return False
    for key, *values in _ATTR.findall(attrs):
        if key.lower() == "hidden" or (key.lower() == "role" and next((v for v in values if v), "").lower() in _ROLES):
            return True
    return False


def _named(name: str, attrs: str) -> bool:
    """Whether an element's class or id is one of navigation, notices, adverts and the like."""
    if not attrs or name in ("html", "body", "main", "article"):
        return False
    return any(key.lower() in ("class", "id") and _NOISE.search(next((v for v in values if v), "")) for key, *values in _ATTR.findall(attrs))


def blocks(page: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts of the page's blocks in order, their features, and which of them a labelled page marks as main text."""
    texts: list[str] = []
    rows: list[list[float]] = []
    marks: list[bool] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, frame, named, article, marked
    pieces: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            n = text.count(" ") + 1
            texts.append(text)
            own = bool(stack) and stack[-1][0] in _LEAF
            rows.append([
                n, min(1.0, linked / n), 0, 0, 0, 0, any(s[3] for s in stack), any(s[1] for s in stack), any(s[2] for s in (stack[:-1] if own else stack)), own and stack[-1][2],
                any(s[0][0] == "h" and s[0][1:].isdigit() for s in stack), any(s[0] == "li" for s in stack), bool(_SENTENCE.search(text)), bool(_LEGAL.search(text)),
            ])
            marks.append(any(s[4] for s in stack))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if in_link:
                linked += len(html.unescape(text).split())

    at = 0
    for m in _TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "a":
            in_link = not m["end"]
        elif name == "br":
            pieces.append(" ")
        elif name in _BLOCK:
            flush()
            in_link = False
            if m["end"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if name in ("p", "li") and stack[i][0] in ("article", "nav", "div", "footer", "aside"):
                        break
            elif name not in _VOID:
                if name == "p":  # a paragraph ends where the next block begins
                    while stack and stack[-1][0] == "p":
                        stack.pop()
                elif stack and stack[-1][0] == "p":
                    stack.pop()
                if name == "li" and stack and stack[-1][0] == "li":
                    stack.pop()
                article = name in ("article", "main")
                attrs = m["attrs"] or ""
                stack.append((name, _framed(name, attrs, article or any(s[3] for s in stack)), _named(name, attrs), article, "data-main" in attrs))
        elif name == "span" and m["attrs"] and not m["end"] and (_framed(name, m["attrs"], True) or _named(name, m["attrs"])):
            flush()
            stack.append((name, True, True, False, False))
        elif m["end"] and stack and stack[-1][0] == name:
            flush()
            stack.pop()
        elif name in ("td", "th"):
            pieces.append(" ")
    add(page[at:])
    flush()
    x = np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))
    if len(rows) > 1:
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, 0:2], x[1:, 0:2]
    return texts, x, np.array(marks, dtype=bool)


def _filler(n: int, at: int, end: str = ".") -> str:
    found = "a page of ordinary words that says something about one thing or another and goes on for as long as it has to".split()
    return " ".join(found[(at * 7 + k) % len(found)] for k in range(n)) + end


def labelled_pages() -> list[str]:
    """Small pages whose elements with ``data-main`` hold the main text: an article or a plain container, with blocks of
    many lengths, links and lists in it, and menus, notices, adverts, forms, comments and legal lines in and around it."""
    out = []
    menu = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/a>About us</a></li></ul></nav>"
    bare = "<div><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div>"
    for i, n in enumerate((1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 6)):
        p = lambda k, end=".", i=i: f"<p data-main>{_filler(k, i + k, end)}</p>"
        head = f"<h1 data-main>{_filler(max(1, n % 9), i, '')}</h1>"
        linked = f"<p data-main><a href=/s>{_filler(n + 5, i)}</a></p>"
        quote = f"<blockquote data-main>{_filler(n, i + 3)}</blockquote><ul><li data-main>{_filler(n % 11 + 1, i)}</li><li data-main>{_filler(n % 7 + 2, i, '')} <a href=/x>link</a></li></ul>"
        named = f"<p data-main class=notice-text>{_filler(n + 6, i)}</p><p data-main class=search>{_filler(n + 8, i + 1)}</p>"
        related = f"<div class=related><h3>Related</h3><ul><li><a href=/1>{_filler(5, i, '')}</a></li><li><a href=/2>{_filler(7, i + 1, '')}</a></li></ul></div>"
        links = f"<ul><li><a href=/3>{_filler(4, i, '')}</a></li><li><a href=/4>{_filler(6, i + 1, '')}</a></li></ul>"
        advert = f"<div class=ad>{_filler(n, i + 5)}</div>"
        notice = f"<div class=cookie-notice><p>{_filler(n + 9, i + 2)}</p><p>{_filler(3, i, '')}</p></div>"
        form = f"<form><p>{_filler(n, i)}</p><label>Name</label></form>"
        comments = f"<section id=comments><h2>Comments</h2><p>{_filler(n + 2, i)}</p><p>{_filler(30, i)}</p></section>"
        foot = f"<footer><p>{_filler(n, i)}</p>© site · {_filler(9, i)}</footer>"
        legal = f"<div>{('Copyright 2024 acme', '© 2024 a site, all rights reserved', 'Copyright acme and others. All rights reserved.')[i % 3]}</div>"
        aside = f"<aside><h3>{_filler(2, i, '')}</h3><p>{_filler(n + 4, i)}</p></aside>"
        top = f"<header><p>{_filler(n % 5 + 1, i, '')}</p>{menu if i % 2 else ''}</header>"
        body = (p(n), p(n + 1, "") if i % 3 == 0 else p(n + 40), linked, quote, named, related, p(60), advert, p(3), links if i % 2 else "", aside, form if i % 4 == 0 else "", p(n + 25), p(1), p(2, ""))
        out.append(f"<body>{top if i % 3 else menu}{notice}<article>{head}{''.join(body)}</article>{comments}{advert}{foot}{legal}</body>")
        out.append(f"<body>{bare}{notice}{aside}<div class=content>{head}{p(n + 8)}{p(70)}{p(n + 30)}{quote if n > 5 else ''}{p(45)}{related}{p(12)}</div>{form}{comments}{legal}{foot}</body>")
        out.append(f"<body>{menu}{advert}<article>{head}{p(n)}{p(n * 3)}</article>{foot}</body>")
        said = "".join(f"<p data-main>{x}</p>" for x in ("All rights reserved.", "Copyright is a matter of law.", "Terms of use are read by few", "Copyright 2020 by those who wrote it"))
        out += [f"<article>{linked}</article>", f"<article>{p(n)}</article>", f"<body>{menu}<article>{said}{p(n)}{linked}{said}</article>{foot}</body>"]
        side = f"<div class=sidebar><h3>{_filler(2, i, '')}</h3><p>{_filler(n + 20, i)}</p>{links}</div>"
        for k, box in enumerate(("div", "section", "main")):
            inner = f"{head if k else head.replace('h1', 'h2')}{p(n + 20 * k + 6)}{p(60 - 9 * k)}{p(n + 12)}"
            out.append(f"<body>{(bare, menu, '')[(i + k) % 3]}{(notice, '', advert)[k]}<{box}>{inner}</{box}>{(side, related, comments)[(i + k) % 3]}{(legal, foot, legal)[k]}</body>")
    return out


class Tree:
    """A decision tree by Gini impurity; inner nodes are (feature, threshold, below, above), leaves 0 or 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.root = self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        if depth == 0 or len(set(y.tolist())) == 1:
            return int(y.mean() >= 0.5)
        best = (len(y) * 2.0, 0, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] < cut
                cost = sum(2 * p * (1 - p) * len(part) for part in (y[low], y[~low]) for p in [part.mean()])
                if cost < best[0] - 1e-9:
                    best = (cost, f, float(cut))
        _, f, cut = best
        low = x[:, f] < cut
        return int(y.mean() >= 0.5) if low.all() or not low.any() else (f, cut, self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)

        def walk(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                low = x[rows, node[0]] < node[1]
                walk(node[2], rows[low])
                walk(node[3], rows[~low])

        walk(self.root, np.arange(len(x)))
        return out


def train(pages: list[str] | None = None) -> Tree:
    """The tree of the labelled pages, the module's own if none are given."""
    parts = [blocks(page) for page in pages or labelled_pages()]
    return Tree(np.concatenate([x for _, x, _ in parts]), np.concatenate([y for _, _, y in parts]).astype(np.float64))


def main_text(page: str | None, tree: Tree) -> str:
    texts, x, _ = blocks(page or "")
    return "\n\n".join(t for t, keep in zip(texts, tree.predict(x), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
