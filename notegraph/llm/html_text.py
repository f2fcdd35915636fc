"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks.  A block has its number of words, its link
density (share of words inside links), the same of both neighbours, and what its markup
says: whether it stands in the page's ``article`` or ``main``, whether the page has one
elsewhere, how strongly an element around it is marked as something else (menu, footer,
advert, ...), how many words of running text its surroundings have without such a mark, and
whether it is a heading.  A mark beyond the article counts only if the page has another
article without one, so the name of a layout spoils nothing; a name around all
text but a title is outvoted by words and link density.  A decision tree, trained on the blocks of the small
labelled pages below, tells main text from the rest.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements whose content is no text, that start a block, and that hold others.
UNSHOWN = "script style noscript template svg math iframe object canvas audio video head title"
BLOCKS = "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html input label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul"
HOLDERS = "article aside body details dialog div dl dd dt fieldset figure footer form header html li main menu nav ol option p pre section select span table td th textarea tr ul button label"
VOID = "br hr input"
#: Elements that end where the next of their kind starts.
ENDS_ITSELF = "p li dd dt option td th tr"
#: Elements that are something other than main text.
OTHER_ELEMENTS = "aside footer form menu nav button select textarea dialog fieldset"
#: Words that mark a class, id or role as such, and words that may stand beside them in a name.
OTHER_NAMES = (
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright "
    "dialog disclaimer disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted promotion "
    "recommended related replies reply responses search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar topbar widget"
)
NEUTRAL_NAMES = (
    "bar block bottom box btn button buttons container content foot global group head heading holder icons inner item items left link links list main message outer panel "
    "post posts primary reader right row secondary section site slot sticky text the title top unit user wrap wrapper"
)

_UNSHOWN, _BLOCKS, _HOLDERS, _ENDS_ITSELF, _OTHER_ELEMENTS, _OTHER_NAMES, _NEUTRAL = (set(x.split()) for x in (UNSHOWN, BLOCKS, HOLDERS, ENDS_ITSELF, OTHER_ELEMENTS, OTHER_NAMES, NEUTRAL_NAMES))
_VOID, _HEADINGS, _MAIN = set(VOID.split()), {f"h{i}" for i in range(1, 7)}, {"article", "main"}
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    rf"|<({'|'.join(x for x in UNSHOWN.split() if x != 'head')})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

#: What a block is told by, in this order.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_article", "article_elsewhere", "mark", "plain_words", "heading")
#: How an element is marked as other than main text: not, by a part of a name, by a whole name, by its kind.
PLAIN, WEAK, STRONG, KIND = 0, 1, 2, 3
#: So many words of running text are not told from more.
ENOUGH = 40

#: The labelled table: pages whose texts say what they are.  +n stands for n words of main
#: text, -n for n words of something else.
LABELLED = [
    # an article with menus, adverts, notices, forms, comments and a footer around and inside it
    "<body><nav><ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul></nav><div class=ad>-9</div><article><h1>+7</h1><p>+12<br><p>+80<p>+3<p>+40</article><footer>-11</footer></body>",
    "<body><header><h1>-2</h1><a>-1</a></header><main><h1>+5</h1><p>+1<p>+60 <a>+3</a> +20<p>+2<h2>+3</h2><p>+150<ul><li>+4<li>+6<li><a>+2</a></ul></main><footer>-4 <a>-2</a></footer></body>",
    "<body><div class=banner>-14</div><article><p>+30<aside>-20</aside><p>+9<form><label>-1</label><button>-1</button></form><p>+50<div class=related><h3>-2</h3><a>-6</a><a>-7</a></div><p>+1</article></body>",
    "<body><article><h2>+4</h2><p>+25<div class=share>-3</div><p>+70<section class=comments><h3>-1</h3><p>-45<p>-120</section></article><div class=sidebar><p>-30<p>-8</div><footer>-30</footer></body>",
    "<body><div><a>-2</a></div><article><p><a>+1</a><p>+1<p><a>+2</a><p>+3<p><a>+4</a><p>+5<h2>+2</h2><p><a>+7</a><p>+1<h3>+1</h3><p>+2 <a>+1</a><p>+4 <a>+3</a><p>+1 <a>+8</a><p>+2</article><div><a>-1</a></div><div><a>-5</a></div></body>",
    "<body><p>-3<main><p>+2<p>+4<h2><a>+3</a></h2><p>+11<p>+6<table><tr><td>+1<td>+1<tr><td>+2<td><a>+1</a></table><p>+3<pre>+9</pre><p>+1</main><p>-8<p><a>-2</a><p>-25<p>-60</body>",
    "<body><article><p>+14</article></body>", "<body><main>+1</main><footer>-2</footer></body>", "<body><article><h1>+2</h1></article></body>",
    "<body><article><p>+2<p>+1<p>+3</article><section class=comments><article><p>-40<p>-15</article><article><p>-60</article></section></body>",
    "<body><article><p>+90<p>+6</article><aside><article><h3>-5</h3><p>-20</article><article><a>-8</a></article></aside></body>",
    "<body><nav><a>-3</a></nav><article><p><a>+1</a><p><a>+9</a><p>+4 <a>+12</a><p><a>+30</a><li><a>+2</a></article><div class=widget><a>-9</a></div></body>",
    "<body><article><p class=price>+8<p class='share-price'>+6<div class='form-factor'>+40</div><p>+5<p class=cookie>-12<p class='reader-comments'>-33</article></body>",
    # layouts whose names hold such a word around the article
    "<body><div class='layout with-sidebar'><nav><a>-1</a></nav><article><h1>+5</h1><p>+60<p>+3</article></div><footer>-6</footer></body>",
    "<body class=search-page><div class='no-ads'><article><p>+45<p>+2</article></div></body>", "<body><div class=widget-area><article><p>+60<p>+9</article></div></body>",
    "<body><form><div class=header><article><h1>+3</h1><p>+55</article></div><label>-1</label></form></body>", "<body><div class=sidebar><main><p>+70<p>+20<p>+1</main></div></body>",
    "<body><form class=form><main><h1>+4</h1><p>+35<p>+1<aside>-9</aside></main><button>-1</button></form></body>", "<body><div class=modal><article><p>+2<p>+18<div class=ad>-7</div></article></div></body>",
    # articles that stand in an element of such a name themselves, and what is marked around text that does not
    "<body><nav><a>-1</a></nav><article><div class=comment><p>+40</div></article></body>", "<body><article><h1>+4</h1><div class=search><p>+55<p>+30<p>+12</div></article><footer>-8</footer></body>",
    "<body><article><section id=social><h2>+3</h2><p>+70<p>+25<p><a>+3</a> +14</section><div class=share>-2</div></article></body>", "<body><article><h1>+3</h1><div class=widget><p>+33<p>+18<div class=ad><a>-4</a></div></div></article></body>", "<body><article><p>+1<div class=notice>-60</div></article></body>", "<body><article><p>+4<aside>-30</aside><section class=comments><p>-85<p>-8</section></article></body>", "<body><article><h2>+3</h2><aside>-30<p>-70</aside></article></body>", "<body><article><form><p>-24</form></article></body>",
    "<body><main><div class=banner><h1>+5</h1><p>+16<p>+90</div></main></body>", "<body><div class=comment><p>+60<p>+45</div></body>", "<body><nav><a>-2</a></nav><div class=social><h1>+3</h1><p>+24<p>+52</div></body>",
    "<body><article><p>+14<p>+22<div class=disclaimer>-35</div><div class=outbrain><a>-9</a><a>-7</a></div><ul class=feedback-list><li>-20<li>-60</ul></article></body>",
    "<body><article><h1>+6</h1><p>+45<div class=copyright>-8</div><div id=responses><p>-12<p>-90</div></article></body>", "<body><article><p>+18<div class=notice><p>-40<p>-16</div></article></body>",
    "<body><article><p>+50<p>+120<p>+30</article></body>", "<body><main><p>+12<p>+200<p>+7</main></body>", "<body><article><h1>+9</h1><p>+160<p>+1<p>+90<p>+8</article></body>", "<body><article>+300</article><p>-9</body>",
    "<body><article><h1>+8</h1><p>+7<p>+40<p>+9<p>+60<p>+10<p>+33<p>+11<p>+80<p>+8<p>+35<p>+14</article></body>", "<body><article><p>+9<p>+60<p>+14<p>+38<p>+2</article></body>", "<body><main><p>+8<p>+44<p>+12<p>+70<p>+10</main></body>",
    "<body><nav><a>-2</a></nav><article><p>+10<p>+50<p>+7<p><a>+2</a><p>+11<p>+34<p><a>+6</a><p>+9</article></body>", "<body><div><a>-2</a></div><main><p>+13<p>+41<p>+3<p><a>+4</a><p>+8</main><div><a>-3</a></div></body>", "<body><p>-9<main><p>+11<p>+36</main></body>",
    "<body><div><a>-2</a></div><p>+60<p>+17<p>+45<p>-17<div><a>-30</a></div><p>-9</body>", "<body><p>-20<div><a>-25</a></div><h1>+4</h1><p>+50<p>+20<p>+35<div><a>-28</a></div><p>-20<div><a>-26</a></div></body>",
    "<body><div><a>-2</a></div><h1>+4</h1><p>+40<p>+74<p>+76<p>+22<p>+72<p>+71<p>+35<p>+77<p>+16<p>+73</body>",
    "<body><div><a>-24</a></div><p>-16<div><a>-27</a></div><h1>+3</h1><p>+33<p>+16<p>+58</body>",
    # pages without such an element: foot lines, banners, captions of link lists without a mark; short lines within text
    "<body><div>-12</div><div><a>-2</a></div><p>+45<p>+30<p>+4<p>+60<div>-8</div></body>", "<body><p>-10<p>+52<p>+3<p>+41<p>+2<p>+28<p>-8</body>", "<body><div>-9</div><p>+33<p>+47<p>+5<p>+64<p>-7</body>",
    "<body><div>-7</div><p>+90<p>+25<p>+55<div>-9</div></body>", "<body><div>-3</div><div><a>-2</a> <a>-3</a></div><p>+44<p>+36<p>-3<div><a>-5</a></div><div><a>-6</a></div><p>-8</body>",
    "<body><div><a>-3</a></div><p>-2<div><a>-4</a></div><p>-14<div><a>-5</a></div><h1>+4</h1><p>+70<p>+13<p>+22<p>-2<div><a>-4</a></div><p>-13<div><a>-4</a></div></body>",
    "<body><h1>+5</h1><p>+62<p>+14<p>+38<p>+13<p>+29<p>-4<ul><li><a>-3</a><li><a>-2</a></ul><div>-11</div></body>", "<body><p>-14<div><a>-2</a></div><p>+39<p>+14<p>+58<div><a>-3</a></div><p>-14<div><a>-2</a></div></body>",
    "<body><div><a>-2</a> <a>-3</a></div><p>-9<p>+44<p>+36<p>+9<p>+27</body>", "<body><div><a>-4</a></div><p>-11<p>+71<p>+11<p>+30</body>", "<body><ul><li><a>-2</a><li><a>-1</a></ul><h1>+7</h1><p>+48<p>+10<p>+66</body>",
    # pages without such an element
    "<body><div><a>-1</a> <a>-1</a> <a>-2</a></div><div><h2>+2</h2><p>+45<p>+60</div><div><a>-2</a></div></body>",
    "<body><ul><li><a>-1</a><li><a>-2</a><li><a>-3</a></ul><h1>+6</h1><p>+80 <a>+4</a><p>+20<p>+35<div><a>-9</a></div><p>-4</body>",
    "<body><p>-4<div><a>-2</a></div><div><a>-1</a></div><p>+150</body>", "<body><p>+28<p>+31<p>+16<p>+21</body>", "<body><p>+40</body>",
    "<body><h1>-2</h1><div><a>-1</a></div><div><a>-2</a></div><h2>+3</h2><p>+35<p>+52<h2>+1</h2><p>+66<div><a>-4</a> -1</div></body>",
    "<body><div class=content-with-sidebar><p>+50<p>+70<p>+22</div><div class=footer><p>-40</div></body>",
    "<body><div id=search-results><h2>+4</h2><p>+38<p>+44</div><div class=ads><p>-25</div></body>",
    "<body><div class=menu><a>-1</a><a>-1</a></div><div class=notice>-30</div><div class=post><h1>+5</h1><p>+30<p>+18<p>+90</div><div class=comments><p>-50<p>-22</div></body>",
    "<body><table><tr><td><a>-2</a><td><a>-3</a><tr><td>+48<td>+33</table><center>-5</center></body>",
]
# Whatever stands before and after it, an unmarked block of an article is main text.
_SIZES = (1, 4, 9, 20, 45, 73, 120)
LABELLED += [f"<body><nav><a>-2</a></nav><article><p>+{a}<p>+{b}<p>+{a}</article><footer>-7</footer></body>" for a in _SIZES for b in _SIZES]


class DecisionTree:
    """Binary classification tree grown by Gini impurity."""

    def __init__(self, rows: list[tuple], depth: int = 14):
        data = np.array(rows, float)
        self._root = self._grow(data[:, :-1], data[:, -1], depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        share = float(y.mean())
        if depth == 0 or share in (0.0, 1.0):
            return share
        choice = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] < cut
                p, q, w = y[left].mean(), y[~left].mean(), left.mean()
                impurity = w * p * (1 - p) + (1 - w) * q * (1 - q)
                if choice is None or impurity < choice[0] - 1e-12:
                    choice = impurity, f, float(cut)
        if choice is None:
            return share
        _, f, cut = choice
        left = x[:, f] < cut
        return f, cut, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def predict(self, row: tuple) -> float:
        """The share of main text in the leaf that ``row`` comes to."""
        node = self._root
        while isinstance(node, tuple):
            f, cut, less, more = node
            node = less if row[f] < cut else more
        return node


@functools.lru_cache(4096)
def _name_mark(names: str) -> int:
    """The mark of the value of a class, id or role: STRONG if one of its names says nothing
    but what is other, WEAK if a part of one does."""
    out = PLAIN
    for name in names.lower().split():
        words = re.findall(r"[a-z]+", name)
        if not _OTHER_NAMES.isdisjoint(words):
            out = max(out, STRONG if all(w in _OTHER_NAMES or w in _NEUTRAL for w in words) else WEAK)
    return out


def _own_mark(name: str, attributes: str, in_main: bool) -> int:
    if name in _OTHER_ELEMENTS or name == "header" and not in_main:
        return KIND
    if not attributes or name in _MAIN or name in ("body", "html"):
        return PLAIN
    if _HIDDEN.search(attributes):
        return KIND
    marks = [_name_mark(m[1] or m[2] or m[3] or "") for m in _NAMED.finditer(attributes)]
    if name == "span":  # too small to be more than a part of a sentence unless it says so
        marks = [m for m in marks if m == STRONG]
    return max(marks, default=PLAIN)


class _Place:
    """Where the next text stands: a stack of open elements, each with what holds inside it."""

    def __init__(self) -> None:
        self._stack: list[tuple[str, bool, int, int]] = []
        self._open: dict[str, int] = {}
        self.state: tuple[bool, int, int] = (False, PLAIN, PLAIN)  # in main, mark, mark beyond the article

    def push(self, name: str, attributes: str) -> bool:
        """Open an element; does it change what holds?"""
        in_main, mark, beyond = before = self.state
        own = _own_mark(name, attributes, in_main)
        if name in _MAIN:
            # Marks so far lie beyond the article from here on.
            in_main, mark, beyond = True, PLAIN, max(mark, beyond)
        else:
            mark = max(mark, own)
        self.state = in_main, mark, beyond
        self._stack.append((name, *self.state))
        self._open[name] = self._open.get(name, 0) + 1
        return self.state != before

    def pop(self, name: str) -> bool:
        """Close an element and all in it, if it is open at all; does it change what holds?"""
        before = self.state
        if self._open.get(name):
            while True:
                last = self._stack.pop()[0]
                self._open[last] -= 1
                if last == name:
                    break
            self.state = self._stack[-1][1:] if self._stack else (False, PLAIN, PLAIN)
        return self.state != before

    def starts(self, name: str) -> None:
        """A block element ends an open paragraph, and the item of its kind right before it."""
        if self._open.get("p"):
            self.pop("p")
        if name in _ENDS_ITSELF and self._stack and self._stack[-1][0] == name:
            self.pop(name)
        if name in ("td", "th") and self._stack and self._stack[-1][0] in ("td", "th"):
            self.pop(self._stack[-1][0])
        if name == "tr" and self._open.get("tr") and self._stack[-1][0] in ("td", "th"):
            self.pop("tr")


def text_blocks(page: str) -> list[tuple[str, int, int, bool, int, int, int, str, str]]:
    """(text, words, linked words, in main, mark, mark beyond the article, level of heading, space
    before, space after) of each block with text, in one pass; a stray end tag costs nothing.
    The parts of a block around a marked span are blocks of their own, with the space that
    the page has at their ends; a whole block has a space at both."""
    out: list[tuple[str, int, int, bool, int, int, int, str, str]] = []
    parts: list[tuple[str, bool]] = []
    place = _Place()
    link, heading, at, before = False, 0, 0, " "

    def flush(after: str = " ") -> None:
        nonlocal before
        if parts:
            raw = html.unescape("".join([t for t, _ in parts]))
            text = " ".join(raw.split())
            if text:
                linked = sum(len(html.unescape(t).split()) for t, own in parts if own)
                out.append((text, len(text.split()), linked, *state, heading, before or " " * raw[0].isspace(), after or " " * raw[-1].isspace()))
            elif out and raw:  # white space alone between two marked spans
                after = " "
            parts.clear()
        before = after

    for m in _TOKEN.finditer(page):
        state = place.state
        if m.start() > at:
            parts.append((page[at : m.start()], link))
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "a":
            link = not m[2]
            continue
        if name in _BLOCKS:
            flush()
            link = link and name == "br"
        if name in _HEADINGS:
            heading = 0 if m[2] else int(name[1])
        if name in _BLOCKS and not m[2] and name != "br":
            place.starts(name)
        if name in _HOLDERS and name not in _VOID:
            changed = place.pop(name) if m[2] else place.push(name, m[4] or "")
            if changed:  # a marked span
                flush("")
    state = place.state
    if at < len(page):
        parts.append((page[at:], link))
    flush()
    return out


def block_rows(blocks: list[tuple]) -> list[tuple]:
    """FEATURES of each block."""
    counts = [(n, linked / n) for _, n, linked, *_ in blocks]
    clean = [b[3] and b[5] < STRONG for b in blocks]
    if not any(clean):
        clean = [b[3] for b in blocks]
    somewhere = any(clean)
    # Words outside links, titles (h1) and marked elements, inside the article and outside: few or enough.
    plain = {own: min(ENOUGH, sum(b[1] - b[2] for b, c in zip(blocks, clean) if c == own and b[4] < STRONG and b[6] != 1)) for own in (True, False)}
    none = (0, 0.0)
    out = []
    for i, b in enumerate(blocks):
        before, after = counts[i - 1] if i else none, counts[i + 1] if i + 1 < len(counts) else none
        out.append((*counts[i], *before, *after, clean[i], somewhere and not clean[i], b[4], plain[clean[i]], b[6] > 0))
    return out


@functools.cache
def trained_tree() -> DecisionTree:
    """Trained on the blocks of the labelled pages."""
    rows = []
    for page in LABELLED:
        said = re.sub(r"([+-])(\d+)", lambda m: " ".join(m[1] * int(m[2])), page)
        blocks = text_blocks(said)
        rows += [(*row, block[0][0] == "+") for row, block in zip(block_rows(blocks), blocks)]
    return DecisionTree(rows)


def main_text(page: str, tree: DecisionTree) -> str:
    blocks = text_blocks(page)
    kept = [b for b, row in zip(blocks, block_rows(blocks)) if tree.predict(row) >= 0.5]
    return "".join([text + (" " if after or before else "") for (text, *_, after), (*_, before, _) in zip(kept, kept[1:])] + [b[0] for b in kept[-1:]])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    A null or empty html, or one without main text, gives an empty text.  Repeated rows
    give repeated rows, an empty table an empty one; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained_tree()
        for batch in batches:
            texts = [main_text(x.as_py() or "", tree) for x in batch.column("html")]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
