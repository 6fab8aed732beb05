"""HTML extraction by line-block distribution.

Markup is cut into lines, one for each block of the page.  Lines that the markup
says are not part of the article (navigation, headers, footers, asides, forms,
adverts, cookie notices, reader comments) go.  Names that may stand for parts of an
article too (legal, form, social, related and so on) are believed outside article
elements only; inside, such a line goes if it is mostly links.  Each other line weighs as many characters
as its text has, and nothing if it is mostly links.  Sums of weights over sliding
windows of WINDOW lines show a surge where the article begins and a dive where it
ends: the first and the last line of a window that reaches SURGE, and the lines
with a weight right before and after.  All lines between surge and dive are kept.

Article and main elements raise weights, if they hold at least as many characters
as the rest of the page: their lines, mostly links or not, weigh RAISED times as
much, and windows inside and outside sum up their own side only.  Beside them, a
line in an element with a name of its own (trending, discussion: whatever it is
called) needs a window as heavy as the article's heaviest, and does not count in
that comparison.  If article elements hold fewer characters (a teaser card beside a
body without an element), they change nothing.

Character references are decoded after the markup is gone, white space inside a
block becomes one space, and blocks are joined in page order by one space.

Defined results: a null or empty page, and one without text, or of marked lines
and links only, gives the empty string; where no window makes a surge, the span is
from the first to the last line with the highest kind of weight; unclosed elements
end where an enclosing one ends; pages of any length and depth are read whole, in
time linear in their length; repeated rows give one row each, rows with a null id
too; an empty table gives no rows; only page_id, url and html are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window, weight in a window that makes a surge, and how much more lines in article elements weigh.
WINDOW, SURGE, RAISED = 3, 80, 4

#: Names of elements of HTML.
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("head nav footer aside form button select textarea menu dialog fieldset noscript template iframe object svg canvas audio video title".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Parts of class and id names that mark something else than the article, and names that do so as a whole.
_MARKED = re.compile(
    r"ads?|advert\w*|adsense|banners?|sponsor\w*|promos?|promotions?|promoted|sidebar|sidenav|nav|navbar|navigation|navigator|menus?|menubar|breadcrumbs?|pagination|pager|footer|masthead|topbar|"
    r"cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comments?|commentlist|disqus|respond|replies|reply|tagcloud|searchform",
    re.IGNORECASE,
)
#: Parts of names that say so outside article elements only.
_DOUBTFUL = re.compile(
    r"notices?|notification|alerts?|share|sharing|sharebar|social|related|recommended|recommendations?|tags|toolbar|search|skip|copyright|legal|disclaimer|widgets?|forms?",
    re.IGNORECASE,
)
_COMMENT = re.compile(r"comments?|commentlist|disqus|respond|replies|reply", re.IGNORECASE)
_MARKED_WHOLE = frozenset("side-bar site-header page-header top-header global-header header-bar tag-cloud print-only".split())
#: Parts of names that say where or in what shape something stands, not what it is.
_SHAPE = re.compile(
    r"box|bars?|blocks?|wrap|wrapper|container|content|section|area|zone|slot|unit|list|items?|links?|btn|buttons?|icons?|inner|outer|main|site|page|post|entry|article|blog|global|primary|secondary|top|bottom|left|right|header|head|"
    r"title|body|text|panel|card|row|col|column|group|holder|module|component|region|layer|sticky|fixed|mobile|desktop|small|large|count|thread|bar|to|me|us|js|is|has|the|my|no|[a-z]?\d+\w*|",
    re.IGNORECASE,
)
_RAW = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>", re.IGNORECASE | re.DOTALL)
#: A quote opens a value only after an equals sign; elsewhere it is a character like any.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
_NAME = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Elements that an end tag may leave open, and what they close when they start again.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}


def _says(value: str, what: re.Pattern) -> bool:
    """Whether one of the names in a class or id is made of a part that matches and of words for shapes or other marks only."""
    for name in value.lower().split():
        if what is _MARKED and name in _MARKED_WHOLE:
            return True
        parts = re.split("[-_]", name)
        if any(what.fullmatch(p) for p in parts) and all(what.fullmatch(p) or _MARKED.fullmatch(p) or _DOUBTFUL.fullmatch(p) or _SHAPE.fullmatch(p) for p in parts):
            return True
    return False


def _names(name: str, attributes: str) -> list[str]:
    """The values of class and id that may say what an element is; ids of headings name places."""
    if not attributes or name in ("html", "body"):
        return []
    found = ((key.lower(), next((v for v in values if v), "")) for key, *values in _NAME.findall(attributes))
    return [value for key, value in found if key == "class" or key == "id" and name not in _HEADING]


def _is_marked(name: str, attributes: str, inside: bool) -> bool:
    if name in _SKIP:
        return True
    if name == "header":
        return not inside
    if not attributes:
        return False
    if any(_says(value, _COMMENT if name in ("article", "main") else _MARKED) for value in _names(name, attributes)):
        return True
    for key, *values in _NAME.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "role" and value.lower() in _ROLE:
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True
    return False


def _judged(name: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element is marked outside and inside an article, has a doubtful name, and a name of its own."""
    said = _names(name, attributes)
    own = any(not _SHAPE.fullmatch(p) for v in said for p in re.split(r"[-_\s]+", v))
    return _is_marked(name, attributes, False), _is_marked(name, attributes, True), any(_says(v, _DOUBTFUL) for v in said), own


#: Pages use the same few attributes again and again; those longer than so many characters are not remembered.
_remembered, _LONG = lru_cache(maxsize=1 << 14)(_judged), 200


@dataclass
class Line:
    text: str
    linked: int  # characters in links
    marked: bool  # as something else than the article
    doubtful: bool  # by a name that is believed outside article elements only
    inside: bool  # an article or main element
    named: bool  # in an element with a name of its own that holds no article element


@dataclass
class _Open:
    name: str
    marked: bool
    doubtful: bool
    article: bool
    named: bool
    holds: bool = False  # an article element


def lines(page: str) -> list[Line]:
    """A line for each block with text."""
    page = _RAW.sub("", page)
    out: list[tuple[Line, _Open | None]] = []
    text: list[str] = []
    linked = 0
    stack: list[_Open] = []
    named: list[_Open] = []
    opened: Counter[str] = Counter()  # names on the stack
    marked = doubtful = articles = links = 0

    def end_line() -> None:
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((Line(line, min(linked, len(line)), marked > 0, doubtful > 0, articles > 0, False), named[-1] if named else None))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal marked, doubtful, articles
        while len(stack) > depth:
            e = stack.pop()
            opened[e.name] -= 1
            marked -= e.marked
            doubtful -= e.doubtful
            articles -= e.article
            if e.named:
                named.pop()

    at = 0
    for tag in _TAG.finditer(page):
        if tag.start() > at:
            piece = page[at : tag.start()]
            text.append(piece)
            if links:
                linked += len(piece.strip())
        at = tag.end()
        ending, name, attributes = tag.groups()
        name = name.lower()
        if name == "a":
            links = 0 if ending else 1
            continue
        block = name in _BLOCK or name in _SKIP
        opens = not ending and name not in _VOID
        outer, inner, doubt, own = (_remembered if len(attributes) <= _LONG else _judged)(name, attributes) if opens and (attributes or block) else (False,) * 4
        if not block and not (inner if articles else outer) and not doubt and not opened[name]:
            continue
        if block:
            end_line()
        if ending:
            if opened[name]:
                if not block:
                    end_line()
                close(next(depth for depth in range(len(stack) - 1, -1, -1) if stack[depth].name == name))
        elif opens and not attributes.endswith("/"):
            if closing := _CLOSES.get(name):
                while stack and stack[-1].name in closing:
                    close(len(stack) - 1)
            if not block:
                end_line()
            article = name in ("article", "main") or 'role="main"' in attributes
            e = _Open(name, inner if articles else outer, doubt and not article, article, own and not article)
            if article:
                for holder in reversed(stack):  # those further out are told already
                    if holder.holds:
                        break
                    holder.holds = True
            stack.append(e)
            opened[name] += 1
            marked += e.marked
            doubtful += e.doubtful
            articles += article
            if e.named:
                named.append(e)
    text.append(page[at:])
    end_line()
    for line, element in out:
        line.named = element is not None and not element.holds
    return [line for line, _ in out]


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    linked_lines = [(line, 2 * line.linked > len(line.text)) for line in lines(page)]
    found = [(line, linked) for line, linked in linked_lines if not line.marked and not (line.doubtful and (linked or not line.inside))]
    inside = sum(len(line.text) for line, _ in found if line.inside)
    raised = inside > 0 and inside >= sum(len(line.text) for line, _ in found if not line.inside and not line.named)
    sure = [raised and line.inside for line, _ in found]
    apart = [raised and not line.inside and line.named for line, _ in found]
    weight = [RAISED * len(line.text) if s else 0 if linked else len(line.text) for (line, linked), s in zip(found, sure, strict=True)]
    if not any(weight):
        return ""

    def window(begin: int, i: int) -> int:
        """The weight of the window at begin, of lines of the kind of line i."""
        return sum(weight[j] for j in range(max(0, begin), min(len(found), begin + WINDOW)) if (sure[j], apart[j]) == (sure[i], apart[i]))

    heaviest = max((window(i, i) for i in range(len(found)) if sure[i]), default=0)

    def reaches(i: int, begin: int) -> bool:
        """Whether the window at begin, in which line i stands, makes a surge of that line."""
        return weight[i] > 0 and window(begin, i) >= (max(SURGE, heaviest) if apart[i] else SURGE)

    surges = [i for i in range(len(found)) if reaches(i, i)]
    dives = [i for i in range(len(found)) if reaches(i, i - WINDOW + 1)]
    if not surges:  # then no window reaches SURGE, and there is no dive
        surges = dives = [i for i, w in enumerate(weight) if w and sure[i] == any(sure) and not apart[i]] or [i for i, w in enumerate(weight) if w]
    surge, dive = surges[0], max(surges[0], dives[-1] if dives else 0)
    while surge and weight[surge - 1] and (sure[surge - 1], apart[surge - 1]) == (sure[surge], apart[surge]):  # a heading or short paragraph right before
        surge -= 1
    while dive + 1 < len(found) and weight[dive + 1] and (sure[dive + 1], apart[dive + 1]) == (sure[dive], apart[dive]):
        dive += 1
    return " ".join(line.text for line, _ in found[surge : dive + 1])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row, from its whole html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [main_text(t) for t in rows.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
