"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block element, with empty lines where a
part of the page ends and another begins.  Lengths of lines are summed over a sliding window of
``WINDOW`` lines; the sums form a curve.  Where it rises from zero a run of text starts,
where it dives to zero the run ends, and a run whose peak reaches the surge is article
text.  Runs between two of these belong to the article, and so do headings right before one.

Markup does two things beside: scripts, styles, form controls and landmark elements (navigation, page
headers and footers, asides, forms) have no text, and what else it says is weighed.
A line counts ``ARTICLE_WEIGHT`` times where the page marks it as article, and
``MARKED_WEIGHT`` times where a class or id names an advert, comments and the like; a line
that is mostly links counts nothing.  The surge is a share of the page's highest
window, so that the curve decides which runs stay.  A short line that a class or id
speaks against is left out of a run, too, unless nothing of the article were left.

The work is linear in the page: each element is opened and closed once, windows come from running sums.

Results for edge cases: a null or empty page, and one without article text, gives ''
and 0; unclosed elements end where their parent ends or the page does; an unclosed
comment, script or style hides the rest of the page; repeated rows give repeated rows; pages
of any length are read whole; columns other than id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import as_binary, map_arrow

WINDOW = 3
#: Weights of a line's length by what the markup says of it.
ARTICLE_WEIGHT, MARKED_WEIGHT = 4.0, 0.2
#: The surge: a share of the highest window sum, and no more than so many characters.
SHARE, SURGE = 0.5, 160
#: The same for pages that mark an article, whose lines weigh more.
MARKED_SHARE, MARKED_SURGE = 0.25, 640
#: Weighed characters under which a line is left out that a class or id speaks against.
SHORT = 40

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title|select)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:\s*/?|(?:[\s/](?:\"[^\"]*\"|'[^']*'|[^'\">])*)))>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)

# Element names of HTML, and words of class, id and role that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Blocks that hold one line of a part; any other block is a part of the page.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot pre blockquote figcaption caption hr address summary".split())
HEADINGS = frozenset("h1 h2 h3".split())
LANDMARKS = frozenset("head nav header footer aside form button menu dialog object audio video canvas fieldset option".split())
LANDMARK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
AGAINST = frozenset(
    "ad ads adbox adslot adunit advert advertisement advertising adverts adsense alert alertbar announcement banner bio breadcrumb breadcrumbs byline comment comments commentlist consent"
    " cookie cookies copyright disclaimer discussion disqus dropdown feedback footer footnav gdpr header legal login masthead menu menubar modal nav navbar navigation navi newsletter notice notices"
    " overlay pager pagination popup promo promoted promotion recommended recommendations related replies reply respond search share sharing sidebar sidenav signup skip skiplink"
    " social sponsor sponsored sponsors subscribe subscription tagcloud tags teaser toc toolbar topbar trending utility widget widgets".split()
)
_MARKS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORDS = re.compile(r"[^a-z0-9]+")
_NUMBERED = re.compile(r"[0-9]+$")


def _speaks_against(token: str, words: frozenset[str]) -> bool:
    """A class or id of up to two words, the first of which is on the list."""
    parts = [w for w in _WORDS.split(token) if w]
    return 0 < len(parts) <= 2 and _NUMBERED.sub("", parts[0]) in words


def marks(name: str, rest: str, words: frozenset[str] = AGAINST) -> tuple[bool, bool, bool]:
    """Whether an element is a landmark, whether a class or id speaks against it, whether it marks an article."""
    landmark, against, article = name in LANDMARKS, False, name in ("article", "main")
    if len(rest) > 3:
        for key, value in _MARKS.findall(rest):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                landmark = True
            elif key == "role":
                landmark, article = landmark or value in LANDMARK_ROLES, article or value in ("main", "article")
            elif key == "itemprop":
                article = article or value == "articlebody"
            elif key in ("class", "id") and name not in ("html", "body", "main", "article"):
                against = against or any(_speaks_against(token, words) for token in value.split())
    return landmark, against, article and not landmark


class Line(NamedTuple):
    text: str
    landmark: bool
    against: bool
    article: int  # number of the article that it is in, 0 for none
    linked: int  # characters in links
    heading: bool
    parts: int  # parts of the page that end or begin before it


class _Entry(NamedTuple):
    name: str
    landmark: bool
    against: bool
    article: int
    block: bool


_ROOT = _Entry("", False, False, 0, True)


def lines(page: str, words: frozenset[str] = AGAINST) -> list[Line]:
    """The page's blocks in order."""
    found: list[Line] = []
    stack: list[_Entry] = [_ROOT]
    places: dict[str, list[int]] = {}  # of the open elements of each name
    blocks = [0]  # places of the open blocks
    parts: list[str] = []
    articles = links = linked = crossed = 0
    heading = False

    def flush() -> None:
        nonlocal linked, crossed, heading
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[-1]
                found.append(Line(text, top.landmark, top.against, top.article, linked, heading, crossed))
                crossed = 0
            parts.clear()
        linked, heading = 0, False

    def push(entry: _Entry) -> None:
        nonlocal crossed
        if entry.block:
            blocks.append(len(stack))
            crossed += entry.name not in LEAVES
        places.setdefault(entry.name, []).append(len(stack))
        stack.append(entry)

    def close_to(k: int) -> None:
        """Ends the elements from place ``k`` on."""
        nonlocal links, crossed
        while len(stack) > k:
            entry = stack.pop()
            places[entry.name].pop()
            links -= entry.name == "a"
            if entry.block:
                blocks.pop()
                crossed += entry.name not in LEAVES

    for token in _TOKEN.finditer(page):
        text = token["text"]
        if text is not None:
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        name = token["name"]
        if name is None:
            continue  # comments, scripts and other raw elements, declarations
        name = name.lower()
        if token["close"]:
            if name == "br":
                parts.append(" ")
                continue
            k = places[name][-1] if places.get(name) else 0
            if k and (name not in INLINE or k > blocks[-1]):  # an inline element does not end beyond its block
                if blocks[-1] >= k:
                    flush()
                close_to(k)
            continue
        top = stack[-1]
        if name in INLINE and name != "a":
            if name == "br":
                parts.append(" ")
            elif name not in VOID:
                landmark, against, _ = marks(name, token["rest"], words) if len(token["rest"]) > 3 else (False, False, False)
                if (landmark or against) and not (top.landmark or top.against):
                    flush()
                    push(_Entry(name, landmark, against, top.article, True))
                else:
                    push(_Entry(name, top.landmark, top.against, top.article, False))
            continue
        if name == "a":
            links += 1
            push(_Entry(name, top.landmark, top.against, top.article, False))
            continue
        flush()
        if name in VOID:
            continue
        while len(stack) > 1 and (not stack[-1].block or stack[-1].name == "p" or stack[-1].name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
            close_to(len(stack) - 1)  # a block ends open inline elements and paragraphs
        top = stack[-1]
        landmark, against, article = marks(name, token["rest"], words)
        if name == "header" and top.article:
            landmark = False  # an article's own header holds its title
        elif name in HEADINGS:
            against = False
        number = top.article
        if article and not top.landmark and not number:
            articles += 1
            number = articles
        push(_Entry(name, top.landmark or landmark, top.against or against, number, True))
        heading = name in HEADINGS
    flush()
    return found


def runs(lengths: list[float], window: int = WINDOW) -> list[tuple[int, int, float]]:
    """Start, end and peak of each stretch where the window sums are over zero."""
    n = len(lengths)
    before = [0.0, *accumulate(lengths)]
    sums = [before[min(n, i + window)] - before[i] for i in range(n)]
    found, i = [], 0
    while i < n:
        if sums[i] <= 0:
            i += 1
            continue
        end = i
        while end < n and sums[end] > 0:
            end += 1
        found.append((i, end, max(sums[i:end])))
        i = end
    return found


def kept_between(lengths: list[float], surge: float, window: int = WINDOW) -> list[bool]:
    """Which lines lie between a surge point and the next dive point, that have text."""
    keep = [False] * len(lengths)
    for start, end, peak in runs(lengths, window):
        if peak >= surge:
            keep[start:end] = [x > 0 for x in lengths[start:end]]
    return keep


def weight(line: Line) -> float:
    if line.landmark or line.linked > 0.6 * len(line.text):
        return 0.0
    return len(line.text) * (ARTICLE_WEIGHT if line.article else 1.0) * (MARKED_WEIGHT if line.against else 1.0)


def _chosen(found: list[Line], window: int) -> list[Line]:
    """The lines of the runs that the curve keeps."""
    lengths: list[float] = []
    owner: list[int] = []  # number of the line, or -1 for an empty one
    for k, line in enumerate(found):
        before = found[k - 1].article if k else 0
        if k and line.article != before or line.parts > 1 and not line.article:
            lengths += [0.0] * window
            owner += [-1] * window
        lengths.append(weight(line))
        owner.append(k)
    curve = runs(lengths, window)
    highest = max((peak for _, _, peak in curve), default=0.0)
    marked = any(line.article for line in found)
    surge = min(MARKED_SHARE * highest, MARKED_SURGE) if marked else min(SHARE * highest, SURGE)
    held = [[found[k] for k in owner[start:end] if k >= 0] for start, end, _ in curve]
    core = [n for n, (_, _, peak) in enumerate(curve) if peak >= surge]
    if not core:
        return []
    first, last = core[0], core[-1]
    while first and all(line.heading or not weight(line) for line in held[first - 1]):
        first -= 1  # a title that stands in a part of its own
    out = []
    for n in range(first, last + 1):
        out += [line for line in held[n] if not line.landmark and (line.article or weight(line)) and not (line.against and MARKED_WEIGHT * len(line.text) < SHORT)]
    return out


def main_text(page: str, window: int = WINDOW, words: frozenset[str] = AGAINST) -> str:
    """The article's blocks, joined by newlines."""
    found = lines(page, words)
    kept = _chosen(found, window)
    inside = [line for line in found if line.article and not line.landmark]
    if inside and not any(line.article for line in kept) or not kept:
        # Classes and ids do not empty an article.
        kept = _chosen([line._replace(against=False) for line in found], window)
    return "\n".join(line.text for line in kept)


def extract(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", window: int = WINDOW) -> DataFrame:
    """id, url, text and n_chars of every page."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = [main_text(t.decode(), window) if t else "" for t in as_binary(batch.column(2)).to_pylist()]
            return {"id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return map_arrow(rows, make, "id long, url string, text string, n_chars long", "html").withColumnRenamed("id", id_column).withColumnRenamed("url", url_column)
