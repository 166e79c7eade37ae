"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block of the page. Each line weighs as many characters as it
has outside links and page furniture; the weights are summed over sliding windows of lines. Where
the sums surge from nothing the text begins, where they dive to nothing it ends, and all lines
between that do not belong to furniture are kept, however short and whether linked or not.

Around that stretch, lines that belong to it are kept too: headings that lead up to it, and what stands
in the same list or container, such as a closing line that is wholly a link or comes after a list of
links. A page that marks its text (article, main) and has a share `MARKED` of its weight there weighs
nothing elsewhere, and all of a landmark that the stretch touches is kept; a smaller one is a teaser, and
weighs like any other line.

Names say less than tags: a box that a class, id or role names as furniture is none if it holds
most of the page's text, stands around <main>, or if nothing would be left of the page or its articles.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
# a stretch of lines is text if its heaviest window has this share of the page's heaviest
SURGE = 0.2
# what a page marks as its text is that if it has this share of the page's weight; else it is a teaser
MARKED = 1 / 8

# tags, comments and declarations; an unfinished one at the end is dropped
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.DOTALL)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
SILENT = frozenset("script style noscript template svg iframe object canvas head title textarea select option button".split())
# what may stand in a head; anything else ends it, as its end tag may be left out
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
FURNITURE = frozenset("nav header footer aside menu dialog".split())
# words in a class, id or role that name furniture; "has-sidebar" and the like name what is around it
FURNITURE_NAMES = re.compile(
    r"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bno[_-])(?:ads?(?:box|bygoogle|ense|lots?|units?)?|adverts?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|side-?bar|widget|related|share|social|"
    r"cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|login|search|comment(?!ar)\w*|replies|respond|disqus|toolbar|pagination|pager|copyright|contentinfo|complementary|navigation|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
# of these, what stays furniture beside other text even if it is longer than that
ASIDES = re.compile(
    r"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bno[_-])"
    r"(?:ads?(?:box|bygoogle|ense|lots?|units?)?|adverts?|advert\w*|promo\w*|sponsor\w*|related|newsletter|subscribe|comment(?!ar)\w*|replies|respond|disqus|cookies?|consent|copyright)(?:$|[\s_-])",
    re.IGNORECASE,
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(f"</{tag}(?![a-z0-9-])", re.IGNORECASE) for tag in ("script", "style", "title", "textarea", "noscript", "template")}
# a closing tag of these also ends what was left open inside
LANDMARKS = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# what lines stand in together: containers of blocks, and lists of items
CONTAINERS = frozenset("article blockquote body center details div fieldset figure html main section td th".split())
LISTS = frozenset("dir dl menu ol table ul".split())
SPACE = re.compile(r"\s+")


@dataclass
class Line:
    text: str
    weight: int
    furniture: bool
    landmark: int  # the outermost article or main around it, numbered from 1, or 0
    heading: bool
    container: int = 0
    list: int = 0  # the innermost list around it within its container, or 0
    box: int = -1  # the innermost box around it


@dataclass
class Box:
    """An element that its name, or the form tag, makes furniture, unless it proves to hold the text."""

    outer: int  # the box around it
    aside: bool
    marks: bool = False  # whether an article stands in it
    weight: int = 0


def _plain(parts: list[str]) -> str:
    """Runs of a page as the reader sees them: references decoded, white space collapsed."""
    return SPACE.sub(" ", unescape("".join(parts))).strip()


def lines_of(html: str) -> list[Line]:
    """The page's blocks in order. Text in silent elements is dropped; text in furniture and links
    weighs nothing."""
    found, boxes = _blocks(html)
    for line in found:
        if line.box >= 0:
            boxes[line.box].weight += line.weight
    # boxes stand in the order in which they open, so outer ones come first
    for box in reversed(boxes):
        if box.outer >= 0 and not box.aside:
            boxes[box.outer].weight += box.weight
    total = sum(line.weight for line in found if line.box < 0) + sum(box.weight for box in boxes if box.outer < 0 and not box.aside)

    def shut(opens) -> list[bool]:
        closed: list[bool] = []
        for box in boxes:
            closed.append(not opens(box) or (box.outer >= 0 and closed[box.outer]))
        return closed

    def left(closed: list[bool], marked: bool) -> bool:
        return any((line.landmark or line.weight and not marked) and not line.furniture and (line.box < 0 or not closed[line.box]) for line in found)

    closed = shut(lambda box: 2 * box.weight > total and not box.aside)
    if left([False] * len(boxes), True) and not left(closed, True):
        # the marked text is in small boxes: they are text beside the rest
        closed = shut(lambda box: not box.aside and (box.marks or 2 * box.weight > total))
        for line in found:
            line.landmark = 0
    if not left(closed, False):
        closed = shut(lambda box: True)
    for line in found:
        if line.box >= 0 and closed[line.box]:
            line.weight, line.furniture = 0, True
    return found


def _blocks(html: str) -> tuple[list[Line], list[Box]]:
    """The page's blocks and the boxes they stand in; furniture is by tag here."""
    found: list[Line] = []
    boxes: list[Box] = []
    parts: list[str] = []
    unlinked: list[str] = []
    has_links = False
    # tag, silent, furniture, and box, container, list and landmark around it
    stack: list[tuple[str, bool, bool, int, int, int, int]] = []
    inside = -1
    silent = furniture = links = landmarks = headings = container = listed = landmark = opened = 0

    def flush() -> None:
        nonlocal has_links
        text = _plain(parts)
        if text:
            own = len(_plain(unlinked) if has_links else text)
            found.append(Line(text, 0 if furniture else own, bool(furniture), landmark, bool(headings), container, listed, inside))
        parts.clear()
        unlinked.clear()
        has_links = False

    def close(depth: int) -> None:
        nonlocal silent, furniture, links, landmarks, headings, inside, container, listed, landmark
        while len(stack) > depth:
            tag, was_silent, was_furniture, inside, container, listed, landmark = stack.pop()
            silent, furniture = silent - was_silent, furniture - was_furniture
            links, landmarks, headings = links - (tag == "a"), landmarks - (tag in LANDMARKS), headings - (tag in HEADINGS)

    at = 0
    while True:
        m = MARKUP.search(html, at)
        run = html[at : m.start() if m else len(html)]
        if run and stack and stack[-1][0] == "head" and not run.isspace():
            close(len(stack) - 1)
        if run and not silent:
            parts.append(run)
            if links:
                has_links = True
            else:
                unlinked.append(run)
        if not m:
            break
        at = m.end()
        ends, tag = m.group(1), (m.group(2) or "").lower()
        if not tag:
            continue
        if not ends and stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag == "br" or tag == "img" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            unlinked.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
        if ends:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                close(depth)
            continue
        if tag in VOID or m.group(3).rstrip().endswith("/"):
            continue
        if tag == "p" or tag == "li":
            # these end where the next begins
            top = len(stack) - 1
            while top >= 0 and stack[top][0] not in BLOCKS:
                top -= 1
            if top >= 0 and stack[top][0] == tag:
                close(top)
        is_silent = tag in SILENT
        named = " ".join("".join(x) for x in NAMED.findall(m.group(3))) if m.group(3) else ""
        is_furniture = tag in FURNITURE and not (tag == "header" and landmarks)
        stack.append((tag, is_silent, is_furniture, inside, container, listed, landmark))
        opened += 1
        if tag in CONTAINERS:
            container, listed = opened, 0
        elif tag in LISTS:
            listed = opened
        if tag in LANDMARKS and not landmark:
            landmark = opened
        if tag == "main":
            inside = -1
        elif tag == "article":
            at_box = inside
            while at_box >= 0 and not boxes[at_box].marks:
                boxes[at_box].marks, at_box = True, boxes[at_box].outer
        elif tag not in ("html", "body") and not is_furniture and (tag == "form" or named and FURNITURE_NAMES.search(named)):
            boxes.append(Box(inside, bool(ASIDES.search(named))))
            inside = len(boxes) - 1
        silent, furniture = silent + is_silent, furniture + is_furniture
        links, landmarks, headings = links + (tag == "a"), landmarks + (tag in LANDMARKS), headings + (tag in HEADINGS)
        if tag in RAW:
            # raw text up to its own end tag
            end = RAW[tag].search(html, at)
            at = end.start() if end else len(html)
    flush()
    return found, boxes


def stretch_of(weights: list[int], window: int = WINDOW, surge: float = SURGE) -> tuple[int, int]:
    """Where the text begins and ends: from the first to the last stretch of windows with weight whose
    heaviest window has a share `surge` of the page's heaviest; (0, 0) without any weight."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    least, begin, end, stretch = surge * max(sums, default=0), None, 0, None
    for i, total in enumerate([*sums, 0]):
        if total and stretch is None:
            stretch = i
        elif not total and stretch is not None:
            if max(sums[stretch:i]) >= least:
                begin, end = stretch if begin is None else begin, i
            stretch = None
    if begin is None:
        return 0, 0
    # windows look ahead: the text begins at the first line that weighs
    return next(i for i in range(begin, end) if weights[i]), end


def main_text(html: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """The text between surge and dive; empty for null, empty and textless pages. A page that has links
    alone gives those that it marks as its text."""
    # furniture takes no line of its own, so that a box in the middle of a text is no dive
    kept = [line for line in lines_of(html or "") if not line.furniture]
    total, marked = sum(line.weight for line in kept), sum(line.weight for line in kept if line.landmark)
    if not total:
        return "\n".join(line.text for line in kept if line.landmark)
    by_mark = marked >= MARKED * total
    begin, end = stretch_of([0 if by_mark and not line.landmark else line.weight for line in kept], window, surge)
    if by_mark:
        touched = {line.landmark for line in kept[begin:end]} - {0}
        return "\n".join(line.text for line in kept if line.landmark in touched)
    weighty = [line for line in kept[begin:end] if line.weight]
    lists, containers = {line.list for line in weighty} - {0}, {line.container for line in weighty}

    def belongs(line: Line) -> bool:
        return line.list in lists if line.list else line.container in containers

    while begin and (kept[begin - 1].heading or not kept[begin - 1].weight and belongs(kept[begin - 1])):
        begin -= 1
    for i in range(end, len(kept)):
        if belongs(kept[i]):
            end = i + 1
        elif kept[i].weight:
            break
    return "\n".join(line.text for line in kept[begin:end])


def main_text_column(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return run(html)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of `pages` but `html`, plus `text` and `n_chars`, its code points. Null and empty
    pages give an empty text; columns of these names give way; all rows stay."""
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    return pages.select(*rest, main_text_column(F.col(html)).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
