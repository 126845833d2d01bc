"""Main text of HTML pages by tree scoring (operator 6)."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remembra.llm._bytes import pieces
from remembra.llm._store import held, quoted, released

# How elements are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; it ends at their end tag.
RAW = frozenset("script style noscript template textarea iframe title xmp noembed noframes".split())
#: Without an end tag, these run to the end of the page; the other raw ones are empty then.
UNENDED = frozenset("script style xmp".split())
#: Never part of the text.
SKIPPED = frozenset("head nav footer aside button select option optgroup datalist menu canvas audio video svg math".split()) | RAW
#: These, and hidden elements, are part of it only if they wrap the page: they hold so much of its unlinked paragraphs, and no article or main
#: element is outside of them.
WRAPPERS, WRAPS = frozenset("form dialog".split()), 0.9
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img nobr svg math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of one of these ends an open svg or math element.
BREAKOUT = frozenset("article blockquote body br center dd div dl dt figure footer h1 h2 h3 h4 h5 h6 head header hr img li main menu nav ol p pre section table ul".split())
#: A new one ends an open one of the same row, up to the elements after it.
ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: A class, id or role with one of these words marks a part of the page that isn't the article, unless it holds much of the text.
OUTSIDE = frozenset("ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus discussion footer form masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promoted recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags taboola toolbar widget".split())
KEPT_ANYWAY = frozenset("html body article main".split())
#: Marked elements stay from these shares of the page's unlinked paragraphs: in general, and with one of these words or an
#: article inside. Names that are such a word as a whole never stay by the first. A result shorter than NEARLY_EMPTY is
#: looked for again with the first for all, then without the marks.
MAJOR, MINOR, PERHAPS, NEARLY_EMPTY = 0.5, 0.2, frozenset("article body content entry main post story text".split()), 140

#: Least length of a block that scores, characters for one point of length and the most such points, link density from which a
#: block has no points, and ancestors that get points.
LEAST, PER_POINT, MOST_POINTS, MENU, LEVELS = 25, 100, 3, 0.5, 6
#: Siblings of the best container are kept from this share of its score, or as paragraphs of this length with few links.
SIBLING, SIBLING_LENGTH, SIBLING_LINKS = 0.2, 80, 0.25
#: A list within the article, or a block of text that is no paragraph, goes as a menu if so much of it is links, of so few
#: characters each on average, two at least.
LIST_LINKS, LINK_LENGTH = 0.8, 60
LISTS, PARAGRAPHS = frozenset("ul ol dl table".split()), frozenset("p pre li dt dd td th blockquote figcaption caption".split()) | HEADINGS

# Quotes hold a > only after an equals sign; possessive, so a tag is gone through once. The second is for what is left of a page in which
# a tag never ends by the first.
_TAG = re.compile(r"<(/)?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.A)
_LOOSE = re.compile(r"<(/)?([a-zA-Z][^\s/>]*+)([^>]*+)>", re.A)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.A)
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.A | re.I) for t in RAW}
_NONE = re.compile(r"display\s*+:\s*+none", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


class _Block:
    __slots__ = ("node", "parts", "linked", "text", "links", "n_links", "link")

    def __init__(self, node: int):
        self.node, self.parts, self.linked, self.n_links, self.link = node, [], [], 0, 0


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start and end of each piece of markup, whether it is an end tag, its name (none for comments and the like) and its attributes.

    A raw element is one piece with its content. Each character is gone through a fixed number of times: what
    has been looked for in vain is not looked for again.
    """
    pattern, unended, i = _TAG, set(), page.find("<")
    while i >= 0:
        m = pattern.match(page, i)
        if m is None and pattern is _TAG and page[i + 1 : i + 2].isalpha():
            pattern = _LOOSE
            m = pattern.match(page, i)
        if m is not None:
            name, end = m[2].lower(), m.end()
            if name in RAW and not m[1] and name not in unended:
                close = _END[name].search(page, end)
                if close is not None:
                    end = close.end()
                else:
                    unended.add(name)
                    if name in UNENDED:
                        end = len(page)
            yield i, end, m[1] is not None, name, m[3]
        elif page.startswith("<!--", i):
            end = i + 4
            if not page.startswith((">", "->"), end):
                end = page.find("-->", end) + 3
            else:
                end = page.find(">", end) + 1
            end = end if end > i + 4 else len(page)
            yield i, end, False, "", ""
        elif page.startswith(("<!", "<?", "</"), i):
            end = page.find(">", i) + 1 or len(page)
            yield i, end, False, "", ""
        elif page[i + 1 : i + 2].isascii() and page[i + 1 : i + 2].isalpha():
            yield i, len(page), False, "", ""  # a tag that the page's end cuts off
            return
        else:
            end = i + 1
        i = page.find("<", end)


class Page:
    """A parsed page: parent, tag and look (tag, first class and id, without digits) of every element, the text blocks outside
    skipped parts in page order, the marked elements with the share from which they stay, and the elements that may wrap the page."""

    def __init__(self):
        self.parents: list[int] = [-1]
        self.tags: list[str] = ["#"]
        self.looks: list[tuple[str, str, str]] = [("#", "", "")]
        self.blocks: list[_Block] = []
        self.marked: dict[int, float] = {}
        self.wrappers: set[int] = set()


def parse(page: str) -> Page:
    """The page's elements and blocks; see Page."""
    out = Page()
    parents, tags, looks, blocks, marked = out.parents, out.tags, out.looks, out.blocks, out.marked
    # element, tag, whether it is skipped, the nearest element around its text that is not inline
    stack: list[tuple[int, str, bool, int]] = [(0, "#", False, 0)]
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements of each tag
    skipped = 0
    block: _Block | None = None
    at = 0

    def pop() -> None:
        nonlocal skipped, block
        _, tag, skip, _ = stack.pop()
        opened[tag].pop()
        skipped -= skip
        if tag not in INLINE:
            block = None

    def last(names: tuple[str, ...]) -> int:
        return max((opened[n][-1] for n in names if opened[n]), default=0)

    def text(piece: str) -> None:
        nonlocal block
        if skipped or not piece:
            return
        if block is None:
            if not piece.strip():
                return
            block = _Block(stack[-1][3])
            blocks.append(block)
        piece = html.unescape(piece) if "&" in piece else piece
        block.parts.append(piece)
        if opened["a"]:
            block.linked.append(piece)
            link = stack[opened["a"][-1]][0]
            block.n_links += link != block.link
            block.link = link

    for start, end, close, tag, rest in _tags(page):
        if start > at:
            text(page[at:start])
        at = end
        if not tag:
            continue
        if close:
            if tag == "br":
                text(" ")
            elif opened[tag]:
                to = opened[tag][-1]
                while len(stack) > to:
                    pop()
            elif tag not in INLINE:
                block = None
            continue
        foreign = last(("svg", "math"))
        if foreign and tag in BREAKOUT and not opened["foreignobject"]:
            while len(stack) > foreign:
                pop()
        if tag == "br" or tag == "wbr" or tag == "img":
            if block is not None and tag == "br":
                text(" ")
            continue
        if tag not in INLINE and not skipped:
            block = None
        if tag not in INLINE:
            over = last(("p",))
            if over:  # block elements end an open paragraph
                while len(stack) > over:
                    pop()
            if tag in ENDS:
                those, until = ENDS[tag]
                over = last(those)
                if over > last(until):
                    while len(stack) > over:
                        pop()
        if tag in VOID or tag in RAW or rest.endswith("/") and (tag in INLINE or foreign):
            continue
        skip, look, wrapper = tag in SKIPPED, (tag, "", ""), tag in WRAPPERS
        if rest and not skip and not skipped and tag not in ("html", "body"):
            values, hidden, first = [], False, {}
            for name, a, b, c in _ATTRIBUTE.findall(rest):
                name, value = name.lower(), a or b or c
                if name in ("class", "id", "role"):
                    some = html.unescape(value).lower().split()
                    values += some
                    first.setdefault(name, _DIGITS.sub("", some[0]) if some else "")
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NONE.search(value):
                    hidden = True
            look = (tag, first.get("class", ""), first.get("id", ""))
            names = {w for x in values for w in _WORD.findall(x)}
            outside = not names.isdisjoint(OUTSIDE)
            # the spans of a program's listing are often marked as its comments
            skip = tag in INLINE and (hidden or outside and not opened["pre"] and not opened["code"])
            wrapper |= hidden and tag not in KEPT_ANYWAY and tag not in INLINE
            if outside and tag not in INLINE:
                marked[len(tags)] = MINOR if not names.isdisjoint(PERHAPS) else MAJOR if OUTSIDE.isdisjoint(values) else 2.0
        if tag == "header" and not opened["article"] and not opened["main"]:
            skip = True
        if skip and tag not in INLINE:
            block = None
        if wrapper and not skipped:
            out.wrappers.add(len(tags))
        parents.append(stack[-1][0])
        tags.append(tag)
        looks.append(look)
        opened[tag].append(len(stack))
        stack.append((len(tags) - 1, tag, skip, stack[-1][3] if tag in INLINE else len(tags) - 1))
        skipped += skip
    text(page[at:])
    for b in blocks:
        b.text, b.links = " ".join("".join(b.parts).split()), len(" ".join("".join(b.linked).split()))
    out.blocks = [b for b in blocks if b.text]
    return out


def _up(parents: list[int], values: list[int]) -> list[int]:
    """Each element's value and those of all elements in it; a parent comes before its children."""
    out = values.copy()
    for k in range(len(parents) - 1, 0, -1):
        out[parents[k]] += out[k]
    return out


def _pays(b: _Block, tags: list[str]) -> bool:
    """Whether a block has points: prose, by its length and links."""
    return len(b.text) >= LEAST and b.links <= MENU * len(b.text) and tags[b.node] not in HEADINGS


def _prose(parents: list[int], tags: list[str], blocks: list[_Block]) -> list[int]:
    """Characters of unlinked prose in each element."""
    own = [0] * len(tags)
    for b in blocks:
        if _pays(b, tags):
            own[b.node] += len(b.text) - b.links
    return _up(parents, own)


def _unwrapped(page: Page) -> list[_Block]:
    """The blocks outside of forms, dialogs and hidden elements, but for those that wrap the page."""
    if not page.wrappers:
        return page.blocks
    parents, tags = page.parents, page.tags
    unlinked = _prose(parents, tags, page.blocks)
    inside, articles = [False] * len(tags), [0] * len(tags)
    for k in range(1, len(tags)):
        inside[k] = inside[parents[k]] or tags[k] in ("article", "main")
    for b in page.blocks:
        articles[b.node] += inside[b.node]
    articles = _up(parents, articles)
    gone = [False] * len(tags)
    for k in range(1, len(tags)):
        wraps = unlinked[0] and unlinked[k] >= WRAPS * unlinked[0] and articles[k] == articles[0]
        gone[k] = gone[parents[k]] or k in page.wrappers and not wraps
    return [b for b in page.blocks if not gone[b.node]]


def _outside(parents: list[int], tags: list[str], blocks: list[_Block], marked: dict[int, float]) -> list[bool]:
    """Whether each element goes: marked ones without much of the text, and all in them."""
    unlinked = _prose(parents, tags, blocks)
    total = unlinked[0]
    # comments are often articles, but marked ones
    holds = [t in ("article", "main") and k not in marked and unlinked[k] >= MINOR * total for k, t in enumerate(tags)]
    for k in range(len(tags) - 1, 0, -1):
        holds[parents[k]] |= holds[k]
    gone = [False] * len(tags)
    for k in range(1, len(tags)):
        least = marked.get(k)
        gone[k] = gone[parents[k]] or least is not None and tags[k] not in KEPT_ANYWAY and not holds[k] and (not total or unlinked[k] < least * total)
    return gone


def main_text(page: str | None) -> str:
    """The page's article, one block a line; empty if there is none.

    Every block of LEAST characters or more has a point, one for each comma, and up to MOST_POINTS for its length;
    its parent gets all of them, the grandparent half, each further ancestor a third of its child's
    divisor less, up to LEVELS. A container's score is discounted by the share of its text that is in links. The best
    container is kept with those siblings that score well or read like paragraphs, and with the rows of a layout that it is one
    of, see _repeated; lists within that are but short links go. Parts of the page that class, id or role mark as no article go
    before that, see _outside, forms, dialogs and hidden parts unless they wrap the page.
    """
    if not page:
        return ""
    parsed = parse(page)
    blocks, marked, text = _unwrapped(parsed), parsed.marked, ""
    for marks in (marked, {k: min(v, MAJOR) for k, v in marked.items()}, {}) if marked else ({},):
        gone = _outside(parsed.parents, parsed.tags, blocks, marks)
        again = _article(parsed, [b for b in blocks if not gone[b.node]])
        if not text or len(again) > max(2 * len(text), NEARLY_EMPTY):
            text = again
        if len(text) >= NEARLY_EMPTY:
            break
    return text


def _repeated(page: Page, blocks: list[_Block], best: int, lengths: list[int], linked: list[int], prose: list[int]) -> list[int]:
    """The elements of a layout that repeats the best container, or one around it, as rows, columns or sections.

    From the best container up, as long as what is taken is most of the parent's prose: its children that look the same, with their
    first prose as deep and few links, are taken, and with them those of the same look that have no prose, such as headings.
    """
    parents, tags, looks = page.parents, page.tags, page.looks
    depth, children, first = [0] * len(tags), defaultdict(list), [0] * len(tags)
    for k in range(1, len(tags)):
        depth[k] = depth[parents[k]] + 1
        children[parents[k]].append(k)
    for b in reversed(blocks):
        if _pays(b, tags):
            first[b.node] = depth[b.node]
    for k in range(len(tags) - 1, 0, -1):
        first[parents[k]] = first[k] or first[parents[k]]
    taken, node = [], best
    while node > 0 and tags[node] not in KEPT_ANYWAY:
        alike = [k for k in children[parents[node]] if k != node and lengths[k] and looks[k] == looks[node] and linked[k] < SIBLING_LINKS * lengths[k]]
        rows = [k for k in alike if not prose[k] or first[k] - depth[k] == first[node] - depth[node]]
        whole = prose[node]
        if any(prose[k] for k in rows):
            taken += [node, *rows]
            whole += sum(prose[k] for k in rows)
        node = parents[node]
        if whole < MAJOR * prose[node]:
            break
    return taken


def _article(page: Page, blocks: list[_Block]) -> str:
    parents, tags = page.parents, page.tags
    scores: dict[int, float] = {}
    lengths, linked, links, prose = ([0] * len(tags) for _ in range(4))
    for b in blocks:
        lengths[b.node] += len(b.text)
        linked[b.node] += b.links
        links[b.node] += b.n_links
        if not _pays(b, tags):
            continue
        prose[b.node] += len(b.text) - b.links
        points = 1 + sum(b.text.count(c) for c in ",，、،") + min(len(b.text) / PER_POINT, MOST_POINTS)
        # text that stands in a container itself counts for that container
        node = parents[b.node] if tags[b.node] in ("p", "pre", "td", "blockquote", "li", "dd") else b.node
        for level in range(LEVELS):
            if node > 0 or not level:
                scores[node] = scores.get(node, 0.0) + points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            node = parents[node] if node > 0 else 0
    lengths, linked, links, prose = (_up(parents, x) for x in (lengths, linked, links, prose))
    if scores:
        final = {n: s * (1 - linked[n] / max(1, lengths[n])) for n, s in scores.items()}
        best = max(final, key=lambda n: (final[n], -n))
        # a lone paragraph's wrapper, or a block inside the article, stands for the article around it
        node = best
        while node > 0:
            if tags[node] in ("article", "main"):
                best = node
                break
            node = parents[node]
        final.setdefault(best, 0.0)
    else:
        best = next((k for k, t in enumerate(tags) if t in ("article", "main")), 0)
        final = {best: 0.0}
    kept = [k == best for k in range(len(tags))]
    if best and tags[best] not in ("main", "body", "html"):
        for node in range(1, len(tags)):
            if parents[node] != parents[best] or node == best:
                continue
            few = linked[node] < SIBLING_LINKS * lengths[node]
            if tags[best] == "article":  # parts of one article, or another's teaser
                good = tags[node] in ("article", "section") and few and prose[node] >= max(SIBLING * prose[best], NEARLY_EMPTY)
            else:
                good = final.get(node, 0.0) >= max(10.0, SIBLING * final[best]) or tags[node] == "p" and lengths[node] >= SIBLING_LENGTH and few
            kept[node] = kept[node] or good
        for node in _repeated(page, blocks, best, lengths, linked, prose):
            kept[node] = True
    short = lambda part, whole, n: n > 1 and part > LIST_LINKS * whole and part < LINK_LENGTH * n
    menu = [t in LISTS and short(linked[k], lengths[k], links[k]) for k, t in enumerate(tags)]
    for k in range(1, len(tags)):
        kept[k] = kept[k] or kept[parents[k]]
        menu[k] = menu[k] or menu[parents[k]]
    return "\n".join(b.text for b in blocks if kept[b.node] and not menu[b.node] and (tags[b.node] in PARAGRAPHS or not short(b.links, len(b.text), b.n_links)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "__html"):
            texts = [main_text(x) for x in piece.column(piece.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["__row", "text", "n_chars"])


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `text` and `n_chars` (its code points) in place of the html; see main_text.

    A null, empty or contentless html gives an empty text. One pass without a shuffle, of time and memory in proportion to a
    page's length; repeated rows stay, other columns are kept, but for columns named text or n_chars, which are replaced.
    """
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(held(rest), F.col(quoted(html)).alias("__html"))
    found = rows.mapInArrow(_extract, rows.select("__row").schema.add("text", "string").add("n_chars", "long"))
    return found.select(*released(rest), "text", "n_chars")
