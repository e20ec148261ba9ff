"""HTML extraction by line-block distribution: text lengths over sliding windows of lines, surge and dive points."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Lines in a window, and the window sums at which the main text surges (starts) and dives (ends), in characters outside links.
WINDOW, SURGE, DIVE = 3, 60, 20
#: A block of fewer characters ends no span, where nothing marks it as content.
SHORT = 10
#: Elements whose whole content is no text of the article.
NO_TEXT = "script style noscript template head title svg math iframe object canvas select option datalist button textarea audio video map".split()
ASIDE = "nav header footer aside form menu dialog".split()
#: Parts of a class, id or role that mark such a part of the page (HARD), or may do so (SOFT): a share price is no share button.
HARD = set(
    "nav navbar navigation footer sidebar breadcrumb breadcrumbs cookie cookies consent popup modal newsletter subscribe signup login comments commentlist disqus replies respond "
    "toolbar pagination pager contentinfo complementary".split()
)
SOFT = set("header banner menu masthead notice comment related recommended share sharing social widget search alert".split())
AD = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*")
#: Parts that only say where or how such a part stands, and parts that name the article.
HELPERS = set(
    "site page main global top bottom left right primary secondary list lists box block blocks wrapper wrap container inner outer section area slot bar buttons button links link icons "
    "icon posts articles stories items item user users reader readers form panel unit sticky fixed mobile desktop".split()
)
CONTENT_PARTS = set("article post entry story content body text".split())
#: Words in class or id that support a container's own text, and words of a short block that speak against it at a span's end.
CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:content|article|post|entry|story|body|text)(?=$|[\s_-])", re.I)
#: A text that ends as sentences do; a notice about cookies; a heading over readers' comments.
PROSE = re.compile(r"[.!?…:;][\"'”’»)\]]*\Z")
NOTICE = re.compile(r"\b(?:we|this (?:web)?site|our (?:web)?sites?|our partners|by (?:continuing|using|clicking)|accept)\b.{0,120}\bcookies?\b|\bcookies?\b.{0,120}\b(?:accept|consent|agree)\b", re.I | re.S)
REMARKS = re.compile(
    r"(?:\d+\s+)?(?:reader |user |your |leave an? |post an? |add an? )?(?:comments?|replies|reply|responses?|kommentare?|commentaires?|comentarios?)(?:\s*\(\d+\)|\s+\d+)?\s*:?", re.I
)
SMALL_PRINT = re.compile(r"©|\(c\)|\bcopyright\b|\ball rights reserved\b|\bcookies?\b", re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block; others run on within a line.
BLOCK = set(
    "address article aside blockquote body br center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_BLOCK = {"p"}
#: Elements that hold a part of the page; others belong to the part that they stand in.
BOX = set("html body div section article main center details dialog fieldset td th".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
#: What stands between the links of a menu.
BETWEEN_LINKS = " \t\r\f\xa0|/·•,;:<>»«›‹–-"
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ENDS = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
BLANK = re.compile(r"\s+")


def marked(value: str) -> int:
    """2 if a class, id or role marks a part that is no text of the article, 1 if it may, 0 if not.

    A token of known parts alone marks it (`site-header`), as does a hard one beside a name of the article (`post-comments`); any
    other token with such a part (`share-price`, `article-header`) leaves it to the part's own text.
    """
    best = 0
    for token in value.lower().split():
        parts = [x for x in re.split(r"[-_]+", token) if x]
        hard = any(x in HARD for x in parts)
        if not hard and not any(x in SOFT or AD.fullmatch(x) for x in parts):
            continue
        others = [x for x in parts if not (x in HARD or x in SOFT or AD.fullmatch(x) or x in HELPERS or x.isdigit())]
        best = max(best, 2 if not others or hard and all(x in CONTENT_PARTS for x in others) else 1)
    return best


def aside(name: str, attributes: str, inside: bool = False) -> int:
    """marked of an element; the header of an article may hold its headline, so there it may be left out, but need not."""
    if name in ASIDE:
        return 1 if name == "header" and inside else 2
    if not attributes or name in ("html", "body", "main", "article"):
        return 0
    best = 0
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 2
        if key in ("class", "id", "role"):
            best = max(best, marked(value))
    return best


class Markup(NamedTuple):
    """A tag (name empty: a comment or declaration) between two places of the page."""

    start: int
    end: int
    closing: bool
    name: str
    attributes: str


class Scanner:
    """Finds a page's markup from left to right. What no end was found for is kept, so that the work is in proportion to the page
    whatever is left open in it."""

    def __init__(self, page: str):
        self.page, self.bare, self.dead, self.unclosed = page, len(page) + 1, set(), set()

    def _end(self, at: int) -> int:
        """Behind the first > outside quotes; -1 if there is none or a quote stays open."""
        passed = []
        while at < self.bare:
            mark = ENDS.search(self.page, at)
            if not mark:
                self.bare = at
                break
            if mark[0] == ">":
                return mark.end()
            if mark.start() in self.dead:
                break
            passed.append(mark.start())
            close = self.page.find(mark[0], mark.end())
            if close < 0:
                break
            at = close + 1
        self.dead.update(passed)
        return -1

    def next(self, at: int) -> Markup | None:
        while (at := self.page.find("<", at)) >= 0:
            if other := OTHER.match(self.page, at):
                return Markup(at, other.end(), False, "", "")
            if (tag := TAG.match(self.page, at)) and (end := self._end(tag.end())) >= 0:
                return Markup(at, end, bool(tag[1]), tag[2].lower(), self.page[tag.end() : end - 1])
            at += 1
        return None

    def close_of(self, name: str, at: int) -> int:
        """Behind the next closing tag of this name; -1 if there is none."""
        if name in self.unclosed:
            return -1
        close = re.compile(rf"</{re.escape(name)}\b", re.I).search(self.page, at)
        end = self.page.find(">", close.end()) if close else -1
        if end < 0:
            self.unclosed.add(name)
        return end + 1 if end >= 0 else -1


class Block(NamedTuple):
    """A text block: its text, the characters outside links of each of its source lines, empty lines before it, the
    container it stands in, its support (1 in a container named as content), whether it is a heading, its element, whether it
    stands in article or main, and the parts around it that may be none of the article."""

    text: str
    sizes: list[int]
    gap: int
    box: int
    support: int
    heading: bool
    tag: str = ""
    inside: bool = False
    parts: tuple[int, ...] = ()

    @property
    def size(self) -> int:
        return sum(self.sizes)

    @property
    def prose(self) -> bool:
        return bool(PROSE.search(self.text))


class Open(NamedTuple):
    """An open element that matters: whether its content is left out, its container, that around it, whether it is named as content,
    the parts around its text that may be left out."""

    name: str
    off: bool
    box: int
    outer: int
    content: bool
    parts: tuple[int, ...] = ()


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order. A block tag beside a text is on the text's line; every other one, and what
    stands in a part that is left out, is an empty line."""
    out: list[Block] = []
    buffer: list[tuple[str, bool]] = []  # text, whether within a link
    stack: list[Open] = []
    skipped = inside = boxes = doubtful = marks = 0  # marks: block tags, and lines left out, since the last text
    link = False

    def flush():
        nonlocal marks
        raw = "".join(x for x, _ in buffer)
        text = BLANK.sub(" ", entities.unescape(raw)).strip()
        if text:
            top = stack[-1] if stack else Open("", False, 0, 0, False)
            heading = top.name in HEADING
            # a paragraph that is one link is text, a menu's link is not
            whole = top.name in ("p", "blockquote") and (inside or top.content) and len(text) >= SURGE and PROSE.search(text) and not any(x.strip() for x, linked in buffer if not linked)
            plain = raw if heading or whole else "".join("\n" * x.count("\n") if linked else x for x, linked in buffer)
            sizes = [len(y.strip(BETWEEN_LINKS)) for x, y in zip(raw.split("\n"), plain.split("\n"), strict=True) if x.strip()]
            box = top.outer if top.name in BOX else top.box
            out.append(Block(text, sizes, max(0, marks - 2), box, int(top.content), heading, top.name, inside > 0, top.parts))
            marks = 0
        buffer.clear()

    at, scanner, opened = 0, Scanner(page), Counter()
    while at < len(page):
        tag = scanner.next(at)
        text = page[at : tag.start if tag else len(page)]
        if not skipped:
            buffer.append((text, link))
        elif text and not text.isspace():
            marks += 1
        if not tag:
            break
        at, name = tag.end, tag.name
        if not name:
            continue
        if name in BLOCK:
            if not skipped:
                flush()
            marks += 1
        if tag.closing:
            if name == "a" or name in BLOCK:  # a link that is not closed ends with its block
                link = False
            if opened[name]:
                while stack:
                    last = stack.pop()
                    opened[last.name] -= 1
                    skipped -= last.off
                    inside -= last.name in ("article", "main")
                    if last.name == name:
                        break
            continue
        if name in NO_TEXT and name != "head":
            marks += 1
            if tag.attributes.rstrip().endswith("/"):
                continue
            if (end := scanner.close_of(name, at)) >= 0:
                at = end
            elif name in ("script", "style"):
                break
            continue
        if name in VOID or tag.attributes.rstrip().endswith("/"):
            continue
        if name == "a":
            link = "href" in tag.attributes.lower()
        mark = aside(name, tag.attributes, inside > 0)
        off = name == "head" or mark == 2
        if name == "body":  # an unclosed head ends here
            while stack and stack[-1].name == "head":
                opened["head"] -= 1
                skipped -= stack.pop().off
        if off or mark or name in BLOCK or name in ("article", "main", "section", "span"):
            if name in CLOSED_BY_BLOCK and stack and stack[-1].name == name:
                opened[name] -= 1
                skipped -= stack.pop().off
            outer, content, parts = (stack[-1].box, stack[-1].content, stack[-1].parts) if stack else (0, False, ())
            if mark == 1:
                doubtful += 1
                parts += (doubtful,)
            if name in BOX:
                boxes += 1
                content = any(key.lower() in ("class", "id") and CONTENT_WORDS.search(a or b or c) for key, a, b, c in ATTRIBUTE.findall(tag.attributes))
            stack.append(Open(name, off, boxes if name in BOX else outer, outer, content, parts))
            opened[name] += 1
            skipped += off
            inside += name in ("article", "main")
    flush()
    return out


def main_spans(blocks: list[Block], supported: bool = False) -> list[bool]:
    """Which blocks have a line between a surge and the next dive of the window sums; where a block has support, any text surges."""
    lines: list[tuple[int, int]] = []  # characters, block; -1: an empty line
    for k, b in enumerate(blocks):
        lines += [(0, -1)] * min(b.gap, WINDOW)  # more empty lines than a window change no sum
        lines += [(n, k) for n in b.sizes]
    kept, within, support = [False] * len(blocks), False, False
    for i, (n, k) in enumerate(lines):
        total = sum(x for x, _ in lines[i : i + WINDOW])
        if k >= 0:
            support = supported or blocks[k].support > 0
        if within:
            within = total >= (1 if support else DIVE)
        else:
            within = n > 0 and total >= (1 if support else SURGE)
        if within and k >= 0:
            kept[k] = True
    return kept


def settled(blocks: list[Block]) -> list[Block]:
    """The blocks without the parts that their class, id or element makes doubtful and their own text does not clear: parts with more
    text in links than outside, and parts of less text than a surge that hold no heading."""
    size, linked, headed = Counter(), Counter(), set()
    for b in blocks:
        for part in b.parts:
            size[part] += b.size
            linked[part] += max(0, len(b.text) - b.size)
            if b.heading:
                headed.add(part)
    out = {part for part in size if linked[part] > size[part] or size[part] < SURGE and part not in headed}
    return without(blocks, [any(part in out for part in b.parts) for b in blocks])


def without(blocks: list[Block], gone: list[bool]) -> list[Block]:
    """The blocks that stay; those that go become empty lines."""
    out, gap = [], 0
    for b, off in zip(blocks, gone, strict=True):
        if off:
            gap += b.gap + len(b.sizes)
        else:
            out.append(b._replace(gap=b.gap + gap))
            gap = 0
    return out


def unmarked(blocks: list[Block]) -> list[Block]:
    """The blocks without what nothing but its words marks: a heading over readers' comments with all that follows in its container up
    to the next heading, and notices about cookies outside the container of most text."""
    gone, ends, size, long = [False] * len(blocks), None, Counter(), False
    for b in blocks:
        size[b.box] += b.size
    main = max(size, key=lambda box: size[box], default=0)
    for k, b in enumerate(blocks):
        if long and (b.heading or b.tag in ("div", "p", "dt")) and len(b.text) < SURGE and REMARKS.fullmatch(b.text):
            ends = b.box
        elif ends is not None and (b.box < ends or b.heading and b.box == ends):
            ends = None
        long = long or b.size >= SURGE
        gone[k] = ends is not None or b.box != main and "ookie" in b.text and NOTICE.search(b.text) is not None
    return without(blocks, gone)


def bridged(blocks: list[Block], kept: list[bool]) -> None:
    """Keeps text outside links, and paragraphs that are one link, between two kept blocks of one container, where it stands in that container itself."""
    last = None
    for k, b in enumerate(blocks):
        if kept[k]:
            if last is not None and blocks[last].box == b.box:
                for j in range(last + 1, k):
                    x = blocks[j]
                    kept[j] = x.box == b.box and (x.size > 0 or x.tag == "p" and x.prose and len(x.text) >= SURGE)
            last = k


#: Elements of an article that are text however short they are.
TEXTUAL = HEADING | set("p li blockquote dd dt pre figcaption caption address td th".split())


def weak(b: Block, main: Block) -> bool:
    """Whether a block at the end of a run speaks against being text: small print, or too short for its place. Sentences in the
    container of the run's longest text are not too short; nor are, in article and main, the elements of texts."""
    if b is main:
        return False
    small = b.size < SURGE and SMALL_PRINT.search(b.text)
    if b.inside:  # a paragraph of the article may well speak of rights
        return b.tag not in TEXTUAL and bool(small or not b.prose and b.size < SHORT) or bool(small) and b.box != main.box
    if small:
        return True
    return not b.support and not (b.box == main.box and b.prose and b.tag in TEXTUAL) and b.size < (SHORT if b.box == main.box else SURGE)


def trimmed(blocks: list[Block], kept: list[bool]) -> None:
    """Cuts the weak blocks that the windows take in at the ends of a run, and adds the strong ones that they leave beside it: texts of
    the run's container within a window's lines. A heading that leads into a run belongs to it, one at its end does not."""
    k = 0
    while k < len(blocks):
        if not kept[k]:
            k += 1
            continue
        end = k
        while end < len(blocks) and kept[end]:
            end += 1
        main = max(blocks[k:end], key=lambda b: b.size)
        first, last = k, end - 1
        while weak(blocks[first], main) and not blocks[first].heading:
            kept[first] = False
            first += 1
        while last > first and (weak(blocks[last], main) or blocks[last].heading and not blocks[last].support and not blocks[last].inside and blocks[last] is not main):
            kept[last] = False
            last -= 1

        def strong(b: Block) -> bool:
            return b.size > 0 and b.box == main.box and b.tag in TEXTUAL and not b.heading and (b.prose or b.inside) and not weak(b, main)

        while last == end - 1 and end < len(blocks) and not kept[end] and blocks[end].gap <= WINDOW and strong(blocks[end]):
            kept[end] = True
            last, end = end, end + 1
        while first and not kept[first - 1] and blocks[first].gap <= WINDOW and (strong(blocks[first - 1]) or blocks[first - 1].heading):
            first -= 1
            kept[first] = True
        k = end


def main_text(page: str | None) -> str:
    """The main text of a page: blocks joined by one newline; empty if there is none.

    Markup, scripts, styles, comments and parts marked as navigation, header, footer, sidebar, notice, advert, form or
    reader comments become empty lines; a part that is marked by half a name only (`share-price`), and the header of an article,
    goes if its text is mostly links, or short and without a heading. Comments under a heading that says so and notices about
    cookies go without a mark. Over the lines, each weighed by its characters outside links, the text between surge and dive points
    of the window sums is kept, in article and main as elsewhere, so thin runs at the ends and between (menus, footers and notices
    that nothing marks) go. Markup only supports this: in containers named as content any text outside links surges, article and
    main alone are searched where they hold at least half of the text, and short text that ends as sentences do, or stands in an
    element of texts in article and main, stays beside a run of its own container. Where no window surges (a very short
    article), all text outside links is kept, and where all stands in links, all of it.
    """
    if not page:
        return ""
    blocks = settled(blocks_of(page))
    inside = [b for b in blocks if b.inside]
    if inside and 2 * sum(b.size for b in inside) >= sum(b.size for b in blocks):
        blocks = inside
    else:
        blocks = [b._replace(support=max(b.support, int(b.inside))) for b in blocks]
    blocks = unmarked(blocks)
    kept = main_spans(blocks)
    if any(kept):
        trimmed(blocks, kept)
        bridged(blocks, kept)
    else:
        blocks = unmarked(inside) or blocks
        kept = main_spans(blocks, supported=True)
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep or not any(kept))


def extract(pages: DataFrame, html_col: str = "html") -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(main_text)

    return run(F.coalesce(F.col(html_col), F.lit("")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page row; null html: empty."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.select("page_id", "url", extract(pages).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
