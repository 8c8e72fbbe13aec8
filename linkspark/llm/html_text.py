"""Main text of HTML pages by scoring the tree of containers.

Each paragraph passes points for its length and its commas to the elements around it:
all of them to the nearest container, half to the next, a third to the next, and so
on (to ``REACH`` of them), discounted by the share of its characters inside links.  The
container with the most points, again discounted by link density, is kept (the article or
main element around it, if it lies in one), with those of its siblings that score well or
are plain paragraphs.  Where no article or main element tells its bounds, siblings need only
hold some sentence and few links, and headings, lists, tables, quotes and code among or
after the kept ones stay too.

Left out whole are elements that are no part of an article by their name (menus, footers,
scripts and so on) or role, and hidden ones.  A class or id leaves an element out only if it
names it, that is, consists of such words ("sidebar", "site-footer"); not where it tells
of the layout (with-, no-, -open and so on), where elements of that word hold most of the points
of a page without other articles, or where they hold its only article.  A form counts like
such a word, so a form around the page stays.  Words inside longer classes ("category-social-history")
halve the points of an element; only where they tell of readers' talk or of what is sold
do they leave out an element with a small share of the points.

Every other character of the kept elements stays.  Character references are decoded,
white space inside a block becomes one space, and blocks are joined in page order by
two line feeds; a line break element is white space.

Time and memory grow with the length of a page, however deep its elements are nested and
whatever quotes are missing: a quote that has no partner in the rest of the page is a plain
character, a tag without an end reaches to the end of the page.

Defined results: null or empty html gives an empty text; broken markup never fails (an
unclosed element ends with the one around it, a stray end tag is skipped); every input
row gives one row, repeated ones too; an empty table gives no rows; the carried columns keep
their names, and columns of the input named text or n_chars that aren't carried are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
BEFORE_ATTRIBUTE = re.compile(r"[\s/]*+")
ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*+")  # an equals sign may begin a name
BEFORE_VALUE = re.compile(r"\s*+=\s*+")
BARE_VALUE = re.compile(r"[^\s>]*+")
RAW = {x: re.compile(rf"</{x}[\s/>]", re.I) for x in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PHRASE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dd dt figcaption caption".split())
OUT = frozenset("head nav footer aside script style noscript template button select option textarea iframe object svg math canvas audio video menu dialog fieldset label input map".split())
WHOLE = frozenset("html body article main".split())
#: Words of class, id or role that name what is no part of an article.
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation navi breadcrumb breadcrumbs footer foot header masthead topbar toolbar notice notices cookie cookies consent gdpr alert popup modal overlay dialog comment comments disqus discussion respond replies reply share sharing social follow subscribe subscription newsletter signup login search related recommended recommendations recirc widget widgets complementary contentinfo paywall pagination pager skip tags".split())
#: Words of OUT_WORDS that name what readers say or what is sold; it may well outweigh the article.
TALK = frozenset("comment comments disqus discussion respond replies reply".split())
SOLD = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr".split())
TOPS = frozenset("header masthead".split())
#: Roles that say the same of a whole element.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar tablist toolbar tooltip".split())
#: Words that add nothing to the naming words of a class: a class of these and naming words alone names its element.
PLAIN = frozenset("site page main blog post posts entry article articles story stories content area box bar block button buttons link links list section container wrapper wrap inner outer left right top bottom item items icon icons unit slot group panel holder module row col column form input title text the primary secondary".split())
FORM = "form"
NAMED = OUT | {"header", FORM}
KEPT = (False, frozenset(), frozenset())
FAINT_SHARE = 0.25  # of a page's points, up to which words inside longer classes name talk or what is sold
#: First and last parts of a class that tells of the layout around what its words name, and first parts of an article's own header.
WITH = frozenset("with without no has hide show".split())
STATES = frozenset("open closed enabled disabled on off active fixed sticky visible hidden".split())
OWN = frozenset("entry article post story".split())
LISTED = frozenset("ul ol dl table blockquote pre figure".split())
REACH = 64  # containers around a paragraph that get points of it
FEW_LINKS = 0.3  # share of an element's characters
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: start tag: (open elements that it ends, elements beyond which it doesn't reach)
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
P_ENDS = (frozenset(["p"]), frozenset(["table", "td", "th", "button", "caption", "object", "article", "section", "body"]))
COMMAS = re.compile("[,、，،]")
HIDDEN = re.compile(r"display\s*+:\s*+none")


class Page:
    """Elements and blocks of a page."""

    def __init__(self, html: str):
        self.tags, self.parents, self.out = ["#root"], [-1], [False]
        self.marks: list[frozenset[str]] = [frozenset()]  # words that may leave an element out
        self.faint: list[bool] = [False]  # whether such words are parts of longer classes
        self.sold: list[bool] = [False]  # whether these tell of talk or what is sold
        self.open: dict[str, list[int]] = {}  # tag: depths of the stack at which it is open
        self.solid = [0]  # depths of elements that aren't phrases
        self.articles = 0  # open article and main elements
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.stack = [0]
        self.buffer: list[str] = []
        self.linked = 0
        self.link_level = 0  # depth of the stack at which the open link began, 0: none
        self.owner = 0
        self.read(html)
        self.flush()
        self.settle()

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.blocks.append((self.owner, text, min(self.linked, len(text))))
            self.buffer, self.linked = [], 0

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if self.out[top]:
            return
        if not self.buffer:
            if not raw or raw.isspace():
                return
            self.owner = self.stack[self.solid[-1]]
        if "&" in raw:
            raw = entities.unescape(raw)
        self.buffer.append(raw)
        if self.link_level:
            self.linked += len(" ".join(raw.split()))

    def push(self, tag: str) -> None:
        depth = len(self.stack)
        self.stack.append(len(self.tags))
        self.tags.append(tag)
        self.open.setdefault(tag, []).append(depth)
        if tag not in PHRASE:
            self.solid.append(depth)
        self.articles += tag in ("article", "main")

    def pop_to(self, depth: int) -> None:
        if self.solid[-1] >= depth:
            self.flush()
        for x in self.stack[depth:]:
            tag = self.tags[x]
            self.open[tag].pop()
            if tag not in PHRASE:
                self.solid.pop()
            self.articles -= tag in ("article", "main")
        del self.stack[depth:]
        if self.link_level > depth:
            self.link_level = 0

    def innermost(self, tags: frozenset[str]) -> int:
        """Depth of the innermost open element of these tags, 0 if there is none."""
        return max((self.open[x][-1] for x in tags if self.open.get(x)), default=0)

    def end_open(self, what: frozenset, limits: frozenset) -> None:
        depth = self.innermost(what)
        if depth and depth > self.innermost(limits):
            self.pop_to(depth)

    def left_out(self, tag: str, attributes: list[tuple[str, str]]) -> tuple[bool, frozenset[str], frozenset[str]]:
        """(whether an element is left out for sure, words that name it, such words as parts of longer classes)."""
        if tag in OUT or tag == "header" and not self.articles:
            return True, *KEPT[1:]
        words: set[str] = set()
        named: set[str] = {FORM} if tag == FORM else set()
        faint: set[str] = set()
        for name, value in attributes:
            if name == "role" and tag not in WHOLE and not ROLES.isdisjoint(value.lower().split()) and not (self.articles and value.lower() == "banner"):
                return True, *KEPT[1:]
            if name in ("class", "id"):
                for one in value.split():
                    parts = SPLIT.sub(" ", one).lower().split()
                    words.update(parts)
                    if len(parts) > 1 and (parts[0] in WITH or parts[-1] in STATES):
                        continue
                    found = [x for x in parts if x in OUT_WORDS and not (x in TOPS and (self.articles or parts[0] in OWN))]
                    whole = all(x in OUT_WORDS or x in PLAIN or x.isdigit() for x in parts)
                    (named if whole else faint).update(found)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
                return True, *KEPT[1:]
        if tag in WHOLE:
            return tag == "article" and not words.isdisjoint(("comment", "comments", "reply", "ad", "advert", "sponsored")), *KEPT[1:]
        if self.articles and tag in HEADINGS:
            return KEPT
        return False, frozenset(named), frozenset(faint)

    def settle(self) -> None:
        """Decide what the marks leave out, and drop its blocks."""
        n = len(self.tags)
        if not any(self.marks) and not any(self.sold):
            return
        above = [self.marks[0]] * n
        for k in range(1, n):
            above[k] = above[self.parents[k]] | self.marks[k] if self.marks[k] else above[self.parents[k]]
        total, by_word, inside = 0.0, dict.fromkeys([*OUT_WORDS, FORM], 0.0), [0.0] * n
        for owner, text, linked in self.blocks:
            points = gain(text, linked)
            total += points
            inside[owner] += points
            for x in above[owner]:
                by_word[x] += points
        real = [tag in ("article", "main") and not out for tag, out in zip(self.tags, self.out)]
        holds, spoken = [0] * n, [False] * n
        for owner, _, _ in self.blocks:
            spoken[owner] = True
        for k in range(n - 1, 0, -1):
            up = self.parents[k]
            inside[up] += inside[k]
            spoken[up] |= spoken[k]
            holds[up] += holds[k] + real[k]
        articles = holds[0]
        full = [k for k in range(1, n) if real[k] and spoken[k]]  # articles with text
        free = {x for x, points in by_word.items() if points > total / 2 and x not in TALK and x not in SOLD}
        around = {x: set() for x in free}  # elements around those of a word
        for k in range(1, n):
            for x in self.marks[k] & free:
                node = k
                while node > 0 and node not in around[x]:
                    around[x].add(node)
                    node = self.parents[node]
        free = {x for x in free if all(x in above[k] or k in around[x] for k in full)}  # none with another article
        dropped, within = [False] * n, [0] * n
        for k in range(1, n):
            up = self.parents[k]
            within[k] = within[up] + real[up]
            marks = self.marks[k] - free
            only = holds[k] and holds[k] + within[k] == articles and marks.isdisjoint(TALK)
            hinted = self.sold[k] and not holds[k] and inside[k] < FAINT_SHARE * total
            dropped[k] = dropped[up] or bool(marks) and not only or hinted
        self.blocks = [x for x in self.blocks if not dropped[x[0]]]

    def start(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        if tag == "br":
            if self.buffer:
                self.buffer.append(" ")
            return
        if tag in CLOSES_P and self.open.get("p"):
            self.end_open(*P_ENDS)
        if tag in CLOSES:
            self.end_open(*CLOSES[tag])
        phrase = tag in PHRASE
        if not phrase:
            self.flush()
        if tag in VOID:
            return
        if phrase and not attributes:
            if tag == "a":
                self.link_level = len(self.stack)
            return
        sure, named, faint = self.left_out(tag, attributes) if attributes or tag in NAMED else KEPT
        if phrase and not (sure or named):
            if tag == "a":
                self.link_level = len(self.stack)
            return
        parent = self.stack[-1]
        self.out.append(self.out[parent] or sure or phrase)
        self.marks.append(named or self.marks[0])
        self.faint.append(bool(faint))
        self.sold.append(not (faint.isdisjoint(TALK) and faint.isdisjoint(SOLD)))
        self.parents.append(parent)
        self.push(tag)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link_level = 0
        depth = self.open[tag][-1] if self.open.get(tag) else 0
        if depth and not (tag in PHRASE and self.solid[-1] > depth):
            self.pop_to(depth)
        elif tag in CLOSES_P:
            self.flush()

    def attributes(self, html: str, at: int, lost: dict[str, bool]) -> tuple[list[tuple[str, str]], int]:
        """Names (lower case) and values from `at` on, and where the tag ends.  lost: quotes that occur no more; they are no quotes then."""
        if html.startswith(">", at):
            return [], at + 1
        out, n = [], len(html)
        while True:
            at = BEFORE_ATTRIBUTE.match(html, at).end()
            if at >= n:
                return out, n
            if html[at] == ">":
                return out, at + 1
            found = ATTRIBUTE.match(html, at)
            at, value = found.end(), ""
            equals = BEFORE_VALUE.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at : at + 1]
                end = html.find(quote, at + 1) if quote in ("\"", "'") and quote not in lost else -1
                if end >= 0:
                    value, at = html[at + 1 : end], end + 1
                else:
                    if quote in ("\"", "'"):
                        lost[quote] = True
                    bare = BARE_VALUE.match(html, at)
                    value, at = bare[0].strip("\"'"), bare.end()
            out.append((found[0].lower(), value))

    def read(self, html: str) -> None:
        at, n = 0, len(html)
        lost: dict[str, bool] = {}
        while at < n:
            begin = html.find("<", at)
            if begin < 0:
                self.text(html[at:])
                return
            ahead = html[begin + 1 : begin + 2]
            if ahead == "/":
                found = NAME.match(html, begin + 2)
            else:
                found = NAME.match(html, begin + 1)
            if not found and ahead not in ("!", "?", "/"):  # a plain character
                self.text(html[at : begin + 1])
                at = begin + 1
                continue
            if begin > at:
                self.text(html[at:begin])
            if not found:  # comments, declarations, odd end tags
                comment = html.startswith("<!--", begin)
                end = html.find("-->" if comment else ">", begin + (2 if comment else 1))
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            tag = found[0].lower()
            if ahead == "/":
                end = html.find(">", found.end())
                at = n if end < 0 else end + 1
                self.end(tag)
                continue
            attributes, at = self.attributes(html, found.end(), lost)
            if tag in RAW:
                close = RAW[tag].search(html, at)
                at = close.start() if close else n
                self.flush()
            else:
                self.start(tag, attributes)


def gain(text: str, linked: int) -> float:
    """Points that a block passes on."""
    size = len(text)
    return (size / 100 if size < 25 else 1 + len(COMMAS.findall(text)) + min(size / 100, 3)) * (1 - linked / size)


def scored(page: Page, reach: int = REACH) -> tuple[list[float], list[int], list[int]]:
    """Points (of blocks up to `reach` containers further in), characters and characters in links of each element."""
    n = len(page.tags)
    points, chars, links = [0.0] * n, [0] * n, [0] * n
    for owner, text, linked in page.blocks:
        own = gain(text, linked)
        node = page.parents[owner] if page.tags[owner] in PARAGRAPH else owner
        for share in range(1, reach + 1):
            if node <= 0:
                break
            points[node] += own / share
            node = page.parents[node]
        chars[owner] += len(text)
        links[owner] += linked
    for k in range(n - 1, 0, -1):
        chars[page.parents[k]] += chars[k]
        links[page.parents[k]] += links[k]
    return points, chars, links


def main_text(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = Page(html)
    if not page.blocks:
        return ""
    points, chars, links = scored(page)
    final = [p * (1 - y / x) * (0.5 if faint else 1) if x else 0.0 for p, x, y, faint in zip(points, chars, links, page.faint)]
    best = max(range(len(final)), key=lambda k: (final[k], -k))
    node = best
    while node > 0:
        if page.tags[node] in ("article", "main"):
            best = node
        node = page.parents[node]
    bounded = page.tags[best] in ("article", "main")
    while not bounded and page.parents[best] > 0 and page.tags[page.parents[best]] not in WHOLE and chars[page.parents[best]] == chars[best]:
        best = page.parents[best]  # which holds nothing else
    parent = page.parents[best]
    kept = {best}
    plain = lambda tag, size, linked, text: tag == "h1" and not linked or tag == "p" and (size > 80 and linked < 0.25 * size or not linked and text.endswith((".", "!", "?")))
    level = max(10.0, 0.2 * final[best])
    spoken = [False] * len(page.tags)  # elements with a sentence
    for owner, text, linked in page.blocks:
        if len(text) >= 25 and linked < FEW_LINKS * len(text) and page.tags[owner] not in HEADINGS:
            node = owner
            while node >= 0 and not spoken[node]:
                spoken[node] = True
                node = page.parents[node]
    loose = set()  # blocks that stand alone beside the best element
    if best:
        for k in range(1, len(page.tags)):
            if page.parents[k] == parent and page.tags[k] != "header" and (final[k] >= level or not bounded and spoken[k] and links[k] < FEW_LINKS * chars[k]):
                kept.add(k)
        for k, (owner, text, linked) in enumerate(page.blocks):
            if page.parents[owner] == parent and owner != best and plain(page.tags[owner], len(text), linked, text) or owner == parent and plain("p", len(text), linked, text):
                loose.add(k)
        if not bounded:
            alone = {page.blocks[k][0] for k in loose} - {parent}
            first = min(kept | alone)
            heads = []
            for k in range(1, len(page.tags)):
                if page.parents[k] != parent or not chars[k]:
                    continue
                few = links[k] < FEW_LINKS * chars[k]
                if page.tags[k] in HEADINGS and few:
                    heads.append(k)
                    continue
                stays = k in kept or k in alone or k > first and page.tags[k] in LISTED and few
                if stays:  # with the headings before it
                    kept.update([k, *heads])
                heads = []
    inside = {}

    def within(node: int) -> bool:
        path = []
        while node not in inside:
            path.append(node)
            if node in kept or node < 0:
                inside[node] = node in kept
                break
            node = page.parents[node]
        for x in path:
            inside[x] = inside[node]
        return inside[node]

    return "\n\n".join(text for k, (owner, text, _) in enumerate(page.blocks) if k in loose or within(owner))


def extract(pages: DataFrame, html_column: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The carried columns, the main text and n_chars (its code points) of each page."""
    fields = [pages.schema[c] for c in carry]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carried"), F.col(html_column).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_carried"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["_carried", "text", "n_chars"])

    inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)
    out = rows.mapInArrow(common.lean(run), f"_carried struct<{inner}>, text string, n_chars long")
    return out.select(*[F.col(f"_carried.`{c}`").alias(c) for c in carry], "text", "n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
