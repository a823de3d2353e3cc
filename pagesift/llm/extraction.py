"""Main-text extraction by composite text density.

Each page becomes a node table in document order.  Subtree sums of text
characters, tags, link characters and link tags come from one pass over it;
a node's density is its characters per tag, adjusted for the share of links.
The node whose children's densities sum highest is the content; the lowest
density on its path to the body is the threshold for further content beside
it, unless the content stands in an ``article`` or ``main`` element: then that
is the content, with its headings.

Parts that are never article text by their element (scripts, menus, footers,
asides, hidden parts) are not read.  Forms, headers and parts named by a role,
class or id (adverts, sidebars, notices, reader comments) are only suspected:
templates name whole pages so.  A suspect goes unless it is a heading or holds
nearly all text of the page (see ``is_layout``), so that what is left decides by
density.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.session import ship_package

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp".split())
RCDATA = frozenset(("title", "textarea"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that an opening tag closes, and the tags at which the search stops.
CLOSES = {
    "li": (frozenset(("li",)), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset("tr td th".split()), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(("option",)), frozenset("select datalist".split())),
}
#: An open paragraph is closed from within these, but not from outside them.
P_SCOPE = frozenset("button td th caption table object html body".split())
# Parts of a page that are no article text, by tag, role and word of a class or id.
DROP_TAGS = frozenset("nav footer aside menu button select dialog svg canvas audio video object head title".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
DROP_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "cookie cookies consent disclaimer disqus feedback footer gdpr header login masthead menu menubar modal "
    "nav navbar navigation newsletter notice pager pagination popup promo promoted recommended related replies reply "
    "respond share sharing sidebar signup sitemap social sponsor sponsored subscribe subscription toolbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: With one of these right before it, such a word tells about the page's layout.
LAYOUT_WORDS = frozenset("has no with without".split())
#: Headers are dropped unless they belong to an article.
ARTICLE_HEADERS = frozenset(("article", "entry", "post", "story"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)",
    re.DOTALL,
)
#: Name and value (in double quotes, in single ones, bare) of one attribute after the other.
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")


#: A suspect with this many times the text of all the rest is the page's layout.
LAYOUT_SHARE = 4


def dropped_words(name: str, in_article: bool) -> set[str]:
    words = _WORD.findall(name)
    found = {w for before, w in zip(["", *words], words) if w in DROP_WORDS and before not in LAYOUT_WORDS}
    if found == {"header"} and (in_article or ARTICLE_HEADERS & set(words)):
        return set()
    return found


def verdict(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is no article text whatever it holds, is suspected not to be, and is a suspected reader comment."""
    if tag in DROP_TAGS:
        return True, False, False
    suspect, comment = tag == "form" or tag == "header" and not in_article, False
    seen = set()
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name = name.lower()
        if name in seen:  # the first of its name holds
            continue
        seen.add(name)
        value = html.unescape("".join(values)).strip().lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False, False
        if name == "role" and value in DROP_ROLES:
            suspect = True
        if name in ("class", "id"):
            words = set().union(*[dropped_words(n, in_article) for n in value.split()])
            suspect |= bool(words)
            comment |= bool(words & COMMENT_WORDS)
    return False, suspect and tag not in HEADINGS, comment


class Page:
    """The elements of a page in document order and its texts.

    ``end[i]`` is the number after the last element in the subtree of ``i``.
    A text is (element, block run, string); the run number changes wherever a
    block begins or ends.  Nothing is kept of dropped elements; ``gone`` marks
    those of suspects that go.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.end = ["#page"], [-1], [0]
        self.texts: list[tuple[int, int, str]] = []
        self.body = 0
        self.suspects: list[tuple[int, bool]] = []
        self._parse(source)
        self.end[0] = len(self.tag)
        self.gone = [False] * len(self.tag)
        self._judge()

    def _judge(self) -> None:
        """Marks the suspects that go, outermost ones first."""
        if not self.suspects:
            return
        plain, blocks, landmarks = [0] * len(self.tag), [0] * len(self.tag), [0] * len(self.tag)
        linked = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            linked[i] = self.tag[i] == "a" or linked[self.parent[i]]
        runs = set()
        for i, run, t in self.texts:
            n = len("".join(t.split()))
            plain[i] += 0 if linked[i] else n
            if n and run not in runs:
                runs.add(run)
                blocks[i] += 1
        for i in range(len(self.tag) - 1, 0, -1):
            p = self.parent[i]
            landmarks[i] += self.tag[i] in ("article", "main", "h1")
            plain[p] += plain[i]
            blocks[p] += blocks[i]
            landmarks[p] += landmarks[i]
        outside = plain[0] - self._suspected_within(0, plain)
        for i, comment in self.suspects:
            if self.gone[i]:
                continue
            if self.is_layout(plain[i], outside, blocks[i], landmarks[i], comment):
                # its text counts as the page's; suspects within are judged on their own
                outside += plain[i] - self._suspected_within(i, plain)
            else:
                self.gone[i : self.end[i]] = [True] * (self.end[i] - i)
        self.texts = [t for t in self.texts if not self.gone[t[0]]]

    def _suspected_within(self, i: int, plain: list[int]) -> int:
        """Text of the outermost suspects inside of an element."""
        total, at = 0, i + 1
        for k in range(bisect.bisect_right(self.suspects, (i, True)), len(self.suspects)):
            j = self.suspects[k][0]
            if j >= self.end[i]:
                break
            if j >= at:
                total += plain[j]
                at = self.end[j]
        return total

    @staticmethod
    def is_layout(inside: int, outside: int, blocks: int, landmarks: int, comment: bool) -> bool:
        """Whether a suspect is what the page stands in: it has nearly all text, and an article, a main part, a title
        or (if not named as a comment) three blocks of text."""
        return inside > LAYOUT_SHARE * outside and (landmarks > 0 or blocks >= 3 and not comment)

    def _parse(self, source: str) -> None:
        stack, names, opened = [0], ["#page"], Counter()  # element numbers, their tags, how many of each are open
        skip = run = at = 0  # skip: depth of the outermost dropped element, else 0

        def close_to(depth: int) -> None:
            nonlocal skip, run
            for i, name in zip(stack[depth:], names[depth:]):
                if i >= 0:
                    self.end[i] = len(self.tag)
                opened[name] -= 1
                run += name in BLOCK
            del stack[depth:], names[depth:]
            if depth <= skip:
                skip = 0

        def element(tag: str) -> int:
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.end.append(len(self.tag))
            return len(self.tag) - 1

        def enter(tag: str, number: int) -> None:
            stack.append(number)
            names.append(tag)
            opened[tag] += 1

        def text(raw: str) -> None:
            if raw and not skip:
                self.texts.append((stack[-1], run, html.unescape(raw) if "&" in raw else raw))

        while at < len(source):
            m = _TOKEN.search(source, at)
            text(source[at : m.start()] if m else source[at:])
            if m is None:
                break
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                if opened[tag] > 0 and tag not in ("html", "body"):  # what follows the body's end still belongs to it
                    depth = len(names) - 1 - names[::-1].index(tag)
                    if tag in BLOCK or not any(x in BLOCK for x in names[depth + 1 :]):
                        close_to(depth)
                elif tag in BLOCK:
                    run += 1
                elif tag == "br":
                    text(" ")
                continue
            tag, attributes = (m[2] or m[4] or "").lower(), m[3] or m[5] or ""
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            if not tag or not m[0].endswith(">"):
                continue  # a comment or declaration, or the page ends within a tag
            if tag in RAW or tag in RCDATA:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                at = close.end() if close else len(source)
                continue
            if tag == "html":
                continue
            if tag == "body":
                if not self.body:
                    close_to(1)
                    self.body = element(tag)
                    enter(tag, self.body)
                continue
            if tag in CLOSES:
                closed, stop = CLOSES[tag]
                if any(opened[x] > 0 for x in closed):
                    for depth in range(len(names) - 1, 0, -1):
                        if names[depth] in closed:
                            close_to(depth)
                            if tag != "tr":
                                break
                        elif names[depth] in stop:
                            break
            if tag in BLOCK:
                if opened["head"] > 0:  # never closed
                    close_to(names.index("head"))
                if opened["p"] > 0:
                    for depth in range(len(names) - 1, 0, -1):
                        if names[depth] == "p":
                            close_to(depth)
                        if depth < len(names) and names[depth] in P_SCOPE or not opened["p"]:
                            break
                if tag in HEADINGS and names[-1] in HEADINGS:
                    close_to(len(names) - 1)
                run += 1
            if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
                if not skip:
                    if tag == "br":
                        text(" ")
                    element(tag)
            elif skip:
                enter(tag, -1)
            else:
                drop, suspect, comment = verdict(tag, attributes, opened["article"] > 0 or opened["main"] > 0)
                if drop:
                    skip = len(names)
                    enter(tag, -1)
                else:
                    enter(tag, element(tag))
                    if suspect:
                        self.suspects.append((stack[-1], comment))
        close_to(1)

    def densities(self) -> None:
        """Sums over subtrees, and the composite density of every block.

        An inline element counts as a tag of its block and has no density of
        its own; the text that stands in a block itself counts as one more
        child of it.
        """
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for i, _, t in self.texts:
            chars[i] += len("".join(t.split()))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if self.gone[i]:
                continue
            if self.tag[i] == "a":
                link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i]
        self.chars, self.link_chars, self.link_tags = chars, link_chars, link_tags
        share = link_chars[self.body] / max(chars[self.body], 1)

        def composite(c: int, t: int, lc: int, lt: int) -> float:
            if not c:
                return 0.0
            t, lc_, lt = max(t, 1), max(lc, 1), max(lt, 1)
            base = math.log(c / max(c - lc, 1) * lc_ + share * c + math.e)
            return max(0.0, c / t * math.log(c / lc_ * t / lt) / math.log(base))

        # what is left of a block when its child blocks are taken away is its own text
        rest = [[chars[i], tags[i], link_chars[i], link_tags[i]] for i in range(n)]
        holder = [0] * n
        for i in range(1, n):
            holder[i] = i if self.is_block(i) else holder[self.parent[i]]
            if holder[i] == i and not self.gone[i]:
                h = holder[self.parent[i]]
                for k, v in enumerate((chars[i], tags[i] + 1, link_chars[i], link_tags[i])):
                    rest[h][k] -= v
        self.density, self.below = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if self.is_block(i) and not self.gone[i]:
                self.density[i] = composite(chars[i], tags[i], link_chars[i], link_tags[i])
                self.below[i] += composite(*rest[i])
                if i:
                    self.below[holder[self.parent[i]]] += self.density[i]

    def is_block(self, i: int) -> bool:
        return self.tag[i] in BLOCK or i == 0

    def content(self) -> list[int]:
        """Roots of the content subtrees, in document order."""
        self.densities()
        blocks = [i for i in range(self.body, self.end[self.body]) if self.is_block(i) and not self.gone[i]]
        best = max(blocks, key=lambda i: (self.below[i], -i))
        path, i = [best], best
        while i > self.body:
            i = self.parent[i]
            path.append(i)
        threshold = min(self.density[i] for i in path if self.is_block(i))
        # the whole article, with its headings, not only the part of it that has most text
        best = next((i for kind in ("article", "main") for i in path if self.tag[i] == kind), best)
        alone = self.tag[best] in ("article", "main")
        titled = any(self.tag[i] == "h1" and self.chars[i] for i in range(best, self.end[best]))
        roots, at = [], self.body
        while at < self.end[self.body]:
            if self.gone[at]:
                at = self.end[at]
            elif at == best or self.tag[at] == "h1" and not titled:
                roots.append(at)
                at = self.end[at]
            elif at < best < self.end[at]:
                at += 1
            elif not alone and self.is_block(at) and self.chars[at] and self.density[at] >= threshold and not self.is_menu(at):
                roots.append(at)
                at = self.end[at]
            else:
                at += 1
        return roots

    def is_menu(self, i: int) -> bool:
        """A block of three links or more and no other text."""
        return self.link_tags[i] >= 3 and self.link_chars[i] == self.chars[i]

    def main_text(self) -> str:
        """Blocks of the content joined by an empty line; white space within a block is one blank."""
        kept = [False] * len(self.tag)
        for r in self.content():
            kept[r : self.end[r]] = [True] * (self.end[r] - r)
        at = 0
        while at < len(kept):
            if kept[at] and self.tag[at] in ("ul", "ol", "dl", "table") and self.is_menu(at):
                kept[at : self.end[at]] = [False] * (self.end[at] - at)
                at = self.end[at]
            else:
                at += 1
        blocks: dict[int, list[str]] = {}
        for i, run, t in self.texts:
            if kept[i]:
                blocks.setdefault(run, []).append(t)
        lines = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n\n".join(x for x in lines if x)


RESULT = "page_id long, url string, text string, n_chars long"


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: ``page_id, url, text, n_chars``.

    Character references are decoded, white space inside a block becomes one
    blank, blocks are joined in page order by an empty line.  ``text`` is empty
    for null and empty pages and where nothing is left; a page without tags is
    one block.  Cut-off markup is read as far as it goes; null ids and urls and
    repeated rows keep their row; other columns are not read.
    """
    ship_package(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(h.as_py() or "").main_text() for h in b.column(2)]
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col))
    return picked.mapInArrow(extract, RESULT)
