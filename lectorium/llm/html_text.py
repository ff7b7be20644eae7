"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one classifies each block by itself: text in
boilerplate containers (menus, headers, footers, sidebars, forms, adverts, notices, comments) and blocks
that are mostly links are bad; blocks with enough words and a fair share of stop words are good; long
blocks without stop words and all short blocks are undecided. On a page whose long blocks hold hardly any
stop words, as in languages that the list doesn't cover, length and link density alone make a block good.
Pass two: in an article container an undecided block is good, unless the article has good blocks and the
nearest decided ones on both sides are bad; outside one it gets the label of its nearest decided
neighbours, where a tie falls to bad. A page with an article (or main) container has its text there only, unless
that holds fewer words than a good block and there is a long block elsewhere.
A class or id around a main container doesn't make it boilerplate, nor around an article if there is no other.

Defined results: null, empty or text-free html gives an empty text; unclosed comments, scripts and
styles run to the end; markup cut off in the middle of a tag ends there; repeated rows are each kept.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectorium.llm._io import frugal, ship, table

#: Elements without any text of the article.
DROPPED = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "textarea", "button", "head", "title", "audio", "video", "datalist", "map"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
CONTAINERS = {"nav", "footer", "aside", "form", "dialog", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Classes and ids that mark boilerplate, alone or with each other and words of FRAME in one name.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "header masthead footer sidebar side aside widget related recommended recommendations share sharing social comments comment reply replies disqus respond "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search toolbar skip hidden paywall".split()
)
FRAME = set("site main page top bottom left right center primary secondary global sticky fixed floating mobile desktop list item items box block bar container wrapper wrap section area inner outer panel group row col column slot posts articles links link button buttons btn icon icons form module region zone card cards count thread policy".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: End tags that browsers supply.
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
ARTICLE = {"article", "main"}
STOP_WORDS = set(
    "the of and to in a is that it for was on are with as be at this by from he his her she they not or an which have had but "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de des du et un une en est que qui dans pour pas au sur par plus il elle ce se sont avec ne "
    "el los las y del que en un una por con para es no su al lo como más o pero sus ha".split()
)
LINKS, MIN_WORDS, GOOD_STOP_SHARE = 0.5, 12, 0.2
#: Below this share over a page's long blocks stop words say nothing; signs of scripts without spaces that count as a word.
NO_STOP_SHARE, SIGNS = 0.1, 2

# Attributes as browsers cut them: a quote begins a value only after the equals sign. Nothing is tried twice.
_TAG = re.compile(r"""<!--|<!\[CDATA\[|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?)?|=)*+)>""")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SIGN = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")  # scripts without spaces


def _marks(value: str) -> bool:
    """Whether a class or id has a name that marks boilerplate: `share`, `site-header`, but not `share-price`."""
    for name in value.split():
        parts = re.findall(r"[^\W\d_]+", name)
        if MARKS.intersection(parts) and all(x in MARKS or x in FRAME for x in parts):
            return True
    return False


def _boilerplate(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate by what it is, and whether by a word of its class or id."""
    if name in CONTAINERS or (name == "header" and not in_article):
        return True, False
    if not attributes or name in ("html", "body", "article", "main"):
        return False, False
    marked = False
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        value = _html.unescape(m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True, False
        if key == "role" and value in ROLES:
            return True, False
        if key in ("class", "id") and _marks(value):
            marked = True
    return False, marked


class _Block:
    __slots__ = ("text", "linked", "bad", "wrapped", "article", "label")

    def __init__(self, text, linked, bad, wrapped, article):
        self.text, self.linked, self.bad, self.wrapped, self.article, self.label = text, linked, bad, wrapped, article, None


def blocks(page: str) -> list[_Block]:
    """The blocks of a page in order, with what is known about where each stands."""
    out: list[_Block] = []
    # Name, boilerplate below it, that by a class or id outside articles, text dropped below it, in an article.
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    pieces: list[str] = []
    links: list[str] = []
    in_link, at, size = 0, 0, len(page)

    def flush():
        text = " ".join(_html.unescape("".join(pieces)).split())
        if text:
            linked = len("".join(_html.unescape("".join(links)).split()))
            _, bad, wrapped, _, article = stack[-1] if stack else ("", False, False, False, False)
            out.append(_Block(text, linked / max(1, len(text.replace(" ", ""))), bad or wrapped, wrapped and not bad, article))
        pieces.clear()
        links.clear()

    def add(text):
        if text and not (stack and stack[-1][3]):
            pieces.append(text)
            if in_link:
                links.append(text)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        m = _TAG.match(page, lt)
        if not m:
            if re.match(r"</?[a-zA-Z!?]", page[lt : lt + 3]) and page.find(">", lt) < 0:
                break  # cut off inside a tag
            add("<")
            at = lt + 1
            continue
        at = m.end()
        lead = m[0]
        if lead == "<!--":
            end = page.find("-->", at)
            at = size if end < 0 else end + 3
            continue
        if lead == "<![CDATA[":
            end = page.find("]]>", at)
            at = size if end < 0 else end + 3
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:  # an end tag
            if name in BLOCKS:
                flush()
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name == "br":
                add(" ")
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
                if stack[depth][0] in ("article", "main", "body", "table") and name not in ("article", "main", "body", "html", "table"):
                    break
            continue
        if name in BLOCKS:
            flush()
            in_link = 0
        if name == "br":
            add(" ")
        if name in VOID:
            continue
        if name == "a":
            in_link += 1
        while stack and stack[-1][0] in CLOSED_BY and name in CLOSED_BY[stack[-1][0]]:
            stack.pop()
        if name in BLOCKS:  # inline elements left open don't reach past the paragraph
            depth = len(stack)
            while depth and stack[depth - 1][0] not in BLOCKS and stack[depth - 1][0] not in DROPPED:
                depth -= 1
            if depth and stack[depth - 1][0] in CLOSED_BY and name in CLOSED_BY[stack[depth - 1][0]]:
                del stack[depth - 1 :]
        if m[3].endswith("/") and name not in BLOCKS and name not in RAW:
            continue
        above = stack[-1] if stack else ("", False, False, False, False)
        article = above[4] or name in ARTICLE
        bad, wrapped = above[1], above[2] and not (name == "main" and not above[4])
        if name in BLOCKS or name in DROPPED or name in ("a", "span", "section"):
            own, marked = _boilerplate(name, m[3], above[4])
            bad = bad or own or marked and above[4]
            wrapped = wrapped or marked and not above[4]
        stack.append((name, bad, wrapped, above[3] or name in DROPPED, article))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            stack.pop()
            at = end.end() if end else size
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text: good blocks in page order, joined by an empty line."""
    found = blocks(page or "")
    article = any(b.article and not b.bad for b in found)
    if not article:
        for b in found:
            if b.article and b.wrapped:
                b.bad, article = False, True
    long, stop, total = [], 0, 0
    cut = [_WORD.findall(b.text.lower()) for b in found]
    sizes = [len(words) if b.text.isascii() else max(len(words), len(_SIGN.findall(b.text)) // SIGNS) for b, words in zip(found, cut, strict=True)]
    if article and sum(n for b, n in zip(found, sizes, strict=True) if b.article and not b.bad) < MIN_WORDS:
        # A container with a heading alone isn't where the text is, if there is text elsewhere.
        article = not any(n >= MIN_WORDS and not b.article and not b.bad and b.linked <= LINKS for b, n in zip(found, sizes, strict=True))
    for b, words, size in zip(found, cut, sizes, strict=True):
        if b.bad or (article and not b.article) or b.linked > LINKS:
            b.label = False
        elif size >= MIN_WORDS:
            known = sum(w in STOP_WORDS for w in words)
            long.append(b)
            stop, total = stop + known, total + size
            if known >= GOOD_STOP_SHARE * size:
                b.label = True
    if stop < NO_STOP_SHARE * total:
        for b in long:
            b.label = True
    some = any(b.article and b.label for b in found)
    kept, n = [], len(found)
    before: list[bool | None] = [None] * n
    last, distance = None, [0] * n
    for i, b in enumerate(found):
        if i and b.article != found[i - 1].article:
            last = None
        if b.label is not None and not b.bad:
            last = (i, b.label)
        before[i] = last
    last = None
    for i in range(n - 1, -1, -1):
        b = found[i]
        if i + 1 < n and b.article != found[i + 1].article:
            last = None
        if b.label is not None and not b.bad:
            last = (i, b.label)
        label = b.label
        if label is None:
            left, right = before[i], last
            near = [x for x in (left, right) if x]
            if b.article:
                label = not some or len(near) < 2 or any(x[1] for x in near)
            elif not near:
                label = False
            elif len(near) == 1:
                label = near[0][1]
            elif near[0][1] == near[1][1]:
                label = near[0][1]
            else:
                d = (i - near[0][0]) - (near[1][0] - i)
                label = near[0][1] if d < 0 else near[1][1] if d > 0 else False
        if label:
            kept.append(b.text)
    return "\n\n".join(reversed(kept))


@frugal
def _extract(batches):
    for batch in batches:
        texts = [extract(x) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[1:], "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages(page_id, url, html)."""
    ship(pages.sparkSession)
    return pages.select("html", "page_id", "url").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
