"""Main text of web pages by tag-path ratios.

The page is scanned once into blocks of text, each with the path of block-level tags (and classes) from
the root. Text length, punctuation and link text are summed for each path; a block's value is its path's
mean length times mean punctuation, times the part that isn't link text. Values are smoothed over
neighbouring blocks, fused with the unsmoothed ones, and weighted by what the path's tags, roles and class
names say of it (a class name alone never decides). Blocks over a threshold, a part of the values'
deviation, are content, and all of them are the result.

Short blocks have low ratios, so inside the region of the content (the deepest element with nearly all of
its text, or the article or main element around it) everything is content that nothing tells against:
neutral elements, bare text, details, bylines and lists of links too. What tells against a block there is its
weight, a call to buy or subscribe as its only text, or text of buttons alone. Where the region is the whole body, only tags of prose
(headings, list items, cells, captions, quotations, paragraphs) are; and so is a heading right before content. A heading that counts
replies, or names them behind an article, begins reader comments up to the end of its element. Menus, headers and footers,
sidebars, scripts and styles, told by their tags and roles, have the weight zero, and so has a form, but
for one that holds most of the page's text.

Pages are independent rows: no shuffle, and work is linear in a page's length, whatever its nesting. Null
or empty pages give an empty text; repeated rows are extracted again; null ids and urls stay; an empty
table gives no rows; extra columns are ignored. Unclosed and misnested tags are closed as browsers do for
paragraphs, list items and table cells; an unclosed script or comment ends with the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.text_arrays import slices

# What HTML says of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe select option audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "link listing main menu meta nav noframes ol optgroup p param plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
) | RAW
BOILERPLATE_TAGS = frozenset("head nav footer aside dialog menu".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Closed by the start of these.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words in class names and ids that tell against content, and such as tell little; their weights.
AGAINST = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|sidebar|breadcrumbs?|masthead|footer|cookies?|consent|gdpr|notices?|notification|popup|modal|"
    r"overlay|newsletter|subscribe|signup|login|comments?|disqus|discussion|replies|share|sharing|social|recommended|widget|toolbar|pagination|pager)(?:$|[\s_-])",
    re.I,
)
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:header|foot|side|related|respond|copyright|legal)(?:$|[\s_-])", re.I)
AGAINST_WEIGHT, DOUBTFUL_WEIGHT = 0.05, 0.5
#: The whole text of a neutral element that is a call to the reader and no part of an article.
CALL = re.compile(r"(?:buy|shop|order|subscribe|sign up|join|download|donate|register|click|read|learn)(?: (?:it|us|for))?(?: (?:now|here|today|free|more))[ !.>»]*", re.I)
#: A heading of reader comments: anywhere, and behind an article.
COUNTED_REPLIES = re.compile(r"\W*(?:\d+ (?:reader )?(?:repl(?:y|ies)|comments?|responses?)|(?:reader )?(?:replies|comments|responses) \(\d+\)|leave a (?:reply|comment))\W*", re.I)
REPLIES = re.compile(r"\W*(?:reader )?(?:replies|comments|responses)\W*", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?]")
_SPACES = re.compile(r"\s+")

#: Of the values' standard deviation: the threshold; of the content's text: what its region must hold.
DEVIATION, MOSTLY = 0.6, 0.9


class Element:
    __slots__ = ("tag", "parent", "depth", "path", "weight", "link", "button", "form", "base", "solid", "article")

    def __init__(self, tag: str, parent: Element | None, path: int, weight: float):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.path, self.weight, self.link = path, weight, tag == "a" or bool(parent and parent.link)
        self.button = tag == "button" or bool(parent and parent.button)
        self.form: Element | None = self if tag in ("form", "fieldset") and not (parent and parent.form) else parent.form if parent else None
        #: The nearest element, itself included, that isn't inline; and the nearest that is no paragraph either.
        self.base: Element = parent.base if parent and tag not in BLOCKS else self
        self.solid: Element = parent.solid if parent and (tag not in BLOCKS or tag == "p") else self
        self.article: Element | None = self if tag in ("article", "main") else parent.article if parent else None


def _weight(tag: str, names: str, parent: Element) -> float:
    """What a tag, its role and its names leave of its parent's weight."""
    if tag in BOILERPLATE_TAGS:
        return 0.0
    if tag == "header":
        return parent.weight * DOUBTFUL_WEIGHT if parent.article else 0.0
    if not names or tag in ("html", "body", "article", "main"):
        return parent.weight
    if any(w in BOILERPLATE_ROLES for w in names.lower().split()):
        return 0.0
    return parent.weight * (AGAINST_WEIGHT if AGAINST.search(names) else DOUBTFUL_WEIGHT if DOUBTFUL.search(names) else 1.0)


def _scan(page: str) -> list[tuple[Element, str, int]]:
    """Blocks in page order: element, text with single spaces, characters of it that are link text. Parts of no weight and blocks of buttons alone are left out."""
    paths: dict[tuple[int, str], int] = {}
    at = Element("", None, 0, 1.0)
    opened: dict[str, int] = {}
    blocks: list[tuple[Element, str, int]] = []
    parts: list[str] = []
    linked = plain = 0  # of links; outside buttons
    here, n = 0, len(page)
    lower = None

    def text(a: int, b: int) -> None:
        nonlocal linked, plain
        if a < b and at.weight:
            s = entities.unescape(page[a:b])
            parts.append(s)
            if not at.button:
                plain += len(s.strip())
            if at.link:
                linked += len(s.strip())

    def cut() -> None:
        nonlocal linked, plain
        if parts:
            line = _SPACES.sub(" ", "".join(parts)).strip()
            if line and plain:
                blocks.append((at.base, line, linked))
            parts.clear()
        linked = plain = 0

    def close(to: Element) -> None:
        nonlocal at
        while at is not to:
            opened[at.tag] -= 1
            at = at.parent

    while here < n:
        m = _TOKEN.search(page, here)
        if not m:
            text(here, n)
            break
        text(here, m.start())
        here = m.end()
        closing, opening = m[1], m[2]
        if closing:
            tag = closing.lower()
            if tag in BLOCKS:
                cut()
            if opened.get(tag):  # else it closes nothing
                x = at
                while x.tag != tag:
                    x = x.parent
                if tag not in BLOCKS or x.base is x:
                    close(x.parent)
        elif opening:
            tag = opening.lower()
            if tag in BLOCKS:
                cut()
                if at.base.tag == "p":  # a block ends a paragraph, and what is open in it
                    close(at.solid)
                if tag in CLOSED_BY.get(at.base.tag, ()):
                    close(at.base.parent)
            elif tag == "br" and at.weight:
                parts.append(" ")
            attributes = m[3] or ""
            if tag in VOID or attributes.endswith("/"):
                continue
            if tag in RAW:
                lower = lower or page.lower()
                end = lower.find(f"</{tag}", here)
                here = n if end < 0 else (page.find(">", end) + 1 or n)
                continue
            if tag not in BLOCKS:
                at = Element(tag, at, at.path, 0.0 if tag in BOILERPLATE_TAGS else at.weight)
            else:
                names = " ".join(a[1] or a[2] or a[3] for a in _NAMES.findall(attributes)) if "=" in attributes else ""
                at = Element(tag, at, paths.setdefault((at.path, f"{tag}.{names}"), len(paths) + 1), _weight(tag, names, at))
            opened[tag] = opened.get(tag, 0) + 1
    cut()
    return _without_forms(blocks)


def _without_forms(blocks: list[tuple[Element, str, int]]) -> list[tuple[Element, str, int]]:
    """All blocks but those in forms, except a form with more than half of the text that nothing tells against."""
    held: dict[Element | None, int] = {}
    for element, s, linked in blocks:
        held[element.form] = held.get(element.form, 0) + (max(0, len(s) - linked) if element.weight >= DOUBTFUL_WEIGHT else 0)
    total = sum(held.values())
    return [b for b in blocks if b[0].form is None or 2 * held[b[0].form] > total]


def _content(blocks: list[tuple[Element, str, int]]) -> list[bool]:
    """Whether each block has the ratios of content. None has where names tell against all of them."""
    if all(element.weight <= AGAINST_WEIGHT for element, _, _ in blocks):
        return [False] * len(blocks)
    sums: dict[int, list[int]] = {}
    for element, s, linked in blocks:
        path = sums.setdefault(element.path, [0, 0, 0, 0])
        for i, x in enumerate((len(s), len(_PUNCTUATION.findall(s)), 1, min(linked, len(s)))):
            path[i] += x
    value = {p: (length / count) * (1 + marks / count) * (1 - linked / length) for p, (length, marks, count, linked) in sums.items()}
    raw = [value[element.path] for element, _, _ in blocks]
    # a window of three, and the geometric mean of smoothed and raw values
    smooth = [sum(raw[max(0, i - 1) : i + 2]) / len(raw[max(0, i - 1) : i + 2]) for i in range(len(raw))]
    # where there is an article, names tell more against what is outside
    article = any(element.article for element, _, _ in blocks)
    weights = [element.weight * (AGAINST_WEIGHT if article and not element.article and element.weight < 1 else 1) for element, _, _ in blocks]
    fused = [(a * b) ** 0.5 * w for a, b, w in zip(raw, smooth, weights, strict=True)]
    mean = sum(fused) / max(len(fused), 1)
    least = DEVIATION * (sum((x - mean) ** 2 for x in fused) / max(len(fused), 1)) ** 0.5
    # names against a block count until its value is near the mean in spite of them
    found = [x > 0 and x >= (least if element.weight > AGAINST_WEIGHT else max(least, 0.9 * mean)) for x, (element, _, _) in zip(fused, blocks, strict=True)]
    return found if any(found) else [element.weight > AGAINST_WEIGHT for element, _, _ in blocks]


def _region(blocks: list[tuple[Element, str, int]], content: list[bool]) -> Element:
    """The deepest element that holds nearly all content text, or the article or main element around it."""
    held: dict[Element, int] = {}
    levels: dict[int, list[Element]] = {}

    def add(x: Element, n: int) -> None:
        if x not in held:
            levels.setdefault(x.depth, []).append(x)
        held[x] = held.get(x, 0) + n

    for (element, s, _), good in zip(blocks, content, strict=True):
        if good:
            add(element, len(s))
    total = sum(held.values())
    # from the deepest on, each element's text is added to its parent's once
    for depth in range(max(levels), -1, -1):
        for x in levels.get(depth, ()):
            if held[x] >= MOSTLY * total:
                return x.article or x
            add(x.parent, held[x])
    raise AssertionError("the root holds everything")


def _inside(region: Element, x: Element, known: dict[Element, bool]) -> bool:
    way = []
    while x is not None and x not in known:
        way.append(x)
        x = x.parent
    found = known[x] if x is not None else False
    for y in way:
        known[y] = found
    return found


def main_text(page: str | None) -> str:
    """The main text of one page: a line for each block."""
    blocks = _scan(page) if page else []
    content = _content(blocks) if blocks else []
    if not any(content):
        return ""
    region = _region(blocks, content)
    if region.tag in ("p", "li", "td", "th", "dt", "dd", *HEADINGS) and region.parent:
        region = region.parent
    whole = region.tag in ("", "html", "body")
    articles = {element.article for (element, _, _), good in zip(blocks, content, strict=True) if good and element.article}
    known = {region: True}

    def belongs(element: Element, s: str, linked: int) -> bool:
        """Whether what isn't content by its ratios stays where it stands."""
        prose = element.tag in PROSE_TAGS
        if element.weight < DOUBTFUL_WEIGHT or (not prose and CALL.fullmatch(s)):
            return False
        if element.article in articles or (not whole and _inside(region, element, known)):
            return element.weight == 1 or (prose and 2 * linked <= len(s))
        return whole and element.weight == 1 and prose and 2 * linked <= len(s)

    stays = [good or belongs(*b) for b, good in zip(blocks, content, strict=True)]
    following = False
    for i in range(len(blocks) - 1, -1, -1):
        element, s, linked = blocks[i]
        stays[i] = stays[i] or (following and element.weight == 1 and element.tag in HEADINGS and 2 * linked <= len(s))
        following = stays[i]
    out: list[str] = []
    replies: Element | None = None  # whose rest is reader comments
    within: dict[Element, bool] = {}
    for (element, s, _), good in zip(blocks, stays, strict=True):
        if replies is not None and not _inside(replies, element, within):
            replies = None
        if replies is None and element.tag in HEADINGS and (COUNTED_REPLIES.fullmatch(s) or (articles and element.article not in articles and REPLIES.fullmatch(s))):
            replies, within = element.parent, {element.parent: True}
        if good and replies is None:
            out.append(s)
    return "\n".join(out)


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 500):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows_in = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows_in.mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
