"""Main text of web pages, with site templates removed.

Each page is parsed once into a tree (tolerant of open and stray tags). What is no article by its markup goes: scripts, styles,
menus (nav, menu), the page's headers (not an article's), footers, asides, forms and their controls, and elements whose role,
class or id names them as a menu, header, footer, sidebar, notice, advert, form or reader comment: by nothing but such a name and
words of layout (site-footer, ad-box), so notice-period and menu-recipes stay, as does a heading's id, which names its topic. A form
or a named element that holds the page's main element is a frame around it and stays. What is not shown goes (hidden, template, a closed
dialog). Of the main element (else the body) the outermost articles make the text if they hold half of it or more,
all of them, whatever their size; else all of it does. What is left is cut into blocks.

Site templates: every block element that is left has a hash of its subtree (tag, text and subtrees); inside an article also of the
places of it and what it stands in among their siblings, from the nearer end, as articles may share passages, but a site's frame
repeats them at one place. Spark counts, per host and
per section of it (the first part of the path), the different pages that hold a hash; pages are different if the texts
left of them are, so an article that is published at several addresses counts once. A subtree on MIN_PAGES different pages or
more that are SHARE or more of the host's or the section's different pages is template: it is deleted with all it holds.

White space in a block becomes one space, blocks are trimmed, empty ones go; the rest is joined by line feeds. Null and empty
html gives an empty text; a null url, or one without host, has no templates. All columns of pages but html are kept, whatever
their names; text and n_chars replace columns of that name. Repeated rows get equal results; an empty table an empty result."""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import fresh, kept, materialize, maybe_broadcast

MIN_PAGES, SHARE = 4, 0.5
#: Hosts and sections with templates that may be broadcast; each holds twice the subtrees of its mean page at most. More are shuffled.
BROADCAST_SITES = 50_000

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
DROPPED = frozenset("head script style noscript template textarea title iframe svg nav menu footer aside form button select option input".split())
ENDS_P = BLOCKS - {"body", "html", "tbody", "tfoot", "thead", "tr"}
SCOPES = frozenset("article aside body blockquote button details dialog div dd dt figcaption figure footer form header html li main nav section table td th ul ol".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# What sites call menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
NAMES = frozenset(
    "nav navbar navigation navi menu submenu breadcrumb breadcrumbs pagination pager "
    "header siteheader masthead footer sitefooter sidebar aside "
    "cookie cookies consent gdpr notice notices banner popup modal paywall newsletter "
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo "
    "form searchform search login signup subscribe comment comments commentlist disqus".split()
)
# Words of layout that stand beside these in names.
LAYOUT = frozenset(
    "site page main top bottom left right side center inner outer primary secondary global mobile desktop sticky fixed "
    "box bar block area section region zone slot unit space wrapper wrap container holder panel group row column col "
    "list item items link links button toggle title text body content message policy info copyright logo image widget "
    "article post entry story user reader author reply respond thread google overlay window card".split()
)
#: First parts of a name whose header is the article's own (post-header): anywhere, and while it stands inside one.
OWN = frozenset("article post entry story".split())
OWN_INSIDE = OWN | frozenset("content main body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIZES = re.compile(r"[0-9]+(?:x[0-9]+)?")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACE = re.compile(r"\s+")
ENDS = {tag: re.compile(rf"</{tag}(?=[\s>/])[^>]*>", re.I) for tag in RAW}


class Node:
    """An element: its children are nodes and texts."""

    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def named(self) -> dict[str, str]:
        return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.attributes)} if self.attributes.strip() else {}


def parse(page: str) -> Node:
    root = Node("#root")
    stack, open_, at = [root], Counter(), 0

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(references.unescape(raw) if "&" in raw else raw)

    def close(place: int) -> None:
        open_.subtract(x.tag for x in stack[place:])
        del stack[place:]

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            stack[-1].children.append(m[1])
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if open_[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif tag == "p":  # as browsers do: an end without a beginning is an empty paragraph
                stack[-1].children.append(Node("p"))
            continue
        if tag in ENDS_P and open_["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        if tag in SAME:
            closes = SAME[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    close(i)
                elif stack[i].tag in SCOPES:
                    break
        node = Node(tag, m[4] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            if end := ENDS[tag].search(page, at):
                if tag == "xmp":
                    node.children.append(page[at : end.start()])
                at = end.end()
            elif tag != "title":
                at = len(page)
        elif tag not in VOID and not (m[4] or "").rstrip().endswith("/"):
            stack.append(node)
            open_[tag] += 1
    text(page[at:])
    return root


def _all(node: Node) -> list[Node]:
    found, work = [], [node]
    while work:
        x = work.pop()
        found.append(x)
        work.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return found


def _named_away(node: Node, in_article: bool, around: dict[str, set[int]]) -> bool:
    """Whether the markup says that this is no part of an article; around: the ids of nodes that an element of a name stands in."""
    if node.tag in DROPPED and not (node.tag == "form" and (id(node) in around["main"] or id(node) in around["article"])):
        return True
    if node.tag == "header" and not in_article:
        return True
    if not node.attributes.strip("/ "):
        return node.tag == "dialog"
    named = node.named()
    if "hidden" in named or UNSEEN.search(named.get("style", "")) or (node.tag == "dialog" and "open" not in named):
        return True
    if node.tag in ("html", "body"):
        return False
    names = f"{named.get('class', '')} {'' if node.tag in HEADINGS else named.get('id', '')}".split()
    away = named.get("role", "").lower() in ROLES or any(_is_frame(x, in_article) for x in names)
    return away and id(node) not in around["main"]


def _is_frame(name: str, in_article: bool) -> bool:
    """Whether a class or id is made of nothing but what sites call their frame, and words of layout."""
    parts = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if x]
    if not any(x in NAMES for x in parts) or not all(x in NAMES or x in LAYOUT or SIZES.fullmatch(x) for x in parts):
        return False
    return not (parts[-1] == "header" and parts[0] in (OWN_INSIDE if in_article else OWN))


def _around(root: Node, tags: tuple[str, ...]) -> dict[str, set[int]]:
    """Per tag the ids of the nodes that an element of it stands in."""
    found: dict[str, set[int]] = {tag: set() for tag in tags}
    for x in reversed(_all(root)):  # what stands inside comes first
        for c in x.children:
            if isinstance(c, Node):
                for tag, ids in found.items():
                    if c.tag == tag or id(c) in ids:
                        ids.add(id(x))
    return found


def _pruned(node: Node) -> None:
    around = _around(node, ("main", "article"))
    work = [(node, False)]
    while work:
        x, inside = work.pop()
        inside = inside or x.tag in ("article", "main")
        x.children = [c for c in x.children if isinstance(c, str) or not _named_away(c, inside, around)]
        work.extend((c, inside) for c in x.children if isinstance(c, Node))


def _size(node: Node) -> int:
    return sum(len(c) - c.count(" ") for x in _all(node) for c in x.children if isinstance(c, str))


def _outermost(region: Node, wanted) -> list[Node]:
    found, work = [], [c for c in reversed(region.children) if isinstance(c, Node)]
    while work:
        x = work.pop()
        if wanted(x):
            found.append(x)
        else:
            work.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return found


def roots(page: str | None) -> list[Node]:
    """The elements of the page that hold its text, without what the markup names away."""
    tree = parse(page or "")
    _pruned(tree)
    mains = [x for x in _outermost(tree, lambda x: x.tag == "main" or x.named().get("role", "").lower() == "main") if _size(x)]
    regions = mains or [tree]
    articles = [a for r in regions for a in _outermost(r, lambda x: x.tag == "article")]
    return articles if articles and 2 * sum(map(_size, articles)) >= sum(map(_size, regions)) else regions


def _placed(node: Node) -> list[tuple]:
    """The children, last first, each element with its place among the block elements: from the start, or below 0 from the end."""
    n, i, out = sum(isinstance(c, Node) and c.tag in BLOCKS for c in node.children), 0, []
    for c in node.children:
        out.append((c, True, i if i < n - 1 - i else i - n))
        i += isinstance(c, Node) and c.tag in BLOCKS
    return out[::-1]


def _place(parent: str, place: int) -> str:
    """The way to an element in an article, of bounded length; nothing outside."""
    return f"{xxhash.xxh64_intdigest(parent)}/{place}" if parent else ""


def cut(page: str | None) -> tuple[list[str], list[int], list[int], list[int]]:
    """The page's blocks in order, the block element (by number, -1: none) that each stands in, and those elements' subtree
    hashes and parents. An element has a smaller number than those inside it; roots have none."""
    texts, owners, hashes, parents, run = [], [], [], [], []
    inside = [-1]  # the elements that are being walked
    places: list[str] = [""]  # of each: where it stands in the article
    parts: list[list[str]] = [[]]  # of each: what its hash is made of

    def flush() -> None:
        if t := SPACE.sub(" ", "".join(run)).strip():
            texts.append(t)
            owners.append(inside[-1])
            parts[-1].append(t)
        run.clear()

    for root in roots(page):
        inside, parts, places = [-1], [[]], ["a" if root.tag == "article" else ""]
        work: list = _placed(root)
        while work:
            x, enter, place = work.pop()
            if isinstance(x, str):
                run.append(x)
            elif not enter:
                flush()
                number, own, at = inside.pop(), parts.pop(), places.pop()
                if own:
                    digest = xxhash.xxh64_intdigest("\x00".join([x.tag, *own])) - 2**63
                    hashes[number] = xxhash.xxh64_intdigest(f"{at}\x00{digest}") - 2**63 if at else digest
                    parts[-1].append(f"<{digest}")
            elif x.tag in BLOCKS:
                flush()
                work.append((x, False, 0))
                work.extend(_placed(x))
                places.append(_place(places[-1], place))
                parents.append(inside[-1])
                inside.append(len(hashes))
                hashes.append(0)
                parts.append([])
            else:
                if x.tag in ("br", "td", "th", "img"):
                    run.append(" ")
                work.extend((c, True, place) for c in reversed(x.children))
        flush()
    return texts, owners, hashes, parents


PARSED = "page long, texts array<string>, owners array<int>, hashes array<long>, parents array<int>"


def _parsed(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for page in pages:
        texts, owners, hashes, parents = cut(page)
        rows.append((xxhash.xxh64_intdigest("\n".join(texts)) - 2**63, texts, owners, hashes, parents))
    return pd.DataFrame(rows, columns=["page", "texts", "owners", "hashes", "parents"])


def assembled(texts, owners, hashes, parents, templates: set[int]) -> str:
    """The blocks that stand in no template."""
    gone = []
    for h, p in zip(hashes, parents, strict=True):
        gone.append(h in templates or (p >= 0 and gone[p]))
    return "\n".join(t for t, o in zip(texts, owners, strict=True) if o < 0 or not gone[o])


def _assembled(parsed: pd.DataFrame, mine: pd.Series, sites: pd.Series) -> pd.Series:
    known = ({*(() if a is None else a), *(() if b is None else b)} for a, b in zip(mine, sites, strict=True))
    return pd.Series([assembled(*row, t) for row, t in zip(zip(parsed["texts"], parsed["owners"], parsed["hashes"], parsed["parents"], strict=True), known, strict=True)], dtype=object)


def templates(parsed: DataFrame) -> DataFrame:
    """(site, templates): the hashes of subtrees on many of a site's different pages; of parsed(site, page, hashes)."""
    own = parsed.where("site IS NOT NULL")
    pages = own.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    # distinct, then counted with sums where the rows are: a host with very many pages is no single task's
    seen = own.select("site", "page", F.explode("hashes").alias("subtree")).where("subtree <> 0").distinct().groupBy("site", "subtree").agg(F.count("*").alias("on")).where(F.col("on") >= MIN_PAGES)
    return seen.join(pages, "site").where(F.col("on") >= SHARE * F.col("pages")).groupBy("site").agg(F.collect_list("subtree").alias("templates"))


def extract(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars in place of html."""
    pages = pages.drop("text", "n_chars")
    rest = pages.drop("html")
    host, section, parsed, a, b = fresh(rest, "host", "section", "parsed", "a", "b")
    address = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)(?:/([^/?#]*)(?=/))?"
    name, first = F.lower(F.regexp_extract("url", address, 1)), F.regexp_extract("url", address, 2)
    places = [F.when(name != "", F.xxhash64(name)).alias(host), F.when(name != "", F.xxhash64(name, first)).alias(section)]
    # written out: texts and hashes serve the counts and the result, and no page is parsed again
    done = materialize(pages.select(*kept(rest), *places, F.pandas_udf(_parsed, PARSED)("html").alias(parsed)), "pages")
    joined = done
    for by, found in ((host, a), (section, b)):
        counted = done.select(F.col(by).alias("site"), f"{parsed}.page", f"{parsed}.hashes")
        known = materialize(templates(counted), "templates").select(F.col("site").alias(by), F.col("templates").alias(found))
        joined = joined.join(maybe_broadcast(known, BROADCAST_SITES), by, "left")
    text = F.pandas_udf(_assembled, "string")(parsed, a, b)
    return joined.select(*kept(rest), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
