"""Main text of web pages: site template removal.

Pages become trees. Every element with text gets a hash of its whole subtree; Spark counts, for each host, on how many of its
different pages a subtree occurs, and subtrees that recur on many of them are the site's template. A menu, an advert or a footer
has other words on each page, so there is a second hash, of an element's place and shape: tags, classes and where links and
texts are, runs of equal parts as one. A shape counts only beside the way that leads down to most of a page's text (on the
host's pages), never on it or below it. Pages whose articles are copies or near copies of each other have one vote together. A
second pass deletes what recurs and then chooses the article, along with elements that are no article by their tag, class or role (menus, adverts, forms, notices, comments ...) unless they hold
most of the text, takes the article if the page marks one, and joins its blocks.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import wordhash
from hearthline.llm.common import map_arrow, stored


#: Hosts with more than 1 / HEAVY of all pages are treated one by one.
HEAVY = 1024
#: Words of a shingle by which near copies are known.
VOTE_WORDS = 5


@dataclass(frozen=True)
class Settings:
    """A subtree is template if it is on ``least_pages`` different pages of a host and on ``least_share`` of all of them."""

    least_pages: int = 5
    least_share: float = 0.5
    link_share: float = 0.6
    least_links: int = 3


# Fixed values of HTML and of common page markup.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
_DROP = set("button canvas datalist head input label select svg template audio video math".split()) | _RAW
#: Dropped unless they hold most of the text: some sites wrap a whole page in a form.
_SOFT = set("aside dialog footer form menu nav object".split())
_WORDS = set(
    "ad ads adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus donate footer login menu modal nav navbar navigation newsletter notice overlay paywall pagination pager popup promo promoted "
    "promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that, with one of the above, make up a class such as site-footer or related-posts; has-sidebar or cookie-free is none.
_BESIDE = set(
    "area article articles bar block bottom box btn button buttons container content entry form global group header icon icons inner item items "
    "left link links list main media outer page panel post posts primary right row secondary section site slot stories top unit wp wrap wrapper".split()
)
_WHOLE = {"#root", "html", "body"}
_HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Site headers; an article's own header holds its title.
_HEADS = set("header masthead topbar".split())
#: An open element that a new one ends, up to the nearest of its bounds.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements whose shape may be a template's, if they are of the first kind, have a class or id, or hold links.
_PARTS = set("aside dialog footer form header menu nav".split())
_HOLDERS = _PARTS | set("article body center details div dl fieldset html main ol section table tbody td tr ul #root".split())
_SCOPE = {"td", "th", "table", "article", "body", "html", "button", "object", "caption"}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
#: One attribute after the other, so that nothing is found inside a value.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?|"[^"]*+"|'[^']*+'""", re.S)
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Node:
    tag: str
    marks: str = ""
    #: Strings and nodes in page order.
    inside: list = field(default_factory=list)
    key: int = 0
    #: Hash of tags, classes and the places of links and texts.
    shape: int = 0
    #: Hidden, and named as no part of an article.
    dropped: bool = False
    aside: bool = False
    main: bool = False
    #: Length of the text in it, of that outside of named or dropped elements, of that in links, and the number of links.
    size: int = 0
    plain: int = 0
    linked: int = 0
    links: int = 0


def parse(page: str) -> Node:
    """Tree of a page. Unclosed and stray tags are mended as browsers do for the common cases; depth costs no recursion."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            _text(stack, page[at:])
            break
        if m.start() > at:
            _text(stack, page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].inside.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1] or m[4]:
            _close(stack, tag)
            continue
        _make_room(stack, tag)
        node = Node(tag)
        extra = m[3] if m[2] else m[6]
        if extra and extra != "/":
            _read_marks(node, extra)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack[-1].inside.append(node)
        if tag not in _VOID and not (extra or "").endswith("/") or tag in _BLOCK and tag not in _VOID:
            stack.append(node)
    while len(stack) > 1:
        _finish(stack.pop(), stack[-1])
    return root


def _text(stack: list[Node], raw: str) -> None:
    stack[-1].inside.append(entities.unescape(raw) if "&" in raw else raw)


def _close(stack: list[Node], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            while len(stack) > k:
                _finish(stack.pop(), stack[-1])
            return
        if stack[k].tag in _BLOCK and tag not in _BLOCK or tag == "p" and stack[k].tag in _SCOPE:
            return


def _make_room(stack: list[Node], tag: str) -> None:
    if tag in _BLOCK:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                while len(stack) > k:
                    _finish(stack.pop(), stack[-1])
                break
            if stack[k].tag in _SCOPE or stack[k].tag in _BLOCK:
                break
    ends, bounds = _ENDS.get(tag, ((), ()))
    if ends:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in bounds:
                break
            if stack[k].tag in ends:
                while len(stack) > k:
                    _finish(stack.pop(), stack[-1])


def _read_marks(node: Node, extra: str) -> None:
    seen: set[str] = set()
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(extra):
        name, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in seen:
            continue  # the first one counts
        seen.add(name)
        if name in ("class", "id"):
            node.marks += value + " "
            # the id of a heading or section is made of its title
            if node.tag not in ("html", "body", "article", "main") and (name == "class" or node.tag != "section" and node.tag not in _HEADINGS):
                tokens = value.split()
                node.aside |= any(_names_aside(x) for x in tokens)
                words.update(tokens)
        elif name == "role":
            node.aside |= value in _ROLES
            node.main |= value in ("main", "article")
        elif name == "itemprop":
            node.main |= value == "articlebody"
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            node.dropped = True
    if any(w in _HEADS or (parts := set(_SPLIT.split(w))) & _HEADS and parts <= _HEADS | _BESIDE for w in words):
        node.marks += "#head"


@lru_cache(1 << 14)
def _names_aside(token: str) -> bool:
    """Whether a class or id says that an element is no article: all its words must belong to such a name."""
    parts = [x for x in _SPLIT.split(token) if x and not x[0].isdigit()]
    return any(x in _WORDS for x in parts) and all(x in _WORDS or x in _BESIDE for x in parts)


def _finish(node: Node, parent: Node) -> None:
    """Key of a closed element's subtree: tag, class and id, and what is in it, with white space made even."""
    parts = [node.tag, node.marks]
    for x in node.inside:
        if isinstance(x, str):
            even = " ".join(x.split())
            node.size += len(even)
            node.plain += len(even)
            parts.append(even)
        else:
            parts.append(str(x.key))
    if node.tag == "a":
        node.links += 1
        node.linked = node.size
    if node.tag in _BLOCK or node.tag == "a":
        shapes = [x.shape if not isinstance(x, str) else -1 if x.strip() else 0 for x in node.inside]
        shapes = [x for x in shapes if x]
        runs = [x for k, x in enumerate(shapes) if not k or x != shapes[k - 1]]
        node.shape = xxhash.xxh3_64_intdigest(f"{node.tag}\x1f{_even_marks(node.marks)}\x1f{runs}".encode("utf-8", "surrogatepass")) | 1
    else:
        node.shape = -1 if node.size else 0  # text, marked up or not
    node.key = xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))
    parent.size += node.size
    if not (node.dropped or node.aside or node.tag in _DROP or node.tag in _SOFT):
        parent.plain += node.plain
    parent.linked += node.linked
    parent.links += node.links


def walk(root: Node) -> Iterator[Node]:
    waiting = [root]
    while waiting:
        node = waiting.pop()
        yield node
        waiting.extend(x for x in node.inside if not isinstance(x, str))


def subtree_keys(root: Node) -> set[int]:
    """Keys of the block elements with text, as signed 64-bit numbers; the page as a whole is none."""
    return {_signed(x.key) for x in walk(root) if x.size and x.tag in _BLOCK and x.tag not in _WHOLE}


@lru_cache(1 << 14)
def _even_marks(marks: str) -> str:
    """Classes and ids without their numbers: post-12 and post-13 are one."""
    return re.sub(r"\d+", "0", marks.strip())


def _address(above: int, node: Node) -> int:
    return xxhash.xxh3_64_intdigest(f"{above}\x1f{node.tag}\x1f{_even_marks(node.marks)}")


def _shape_key(address: int, node: Node) -> int:
    return _signed(xxhash.xxh3_64_intdigest(f"{address}\x1e{node.shape}"))


def _may_be_part(x: Node) -> bool:
    return x.size > 0 and x.tag in _HOLDERS and x.tag not in _WHOLE and (x.tag in _PARTS or bool(x.marks) or x.links > 0)


def shape_keys(root: Node) -> tuple[set[int], set[int], set[int]]:
    """(shapes, places, ways) of a page: shapes with their place beside the way down to most of its text, places of all elements
    that hold others, and those of them that hold at least half of the text."""
    shapes, sizes = set(), {}
    waiting = [(root, _address(0, root), True)]
    while waiting:
        node, address, on_way = waiting.pop()
        sizes[_signed(address)] = sizes.get(_signed(address), 0) + node.size
        for x in node.inside:
            if not isinstance(x, str) and x.size and x.tag in _HOLDERS:
                own = _address(address, x)
                way = on_way and 2 * x.size >= root.size
                if on_way and not way and _may_be_part(x):
                    shapes.add(_shape_key(own, x))
                waiting.append((x, own, way))
    return shapes, set(sizes), {a for a, n in sizes.items() if 2 * n >= root.size > 0}


def drop_shapes(root: Node, template: set[int], way: set[int]) -> int:
    """Mark the elements whose shape is template as dropped, beside the host's way to the text; how many there are.

    The children of the last element on the way are the text and stay.
    """
    found = 0
    node, address, above = root, _address(0, root), []
    while True:
        children = [(x, _address(address, x)) for x in node.inside if not isinstance(x, str) and x.size and x.tag in _HOLDERS]
        following = [(x, a) for x, a in children if _signed(a) in way]
        if not following:
            return found
        above.append(node)
        for x, a in children:
            if _signed(a) not in way and _may_be_part(x) and _shape_key(a, x) in template:
                x.dropped = True
                found += 1
                lost = 0 if x.aside or x.tag in _DROP or x.tag in _SOFT else x.plain
                for y in above:
                    y.size, y.plain, y.linked, y.links = y.size - x.size, y.plain - lost, y.linked - x.linked, y.links - x.links
        node, address = max(following, key=lambda f: f[0].size)


def voter(root: Node) -> tuple[str, bool]:
    """The text that a page's vote is made of, and whether it is that of a marked article."""
    start = _article(root)
    return _blocks(start, set(), Settings()), start.tag not in _WHOLE


def votes(voters: list[tuple[str, bool]]) -> list[int]:
    """A number for each page, which copies share.

    The least shingle of a marked article's text, which near copies share as well but for a few; without a mark the text
    of the whole page, since template and near copies cannot be told apart there.
    """
    least = wordhash.shingle_sets([text if marked else None for text, marked in voters], VOTE_WORDS)
    return [
        _signed(int(own[0])) if len(own) else _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
        for own, (text, _) in zip(least, voters)
    ]


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def main_text(page: str, template: set[int], s: Settings = Settings(), copies: bool = False, way: set[int] | frozenset[int] = frozenset()) -> str:
    """Text of the article, blocks joined by line ends. A page all of which is template keeps its text.

    Shapes beside the ``way`` are deleted before the article is chosen. On a host that consists of ``copies``, what recurs may be
    the article: a marked one most of which is template stays whole.
    """
    root = parse(page)
    if way and drop_shapes(root, template, way) and not root.size:
        root = parse(page)
    start = _article(root)
    text = _blocks(start, template, s)
    if not template or text and not (copies and start.tag not in _WHOLE):
        return text
    everything = _blocks(start, set(), s)
    return text if 2 * len(text) >= len(everything) else everything


def _article(root: Node) -> Node:
    """The largest of the elements marked as article, or as main part if that holds over twice as much, else everything.

    Elements inside of others that are named as no article count only where there are no others.
    """
    inner, outer = ([], []), ([], [])
    waiting = [(root, outer)]
    while waiting:
        node, found = waiting.pop()
        if node.dropped or node.tag in _DROP:
            continue
        if node.aside or node.tag in _SOFT:
            found = inner
        articles, mains = found
        if node.size and (node.tag in ("article", "main") or node.main):
            (mains if node.tag == "main" else articles).append(node)
            if node.tag == "article":
                continue
        waiting.extend((x, found) for x in node.inside if not isinstance(x, str))
    for articles, mains in (outer, inner):
        article, main = (max(x, key=lambda n: (n.plain, n.size), default=None) for x in (articles, mains))
        if article and main:
            return article if 2 * article.plain >= main.plain else main
        if article or main:
            return article or main
    return root


def _blocks(start: Node, template: set[int], s: Settings) -> str:
    whole = start.tag in _WHOLE
    blocks: list[str] = []
    current: list[str] = []

    def end() -> None:
        text = " ".join("".join(current).split())
        if text:
            blocks.append(text)
        current.clear()

    waiting: list = [start]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            current.append(x)
        elif x is None:
            end()
        else:
            block = x.tag in _BLOCK
            if block:
                end()
            elif x.tag in ("br", "td", "th"):
                current.append(" ")
            if x is not start and _removed(x, start, block, whole, template, s):
                continue
            if block:
                waiting.append(None)
            waiting.extend(reversed(x.inside))
    end()
    return "\n".join(blocks)


def _removed(x: Node, start: Node, block: bool, whole: bool, template: set[int], s: Settings) -> bool:
    if x.dropped or x.tag in _DROP:
        return True
    if (x.aside or x.tag in _SOFT or whole and (x.tag == "header" or x.marks.endswith("#head"))) and 2 * x.size <= start.size:
        return True
    if block and template and x.size and _signed(x.key) in template:
        return True
    # outside a marked article, a block that is mostly links is a menu
    return whole and block and x.tag not in ("body", "html", "main") and x.links >= s.least_links and x.linked > s.link_share * x.size


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def site_templates(pages: DataFrame, s: Settings = Settings(), url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, keys, copies, way): subtrees and shapes that recur on many different pages of each host, whether most of its pages
    are copies, and the places that hold most of the text where they occur.

    Counted by (host, key, vote) and then by (host, key), so a large host is spread, and combined before each shuffle. A host's
    keys are few: all of them are on a share of its different pages, so there are at most 1 / share times as many as a page has
    elements on average. Hosts without such a key have no row; null urls are host ''; an empty table gives no rows.
    """
    rows = pages.select(host_of(F.col(url_column)).alias("host"), F.col(html_column).cast("string").alias("html"))

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        hosts, keys, most, counts, voters = [], [], [], [], []
        for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            root = parse(page or "")
            shapes, places, ways = shape_keys(root)
            found = subtree_keys(root) | shapes
            voters.append(voter(root))
            counts.append(len(found) + len(places) + 1)
            hosts.extend([host] * counts[-1])
            keys.append(None)  # the page itself
            most.append(None)
            keys.extend(found)
            most.extend([None] * len(found))
            keys.extend(places)
            most.extend(int(p in ways) for p in places)
        own = np.repeat(np.array(votes(voters), dtype=np.int64), counts)
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(own), pa.array(most, pa.int32())], ["host", "key", "vote", "most"])

    single = map_arrow(rows, batch, "host string, key bigint, vote bigint, most int").groupBy("host", "key", "vote").agg(F.count("*").alias("n"), F.max("most").alias("most"))
    counted = single.groupBy("host", "key").agg(F.count("*").alias("n"), F.sum("n").alias("pages"), F.sum("most").alias("most"))
    kept = stored(counted.where((F.col("n") >= s.least_pages) & (F.col("most").isNull() | (F.col("most") > 0)) | F.col("key").isNull()), "recurring")
    sizes = kept.where("key IS NULL").select(F.col("host").alias("of"), F.col("n").alias("different"), F.col("pages").alias("all"))
    named = kept.where("key IS NOT NULL").join(sizes, F.col("host") == F.col("of"))
    often = named.where(F.when(F.col("most").isNull(), F.col("n") >= s.least_share * F.col("different")).otherwise(2 * F.col("most") >= F.col("n")))
    return often.groupBy("host").agg(
        F.collect_set(F.when(F.col("most").isNull(), F.col("key"))).alias("keys"),
        F.first(2 * F.col("different") < F.col("all")).alias("copies"),
        F.collect_set(F.when(F.col("most").isNotNull(), F.col("key"))).alias("way"),
    )


def extract(
    pages: DataFrame, settings: Settings = Settings(), id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """(page_id, url, host, text, n_chars) of every page. Null or empty html gives an empty text; a null URL is host ''."""
    templates = site_templates(pages, settings, url_column, html_column)
    rows = pages.select(
        F.col(id_column).cast("bigint").alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        host_of(F.col(url_column)).alias("host"),
        F.col(html_column).cast("string").alias("html"),
    )
    named = templates.withColumnRenamed("host", "of")
    # a host with more than one page in HEAVY is one of HEAVY at most: their keys are broadcast and their pages stay where
    # they are; no other host is large enough to be a burden to one task of a join
    total = pages.count()
    sizes = rows.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") * HEAVY > total).select(F.col("host").alias("big"))
    heavy = stored(sizes.join(named, F.col("big") == F.col("of"), "left").select("big", "keys", "copies", "way"), "heavy-hosts")
    columns = ["page_id", "url", "host", "html", "keys", "copies", "way"]
    large = rows.join(F.broadcast(heavy), F.col("host") == F.col("big")).select(*columns)
    small = rows.join(F.broadcast(heavy.select("big")), F.col("host") == F.col("big"), "left_anti")
    light = named.join(F.broadcast(heavy.select("big")), F.col("of") == F.col("big"), "left_anti")
    joined = large.unionByName(small.join(light, F.col("host") == F.col("of"), "left").select(*columns))

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        html, keys, copies, ways = (part.column(k).to_pylist() for k in (3, 4, 5, 6))
        texts = [main_text(page, set(own or ()), settings, bool(same), set(way or ())) if page else "" for page, own, same, way in zip(html, keys, copies, ways)]
        columns = [*part.columns[:3], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "text", "n_chars"])

    return map_arrow(joined, batch, "page_id bigint, url string, host string, text string, n_chars bigint")
