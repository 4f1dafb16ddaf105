"""Main text of web pages, with site templates found by counting element subtrees per host.

A page is read into a small element tree.  What its tags, roles and class names
already mark as menu, notice, form and the like goes first.  Then every block
element that is left, of any size and at any place, is hashed with all it holds; one
whose hash recurs on different articles of the host is template and goes too.  Only
hashes are shuffled; pages meet their host's templates only if they may hold one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from negmine.llm.bitset import bitset, may_hold
from negmine.staging import stage

# Element names of HTML by their part in a page, and words by which sites name their page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select textarea input iframe object embed "
    "svg canvas audio video menu dialog map noembed noframes xmp search fieldset datalist".split())
CONTAINERS = frozenset("div section ul ol dl table center figure address details header span".split())
PART_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside footer foot masthead topbar banner cookie "
    "cookies consent gdpr notice notices notification alert popup popover modal overlay ad ads adv advert adverts "
    "advertisement advertisements advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion newsletter subscribe "
    "subscription signup login signin share sharing social sharebar comment comments commentlist disqus respond replies "
    "reply related recommended recommendations widget widgets pagination pager paging skip toolbar copyright "
    "disclaimer hidden".split())
PART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                       "toolbar status".split())
# Words that add nothing to a name of a part, as in "comment-list".
PLAIN_WORDS = frozenset("area bar block body box button buttons container content form group header holder inner item items link links list "
                        "module outer panel post posts section site title wrap wrapper".split())
# Ids of sections are often made of their headings; inside an article only these are no headings.
PART_IDS = frozenset("adbox adsense adslot breadcrumb breadcrumbs commentlist comments disqus masthead navbar respond sharebar sidebar".split())
MAIN_WORDS = frozenset("article content post entry story main".split())

# From so many words on a text does not recur by chance.
CHANCE_WORDS = 5

_CLOSES = {  # an opening tag ends an open element of these names, up to the next of the bounds
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
}
_ENDS_P = BLOCK - {"body", "html", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "option", "legend"}
_P_BOUNDS = frozenset("td th table button div article section main aside li blockquote body html header footer nav form".split())
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "attributes", "parts", "parent")

    def __init__(self, name: str, attributes: str, parent: Node | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.parts: list[Node | str] = []

    def named(self) -> dict[str, str]:
        return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attributes)}

    def nodes(self) -> Iterator[Node]:
        """All elements below, in page order."""
        stack = [iter(self.parts)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Node):
                    yield x
                    stack.append(iter(x.parts))
                    break
            else:
                stack.pop()


def parse(page: str) -> Node:
    """The element tree of a page; unclosed and stray tags are taken as browsers mostly do."""
    root = at = Node("#page", "", None)
    place, end = 0, len(page)
    while place < end:
        m = _TOKEN.search(page, place)
        if m is None:
            at.parts.append(page[place:])
            break
        if m.start() > place:
            at.parts.append(page[place:m.start()])
        place = m.end()
        name = m[2]
        if name is None:
            continue  # a comment or declaration
        name = name.lower()
        if m[1]:
            at = _close(at, name)
            continue
        if name in _ENDS_P:
            at = _end_open(at, {"p"}, _P_BOUNDS)
        if name in _CLOSES:
            at = _end_open(at, *_CLOSES[name])
        node = Node(name, m[3], at)
        at.parts.append(node)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, place)
            stop = close.start() if close else end
            node.parts.append(page[place:stop])
            gt = page.find(">", stop)
            place = end if gt < 0 or not close else gt + 1
        elif name not in VOID and not m[3].endswith("/") or name in BLOCK and name != "hr":
            at = node
    return root


def _close(at: Node, name: str) -> Node:
    node = at
    while node.parent is not None:
        if node.name == name:
            return node.parent
        if node.name in ("article", "main", "body", "table", "td") and name not in BLOCK:
            return at  # an inline end tag does not end what holds it
        node = node.parent
    return at


def _end_open(at: Node, names, bounds) -> Node:
    node = at
    while node.parent is not None and node.name not in bounds:
        if node.name in names:
            return node.parent
        node = node.parent
    return at


def _part_words(value: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(value)}


def _known_name(value: str, words: frozenset[str] = PART_WORDS) -> bool:
    """Whether a class or id is as a whole the name of a page part, and not a slug in which such a word stands."""
    found = {w.lower() for w in re.findall(r"[A-Z]?[^\W\dA-Z_]+|[A-Z]+", value)}
    return bool(found & words) and found <= words | PLAIN_WORDS


def is_page_part(node: Node, in_article: bool) -> bool:
    """Whether tag, role or class names say that this is no article text.

    Inside an article only containers are judged by name, and only by whole known names.  An id of a heading,
    paragraph or list item never counts, and of other elements only if all of it is a known name.
    """
    if node.name in DROPPED:
        return True
    if node.name == "header":
        return not in_article
    if not node.attributes or node.name in ("html", "body", "main", "#page"):
        return False
    named = node.named()
    if "hidden" in named or named.get("aria-hidden") == "true" or named.get("role", "").lower() in PART_ROLES:
        return True
    if "display:none" in named.get("style", "").replace(" ", "").lower():
        return True
    classes, ids = (named.get(key, "").split() for key in ("class", "id"))
    if node.name in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li"):
        ids = []
    if in_article:
        if node.name not in CONTAINERS and node.name != "article":
            return False
        classes, ids = [w for w in classes if _known_name(w)], [w for w in ids if _known_name(w, PART_IDS)]
    else:
        ids = [w for w in ids if _known_name(w)]
    # a name may say both, as in "post has-comments"; what holds the article is no part
    words = classes + ids
    plain = set().union(*(_part_words(w) for w in words if not re.match(r"(has|no|with|without|is)[-_]", w))) if words else set()
    return bool(plain & PART_WORDS) and not (plain & {"article", "post", "entry", "story"} and not plain & {
        "comment", "comments", "related", "ad", "ads", "nav", "navigation", "footer", "share", "sidebar", "promo"})


def clean(root: Node) -> None:
    """Take out what is marked as no article text, unless the article is inside it."""
    whole = size(root)

    def holds_article(node: Node) -> bool:
        own = None
        for x in node.nodes():
            if x.name in ("article", "main") and not _marked(x):
                return True
            # the part of a layout that is named as content and holds most of it
            if x.name in ("div", "section", "td") and x.attributes and _part_words(" ".join(x.named().get(k, "") for k in ("class", "id"))) & MAIN_WORDS and not _marked(x):
                own = size(node) if own is None else own
                if 0 < own < 2 * size(x):
                    return True
        # whole pages stand in one form where servers keep their state in it
        return node.name == "form" and 2 * size(node) > whole

    stack = [(root, False)]
    while stack:
        node, in_article = stack.pop()
        inside = in_article or node.name in ("article", "main") or (
            node.name in CONTAINERS and bool(node.attributes) and "articlebody" in node.attributes.lower())
        kept = []
        for x in node.parts:
            if isinstance(x, Node):
                if is_page_part(x, inside) and (inside or x.name in DROPPED and x.name != "form" or not holds_article(x)):
                    kept.append(" " if x.name not in BLOCK else Node("p", "", node))
                    continue
                stack.append((x, inside))
            kept.append(x)
        node.parts = kept


def _marked(node: Node) -> bool:
    named = node.named() if node.attributes else {}
    return bool(_part_words(named.get("class", "") + " " + named.get("id", "")) & PART_WORDS)


def size(node: Node) -> int:
    return sum(len(x.strip()) for n in [node, *node.nodes()] for x in n.parts if isinstance(x, str))


def main_root(root: Node) -> Node:
    """The element that holds the article: article, main, a container named so, or the page."""
    nodes = list(root.nodes())
    articles = [n for n in nodes if n.name == "article"]
    mains = [n for n in nodes if n.name == "main" or "role" in n.attributes and n.named().get("role", "").lower() == "main"]
    if mains:
        best = max(mains, key=size)
        inner = [a for a in articles if _under(a, best)]
        if len(inner) == 1 and size(inner[0]) > 0:
            return inner[0]
        return best
    tops = [a for a in articles if not any(_under(a, b) for b in articles if b is not a)]
    if tops:
        return max(tops, key=size)
    named = [n for n in nodes if n.name in ("div", "section", "td") and n.attributes
             and _part_words(" ".join(n.named().get(k, "") for k in ("class", "id", "itemprop"))) & MAIN_WORDS]
    if named:
        best = max(named, key=size)
        if 2 * size(best) > size(root):
            return best
    return root


def _under(node: Node, above: Node) -> bool:
    while node is not None:
        if node is above:
            return True
        node = node.parent
    return False


def read_blocks(article: Node) -> tuple[list[str], list[tuple[int, int, int, bool, bool]]]:
    """Text by blocks, and the block elements that hold any: hash, first block, block after the last, mostly links, container.

    References are decoded and white space is evened out.  The hash is of names and text of all that the element holds.
    """
    blocks: list[str] = []
    line: list[str] = []
    parts: list[tuple[int, int, int, bool, bool]] = []

    def flush():
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            blocks.append(text)

    # an open element: its node, what is left of it, first block, hashes of its parts, characters of text and of links
    frames = [[article, iter(article.parts), 0, [], 0, 0]]
    while frames:
        frame = frames[-1]
        x = next(frame[1], None)
        if isinstance(x, str):
            line.append(entities.unescape(x))
            plain = _SPACE.sub(" ", x).strip()
            if plain:
                frame[3].append(plain.encode("utf-8", "surrogatepass"))
                frame[4] += len(plain)
        elif x is not None and x.name == "br":
            line.append(" ")
            frame[3].append(b"<br>")
        elif x is not None:
            if x.name in BLOCK:
                flush()
            frames.append([x, iter(x.parts), len(blocks), [], 0, 0])
        else:
            node, _, first, held, size, links = frames.pop()
            if node.name in BLOCK or node is article:
                flush()
            if node.name == "a":
                links = size
            digest = xxhash.xxh3_64(b"<" + node.name.encode("utf-8", "surrogatepass") + b">")
            for h in held:
                digest.update(len(h).to_bytes(8, "little") + h)
            if frames:
                above = frames[-1]
                above[3].append(b"\0" + digest.digest())
                above[4] += size
                above[5] += links
                if node.name in BLOCK and len(blocks) > first:
                    parts.append((digest.intdigest() - (1 << 63), first, len(blocks), 2 * links > size, node.name in CONTAINERS))
    return blocks, parts


def suspects(article: Node, blocks: list[str], parts: list[tuple[int, int, int, bool, bool]]) -> list[tuple[int, int, int, int]]:
    """(hash, article, first block, block after the last) of the elements that are template if they recur.

    The article is told by the three longest blocks outside the element, so copies of an article, exact or near, are one
    article.  Few words recur by chance: texts of less than ``CHANCE_WORDS`` words count only in containers, and inside
    an element that is marked as article only if they are mostly links.
    """
    sure, out = article.name in ("article", "main"), []
    ranked = sorted(range(len(blocks)), key=lambda i: (-len(blocks[i]), i))
    known: dict[tuple[int, ...], int] = {}
    for h, first, end, links, container in parts:
        few = sum(len(blocks[i].split(" ", CHANCE_WORDS)) for i in range(first, min(end, first + CHANCE_WORDS))) < CHANCE_WORDS
        if few and not (container and (links or not sure)):
            continue
        outside = []
        for i in ranked:
            if not first <= i < end:
                outside.append(i)
                if len(outside) == 3:
                    break
        if outside:
            key = tuple(outside)
            if key not in known:
                known[key] = xxhash.xxh3_64_intdigest("\n".join(blocks[i] for i in key).encode("utf-8", "surrogatepass")) - (1 << 63)
            out.append((h, known[key], first, end))
    return out


def block_text(node: Node) -> str:
    """Text by blocks: references decoded, white space evened out, blocks joined by a line feed."""
    return "\n".join(read_blocks(node)[0])


def packed(blocks: list[str]) -> tuple[bytes, int]:
    """Blocks as they are staged and shuffled: compressed, with the bytes of their text.  No block holds a line feed."""
    text = "\n".join(blocks).encode("utf-8")
    return pa.compress(text, codec="zstd", asbytes=True), len(text)


def unpacked(data: pa.BinaryScalar, n_bytes: int) -> str:
    return pa.decompress(data.as_buffer(), decompressed_size=n_bytes, codec="zstd", asbytes=True).decode("utf-8") if n_bytes else ""


def read_page(page: str) -> tuple[Node, Node]:
    tree = parse(page)
    clean(tree)
    return tree, main_root(tree)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_pages: int = 5) -> DataFrame:
    """Per page: id, url, ``text`` of the article and its length ``n_chars`` in code points.

    A block element is template if it recurs on at least ``min_pages`` different articles of the host, however many
    the host has; copies of one article count once.  A null or empty page has an empty text; a null url is
    a host of its own without a name.  Repeated rows give repeated results; other columns are not read.
    """
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"))

    schema = (f"_id {kind}, _url {url_kind}, packed binary, n_bytes long, host string, subtrees array<long>, articles array<long>, "
              "firsts array<int>, ends array<int>")
    types = {"packed": pa.binary(), "n_bytes": pa.int64(), "host": pa.string(), "subtrees": pa.list_(pa.int64()), "articles": pa.list_(pa.int64()),
             "firsts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in types}
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2)):
                _, article = read_page(page.as_py() or "")
                blocks, parts = read_blocks(article)
                host = host_of(url)
                # the name of a subtree holds the host
                salt = xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass")) - (1 << 63)
                found = [(h ^ salt, *rest) for h, *rest in suspects(article, blocks, parts)]
                data, n_bytes = packed(blocks)
                out["packed"].append(data)
                out["n_bytes"].append(n_bytes)
                out["host"].append(host)
                for k, name in enumerate(("subtrees", "articles", "firsts", "ends")):
                    out[name].append([x[k] for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, types[k]) for k, v in out.items())],
                                             names=["_id", "_url", *out])

    looked = stage(rows.mapInArrow(first, schema).withColumn("_row", F.monotonically_increasing_id()), "pages")
    seen = (looked.select("host", F.explode(F.arrays_zip("subtrees", "articles")).alias("x"))
            .select("host", F.col("x.subtrees").alias("subtree"), F.col("x.articles").alias("article")).distinct())
    templates = stage(seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= int(min_pages))
                      .select("host", "subtree"), "subtrees")
    known = pages.sparkSession.sparkContext.broadcast(bitset(templates, "subtree"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, subtree) of all subtrees that may be templates."""
        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().fill_null(0).to_numpy())
            subtree = lists.flatten().to_numpy()
            hit = may_hold(known.value, subtree)
            yield pa.RecordBatch.from_arrays([pa.array(row[hit]), pa.array(subtree[hit])], names=["_row", "subtree"])

    # a page meets only the templates among its own subtrees, whose names hold the host; one on very many pages is split by AQE
    own = (looked.select("_row", "subtrees").mapInArrow(asked, "_row long, subtree long").join(templates.select("subtree").distinct(), "subtree", "left_semi")
           .groupBy("_row").agg(F.collect_set("subtree").alias("templates")))

    def looks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row in the batch of every subtree, which of them may be templates, and which rows may hold one."""
        lists = batch.column("subtrees")
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        may = may_hold(known.value, lists.flatten().to_numpy())
        hit = np.zeros(len(lists), dtype=bool)
        hit[row[may]] = True
        return row, may, hit

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of the pages without a template."""
        for batch in batches:
            batch = batch.filter(pa.array(~looks(batch)[2]))
            texts = [unpacked(data, n) for data, n in zip(batch.column("packed"), batch.column("n_bytes").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], names=["_id", "_url", "text"])

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other pages, packed, with those of their subtrees that may be templates."""
        for batch in batches:
            row, may, hit = looks(batch)
            cuts = np.r_[0, np.cumsum(np.bincount(row[may], minlength=len(batch))[hit])].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), batch.column(k).flatten().filter(pa.array(may))) for k in ("subtrees", "firsts", "ends")]
            batch = batch.filter(pa.array(hit))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("_id", "_url", "_row", "packed", "n_bytes")] + lists,
                                             names=["_id", "_url", "_row", "packed", "n_bytes", "subtrees", "firsts", "ends"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            lists = (batch.column(k).to_pylist() for k in ("n_bytes", "subtrees", "firsts", "ends", "templates"))
            for data, n, subtrees, firsts, ends, templates in zip(batch.column("packed"), *lists):
                templates, text = set(templates or ()), unpacked(data, n)
                gone = {i for h, a, z in zip(subtrees, firsts, ends) if h in templates for i in range(a, z)}
                texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], names=["_id", "_url", "text"])

    texts = f"_id {kind}, _url {url_kind}, text string"
    done = looked.select("_id", "_url", "packed", "n_bytes", "subtrees").mapInArrow(plain, texts)
    doubted = (looked.mapInArrow(doubtful, f"_id {kind}, _url {url_kind}, _row long, packed binary, n_bytes long, "
                                           "subtrees array<long>, firsts array<int>, ends array<int>")
               .join(own, "_row", "left").select("_id", "_url", "packed", "n_bytes", "subtrees", "firsts", "ends", "templates")
               .mapInArrow(second, texts))
    return done.unionByName(doubted).select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text",
                                            F.length("text").cast("long").alias("n_chars"))
