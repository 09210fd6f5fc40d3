"""Main-text extraction by wrapper induction over the pages of a host.

1. Each page's DOM becomes a tree in which same-label siblings of one parent are
   one node (a list slot); its text blocks hang on nodes. What a page passes on is
   its tree and, for each block, slot and text hash - no text.
2. A host's most common tree is its reference. Every page's tree is aligned with
   it by simple tree matching; a block counts for the slot its node is aligned
   with. Counts are taken over pages of different content (copies of an article
   are one page), by partial sums, so a host that holds a third of all pages is no
   single task. The hosts of a site (the last two labels) count together as well,
   for hosts whose own pages are too few to tell.
3. Constant nodes are template: a text that fills an aligned slot on half of the
   pages that have the slot, and on SUPPORT pages at least. So are slots that are
   filled from a stock, where half of what they hold or more stands on several
   pages (menus, adverts, notices). Slots that vary are content.
4. Each page is read again with its host's wrapper, which decides first. What it has
   no word on goes by its markup (menus and the like); where the page marks an article
   the rest outside of it goes, else link lists. ``removals`` counts what each rule took.
"""

from __future__ import annotations

import html as html_codes
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import discard, fresh, stored
from factloom.llm.url_filter import host_of

#: Different pages that must share a text in a slot, and their share of the pages that have the slot.
SUPPORT, SHARE = 4, 0.5
#: Different pages a slot must be on to be told stock from content; pages from which a text counts as stock.
LEAST_PAGES, STOCK = 8, 2
#: Words from which a block counts as content when pages are told apart.
LONG = 12

#: HTML's element kinds, and names that mark what is not article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br img wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
CLOSES_P = frozenset("address article aside blockquote details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table article main section body html div".split())
NEVER = frozenset("head nav footer aside form button select option datalist dialog menu object canvas svg audio video".split())
#: Short texts that recur in articles too: their slots are template only where they are constant.
RECURRING = frozenset("h1 h2 h3 h4 h5 h6 td th dt figcaption caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|popups?|modals?|overlay|newsletter|subscribe|subscription|"
    r"comments?|commentlist|disqus|repl(?:y|ies)|respond|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footer|shar(?:e|ing)|widgets?|toolbar|pagination|pager|login|signup|skip)(?:$|[\s_-])",
    re.I,
)
#: Names that text of an article may have too: inside an article they mean nothing for prose that varies.
WEAK_NAMES = re.compile(r"(?:^|[\s_-])(?:notices?|notifications?|alerts?|discussion|related|recommend(?:ed|ations?)?|social)(?:$|[\s_-])", re.I)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
# Possessive throughout, and a quote opens a value only behind an equals sign: a tag that never ends is given up after one pass.
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
NAME = re.compile(r"[a-zA-Z]")
DIGITS = re.compile(r"[0-9]+")

SIGN = 1 << 63


def text_hash(text: str, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - SIGN


@lru_cache(maxsize=20_000)
def _start(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """(label, whether its text is dropped, whether an article's prose is spared, whether it holds the article, whether only outside an article it is dropped)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    role = found.get("role", "").lower()
    label = tag + (f".{DIGITS.sub('#', names.split()[0])}" if names else "")
    drop = tag in NEVER or role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    article = tag in ("article", "main") or role in ("main", "article")
    named = bool(names) and not article and tag not in ("html", "body")
    drop = drop or (named and NAMES.search(names) is not None)
    weak = named and not drop and WEAK_NAMES.search(names) is not None
    outside = tag == "header" or (named and HEADER_NAMES.search(names) is not None)
    return label, drop, weak, article, outside


class Block:
    """A run of text: its slot, words, and what its place says of it."""

    __slots__ = ("slot", "text", "drop", "weak", "article", "links", "recurring")

    def __init__(self, slot: int, text: str, drop: bool, weak: bool, article: bool, links: float, recurring: bool):
        self.slot, self.text, self.drop, self.weak, self.article, self.links, self.recurring = slot, text, drop, weak, article, links, recurring


class Open:
    """An open element, with what holds for all that is in it."""

    __slots__ = ("tag", "inline", "node", "drop", "weak", "article", "link")

    def __init__(self, tag: str, inline: bool, node: int, drop: bool, weak: bool, article: bool, link: bool):
        self.tag, self.inline, self.node, self.drop, self.weak, self.article, self.link = tag, inline, node, drop, weak, article, link


class Tree:
    """Nodes by number, parents before children; same-label siblings are one node. A node's slot is a hash of the labels from the root to it."""

    __slots__ = ("parents", "labels", "slots", "_of")

    def __init__(self):
        self.parents, self.labels, self.slots, self._of = [-1], [""], [0], {}

    def child(self, parent: int, label: str) -> int:
        key = (parent, label)
        node = self._of.get(key)
        if node is None:
            node = self._of[key] = len(self.labels)
            self.parents.append(parent)
            self.labels.append(label)
            self.slots.append(text_hash(label, self.slots[parent] + SIGN if parent else 0))
        return node

    def dumped(self) -> str:
        return "\n".join([f"{p} {label}" for p, label in zip(self.parents[1:], self.labels[1:], strict=True)])

    @staticmethod
    def loaded(text: str) -> Tree:
        out = Tree()
        for line in text.split("\n") if text else ():
            parent, label = line.split(" ", 1)
            out.child(int(parent), label)
        return out


def parse(page: str) -> tuple[Tree, list[Block]]:
    """The tree and the text blocks of a page, in one pass over it however it is nested or cut off."""
    tree, blocks = Tree(), []
    root = Open("", False, 0, False, False, False, False)
    stack: list[Open] = [root]
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html_codes.unescape("".join(pieces)).split())
            if text:
                top = stack[-1]
                block = tree.labels[top.node].partition(".")[0]
                blocks.append(Block(tree.slots[top.node], text, top.drop, top.weak, top.article, min(1.0, linked / len(text)), block in RECURRING))
            pieces.clear()
            linked = 0

    def say(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if stack[-1].link:
            linked += len(text.strip())

    at, n = 0, len(page)
    find, match = page.find, TAG.match
    # tags that may be open where a closing tag is looked up: without a count, unmatched ones would search the whole stack each time
    open_tags: dict[str, int] = {}

    def pop(to: int) -> None:
        while len(stack) > to:
            open_tags[stack.pop().tag] -= 1

    while at < n:
        mark = find("<", at)
        if mark < 0:
            say(page[at:])
            break
        if mark > at:
            say(page[at:mark])
        follow = page[mark + 1 : mark + 2]
        if follow == "!" or follow == "?":
            comment = page.startswith("!--", mark + 1)
            end = find("-->" if comment else ">", mark + (4 if comment else 2))
            if end < 0:
                break
            at = end + (3 if comment else 1)
            continue
        if not (NAME.match(follow) or (follow == "/" and NAME.match(page[mark + 2 : mark + 3]))):
            say("<")
            at = mark + 1
            continue
        m = match(page, mark + 1)
        if m is None:  # cut off inside a tag
            break
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in VOID:
                continue
            inline = tag in INLINE
            if not inline:
                flush()
            if open_tags.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop(i)
                        break
                    if inline and not stack[i].inline:
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            pieces.append(" ")
            if tag == "hr":
                flush()
            continue
        inline = tag in INLINE
        if not inline:
            flush()
            closing = (*CLOSES_SAME.get(tag, ()), "p") if tag in CLOSES_P else CLOSES_SAME.get(tag, ())
            left = sum(open_tags.get(c, 0) for c in closing)
            for i in range(len(stack) - 1, 0, -1):
                if not left:
                    break
                own = stack[i].tag
                if own in closing:
                    pop(i)
                    left = sum(open_tags.get(c, 0) for c in closing)
                elif own in SCOPES:
                    break
        label, drop, weak, article, outside = _start(tag, m[3])
        top = stack[-1]
        node = top.node if inline else tree.child(top.node, label)
        stack.append(Open(tag, inline, node, top.drop or drop or (outside and not top.article), top.weak or weak, top.article or article, top.link or tag == "a"))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return tree, blocks


def _heaviest_rising(places: list[int], weights: list[int]) -> list[int]:
    """The items, by number, of the heaviest subsequence with rising places (all places differ)."""
    order = sorted(range(len(places)), key=places.__getitem__)
    rank = [0] * len(places)
    for r, i in enumerate(order, 1):
        rank[i] = r
    size = len(places)
    best: list[tuple[int, int]] = [(0, -1)] * (size + 1)  # of a prefix of ranks: weight and last item
    before = [-1] * size
    for i, w in enumerate(weights):
        top, r = (0, -1), rank[i] - 1
        while r > 0:
            if best[r][0] > top[0]:
                top = best[r]
            r -= r & -r
        before[i] = top[1]
        own, r = (top[0] + w, i), rank[i]
        while r <= size:
            if own[0] > best[r][0]:
                best[r] = own
            r += r & -r
    top, r = (0, -1), size
    while r > 0:
        if best[r][0] > top[0]:
            top = best[r]
        r -= r & -r
    out, i = [], top[1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """The node pairs of the largest matching of two trees that keeps roots, levels, labels and order (simple tree matching).

    Siblings have different labels, so a node can only be matched with the one node
    of its path in the other tree: children are chosen by the heaviest rising
    subsequence, and the whole takes time in proportion to the smaller tree.
    """
    partner = {0: 0}
    places = {(p, label): i for i, (p, label) in enumerate(zip(b.parents, b.labels, strict=True))}
    children: dict[int, list[int]] = {}
    for node in range(1, len(a.labels)):
        other = partner.get(a.parents[node])
        if other is not None and (match := places.get((other, a.labels[node]))) is not None:
            partner[node] = match
            children.setdefault(a.parents[node], []).append(node)
    weight: dict[int, int] = {}
    chosen: dict[int, list[int]] = {}
    for node in reversed(list(partner)):  # children before parents
        own = children.get(node, [])
        kept = [own[i] for i in _heaviest_rising([partner[c] for c in own], [weight[c] for c in own])] if len(own) > 1 else own
        chosen[node] = kept
        weight[node] = 1 + sum(weight[c] for c in kept)
    found, waiting = [], [0]
    while waiting:
        node = waiting.pop()
        found.append((node, partner[node]))
        waiting += chosen[node]
    return found


def aligned_slots(page_tree: str, reference: str) -> list[int]:
    """The slots of a page's nodes that are aligned with nodes of the reference, ascending."""
    a = Tree.loaded(page_tree)
    return sorted({a.slots[x] for x, _ in aligned(a, Tree.loaded(reference)) if x})


def judged(page: str, template: frozenset, stock: frozenset) -> list[tuple[Block, str | None]]:
    """Each block of the page with the rule that removes it, None where it stays.

    ``template`` holds (slot, text hash) pairs of the page's wrapper, ``stock`` the
    slots filled from a stock. The wrapper decides first: its constant texts, then its
    stock slots (inside a marked article where the article has varying prose beside
    them, so that copies of an article don't empty it). What it has no word on goes by
    the markup and its names, and what is left by the article's mark or, without one,
    by links.
    """
    blocks = parse(page)[1]
    long = [b for b in blocks if b.text.count(" ") >= LONG - 1]
    constant = {id(b) for b in blocks if template and (b.slot, text_hash(b.text)) in template}
    prose = any(b.article and not b.drop and b.slot not in stock and id(b) not in constant for b in long)
    told: list[tuple[Block, str | None]] = []
    for b in blocks:
        rule = None
        if id(b) in constant:
            rule = "constant"
        elif b.slot in stock and (prose or not b.article):
            rule = "stock"
        elif b.drop:
            rule = "markup"
        elif b.weak and not (b.article and b.links < 0.5 and b.slot not in stock and b.text.count(" ") >= LONG - 1):
            rule = "names"
        told.append((b, rule))
    article = any(b.article for b, rule in told if rule is None)
    return [(b, rule or (None if (b.article if article else b.links < 0.5) else "outside" if article else "links")) for b, rule in told]


def text_of(page: str, template: frozenset, stock: frozenset) -> str:
    """The text of the page's blocks that stay."""
    return "\n".join([b.text for b, rule in judged(page, template, stock) if rule is None])


def outlined(pages: DataFrame, host: str, html_col: str) -> DataFrame:
    """host, content (a hash of what tells the page from others), page, tree_id, tree, and each block's slot, text hash and whether its slot may be stock."""

    def outline(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree, blocks = parse(page or "")
                seen = sorted({(b.slot, text_hash(b.text), not b.recurring) for b in blocks})
                told = [b for b in blocks if not b.drop and b.text.count(" ") >= LONG - 1] or blocks
                content = text_hash(",".join(map(str, sorted({text_hash(b.text) for b in told}))))
                shape = tree.dumped()
                rows.append((name, content, text_hash(page or ""), text_hash(shape), shape, [s for s, _, _ in seen], [h for _, h, _ in seen], [r for _, _, r in seen]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "content", "page", "tree_id", "tree", "slots", "hashes", "open"])

    return pages.select(F.col(host).alias("host"), F.col(html_col).cast("string")).mapInArrow(outline, "host string, content long, page long, tree_id long, tree string, slots array<long>, hashes array<long>, open array<boolean>")


def site_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def _alignments(outlines: DataFrame, by: str) -> DataFrame:
    """by, tree_id and the slots that the tree shares with the reference, for every tree of a host or site of SUPPORT different pages at least."""
    trees = outlines.groupBy(by, "tree_id").agg(F.count(F.lit(1)).alias("n"), F.min("tree").alias("tree"))
    references = trees.groupBy(by).agg(F.max_by("tree", F.struct("n", "tree_id")).alias("reference"), F.sum("n").alias("pages")).where(F.col("pages") >= SUPPORT).drop("pages")
    pairs = trees.join(references, by).select(by, "tree_id", "tree", "reference")

    def align(batches):
        import pyarrow as pa

        for batch in batches:
            found = [aligned_slots(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=[by, "tree_id", "aligned"])

    return stored(pairs.mapInArrow(align, f"{by} string, tree_id long, aligned array<long>"), "alignments")


def _wrapper(outlines: DataFrame, by: str, made: list[DataFrame]) -> DataFrame:
    """by, texts (constant texts with their slots) and stock (slots): only slots of the reference occur, so a wrapper is as large as some pages at most.

    ``made`` gets the tables that are stored on the way.
    """
    alignments = _alignments(outlines, by)
    placed = outlines.join(alignments, [by, "tree_id"])
    blocks = placed.select(by, "aligned", F.explode(F.arrays_zip("slots", "hashes", "open")).alias("b")).where(F.array_contains("aligned", F.col("b.slots")))
    counts = stored(blocks.groupBy(by, F.col("b.slots").alias("slot"), F.col("b.hashes").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.bool_and("b.open").alias("open")), "slot-texts")
    made += [alignments, counts]
    # a page with several texts in a slot is one page that has the slot
    having = placed.select(by, F.explode(F.array_intersect(F.array_distinct("slots"), "aligned")).alias("slot")).groupBy(by, "slot").agg(F.count(F.lit(1)).alias("pages"))
    told = counts.join(having, [by, "slot"]).withColumn("constant", (F.col("n") >= SUPPORT) & (F.col("n") >= SHARE * F.col("pages")))
    texts = told.where("constant").groupBy(by).agg(F.collect_list(F.struct("slot", "hash")).alias("texts"))
    # what constant texts leave of a slot is from a stock or varies
    rest = told.where(~F.col("constant") & (F.col("pages") >= LEAST_PAGES)).groupBy(by, "slot")
    filled = rest.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") >= STOCK, F.col("n")).otherwise(0)).alias("again"), F.bool_and("open").alias("open"))
    from_stock = filled.where(F.col("open") & (F.col("again") >= SHARE * F.col("all")))
    return texts.join(from_stock.groupBy(by).agg(F.collect_list("slot").alias("stock")), by, "full_outer")


def induced(pages: DataFrame, host: str, html_col: str) -> DataFrame:
    """host, texts and stock of each host that has a wrapper of its own or of its site."""
    read = stored(outlined(pages.where(F.col(host) != ""), host, html_col), "outlines")
    # of a host's pages of equal content the one with the smallest hash counts
    one = F.min_by(F.struct("tree_id", "tree", "slots", "hashes", "open"), "page").alias("p")
    outlines = stored(read.groupBy("host", "content").agg(one).select("host", site_of(F.col("host")).alias("site"), "p.*"), "outlines-told-apart")
    discard(read)
    made: list[DataFrame] = [outlines]
    own = _wrapper(outlines, "host", made).select("host", F.col("texts").alias("own_texts"), F.col("stock").alias("own_stock"))
    sites = _wrapper(outlines, "site", made).select("site", F.col("texts").alias("site_texts"), F.col("stock").alias("site_stock"))
    hosts = outlines.select("host", "site").distinct()
    none, no_texts = F.array().cast("array<long>"), F.array().cast("array<struct<slot:long,hash:long>>")
    both = hosts.join(own, "host", "left").join(sites, "site", "left")
    wrappers = both.select("host", F.array_union(F.coalesce("own_texts", no_texts), F.coalesce("site_texts", no_texts)).alias("texts"), F.array_union(F.coalesce("own_stock", none), F.coalesce("site_stock", none)).alias("stock"))
    out = stored(wrappers.where((F.size("texts") > 0) | (F.size("stock") > 0)), "wrappers")
    discard(*made)
    return out


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", wrappers: bool = True) -> DataFrame:
    """A row for each row of ``pages``: id, url, text, n_chars.

    White space inside a block becomes one space, blocks are joined by a newline in
    page order. Null or empty html gives an empty text. Pages without a host are
    extracted without a wrapper, as are hosts of whose pages and whose site's less
    than SUPPORT differ. Badly nested html is read as it stands, html that is cut off
    inside a tag up to that tag. Null ids and repeated rows pass through; pages of
    equal content count once for the wrapper; other columns are not read; an empty
    table gives no rows. ``wrappers=False`` goes by each page's own markup alone.
    """
    joined = _with_wrappers(pages, id_col, url_col, html_col, wrappers)

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [text_of(*own) for own in _pages_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    id_type = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(extract, f"`{id_col}` {id_type}, url string, text string, n_chars long")


def removals(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", wrappers: bool = True) -> DataFrame:
    """rule, blocks, pages: how many blocks, of how many pages, each rule of ``judged`` removes, and how many stay (rule ``kept``)."""
    joined = _with_wrappers(pages, id_col, url_col, html_col, wrappers)

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        blocks, seen = Counter(), Counter()
        for batch in batches:
            for own in _pages_of(batch):
                rules = [rule or "kept" for _, rule in judged(*own)]
                blocks.update(rules)
                seen.update(set(rules))
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.string()), pa.array(blocks.values(), pa.int64()), pa.array([seen[r] for r in blocks], pa.int64())], names=["rule", "blocks", "pages"])

    return joined.mapInArrow(count, "rule string, blocks long, pages long").groupBy("rule").agg(F.sum("blocks").alias("blocks"), F.sum("pages").alias("pages"))


def _pages_of(batch):
    """(html, constant texts, stock slots) of each row of ``_with_wrappers``."""
    for page, slots, hashes, stock in zip(*[batch.column(i).to_pylist() for i in range(2, 6)], strict=True):
        yield page or "", frozenset(zip(slots or (), hashes or (), strict=True)), frozenset(stock or ())


def _with_wrappers(pages: DataFrame, id_col: str, url_col: str, html_col: str, wrappers: bool) -> DataFrame:
    """id, url, html and the wrapper of the page's host: slots and hashes of its constant texts, and its stock slots."""
    page_host, page_html, page_texts, page_stock = fresh(pages.select(id_col), "_host", "_html", "_texts", "_stock")
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias(page_html)).withColumn(page_host, host_of(F.col("url")))
    if wrappers:
        made = induced(rows, page_host, page_html).select(F.col("host").alias(page_host), F.col("texts").alias(page_texts), F.col("stock").alias(page_stock))
        joined = rows.join(made, page_host, "left")
    else:
        joined = rows.withColumns({page_texts: F.lit(None).cast("array<struct<slot:long,hash:long>>"), page_stock: F.lit(None).cast("array<long>")})
    return joined.select(id_col, "url", page_html, F.col(page_texts)["slot"].alias("_slots"), F.col(page_texts)["hash"].alias("_hashes"), page_stock)
