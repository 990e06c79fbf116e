"""Main text of web pages by wrapper induction over the pages of a host; what markup says of itself is a prior.

A page is read into a tree of elements and blocks of text by a forgiving tokenizer (unclosed and misnested elements,
comments, raw-text elements, character references) in time linear in its length. Each block has a role by the elements
around it: MAIN inside <article> or <main>, NONE, DOUBTFUL inside a container with a class or id that names page
furniture, OUT inside an element that can't hold main text (menus, headers, footers, sidebars, forms, hidden ones).

1. Skeleton. SAMPLE pages of a host (the least hashes of page_id) are aligned one after another by simple tree matching:
   the order-preserving mapping of equal tags with the most nodes, by dynamic programming over children. What a page
   has beyond the skeleton is added to it, so it holds the nodes of all layouts seen.
2. Counts. Every page of the host is aligned with its skeleton, and for each node (or path, for what the skeleton
   lacks) the texts found there are counted, with their share of link text, pre-aggregated. All pages count.
3. Decision, on every page. A block whose text stands at its node on nearly all pages that have the node is template;
   a node that varies is a slot. Slots of mostly link text outside paragraphs and headings are menus. Of the rest, the
   MAIN blocks are the article unless the NONE blocks have PRIOR times as much text; then those count, too. Inside a
   named main part a text needs the evidence of MANY pages to be template, and where template would be more than
   half of the article the page is a copy of others, and nothing is taken away. DOUBTFUL blocks count only where there
   is nothing else.

The skeleton is a model of a few hundred nodes a host; it decides which places are compared, the counts of all pages
decide what is template. Pages of a host are never gathered: only the sampled ones are, and skeletons and counts go to
their host's pages by a join that splits hot hosts.

Defined cases: a null or empty html gives an empty text; hosts with fewer than three pages, and pages without a host
(null or odd url), have no skeleton, and roles alone decide; repeated rows come out once each; further columns are kept
out of the way; elements may be nested to any depth; an empty table gives an empty table.
"""

from __future__ import annotations

import html as html_lib
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, pin

SAMPLE, CONSTANT, FEW, MANY, MENU, PRIOR = 8, 0.8, 3, 10, 0.5, 4
#: Cells of the table by which two lists of children are aligned; longer lists are aligned from one end to the other.
CELLS = 10_000
#: Sampled page_ids and bytes of skeletons that may be broadcast; beyond, pages are shuffled.
BROADCAST_IDS, BROADCAST_BYTES, SALTS = 1_000_000, 16 << 20, 64
MAIN, NONE, DOUBTFUL, OUT = 2, 1, 0, -1

#: Fixed values of HTML: elements without content, elements whose content is no text, elements inside a line of text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template svg object select option button annotation annotation-xml".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mtable mtr mtd mspace mpadded mphantom menclose mfenced semantics".split())
PHRASE = set("button select option object svg iframe noscript script template annotation annotation-xml".split())
#: Elements that end an open paragraph.
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements and ARIA roles that are no main text. A header inside the main part is its heading.
NOT_MAIN = set("nav header footer aside form dialog menu head".split())
NOT_MAIN_ROLE = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Elements whose class or id may name them, and elements that hold text of their own even if it is a link.
CONTAINER = set("div section ul ol dl table".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt".split())
#: Words of class and id that name page furniture; inside the main part only whole names of the second list count.
FURNITURE = set(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer masthead header topbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments respond reply disqus pagination pager toolbar skip disclaimer paywall".split()
)
FURNITURE_INSIDE = set("ad ads advert advertisement sponsored comments comment-list commentlist disqus disqus_thread respond sidebar newsletter share sharing social-share cookie-notice cookie-banner breadcrumb breadcrumbs pagination".split())

START = re.compile(r"<([a-zA-Z][^\s>/]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACES = re.compile(r"[\s\x00]+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element, or with the tag "" a block of text. h names a block's text; link is how much of it is link text."""

    __slots__ = ("tag", "kids", "role", "text", "h", "link", "id")

    def __init__(self, tag: str, role: int = NONE, text: str = "", h: int = 0, link: int = 0):
        self.tag, self.kids, self.role, self.text, self.h, self.link, self.id = tag, [], role, text, h, link, -1


def _named(tag: str, source: str, inside: bool) -> tuple[int | None, bool]:
    """The role that an element's tag and attributes give it (None: its parent's), and whether it is hidden."""
    role = MAIN if tag in ("article", "main") else OUT if tag in NOT_MAIN and not (inside and tag == "header") else None
    hidden = False
    if source and not source.isspace():
        for name, a, b, c in ATTRIBUTE.findall(source):
            name, value = name.lower(), (a or b or c).strip()
            if name == "role":
                role = OUT if value.lower() in NOT_MAIN_ROLE else MAIN if value.lower() in ("main", "article") else role
            elif name in ("class", "id"):
                if tag in CONTAINER and role is None:
                    if inside:
                        role = OUT if not FURNITURE_INSIDE.isdisjoint(value.lower().split()) else None
                    elif not FURNITURE.isdisjoint(w.lower() for w in WORDS.findall(value)):
                        role = DOUBTFUL
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
                hidden = True
    return role, hidden and tag not in ("html", "body")


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def parse(source: str | None) -> Node:
    """The tree: elements, and leaves of tag "" that are the blocks of text between the tags that end a block."""
    source = source or ""
    root = Node("root")
    stack, places, walls = [root], {}, []  # places: where each tag is open; walls: where the main part or the body begins
    line: list[tuple[str, bool]] = []
    strict, linked, found, unclosed = True, False, False, set()

    def flush() -> None:
        if line:
            text = SPACES.sub(" ", html_lib.unescape("".join(x for x, _ in line))).strip()
            if text:
                link = sum(len(x.strip()) for x, a in line if a)
                stack[-1].kids.append(Node("", stack[-1].role, text, digest(text), min(link, len(text))))
            line.clear()

    def push(node: Node, begin: bool = False) -> None:
        stack[-1].kids.append(node)
        stack.append(node)
        places.setdefault(node.tag, []).append(len(stack) - 1)
        if begin:
            walls.append(len(stack) - 1)

    def cut(k: int) -> None:
        """Closes the elements from place k on."""
        while len(stack) > k:
            places[stack.pop().tag].pop()
            if walls and walls[-1] >= len(stack):
                walls.pop()

    def close(tag: str) -> None:
        if at := places.get(tag):
            if tag not in ("p", "b", "li") or not walls or at[-1] > walls[-1]:
                cut(at[-1])

    at, end, last = 0, len(source), source.rfind(">")
    while at < end:
        lt = source.find("<", at)
        if lt != at:
            line.append((source[at : lt if lt >= 0 else end], linked))
            if lt < 0:
                break
            at = lt
        after = source[at + 1 : at + 2]
        if source.startswith("<!--", at):
            stop = source.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if not (after.isascii() and after.isalpha() or after in ("/", "!", "?")) or at > last:
            line.append(("<", linked))
            at += 1
            continue
        if after in "/!?":
            stop = source.find(">", at)
            name, at = source[at + 2 : stop], stop + 1
            if after == "/" and name[:1].isalpha():
                tag = re.split(r"[\s/]", name, maxsplit=1)[0].lower()
                if tag in INLINE:
                    if tag == "a":
                        linked = False
                    if stack[-1].tag == tag:  # one that is hidden
                        flush()
                        cut(len(stack) - 1)
                elif tag not in RAW:
                    flush()
                    close(tag)
            continue
        m = START.match(source, at) if strict else None
        if m:
            tag, attributes, at = m[1].lower(), m[2], m.end()
        else:  # a quote that nothing closes: from here on a tag ends at the next bracket
            strict = False
            stop = source.find(">", at)
            tag, _, attributes = source[at + 1 : stop].partition(" ")
            tag, at = tag.rstrip("/").lower(), stop + 1
        if tag in RAW:  # what it holds is no text
            if tag not in PHRASE:
                flush()
            if not attributes.rstrip().endswith("/") and tag not in unclosed:
                over = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
                if over:
                    at = over.end()
                else:
                    unclosed.add(tag)
            continue
        inside = bool(walls) and stack[-1].role == MAIN
        if tag in INLINE:
            if tag == "br":
                line.append((" ", linked))
            elif tag == "a":
                linked = True
            if attributes and tag not in VOID and _named(tag, attributes, inside)[1]:
                flush()
                push(Node(tag, OUT))
            continue
        flush()
        linked = linked and tag not in ("article", "main", "body")
        if tag in ENDS_P and stack[-1].tag == "p":
            cut(len(stack) - 1)
        elif tag == "li":
            own, lists = places.get("li"), [p[-1] for t in ("ul", "ol", "menu") if (p := places.get(t))]
            if own and own[-1] > max(lists, default=0):
                cut(own[-1])
        elif tag in ("dt", "dd") and stack[-1].tag in ("dt", "dd"):
            cut(len(stack) - 1)
        elif tag in ("td", "th", "tr"):
            while stack[-1].tag in ("td", "th") or tag == "tr" and stack[-1].tag == "tr":
                cut(len(stack) - 1)
        named, hidden = _named(tag, attributes, inside)
        up = stack[-1].role
        if named == MAIN and not found and not hidden and up in (NONE, DOUBTFUL):
            found = True  # what holds the main part is no furniture, whatever its class says
            for n in stack:
                n.role = NONE if n.role == DOUBTFUL else n.role
            up = stack[-1].role
        role = OUT if hidden or up == OUT else up if named is None else named if up != DOUBTFUL or named == OUT else DOUBTFUL
        node = Node(tag, role)
        if tag in VOID:
            stack[-1].kids.append(node)
        else:
            push(node, tag in ("article", "main", "body"))
    flush()
    return root


def leaves(root: Node) -> Iterator[tuple[Node, Node, int]]:
    """Each block that isn't OUT, its parent, and a hash of its path, in page order."""
    todo = [(root, root, 0)]
    while todo:
        n, up, path = todo.pop()
        if not n.tag:
            yield n, up, path
        elif n.role != OUT:
            path = xxhash.xxh64_intdigest(n.tag, path & 0xFFFFFFFFFFFFFFFF)
            todo += [(k, n, path) for k in reversed(n.kids) if k.role != OUT]


def size(n: Node) -> int:
    return 1 + (len(n.kids) == 1 and not n.kids[0].tag)


def simple(n: Node) -> bool:
    """A block, or an element with nothing but one."""
    return not n.tag or len(n.kids) == 1 and not n.kids[0].tag


def sign(n: Node) -> tuple | None:
    """What two nodes have in common that say the same."""
    return (n.tag, n.h) if not n.tag else (n.tag, n.kids[0].h) if simple(n) else None


def segments(xs: list[Node], ys: list[Node]) -> tuple[list, list]:
    """Pairs of children that belong together for sure, and what lies between them, as ranges of both lists.

    Those are: from both ends and in between, in order, the ones that say the same and are the only ones on either side.
    """
    a, b = list(map(sign, xs)), list(map(sign, ys))
    once_a, once_b = Counter(a), Counter(b)
    where = {s: j for j, s in enumerate(b)}
    sure, last = [], -1
    for i, s in enumerate(a):
        if s is not None and once_a[s] == 1 == once_b.get(s, 0) and where[s] > last:
            last = where[s]
            sure.append((i, last))
    between, i, j = [], 0, 0
    for p, q in [*sure, (len(xs), len(ys))]:
        if p > i and q > j:
            between.append((i, p, j, q))
        i, j = p + 1, q + 1
    return sure, between


def trimmed(xs: list[Node], ys: list[Node], i: int, p: int, j: int, q: int) -> tuple[list, tuple]:
    """Pairs from the beginning of two ranges as long as both are simple and of one tag, and what is left."""
    pairs = []
    while i < p and j < q and xs[i].tag == ys[j].tag and simple(xs[i]) and simple(ys[j]):
        pairs.append((i, j))
        i, j = i + 1, j + 1
    return pairs, (i, p, j, q)


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The pairs of nodes of a simple tree matching of two trees, without recursion."""
    memo: dict[tuple[int, int], tuple[int, list]] = {}
    plans: dict[tuple[int, int], tuple] = {}

    def weight(x: Node, y: Node) -> int | None:
        """How many pairs two nodes give; None where that isn't known yet."""
        if x.tag != y.tag:
            return 0
        if simple(x) and simple(y):
            return size(x) + (sign(x) == sign(y))
        got = memo.get((id(x), id(y)))
        return None if got is None else got[0]

    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        key = (id(x), id(y))
        if key in memo:
            stack.pop()
            continue
        xs, ys = x.kids, y.kids
        if key not in plans:
            sure, between = segments(xs, ys)
            rest = []
            for r in between:
                pairs, left = trimmed(xs, ys, *r)
                sure += pairs
                if left[0] < left[1] and left[2] < left[3]:
                    rest.append(left)
            plans[key] = sure, rest
            missing = [(xs[i], ys[j]) for i, j in sure if weight(xs[i], ys[j]) is None]
            for i, p, j, q in rest:
                if (p - i) * (q - j) <= CELLS:
                    missing += [(u, v) for u in xs[i:p] for v in ys[j:q] if weight(u, v) is None]
            if missing:
                stack += missing
                continue
        sure, rest = plans[key]
        chosen = list(sure)
        for i, p, j, q in rest:
            if (p - i) * (q - j) <= CELLS:
                chosen += best_pairs([[weight(u, v) for v in ys[j:q]] for u in xs[i:p]], i, j)
            else:
                chosen += in_order(xs, ys, i, p, j, q)
        todo = [(xs[i], ys[j]) for i, j in chosen if weight(xs[i], ys[j]) is None]
        if todo:
            stack += todo
            plans[key] = chosen, []
            continue
        memo[key] = (1 + sum(weight(xs[i], ys[j]) for i, j in chosen), sorted(chosen))
        stack.pop()
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        chosen = memo[id(x), id(y)][1] if (id(x), id(y)) in memo else [(0, 0)] if x.tag and x.kids and y.kids else []
        todo += [(x.kids[i], y.kids[j]) for i, j in reversed(chosen)]
    return out


def best_pairs(sub: list[list[int]], i: int, j: int) -> list[tuple[int, int]]:
    """The order-preserving pairs of the greatest weight."""
    m, n = len(sub), len(sub[0])
    best = [[0] * (n + 1)]
    for row in sub:
        up, now = best[-1], [0]
        for c in range(n):
            now.append(max(up[c + 1], now[c], up[c] + row[c] if row[c] else 0))
        best.append(now)
    out = []
    while m and n:
        if best[m][n] == best[m - 1][n]:
            m -= 1
        elif best[m][n] == best[m][n - 1]:
            n -= 1
        else:
            m, n = m - 1, n - 1
            out.append((i + m, j + n))
    return out[::-1]


def in_order(xs: list[Node], ys: list[Node], i: int, p: int, j: int, q: int) -> list[tuple[int, int]]:
    """Pairs of one tag from one end to the other, for lists too long for a table."""
    places: dict[str, list[int]] = {}
    for k in range(q - 1, j - 1, -1):
        places.setdefault(ys[k].tag, []).append(k)
    out, last = [], j - 1
    for k in range(i, p):
        own = places.get(xs[k].tag, [])
        while own and own[-1] <= last:
            own.pop()
        if own:
            last = own.pop()
            out.append((k, last))
    return out


def skeleton(trees: list[Node]) -> bytes:
    """The nodes of all trees, aligned: for each its parent, tag, and the text that most of its pages have."""
    base = copied(trees[0])[0]
    seen: dict[int, Counter] = {}
    for n, _, _ in leaves(base):
        seen[id(n)] = Counter([n.h])
    for t in trees[1:]:
        t = copied(t)[0]
        pairs = align(base, t)
        at = {id(y): x for x, y in pairs}
        for x, y in pairs:
            if not x.tag:
                seen.setdefault(id(x), Counter())[y.h] += 1
                x.h = min(h for h, c in seen[id(x)].items() if c == max(seen[id(x)].values()))
        for x, y in pairs:  # what only the page has goes after the node before it
            if len(y.kids) > sum(id(k) in at for k in y.kids):
                own = {id(k): i for i, k in enumerate(x.kids)}
                place = 0
                merged = list(x.kids)
                for k in y.kids:
                    if id(k) in at:
                        place = own[id(at[id(k)])] + 1 + len(merged) - len(x.kids)
                    else:
                        merged.insert(place, k)
                        place += 1
                x.kids = merged
    tags, parents, texts, todo = [], [], [], [(base, -1)]
    while todo:
        n, up = todo.pop()
        parents.append(up)
        tags.append(n.tag)
        texts.append(n.h)
        todo += [(k, len(tags) - 1) for k in reversed(n.kids)]
    return pickle.dumps((tags, parents, texts))


def copied(root: Node) -> tuple[Node, list[tuple[Node, Node]]]:
    """A tree without what is OUT, and without text; each of its nodes with the one that it is a copy of."""
    pairs = [(Node(root.tag), root)]
    for to, n in pairs:
        for k in n.kids:
            if k.role != OUT:
                to.kids.append(Node(k.tag, k.role, h=k.h))
                pairs.append((to.kids[-1], k))
    return pairs[0][0], pairs


@lru_cache(64)
def opened(data: bytes) -> Node:
    tags, parents, texts = pickle.loads(data)
    nodes = [Node(t, h=h) for t, h in zip(tags, texts, strict=True)]
    for i, (n, up) in enumerate(zip(nodes, parents, strict=True)):
        n.id = i
        if up >= 0:
            nodes[up].kids.append(n)
    return nodes[0]


def placed(source: str | None, base: bytes | None) -> list[tuple[int, Node, Node]]:
    """The blocks of a page with their places: the id of the skeleton's node, or for other blocks a hash of their path."""
    root = parse(source)
    blocks = list(leaves(root))
    if base is None:
        return [(0, n, up) for n, up, _ in blocks]
    light, pairs = copied(root)
    origin = {id(c): n for c, n in pairs}
    at = {id(origin[id(y)]): x.id for x, y in align(opened(base), light) if not x.tag}
    return [(at.get(id(n), -1 - (path >> 1)), n, up) for n, up, path in blocks]


def main_text(source: str | None, base: bytes | None, facts: dict[int, tuple[int, int, bool]]) -> str:
    """facts: for each place the text that is template there, on how many pages the place is, and whether it is a menu."""
    article, rest, doubtful = [], [], []
    for k, (place, n, up) in enumerate(placed(source, base)):
        text, pages, menu = facts.get(place, (None, 0, n.link > MENU * len(n.text) if base is None else False))
        fixed = text == n.h
        if n.role == MAIN:
            article.append((k, n.text, fixed and pages >= MANY))
        elif not fixed and not (menu and up.tag not in PROSE):
            (rest if n.role == NONE else doubtful).append((k, n.text))
        elif n.role == NONE and up.tag in PROSE:
            doubtful.append((k, n.text))
    chars = lambda xs: sum(len(x[1]) for x in xs)
    own = [x[:2] for x in article if not x[2]]
    if 2 * chars(own) < chars(article):
        own = [x[:2] for x in article]
    blocks = own if chars(own) and PRIOR * chars(own) >= chars(rest) else sorted(own + rest)
    return "\n\n".join(t for _, t in blocks or doubtful)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def skeletons(pages: DataFrame) -> DataFrame:
    """host, base (bytes) for the hosts that have one; pages: page_id, host, html."""
    order = Window.partitionBy("host").orderBy("k", "page_id")
    # The least hashes of each host, first among a few dozen groups of it, so no host's pages meet in one task.
    ids = pages.where("host != ''").select("host", "page_id", F.xxhash64("page_id").alias("k"), F.pmod(F.xxhash64(F.lit(7), "page_id"), F.lit(64)).alias("salt"))
    few = ids.withColumn("n", F.row_number().over(Window.partitionBy("host", "salt").orderBy("k", "page_id"))).where(F.col("n") <= SAMPLE)
    few = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE).select("host", "page_id", "n").distinct()
    few = pin(few)
    few = broadcast_if(few, few.count(), BROADCAST_IDS)
    sample = pages.select("page_id", "html").join(few, "page_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "html"]).drop_duplicates("n")
        if len(group) < FEW:
            return pd.DataFrame({"host": [], "base": []}, dtype=object)
        return pd.DataFrame({"host": group["host"].iloc[:1], "base": [skeleton([parse(x) for x in group["html"]])]})

    return sample.select("host", "n", "html").groupBy("host").applyInPandas(run, "host string, base binary")


def beside(pages: DataFrame, model: DataFrame, volume: int) -> DataFrame:
    """pages with the columns of their host's model, which is broadcast if it is small."""
    if volume <= BROADCAST_BYTES:
        return pages.join(F.broadcast(model), "host", "left")
    # a hot host's pages are dealt to SALTS tasks, each with a copy of its model
    salted = model.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def volume(model: DataFrame, *columns: str) -> int:
    return model.agg(sum(F.sum(F.length(c)) for c in columns)).first()[0] or 0


def counted(pages: DataFrame) -> DataFrame:
    """host, facts (pickled) of the hosts with a skeleton; pages: host, html, base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple, list[int]] = {}
            for h, source, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for key in {(h, place, n.h): (n.link, len(n.text)) for place, n, _ in placed(source, base)}.items():
                    (a, z), x = key[1], seen.setdefault(key[0], [0, 0, 0])
                    x[0], x[1], x[2] = x[0] + 1, x[1] + a, x[2] + z
            keys, values = list(seen), list(seen.values())
            kinds = [pa.string(), *[pa.int64()] * 5]
            columns = [*zip(*keys, strict=True), *zip(*values, strict=True)] if keys else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "place", "h", "n", "link", "chars"])

    rows = pages.select("host", "html", "base").where("base is not null").mapInArrow(run, "host string, place long, h long, n long, link long, chars long")
    texts = rows.groupBy("host", "place", "h").agg(F.sum("n").alias("n"), F.sum("link").alias("link"), F.sum("chars").alias("chars"))
    places = texts.groupBy("host", "place").agg(F.max(F.struct("n", "h")).alias("top"), F.sum("n").alias("n"), F.sum("link").alias("link"), F.sum("chars").alias("chars"))
    fixed = (F.col("top.n") >= F.lit(FEW)) & (F.col("top.n") >= CONSTANT * F.col("n"))
    found = places.select("host", "place", F.when(fixed, F.col("top.h")).alias("h"), "n", (F.col("link") > MENU * F.col("chars")).alias("menu")).where("h is not null or menu")
    # at most a row for each place that recurs on a host's pages, or is a menu
    return found.groupBy("host").agg(F.collect_list(F.struct("place", "h", "n", "menu")).alias("facts"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the main text), n_chars of every page."""
    pages = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    bases = pin(skeletons(pages))
    joined = beside(pages, bases, volume(bases, "base", "host"))
    facts = pin(counted(joined))
    places = facts.agg(F.sum(32 * F.size("facts"))).first()[0] or 0
    joined = beside(joined, facts, places).select("page_id", "url", "html", "base", "facts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, dict] = {}
        for b in batches:
            texts = []
            for source, base, own in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                if base not in known:
                    if len(known) > 64:
                        known.clear()
                    known[base] = {f["place"]: (f["h"], f["n"], f["menu"]) for f in own.as_py() or ()}
                texts.append(main_text(source, base, known[base]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op7(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
