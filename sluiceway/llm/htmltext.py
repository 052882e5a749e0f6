"""HTML extraction by site style trees.

Pages of one host are merged: nodes with the same path of styles (tag, classes, role) are one style node of the host.
Two measures come from the merged tree, both entropies: a presentation's (how evenly a node's pages are spread over
different sequences of children) and a content's (a text that c of a node's m pages share has importance 1 - log c /
log m). A branch's importance is weighted with a prior of its style, and branches whose weighted importance is low are
cut from each page, in an article or not; what is left is the page's main text.

The prior is there because entropy alone can't give the text asked for: menus, adverts and footers may differ on every
page, which makes them look important, and copies of one article may fill a host, which makes it look like template. So
the style of a node (nav, footer, aside; forms but those that wrap the page's article or all of it; classes such as ad, sidebar, cookie, comments) weighs its branch down to
nothing, and that of article or main counts HELD times; and pages of a host whose text is the same but for branches
weighed down are one page to the counts, so copies of an article don't make it template.

Two passes read the pages; the first yields hashes by host, page, path and content, from which counts by host, path and
content are made; the second looks each page's blocks up among its host's shared contents, those on more than m ** KEEP of a
style node's m pages. Up to CUTS of these in all are sent to all executors. Beyond that pages are dealt by host and salt, each
deal preceded by its host's shared contents, which a task holds while the deal's pages stream by: about m ** LOW for each
style node, and nothing of them is attached to a page.

Parsing takes time in proportion to the page, whatever its end tags and nesting.

Defined results: null or empty html: empty text, 0 characters; null url: the host is empty, and hosts without a name are
one site; pages of any length and depth are read whole; repeated rows are extracted each; rows without page_id come out without; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import html as H
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST_PAGES, LOW, GAMMA, HELD, CUTS, DEAL = 8, 0.3, 0.9, 2, 1 << 18, 1 << 14
KEEP = 1 - LOW

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|math|textarea|select|object|canvas|audio|video|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|</(?P<end>[a-z][^\s/>]*)[^>]*>|<(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.I | re.S,
)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# Fixed values of HTML: elements without content, elements that are blocks, and what closes an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: What an inline element's end tag doesn't reach beyond.
BARRIERS = frozenset("td th table article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LOW_TAGS = frozenset("nav aside footer form menu dialog button head search label fieldset".split())
LOW_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
LOW_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions banner sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond reply replies widget widgets pagination pager paging toolbar copyright hidden".split())
#: What a class name may end in without meaning anything else.
PLAIN_WORDS = frozenset("area bar block body bottom box button buttons col column container content group holder inner item items layout left link links list module outer panel right row section slot text title top unit wrap wrapper".split())
HIGH_WORDS = frozenset("article post entry story content main maincontent articlebody".split())


def low_name(name: str) -> bool:
    """Whether a class or id names what isn't main text: its last part that means anything does (``share-buttons``, not ``share-price``)."""
    parts = re.findall(r"[a-z]+", name)
    while len(parts) > 1 and parts[-1] in PLAIN_WORDS:
        parts.pop()
    return bool(parts) and parts[-1] in LOW_WORDS


class Node:
    __slots__ = ("tag", "style", "prior", "high", "parent", "kids", "path", "heads", "named", "worded", "form")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.parent, self.kids, self.heads = tag, parent, [], False
        said = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attrs)} if attrs else {}
        cls = said.get("class", "").lower()
        names = f"{cls} {said.get('id', '').lower()}".split() if said else []
        words = set(re.findall(r"[a-z]+", " ".join(names)))
        role = said.get("role", "").lower()
        self.style = f"{tag}.{'.'.join(sorted(cls.split()))}#{role}" if said else tag
        self.high = tag in ("article", "main") or role in ("main", "article") or bool(words & HIGH_WORDS)
        self.form = tag in ("form", "fieldset")
        sure = tag in LOW_TAGS and not self.form or role in LOW_ROLES or "hidden" in said or said.get("aria-hidden") == "true"
        low = sure or self.form or any(map(low_name, names))
        self.worded = low and not sure
        self.named = "header" in words and tag not in HEADINGS and not low and tag not in ("article", "main", "body", "html")
        self.prior = 0 if low and tag not in ("article", "main", "body", "html") or (tag == "article" and words & {"comment", "comments", "reply"}) else 1
        self.path = hash64(self.style, parent.path if parent else 0)


def hash64(text: str, seed: int = 0) -> int:
    """A 64-bit hash of text that is the same in every process, signed."""
    import xxhash

    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed & C.MASK)
    return x - (1 << 64) if x >> 63 else x


class Open:
    """The open elements of a page being parsed, with where each tag, each block and each barrier stands among them."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks, self.barriers = [root], {}, [], [0]

    def push(self, node: Node) -> None:
        n = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(n)
        if node.tag in BLOCK:
            self.blocks.append(n)
        if node.tag in BARRIERS:
            self.barriers.append(n)

    def close(self, n: int) -> None:
        """Closes the elements from the n-th on."""
        while len(self.stack) > n:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in BARRIERS:
                self.barriers.pop()

    def last(self, tag: str) -> int:
        found = self.at.get(tag)
        return found[-1] if found else 0


def parse(html: str) -> Node:
    """The tree of a page: kids are nodes and strings (text, with references still encoded)."""
    root = Node("#root", "", None)
    open_, at, m = Open(root), 0, None
    closed = html.rfind(">") + 1  # no tag ends beyond; what looks like one there is text
    for m in TOKEN.finditer(html, 0, closed):
        if m.start() > at:
            open_.stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag:
            tag = tag.lower()
            if tag in BLOCK and tag != "body" and open_.blocks and open_.stack[open_.blocks[-1]].tag == "p":
                open_.close(open_.blocks[-1])  # a block ends an open paragraph
            if tag in CLOSES:
                scope = max(open_.last(x) for x in SCOPE[tag])
                ends = [found[k] for x in CLOSES[tag] if (found := open_.at.get(x)) and (k := bisect.bisect_right(found, scope)) < len(found)]
                if ends:
                    open_.close(min(ends))
            now = open_.stack[-1]
            node = Node(tag, m["attrs"] if m["tag"] else m["attrs2"], now)
            now.kids.append(node)
            if tag in HEADINGS:
                x = now
                while x is not None and not x.heads:
                    x.heads, x = True, x.parent
            if tag not in VOID and not (m[0].endswith("/>") and tag not in BLOCK):
                open_.push(node)
        elif m["end"]:
            tag = m["end"].lower()
            # An inline element's end tag doesn't reach beyond a cell, a table or an article.
            n = open_.last(tag)
            if n and (tag in BLOCK or n >= open_.barriers[-1]):
                open_.close(n)
    unclosed = m is not None and at == closed and (m[0].startswith("<!--") and not m[0].endswith("-->") or m["raw"] and not re.search(r"</[a-z]+\s*>$", m[0], re.I))
    if at < len(html) and not unclosed:
        open_.stack[-1].kids.append(html[at:].partition("<!--")[0])
    clear(root)
    return root


def sizes(root: Node) -> dict[int, int]:
    """By the id of each node the characters of text in its tree, without white space."""
    out, order = {}, [root]
    for x in order:
        order += [k for k in x.kids if isinstance(k, Node)]
    for x in reversed(order):
        out[id(x)] = sum(out[id(k)] if isinstance(k, Node) else len("".join(k.split())) for k in x.kids)
    return out


def clear(root: Node) -> None:
    """Gives their weight back to nodes that words alone weigh down, and to forms, where they hold what the page is about.

    That is a main; without one, the largest article of a page that has none outside of such nodes; without any, more
    than half of the page's text (of a form: headings and nearly all of it, as where a framework wraps whole pages in one), unless
    there is a node of article's or main's words outside.
    """
    mains, articles, worded, free, todo = [], [], [], False, [(root, False, False)]
    while todo:
        x, sure, under = todo.pop()
        words = (x.worded and not x.prior) or x.named
        sure, under = sure or (not x.prior and not words) or (x.tag == "header" and not x.heads), under or words
        if sure:
            continue
        if words:
            worded.append(x)
        elif x.tag in ("article", "main") or x.high and x.heads:
            free = free or not under
            if x.tag == "main":
                mains.append((x, under))
            elif x.tag == "article":
                articles.append((x, under))
        todo += [(k, sure, under) for k in x.kids if isinstance(k, Node)]
    if not worded:
        return
    if mains:
        held = [x for x, under in mains if under]
    elif any(not under for _, under in articles):
        held = []
    else:
        size = sizes(root)
        if articles:
            held = [max((x for x, _ in articles), key=lambda x: size[id(x)])]
        else:
            whole = 0 if free else size[id(root)]
            held = [x for x in worded if size[id(x)] > whole * (0.9 if x.form else 0.5) and (x.heads or not x.form)] if whole else []
    done: set[int] = set()
    for x in held:
        while x is not None and id(x) not in done:
            done.add(id(x))
            if x.worded:
                x.prior = 1
            x.named, x = False, x.parent


def plain(parts: list[str]) -> str:
    return " ".join(H.unescape("".join(parts)).split())


class Branch:
    """A block of text with what decides about it: its path, prior and whether it lies in an article."""

    __slots__ = ("path", "text", "prior", "held")

    def __init__(self, path: int, text: str, prior: int, held: bool):
        self.path, self.text, self.prior, self.held = path, text, prior, held


def branches(root: Node) -> tuple[list[Branch], list[tuple[int, int, int]]]:
    """The blocks of a page in order, and (path, hash of the children's styles, number of children) of its inner nodes."""
    out: list[Branch] = []
    inner: list[tuple[int, int, int]] = []
    parts: list[str] = []
    where = [root.path, 1, False]
    # Without recursion: pages nest as deeply as they like.
    todo: list[tuple] = [("open", root, 1, False)]

    def flush():
        if parts:
            if text := plain(parts):
                out.append(Branch(where[0], text, where[1], where[2]))
            parts.clear()

    while todo:
        what, x, prior, held = todo.pop()
        if what == "text":
            if not parts:
                where[:] = x[0], prior, held
            parts.append(x[1])
            continue
        if what == "close":
            flush()
            continue
        if x.tag == "br":
            parts.append(" ")
            continue
        own = x.prior
        if x.tag == "header" and not (held and x.heads) or x.named and not x.heads:
            own = 0
        held_now = held or x.tag in ("article", "main") or (x.high and own and x.heads)
        prior_now = prior and own
        block = x.tag in BLOCK or not own
        if block:
            flush()
            todo.append(("close", x, 0, False))
        kids = [k for k in x.kids if isinstance(k, Node)]
        if len(kids) > 0 and block:
            inner.append((x.path, hash64("|".join(k.style for k in kids)), len({k.style for k in kids})))
        for k in reversed(x.kids):
            todo.append(("open", k, prior_now, held_now) if isinstance(k, Node) else ("text", (x.path, k), prior_now, held_now))
    flush()
    return out, inner


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def weight(b: Branch) -> int:
    """The prior as a weight of a branch's importance."""
    return b.prior * (HELD if b.held else 1)


def style_counts(pages: DataFrame, html: str, url: str) -> DataFrame:
    """(host, kind, path, value, width, n): how many of a host's pages have a node with these children (kind 0), this text (kind 1) or any text (kind 2).

    Pages whose branches not weighed down have the same texts count once.
    """
    import pyarrow as pa

    names = ["host", "page", "kind", "path", "value", "width"]

    def run(batches: Iterator) -> Iterator:
        seen: dict[tuple, set[tuple]] = {}

        def out():
            rows = [(*key, *x) for key, found in seen.items() for x in found]
            cols = list(zip(*rows)) if rows else [()] * 6
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[3:]]], names)

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not page:
                    continue
                blocks, inner = branches(parse(page))
                texts = [(b.path, hash64(b.text)) for b in blocks if b.prior]
                found = {(0, *x) for x in inner} | {(1, path, value, 0) for path, value in texts} | {(2, path, 0, 0) for path, _ in texts}
                seen.setdefault((host, hash64(repr(texts))), set()).update(found)
                if len(seen) > 4096:
                    yield out()
        yield out()

    flat = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, page long, kind int, path long, value long, width long")
    once = flat.groupBy("host", "page", "kind", "path", "value").agg(F.max("width").alias("width"))
    return once.groupBy("host", "kind", "path", "value").agg(F.max("width").alias("width"), F.count(F.lit(1)).alias("n"))


def low_branches(counts: DataFrame, low: float = LOW, least: int = LEAST_PAGES, gamma: float = GAMMA) -> DataFrame:
    """(host, path, value, importance) of what has an importance under ``low``: value is a text's hash.

    A text's importance is 1 - log c / log m; its node's presentation adds (1 - gamma ** kinds of children) times the
    entropy of the children's sequences, to base m, where the node has children.
    """
    m = counts.groupBy("host", "kind", "path").agg(F.sum("n").alias("m"), F.max("width").alias("width"))
    p = F.col("n") / F.col("m")
    shape = counts.where("kind = 0").join(m, ["host", "kind", "path"]).groupBy("host", "path").agg((F.sum(-p * F.log(p)) / F.log(F.greatest(F.max("m"), F.lit(2)).cast("double"))).alias("node"), F.max(m["width"]).alias("l"))
    readers = counts.where("kind = 2").select("host", "path", F.col("n").alias("m"))
    text = counts.where("kind = 1 AND n >= 2").join(readers, ["host", "path"]).where((F.col("m") >= least) & (F.col("n") > F.pow(F.col("m").cast("double"), F.lit(1 - low))))
    text = text.join(shape, ["host", "path"], "left")
    g = F.pow(F.lit(gamma), F.coalesce("l", F.lit(0)))
    importance = (1 - g) * F.coalesce("node", F.lit(0.0)) + g * (1 - F.log(F.col("n").cast("double")) / F.log(F.col("m").cast("double")))
    text = text.withColumn("importance", importance)
    return text.where(F.col("importance") < low).select("host", "path", "value", "importance")


def main_text(page: str | None, cut: dict[tuple[int, int], float]) -> str:
    """The blocks of a page whose importance, weighted with the prior, is not low. ``cut`` has the importance of those that a host shares."""
    if not page:
        return ""
    blocks, _ = branches(parse(page))
    return "\n\n".join(b.text for b in blocks if b.prior and weight(b) * (cut.get((b.path, hash64(b.text)), 1.0) if cut else 1.0) >= LOW)


OUT = "page_id long, url string, text string, n_chars long"


def _texts(ids, urls, texts: list[str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages."""
    spark = pages.sparkSession
    pages = C.wide(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    # Written, for each kind of count is read on its own, and pages are to be parsed once for all.
    counts, counts_at = C.write_out(spark, style_counts(pages, "html", "url"), "counts")
    cut, _ = C.write_out(spark, low_branches(counts), "styles")
    C.drop_path(spark, counts_at)
    pages = pages.withColumn("host", host_of(F.col("url")))
    few = cut.limit(CUTS + 1).count() <= CUTS
    return by_table(pages, cut) if few else by_host(pages, cut)


def by_table(pages: DataFrame, cut: DataFrame) -> DataFrame:
    """The pages' texts, with all that hosts share in every task: CUTS rows at most."""
    by: dict[str, dict[tuple[int, int], float]] = {}
    for r in cut.collect():
        by.setdefault(r["host"], {})[r["path"], r["value"]] = r["importance"]
    shipped = pages.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator) -> Iterator:
        by, none = shipped.value, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield _texts(part.column(0), part.column(1), [main_text(page, by.get(host, none)) for host, page in zip(part.column(3).to_pylist(), part.column(2).to_pylist())])

    return pages.mapInArrow(run, OUT)


def by_host(pages: DataFrame, cut: DataFrame) -> DataFrame:
    """The same by deals of about DEAL pages of a host, each preceded by what the host shares. Pages of hosts that share nothing are in no shuffle."""
    hosts = cut.select("host").distinct()
    deals = pages.join(hosts, "host", "left_semi").groupBy("host").agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias("deals"))
    deals, _ = C.write_out(pages.sparkSession, deals, "deals")
    nothing = {"page_id": "long", "url": "string", "html": "string", "path": "long", "value": "long", "importance": "double"}
    row = lambda side, *own: [F.lit(side).alias("side"), *[F.col(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in nothing.items()]]
    ahead = cut.join(deals, "host").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("host", "deal", *row(0, "path", "value", "importance"))
    # A page's deal follows from its own row, so that a lost task deals it again as before.
    dealt = pages.join(deals, "host").withColumn("deal", F.pmod(F.xxhash64("page_id", "url", "html"), F.col("deals")).cast("int")).select("host", "deal", *row(1, "page_id", "url", "html"))

    def run(batches: Iterator) -> Iterator:
        now, held = None, {}
        for batch in batches:
            host, deal, side, ids, urls, html, path, value, importance = (c.to_pylist() for c in batch.columns)
            rows, texts = [], []
            for k in range(batch.num_rows):
                if now != (host[k], deal[k]):
                    now, held = (host[k], deal[k]), {}
                if side[k] == 0:
                    held[path[k], value[k]] = importance[k]
                else:
                    rows.append(k)
                    texts.append(main_text(html[k], held))
            if rows:
                some = batch.take(rows)
                yield _texts(some.column(3), some.column(4), texts)

    parts = max(pages.sparkSession.sparkContext.defaultParallelism, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    of = ahead.unionByName(dealt).repartition(4 * parts, "host", "deal").sortWithinPartitions("host", "deal", "side").mapInArrow(run, OUT)
    rest = pages.join(hosts, "host", "left_anti").select("page_id", "url", "html", "host")
    return of.unionByName(by_table(rest, cut.limit(0)))


def op2_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
