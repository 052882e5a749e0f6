"""Slide templates: indexing, deterministic allocation, cards, patches, fill and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of the template format.
CAP_MAX = {"title": 24, "subtitle": 34, "item_head": 14, "item_body": 80}
CAP_OTHER, FINE_PRINT, TOP_AREA, BAND, TOLERANCE, MAX_ITEMS, SAMPLE = 40, 9.0, 2011680, 548640, 1.15, 6, 24
DECOR = [r"^\d{1,2}$", r"^(PART|Part)\s*\.?\s*\d+$", r"^[A-Za-z][A-Za-z\s\.&/-]*$", r"^第?[一二三四五六七八九十]+$"]
TOC_HINTS, CLOSING_HINTS = ("目录", "CONTENTS", "CONTENT"), ("谢谢", "感谢", "THANKS", "THANK YOU")
SECTION_NO = r"(?i)^(0?\d|PART\s*\.?\s*\d+)$"
RESIDUE = ["单击此处", "单击添加", "此处添加", "本模板内", "请添加", "请自行替换", "XXXX", "{"]
KINDS = ["cover", "toc", "section", "content", "table", "closing"]
LABELS = {"cover": "封面", "toc": "目录", "section": "章节", "content": "要点", "table": "表格", "closing": "封底"}


def _any(x: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def capacity(width: Column, height: Column, font: Column) -> Column:
    """Characters that fit a box (EMU) at a font size (points, 18 if none)."""
    f = F.coalesce(F.nullif(font, F.lit(0.0)), F.lit(18.0))
    per_line = F.greatest(F.lit(1), F.bround(width / 12700 * 0.92 / f).cast("int"))
    return per_line * F.greatest(F.lit(1), F.floor(height / 12700 * 0.95 / (f * 1.25)).cast("int"))


def slot_cap(role: Column, room: Column, text: Column) -> Column:
    top = F.lit(CAP_OTHER)
    for k, v in CAP_MAX.items():
        top = F.when(role == k, v).otherwise(top)
    return F.least(F.greatest(room, F.length(text)), top)


def prominence(font: Column, height: Column) -> Column:
    return F.coalesce(F.nullif(font, F.lit(0.0)), height / 91440.0)


def is_decor(text: Column) -> Column:
    flat = T.flatten(text)
    return _any(F.upper(flat), TOC_HINTS) | F.rlike(flat, F.lit("|".join(DECOR)))


def _template(df: DataFrame) -> list[str]:
    """The key of a table that holds several templates."""
    return ["template"] if "template" in df.columns else []


def slide_kinds(shapes: DataFrame) -> DataFrame:
    """(slide, kind) by ordered rules. shapes: (slide, pos, text, font_pt, left, top, width, height, has_table, layout), and template if there are several, as in all that is made of them."""
    key = _template(shapes)
    per = shapes.groupBy(*key, "slide").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: T.flatten(x["text"])), "").alias("flat"), F.max(F.rlike(T.flatten(F.col("text")), F.lit(SECTION_NO))).alias("numbered"), F.count_if(~is_decor(F.col("text")) & (T.strip(F.col("text")) != "")).alias("bodies"), F.max("has_table").alias("has_table"), F.max("layout").alias("layout"))
    ends = shapes.groupBy(*key).agg(F.min("slide").alias("first"), F.max("slide").alias("last"))
    up = F.upper("flat")
    kind = F.when(F.col("slide") == F.col("first"), "cover").when(_any(up, TOC_HINTS), "toc").when(_any(up, CLOSING_HINTS), "closing").when(F.col("has_table"), "table").when(F.col("numbered") & ((F.col("bodies") <= 2) | F.contains("layout", F.lit("节"))), "section").when(F.col("slide") == F.col("last"), "closing").otherwise("content")
    # Without a key, ends is one row.
    return (per.join(ends, key) if key else per.crossJoin(ends)).select(*key, "slide", kind.alias("kind"))


def slot_roles(shapes: DataFrame, kinds: DataFrame) -> DataFrame:
    """(slide, pos, role): decoration first, the rest by prominence."""
    key, text = _template(shapes), F.col("text")
    numbered = F.rlike(T.flatten(text), F.lit(SECTION_NO))
    fine = (F.col("font_pt") > 0) & (F.col("font_pt") < FINE_PRINT)
    df = shapes.join(kinds, [*key, "slide"]).withColumn("aside", F.when(numbered, "no").when(is_decor(text) | fine, "decor"))
    rest = Window.partitionBy(*key, "slide", F.col("aside").isNull()).orderBy(F.desc(prominence(F.col("font_pt"), F.col("height"))), "pos")
    n, size = F.row_number().over(rest) - 1, F.length(T.flatten(text))
    front = F.col("kind").isin("cover", "section", "closing")
    role = (
        F.when(F.col("aside").isNotNull(), F.col("aside")).when(front & (n == 0), "title").when(front & (n == 1), "subtitle").when(front, "item_body").when(F.col("kind") == "toc", "item_head")
        .when((n == 0) & (F.col("top") < TOP_AREA) & (size <= 20), "title").when(size <= 12, "item_head").otherwise("item_body")
    )
    return df.select(*key, "slide", "pos", role.alias("role"))


def pair(slots: DataFrame) -> DataFrame:
    """(slide, pos, idx): heads numbered in reading order; each body takes the nearest free head, the first on ties, or a new number.

    slots: (slide, pos, role, left, top, width, height). A fold over a slide's bodies, JVM-side.
    """
    cx, cy = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    at = F.struct(F.floor(F.col("top") / BAND).alias("band"), F.col("left").alias("left"), F.col("pos").alias("pos"), cx.alias("x"), cy.alias("y"))
    key = _template(slots)
    per = slots.groupBy(*key, "slide").agg(F.sort_array(F.collect_list(F.when(F.col("role") == "item_head", at))).alias("heads"), F.sort_array(F.collect_list(F.when(F.col("role") == "item_body", at))).alias("bodies"))
    free = F.sequence(F.lit(0), F.size("heads") - 1)
    start = F.struct(F.when(F.size("heads") > 0, free).otherwise(F.array().cast("array<int>")).alias("free"), F.size("heads").alias("next"), F.array().cast("array<struct<pos:int,idx:int>>").alias("out"))

    def step(acc, b):
        def far(h):
            head = F.get(F.col("heads"), h)
            return F.struct((F.pow(head["x"] - b["x"], 2) + F.pow(head["y"] - b["y"], 2)).alias("d"), h.alias("h"))

        best = F.array_min(F.transform(acc["free"], far))["h"]
        idx = F.coalesce(best, acc["next"])
        return F.struct(F.filter(acc["free"], lambda h: h != idx).alias("free"), (acc["next"] + F.when(best.isNull(), 1).otherwise(0)).alias("next"), F.concat(acc["out"], F.array(F.struct(b["pos"].cast("int").alias("pos"), idx.cast("int").alias("idx")))).alias("out"))

    bodies = F.aggregate("bodies", start, step)["out"]
    heads = F.transform("heads", lambda h, i: F.struct(h["pos"].cast("int").alias("pos"), i.cast("int").alias("idx")))
    return per.select(*key, "slide", F.explode(F.concat(heads, bodies)).alias("x")).select(*key, "slide", "x.*")


def index_slides(shapes: DataFrame) -> DataFrame:
    """(slide, kind, items, slots) of a template: its slots in reading order, with role, the text's beginning, capacity and item number.

    shapes: slide_kinds()'s columns and sid. Decoration and section numbers have no capacity; heads and bodies are paired.
    items, the number of items a slide holds, is null for dividers and tables, as for slides without heads and bodies.
    """
    key, kinds = _template(shapes), slide_kinds(shapes)
    slots = shapes.join(slot_roles(shapes, kinds), [*key, "slide", "pos"])
    paired = pair(slots).select(*key, "slide", "pos", "idx")
    df = slots.join(paired, [*key, "slide", "pos"], "left")
    text = T.strip(F.col("text"))
    cap = F.when(~F.col("role").isin("decor", "no"), slot_cap(F.col("role"), capacity(F.col("width"), F.col("height"), F.col("font_pt")), text)).cast("int")
    at = [F.floor(F.col("top") / BAND).alias("band"), F.col("left").alias("left"), F.col("pos").alias("pos")]
    each = F.struct(*at, F.struct(F.col("sid").cast("int").alias("sid"), "role", F.left(text, F.lit(SAMPLE)).alias("sample"), cap.alias("cap"), "idx").alias("slot"))
    per = df.groupBy(*key, "slide").agg(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["slot"]).alias("slots"), (F.max("idx") + 1).alias("items"))
    counted = F.col("kind").isin("content", "toc", "cover", "closing")
    return per.join(kinds, [*key, "slide"]).select(*key, "slide", "kind", F.when(counted, F.col("items")).alias("items"), "slots")


def slides_of(index: DataFrame) -> DataFrame:
    """(i, kind, items, title_cap) of an index, as allocate() and rebuild() take them: the title's tightest capacity."""
    caps = F.transform(F.filter("slots", lambda x: (x["role"] == "title") & x["cap"].isNotNull()), lambda x: x["cap"])
    return index.select(*_template(index), F.col("slide").alias("i"), "kind", "items", F.array_min(caps).alias("title_cap"))


def slots_of(index: DataFrame) -> DataFrame:
    """(i, kind, sid, role, cap, idx, sample) of an index, as fill() takes them."""
    key = _template(index)
    return index.select(*key, F.col("slide").alias("i"), "kind", F.explode("slots").alias("s")).select(*key, "i", "kind", "s.sid", "s.role", "s.cap", "s.idx", "s.sample")


def blank_pages(index: DataFrame) -> DataFrame:
    """(i, kind, caps, items) of what is to be written on each slide: by role the tightest capacity, and items with a placeholder in each field that has a slot."""
    caps = F.filter("slots", lambda x: x["cap"].isNotNull())
    least = lambda r: F.struct(r.alias("role"), F.array_min(F.transform(F.filter(caps, lambda x: x["role"] == r), lambda x: x["cap"])).alias("cap"))
    tight = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform(caps, lambda x: x["role"]))), least))
    of = lambda role, k: F.filter("slots", lambda x: (x["role"] == role) & (x["idx"] == k))
    front = F.col("kind").isin("cover", "closing")

    def item(k):
        body = F.get(of("item_body", k), F.lit(0))
        head = F.when(F.col("kind") == "toc", F.lit("{章节名}")).when(~front & (F.size(of("item_head", k)) > 0), F.lit("{要点}"))
        text = F.when(front, F.concat(F.lit("{"), F.coalesce(body["sample"], F.lit("署名")), F.lit("}"))).when((F.col("kind") != "toc") & (body.isNotNull() | head.isNull()), F.lit("{说明}"))
        return F.struct(head.alias("head"), text.alias("body"))

    items = F.when(F.coalesce("items", F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.col("items") - 1), item))
    return index.select(*_template(index), F.col("slide").alias("i"), "kind", F.when(F.size(tight) > 0, tight).alias("caps"), items.alias("items"))


def kind_counts(kinds: DataFrame) -> DataFrame:
    """(ord, kind, n) of a template's slides, in the kinds' order; kinds without a slide are left out."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    key = _template(kinds)
    return kinds.groupBy(*key, "kind").agg(F.count(F.lit(1)).alias("n")).select(*key, place.alias("ord"), "kind", "n")


def summary(index: DataFrame) -> DataFrame:
    """(slides, kinds, capacities, line): a row for each template."""
    key = _template(index)
    by = kind_counts(index).groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "kind", "n"))), lambda x: F.concat(x["kind"], x["n"].cast("string"))), " ").alias("kinds"), F.sum("n").alias("slides"))
    items = F.when((F.col("kind") == "content") & (F.col("items") > 0), F.col("items"))
    room = index.groupBy(*key).agg(F.sort_array(F.collect_set(items)).alias("capacities"))
    line = F.concat(F.col("slides").cast("string"), F.lit(" slides ("), "kinds", F.lit("); items: "), F.when(F.size("capacities") > 0, F.array_join(F.transform("capacities", lambda x: x.cast("string")), "/")).otherwise("-"))
    return (by.join(room, key) if key else by.crossJoin(room)).select(*key, "slides", "kinds", "capacities", line.alias("line"))


def templates(slides: DataFrame) -> DataFrame:
    """A row for each template, which is a few dozen slides: cover, end and closings, tocs (i, n, items), divs, and the pool (items, i, title_cap).

    The pool is content slides with 1 to MAX_ITEMS items, with two or more if there are any. slides: (i, kind, items, title_cap).
    """
    of = lambda kind, x: F.sort_array(F.collect_list(F.when(kind, x)))
    kind, i = F.col("kind"), F.col("i")
    usable = (kind == "content") & F.col("items").between(1, MAX_ITEMS)
    per = slides.groupBy(*_template(slides)).agg(
        F.min(F.when(kind == "cover", i)).alias("cover"), F.min(F.when(kind == "closing", i)).alias("end"), F.count_if(kind == "closing").alias("closings"), of(kind == "section", i).alias("divs"),
        of(kind == "toc", F.struct("i", F.coalesce("items", F.lit(0)).alias("n"), "items")).alias("tocs"), of(usable, F.struct("items", "i", "title_cap")).alias("pool"),
    )
    several = F.filter("pool", lambda x: x["items"] >= 2)
    return per.withColumn("pool", F.when(F.size(several) > 0, several).otherwise(F.col("pool")))


def _holding(pool: Column, title: Column) -> Column:
    """The slides of a pool that hold a title; all if none does."""
    holds = F.filter(pool, lambda x: F.coalesce(x["title_cap"], F.lit(99)) >= F.length(title))
    return F.when(F.size(holds) > 0, holds).otherwise(pool)


def outlines(slides: DataFrame, requests: DataFrame) -> DataFrame:
    """(deck, template, page, src, kind, title, items) of outlines: cover, contents, per section a divider and its share of body pages, closing.

    slides: (template, i, kind, items, title_cap); requests: (deck, template, title, total, sections). Keys that requests lack are left out.
    Body pages are dealt by divmod, the remainder to the first sections; one counter runs through all sections and picks from
    the slides that hold a section's name. An outline is a few dozen pages, made within its request's row by higher-order
    functions: one join of requests with a row for each template, and no shuffle of pages.

    Defined results: null sections are none; a template that is missing, or without slides, gives no pages; a total under one gives none.
    """
    key, keep = _template(requests), [*_deck(requests), *_template(requests)]
    per = templates(slides if key else slides.drop("template"))
    df = (requests.join(per, key) if key else requests.crossJoin(per)).withColumn("sections", F.coalesce("sections", F.array().cast("array<string>")))
    n = F.size("sections")
    fixed = 1 + F.col("closings") + F.when(F.size("tocs") > 0, 1).otherwise(0) + F.when(F.size("divs") > 0, n).otherwise(0)
    df = df.withColumn("n", n).withColumn("body", F.greatest(F.col("total") - fixed, n).cast("int"))
    df = df.withColumn("share", F.floor(F.col("body") / F.greatest("n", F.lit(1))).cast("int")).withColumn("more", F.col("body") % F.greatest("n", F.lit(1)))
    none = F.lit(None)
    page = lambda src, kind, title, items: F.struct(src.cast("int").alias("src"), F.lit(kind).alias("kind"), title.alias("title"), items.cast("int").alias("items"))
    empty = F.array().cast("array<struct<src:int,kind:string,title:string,items:int>>")
    some = lambda ok, x: F.when(ok, x).otherwise(empty)

    def section(name, s):
        use, start = _holding(F.col("pool"), name), s * F.col("share") + F.least(s, F.col("more"))
        count = F.col("share") + F.when(s < F.col("more"), 1).otherwise(0)

        def body(b):
            slide = F.get(use, (b % F.size(use)).cast("int"))
            return page(slide["i"], "content", name, slide["items"])

        div = some(F.size("divs") > 0, F.array(page(F.get("divs", (s % F.size("divs")).cast("int")), "section", name, none)))
        return F.concat(div, some(F.size("pool") > 0, F.transform(F.sequence(start, start + count - 1), body)))

    toc = F.array_min(F.transform("tocs", lambda x: F.struct(F.abs(x["n"] - F.col("n")).alias("far"), x["i"].alias("i"), x["items"].alias("items"))))
    pages = F.concat(
        some(F.col("cover").isNotNull(), F.array(page(F.col("cover"), "cover", F.col("title"), none))),
        some(F.size("tocs") > 0, F.array(page(toc["i"], "toc", F.lit("目录"), F.least(F.coalesce(toc["items"], F.col("n")), F.col("n"))))),
        F.flatten(F.transform("sections", section)),
        some(F.col("end").isNotNull(), F.array(page(F.col("end"), "closing", F.lit("{致谢}"), none))),
    )
    each = df.select(*keep, F.posexplode(F.slice(pages, F.lit(1), F.greatest(F.col("total"), F.lit(0)).cast("int"))).alias("at", "x"))
    return each.select(*keep, (F.col("at") + 1).alias("page"), "x.*")


def allocate(slides: DataFrame, sections: list[str], total: int, title: str = "{标题}") -> DataFrame:
    """(page, src, kind, title, items) of one outline, as outlines() gives many."""
    one = slides.sparkSession.range(1).select(F.lit(title).alias("title"), F.lit(total).alias("total"), F.array(*map(F.lit, sections)).cast("array<string>").alias("sections"))
    return outlines(slides, one)


def label(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in LABELS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _deck(df: DataFrame) -> list[str]:
    """The key of a table that holds several decks."""
    return ["deck"] if "deck" in df.columns else []


def _numbered(pages: DataFrame) -> Column:
    """The number of the section that a page belongs to, by deck."""
    return F.sum((F.col("kind") == "section").cast("int")).over(Window.partitionBy(*_deck(pages)).orderBy("page"))


def cards(pages: DataFrame) -> DataFrame:
    """(page, card): a page as text. pages: (page, kind, title, subtitle, items array<struct<head,body>>), and deck if there are several."""
    df = pages.withColumn("no", _numbered(pages))
    title, sub = F.coalesce("title", F.lit("")), F.coalesce("subtitle", F.lit(""))
    head = F.concat(F.lit("**第 "), F.col("page").cast("string"), F.lit(" 页**　`"), label(F.col("kind")), F.lit("`"))
    front = F.col("kind").isin("cover", "closing")

    def line(x):
        h, b = F.coalesce(x["head"], F.lit("")), F.coalesce(x["body"], F.lit(""))
        return F.when(front, F.concat(F.lit("- "), b)).when(F.col("kind") == "toc", F.concat(F.lit("- "), h)).when((h != "") & (b != ""), F.concat(F.lit("- **"), h, F.lit("** — "), b)).when(h != "", F.concat(F.lit("- **"), h, F.lit("**"))).otherwise(F.concat(F.lit("- "), b))

    items = F.transform(F.coalesce("items", F.array()), line)
    first = F.when((F.col("kind") == "section") | front | (title == ""), head).otherwise(F.concat(head, F.lit("　"), title))
    own = F.when(F.col("kind") == "section", F.array(F.concat(F.lit("### "), F.lpad(F.col("no").cast("string"), 2, "0"), F.lit(" · "), title))).when(front, F.when(sub != "", F.array(F.concat(F.lit("# "), title), sub)).otherwise(F.array(F.concat(F.lit("# "), title)))).when(sub != "", F.array(F.concat(F.lit("*"), sub, F.lit("*")))).otherwise(F.array().cast("array<string>"))
    return df.select(*_deck(pages), "page", F.array_join(F.concat(F.array(first), own, items), "\n").alias("card"))


def preview(cards_: DataFrame, template: str, title: str) -> DataFrame:
    """(text): whole cards, a row for each deck: a head line, the pages between separators, a separator. A deck is as long as its pages."""
    by = _deck(cards_)
    whole = cards_.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("page", "card"))).alias("c"))
    head = F.concat(F.lit(f"**{title}**　模板：{template}　共 "), F.size("c").cast("string"), F.lit(" 页"))
    pages = F.array_join(F.transform("c", lambda x: x["card"]), "\n\n---\n\n")
    return whole.select(*by, F.concat(head, F.lit("\n\n---\n\n"), pages, F.lit("\n\n---\n")).alias("text"))


CARD_HEAD = r"^\*\*(.+?)\*\*[　 ]+模板：(.+?)[　 ]+共 (\d+) 页$"


def _settled(df: DataFrame, *columns: str) -> DataFrame:
    """df with columns that are worked out once a row, however often later columns and filters name them: what a generator gives is not put in place of its name."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))


def read_cards(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(card, page, kind, title, subtitle, items) of whole card texts (card, text), and (card, error) of those that aren't right.

    What stands before the head line is noise; pages end at the first block that begins with no page's head. A text
    without a head line or without pages, with a page of unknown label, a divider without a title, or another number of
    pages than its head line says is an error, and gives no pages. Pages are numbered by their place.
    """
    lines = F.transform(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, f"{T.SPACE}+$", ""))
    at = F.array_position(F.transform("lines", lambda x: F.rlike(x, F.lit(CARD_HEAD))), F.lit(True))
    df = _settled(texts.select("card", lines.alias("lines")), "lines").withColumn("at", at.cast("int"))
    df = df.withColumn("head", F.when(F.col("at") > 0, F.element_at("lines", F.greatest("at", F.lit(1)))))
    body = F.slice("lines", F.col("at") + 1, F.greatest(F.size("lines") - F.col("at"), F.lit(0)))
    blocks = F.filter(F.split(F.array_join(F.filter(F.transform(body, lambda x: F.when(T.strip(x) == "---", F.lit("\x01")).otherwise(x)), lambda x: x != ""), "\n"), "\x01"), lambda b: T.strip(b) != "")
    first = lambda b: F.get(F.filter(F.split(b, "\n"), lambda x: x != ""), F.lit(0))
    df = _settled(df.select("card", "head", F.when(F.col("at") > 0, blocks).alias("blocks")), "head", "blocks")
    foreign = F.array_position(F.transform("blocks", lambda b: ~F.rlike(first(b), F.lit(PAGE_HEAD))), F.lit(True))
    df = df.withColumn("end", foreign.cast("int")).withColumn("own", F.when(F.col("end") > 0, F.slice("blocks", 1, F.col("end") - 1)).otherwise(F.col("blocks")))
    df = _settled(df.select("card", "head", "own"), "head", "own")
    labels = F.transform("own", lambda b: T.strip(F.regexp_extract(first(b), PAGE_HEAD, 2)))
    unknown = F.get(F.filter(labels, lambda x: ~x.isin(*LABELS.values())), F.lit(0))
    bare = F.exists("own", lambda b: (F.regexp_extract(first(b), PAGE_HEAD, 2) == LABELS["section"]) & ~F.rlike(b, F.lit(r"(?m)^### \d+ · .+$")) & (T.strip(F.regexp_extract(first(b), PAGE_HEAD, 3)) == ""))
    said = F.regexp_extract("head", CARD_HEAD, 3).cast("int")
    error = F.when(F.col("head").isNull(), F.lit("no head line")).when(F.size("own") == 0, F.lit("no pages")).when(unknown.isNotNull(), F.concat(F.lit("unknown label "), unknown)).when(bare, F.lit("divider without a title")).when(F.size("own") != said, F.concat(F.lit("head line says "), said.cast("string"), F.lit(" pages, there are "), F.size("own").cast("string")))
    df = _settled(df.select("card", "own", error.alias("error")), "own", "error")
    each = df.where("error IS NULL").select("card", F.posexplode("own").alias("k", "block"))
    parsed = parse_cards(each.select(F.struct("card", "k").alias("key"), F.col("block").alias("card")), ["key"])
    return parsed.select(F.col("key.card").alias("card"), (F.col("key.k") + 1).alias("page"), "kind", "title", "subtitle", "items"), df.where("error IS NOT NULL").select("card", "error")


PAGE_HEAD = r"^\*\*第 (\d+) 页\*\*[　 ]+`([^`]+)`(?:[　 ]+(.*))?$"


def parse_cards(cards_: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(page, kind, title, subtitle, items) of card texts, and columns to keep (deck by default); rows whose first line is no page head are left out (read_cards() tells what is wrong with whole texts)."""
    keep = _deck(cards_) if keep is None else keep
    lines = F.filter(F.transform(F.split("card", "\n"), lambda x: T.strip(x)), lambda x: x != "")
    df = cards_.select(*keep, lines.alias("l")).withColumn("h", F.get("l", F.lit(0))).where(F.rlike("h", F.lit(PAGE_HEAD)))
    kind = F.lit(None).cast("string")
    for k, v in LABELS.items():
        kind = F.when(F.regexp_extract("h", PAGE_HEAD, 2) == v, k).otherwise(kind)
    df = df.select(*keep, F.regexp_extract("h", PAGE_HEAD, 1).cast("int").alias("page"), kind.alias("kind"), F.regexp_extract("h", PAGE_HEAD, 3).alias("t"), F.slice("l", F.lit(2), F.size("l")).alias("l"))
    bullets = F.filter("l", lambda x: F.startswith(x, F.lit("- ")))
    front = F.col("kind").isin("cover", "closing")

    def item(x):
        s = F.substr(x, F.lit(3))
        pair_, alone = r"^\*\*(.+?)\*\*[　 ]+—[　 ]+(.*)$", r"^\*\*(.+?)\*\*$"
        h = F.when(F.col("kind") == "toc", s).when(front, "").when(F.rlike(s, F.lit(pair_)), F.regexp_extract(s, pair_, 1)).when(F.rlike(s, F.lit(alone)), F.regexp_extract(s, alone, 1)).otherwise("")
        b = F.when(F.col("kind") == "toc", "").when(front, s).when(F.rlike(s, F.lit(pair_)), F.regexp_extract(s, pair_, 2)).when(F.rlike(s, F.lit(alone)), "").otherwise(s)
        return F.struct(h.alias("head"), b.alias("body"))

    big = F.get(F.filter("l", lambda x: F.startswith(x, F.lit("# "))), F.lit(0))
    sec = F.get(F.filter("l", lambda x: F.startswith(x, F.lit("### "))), F.lit(0))
    rest = F.get(F.filter("l", lambda x: ~F.startswith(x, F.lit("- ")) & ~F.startswith(x, F.lit("#"))), F.lit(0))
    title = F.when(front, F.substr(big, F.lit(3))).when(F.col("kind") == "section", F.regexp_replace(sec, r"^### \d+ · ", "")).otherwise(F.col("t"))
    sub = F.when(front, rest).otherwise(F.regexp_replace(rest, r"^\*|\*$", ""))
    return df.select(*keep, "page", "kind", title.alias("title"), sub.alias("subtitle"), F.transform(bullets, item).alias("items"))


def default_sections(slides: DataFrame) -> DataFrame:
    """(template, ord, name): titles of a template's dividers, else the heads of its first contents page; each once, none empty.

    slides: (template, i, kind, slots array<struct<role, sample, ...>>). One shuffle, by template.
    """
    role = F.when(F.col("kind") == "section", "title").when(F.col("kind") == "toc", "item_head")
    each = slides.where(F.col("kind").isin("section", "toc")).select("template", "kind", "i", role.alias("want"), F.posexplode("slots").alias("pos", "x")).where("x.role = want")
    mine = Window.partitionBy("template")
    each = each.withColumn("divided", F.max(F.col("kind") == "section").over(mine)).withColumn("toc", F.min(F.when(F.col("kind") == "toc", F.col("i"))).over(mine))
    used = each.where("IF(divided, kind = 'section', kind = 'toc' AND i = toc) AND x.sample <> ''")
    names = used.groupBy("template", F.col("x.sample").alias("name")).agg(F.min(F.struct("i", "pos")).alias("at"))
    return names.select("template", F.row_number().over(mine.orderBy("at")).alias("ord"), "name")


def same(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows by which two parsed cards differ, with the side that has them: none if a card was rebuilt as it was."""
    one = lambda x, y, side: x.exceptAll(y).withColumn("side", F.lit(side))
    return one(a, b, "first").unionByName(one(b, a, "second"))


def rebuild(skeleton: DataFrame, parsed: DataFrame, slides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages as written on cards, errors (page, error)). skeleton: what outlines() gives; parsed: what parse_cards() gives, with the same deck if there are several.

    A page keeps its slide if its items are as many as the slide has. Contents pages take the nearest slide. Content
    pages take slides of just that many items in turn, those that hold the title first; without any, fewer items leave
    slots empty and more are an error, as is a page whose kind differs.
    """
    deck, key = _deck(parsed), _template(skeleton)
    had = skeleton.select(*deck, *key, "page", "src", F.col("kind").alias("was"), F.coalesce("items", F.lit(0)).alias("have"))
    per = templates(slides if key else slides.drop("template")).select(*key, "pool", "tocs")
    j = parsed.drop(*key).join(had, [*deck, "page"]).withColumn("need", F.size("items"))
    j = (j.join(per, key) if key else j.crossJoin(per)).withColumn("moved", F.when((F.col("kind") == F.col("was")) & (F.col("need") != F.col("have")), F.col("kind")))
    # Content pages of a deck that want as many items take the slides that have them in turn.
    k = F.row_number().over(Window.partitionBy(*deck, "moved", "need").orderBy("page")) - 1
    use = _holding(F.filter("pool", lambda x: x["items"] == F.col("need")), F.col("title"))
    near = F.array_min(F.transform("tocs", lambda x: F.struct(F.abs(x["n"] - F.col("need")).alias("far"), x["i"].alias("i"), x["n"].alias("n"))))
    df = j.withColumn("k", k).withColumn("use", use).withColumn("near", near)
    turn = F.get("use", (F.col("k") % F.size("use")).cast("int"))
    df = df.withColumn("i", F.when((F.col("moved") == "content") & (F.size("use") > 0), turn["i"]).when(F.col("moved") == "toc", F.col("near.i")))
    df = df.withColumn("room", F.when(F.col("i").isNull(), F.col("have")).when(F.col("moved") == "toc", F.col("near.n")).otherwise(F.col("need")))
    error = F.when(F.col("kind").isNull() | (F.col("kind") != F.col("was")), "kind differs").when(F.col("need") > F.col("room"), "too many items")
    given = F.transform(F.when(F.col("room") > 0, F.sequence(F.lit(0), F.col("room") - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(*[F.coalesce(F.get("items", k)[f], F.lit("")).alias(f) for f in ("head", "body")]))
    pages = df.where(error.isNull()).select(*deck, "page", F.coalesce("i", "src").alias("src"), "kind", "title", "subtitle", given.alias("items"))
    return pages, df.where(error.isNotNull()).select(*deck, "page", error.alias("error"))


def cap_warnings(pages: DataFrame, caps: DataFrame) -> DataFrame:
    """(page, role, text, cap) of texts beyond their slide's tightest cap; a template's own ``{...}`` is none. caps: (i, role, cap)."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    items = F.flatten(F.transform(F.coalesce("items", F.array()), lambda x: F.array(one("item_head", x["head"]), one("item_body", x["body"]))))
    said = pages.select("page", F.col("src").alias("i"), F.explode(F.concat(F.array(one("title", F.col("title")), one("subtitle", F.col("subtitle"))), items)).alias("x")).select("page", "i", "x.*")
    df = said.join(caps, ["i", "role"])
    return df.where((F.length("text") > F.col("cap")) & (F.col("cap") > 0) & ~F.startswith("text", F.lit("{"))).select("page", "role", "text", "cap")


FIELD = r"^items\[(\d+)\]\.(head|body)$"


def patch(pages: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patched pages, invalid ops). ops: (ord, page, field, value); the last of a page's field wins; with any invalid op nothing of the deck changes.

    With a column deck in both tables, ops are those of each deck.
    """
    by = _deck(pages)
    n = pages.select(*by, "page", F.size("items").alias("n"))
    at = F.regexp_extract("field", FIELD, 1)
    j = ops.join(n, [*by, "page"], "left").withColumn("k", F.when(at != "", at.cast("int")))
    ok = F.col("n").isNotNull() & F.col("value").isNotNull() & (F.col("field").isin("title", "subtitle") | (F.col("k") < F.col("n")))
    bad = j.where(~F.coalesce(ok, F.lit(False))).select(*by, "ord", "page", "field")
    last = j.groupBy(*by, "page", "field").agg(F.max_by("value", "ord").alias("value")).groupBy(*by, "page").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    if by:
        last = last.join(bad.select(*by).distinct(), by, "left_anti")
    else:
        last = last.crossJoin(bad.agg((F.count(F.lit(1)) == 0).alias("fine"))).where("fine").drop("fine")
    df = pages.join(last, [*by, "page"], "left")
    get = lambda field, old: F.coalesce(F.element_at("m", field), old)
    items = F.transform("items", lambda x, i: F.struct(get(F.concat(F.lit("items["), i.cast("string"), F.lit("].head")), x["head"]).alias("head"), get(F.concat(F.lit("items["), i.cast("string"), F.lit("].body")), x["body"]).alias("body")))
    return df.select(*by, "page", "kind", get(F.lit("title"), F.col("title")).alias("title"), get(F.lit("subtitle"), F.col("subtitle")).alias("subtitle"), items.alias("items")), bad


def unknown_slides(pages: DataFrame, slots: DataFrame) -> DataFrame:
    """(page, error) of pages whose slide the index doesn't have."""
    key = [k for k in _template(slots) if k in pages.columns]
    lost = pages.join(slots.select(*key, F.col("i").alias("src")).distinct(), [*key, "src"], "left_anti")
    return lost.select(*_deck(pages), "page", F.concat(F.lit("no slide "), F.coalesce(F.col("src").cast("string"), F.lit("given"))).alias("error"))


def fill(pages: DataFrame, slots: DataFrame) -> DataFrame:
    """(page, sid, text): what goes into each slot. pages: (page, src, title, subtitle, items), and deck if there are several; slots: (i, kind, sid, role, idx). Decoration stays.

    Pages of slides that the index doesn't have are errors, given by unknown_slides(), and have no slots.
    """
    by, key = _deck(pages), [k for k in _template(slots) if k in pages.columns]
    kinds = slots.select(*key, F.col("i").alias("src"), "kind").distinct()
    df = pages.drop("kind").join(kinds, [*key, "src"])
    df = df.withColumn("no", _numbered(df)).drop("kind").join(slots.withColumnRenamed("i", "src"), [*key, "src"])
    item = F.get("items", F.coalesce("idx", F.lit(0)))
    text = F.when((F.col("role") == "no") & (F.col("kind") == "section"), F.lpad(F.col("no").cast("string"), 2, "0")).when(F.col("role") == "title", F.col("title")).when(F.col("role") == "subtitle", F.col("subtitle")).when(F.col("role") == "item_head", item["head"]).when(F.col("role") == "item_body", item["body"])
    return df.where("role <> 'decor' AND (role <> 'no' OR kind = 'section')").select(*by, "page", "sid", F.coalesce(text, F.lit("")).alias("text"))


def content_issues(filled: DataFrame, caps: DataFrame) -> DataFrame:
    """(page, sid, category): placeholders left over, and text beyond a cap's tolerance. caps: cap by any of deck, page and sid."""
    text = T.strip(F.col("text"))
    by = _deck(filled)
    df = filled.join(caps, [*(c for c in by if c in caps.columns), *(c for c in ("page", "sid") if c in caps.columns)], "left").where(text != "")
    both = F.filter(F.array(F.when(_any(F.col("text"), RESIDUE), F.lit("residue")), F.when(F.length(text) > F.col("cap") * TOLERANCE, F.lit("overflow"))), lambda x: x.isNotNull())
    return df.select(*by, "page", "sid", F.explode(both).alias("category"))


def todo_slots(filled: DataFrame) -> DataFrame:
    """(page, todo): runs of two underscores or more."""
    return filled.groupBy(*_deck(filled), "page").agg(F.sum(F.regexp_count("text", F.lit("_{2,}"))).alias("todo")).where("todo > 0")


def package_issues(used: DataFrame, rels: DataFrame, parts: DataFrame, shapes: DataFrame, charts: DataFrame | None = None) -> DataFrame:
    """(category, part, detail) of a package: used (part, rid), rels (part, rid, type, target, mode), parts (part), shapes (part, shape_id).

    charts (part, rid), if given, has the relationships by which charts name their data; those must lead to a workbook.
    Targets are normalised part names. Parts for one owner only: tags, charts, embeddings, diagrams. With a column
    ``package`` in all of them, issues are those of each package, and have that column too.
    """
    by = ["package"] if "package" in rels.columns else []
    dangling = used.join(rels, [*by, "part", "rid"], "left_anti").select(*by, F.lit("dangling_rid").alias("category"), "part", F.col("rid").alias("detail"))
    inner = rels.where("mode IS NULL OR mode <> 'External'")
    missing = inner.join(parts.select(*by, F.col("part").alias("target")), [*by, "target"], "left_anti").select(*by, F.lit("missing_target").alias("category"), "part", F.col("target").alias("detail"))
    twice = shapes.groupBy(*by, "part", "shape_id").count().where("count > 1").select(*by, F.lit("duplicate_id").alias("category"), "part", F.col("shape_id").cast("string").alias("detail"))
    shared = inner.where(F.rlike("target", F.lit("/(tags|charts|embeddings|diagrams)/"))).groupBy(*by, "target").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by, F.lit("shared_part").alias("category"), F.col("target").alias("part"), F.col("n").cast("string").alias("detail"))
    out = dangling.unionByName(missing).unionByName(twice).unionByName(shared)
    if charts is None:
        return out
    kind = F.substring_index(F.coalesce("type", F.lit("")), "/", -1)
    led = charts.join(rels.select(*by, "part", "rid", "type"), [*by, "part", "rid"], "left").where(~F.endswith(F.coalesce("type", F.lit("")), F.lit("/package")))
    return out.unionByName(led.select(*by, F.lit("chart_data").alias("category"), "part", F.coalesce(F.nullif(kind, F.lit("")), F.lit("missing")).alias("detail")))


def grid(cells: Column, columns: int) -> Column:
    """(rows, row, column) of the cells 0, 1, ... of a grid: the number of rows it takes, and each cell's place."""
    rows = F.ceil(cells / columns).cast("int")
    place = lambda k: F.struct(F.floor(k / columns).cast("int").alias("row"), (k % columns).cast("int").alias("column"))
    return F.struct(rows.alias("rows"), F.when(cells > 0, F.transform(F.sequence(F.lit(0), cells.cast("int") - 1), place)).otherwise(F.array().cast("array<struct<row:int,column:int>>")).alias("cells"))
