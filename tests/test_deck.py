import random

from pyspark.sql import functions as F

from sluiceway.operators import deck
from sluiceway.plans import queries as Q


def allocate(slides, sections, total, title="{标题}"):
    """The outline page by page, in plain Python."""
    of = lambda kind: [s for s in slides if s[1] == kind]
    usable = [s for s in of("content") if 1 <= (s[2] or 0) <= 6]
    pool = sorted([s for s in usable if s[2] >= 2] or usable, key=lambda s: s[2])
    pages, n = [(of("cover")[0][0], "cover", title, None)], len(sections)
    fixed = 1 + len(of("closing")) + bool(of("toc")) + (n if of("section") else 0)
    if of("toc"):
        t = min(of("toc"), key=lambda s: abs((s[2] or 0) - n))
        pages.append((t[0], "toc", "目录", min(t[2] if t[2] is not None else n, n)))
    base, extra = divmod(max(total - fixed, n), n)
    taken = 0
    for i, name in enumerate(sections):
        if of("section"):
            pages.append((of("section")[i % len(of("section"))][0], "section", name, None))
        fit = [s for s in pool if (s[3] or 99) >= len(name)] or pool
        for _ in range(max(1, base + (i < extra))):
            s = fit[taken % len(fit)]
            pages.append((s[0], "content", name, s[2]))
            taken += 1
    if of("closing"):
        pages.append((of("closing")[0][0], "closing", "{致谢}", None))
    return pages[:total]


def written(spark):
    """One outline with text in its items."""
    item = lambda k: F.struct(F.concat(F.lit("要点"), k.cast("string")).alias("head"), F.when(k % 2 == 0, F.lit("说明 __ 文字")).otherwise(F.lit("")).alias("body"))
    n = F.coalesce("items", F.lit(0))
    items = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), item)).otherwise(F.array().cast("array<struct<head:string,body:string>>"))
    return Q.outline(spark).select("page", "src", "kind", "title", F.when(F.col("kind") == "cover", F.lit("副标题")).alias("subtitle"), items.alias("items"))


def test_allocate_matches_plain_python(spark):
    bare = [s for s in Q.SLIDES if s[1] not in ("section", "toc")]
    for slides, total in ((Q.SLIDES, 14), (Q.SLIDES, 30), (Q.SLIDES, 5), (bare, 12)):
        df = spark.createDataFrame(slides, "i int, kind string, items int, title_cap int")
        got = [(r.src, r.kind, r.title, r["items"]) for r in deck.allocate(df, Q.SECTIONS, total).orderBy("page").collect()]
        assert got == allocate(slides, Q.SECTIONS, total)


def test_cards_round_trip(spark):
    pages = written(spark)
    back = deck.parse_cards(deck.cards(pages)).select("page", "kind", "title", F.coalesce("subtitle", F.lit("")).alias("subtitle"), "items")
    want = pages.select("page", "kind", "title", F.coalesce("subtitle", F.lit("")).alias("subtitle"), "items")
    plain = lambda df: sorted((r.page, r.kind, r.title, r.subtitle, [("" if r.kind in ("cover", "closing") else i.head, "" if r.kind == "toc" else i.body) for i in r["items"]]) for r in df.collect())
    assert plain(back) == plain(want)


def test_outlines_of_many_decks_and_templates(spark):
    """As one outline after the other; slides of two templates in a table do not mix."""
    bare = [s for s in Q.SLIDES if s[1] not in ("section", "toc")]
    df = spark.createDataFrame([("full", *s) for s in Q.SLIDES] + [("bare", *s) for s in bare], "template string, i int, kind string, items int, title_cap int")
    asked = [(k, t, "{标题}", n, Q.SECTIONS[: k % 4]) for k, (t, n) in enumerate((t, n) for t in ("full", "bare", "gone") for n in (-1, 0, 1, 4, 14, 30))] + [(99, "full", "{标题}", 5, None)]
    got = deck.outlines(df, spark.createDataFrame(asked, "deck int, template string, title string, total int, sections array<string>"))
    by = {}
    for r in got.orderBy("deck", "page").collect():
        by.setdefault(r.deck, []).append((r.src, r.kind, r.title, r["items"]))
    for k, t, _, n, sections in asked:
        want = [] if t == "gone" or n < 1 else allocate(Q.SLIDES if t == "full" else bare, sections, n) if sections else None
        if want is not None:
            assert by.get(k, []) == want, (k, t, n)
    assert [x[1] for x in by[99]] == ["cover", "toc", "closing"]
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_rebuild_keeps_decks_apart(spark):
    """Two decks with the same pages take turns each for itself, of slides of their own template."""
    item = "array<struct<head:string,body:string>>"
    some = lambda n: [(f"h{k}", f"b{k}") for k in range(n)]
    slides = spark.createDataFrame([("a", *s) for s in Q.SLIDES] + [("b", 3, "content", 4, 99), ("b", 5, "content", 3, 99)], "template string, i int, kind string, items int, title_cap int")
    skeleton = spark.createDataFrame([(d, t, p, 4, "content", 3) for d, t in (("x", "a"), ("y", "a"), ("z", "b")) for p in (1, 2)], "deck string, template string, page int, src int, kind string, items int")
    parsed = spark.createDataFrame([(d, p, "content", "t", None, some(4)) for d in "xyz" for p in (1, 2)], f"deck string, page int, kind string, title string, subtitle string, items {item}")
    pages, errors = deck.rebuild(skeleton, parsed, slides)
    assert {(r.deck, r.page): r.src for r in pages.collect()} == {("x", 1): 6, ("x", 2): 10, ("y", 1): 6, ("y", 2): 10, ("z", 1): 3, ("z", 2): 3}
    assert errors.count() == 0


def test_indexes_of_two_templates(spark):
    """An index of two templates in one table is that of each."""
    rows = [(s, p, f"{'目录' if s == 1 and p == 0 else '01' if s == 2 and p == 0 else 'Text'} {s} {p}" if p else ["Cover", "目录", "01", "body", "Z"][s % 5], 18.0, p * 1_000_000, p * 600_000, 900_000, 400_000, False, "L", 10 * s + p) for s in range(5) for p in range(4)]
    schema = "slide int, pos int, text string, font_pt double, left long, top long, width long, height long, has_table boolean, layout string, sid int"
    one, two = spark.createDataFrame(rows, schema), spark.createDataFrame([r for r in rows if r[0] < 3], schema)
    both = one.withColumn("template", F.lit("one")).unionByName(two.withColumn("template", F.lit("two")))
    plain = lambda df: sorted(map(str, df.collect()))
    index = deck.index_slides(both)
    for name, df in (("one", one), ("two", two)):
        own = lambda x: x.where(F.col("template") == name).drop("template")  # noqa: B023, E731
        assert plain(own(index)) == plain(deck.index_slides(df))
        assert plain(own(deck.summary(index))) == plain(deck.summary(deck.index_slides(df)))
        assert plain(own(deck.slides_of(index))) == plain(deck.slides_of(deck.index_slides(df)))


def test_pairing_takes_the_nearest_free_head(spark):
    rng = random.Random(4)
    rows = [(s, p, rng.choice(["item_head", "item_body"]), rng.randrange(9_000_000), rng.randrange(6_000_000), 900_000, 500_000) for s in range(30) for p in range(8)]
    got = {(r.slide, r.pos): r.idx for r in deck.pair(spark.createDataFrame(rows, "slide int, pos int, role string, left long, top long, width long, height long")).collect()}
    want = {}
    for s in range(30):
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[4] // deck.BAND, r[3], r[1]))
        heads = [r for r in mine if r[2] == "item_head"]
        free, nxt = list(range(len(heads))), len(heads)
        for k, h in enumerate(heads):
            want[s, h[1]] = k
        for b in (r for r in mine if r[2] == "item_body"):
            if free:
                k = min(free, key=lambda k: ((heads[k][3] - b[3]) ** 2 + (heads[k][4] - b[4]) ** 2, k))
                free.remove(k)
            else:
                k, nxt = nxt, nxt + 1
            want[s, b[1]] = k
    assert got == want


def test_patch_with_an_invalid_op_changes_nothing(spark):
    pages = written(spark)
    ops = spark.createDataFrame([(1, 1, "title", "New"), (2, 99, "title", "x")], "ord int, page int, field string, value string")
    out, bad = deck.patch(pages, ops)
    assert [r.page for r in bad.collect()] == [99]
    assert sorted(r.title for r in out.collect()) == sorted(r.title for r in pages.collect())


def test_rebuild_realigns_pages(spark):
    item = "array<struct<head:string,body:string>>"
    skeleton = spark.createDataFrame([(1, 0, "cover", None), (2, 1, "toc", 3), (3, 4, "content", 3), (4, 4, "content", 3), (5, 4, "content", 3), (6, 5, "content", 5), (7, 5, "content", 5), (8, 11, "closing", None), (9, 6, "content", 4)], "page int, src int, kind string, items int")
    some = lambda n: [(f"h{k}", f"b{k}") for k in range(n)]
    card = [(1, "cover", "T", "S", []), (2, "toc", "目录", None, some(4)), (3, "content", "short", None, some(4)), (4, "content", "ten letter", None, some(4)), (5, "content", "a", None, some(4)), (6, "content", "b", None, some(2)), (7, "content", "c", None, some(7)), (8, "content", "x", None, []), (9, "content", "same", None, some(4))]
    pages, errors = deck.rebuild(skeleton, spark.createDataFrame(card, f"page int, kind string, title string, subtitle string, items {item}"), spark.createDataFrame(Q.SLIDES, "i int, kind string, items int, title_cap int"))
    got = {r.page: r for r in pages.collect()}
    # Slides of four items are 6 (titles up to 9) and 10 (up to 13): pages 3, 4, 5 take turns 0, 1, 2.
    assert {p: r.src for p, r in got.items()} == {1: 0, 2: 1, 3: 6, 4: 10, 5: 6, 6: 5, 9: 6}
    assert [tuple(x) for x in got[6]["items"]] == [*some(2), ("", ""), ("", ""), ("", "")]
    assert {r.page: r.error for r in errors.collect()} == {7: "too many items", 8: "kind differs"}


def test_rebuild_of_an_outlines_own_card(spark):
    back = deck.parse_cards(deck.cards(written(spark)))
    pages, errors = deck.rebuild(Q.outline(spark), back, Q.slides(spark))
    assert errors.count() == 0
    assert [tuple(r) for r in pages.select("page", "src", "kind", "title").orderBy("page").collect()] == [tuple(r) for r in Q.outline(spark).select("page", "src", "kind", "title").orderBy("page").collect()]
    again = deck.parse_cards(deck.cards(pages))
    assert again.exceptAll(back).count() == 0 and back.exceptAll(again).count() == 0
