"""Slide packages put together from a template's slides and the texts of their slots."""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from xml.dom import minidom
from xml.parsers.expat import ExpatError
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decks import NS, _open, _read, _slides

#: Decks of one template that a task builds with it at hand.
DEAL = 64
#: Slides with places for texts that a task keeps.
FORMS = 512
#: Bytes of packages that a task gives at once, but for a package that is larger.
FLUSH = 1 << 22
# Fixed values of the package format.
PRESENTATION, TYPES = "ppt/presentation.xml", "[Content_Types].xml"
REL_NS = "http://schemas.openxmlformats.org/package/2006/relationships"
SLIDE_REL = f"{NS['r']}/slide"
NUMBERED = re.compile(r"(.*?)(\d+)(\.[^.]+)")
ILLEGAL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
#: Slides made of one slide share these; of all else each gets a copy, as charts and tags belong to one slide.
SHARED = ("image", "video", "audio", "media", "slideLayout", "slideMaster", "theme", "notesMaster")
DEPTH = 4


def _rels(part: str) -> str:
    folder, name = posixpath.split(part)
    return posixpath.join(folder, "_rels", f"{name}.rels")


def _kind(type_: str) -> str:
    return type_.rsplit("/", 1)[-1]


def _elements(node, ns: str, name: str) -> list:
    return [x for x in node.childNodes if x.nodeType == x.ELEMENT_NODE and x.namespaceURI == ns and x.localName == name]


def _make(like, name: str):
    """A new element of like's namespace and prefix."""
    return like.ownerDocument.createElementNS(like.namespaceURI, f"{like.prefix}:{name}" if like.prefix else name)


def _legal(text: str) -> str:
    return ILLEGAL.sub(lambda m: f"_x{ord(m[0]):04X}_", text)


def _put(shape, text: str) -> None:
    """Puts text into a shape's first paragraph, in the style of its first run; other runs and paragraphs go."""
    for body in _elements(shape, NS["p"], "txBody"):
        paragraphs = _elements(body, NS["a"], "p")
        if not paragraphs:
            continue
        p = paragraphs[0]
        for x in paragraphs[1:]:
            body.removeChild(x)
        runs = _elements(p, NS["a"], "r")
        for x in runs[1:]:
            p.removeChild(x)
        run = runs[0] if runs else p.insertBefore(_make(p, "r"), next(iter(_elements(p, NS["a"], "endParaRPr")), None))
        for x in _elements(run, NS["a"], "t"):
            run.removeChild(x)
        t = run.appendChild(_make(p, "t"))
        t.appendChild(p.ownerDocument.createTextNode(text))


class Builder:
    """A template's parts and relationships. deck() puts packages together and leaves the template as it is."""

    def __init__(self, data: bytes):
        z = _open(data)
        if z is None:
            raise ValueError("invalid template")
        self.raw = {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
        if TYPES not in self.raw or any(_read(z, n) is None for n in (PRESENTATION, TYPES)):
            raise ValueError("invalid template")
        self.forms: dict[tuple, tuple[list[str], frozenset[str]]] = {}
        self.slides = _slides(z)
        self.broken = {p for p in self.slides if _read(z, p) is None}
        self.rels = {p: self._relations(z, p) for p in ["", *self.raw] if _rels(p) in self.raw}
        self.types = {x.getAttribute("PartName").lstrip("/"): x.getAttribute("ContentType") for x in minidom.parseString(self.raw[TYPES]).documentElement.childNodes if x.nodeType == x.ELEMENT_NODE and x.localName == "Override"}

    @staticmethod
    def _relations(z, part: str) -> list[tuple[str, str, str, bool]]:
        """(id, type, target, whether it is external) of a part's relationships; targets within the package as its parts' names."""
        tree, out = _read(z, _rels(part)), []
        for r in tree if tree is not None else ():
            target, away = r.get("Target", ""), r.get("TargetMode") == "External"
            if not away:
                target = posixpath.normpath(posixpath.join("/" + posixpath.dirname(part), target)).lstrip("/")
            out.append((r.get("Id", ""), r.get("Type", ""), target, away))
        return out

    def deck(self, pages: list[tuple[int, dict[int, str]]]) -> bytes:
        """A package of one slide for each (slide of the template from 0, text by shape id)."""
        raw, rels, types = dict(self.raw), dict(self.rels), dict(self.types)
        numbers: dict[tuple[str, str], int] = {}
        for n in self.raw:
            if m := NUMBERED.fullmatch(n):
                numbers[m[1], m[3]] = max(numbers.get((m[1], m[3]), 0), int(m[2]))

        def name(like: str) -> str:
            m = NUMBERED.fullmatch(like)
            numbers[m[1], m[3]] += 1
            return f"{m[1]}{numbers[m[1], m[3]]}{m[3]}"

        made = [(self.slides[src], name(self.slides[src]), texts) for src, texts in pages]
        first: dict[str, str] = {}
        for src, new, _ in made:
            first.setdefault(src, new)

        def related(part: str, copies: dict[str, str], depth: int, used: frozenset[str] | None = None) -> list[tuple[str, str, str, bool]]:
            out = []
            for rid, type_, target, away in self.rels.get(part, []):
                if used is not None and rid not in used and _kind(type_) not in ("slideLayout", "diagramDrawing"):
                    continue
                if _kind(type_) == "slide" and not away:
                    target = copies.get(target) or first.get(target)
                    if target is None:
                        continue
                elif not away and not _kind(type_).startswith(SHARED):
                    target = copy(target, copies, depth)
                out.append((rid, type_, target, away))
            return out

        def copy(part: str, copies: dict[str, str], depth: int) -> str:
            if part in copies:
                return copies[part]
            if part not in raw or depth > DEPTH or not NUMBERED.fullmatch(part):
                return part
            copies[part] = new = name(part)
            raw[new] = raw[part]
            if part in types:
                types[new] = types[part]
            if part in self.rels:
                rels[new] = related(part, copies, depth + 1)
            return new

        for src, new, texts in made:
            raw[new], used = self._slide(src, texts, set(first))
            rels[new] = related(src, {src: new}, 0, used)
            if src in types:
                types[new] = types[src]
        ids = {rid for rid, *_ in rels.get(PRESENTATION, [])}
        fresh = (f"rId{k}" for k in range(1, len(ids) + len(made) + 1) if f"rId{k}" not in ids)
        listed = [(next(fresh), new) for _, new, _ in made]
        # The views' state names slides of the template.
        rels[PRESENTATION] = [r for r in rels.get(PRESENTATION, []) if _kind(r[1]) not in ("slide", "viewProps")] + [(rid, SLIDE_REL, new, False) for rid, new in listed]
        raw[PRESENTATION] = self._presentation([rid for rid, _ in listed])
        return self._zip(raw, rels, types)

    def _slide(self, part: str, texts: dict[int, str], present: set[str]) -> tuple[bytes, frozenset[str]]:
        """A slide's shapes with new texts, and the ids of relationships that they use. Links to slides that the deck doesn't have go."""
        lost = frozenset(rid for rid, type_, target, away in self.rels.get(part, []) if _kind(type_) == "slide" and not away and target not in present)
        key = part, frozenset(texts), lost
        if key not in self.forms:
            if len(self.forms) >= FORMS:
                self.forms.clear()
            self.forms[key] = self._form(*key)
        pieces, used = self.forms[key]
        # Every second piece is a shape's id, in whose place the text goes.
        whole = "".join(escape(_legal(texts[int(x)])) if k % 2 else x for k, x in enumerate(pieces))
        return whole.encode("UTF-8", "xmlcharrefreplace"), used

    def _form(self, part: str, sids: frozenset[int], lost: frozenset[str]) -> tuple[list[str], frozenset[str]]:
        """A slide as text between the ids of the shapes that get new texts, and the ids of relationships that it uses: the same for all decks."""
        mark = uuid.uuid4().hex
        doc = minidom.parseString(self.raw[part])
        root = doc.documentElement
        for x in list(root.childNodes):
            if x.nodeType != x.ELEMENT_NODE or x.localName not in ("cSld", "clrMapOvr"):
                root.removeChild(x)
        for c in _elements(root, NS["p"], "cSld"):
            for x in list(c.childNodes):
                if x.nodeType != x.ELEMENT_NODE or x.localName != "spTree":
                    c.removeChild(x)
        for sp in root.getElementsByTagNameNS(NS["p"], "sp"):
            for own in sp.getElementsByTagNameNS(NS["p"], "cNvPr")[:1]:
                sid = own.getAttribute("id")
                if sid.isdigit() and int(sid) in sids:
                    _put(sp, f"{mark}:{int(sid)};")
        used: set[str] = set()
        for x in root.getElementsByTagName("*"):
            ids = {a.value for a in x.attributes.values() if a.namespaceURI == NS["r"]}
            if ids & lost:
                x.parentNode.removeChild(x)
            else:
                used |= ids
        return re.split(f"{mark}:(\\d+);", doc.toxml("UTF-8", standalone=True).decode("UTF-8")), frozenset(used)

    def _presentation(self, ids: list[str]) -> bytes:
        """The presentation with the slides of these relationships. Sections and custom shows, which name slides of the template, go."""
        doc = minidom.parseString(self.raw[PRESENTATION])
        root = doc.documentElement
        least = 256
        for x in _elements(root, NS["p"], "custShowLst") + _elements(root, NS["p"], "sldIdLst"):
            least = max([least, *(int(s.getAttribute("id")) + 1 for s in _elements(x, NS["p"], "sldId") if s.getAttribute("id").isdigit())])
            root.removeChild(x)
        for x in root.getElementsByTagName("*"):
            if x.localName == "sectionLst":
                ext = x.parentNode
                ext.parentNode.removeChild(ext)
        if ids:
            made = _make(root, "sldIdLst")
            made.setAttribute("xmlns:r", NS["r"])
            for k, rid in enumerate(ids):
                one = made.appendChild(_make(root, "sldId"))
                one.setAttribute("id", str(least + k))
                one.setAttributeNS(NS["r"], "r:id", rid)
            ahead = [x for x in root.childNodes if x.nodeType == x.ELEMENT_NODE and x.localName in ("sldMasterIdLst", "notesMasterIdLst", "handoutMasterIdLst")]
            root.insertBefore(made, ahead[-1].nextSibling if ahead else root.firstChild)
        return doc.toxml("UTF-8", standalone=True)

    def _zip(self, raw: dict[str, bytes], rels: dict[str, list], types: dict[str, str]) -> bytes:
        """The parts that the package's relationships reach. The same parts give the same bytes."""
        todo = [""] if "" in rels else [PRESENTATION]
        reached = dict.fromkeys(todo)
        for part in todo:
            for _, _, target, away in rels.get(part, []):
                if not away and target in raw and target not in reached:
                    reached[target] = None
                    todo.append(target)
        reached.setdefault(PRESENTATION)
        doc = minidom.parseString(raw[TYPES])
        root = doc.documentElement
        for x in list(root.childNodes):
            if x.nodeType == x.ELEMENT_NODE and x.localName == "Override":
                root.removeChild(x)
        for part in sorted(p for p in types if p in reached):
            x = root.appendChild(_make(root, "Override"))
            x.setAttribute("PartName", "/" + part)
            x.setAttribute("ContentType", types[part])
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            put = lambda n, b: z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), b, zipfile.ZIP_DEFLATED)
            put(TYPES, doc.toxml("UTF-8", standalone=True))
            for part in reached:
                if part:
                    put(part, raw[part])
                if rels.get(part):
                    put(_rels(part), self._written(part, rels[part]))
        return out.getvalue()

    def _written(self, part: str, rels: list[tuple[str, str, str, bool]]) -> bytes:
        if self.rels.get(part) == rels:
            return self.raw[_rels(part)]
        doc = minidom.getDOMImplementation().createDocument(REL_NS, "Relationships", None)
        doc.documentElement.setAttribute("xmlns", REL_NS)
        for rid, type_, target, away in rels:
            x = doc.documentElement.appendChild(doc.createElementNS(REL_NS, "Relationship"))
            x.setAttribute("Id", rid)
            x.setAttribute("Type", type_)
            x.setAttribute("Target", target if away else posixpath.relpath("/" + target, "/" + posixpath.dirname(part)))
            if away:
                x.setAttribute("TargetMode", "External")
        return doc.toxml("UTF-8", standalone=True)


def build(pages: DataFrame, filled: DataFrame, templates: DataFrame, first: int = 0) -> DataFrame:
    """(deck, data, error): a package for each deck, or why there is none.

    pages: (deck, package, page, src); filled: (deck, page, sid, text), as deck.fill() gives; templates: (package, data);
    ``first`` is the number of a template's first slide: 0 in indexes as JSON, 1 in those of decks.shapes().

    A deck has its pages in their order, each the shapes of its slide, with the layout's background. Images and media are
    shared; charts, tags and whatever else belongs to a slide is copied with all that it leads to. Notes, comments, timing
    and transitions stay behind. Links to other slides lead to the first page made of that slide, and go if there is none.
    The template's own slides are no part of the deck.

    Defined results: a slot without a row keeps its text, a null text is empty; of pages with one number that with the
    largest src counts; a page whose slide the template doesn't have, a template that is missing, no package or broken give
    an error and no package; a null deck is a deck. A template is opened once for DEAL of its decks, however many it has.
    """
    texts = F.struct("sid", F.coalesce("text", F.lit("")).alias("text"))
    rows = pages.select("deck", "package", F.col("page").cast("int").alias("page"), F.col("src").cast("int").alias("src"), F.lit(None).cast("struct<sid:int,text:string>").alias("slot"))
    slots = filled.where("sid IS NOT NULL").select("deck", F.lit(None).cast("string").alias("package"), F.col("page").cast("int").alias("page"), F.lit(None).cast("int").alias("src"), texts.cast("struct<sid:int,text:string>").alias("slot"))
    per = rows.unionByName(slots).groupBy("deck", "page").agg(F.max("package").alias("package"), F.max("src").alias("src"), F.sort_array(F.collect_list("slot")).alias("slots"), F.count_if(F.col("slot").isNull()).alias("given"))
    decks = per.where("given > 0").groupBy("deck").agg(F.max("package").alias("package"), F.sort_array(F.collect_list(F.struct("page", "src", "slots"))).alias("pages"))
    deals = decks.where("package IS NOT NULL").groupBy("package").agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias("deals"))
    shape = decks.schema["pages"].dataType.simpleString()
    ahead = templates.join(deals, "package").select("package", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(0).alias("side"), "data", F.lit(None).cast("string").alias("deck"), F.lit(None).cast(shape).alias("pages"))
    dealt = decks.join(deals, "package", "left").select("package", F.coalesce(F.pmod(F.xxhash64("deck"), F.col("deals")), F.lit(0)).cast("int").alias("deal"), F.lit(1).alias("side"), F.lit(None).cast("binary").alias("data"), F.col("deck").cast("string").alias("deck"), "pages")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, builder, error = None, None, ""
        rows, size = [], 0
        for frame in frames:
            for package, deal, side, data, deck, pages_ in frame.itertuples(index=False):
                if side == 0:
                    now, builder, error = (package, deal), None, "no template"
                    try:
                        builder = Builder(data)
                    except (ValueError, KeyError, RuntimeError, zipfile.BadZipFile, zlib.error, ExpatError) as e:
                        error = str(e) or "invalid template"
                    continue
                if now != (package, deal):
                    now, builder, error = (package, deal), None, "no template"
                out, why = None, error
                if builder is not None:
                    wanted = [-1 if pd.isna(p["src"]) else int(p["src"]) - first for p in pages_]  # None and nan alike
                    lost = [p["src"] for p, k in zip(pages_, wanted) if not 0 <= k < len(builder.slides) or builder.slides[k] in builder.broken]
                    if lost:
                        why = f"no slide {'given' if pd.isna(lost[0]) else int(lost[0])}"
                    else:
                        out, why = builder.deck([(k, {int(s["sid"]): s["text"] for s in p["slots"]}) for p, k in zip(pages_, wanted)]), None
                rows.append((deck, out, why))
                size += len(out or b"")
                if size >= FLUSH or len(rows) >= DEAL:
                    yield pd.DataFrame(rows, columns=["deck", "data", "error"])
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["deck", "data", "error"])

    # One template is at hand in a task at a time: its row comes ahead of its decks. Keys are strings there, for pandas makes numbers next to nulls floats.
    spark = pages.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = ahead.unionByName(dealt).repartition(4 * parts, "package", "deal").sortWithinPartitions("package", "deal", "side")
    made = both.select("package", "deal", "side", "data", "deck", "pages").mapInPandas(run, "deck string, data binary, error string")
    return made.withColumn("deck", F.col("deck").cast(decks.schema["deck"].dataType))


def zipped(parts: DataFrame, key: str = "deck") -> DataFrame:
    """(key, data): packages of parts (key, part, data), those of one key by name. The same parts give the same bytes; of parts of one name one counts."""
    names = F.struct("part", "data")
    per = parts.where("part IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_set(names)).alias("parts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for found in frame.parts:
                whole = io.BytesIO()
                with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
                    for part, data in {p["part"]: p["data"] for p in found}.items():
                        z.writestr(zipfile.ZipInfo(part, (1980, 1, 1, 0, 0, 0)), b"" if data is None else bytes(data), zipfile.ZIP_DEFLATED)
                out.append(whole.getvalue())
            yield pd.DataFrame({key: frame[key], "data": out})

    return per.mapInPandas(run, parts.select(key).withColumn("data", F.lit(None).cast("binary")).schema)


def save(built: DataFrame, folder: str) -> None:
    """Writes each deck that build() gave as a .pptx file into a folder that all executors mount; a file is there whole or not at all, and a task run again writes the same."""

    def run(rows: Iterator) -> None:
        import os
        import uuid

        from .slides import file_name

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(r["data"])
            os.replace(part, os.path.join(folder, f"{file_name(r['deck'])}.pptx"))

    built.where("data IS NOT NULL").select("deck", "data").foreachPartition(run)
