"""Slide packages, template indexes, outlines and cards as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PACKAGE = 100 << 20
SLOT = T.StructType().add("sid", "integer").add("role", "string").add("sample", "string").add("cap", "integer").add("idx", "integer")
SLIDE = T.StructType().add("i", "integer").add("kind", "string").add("items", "integer").add("slots", T.ArrayType(SLOT))
INDEX = T.StructType().add("template", "string").add("source", "string").add("slides", T.ArrayType(SLIDE))
ITEM = T.StructType().add("head", "string").add("body", "string")
PAGE = T.StructType().add("src", "integer").add("kind", "string").add("title", "string").add("subtitle", "string").add("caps", T.MapType(T.StringType(), T.IntegerType())).add("items", T.ArrayType(ITEM))
OUTLINE = T.StructType().add("template", "string").add("title", "string").add("pages", T.ArrayType(PAGE))
SHAPES = "package string, slide int, pos int, sid int, text string, font_pt double, left long, top long, width long, height long, has_table boolean, layout string"
NS = {"a": "http://schemas.openxmlformats.org/drawingml/2006/main", "p": "http://schemas.openxmlformats.org/presentationml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def packages(spark: SparkSession, path: str) -> DataFrame:
    """(package, data) of the .pptx files under a path; of those over MAX_PACKAGE bytes data is null, which faults() reports as too_large."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.pptx").option("recursiveFileLookup", "true").load(path)
    small = df.where(F.col("length") <= MAX_PACKAGE).select(F.col("path").alias("package"), F.col("content").alias("data"))
    return small.unionByName(df.where(F.col("length") > MAX_PACKAGE).select(F.col("path").alias("package"), F.lit(None).cast("binary").alias("data")))


def acquire(packages_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages that are presentations, and (package, error) of those that aren't: too_large or invalid."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            errors = ["too_large" if d is None else None if _open(d) is not None else "invalid" for d in frame.data]
            yield pd.DataFrame({"package": frame.package, "error": errors})

    judged = packages_.mapInPandas(run, "package string, error string")
    return packages_.join(judged.where("error IS NULL").select("package"), "package", "left_semi"), judged.where("error IS NOT NULL")


def _open(data: bytes):
    """The package, or None if it is no zip archive with a presentation in it."""
    import io

    return None if data is None else opened(io.BytesIO(data))


def opened(file):
    """The package in a file, of which this reads the directory; None if it is none."""
    import zipfile

    try:
        z = zipfile.ZipFile(file)
        return z if "ppt/presentation.xml" in z.namelist() else None
    except zipfile.BadZipFile:
        return None


def _read(z, part: str):
    """A part's XML; None for broken XML and for one that declares entities."""
    import xml.etree.ElementTree as ET

    raw = z.read(part)
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        return None
    try:
        return ET.fromstring(raw)
    except ET.ParseError:
        return None


def _related(z, part: str, kind: str | None = None) -> dict[str, str]:
    """By id the parts that a part's relationships lead to, of one kind if given."""
    import posixpath

    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist() or (tree := _read(z, rels)) is None:
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join("/" + folder, r.get("Target", ""))).lstrip("/") for r in tree if r.get("TargetMode") != "External" and (kind is None or (r.get("Type") or "").endswith(f"/{kind}"))}


def _slides(z) -> list[str]:
    """The slides' parts in the presentation's order; those that it doesn't list follow by number."""
    import re

    by_number = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
    tree, parts = _read(z, "ppt/presentation.xml"), _related(z, "ppt/presentation.xml")
    listed = [parts.get(x.get(f"{{{NS['r']}}}id")) for x in tree.iterfind(".//p:sldIdLst/p:sldId", NS)] if tree is not None else []
    listed = [p for p in dict.fromkeys(listed) if p in by_number]
    return listed + [p for p in by_number if p not in listed]


def _layout(z, part: str) -> str:
    """The name of a slide's layout."""
    for p in _related(z, part, "slideLayout").values():
        if p in z.namelist() and (tree := _read(z, p)) is not None:
            own = tree.find("p:cSld", NS)
            return (own.get("name") or "") if own is not None else ""
    return ""


def _boxes(tree) -> list[tuple]:
    """(shape, left, top, width, height) of the shapes of a slide in document order; those of groups in the slide's own coordinates."""
    out: list[tuple] = []

    def walk(node, sx: float, sy: float, dx: float, dy: float) -> None:
        for x in node:
            if x.tag == f"{{{NS['p']}}}sp":
                off, ext = x.find("p:spPr/a:xfrm/a:off", NS), x.find("p:spPr/a:xfrm/a:ext", NS)
                left, top = (int(off.get("x")), int(off.get("y"))) if off is not None else (0, 0)
                w, h = (int(ext.get("cx")), int(ext.get("cy"))) if ext is not None else (0, 0)
                out.append((x, int(left * sx + dx), int(top * sy + dy), int(w * sx), int(h * sy)))
            elif x.tag == f"{{{NS['p']}}}grpSp":
                of = {k: x.find(f"p:grpSpPr/a:xfrm/a:{k}", NS) for k in ("off", "ext", "chOff", "chExt")}
                if any(v is None for v in of.values()):
                    walk(x, sx, sy, dx, dy)
                    continue
                num = lambda k, a: int(of[k].get(a))  # noqa: B023, E731
                gx = num("ext", "cx") / num("chExt", "cx") if num("chExt", "cx") else 1.0
                gy = num("ext", "cy") / num("chExt", "cy") if num("chExt", "cy") else 1.0
                walk(x, sx * gx, sy * gy, dx + sx * (num("off", "x") - gx * num("chOff", "x")), dy + sy * (num("off", "y") - gy * num("chOff", "y")))

    top = tree.find(".//p:spTree", NS)
    walk(tree if top is None else top, 1.0, 1.0, 0.0, 0.0)
    return out


def slide_rows(z, numbers: set[int] | None = None, layouts: bool = True) -> Iterator[tuple]:
    """A package's text boxes as SHAPES but for the package; of the given slides alone, without the layouts' names."""
    for number, part in enumerate(_slides(z), 1):
        if (numbers is not None and number not in numbers) or (tree := _read(z, part)) is None:
            continue
        table, layout = tree.find(".//a:tbl", NS) is not None, _layout(z, part) if layouts else None
        for pos, (sp, *size) in enumerate(_boxes(tree)):
            own = sp.find(".//p:cNvPr", NS)
            text = "\n".join("".join(t.text or "" for t in p.iterfind(".//a:t", NS)) for p in sp.iterfind(".//a:p", NS))
            if not text.strip():
                continue
            font = max((int(x.get("sz")) / 100 for x in sp.iter() if (x.get("sz") or "").isdigit()), default=0.0)
            yield (number, pos, int(own.get("id")) if own is not None else None, text, font, *size, table, layout)


def shapes(packages_: DataFrame) -> DataFrame:
    """The text boxes of each slide, those within groups too, in document order; slides are numbered from 1 in the presentation's order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(name, *row) for name, data in zip(frame.package, frame.data) if (z := _open(data)) is not None for row in slide_rows(z)]
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in SHAPES.split(", ")])

    return packages_.mapInPandas(run, SHAPES)


def relation_rows(z, rels: str) -> list[tuple] | None:
    """(part, rid, type, target, mode) of a part of relationships, targets normalised; None if it can't be read."""
    import posixpath

    owner = posixpath.join(posixpath.dirname(posixpath.dirname(rels)), posixpath.basename(rels)[:-5])
    if (tree := _read(z, rels)) is None:
        return None
    out = []
    for rel in tree:
        target, mode = rel.get("Target"), rel.get("TargetMode")
        if mode != "External":
            target = posixpath.normpath(posixpath.join("/" + posixpath.dirname(owner), target))
        out.append(("/" + owner, rel.get("Id"), rel.get("Type"), target, mode))
    return out


def relationships(packages_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parts (package, part), rels (package, part, rid, type, target, mode), used (package, part, rid)); targets are normalised."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for frame in frames:
            out = []
            for name, data in zip(frame.package, frame.data):
                if (z := _open(data)) is None:
                    out.append((name, "broken", None, None, None, None, None))
                    continue
                for part in z.namelist():
                    out.append((name, "part", "/" + part, None, None, None, None))
                    if part.endswith(".rels"):
                        if (rows := relation_rows(z, part)) is None:
                            out.append((name, "broken", "/" + part, None, None, None, None))
                            continue
                        out += [(name, "rel", *row) for row in rows]
                    elif part.endswith(".xml"):
                        for rid in sorted(set(re.findall(rb'\br:(?:id|embed|link|pict)="([^"]+)"', z.read(part)))):
                            out.append((name, "used", "/" + part, rid.decode(), None, None, None))
            yield pd.DataFrame(out, columns=["package", "kind", "part", "rid", "type", "target", "mode"])

    df = packages_.mapInPandas(run, "package string, kind string, part string, rid string, type string, target string, mode string")
    of = lambda kind, *cols: df.where(F.col("kind") == kind).select("package", *cols)
    return of("part", "part"), of("rel", "part", "rid", "type", "target", "mode"), of("used", "part", "rid")


def faults(packages_: DataFrame) -> DataFrame:
    """(package, part, fault): ``broken`` for XML that can't be parsed, ``unsafe`` for XML that declares entities; a package that is none has a null part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, data in zip(frame.package, frame.data):
                if (z := _open(data)) is None:
                    out.append((name, None, "too_large" if data is None else "broken"))
                    continue
                for part in z.namelist():
                    if part.endswith((".xml", ".rels")) and _read(z, part) is None:
                        raw = z.read(part)
                        out.append((name, "/" + part, "unsafe" if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw else "broken"))
            yield pd.DataFrame(out, columns=["package", "part", "fault"])

    return packages_.mapInPandas(run, "package string, part string, fault string")


def chart_data(packages_: DataFrame) -> DataFrame:
    """(package, part, rid): by which relationship each chart names its data."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for frame in frames:
            out = []
            for name, data in zip(frame.package, frame.data):
                z = _open(data)
                for part in z.namelist() if z else ():
                    if re.fullmatch(r"ppt/charts/chart\d+\.xml", part) and (tree := _read(z, part)) is not None:
                        out += [(name, "/" + part, e.get(f"{{{NS['r']}}}id")) for e in tree.iter() if e.tag.endswith("}externalData")]
            yield pd.DataFrame(out, columns=["package", "part", "rid"])

    return packages_.mapInPandas(run, "package string, part string, rid string")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(template, i, kind, items, slots) of template indexes in JSON."""
    return spark.read.schema(INDEX).json(path, multiLine=True).select("template", F.explode("slides").alias("s")).select("template", "s.*")


def tightest_caps(slides: DataFrame) -> DataFrame:
    """(template, i, caps): by role the smallest capacity of a slide's slots."""
    each = slides.select("template", "i", F.explode("slots").alias("x")).where("x.cap IS NOT NULL").groupBy("template", "i", "x.role").agg(F.min("x.cap").alias("cap"))
    return each.groupBy("template", "i").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "cap")))).alias("caps"))


def hints(slides: DataFrame) -> DataFrame:
    """(template, i, hints): samples of a slide's body slots by number."""
    body = F.filter("slots", lambda x: (x["role"] == "item_body") & x["idx"].isNotNull())
    return slides.select("template", "i", F.map_from_entries(F.transform(body, lambda x: F.struct(x["idx"], x["sample"]))).alias("hints"))


def outlines(spark: SparkSession, path: str) -> DataFrame:
    """(template, title, page, src, kind, ...) of outlines in JSON."""
    df = spark.read.schema(OUTLINE).json(path, multiLine=True)
    return df.select("template", F.col("title").alias("deck"), F.posexplode("pages").alias("page", "p")).select("template", "deck", (F.col("page") + 1).alias("page"), "p.*")


def cards(spark: SparkSession, path: str) -> DataFrame:
    """(card) for each page of card texts; what stands before the first and after the last separator is left out."""
    df = spark.read.text(path, wholetext=True)
    blocks = F.transform(F.split("value", r"(?m)^---\s*$"), F.trim)
    return df.select(F.explode(F.slice(blocks, 2, F.greatest(F.size(blocks) - 2, F.lit(0)))).alias("card"))


REGISTRY = T.MapType(T.StringType(), T.StructType().add("label", "string").add("source", "string").add("index", "string").add("aliases", T.ArrayType(T.StringType())).add("sections", T.ArrayType(T.StringType())))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(ord, key, label, source, index, aliases, sections) of a template registry in JSON, in its order."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", REGISTRY).alias("m"))
    return whole.select(F.posexplode(F.map_entries("m")).alias("ord", "x")).select("ord", F.col("x.key").alias("key"), "x.value.*")


def inspect(packages_: DataFrame) -> DataFrame:
    """(package, slides, masters, layouts, width, height, names, samples): counts, the layouts' names with their placeholders, and by slide its layout and first four texts, forty characters each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for frame in frames:
            out = []
            for name, data in zip(frame.package, frame.data):
                if (z := _open(data)) is None:
                    continue
                tree = _read(z, "ppt/presentation.xml")
                size = tree.find("p:sldSz", NS) if tree is not None else None
                layouts = sorted(n for n in z.namelist() if re.fullmatch(r"ppt/slideLayouts/slideLayout\d+\.xml", n))
                masters = [n for n in z.namelist() if re.fullmatch(r"ppt/slideMasters/slideMaster\d+\.xml", n)]
                names = []
                for n in layouts:
                    if (t := _read(z, n)) is not None:
                        own = t.find("p:cSld", NS)
                        marks = [f"{p.get('idx') or 0}:{p.get('type') or 'obj'}" for p in t.iterfind(".//p:nvPr/p:ph", NS)]
                        names.append(f"{own.get('name') if own is not None else ''} {' '.join(marks)}".strip())
                samples = []
                for part in _slides(z):
                    if (t := _read(z, part)) is not None:
                        texts = ["\n".join("".join(x.text or "" for x in p.iterfind(".//a:t", NS)) for p in sp.iterfind(".//a:p", NS)).strip() for sp in t.iterfind(".//p:sp", NS)]
                        samples.append(f"{_layout(z, part)}: {' / '.join([x.replace(chr(10), ' | ')[:40] for x in texts if x][:4])}")
                out.append((name, len(_slides(z)), len(masters), len(layouts), int(size.get("cx")) if size is not None else None, int(size.get("cy")) if size is not None else None, names, samples))
            yield pd.DataFrame(out, columns=["package", "slides", "masters", "layouts", "width", "height", "names", "samples"])

    return packages_.mapInPandas(run, "package string, slides int, masters int, layouts int, width long, height long, names array<string>, samples array<string>")


def card_texts(spark: SparkSession, path: str) -> DataFrame:
    """(card, text) of whole card files, for deck.read_cards()."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("card"), F.col("value").alias("text"))
