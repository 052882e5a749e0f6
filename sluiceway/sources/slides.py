"""Slide packages as a data source: ``spark.read.format("slides")`` and ``df.write.format("slides")``.

Reading. The ``table`` option says which rows: shapes (the text boxes, as decks.shapes()), parts, relationships or packages.
Files are dealt over partitions by size. A task reads a package's central directory and then only those parts whose
contents the wanted columns and options call for: give the columns as a schema, as in
``spark.read.format("slides").schema("package string, slide int, text string").load(path)``. Without ``layout`` no
layouts and relationships are read, without ``data`` no part at all. The options slide, part and package (one, or several
between ``|``) leave other slides, parts and files unread. They are options because filters that Spark offers to a Python
source stay with the relation: a second query on the same DataFrame would see the first one's.

Writing. Rows of (deck, data) become files in three steps: a task writes its files to a folder of its own attempt,
the driver moves the folders of the attempts that count to their places (a rename for each partition), and what else
was begun is deleted. So a task that failed or ran twice leaves no file.

Defined results: packages over MAX_PACKAGE bytes and those that are none have no shapes, parts or relationships, and are
errors in the table ``packages``; names that begin with ``_`` or ``.`` are not read; a null deck is called output, null
data is no file; decks of one name in a partition are numbered; an empty folder has no rows. Paths are those that pyarrow
opens (local, s3, gs, hdfs); for others there is decks.packages(), which reads whole files.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import decks

TABLES = {
    "shapes": decks.SHAPES,
    "parts": "package string, part string, size long, data binary",
    "relationships": "package string, part string, rid string, type string, target string, mode string",
    "packages": "package string, size long, slides int, error string, bytes_read long",
}
#: Bytes of files in a partition at most, but for a file that is larger; what opening a file counts as.
PARTITION, OPEN = 64 << 20, 1 << 20
#: Rows in a batch.
ROWS = 1024


def filesystem(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Ranged(io.RawIOBase):
    """A file that is read in ranges, and counts them."""

    def __init__(self, file):
        self.file, self.count = file, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        place = at + (0, self.file.tell(), self.file.size())[whence]
        if place < 0:
            raise OSError("before the file's start")
        self.file.seek(place)
        return place

    def tell(self) -> int:
        return self.file.tell()

    def read(self, n: int = -1) -> bytes:
        data = self.file.read(None if n is None or n < 0 else n)
        self.count += len(data)
        return data


@dataclass
class Files(InputPartition):
    files: tuple = ()


def deal(files: list[tuple[str, int]], limit: int, least: int) -> list[list[tuple[str, int]]]:
    """Files in partitions of up to limit bytes, or of less, so that there are about ``least`` of them; the largest first, each to the first that has room."""
    cost = lambda f: f[1] + OPEN
    room = min(limit, max(OPEN, -(-sum(map(cost, files)) // max(1, least))))
    out: list[list] = []
    open_: list[tuple[int, int]] = []  # (bytes, partition) of those with room, not too many to look through
    for f in sorted(files, key=lambda f: (-f[1], f[0])):
        k = next((i for i, (n, _) in enumerate(open_) if n + cost(f) <= room), None)
        if k is None:
            open_.append((cost(f), len(out)))
            out.append([f])
            open_ = open_[-32:]
        else:
            n, at = open_[k]
            out[at].append(f)
            open_[k] = (n + cost(f), at)
    return out


class SlideReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.table = options.get("table", "shapes")
        of = lambda name, kind: {kind(x) for x in options[name].split("|")} if options.get(name) else None
        self.slides, self.parts, self.packages = of("slide", int), of("part", str), of("package", str)
        #: Bytes this process has read.
        self.count = 0

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        found = []
        for path in self.options["path"].split(","):
            store, base = filesystem(path)
            one = store.get_file_info(base)
            infos = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
            for x in infos:
                inner = x.path[len(base) :].split("/") if x is not one else [""]
                if x.type == fs.FileType.File and x.path.endswith(".pptx") and not any(n.startswith(("_", ".")) for n in inner):
                    name = x.path if "://" not in path else path.split("://")[0] + "://" + x.path
                    if self.packages is None or name in self.packages:
                        found.append((name, x.size))
        return [Files(tuple(p)) for p in deal(found, int(self.options.get("partitionbytes", PARTITION)), int(self.options.get("partitions", 8)))]

    def read(self, partition: Files):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        names, rows = self.schema.fieldNames(), []
        arrow = to_arrow_schema(self.schema)
        known = [c.split(" ")[0] for c in TABLES[self.table].split(", ")]
        if missing := set(names) - set(known):
            raise ValueError(f"the table {self.table} has no {', '.join(sorted(missing))}")

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, arrow.types)], schema=arrow)

        for path, size in partition.files:
            for row in self.package(path, size, set(names)):
                rows.append(row)
                if len(rows) == ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()

    def package(self, path: str, size: int, names: set[str]) -> Iterator[dict]:
        """One package's rows, with the values that names call for."""
        if size > decks.MAX_PACKAGE:
            if self.table == "packages":
                yield {"package": path, "size": size, "error": "too_large", "bytes_read": 0}
            return
        store, inner = filesystem(path)
        with store.open_input_file(inner) as file:
            ranged = Ranged(file)
            z = decks.opened(ranged)
            try:
                if self.table == "packages":
                    slides = len(decks._slides(z)) if z is not None and "slides" in names else None
                    yield {"package": path, "size": size, "slides": slides, "error": None if z is not None else "invalid", "bytes_read": ranged.count}
                elif z is not None:
                    for row in getattr(self, f"_{self.table}")(path, z, names):
                        yield {"package": path, **row}
            finally:
                self.count += ranged.count

    def _shapes(self, path: str, z, names: set[str]) -> Iterator[dict]:
        columns = [c.split(" ")[0] for c in decks.SHAPES.split(", ")][1:]
        for row in decks.slide_rows(z, self.slides, "layout" in names):
            yield dict(zip(columns, row))

    def _parts(self, path: str, z, names: set[str]) -> Iterator[dict]:
        for x in z.infolist():
            part = "/" + x.filename
            if not x.is_dir() and (self.parts is None or part in self.parts):
                yield {"part": part, "size": x.file_size, "data": z.read(x) if "data" in names else None}

    def _relationships(self, path: str, z, names: set[str]) -> Iterator[dict]:
        for part in z.namelist():
            if part.endswith(".rels"):
                for row in decks.relation_rows(z, part) or ():
                    yield dict(zip(("part", "rid", "type", "target", "mode"), row))


@dataclass
class Written(WriterCommitMessage):
    stage: str
    place: str
    files: int


class SlideWriter(DataSourceArrowWriter):
    """Writes to folders of attempts, which commit() moves to their places."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        import uuid

        if not {"deck", "data"} <= set(schema.fieldNames()):
            raise ValueError("rows of slide packages have the columns deck and data")
        self.path, self.names, self.overwrite, self.job = path, schema.fieldNames(), overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        import uuid

        from pyspark import TaskContext

        store, base = filesystem(self.path)
        number = TaskContext.get().partitionId() if TaskContext.get() else 0
        stage, used, files = f"{base}/_temporary/{self.job}/{uuid.uuid4().hex}", {}, 0
        for batch in iterator:
            for deck, data in zip(batch.column(self.names.index("deck")).to_pylist(), batch.column(self.names.index("data"))):
                if not data.is_valid:
                    continue
                if not files:
                    store.create_dir(stage)
                name = file_name(deck)
                used[name] = used.get(name, 0) + 1
                with store.open_output_stream(f"{stage}/{name}{f'-{used[name]}' if used[name] > 1 else ''}.pptx") as f:
                    f.write(data.as_buffer())
                files += 1
        return Written(stage, f"part-{number:05d}-{self.job}", files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, base = filesystem(self.path)
        before = [x.path for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.base_name.startswith("part-")]
        store.create_dir(base)
        for m in messages:
            if m is not None and m.files:
                store.move(m.stage, f"{base}/{m.place}")
        for x in before if self.overwrite else ():
            store.delete_dir(x)
        self._clear(store, base)

    def abort(self, messages) -> None:
        self._clear(*filesystem(self.path))

    def _clear(self, store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{base}/_temporary/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/_temporary/{self.job}")
        if store.get_file_info(f"{base}/_temporary").type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(f"{base}/_temporary")):
            store.delete_dir(f"{base}/_temporary")


def file_name(deck) -> str:
    """A deck's name as a file's; of long names a hash tells which is which."""
    from urllib.parse import quote

    name = quote("output" if deck is None else str(deck), safe=" ")
    if name.startswith((".", "_")):
        name = f"%{ord(name[0]):02X}{name[1:]}"
    return name if len(name) <= 200 else f"{name[:160]}-{hashlib.sha256(name.encode()).hexdigest()[:32]}"


class Slides(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slides"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "shapes")]

    def reader(self, schema: StructType) -> SlideReader:
        return SlideReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> SlideWriter:
        return SlideWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Slides)
