"""Page description files as tables: a data source, the same over bytes that Spark has read, and a writer.

``what`` chooses the table: ``pages`` (sizes and texts), ``glyphs`` (letters, boxes, styles) or
``objects`` (paths, rectangles, pictures; the shape of a path is its points, with a pair of NaN before each further piece). What cannot be read is a row with its error, for a file or a page.
"""

from __future__ import annotations

import fnmatch
import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from pagequarry.sources.page_content import Reading, read
from pagequarry.sources.page_objects import PageFile, PageFileError

TABLES = {
    "pages": "path string, page int, width double, height double, turn int, text string, error string",
    "glyphs": "path string, page int, idx long, ch string, l double, t double, r double, b double, size double, font string, bold boolean, italic boolean, colour int, hidden boolean, mark int, error string",
    "objects": "path string, page int, idx long, kind string, l double, t double, r double, b double, fill int, line int, width double, depth int, mark int, rule string, shape array<double>, error string",
}
#: Bytes of a file that one partition is meant for, and rows of a batch.
PARTITION_BYTES, ROWS = 16 << 20, 8192
#: What all letters of a stretch share.
STYLE = ("size", "font", "bold", "italic", "colour", "hidden", "mark")
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def columns_of(what: str) -> dict[str, pa.DataType]:
    return {name: _KINDS[kind] for name, kind in (x.split() for x in TABLES[what].split(", "))}


def rows(path: str, content: bytes, what: str, wanted: set[str], nth: int = 0, of: int = 1, pages: tuple[float, float] = (0, math.inf)) -> Iterator[dict]:
    """The rows of one file, as ``found_in`` has them."""
    for row in found_in(path, content, what, wanted, nth, of, pages):
        if isinstance(row, pa.RecordBatch):
            yield from ({k: v for k, v in x.items() if k != "error"} for x in row.to_pylist())
        else:
            yield row


def found_in(path: str, content: bytes, what: str, wanted: set[str], nth: int = 0, of: int = 1, pages: tuple[float, float] = (0, math.inf)) -> Iterator[dict | pa.RecordBatch]:
    """The rows of one file, a page's letters as one batch or several: of its ``nth`` part of ``of``, pages within bounds, with the columns that are wanted."""
    try:
        file = PageFile(content)
        found = list(file.pages())
    except (PageFileError, ValueError, TypeError, AttributeError, RecursionError) as e:
        if nth == 0:
            yield {"path": path, "error": str(e) if isinstance(e, PageFileError) else f"format: {type(e).__name__}: {e}"}
        return
    texts = what == "glyphs" or (what == "pages" and "text" in wanted)
    for number in range(nth * len(found) // of, (nth + 1) * len(found) // of):
        if not pages[0] <= number <= pages[1]:
            continue
        page, at = found[number], {"path": path, "page": number}
        if what == "pages" and not texts and "error" not in wanted:  # sizes alone: no content is run
            turned = page.turn % 2
            wide, tall = page.box[2] - page.box[0], page.box[3] - page.box[1]
            yield at | {"width": float(tall if turned else wide), "height": float(wide if turned else tall), "turn": page.turn}
            continue
        try:
            seen = read(file, page, texts)
        except PageFileError as e:
            yield at | {"error": str(e)}
            continue
        if what == "glyphs":
            yield from glyphs(at, seen, wanted)
        elif what == "pages":
            yield at | {"width": float(seen.width), "height": float(seen.height), "turn": page.turn, "text": seen.text_of() if texts else None}
        else:
            names = [x for x in columns_of(what) if x not in ("path", "page", "idx", "error")]
            for i, row in enumerate(seen.objects):
                yield at | {"idx": i} | dict(zip(names, row, strict=True))


def glyphs(at: dict, seen: Reading, wanted: set[str]) -> Iterator[pa.RecordBatch]:
    """A page's letters by columns, of those that are wanted."""
    parts = list(seen.parts())
    sizes = [len(letters) for letters, _, _ in parts]
    n, columns = sum(sizes), {c: t for c, t in columns_of("glyphs").items() if c in wanted}
    if not n:
        return
    part = np.repeat(np.arange(len(parts)), sizes)
    nowhere = np.array([places is None for _, places, _ in parts])[part]
    boxes = np.concatenate([np.zeros((1, 4)) if places is None else places for _, places, _ in parts])
    out = []
    for c, t in columns.items():
        if c in "ltrb":
            out.append(pa.array(boxes[:, "ltrb".index(c)], t, mask=nowhere))
        elif c == "idx":
            out.append(pa.array(np.arange(n), t))
        elif c == "ch":
            out.append(pa.array([x for letters, _, _ in parts for x in letters], t))
        elif c in STYLE:
            out.append(pa.array([style[STYLE.index(c)] for _, _, style in parts], t).take(pa.array(part)))
        else:
            out.append(pa.nulls(n, t) if at.get(c) is None else pa.repeat(pa.scalar(at[c], t), n))
    whole = pa.RecordBatch.from_arrays(out, list(columns))
    yield from (whole.slice(i, ROWS) for i in range(0, n, ROWS))


def batches(found: Iterable[dict | pa.RecordBatch], columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in held], t) for c, t in columns.items()], list(columns))
        held.clear()
        return out

    for row in found:
        if isinstance(row, pa.RecordBatch):
            if held:
                yield batch()
            yield row
            continue
        held.append(row)
        if len(held) >= ROWS:
            yield batch()
    if held:
        yield batch()


def read_files(files: DataFrame, what: str = "pages", only: list[str] | None = None) -> DataFrame:
    """The table of ``files`` (``path``, ``content``), wherever Spark has read them from; ``only`` names the columns that are wanted."""
    columns = {c: t for c, t in columns_of(what).items() if only is None or c in only}
    schema = ", ".join(x for x in TABLES[what].split(", ") if x.split()[0] in columns)

    def run(parts):
        for part in parts:
            for path, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                yield from batches(found_in(path, content.as_py() or b"", what, set(columns)), columns)

    return files.select("path", "content").mapInArrow(run, schema)


@dataclass
class Part(InputPartition):
    """One range of a file's pages."""

    path: str
    nth: int
    of: int


class PageFiles(DataSource):
    """``spark.read.format("pagefiles").option("what", ...).load(path)``.

    Options: ``what`` (pages, glyphs, objects), ``pattern`` for file names, ``partitionbytes``: a larger file
    is read in several partitions, each a range of its pages. A schema with fewer columns reads no more than it needs;
    conditions on ``page`` and ``path`` leave pages and files out.
    """

    @classmethod
    def name(cls) -> str:
        return "pagefiles"

    def schema(self) -> str:
        what = self.options.get("what", "pages")
        if what not in TABLES:
            raise ValueError(f"no table {what}: {', '.join(TABLES)}")
        return TABLES[what]

    def reader(self, schema: StructType) -> PageFilesReader:
        return PageFilesReader(schema, dict(self.options))


class PageFilesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.options, self.what = options, options.get("what", "pages")
        known = columns_of(self.what)
        self.columns = {c: known[c] for c in schema.fieldNames()}
        self.first, self.last, self.only = 0, math.inf, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on pages and paths are met here; a row with an error of a whole file has no page, and Spark drops it too."""
        for f in filters:
            bound = f.value if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) else None
            if getattr(f, "attribute", None) == ("page",) and isinstance(bound, int):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.first = max(self.first, bound + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.last = min(self.last, bound - isinstance(f, LessThan))
            elif isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = f.value
            yield f  # Spark checks rows again, so that none of these must be exact

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"])
        about = store.get_file_info(path)
        if about.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [about] if about.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for one in sorted(found, key=lambda x: x.path):
            if one.type == fs.FileType.File and fnmatch.fnmatch(one.base_name, self.options.get("pattern", "*")) and self.only in (None, one.path):
                of = max(1, -(-one.size // int(self.options.get("partitionbytes", PARTITION_BYTES))))
                out += [Part(one.path, i, of) for i in range(of)]
        return out or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.of:
            return
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.options["path"])[0] if "://" in self.options["path"] else fs.LocalFileSystem()
        with store.open_input_stream(partition.path) as f:
            content = f.read()
        yield from batches(found_in(partition.path, content, self.what, set(self.columns), partition.nth, partition.of, (self.first, self.last)), self.columns)


def register(spark: SparkSession) -> None:
    """Make the format known; Spark hands conditions to sources in Python only where that is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageFiles)


def page_file(pages: list[list[tuple[float, float, str]]], width: float, height: float, size: float = 10.0, packed: bool = True) -> bytes:
    """A file of pages, each of texts ``(left, top, text)``.

    Letters are numbered as they come, as fonts that hold only what is used do; all are ``size`` wide, nine tenths of
    it above their line and three below.
    """
    codes: dict[str, int] = {}
    show = lambda text: b"".join(codes.setdefault(c, len(codes) + 1).to_bytes(2, "big") for c in text).hex()
    contents = ["\n".join(["BT", f"/F1 {size:g} Tf", *(f"1 0 0 1 {x:g} {height - y - 0.9 * size:g} Tm <{show(t)}> Tj" for x, y, t in page if t), "ET"]).encode() for page in pages]
    table = "\n".join(f"<{k:04x}> <{c.encode('utf-16-be').hex()}>" for c, k in codes.items())
    unicode = f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(codes)} beginbfchar\n{table}\nendbfchar".encode()

    def stream(data: bytes) -> bytes:
        body = zlib.compress(data) if packed else data
        return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), b" /Filter /FlateDecode" * packed, body)

    first = 7
    kids = " ".join(f"{first + 2 * i} 0 R" for i in range(len(pages)))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 {width:g} {height:g}] /Resources << /Font << /F1 3 0 R >> >> >>".encode(),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Grid /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 6 0 R >>",
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Grid /DW 1000 /FontDescriptor 5 0 R >>",
        b"<< /Type /FontDescriptor /FontName /Grid /Flags 4 /Ascent 900 /Descent -300 >>",
        stream(unicode),
    ]
    for i, content in enumerate(contents):
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {first + 2 * i + 1} 0 R >>".encode(), stream(content)]
    out, places = b"%PDF-1.7\n", []
    for number, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
