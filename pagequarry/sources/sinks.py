"""Where results go: single JSON files, logs of edits, tables swapped whole, and word-processor packages.

Files are written under another name and renamed; readers see the old content or the new.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Namespaces and fixed parts of a package.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PACKAGE = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
}
HEADINGS = (1, 2, 3, 4)


def _path(spark: SparkSession, name: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, value, name: str) -> None:
    """One JSON file, replaced at once."""
    target, fs = _path(spark, name)
    fresh, _ = _path(spark, f"{name}.{uuid.uuid4().hex}.tmp")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(fresh, target):
        raise OSError(f"cannot replace {name}")


def append_edits(edits: DataFrame, folder: str) -> None:
    """Edits as a log: what is saved is never changed, the state is that of each annotation's last edit."""
    edits.write.mode("append").parquet(folder)


def current_state(log: DataFrame) -> DataFrame:
    """The last edit of every annotation that is not deleted; of equal ``seq`` the greatest row."""
    last = log.groupBy("doc_id", "annot_id").agg(F.max(F.struct("seq", "op", "value")).alias("x"))
    return last.where("x.op <> 'delete'").select("doc_id", "annot_id", "x.seq", "x.op", "x.value")


def swap_table(df: DataFrame, folder: str) -> None:
    """Replace a table by one that may be made from it: write beside it, then put it in its place, with the old one kept until then."""
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    target, fs = _path(spark, folder)
    fresh, _ = _path(spark, f"{folder}.{tag}.new")
    old, _ = _path(spark, f"{folder}.{tag}.old")
    df.write.parquet(fresh.toString())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {folder}")
    if not fs.rename(fresh, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot replace {folder}")
    if had:
        fs.delete(old, True)


def half_points(points: Column) -> Column:
    """A size in half-points, within what a package may hold."""
    return F.least(F.greatest(F.bround(points * 2), F.lit(2)), F.lit(3276)).cast("int")


def paragraph_xml(text: Column, heading: Column, listed: Column, level: Column) -> Column:
    """A paragraph's element; text is as XML may hold it, with its blanks kept."""
    clean = F.regexp_replace(text, "[\\x00-\\x08\\x0B-\\x1F\\x7F\\uFFFE\\uFFFF]", "")
    safe = F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    look = F.when(heading > 0, F.concat(F.lit('<w:pPr><w:pStyle w:val="Heading'), heading.cast("string"), F.lit('"/></w:pPr>'))).when(listed, F.concat(F.lit('<w:pPr><w:ind w:left="'), ((level + 1) * 360).cast("string"), F.lit('"/></w:pPr>'))).otherwise("")
    return F.concat(F.lit("<w:p>"), look, F.lit('<w:r><w:t xml:space="preserve">'), safe, F.lit("</w:t></w:r></w:p>"))


def package(body: str, title: str = "") -> bytes:
    """A word-processor file around a body; the same body gives the same bytes."""
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:rPr><w:b/><w:sz w:val="{36 - 4 * k}"/></w:rPr></w:style>' for k in HEADINGS)
    head = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{W}"><w:body>'
    parts = PACKAGE | {"word/styles.xml": f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:styles xmlns:w="{W}">{styles}</w:styles>'}
    # The last paragraph carries the section, so a body without any has an empty one.
    parts["word/document.xml"] = f'{head}{body or "<w:p/>"}<w:sectPr><w:pgSz w:w="12240" w:h="15840"/></w:sectPr></w:body></w:document>'
    if title:
        parts["docProps/core.xml"] = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></cp:coreProperties>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def packages(bodies: DataFrame) -> DataFrame:
    """``doc_id, content``: a file for each row of ``doc_id, body``."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([package(batch.column(1)[i].as_py() or "")], pa.binary())], ["doc_id", "content"])

    return bodies.select(F.col("doc_id").cast("long").alias("doc_id"), "body").mapInArrow(run, "doc_id long, content binary")


def obfuscated(data: bytes, guid: str) -> bytes:
    """An embedded font as a package keeps it: its first 32 bytes xor the key's bytes from the end. Its own inverse."""
    key = bytes.fromhex(guid.strip("{}").replace("-", ""))[::-1]
    return bytes(b ^ key[i % 16] for i, b in enumerate(data[:32])) + data[32:]
