"""Whole word-processor packages: numbering, tables with spans, pictures by digest, comments, running heads.

A document's blocks come in order as one row, as one file holds them. Every relation that a part names has its target.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame

from pagequarry.sources.sinks import HEADINGS, PACKAGE, W

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Namespaces of pictures, English metric units of a point, twentieths of a point a level, a point's paragraph between tables.
WP, A, PIC = (f"http://schemas.openxmlformats.org/drawingml/2006/{x}" for x in ("wordprocessingDrawing", "main", "picture"))
EMU, LEVEL = 12_700, 360
SPACER = '<w:p><w:pPr><w:spacing w:before="0" w:after="0" w:line="20" w:lineRule="exact"/><w:rPr><w:sz w:val="2"/></w:rPr></w:pPr></w:p>'
#: Numbers of the lists that every package has, for bullets and for plain numbers.
BULLET, NUMBER, FIRST_OWN = 1, 2, 3
XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_KINDS = {"png": "image/png", "jpeg": "image/jpeg", "bmp": "image/bmp"}

CELL = "struct<text:string,span:int,merge:int>"
#: A block: ``kind`` is paragraph, table or picture. ``number`` is a numbering's start, format and label; ``merge`` 1 begins a vertical merge, 2 goes on with it.
BLOCK = f"struct<kind:string,text:string,heading:int,bullet:boolean,number:struct<format:string,start:int,label:string>,level:int,rows:array<array<{CELL}>>,picture:binary,width:double,height:double,comment:struct<author:string,initials:string,text:string>>"


def _clean(text: str | None) -> str:
    return escape("".join(c for c in text or "" if (c >= " " or c in "\t\n") and c not in "\x7f\ufffe\uffff"))


def _run(text: str | None) -> str:
    return f'<w:r><w:t xml:space="preserve">{_clean(text)}</w:t></w:r>'


def table_xml(rows: list[list[dict]]) -> str:
    """A table of cells with ``text, span, merge``; the grid is as wide as the widest row."""
    columns = max((sum(c["span"] for c in row) for row in rows), default=1)
    out = [f'<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/><w:tblLayout w:type="fixed"/></w:tblPr><w:tblGrid>{"<w:gridCol/>" * columns}</w:tblGrid>']
    for row in rows:
        out.append("<w:tr>")
        for c in row:
            span = f'<w:gridSpan w:val="{c["span"]}"/>' if c["span"] > 1 else ""
            merge = '<w:vMerge w:val="restart"/>' if c["merge"] == 1 else "<w:vMerge/>" if c["merge"] == 2 else ""
            # A cell ends in a paragraph, also where it holds nothing.
            out.append(f"<w:tc><w:tcPr>{span}{merge}</w:tcPr><w:p>{_run(c['text']) if c['text'] else ''}</w:p></w:tc>")
        out.append("</w:tr>")
    return "".join(out) + "</w:tbl>"


class Package:
    """The parts of one file, as its blocks are added in order."""

    def __init__(self) -> None:
        self.body: list[str] = []
        self.last = ""
        self.relations = [("rId1", "styles", "styles.xml"), ("rId2", "numbering", "numbering.xml")]
        self.media: dict[str, tuple[str, str, bytes]] = {}
        self.numbers: list[dict] = []
        self.before: dict | None = None
        self.comments: list[dict] = []
        self.drawings = 0

    def _relation(self, kind: str, target: str) -> str:
        self.relations.append((f"rId{len(self.relations) + 1}", kind, target))
        return self.relations[-1][0]

    def _number(self, number: dict, level: int) -> int:
        """The list that a numbered paragraph is in: the one before goes on if its level, format and label are the same and its number is one less."""
        now = number | {"level": level}
        goes_on = self.before is not None and self.before | {"start": self.before["start"] + 1} == now
        if not goes_on:
            self.numbers.append(now)
        self.before = now
        return FIRST_OWN + len(self.numbers) - 1

    def add(self, block: dict) -> None:
        kind = block["kind"]
        if kind == "table":
            if self.last == "table":
                self.body.append(SPACER)
            self.body.append(table_xml(block["rows"] or []))
            self.before = None
        elif kind == "picture":
            self.body.append(f"<w:p>{self._picture(bytes(block['picture']), block['width'] or 72, block['height'] or 72)}</w:p>")
            self.before = None
        else:
            self.body.append(self._paragraph(block))
        self.last = kind

    def _paragraph(self, block: dict) -> str:
        level, look = block["level"] or 0, ""
        number = block["number"] if block["number"] and block["number"]["label"] else None
        if block["heading"]:
            look = f'<w:pStyle w:val="Heading{block["heading"]}"/>'
        elif number or block["bullet"]:
            listed = self._number(number, level) if number else BULLET
            look = f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{listed}"/></w:numPr><w:ind w:left="{(level + 1) * LEVEL}"/>'
        if not number:
            self.before = None
        text = _run(block["text"])
        if block["comment"]:
            at = len(self.comments)
            self.comments.append(block["comment"])
            text = f'<w:commentRangeStart w:id="{at}"/>{text}<w:commentRangeEnd w:id="{at}"/><w:r><w:commentReference w:id="{at}"/></w:r>'
        return f"<w:p>{f'<w:pPr>{look}</w:pPr>' if look else ''}{text}</w:p>"

    def _picture(self, data: bytes, width: float, height: float) -> str:
        digest = hashlib.sha256(data).hexdigest()
        if digest not in self.media:
            kind = "png" if data[:4] == b"\x89PNG" else "bmp" if data[:2] == b"BM" else "jpeg"
            name = f"media/image{len(self.media) + 1}.{kind}"
            self.media[digest] = (self._relation("image", name), name, data)
        self.drawings += 1
        relation, n, size = self.media[digest][0], self.drawings, f'cx="{round(width * EMU)}" cy="{round(height * EMU)}"'
        return (
            f'<w:r><w:drawing><wp:inline><wp:extent {size}/><wp:docPr id="{n}" name="Picture {n}"/><a:graphic><a:graphicData uri="{PIC}"><pic:pic><pic:nvPicPr><pic:cNvPr id="{n}" name="Picture {n}"/><pic:cNvPicPr/></pic:nvPicPr>'
            f'<pic:blipFill><a:blip r:embed="{relation}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
        )

    def _numbering(self) -> str:
        def levels(kind: str, label: str, start: int, only: int | None = None) -> str:
            which = range(5) if only is None else [only]
            return "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="{start}"/><w:numFmt w:val="{kind}"/><w:lvlText w:val={quoteattr(_clean(label.replace("%", str(i + 1)) if only is None else label))}/></w:lvl>' for i in which)

        own = [(FIRST_OWN + i, levels(n["format"], n["label"], n["start"], n["level"])) for i, n in enumerate(self.numbers)]
        every = [(BULLET, levels("bullet", "•", 1)), (NUMBER, levels("decimal", "%.", 1).replace('w:val="1."', 'w:val="%1."')), *own]
        return f'{XML}<w:numbering xmlns:w="{W}">' + "".join(f'<w:abstractNum w:abstractNumId="{k}">{x}</w:abstractNum>' for k, x in every) + "".join(f'<w:num w:numId="{k}"><w:abstractNumId w:val="{k}"/></w:num>' for k, _ in every) + "</w:numbering>"

    def content(self, header: str | None = None) -> bytes:
        """The file. ``header`` is a running head; the number of the page follows it, in its look."""
        parts, kinds = {}, dict.fromkeys(x[1].rsplit(".", 1)[1] for x in self.media.values())
        overrides = {"numbering": "numbering"}
        section = '<w:pgSz w:w="12240" w:h="15840"/>'
        if header is not None:
            relation = self._relation("header", "header1.xml")
            field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText xml:space="preserve"> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>1</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
            parts["word/header1.xml"] = f'{XML}<w:hdr xmlns:w="{W}"><w:p>{_run(header)}{field}</w:p></w:hdr>'
            section = f'<w:headerReference w:type="default" r:id="{relation}"/>{section}'
            overrides["header1"] = "header"
        if self.comments:
            self._relation("comments", "comments.xml")
            each = "".join(f'<w:comment w:id="{i}" w:author={quoteattr(_clean(c["author"]))} w:initials={quoteattr(_clean(c["initials"]))}>' + "".join(f"<w:p>{_run(line)}</w:p>" for line in (c["text"] or "").split("\n")) + "</w:comment>" for i, c in enumerate(self.comments))
            parts["word/comments.xml"] = f'{XML}<w:comments xmlns:w="{W}">{each}</w:comments>'
            overrides["comments"] = "comments"
        # A body ends in a paragraph, so what follows a table at its end is the smallest one.
        body = "".join(self.body) + ("" if self.last in ("paragraph", "picture") else SPACER)
        names = f'xmlns:w="{W}" xmlns:r="{R}" xmlns:wp="{WP}" xmlns:a="{A}" xmlns:pic="{PIC}"'
        parts["word/document.xml"] = f"{XML}<w:document {names}><w:body>{body}<w:sectPr>{section}</w:sectPr></w:body></w:document>"
        styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:rPr><w:b/><w:sz w:val="{36 - 4 * k}"/></w:rPr></w:style>' for k in HEADINGS)
        parts["word/styles.xml"] = f'{XML}<w:styles xmlns:w="{W}">{styles}<w:style w:type="table" w:styleId="TableGrid"><w:name w:val="Table Grid"/></w:style></w:styles>'
        parts["word/numbering.xml"] = self._numbering()
        more = "".join(f'<Override PartName="/word/{part}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{kind}+xml"/>' for part, kind in overrides.items())
        parts["[Content_Types].xml"] = PACKAGE["[Content_Types].xml"].replace("</Types>", "".join(f'<Default Extension="{k}" ContentType="{_KINDS[k]}"/>' for k in kinds) + more + "</Types>")
        parts["_rels/.rels"] = PACKAGE["_rels/.rels"]
        parts["word/_rels/document.xml.rels"] = f'{XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{R}/{kind}" Target="{target}"/>' for i, kind, target in self.relations) + "</Relationships>"
        parts |= {f"word/{name}": data for _, name, data in self.media.values()}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in parts.items():
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
        return out.getvalue()


def whole_packages(documents: DataFrame) -> DataFrame:
    """``doc_id, content``: a file for each row of ``doc_id, header, blocks`` (an array of ``BLOCK`` in order); equal rows give equal bytes."""

    def run(batches):
        for batch in batches:
            for doc_id, header, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = Package()
                for block in blocks or []:
                    file.add(block)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([file.content(header)], pa.binary())], ["doc_id", "content"])

    return documents.selectExpr("cast(doc_id as long) as doc_id", "header", f"cast(blocks as array<{BLOCK}>) as blocks").mapInArrow(run, "doc_id long, content binary")
