"""Whole packages, opened again: every relation, list, span, picture and comment."""

import io
import re
import zipfile
from xml.etree import ElementTree

import numpy as np

from pagequarry.operators import raster
from pagequarry.sources import packages as pk

NS = {"w": pk.W, "r": pk.R, "a": pk.A}
KEY = lambda name: f"{{{pk.W}}}{name}"
PNG = raster.png(np.zeros((3, 4), np.uint8))


def block(kind="paragraph", **more):
    return dict.fromkeys(("text", "heading", "bullet", "number", "level", "rows", "picture", "width", "height", "comment")) | {"kind": kind} | more


def number(start, label="%1.", kind="decimal"):
    return {"format": kind, "start": start, "label": label}


def cell(text, span=1, merge=0):
    return {"text": text, "span": span, "merge": merge}


BLOCKS = [
    block(text="Title & <more>\x01", heading=1),
    block(text="one", number=number(1)), block(text="two", number=number(2)), block(text="two again", number=number(2)),
    block(text="a", number=number(1, "%1)", "lowerLetter"), level=1), block(text="between"), block(text="three", number=number(3)),
    block(text="dot", bullet=True, level=2),
    block("table", rows=[[cell("a", 2), cell("b", 1, 1)], [cell("c"), cell(None), cell(None, 1, 2)]]), block("table", rows=[[cell("x")]]),
    block("picture", picture=PNG, width=36.0, height=27.0), block("picture", picture=PNG), block("picture", picture=raster.png(np.ones((3, 4), np.uint8))),
    block(text="said", comment={"author": "A \"B\"", "initials": "AB", "text": "first\nsecond"}),
    block("table", rows=[[cell("end")]]),
]


def opened(data):
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.testzip() is None
    return {n: z.read(n) for n in z.namelist()}


def made(blocks, header=None):
    file = pk.Package()
    for b in blocks:
        file.add(b)
    return opened(file.content(header))


def test_all_relations_have_their_parts():
    parts = made(BLOCKS, "Head")
    trees = {n: ElementTree.fromstring(d) for n, d in parts.items() if n.endswith((".xml", ".rels"))}
    types = {x.get("PartName") or "." + x.get("Extension"): x.get("ContentType") for x in trees["[Content_Types].xml"]}
    for name in parts:
        assert f"/{name}" in types or "." + name.rsplit(".", 1)[1] in types
    relations = {x.get("Id"): x for x in trees["word/_rels/document.xml.rels"]}
    assert all(f"word/{x.get('Target')}" in parts for x in relations.values())
    body = parts["word/document.xml"].decode()
    used = re.findall(r'r:(?:id|embed)="(rId\d+)"', body)
    assert set(used) <= set(relations) and {x.get("Type").rsplit("/", 1)[1] for x in relations.values()} == {"styles", "numbering", "header", "comments", "image"}
    assert [n for n in parts if "media" in n] == ["word/media/image1.png", "word/media/image2.png"] and parts["word/media/image1.png"] == PNG
    embeds = re.findall(r'r:embed="(rId\d+)"', body)
    assert embeds[0] == embeds[1] != embeds[2]
    assert " PAGE " in parts["word/header1.xml"].decode() and "Title &amp; &lt;more&gt;</w:t>" in body


def test_lists_go_on_or_begin():
    parts = made(BLOCKS)
    doc, numbering = (ElementTree.fromstring(parts[f"word/{n}.xml"]) for n in ("document", "numbering"))
    lists = {"".join(p.itertext()): (p.find(".//w:numId", NS).get(KEY("val")), p.find(".//w:ilvl", NS).get(KEY("val"))) for p in doc.iter(KEY("p")) if p.find(".//w:numId", NS) is not None}
    assert lists == {"one": ("3", "0"), "two": ("3", "0"), "two again": ("4", "0"), "a": ("5", "1"), "three": ("6", "0"), "dot": ("1", "2")}
    nums = {n.get(KEY("numId")): n.find("w:abstractNumId", NS).get(KEY("val")) for n in numbering.findall("w:num", NS)}
    own = {a.get(KEY("abstractNumId")): a for a in numbering.findall("w:abstractNum", NS)}
    assert set(nums) == {"1", "2", "3", "4", "5", "6"} and set(nums.values()) == set(own)
    of = lambda k, name: own[nums[k]].find(f"w:lvl/w:{name}", NS).get(KEY("val"))
    assert [of(k, "start") for k in "3456"] == ["1", "2", "1", "3"] and of("5", "numFmt") == "lowerLetter" and of("2", "lvlText") == "%1."


def test_tables_comments_and_ends():
    doc = ElementTree.fromstring(made(BLOCKS)["word/document.xml"])
    body = doc.find("w:body", NS)
    tables = body.findall("w:tbl", NS)
    assert [len(t.findall("w:tblGrid/w:gridCol", NS)) for t in tables] == [3, 1, 1]
    for t in tables:
        for row in t.findall("w:tr", NS):
            assert sum(int((c.find("w:tcPr/w:gridSpan", NS).get(KEY("val"))) if c.find("w:tcPr/w:gridSpan", NS) is not None else 1) for c in row) == len(t.findall("w:tblGrid/w:gridCol", NS))
            assert all(c[-1].tag == KEY("p") for c in row)
    merges = [m.get(KEY("val")) for m in tables[0].iter(KEY("vMerge"))]
    assert merges == ["restart", None]
    tags = [x.tag for x in body]
    assert all(not (a == b == KEY("tbl")) for a, b in zip(tags, tags[1:], strict=False)) and tags[-2:] == [KEY("p"), KEY("sectPr")]
    said = next(p for p in body.iter(KEY("p")) if "".join(p.itertext()) == "said")
    assert [x.tag for x in said] == [KEY("commentRangeStart"), KEY("r"), KEY("commentRangeEnd"), KEY("r")]
    comments = ElementTree.fromstring(made(BLOCKS)["word/comments.xml"])
    assert [["".join(p.itertext()) for p in c] for c in comments] == [["first", "second"]] and comments[0].get(KEY("author")) == 'A "B"'


def test_packages_of_a_table(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("header", T.StringType()), T.StructField("blocks", T._parse_datatype_string(f"array<{pk.BLOCK}>"))])
    df = spark.createDataFrame([(1, "H", [b | {"picture": bytearray(b["picture"])} if b["picture"] else b for b in BLOCKS]), (2, None, []), (3, None, None)], schema)
    got = {r.doc_id: opened(bytes(r.content)) for r in pk.whole_packages(df).collect()}
    assert got[1] == made(BLOCKS, "H") and got[2] == got[3] == made([])
    assert "word/comments.xml" not in got[2] and ElementTree.fromstring(got[2]["word/document.xml"]).find("w:body/w:p", NS) is not None
    assert pk.whole_packages(df.limit(0)).count() == 0
