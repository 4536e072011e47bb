"""Page description files that are written here, read back as pages, letters and objects."""

import zlib

import pytest

from pagequarry.sources import page_files as pf
from pagequarry.sources.page_objects import Name, PageFile, PageFileError, value

HEAD = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"
FONT = "<< /Type /Font /Subtype /TrueType /BaseFont /ABCDEF+Serif-BoldItalic /FirstChar 32 /Widths [" + " ".join(["500"] * 95) + "] >>"


def stream(data: bytes, more: str = "", packed: bool = False) -> bytes:
    body = zlib.compress(data) if packed else data
    return f"<< /Length {len(body)} {more} {'/Filter /FlateDecode' if packed else ''} >>\nstream\r\n".encode() + body + b"\r\nendstream"


def a_file(content: bytes, more: dict[int, bytes] | None = None, resources: str = "", page: str = "", packed: bool = False, end: bytes = b"") -> bytes:
    """One page of 200 by 100 points; ``more`` are further objects by number."""
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] >>",
        3: f"<< /Type /Page /Parent 2 0 R /Contents 4 0 R {page} /Resources << /Font << /F1 5 0 R >> {resources} >> >>".encode(),
        4: stream(content, packed=packed),
        5: FONT.encode(),
    } | (more or {})
    return HEAD + b"".join(b"%d 0 obj %s endobj\n" % x for x in objects.items()) + b"xref\n0 1\ngarbage\ntrailer << /Root 1 0 R >>\n" + end


def read(data: bytes, what: str = "glyphs") -> list[dict]:
    return list(pf.rows("f", data, what, set(pf.columns_of(what))))


def text_of(data: bytes) -> str:
    return read(data, "pages")[0]["text"]


def boxes(data: bytes) -> list[tuple]:
    return [(g["ch"], *(None if g[k] is None else round(g[k], 4) for k in "ltrb")) for g in read(data)]


def test_values():
    got, _ = value(rb"<< /A#20b [1 -2.5 .5 (a\(b\051\\ (in) \n\101) <48 6> true null 3 0 R] % note" + b"\n /C /D >>", 0)
    assert list(got) == ["A b", "C"] and isinstance(got["C"], Name) and got["C"] == "D"
    assert got["A b"][:6] == [1, -2.5, 0.5, rb"a(b)\ (in) " + b"\nA", b"H`", True] and got["A b"][6] is None and got["A b"][7].number == 3


@pytest.mark.parametrize("packed", [False, True])
def test_letters_with_places_and_style(packed):
    data = a_file(b"q 2 0 0 2 10 20 cm 1 0 0 rg BT /F1 10 Tf 5 5 Td (Ab) Tj ET Q", packed=packed)
    # Ten units at double size: half of it wide, three quarters above the line and one below.
    assert boxes(data) == [("A", 20, 55, 30, 75), ("b", 30, 55, 40, 75)]
    first = read(data)[0]
    assert (first["size"], first["font"], first["bold"], first["italic"], first["colour"], first["hidden"]) == (20, "Serif-BoldItalic", True, True, 0xFF0000, False)


def test_spacing_lines_and_blanks():
    assert text_of(a_file(b"BT /F1 10 Tf 12 TL 10 80 Td [(ab) -100 (c) -900 (d)] TJ T* (e) ' (f) ' 1 Tc (gh) Tj ET")) == "abc d\ne\nfgh"
    wide = boxes(a_file(b"BT /F1 10 Tf 50 Tz 2 Tc 4 Tw 5 Ts 0 10 Td (a b) Tj ET"))
    assert [b[0] for b in wide] == ["a", " ", "b"] and wide[0][1:] == (0, 77.5, 2.5, 87.5) and wide[2][1] == pytest.approx(9)
    controls = text_of(a_file(b"BT /F1 10 Tf 0 10 Td (a\\002b\\015\\000c) Tj ET"))
    assert controls == "a-bc"


def test_hidden_text_counts_only_alone():
    both = b"BT /F1 10 Tf 0 50 Td 3 Tr (scan) Tj 0 Tr 0 -20 Td (seen) Tj ET"
    assert text_of(a_file(both)) == "seen"
    assert text_of(a_file(b"BT /F1 10 Tf 0 50 Td 3 Tr (scan) Tj 0 Tr 0 -20 Td ( ) Tj ET")) == "scan"


def test_marks_and_nested_forms():
    form = lambda inner, body: stream(body, f"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 10 0] /Resources << /Font << /F1 5 0 R >> /XObject << /X {inner} 0 R >> >>")
    more = {k: form(k + 1, b"BT /F1 10 Tf 0 50 Td (%d) Tj ET /X Do" % (k % 10)) for k in range(10, 21)} | {21: form(10, b"/X Do")}
    got = read(a_file(b"/P << /MCID 7 >> BDC /X Do EMC", more, "/XObject << /X 10 0 R >>"))
    shown = [(g["ch"], round(g["l"]), g["mark"]) for g in got if g["l"] is not None]
    assert shown == [(str(k), 10 * (k + 1), 7) for k in range(8)]  # eight deep
    loop = {10: form(10, b"BT /F1 10 Tf 0 50 Td (x) Tj ET /X Do")}
    assert text_of(a_file(b"/X Do", loop, "/XObject << /X 10 0 R >>")) == "x"


def test_objects():
    more = {10: stream(b"\0", "/Type /XObject /Subtype /Image /Width 1 /Height 1")}
    body = b"0 0 1 rg 10 10 50 20 re f 2 w 1 0 0 RG 0 0 m 100 50 l S q 40 0 0 30 60 40 cm /I Do Q 5 5 m 9 9 9 20 5 20 c f 1 1 5 5 re n"
    got = [(o["kind"], *(round(o[k], 4) for k in "ltrb"), o["fill"], o["line"], o["width"]) for o in read(a_file(body, more, "/XObject << /I 10 0 R >>"), "objects")]
    assert got == [
        ("rectangle", 10, 70, 60, 90, 0x0000FF, None, 0), ("path", 0, 50, 100, 100, None, 0xFF0000, 2), ("image", 60, 30, 100, 60, None, None, 0),
        ("path", 5, 80, 8, 95, 0x0000FF, None, 0),
    ]
    inline = read(a_file(b"q 10 0 0 10 0 0 cm BI /W 1 /H 1 ID \x00 EI Q BT /F1 10 Tf (a) Tj ET"), "objects")
    assert [o["kind"] for o in inline] == ["image"]


@pytest.mark.parametrize(("turn", "want"), [(0, (0, 82.5, 5, 92.5)), (90, (7.5, 0, 17.5, 5)), (180, (195, 7.5, 200, 17.5)), (270, (82.5, 195, 92.5, 200))])
def test_turned_pages(turn, want):
    data = a_file(b"BT /F1 10 Tf 0 10 Td (a) Tj ET", page=f"/Rotate {turn}")
    assert boxes(data)[0][1:] == pytest.approx(want)
    page = read(data, "pages")[0]
    assert (page["width"], page["height"], page["turn"]) == ((100, 200) if turn % 180 else (200, 100)) + (turn // 90,)


def test_letters_of_composite_fonts():
    table = b"1 beginbfchar <0001> <00660069> endbfchar 2 beginbfrange <0002> <0003> <0041> <0010> <0011> [<0078> <D83DDE00>] endbfrange"
    more = {
        5: b"<< /Type /Font /Subtype /Type0 /BaseFont /C /DescendantFonts [8 0 R] /ToUnicode 9 0 R >>",
        8: b"<< /Type /Font /Subtype /CIDFontType2 /DW 300 /W [1 [600 700] 3 16 800] >>", 9: stream(table, packed=True),
    }
    data = a_file(b"BT /F1 10 Tf 0 10 Td <000100020003001000110041> Tj ET", more)
    assert text_of(data) == "fiABx\U0001f600A"
    assert [round(x, 3) for x in sorted({b[1] for b in boxes(data)})] == [0, 6, 13, 21, 29, 32]
    named = {5: b"<< /Type /Font /Subtype /Type1 /BaseFont /D /Encoding << /Differences [65 /uni00E9 /b] >> >>"}
    assert text_of(a_file(b"BT /F1 10 Tf 0 10 Td (ABC\\223) Tj ET", named)) == "ébC“"


def test_broken_and_changed_files():
    good = a_file(b"BT /F1 10 Tf 0 10 Td (old) Tj ET")
    changed = good + b"4 0 obj " + stream(b"BT /F1 10 Tf 0 10 Td (new) Tj ET") + b" endobj trailer << /Root 1 0 R /Prev 9 >>"
    assert text_of(changed) == "new"
    assert text_of(good[: good.index(b"xref")]) == "old"  # no table, no trailer
    wrong = good.replace(b"/Length 32", b"/Length 99")
    assert wrong != good and text_of(wrong) == "old"
    decoy = a_file(b"BT /F1 10 Tf 0 10 Td (a 4 0 obj b) Tj ET")
    assert text_of(decoy) == "a 4 0 obj b"
    cut = a_file(b"BT /F1 10 Tf 0 10 Td (first) Tj ET " + b"BT 0 90 Td (x) Tj ET " * 200, packed=True)
    at = cut.index(b"stream\r\n") + 60
    assert text_of(cut[:at] + b"\xff" * 20 + cut[at + 20 :]).startswith("first")
    for data, kind in ((b"", "format"), (b"GIF89a", "format"), (HEAD, "format"), (a_file(b"", end=b"trailer << /Encrypt 9 0 R >>"), "password")):
        with pytest.raises(PageFileError) as e:
            list(PageFile(data).pages())
        assert e.value.kind == kind
        assert [r["error"].split(":")[0] for r in read(data, "pages")] == [kind]
    odd = a_file(b"", {4: stream(b"x", "/Filter /Crypt")})
    assert read(odd, "glyphs") == [{"path": "f", "page": 0, "error": "page: a stream packed as Crypt"}]


def test_packed_objects_with_predicted_rows():
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 3 0 R 2 0 R] /MediaBox [0 0 200 100] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", 5: FONT.encode()}
    offsets, body = [], b""
    for number, data in inner.items():
        offsets.append(f"{number} {len(body)}")
        body += data + b" "
    head = " ".join(offsets).encode() + b" "
    plain = head + body
    plain += b" " * (-len(plain) % 10)
    rows = [plain[i : i + 10] for i in range(0, len(plain), 10)]
    up = b"".join(b"\2" + bytes((a - b) & 255 for a, b in zip(r, rows[i - 1] if i else bytes(10), strict=True)) for i, r in enumerate(rows))
    holder = stream(up, f"/Type /ObjStm /N {len(inner)} /First {len(head)} /DecodeParms << /Predictor 12 /Columns 10 >>", packed=True)
    data = HEAD + b"9 0 obj " + holder + b" endobj 4 0 obj " + stream(b"BT /F1 10 Tf 0 10 Td (packed) Tj ET") + b" endobj"
    assert [p["text"] for p in read(data, "pages")] == ["packed"]  # a page once, a tree in itself never


def test_written_files_come_back():
    pages = [[(0.0, 0.0, "Grüße, 世界 😀"), (20.0, 16.0, "b")], [], [(0.0, 0.0, "c")]]
    for packed in (True, False):
        got = read(pf.page_file(pages, 300, 64, packed=packed), "pages")
        assert [p["text"] for p in got] == ["Grüße, 世界 😀\nb", "", "c"]
        assert {(p["width"], p["height"]) for p in got} == {(300.0, 64.0)}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "deep").mkdir()
    (at / "a.pdf").write_bytes(pf.page_file([[(0.0, 0.0, f"page {i}")] for i in range(23)], 200, 100))
    (at / "deep" / "b.pdf").write_bytes(pf.page_file([[(0.0, 0.0, "other")]], 200, 100))
    (at / "bad.pdf").write_bytes(b"no such file")
    (at / "note.txt").write_text("x")
    return at


def test_data_source(spark, folder):
    pf.register(spark)
    load = lambda **o: spark.read.format("pagefiles").options(pattern="*.pdf", **o).load(str(folder))
    whole = load()
    got = {(r.path.rsplit("/", 1)[1], r.page): (r.text, r.error) for r in whole.collect()}
    assert got == {("a.pdf", i): (f"page {i}", None) for i in range(23)} | {("b.pdf", 0): ("other", None), ("bad.pdf", None): (None, "format: not a page description file")}
    size = (folder / "a.pdf").stat().st_size
    parts = load(partitionbytes=size // 4)
    assert parts.rdd.getNumPartitions() >= 6  # one a range
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert {r.text for r in parts.where("page >= 20 and page < 22").collect()} == {"page 20", "page 21"}
    assert whole.where("page = 3").count() == 1
    letters = load(what="glyphs").where("page = 2 and l is not null and path like '%a.pdf'").orderBy("idx").collect()
    assert "".join(r.ch for r in letters) == "page 2" and [r.l for r in letters] == [10.0 * i for i in range(6)]
    few = spark.read.format("pagefiles").schema("path string, page int, width double").options(pattern="*.pdf").load(str(folder))
    assert few.columns == ["path", "page", "width"] and few.where("width = 200").count() == 24
    with pytest.raises(Exception, match="no table"):
        load(what="nothing").schema
    with pytest.raises(Exception, match="missing"):
        spark.read.format("pagefiles").load(str(folder / "missing")).collect()


def test_sizes_run_no_content(monkeypatch):
    def fails(*_):
        raise AssertionError

    monkeypatch.setattr(pf, "read", fails)
    got = list(pf.rows("f", a_file(b"BT"), "pages", {"path", "page", "width"}))
    assert got == [{"path": "f", "page": 0, "width": 200.0, "height": 100.0, "turn": 0}]


def test_files_that_spark_has_read(spark, folder):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder))
    got = pf.read_files(files, "pages")
    assert got.where("error is null").count() == 24 and got.where("error like 'format%'").count() == 2
    assert pf.read_files(files.limit(0), "objects").count() == 0
