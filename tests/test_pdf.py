"""PDF pages as they were written, by the writer in this library and by hand."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from quirespark.functions import text
from quirespark.sources import pdf, readers, writers


def compact(objects):
    """A PDF whose plain objects are in an object stream and whose table is a stream with predicted rows. objects: {number: body}, bodies bytes or (head, data)."""
    plain = {n: b for n, b in objects.items() if isinstance(b, bytes)}
    out, places = b"%PDF-1.5\n", {}
    for n, b in objects.items():
        if not isinstance(b, bytes):
            places[n] = (1, len(out), 0)
            out += b"%d 0 obj\n<< %s /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (n, b[0], len(b[1]), b[1])
    holder, table = max(objects) + 1, max(objects) + 2
    heads, bodies = b"", b""
    for i, (n, b) in enumerate(plain.items()):
        heads += b"%d %d " % (n, len(bodies))
        bodies += b + b"\n"
        places[n] = (2, holder, i)
    packed = zlib.compress(heads + bodies)
    places[holder] = (1, len(out), 0)
    out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (holder, len(plain), len(heads), len(packed), packed)
    places[table] = (1, len(out), 0)
    rows, before, wide = b"", bytes(5), lambda p: p[0].to_bytes(1, "big") + p[1].to_bytes(3, "big") + p[2].to_bytes(1, "big")
    for n in range(table + 1):
        row = wide(places.get(n, (0, 0, 0)))
        rows += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, before, strict=True))
        before = row
    packed = zlib.compress(rows)
    start = len(out)
    out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 3 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >> /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (table, table + 1, len(packed), packed, start)
    return out


CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0005> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<00E9> <03B1>] endbfrange"


def hand_made():
    content = (
        b"q 200 0 0 100 0 700 cm /Pic Do Q BT /F1 10 Tf 2 Tr 1 0 0 1 50 700 Tm (ab) Tj 0 Tr 5 Tw 1 Tc 50 Tz [(c d) -500 (e)] TJ 100 Tz 0 Tw 0 Tc 14 TL T* (x\\051\\n) Tj ET "
        b"BT /F2 20 Tf 1 0 0 1 50 600 Tm <0005001000110020> Tj <0099> Tj ET BT /F1 10 Tf 0 1 -1 0 300 300 Tm (up) Tj ET BT 3 Tr 1 0 0 1 0 0 Tm (hidden) Tj ET 10 10 5 5 re f "
        b"q 2 0 0 2 100 100 cm /Form Do Q BI /W 1 /H 1 /CS /G /BPC 8 ID \xff EI BT /F3 10 Tf 1 0 0 1 50 500 Tm (\x80A) Tj ET"
    )
    return {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 2 /Kids [3 0 R 4 0 R] /MediaBox [0 0 400 800] /Resources 5 0 R >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>", 4: b"<< /Type /Page /Parent 2 0 R /Rotate 90 /Contents 13 0 R >>",
        5: b"<< /Font << /F1 7 0 R /F2 8 0 R /F3 14 0 R >> /XObject << /Pic 11 0 R /Form 12 0 R >> >>", 6: (b"/Filter /FlateDecode", zlib.compress(content)),
        7: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /FirstChar 97 /Widths [500 600 700 800 900] /FontDescriptor << /MissingWidth 250 >> /Encoding /WinAnsiEncoding >>",
        8: b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /DescendantFonts [9 0 R] /ToUnicode 10 0 R >>", 9: b"<< /Type /Font /Subtype /CIDFontType2 /DW 400 /W [5 [800] 16 17 300] /FontDescriptor << /FontWeight 400 >> >>",
        10: (b"", CMAP), 11: (b"/Type /XObject /Subtype /Image /Width 4 /Height 2 /ColorSpace /DeviceGray /BitsPerComponent 8", b"\0" * 8),
        12: (b"/Type /XObject /Subtype /Form /BBox [0 0 9 9] /Matrix [1 0 0 1 5 5]", b"BT /F1 10 Tf (a) Tj ET"), 13: (b"", b"BT /F1 10 Tf 0 1 -1 0 30 40 Tm (b) Tj ET"),
        14: b"<< /Type /Font /Subtype /TrueType /BaseFont /T /FirstChar 65 /Widths [1000] /Encoding << /Differences [128 /eacute] >> >>",
    }


def classic(objects):
    out, places = b"%PDF-1.4\n", {}
    for n, b in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b if isinstance(b, bytes) else b"<< %s /Length %d >>\nstream\n%s\nendstream" % (b[0], len(b[1]), b[1]))
    start = len(out)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % places[n] for n in sorted(objects)) + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start)


def rows_of(data, parts=1):
    return [r for k in range(parts) for r in pdf.read_pages("d", lambda at, n: data[at : at + n], len(data), k, parts)]


@pytest.mark.parametrize("form", [classic, compact, lambda o: classic(o).replace(b"startxref\n", b"startxref\n9")])
def test_glyphs_of_a_hand_made_file(form):
    data = form(hand_made())
    first, second = rows_of(data)
    assert first[1:5] == (0, 2, 400.0, 800.0) and second[1:5] == (1, 2, 800.0, 400.0) and first[8] is None
    g = [(s, round(x0, 3), round(x1, 3), round(y, 3), round(size, 3), bold, visible) for s, x0, x1, y, size, bold, visible, *_ in first[5]]
    assert g[:2] == [("a", 50, 55, 100, 10, True, True), ("b", 55, 61, 100, 10, True, True)]
    # c d: half as wide, a point between letters, five more at the space, then half a size to the right (halved) before e.
    assert g[2:6] == [("c", 61, 64.5, 100, 10, True, True), (" ", 65, 66.25, 100, 10, True, True), ("d", 69.25, 73.25, 100, 10, True, True), ("e", 76.25, 80.75, 100, 10, True, True)]
    assert g[6:9] == [("x", 50, 52.5, 114, 10, True, True), (")", 52.5, 55, 114, 10, True, True), (None, 55, 57.5, 114, 10, True, True)]
    assert g[9:14] == [("fi", 50, 66, 200, 20, False, True), ("A", 66, 72, 200, 20, False, True), ("B", 72, 78, 200, 20, False, True), ("é", 78, 86, 200, 20, False, True), (None, 86, 94, 200, 20, False, True)]
    assert [x[0] for x in g[14:16]] == ["u", "p"] and abs(first[5][14][7]) < 1e-9
    assert [x[6] for x in g[16:22]] == [False] * 6
    form_glyph = next(x for x in g[22:] if x[4] == 20)
    assert form_glyph[:5] == ("a", 110, 120, 690, 20)
    assert [x[0] for x in g[-2:]] == ["é", "A"] and g[-1][2] - g[-1][1] == 10
    assert [i[6:] for i in first[6]] == [(4, 2), (1, 1)] and first[6][0][:6] == (200, 0, 0, -100, 0, 100) and first[7] == 1
    turned = second[5][0]
    assert (turned[0], round(turned[1]), round(turned[3]), round(turned[4])) == ("b", 40, 30, 10)


def test_ranges_and_errors():
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 7 /Kids [3 0 R 4 0 R 5 0 R] >>", 3: b"<< /Type /Pages /Count 3 /Kids [6 0 R 6 0 R 6 0 R] >>", 4: b"<< /Type /Pages /Count 3 /Kids [6 0 R 6 0 R 6 0 R] >>", 5: b"<< /Type /Page /MediaBox [0 0 9 9] >>", 6: b"<< /Type /Page /MediaBox [0 0 5 5] >>"}
    data = classic(objects)
    assert [r[1] for r in rows_of(data)] == [r[1] for r in rows_of(data, 4)] == [*range(7)]
    assert [r[3] for r in rows_of(data)] == [5.0] * 6 + [9.0]
    assert rows_of(b"no pdf")[0][8].startswith("ValueError") and rows_of(b"")[0][1] is None
    assert rows_of(data.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 1 0 R"))[0][8] == "ValueError: encrypted"


PAGE = "doc string, page int, w double, h double, iw int, ih int, kind string, px binary, visible boolean, lines array<struct<s:binary,x0:double,y0:double,x1:double,y1:double>>, figures array<struct<x0:double,y0:double,x1:double,y1:double,iw:int,ih:int,kind:string,px:binary>>"


def whole_files(parts):
    found = {}
    for r in sorted(parts.collect(), key=lambda r: (r["doc"], r["section"], r["k"])):
        found[r["doc"]] = found.get(r["doc"], b"") + bytes(r["bytes"])
    return found


def test_written_in_parts_and_read_back(spark, tmp_path):
    line = lambda s, y: (s, 10.0, y, 10.0 + 6.0 * len(s), y + 7.86)
    figure = (20.0, 30.0, 60.0, 80.0, 2, 1, "rgb", b"\xff\0\0\0\xff\0")
    rows = [("d", p, 200.0, 300.0, 16, 2, "bit", b"\xaa\x55\xaa\x55", p % 2 == 1, [line(b"page %d" % p, 20.0)], [figure] if p % 5 == 0 else []) for p in range(600)]
    rows += [("e", 0, 50.0, 60.0, None, None, None, None, True, [line(b"alone (", 5.0)], None)]
    pages = spark.createDataFrame(rows, PAGE).repartition(4)
    files = whole_files(writers.pdf_parts(pages))
    for doc, data in files.items():
        (tmp_path / f"{doc}.pdf").write_bytes(data)
        at = int(re.findall(rb"startxref\n(\d+)", data)[-1])
        places = [int(x[:10]) for x in data[at:].split(b"\n") if x.endswith(b" n ")]
        assert all(data[p:].startswith(b"%d 0 obj" % n) for n, p in enumerate(places, 1)) and b"/Size %d " % (len(places) + 1) in data[at:]
    assert {r["doc_id"]: r["n_pages"] for r in readers.n_pages(readers.documents(spark, str(tmp_path))).collect()} == {"d": 600, "e": 1}
    spark.dataSource.register(pdf.PdfSource)
    source = spark.read.format("pdf_pages").option("spanBytes", "20000").load(str(tmp_path))
    assert source.rdd.getNumPartitions() > 5
    found = {(r["doc"], r["page"]): r for r in source.collect()}
    assert len(found) == 601 and all(r["error"] is None for r in found.values())
    for p in (0, 7, 599):
        r = found["d", p]
        assert "".join(g["s"] for g in r["glyphs"]) == f"page {p}" and {g["visible"] for g in r["glyphs"]} == {p % 2 == 1} and len(r["images"]) == 1 + (p % 5 == 0)
        assert all(abs(g["size"] - 10) < 0.01 for g in r["glyphs"]) and abs(r["glyphs"][0]["y"] - (27.86 - 1.57)) < 0.02
    glyphs = pdf.glyph_rows(source).where("doc = 'd'")
    assert glyphs.select("page").distinct().count() == 300
    facts = {(r["doc"], r["page"]): r for r in pdf.page_facts(source).collect()}
    assert facts["d", 2]["sole_image"] and facts["d", 2]["big_image"] and not facts["d", 1]["sole_image"] and not facts["d", 5]["sole_image"] and facts["e", 0]["image_share"] == 0
    from_columns = pdf.pdf_pages(readers.documents(spark, str(tmp_path)).withColumnRenamed("doc_id", "doc"))
    assert from_columns.where("doc = 'd'").count() == 600


def test_running_sums_have_no_large_group(spark):
    rows = spark.range(10_000).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("page"), (F.col("id") % 7).alias("v"))
    summed = writers.before_sums(rows, "page", "v", "before")
    found = {r["page"]: r["before"] for r in summed.collect()}
    total = 0
    for p in range(10_000):
        assert found[p] == total
        total += p % 7


def test_colour_copies(spark):
    rows = [("d", p, 50.0, 60.0, 1, 1, "rgb", bytes([p, 0, 0]), False, [], []) for p in range(6)]
    files = whole_files(writers.colour_copies(spark.createDataFrame(rows, PAGE), spark.createDataFrame([("d", 1), ("d", 4), ("d", 4)], "doc string, page int")))
    data = files["d"]
    own = pdf.Pdf(lambda at, n: data[at : at + n], len(data))
    pictures = [own.content(own.value(page["Resources"]["XObject"]["Im0"])) for _, page in own.pages(0, 9)]
    assert pictures == [b"\x01\0\0", b"\x04\0\0"]


def test_the_glyphs_of_a_string_are_placed_at_once(monkeypatch):
    """The matrices of a string are computed once, however many letters it has; each letter has its place, width and character."""
    lines = [{"s": b"ab " * 40, "x0": 10.0, "y0": 14.0 * k, "x1": 370.0, "y1": 14.0 * k + 7.86} for k in range(1, 5)]
    content = writers.pdf([{"page": 0, "w": 600.0, "h": 800.0, "visible": True, "lines": lines}])
    calls, times = [], pdf.times
    monkeypatch.setattr(pdf, "times", lambda m, n: calls.append(1) or times(m, n))
    (page,) = pdf.read_pages("a", lambda at, n: content[at : at + n], len(content))
    assert page[8] is None and len(calls) <= 4 * 4
    glyphs = {name: [g[k] for g in page[5]] for k, name in enumerate(["s", "x0", "x1", "y"])}
    assert "".join(glyphs["s"]) == "ab " * 160
    assert glyphs["x0"][:120] == pytest.approx([10 + 3 * k for k in range(120)], abs=0.1) and glyphs["x1"][:119] == pytest.approx(glyphs["x0"][1:120])
    assert {len(v) for v in glyphs.values()} == {480} and len(set(glyphs["y"])) == 4


def test_whole_files_of_many_documents(spark):
    """Pages in order, documents apart, and a file that can't be read among others."""
    rows = [(d, p, 600.0, 800.0, [(f"{d}-{p}".encode(), 10.0, 20.0, 40.0, 30.0)]) for d in range(50) for p in range(d % 3 + 1)]
    drawn = spark.createDataFrame(rows, "doc long, page int, w double, h double, lines array<struct<s: binary, x0: double, y0: double, x1: double, y1: double>>")
    files = writers.pdf_documents(drawn.repartition(3)).withColumn("content", F.when(F.col("doc") == 7, F.lit(b"none")).otherwise(F.col("content")))
    found = {(int(r["doc"]), r["page"]): "".join(g["s"] for g in r["glyphs"]) if r["error"] is None else None for r in pdf.pdf_pages(files).collect()}
    assert found == {(d, p): f"{d}-{p}" for d, p, *_ in rows if d != 7} | {(7, None): None}


def test_glyphs_of_a_string_are_arrays():
    """A page keeps an entry for each string, not for each glyph; their places are those of sums glyph by glyph."""
    line = lambda s, y: {"s": s, "x0": 10.0, "y0": y, "x1": 90.0, "y1": y + 7.86}
    content = writers.pdf([{"w": 600.0, "h": 800.0, "visible": True, "lines": [line(b"a (b) \\ c" * 30, 20.0), line(b"\xe9\x80", 40.0)]}])
    read = lambda at, n: content[at : at + n]
    (row,) = pdf._read_pages("d", read, len(content))
    assert [len(s.codes) for s in row[5]] == [270, 2]
    (page,) = pdf.read_pages("d", read, len(content))
    assert "".join(g[0] for g in page[5]) == "a (b) \\ c" * 30 + "é€"
    size, stretch = 10.0, round(100 * 80 / (0.6 * 10.0 * 270), 2) * 0.01
    x = 10.0
    for s, x0, x1, *_ in page[5][:270]:
        assert x0 == x and abs(x1 - x0 - 0.6 * size * stretch) < 1e-9
        x += 0.6 * size * stretch


def test_winansi_of_plain_and_odd_lines(spark):
    rows = ["plain", "caf\u00e9 \u00ff", "\u2018q\u2019 \u2022\u20ac", "\u4e00a\u0100", "\x80\x9f\t", "", None]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").select("k", text.winansi(F.col("t")).alias("w")).orderBy("k").collect()
    want = [(b"plain", 0), (b"caf\xe9 \xff", 0), (b"\x91q\x92 \x95\x80", 0), (b"a", 2), (b"", 3), (b"", 0), (None, None)]
    assert [(r["w"]["bytes"], r["w"]["skipped"]) for r in found] == want
