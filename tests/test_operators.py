import json

import numpy as np

from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.operators import colour, glyphs, pages, paragraphs, raster
from quirespark.sources import readers, writers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_text_functions(spark):
    lines = F.array(*[F.lit(x) for x in ("An exam-", "ple of soft­", "ness", "Upper-", "Case")])
    r = one(
        spark,
        lig=T.ligatures(F.lit("ﬁx ﬃ")), norm=T.normalised(F.lit("Side #12 of 30")), edge=T.edge_numbers(F.lit("(12) text of page 7.")), single=T.edge_numbers(F.lit("42")),
        ends=T.ends_sentence(F.lit("Done.” ")), lower=T.starts_lower(F.lit("élan")), item=T.bullet(F.lit("• first")), no=T.bullet(F.lit("first")), num=T.numbered(F.lit("12) x")),
        joined=T.join_lines(lines), table=T.pipe_table(F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("1"), F.lit("2")))), name=T.figure_name(F.lit("doc"), F.lit(3), F.lit(2), F.lit("png")),
        colours=T.colour_list(F.lit("12, 3a,4b,x")), none=T.colour_list(F.lit("none")), out=T.output_name(F.lit("a/b.pdf")), words=T.words(F.lit("# A *B* ![x](y.png) <b>c_1</b>\n- d | e")),
    )
    assert (r.lig, r.norm, r.edge, r.single, r.ends, r.lower, r.item, r.no, r.num) == ("fix ffi", "side # of #", [12, 7], [42, 42], True, True, "first", None, True)
    assert r.joined == "An example of softness Upper- Case"
    assert r.table == "| a\\|b | c |\n| --- | --- |\n| 1 | 2 |"
    assert (r.name, r.out, r.words) == ("doc_p3_2.png", "a/b.1bit.pdf", ["a", "b", "c_1", "d", "e"])
    assert [tuple(c) for c in r.colours] == [(12, None), (3, 0), (4, 1)] and r.none == []


def test_page_labels(spark):
    rows = [("a", 0, [7]), ("a", 1, [8, 300]), ("a", 2, [9]), ("b", 0, [4, 5]), ("b", 1, [6, 7]), ("c", 0, []), ("c", 1, [9])]
    found = pages.page_labels(spark.createDataFrame(rows, "doc string, page int, numbers array<int>"))
    assert {(r["doc"], r["page"]): r["label"] for r in found.collect()} == {("a", 0): "7", ("a", 1): "8", ("a", 2): "9", ("b", 0): "4–5", ("b", 1): "6–7", ("c", 0): "1", ("c", 1): "9"}


def test_two_columns(spark):
    rows, seq = [], 0
    for line in range(8):
        for start, text in ((50, "left side"), (300, "right side")):
            for j, c in enumerate(text):
                if c != " ":
                    rows.append(("d", seq, c, 50.0 + start + 5 * j, 55.0 + start + 5 * j, 100.0 + 12 * line, 10.0))
                    seq += 1
    table = spark.createDataFrame([*rows, rows[0]], "doc string, seq int, s string, x0 double, x1 double, y double, size double")
    split = glyphs.fragments(glyphs.baseline_rows(glyphs.without_doubles(table)))
    assert sorted({r["text"] for r in split.collect()}) == ["left side", "right side"] and split.count() == 16
    bins = {r["bin"] for r in glyphs.gutter_bins(glyphs.baseline_rows(table)).collect()}
    assert min(bins) == 146 and max(bins) == 349


def test_layout_and_labels(spark, tmp_path):
    page = {"page_size": [100.0, 200.0], "para_blocks": [{"type": "image", "bbox": [0, 0, 9, 9], "blocks": [{"type": "image_body", "bbox": [10, 20, 50, 60]}, {"type": "image_caption", "lines": [{"bbox": [1, 2, 3, 4], "spans": [{"type": "text", "content": "Caption"}, {"type": "formula", "content": "x"}]}]}]}], "discarded_blocks": []}
    (tmp_path / "one.json").write_text(json.dumps({"pdf_info": [page]}, indent=1))
    read = readers.layout(spark, str(tmp_path / "one.json"))
    assert [r["text"] for r in readers.block_lines(read).collect()] == ["Caption"]
    boxes = readers.figure_boxes(read)
    fitted = readers.fit_boxes(boxes, read.select("file", "ordinal", F.col("w").alias("lw"), F.col("h").alias("lh"), (F.col("w") + 1).alias("w"), F.col("h").alias("h")))
    assert [tuple(round(x, 2) for x in r[3:]) for r in fitted.collect()] == [(7.1, 17.0, 53.5, 63.0)]
    (tmp_path / "f1.tsv").write_text("# page\tclasses\n3\ttext,picture\t1\tpicture:0.1,0.2,0.5,0.6?;text:0,0,1,1\tnote\n\n4\t\t0\n")
    first, second = readers.labels(spark, str(tmp_path / "f1.tsv")).orderBy("page").collect()
    assert (first["file"], first["classes"], first["certain"], first["note"], second["classes"], second["regions"]) == ("f1", ["text", "picture"], True, "note", [], [])
    assert [tuple(r) for r in first["regions"]] == [("picture", 0.1, 0.2, 0.5, 0.6, True), ("text", 0.0, 0.0, 1.0, 1.0, False)]


def test_png_is_read_back(spark, tmp_path):
    rgb = bytes(range(3 * 4 * 2))
    (tmp_path / "x.png").write_bytes(writers.png(4, 2, rgb))
    r = readers.rasters(spark, str(tmp_path)).first()
    assert (r["doc_id"], r["w"], r["h"], r["channels"]) == ("x", 4, 2, 3)
    assert np.array_equal(np.frombuffer(r["px"], np.uint8).reshape(2, 4, 3)[:, :, ::-1], np.frombuffer(rgb, np.uint8).reshape(2, 4, 3))


def lines_page(h=400, w=600, tilt=0.0):
    y, x = np.mgrid[0:h, 0:w]
    at = y - (x - w / 2) * np.tan(np.radians(tilt))
    return np.where((at % 20 < 3) & (x > 60) & (x < w - 60) & (y > 40) & (y < h - 40), 0.1, 1.0)


def test_kernels():
    page = lines_page(tilt=2.0)
    assert abs(raster.skew_angle(page < 0.6) - 2.0) < 0.1
    straight = raster.rotate(page, -2.0, 600, 400)
    assert abs(raster.skew_angle(straight < 0.6)) < 0.15
    shaded = lines_page() * np.linspace(0.55, 0.95, 600)[None, :]
    assert (raster.flatten(shaded)[:, 300][5:30] > 0.97).all()
    ramp = np.random.default_rng(1).random((300, 400))
    ramp[100:200] *= 0.3
    assert np.abs(raster.gauss(ramp, 30.0) - raster._blur(ramp, 30.0)).max() < 2e-3
    letters = (lines_page() < 0.6) & (np.arange(600) % 2 == 0)  # whole lines are darker than text
    x0, y0, x1, y1 = raster.content_box(letters)
    assert abs(x0 - 53) <= 2 and abs(x1 - 547) <= 2 and 30 <= y0 <= 45 and 340 <= y1 <= 370


def test_content_box_leaves_bands_out():
    letters = (lines_page() < 0.6) & (np.arange(600) % 2 == 0)
    banded = letters.copy()
    banded[:22, ::3] = True  # a dark edge
    assert raster.content_box(banded)[1] >= 22 and raster.content_box(banded) == raster.content_box(letters)
    head = letters.copy()
    head[14:20, 200:260:2] = True  # a running head in the outer tenth stays: it is low and has no long segments
    assert raster.content_box(head)[1] <= 14
    assert raster.content_box(np.zeros((50, 50), bool)) is None
    assert raster.long_share(np.array([[1, 1, 1, 0, 1]], bool), 3) == 0.75


def test_orientation_by_tiles():
    rng = np.random.default_rng(5)
    page = np.ones((600, 600))
    for top in range(20, 560, 24):
        page[top : top + 5, 30:570], page[top + 5 : top + 13, 30:570], page[top + 13 : top + 15, 30:570] = 0.9, 0.66, 0.98
    for turns in range(4):
        turn, sure = raster.orientation(raster.quarter_turns(page, turns))
        assert turn == (360 - 90 * turns) % 360 and sure > 0.25
    picture = page.copy()
    picture[:, 300:420] = rng.random((600, 120)) * 0.4  # dark tiles do not count
    assert raster.orientation(picture)[0] == 0
    assert raster.orientation(np.zeros((300, 300))) == (0, 0.0)


def test_logs(spark, tmp_path):
    (tmp_path / "geom.log").write_text("f1 12: turn 0 box Some([10, 20, 300, 400]) conf 2.1 gutter Some((155, 12))\nf1 13: box Some([1, 2, 3, 4]) gutter None\nnoise\n")
    (tmp_path / "slots.log").write_text("f1 12: deskew [0.1, -0.2]\nf1 13: deskew [0.0]\n")
    found = readers.log_lines(spark, str(tmp_path)).orderBy("page").collect()
    assert [tuple(r) for r in found] == [("f1", 12, [10, 20, 300, 400], 155, 2), ("f1", 13, [1, 2, 3, 4], None, 1)]


def test_heading_levels_and_markers(spark):
    rows = [("d", 1, 0, "Title", True, 1, True), ("d", 2, 1, "A bold line", False, 2, True), ("d", 3, 2, "# not a heading", False, 2, False), ("d", 4, 3, "Ends here.", False, 2, True)]
    table = spark.createDataFrame(rows, "doc string, para int, line int, text string, heading boolean, level int, bold boolean")
    assert [r["text"] for r in paragraphs.paragraphs(table, 3).orderBy("para").collect()] == ["# Title", "### A bold line", "\\# not a heading", "Ends here."]
    marker = spark.range(1).select(T.page_marker(F.lit("7"), F.lit(True), F.array(F.lit("1 a"), F.lit("2 b"))).alias("m"), T.page_marker(F.lit("7"), F.lit(True), F.array().cast("array<string>")).alias("e")).first()
    assert marker["m"] == "\n\n---\n1 a\n\n2 b\n\n*— side 7 —*\n" and marker["e"] == "\n\n*— side 7 —*\n"


def test_components():
    mask = np.zeros((9, 9), bool)
    mask[1, 1:4] = mask[2, 4] = mask[3, 5] = mask[6:8, 6:8] = mask[8, 0] = True
    assert raster.components(mask).tolist() == [[1, 1, 6, 4, 5], [6, 6, 8, 8, 4], [0, 8, 1, 9, 1]]
    band = np.zeros((100, 100), bool)
    band[5:95, 2:5] = True
    band[40:60, 45:60] = True
    assert raster.clear_edge_bands(band).sum() == 300
    bent = band.copy()
    bent[5:95, 2:5] = False
    bent[5:95, 2] = bent[90:95, 2:24] = True  # an L, and a letter in its box that is not its own
    bent[20:24, 12:16] = True
    assert raster.clear_edge_bands(bent).sum() == 300 + 16


def test_kernel_over_pages(spark):
    px = (lines_page() * 255).astype(np.uint8).tobytes()
    table = spark.createDataFrame([("d", 1, 600, 400, px)], "doc string, page int, w int, h int, px binary")
    found = raster.map_pages(table, lambda v: {"angle": raster.skew_angle(v < 0.6), "ink": float((v < 0.6).mean())}, "doc string, page int, angle double, ink double").first()
    assert abs(found["angle"]) < 0.1 and 0.05 < found["ink"] < 0.2


def test_signals_and_tiles():
    grey = np.full((320, 320, 3), 255, np.uint8)
    grey[100:110, 50:250] = 20
    s = colour.signals(grey)
    assert set(s) == set(readers.SIGNALS) and s["hasler"] == 0 and s["nongrey20"] == 0 and s["cc_med_area"] == 2000 and s["cc_big_frac"] == 1
    assert abs(s["ink"] - 2000 / 320**2) < 1e-9 and s["midtone"] == 0
    assert colour.tiles(700, 500) == [(0, 0, 320, 320), (320, 0, 640, 320), (0, 320, 320, 500), (320, 320, 640, 500)]


def test_figures():
    page = np.full((140, 160, 3), 255, np.uint8)
    page[40:100, 30:120] = (200, 40, 40)
    page[120:122, ::3] = 0
    assert not colour.is_line_art(page[40:100, 30:120]) and colour.is_line_art(page[110:140])
    x0, y0, x1, y1 = colour.grow_box(page, (50, 50, 100, 90))
    assert x0 <= 34 and y0 <= 42 and 116 <= x1 <= 124 and 98 <= y1 <= 104
    assert colour.grow_box(page, (50, 60, 60, 66)) == (50, 60, 60, 66)  # a picture far larger than the box


def test_gutter():
    spread = np.zeros((480, 1000), bool)
    spread[40:440:8, 60:460] = spread[40:440:8, 540:940] = True
    assert colour.gutter(spread) == (500, 80)
    single = np.zeros((480, 1000), bool)
    single[40:440:8, 60:940] = True
    assert colour.gutter(single) is None and colour.gutter(np.zeros((100, 100), bool)) is None


def test_notes_and_paragraphs(spark):
    rows = [("d", i, t) for i, t in enumerate(["1 First note is bro-", "ken here.", "* Second", "3 Third"])]
    found = paragraphs.notes(spark.createDataFrame(rows, "doc string, line int, text string")).orderBy("note").collect()
    assert [r["text"] for r in found] == ["1 First note is broken here.", "* Second", "3 Third"]
    lines = [("A Title", 20.0), ("Some text that goes", 10.0), ("on and ends.", 10.0), ("• an item", 10.0), ("# not a heading", 10.0)]
    rows = [("d", i, 100.0 + 14 * i, 50.0, 50.0 + 5 * len(t), s, False, t, i == 0) for i, (t, s) in enumerate(lines)]
    table = spark.createDataFrame(rows, "doc string, line int, base double, x0 double, x1 double, size double, bold boolean, text string, col_start boolean")
    body = spark.createDataFrame([("d", 10.0)], "doc string, body double")
    text = [r["text"] for r in paragraphs.paragraphs(paragraphs.paragraph_breaks(table, body)).orderBy("para").collect()]
    assert text == ["## A Title", "Some text that goes on and ends.", "- an item # not a heading"] or text == ["## A Title", "Some text that goes on and ends.", "- an item", "\\# not a heading"]


def test_headers_go_by_the_share_of_pages(spark):
    from quirespark.operators import headers

    # 12 pages: "seldom" is on 2, "head" stands clear on 3, "near" is close to the text on 5, "often" close to it on 6.
    first = ["seldom\n"] * 2 + ["head\n"] * 3 + ["near"] * 5 + ["only a\n", "only b\n"]
    rows = [("s", i, f"{top}\nbody {'abcdefghijkl'[i]}\nmore {'abcdefghijkl'[i]}\n{'often' if i < 6 else 'end ' + 'abcdefghijkl'[i]}") for i, top in enumerate(first)]
    left = headers.without_headers(headers.lines(spark.createDataFrame(rows, "s string, p int, t string"), "s", "p", "t"))
    texts = [r["text"] for r in left.collect()]
    assert [texts.count(x) for x in ("seldom", "head", "near", "often")] == [2, 0, 5, 0]


def test_colour_slots():
    rgb = np.arange(6 * 8 * 3, dtype=np.uint8).reshape(6, 8, 3)
    assert (raster.colour_cut(rgb, (2, 1, 6, 5), 0.0, 1.0) == rgb[1:5, 2:6]).all()
    slot = raster.colour_slot(rgb, 20, 10, 0.5)
    assert slot.shape == (6, 12, 3) and (slot[:, 2:10] == rgb).all() and (slot[:, :2] == 255).all()
    turned = raster.colour_cut(rgb, (0, 0, 8, 6), 30.0, 1.0)
    assert turned.shape == (10, 10, 3)
    assert [c.shape[:2] for c in raster.figure_cuts(rgb, [(0, 0, 2, 2), (0, 0, 0.5, 3), (1, 1, 3, 2)], 2.0)] == [(4, 4), (2, 4)]


def test_loaded_pages():
    v = np.array([[0.0, 1.0], [1.0, 0.0]])
    twice = raster.loaded(v, (0.5, 0, 0, 0.5, 0, 0), 4, 4, False)
    assert (twice == np.kron(v, np.ones((2, 2)))).all()
    smooth = raster.loaded(v, (0.5, 0, 0, 0.5, 0, 0), 4, 4, True)
    assert 0 < smooth[0, 1] < 1 and (raster.loaded(v, (1, 0, 0, 1, 0, 0), 2, 2, True) == v).all()


def test_sliver_half():
    mask = np.zeros((400, 1000), bool)
    mask[40:360:8, 560:940:2] = mask[41:360:8, 560:940:2] = mask[42:360:8, 560:940:2] = True
    mask[100:164:8, 100:480:2] = mask[101:164:8, 100:480:2] = mask[102:164:8, 100:480:2] = True
    assert raster.spread_box(mask, (450, 30, 950, 370), 500)[0] < 110 and raster.spread_box(mask, (450, 30, 950, 370), 500)[2] == 950
    assert raster.spread_box(mask, (100, 30, 950, 370), 500) == (100, 30, 950, 370)


def test_pdf(spark, tmp_path):
    line = [(b"a (b)", 10.0, 20.0, 110.0, 32.0)]
    kinds = "doc string, page int, w double, h double, iw int, ih int, grey binary, lines array<struct<s:binary,x0:double,y0:double,x1:double,y1:double>>"
    rows = [("d", 2, 200.0, 300.0, 2, 1, b"\x00\xff", line), ("d", 1, 200.0, 300.0, 1, 2, b"\x10\x20", None), ("e", 1, 50.0, 60.0, 1, 1, b"\x80", [])]
    found = {r["doc"]: r for r in writers.pdf_documents(spark.createDataFrame(rows, kinds)).collect()}
    assert {k: r["n_pages"] for k, r in found.items()} == {"d": 2, "e": 1}
    content = bytes(found["d"]["content"])
    places = [int(x[:10]) for x in content[content.rindex(b"xref\n0") :].split(b"\n")[3:] if x.endswith(b" n ")]
    assert len(places) == 9 and all(content[p:].startswith(b"%d 0 obj" % n) for n, p in enumerate(places, 1))
    assert content.index(b"/Width 1 ") < content.index(b"/Width 2 ") and b"3 Tr" in content and b"(a \\(b\\)) Tj" in content
    (tmp_path / "d.pdf").write_bytes(content)
    assert [r["n_pages"] for r in readers.n_pages(readers.documents(spark, str(tmp_path))).collect()] == [2]


def test_figure_files(spark):
    table = spark.createDataFrame([("book", 3, 1, "png", bytearray(b"xyz"))], "stem string, page int, n int, ext string, content binary")
    assert [(r["name"], bytes(r["content"])) for r in writers.figure_files(table).collect()] == [("book_p3_1.png", b"xyz")]


def test_blank_facing_pages(spark):
    rows = [("d", 1, 1000, 700, False, (500, 60), (520, 20, 900, 600)), ("d", 2, 1000, 700, False, (500, 60), (100, 20, 480, 600)), ("d", 3, 1000, 700, False, (500, 60), (100, 20, 900, 600))]
    table = spark.createDataFrame(rows, "doc string, page int, w long, h long, vector boolean, gutter struct<x: long, w: long>, trim struct<x0: long, y0: long, x1: long, y1: long>")
    found = {r["page"]: r for r in pages.plans(table).collect()}
    assert [tuple(found[k]["box"]) for k in (1, 2, 3)] == [(100, 20, 900, 600), (100, 20, 900, 600), (100, 20, 900, 600)] and {r["kind"] for r in found.values()} == {"split"}


def test_file_names_are_composed(spark):
    import unicodedata

    from quirespark.operators import evaluate

    name = "Übung é.pdf"
    signals = spark.createDataFrame([(unicodedata.normalize("NFD", name), 1, 0.5), ("b", 1, 0.1)], "file string, page int, hasler double")
    labels = spark.createDataFrame([(name, 1, "picture"), ("b", 2, "x")], "file string, page int, class string")
    assert [(r["file"], r["class"], r["hasler"]) for r in evaluate.with_labels(signals, labels).collect()] == [(name, "picture", 0.5)]


def test_stray_commas(spark, tmp_path):
    text = '{"pdf_info": [, {"page_size": [10, 20,], "para_blocks": [{"type": "image,]", "bbox": [1,2,,3,4],},], "discarded_blocks": [],},],}'
    (tmp_path / "one.json").write_text(text)
    r = readers.layout(spark, str(tmp_path)).first()
    assert (r["ordinal"], r["w"], r["h"], r["blocks"][0]["type"], r["blocks"][0]["bbox"]) == (0, 10.0, 20.0, "image,]", [1.0, 2.0, 3.0, 4.0])
