"""Writers: Markdown, page reports, review lists, figure files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import figure_name
from ..operators.folds import fold_groups
from ..scratch import small_batches, written


def markdown(pages: DataFrame, path: str) -> None:
    """One text file below path for each document: pages has doc, page and markdown (page markers included)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "markdown"))), lambda p: p["markdown"])
    whole = pages.groupBy("doc").agg(F.array_join(parts, "").alias("value"))  # the pages of one document
    whole.write.partitionBy("doc").text(path)


def page_report(report: DataFrame, path: str, figures: bool = False) -> None:
    """Tab-separated: page, label, kind, glyphs, unmapped, rotated, tables, image share, and figures if wanted."""
    columns = ["page", "label", "kind", "glyphs", "unmapped", "rotated", "tables", "image_share", *["figures"] * figures]
    report.select("doc", *columns).sortWithinPartitions("doc", "page").write.option("sep", "\t").option("header", True).csv(path)


def smaller_only(outputs: DataFrame, force: bool = False) -> DataFrame:
    """Outputs that are smaller than their inputs; all of them with colour pages or a layout."""
    return outputs if force else outputs.where("n_bytes_out < n_bytes_in")


def review(planned: DataFrame) -> DataFrame:
    """doc, pages: those that look double and have no gutter to trust, in order; status is 2 for these documents, else 0."""
    numbers = F.array_sort(F.collect_list(F.when(F.col("kind") == "review", F.col("page"))))
    return planned.groupBy("doc").agg(numbers.alias("pages")).withColumn("status", F.when(F.size("pages") > 0, 2).otherwise(0))


def png(w: int, h: int, rgb: bytes) -> bytes:
    """An 8-bit RGB image as PNG."""
    import struct

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + rgb[y * 3 * w : (y + 1) * 3 * w] for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


#: The width of a letter and the height of a line of the invisible text, in sizes, and how far its baseline lies above the box's foot.
LETTER, LINE, BASELINE = 0.6, 0.786, 0.157
#: What a string in parentheses needs a backslash for.
_SIGNS = re.compile(rb"[()\\]")


def text_layer(lines: list[dict], height: float, visible: bool = False) -> bytes:
    """Text over a page, by default found but not seen: each line (s, x0, y0, x1, y1 from the top, in points) fills its box, stretched sideways."""
    out = []
    for line in lines:
        raw = bytes(line["s"])
        size = (line["y1"] - line["y0"]) / LINE
        if not raw or size <= 0 or line["x1"] <= line["x0"]:
            continue
        stretch = 100 * (line["x1"] - line["x0"]) / (LETTER * size * len(raw))
        shown = _SIGNS.sub(rb"\\\g<0>", raw)
        out.append(b"%.2f Tz /F1 %.2f Tf 1 0 0 1 %.2f %.2f Tm (%s) Tj" % (stretch, size, line["x0"], height - line["y1"] + BASELINE * size, shown))
    return b"BT %d Tr " % (0 if visible else 3) + b" ".join(out) + b" ET" if out else b""


#: Kinds of images: colour space and bits of a sample.
KINDS = {"bit": (b"DeviceGray", 1), "grey": (b"DeviceGray", 8), "rgb": (b"DeviceRGB", 8)}
#: Pages below one node of a PDF's page tree, and rows that a running sum goes over at once.
NODE_PAGES, CHUNK = 256, 1024
#: Whole files that are sent on at a time.
FILES = 16
_FIXED = 3  # catalog, root of the page tree, font


def _stream(head: bytes, data: bytes) -> bytes:
    return b"<< %s/Length %d >>\nstream\n%s\nendstream" % (head, len(data), data)


def _image(image: dict) -> bytes:
    space, bits = KINDS[image.get("kind") or "grey"]
    head = b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /%s /BitsPerComponent %d /Filter /FlateDecode " % (image["iw"], image["ih"], space, bits)
    return _stream(head, zlib.compress(bytes(image["px"])))


def page_objects(page: dict, first: int, parent: int) -> list[bytes]:
    """The objects of a page, numbered from `first`: page, content, its image (if it has one) and its figures. page: w, h (points), lines (text_layer()),
    visible, figures (x0, y0, x1, y1 in points from the top, iw, ih, kind, px; drawn over the image), and iw, ih, kind, px (or grey) of an image of the whole page."""
    w, h = page["w"], page["h"]
    px = page.get("px", page.get("grey"))
    whole = [{"x0": 0.0, "y0": 0.0, "x1": w, "y1": h, "px": px, **{c: page.get(c) for c in ("iw", "ih", "kind")}}] if px is not None else []
    images = whole + [dict(f) for f in (page.get("figures") if page.get("figures") is not None else [])]
    drawn = b"".join(b"q %.2f 0 0 %.2f %.2f %.2f cm /Im%d Do Q " % (i["x1"] - i["x0"], i["y1"] - i["y0"], i["x0"], h - i["y1"], k) for k, i in enumerate(images))
    lines = page.get("lines")
    content = drawn + text_layer([] if lines is None else list(lines), h, bool(page.get("visible")))
    named = b" ".join(b"/Im%d %d 0 R" % (k, first + 2 + k) for k in range(len(images)))
    about = b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 %.2f %.2f] /Resources << /XObject << %s >> /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (parent, w, h, named, first + 1)
    return [about, _stream(b"", content), *[_image(i) for i in images]]


def _numbered(objects: list[bytes], first: int) -> list[bytes]:
    return [b"%d 0 obj\n%s\nendobj\n" % (first + k, body) for k, body in enumerate(objects)]


_HEAD = [b"%PDF-1.4\n", *_numbered([b"<< /Type /Catalog /Pages 2 0 R >>"], 1), *_numbered([b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"], 3)]


def pdf(pages: list[dict]) -> bytes:
    """A PDF of a few pages in one piece (page_objects())."""
    places, out, at, n, kids = {1: len(_HEAD[0]), 3: len(_HEAD[0]) + len(_HEAD[1])}, [*_HEAD], sum(map(len, _HEAD)), _FIXED + 1, []
    for page in pages:
        kids.append(n)
        for body in _numbered(page_objects(page, n, 2), n):
            places[n], at, n = at, at + len(body), n + 1
            out.append(body)
    places[2] = at
    out += _numbered([b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % k for k in kids))], 2)
    at += len(out[-1])
    out.append(b"xref\n0 %d\n0000000000 65535 f \n" % n + b"".join(b"%010d 00000 n \n" % places[k] for k in range(1, n)))
    out.append(b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (n, at))
    return b"".join(out)


def pdf_documents(pages: DataFrame) -> DataFrame:
    """doc, n_pages, content: a PDF of each document's pages in order, as one value; for documents that fit one. pages: doc, page and what page_objects() takes."""

    names = [c for c in pages.columns if c != "doc"]

    def build(rows: list[tuple]) -> list[tuple]:
        return [(len(rows), pdf([dict(zip(names, r, strict=True)) for r in rows]))]

    small_batches(pages.sparkSession)
    return fold_groups(pages.select("doc", *names), ["doc"], ["page"], build, "n_pages int, content binary", batch=FILES)


def before_sums(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows (doc, order from 0, value) with name: the sum of value over all earlier rows of the document; by chunks of CHUNK rows, then over chunks."""
    chunked = rows.withColumn("chunk", F.expr(f"{order} div {CHUNK}"))
    totals = chunked.groupBy("doc", "chunk").agg(F.sum(value).alias("total"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("base", F.coalesce(F.sum("total").over(earlier("doc").orderBy("chunk")), F.lit(0))).drop("total")
    inside = F.coalesce(F.sum(value).over(earlier("doc", "chunk").orderBy(order)), F.lit(0))
    return chunked.withColumn("inside", inside).join(bases, ["doc", "chunk"]).withColumn(name, (F.col("base") + F.col("inside")).cast("long")).drop("chunk", "base", "inside")


def pdf_parts(pages: DataFrame) -> DataFrame:
    """doc, section, k, bytes: the pieces of each document's PDF; in order of section and k, end to end, they are the file.

    Object numbers and places in the file are running sums over pages, so no document is ever in one place, however many pages
    it has. pages: doc, page (from 0, without gaps) and what page_objects() takes, each column or none.
    """
    figures = F.size(F.coalesce("figures", F.array())) if "figures" in pages.columns else F.lit(0)
    px = next((c for c in ("px", "grey") if c in pages.columns), None)
    whole = F.when(F.col(px).isNotNull(), 1).otherwise(0) if px else F.lit(0)
    counts = pages.select("doc", "page", (2 + figures + whole).cast("long").alias("n_objects"))
    sizes = counts.groupBy("doc").agg(F.count("*").alias("n_pages"), F.sum("n_objects").alias("n_objects")).withColumn("n_nodes", F.expr(f"(n_pages + {NODE_PAGES - 1}) div {NODE_PAGES}"))
    numbers = before_sums(counts, "page", "n_objects", "before").join(sizes.select("doc", "n_nodes"), "doc")
    placed = numbers.select("doc", "page", (F.lit(_FIXED + 1) + F.col("n_nodes") + F.col("before")).alias("first"), (F.lit(_FIXED + 1) + F.expr(f"page div {NODE_PAGES}")).alias("parent"))
    kind = dict(pages.dtypes)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                bodies = _numbered(page_objects(row, row["first"], row["parent"]), row["first"])
                yield pd.DataFrame({"doc": [row["doc"]], "page": [row["page"]], "first": [row["first"]], "lengths": [[len(b) for b in bodies]], "bytes": [b"".join(bodies)]})

    # Written once: what is compressed here is read for its lengths and for its bytes.
    parts = written(pages.join(placed, ["doc", "page"]).mapInPandas(build, f"doc {kind['doc']}, page {kind['page']}, first long, lengths array<long>, bytes binary"))
    text = lambda form, *columns: F.encode(F.format_string(form, *columns), "ISO-8859-1")
    row = lambda section, k, data: (F.lit(section).alias("section"), k.cast("long").alias("k"), data.alias("bytes"))
    entries = lambda places: F.encode(F.array_join(F.transform(places, lambda p: F.format_string("%010d 00000 n \n", p)), ""), "ISO-8859-1")
    head = sum(map(len, _HEAD))
    offsets = before_sums(parts.select("doc", "page", F.aggregate("lengths", F.lit(0).cast("long"), lambda t, x: t + x).alias("size"), "lengths"), "page", "size", "before")
    each = F.transform("lengths", lambda _, i: F.lit(head) + F.col("before") + F.aggregate(F.slice("lengths", F.lit(1), i), F.lit(0).cast("long"), lambda t, x: t + x))
    nodes = parts.groupBy("doc", F.expr(f"page div {NODE_PAGES}").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("first")), lambda n: F.format_string("%d 0 R", n)), " ").alias("kids"), F.count("*").alias("n"))  # of NODE_PAGES at most
    node = nodes.select("doc", "node", text(f"%d 0 obj\n<< /Type /Pages /Parent 2 0 R /Count %d /Kids [%s] >>\nendobj\n", F.col("node") + _FIXED + 1, F.col("n"), F.col("kids")).alias("bytes"))
    page_bytes = offsets.groupBy("doc").agg(F.sum("size").alias("page_bytes"))
    node_places = before_sums(node.withColumn("size", F.length("bytes")), "node", "size", "before").join(page_bytes, "doc").withColumn("at", F.lit(head) + F.col("page_bytes") + F.col("before"))
    node_bytes = node_places.groupBy("doc").agg(F.sum("size").alias("node_bytes"))
    kids = F.array_join(F.transform(F.sequence(F.lit(_FIXED + 1), F.col("n_nodes").cast("int") + _FIXED), lambda n: F.format_string("%d 0 R", n)), " ")
    whole_file = sizes.join(page_bytes, "doc").join(node_bytes, "doc").withColumn("root", text("2 0 obj\n<< /Type /Pages /Count %d /Kids [%s] >>\nendobj\n", F.col("n_pages"), kids))
    whole_file = whole_file.withColumn("root_at", F.lit(head) + F.col("page_bytes") + F.col("node_bytes")).withColumn("n", F.lit(_FIXED + 1) + F.col("n_nodes") + F.col("n_objects"))
    zero = F.lit(0)
    table = text("xref\n0 %d\n0000000000 65535 f \n%010d 00000 n \n%010d 00000 n \n%010d 00000 n \n", F.col("n"), F.lit(len(_HEAD[0])), F.col("root_at"), F.lit(len(_HEAD[0]) + len(_HEAD[1])))
    end = text("trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n", F.col("n"), F.col("root_at") + F.length("root"))
    rows = [
        whole_file.select("doc", *row(0, zero, F.lit(b"".join(_HEAD)))), parts.select("doc", *row(1, F.col("page"), F.col("bytes"))), node.select("doc", *row(2, F.col("node"), F.col("bytes"))), whole_file.select("doc", *row(3, zero, F.col("root"))),
        whole_file.select("doc", *row(4, zero, table)), node_places.select("doc", *row(5, F.col("node"), entries(F.array("at")))), offsets.select("doc", *row(6, F.col("page"), entries(each))), whole_file.select("doc", *row(7, zero, end)),
    ]
    return reduce(DataFrame.unionByName, rows)


def colour_copies(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """pdf_parts() of the colour copies of listed pages, as documents of their own, numbered anew. pages: doc, page and what page_objects() takes; wanted: doc, page."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page")) - 1
    listed = pages.join(wanted.select("doc", "page").distinct(), ["doc", "page"], "left_semi").select("doc", "page")
    return pdf_parts(pages.join(listed.withColumn("new", place), ["doc", "page"]).drop("page").withColumnRenamed("new", "page"))


def figure_files(figures: DataFrame) -> DataFrame:
    """name, content of figures (stem, page, n, ext, content): <stem>_p<page>_<n>.<ext>. Rows rather than files: what stores them
    decides where, as a folder of one machine is none for a cluster."""
    return figures.select(figure_name(F.col("stem"), F.col("page"), F.col("n"), F.col("ext")).alias("name"), "content")
