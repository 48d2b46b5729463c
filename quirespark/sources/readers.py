"""Readers of what page measurement works on: labels, signals, logs, facts, layout JSON, documents and rasters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pdf import Pdf

#: The signals of a page or tile, in the order of their columns.
SIGNALS = ["hasler", "nongrey20", "nongrey60", "lum_std", "midtone", "entropy", "ink", "cc_per_mpx", "cc_med_area", "cc_big_frac", "edge"]

_LINE = "struct<bbox:array<double>,spans:array<struct<type:string,content:string>>>"
_INNER = f"struct<type:string,bbox:array<double>,lines:array<{_LINE}>>"
_BLOCK = f"struct<type:string,bbox:array<double>,lines:array<{_LINE}>,blocks:array<{_INNER}>>"
LAYOUT = f"pdf_info array<struct<page_size:array<double>,para_blocks:array<{_BLOCK}>,discarded_blocks:array<{_BLOCK}>>>"


def file_stem(path: F.Column) -> F.Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, content, n_bytes of the PDF files below path; pages are counted by n_pages()."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select(file_stem(F.col("path")).alias("doc_id"), "path", "content", F.col("length").alias("n_bytes"))


def n_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_pages of PDFs, object streams included, from the page tree alone; null: not a PDF that can be read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for content in batch.column(1).to_pylist():
                data = content or b""
                try:
                    found.append(Pdf(lambda at, n, data=data: data[at : at + n], len(data)).n_pages())
                except Exception:  # noqa: BLE001  a file that can't be read has no count
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=["doc_id", "n_pages"])

    return docs.select("doc_id", "content").mapInArrow(count, f"doc_id {dict(docs.dtypes)['doc_id']}, n_pages int")


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, w, h, channels, px of images (PNG, JPEG, TIFF) below path; px is BGR or grey, row by row."""
    read = spark.read.format("image").option("dropInvalid", True).load(path)
    return read.select(file_stem(F.col("image.origin")).alias("doc_id"), F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("px"))


def layout(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, w, h, blocks, discarded: the pages of layout files; stray commas are overlooked, a file that can't be parsed all the same
    fails the read."""
    read = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), without_stray_commas(F.col("value")).alias("value"))
    return layout_pages(read.select("file", F.from_json("value", LAYOUT, {"mode": "FAILFAST"})["pdf_info"].alias("pdf_info")))


def without_stray_commas(json: F.Column) -> F.Column:
    """JSON without commas that nothing follows or nothing precedes; what is inside strings stays."""
    string = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'
    trailing = F.regexp_replace(json, rf"(?s){string}|,(?=[\s,]*[\]}}])|,(?=\s*,)", "$1")
    return F.regexp_replace(trailing, rf"(?s){string}|([\[{{]\s*),", "$1$2")


def layout_pages(parsed: DataFrame) -> DataFrame:
    each = parsed.select("file", F.posexplode("pdf_info").alias("ordinal", "page"))
    return each.select("file", "ordinal", F.get("page.page_size", F.lit(0)).alias("w"), F.get("page.page_size", F.lit(1)).alias("h"), F.col("page.para_blocks").alias("blocks"), F.col("page.discarded_blocks").alias("discarded"))


def figure_boxes(pages: DataFrame) -> DataFrame:
    """file, ordinal, n, bbox: the bodies of image and chart blocks."""
    block = pages.select("file", "ordinal", F.posexplode("blocks").alias("n", "block")).where("block.type in ('image', 'chart')")
    return block.select("file", "ordinal", "n", F.explode("block.blocks").alias("inner")).where("inner.type rlike '_body$'").select("file", "ordinal", "n", F.col("inner.bbox").alias("bbox"))


def fit_boxes(figures: DataFrame, sizes: DataFrame, pad: float = 3.0, tolerance: float = 2.0) -> DataFrame:
    """figure_boxes() scaled to output pages (file, ordinal, lw, lh, w, h), padded and clamped; none where sizes disagree."""
    joined = figures.join(sizes, ["file", "ordinal"]).where((F.abs(F.col("w") - F.col("lw")) <= tolerance) & (F.abs(F.col("h") - F.col("lh")) <= tolerance))
    at = lambda i: F.get("bbox", F.lit(i))
    x, y = F.col("w") / F.col("lw"), F.col("h") / F.col("lh")
    box = joined.select("file", "ordinal", "n", F.greatest(at(0) * x - pad, F.lit(0.0)).alias("x0"), F.greatest(at(1) * y - pad, F.lit(0.0)).alias("y0"), F.least(at(2) * x + pad, F.col("w")).alias("x1"), F.least(at(3) * y + pad, F.col("h")).alias("y1"))
    return box.where("x1 > x0 and y1 > y0")


def block_lines(pages: DataFrame) -> DataFrame:
    """file, ordinal, n, line, bbox, text: the text spans of the lines of blocks and of the blocks inside them."""
    block = pages.select("file", "ordinal", F.posexplode(F.concat("blocks", "discarded")).alias("n", "block"))
    nested = F.coalesce(F.flatten(F.transform("block.blocks", lambda b: F.coalesce(b["lines"], F.array().cast(f"array<{_LINE}>")))), F.array().cast(f"array<{_LINE}>"))
    lines = F.concat(F.coalesce("block.lines", F.array().cast(f"array<{_LINE}>")), nested)
    each = block.select("file", "ordinal", "n", F.posexplode(lines).alias("line", "l"))
    spans = F.filter("l.spans", lambda s: s["type"] == "text")
    return each.select("file", "ordinal", "n", "line", F.col("l.bbox").alias("bbox"), F.array_join(F.transform(spans, lambda s: s["content"]), " ").alias("text"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """file, page, classes, certain, regions (class, x0, y0, x1, y1, unsure; as shares of the page) of label files."""
    lines = spark.read.text(path).select(file_stem(F.input_file_name()).alias("file"), "value").where("value <> '' and value not like '#%'")
    part = F.split("value", "\t")
    column = lambda i: F.coalesce(F.get(part, F.lit(i)), F.lit(""))

    def region(text: F.Column) -> F.Column:
        box = F.transform(F.split(F.replace(F.get(F.split(text, ":"), F.lit(1)), F.lit("?"), F.lit("")), ","), lambda x: x.cast("double"))
        return F.struct(F.get(F.split(text, ":"), F.lit(0)).alias("class"), *[F.get(box, F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], text.endswith("?").alias("unsure"))

    regions = F.transform(F.filter(F.split(column(3), ";"), lambda r: r.contains(":")), region)
    return lines.select("file", column(0).cast("int").alias("page"), F.filter(F.split(column(1), ","), lambda c: c != "").alias("classes"), (column(2) == "1").alias("certain"), regions.alias("regions"), column(4).alias("note"))


def signals(spark: SparkSession, path: str) -> DataFrame:
    """file, page, scope, box, raster size and the signals of pages and tiles; lines with a number sign are headings."""
    schema = "file string, page int, scope string, x0 int, y0 int, x1 int, y1 int, W int, H int, " + ", ".join(f"{s} double" for s in SIGNALS)
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def facts(spark: SparkSession, path: str) -> DataFrame:
    """page, w, h, x0, y0, x1, y1, foot from lines of numbers (boxes in thousandths of the page)."""
    part = F.split(F.trim("value"), r"\s+")
    names = ["page", "w", "h", "x0", "y0", "x1", "y1", "foot"]
    rows = spark.read.text(path).where("trim(value) rlike '^[0-9]'")
    return rows.select(*[F.get(part, F.lit(i)).cast("double" if c in ("w", "h") else "int").alias(c) for i, c in enumerate(names)])


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, page, box (null where none), gutter, slots from progress logs: lines `f1 12: ... box Some([10, 20, 300, 400]) ... gutter
    Some((155, ...` or `None`, and lines `f1 12: ... deskew [0.1, 0.2]` with a value for each slot; joined by file and page."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^(\S+) \d+:", 1).alias("file"), F.regexp_extract("value", r"^\S+ (\d+):", 1).alias("page"), "value").where("file <> ''")
    box = F.transform(F.split(F.nullif(F.regexp_extract("value", r"box Some\(\[(\d+, \d+, \d+, \d+)\]\)", 1), F.lit("")), ", "), lambda x: x.cast("int"))
    gutter = F.nullif(F.regexp_extract("value", r"gutter Some\(\((\d+),", 1), F.lit("")).cast("int")
    slots = F.size(F.split(F.nullif(F.regexp_extract("value", r"deskew \[([^\]]*)\]", 1), F.lit("")), ","))
    each = rows.select("file", F.col("page").cast("int").alias("page"), box.alias("box"), gutter.alias("gutter"), F.when(F.col("value").contains("deskew ["), slots).alias("slots"))
    return each.groupBy("file", "page").agg(*[F.max(c).alias(c) if c != "box" else F.first(c, ignorenulls=True).alias(c) for c in ("box", "gutter", "slots")])
