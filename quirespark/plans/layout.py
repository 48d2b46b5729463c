"""Queries of the page layout: rows, sections, tables, headers, components and canvases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boxes as B
from ..operators import assembly, glyphs, headers, layout, profiles, raster, reading, ring
from ..scratch import written
from ..sources import pdf, writers
from .queries import _PROFILE, _profile, query, table

# --- fragments: documents as fragments of pages of sixteen -----------------------------------------------------------------

_FRAGS = """fr AS (SELECT doc_id // 16 AS doc, doc_id AS id, ((length(text) * 7) % 23)::DOUBLE AS base, (length(text) % 37) * 10.0::DOUBLE AS x0, (length(text) % 37) * 10.0::DOUBLE + 40 + length(text) % 90 AS x1,
  8.0::DOUBLE + length(text) % 5 AS size FROM documents WHERE text IS NOT NULL)"""


def _frags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    x0 = (n % 37) * F.lit(10.0)
    return table(spark, sf_dir, "documents").where("text is not null").select(
        F.expr("doc_id div 16").alias("doc"), F.col("doc_id").alias("id"), ((n * 7) % 23).cast("double").alias("base"), x0.alias("x0"), (x0 + 40 + n % 90).alias("x1"), (F.lit(8.0) + n % 5).alias("size"), "text"
    )


_ROWS = f"""{_FRAGS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY base, x0, id) AS k FROM fr),
r AS (SELECT doc, k, id, base AS fb, size AS fs, 1 AS row FROM o WHERE k = 1 UNION ALL
  SELECT o.doc, o.k, o.id, CASE WHEN abs(o.base - fb) >= 0.3 * least(o.size, fs) THEN o.base ELSE fb END, CASE WHEN abs(o.base - fb) >= 0.3 * least(o.size, fs) THEN o.size ELSE fs END,
    CASE WHEN abs(o.base - fb) >= 0.3 * least(o.size, fs) THEN row + 1 ELSE row END FROM r JOIN o ON o.doc = r.doc AND o.k = r.k + 1)"""


@query(f"WITH RECURSIVE {_ROWS} SELECT doc, id, row::INT AS row FROM r")
def column_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_rows(_frags(spark, sf_dir), ["doc"]).select("doc", "id", "row")


@query(f"""WITH RECURSIVE {_ROWS}, j AS (SELECT r.row, fr.* FROM r JOIN fr ON fr.doc = r.doc AND fr.id = r.id)
SELECT doc, row::INT AS row, min(x0) AS x0, arg_max(x1, (x0, x1, base)) AS x1, arg_min(base, (x0, x1, base)) AS base, max(size) AS size FROM j GROUP BY doc, row""")
def row_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    frags = _frags(spark, sf_dir)
    rows = layout.column_rows(frags, ["doc"]).select("doc", "id", "row").join(frags.withColumn("text", F.lit("")), ["doc", "id"])
    return layout.row_lines(rows, ["doc"]).select("doc", "row", "x0", "x1", "base", "size")


@query(f"""WITH {_FRAGS}, s AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY base) AS strip FROM fr), o AS (SELECT *, max(x1) OVER (PARTITION BY doc, strip ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
n AS (SELECT *, sum(CASE WHEN m IS NULL OR x0 > m THEN 1 ELSE 0 END) OVER (PARTITION BY doc, strip ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS span FROM o),
sp AS (SELECT doc, strip, span, min(x0) AS x0, max(x1) AS x1 FROM n GROUP BY doc, strip, span), g AS (SELECT doc, strip, x1 AS g0, lead(x0) OVER (PARTITION BY doc, strip ORDER BY x0) AS g1 FROM sp)
SELECT doc, strip, g0 AS x0, g1 AS x1 FROM g WHERE g1 - g0 >= 0.6 * 10""")
def interior_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    stripped = _frags(spark, sf_dir).withColumn("strip", F.dense_rank().over(Window.partitionBy("doc").orderBy("base")).cast("long"))
    return glyphs.interior_gutters(glyphs.spans(stripped), stripped.select("doc", F.lit(10.0).alias("body")).distinct())


def _strip_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    narrow = _frags(spark, sf_dir).withColumn("x1", F.col("x0") + F.least(F.col("x1") - F.col("x0"), F.lit(60.0)))
    stripped = narrow.withColumn("strip", F.dense_rank().over(Window.partitionBy("doc").orderBy("base")).cast("long"))
    spans = glyphs.spans(stripped).groupBy("doc", "strip").agg(F.collect_list(F.struct("x0", "x1")).alias("spans"))  # of one strip
    return stripped, layout.sections(spans, stripped.select("doc", F.lit(10.0).alias("body")).distinct())


@query()
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of fragments to sections that keep their gutters."""
    return _strip_spans(spark, sf_dir)[1].select("doc", "strip", "section", F.size("gutters").alias("n_gutters"))


_CELLS = """c AS (SELECT l_orderkey // 32 AS doc, (l_orderkey % 8)::INT AS section, l_linenumber::INT AS col, (1 + l_orderkey // 8 % 4)::INT AS row, l_partkey * 1.0::DOUBLE AS x0, l_returnflag || ' ' || l_linestatus AS text FROM lineitem WHERE l_linenumber <= 1 + l_orderkey % 8 % 4)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    each = table(spark, sf_dir, "lineitem").where("l_linenumber <= 1 + l_orderkey % 8 % 4")
    return each.select(
        F.expr("l_orderkey div 32").alias("doc"), (k % 8).cast("int").alias("section"), F.col("l_linenumber").cast("int").alias("col"), F.expr("int(1 + l_orderkey div 8 % 4)").alias("row"), F.col("l_partkey").cast("double").alias("x0"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text")
    )


@query(f"""WITH {_CELLS}, e AS (SELECT doc, section, col, count(DISTINCT row) AS n FROM c GROUP BY ALL), s AS (SELECT doc, section, count(*) AS n_cols, min(n) AS fewest FROM e GROUP BY ALL),
w AS (SELECT doc, section, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS words, row_number() OVER (PARTITION BY doc, section ORDER BY len(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS k, count(*) OVER (PARTITION BY doc, section) AS n FROM c)
SELECT doc, section, n_cols, CASE WHEN n_cols >= 3 AND fewest >= 2 AND words <= 4 THEN 'table' WHEN n_cols >= 2 AND fewest >= 2 THEN 'columns' ELSE 'lines' END AS kind FROM s JOIN w USING (doc, section) WHERE k = n // 2 + 1""")
def section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, columns and plain lines, from order lines as cells."""
    return layout.section_kinds(_cells(spark, sf_dir))


@query(f"""WITH {_CELLS}, g AS (SELECT doc, section, row, col, string_agg(text, ' ' ORDER BY x0, text) AS cell FROM c GROUP BY ALL)
SELECT doc, section, row, md5(array_to_string(list_transform(range(1, 5), lambda i: coalesce(list_filter(list((col, cell)), lambda p: p[1] = i)[1][2], '')), '|')) AS md5 FROM g GROUP BY doc, section, row""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = layout.table_cells(_cells(spark, sf_dir).withColumn("col", F.col("col") - 1).withColumn("n_cols", F.lit(4)))
    return cells.select("doc", "section", "row", F.md5(F.array_join("cells", "|")).alias("md5"))


@query()
def superscript_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of small letters that join a larger row: documents as rows of three letters."""
    frags = _frags(spark, sf_dir).withColumn("size", F.col("size") - F.when(F.col("id") % 3 == 0, 4.0).otherwise(0.0))
    letter = lambda k: F.struct((F.col("x0") + 5 * k).alias("x0"), (F.col("x0") + 5 * k + 5).alias("x1"), F.col("base").alias("y"), "size")
    return layout.superscript_hosts(frags.select("doc", F.col("id").alias("row"), F.array(*[letter(k) for k in range(3)]).alias("letters")))


# --- headers as a whole -------------------------------------------------------------------------------------------------

_HEADERS = r"""
l0 AS (SELECT length(text) % 97 AS grp, doc_id AS page, len(string_split(text, chr(10))) AS n, unnest(range(len(string_split(text, chr(10))))) AS line, string_split(unnest(string_split(text, chr(10))), ', ') AS ps FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT grp, page, n, line, ps, unnest(range(len(ps))) AS k, unnest(ps) AS raw FROM l0),
l AS (SELECT grp, page, line * 100000 + k AS id, 15.0::DOUBLE * (line + 1) + 5 * (line % 2) AS base, 5.0::DOUBLE * (length(array_to_string(ps[1:k], ', ')) + CASE WHEN k > 0 THEN 2 ELSE 0 END) AS x0, 5.0::DOUBLE * length(raw) AS w, 15.0::DOUBLE * (n + 2) AS h, trim(raw) AS text FROM l1),
f AS (SELECT *, x0 + w AS x1, regexp_replace(lower(text), '#?[0-9]+', '#', 'g') AS norm, base + 2 < 0.12 * h OR base - 7 > 0.88 * h AS edge, base - 7 < h / 2 AS upper_half FROM l WHERE text <> ''),
t AS (SELECT *, NOT EXISTS (SELECT 1 FROM f o WHERE o.grp = b.grp AND o.page = b.page AND o.x0 < b.x1 AND o.x1 > b.x0 AND CASE WHEN b.upper_half THEN o.base < b.base - 3 ELSE o.base > b.base + 3 END) AS outer_,
  NOT EXISTS (SELECT 1 FROM f o WHERE o.grp = b.grp AND o.page = b.page AND CASE WHEN b.upper_half THEN o.base > b.base + 3 AND o.base < b.base + 18 ELSE o.base < b.base - 3 AND o.base > b.base - 18 END) AS clear,
  NOT EXISTS (SELECT 1 FROM f o WHERE o.grp = b.grp AND o.page = b.page AND o.id <> b.id AND abs(o.base - b.base) < 3 AND o.x0 < b.x1 + 30 AND o.x1 > b.x0 - 30) AS alone FROM f b WHERE edge),
pg AS (SELECT grp, count(DISTINCT page) AS n_pages FROM l0 GROUP BY grp), ct AS (SELECT grp, norm, count(DISTINCT page) AS n_with FROM t GROUP BY grp, norm),
x AS (SELECT t.*, n_with, n_pages, regexp_matches(text, '^[0-9]{1,4}$') AS is_number, list_transform(list_filter([regexp_replace(regexp_split_to_array(text, '\s+')[1], '^[^0-9]+|[^0-9]+$', '', 'g'), regexp_replace(regexp_split_to_array(text, '\s+')[-1], '^[^0-9]+|[^0-9]+$', '', 'g')], lambda w: regexp_matches(w, '^[0-9]{1,4}$')), lambda w: w::INT) AS numbers
  FROM t JOIN ct USING (grp, norm) JOIN pg USING (grp) WHERE outer_)"""


@query(rf"""WITH {_HEADERS} SELECT grp, page, id::BIGINT AS id FROM x WHERE is_number OR n_with >= greatest(3, (n_pages + 1) // 2) AND alone OR n_with >= greatest(2, n_pages // 4) AND clear OR list_contains(numbers, (page % 16)::INT) AND alone""")
def header_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost pieces of lines (cut at commas) of documents, in volumes by length: repeated ones, bare numbers and those with their page's label."""
    each = headers.lines(table(spark, sf_dir, "documents").withColumn("volume", F.char_length("text") % 97), "volume", "doc_id", "text")
    pieces = each.select("grp", "page", "line", "n_lines", F.split("text", ", ").alias("ps")).select("grp", "page", "line", "n_lines", "ps", F.posexplode("ps").alias("k", "raw"))
    x0 = F.lit(5.0) * (F.char_length(F.array_join(F.slice("ps", F.lit(1), F.col("k")), ", ")) + F.when(F.col("k") > 0, 2).otherwise(0))
    placed = pieces.select(
        "grp", "page", (F.col("line").cast("long") * 100_000 + F.col("k")).alias("id"), (F.lit(15.0) * (F.col("line") + 1) + 5 * (F.col("line") % 2)).alias("base"), x0.alias("x0"), (x0 + F.lit(5.0) * F.char_length("raw")).alias("x1"),
        F.lit(10.0).alias("size"), (F.lit(15.0) * (F.col("n_lines") + 2)).alias("h"), F.trim("raw").alias("text"),
    ).where("text <> ''")
    marked = placed.withColumn("edge", (F.col("base") + 2 < headers.EDGE * F.col("h")) | (F.col("base") - 7 > (1 - headers.EDGE) * F.col("h"))).withColumn("upper_half", F.col("base") - 7 < F.col("h") / 2)
    tested = marked.join(glyphs.header_tests(marked, ["grp", "page"], "id"), ["grp", "page", "id"]).withColumns(
        {"norm": T.normalised(F.col("text")), "number": F.when(F.col("text").rlike("^[0-9]{1,4}$"), T.page_number(F.col("text"))), "numbers": T.edge_numbers(F.col("text"))}
    )
    pages = each.groupBy("grp").agg(F.count_distinct("page").alias("n_pages"))
    labels = each.select("grp", "page").distinct().withColumn("label_numbers", F.array((F.col("page") % 16).cast("int")))
    return layout.header_lines(tested, pages, labels)


@query("""WITH sized AS (SELECT source AS doc, doc_id AS line, 8 + (length(text) % 60) / 7.0::DOUBLE AS size, length(text) AS n FROM documents WHERE text IS NOT NULL),
half AS (SELECT doc, round(size * 2) / 2 AS size, sum(n) AS n FROM sized GROUP BY 1, 2), body AS (SELECT doc, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, size DESC) AS r FROM half) WHERE r = 1),
h AS (SELECT doc, half.size FROM half JOIN body USING (doc) WHERE half.size >= 1.15 * body)
SELECT s.line, least((SELECT count(*) FROM h WHERE h.doc = s.doc AND h.size > round(s.size * 2) / 2) + 1, 4)::INT AS level FROM sized s""")
def line_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading level of every line, those below all heading sizes included."""
    n = F.char_length("text")
    sized = table(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("doc"), F.col("doc_id").alias("line"), (8 + (n % 60) / F.lit(7.0)).alias("size"), n.alias("n"))
    levels = glyphs.heading_levels(sized, glyphs.body_size(sized))
    return glyphs.line_levels(sized, levels).select("line", "level")


# --- boxes and components -----------------------------------------------------------------------------------------------

_COMPS = """cp AS (SELECT l_orderkey // 4 AS slot, (l_orderkey % 4 * 8 + l_linenumber)::INT AS id, (l_partkey % 97 * 10)::INT AS x0, (l_suppkey % 61 * 12)::INT AS y0, (l_partkey % 97 * 10 + 4 + l_quantity % 40)::INT AS x1,
  (l_suppkey % 61 * 12 + 6 + l_linenumber * 5)::INT AS y1, (20 + l_partkey % 50 * 10)::INT AS area, l_suppkey % 5 = 0 AS edge FROM lineitem),
bl AS (SELECT DISTINCT slot, 200 AS ax0, 150 AS ay0, 700 AS ax1, 600 AS ay1, 10.0::DOUBLE AS letter, 1000 AS w, 800 AS h FROM cp)"""


def _comps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    x0, y0 = p % 97 * 10, s % 61 * 12
    comps = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 4").alias("slot"), (k % 4 * 8 + n).cast("int").alias("id"), x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), (x0 + 4 + F.col("l_quantity") % 40).cast("int").alias("x1"),
        (y0 + 6 + n * 5).cast("int").alias("y1"), (20 + p % 50 * 10).cast("int").alias("area"), (s % 5 == 0).alias("edge"),
    )
    block = comps.select("slot").distinct().selectExpr("slot", "200 ax0", "150 ay0", "700 ax1", "600 ay1", "10D letter", "1000 w", "800 h")
    return comps, block


_LIVE = """(area > 0 AND NOT (area < 0.1 * (x1 - x0) * (y1 - y0) AND (x1 - x0) * (y1 - y0) > 100 * letter * letter AND NOT (x0 >= ax0 - 40 AND y0 >= ay0 - 40 AND x1 <= ax1 + 40 AND y1 <= ay1 + 40))
  AND ((x0 < ax1 - (ax1 - ax0) // 4 AND ax0 + (ax1 - ax0) // 4 < x1 AND y0 < ay1 - (ay1 - ay0) // 4 AND ay0 + (ay1 - ay0) // 4 < y1)
    OR NOT ((edge AND greatest(x1 - x0, y1 - y0) > 3 * letter AND big_edge <= 16) OR (y1 - y0 > 0.25 * h AND (x1 - x0) * 8 < y1 - y0))))"""


@query(f"""WITH {_COMPS}, j AS (SELECT *, count(*) FILTER (edge AND greatest(x1 - x0, y1 - y0) > 3 * letter) OVER (PARTITION BY slot) AS big_edge FROM cp JOIN bl USING (slot)) SELECT slot, id, {_LIVE} AS live FROM j""")
def live_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.live(*_comps(spark, sf_dir)).select("slot", "id", "live")


@query(f"WITH {_COMPS} SELECT slot, id FROM cp JOIN bl USING (slot) WHERE x0 < ax1 AND ax0 < x1 AND y0 < ay1 AND ay0 < y1")
def block_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.meeting_block(*_comps(spark, sf_dir)).select("slot", "id")


@query(f"""WITH {_COMPS}, m AS (SELECT slot, y1 - y0 AS v, row_number() OVER (PARTITION BY slot ORDER BY y1 - y0) - 1 AS k, count(*) OVER (PARTITION BY slot) AS n FROM cp JOIN bl USING (slot)
  WHERE area >= 20 AND x0 < ax1 AND ax0 < x1 AND y0 < ay1 AND ay0 < y1), u AS (SELECT slot, v FROM m WHERE k = n // 2)
SELECT slot, greatest(1, coalesce(v, h // 100))::INT AS letter FROM bl LEFT JOIN u USING (slot)""")
def letter_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.letter_heights(*_comps(spark, sf_dir)).select("slot", "letter")


@query(f"""WITH RECURSIVE {_COMPS}, e AS (SELECT a.slot, a.id AS u, b.id AS v FROM cp a JOIN cp b ON a.slot = b.slot WHERE greatest(b.x0 - a.x1, a.x0 - b.x1, 0) <= 30 AND 2 * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= least(a.y1 - a.y0, b.y1 - b.y0)),
reach AS (SELECT slot, id AS u, id AS v FROM cp UNION SELECT r.slot, r.u, e.v FROM reach r JOIN e ON e.slot = r.slot AND e.u = r.v) SELECT slot, u AS id, min(v) AS root FROM reach GROUP BY slot, u""")
def piece_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of one line: half the lesser height in common, and three letters' gap at most."""
    return B.clusters(_comps(spark, sf_dir)[0], gap=30.0).select("slot", "id", "root")


@query(f"""WITH {_COMPS} SELECT slot, id FROM cp s WHERE area < 120 AND EXISTS (SELECT 1 FROM cp k WHERE k.slot = s.slot AND k.area >= 120 AND k.x0 < s.x1 AND s.x0 < k.x1 AND greatest(k.y0 - s.y1, s.y0 - k.y1, 0) <= 5)""")
def diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps, block = _comps(spark, sf_dir)
    return B.diacritics(comps.where("area < 120"), comps.where("area >= 120"), block, 0.5).select("slot", "id")


@query("""WITH f AS (SELECT doc_id // 8 AS page, doc_id AS seq, (length(text) % 50 * 8)::DOUBLE AS x0, (length(text) % 13 * 20)::DOUBLE AS y0, (length(text) % 50 * 8 + 100 + length(text) % 11 * 30)::DOUBLE AS x1, (length(text) % 13 * 20 + 150)::DOUBLE AS y1 FROM documents WHERE text IS NOT NULL),
c AS (SELECT page, seq, greatest(x0, 0) AS x0, greatest(y0, 0) AS y0, least(x1, 600.0) AS x1, least(y1, 400.0) AS y1 FROM f), s AS (SELECT *, greatest(x1 - x0, 0) * greatest(y1 - y0, 0) / (600.0 * 400.0) AS share FROM c), k AS (SELECT * FROM s WHERE share BETWEEN 0.03 AND 0.9)
SELECT page, seq FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.page = k.page AND o.seq < k.seq AND abs(o.x0 - k.x0) < 1 AND abs(o.y0 - k.y0) < 1 AND abs(o.x1 - k.x1) < 1 AND abs(o.y1 - k.y1) < 1)""")
def figure_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    x0, y0 = n % 50 * 8, n % 13 * 20
    drawn = table(spark, sf_dir, "documents").where("text is not null").select(F.expr("doc_id div 8").alias("page"), F.col("doc_id").alias("seq"), *[c.cast("double").alias(k) for k, c in (("x0", x0), ("y0", y0), ("x1", x0 + 100 + n % 11 * 30), ("y1", y0 + 150))])
    return B.figure_boxes(drawn, 600.0, 400.0).select("page", "seq")


@query("""SELECT doc_id AS slot, CASE WHEN a = 0 THEN ceil(w + 0.06 * greatest(w, h)) ELSE ceil(w * cos(radians(abs(a))) + h * sin(radians(abs(a))) + 0.06 * greatest(w, h)) END::BIGINT AS cw,
 CASE WHEN a = 0 THEN ceil(h + 0.06 * greatest(w, h)) ELSE ceil(h * cos(radians(abs(a))) + w * sin(radians(abs(a))) + 0.06 * greatest(w, h)) END::BIGINT AS ch
 FROM (SELECT doc_id, (100 + length(text) % 700)::DOUBLE AS w, (200 + length(text) % 900)::DOUBLE AS h, (doc_id % 41 - 20) / 4.0::DOUBLE AS a FROM documents WHERE text IS NOT NULL)""")
def slot_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    slots = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("slot"), (100 + n % 700).cast("double").alias("w"), (200 + n % 900).cast("double").alias("h"), ((F.col("doc_id") % 41 - 20) / F.lit(4.0)).alias("angle"))
    return B.slot_canvas(slots).select("slot", "cw", "ch")


@query("""WITH s AS (SELECT doc_id // 8 AS doc, doc_id AS slot, 100 + length(text) % 300 AS w, 150 + length(text) % 500 AS h, 40 + length(text) % 97 AS ax, 20 + length(text) % 53 AS ay FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc, max(greatest(ax, w - ax)) AS half, max(ay) AS top, max(h - ay) AS bot FROM s GROUP BY doc),
m AS (SELECT *, trunc(0.012 * 2 * half)::BIGINT AS mx, trunc(0.012 * (top + bot))::BIGINT AS my FROM c)
SELECT slot, (mx + half - ax)::BIGINT AS ox, (my + top - ay)::BIGINT AS oy, (2 * half + 2 * mx)::BIGINT AS cw, (top + bot + 2 * my)::BIGINT AS ch FROM s JOIN m USING (doc)""")
def compose_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each slot goes on the canvas that all slots of its document share."""
    n = F.char_length("text")
    slots = table(spark, sf_dir, "documents").where("text is not null").select(F.expr("doc_id div 8").alias("doc"), F.col("doc_id").alias("slot"), (100 + n % 300).alias("w"), (150 + n % 500).alias("h"), (40 + n % 97).alias("ax"), (20 + n % 53).alias("ay"))
    return B.compose_offsets(slots).select("slot", "ox", "oy", "cw", "ch")


@query(f"""WITH {_PROFILE}, m AS (SELECT key, i, round(sum(d) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 9) AS m FROM v),
n AS (SELECT *, lag(m) OVER w AS a, lead(m) OVER w AS b FROM m WINDOW w AS (PARTITION BY key ORDER BY i))
SELECT key, i FROM (SELECT key, i, a, b, m <= a AND m < b AS low, i - max(CASE WHEN a IS NULL OR m <= a AND m < b THEN i END) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM n) WHERE a IS NULL OR b IS NULL OR low AND since >= 1""")
def profile_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local minima of profiles, however near."""
    return profiles.local_minima(_profile(spark, sf_dir), least=1)


@query("""WITH RECURSIVE v AS (SELECT vec_id AS key, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings), c AS (SELECT key, (i % 8)::INT AS x, (i // 8)::INT AS y FROM v WHERE e > 0.1),
r AS (SELECT key, x, y, x AS px, y AS py FROM c UNION SELECT r.key, r.x, r.y, c.x, c.y FROM r JOIN c ON c.key = r.key AND abs(c.x - r.px) <= 1 AND abs(c.y - r.py) <= 1),
g AS (SELECT key, x, y, min(py * 1000 + px) AS root FROM r GROUP BY key, x, y)
SELECT key, root::INT AS root, greatest(0, min(x) * 320 - 160)::INT AS x0, greatest(0, min(y) * 320 - 160)::INT AS y0, least(2500, (max(x) + 1) * 320 + 160)::INT AS x1, least(2560, (max(y) + 1) * 320 + 160)::INT AS y1 FROM g GROUP BY key, root""")
def tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around groups of flagged tiles."""
    vectors = table(spark, sf_dir, "embeddings")
    each = vectors.select(F.col("vec_id").alias("key"), F.posexplode("embedding").alias("i", "e"))
    cells = each.where(F.col("e").cast("double") > 0.1).select("key", (F.col("i") % 8).cast("int").alias("x"), F.expr("int(i div 8)").alias("y"))
    return profiles.component_boxes(profiles.grid_components(cells), vectors.select(F.col("vec_id").alias("key"), F.lit(2500).alias("w"), F.lit(2560).alias("h")), 320)


@query("""SELECT vec_id AS key FROM embeddings WHERE len(list_filter(embedding[1:8], lambda v: abs(v::DOUBLE) > 0.3)) = 0 AND len(list_filter(embedding[9:16], lambda v: abs(v::DOUBLE) > 0.3)) = 0""")
def usable_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda a: F.transform(F.slice("embedding", a, 8), lambda v: F.abs(v.cast("double")))
    return profiles.usable_tiles(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), part(1).alias("rows"), part(9).alias("cols")), 0.3).select("key")


# --- rasters: vectors as pages of 8 x 8 grey points -------------------------------------------------------------------------

_GREY = "g AS (SELECT vec_id AS doc, unnest(range(64))::INT AS i, round(least(1.0, abs(unnest(embedding)::DOUBLE) * 3) * 255)::INT AS v FROM embeddings)"


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda v: F.lpad(F.hex(F.round(F.least(F.lit(1.0), F.abs(v.cast("double")) * 3) * 255).cast("int")), 2, "0")
    px = F.unhex(F.array_join(F.transform("embedding", point), ""))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.lit(1).alias("page"), F.lit(8).alias("w"), F.lit(8).alias("h"), px.alias("px"))


def _points(spark: SparkSession, sf_dir: str, kernel) -> DataFrame:
    """doc, y, x, v of what a kernel makes of each raster."""
    found = raster.map_pages(_rasters(spark, sf_dir), lambda v: {"rows": [[float(x) for x in r] for r in kernel(v)]}, "doc long, page int, rows array<array<double>>")
    each = found.select("doc", F.posexplode("rows").alias("y", "row"))
    return each.select("doc", "y", F.posexplode("row").alias("x", "v")).select("doc", "y", "x", F.round("v", 6).alias("v"))


@query(f"WITH {_GREY} SELECT doc, (i // 8 // 2)::INT AS y, (i % 8 // 2)::INT AS x, round(avg(v / 255.0::DOUBLE), 6) AS v FROM g GROUP BY ALL")
def raster_downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, lambda v: raster.downsample(v, 2))


@query(f"WITH {_GREY} SELECT doc, (i % 8)::INT AS y, (7 - i // 8)::INT AS x, round(v / 255.0::DOUBLE, 6) AS v FROM g")
def raster_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, lambda v: raster.quarter_turns(v, 1))


@query(f"WITH {_GREY} SELECT doc, (i // 8 - 2)::INT AS y, (i % 8 - 1)::INT AS x, round(v / 255.0::DOUBLE, 6) AS v FROM g WHERE i // 8 BETWEEN 2 AND 6 AND i % 8 BETWEEN 1 AND 5")
def raster_cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, lambda v: raster.crop(v, (1, 2, 6, 7)))


@query(f"WITH {_GREY} SELECT doc, (i // 8)::INT AS y, 0 AS x, round(floor(avg((v < 60)::INT) * 255 + 0.5) / 255, 6) AS v FROM g GROUP BY doc, i // 8")
def raster_row_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, lambda v: raster.density(v * 255 < 59.5, 1)[:, None])


@query(f"""WITH {_GREY}, s AS (SELECT doc, (i // 8 * 2 + dy)::INT AS y, (i % 8 * 2 + dx)::INT AS x, v FROM g CROSS JOIN (SELECT unnest([0, 1]) AS dy) CROSS JOIN (SELECT unnest([0, 1]) AS dx))
SELECT doc, y, x, round(v / 255.0::DOUBLE, 6) AS v FROM s""")
def raster_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page at twice its size, unsmoothed."""
    return _points(spark, sf_dir, lambda v: raster.nearest_map(v, (0.5, 0, 0, 0.5, 0, 0), 16, 16))


@query(f"""WITH {_GREY} SELECT doc, y::INT AS y, x::INT AS x, round(coalesce(v / 255.0::DOUBLE, 1.0), 6) AS v FROM (SELECT DISTINCT doc FROM g) CROSS JOIN (SELECT unnest(range(11)) AS y) CROSS JOIN (SELECT unnest(range(10)) AS x)
  LEFT JOIN (SELECT doc AS d, i // 8 + 3 AS gy, i % 8 + 4 AS gx, v FROM g) ON d = doc AND gy = y AND gx = x""")
def raster_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page at its place on a larger canvas; what reaches beyond is cut off."""
    return _points(spark, sf_dir, lambda v: raster.placed(v, 4, 3, 10, 11))


# --- whole pages ----------------------------------------------------------------------------------------------------------

#: Typeset pages: words to a line, lines to a column, width of a letter, distance of lines.
_WORDS_A_LINE, _LINES_A_COLUMN, _ADVANCE, _PITCH = 6, 40, 3.0, 12.0


def _columns_of_text(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc, page, id, x0, x1, base, size, bold, text: the words of each text (doc, text) set in two columns under a running head, and the pages."""
    words = docs.select("doc", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(_WORDS_A_LINE))
    lines = words.select("doc", F.posexplode(F.transform(starts, lambda k: F.array_join(F.slice("w", k + 1, _WORDS_A_LINE), " "))).alias("n", "text"))
    page, k = F.expr(f"int(n div {2 * _LINES_A_COLUMN})"), F.col("n") % _LINES_A_COLUMN
    x0 = F.when(F.expr(f"n div {_LINES_A_COLUMN} % 2 = 0"), 40.0).otherwise(640.0)
    placed = lines.select("doc", page.alias("page"), F.col("n").cast("long").alias("id"), x0.alias("x0"), (x0 + F.least(F.lit(580.0), _ADVANCE * F.char_length("text"))).alias("x1"), (120 + _PITCH * k).alias("base"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"), "text")
    pages = placed.select("doc", "page").distinct().withColumn("h", F.lit(800.0))
    heads = pages.select("doc", "page", F.lit(-1).cast("long").alias("id"), F.lit(40.0).alias("x0"), F.lit(200.0).alias("x1"), F.lit(30.0).alias("base"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"), F.concat(F.lit("Volume "), F.col("page") + 3).alias("text"))
    return placed.unionByName(heads), pages


@query()
def markdown_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set in two columns, read back as Markdown: headers off, columns in order, paragraphs."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), "text")
    # Set once: what reads the fragments and pages below would set them again each time.
    found = assembly.page_markdown(*map(written, _columns_of_text(docs)))
    return found.select("doc", "page", "label", F.char_length("markdown").alias("n_chars"), F.md5("markdown").alias("md5"))


@query()
def markdown_from_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From single glyphs to Markdown: benchmark texts set letter by letter, an item to a page and eight pages to a document."""
    items = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.expr("item_id div 8").alias("doc"), F.expr("int(item_id % 8)").alias("page"), "text")
    set_ = glyphs.from_lines(items, "item_id").join(items.select(F.col("item_id").alias("doc"), F.col("doc").alias("book"), "page"), "doc")
    each = set_.select(F.col("book").alias("doc"), "page", F.monotonically_increasing_id().alias("seq"), "s", "x0", "x1", "y", "size", F.lit(False).alias("bold"))
    pages = items.select("doc", "page").distinct().withColumn("h", F.lit(800.0))
    found = assembly.markdown_of_glyphs(each, pages)
    return found.select("doc", "page", "label", F.char_length("markdown").alias("n_chars"), F.md5("markdown").alias("md5"))


_UNITS = """u AS (SELECT doc_id // 16 AS doc, row_number() OVER (PARTITION BY doc_id // 16 ORDER BY doc_id) AS ord, doc_id AS id, CASE WHEN length(text) % 7 = 0 THEN 'table' ELSE 'line' END AS kind,
  (length(text) % 37) * 10.0::DOUBLE AS x0, (length(text) % 37) * 10.0::DOUBLE + 40 + length(text) % 90 AS x1, 12.0::DOUBLE * (doc_id % 16) AS base FROM documents WHERE text IS NOT NULL),
fg AS (SELECT doc, id AS fig, x0 - 30 AS x0, x1 + 60 AS x1, base * 2 / 3 AS top FROM u WHERE id % 3 = 0)"""


@query(f"""WITH {_UNITS}, p AS (SELECT doc, fig, coalesce((SELECT min(ord) FROM u WHERE u.doc = fg.doc AND kind = 'line' AND base > top AND u.x1 > fg.x0 AND u.x0 < fg.x1), 2147483647) AS ord FROM fg),
a AS (SELECT doc, ord, id, kind, NULL AS fig FROM u UNION ALL SELECT doc, ord, NULL, 'figure', fig FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord, kind <> 'figure', fig) AS seq FROM a),
b AS (SELECT *, lag(kind) OVER w AS before, last_value(CASE WHEN kind <> 'figure' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS text_before FROM s WINDOW w AS (PARTITION BY doc ORDER BY seq))
SELECT doc, seq::INT AS seq, kind, id, fig, sum(CASE WHEN before IS NULL OR before <> 'line' OR kind <> 'line' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY seq)::BIGINT AS block, coalesce(kind = 'line' AND before = 'figure' AND text_before = 'line', false) AS col_start FROM b""")
def figure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures before the first line below their top that they overlap; blocks of lines split there and are numbered anew."""
    from pyspark.sql import Window

    n, k = F.char_length("text"), F.col("doc_id")
    x0 = (n % 37) * F.lit(10.0)
    units = table(spark, sf_dir, "documents").where("text is not null").select(
        F.expr("doc_id div 16").alias("doc"), F.lit(0).alias("page"), F.row_number().over(Window.partitionBy(F.expr("doc_id div 16")).orderBy("doc_id")).alias("ord"), k.alias("id"), F.when(n % 7 == 0, "table").otherwise("line").alias("kind"),
        x0.alias("x0"), (x0 + 40 + n % 90).alias("x1"), (F.lit(12.0) * (k % 16)).alias("base"), F.lit(False).alias("col_start"),
    )
    figures = units.where("id % 3 = 0").select("doc", "page", F.col("id").alias("fig"), (F.col("x0") - 30).alias("x0"), (F.col("x1") + 60).alias("x1"), (F.col("base") * 2 / 3).alias("top"))
    return reading.page_blocks(units, figures).select("doc", "seq", "kind", "id", "fig", "block", "col_start")


# --- documents as PDF files, read back --------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, regexp_replace(unnest(string_split(text, chr(10))), '[^\x20-\x7e\x{a0}-\x{ff}‘’“”•–—…€]', '', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id::VARCHAR AS doc, (max(line) // 50 + 1)::INT AS n_pages, sum(length(t))::BIGINT AS n_glyphs, md5(string_agg(t, '' ORDER BY line)) AS text_md5 FROM l GROUP BY doc_id""")
def pdf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as PDFs of fifty lines a page and read back glyph by glyph."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select(F.col("doc_id").cast("string").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("s", T.winansi(F.col("t"))["bytes"])
    y = F.lit(14.0) * (F.col("line") % 50 + 1)
    drawn = F.struct("line", "s", F.lit(10.0).alias("x0"), y.alias("y0"), (F.lit(10.0) + 3 * F.length("s")).alias("x1"), (y + 7.86).alias("y1"))
    pages = lines.groupBy("doc", F.expr("int(line div 50)").alias("page")).agg(F.array_sort(F.collect_list(drawn)).alias("own"))  # of fifty lines
    shown = F.transform("own", lambda r: F.struct(*[r[c].alias(c) for c in ("s", "x0", "y0", "x1", "y1")]))
    files = writers.pdf_documents(pages.select("doc", "page", F.lit(600.0).alias("w"), F.lit(800.0).alias("h"), F.lit(True).alias("visible"), shown.alias("lines")))
    found = pdf.pdf_pages(files).select("doc", "page", "n_pages", F.size("glyphs").alias("n"), F.array_join(F.col("glyphs.s"), "").alias("t"))
    whole = found.groupBy("doc").agg(F.max("n_pages").alias("n_pages"), F.sum("n").cast("long").alias("n_glyphs"), F.array_sort(F.collect_list(F.struct("page", "t"))).alias("p"))  # of one document
    return whole.select("doc", "n_pages", "n_glyphs", F.md5(F.array_join(F.transform("p", lambda p: p["t"]), "")).alias("text_md5"))


# --- the ring around slots: pieces of order lines -------------------------------------------------------------------------

_RING = """rp AS (SELECT l_orderkey // 4 AS slot, (l_orderkey % 4 * 8 + l_linenumber)::INT AS id, (l_partkey % 23 * 16)::INT AS x0, (CASE WHEN l_suppkey % 4 = 0 THEN 760 ELSE 640 END + l_suppkey % 9 * 6)::INT AS y0,
  (l_partkey % 23 * 16 + 8 + l_linenumber)::INT AS x1, (CASE WHEN l_suppkey % 4 = 0 THEN 760 ELSE 640 END + l_suppkey % 9 * 6 + 8 + l_quantity % 9)::INT AS y1, (30 + l_partkey % 40)::INT AS area, l_orderkey % 4 <> 3 AS "out", l_partkey % 17 = 0 AS edge, l_partkey % 3 = 0 AS seed FROM lineitem)"""


def _ring(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    x0, y0 = p % 23 * 16, F.when(s % 4 == 0, 760).otherwise(640) + s % 9 * 6
    pieces = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 4").alias("slot"), (k % 4 * 8 + n).cast("int").alias("id"), x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), (x0 + 8 + n).cast("int").alias("x1"), (y0 + 8 + F.col("l_quantity") % 9).cast("int").alias("y1"),
        (30 + p % 40).cast("int").alias("area"), (k % 4 != 3).alias("out"), (p % 17 == 0).alias("edge"), (p % 3 == 0).alias("seed"),
    )
    block = pieces.select("slot").distinct().selectExpr("slot", "100 ay0", "620 ay1", "50 kx0", "300 kx1", "100 top", "620 bottom", "10D letter", "800 h")
    return pieces, block


@query(f"""WITH {_RING}, g AS (SELECT *, greatest(50 - x1, x0 - 300, 0) AS gx FROM rp)
SELECT slot, id FROM g WHERE area > 0 AND "out" AND NOT edge AND area >= 12.5 AND greatest(x1 - x0, y1 - y0) <= 30 AND ((y1 - y0 >= 5 AND gx <= 240 AND (y0 < 115 OR y1 > 605)) OR ((y1 <= 100 OR y0 >= 620) AND gx <= 120))""")
def ring_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces outside a slot that stand on its first or last line, or above or below its text."""
    return ring.ring_letters(*_ring(spark, sf_dir)).where("online").select("slot", "id")


@query(f"""WITH RECURSIVE {_RING}, pool AS (SELECT * FROM rp WHERE "out" AND NOT edge), e AS (SELECT a.slot, a.id AS u, b.id AS v FROM pool a JOIN pool b USING (slot) WHERE greatest(b.x0 - a.x1, a.x0 - b.x1, 0) <= 10 AND least(a.y1, b.y1) > greatest(a.y0, b.y0)),
reach AS (SELECT slot, id AS u, id AS v FROM pool UNION SELECT r.slot, r.u, e.v FROM reach r JOIN e ON e.slot = r.slot AND e.u = r.v), rows_ AS (SELECT slot, u AS id, min(v) AS root FROM reach GROUP BY slot, u),
held AS (SELECT * FROM rows_ JOIN pool USING (slot, id) WHERE (slot, root) IN (SELECT (slot, root) FROM rows_ JOIN pool USING (slot, id) WHERE seed)), band AS (SELECT slot, root, min(y0) AS y0, max(y1) AS y1 FROM held GROUP BY slot, root),
e2 AS (SELECT a.slot, a.root AS u, b.root AS v FROM band a JOIN band b USING (slot) WHERE 2 * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= least(a.y1 - a.y0, b.y1 - b.y0)),
r2 AS (SELECT slot, root AS u, root AS v FROM band UNION SELECT r.slot, r.u, e2.v FROM r2 r JOIN e2 ON e2.slot = r.slot AND e2.u = r.v), ln AS (SELECT slot, u AS root, min(v) AS line FROM r2 GROUP BY slot, u)
SELECT slot, line, count(*) AS n, sum(id)::BIGINT AS ids FROM held JOIN ln USING (slot, root) GROUP BY slot, line HAVING count(*) FILTER (y1 - y0 >= 5) >= 3 AND sum(area) FILTER (y1 - y0 >= 5) >= 0.8 * sum(area)""")
def clipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces linked to rows, rows to lines; a line has letters with most of its ink."""
    pieces, block = _ring(spark, sf_dir)
    letters = ring.ring_letters(pieces, block)
    found = ring.clipped_lines(letters, letters.select("slot", "id"))
    return found.groupBy("slot", "line").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query()
def reached_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the ring search takes in: page numbers, clipped lines, signs over and under them."""
    return ring.reached(*_ring(spark, sf_dir)).select("slot", "id", "why", "part")


# --- kernels on rasters whose SQL sums neighbours ----------------------------------------------------------------------------

_PIXELS = f"{_GREY}, px AS (SELECT doc, (i // 8)::INT AS y, (i % 8)::INT AS x, v / 255.0::DOUBLE AS v FROM g)"


@query(f"""WITH {_PIXELS} SELECT doc, y, x, (v < 0.6 OR v < 0.75 AND EXISTS (SELECT 1 FROM px s WHERE s.doc = p.doc AND s.v < 0.45 AND (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) <= 5))::INT::DOUBLE AS v FROM px p""")
def raster_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink: dark points, and lighter ones near very dark ones."""
    return _points(spark, sf_dir, lambda v: raster.threshold(v).astype(float))


_WEIGHTS = "wt AS (SELECT d, e / sum(e) OVER () AS wt FROM (SELECT d, exp(-0.5 * (d / 0.8::DOUBLE) * (d / 0.8::DOUBLE)) AS e FROM (SELECT unnest(range(-4, 5)) AS d)))"


@query(f"""WITH {_PIXELS}, {_WEIGHTS}, down AS (SELECT p.doc, o.y, p.x, sum(wt * p.v) AS v FROM (SELECT unnest(range(8))::INT AS y) o CROSS JOIN wt JOIN px p ON p.y = least(7, greatest(0, o.y + d)) GROUP BY ALL),
across AS (SELECT p.doc, p.y, o.x, sum(wt * p.v) AS v FROM (SELECT unnest(range(8))::INT AS x) o CROSS JOIN wt JOIN down p ON p.x = least(7, greatest(0, o.x + d)) GROUP BY ALL)
SELECT doc, y, x, round(v, 6) AS v FROM across""")
def raster_blurred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian blur, edges repeated."""
    return _points(spark, sf_dir, lambda v: raster.gauss(v, 0.8))


@query(f"""WITH RECURSIVE {_PIXELS}, c AS (SELECT doc, x, y FROM px WHERE v < 0.2), r AS (SELECT doc, x, y, x AS u, y AS w FROM c UNION SELECT r.doc, r.x, r.y, c.x, c.y FROM r JOIN c ON c.doc = r.doc AND abs(c.x - r.u) <= 1 AND abs(c.y - r.w) <= 1),
o AS (SELECT doc, x, y, min(w * 8 + u) AS root FROM r GROUP BY doc, x, y)
SELECT doc, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*)::INT AS area FROM o GROUP BY doc, root""")
def raster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of ink of each page: their boxes and areas."""
    pieces = "array<struct<x0:int,y0:int,x1:int,y1:int,area:int>>"
    named = lambda v: {"pieces": [dict(zip(("x0", "y0", "x1", "y1", "area"), map(int, c), strict=True)) for c in raster.components(v < 0.2)]}
    return raster.map_pages(_rasters(spark, sf_dir), named, f"doc long, page int, pieces {pieces}").select("doc", F.inline("pieces"))


@query(f"""WITH {_PIXELS} SELECT doc, y, x, round(v, 6) AS v FROM px""")
def raster_unturned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned by next to nothing onto a canvas of the same size: no point moves."""
    return _points(spark, sf_dir, lambda v: raster.rotate(v, 0.005, 8, 8))
