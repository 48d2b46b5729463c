"""Queries over the given tables, one for each operator or small chain of operators, with the DuckDB SQL of the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, glyphs, headers, onepass, pages, paragraphs, profiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- lines of documents; a source is a document group, a document a page -------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.lines(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


def _volume_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As _lines(), for groups of eight documents that follow each other."""
    documents = table(spark, sf_dir, "documents").withColumn("volume", F.expr("doc_id div 8"))
    return headers.lines(documents, "volume", "doc_id", "text")


_LINES = r"""
lines AS (SELECT source AS grp, doc_id AS page, len(string_split(text, chr(10))) AS n_lines, unnest(range(len(string_split(text, chr(10))))) AS line,
                 unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL),
marked AS (SELECT *, regexp_replace(lower(trim(text)), '#?[0-9]+', '#', 'g') AS norm,
                  (line + 1 < 0.12 * n_lines OR line > 0.88 * n_lines OR line = 0 OR line = n_lines - 1) AS edge FROM lines)"""


_VOLUME_LINES = _LINES.replace("SELECT source AS grp", "SELECT doc_id // 8 AS grp")


@query(f"""WITH {_VOLUME_LINES}, pages AS (SELECT grp, count(DISTINCT page) AS n_pages FROM lines GROUP BY grp),
r AS (SELECT grp, norm, count(DISTINCT page) AS n_with FROM marked WHERE edge AND norm <> '' GROUP BY grp, norm)
SELECT grp, norm, n_with, n_pages FROM r JOIN pages USING (grp) WHERE n_with >= greatest(2, n_pages // 4)""")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.running_headers(_volume_lines(spark, sf_dir)).select("grp", "norm", "n_with", "n_pages")


_REMOVED = """pages AS (SELECT grp, count(DISTINCT page) AS n_pages FROM lines GROUP BY grp),
r AS (SELECT grp, norm, count(DISTINCT page) AS n_with FROM marked WHERE edge AND norm <> '' GROUP BY grp, norm),
c AS (SELECT *, coalesce(trim(CASE WHEN 2 * line < n_lines - 1 THEN lead(text) OVER w ELSE lag(text) OVER w END) = '', true) AS clear FROM marked WINDOW w AS (PARTITION BY grp, page ORDER BY line)),
kept AS (SELECT c.page, c.line, c.text FROM c LEFT JOIN r ON c.edge AND r.grp = c.grp AND r.norm = c.norm LEFT JOIN pages ON pages.grp = c.grp
  WHERE NOT coalesce(n_with >= greatest(2, n_pages // 4) AND clear OR n_with >= greatest(3, (n_pages + 1) // 2, n_pages // 4), false))
SELECT page, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM kept GROUP BY page"""


@query(f"WITH {_VOLUME_LINES}, {_REMOVED}")
def edge_lines_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers go by the share of the pages of a volume of eight."""
    left = headers.without_headers(_volume_lines(spark, sf_dir))
    return left.groupBy("page").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("text")).alias("n_chars"))


@query(f"WITH {_LINES}, {_REMOVED}")
def header_lines_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As edge_lines_removed, for whole sources."""
    left = headers.without_headers(_lines(spark, sf_dir))
    return left.groupBy("page").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("text")).alias("n_chars"))


@query(r"""WITH lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line, string_split_regex(trim(t), '\s+') AS w FROM lines),
n AS (SELECT DISTINCT doc_id, line, regexp_replace(unnest([w[1], w[-1]]), '^[^0-9]+|[^0-9]+$', '', 'g') AS d FROM w)
SELECT DISTINCT doc_id, line::INT AS line, d::INT AS number FROM n WHERE regexp_matches(d, '^[0-9]{1,4}$')""")
def edge_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that begin or end a line."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return each.select("doc_id", "line", F.explode(F.array_distinct(T.edge_numbers(F.col("t")))).alias("number"))


@query(r"""WITH v AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, line, lower(regexp_replace(trim(t), '^[\-–—|·•()\[\] ]+|[\-–—|·•()\[\] ]+$', '', 'g')) AS b FROM v),
c AS (SELECT doc_id, line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '^side ', ''), '^page ', ''), '^s\. ', ''), '^p\. ', '') AS b FROM a),
d AS (SELECT doc_id, line, CASE WHEN regexp_matches(b, '^[0-9]{1,4}$') THEN b::INT
  WHEN regexp_matches(b, '^[0-9]{1,4} *(/| (of|af) ) *[0-9]{1,4}$') THEN regexp_extract(b, '^([0-9]+)', 1)::INT END AS number FROM c)
SELECT doc_id, count(*) AS n_lines, count(number) AS n_numbers, coalesce(sum(number), 0)::BIGINT AS total FROM d GROUP BY doc_id""")
def page_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document read as a page number, and the sum of those."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t")).withColumn("number", T.page_number(F.col("t")))
    return each.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("number").alias("n_numbers"), F.coalesce(F.sum("number"), F.lit(0)).alias("total"))


_CANDIDATES = r"""
ranked AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page FROM documents),
cand AS (SELECT source AS doc, page, list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda x: length(x) <= 4), lambda x: x::INT) AS numbers FROM ranked),
each AS (SELECT DISTINCT doc, page, unnest(numbers) AS n FROM cand),
votes AS (SELECT doc, n - page AS off, count(DISTINCT page) AS c FROM each GROUP BY 1, 2), having_n AS (SELECT doc, count(DISTINCT page) AS n_with FROM each GROUP BY 1),
best AS (SELECT doc, off FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY c DESC, off) AS r FROM votes) JOIN having_n USING (doc) WHERE r = 1 AND c >= 2 AND 5 * c >= 2 * n_with),
u AS (SELECT doc, page, list_sort(list_distinct(numbers)) AS u FROM cand)"""


@query(rf"""WITH {_CANDIDATES}
SELECT doc, page::INT AS page, CASE WHEN len(u) = 2 AND u[2] = u[1] + 1 THEN u[1] || '–' || u[2] WHEN page + off >= 1 THEN (page + off)::VARCHAR
  WHEN len(u) = 1 THEN u[1]::VARCHAR ELSE (page + 1)::VARCHAR END AS label FROM u LEFT JOIN best USING (doc)""")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    numbers = F.transform(F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x) <= 4), lambda x: x.cast("int"))
    each = table(spark, sf_dir, "documents").select("source", "doc_id", numbers.alias("numbers"))
    return pages.page_labels(each.select(F.col("source").alias("doc"), place.alias("page"), "numbers"))


# --- glyphs typeset from documents ---------------------------------------------------------------------------------------

_GLYPHS = r"""
l AS (SELECT doc_id AS doc, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc, line, unnest(range(length(t))) AS j, unnest(string_split(t, '')) AS s FROM l WHERE length(t) > 0),
gl AS (SELECT doc, line, s, 50.0::DOUBLE + 5 * j AS x0, 55.0::DOUBLE + 5 * j AS x1, 100.0::DOUBLE + 12 * line AS y FROM g WHERE s NOT IN ('', ' ')),
p AS (SELECT *, x0 - max(x1) OVER (PARTITION BY doc, line ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, dense_rank() OVER (PARTITION BY doc ORDER BY line) AS row FROM gl),
f AS (SELECT *, sum(CASE WHEN gap > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, line ORDER BY x0) AS frag FROM p)"""


@query(rf"""WITH {_GLYPHS}
SELECT doc, row::BIGINT AS row, frag::BIGINT AS frag, min(x0) AS x0, max(x1) AS x1, min(y) AS base, md5(string_agg(CASE WHEN gap > 1.8 AND gap <= 15 THEN ' ' || s ELSE s END, '' ORDER BY x0)) AS text_md5
FROM f GROUP BY doc, row, frag""")
def glyph_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = onepass.fragments_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text").repartition("doc"), onepass.set_text)
    return found.select("doc", "row", "frag", "x0", "x1", "base", F.md5("text").alias("text_md5"))


@query(rf"""WITH {_GLYPHS},
gaps AS (SELECT doc, row, x0, x0 - gap AS f FROM p WHERE gap >= 4),
free AS (SELECT doc, row, unnest(range(floor(f)::BIGINT + 1, floor(x0)::BIGINT)) AS bin FROM gaps),
over_ AS (SELECT doc, bin, count(*) AS n_over FROM (SELECT doc, row, unnest(range(floor(min(x0))::BIGINT, floor(max(x1))::BIGINT)) AS bin FROM p GROUP BY doc, row) GROUP BY doc, bin),
c AS (SELECT doc, bin, count(*) AS n_free FROM free GROUP BY doc, bin HAVING count(*) >= 5)
SELECT doc, bin::INT AS bin, n_free, n_over FROM c JOIN over_ USING (doc, bin) WHERE n_free >= 0.3 * n_over""")
def column_gutter_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = onepass.gutters_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text").repartition("doc"), onepass.set_text, share=0.3, gap=0.4)
    return found.select("doc", "bin", "n_free", "n_over")


_SIZED = "sized AS (SELECT source AS doc, 8 + (length(text) % 60) / 7.0::DOUBLE AS size, length(text) AS n FROM documents WHERE text IS NOT NULL)"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("doc"), (8 + (n % 60) / F.lit(7.0)).alias("size"), n.alias("n"))


_BODY = f"""{_SIZED}, half AS (SELECT doc, round(size * 2) / 2 AS size, sum(n) AS n FROM sized GROUP BY 1, 2),
body AS (SELECT doc, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, size DESC) AS r FROM half) WHERE r = 1)"""


@query(f"WITH {_BODY} SELECT doc, body FROM body")
def body_size_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.body_size(_sized(spark, sf_dir))


@query(f"""WITH {_BODY} SELECT doc, size, least(dense_rank() OVER (PARTITION BY doc ORDER BY size DESC), 4)::INT AS level FROM half JOIN body USING (doc) WHERE size >= 1.15 * body""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _sized(spark, sf_dir)
    return glyphs.heading_levels(sized, glyphs.body_size(sized))


_BOXES = """box AS (SELECT doc_id // 8 AS doc, (doc_id % 8)::INT AS line, (length(text) % 37) * 10.0::DOUBLE AS x0, (length(text) % 37) * 10.0::DOUBLE + 40 + length(text) % 90 AS x1,
  20.0::DOUBLE * (doc_id % 8) AS top, 20.0::DOUBLE * (doc_id % 8) + 8 + length(text) % 17 AS bot, 8.0::DOUBLE + length(text) % 5 AS size, (doc_id % 8) < 4 AS upper_half, 20.0::DOUBLE * (doc_id % 8) + length(text) % 13 AS base FROM documents WHERE text IS NOT NULL)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.char_length("text"), F.col("doc_id") % 8
    x0 = (n % 37) * F.lit(10.0)
    return table(spark, sf_dir, "documents").where("text is not null").select(
        F.expr("doc_id div 8").alias("doc"), k.cast("int").alias("line"), x0.alias("x0"), (x0 + 40 + n % 90).alias("x1"), (F.lit(20.0) * k).alias("top"), (F.lit(20.0) * k + 8 + n % 17).alias("bot"), (F.lit(8.0) + n % 5).alias("size"), (k < 4).alias("upper_half"), (F.lit(20.0) * k + n % 13).alias("base")
    )


@query(f"""WITH {_BOXES}
SELECT doc, line, NOT EXISTS (SELECT 1 FROM box o WHERE o.doc = b.doc AND o.line <> b.line AND o.x0 < b.x1 AND o.x1 > b.x0 AND CASE WHEN b.upper_half THEN o.base < b.base - 0.3 * b.size ELSE o.base > b.base + 0.3 * b.size END) AS outer_,
 NOT EXISTS (SELECT 1 FROM box o WHERE o.doc = b.doc AND o.line <> b.line AND CASE WHEN b.upper_half THEN o.base > b.base + 0.3 * b.size AND o.base < b.base + 1.8 * b.size ELSE o.base < b.base - 0.3 * b.size AND o.base > b.base - 1.8 * b.size END) AS clear,
 NOT EXISTS (SELECT 1 FROM box o WHERE o.doc = b.doc AND o.line <> b.line AND abs(o.base - b.base) < 0.3 * b.size AND o.x0 < b.x1 + 3 * b.size AND o.x1 > b.x0 - 3 * b.size) AS alone FROM box b""")
def header_outer_clear_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.header_tests(_boxes(spark, sf_dir)).select("doc", "line", F.col("outer").alias("outer_"), "clear", "alone")


@query(f"""WITH {_BOXES}, body AS (SELECT doc, max(size) AS body FROM box GROUP BY doc)
SELECT s.doc, s.line FROM box s JOIN body USING (doc) WHERE s.size <= 0.85 * body AND NOT EXISTS (SELECT 1 FROM box f WHERE f.doc = s.doc AND f.size > 0.85 * body AND f.base > s.base AND f.x0 < s.x1 AND f.x1 > s.x0)""")
def footnote_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    found = glyphs.footnotes(boxes, boxes.groupBy("doc").agg(F.max("size").alias("body")))
    return found.select(found["doc"], "line")


_STRIPS = f"""{_BOXES}, s AS (SELECT *, CASE WHEN top >= max(bot) OVER (PARTITION BY doc ORDER BY top, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 0.05 * size THEN 1
   WHEN row_number() OVER (PARTITION BY doc ORDER BY top, x0) = 1 THEN 1 ELSE 0 END AS new FROM box),
st AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY top, x0 ROWS UNBOUNDED PRECEDING) AS strip FROM s)"""


@query(f"WITH {_STRIPS} SELECT doc, line, strip::BIGINT AS strip FROM st")
def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.strips(_boxes(spark, sf_dir)).select("doc", "line", "strip")


@query(f"""WITH {_STRIPS}, n AS (SELECT *, CASE WHEN x0 > max(x1) OVER (PARTITION BY doc, strip ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY doc, strip ORDER BY x0, x1) = 1 THEN 1 ELSE 0 END AS new2 FROM st),
sp AS (SELECT *, sum(new2) OVER (PARTITION BY doc, strip ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS span FROM n)
SELECT doc, strip::BIGINT AS strip, span::BIGINT AS span, min(x0) AS x0, max(x1) AS x1 FROM sp GROUP BY doc, strip, span""")
def span_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.spans(glyphs.strips(_boxes(spark, sf_dir)))


@query(f"""WITH {_BOXES}, fig AS (SELECT doc, line AS fig, x0, x1, top FROM box WHERE line % 3 = 0)
SELECT f.doc, f.fig, (SELECT l.line FROM box l WHERE l.doc = f.doc AND l.bot > f.top AND l.line % 3 <> 0 AND l.x0 < f.x1 AND l.x1 > f.x0 ORDER BY l.bot, l.line LIMIT 1) AS line FROM fig f""")
def figure_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    figures = boxes.where("line % 3 = 0").select("doc", F.col("line").alias("fig"), "x0", "x1", "top")
    return evaluate.figure_anchors(figures, boxes.where("line % 3 <> 0").withColumn("base", F.col("bot"))).select("doc", "fig", "line")


# --- text of pages as Markdown -------------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, line, list_filter(list_transform(string_split(t, '|'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM l WHERE contains(t, '|'))
SELECT doc_id, md5('| ' || array_to_string(cells, ' | ') || ' |' || chr(10) || '|' || repeat(' --- |', len(cells))) AS md5, line::INT AS line FROM c WHERE len(cells) > 0""")
def pipe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with bars as a table of one row."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(F.col("t").contains("|"))
    cells = F.filter(F.transform(F.split("t", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return each.select("doc_id", "line", cells.alias("cells")).where(F.size("cells") > 0).select("doc_id", "line", F.md5(T.pipe_table(F.array("cells"))).alias("md5"))


@query(r"""WITH m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, md5(string_agg(coalesce(text, '') || chr(10) || chr(10) || '*— side ' || turn || ' —*' || CASE WHEN turn = last THEN chr(10) ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) END, '' ORDER BY turn, role, text)) AS md5, count(*) AS n_pages
FROM m GROUP BY conv_id""")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages (turns) of each conversation as one Markdown text."""
    talk = table(spark, sf_dir, "conversations")
    last = talk.groupBy("conv_id").agg(F.max("turn").alias("last"))
    page = F.concat(F.coalesce("text", F.lit("")), T.page_marker(F.col("turn").cast("string"), F.col("turn") == F.col("last")))
    each = talk.join(last, "conv_id").select("conv_id", F.struct("turn", "role", "text", page.alias("page")).alias("p"))
    parts = F.transform(F.array_sort(F.collect_list("p")), lambda p: p["page"])
    return each.groupBy("conv_id").agg(F.md5(F.array_join(parts, "")).alias("md5"), F.count("*").alias("n_pages"))


@query(r"""SELECT conv_id, string_agg(CASE WHEN length(text) >= 30 THEN 'D' ELSE 'S' END, '' ORDER BY turn, length(text) >= 30) AS letters FROM conversations GROUP BY conv_id""")
def classify_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.coalesce(F.char_length("text") >= 30, F.lit(False)).alias("digital"))
    return pages.classify(talk).select(F.col("doc").alias("conv_id"), "letters")


@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
w AS (SELECT page_id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) AS w FROM b)
SELECT page_id, count(*) AS n_words, count(DISTINCT w) AS n_distinct FROM w GROUP BY page_id""")
def html_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(T.word_list(bare)).alias("w"))
    # Distinct words of a page are counted after one partial aggregate by page and word.
    return each.groupBy("page_id", "w").count().groupBy("page_id").agg(F.sum("count").alias("n_words"), F.count("*").alias("n_distinct"))


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


@query(rf"""WITH a AS (SELECT source, w, count(*) AS a FROM (SELECT source, unnest({_WORDS}) AS w FROM documents) GROUP BY 1, 2),
b AS (SELECT w, count(*) AS b FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY 1)
SELECT source, sum(least(a, b))::BIGINT AS common FROM a JOIN b USING (w) GROUP BY source""")
def note_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.explode(T.word_list(F.coalesce("text", F.lit("")))).alias("w")
    return evaluate.multiset_overlap(table(spark, sf_dir, "documents").select("source", w), table(spark, sf_dir, "benchmark").select(w), ["source"], "w")


_BREAKS = r"""
l AS (SELECT doc_id AS doc, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, 100.0::DOUBLE + 12 * line AS base, CASE WHEN line % 4 = 1 THEN 60.0 ELSE 50.0 END::DOUBLE AS x0, 50.0::DOUBLE + 5 * length(text) AS x1, CASE WHEN length(text) < 30 THEN 14.0 ELSE 10.0 END::DOUBLE AS size, line % 5 = 0 AS bold, line % 12 = 0 AS col_start FROM l),
c AS (SELECT *, sum(col_start::INT) OVER (PARTITION BY doc ORDER BY line) AS col, size >= 11.5 AND len(string_split_regex(trim(text), '\s+')) <= 25 AS heading FROM g),
e AS (SELECT *, min(x0) OVER (PARTITION BY doc, col) AS lft, max(x1) OVER (PARTITION BY doc, col) AS rgt FROM c),
p AS (SELECT *, lag(text) OVER w AS pt, lag(heading) OVER w AS ph, lag(base) OVER w AS pb, lag(size) OVER w AS ps, lag(bold) OVER w AS pbold, lag(x0) OVER w - lag(lft) OVER w > 8 AS pind, lag(rgt) OVER w - lag(x1) OVER w > 30 AS pshort, row_number() OVER w AS rn FROM e WINDOW w AS (PARTITION BY doc ORDER BY line)),
q AS (SELECT *, regexp_matches(pt, '[.!?:"”»]\s*$') AS ended FROM p),
b AS (SELECT *, CASE WHEN rn = 1 OR heading <> ph OR regexp_matches(text, '^[•●▪◦■–\x{F0B7}] ') OR regexp_matches(text, '^[0-9]{1,2}[).] ') OR
  CASE WHEN col_start THEN ended OR (NOT regexp_matches(text, '^\p{Ll}') AND NOT ends_with(trim(pt), '-'))
       ELSE base - pb > 15.6 OR abs(size - ps) > 1.0 OR (bold <> pbold AND NOT heading) OR (x0 - lft > 8 AND NOT pind AND ended) OR (pshort AND ended) END THEN 1 ELSE 0 END AS brk FROM q),
n AS (SELECT *, sum(brk) OVER (PARTITION BY doc ORDER BY line) AS para FROM b)"""


@query(f"WITH {_BREAKS} SELECT doc, para::BIGINT AS para, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars, bool_or(heading) AS heading FROM n GROUP BY doc, para")
def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    line, n = F.col("line"), F.char_length("text")
    placed = each.select(
        "doc", "line", "text", (100.0 + 12 * line).alias("base"), F.when(line % 4 == 1, 60.0).otherwise(50.0).alias("x0"), (50.0 + 5 * n).alias("x1"), F.when(n < 30, 14.0).otherwise(10.0).alias("size"),
        (line % 5 == 0).alias("bold"), (line % 12 == 0).alias("col_start"),
    )
    broken = paragraphs.paragraph_breaks(placed, placed.select("doc", F.lit(10.0).alias("body")).distinct())
    return broken.groupBy("doc", "para").agg(F.count("*").alias("n_lines"), F.sum(n).alias("n_chars"), F.bool_or("heading").alias("heading"))


# --- page measurements made of orders (documents) and their lines (pages) ------------------------------------------------

_METAS = """metas AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS page,
  (90 * (l_linenumber % 4))::INT AS rot, 10 * l_discount AS conf, 900 + (l_partkey % 9) * 100 AS w, 1000::BIGINT AS h,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE {'x0': 40 + l_partkey % 31, 'y0': 30 + l_suppkey % 17, 'x1': 800 + l_partkey % 29, 'y1': 900 + l_suppkey % 23} END AS trim,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE {'x': 450 + l_partkey % 13 * 10, 'w': 10 + l_suppkey % 11 * 12} END AS gutter, l_linenumber = 3 AS vector FROM lineitem)"""


def _metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    trim = F.struct((40 + p % 31).alias("x0"), (30 + s % 17).alias("y0"), (800 + p % 29).alias("x1"), (900 + s % 23).alias("y1"))
    gutter = F.struct((450 + p % 13 * 10).alias("x"), (10 + s % 11 * 12).alias("w"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.row_number().over(order).alias("page"), (90 * (F.col("l_linenumber") % 4)).cast("int").alias("rot"), (10 * F.col("l_discount")).alias("conf"),
        (900 + (p % 9) * 100).alias("w"), F.lit(1000).cast("long").alias("h"), F.when(s % 7 != 0, trim).alias("trim"), F.when(p % 5 != 0, gutter).alias("gutter"), (F.col("l_linenumber") == 3).alias("vector"),
    )


_CAND = "(w / h >= 1.15 AND NOT vector)"
_MEDIANS = f"""{_METAS}, med AS (SELECT doc, trunc(median(trim.x0) FILTER (NOT {_CAND} AND trim IS NOT NULL))::BIGINT AS bx0, trunc(median(trim.y0) FILTER (NOT {_CAND} AND trim IS NOT NULL))::BIGINT AS by0,
  trunc(median(trim.x1) FILTER (NOT {_CAND} AND trim IS NOT NULL))::BIGINT AS bx1, trunc(median(trim.y1) FILTER (NOT {_CAND} AND trim IS NOT NULL))::BIGINT AS by1,
  median(gutter.x / w) FILTER ({_CAND} AND gutter IS NOT NULL AND NOT (gutter.w > 0.08 * w)) AS fraction FROM metas GROUP BY doc)"""
_PLANS = f"""{_MEDIANS}, o AS (SELECT m.*, med.*, {_CAND} AS double_, (gutter IS NOT NULL AND (fraction IS NULL OR NOT (gutter.w > 0.08 * w))) AS trusted FROM metas m JOIN med USING (doc)),
q AS (SELECT *, CASE WHEN double_ AND trusted THEN gutter.x WHEN double_ AND fraction IS NOT NULL THEN trunc(fraction * w)::BIGINT END AS gx FROM o),
plan0 AS (SELECT doc, page, w, CASE WHEN double_ AND gx IS NULL THEN 'review' WHEN double_ THEN 'split' WHEN bx0 IS NOT NULL OR trim IS NOT NULL THEN 'box' ELSE 'whole' END AS kind, gx,
  CASE WHEN NOT double_ AND bx0 IS NOT NULL THEN bx0 ELSE coalesce(trim.x0, 0) END AS x0, CASE WHEN NOT double_ AND bx0 IS NOT NULL THEN by0 ELSE coalesce(trim.y0, 0) END AS y0,
  CASE WHEN NOT double_ AND bx0 IS NOT NULL THEN bx1 ELSE coalesce(trim.x1, w) END AS x1, CASE WHEN NOT double_ AND bx0 IS NOT NULL THEN by1 ELSE coalesce(trim.y1, h) END AS y1, trim IS NOT NULL AND double_ AND gx IS NOT NULL AS faces FROM q),
plan1 AS (SELECT *, CASE WHEN faces AND x0 >= gx THEN greatest(2 * gx - x1, 0) ELSE x0 END AS l FROM plan0),
plan AS (SELECT doc, page, kind, gx, l AS x0, y0, CASE WHEN faces AND x1 <= gx THEN least(2 * gx - l, w) ELSE x1 END AS x1, y1 FROM plan1)"""


@query(f"""WITH {_METAS}, v AS (SELECT doc, rot, count(*) AS n FROM metas WHERE conf >= 0.25 GROUP BY doc, rot), m AS (SELECT doc, max(n) AS most FROM v GROUP BY doc),
f AS (SELECT doc, CASE WHEN count(*) = 1 THEN min(rot) ELSE 0 END AS turn FROM v JOIN m USING (doc) WHERE n = most GROUP BY doc)
SELECT doc, coalesce(turn, 0)::INT AS turn FROM (SELECT DISTINCT doc FROM metas) LEFT JOIN f USING (doc)""")
def majority_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.majority_turn(_metas(spark, sf_dir))


@query(f"""WITH {_METAS}, v AS (SELECT doc, rot, count(*) AS n FROM metas WHERE conf >= 0.25 GROUP BY doc, rot), m AS (SELECT doc, max(n) AS most FROM v GROUP BY doc),
f AS (SELECT doc, CASE WHEN count(*) = 1 THEN min(rot) ELSE 0 END AS turn FROM v JOIN m USING (doc) WHERE n = most GROUP BY doc)
SELECT doc, page, CASE WHEN conf < 0.25 AND rot <> coalesce(turn, 0) THEN h ELSE w END AS w, (conf < 0.25 AND rot <> coalesce(turn, 0)) AS low FROM metas LEFT JOIN f USING (doc)""")
def low_confidence_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    metas = _metas(spark, sf_dir)
    return pages.turned(metas, metas.select("doc", "page", F.col("h").alias("w"))).select("doc", "page", "w", "low")


@query(f"WITH {_MEDIANS} SELECT doc, bx0 AS x0, by0 AS y0, bx1 AS x1, by1 AS y1, round(fraction, 9) AS fraction FROM med")
def plan_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.medians(_metas(spark, sf_dir)).select("doc", "box.*", F.round("fraction", 9).alias("fraction"))


@query(f"WITH {_PLANS} SELECT doc, page, kind, gx, x0, y0, x1, y1 FROM plan")
def plan_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.plans(_metas(spark, sf_dir)).select("doc", "page", "kind", "gx", "box.*")


@query(f"WITH {_PLANS} SELECT doc, max(CASE WHEN kind = 'split' THEN greatest(gx - x0, x1 - gx) ELSE x1 - x0 END) AS cw, max(y1 - y0) AS ch FROM plan GROUP BY doc")
def plan_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.canvas(pages.plans(_metas(spark, sf_dir)))


@query(f"""WITH {_PLANS}, n AS (SELECT doc, page, CASE WHEN kind = 'split' THEN 2 ELSE 1 END AS n FROM plan),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM n)
SELECT doc, page, slot::INT AS slot, (first + slot)::BIGINT AS ordinal FROM (SELECT *, unnest(range(n)) AS slot FROM b)""")
def output_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.slots(pages.plans(_metas(spark, sf_dir))).select("doc", "page", "slot", F.col("ordinal").cast("long").alias("ordinal"))


@query(f"""WITH {_PLANS}, s AS (SELECT doc, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) // 2 AS ax, (y1 - y0) // 3 AS ay FROM plan),
c AS (SELECT doc, 2 * max(greatest(ax, w - ax)) AS w, max(ay) + max(h - ay) AS h FROM s GROUP BY doc)
SELECT doc, w + 2 * trunc(0.012 * w)::BIGINT AS cw, h + 2 * trunc(0.012 * h)::BIGINT AS ch FROM c""")
def compose_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = pages.plans(_metas(spark, sf_dir)).select("doc", (F.col("box.x1") - F.col("box.x0")).alias("w"), (F.col("box.y1") - F.col("box.y0")).alias("h"))
    return pages.shared_canvas(boxes.select("*", F.expr("w div 2").alias("ax"), F.expr("h div 3").alias("ay")))


@query(f"""WITH {_METAS}, f AS (SELECT doc, page, w, h, trim.x0 AS x0, trim.x1 AS x1, trim.y0 AS y0 FROM metas WHERE trim IS NOT NULL)
SELECT doc, max(abs(x0 - (w - x1))) AS uneven, round(stddev_pop(x0), 6) AS x_stray, round(stddev_pop(y0), 6) AS y_stray, count(DISTINCT (w, h)) AS sizes FROM f GROUP BY doc""")
def margin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.margins(_metas(spark, sf_dir).where("trim is not null").select("doc", "w", "h", "trim.*"))


@query(f"""WITH {_METAS}, e AS (SELECT doc * 100 + page AS k, w, conf FROM metas WHERE page <> 2), m AS (SELECT doc * 100 + page AS k, w + (CASE WHEN rot = 90 THEN 5 ELSE 0 END) AS w, conf FROM metas WHERE page <> 3),
j AS (SELECT coalesce(e.k, m.k) AS k, e.w::DOUBLE AS ew, m.w::DOUBLE AS mw, e.conf AS ec, m.conf AS mc FROM e FULL JOIN m ON e.k = m.k),
p AS (SELECT k, 'w' AS "column", ew AS expected, mw AS measured FROM j UNION ALL SELECT k, 'conf', ec, mc FROM j)
SELECT * FROM p WHERE abs(expected - measured) > 2 OR (expected IS NULL) <> (measured IS NULL)""")
def facts_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _metas(spark, sf_dir).select((F.col("doc") * 100 + F.col("page")).alias("k"), "page", "rot", "w", "conf")
    measured = each.where("page <> 3").withColumn("w", F.col("w") + F.when(F.col("rot") == 90, 5).otherwise(0))
    return evaluate.facts_difference(each.where("page <> 2").select("k", "w", "conf"), measured.select("k", "w", "conf"), "k", ["w", "conf"], 2.0)


# --- density profiles and tiles made of vectors --------------------------------------------------------------------------

_PROFILE = """v AS (SELECT vec_id AS key, unnest(range(len(embedding)))::INT AS i, round(least(1.0, abs(unnest(embedding)::DOUBLE) * 3) * 255) / 255 AS d FROM embeddings)"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.posexplode("embedding").alias("i", "e"))
    return each.select("key", "i", profiles.quantised(F.least(F.lit(1.0), F.abs(F.col("e").cast("double")) * 3)).alias("d"))


_RUNS = f"""{_PROFILE}, ins AS (SELECT key, i, CASE WHEN i - lag(i) OVER (PARTITION BY key ORDER BY i) - 1 <= 1 THEN 0 ELSE 1 END AS new FROM v WHERE d BETWEEN 0.1 AND 0.7),
r AS (SELECT key, i, sum(new) OVER (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM ins),
runs AS (SELECT key, min(i)::INT AS start, (max(i) + 1)::INT AS stop FROM r GROUP BY key, run HAVING max(i) + 1 - min(i) >= 3)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.density_runs(_profile(spark, sf_dir), 0.1, 0.7, 1, 3)


@query(f"WITH {_RUNS} SELECT * FROM runs")
def density_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


@query(f"""WITH {_RUNS}, w AS (SELECT *, min(start) OVER p AS a, max(stop) OVER p AS b, count(*) OVER p AS c FROM runs WINDOW p AS (PARTITION BY key))
SELECT key, start, stop FROM w WHERE NOT (c > 1 AND ((start = a AND stop <= 0.1 * 64) OR (stop = b AND start >= 0.9 * 64)))""")
def band_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.without_bands(_runs(spark, sf_dir), 64)


@query(f"""WITH {_RUNS}, x AS (SELECT key, min(start) AS start, max(stop) AS stop FROM runs GROUP BY key),
n AS (SELECT x.key, start, stop, min(i) FILTER (i < start AND i >= start - 0.08 * 64) AS first, max(i + 1) FILTER (i >= stop AND i < stop + 0.08 * 64) AS last FROM x LEFT JOIN v ON v.key = x.key AND d BETWEEN 0.004 AND 0.55 GROUP BY ALL)
SELECT key, greatest(0, coalesce(first, start) - trunc(0.012 * 64)::INT)::INT AS lo, least(64, coalesce(last, stop) + trunc(0.012 * 64)::INT)::INT AS hi FROM n""")
def near_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.near_extension(_profile(spark, sf_dir), _runs(spark, sf_dir), 64)


@query(f"""WITH {_PROFILE}, q AS (SELECT key, i, i - row_number() OVER (PARTITION BY key ORDER BY i) AS g FROM v WHERE d <= 0.4),
r AS (SELECT key, min(i) AS start, count(*) AS len FROM q GROUP BY key, g), k AS (SELECT * FROM r WHERE 2 * start + len BETWEEN 2 * 0.2 * 64 AND 2 * 0.8 * 64)
SELECT key, start::INT AS start, len::INT AS len FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY len DESC, start) AS o FROM k) WHERE o = 1""")
def widest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.widest_gap(_profile(spark, sf_dir), 0.4, 0.2, 0.8, 64).select("key", "start", "len")


@query(f"""WITH {_PROFILE}, m AS (SELECT key, i, round(avg(d) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS m FROM v),
l AS (SELECT key, m AS depth, i AS at_ FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY m, i) AS o FROM m WHERE i BETWEEN 0.2 * 64 AND 0.8 * 64) WHERE o = 1),
s AS (SELECT l.key, depth, at_, avg(m) FILTER (i - at_ BETWEEN -0.15 * 64 AND -0.03 * 64) AS lf, avg(m) FILTER (i - at_ BETWEEN 0.03 * 64 AND 0.15 * 64) AS rt FROM l JOIN m USING (key) GROUP BY ALL)
SELECT key, at_ AS i, depth FROM s WHERE depth <= lf / 2 AND depth <= rt / 2""")
def valley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.valley(_profile(spark, sf_dir), 64, 1)


@query(f"""WITH {_PROFILE}, s AS (SELECT key, d, d - lag(d) OVER (PARTITION BY key ORDER BY i) AS t FROM v)
SELECT key, round(sum(t * t) / greatest(sum(d * d), 1e-12), 6) AS sharpness FROM s GROUP BY key""")
def profile_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.sharpness(_profile(spark, sf_dir)).select("key", F.round("sharpness", 6).alias("sharpness"))


@query(f"""WITH {_PROFILE}, m AS (SELECT *, max(d) OVER (PARTITION BY key) AS most FROM v) SELECT key, (min(i) + max(i)) / 2 AS middle FROM m WHERE d = most GROUP BY key""")
def plateau_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.plateau_middle(_profile(spark, sf_dir))


@query(f"""WITH {_PROFILE}, b AS (SELECT key, least(floor(d * 64), 63) AS bin, count(*) AS c FROM v GROUP BY 1, 2), e AS (SELECT key, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM b GROUP BY key),
s AS (SELECT key, avg(d) AS m, sqrt(greatest(sum(d * d) / count(*) - (sum(d) / count(*)) * (sum(d) / count(*)), 0)) AS sd, avg((d BETWEEN 0.2 AND 0.8)::INT) AS mid, avg((d <= 0.6)::INT) AS ink FROM v GROUP BY key)
SELECT key, round(m, 6) AS lum_mean, round(sd, 6) AS lum_std, round(mid, 6) AS midtone, round(entropy, 6) AS entropy, round(ink, 6) AS ink FROM s JOIN e USING (key)""")
def tile_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.tile_signals(_profile(spark, sf_dir))


@query("""WITH RECURSIVE v AS (SELECT vec_id AS key, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings), c AS (SELECT key, (i % 8)::INT AS x, (i // 8)::INT AS y FROM v WHERE e > 0.1),
reach AS (SELECT key, x, y, y * 1000 + x AS root FROM c UNION SELECT n.key, n.x, n.y, r.root FROM reach r JOIN c n ON n.key = r.key AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1)
SELECT key, x, y, min(root)::INT AS root FROM reach GROUP BY key, x, y""")
def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.posexplode("embedding").alias("i", "e"))
    cells = each.where(F.col("e").cast("double") > 0.1).select("key", (F.col("i") % 8).cast("int").alias("x"), F.expr("int(i div 8)").alias("y"))
    return profiles.grid_components(cells)


# --- scored pages: labels of documents, a signal of their text, the source as the file -----------------------------------

_SCORED = """scored AS (SELECT d.source AS file, l.quality = 1 AS label, (length(d.text) % 997)::DOUBLE / 997 AS v, length(d.text) AS size, d.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("label")).join(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("source").alias("file"), F.char_length("text").alias("size")), "doc_id")
    return joined.select("file", "label", ((F.col("size") % 997).cast("double") / 997).alias("v"), "size", "doc_id")


_AUC = """r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY v) + (count(*) OVER (PARTITION BY {by}, v) - 1) / 2 AS rk FROM scored),
s AS (SELECT {by}, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg, sum(rk) FILTER (label) AS ranks FROM r GROUP BY {by}),
a AS (SELECT *, (ranks - pos * (pos + 1) / 2) / (pos * neg) AS u FROM s WHERE pos > 0 AND neg > 0)"""


@query(f"WITH {_SCORED}, {_AUC.format(by='file')} SELECT file, pos, neg, round(greatest(u, 1 - u), 6) AS auc FROM a")
def auc_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.auc(_scored(spark, sf_dir), ["file"])


@query(f"WITH {_SCORED}, {_AUC.format(by='file')} SELECT min(round(greatest(u, 1 - u), 6)) AS least, max(round(greatest(u, 1 - u), 6)) AS most, count(*) AS files FROM a WHERE pos >= 3 AND neg >= 3")
def auc_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.auc(_scored(spark, sf_dir), ["file"]).where("pos >= 3 and neg >= 3").agg(F.min("auc").alias("least"), F.max("auc").alias("most"), F.count("*").alias("files"))


@query(f"""WITH {_SCORED}, c AS (SELECT DISTINCT file, v FROM scored), t AS (SELECT c.file, c.v, avg((s.v > c.v)::INT) FILTER (s.label) AS tpr, avg((s.v <= c.v)::INT) FILTER (NOT s.label) AS tnr FROM c JOIN scored s ON s.file = c.file GROUP BY c.file, c.v),
b AS (SELECT file, v, round(greatest((tpr + tnr) / 2, 1 - (tpr + tnr) / 2), 9) AS b FROM t WHERE tpr IS NOT NULL AND tnr IS NOT NULL)
SELECT file, v AS cut, round(b, 6) AS balanced FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY b DESC, v) AS o FROM b) WHERE o = 1""")
def best_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_cut(_scored(spark, sf_dir), ["file"])


@query(f"""WITH {_SCORED}, p AS (SELECT file, v, count(*) OVER (PARTITION BY file) AS n, row_number() OVER (PARTITION BY file ORDER BY v) - 1 AS k FROM scored WHERE label)
SELECT file, v AS cut FROM p WHERE k = least(n - 1, trunc({1 - 0.9!r}::DOUBLE * n)::BIGINT)""")
def recall_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall_cut(_scored(spark, sf_dir), ["file"], 0.9)


@query(f"""WITH {_SCORED}, f AS (SELECT DISTINCT file FROM scored), c AS (SELECT f.file, min(s.v) AS cut FROM f JOIN scored s ON s.file <> f.file AND s.label GROUP BY f.file)
SELECT file, cut, count(*) FILTER (v >= cut AND label) AS caught, count(*) FILTER (label) AS positives, count(*) FILTER (v >= cut AND NOT label) AS flagged, count(*) FILTER (NOT label) AS negatives FROM scored JOIN c USING (file) GROUP BY file, cut""")
def leave_one_file_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.leave_one_out(_scored(spark, sf_dir))


_CUTS = [("all", 0.0), ("half", 0.5), ("few", 0.9)]


@query(f"""WITH {_SCORED}, r(policy, cut) AS (VALUES {', '.join(f"('{n}', {c}::DOUBLE)" for n, c in _CUTS)}),
s AS (SELECT policy, file, label, v >= cut AS keep, size FROM scored CROSS JOIN r)
SELECT policy, file, sum((label AND keep)::INT)::BIGINT AS kept, sum((label AND NOT keep)::INT)::BIGINT AS lost, sum(CASE WHEN keep THEN size ELSE trunc(size / 10)::BIGINT END)::BIGINT AS bytes FROM s GROUP BY GROUPING SETS ((policy, file), (policy))""")
def policy_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.policy_prices(_scored(spark, sf_dir), _CUTS, "size")


_TILES = """tiles AS (SELECT doc_id // 4 AS page, (doc_id % 4)::INT AS tile, (doc_id % 4)::INT * 320 AS x0, 0 AS y0, (doc_id % 4)::INT * 320 + 320 AS x1, 320 AS y1 FROM documents),
regions AS (SELECT doc_id // 4 AS page, CASE WHEN quality = 1 THEN 'picture' ELSE 'text' END AS class, (doc_id % 4)::INT AS no, (doc_id % 7)::INT * 50 AS x0, (doc_id % 5)::INT * 20 AS y0, (doc_id % 7)::INT * 50 + 500 AS x1, 300 + (doc_id % 3)::INT * 50 AS y1 FROM labels)"""


def _tiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("doc_id")
    q = lambda m: (k % m).cast("int")
    tiles = table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("page"), q(4).alias("tile"), (q(4) * 320).alias("x0"), F.lit(0).alias("y0"), (q(4) * 320 + 320).alias("x1"), F.lit(320).alias("y1"))
    regions = table(spark, sf_dir, "labels").select(F.expr("doc_id div 4").alias("page"), F.when(F.col("quality") == 1, "picture").otherwise("text").alias("class"), q(4).alias("no"), (q(7) * 50).alias("x0"), (q(5) * 20).alias("y0"), (q(7) * 50 + 500).alias("x1"), (300 + q(3) * 50).alias("y1"))
    return tiles, regions


@query(f"""WITH {_TILES}, m AS (SELECT t.page, t.tile, r.class, r.no, (least(t.x1, r.x1) - greatest(t.x0, r.x0)) * (least(t.y1, r.y1) - greatest(t.y0, r.y0)) >= 0.75 * (t.x1 - t.x0) * (t.y1 - t.y0) AS covers
  FROM tiles t JOIN regions r ON r.page = t.page AND r.x0 < t.x1 AND r.x1 > t.x0 AND r.y0 < t.y1 AND r.y1 > t.y0),
f AS (SELECT page, tile, arg_max(class, no) FILTER (covers) AS class FROM m GROUP BY page, tile)
SELECT t.page, t.tile, CASE WHEN f.page IS NULL THEN 'rest' ELSE f.class END AS class FROM tiles t LEFT JOIN f ON f.page = t.page AND f.tile = t.tile""")
def tile_region_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.region_labels(*_tiles(spark, sf_dir)).select("page", "tile", "class")


@query(f"""WITH {_TILES}, b AS (SELECT page, x0, y0, x0 + 200 AS x1, y1 FROM tiles), g AS (SELECT page, no, x, unnest(range(y0, y1, 10)) AS y FROM (SELECT *, unnest(range(x0, x1, 10)) AS x FROM regions)),
h AS (SELECT g.*, EXISTS (SELECT 1 FROM b WHERE b.page = g.page AND g.x >= b.x0 AND g.x < b.x1 AND g.y >= b.y0 AND g.y < b.y1) AS hit FROM g)
SELECT page, no, round(avg(hit::INT), 6) AS covered FROM h GROUP BY page, no""")
def region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles, regions = _tiles(spark, sf_dir)
    return evaluate.coverage(regions, tiles.withColumn("x1", F.col("x0") + 200))
