"""Scalar text functions of the page text layer, as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures and what they stand for.
LIGATURES = [("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st"), ("\u00a0", " ")]
#: What may stand around a page number, the words before one, and those between a number and the page count.
NUMBER_FRAME = "\\-\u2013\u2014|·•()\\[\\] "
NUMBER_PREFIXES = ["side ", "page ", "s. ", "p. "]
NUMBER_OF = ["of", "af"]
#: Signs that open a list item.
BULLETS = "•●▪◦■–\uf0b7"


def ligatures(text: Column) -> Column:
    """Ligatures spelled out, no-break spaces as spaces."""
    for sign, letters in LIGATURES:
        text = F.replace(text, F.lit(sign), F.lit(letters))
    return text


def normalised(text: Column) -> Column:
    """Lower case, each run of digits as one number sign (which takes in a number sign before it)."""
    return F.regexp_replace(F.lower(text), "#?[0-9]+", "#")


def page_number(text: Column) -> Column:
    """The page number that a short line states (`- 12 -`, `Page 3 of 9`, `4/10`), else null."""
    frame = f"^[{NUMBER_FRAME}]+|[{NUMBER_FRAME}]+$"
    bare = F.lower(F.regexp_replace(F.trim(text), frame, ""))
    for prefix in NUMBER_PREFIXES:
        bare = F.regexp_replace(bare, "^" + prefix.replace(".", "\\."), "")
    plain = F.regexp_extract(bare, r"^([0-9]{1,4})$", 1)
    of_all = F.regexp_extract(bare, r"^([0-9]{1,4}) *(?:/| (?:" + "|".join(NUMBER_OF) + r") ) *[0-9]{1,4}$", 1)
    return F.nullif(F.concat(plain, of_all), F.lit("")).cast("int")


def edge_numbers(text: Column) -> Column:
    """Numbers of 1 to 4 digits that the first and the last word are, but for what stands around the digits."""
    words = F.split(F.trim(text), r"\s+")
    ends = F.array(F.get(words, F.lit(0)), F.get(words, F.size(words) - 1))
    bare = F.transform(ends, lambda w: F.regexp_replace(w, "^[^0-9]+|[^0-9]+$", ""))
    return F.transform(F.filter(bare, lambda w: w.rlike("^[0-9]{1,4}$")), lambda w: w.cast("int"))


def ends_sentence(text: Column) -> Column:
    return text.rlike('[.!?:"”»]\\s*$')


def starts_lower(text: Column) -> Column:
    return text.rlike(r"^\p{Ll}")


def bullet(text: Column) -> Column:
    """What follows a bullet, else null."""
    return F.when(text.rlike(f"^[{BULLETS}] "), F.substring(text, F.lit(3), F.length(text)))


def numbered(text: Column) -> Column:
    return text.rlike(r"^[0-9]{1,2}[).] ")


def word_list(text: Column) -> Column:
    """The words of a text in lower case: letters, digits and low lines."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def words(text: Column) -> Column:
    """Markdown to words in lower case: images, formulas, tags, page markers and line prefixes are left out."""
    for pattern in (r"!\[[^\]]*\]\([^)]*\)", r"!\[\[[^\]]*\]\]", r"\$\$[^$]*\$\$", r"\$[^$\n]*\$", r"<[^>]*>", r"\*— [^*]* —\*"):
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(text, r"(?m)^[#>\-| ]+", "")
    return word_list(text)


def join_lines(lines: Column) -> Column:
    """One paragraph of lines: a hyphen before a lower-case start and a soft hyphen go, else a space comes between."""

    def add(held: Column, line: Column) -> Column:
        # The end alone tells: a letter, a hyphen and at most a line's end of two characters.
        hyphen = F.substring(held, -4, 4).rlike(r"\p{L}-$") & starts_lower(line)
        soft = held.endswith("\u00ad")
        return F.when(held == "", line).when(hyphen | soft, F.concat(F.substring(held, F.lit(1), F.length(held) - 1), line)).otherwise(F.concat(held, F.lit(" "), line))

    return F.aggregate(lines, F.lit(""), add)


def pipe_table(rows: Column) -> Column:
    """Rows of cells as a Markdown table with a rule after its first row."""
    lines = F.transform(rows, lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(rows, F.lit(0)))))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def page_marker(label: Column, last: Column, notes: Column | None = None) -> Column:
    """What closes a page in Markdown: its notes (an array), if it has any, and its label."""
    marker = F.concat(F.lit("\n\n*— side "), label, F.lit(" —*"), F.when(last, "\n").otherwise("\n\n---\n\n"))
    if notes is None:
        return marker
    return F.concat(F.when(F.size(notes) > 0, F.concat(F.lit("\n\n---\n"), F.array_join(notes, "\n\n"))).otherwise(""), marker)


def heading_markup(text: Column, level: Column) -> Column:
    """A paragraph with the signs of its heading level; without one (null), what would read as markup is escaped."""
    return F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).when(text.rlike("^[#>]"), F.concat(F.lit("\\"), text)).otherwise(text)


def figure_name(stem: Column, page: Column, n: Column, ext: Column) -> Column:
    return F.format_string("%s_p%d_%d.%s", stem, page, n, ext)


def colour_list(text: Column) -> Column:
    """`12,3a,4b` as an array of (page, slot: 0, 1 or null for both); `none` is empty, `all` is page 0."""
    entry = lambda e: F.struct(F.regexp_extract(e, r"^([0-9]+)", 1).cast("int").alias("page"), F.when(e.endswith("a"), 0).when(e.endswith("b"), 1).alias("slot"))
    every = F.array(F.struct(F.lit(0).alias("page"), F.lit(None).cast("int").alias("slot")))
    listed = F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ","), lambda e: e.rlike("^[0-9]+[ab]?$"))
    return F.when(text == "all", every).otherwise(F.transform(listed, entry))


def output_name(path: Column, ending: str = "1bit") -> Column:
    """The name of a shrunk document: its own without .pdf, and an ending."""
    return F.concat(F.regexp_replace(path, r"\.pdf$", ""), F.lit(f".{ending}.pdf"))


#: Characters beyond Latin-1 that the fonts' encoding has, and their bytes.
WINANSI = {"\u2018": 0x91, "\u2019": 0x92, "\u201c": 0x93, "\u201d": 0x94, "\u2022": 0x95, "\u2013": 0x96, "\u2014": 0x97, "\u2026": 0x85, "\u20ac": 0x80}


def winansi(text: Column) -> Column:
    """struct<bytes, skipped>: the text in the fonts' one-byte encoding, and how many characters it does not have."""
    known = "".join(WINANSI)
    # Most lines have only what both encodings have at the same place, which one class of two ranges tells soonest.
    other = F.coalesce(text.rlike(r"[^\x20-\x7e\xa0-\xff]"), F.lit(True))
    kept = F.when(other, F.regexp_replace(text, f"[^\\x20-\\x7e\\xa0-\\xff{known}]", "")).otherwise(text)
    moved = F.when(other, F.translate(kept, known, "".join(map(chr, WINANSI.values())))).otherwise(text)
    return F.struct(F.encode(moved, "ISO-8859-1").alias("bytes"), (F.char_length(text) - F.char_length(kept)).alias("skipped"))


def row_count(text: Column, w: Column, h: Column) -> Column:
    """Into how many rows of half-square letters a text is cut to fill a box."""
    n = F.char_length(text)
    return F.greatest(F.lit(1), F.least(F.round(F.sqrt(0.5 * n * F.greatest(h, F.lit(1.0)) / F.greatest(w, F.lit(1.0)))), F.greatest(n, F.lit(1)))).cast("int")


def rows_of_box(text: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """array<struct<s, x0, y0, x1, y1>>: the text in the rows of its box, each cut at the space nearest the even split; the last row
    is as wide as its share of letters."""
    n, k = F.char_length(text), row_count(text, x1 - x0, y1 - y0)
    per, high = F.greatest(n, F.lit(1)) / k, (y1 - y0) / k
    spaces = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(F.substring(text, i, F.lit(1)) == " ", i - 1)), lambda i: i.isNotNull() & (i > 0))

    def cut(held: Column, r: Column) -> Column:
        at = F.element_at(held, -1)
        goal = F.floor((r + 1) * per).cast("int")
        nearest = F.array_min(F.transform(spaces, lambda i: F.struct(F.abs(i - goal).alias("d"), i.alias("i"))))["i"]
        end = F.when(r + 1 == k, n).when(nearest > at, nearest).otherwise(F.least(F.greatest(goal, at + 1), n))
        return F.concat(held, F.array(end))

    ends = F.aggregate(F.sequence(F.lit(0), k - 1), F.array(F.lit(0)), cut)
    row = lambda r: F.trim(F.substring(text, F.get(ends, r) + 1, F.get(ends, r + 1) - F.get(ends, r)))
    wide = lambda r: F.when(r + 1 == k, x0 + (x1 - x0) * F.least(F.char_length(row(r)) / per, F.lit(1.0))).otherwise(x1)
    each = F.transform(F.sequence(F.lit(0), k - 1), lambda r: F.struct(row(r).alias("s"), x0.alias("x0"), (y0 + r * high).alias("y0"), wide(r).alias("x1"), (y0 + (r + 1) * high).alias("y1")))
    return F.filter(each, lambda r: r["s"] != "")


def composed(text: Column) -> Column:
    """Unicode text in composed form (NFC), in which file names of all systems are alike. For small tables of names."""

    @F.pandas_udf("string")
    def nfc(names: pd.Series) -> pd.Series:
        return names.str.normalize("NFC")

    return nfc(text)
