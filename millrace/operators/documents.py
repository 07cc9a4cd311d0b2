"""Document corpus profile from text columns: sections, pages and embedded tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of table markup.
HTML_TABLE = r"(?i)<table[\s>]"
DELIMITER_ROW = r"\|[^\n\r]+\|\r?\n(?U)\s*\|[\s:\-|=]+\|"
GRID_BORDER = r"(?md)^\s*\+[-+=]+\+[-+=+]+\s*$"
BOX_DRAWING = "┌┬┐├┼┤└┴┘│║═"
HEADING = r"(?md)^#{1,6}(?U)\s+\S"
# Line ends as Python splits them; white space as Python strips it.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WIDE_GAP = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}"


def decode_text(content: Column) -> Column:
    """UTF-8, or Latin-1 when the bytes are not valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACES}]")


def page_count(text: Column) -> Column:
    """Non-blank form-feed parts, at least 1; 1 without form feed, 0 for blank text."""
    parts = F.size(F.filter(F.split(text, "\f"), lambda p: ~is_blank(p)))
    return F.when(F.contains(text, F.lit("\f")), F.greatest(F.lit(1), parts)).when(is_blank(text), 0).otherwise(1)


def section_count(text: Column) -> Column:
    """Markdown headings; 1 without any, 0 for blank text."""
    headings = F.regexp_count(text, F.lit(HEADING))
    return F.when(headings > 0, headings).when(is_blank(text), 0).otherwise(1)


def marked_table(text: Column) -> Column:
    """HTML, Markdown delimiter row, ASCII grid or box-drawing characters."""
    found = text.rlike(HTML_TABLE) | text.rlike(DELIMITER_ROW) | text.rlike(GRID_BORDER)
    for mark in BOX_DRAWING:
        found = found | F.contains(text, F.lit(mark))
    return found


def row_table(text: Column) -> Column:
    """Two consecutive lines of pipe cells, of tab cells, or of three or more aligned columns.

    Each line is read once and becomes one digit of three bits (pipes 1, tabs 2, columns 4); a table
    is two neighbouring digits that share a bit.
    """

    def digit(line: Column) -> Column:
        line = F.btrim(line, F.lit(SPACES))
        pipes = line.startswith("|") & line.endswith("|") & (F.length(line) > 1)
        tabs = F.contains(line, F.lit("\t"))
        # The line is stripped, so no part between wide gaps is empty.
        columns = F.regexp_count(line, F.lit(_WIDE_GAP)) >= 2
        return (pipes.cast("int") + tabs.cast("int") * 2 + columns.cast("int") * 4).cast("string")

    digits = F.array_join(F.transform(F.split(text, LINE_END), digit), "")
    return digits.rlike("[1357]{2}|[2367]{2}|[4567]{2}")


def has_table(text: Column) -> Column:
    return F.coalesce(marked_table(text) | row_table(text), F.lit(False))


def profile_documents(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return df.withColumns({
        "pages": page_count(t), "sections": section_count(t), "has_embedded_tables": has_table(t),
    })


def table_share(profiled: DataFrame, by: Sequence[str]) -> DataFrame:
    """Documents and the share of them with an embedded table, per group."""
    return profiled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.avg(F.col("has_embedded_tables").cast("double")).alias("table_share"),
    )
