"""Queries on document structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query, shown
from millrace.catalog.views import table
from millrace.operators import documents

_WRAPPED = """w AS (SELECT doc_id, lang, source, CASE doc_id % 8
  WHEN 0 THEN text || chr(12) || text || chr(12) || ' ' WHEN 1 THEN '# Head' || chr(10) || text || chr(10) || '## Next' || chr(10) || 'end'
  WHEN 2 THEN text || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |'
  WHEN 3 THEN text || chr(10) || 'a' || chr(9) || 'b' || chr(10) || 'c' || chr(9) || 'd'
  WHEN 4 THEN '+----+----+' || chr(10) || text WHEN 5 THEN text || chr(10) || 'x   y   z' || chr(10) || 'p   q   r'
  WHEN 6 THEN text || chr(10) || '| a | b |' || chr(10) || 'text' || chr(10) || '| c | d |' ELSE text END AS text FROM documents)"""

_S = r"[\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_N = r"[^\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BLANK = f"NOT regexp_matches(text, '{_N}')"
_PAGES = (
    f"CASE WHEN contains(text, chr(12)) THEN greatest(1, len(list_filter(string_split(text, chr(12)), lambda p: regexp_matches(p, '{_N}'))))"
    f" WHEN {_BLANK} THEN 0 ELSE 1 END"
)
_HEADS = f"len(regexp_extract_all(text, '(?m)^#{{1,6}}{_S}+{_N}'))"
_SECTIONS = f"CASE WHEN {_HEADS} > 0 THEN {_HEADS} WHEN {_BLANK} THEN 0 ELSE 1 END"
_LINES = (
    r"list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), "
    f"lambda x: regexp_replace(regexp_replace(x, '^{_S}+', ''), '{_S}+$', ''))"
)


def _pairs(test: str) -> str:
    flags = f"list_transform(lines, lambda x: {test})"
    return f"list_bool_or(list_transform(list_zip({flags}, {flags}[2:]), lambda z: coalesce(z[1] AND z[2], false)))"


_MARKED = (
    r"regexp_matches(text, '(?i)<table[\s>]') OR regexp_matches(text, '\|[^\n\r]+\|\r?\n" + _S + r"*\|(?:" + _S + r"|[:\-|=])+\|')"
    r" OR regexp_matches(text, '(?m)^" + _S + r"*\+[-+=]+\+[-+=+]+" + _S + r"*$') OR regexp_matches(text, '[┌┬┐├┼┤└┴┘│║═]')"
)
_ROWS = " OR ".join([
    _pairs("starts_with(x, '|') AND ends_with(x, '|') AND length(x) > 1"),
    _pairs("contains(x, chr(9))"),
    _pairs(f"len(regexp_extract_all(x, '{_S}{{2,}}')) >= 2"),
])
_TABLES = f"coalesce({_MARKED} OR {_ROWS}, false)"


def _wrapped(spark, sf_dir):
    """Whole documents, most of them wrapped with page breaks, headings or table rows."""
    t, turn = F.col("text"), F.col("doc_id") % 8
    shapes = [
        F.concat(t, F.lit("\f"), t, F.lit("\f ")),
        F.concat(F.lit("# Head\n"), t, F.lit("\n## Next\nend")),
        F.concat(t, F.lit("\n| a | b |\n|---|---|\n| 1 | 2 |")),
        F.concat(t, F.lit("\na\tb\nc\td")),
        F.concat(F.lit("+----+----+\n"), t),
        F.concat(t, F.lit("\nx   y   z\np   q   r")),
        F.concat(t, F.lit("\n| a | b |\ntext\n| c | d |")),
    ]
    text = t
    for i, shape in enumerate(shapes):
        text = F.when(turn == i, shape).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.alias("text"))


@query(f"WITH {_WRAPPED} SELECT doc_id, CAST({_PAGES} AS BIGINT) AS pages, CAST({_SECTIONS} AS BIGINT) AS sections FROM w")
def document_sections(spark, sf_dir):
    profiled = documents.profile_documents(_wrapped(spark, sf_dir))
    return shown(profiled.select("doc_id", "pages", "sections"))


@query(f"WITH {_WRAPPED}, l AS (SELECT doc_id, text, {_LINES} AS lines FROM w) SELECT doc_id, {_TABLES} AS has_embedded_tables FROM l")
def document_tables(spark, sf_dir):
    return documents.profile_documents(_wrapped(spark, sf_dir)).select("doc_id", "has_embedded_tables")


@query(f"""WITH {_WRAPPED}, l AS (SELECT doc_id, lang, source, text, {_LINES} AS lines FROM w)
SELECT source, lang, count(*) AS documents, round(avg(CASE WHEN {_TABLES} THEN 1.0 ELSE 0.0 END), 4) AS table_share FROM l GROUP BY 1, 2""")
def table_share(spark, sf_dir):
    return shown(documents.table_share(documents.profile_documents(_wrapped(spark, sf_dir)), ["source", "lang"]))


@query(f"WITH l AS (SELECT page_id, html AS text, {_LINES.replace('(text,', '(html,')} AS lines FROM pages) SELECT page_id, {_TABLES} AS has_embedded_tables FROM l")
def page_tables(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return documents.profile_documents(pages).select("page_id", "has_embedded_tables")


@query("SELECT doc_id, text FROM documents")
def decoded_documents(spark, sf_dir):
    """Texts stored as UTF-8 or, where every character allows it, as Latin-1: read back unchanged."""
    text = F.col("text")
    # Latin-1 bytes that happen to be valid UTF-8 cannot be told apart; a pure ASCII text is both.
    narrow = ~text.rlike(r"[^\x00-\xff]") & ~F.is_valid_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    stored = F.when(narrow, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", documents.decode_text(stored).alias("text"))
