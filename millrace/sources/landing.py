"""Landing-zone audit: which files of a directory may enter, and why not.

Rules run from cheap to dear and the first failing one wins. Name and size rules read no content;
signatures and NUL bytes read each file once; line lengths come from a split text read, so that
no file has to fit one line; Parquet row counts come from the footers. A folder named ``*.parquet`` is one
table: it is judged by its parts and by the rows of all of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Usual upload limits, allowed extensions and the MIME types that go with each.
MAX_BYTES = 50 * 1024 * 1024
MAX_LINE_BYTES = 10 * 1024 * 1024
MAX_COLUMNS = 10_000
MAX_PARQUET_ROWS = 1_000_000
TABULAR = ("csv", "tsv", "xlsx", "xls", "parquet", "txt")
DOCUMENTS = ("pdf", "docx", "txt", "md")
MIME_TYPES: dict[str, tuple[str, ...]] = {
    "csv": ("text/csv", "text/plain", "application/vnd.ms-excel"),
    "tsv": ("text/tab-separated-values", "text/plain", "text/csv"),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",),
    "xls": ("application/vnd.ms-excel",),
    "parquet": ("application/vnd.apache.parquet", "application/x-parquet", "application/octet-stream"),
    "pdf": ("application/pdf",),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
    "txt": ("text/plain",),
    "md": ("text/markdown", "text/plain"),
}
UNDECLARED_MIME = ("", "application/octet-stream", "multipart/form-data")
EXECUTABLE_MARKS: dict[str, tuple[bytes, ...]] = {
    "Windows executable": (b"MZ",),
    "Linux ELF": (b"\x7fELF",),
    "Mach-O executable": (b"\xfe\xed\xfa\xce", b"\xce\xfa\xed\xfe", b"\xfe\xed\xfa\xcf", b"\xcf\xfa\xed\xfe", b"\xca\xfe\xba\xbe", b"\xbe\xba\xfe\xca"),
    "script": (b"#!",),
    "PNG image": (b"\x89PNG\r\n\x1a\n",),
}
FORMAT_MARKS = {
    "parquet": b"PAR1", "xlsx": b"PK\x03\x04", "docx": b"PK\x03\x04", "xls": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "pdf": b"%PDF-",
}


@dataclass(frozen=True)
class Limits:
    """What may enter; None is no limit. ``UPLOAD`` holds the limits of a small upload service."""

    file_bytes: int | None = None
    line_bytes: int | None = None
    columns: int | None = None
    parquet_rows: int | None = None
    extensions: tuple[str, ...] = TABULAR


UPLOAD = Limits(MAX_BYTES, MAX_LINE_BYTES, MAX_COLUMNS, MAX_PARQUET_ROWS)
# A file of more bytes does not fit one cell, so its content is not looked at.
_CELL_BYTES = 2_000_000_000


def _over(value: Column, limit: int | None) -> Column:
    return F.lit(False) if limit is None else value > limit


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(name, r"\.([^.]*)$", 1)))


def _starts(content: Column, *marks: bytes) -> Column:
    hit = F.lit(False)
    for mark in marks:
        hit = hit | (F.substring(content, 1, len(mark)) == F.lit(bytearray(mark)))
    return hit


def _verdict(status: int, reason: str | Column) -> Column:
    return F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def _first_failure(rules: list[tuple[Column, int, str | Column]]) -> Column:
    chain = None
    for broken, status, reason in rules:
        chain = F.when(broken, _verdict(status, reason)) if chain is None else chain.when(broken, _verdict(status, reason))
    return chain


def name_rules(limits: Limits) -> list[tuple[Column, int, str | Column]]:
    name, ext = F.col("name"), F.col("extension")
    return [
        (_over(F.col("length"), limits.file_bytes), 413, "file too large"),
        (F.col("length") == 0, 422, "empty file"),
        (F.contains(name, F.lit("\x00")) | F.contains(F.lower(name), F.lit("%00")), 415, "null byte in file name"),
        (~F.contains(name, F.lit(".")), 415, "no extension"),
        (~ext.isin(*limits.extensions), 415, "extension not allowed"),
    ]


def mime_rule() -> tuple[Column, int, str]:
    declared = F.lower(F.trim(F.substring_index(F.col("mime"), ";", 1)))
    known = F.col("mime").isNotNull() & ~declared.isin(*UNDECLARED_MIME)
    agrees = F.lit(False)
    for ext, mimes in MIME_TYPES.items():
        agrees = agrees | ((F.col("extension") == ext) & declared.isin(*mimes))
    return known & ~agrees, 415, "declared type disagrees with extension"


def content_rules() -> list[tuple[Column, int, str | Column]]:
    content, ext = F.col("content"), F.col("extension")
    rules: list[tuple[Column, int, str | Column]] = [
        (_starts(content, *marks), 415, f"signature of {label}") for label, marks in EXECUTABLE_MARKS.items()
    ]
    for kind, mark in FORMAT_MARKS.items():
        rules.append(((ext == kind) & ~_starts(content, mark), 415, f"not a {kind} file"))
    tail = F.substring(content, -4, 4)
    rules.append(((ext == "parquet") & (tail != F.lit(bytearray(FORMAT_MARKS["parquet"]))), 422, "corrupted Parquet file"))
    # ISO-8859-1 maps each byte to one character, so a NUL byte stays findable.
    text = F.decode(content, "ISO-8859-1")
    rules.append((ext.isin("csv", "tsv", "txt", "md") & F.contains(text, F.lit("\x00")), 415, "null byte in text"))
    return rules


def header_columns(content: Column, ext: Column) -> tuple[Column, Column]:
    """Fields of the first record and whether it is malformed; quoted parts and a BOM are set aside."""
    text = F.decode(content, "ISO-8859-1")
    bare = F.regexp_replace(F.regexp_replace(text, "^ï»¿", ""), '"[^"]*+"', "")
    record = F.substring_index(bare, "\n", 1)
    delimiter = F.when(ext == "tsv", F.lit("\t")).otherwise(F.lit(","))
    fields = F.length(record) - F.length(F.replace(record, delimiter)) + 1
    return fields, record.rlike('(^|[,\\t])"')


def unit_path(path: Column, folder: str) -> Column:
    """What is judged as one: the outermost ``*.parquet`` folder under ``folder`` that holds the Parquet file, else the file itself."""
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*:/+", "/", folder).rstrip("/")
    at = F.instr(path, root)
    start = F.when(at > 0, at + len(root)).otherwise(1)
    table = F.regexp_extract(F.substr(path, start), r"(?is)^(.*?\.parquet)/", 1)
    part = (table != "") & (extension(file_name(path)) == "parquet")
    return F.when(part, F.concat(F.substr(path, F.lit(1), start - 1), table)).otherwise(path)


def _file_key() -> Column:
    """File address as all readers report it, one slash after the scheme."""
    return F.regexp_replace(F.col("_metadata.file_path"), ":/+", ":/")


def _empty_files(spark: SparkSession, files: DataFrame, read: DataFrame) -> DataFrame:
    """Zero-length files: the reader lists them but never opens them, so they have no row.

    Only addresses pass through the driver, where the file listing already lives.
    """
    listing = spark.createDataFrame([(p,) for p in files.inputFiles()], "address string")
    listing = listing.select(F.regexp_replace("address", ":/+", ":/").alias("file"))
    plain = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    return listing.join(read.select("file"), "file", "left_anti").select("file", plain.alias("path"), F.lit(0).cast("bigint").alias("length"))


def longest_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Longest line in bytes per CSV / TSV file, from a splittable text read."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.[cCtT][sS][vV]"
    ).text(folder)
    return lines.groupBy(_file_key().alias("file")).agg(
        F.max(F.octet_length("value")).alias("longest_line")
    )


def parquet_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per Parquet file; no column is read. Broken files are simply absent."""
    files = (
        spark.read.schema("_none int").option("ignoreCorruptFiles", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]").parquet(folder)
    )
    return files.groupBy(_file_key().alias("file")).agg(F.count(F.lit(1)).alias("parquet_rows"))


def _content_facts() -> list[Column]:
    """What the content of a file (columns ``content`` and ``extension``) tells: the first broken rule and the header."""
    fields, malformed = header_columns(F.col("content"), F.col("extension"))
    delimited = F.col("extension").isin("csv", "tsv")
    return [
        _first_failure(content_rules()).alias("late"),
        F.when(delimited, malformed).alias("malformed"),
        F.when(delimited, fields).alias("fields"),
    ]


def row_rule(limits: Limits) -> tuple[Column, int, str]:
    rows = F.coalesce("parquet_rows", F.lit(0))
    return (F.col("extension") == "parquet") & _over(rows, limits.parquet_rows), 413, "too many Parquet rows"


def _verdicts(facts: DataFrame, limits: Limits, first: tuple = ()) -> DataFrame:
    early = _first_failure([*first, *name_rules(limits), mime_rule()])
    last = _first_failure([
        (_over(F.col("longest_line"), limits.line_bytes), 413, "line too long"),
        (F.col("malformed"), 422, "malformed header"),
        (_over(F.col("fields"), limits.columns), 422, "too many columns"),
        row_rule(limits),
    ])
    # A content that no reader could hold in a cell is not vouched for.
    unseen = F.when(F.col("length") > _CELL_BYTES, _verdict(202, "content not checked"))
    verdict = F.coalesce(early, "late", last, unseen)
    return facts.withColumn("verdict", verdict).select(
        "path", "name", "extension", "length",
        F.col("verdict").isNull().alias("accepted"),
        F.coalesce(F.col("verdict.status"), F.lit(200)).alias("status"),
        F.coalesce(F.col("verdict.reason"), F.lit("ok")).alias("reason"),
        "parquet_rows",
    )


def judge(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The verdicts of :func:`audit` on file records that are already a frame (a manifest table, an upload queue).

    ``files`` has ``path``, ``length``, ``content``, ``mime``, ``longest_line`` and ``parquet_rows``; the last three may be NULL. A
    projection only: no row moves.
    """
    named = files.withColumn("name", file_name(F.col("path"))).withColumn("extension", extension(F.col("name")))
    kept = ["path", "name", "extension", "length", "mime", "longest_line", "parquet_rows"]
    return _verdicts(named.select(*kept, *_content_facts()), limits)


def audit(
    spark: SparkSession, folder: str, manifest: DataFrame | None = None, limits: Limits = Limits()
) -> DataFrame:
    """(path, name, extension, length, accepted, status, reason) for every file under ``folder``, and one row for a Parquet table in parts.

    ``manifest`` may give the declared MIME type per file name: (name, mime). A file of over 2 GB that no other rule refuses is not
    accepted: its content was not checked (status 202). A table in parts (a folder named ``*.parquet``) has the rows and bytes of all
    its parts; limits of bytes hold for each part, the limit of rows for the table, and the first refused part (by path) refuses it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    read = files.select(_file_key().alias("file"), "path", "length")
    listed = read.unionByName(_empty_files(spark, files, read)).withColumn("unit", unit_path(F.col("path"), folder))
    listed = listed.withColumn("name", file_name(F.col("unit"))).withColumn("extension", extension(F.col("name")))
    if manifest is not None:
        listed = listed.join(manifest.select("name", "mime"), "name", "left")
    else:
        listed = listed.withColumn("mime", F.lit(None).cast("string"))
    # Oversized files are filtered by the listing itself, before any content is read.
    seen = files.where((F.col("length") > 0) & (F.col("length") <= min(limits.file_bytes or _CELL_BYTES, _CELL_BYTES))).select(
        _file_key().alias("file"), "content", extension(file_name(F.col("path"))).alias("extension")
    )
    counted = listed.join(parquet_rows(spark, folder), "file", "left")
    totals = counted.groupBy("unit").agg(F.sum("parquet_rows").alias("parquet_rows"))
    joined = (
        counted.drop("parquet_rows").join(totals, "unit")
        .join(seen.select("file", *_content_facts()), "file", "left")
        .join(longest_lines(spark, folder), "file", "left")
    )
    # The footers are read anyway, so too many rows is told before the size that goes with them.
    return _of_units(_verdicts(joined, limits, (row_rule(limits),)), folder)


def _of_units(judged: DataFrame, folder: str) -> DataFrame:
    """One row per file or table in parts, of the verdicts on all files."""
    refused = F.min_by(F.struct("status", "reason"), F.when(~F.col("accepted"), F.col("path")))
    found = judged.groupBy(unit_path(F.col("path"), folder).alias("path"), "name", "extension").agg(
        F.sum("length").alias("length"), F.bool_and("accepted").alias("accepted"), refused.alias("refused"), F.max("parquet_rows").alias("parquet_rows"),
    )
    return found.select(
        "path", "name", "extension", "length", "accepted",
        F.coalesce("refused.status", F.lit(200)).alias("status"), F.coalesce("refused.reason", F.lit("ok")).alias("reason"), "parquet_rows",
    )
