"""Readers and writers for delimited, JSON, Markdown and log files.  Everything is read as text."""

from __future__ import annotations

import csv
import io
import re
import statistics
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import packing
from tidewell.operators.cleaning import ROW, text_frame
from tidewell.session import materialise, work_dir

# fixed values: what uploads may be
EXTENSIONS = ["csv", "json"]
DELIMITERS = [",", ";", "\t", "|"]
SNIFF_CHARACTERS = 8192


def file_verdict(name: Column, size: Column, max_bytes: int) -> Column:
    """Why a file is refused, or null.  ``max_bytes`` is the caller's own limit."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return (
        F.when(~extension.isin(EXTENSIONS), "unsupported file type")
        .when(size > max_bytes, "file too large")
        .when(size == 0, "no data rows")
    )


def file_traits(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, breaks) per file.

    The encoding is UTF-8 when every line is valid, else windows-1252, else ISO-8859-1.  ``breaks`` tells whether a quoted
    cell may run over a line break: some line holds an odd number of quotes.  Files are read line by line in parallel; lines
    keep their raw bytes, so any size works.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    # bytes that windows-1252 leaves undefined
    holes = F.hex(F.col("value").cast("binary")).rlike(r"^(?:..)*(?:81|8D|8F|90|9D)")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.groupBy("file").agg(
        F.when(F.bool_and(F.is_valid_utf8("value")), "UTF-8").when(F.bool_or(holes), "ISO-8859-1")
        .otherwise("windows-1252").alias("encoding"),
        F.bool_or(quotes % 2 == 1).alias("breaks"))


def encodings(spark: SparkSession, path: str) -> DataFrame:
    return file_traits(spark, path).drop("breaks")


# the 27 characters that windows-1252 has in place of ISO-8859-1 control characters
_CONTROLS = [i for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", "replace") != "\ufffd"]
LATIN_CONTROLS = "".join(map(chr, _CONTROLS))
LEGACY_SIGNS = bytes(_CONTROLS).decode("cp1252")


def common_encoding(found: DataFrame) -> DataFrame:
    """One encoding that reads all files of a folder: the least strict one that any file needs."""
    order = F.array(F.lit("UTF-8"), F.lit("windows-1252"), F.lit("ISO-8859-1"))
    return found.agg(F.max_by("encoding", F.array_position(order, F.col("encoding"))).alias("encoding"))


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines): the first lines of each file as bytes, up to ``SNIFF_CHARACTERS`` and at least one."""
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0)
    head = lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    few = Window.partitionBy("file").orderBy("at")
    # a line takes a character at least, so no more lines than characters can matter
    head = head.withColumn("n", F.row_number().over(few)).where(F.col("n") <= SNIFF_CHARACTERS)
    head = head.withColumn("seen", F.sum(F.length("value") + 1).over(few))
    head = head.where((F.col("seen") <= SNIFF_CHARACTERS) | (F.col("n") == 1))
    in_order = F.sort_array(F.collect_list(F.struct("n", F.col("value").cast("binary").alias("v"))))
    return head.groupBy("file").agg(F.transform(in_order, lambda x: x["v"]).alias("lines"))


def _delimiter_of():
    """A function from a file's first lines to the mark that cuts them most evenly; a comma when none does.

    Quoted cells are left out, those that run over lines too.
    """
    quoted, marks = re.compile(rb'"(?:[^"]|"")*(?:"|\Z)'), [m.encode() for m in DELIMITERS]

    def find(lines) -> str:
        bare = [x for x in quoted.sub(b"", b"\n".join(lines)).split(b"\n") if x.strip()]
        counts = [(statistics.pstdev(c), -statistics.fmean(c), m) for m in marks if any(c := [x.count(m) for x in bare])]
        return min(counts, key=lambda c: c[:2])[2].decode() if counts else ","

    return find


def delimiters(spark: SparkSession, path: str) -> DataFrame:
    """(file, delimiter) of every file."""
    find = _delimiter_of()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file": batch["file"], "delimiter": batch["lines"].map(find)})

    return _heads(spark, path).mapInPandas(run, "file string, delimiter string")


def file_classes(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> list[Row]:
    """Files that read alike: ``delimiter``, ``encoding``, ``breaks``, ``header`` and the ``files`` that share them.

    Every trait is found per file and in parallel; the driver sees one row per class, in order of its first file.  A
    file without any line has no class.
    """
    each = _heads(spark, path).join(file_traits(spark, path), "file")
    find = _delimiter_of()

    def first_record(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        codecs = {"windows-1252": "cp1252", "UTF-8": "utf-8"}
        for batch in batches:
            marks = [sep or find(lines) for lines in batch["lines"]]
            names = [encoding or e for e in batch["encoding"]]
            headers = []
            for lines, mark, name in zip(batch["lines"], marks, names):
                head = b"\n".join(lines).decode(codecs.get(name, name), "replace").lstrip("\ufeff")
                records = csv.reader(io.StringIO(head, newline=""), delimiter=mark)
                headers.append(next((r for r in records if any(c.strip() for c in r)), None))
            yield batch.assign(delimiter=marks, encoding=names, header=headers)[["file", "delimiter", "encoding", "breaks", "header"]]

    rows = each.mapInPandas(first_record, "file string, delimiter string, encoding string, breaks boolean, header array<string>")
    classes = rows.where("header is not null").groupBy("delimiter", "encoding", "breaks", "header").agg(
        F.sort_array(F.collect_list("file")).alias("files"))
    return sorted(classes.collect(), key=lambda c: c["files"][0])


def _tagged(df: DataFrame) -> DataFrame:
    """Add file, split and a number that rises within the split."""
    return df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"))


def _numbered(tagged: DataFrame) -> DataFrame:
    splits = tagged.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = tagged.join(offsets, ["_file", "_start"])
    return joined.withColumn(ROW, F.col("_offset") + F.col("_id") - F.col("_first")).drop(
        "_file", "_start", "_id", "_first", "_offset")


def with_row_numbers(df: DataFrame) -> DataFrame:
    """Add the 0-based position of each row over all files in path order, without a global sort.

    Rows of one file split are consecutive in one task, so a table with one line per split gives every split its offset;
    the window without a key runs over that table only.
    """
    return _numbered(_tagged(df))


def _literal_path(file: str) -> str:
    """The path of a file from its URI, its signs safe from being read as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def _class_rows(spark: SparkSession, found: Row) -> DataFrame:
    """Tagged rows of one class of files, under the names of its header."""
    legacy = found["encoding"] == "windows-1252"
    base = spark.read.option("sep", found["delimiter"]).option("encoding", "ISO-8859-1" if legacy else found["encoding"]).option(
        "quote", '"').option("escape", '"').option("multiLine", bool(found["breaks"])).option("header", "true").option(
        "enforceSchema", "true").schema(", ".join(f"c{i} string" for i in range(len(found["header"]))))
    rows = _tagged(base.csv([_literal_path(f) for f in found["files"]]))
    cell = lambda i: F.translate(F.col(f"c{i}"), LATIN_CONTROLS, LEGACY_SIGNS) if legacy else F.col(f"c{i}")
    return rows.select("_file", "_start", "_id", *[cell(i).alias(n) for i, n in enumerate(unique_names(found["header"]))])


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """Text frame of a folder of delimited files; delimiter and encoding are found per file when not given.

    Files that share delimiter, encoding, quoted breaks and header are one scan, whatever their number; the scans are united by
    column name, in the order in which names first occur, and a column that a file lacks is null in its rows.  Rows are numbered over
    all files in path order.  Files are split over tasks unless a quoted cell runs over a line break; then each file is read by one task.
    """
    classes = file_classes(spark, path, sep, encoding)
    if not classes:
        raise ValueError("No data rows found in this file.")
    names = list(dict.fromkeys(n for c in classes for n in unique_names(c["header"])))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_class_rows(spark, c) for c in classes])
    return _numbered(rows).select(ROW, *[F.col(f"`{n}`") for n in names])


def unique_names(names: list[str]) -> list[str]:
    """Trimmed names; a repeated one gets .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in (x.strip() for x in names):
        k = seen[n] = seen.get(n, 0) + 1
        out.append(n if k == 1 else f"{n}.{k - 1}")
    return out


def read_json_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Text frame of JSON records; numbers keep their spelling.  One record per line splits best: ``multi_line=False``."""
    df = spark.read.option("multiLine", multi_line).option("primitivesAsString", True).json(path)
    return with_row_numbers(df)


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``record`` (0, 1, ...) and ``value`` (its text) of the objects in files that hold one JSON array each.

    A file of any size is read by many tasks: Spark cuts it at closing braces.  Whether such a piece begins inside a string depends
    on the quotes before it, and whether its brace ends a record on the brackets before it: both are sums over the pieces, added
    up inside every split and then over the splits.  The array's own bracket is depth one.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value")
    bare = F.regexp_replace("value", r"\\.", "")  # without escaped signs
    marks = F.regexp_replace(bare, r'[^"\[\]{}]', "")
    # outside and inside of strings take turns at every quote; the two sums are for either way to begin
    turns = F.split(marks, '"', -1)
    depth = lambda c: F.regexp_count(c, F.lit(r"[\[{]")) - F.regexp_count(c, F.lit(r"[\]}]"))
    total = lambda odd: F.aggregate(F.filter(turns, lambda x, i: i % 2 == odd), F.lit(0), lambda a, x: a + depth(x))
    pieces = pieces.select("file", "split", "at", "value", (F.size(turns) - 1).alias("quotes"), total(0).alias("even"), total(1).alias("odd"))
    pieces = materialise(pieces, "array-pieces")

    inner = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)

    def running(df: DataFrame, column: str, name: str) -> DataFrame:
        """Sum of a column up to and with each piece of the file; one row per split carries it over the splits."""
        sums = df.groupBy("file", "split").agg(F.sum(column).alias("_sum"))
        sums = sums.select("file", "split", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
        return df.withColumn(name, F.sum(column).over(inner)).join(sums, ["file", "split"]).withColumn(
            name, F.col(name) + F.col("_before")).drop("_before")

    pieces = running(pieces, "quotes", "seen")
    begins_inside = (F.col("seen") - F.col("quotes")) % 2 == 1
    outside_end = F.col("seen") % 2 == 0
    step = F.when(begins_inside, F.col("odd")).otherwise(F.col("even")) - outside_end.cast("int")
    pieces = running(pieces.withColumn("step", step), "step", "depth")
    pieces = pieces.withColumn("ends", (outside_end & (F.col("depth") == 1)).cast("int"))
    pieces = running(pieces, "ends", "done").withColumn("record", F.col("done") - F.col("ends"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "at", "value"))), lambda x: x["value"]), "}")
    records = pieces.groupBy("file", "record").agg(whole.alias("value"), F.max("ends").alias("ends")).where("ends = 1")
    return records.select("file", "record", F.concat(F.regexp_replace("value", r"^[\s\[,\ufeff]+", ""), F.lit("}")).alias("value"))


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Text frame of files with one JSON array of records each, every file read by many tasks; columns are found when not given."""
    records = materialise(array_records(spark, path), "array-records")
    if schema is None:
        lines = work_dir(spark, "array-lines")  # a line break can only stand between the parts of a record
        records.select(F.translate("value", "\r\n", "  ").alias("value")).write.text(lines)
        schema = spark.read.option("primitivesAsString", True).json(lines).schema
    sizes = records.groupBy("file").agg(F.max("record").alias("n"))
    sizes = sizes.select("file", F.coalesce(F.sum(F.col("n") + 1).over(
        Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))  # a row per file
    rows = records.join(sizes, "file").select((F.col("record") + F.col("_offset")).alias(ROW), F.from_json("value", schema).alias("r"))
    return rows.select(ROW, "r.*")


def read_json_columns(spark: SparkSession, path: str) -> DataFrame:
    """Text frame of column-oriented JSON: {column: {row: value}}."""
    whole = spark.read.text(path, wholetext=True)
    cells = whole.select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("c", "v")).select(
        "c", F.explode("v").alias("r", "cell"))
    names = [r[0] for r in cells.select("c").distinct().orderBy("c").collect()]
    wide = cells.groupBy(F.col("r").cast("bigint").alias(ROW)).pivot("c", names).agg(F.first("cell"))
    return wide


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by extension; an empty table is an error."""
    extension = path.rsplit(".", 1)[-1].lower()
    if extension == "csv":
        df = read_delimited(spark, path)
    elif extension == "json":
        df = read_json_records(spark, path)
    else:
        raise ValueError(f"Unsupported file type: .{extension}")
    if df.isEmpty():
        raise ValueError("No data rows found in this file.")
    return text_frame(df)


def read_knowledge_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("title string, text string").option("multiLine", True).json(path)


def read_markdown(spark: SparkSession, folder: str, size: int = 800, overlap: int = 100, pattern: str = "*.md") -> DataFrame:
    """Chunks of all Markdown files below a folder: title, text, path.

    The title is the first top heading of the chunk, else the file name with spaces for hyphens; front matter and top
    headings leave the text; empty chunks go.
    """
    whole = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return markdown_chunks(whole, size, overlap)


def markdown_chunks(whole: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """The same for a frame with one file per row (``value``)."""
    parts = whole.select(
        F.col("_metadata.file_path").alias("path"),
        F.posexplode(packing.overlapping_chunks(F.col("value"), size, overlap)).alias("pos", "part"))
    heading = text.trim_all(F.regexp_extract("part", r"(?m)^#\s+(.+)$", 1))
    name = F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1))
    stem = F.replace(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("-"), F.lit(" "))
    body = text.trim_all(F.regexp_replace(text.strip_front_matter(F.col("part")), r"(?m)^#\s+.+$", ""))
    chunks = parts.select(
        "path", "pos", F.when(F.col("part").rlike(r"(?m)^#\s+(.+)$"), heading).otherwise(stem).alias("title"),
        body.alias("text"))
    return chunks.where(F.col("text") != "")


def write_delimited(df: DataFrame, path: str, decimals: dict[str, int] | None = None, header: bool = True) -> None:
    """Write a table as CSV; decimal columns get a fixed number of places, missing cells stay empty."""
    decimals = decimals or {}
    out = [
        F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals[c]}f", F.col(c))).alias(c) if c in decimals else F.col(c)
        for c in df.columns
    ]
    df.select(*out).write.option("header", header).option("emptyValue", "").option("nullValue", "").option(
        "escape", '"').csv(path)


def append_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Append rows to a parquet log, one folder per value of ``partition``."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
