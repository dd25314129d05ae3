"""WARC archives: pages to monolithic gzip files, and a normaliser that makes every record of such files addressable.

1. ``write_monolithic`` lays pages out as WARC records.  Spark's text writer puts the records of a task behind each other into one
   gzip stream; a record ends in the line separator CR LF CR LF.  No page is shuffled: a payload that occurred before needs a
   table of repeated digests only, broadcast when its counted size is small, joined with its hot digests apart otherwise.
2. ``normalise`` inflates each file once, as a stream of lines in constant memory, cuts it into records by their
   ``Content-Length``, and writes every record as a gzip member of its own into archives of about ``ARCHIVE_BYTES``, each with a
   sidecar that holds offset, length, type and ids of its members.
3. ``read_archives`` walks over the members of the archives and recomputes what payloads say about themselves; ``read_index`` reads
   the sidecars; ``fetch`` inflates only the members that are asked for.

Archives and sidecars leave in the same pass through one text sink, a file per row, so that a lost executor costs a task and not a
file.  The sink ends a file in a separator, a zero byte here; every file therefore closes with an empty gzip member
that lacks its last (zero) byte, and what is on disk is plain gzip.  Files are named ``part-...txt`` by Spark.

Defined results: a null payload is empty, a null url has no ``WARC-Target-URI``; line breaks in a url are percent-encoded; a null
key is written as ``urn:null`` and read back as null, and never starts or makes a revisit; several rows with
the smallest key of a payload are all responses; an empty table gives an archive without pages; a truncated record raises.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import small_batches, written
from tidewell.operators.skew import lookup_join
from tidewell.session import materialise, settings, work_dir

ARCHIVE_BYTES = 16 << 20  # of one archive, before the record that passes it
REVISIT_BYTES = 100  # shorter payloads are always written in full
LOOKUP_BYTES = 32 << 20  # of a broadcast table of repeated digests
CAPTURED = "2024-01-01T00:00:00Z"

# Parts of the format
VERSION = b"WARC/"
BREAK = "\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"
NO_PAGE = "urn:null"


def payload_facts(body: Column) -> tuple[Column, Column]:
    """Bytes and lower-case hex SHA-256 of a payload."""
    text = F.coalesce(body, F.lit(""))
    return F.octet_length(text).cast("bigint"), F.sha2(text.cast("binary"), 256)


def repeated_payloads(pages: DataFrame, key: str = "page_id", body: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``_digest``, ``_first`` (the smallest key) and ``_n`` (rows) of every payload that occurs more than once."""
    size, digest = payload_facts(F.col(body))
    rows = pages.select(F.col(key).alias("_key"), size.alias("_bytes"), digest.alias("_digest")).where(F.col("_bytes") >= least)
    counts = rows.groupBy("_digest").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return counts.where((F.col("_n") > 1) & F.col("_first").isNotNull())


def as_records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", captured: str = CAPTURED,
               least: int = REVISIT_BYTES, lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """One WARC record per page, as ``value``, without the CR LF CR LF behind it."""
    size, digest = payload_facts(F.col(body))
    rows = pages.select(
        F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), F.coalesce(F.col(body), F.lit("")).alias("_body"),
        size.alias("_bytes"), F.when(size >= least, digest).alias("_digest"), digest.alias("_sha"))
    first = materialise(repeated_payloads(pages, key, body, least), "repeated-payloads")
    if first.count() * 128 <= lookup_bytes:
        rows = rows.join(F.broadcast(first.drop("_n")), "_digest", "left")
    else:
        rows = lookup_join(rows, first, ["_digest"], "_n")
    again = F.coalesce(F.col("_key") > F.col("_first"), F.lit(False))

    def name(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit(PAGE), F.url_encode(c.cast("string"))), F.lit(NO_PAGE))

    place = F.regexp_replace(F.regexp_replace(F.trim("_url"), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
                    F.col("_bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("_bytes"))
    head = F.concat_ws(
        BREAK, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <"), name(F.col("_key")), F.lit(">")), F.lit(f"WARC-Date: {captured}"),
        F.concat(F.lit("WARC-Target-URI: "), place), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("_sha")),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}{BREAK}WARC-Refers-To: <"), name(F.col("_first")), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), length.cast("string")))
    return rows.select(F.concat(head, F.lit(END), http, F.when(again, F.lit("")).otherwise(F.col("_body"))).alias("value"))


def write_monolithic(pages: DataFrame, folder: str, **more) -> None:
    """Write pages as WARC files that are one gzip stream each; quickly packed, as they are read once."""
    sink = as_records(pages, **more).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    sink.option("lineSep", END).text(folder)


def parse_head(lines: list[bytes]) -> dict[str, str]:
    """Named fields of a record's head, names in lower case; a folded line goes on with the field before it."""
    out: dict[str, str] = {}
    last = ""
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def cut_records(lines: Iterator[tuple[bytes, int]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Head and whole bytes of each record from (line without its LF, file) pairs; a file's lines come in order."""
    head: list[bytes] | None = None  # lines of the head that is being read
    block: list[bytes] = []
    fields: dict[str, str] = {}
    missing = size = 0
    file = None
    for line, source in lines:
        if source != file:
            if head is not None or missing > 0:
                raise ValueError("a file ends inside a record")
            file = source
        if missing > 0:
            block.append(line + b"\n")
            missing -= len(line) + 1
        elif head is None:
            if line.startswith(VERSION):
                head = [line]
            elif line.strip():
                raise ValueError(f"no record begins with {line[:60]!r}")
            continue
        elif line in (b"", b"\r"):
            fields = parse_head(head[1:])
            size = missing = int(fields["content-length"])
            block = []
        else:
            head.append(line)
            continue
        if missing <= 0:
            yield fields, b"\n".join(head) + b"\n\r\n" + b"".join(block)[:size] + END.encode()
            head, missing, block = None, 0, []
    if head is not None or missing > 0:
        raise ValueError("a file ends inside a record")


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def info_record(name: str) -> bytes:
    body = f"software: tidewell{BREAK}format: WARC File Format 1.1{BREAK}"
    return (f"WARC/1.1{BREAK}WARC-Type: warcinfo{BREAK}WARC-Record-ID: <urn:archive:{name}>{BREAK}WARC-Filename: {name}{BREAK}"
            f"Content-Type: application/warc-fields{BREAK}Content-Length: {len(body)}{END}{body}{END}").encode()


def pack_archives(records: Iterator[tuple[dict[str, str], bytes]], prefix: str, most: int) -> Iterator[tuple[str, bytes]]:
    """(kind, file content without the last byte) pairs: an archive and its sidecar, again and again; one pair at least."""
    closing = member(b"")[:-1]
    count, at, parts, index = 0, 0, [], []

    def begin() -> None:
        nonlocal at, parts, index
        parts, index = [member(info_record(f"{prefix}-{count:05d}"))], []
        at = len(parts[0])

    def close() -> Iterator[tuple[str, bytes]]:
        yield "archive", b"".join(parts) + closing
        yield "index", member("".join(index).encode()) + closing

    begin()
    for fields, data in records:
        packed = member(data)
        index.append(json.dumps({
            "archive": f"{prefix}-{count:05d}", "offset": at, "length": len(packed), "type": fields.get("warc-type"),
            "record": fields.get("warc-record-id"), "digest": fields.get("warc-payload-digest"),
            "uri": fields.get("warc-target-uri")}) + "\n")
        parts.append(packed)
        at += len(packed)
        if at >= most:
            yield from close()
            count += 1
            begin()
    if index or not count:
        yield from close()


def normalise(spark: SparkSession, source: str, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Rewrite the gzip files under ``source`` into ``folder``: a gzip member per record, and offset sidecars."""
    lines = spark.read.option("lineSep", "\n").text(source)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, int]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        task = TaskContext.get()
        for kind, content in pack_archives(cut_records(rows()), f"{task.partitionId():06d}", archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([content], pa.binary())], ["kind", "content"])

    files = lines.mapInArrow(run, "kind string, content binary")
    # both kinds are written as they come: without writers side by side Spark would sort the files by kind first
    with small_batches(spark), settings(spark, spark__sql__maxConcurrentOutputFileWriters="4"):
        sink = files.select(F.col("content").cast("string").alias("value"), "kind").write.partitionBy("kind")
        sink.option("lineSep", "\0").option("maxRecordsPerFile", "1").text(folder)


def members(content: bytes, start: int = 0, piece: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, inflated bytes) of each gzip member that is not empty."""
    view = memoryview(content)
    while start < len(view):
        unpacker, at, out = zlib.decompressobj(31), start, []
        while not unpacker.eof:
            if at >= len(view):
                raise ValueError("an archive ends inside a member")
            out.append(unpacker.decompress(view[at:at + piece]))
            at += len(view[at:at + piece])
        at -= len(unpacker.unused_data)
        data = b"".join(out)
        if data:
            yield start, at - start, data
        start = at


def read_record(data: bytes) -> dict:
    """Type, ids, payload and what it measures of one record; a digest that does not fit its payload raises."""
    head, _, block = data.partition(END.encode())
    fields = parse_head(head.split(b"\n")[1:])
    block = block[:int(fields["content-length"])]
    out = {"type": fields.get("warc-type"), "record": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"),
           "refers_to": fields.get("warc-refers-to"), "filename": fields.get("warc-filename"), "payload": None}
    http, _, payload = block.partition(END.encode())
    said = fields.get("warc-payload-digest", "").partition(":")[2]
    if out["type"] == "response":
        out |= {"payload": payload, "bytes": len(payload), "digest": hashlib.sha256(payload).hexdigest()}
        if said and said != out["digest"]:
            raise ValueError(f"{out['record']}: its payload does not have the digest {said}")
    elif out["type"] == "revisit":
        length = parse_head(http.split(b"\n")[1:]).get("content-length")
        out |= {"bytes": int(length) if length else None, "digest": said}
    return out


FOUND = ("archive string, offset long, length long, record string, type string, refers_to string, uri string, "
         "payload_bytes long, payload_digest string")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives, found by walking over their members; ``warcinfo`` records name their archive only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, name = [], None
                for offset, length, data in members(content.as_buffer()):
                    r = read_record(data)
                    if r["type"] == "warcinfo":
                        name = r["filename"]
                        continue
                    rows.append((name, offset, length, r["record"], r["type"], r["refers_to"], r["uri"], r.get("bytes"), r.get("digest")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = [f.split()[0] for f in FOUND.split(", ")]
    types = [pa.int64() if f.endswith("long") else pa.string() for f in FOUND.split(", ")]
    files = spark.read.format("binaryFile").load(f"{folder}/kind=archive").select("content")
    return written(files.mapInArrow(run, FOUND), "records")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecars: ``archive``, ``offset``, ``length``, ``record``, ``type``, ``digest`` and ``uri`` of every member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                lines = gzip.decompress(content).decode().split("\n")[:-1]
                for start in range(0, len(lines), 5_000):
                    yield pa.RecordBatch.from_arrays([pa.array(lines[start:start + 5_000], pa.string())], ["line"])

    files = spark.read.format("binaryFile").load(f"{folder}/kind=index").select("content")
    fields = "archive string, offset long, length long, record string, type string, digest string, uri string"
    return written(files.mapInArrow(run, "line string").select(F.from_json("line", fields).alias("r")).select("r.*"), "index")


def fetch(spark: SparkSession, folder: str, records: DataFrame) -> DataFrame:
    """``record``, ``type`` and ``payload`` of the records named in column ``record``: only their members are inflated.

    The name of an archive stands in its file's name (task and number), so files are joined with the offsets asked for.
    """
    asked = read_index(spark, folder).join(records.select("record").distinct(), "record", "left_semi")
    asked = asked.groupBy("archive").agg(F.collect_list("offset").alias("offsets"))  # at most the members of one archive
    files = spark.read.format("binaryFile").load(f"{folder}/kind=archive")
    task, number = F.regexp_extract("path", r"part-(\d+)-", 1), F.regexp_extract("path", r"[.-]c(\d+)\.", 1)
    files = files.select("content", F.concat(F.lpad(task, 6, "0"), F.lit("-"), F.lpad(number, 5, "0")).alias("archive"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, offsets in zip(batch.column(0), batch.column(1).to_pylist()):
                body = content.as_buffer()
                found = [read_record(next(members(body, offset))[2]) for offset in sorted(offsets)]
                columns = [pa.array([r[c] for r in found], t) for c, t in (("record", pa.string()), ("type", pa.string()), ("payload", pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["record", "type", "payload"])

    rows = files.join(asked, "archive").select("content", "offsets")
    return written(rows.mapInArrow(run, "record string, type string, payload binary"), "fetched")


def page_key(record: Column, kind: str) -> Column:
    """The key inside a record id; null for ``urn:null``."""
    named = F.when(record.startswith(f"<{PAGE}"), F.url_decode(F.regexp_extract(record, f"^<{PAGE}(.*)>$", 1)))
    return named.try_cast(kind)


def report(pages: DataFrame, key: str = "page_id", folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, **more) -> DataFrame:
    """Write ``pages``, normalise the files, and read archives and sidecars back: a row per page.

    A record counts only where its sidecar gives the place at which the walk over the archive has met it.
    """
    spark, folder = pages.sparkSession, folder or work_dir(pages.sparkSession, "warc")
    write_monolithic(pages, f"{folder}/monolithic", key=key, **more)
    normalise(spark, f"{folder}/monolithic", f"{folder}/records", archive_bytes)
    found = read_archives(spark, f"{folder}/records")
    index = read_index(spark, f"{folder}/records").select("archive", "offset", "length", "record")
    kind = pages.schema[key].dataType.simpleString()
    return found.join(index, ["archive", "offset", "length", "record"]).select(
        page_key(F.col("record"), kind).alias(key), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        page_key(F.col("refers_to"), kind).alias("refers_to"), "archive", "offset", "length")


def oracle() -> str:
    """Without the places in archives."""
    return f"""
        with facts as (
            select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
            from pages),
        firsts as (select *, min(page_id) over (partition by payload_digest) as first_id from facts)
        select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
            case when payload_bytes >= {REVISIT_BYTES} and page_id > first_id then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= {REVISIT_BYTES} and page_id > first_id then first_id end as refers_to
        from firsts"""
