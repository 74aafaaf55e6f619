"""WARC archives: a distributed writer with identical-payload revisits, and a splittable reader.

Every record is one gzip member, so an archive can be entered at any member. The reader deals out byte ranges; a task
scans its range for the gzip magic, accepts a candidate only if its first bytes decode to a WARC header, and owns the
records whose member starts inside the range, reading past the end of the range to finish the last one. The writer sees
to it that no member holds the start of another, even if a payload is an archive, so what a task accepts is a record.
Archives are opened through ``pyarrow.fs`` by URI, so they can lie in any shared store that it reaches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads below this many bytes are stored again rather than revisited.
MIN_REVISIT = 1000
RANGE_BYTES = 8 << 20
#: Tasks that the ranges of a read are dealt over at most.
MAX_TASKS = 20_000
MAGIC = b"\x1f\x8b\x08"
#: Bytes of a header that are decoded at once.
HEAD_STEP = 64 << 10
CHUNK = 256 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) for each page to be written.

    Of the pages with one payload of at least ``MIN_REVISIT`` bytes, the largest page_id is the response.
    A null html is an empty payload; a page without page_id is always a response.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload")}
    )
    stored = (
        rows.where(F.col("payload_bytes") >= MIN_REVISIT)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "response", "n")
    )
    revisits = F.col("response") != F.col("page_id")
    return (
        common.salted_join(rows, common.materialise(stored, "warc-stored"), "payload_digest", "page_id")
        .withColumn("refers_to", F.when(revisits, F.col("response")))
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
        .drop("response")
    )


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _member(data: bytes) -> bytes:
    """``data`` as one gzip member that holds no second member's start that a reader would take for a record.

    Deflate stores what it can't compress, so a payload that is itself an archive could lie in the member as it is. If
    so, the data are flushed inside each magic, which puts bytes between its first and second one.
    """
    for level, cuts in ((5, [0]), (5, _inside(data)), (9, _inside(data)), (1, _inside(data))):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        parts = [packer.compress(data[a:b]) + packer.flush(zlib.Z_FULL_FLUSH) for a, b in zip(cuts, cuts[1:], strict=False)]
        found = b"".join([*parts, packer.compress(data[cuts[-1] :]), packer.flush()])
        if not _holds_record(found):
            return found
    raise ValueError("a record can't be written without the start of another inside")


def _inside(data: bytes) -> list[int]:
    """Zero and the places after the first byte of each magic in ``data``."""
    places, at = [0], data.find(MAGIC)
    while at >= 0:
        places.append(at + 1)
        at = data.find(MAGIC, at + 1)
    return places


def _holds_record(member: bytes) -> bool:
    at = member.find(MAGIC, 1)
    while at >= 0:
        try:
            if zlib.decompressobj(31).decompress(member[at : at + (64 << 10)], 7) == b"WARC/1.":
                return True
        except zlib.error:
            pass
        at = member.find(MAGIC, at + 1)
    return False


def _escaped(url: str | None) -> str:
    """A URL that fits on one header line; ``_unescaped`` gives the original back."""
    if url is None:
        return ""
    return "<" + "".join(f"\\u{ord(c):04x}" if c < " " or c in "\\\x7f\x85  " else c for c in url) + ">"


def _unescaped(value: str) -> str | None:
    if not value:
        return None
    parts = value[1:-1].split("\\u")
    return parts[0] + "".join(chr(int(x[:4], 16)) + x[4:] for x in parts[1:])


def encoded_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One gzip member holding a response, or a revisit without its payload."""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _escaped(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    block = HTTP_OK.format(len(payload)).encode()
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    else:
        block += payload
    fields.append(("Content-Length", str(len(block))))
    return _member(_header(fields) + block + b"\r\n\r\n")


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> int:
    """Write one archive per partition of ``records`` (see ``planned``) below ``path``; return the record count.

    Ids and urls may be null, texts are of any length, records may repeat, and an empty table gives empty archives.

    A task writes under a name of its own attempt and renames it at the end, so a repeated task replaces its archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(common.uri(path))
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}.warc.gz"
        attempt = f"{folder}/_attempt-{task.taskAttemptId()}"
        count = 0
        with store.open_output_stream(attempt, compression=None) as out:
            info = b"software: lodestone\r\n"
            fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{task.partitionId()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]
            out.write(_member(_header(fields) + info + b"\r\n\r\n"))
            for batch in batches:
                names = ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
                columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
                for i in range(batch.num_rows):
                    out.write(encoded_record(*(c[i].as_py() for c in columns), date))
                count += batch.num_rows
        store.move(attempt, name)
        yield pa.RecordBatch.from_pydict({"records": pa.array([count], pa.int64())})

    common.short_batches(records.sparkSession)
    return records.mapInArrow(write, "records long").agg(F.sum("records")).first()[0] or 0


class _Source:
    """Sequential bytes of an open file from ``start`` on, with what was read kept until it is dropped."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.at, self.buffer = file, size, start, b""

    def more(self) -> bool:
        offset = self.at + len(self.buffer)
        if offset >= self.size:
            return False
        self.buffer += self.file.read_at(min(CHUNK, self.size - offset), offset)
        return True

    def skip(self, n: int) -> None:
        self.buffer, self.at = self.buffer[n:], self.at + n


def _head(source: _Source) -> bytes | None:
    """The decoded header of the member at the start of ``source``; None if it isn't a WARC member."""
    unpacker = zlib.decompressobj(31)
    head, fed, piece = bytearray(), 0, b""
    while not unpacker.eof:
        if not piece:
            if fed == len(source.buffer) and not source.more():
                return None
            piece = source.buffer[fed:]
            fed += len(piece)
        had = len(head)
        try:
            head += unpacker.decompress(piece, HEAD_STEP)
        except zlib.error:
            return None
        piece = unpacker.unconsumed_tail
        # what isn't a header shows at once; a header is read on to its end, however long it is
        if not head.startswith(b"WARC/1."[: len(head)]):
            return None
        end = head.find(b"\r\n\r\n", max(0, had - 3))
        if end >= 0:
            return bytes(head[:end])
    return None


def _member_at(source: _Source) -> bytes:
    """Decode the whole member at the start of ``source`` and drop its bytes."""
    unpacker = zlib.decompressobj(31)
    parts = []
    while not unpacker.eof:
        if not source.buffer and not source.more():
            raise EOFError("the archive ends inside a record")
        had = len(source.buffer)
        parts.append(unpacker.decompress(source.buffer))
        source.skip(had - len(unpacker.unused_data))
    return b"".join(parts)


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record whose member starts in [start, end)."""
    source = _Source(file, size, start)
    while True:
        if len(source.buffer) < len(MAGIC) and not source.more() and len(source.buffer) < len(MAGIC):
            return
        found = source.buffer.find(MAGIC)
        if found < 0:  # the magic may lie across the end of what was read
            source.skip(len(source.buffer) - len(MAGIC) + 1)
            if source.at >= end or not source.more():
                return
            continue
        source.skip(found)
        if source.at >= end:
            return
        head = _head(source)
        if head is None:
            source.skip(1)
            continue
        data = _member_at(source)
        fields = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            fields[key.strip().lower()] = value.strip()
        at = len(head) + 4
        yield fields, data[at : at + int(fields["content-length"])]


def _page(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    schema = pa.schema([pa.field(n, t) for n, t in zip(names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)])
    rows: list[tuple] = []
    held = 0

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)}, schema)
        rows.clear()
        return batch

    for batch in batches:
        for task in batch.to_pylist():
            store, name = fs.FileSystem.from_uri(common.uri(task["path"]))
            with store.open_input_file(name) as file:
                for fields, block in records_in(file, task["length"], task["start"], task["end"]):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((_page(fields["warc-record-id"]), _unescaped(fields["warc-target-uri"]), kind, refers, digest, payload))
                    held += len(payload or b"")
                    if held >= 8 << 20 or len(rows) >= 4096:
                        yield flushed()
                        held = 0
    if rows:
        yield flushed()


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Page records of the archives below ``path``: page_id, url, record_type, refers_to, payload_digest, payload.

    A revisit has no payload and names the digest of the one it stands for. Records that aren't of pages are passed
    over; headers and payloads are whole whatever their length. Records that repeat are given as often as they are there.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.where("length > 0").select("path", "length", starts.alias("start")).withColumn("end", F.least(F.col("start") + range_bytes, "length"))
    # the rows are tiny and what they stand for is not: a stated number of tasks isn't coalesced by their size
    tasks = files.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0] or 1
    return ranges.repartition(min(int(tasks), MAX_TASKS), "path", "start").mapInArrow(_read, RECORDS)


def resolved(records: DataFrame, written: int | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row for each of ``records``.

    A revisit gets the figures of the response that it refers to, by page_id and digest: page_ids may repeat with other
    payloads. It is an error if ``written`` is given and the number of records differs, if the bytes of a response
    aren't those of its digest, or if a revisit's response isn't there. No records give no rows.
    """
    sha = F.when(F.col("record_type") == "response", F.sha1("payload"))
    rows = common.materialise(
        records.select("page_id", "record_type", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), "payload_digest", sha.alias("sha")),
        "warc-records",
    )
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = rows.where("record_type = 'response'")
    targets = responses.where("page_id is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    revisits = rows.where("record_type = 'revisit'").drop("payload_bytes").join(targets, ["refers_to", "payload_digest"], "left")
    found = common.materialise(responses.select(*names, "sha").unionByName(revisits.select(*names, F.col("payload_digest").alias("sha"))), "warc-resolved")
    counts = found.agg(F.count(F.lit(1)).alias("read"), F.count_if(F.col("sha") != F.col("payload_digest")).alias("broken"), F.count_if(F.col("payload_bytes").isNull()).alias("lost")).first()
    if written is not None and counts["read"] != written:
        raise ValueError(f"{written} records were written to the archives and {counts['read']} read")
    if counts["broken"] or counts["lost"]:
        raise ValueError(f"{counts['broken']} payloads don't fit their digest and {counts['lost']} revisits have no response")
    return found.select(names)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and give what reading them back yields.

    One row for each page. Handles null, empty and very long html and urls, html that is itself an archive, null ids, and
    an empty table (no rows). Of pages that repeat with one page_id and payload, all are responses if that id is the
    largest of its payload; a page_id may repeat with other payloads. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = common.scratch(spark, "warc")
    written = write_archives(planned(pages.select("page_id", "url", "html")), path)
    if not written:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return resolved(read_archives(spark, path), written)
