"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own. Of records with equal payloads of at
least ``LEAST_REVISIT`` bytes, the one with the smallest page id is written as a
response; the others are revisits, which hold the HTTP header alone and name that
response. Members are streamed to one archive per task, under a name of the
attempt that is renamed when it is complete, in the shared folder.

The reader deals byte ranges of the archives to tasks. A task looks for gzip
magic in its range, accepts a place only if the member there inflates to a whole WARC
header with the fields of a record, and owns the records that start inside its range, however far they
reach. Behind a whole member the next one starts at once, so the search is only
needed at the start of a range.

Cases: null html is an empty payload, always a response; a null url is an empty
target; equal payloads without any page id are all responses, and so are rows
that repeat the page id of the response; an empty table gives no archive and no
row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import fresh_path, in_workers, opened

LEAST_REVISIT = 100
SPLIT_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: Bytes that a task reads at once.
READ_BYTES = 1 << 20
#: What is inflated at once of a candidate member to see its header.
PROBE_BYTES = 4096
#: The end of a header, and fields that a record's has.
END, NEEDED = b"\r\n\r\n", ("warc-type", "warc-record-id", "content-length")


def marked(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to) of each page.

    Which pages are revisits is found from ids and digests alone; payloads meet these
    flags by page and digest, so no common page gathers its copies in one place.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    slim = pages.select("page_id", payload.alias("payload")).select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    # Only digests that more than one page has; hot ones are counted before the shuffle.
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null").select("digest", "refers_to")
    later = slim.join(firsts, "digest").where((F.col("page_id") != F.col("refers_to")) | F.col("page_id").isNull())
    flags = later.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "refers_to").distinct()
    out = rows.join(flags, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left")
    return out.select("page_id", "url", "payload", "digest", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response").alias("record_type"), "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A WARC record. The HTTP header keeps the payload's length in revisits too."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    target = "".join(c for c in (url or "") if c not in "\r\n")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": "2020-01-01T00:00:00Z", "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head["Content-Length"] = str(len(block))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member; its time stamp is zero, so equal records give equal bytes."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_warc(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Write ``pages`` (page_id, url, html) as .warc.gz archives in the folder ``path``."""
    store, at = opened(path)
    store.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, count = TaskContext.get(), None, 0
        store, at = opened(path)
        final = f"{at}/part-{context.partitionId():05d}.warc.gz"
        name = f"{at}/.attempt-{context.partitionId():05d}-{context.taskAttemptId()}"
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                if out is None:
                    out = store.open_output_stream(name, compression=None)
                out.write(member(record(*(x.as_py() for x in row))))
                count += 1
        if out is not None:
            out.close()
            store.move(name, final)
        yield pa.RecordBatch.from_pydict({"records": pa.array([count], pa.int64())})

    in_workers(marked(pages, least), run, "records long", "warc").agg(F.sum("records")).collect()


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case names."""
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines}


def parse(data: bytes) -> dict[str, str | bytes]:
    """Header fields (lower-case names) and "block" of an inflated record."""
    head, _, rest = data.partition(END)
    fields: dict = _fields(head)
    fields["block"] = rest[: int(fields["content-length"])]
    return fields


class _Reader:
    """Bytes of one archive from a place on, read as they are needed."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.data = file, start, size, b""

    def upto(self, place: int) -> bool:
        """Read until the bytes before ``place`` are there; False at the archive's end."""
        while self.start + len(self.data) < place:
            self.file.seek(at := self.start + len(self.data))
            if at >= self.size or not (more := self.file.read(READ_BYTES)):
                return False
            self.data += more
        return True

    def forget(self, place: int) -> None:
        self.data, self.start = self.data[place - self.start :], place


def _is_member(reader: _Reader, place: int) -> bool:
    """Whether the member at ``place`` inflates to a whole WARC header with the fields that a record needs."""
    unpack, head, at = zlib.decompressobj(31), b"", place
    while END not in head and not unpack.eof:
        reader.upto(at + PROBE_BYTES)
        data = reader.data[at - reader.start : at - reader.start + PROBE_BYTES]
        if not data:
            return False
        try:
            head += unpack.decompress(data)
        except zlib.error:
            return False
        if head[: len(VERSION)] != VERSION[: len(head)]:
            return False
        at += len(data)
    fields = _fields(head.partition(END)[0])
    return END in head and head.startswith(VERSION) and all(fields.get(f) for f in NEEDED) and fields["content-length"].isdecimal()


def records(file, start: int, end: int, size: int) -> Iterator[tuple[int, dict]]:
    """(place, record) of each record of an archive that starts in [start, end)."""
    reader, place, sure = _Reader(file, start, size), start, False
    while place < end:
        if not sure:
            reader.upto(min(end, place + READ_BYTES) + len(MAGIC))
            found = reader.data.find(MAGIC, place - reader.start)
            if found < 0:
                place = max(place, reader.start + len(reader.data) - len(MAGIC) + 1)
                reader.forget(place)
                if not reader.upto(place + len(MAGIC)):
                    return
                continue
            place = reader.start + found
            if place >= end:
                return
        if not _is_member(reader, place):
            if sure and not reader.upto(place + 1):
                return
            sure, place = False, place + 1
            continue
        unpack, made, at = zlib.decompressobj(31), [], place
        while not unpack.eof:  # a chunk goes when it is inflated, so a record's bytes are copied once
            if not reader.upto(at + 1):
                raise EOFError(f"archive ends inside the record at {place}")
            made.append(unpack.decompress(reader.data[at - reader.start :]))
            at = reader.start + len(reader.data)
            if not unpack.eof:
                reader.forget(at)
        yield place, parse(b"".join(made))
        place = at - len(unpack.unused_data)
        reader.forget(place)
        sure = True


RECORDS = "archive string, place long, record_type string, record_id string, target string, digest string, refers_to_id string, http_length long, payload binary"


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of the archives in the folder ``path``."""
    store, at = opened(path)
    files = [f for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".warc.gz")]
    whole = spark.createDataFrame([(f.path, f.size) for f in files if f.size], "archive string, size long")  # a row for each archive
    lo = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    ranges = sum(-(-f.size // split_bytes) for f in files)
    table = whole.select("archive", lo.alias("lo"), "size").withColumn("hi", F.least(F.col("lo") + split_bytes, "size")).repartition(max(1, ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(path)
        schema = pa.schema([("archive", pa.string()), ("place", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("digest", pa.string()), ("refers_to_id", pa.string()), ("http_length", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for split in batch.to_pylist():
                rows, held = [], 0
                with store.open_input_file(split["archive"]) as file:
                    for place, r in records(file, split["lo"], split["hi"], split["size"]):
                        http, _, payload = r["block"].partition(b"\r\n\r\n")
                        length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                        rows.append((split["archive"], place, r["warc-type"], r["warc-record-id"], r["warc-target-uri"], r.get("warc-payload-digest"), r.get("warc-refers-to"), length, payload))
                        held += len(payload)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return in_workers(table, run, RECORDS, "warc")


def _page(column: str) -> F.Column:
    return F.regexp_extract(column, r"<urn:page:(-?\d*)>", 1)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives below the shared folder and describe each page as read back.

    A response's digest is that of the payload read; a revisit's is the one that
    its record names, as its length is the one in its HTTP header.
    """
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    rows = read_warc(pages.sparkSession, path)
    response = F.col("record_type") == "response"
    number = F.when(_page("record_id") != "", _page("record_id").cast("long"))
    return rows.select(
        number.alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_extract("digest", "^sha256:([0-9a-f]{64})$", 1)).alias("payload_digest"),
        "record_type",
        F.when(~response, _page("refers_to_id").cast("long")).alias("refers_to"),
    )


