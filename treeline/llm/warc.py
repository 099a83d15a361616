"""Operator 3: WARC archives, index first.

Each page becomes one record. Of pages with equal payloads the one with the
least id is stored as ``response``, the others as ``revisit`` of it. Every task
writes its records, each a gzip member of its own, to one archive in the folder
that all executors share, and returns an index row per record: archive, offset,
length, URL, digest. The index is written down before anything is read. Reading
sorts the selected index rows by archive and offset and joins ranges that lie
close together into one read each; records are parsed, and their payloads'
digests are checked against the index.

An archive's name holds the task's attempt, so a repeated or lost attempt leaves
an archive that no index row names. Which page is a response is found from
digests alone. Digests that occur more than once are counted; up to
``SHARED`` of them are broadcast, so that no page is shuffled, and more meet the
pages in one equi-join that can be split. A payload that a third of all pages
share is no hot spot in either.

Archives are the result of :func:`write`: who names the folder owns it.
:func:`archive_and_read` makes one of its own below the shared folder where none
is given; ``common.remove`` deletes it when its rows have been used.

Defined cases: a null html is the empty payload; a null url is written as an
empty target; payloads are equal if SHA-256 and size are; of rows with equal
payload and equal least id (repeated rows) all are responses; a null id is
written, and is a response unless an equal payload has an id.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes between two selected records that are read rather than skipped, and the most that one read takes,
#: unless a single record is longer.
GAP, SPAN = 1 << 16, 1 << 22
#: Repeated payloads that are broadcast, about 60 bytes each.
SHARED = 500_000
#: Bytes of an archive that one reading task takes.
STRETCH = 1 << 23
#: A fixed date, so that the same pages make the same archives.
DATE = "2000-01-01T00:00:00Z"

INDEX = "page_id long, archive string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
INDEX_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def header_value(text: str | None) -> str:
    """A header's value: line ends would end it, so they are written as blanks."""
    return (text or "").replace("\r", " ").replace("\n", " ")


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A WARC/1.1 record and its payload's digest. A revisit's block holds the HTTP header alone."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", digest


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (keys in lower case) and the block's body."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    warc = fields(head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(warc["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode("latin-1").split("\r\n")[1:]), body


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def mark_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, refers_to``: the least id of equal payloads, null where the row is a response itself."""
    rows = common.pick(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))).withColumn("size", F.octet_length(F.coalesce("html", F.lit(""))))
    # Only payloads that occur twice need to be met again.
    shared = rows.groupBy("sha", "size").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 and least is not null").select("sha", "size", "least")
    own = F.col("least") == F.col("page_id")
    shared = common.settle(shared)
    if shared.count() <= SHARED:
        shared = F.broadcast(shared)
    return rows.join(shared, ["sha", "size"], "left").select("page_id", "url", "html", F.when(~F.coalesce(own, F.lit(False)), F.col("least")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives below ``folder`` (a URI that all executors reach) and return the index, one row per record.

    The returned index has been written down (a checkpoint): reading it doesn't write again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        stream, at = None, 0
        for batch in batches:
            out = []
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    stream = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                record, digest = make_record(page, url, payload, refers)
                packed = gzip_member(record)
                stream.write(packed)
                out.append((page, name, at, len(packed), url, digest, len(payload), "response" if refers is None else "revisit", refers))
                at += len(packed)
            if out:
                yield common.record(INDEX_SCHEMA, *map(list, zip(*out, strict=True)))
        if stream is not None:
            stream.close()

    common.session(pages.sparkSession)
    return common.settle(mark_revisits(pages).mapInArrow(run, INDEX))


def read(selected: DataFrame, folder: str) -> DataFrame:
    """The records of index rows: ``page_id, url, payload binary (null for revisits), payload_bytes, payload_digest, record_type, refers_to``.

    ``payload_bytes`` and the digest are those of the full payload, as read: of a
    response from the payload itself, of a revisit from its headers. A record
    that differs from its index row raises an error.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    ddl = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            rows = [dict(zip(batch.schema.names, r, strict=True)) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            for run_ in ranges(rows):
                if run_[0]["archive"] != name:
                    if source is not None:
                        source.close()
                    name = run_[0]["archive"]
                    source = store.open_input_file(f"{root}/{name}")
                begin, end = run_[0]["offset"], max(r["offset"] + r["length"] for r in run_)
                data = memoryview(source.read_at(end - begin, begin))
                out = []
                for r in run_:
                    at = r["offset"] - begin
                    warc, http, body = parse_record(zlib.decompress(data[at : at + r["length"]], 31))
                    kind, said = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                    digest = sha1_base32(body) if kind == "response" else said
                    size = len(body) if kind == "response" else int(http["content-length"])
                    if (digest, said, kind) != (r["payload_digest"], r["payload_digest"], r["record_type"]):
                        raise ValueError(f"record at {name}:{r['offset']} differs from its index row")
                    out.append((r["page_id"], r["url"], body if kind == "response" else None, size, digest, kind, r["refers_to"]))
                yield common.record(schema, *map(list, zip(*out, strict=True)))
        if source is not None:
            source.close()

    stretch = F.floor(F.col("offset") / STRETCH)
    dealt = selected.withColumn("stretch", stretch).repartition("archive", "stretch").sortWithinPartitions("archive", "offset").drop("stretch")
    common.session(selected.sparkSession)
    return dealt.mapInArrow(run, ddl)


def ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Sorted index rows in runs of one archive that one read takes."""
    run: list[dict] = []
    for r in rows:
        if run and (r["archive"] != run[0]["archive"] or r["offset"] - run[-1]["offset"] - run[-1]["length"] > GAP or r["offset"] + r["length"] - run[0]["offset"] > SPAN):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, then read all records back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    folder = folder or common.scratch(pages.sparkSession, "warc")
    index = write(pages, folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
