"""WARC archives with an index written first and coalesced byte-range reads.

``write_archives`` writes one gzip member per record.  The payload of a
record whose equal payload (of at least ``min_revisit`` bytes) is held by the
row with the largest id becomes a ``revisit`` of that row.  Each writing task
fills its own files, moved into place under a name no other attempt uses, and
returns the index of its records (file, offset, length, URL, digest); only the
index rows of committed tasks count, so a lost executor leaves at most files
that no index row names.  ``read_records`` sorts the selected index rows by
file and offset, merges neighbouring ranges into one read each, and parses the
records found there.

Files go through pyarrow's filesystems, so the folder may be on any of them.

Defined results: a null or empty text is a record with an empty payload; a
null URL has no target header; equal rows with the same largest id are all
responses; an empty table writes no file and gives an empty index; only the
id, URL and payload columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import map_batches, table_path, written
from leadlens.operators.joins import broadcast_if

MIN_REVISIT_BYTES = 1000
# Rows of (digest, id), some 60 bytes each, that may be shipped to every task.
BROADCAST_DIGESTS = 200_000
FILE_BYTES = 256 << 20
# Ranges closer than this are read in one go; a read never exceeds READ_BYTES.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
# compressed bytes that one reading task takes
TASK_BYTES = 64 << 20
INDEX = ("id long, url string, file string, offset long, length long, record_type string, digest string, "
         "refers_to long, payload_bytes long")
RECORD = "id long, url string, record_type string, digest string, refers_to long, payload_bytes long, payload binary"


def _record(id_: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, compressed as its own gzip member."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{id_}/{digest}')}>",
            f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
            "Content-Type: text/html; charset=utf-8", f"X-Payload-Length: {len(payload)}"]
    if id_ is not None:
        head.append(f"X-Row-Id: {id_}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    body = payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}/{digest}')}>",
                 f"X-Refers-To-Row-Id: {refers_to}"]
        body = b""
    head.append(f"Content-Length: {len(body)}")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def _parse(member: bytes) -> tuple[dict[str, str], bytes]:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_revisit: int = MIN_REVISIT_BYTES,
                   date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row under ``folder``; the (written) index of all records."""
    spark = pages.sparkSession
    folder = folder or table_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digest = F.sha1("payload")
    # only digests that occur twice can be revisited; the hot one is combined before the shuffle
    shared = written(rows.filter(F.octet_length("payload") >= min_revisit)
                     .select("id", digest.alias("digest"))
                     .groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
                     .filter("n > 1").select("digest", "keeper"), "warc-shared")
    todo = (rows.withColumn("digest", digest)
            .join(broadcast_if(shared, shared.count(), BROADCAST_DIGESTS), "digest", "left")
            .select("id", "url", "payload", "digest",
                    F.when(F.col("id").eqNullSafe(F.col("keeper")), None).otherwise(F.col("keeper")).alias("refers_to")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        sink, name, part, size, index = None, "", "", 0, []

        def flush():
            nonlocal index
            out, index = index, []
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()),
                ("length", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()),
                ("refers_to", pa.int64()), ("payload_bytes", pa.int64())]))

        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for b in batches:
            for id_, url, body, dig, ref in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    part, size = f"{base}/_writing-{name}", 0
                    system.create_dir(base, recursive=True)
                    sink = system.open_output_stream(part, compression=None)
                member = _record(id_, url, body, dig, ref, date)
                sink.write(member)
                index.append({"id": id_, "url": url, "file": f"{folder}/{name}", "offset": size, "length": len(member),
                              "record_type": "response" if ref is None else "revisit", "digest": dig, "refers_to": ref,
                              "payload_bytes": len(body)})
                size += len(member)
                if size >= FILE_BYTES:
                    sink.close()
                    system.move(part, f"{base}/{name}")
                    sink = None
                    yield flush()
        if sink is not None:
            sink.close()
            system.move(part, f"{base}/{name}")
        yield flush()

    return written(map_batches(todo, write, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """The records that the index rows name, parsed from coalesced byte-range reads."""
    todo = index.select("file", "offset", "length")
    # index rows are small beside their records, so the number of tasks follows the bytes they name
    total = todo.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    todo = todo.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        for b in batches:
            files, offsets, lengths = (c.to_pylist() for c in b.columns)
            i = 0
            while i < len(files):
                j, end = i + 1, offsets[i] + lengths[i]
                while (j < len(files) and files[j] == files[i] and offsets[j] - end <= GAP_BYTES
                       and offsets[j] + lengths[j] - offsets[i] <= READ_BYTES):
                    end = max(end, offsets[j] + lengths[j])
                    j += 1
                uri = files[i]
                system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
                with system.open_input_file(path) as f:
                    block = f.read_at(end - offsets[i], offsets[i])
                out = []
                for k in range(i, j):
                    at = offsets[k] - offsets[i]
                    fields, body = _parse(block[at:at + lengths[k]])
                    revisit = fields["WARC-Type"] == "revisit"
                    stored = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    digest = stored if revisit else hashlib.sha1(body).hexdigest()
                    if digest != stored:
                        raise ValueError(f"{uri}: payload at offset {offsets[k]} does not match its digest")
                    row, ref, url = (fields.get(x) for x in ("X-Row-Id", "X-Refers-To-Row-Id", "WARC-Target-URI"))
                    out.append({"id": int(row) if row else None, "url": url, "record_type": fields["WARC-Type"],
                                "digest": digest, "refers_to": int(ref) if ref else None,
                                "payload_bytes": int(fields["X-Payload-Length"]), "payload": None if revisit else body})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                    ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()),
                    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]))
                i = j

    return map_batches(todo, read, RECORD)
