"""Web archives with their index: records are written with offset, length, URL and digest, and read back by ranges.

Each record is a gzip member of its own. Tasks write archives under names of their own and give the index rows; the
index is written as a table, and only what it names counts, so a task that is run again does no harm. A reader takes
chosen index rows, sorts them by place, and reads neighbouring records in one go.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.shared import shared_folder, slices, written

#: Payloads of fewer bytes are always written in full.
SMALLEST_SHARED = 1000
ARCHIVE_BYTES = 256 << 20
#: A read is at most this long (unless one record is longer), and skips at most GAP bytes between two records.
READ_BYTES = 8 << 20
GAP = 64 << 10
#: Bytes of archives that a reading task is given, about, and reading tasks at most.
TASK_BYTES, MOST_READERS = 4 << 20, 100_000
LEVEL = 3
#: Time of records whose table has none.
NO_TIME = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, row_id string, url string, payload_digest string, payload_bytes long, record_type string, refers_to string"
_INDEX = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in INDEX.split(", "))])
RECORDS = "row_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
_RECORDS = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in RECORDS.split(", "))])


def _record_id(row_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row_id}:{digest}')}>"


def _record(row_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC record, its end included: a response, or a revisit of the response with the same payload."""
    packed = base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(row_id, digest)),
              ("WARC-Date", NO_TIME), ("WARC-Payload-Digest", f"sha1:{packed}")]
    if url:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if row_id is not None:
        fields.append(("X-Row-ID", row_id))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block = head + payload
    else:
        block = head
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Row-ID", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a record; the payload of a revisit is empty."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def revisits_of(pages: DataFrame, id_col: str, payload: Column) -> DataFrame:
    """(id, digest, refers_to) of rows whose payload another row with a larger id also has.

    Only digests are shuffled, and added up before. Rows that repeat id and payload are all written in full, and so
    are rows without id among themselves.
    """
    narrow = pages.select(F.col(id_col).alias("id"), F.octet_length(payload).alias("bytes"), F.sha1(payload).alias("digest"))
    narrow = written(narrow.where(F.col("bytes") >= SMALLEST_SHARED), "digests")
    groups = narrow.groupBy("digest", "bytes").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    found = narrow.join(written(groups, "shared-payloads").drop("n"), ["digest", "bytes"]).where("id is null or id < refers_to")
    return written(found.select("id", "digest", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives of all rows below ``folder``, and their index, a table that has been written already.

    A null html counts as empty, a null URL gives a record without one. Of rows with equal payloads of at least
    SMALLEST_SHARED bytes that with the largest id is a response, and the others revisit it.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    marked = revisits_of(pages, id_col, payload)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    same = rows["id"].eqNullSafe(marked["id"]) & (rows["digest"] == marked["digest"])
    rows = rows.join(marked, same, "left").select(rows["id"].cast("string").alias("row_id"), "url", "payload", rows["digest"], marked["refers_to"].cast("string"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in slices(batches):
                index = []
                for row_id, url, data, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = _gzip(_record(row_id, url, data, digest, refers_to))
                    out.write(member)
                    index.append((name, offset, len(member), row_id, url, digest, len(data), "response" if refers_to is None else "revisit", refers_to))
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index), _INDEX)], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(archive, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records that ``index`` rows name, digests checked against their contents.

    Rows are sorted by place; a task reads runs of neighbours at once. Payloads of revisits are null here; bytes and
    digest of a revisit are those its header and its response give (see ``resolved``).
    """
    part = F.floor(F.col("offset") / READ_BYTES).alias("part")
    # The index is small beside what it names, so the number of readers follows the bytes to be read.
    total = index.agg(F.sum("length")).first()[0] or 0
    readers = min(max(total // TASK_BYTES, 1), MOST_READERS)
    placed = index.select("file", "offset", "length", part).repartition(readers, "file", "part").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        opened, source = None, None

        def run(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
            nonlocal opened, source
            if rows[0][0] != opened:
                if source is not None:
                    source.close()
                opened, source = rows[0][0], store.open_input_file(f"{root}/{rows[0][0]}")
            start = rows[0][1]
            data = memoryview(source.read_at(rows[-1][1] + rows[-1][2] - start, start))
            found = []
            for _, offset, length in rows:
                fields, payload = _parsed(zlib.decompress(data[offset - start:offset - start + length], 31))
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                response = fields["WARC-Type"] == "response"
                if response and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"a payload differs from its digest in {opened} at {offset}")
                found.append((fields.get("X-Row-ID"), fields["WARC-Type"], len(payload) if response else None, digest,
                              fields.get("X-Refers-To-Row-ID"), payload if keep_payload and response else None))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _RECORDS)], schema=_RECORDS)

        waiting: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if waiting:
                    file, offset, length = waiting[-1]
                    if row[0] != file or row[1] - offset - length > GAP or row[1] + row[2] - waiting[0][1] > READ_BYTES:
                        yield run(waiting)
                        waiting = []
                waiting.append(row)
        if waiting:
            yield run(waiting)

    return placed.mapInArrow(read, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with the payload's bytes of revisits, taken from the responses they refer to."""
    responses = records.where("record_type = 'response'")
    lengths = responses.groupBy(F.col("row_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full"))
    again = records.where("record_type = 'revisit'").join(written(lengths, "payload-lengths"), ["refers_to", "payload_digest"])
    columns = ["row_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    return responses.select(columns).unionByName(again.withColumn("payload_bytes", F.col("full")).select(columns))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All rows written to archives in the shared folder and read back: id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = shared_folder(pages.sparkSession, "archives")
    index = write_archives(pages, folder, id_col, url_col, html_col)
    records = written(read_records(index, folder, keep_payload=False).drop("payload"), "records")
    kind = pages.schema[id_col].dataType
    return resolved(records).select(F.col("row_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
