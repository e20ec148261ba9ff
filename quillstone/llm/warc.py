"""WARC archives as a chunked record table: payloads travel as (record, chunk number) rows with incremental digests.

Neither writing nor reading holds a whole payload in Python: rows are chunks of at most CHUNK bytes, compressed and
decompressed as they pass. Archives are gzip members, one for each record (WARC/1.1).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

CHUNK = 256 * 1024
#: Payloads below this size are not deduplicated.
REVISIT_FROM = 1000
#: A writer begins another archive beyond this many bytes.
ARCHIVE = 256 * 1024 * 1024
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def plan_records(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """id, url, payload, size, digest, target: target is the largest id of equal payloads (size >= revisit_from), else null.

    A null html is an empty payload. Repeated rows of the largest id are all responses.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    shared = rows.where(F.col("size") >= revisit_from).groupBy("digest").agg(F.max("id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(shared, "digest", "left").select("id", "url", "payload", "size", "digest", F.when(F.col("size") >= revisit_from, F.col("target")).alias("target"))


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table: record columns, chunk_no, is_last, data. A revisit is one chunk without data; so is an empty payload."""
    revisit = F.col("target").isNotNull() & (F.col("target") != F.coalesce("id", F.lit(-(2**63))))
    chunks = F.when(revisit | (F.col("size") == 0), 1).otherwise(F.ceil(F.col("size") / chunk))
    return records.withColumn("is_revisit", revisit).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int")))).select(
        "id", "url", "size", "digest", "target", "is_revisit", "chunk_no", (F.col("chunk_no") == chunks - 1).alias("is_last"),
        F.when(F.col("is_revisit"), F.lit(b"")).otherwise(F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})")).alias("data"),
    )


def _head(row: dict) -> bytes:
    size = 0 if row["is_revisit"] else row["size"]
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if row['is_revisit'] else 'response'}", f"WARC-Record-ID: <urn:page:{'' if row['id'] is None else row['id']}>", f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{row['digest']}", f"WARC-Payload-Length: {row['size']}", f"Content-Length: {len(HTTP) + size}",
    ]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in row["url"]))
    if row["is_revisit"]:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{row['target']}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + HTTP


FILES = pa.schema([("name", pa.string()), ("n_records", pa.int64())])


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes the chunk table's records to archives in ``folder``; the archives that count: name, n_records.

    The chunks of a record stand together and in order, as chunk_rows makes them. The digest is carried over the chunks
    and must equal the record's. A task that runs again writes under other names, and only names returned count.
    """

    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        done, stream, name, n, member, digest = [], None, "", 0, None, None
        for batch in batches:
            heads = batch.drop_columns(["data"]).to_pylist()
            for row, data in zip(heads, batch.column("data"), strict=True):
                data = data.as_buffer()
                if row["chunk_no"] == 0:
                    if stream is not None and stream.tell() >= ARCHIVE:
                        stream.close()
                        done.append((name, n))
                        stream = None
                    if stream is None:
                        name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                        stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member, digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    stream.write(member.compress(_head(row)))
                digest.update(data)
                stream.write(member.compress(data))
                if row["is_last"]:
                    if not row["is_revisit"] and digest.hexdigest() != row["digest"]:
                        raise ValueError(f"record {row['id']}: its chunks do not make its digest")
                    stream.write(member.compress(b"\r\n\r\n") + member.flush())
                    n += 1
        if stream is not None:
            stream.close()
            done.append((name, n))
        yield pa.RecordBatch.from_pydict({"name": [x for x, _ in done], "n_records": [x for _, x in done]}, schema=FILES)

    return stored(chunks.mapInArrow(run, "name string, n_records long"), "warc-files")


class _Bytes:
    """The decompressed bytes of an archive, read by need."""

    def __init__(self, stream):
        self.stream, self.member, self.held, self.ended = stream, zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        while True:
            rest = self.member.unconsumed_tail or self.member.unused_data
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            if not rest:
                rest = self.stream.read(CHUNK)
                if not rest:
                    return False
            got = self.member.decompress(rest, CHUNK)
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                return None
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def some(self, most: int) -> bytes:
        if not self.held and not self._more():
            raise ValueError("an archive ends within a record")
        out, self.held = self.held[:most], self.held[most:]
        return out


def records_of(stream):
    """(headers, chunk number, is_last, data, bytes so far, SHA-1 so far) of an archive's records, as chunks of at most CHUNK bytes."""
    source = _Bytes(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}
        left = int(headers["content-length"]) - len(source.until(b"\r\n\r\n"))  # the HTTP head is not payload
        digest, size, number = hashlib.sha1(), 0, 0
        while True:
            data = source.some(min(left, CHUNK)) if left else b""
            left -= len(data)
            digest.update(data)
            size += len(data)
            yield headers, number, not left, data, size, digest.hexdigest()
            number += 1
            if not left:
                break
        if source.until(b"\r\n\r\n") != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")


COLUMNS = "page_id long, url string, record_type string, refers_to long, chunk_no int, is_last boolean, payload_bytes long, payload_digest string"


def read_archives(files: DataFrame, folder: str, with_data: bool = False) -> DataFrame:
    """The chunk table of the archives: page_id, url, record_type, refers_to, chunk_no, is_last, payload_bytes, payload_digest (and data).

    payload_bytes and payload_digest run over the chunks so far; those of a revisit are its header's, which name the full payload.
    """
    fields = [(x.split()[0], {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]]) for x in COLUMNS.split(", ")]
    kind = pa.schema(fields + [("data", pa.binary())] * with_data)
    number = lambda x: int(y) if x and (y := x.rpartition(":")[2].rstrip(">")) else None

    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for h, no, last, data, size, digest in records_of(stream):
                        revisit = h["warc-type"] == "revisit"
                        if revisit:
                            size, digest = int(h["warc-payload-length"]), h["warc-payload-digest"].partition(":")[2]
                        rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], number(h.get("warc-refers-to")), no, last, size, digest, *([data] if with_data else [])))
                        held += len(data) if with_data else 200
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    many = max(1, files.count())  # a row for each archive
    return files.repartition(many, "name").mapInArrow(run, COLUMNS + (", data binary" if with_data else ""))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else "file://" + folder
    files = write_archives(chunk_rows(plan_records(table(spark, sf_dir, "pages"))), folder)
    ends = read_archives(files, folder).where("is_last")
    return ends.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT payload_digest, max(page_id) AS target FROM p WHERE payload_bytes >= {REVISIT_FROM} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN target <> page_id THEN target END AS refers_to
FROM p LEFT JOIN t USING (payload_digest)
"""
