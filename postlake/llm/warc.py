"""WARC archives through a chunked record table.

A record is not one value but rows of (record_id, chunk, body): payloads are cut into chunks of
``CHUNK`` bytes, shuffled and sorted as such, and each task streams its records into one compressed
archive in the shared folder, a gzip member for each record. Reading streams an archive the other
way, with a running SHA-1 that every chunk row carries, so neither side holds a whole record. The
list of archives is a table that Spark commits; files of lost attempts are in no list.

Of records with equal payloads of ``LEAST`` bytes or more, the one with the largest page_id is a
response and the others revisit it: they have no payload of their own, but its digest and its record's
id. Equal payloads have equal SHA-1 and length.

Cases: NULL html is an empty payload; records with a NULL page_id revisit one that has one, and are
responses if none of the equal ones has; rows that repeat the largest page_id are all responses; a
NULL url is not written; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import bounded
from postlake.session import cut, scratch_path

CHUNK = 1 << 18
LEAST = 1000
ARCHIVE_BYTES = 64 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, n_bytes, digest, record_id, revisits) for every page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("n_bytes"), F.sha1(payload).alias("digest")
    )
    kept = (
        base.where((F.col("n_bytes") >= least) & F.col("page_id").isNotNull())
        .groupBy(F.col("digest").alias("of_digest"))
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"), F.max("n_bytes").alias("of_bytes"))
    )
    kept = bounded(_repeated(base, kept, least).select("of_digest", "of_bytes", "kept"))
    joined = base.join(kept, (F.col("digest") == F.col("of_digest")) & (F.col("n_bytes") == F.col("of_bytes")), "left")
    name = lambda page: F.md5(F.concat_ws("|", page.cast("string"), F.col("digest")))
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select(
        "page_id", "url", "payload", "n_bytes", "digest", name(F.col("page_id")).alias("record_id"), F.when(revisit, name(F.col("kept"))).alias("revisits")
    )


def _repeated(base: DataFrame, kept: DataFrame, least: int) -> DataFrame:
    """Of the payloads those that more than one row has."""
    counts = base.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.count("*").alias("rows")).where("rows > 1")
    return kept.join(counts, F.col("of_digest") == F.col("digest"))


def chunked(found: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunked record table: (record_id, row, chunk, body), with the header's fields in chunk 0."""
    body = F.when(F.col("revisits").isNull(), F.col("payload")).otherwise(F.lit(b""))
    n = F.ceil(F.octet_length(body) / size)
    rows = found.select("*", F.monotonically_increasing_id().alias("row"), F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))).alias("chunk"))
    first = lambda c: F.when(F.col("chunk") == 0, F.col(c)).alias(c)
    part = F.substring(F.when(F.col("revisits").isNull(), F.col("payload")).otherwise(F.lit(b"")), F.col("chunk") * size + 1, F.lit(size))
    return rows.select("record_id", "row", "chunk", part.alias("body"), *[first(c) for c in ("page_id", "url", "n_bytes", "digest", "revisits")])


def _header(record_id, page_id, url, n_bytes, digest, revisits) -> bytes:
    fields = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(record_id)}>"), ("WARC-Date", _DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisits:
        fields += [("WARC-Refers-To", f"<urn:uuid:{uuid.UUID(revisits)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    length = len(_HTTP) + (0 if revisits else n_bytes)
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(length))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + _HTTP


def _open(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url.replace("s3a://", "s3://", 1))


def write_archives(found: DataFrame, folder: str, archives: int) -> DataFrame:
    """Write records into archives below ``folder``; (path, n_records, n_bytes) of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        path, out, packer, n = f"{uuid.uuid4().hex}.warc.gz", None, None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{path}", compression=None)
                if r["chunk"] == 0:
                    if packer:
                        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    packer, n = zlib.compressobj(6, zlib.DEFLATED, 31), n + 1
                    out.write(packer.compress(_header(*[r[k] for k in ("record_id", "page_id", "url", "n_bytes", "digest", "revisits")])))
                out.write(packer.compress(r["body"]))
        if out is not None:
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([n]), pa.array([size])], names=["path", "n_records", "n_bytes"])

    rows = chunked(found).repartition(archives, "record_id").sortWithinPartitions("record_id", "row", "chunk")
    return rows.mapInArrow(run, "path string, n_records long, n_bytes long")


class _Stream:
    """Bytes of a file of gzip members, a piece at a time."""

    def __init__(self, file, piece: int = 1 << 16):
        self.file, self.piece = file, piece
        self.unpacker = zlib.decompressobj(31)
        self.buffer, self.raw = b"", b""

    def _more(self) -> bool:
        while True:
            if self.unpacker.eof:
                self.raw = self.unpacker.unused_data
                self.unpacker = zlib.decompressobj(31)
            else:
                self.raw = self.unpacker.unconsumed_tail
            self.raw = self.raw or self.file.read(self.piece)
            if not self.raw:
                return False
            if got := self.unpacker.decompress(self.raw, self.piece):
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes:
        """Up to and with ``mark``; what is left at the end of the file."""
        while (at := self.buffer.find(mark)) < 0 and self._more():
            pass
        at = len(self.buffer) if at < 0 else at + len(mark)
        out, self.buffer = self.buffer[:at], self.buffer[at:]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out


_ROW = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to_record", pa.string()), ("stated_digest", pa.string())]
    + [("chunk", pa.int32()), ("last", pa.bool_()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("body", pa.binary())]
)
CHUNK_ROW = "record_id string, page_id long, url string, record_type string, refers_to_record string, stated_digest string, chunk int, last boolean, n_bytes long, digest string, body binary"


def chunks_of(file, size: int = CHUNK, bodies: bool = True) -> Iterator[dict]:
    """The chunk rows of one archive, in order; ``digest`` and ``n_bytes`` run up to the chunk's end."""
    stream = _Stream(file)
    while head := stream.until(b"\r\n\r\n"):
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:80]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:] if x)
        uid = lambda k: uuid.UUID(fields[k].removeprefix("<urn:uuid:").removesuffix(">")).hex if k in fields else None
        row = {
            "record_id": uid("WARC-Record-ID"),
            "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
            "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"],
            "refers_to_record": uid("WARC-Refers-To"),
            "stated_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        }
        left = int(fields["Content-Length"]) - len(stream.until(b"\r\n\r\n"))
        running, done, chunk = hashlib.sha1(), 0, 0
        while True:
            body = stream.take(min(size, left))
            if len(body) < min(size, left):
                raise ValueError(f"record {row['record_id']} is cut short")
            running.update(body)
            done, left = done + len(body), left - len(body)
            yield row | {"chunk": chunk, "last": left == 0, "n_bytes": done, "digest": running.copy().hexdigest(), "body": body if bodies else None}
            chunk += 1
            if left == 0:
                break
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {row['record_id']} does not end where its length says")


def read_archives(archives: DataFrame, bodies: bool = True, size: int = CHUNK) -> DataFrame:
    """The chunk rows of all archives of a (path, ...) table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = _open(path)
                with files.open_input_stream(name, compression=None) as file:
                    held, weight = [], 0
                    for row in chunks_of(file, size, bodies):
                        held.append(row)
                        weight += len(row["body"] or b"") + 300
                        if weight > 1 << 22:
                            yield pa.RecordBatch.from_pylist(held, schema=_ROW)
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=_ROW)

    # a task for each archive: the list is small, and small partitions would be joined together
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(run, CHUNK_ROW)


def record_rows(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the last chunks of records.

    A revisit's payload is that of the response it names, whose digest it must have stated.
    """
    ends = cut(chunks.where("last").drop("body", "chunk", "last"), "records")
    answers = ends.where("record_type = 'response'").groupBy("record_id").agg(
        F.max("page_id").alias("of_page"), F.max("n_bytes").alias("of_bytes"), F.max("digest").alias("of_digest")
    )
    answers = answers.withColumnRenamed("record_id", "of_record")
    own = ends.where("record_type = 'response'").select(
        "page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    again = ends.where("record_type != 'response'").join(answers, F.col("refers_to_record") == F.col("of_record"), "left")
    sound = F.assert_true(F.col("of_digest").eqNullSafe(F.col("stated_digest")), F.lit("a revisit states another digest than its response"))
    again = again.select(
        "page_id", F.col("of_bytes").alias("payload_bytes"), F.coalesce(sound.cast("string"), "of_digest").alias("payload_digest"), "record_type", F.col("of_page").alias("refers_to")
    )
    return own.union(again)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page as a record, read the archives back, and return `record_rows`."""
    found = records(pages)
    total = pages.agg(F.sum(F.octet_length("html"))).collect()[0][0] or 0
    folder = folder or scratch_path(pages.sparkSession, "warc")
    archives = cut(write_archives(found, folder, max(1, -(-total // ARCHIVE_BYTES), pages.sparkSession.sparkContext.defaultParallelism)), "archives")
    return record_rows(read_archives(archives, bodies=False))
