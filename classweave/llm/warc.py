"""WARC archives: writing, and turning whole-file gzip into one member a record.

``write_archives`` writes each task's records as one gzip stream, the way many
crawls are delivered. ``normalise`` inflates such a stream once, rewrites every
record as a gzip member of its own and writes a sidecar index with the place of
each member. ``read_archives`` fetches records through the index.

Archives of other writers are read too: header names in any case, records of any
type, gzip cut into members at any place. A stream that ends inside a member or a
record is an error, also where its last record is whole.

Archives live in the shared folder. Every attempt of a task writes files of its
own name, and only the names in a written list count, so retries leave nothing
behind that is read. Streams are read and written in pieces; a task holds one
record at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classweave.llm.shared_files import make_folder, new_name, open_folder
from classweave.session import materialise, new_folder

# a copy of a shorter payload is written again in full
MIN_REVISIT_BYTES = 1000
# a new archive is begun past so many bytes of records
ARCHIVE_BYTES = 256_000_000
PIECE = 1 << 20

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES_TYPE = "archive string, sidecar string, records long, bytes long"


def payload_digest(payload: Column) -> Column:
    return F.sha1(payload)


def with_references(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` of every page.

    Among equal payloads of at least ``MIN_REVISIT_BYTES`` the largest page_id is
    stored and the others refer to it. Rows that repeat that page_id are stored
    too; a null page_id refers to the largest if there is one. Null html is an
    empty payload.
    """
    full = pages.select(
        "page_id", "url",
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", payload_digest(F.col("payload")))
    long = full.where(F.length("payload") >= MIN_REVISIT_BYTES)
    # only payloads that occur again; minima are combined before the shuffle
    groups = long.groupBy("digest").agg(
        F.count("*").alias("n"), F.max("page_id").alias("largest")).where(
        "n > 1 and largest is not null").select("digest", "largest")
    joined = full.join(groups, "digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.withColumn(
        "refers_to", F.when(other, F.col("largest"))).drop("largest")


def header_text(value: str | None) -> str | None:
    """The value as it is, or as a JSON string where a header could not hold it."""
    if value is None or (value.isprintable() and value == value.strip()
                         and not value.startswith('"')):
        return value
    return json.dumps(value)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record, a revisit without its payload."""
    body = b"" if refers_to is not None else payload
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": header_text(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Page-Id": page_id,
        "Payload-Length": len(payload),
        "WARC-Refers-To-Page": refers_to,
        "WARC-Profile": REVISIT_PROFILE if refers_to is not None else None,
        "Content-Type": "text/html;charset=utf-8",
        "Content-Length": len(body),
    }
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class RecordReader:
    """Takes a stream of bytes in pieces of any size and gives whole records."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _fill(self, enough: Callable[[], bool]) -> bool:
        while not enough():
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.held += piece
        return True

    def __iter__(self) -> Iterator[tuple[Headers, bytes]]:
        """Headers and the record as it stands."""
        while True:
            if not self._fill(lambda: b"\r\n\r\n" in self.held):
                if bytes(self.held).strip():
                    raise ValueError("the archive ends inside a record")
                return
            end = self.held.index(b"\r\n\r\n")
            headers = parse_headers(bytes(self.held[:end]))
            if "Content-Length" not in headers:
                raise ValueError("a record without its length")
            size = end + 4 + int(headers["Content-Length"]) + 4
            if not self._fill(lambda: len(self.held) >= size):
                raise ValueError("the archive ends inside a record")
            record = bytes(self.held[:size])
            del self.held[:size]
            yield headers, record


class Headers(dict):
    """Header values by name, in any case."""

    def __setitem__(self, name: str, value: str) -> None:
        super().__setitem__(name.lower(), value)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name: str) -> bool:
        return super().__contains__(name.lower())

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)


def parse_headers(raw: bytes) -> Headers:
    """The headers of a record; the last of a name counts.

    A line that begins with white space goes on with the value before it. Bytes
    that are not UTF-8 are replaced.
    """
    version, *lines = raw.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    found, name = Headers(), ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
            continue
        name, mark, value = line.partition(":")
        if not mark:
            raise ValueError(f"not a header line: {line[:20]!r}")
        name = name.strip()
        found[name] = value.strip()
    return found


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces."""
    engine, begun = zlib.decompressobj(31), False
    while data := stream.read(PIECE):
        while data:
            begun = True
            yield engine.decompress(data, PIECE)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, PIECE)
            data = engine.unused_data
            if engine.eof:
                engine, begun = zlib.decompressobj(31), False
            else:
                break
    if begun:
        raise ValueError("the archive ends inside a gzip member")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``with_references`` rows; one gzip stream per archive.

    Returns the written list of archives. An empty task writes none.
    """
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        stream = engine = None
        name, count, size = "", 0, 0

        def close() -> pa.RecordBatch:
            stream.write(engine.flush())
            stream.close()
            return files_batch([(f"{folder}/{name}", None, count, size)])

        for batch in batches:
            columns = [batch.column(c) for c in (
                "page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*columns):
                if stream is None:
                    name, count, size = new_name("crawl", ".warc.gz"), 0, 0
                    stream = system.open_output_stream(f"{path}/{name}", compression=None)
                    engine = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = record_bytes(*(value.as_py() for value in row))
                stream.write(engine.compress(raw))
                count, size = count + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    stream = None
        if stream is not None:
            yield close()

    return materialise(records.mapInArrow(write, FILES_TYPE))


def files_batch(rows: list[tuple]) -> pa.RecordBatch:
    archive, sidecar, records, size = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(archive, pa.string()), pa.array(sidecar, pa.string()),
         pa.array(records, pa.int64()), pa.array(size, pa.int64())],
        names=["archive", "sidecar", "records", "bytes"])


def spread(files: DataFrame) -> DataFrame:
    """One archive to a task as far as Spark's partitions go."""
    return files.repartition(max(1, min(files.count(), 10_000)))


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a gzip member per record and a sidecar index.

    The index has a line per record: offset, bytes of the member, type, page_id.
    Records keep their order and their bytes. Archives that are normal already
    come out the same. Returns the written list of new archives.
    """
    make_folder(folder)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                system, path = open_folder(source)
                target, base = open_folder(folder)
                name = new_name("normal", ".warc.gz")
                offset = count = 0
                with system.open_input_stream(path, compression=None) as stream, \
                        target.open_output_stream(
                            f"{base}/{name}", compression=None) as out, \
                        target.open_output_stream(
                            f"{base}/{name}.idx", compression=None) as index:
                    for headers, record in RecordReader(inflate(stream)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(record) + engine.flush()
                        out.write(member)
                        index.write((" ".join([
                            str(offset), str(len(member)),
                            "-".join(headers.get("WARC-Type", "-").split()),
                            headers.get("Page-Id", "-")]) + "\n").encode())
                        offset, count = offset + len(member), count + 1
                yield files_batch([(
                    f"{folder}/{name}", f"{folder}/{name}.idx", count, offset)])

    return materialise(spread(files).mapInArrow(rewrite, FILES_TYPE))


RECORD_TYPE = ("page_id long, url string, record_type string, payload_bytes long, "
               "payload_digest string, refers_to long, payload binary")


def read_member(source, offset: int, size: int) -> tuple[Headers, bytes]:
    """One record, by its place alone: headers and payload."""
    source.seek(offset)
    record = zlib.decompress(source.read(size), 31)
    end = record.index(b"\r\n\r\n")
    return parse_headers(record[:end]), record[end + 4:-4]


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of normalised archives, fetched through the indexes.

    ``payloads=False`` reads and checks them but leaves them in the worker.

    A response's digest and size are taken from its payload and checked against
    its headers; a revisit has a null payload and the digest and size of the
    payload it refers to. Records of other types, and of other writers, are
    given too, without a page_id.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(),
                                      batch.column("sidecar").to_pylist()):
                system, path = open_folder(archive)
                rows, held = [], 0
                with system.open_input_file(path) as source, \
                        system.open_input_stream(
                            open_folder(index)[1], compression=None) as lines:
                    for line in _lines(lines):
                        offset, size, kind, _ = line.split(" ")
                        row = _row(*read_member(source, int(offset), int(size)), kind)
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(row[-1] or b"") + 1000 if payloads else 1000
                        if held > 4 * PIECE:
                            yield _records_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _records_batch(rows)

    return spread(files).mapInArrow(read, RECORD_TYPE)


def _lines(stream) -> Iterator[str]:
    held = b""
    while data := stream.read(PIECE):
        *whole, held = (held + data).split(b"\n")
        yield from (line.decode() for line in whole)


def payload_of(headers: Headers, block: bytes) -> bytes:
    """What a record's block delivers: of an HTTP message, its body."""
    if headers.get("Content-Type", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _row(headers: Headers, block: bytes, kind: str) -> tuple:
    """``RECORD_TYPE`` of a record.

    Records of this module carry their page and the payload's size and digest,
    which are checked. Of others the payload is taken as it stands: its size and
    digest are its own, and those of a revisit are null and as its header says.
    """
    if kind != "-".join(headers.get("WARC-Type", "-").split()):
        raise ValueError("the index does not fit the archive")
    page, refers = headers.get("Page-Id"), headers.get("WARC-Refers-To-Page")
    url, payload = headers.get("WARC-Target-URI"), payload_of(headers, block)
    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    if "Payload-Length" in headers:
        wanted = (int(headers["Payload-Length"]),
                  headers["WARC-Payload-Digest"].removeprefix("sha1:"))
        if kind == "response" and (size, digest) != wanted:
            raise ValueError(f"the payload of page {page} is damaged")
        size, digest = wanted
    elif kind == "revisit":
        size, digest = None, headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    return (int(page) if page is not None else None,
            json.loads(url) if (url or "").startswith('"') else url, kind, size, digest,
            int(refers) if refers is not None else None,
            payload if kind != "revisit" else None)


def _records_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
             pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)],
        names=["page_id", "url", "record_type", "payload_bytes", "payload_digest",
               "refers_to", "payload"])


def archive_pages(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write pages, normalise the archives, and read every record back.

    Reads ``page_id, url, html`` only. An empty table gives no archives and no
    records.
    """
    spark = pages.sparkSession
    written = write_archives(with_references(pages), new_folder(spark, "warc"))
    return read_archives(
        normalise(written, new_folder(spark, "warc-normal")), payloads)
