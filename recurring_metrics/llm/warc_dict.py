"""Dictionary-compressed WARC archives: written, and read back.

Each task writes archives of bounded size. An archive begins with a skippable frame that
holds a Zstandard dictionary, trained on the first records of that archive; every record
follows as a frame of its own, compressed with it. Equal payloads of some size are stored
once: the others become revisit records that refer to it. Which record stays is found from
digests alone, summed before they are shuffled.

Archives are written through Arrow's file systems under the given URI (file, hdfs, s3, gs).
A task's archives carry the number of its attempt, and only archives listed in its result
are read, so a task that is run again leaves no double records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recurring_metrics.llm.common import arrow_schema, column
from recurring_metrics.sources.io import materialize

LEAST_REVISIT = 1000
# A skippable frame of this type holds the dictionary (0x184D2A50 to ..5F are skippable).
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES, SAMPLE_BYTES, ARCHIVE_BYTES, LEVEL = 64 << 10, 4 << 20, 32 << 20, 3
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long, bytes long"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def record_id(page: int | None) -> str:
    name = "null" if page is None else str(page)
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + name)}>"


def record_bytes(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str,
                 refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header and leaves out the payload."""
    revisit = refers_to is not None
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    ).encode()
    if not revisit:
        block += payload
    fields = [
        ("WARC-Type", REVISIT if revisit else RESPONSE),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(url.splitlines())))
    if page is not None:
        fields.append(("Page-ID", str(page)))
    if revisit:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to)),
            ("Refers-To-Page-ID", str(refers_to)),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's values; the payload of a response, its size and digest counted anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    size = int(http_fields["Content-Length"])
    if fields["WARC-Type"] == RESPONSE:
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    whole = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": whole("Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": whole("Refers-To-Page-ID"), "payload_bytes": size, "payload_digest": digest,
        "payload": payload if fields["WARC-Type"] == RESPONSE else None,
    }


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on records; the records themselves when they are too few; None without any."""
    if not samples:
        return None
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-size:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _file_system(uri: str) -> tuple[object, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class _Archive:
    """One archive: collects samples, then writes the dictionary and every record."""

    def __init__(self, uri: str):
        self.uri, self.waiting, self.held = uri, [], 0
        self.out, self.records, self.size = None, 0, 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.out is None:
            self.waiting.append(record)
            self.held += len(record)
            if self.held >= SAMPLE_BYTES:
                self._open()
        else:
            self._write(self.packer.compress(record))

    def _open(self) -> None:
        system, path = _file_system(self.uri)
        learned = dictionary(self.waiting)
        data = learned.as_bytes() if learned else b""
        raw = bool(learned) and learned.dict_id() == 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_content_size=True)
        self.out = system.open_output_stream(path, compression=None)
        self._write(struct.pack("<II", DICTIONARY_FRAME, len(data) + 1) + bytes([raw]) + data)
        for record in self.waiting:
            self._write(self.packer.compress(record))
        self.waiting = []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> dict:
        if self.out is None:
            self._open()
        self.out.close()
        return {"archive": self.uri, "records": self.records, "bytes": self.size}


def _writer(folder: str, date: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        done, archive = [], None
        for batch in batches:
            rows = zip(*[batch[c] for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")])
            for page, url, payload, size, digest, refers_to in rows:
                if archive is None:
                    archive = _Archive(f"{stem}-{len(done):04d}.warc.zst")
                data = payload.as_buffer().to_pybytes() if payload.is_valid else None
                archive.add(record_bytes(
                    page.as_py(), url.as_py(), data, size.as_py(), digest.as_py(), refers_to.as_py(), date
                ))
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(
            done, pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        )

    return run


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to) of pages (page_id, url, html).

    Of equal payloads of at least `least` bytes the one with the largest id
    stays (refers_to null, payload present); the others refer to it.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("body")).select(
        "page_id", "url", "body",
        F.octet_length("body").cast("long").alias("payload_bytes"),
        F.sha1("body").alias("payload_digest"),
        # Two independent digests decide what is equal.
        F.sha2("body", 256).alias("equal"),
    )
    large = rows.where(F.col("payload_bytes") >= least)
    stays = (
        large.groupBy("equal")
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("largest").isNotNull())
        .select("equal", "largest")
    )
    marked = rows.join(stays, "equal", "left")
    refers: Column = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return marked.select(
        "page_id", "url", F.when(refers.isNull(), F.col("body")).alias("payload"), "payload_bytes",
        "payload_digest", refers.alias("refers_to"),
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a record per row and returns the manifest (archive, records, bytes).

    Null html is an empty payload, a null url is left out, a null id is written
    without an id and never referred to. Rows that repeat the id that stays are
    all responses. An empty table writes no archive. Other columns are not read.
    `date` is every record's WARC-Date, as the table has none.
    """
    folder = folder.rstrip("/")
    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    chosen = pages.select(
        column(id_col).cast("long").alias("page_id"), column(url_col).alias("url"), column(html_col).alias("html")
    )
    return materialize(with_revisits(chosen).mapInArrow(_writer(folder, date), MANIFEST))


def archive_records(stream: object) -> Iterator[bytes]:
    """The records of an open archive, one after the other."""
    head = stream.read(8)
    kind, size = struct.unpack("<II", head)
    if kind != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    data = stream.read(size)
    learned = None
    if len(data) > 1:
        form = zstandard.DICT_TYPE_RAWCONTENT if data[0] else zstandard.DICT_TYPE_FULLDICT
        learned = zstandard.ZstdCompressionDict(data[1:], dict_type=form)
    unpacker = zstandard.ZstdDecompressor(dict_data=learned)
    frame, parts, begun = unpacker.decompressobj(), [], False
    pending = stream.read(1 << 16)
    while pending:
        parts.append(frame.decompress(pending))
        begun = not frame.eof
        if frame.eof:
            yield b"".join(parts)
            pending = frame.unused_data
            frame, parts = unpacker.decompressobj(), []
            if pending:
                continue
        pending = stream.read(1 << 16)
    if begun:
        raise ValueError("the archive ends within a record")


def _reader(with_payload: bool) -> object:
    schema = arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch["archive"].to_pylist():
                system, path = _file_system(uri)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for data in archive_records(stream):
                        row = parse_record(data)
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(data) if with_payload else 0
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives of a manifest; every response's digest is verified."""
    files = manifest.select("archive")
    spread = files.repartition(max(1, min(manifest.count(), 10_000)), "archive")
    return spread.mapInArrow(_reader(with_payload), RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Writes pages to archives under a folder and reads them back."""
    return read_archives(write_archives(pages, folder), with_payload)
