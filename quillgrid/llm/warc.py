"""WARC archives with a Zstandard dictionary.

Each archive is a file of its own: a skippable frame with a dictionary built
from the records that follow, then one Zstandard frame per record. Repeated
payloads become revisit records that name the record which holds the payload.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.batches import bounded
from quillgrid.session import materialize, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the published formats.
DICTIONARY_MAGIC = 0x184D2A5D  # the skippable frame in front of a .warc.zst
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

ARCHIVE_BYTES = 8 << 20  # records are collected up to this size, then written
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20  # of an archive's records, evenly spread, that build its dictionary
_CHUNK = 64 << 10


def mark_revisits(
    pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 1000
) -> DataFrame:
    """``pages`` with ``warc_digest, warc_bytes, warc_refers``.

    The digest is the payload's SHA-1 in hex (null payload: empty). Among rows
    with equal payloads of at least ``least`` bytes, ``warc_refers`` is the
    largest key unless the row has that key itself; else null. Null keys are
    smaller than all; rows that share the largest key (repeated rows) are all
    kept as responses.
    """
    body = F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "UTF-8")
    marked = pages.withColumn("warc_digest", F.sha1(body)).withColumn("warc_bytes", F.octet_length(body).cast("bigint"))
    repeated = (
        marked.filter(F.col("warc_bytes") >= least)
        .groupBy(F.col("warc_digest").alias("warc_same"))
        .agg(F.max(F.col(f"`{key}`")).alias("warc_last"), F.count(F.lit(1)).alias("warc_n"))
        .filter("warc_n > 1")
    )
    joined = marked.join(repeated, F.col("warc_digest") == F.col("warc_same"), "left")
    refers = F.when(~F.col(f"`{key}`").eqNullSafe(F.col("warc_last")), F.col("warc_last"))
    return joined.withColumn("warc_refers", refers).drop("warc_same", "warc_last", "warc_n")


def _header_text(value: str) -> str:
    """Header lines end at line breaks, so control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def _record(key, url: str | None, body: bytes, digest: str, n_bytes: int, refers) -> bytes:
    block = HTTP_HEAD if refers is not None else HTTP_HEAD + body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if refers is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from an even sample of the records.

    Zstandard refuses to train on few or very small records; then the sample's
    own bytes serve as a raw dictionary.
    """
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    sample = [r[: DICTIONARY_BYTES * 2] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[:2048] for r in sample)[-DICTIONARY_BYTES:]


def write_archive(out, records: list[bytes], level: int = 3) -> None:
    """Dictionary in a skippable frame, then each record as a frame of its own."""
    raw = build_dictionary(records)
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    for record in records:
        out.write(pack.compress(record))


def read_archive(source):
    """The records of an open archive, one after another."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
    rest = b""
    while True:
        rest = rest or source.read(_CHUNK)
        if not rest:
            return
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := source.read(_CHUNK)):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    body = block[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]
    return {"headers": headers, "payload": body}


def write_archives(pages: DataFrame, folder: str, key: str, url: str, payload: str) -> DataFrame:
    """Write archives below ``folder`` and return ``path, records`` of those that count.

    ``pages`` comes from ``mark_revisits``. A task names its files afresh, so a
    task that ran twice leaves files that no manifest row names.
    """

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held, size = [], 0

        def flush():
            name = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(name, compression=None) as out:
                write_archive(out, held)
            return pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                page, link, text, digest, n_bytes, refers = row
                held.append(_record(page, link, (text or "").encode(), digest, n_bytes, refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = pages.select(
        F.col(f"`{key}`").cast("bigint").alias("k"),
        F.col(f"`{url}`").alias("u"),
        F.when(F.col("warc_refers").isNull(), F.col(f"`{payload}`")).alias("p"),
        "warc_digest",
        "warc_bytes",
        F.col("warc_refers").cast("bigint").alias("r"),
    )
    return materialize(bounded(rows).mapInArrow(write, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload`` of every record."""
    schema = (
        "page_id long, url string, record_type string, refers_to long, "
        "payload_digest string, payload_bytes long, payload binary"
    )

    def number(urn: str | None):
        digits = (urn or "")[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
            )

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for record in read_archive(source):
                        found = parse_record(record)
                        h, body = found["headers"], found["payload"]
                        kind = h["WARC-Type"]
                        told = h["WARC-Payload-Digest"].partition(":")[2]
                        if kind == "response" and hashlib.sha1(body).hexdigest() != told:
                            raise ValueError(f"damaged payload of {h['WARC-Record-ID']} in {path}")
                        rows.append((
                            number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), kind, number(h.get("WARC-Refers-To")),
                            told, int(h["X-Payload-Length"]), body if kind == "response" else None,
                        ))
                        size += len(body)
                        if size >= ARCHIVE_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    parallel = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("path").repartition(4 * parallel, "path").mapInArrow(read, schema)


def archive_pages(
    pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html"
) -> tuple[DataFrame, str]:
    """Mark revisits and write: the manifest and the folder.

    ``folder`` is a URI that all executors reach (default: a new one in the
    shared scratch folder). Null payloads are empty, null urls have no target
    line, null keys an empty name; other columns of ``pages`` are left out. An
    empty table gives an empty manifest and no file. Names that begin with
    ``warc_`` are not allowed in ``pages``.
    """
    taken = [c for c in pages.columns if c.lower().startswith("warc_")]
    if taken:
        raise ValueError(f"columns {taken} are made by archive_pages; rename yours")
    folder = folder or scratch_path(pages.sparkSession, "warc")
    if "://" not in folder:  # a plain path, or Hadoop's short spelling file:/path
        folder = f"file://{folder.removeprefix('file:')}"
    return write_archives(mark_revisits(pages, key, payload), folder, key, url, payload), folder
