"""WARC archives through a table of payload chunks.

``write(df)`` cuts payloads into chunk rows, streams each record's chunks into
a WARC file of the shared folder, each record a gzip member of its own, and
returns the manifest of files.
``read(manifest)`` streams the files back into chunk rows: record identifier,
chunk number, the chunk, and the payload's length and SHA-256 up to and with
that chunk. Neither side ever holds more than a chunk of a record in Python,
and either digests chunk by chunk: the writer stops if a record's chunks don't
add up to the digest in its header.

Which record is the response of its digest is worked out on digests and keys
alone; the payloads stay where they were read. A null payload counts as empty. Of records with equal payloads of at least
``REVISIT_FROM`` bytes the one with the smallest key is a response and the
others revisit it; a revisit keeps the response's HTTP header, so length and
digest of the full payload survive. Rows that repeat the smallest key, or have
no key to refer to, stay responses. Other columns, whatever their names, are
left out.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Table, few, new_path, same

CHUNK = 1 << 20
FILE_BYTES = 64 << 20
LEVEL = 3
REVISIT_FROM = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Parts that the rows of a digest are dealt into where digests are joined by a shuffle.
SALTS = 64
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
CHUNK_SCHEMA = "record_id string, key long, record_type string, refers_to long, chunk_no long, chunk binary, payload_bytes long, payload_digest string, is_last boolean"


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    return pyarrow.fs.FileSystem.from_uri(uri)


def record_name(key: int | None) -> str:
    return f"urn:record:{'none' if key is None else key}"


def record_key(name: str) -> int | None:
    said = name.rpartition(":")[2]
    return None if said == "none" else int(said)


def http_header(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def warc_header(key: int | None, url: str | None, kind: str, refers_to: int | None, length: int, digest: str) -> bytes:
    """The record's header and the HTTP header that begins its block."""
    http = http_header(length)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_name(key)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{record_name(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (length if kind == 'response' else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def records(df: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """One row for each record: (key, url, record_type, refers_to, payload_bytes, payload_digest, body)."""
    data = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), data.alias("body"), F.octet_length(data).cast("long").alias("payload_bytes"), F.sha2(data, 256).alias("payload_digest"))
    large = rows.select("key", "payload_bytes", "payload_digest").where(F.col("payload_bytes") >= REVISIT_FROM)
    firsts = large.groupBy(F.col("payload_digest").alias("__digest")).agg(F.min("key").alias("__first"), F.count("*").alias("__n")).where("__n > 1 and __first is not null").drop("__n")
    firsts = Table(firsts, "responses").df
    if few(firsts):
        rows = rows.join(F.broadcast(firsts), F.col("payload_digest") == F.col("__digest"), "left")
    else:
        # repeated digests don't fit a broadcast: keys that revisit are found on narrow rows, digests dealt by key as well
        salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
        told = firsts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("__salt"))
        rows = rows.withColumn("__own", F.when(F.col("payload_bytes") >= REVISIT_FROM, F.col("payload_digest")).otherwise(F.uuid())).join(told, (F.col("__own") == F.col("__digest")) & (salt == F.col("__salt")), "left")
    again = F.col("__first").isNotNull() & ~same(F.col("key"), F.col("__first"))
    kind = F.when(again, "revisit").otherwise("response")
    return rows.select("key", "url", kind.alias("record_type"), F.when(again, F.col("__first")).alias("refers_to"), "payload_bytes", "payload_digest", F.when(again, F.lit(b"")).otherwise(F.col("body")).alias("body"))


def chunk_rows(recs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records as rows of at most ``chunk`` payload bytes, in order and together."""
    last = F.greatest(F.ceil(F.octet_length("body") / F.lit(chunk)) - 1, F.lit(0))
    rows = recs.select("*", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk_no"))
    piece = F.substring("body", (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk))
    return rows.select("key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", (F.col("chunk_no") == F.col("last")).alias("is_last"), piece.alias("chunk"))


def write(df: DataFrame, folder: str | None = None, key: str = "page_id", payload: str = "html", url: str = "url", chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives below ``folder`` (a fresh one of the shared folder if none) and returns (path, n_records, n_bytes).

    A task writes files with names of its own; the manifest has those of the
    attempts that succeeded, so what a lost executor left behind is never read.
    """
    folder = folder or new_path(df.sparkSession, "warc")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        done, file, member, digest, n, size, name = [], None, None, None, 0, 0, ""
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(9)), strict=True):
                number, last = row[6].as_py(), row[7].as_py()
                if number == 0:
                    if file is None or size >= file_bytes:
                        if file is not None:
                            file.close()
                            done.append((name, n, size))
                        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        file, n, size = fs.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None), 0, 0
                    member, digest, n = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), hashlib.sha256(), n + 1
                    size += file.write(member.compress(warc_header(*(x.as_py() for x in row[:6]))))
                digest.update(row[8].as_buffer())
                size += file.write(member.compress(row[8].as_buffer()))
                if last:
                    if row[2].as_py() == "response" and digest.hexdigest() != row[5].as_py():
                        raise ValueError(f"the chunks of record {row[0].as_py()} don't add up to its digest")
                    size += file.write(member.compress(b"\r\n\r\n") + member.flush())
        if file is not None:
            file.close()
            done.append((name, n, size))
        columns = zip(*done, strict=True) if done else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "n_records", "n_bytes"])

    rows = chunk_rows(records(df, key, payload, url), chunk)
    return Table(rows.mapInArrow(stream, "path string, n_records long, n_bytes long"), "manifest").df


def parse(stream, chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of one archive, read front to back."""

    def line() -> bytes:
        text = stream.readline()
        if text and not text.endswith(b"\r\n"):
            raise ValueError("the archive ends inside a header")
        return text[:-2]

    def fields() -> dict[str, str]:
        found = {}
        while text := line():
            name, _, value = text.decode().partition(":")
            found[name.lower()] = value.strip()
        return found

    while version := line():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {version[:40]!r}")
        head = fields()
        kind, key = head["warc-type"], record_key(head["warc-record-id"].strip("<>"))
        refers_to = record_key(head["warc-refers-to"].strip("<>")) if "warc-refers-to" in head else None
        said = head["warc-payload-digest"].removeprefix("sha256:")
        status = line()
        http = fields()
        length = int(http["content-length"])
        name = head["warc-record-id"].strip("<>")
        if kind == "revisit":
            yield (name, key, kind, refers_to, 0, b"", length, said, True)
        else:
            left = int(head["content-length"]) - len(http_header(length))
            if left != length or not status.startswith(b"HTTP/"):
                raise ValueError(f"{name}: its block has {left} bytes of payload, its HTTP header says {length}")
            digest, number, seen = hashlib.sha256(), 0, 0
            while True:
                data = stream.read(min(chunk, left))
                if len(data) < min(chunk, left):
                    raise ValueError(f"{name}: the archive ends inside its payload")
                digest.update(data)
                left, seen = left - len(data), seen + len(data)
                yield (name, key, kind, refers_to, number, bytes(data), seen, digest.hexdigest(), not left)
                number += 1
                if not left:
                    break
            if digest.hexdigest() != said:
                raise ValueError(f"{name}: its payload has another digest than its header")
        if line() or line():
            raise ValueError(f"{name}: no blank lines after the record")


def read(manifest: DataFrame, with_chunks: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows (``CHUNK_SCHEMA``) of the files in ``manifest``; without chunks the bytes are read and digested, not returned."""
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, where = filesystem(path)
                with io.BufferedReader(gzip.GzipFile(fileobj=fs.open_input_stream(where, compression=None), mode="rb"), 1 << 16) as file:
                    for row in parse(file, chunk):
                        rows.append(row if with_chunks else (*row[:5], None, *row[6:]))
                        held += len(row[5]) if with_chunks else 0
                        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield make()
                            rows, held = [], 0
        if rows:
            yield make()

    files = manifest.count()
    return manifest.select("path").repartition(max(files, 1)).mapInArrow(stream, CHUNK_SCHEMA)
