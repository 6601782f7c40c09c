"""WARC archives by way of a chunked record table.

A payload is never held as a whole: it is a run of rows ``record, chunk`` of at most ``CHUNK`` bytes, and each row
carries the length and the SHA-1 of all that stands up to its end. The last row of a record thus has what the record's
header must say, and archives are written and read as streams of such rows.

Writing: the table of chunks is written once; its last rows settle which record of each payload is the response and
which ones revisit it; then chunks go to their records, behind one row that holds the header, and each task streams
its records into compressed archives, a gzip member a record. A table of the archives that successful tasks wrote
says what belongs to the result, so a task that ran twice leaves nothing that is read.

Reading: each task streams archives into rows of the same kind and checks every digest on its way.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import open_input, open_output
from .common import Scratch

CHUNK = 65_536
#: Compressed bytes after which a task begins another archive.
ROLL = 64_000_000
#: Bytes of chunks that a task sends on at once.
FLUSH = 8_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A record as it is read: of each chunk, the length and digest of the payload up to its end.
RECORDS = "record_id string, id string, uri string, record_type string, refers_to string, chunk long, data binary, payload_bytes long, payload_digest string, last boolean"


def base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _names(schema: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in schema.split(",")]


def _chunked(size: int):
    """Rows of chunks from rows ``record, id, uri, payload``; an empty payload is one empty chunk."""
    names = ["record", "id", "uri", "chunk", "data", "so_far", "digest", "last"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            types = types or [pa.int64(), batch.column(1).type, pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
            out, held = [], 0
            for record, key, uri, payload in zip(*batch.columns, strict=True):
                whole, sha1, at, chunk = memoryview(payload.as_buffer() or b""), hashlib.sha1(), 0, 0
                while True:
                    data = bytes(whole[at : at + size])
                    at, last = at + len(data), at + len(data) == len(whole)
                    sha1.update(data)
                    out.append((record.as_py(), key.as_py(), uri.as_py(), chunk, data, at, base32(sha1), last))
                    chunk, held = chunk + 1, held + len(data)
                    if held >= FLUSH:
                        yield _batch(out, names, types)
                        out, held = [], 0
                    if last:
                        break
            if out:
                yield _batch(out, names, types)

    return run


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def chunk_payloads(rows: DataFrame, id_col: str, uri_col: str, payload_col: str, size: int = CHUNK) -> DataFrame:
    """``record, id, uri, chunk, data, so_far, digest, last`` of a table's payloads; record numbers the rows.

    A null payload counts as empty, and texts are taken as UTF-8. As rows are numbered when they are first read, the
    result must be written before it is used twice.
    """
    source = rows.select(F.monotonically_increasing_id().alias("record"), F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_chunked(size), f"record long, id {kind}, uri string, chunk long, data binary, so_far long, digest string, last boolean")


def settle_records(scratch: Scratch, chunks: DataFrame, least: int = 0) -> DataFrame:
    """One row a record: ``record, id, uri, so_far, digest, refers struct<id, record>``; refers is null for a response.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest id is the response, a null id
    coming last and the earlier row first where ids are equal. Groups of copies are counted before they are dealt, and
    both sides of the join are written tables, so that the copies of one payload are split among tasks.
    """
    heads = chunks.filter("last").select("record", "id", "uri", "so_far", "digest")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "record")).alias("first")
    shared = scratch.save(heads.filter(F.col("so_far") >= least).groupBy("digest", "so_far").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "so_far", "first.id", "first.record"), "groups")
    other = shared.select("digest", "so_far", F.struct("id", "record").alias("refers"))
    joined = heads.join(other, ["digest", "so_far"], "left")
    return joined.select("record", "id", "uri", "so_far", "digest", F.when(F.col("refers.record") != F.col("record"), F.col("refers")).alias("refers"))


def record_name(key: str | None, record: int | None) -> str:
    """A record's URI: its id, quoted, and its number."""
    return f"<urn:record:{'' if key is None else urllib.parse.quote(key, safe='') or '%'}:{record}>"


def record_key(name: str) -> str | None:
    key = name.removeprefix("<urn:record:").rpartition(":")[0]
    return None if not key else "" if key == "%" else urllib.parse.unquote(key)


def header(row: dict, date: str) -> bytes:
    """All of a record that stands before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['so_far']}\r\n\r\n".encode()
    revisit = row["refers"] is not None
    uri = re.sub(r"[\x00-\x20\x7F]", lambda m: urllib.parse.quote(m[0]), row["uri"] or "urn:none")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_name(row["id"], row["record"])), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{row['digest']}")]
    if revisit:
        fields += [("WARC-Refers-To", record_name(row["refers"]["id"], row["refers"]["record"])), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (0 if revisit else row["so_far"])))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + http


def _archived(folder: str, roll: int, date: str, level: int):
    """Streams records into archives; a row for each archive."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files, sink, member, name = uuid.uuid4().hex, [], None, None, ""

        def end_record() -> None:
            nonlocal member
            if member is not None:
                sink.write(member.compress(b"\r\n\r\n") + member.flush())
                member = None

        def end_archive() -> None:
            nonlocal sink
            if sink is not None:
                files[-1][2] = sink.tell()
                sink.close()
                sink = None

        for batch in batches:
            place = {n: i for i, n in enumerate(batch.schema.names)}
            for i, chunk in enumerate(batch.column(place["chunk"]).to_pylist()):
                if chunk < 0:  # a record's first row: what its header says
                    end_record()
                    if sink is not None and sink.tell() >= roll:
                        end_archive()
                    if sink is None:
                        name = f"{folder}/{task}-{len(files):05d}.warc.gz"
                        sink = open_output(name)
                        files.append([name, 0, 0])
                    row = {n: batch.column(place[n])[i].as_py() for n in ("record", "id", "uri", "so_far", "digest", "refers")}
                    member, wanted = zlib.compressobj(level, wbits=31), row["refers"] is None
                    sink.write(member.compress(header(row, date)))
                    files[-1][1] += 1
                elif wanted:
                    sink.write(member.compress(batch.column(place["data"])[i].as_buffer()))
        end_record()
        end_archive()
        if files:
            yield _batch([tuple(f) for f in files], ["file", "records", "bytes"], [pa.string(), pa.int64(), pa.int64()])

    return run


def write_warc(scratch: Scratch, chunks: DataFrame, settled: DataFrame, folder: str, roll: int = ROLL, date: str = "2000-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Write records and return the table of archives ``file, records, bytes``; only what it names belongs to the result."""
    kind = "struct<id string, record bigint>"
    heads = settled.select("record", F.lit(-1).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("data"), F.col("id").cast("string").alias("id"), "uri", "so_far", "digest", F.col("refers").cast(kind).alias("refers"))
    none = lambda name, type_: F.lit(None).cast(type_).alias(name)
    data = chunks.select("record", "chunk", "data", none("id", "string"), none("uri", "string"), none("so_far", "long"), none("digest", "string"), none("refers", kind))
    placed = heads.unionByName(data).repartition("record").sortWithinPartitions("record", "chunk")
    return scratch.save(placed.mapInArrow(_archived(folder, roll, date, level), "file string, records long, bytes long"), "archives-written")


class BadRecord(ValueError):
    """A record that is cut short, is no WARC record, or does not have the digest that it claims."""


def _fields(f: gzip.GzipFile) -> tuple[dict[str, str], int]:
    out, n = {}, 0
    while (line := f.readline(1 << 16)) not in (b"\r\n", b"\n"):
        if not line:
            raise BadRecord("a header is cut short")
        n += len(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out, n + len(line)


def read_records(f: gzip.GzipFile, size: int = CHUNK, content: bool = True) -> Iterator[tuple]:
    """The rows of RECORDS of one archive, a chunk at a time; other types than response and revisit are passed over."""
    while line := f.readline(1 << 16):
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise BadRecord("no WARC record begins here")
        head, _ = _fields(f)
        left, kind = int(head["content-length"]), head.get("warc-type", "")
        http: dict[str, str] = {}
        if kind in ("response", "revisit") and head.get("content-type", "").startswith("application/http"):
            first = f.readline(1 << 16)
            http, n = _fields(f)
            left -= len(first) + n
        name, refers = head.get("warc-record-id", ""), head.get("warc-refers-to")
        base = (name, record_key(name), head.get("warc-target-uri"), kind, record_key(refers) if refers else None)
        claimed = head.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "revisit":
            yield (*base, 0, b"", int(http.get("content-length", 0)), claimed, True)
        sha1, at, chunk, last = hashlib.sha1(), 0, 0, False
        while not last:
            data = f.read(min(size, left - at))
            if not data and at < left:
                raise BadRecord(f"{name} is cut short")
            sha1.update(data)
            at += len(data)
            last = at == left
            if last and kind == "response" and claimed and base32(sha1) != claimed:
                raise BadRecord(f"{name} does not have the digest {claimed}")
            if kind == "response":
                yield (*base, chunk, data if content else None, at, base32(sha1), last)
            chunk += 1


def _unpacked(size: int, content: bool):
    types = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out, held = [], 0
                try:
                    with open_input(name) as raw, gzip.GzipFile(fileobj=raw) as f:
                        for row in read_records(f, size, content):
                            out.append(row)
                            held += len(row[6] or b"") + 300
                            if held >= FLUSH:
                                yield _batch(out, _names(RECORDS), types)
                                out, held = [], 0
                except (BadRecord, EOFError, zlib.error, gzip.BadGzipFile, KeyError, ValueError) as e:
                    raise BadRecord(f"{name}: {e!r}") from e
                if out:
                    yield _batch(out, _names(RECORDS), types)

    return run


def read_warc(files: DataFrame, size: int = CHUNK, content: bool = True) -> DataFrame:
    """The records of the archives that ``file`` names, as rows of RECORDS; without ``content`` bytes are checked but not returned.

    A record that is cut short or does not match its digest fails the read.
    """
    return files.select("file").mapInArrow(_unpacked(size, content), RECORDS)


def through_warc(rows: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 0, size: int = CHUNK, roll: int = ROLL) -> DataFrame:
    """Write a record for every row, read the archives back: ``id_col, payload_bytes, payload_digest, record_type, refers_to``, a row a record.

    A null or empty payload is a record of no bytes. Null ids are records as well: they come last where payloads are
    equal, and what revisits one refers to null. Rows that repeat are records each, the earlier row being the response.
    A null address is written as urn:none; characters that a header line cannot hold are percent-encoded. Payloads
    of any length pass in chunks. Columns besides these three are ignored, whatever their names; an empty table gives
    no rows. Digests are SHA-1 in upper-case base32. Tables and archives of the run are removed but for the result.
    """
    scratch = Scratch(rows.sparkSession, "warc")
    kind = rows.schema[id_col].dataType
    chunks = scratch.save(chunk_payloads(rows, id_col, uri_col, payload_col, size), "chunks", compression="zstd")
    settled = settle_records(scratch, chunks, least)
    scratch.names.append("archives")
    archives = write_warc(scratch, chunks, settled, f"{scratch.root}/archives", roll)
    # a task for each few archives, however few files name them
    spread = archives.repartition(max(1, min(100_000, archives.count())))
    found = read_warc(spread, size, content=False).filter("last")
    return scratch.last(found.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")))
