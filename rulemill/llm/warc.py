"""Legacy archive converter: ARC files of either version become WARC records.

An ARC file starts with a ``filedesc:`` record whose body names the version and the fields of the header lines that follow: one line
of blank-parted fields, the declared length last, then that many bytes and a line feed. Version 1 lines have
five fields, version 2 lines ten. Each ARC record becomes a WARC record whose identifier, timestamp, type and digests are derived from it:
a name-based UUID of address, date and content; the date in ISO form; ``warcinfo``, ``response`` or ``resource``; SHA-1 of the block and SHA-256 of the payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed by the ARC format: the fields of a header line, by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LEAST_REVISIT = 100
FILE_BYTES = 64 << 20


class ArcError(ValueError):
    """A header line or a declared length that doesn't fit the file."""


def arc_file(records: list[tuple[str, str, str, str, bytes]], version: int = 1, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    """An ARC file of (url, ip, date, type, body) records."""
    fields = " ".join(ARC_FIELDS[version])
    body = f"{version} 0 rulemill\n{fields}\n\n".encode()
    out = [_arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", 0, name, len(body)), body, b"\n"]
    at = sum(map(len, out))
    for url, ip, when, kind, block in records:
        line = _arc_line(version, url, ip, when, kind, at, name, len(block))
        out += [line, block, b"\n"]
        at += len(line) + len(block) + 1
    return b"".join(out)


def _arc_line(version: int, url: str, ip: str, date: str, kind: str, offset: int, name: str, length: int) -> bytes:
    middle = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {kind}{middle} {length}\n".encode()


def read_arc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record, the ``filedesc:`` one first. Raises ArcError on a wrong line or a body shorter than declared."""
    names: list[str] | None = None
    while True:
        line = stream.readline()
        while line in (b"\n", b"\r\n"):
            line = stream.readline()
        if not line:
            return
        text = line.rstrip(b"\r\n").decode("utf-8", "surrogateescape")
        if names is None:
            if not text.startswith("filedesc:"):
                raise ArcError("the file doesn't start with a filedesc record")
            parts = text.split(" ")
            names_here = ARC_FIELDS[1] if len(parts) == 5 else ARC_FIELDS[2]
        else:
            names_here = names
        parts = text.rsplit(" ", len(names_here) - 1)  # an address with blanks keeps them
        if len(parts) != len(names_here) or not parts[-1].isdigit():
            raise ArcError(f"a header line of {len(names_here)} fields is due: {text[:120]!r}")
        length = int(parts[-1])
        body = stream.read(length)
        if len(body) != length:
            raise ArcError(f"{length} bytes are declared, {len(body)} there")
        if names is None:
            declared = body.decode("utf-8", "replace").split("\n")
            version = declared[0].split(" ")[0]
            if version not in ("1", "2"):
                raise ArcError(f"version {version!r} is unknown")
            listed = declared[1].split() if len(declared) > 1 else []
            names = listed if listed and listed[-1] == "Archive-length" else ARC_FIELDS[int(version)]
        yield dict(zip(names_here, parts, strict=True)), body


def iso_date(date: str) -> str:
    """14 digits, or the 12 of old files, as a WARC date."""
    if not re.fullmatch(r"\d{12}(\d\d)?", date):
        raise ArcError(f"not a date: {date!r}")
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(fields: dict[str, str], body: bytes) -> tuple[list[tuple[str, str]], bytes, bytes]:
    """WARC header fields, the block and its payload of one ARC record."""
    url, kind = fields["URL"], fields["Content-type"]
    block_sha1 = hashlib.sha1(body).digest()
    payload = body
    if url.startswith("filedesc:"):
        what, content = "warcinfo", "application/warc-fields"
    elif body[:5] == b"HTTP/":
        what, content = "response", "application/http; msgtype=response"
        cut = body.find(b"\r\n\r\n")
        payload = body[cut + 4 :] if cut >= 0 else b""
    elif url.startswith("dns:"):
        what, content = "response", "text/dns"
    else:
        what, content = "resource", kind if kind not in ("-", "no-type") else "application/octet-stream"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {fields['Archive-date']} {block_sha1.hex()}")
    head = [("WARC-Type", what), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", iso_date(fields["Archive-date"])), ("Content-Type", content)]
    if what == "warcinfo":
        head.append(("WARC-Filename", url.removeprefix("filedesc://")))
    else:
        head += [("WARC-Target-URI", url), ("WARC-IP-Address", fields["IP-address"]), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest())]
    head.append(("WARC-Block-Digest", "sha1:" + base64.b32encode(block_sha1).decode()))
    return head, body, payload


def warc_record(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + lines.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            head[k.strip()] = v.strip()
        n = int(head["Content-Length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a WARC block is cut short")
        yield head, block


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _blank_free(url: str | None) -> str:
    return re.sub(r"\s", "%20", url) if url else "about:blank"


def convert_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1, date: str = "20240101000000") -> DataFrame:
    """Put pages into ARC files and convert these: one row per page with the converted record.

    Returns the id, row (a number for this run), digest, payload_bytes, record_id, uri and record (a gzip member). The page's id travels in an HTTP header of the ARC body.
    A null html is an empty payload, a null address about:blank.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        base = TaskContext.get().partitionId() << 40
        for batch in common.pieces(batches, "_html", 8 << 20):
            urls, htmls, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0).to_pylist()
            records = []
            for i, u, h in zip(ids, urls, htmls, strict=True):
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if i is None else i}\r\n\r\n".encode()
                records.append((_blank_free(u), "0.0.0.0", date, "text/html", http + (h or "").encode()))
            out = []
            for fields, body in read_arc(io.BytesIO(arc_file(records, version))):
                if fields["URL"].startswith("filedesc:"):
                    continue
                head, block, payload = convert(fields, body)
                named = dict(head)
                out.append((named["WARC-Payload-Digest"].removeprefix("sha256:"), len(payload), named["WARC-Record-ID"], named["WARC-Target-URI"], _gzip(warc_record(head, block))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(range(base + n, base + n + len(out)), pa.int64()), pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out]), pa.array([x[3] for x in out]), pa.array([x[4] for x in out], pa.binary())],
                [id_col, "row", "digest", "payload_bytes", "record_id", "uri", "record"],
            )
            n += len(out)

    return pages.select(F.col(id_col), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html")).mapInArrow(run, f"`{id_col}` {kind}, row long, digest string, payload_bytes long, record_id string, uri string, record binary")


def originals(records: DataFrame, id_col: str = "page_id", least: int = LEAST_REVISIT) -> DataFrame:
    """row and refers_to of every record that repeats an earlier payload of at least ``least`` bytes; the smallest id (nulls last, then the row) stays. A very common payload is looked up by broadcast."""
    slim = records.where(F.col("payload_bytes") >= least).select("digest", "row", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "row", "record_id", "uri").alias("me"))
    groups = slim.groupBy("digest").agg(F.min("me").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = common.with_lookup(slim, "digest", groups, "n", common.hot_limit(records.count()))
    return found.where("first IS NOT NULL AND first.row <> row").select("row", F.struct(F.col("first")["id"].alias("id"), F.col("first")["record_id"].alias("record_id"), F.col("first")["uri"].alias("uri")).alias("first"))


def write_archives(records: DataFrame, revisits: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write gzip WARC files of about ``file_bytes`` into ``folder`` and return their manifest (file, records).

    Each attempt of a task writes under names of its own, and only the successful attempt's names come into the manifest, so lost executors and
    repeated tasks leave no double records. Works with every store that pyarrow opens.
    """
    joined = records.select("row", "record", "digest", "payload_bytes").join(revisits, "row", "left").select("record", "digest", "payload_bytes", F.col("first").isNotNull().alias("again"), F.col("first")["id"].cast("string").alias("of"), F.col("first")["record_id"].alias("of_record"), F.col("first")["uri"].alias("of_uri"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, n, files = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(posixpath.join(root, name), compression=None)
                    info = b"software: rulemill\r\nformat: WARC File Format 1.0\r\n"
                    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                    out.write(_gzip(warc_record(head, info)))
                data = revisit(row["record"], row["payload_bytes"], row["of"], row["of_record"], row["of_uri"]) if row["again"] else row["record"]
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    files.append((name, n))
                    out = None
        if out is not None:
            out.close()
            files.append((name, n))
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files]), pa.array([k for _, k in files], pa.int64())], ["file", "records"])

    return common.stored(joined.mapInArrow(run, "file string, records long"), "manifest")


def revisit(record: bytes, payload_bytes: int, of: str | None, of_record: str, of_uri: str) -> bytes:
    """The revisit record of a response record: the HTTP head alone, with the digest of the full payload and the original's record id, address and date (all pages here have one)."""
    head, block = next(read_warc(io.BytesIO(zlib.decompress(record, 31))))
    block = block[: len(block) - payload_bytes]
    head = {k: v for k, v in head.items() if k not in ("Content-Length", "WARC-Block-Digest")} | {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": of_record, "WARC-Refers-To-Target-URI": of_uri, "WARC-Refers-To-Date": head["WARC-Date"], "X-Payload-Length": str(payload_bytes), "X-Refers-To-Page": of or ""}
    head["WARC-Block-Digest"] = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    return _gzip(warc_record(list(head.items()), block))


def read_archives(manifest: DataFrame, folder: str, id_type: str = "long", id_col: str = "page_id") -> DataFrame:
    """Read the WARC files of a manifest, one stream at a time: id, target_uri, payload_bytes, payload_digest, record_type, refers_to, record_id, date."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(posixpath.join(root, name), compression="gzip", buffer_size=1 << 20) as raw:
                    for head, block in read_warc(io.BufferedReader(raw, 1 << 20)):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        cut = block.find(b"\r\n\r\n")
                        http = dict(x.partition(": ")[::2] for x in block[:cut].decode("utf-8", "replace").split("\r\n")[1:])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if head["WARC-Type"] == "revisit":
                            size = int(head["X-Payload-Length"])
                        else:
                            size = len(block) - cut - 4
                            if hashlib.sha256(memoryview(block)[cut + 4 :]).hexdigest() != digest:
                                raise ValueError(f"{name}: a payload doesn't fit its digest")
                        rows.append((http.get("X-Page-Id") or None, head["WARC-Target-URI"], size, digest, head["WARC-Type"], head.get("X-Refers-To-Page") or None, head["WARC-Record-ID"], head["WARC-Date"]))
                        if len(rows) >= 20_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    read = manifest.select("file").repartition(max(1, min(manifest.count(), 100_000)), F.col("file")).mapInArrow(run, "id string, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, date string")
    return read.select(F.col("id").cast(id_type).alias(id_col), "target_uri", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"), "record_id", "date")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 2 else pa.string()) for i in range(8)], names)


def round_trip(pages: DataFrame, id_col: str = "page_id", version: int = 1) -> DataFrame:
    """Pages to ARC, to WARC files in the shared folder, and back. Repeated rows and null ids keep a record each; an empty table gives an empty table; further columns, whatever their names, are not read. Payloads are kept whole, however long."""
    spark = pages.sparkSession
    records = common.stored(convert_pages(pages, id_col, version=version), "records")
    folder = common.shared_path(spark, "warc")
    manifest = write_archives(records, common.stored(originals(records, id_col), "revisits"), folder)
    return read_archives(manifest, folder, pages.schema[id_col].dataType.simpleString(), id_col)
