"""WARC archives: a writer and a sequential reader.

Every record is a gzip member of its own. Pages with equal payloads are found by digest over the keys alone; the smallest
page_id becomes the response, the others become revisits of it. Tasks write archives of bounded size into the shared
folder and return their paths; the manifest of those paths, which Spark commits, decides which archives count, so files
of lost or repeated tasks are never read. The reader decompresses in pieces, frames by Content-Length and checks digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import new_path, written

ARCHIVE = 64 << 20  #: bytes after which a task starts a new archive
PIECE = 1 << 16  #: bytes read at once
LINE = b"\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that is cut off, framed wrongly or whose digests do not hold."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    name = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def header_value(text: str) -> str:
    """A value on one line."""
    return " ".join(text.split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. A revisit has no payload; its digest and length are those of the full payload."""
    block = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", page_uri(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", header_value(url or "")),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Refers-To", page_uri(refers_to)), ("WARC-Profile", IDENTICAL)]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = b"WARC/1.1" + LINE + b"".join(f"{k}: {v}".encode() + LINE for k, v in fields) + LINE
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(head + block + LINE + LINE) + pack.flush()


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream one after another, each decompressed, reading PIECE bytes at a time."""
    left = b""
    while True:
        left = left or stream.read(PIECE)
        if not left:
            return
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not left:
                left = stream.read(PIECE)
                if not left:
                    raise WarcError("the archive ends within a record")
            try:
                parts.append(unpack.decompress(left))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            left = unpack.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block of a record; framing and digests are checked."""
    head, found, rest = member.partition(LINE + LINE)
    first, *lines = head.split(LINE)
    if not found or not first.startswith(b"WARC/1."):
        raise WarcError("a record without WARC header")
    fields = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise WarcError(f"not a header field: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("a record without Content-Length") from e
    block = rest[:n]
    if len(block) != n or rest[n:] != LINE + LINE:
        raise WarcError("a record whose length is not its Content-Length")
    wanted = [fields.get("warc-block-digest")] + [fields.get("warc-payload-digest")] * (fields.get("warc-type") == "response")
    for digest in wanted:
        if digest and digest != f"sha1:{base32_sha1(block)}":
            raise WarcError(f"digest {digest} does not hold for {fields.get('warc-record-id')}")
    return fields, block


def read(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of an archive in order."""
    return map(parse, members(stream))


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, html, refers_to, revisit.

    Payloads of at least ``least`` bytes that are equal: the smallest page_id is the response (rows repeated with that id
    too), the others refer to it. Only digests and ids are grouped, in part before the shuffle.
    """
    key = F.sha2(F.coalesce("html", F.lit("")), 256)
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= least
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", key.alias("key"), large.alias("large"))
    same = rows.where("large").groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    revisit = F.coalesce(F.col("large") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return rows.join(same, "key", "left").select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", most: int = ARCHIVE) -> DataFrame:
    """records of plan_records() written as archives in folder, which all executors share; their manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            for r in range(batch.num_rows):
                page_id, url, html, refers_to, revisit = (batch.column(c)[r].as_py() for c in range(5))
                data = record(page_id, url, (html or "").encode("utf-8", "replace"), refers_to, revisit, date)
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= most:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})

    return written(records.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(run, "path string, records long"), "warc-manifest")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of all archives of a manifest: READ's columns and, if wanted, payload (binary; null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * payloads
        kinds = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.binary() if n == "payload" else pa.string()) for n in names])
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                rows, seen, held = [], 0, 0
                with store.open_input_stream(at, compression=None) as stream:
                    for fields, block in read(stream):
                        refers = fields.get("warc-refers-to")
                        rows.append({
                            "page_id": page_of(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload_bytes": int(fields["payload-length"]),
                            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "record_type": fields["warc-type"], "refers_to": page_of(refers) if refers else None,
                        } | ({"payload": block if fields["warc-type"] == "response" else None} if payloads else {}))
                        seen, held = seen + 1, held + len(block)
                        if len(rows) == 4096 or (payloads and held > 8 << 20):
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, held = [], 0
                if seen != n:
                    raise WarcError(f"{path} has {seen} records, not {n}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    dealt = manifest.select("path", "records").repartition(F.col("path"))
    return dealt.mapInArrow(run, READ + ", payload binary" * payloads)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, a row per page.

    Null html is an empty payload, null url an empty target. Pages with null page_id keep it and are a response only if no
    page with an id has their payload. Empty tables give no rows.
    """
    folder = new_path(pages.sparkSession, "warc")
    manifest = write_archives(plan_records(pages, least), folder)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
