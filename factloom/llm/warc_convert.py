"""Legacy ARC archives to WARC, and back to rows.

``write_arcs`` lays rows down as ARC files of version 1 or 2 (gzip member for each
record). ``convert`` parses them: the version block names the version, which tells
how a header line's fields are cut; the declared length cuts the record. Of each
it synthesises a WARC record: identifier (name-based UUID), date from the 14-digit
timestamp, type, payload and block digests. Of records with equal payloads one is
the response and the others revisit it, which a group-by over digests decides; no
payload is ever shuffled. ``read_warcs`` reads the archives back.

Files are written whole by the task that owns them (an attempt that runs again
replaces its own) and their lists are stored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import datetime, timedelta

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import discard, filesystem, remove, shared_folder, stored, write_atomically

#: A file ends after so many bytes of records, or so many records.
FILE_BYTES, FILE_RECORDS = 32 << 20, 20_000
#: Field lists of the two versions' header lines, and WARC's names.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
FIRST_DATE = datetime(2001, 1, 1)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream, size: int = 1 << 20):
    """The gzip members of a stream, one at a time."""
    unpacker, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(size)
        rest = b""
        if not data:
            if parts:
                raise ValueError("the archive is cut off")
            return
        parts.append(unpacker.decompress(data))
        if unpacker.eof:
            yield b"".join(parts)
            rest, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def version_block(version: int, name: str) -> bytes:
    lines = f"{version} 0 factloom\n{FIELDS[version]}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {FIRST_DATE:%Y%m%d%H%M%S} text/plain"
    if version == 2:
        head += f" 200 - - 0 {name}"
    return f"{head} {len(lines)}\n".encode() + lines


def header_fields(line: bytes, version: int) -> dict[str, str]:
    """The fields of an ARC header line; a URL may hold spaces, so fields are cut from the right."""
    names = FIELDS[version].split()
    values = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
    if len(values) != len(names) or not values[-1].isdigit():
        raise ValueError(f"not an ARC header line of version {version}: {line[:200]!r}")
    return dict(zip(names, values, strict=True))


def arc_records(stream):
    """(fields, block) of each record of an ARC file, by declared lengths."""
    version = 0
    for member in members(stream):
        member = member.lstrip(b"\n")
        line, _, rest = member.partition(b"\n")
        if not version:
            if not line.startswith(b"filedesc://"):
                raise ValueError("no version block")
            version = int(rest.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        fields = header_fields(line, version)
        block = rest[: int(fields["Archive-length"])]
        if len(block) != int(fields["Archive-length"]):
            raise ValueError("a record is shorter than its declared length")
        yield fields, block


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers with lower-case names, header bytes, payload) of an HTTP response."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, head + mark, payload


def record_id(row: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'row:{row}')}>"


def warc_record(fields: dict, block: bytes, record_type: str, refers_to: str | None) -> bytes:
    """A WARC record of an ARC record; ``refers_to`` is the row of the response that a revisit refers to."""
    headers, head, payload = http_parts(block)
    date = datetime.strptime(fields["Archive-date"], "%Y%m%d%H%M%S")
    body = head if record_type == "revisit" else block
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {record_id(headers.get('x-row', '-'))}",
        f"WARC-Date: {date:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(body)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if record_type == "revisit":
        lines[5:5] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def warc_info(name: str) -> bytes:
    body = b"software: factloom\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, name)}>\r\nWARC-Date: {FIRST_DATE:%Y-%m-%dT%H:%M:%SZ}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def warc_records(stream):
    """(headers with lower-case names, block) of each record of a WARC file."""
    for member in members(stream):
        head, _, rest = member.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        yield headers, rest[: int(headers["content-length"])]


def _archive_url(url: str | None, row: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:row:{row}"


def write_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Lays the rows down as ARC files, of either version by turns; returns their list: path."""
    folder = shared_folder(pages.sparkSession, "arc")

    def write(batches):
        import pyarrow as pa

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            nonlocal n, size
            name = f"part-{part:06d}-{n:04d}.arc.gz"
            version = 1 + (part + n) % 2

            def fill(out):
                out.write(_member(version_block(version, name)))
                at = 0
                for url, row, payload in held:
                    date = FIRST_DATE + timedelta(seconds=int(row) % 10**9 if row != "-" else 0)
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Row: {row}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                    line = f"{url} 0.0.0.0 {date:%Y%m%d%H%M%S} text/html"
                    if version == 2:
                        line += f" 200 - - {at} {name}"
                    packed = _member(f"{line} {len(block)}\n".encode() + block + b"\n")
                    at += len(packed)
                    out.write(packed)

            write_atomically(f"{folder}/{name}", fill)
            held.clear()
            n, size = n + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

        for batch in batches:
            for row, url, page in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                row = "-" if row is None else str(row)
                payload = (page or "").encode("utf-8", "surrogatepass")
                held.append((_archive_url(url, row), row, payload))
                size += len(payload)
                if size >= FILE_BYTES or len(held) >= FILE_RECORDS:
                    yield close()
        if held:
            yield close()

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return stored(rows.mapInArrow(write, "path string"), "arc-list")


def _dealt(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")


def arc_digests(arcs: DataFrame) -> DataFrame:
    """path, n (the record's place in its file), row, bytes and digests of each record's payload."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = filesystem(path)
                rows = []
                with store.open_input_stream(name, compression=None) as f:
                    for n, (_, block) in enumerate(arc_records(f)):
                        headers, _, payload = http_parts(block)
                        row = headers.get("x-row", "-")
                        rows.append((path, n, None if row == "-" else int(row), len(payload), hashlib.sha1(payload).digest() + hashlib.sha256(payload).digest()))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "n", "row", "bytes", "digest"])

    return _dealt(arcs).mapInArrow(read, "path string, n int, row long, bytes long, digest binary")


def convert(arcs: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes a WARC file for each ARC file; returns their list: path.

    Of records with equal payloads of ``least_bytes`` bytes or more, that with the
    largest row is the response; smaller payloads are all responses.
    """
    folder = shared_folder(arcs.sparkSession, "warc")
    digests = stored(arc_digests(arcs), "arc-digests")
    # the response's row by digest and length; the joined key is made anew so that a digest that very many rows share can be split
    first = digests.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("row").alias("first")).select(F.concat("digest", F.col("bytes").cast("string").cast("binary")).alias("key"), "first")
    told = digests.select("path", "n", "row", F.concat("digest", F.col("bytes").cast("string").cast("binary")).alias("key")).join(first, "key", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("row")), F.col("first"))
    # at most FILE_RECORDS rows for each file; only revisits are told
    lists = told.select("path", refers.alias("refers"), "n").where("refers is not null").groupBy("path").agg(F.collect_list(F.struct("n", "refers")).alias("revisits"))
    # the files are dealt out before the small lists join them: lists alone would be put together in one task
    by_file = _dealt(arcs.select("path")).join(lists, "path", "left").select("path", "revisits")

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for path, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                refers_to = {r["n"]: r["refers"] for r in revisits or ()}
                store, name = filesystem(path)
                out_name = f"{path.rsplit('/', 1)[1].removesuffix('.arc.gz')}.warc.gz"

                def fill(out, store=store, name=name, refers_to=refers_to, out_name=out_name):
                    out.write(_member(warc_info(out_name)))
                    with store.open_input_stream(name, compression=None) as f:
                        for n, (fields, block) in enumerate(arc_records(f)):
                            first = refers_to.get(n)
                            out.write(_member(warc_record(fields, block, "response" if first is None else "revisit", None if first is None else str(first))))

                write_atomically(f"{folder}/{out_name}", fill)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{out_name}"])], names=["path"])

    warcs = stored(by_file.mapInArrow(write, "path string"), "warc-list")
    discard(digests)
    return warcs


def read_warcs(warcs: DataFrame) -> DataFrame:
    """record_id, row, url, date, record_type, refers_to_id, payload_bytes, payload_digest of each record but warcinfo.

    A response's digest is computed anew and must be the one its header has.
    """

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = filesystem(path)
                rows = []
                with store.open_input_stream(name, compression=None) as f:
                    for headers, block in warc_records(f):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = http_parts(block)
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and sha1_base32(payload) != digest:
                            raise ValueError(f"{path}: {headers['warc-record-id']} does not have its digest")
                        row = http.get("x-row", "-")
                        size = len(payload) if kind == "response" else int(http["content-length"])
                        rows.append((headers["warc-record-id"], None if row == "-" else int(row), headers["warc-target-uri"], headers["warc-date"], kind, headers.get("warc-refers-to"), size, digest))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record_id", "row", "url", "date", "record_type", "refers_to_id", "payload_bytes", "payload_digest"])

    return _dealt(warcs).mapInArrow(read, "record_id string, row long, url string, date string, record_type string, refers_to_id string, payload_bytes long, payload_digest string")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """A row for each row of ``pages``, read back from the WARC files: id, payload_bytes, payload_digest, record_type, refers_to, url, date.

    Null html is an empty payload; null or empty URLs get ``urn:row:<id>``, white
    space and controls in others are percent-encoded. Rows with a null id are
    responses where no row of their payload has an id, else they revisit the
    largest. Repeated rows of the largest id are all responses. Other columns are
    not read. An empty table gives no rows.
    """
    arcs = write_arcs(pages, id_col, url_col, html_col)
    records = stored(read_warcs(convert(arcs, least_bytes)), "warc-records")
    for row in arcs.limit(1).collect():  # the ARC files were made here alone; the archives stay
        remove(arcs.sparkSession, row["path"].rsplit("/", 1)[0])
    responses = records.where("record_type = 'response' and row is not null").select(F.col("record_id").alias("refers_to_id"), F.col("row").alias("refers_to")).distinct()
    referred = records.select("refers_to_id").where("refers_to_id is not null").distinct()
    targets = responses.join(referred, "refers_to_id", "left_semi")
    joined = records.join(targets.select(F.concat("refers_to_id", F.lit("")).alias("refers_to_id"), "refers_to"), "refers_to_id", "left")
    return joined.select(F.col("row").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date")
