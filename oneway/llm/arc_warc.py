"""Legacy web archives: write and read ARC (versions 1 and 2), convert to WARC, write and read WARC.

An ARC file opens with a ``filedesc://`` record whose block names the version; every record is one header line, version 1 with 5
fields and version 2 with 10, ending in the declared length of the block that follows.  The converter synthesises what WARC
has and ARC lacks: record ids (from file, offset, url and date, so reruns agree), ISO timestamps, record types (warcinfo for
filedesc, response for HTTP blocks of http urls, else resource), block and payload digests (SHA-1, base 32), and revisits for
payloads that another record has in full.

Archives are gzip files with a member for each record, as both formats want, ended by an empty member.

Scale: a task packs records until a file has ``FILE_BYTES`` (before compression), whatever their sizes, and Spark's text writer stores
each file as one value, so archives land in any store Spark can write; they are read as binary files (of less than 2 GB).
Which records are revisits is settled on digests alone; then each ARC file meets its own list of revisits, so equal payloads never meet.

Rows: a null html is an empty payload, a null url becomes ``urn:page:none``, a null page_id stays null and counts as smallest.  Of
repeated rows with equal large payloads one is the response.  Truncated last records (ARC or WARC) keep what is there and are
marked, a WARC file that ends inside a record's header ends before it; header lines that do not parse are skipped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oneway.llm.shared import materialize, new_path
from oneway.llm.textkit import chunks, text_bytes

#: Bytes of records in an archive file, before compression; the last record may go over.
FILE_BYTES = 16 << 20
#: Payloads of at least so many bytes can be revisits.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}

#: Ends a file: a gzip member of nothing, since the text writer ends each value with a separator.
NOTHING = gzip.compress(b"", 1, mtime=0)
MEMBER_BYTES = 1 << 16
LEVEL = 4

ARC_ROW = "file string, offset long, version int, url string, ip string, date string, mime string, truncated boolean, block binary"
WARC_ROW = "file string, type string, record_id string, refers_to string, uri string, date string, payload_digest string, http string, truncated boolean, payload binary"


def _url(url: str | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~._-") if url else "urn:page:none"


def arc_header(version: int, url: str, ip: str, date: str, mime: str, n: int, status: str = "200", offset: int = 0, name: str = "-") -> bytes:
    middle = f" {status} - - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{middle} {n}\n".encode()


def arc_filedesc(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 oneway\n{FIELDS[version]}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(block), name=name) + block


def http_block(page_id, payload: bytes) -> bytes:
    known = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def read_arc(data: bytes) -> Iterator[tuple]:
    """(offset, version, url, ip, date, mime, truncated, block) of each record; the filedesc record comes first."""
    at, version = 0, 1
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        if line.startswith(b"filedesc://"):  # the version stands in the block, so look there first
            version = 2 if data[end + 1 : end + 3] == b"2 " else 1
        parts = line.rsplit(b" ", 9 if version == 2 else 4)
        if len(parts) != (10 if version == 2 else 5) or not parts[-1].isdigit():
            at = end + 1
            continue
        n = int(parts[-1])
        block = data[end + 1 : end + 1 + n]
        url, ip, date, mime = (x.decode("utf-8", "replace") for x in parts[:4])
        yield at, version, url, ip, date, mime, len(block) < n, block
        at = end + 1 + n


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head with its empty line, and the payload."""
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if block.startswith(b"HTTP/") and at >= 0 else (b"", block)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso(date: str) -> str:
    """A 14-digit (or shorter) date as WARC writes it."""
    d = (date if date.isdigit() else "").ljust(4, "1")[:14]
    d += "19700101000000"[len(d) :] if len(d) < 14 else ""
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(file: str, offset: int, url: str, date: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}|{offset}|{url}|{date}')}>"


def kind_of(url: str, block: bytes) -> str:
    if url.startswith("filedesc://"):
        return "warcinfo"
    return "response" if block.startswith(b"HTTP/") else "resource"


def warc_record(kind: str, rid: str, date: str, uri: str, ip: str, mime: str, block: bytes, refers_to: str | None = None, truncated: bool = False) -> bytes:
    """A record without its trailing empty lines.  A revisit keeps the HTTP head and leaves the payload out."""
    head, payload = split_http(block)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}"]
    if kind == "warcinfo":
        lines += [f"WARC-Filename: {uri.removeprefix('filedesc://')}", "Content-Type: application/warc-fields"]
        block = b"software: oneway\r\nformat: WARC File Format 1.1\r\n"
    else:
        lines += [f"WARC-Target-URI: {uri}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: {_sha1(payload)}"]
        lines += [f"Content-Type: {'application/http;msgtype=response' if head else mime}"]
        if refers_to:
            lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
            block = head
        if truncated:
            lines += ["WARC-Truncated: unspecified"]
    lines += [f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers in lower case, block, truncated) of each record."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0 and (end := data.find(b"\r\n\r\n", at)) >= 0:
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = headers.get("content-length", "")
        at = end + 4
        if size.isdigit():
            block = data[at : at + int(size)]
            yield headers, block, len(block) < int(size)
            at += int(size)


def packed(records: Iterable[bytes], opening: Callable[[int], bytes]) -> Iterator[pa.RecordBatch]:
    """Archive files of about FILE_BYTES: ``opening`` makes the first record of the file with a number."""
    members, size, n = [], 0, 0
    for record in records:
        if not members:
            members.append(gzip.compress(opening(n), LEVEL, mtime=0))
        members.append(gzip.compress(record, LEVEL, mtime=0))
        size += len(record)
        if size >= FILE_BYTES:
            yield pa.record_batch([pa.array([b"".join(members)], pa.binary())], names=["file"])
            members, size, n = [], 0, n + 1
    if members:
        yield pa.record_batch([pa.array([b"".join(members)], pa.binary())], names=["file"])


def _store(files: DataFrame, path: str) -> None:
    """One file per value."""
    text = files.select(F.col("file").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1"))
    text.option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """ARC files of pages (page_id, url, html), versions 1 and 2 in turn by partition."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version = 1 + part % 2

        def records():
            for batch in batches:
                for piece in chunks(batch, "html", 4 << 20):
                    for page_id, url, html in zip(piece.column("page_id").to_pylist(), piece.column("url").to_pylist(), text_bytes(piece.column("html"))):
                        block = http_block(page_id, html)
                        yield arc_header(version, _url(url), "0.0.0.0", date, "text/html", len(block)) + block + b"\n"

        yield from packed(records(), lambda n: arc_filedesc(version, f"pages-{part:05d}-{n:05d}.arc.gz", date) + b"\n")

    _store(pages.mapInArrow(run, "file binary"), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def plain(content: bytes) -> bytes:
    """An archive file's records: all members of a gzip file, or the file as it is.  A member that is cut off gives what it has."""
    if content[:2] != b"\x1f\x8b":
        return content
    at, out = 0, []
    while content[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while at < len(content) and not member.eof:
            piece = content[at : at + MEMBER_BYTES]
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        if not member.eof:
            out.append(member.flush())
    return b"".join(out)


def _contents(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
        yield file, plain(content.as_buffer().to_pybytes())


def _parts(rows: Iterable, each: int = 4 << 20):
    """Lists of records whose last values have about ``each`` bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1] or b"")
        if size >= each:
            yield held
            held, size = [], 0
    if held:
        yield held


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 4, pa.bool_(), pa.binary()]
        names = ["file", "offset", "version", "url", "ip", "date", "mime", "truncated", "block"]
        for batch in batches:
            for file, data in _contents(batch):
                for part in _parts((file, *r) for r in read_arc(data)):
                    yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*part), kinds)], names=names)

    return _files(spark, path).mapInArrow(run, ARC_ROW)


def _digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, record_id, page_id, digest, n) of the ARC records that can be revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"file": pa.string(), "offset": pa.int64(), "record_id": pa.string(), "page_id": pa.int64(), "digest": pa.string(), "n": pa.int64()}
        for batch in batches:
            for file, data in _contents(batch):
                rows = []
                for offset, _, url, _, date, _, _, block in read_arc(data):
                    if kind_of(url, block) == "response":
                        head, payload = split_http(block)
                        if len(payload) >= REVISIT_BYTES:
                            rows.append((file, offset, record_id(os.path.basename(file), offset, url, date), _page_id(head), hashlib.sha1(payload).hexdigest(), len(payload)))
                if rows:
                    yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    return _files(spark, path).mapInArrow(run, "file string, offset long, record_id string, page_id long, digest string, n long")


def _header(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n"):
        if line.lower().startswith(name + b":"):
            return line[len(name) + 1 :].strip()
    return None


def _page_id(head: bytes) -> int | None:
    found = _header(head, b"x-page-id")
    return int(found) if found else None


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """ARC files to WARC files, equal payloads of REVISIT_BYTES or more as revisits of the one with the largest page id."""
    found = materialize(_digests(spark, arc_path), "digests")
    whole = found.groupBy("digest", "n").agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), "record_id")).alias("keep"), F.count("*").alias("copies")).where("copies > 1")
    revisits = found.join(whole, ["digest", "n"]).where("record_id <> keep.record_id")
    revisits = revisits.groupBy("file").agg(F.collect_list("offset").alias("offsets"), F.collect_list("keep.record_id").alias("refers"))
    files = _files(spark, arc_path).join(revisits.hint("shuffle_hash"), "file", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last = [""]

        def records():
            for batch in batches:
                for (file, data), offsets, refers in zip(_contents(batch), batch.column("offsets").to_pylist(), batch.column("refers").to_pylist()):
                    known = dict(zip(offsets or (), refers or ()))
                    for offset, _, url, ip, date, mime, truncated, block in read_arc(data):
                        if not url.startswith("filedesc://"):
                            last[0] = iso(date)
                            refers_to = known.get(offset)
                            kind = "revisit" if refers_to else kind_of(url, block)
                            yield warc_record(kind, record_id(os.path.basename(file), offset, url, date), last[0], url, ip, mime, block, refers_to, truncated) + b"\r\n\r\n"

        def opening(n: int) -> bytes:
            name = f"pages-{part:05d}-{n:05d}.warc.gz"
            return warc_record("warcinfo", record_id(name, 0, name, ""), last[0], name, "", "", b"") + b"\r\n\r\n"

        yield from packed(records(), opening)

    _store(files.mapInArrow(run, "file binary"), warc_path)


def warc_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all WARC files under a path; a digest that does not fit its whole content is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "type", "record_id", "refers_to", "uri", "date", "payload_digest", "http", "truncated", "payload"]
        kinds = [*[pa.string()] * 8, pa.bool_(), pa.binary()]

        def rows(file, data):
            for h, block, truncated in read_warc(data):
                own = h.get("warc-block-digest")
                if own and not truncated and own != _sha1(block):
                    raise ValueError(f"{file}: {h.get('warc-record-id')} does not have its digest")
                head, payload = split_http(block)
                digest = h.get("warc-payload-digest")
                if digest and not truncated and h.get("warc-type") != "revisit" and digest != _sha1(payload):
                    raise ValueError(f"{file}: {h.get('warc-record-id')} does not have its payload digest")
                yield file, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, head.decode("latin-1"), truncated, payload if payloads else None

        for batch in batches:
            for file, data in _contents(batch):
                for part in _parts(rows(file, data)):
                    yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*part), kinds)], names=names)

    return _files(spark, path).mapInArrow(run, WARC_ROW)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages through ARC and WARC and back: page_id, payload_bytes, payload_digest (hex), record_type, refers_to, uri."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [x.encode("latin-1") for x in batch.column("http").to_pylist()]
            digest = [base64.b32decode(x.removeprefix("sha1:")).hex() for x in batch.column("payload_digest").to_pylist()]
            size = [int(_header(x, b"content-length") or 0) for x in heads]
            columns = [pa.array(list(map(_page_id, heads)), pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string())]
            yield pa.record_batch([*columns, *(batch.column(c) for c in ("type", "record_id", "refers_to", "uri"))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers", "uri"])

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers string, uri string"
    records = materialize(warc_records(spark, warc, payloads=False).where(F.col("type").isin("response", "revisit")).mapInArrow(run, kinds), "records")
    # small rows: one for each revisit and, on the other side, one for each response
    target = records.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").join(target, "refers", "left")
    responses = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"]
    return responses.select(columns).unionByName(revisits.select(columns))


def archive_sql() -> str:
    return f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
    g AS (SELECT d, n, max(page_id) AS keep FROM p WHERE n >= {REVISIT_BYTES} GROUP BY ALL)
    SELECT page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
           CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN keep <> page_id THEN keep END AS refers_to
    FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n"""
