"""Web archives: pages written as WARC records, one gzip member each, and read back record by record.

Writing. Every page becomes a record whose block is an HTTP answer with the html in UTF-8 as payload. Pages of equal payload (by SHA-1 and
size) share one response, that with the largest page_id; the others are revisit records, which name it and hold the HTTP header alone,
whose Content-Length is the size of the payload. Only digests are grouped, in partial results, so a payload that a third of all pages
share is summed up where it lies; its pages are told apart by a join that Spark splits or broadcasts by measured size. Each task
appends records to archives of its own in `folder`, begins a new one every ARCHIVE_BYTES, and reports them; only archives in that report
are part of the result, so what a lost or repeated task left behind is never read.

Reading. A task opens an archive as a stream and inflates it piece by piece: a member is a record; its header says how long the block
is, the block must be followed by two line ends and the end of the member. Memory holds one record and one piece. Digests of block and payload are
computed anew. A member that can't be inflated or whose framing is wrong gives a row with the reason, and reading goes on at the next
member that begins a record.

A null html counts as empty. A null page_id is smaller than any other; a null url is written as about:blank. Control characters, white
space and characters beyond ASCII of a url are percent-encoded. Rows that share page_id and payload with the response are responses as
well (one capture listed twice). Payloads below `least` bytes are all responses. An empty table gives no archives and no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import stored, table
from docfields.sources.tables import shared_folder

#: Bytes from which on a task begins a new archive, and bytes that are read or inflated at once.
ARCHIVE_BYTES, PIECE = 1 << 28, 1 << 18
#: Payloads from so many bytes on are written once.
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
RECORD = (
    "archive string, offset long, type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, "
    "payload binary, intact boolean, problem string"
)


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that driver and executors share; a path without scheme is a mounted folder."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- writing
def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member."""
    lines = [*headers, ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode()) + squeeze.compress(block) + squeeze.compress(END) + squeeze.flush()


def name_of(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = DATE) -> bytes:
    """A response, or with `revisit` the record that stands for an equal payload of page `refers_to`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name_of(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url if url is not None else "about:blank", safe="".join(map(chr, range(33, 127))), errors="replace")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", name_of(refers_to)),
        ]
    return record(headers, http if revisit else http + payload)


def one_response(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, refers_to, revisit of every page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    shared = rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.count("*").alias("pages"), F.max("page_id").alias("first"))
    shared = stored(shared.filter("pages > 1").select("digest", "size", "first"), "warc-shared")
    known = rows.join(shared, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Writes `pages` (page_id, url, html) as archives into `folder`; gives archive (path), records, bytes of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = place(folder)
        out, path, records, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            # the rows of a batch one by one: texts may be long
            for page_id, url, payload, refers_to, revisit in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    # a name of its own for each attempt
                    path, records, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path, compression=None)
                    info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size += len(info)
                member = page_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py(), date)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["archive", "records", "bytes"])

    files, base = place(folder)
    files.create_dir(base, recursive=True)
    return stored(one_response(pages, least).mapInArrow(write, "archive string, records long, bytes long"), "warc-archives")


# ---------------------------------------------------------------- reading
class Broken(ValueError):
    """A member that is no whole record."""


def members(stream, piece: int = PIECE) -> Iterator[tuple[int, bytes | Broken]]:
    """(offset, inflated member) of a stream of gzip members, or (offset, what is wrong with it). A broken member is left at the next
    place where a member with a record begins; of the raw stream only the member at hand is kept, for that."""
    raw, start, ended = bytearray(), 0, False

    def more() -> bool:
        nonlocal ended
        data = stream.read(piece)
        ended = not data
        raw.extend(data)
        return not ended

    def left(n: int) -> None:
        nonlocal start
        del raw[:n]
        start += n

    def begins(at: int) -> bool:
        """Whether a member with the first bytes of a record begins there."""
        try:
            return zlib.decompressobj(31).decompress(bytes(raw[at : at + 4096]), 5).startswith(b"WARC/")
        except zlib.error:
            return False

    while raw or more():
        inflate, used, out, problem = zlib.decompressobj(31), 0, [], None
        try:
            while not inflate.eof:
                if used == len(raw) and not more():
                    raise Broken("the archive ends inside a record")
                fed = bytes(raw[used : used + 16_384])
                out.append(inflate.decompress(fed))
                used += len(fed)
        except (zlib.error, Broken) as e:
            problem = e if isinstance(e, Broken) else Broken(f"not inflatable: {e}")
        yield start, problem or b"".join(out)
        if problem is None:
            left(used - len(inflate.unused_data))
            continue
        left(1)
        while raw or more():
            at = raw.find(b"\x1f\x8b\x08")
            if at < 0:  # its first bytes may be the last ones here
                left(max(0, len(raw) - 2))
                if not more():
                    left(len(raw))
            elif at + 4096 > len(raw) and not ended:
                more()
            elif begins(at):
                left(at)
                break
            else:
                left(at + 1)


def parsed(member: bytes) -> dict:
    """Fields of a record; Broken if its framing is wrong."""
    head, mark, rest = member.partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise Broken("no record header")
    named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = named.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Broken("no content length")
    block, tail = rest[: int(length)], rest[int(length) :]
    if len(block) < int(length) or tail != END:
        raise Broken("the content length does not fit the record")

    def page(field: str) -> int | None:
        value = named.get(field, "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(value) if value.lstrip("-").isdecimal() else None

    bare = lambda field: named.get(field, "").removeprefix("sha1:") or None
    intact = bare("warc-block-digest") in (None, base32_sha1(block))
    kind, payload, size, digest = named.get("warc-type"), None, None, bare("warc-payload-digest")
    if kind in ("response", "revisit"):
        http, _, body = block.partition(END)
        lengths = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        said = int(lengths[0]) if lengths and lengths[0].strip().isdigit() else None
        if kind == "response":
            own = base32_sha1(body)
            intact &= digest in (None, own) and said in (None, len(body))
            payload, size, digest = body, len(body), own
        else:
            size = said
    return {
        "type": kind, "page_id": page("warc-record-id"), "refers_to": page("warc-refers-to"), "url": named.get("warc-target-uri"),
        "payload_bytes": size, "payload_digest": digest, "payload": payload, "intact": intact, "problem": None,
    }


def records_of(archive: str, stream, payloads: bool) -> Iterator[dict]:
    for offset, member in members(stream):
        try:
            if isinstance(member, Broken):
                raise member
            row = parsed(member)
        except Broken as e:
            row = dict.fromkeys(("type", "page_id", "refers_to", "url", "payload_bytes", "payload_digest", "payload")) | {"intact": False, "problem": str(e)}
        if not payloads:
            row["payload"] = None
        yield {"archive": archive, "offset": offset, **row}


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives (paths in column archive): archive, offset, type, page_id, refers_to, url, payload_bytes, payload_digest, payload, intact
    (all digests and lengths agree), problem. Without `payloads` they are read and verified, but not given. page_id and refers_to are those
    that `write_archives` puts into record ids, null in archives of other origin."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    bound = 1 << 24

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("archive", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("intact", pa.bool_()), ("problem", pa.string())]
        )
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, path = place(archive)
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for row in records_of(archive, stream, payloads):
                        rows.append(row)
                        held += len(row["payload"] or b"")
                        if held > bound or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # one archive a task; a given number of partitions is not merged for being small
    spread = archives.select("archive").repartition(max(1, archives.count()))
    return spread.mapInArrow(read, RECORD).select(*names)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    read = read_archives(write_archives(table(spark, sf_dir, "pages"), folder), payloads=False)
    pages = read.filter("coalesce(type, 'broken') <> 'warcinfo'")
    fine = F.assert_true(F.col("intact"), F.concat_ws(" ", F.lit("broken record in"), "archive", F.col("offset").cast("string"), "problem"))
    return pages.filter(fine.isNull()).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"
    )


#: The same rows in DuckDB.
ORACLE = """
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
headed AS (SELECT *, max(page_id) OVER (PARTITION BY digest, payload_bytes) AS head FROM sized),
coded AS (
  SELECT *, list_reduce(list_transform(range(8), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(digest, 5 * i::INT + 1, 5))::INT >> s::INT) & 31) + 1), 1)),
    lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest FROM headed)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to FROM coded
"""
