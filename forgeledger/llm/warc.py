"""WARC archives of web pages: written from a table, and read back by tasks that scan ranges of bytes.

Every record is a gzip member of its own. A page whose payload another page has too is a revisit of
the one with the largest id and stores the headers alone. Tasks write archives below a folder of any
file system that ``pyarrow.fs`` opens by its address; the manifest of finished archives is a Parquet table, so
that files of tasks that were lost or run twice are never read.

A reading task gets a range of bytes of an archive. It looks for the magic bytes of a gzip member, takes
a place only if a WARC header decodes there, and reads each record that starts in its range to
its end, wherever that lies; records that started earlier belong to the task before.

Columns ``page_id, url, html`` are read. Null ``html`` is an empty payload and a null ``url`` leaves the target out.
A page without an id is written without one, never stands for others and reads back with a null id. Rows that
repeat an id and its payload are records of the same kind. An empty table makes no archive and gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, scratch_path

ARCHIVE_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
#: Tasks that read archives; beyond that a task reads several ranges.
READERS = 50_000
MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 18
#: Record ids of pages.
_PAGE = "urn:x-page:"
# Fixed values of the format.
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One compressed record. A revisit keeps the HTTP headers, which tell the payload's length."""
    digest = "sha1:" + _base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = f"{_PAGE}{page_id}" if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, digest).urn
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head.append(f"WARC-Payload-Digest: {digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", f"WARC-Profile: {_REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def _write(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        out, path, size, n = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.record_batch({"path": [f"{folder}/{path}"], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    # The folder may be new to this task; a name of its own keeps attempts apart.
                    store.create_dir(root, recursive=True)
                    path, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                data = record(page_id, url, (html or "").encode(), refers_to)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archives; returns the manifest ``path, bytes, records``.

    Payloads of fewer than ``min_bytes`` bytes are always written whole.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"),
        F.unhex(F.sha1(payload.cast("binary"))).alias("digest"),
    )
    heads = durable(
        rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n"),
        "payload-heads",
    )
    # Both sides of the join are exchanged, so that a payload of very many pages can be split at run time.
    kinds = rows.join(heads.hint("merge"), "digest", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to")
    )
    return durable(kinds.mapInArrow(_write(folder), "path string, bytes bigint, records bigint"), "warc-manifest")


class _Window:
    """A file's bytes from some place on, read as they are asked for."""

    def __init__(self, source, begin: int):
        self.source, self.begin, self.data, self.ended = source, begin, b"", False

    def more(self) -> bool:
        self.source.seek(self.begin + len(self.data))
        got = self.source.read(_READ)
        self.ended = not got
        self.data += got
        return bool(got)

    def forget(self, n: int) -> None:
        self.begin, self.data = self.begin + n, self.data[n:]


def _decode(window: _Window, whole: bool) -> tuple[bytes, int] | None:
    """The member at the window's beginning, whole or its first bytes, and its compressed length; None if it is no record."""
    unpacker, out, at = zlib.decompressobj(31), [], 0
    try:
        while not unpacker.eof:
            if at >= len(window.data) and not window.more():
                return None
            step = window.data[at : at + _READ] if whole else window.data[at : at + 512]
            at += len(step)
            out.append(unpacker.decompress(step))
            if not whole and sum(map(len, out)) >= 64:
                break
    except zlib.error:
        return None
    data = b"".join(out)
    if not data.startswith(b"WARC/1."):
        return None
    return data, at - len(unpacker.unused_data)


def records(source, begin: int, end: int, chained: bool = False) -> Iterator[bytes]:
    """The records that start in ``[begin, end)`` of an open file.

    If ``chained``, the file must begin with a record and each must be followed by another or the file's end; what
    cannot be read raises. Each range looks at the record after its last, so all ranges together miss none.
    """
    window = _Window(source, begin)
    follows = chained and begin == 0
    while window.begin < end or follows:
        while len(window.data) < len(MAGIC) and window.more():
            pass
        if follows and not window.data:
            return
        at = 0 if follows else window.data.find(MAGIC)
        if at < 0:
            if window.ended or not window.data:
                return
            window.forget(max(0, len(window.data) - len(MAGIC) + 1))
            if not window.more():
                return
            continue
        window.forget(at)
        if window.begin >= end and not follows:
            return
        # The beginning is decoded first, so that a chance hit costs little; then the record to its end.
        head = _decode(window, False)
        if head and window.begin >= end:
            return
        found = head and _decode(window, True)
        if found:
            yield found[0]
        elif chained and (head or follows):
            raise ValueError(f"the record at byte {window.begin} is damaged or cut off")
        window.forget(found[1] if found else 1)
        follows = chained and bool(found)


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _page(name: str | None) -> int | None:
    name = (name or "").strip("<>")
    return int(name[len(_PAGE) :]) if name.startswith(_PAGE) else None


def parsed(data: bytes) -> tuple:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        found = _base32(hashlib.sha1(payload).digest())
        if digest and digest != found:
            raise ValueError(f"the payload of {fields.get('warc-record-id')} has digest {found}, its header says {digest}")
        size, digest = len(payload), found
    else:
        size, payload = int(_fields(http).get("content-length", 0)), None
    return (_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, digest, kind, _page(fields.get("warc-refers-to")), payload)


_SHAPE = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
     ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            store, name = pyarrow.fs.FileSystem.from_uri(path)
            rows: list[tuple] = []
            held = 0
            with store.open_input_file(name) as source:
                if source.size() != size:
                    raise ValueError(f"{path} has {source.size()} bytes, the manifest says {size}")
                for data in records(source, begin, end, chained=True):
                    rows.append(parsed(data))
                    held += len(data)
                    if held >= 8 << 20:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SHAPE, strict=True)], schema=_SHAPE)
                        rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SHAPE, strict=True)], schema=_SHAPE)


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, readers: int = READERS) -> DataFrame:
    """All records of the manifest's archives (columns ``path, bytes``), a task for each range of bytes, at most ``readers``.

    An archive of another size, or with a record that cannot be read, raises.
    """
    begins = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))
    ranges = durable(
        manifest.select("path", "bytes", F.explode(begins).alias("begin"))
        .select("path", "bytes", "begin", F.least(F.col("begin") + split_bytes, F.col("bytes")).alias("end")),
        "warc-ranges",
    )
    shape = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    # A fixed number of partitions is not merged at run time, small as its rows are.
    return ranges.repartition(max(1, min(readers, ranges.count()))).mapInArrow(_read, shape)
